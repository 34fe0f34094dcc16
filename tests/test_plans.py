"""What the plans of the large queries must hold: one exchange per key, no sort of edges by a hot key."""

import re

import pytest

from callscope.operators import graph, resolve
from callscope.plans import registry, sample

DATA = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def scans(text, name):
    return len(re.findall(rf"FileScan parquet [^\n]*/{name}\.parquet", text))


@pytest.mark.parametrize("name", ["resolve_internal", "resolve_external", "resolve_ambiguous", "legacy_callers", "callers", "outgoing_deps", "outgoing_grouped", "edges_with_ends", "graph_expanded", "graph_window", "adjacency", "degrees", "most_connected", "cluster_highlight", "orphan_externals", "callers_of_one"])
def test_lines_are_read_and_dealt_by_order_once(spark, name):
    assert scans(plan(registry.QUERIES[name](spark, DATA)), "lineitem") == 1


def test_a_small_file_of_definitions_is_dealt_out_before_work(spark):
    text = plan(sample.definitions(spark, DATA))
    assert text.count("REPARTITION_BY_COL") >= scans(text, "part") > 0


def test_the_resolver_deals_sites_by_the_key_of_their_join(spark):
    defs = sample.definitions(spark, DATA)
    text = plan(resolve.resolve(sample.sites(spark, DATA, defs), defs))
    by_caller = [line for line in text.splitlines() if "Exchange" in line and "caller_id" in line]
    assert by_caller == [] and re.search(r"ShuffledHashJoin \[repo_name#\d+, file_path#\d+, name#\d+\]", text)


@pytest.mark.parametrize("name", ["callers", "outgoing_deps", "outgoing_grouped", "legacy_callers", "edges_with_ends", "cluster_highlight", "graph_expanded"])
def test_edges_are_not_sorted_by_their_target(spark, name):
    text = plan(registry.QUERIES[name](spark, DATA))
    assert not re.search(r"SortMergeJoin \[[^\]]*target", text) and re.search(r"ShuffledHashJoin \[[^\]]*target", text)


def test_nodes_without_edges_do_not_meet_in_one_key(spark):
    """The window joins targets to edges, not to nodes, of which those without edges have a null target."""
    text = plan(graph.window(sample.sample_graph(spark, DATA), None))
    ends = next(line for line in text.splitlines() if re.search(r"Join \[repo_name#\d+, target#\d+\]", line))
    nodes = next(line for line in text.splitlines() if re.search(r"Join \[repo_name#\d+, kind#\d+, id#\d+\]", line))
    depth = lambda line: len(re.match(r"[ :]*", line)[0])
    assert depth(nodes) < depth(ends)


def test_degrees_are_worked_out_once_for_sizes_and_repositories_are_no_hot_key(spark):
    text = plan(registry.QUERIES["node_sizes"](spark, DATA))
    assert scans(text, "lineitem") == 0 and not re.search(r"SortMergeJoin \[repo_name#\d+\]", text)


def test_files_of_one_partition_are_parsed_in_many_tasks(spark):
    from callscope.sources.files import parse_files

    files = spark.range(200).selectExpr("'o/r' AS repo_name", "concat('f', id, '.py') AS path", "CAST('def f(): pass' AS BINARY) AS content").coalesce(1)
    parsed = parse_files(files)
    tasks = {r[0] for r in parsed.selectExpr("spark_partition_id() AS task").distinct().collect()}
    assert len(tasks) >= spark.sparkContext.defaultParallelism and parsed.where("error IS NULL").count() == 200


def test_external_callees_are_found_once_before_they_are_compared(spark):
    text = plan(registry.QUERIES["orphan_externals"](spark, DATA))
    below = text[text.index("LeftAnti") :]
    assert re.search(r"HashAggregate\(keys=\[repo_name#\d+, name#\d+\], functions=\[\]", below)
