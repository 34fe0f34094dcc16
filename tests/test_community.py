"""Leiden, modularity, pooling and labels."""

import numpy as np
import pytest

from callscope.operators import community, graph
from callscope.schema import TABLES, UNGROUPED_ID
from callscope.operators.store import empty


def cliques(sizes, bridge=True):
    edges, at = [], 0
    for n in sizes:
        edges += [(at + i, at + j) for i in range(n) for j in range(i)]
        if bridge and at:
            edges.append((at - 1, at))
        at += n
    s, t = np.array(edges).T
    return at, s, t


def modularity(n, s, t, label):
    d = np.bincount(np.concatenate([s, t]), minlength=n)
    inside = np.bincount(label[s[label[s] == label[t]]], minlength=n)
    total = np.bincount(label, d, n)
    return (inside / len(s) - (total / (2 * len(s))) ** 2).sum()


def test_two_cliques_are_two_communities():
    n, s, t = cliques([4, 4])
    found = community.leiden(n, s, t, np.ones(len(s)))
    assert len(set(found[:4])) == len(set(found[4:])) == 1 and len(set(found)) == 2


@pytest.mark.parametrize("seed", range(4))
def test_random_graphs_give_connected_communities(seed):
    rng = np.random.default_rng(seed)
    n = 200
    block = np.arange(n) // 25
    pairs = rng.integers(0, n, (4000, 2))
    keep = (pairs[:, 0] != pairs[:, 1]) & ((block[pairs[:, 0]] == block[pairs[:, 1]]) | (rng.random(4000) < 0.02))
    s, t = np.unique(np.sort(pairs[keep], axis=1), axis=0).T
    found = community.leiden(n, s, t, np.ones(len(s)))
    assert np.array_equal(found, community.leiden(n, s, t, np.ones(len(s))))
    assert modularity(n, s, t, np.unique(found, return_inverse=True)[1]) >= modularity(n, s, t, block) - 0.02
    for c in set(found.tolist()):
        members = set(np.flatnonzero(found == c).tolist())
        seen, todo = set(), [min(members)]
        while todo:
            v = todo.pop()
            seen.add(v)
            todo += [x for x in {*t[s == v].tolist(), *s[t == v].tolist()} if x in members and x not in seen]
        assert seen == members


def source_graph(spark, groups):
    g = empty(spark)
    rows, calls, files = [], [], []
    blank = dict.fromkeys(c.split()[0] for c in TABLES["functions"].split(", "))
    for k, n in enumerate(groups):
        files.append(("o/r", f"f{k}.py", None))
        for i in range(n):
            rows.append(tuple((blank | {"repo_name": "o/r", "entity_id": f"{k}-{i}", "name": f"n{k}{i}", "qualified_name": f"n{k}{i}", "file_path": f"f{k}.py"}).values()))
            calls += [("o/r", f"{k}-{i}", "Function", f"{k}-{j}", "lexical_scope", 1, f"f{k}.py") for j in range(n) if j != i]
    g.functions = spark.createDataFrame(rows, TABLES["functions"])
    g.files = spark.createDataFrame(files, TABLES["files"])
    g.calls = spark.createDataFrame(calls, TABLES["calls"])
    return g


@pytest.mark.parametrize("kernel_edges", [10_000, 0])
def test_files_of_mutual_calls_are_communities(spark, kernel_edges):
    """By the kernel and by joins alike."""
    found = {r.entity_id: r.leiden_community for r in community.detect(source_graph(spark, [4, 4]), kernel_edges).collect()}
    assert len(found) == 8
    assert len({c for e, c in found.items() if e[0] == "0"}) == len({c for e, c in found.items() if e[0] == "1"}) == 1
    assert len(set(found.values())) == 2


def test_a_function_without_edges_is_alone(spark):
    g = source_graph(spark, [1])
    g.files = g.files.limit(0)
    assert [r.leiden_community for r in community.detect(g).collect()] == [0]
    assert community.detect(empty(spark)).count() == 0


def test_small_communities_are_pooled_and_large_ones_labelled(spark):
    g = source_graph(spark, [5, 2, 1])
    from pyspark.sql import functions as F

    functions = g.functions.withColumn("leiden_community", F.substring("entity_id", 1, 1).cast("bigint"))
    moved, labels = community.label(functions)
    assert {r.community_id: r.name for r in labels.collect()} == {0: "f0.py", UNGROUPED_ID: "Ungrouped"}
    assert sorted(r.leiden_community for r in moved.collect()) == [UNGROUPED_ID] * 3 + [0] * 5


def test_labels_must_match(spark):
    from pyspark.sql import functions as F

    functions = source_graph(spark, [3]).functions.withColumn("leiden_community", F.lit(7).cast("bigint"))
    with pytest.raises(Exception, match="do not match"):
        community.label(functions, lambda rows: [{"id": 8, "name": "x", "description": ""}])[1].collect()


def test_legend_order_and_fallback(spark):
    rows = [(k, c, "Auth" if c == 7 else f"Cluster #{c}", "") for k, c in enumerate([1, 7, 7, 3, 3, 3, 2, 2])] + [(9, None, None, None)]
    df = spark.createDataFrame([("r", str(k), c, n, x) for k, c, n, x in rows], "repo_name string, id string, community bigint, community_name string, community_description string")
    got = [(r.id, r["count"], r.name) for r in graph.legend(df).collect()]
    assert got == [(3, 3, "Cluster #3"), (2, 2, "Cluster #2"), (7, 2, "Auth"), (1, 1, "Cluster #1"), (None, 1, None)]


def test_report_of_an_empty_repository(spark):
    g = source_graph(spark, [3])
    g.functions = community.write_back(g.functions, community.detect(g))
    repositories = spark.createDataFrame([("o/r",), ("o/empty",)], "repo_name string")
    got = {r.repo_name: r.asDict() for r in community.report(g.functions, community.projection(g), repositories).collect()}
    assert got["o/empty"] == {"repo_name": "o/empty", "community_count": 0, "function_count": 0, "singleton_count": 0, "projected_nodes": 0, "projected_relationships": 0, "singleton_ratio": 0.0, "warning": False}
    assert (got["o/r"]["community_count"], got["o/r"]["function_count"], got["o/r"]["projected_nodes"]) == (1, 3, 4)


def test_running_numbers_against_sorted_rows(spark):
    import random

    rng = random.Random(1)
    rows = sorted({("big" if rng.random() < 0.9 else f"r{rng.randrange(3)}", rng.choice("FG"), str(rng.randrange(10**6))) for _ in range(3000)})
    df = spark.createDataFrame(rows, "repo_name string, kind string, id string").repartition(7)
    want = {}
    for r in rows:
        want[r] = sum(1 for x in want if x[0] == r[0])
    got = {(r.repo_name, r.kind, r.id): r.ordinal for r in graph.running_number(df, "repo_name", "kind", "id").collect()}
    assert got == want
