"""Queries over a source graph.  Each takes the graph's tables and returns a DataFrame.

Filters on ``repo_name`` come first, so they reach the partitions of the stored tables.
Sorts put nulls last.  A few callees are called by most: tables with a row per key are the
hashed sides of joins with edges, which stream past them without a sort.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from callscope.functions import view
from callscope.operators.checkpoints import cut
from callscope.schema import EXTERNAL, FUNCTION, UNGROUPED_ID

CALLER_LIMIT, WINDOW_LIMIT, NAME_SAMPLE, PATH_SAMPLE = 100, 200, 15, 5


@dataclass
class Graph:
    """The tables of :mod:`callscope.schema`, of one repository or of many."""

    files: DataFrame
    functions: DataFrame
    external_functions: DataFrame
    calls: DataFrame
    communities: DataFrame
    repositories: DataFrame

    def of(self, repo: str) -> Graph:
        return Graph(**{k: v.where(F.col("repo_name") == repo) for k, v in self.__dict__.items()})


def _display(prefix: str = "") -> Column:
    return F.coalesce(f"{prefix}qualified_name", f"{prefix}name")


def targets(g: Graph) -> DataFrame:
    """Everything that can be called: repo_name, kind, key, name, qualified_name, file_path."""
    inside = g.functions.select("repo_name", F.lit(FUNCTION).alias("kind"), F.col("entity_id").alias("key"), "name", "qualified_name", "file_path")
    none = F.lit(None).cast("string")
    outside = g.external_functions.select("repo_name", F.lit(EXTERNAL).alias("kind"), F.col("name").alias("key"), "name", none.alias("qualified_name"), none.alias("file_path"))
    return inside.unionByName(outside)


def _hashed(rows: DataFrame) -> DataFrame:
    """``rows``, which have a row per key, as the hashed side of a join."""
    return rows.hint("shuffle_hash")


def _linked(g: Graph, callers: DataFrame, called: DataFrame, hashed: bool = True) -> DataFrame:
    """Edges with caller (c_) and target (t_) columns; both must exist in one repository.  Without ``hashed``, for sides filtered by name, the joins are left to the planner."""
    c = callers.select("repo_name", F.col("entity_id").alias("caller_id"), F.col("name").alias("c_name"), F.col("qualified_name").alias("c_qualified_name"), F.col("file_path").alias("c_file"))
    t = called.select("repo_name", F.col("kind").alias("target_kind"), F.col("key").alias("target_key"), F.col("name").alias("t_name"), F.col("qualified_name").alias("t_qualified_name"), F.col("file_path").alias("t_file"))
    if not hashed:
        return g.calls.join(t, ["repo_name", "target_kind", "target_key"]).join(c, ["repo_name", "caller_id"])
    # Calls are dealt by caller as they come from the resolver, so this order has one exchange of edges.
    return g.calls.join(_hashed(c), ["repo_name", "caller_id"]).join(_hashed(t), ["repo_name", "target_kind", "target_key"])


def by(rows: DataFrame, *columns: str) -> DataFrame:
    """Rows in order of columns, nulls last.  Operators leave their rows unordered; those who show them ask for it."""
    return rows.orderBy(*(F.col(c).asc_nulls_last() for c in columns))


def _named(name: str | None) -> Column:
    return F.lit(True) if name is None else (F.col("name") == name) | (F.col("qualified_name") == name)


def callers(g: Graph, name: str | None = None, limit: int = CALLER_LIMIT) -> DataFrame:
    """Direct callers of what is named so (simple or qualified), the first ``limit`` by caller and file.

    Without a name: of every name, the first ``limit`` of each.  func_name is the target's simple name.
    """
    rows = _linked(g, g.functions, targets(g).where(_named(name)), hashed=name is None)
    rows = rows.select("repo_name", F.col("t_name").alias("func_name"), _display("c_").alias("caller"), "c_file", _display("t_").alias("target"), F.col("t_file").alias("target_file"), (F.col("target_kind") == EXTERNAL).alias("target_is_external"))
    keys = ["repo_name", "func_name", "caller", "target", "target_file", "target_is_external"]
    # Once each before they are gathered: numbers of keys are summed up where they are read, sets are not.
    grouped = rows.distinct().groupBy(*keys).agg(F.sort_array(F.collect_set("c_file")).alias("file_paths"))
    order = [F.col("caller").asc_nulls_last(), F.col("target_file").asc_nulls_last(), F.col("target").asc_nulls_last(), F.col("target_is_external")]
    if name is not None:
        return grouped.orderBy(*order).limit(limit)
    return grouped.withColumn("_n", F.row_number().over(W.partitionBy("repo_name", "func_name").orderBy(*order))).where(F.col("_n") <= limit).drop("_n")


def outgoing(g: Graph, name: str | None = None, ordered: bool = False) -> DataFrame:
    """What functions of this name call, of all functions without a name; ``ordered``: by caller's file and name, target and its file."""
    rows = _linked(g, g.functions.where(_named(name)), targets(g), hashed=name is None)
    rows = rows.select("repo_name", _display("c_").alias("caller_name"), F.col("c_file").alias("caller_file"), _display("t_").alias("target_name"), F.col("t_file").alias("target_file"), (F.col("target_kind") == EXTERNAL).alias("is_external"))
    return by(rows, "caller_file", "caller_name", "target_name", "target_file") if ordered else rows


def grouped_dependencies(out: DataFrame) -> DataFrame:
    """Dependencies of each (caller, file) as sorted lines, and how many."""
    line = F.when(F.col("is_external"), F.concat(F.col("target_name"), F.lit(" (External/Built-in)"))).otherwise(F.concat("target_name", F.lit(" ("), F.coalesce("target_file", F.lit("unknown file")), F.lit(")")))
    rows = out.where(F.col("target_name").isNotNull()).withColumn("line", line)
    listed = F.transform(F.array_sort(F.collect_list(F.struct("target_name", "target_file", "line"))), lambda x: x["line"])
    return rows.groupBy("repo_name", "caller_name", "caller_file").agg(listed.alias("dependencies"), F.count(F.lit(1)).alias("n"))


def file_list(g: Graph, ordered: bool = False) -> DataFrame:
    rows = g.files.select("repo_name", F.col("path").alias("file_path"))
    return by(rows, "repo_name", "file_path") if ordered else rows


def functions_in_file(g: Graph, path: str | None = None, ordered: bool = False) -> DataFrame:
    """Functions of a file (or of all), only of files that exist; ``ordered``: by file, start line and name."""
    at = F.lit(True) if path is None else F.col("file_path") == path
    rows = g.functions.where(at).select("repo_name", "file_path", _display().alias("function_name"), "start_line")
    kept = rows.join(g.files.select("repo_name", F.col("path").alias("file_path")), ["repo_name", "file_path"], "left_semi")
    return by(kept, "repo_name", "file_path", "start_line", "function_name") if ordered else kept


def external_list(g: Graph, ordered: bool = False) -> DataFrame:
    rows = g.external_functions.select("repo_name", F.col("name").alias("function_name"))
    return by(rows, "repo_name", "function_name") if ordered else rows


def subsystems(g: Graph) -> DataFrame:
    """Communities with their number of functions, none included, largest first."""
    sizes = g.functions.where(F.col("leiden_community").isNotNull()).groupBy("repo_name", F.col("leiden_community").alias("community_id")).agg(F.count(F.lit(1)).alias("n"))
    rows = g.communities.join(sizes, ["repo_name", "community_id"], "left")
    rows = rows.select("repo_name", F.col("community_id").alias("id"), F.col("name").alias("module_title"), F.col("description").alias("module_description"), F.coalesce("n", F.lit(0)).alias("function_count"))
    return rows.orderBy(F.col("function_count").desc(), "repo_name", "id")


def defines(g: Graph) -> DataFrame:
    """Edges from files to the functions they define."""
    f = g.files.select("repo_name", F.col("path").alias("file_path"))
    return g.functions.select("repo_name", "file_path", "entity_id").join(f, ["repo_name", "file_path"], "left_semi")


def nodes(g: Graph) -> DataFrame:
    """Files and functions: repo_name, kind, id, label, community; without code or vectors."""
    f = g.files.select("repo_name", F.lit("File").alias("kind"), F.col("path").alias("id"), F.col("path").alias("label"), F.col("path").alias("file_path"), F.lit(None).cast("bigint").alias("community"))
    label = view.node_label(F.col("qualified_name"), F.col("name"), F.lit(None).cast("string"), F.lit(FUNCTION))
    fn = g.functions.select("repo_name", F.lit(FUNCTION).alias("kind"), F.col("entity_id").alias("id"), label.alias("label"), "file_path", F.col("leiden_community").alias("community"))
    return f.unionByName(fn).dropDuplicates(["repo_name", "kind", "id"])


def edges(g: Graph) -> DataFrame:
    """DEFINES and CALLS: repo_name, kind, source_kind, source, target_kind, target."""
    d = defines(g).select("repo_name", F.lit("DEFINES").alias("edge"), F.lit("File").alias("source_kind"), F.col("file_path").alias("source"), F.lit(FUNCTION).alias("target_kind"), F.col("entity_id").alias("target"))
    c = g.calls.select("repo_name", F.lit("CALLS").alias("edge"), F.lit(FUNCTION).alias("source_kind"), F.col("caller_id").alias("source"), "target_kind", F.col("target_key").alias("target"))
    return d.unionByName(c)


def window(g: Graph, limit: int | None = WINDOW_LIMIT) -> DataFrame:
    """Nodes with their outgoing edges (none: nulls) and the community names of both ends, the first ``limit`` in a fixed order."""
    named = g.communities.select("repo_name", F.col("community_id"), F.col("name").alias("cname"), F.col("description").alias("cdesc"))
    n = nodes(g)
    ends = g.functions.select("repo_name", F.lit(FUNCTION).alias("target_kind"), F.col("entity_id").alias("target"), F.col("leiden_community").alias("m_community"))
    out = edges(g).select("repo_name", F.col("source_kind").alias("kind"), F.col("source").alias("id"), "edge", "target_kind", "target")
    # Edges get their target's community first: nodes without edges would meet as one null key.
    out = out.join(_hashed(ends), ["repo_name", "target_kind", "target"], "left")
    rows = _hashed(n).join(out, ["repo_name", "kind", "id"], "left")
    of = lambda c, p: named.select("repo_name", F.col("community_id").alias(c), F.col("cname").alias(f"{p}_community_name"), F.col("cdesc").alias(f"{p}_community_description"))
    rows = rows.join(of("community", "n"), ["repo_name", "community"], "left").join(of("m_community", "m"), ["repo_name", "m_community"], "left")
    rows = rows.select("repo_name", "kind", "id", "label", "community", "edge", "target_kind", "target", "n_community_name", "n_community_description", "m_community_name", "m_community_description")
    if limit is None:
        return rows
    return rows.orderBy("repo_name", "kind", "id", F.col("edge").asc_nulls_last(), F.col("target_kind").asc_nulls_last(), F.col("target").asc_nulls_last()).limit(limit)


def running_number(rows: DataFrame, group: str, *order: str) -> DataFrame:
    """``rows`` with ordinal, from 0 within each ``group`` in ``order``, no group in one task.

    Rows are dealt by ranges of (group, order); a row's number is its place in its range plus
    the rows of its group in the ranges before.
    """
    ranged = cut(rows.repartitionByRange(group, *order).withColumn("_range", F.spark_partition_id()))
    counts = ranged.groupBy(group, "_range").agg(F.count(F.lit(1)).alias("_rows"))
    before = W.partitionBy(group).orderBy("_range").rowsBetween(W.unboundedPreceding, -1)  # a row per range
    starts = counts.select(group, "_range", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_start"))
    own = F.row_number().over(W.partitionBy(group, "_range").orderBy(*order)) - 1
    return ranged.withColumn("_own", own).join(starts, [group, "_range"]).withColumn("ordinal", (F.col("_own") + F.col("_start")).cast("bigint")).drop("_range", "_own", "_start")


def positioned(n: DataFrame) -> DataFrame:
    """Nodes on a grid in order of repository, kind and id."""
    rows = running_number(n, "repo_name", "kind", "id")
    x, y = view.grid_position(F.col("ordinal"))
    return rows.withColumns({"x": x.cast("bigint"), "y": y.cast("bigint")})


def payload(g: Graph) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges as JSON documents, by id once."""
    named = g.communities.select("repo_name", F.col("community_id").alias("community"), F.col("name").alias("stored"), F.col("description").alias("community_description"))
    rows = positioned(nodes(g)).join(named, ["repo_name", "community"], "left")
    doc = F.struct("id", "label", F.array("kind").alias("labels"), "community", F.col("community").alias("community_id"), view.community_name(F.col("stored"), F.col("community")).alias("community_name"), "community_description", "file_path", F.struct("x", "y").alias("position"))
    edge_id = F.concat_ws("|", "edge", "source", "target_kind", "target")
    links = edges(g).withColumn("id", edge_id).dropDuplicates(["repo_name", "id"])
    link = F.struct("id", "source", "target", F.col("edge").alias("label"))
    return rows.select("repo_name", "id", F.to_json(doc, {"ignoreNullFields": "false"}).alias("json")), links.select("repo_name", "id", F.to_json(link).alias("json"))


def node_code(g: Graph, entity_id: str) -> DataFrame:
    """Code, path and name of one function, empty strings for nulls; no row if it is missing."""
    text = lambda c: F.coalesce(c, F.lit(""))
    return g.functions.where(F.col("entity_id") == entity_id).select(text("raw_code").alias("code"), text("file_path").alias("file_path"), text("name").alias("name")).limit(1)


def token_baseline(g: Graph) -> DataFrame:
    """One row: the repository's total tokens, 0 if unknown."""
    return g.repositories.agg(F.coalesce(F.max("total_tokens"), F.lit(0)).cast("bigint").alias("total_tokens"))


def label_counts(g: Graph) -> DataFrame:
    """Nodes by label over all repositories."""
    named = {"Repository": g.repositories, "File": g.files, "Function": g.functions, "ExternalFunction": g.external_functions, "Community": g.communities}
    rows = None
    for label, df in named.items():
        part = df.select(F.lit(label).alias("type"))
        rows = part if rows is None else rows.unionByName(part)
    return rows.groupBy("type").agg(F.count(F.lit(1)).alias("count")).orderBy("type")


def degrees(n: DataFrame, e: DataFrame) -> DataFrame:
    """Degree of each node: 1 for each end of an edge, 2 for a loop, 0 for none."""
    ends = e.select("repo_name", F.inline(F.array(F.struct(F.col("source_kind").alias("kind"), F.col("source").alias("id")), F.struct(F.col("target_kind").alias("kind"), F.col("target").alias("id")))))
    counted = ends.groupBy("repo_name", "kind", "id").agg(F.count(F.lit(1)).alias("degree"))
    return n.select("repo_name", "kind", "id").join(counted, ["repo_name", "kind", "id"], "left").withColumn("degree", F.coalesce("degree", F.lit(0)))


def sized(n: DataFrame, e: DataFrame) -> DataFrame:
    """Nodes with degree and display size; the largest degree (1 at least) is the unit."""
    rows = cut(degrees(n, e))  # read twice
    most = rows.groupBy("repo_name").agg(F.greatest(F.lit(1), F.max("degree")).alias("most"))
    rows = rows.join(F.broadcast(most), "repo_name")  # a row per repository, which is a hot key
    width, height = view.node_size(F.col("kind"), F.col("degree"), F.col("most"))
    return rows.withColumns({"width": width, "height": height}).drop("most")


def most_connected(n: DataFrame, e: DataFrame) -> DataFrame:
    """Each repository's node of the highest degree that is not external."""
    rows = degrees(n, e).where(F.col("kind") != EXTERNAL)
    order = W.partitionBy("repo_name").orderBy(F.col("degree").desc(), "kind", "id")
    return rows.withColumn("_n", F.row_number().over(order)).where(F.col("_n") == 1).drop("_n")


def adjacency(e: DataFrame) -> DataFrame:
    """Neighbours of each node in either direction: repo_name, id, neighbour and the number of edges between them, a row each, as a hub may have any number."""
    ends = F.array(F.struct(F.col("source").alias("id"), F.col("target").alias("neighbour")), F.struct(F.col("target").alias("id"), F.col("source").alias("neighbour")))
    return e.select("repo_name", F.inline(ends)).groupBy("repo_name", "id", "neighbour").agg(F.count(F.lit(1)).alias("n_edges"))  # a union would work the edges out twice


def with_both_ends(e: DataFrame, n: DataFrame) -> DataFrame:
    """Edges whose ends are both among the nodes."""
    s = n.select("repo_name", F.col("kind").alias("source_kind"), F.col("id").alias("source"))
    t = n.select("repo_name", F.col("kind").alias("target_kind"), F.col("id").alias("target"))
    return e.join(_hashed(s), ["repo_name", "source_kind", "source"], "left_semi").join(_hashed(t), ["repo_name", "target_kind", "target"], "left_semi")


def toggled(selection: list[int], community: int) -> list[int]:
    """The selection with a community put in or taken out."""
    return [c for c in selection if c != community] if community in selection else [*selection, community]


def highlighted(n: DataFrame, e: DataFrame, selection: list[int]) -> tuple[DataFrame, DataFrame]:
    """Nodes with ``active`` and edges with ``dimmed``: a node is active if its community is selected or nothing is, an edge dimmed unless an end is active."""
    on = F.lit(True) if not selection else F.coalesce(F.col("community").isin(*selection), F.lit(False))
    marked = n.withColumn("active", on)
    end = lambda p: marked.select("repo_name", F.col("kind").alias(f"{p}_kind"), F.col("id").alias(p), F.col("active").alias(f"{p}_on"))
    rows = e.join(_hashed(end("source")), ["repo_name", "source_kind", "source"], "left").join(_hashed(end("target")), ["repo_name", "target_kind", "target"], "left")
    lit = F.coalesce("source_on", F.lit(False)) | F.coalesce("target_on", F.lit(False))
    return marked, rows.withColumn("dimmed", ~lit).drop("source_on", "target_on")


def legend(n: DataFrame) -> DataFrame:
    """Communities of nodes (repo_name, id, community, community_name, community_description): size, first given name and description, colour; largest first.

    The row with null id counts the nodes without one.
    """
    given = F.when(F.col("community_name") != view.fallback_name(F.col("community")), F.nullif(F.col("community_name"), F.lit("")))
    # The first that is not null, in order of node ids.
    first = lambda c: F.min(F.when(c.isNotNull(), F.struct(F.col("id"), c.alias("v"))))["v"]
    rows = n.groupBy("repo_name", "community").agg(F.count(F.lit(1)).alias("count"), first(given).alias("name"), first(F.nullif(F.col("community_description"), F.lit(""))).alias("description"))
    known = F.col("community").isNotNull()
    out = rows.select(
        "repo_name", F.col("community").alias("id"), "count", F.when(known, F.coalesce("name", view.fallback_name(F.col("community")))).alias("name"),
        F.when(known, F.coalesce("description", F.lit(""))).alias("description"), F.when(known, view.color(F.col("community"))).alias("color"),
    )
    return out.orderBy("repo_name", F.col("id").isNull(), F.col("count").desc(), "id")


def integrity(g: Graph, dimensions: int = 1536) -> DataFrame:
    """Per repository: functions, distinct and embedded ones, DEFINES links, and what breaks the rules."""
    linked = defines(g).select("repo_name", "entity_id", F.lit(1).alias("defined")).distinct()
    rows = g.functions.select("repo_name", "entity_id", "qualified_name", "file_path", F.size("embedding").alias("dims"), F.col("embedding").isNotNull().alias("has"))
    rows = rows.join(linked, ["repo_name", "entity_id"], "left")
    return rows.groupBy("repo_name").agg(
        F.count(F.lit(1)).alias("functions"), F.count_distinct("entity_id").alias("unique_functions"), F.count_distinct(F.when(F.col("has"), F.col("entity_id"))).alias("embedded_functions"),
        F.sum(F.coalesce("defined", F.lit(0))).cast("bigint").alias("defines_links"), F.count_if(F.col("defined").isNull()).alias("invalid_defines"),
        F.count_if(F.col("has") & (F.col("dims") != dimensions)).alias("invalid_vectors"), F.count_distinct(F.struct("qualified_name", "file_path")).alias("embedding_inputs"),
    )


def missing_communities(g: Graph) -> DataFrame:
    """Per repository, functions whose community has no row."""
    known = g.communities.select("repo_name", F.col("community_id").alias("leiden_community"))
    rows = g.functions.where(F.col("leiden_community").isNotNull()).join(known, ["repo_name", "leiden_community"], "left_anti")
    return rows.groupBy("repo_name").agg(F.count(F.lit(1)).alias("missing_communities"))


def orphan_externals(g: Graph) -> DataFrame:
    """External functions that nothing calls."""
    called = g.calls.where(F.col("target_kind") == EXTERNAL).select("repo_name", F.col("target_key").alias("name")).distinct()
    return g.external_functions.join(called, ["repo_name", "name"], "left_anti")


def pooled(functions: DataFrame, smallest: int) -> DataFrame:
    """Functions with those in communities of fewer than ``smallest`` moved to the ungrouped one."""
    sizes = functions.where(F.col("leiden_community").isNotNull()).groupBy("repo_name", "leiden_community").agg(F.count(F.lit(1)).alias("_n"))
    small = sizes.where(F.col("_n") < smallest).select("repo_name", "leiden_community", F.lit(True).alias("_small"))
    rows = functions.join(small, ["repo_name", "leiden_community"], "left")
    return rows.withColumn("leiden_community", F.when(F.col("_small"), F.lit(UNGROUPED_ID).cast("bigint")).otherwise(F.col("leiden_community"))).drop("_small")


def community_samples(functions: DataFrame) -> DataFrame:
    """Per community: size, its first names and its first distinct paths."""
    rows = functions.where(F.col("leiden_community").isNotNull())
    # A community may be large: names are ranked before they are gathered.
    names = rows.select("repo_name", "leiden_community", _display().alias("v"), "entity_id")
    nth = F.row_number().over(W.partitionBy("repo_name", "leiden_community").orderBy("v", "entity_id"))
    names = names.withColumn("_n", nth).where(F.col("_n") <= NAME_SAMPLE).groupBy("repo_name", "leiden_community").agg(F.sort_array(F.collect_list("v")).alias("func_names"))
    paths = rows.select("repo_name", "leiden_community", "file_path").distinct()
    nth = F.row_number().over(W.partitionBy("repo_name", "leiden_community").orderBy("file_path"))
    paths = paths.withColumn("_n", nth).where(F.col("_n") <= PATH_SAMPLE).groupBy("repo_name", "leiden_community").agg(F.sort_array(F.collect_list("file_path")).alias("file_paths"))
    sizes = rows.groupBy("repo_name", "leiden_community").agg(F.count(F.lit(1)).alias("function_count"))
    both = ["repo_name", "leiden_community"]
    return sizes.join(names, both, "left").join(paths, both, "left").withColumnRenamed("leiden_community", "comm_id")


def flat_callers(g: Graph, name: str | None = None, ordered: bool = False) -> DataFrame:
    """The earlier callers query: distinct callers of a name, with id, name, file and line; ``ordered``: by file, line and id."""
    called = targets(g).where(_named(name)).select("repo_name", F.col("kind").alias("target_kind"), F.col("key").alias("target_key"))
    rows = g.calls.select("repo_name", "caller_id", "target_kind", "target_key").join(called if name is not None else _hashed(called), ["repo_name", "target_kind", "target_key"], "left_semi")
    # Distinct and joined: a semi join is pushed below unions of functions, and all calls are then worked out for each.
    found = g.functions.join(_hashed(rows.select("repo_name", F.col("caller_id").alias("entity_id")).distinct()), ["repo_name", "entity_id"])
    found = found.select(F.col("entity_id").alias("id"), "name", "qualified_name", F.col("file_path").alias("file"), F.col("start_line").alias("line")).distinct()
    return by(found, "file", "line", "id") if ordered else found


def flat_nodes(g: Graph, ordered: bool = False) -> DataFrame:
    """The earlier node list: functions and external callees; ``ordered``: external ones last, by qualified name and id."""
    inside = g.functions.select(F.col("entity_id").alias("id"), "name", "qualified_name", F.col("file_path").alias("file"), F.col("start_line").alias("line"), F.lit(False).alias("external"))
    none = F.lit(None)
    outside = g.external_functions.select(F.concat(F.lit("external::"), "name").alias("id"), "name", F.col("name").alias("qualified_name"), none.cast("string").alias("file"), none.cast("int").alias("line"), F.lit(True).alias("external"))
    rows = inside.unionByName(outside)
    return by(rows, "external", "qualified_name", "id") if ordered else rows


def flat_edges(links: DataFrame, locations: bool = True, ordered: bool = False) -> DataFrame:
    """The earlier edge list from resolved links: source, target, count (1 if unknown), locations (empty if unknown); ``ordered``: by source and target."""
    cols = [F.col("caller_id").alias("source"), F.col("target_id").alias("target"), F.coalesce("count", F.lit(1)).alias("count")]
    if locations:
        cols.append(F.coalesce("locations", F.array().cast("array<int>")).alias("locations"))
    return by(links.select(*cols), "source", "target") if ordered else links.select(*cols)
