"""The registered queries over the driver's tables, and DuckDB SQL for each that SQL can express."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from callscope.functions import identity, text, view
from callscope.operators import changes, community, graph, resolve, vectors
from callscope.operators.checkpoints import cut
from callscope.plans.sample import SQL, definitions, resolved, sample_graph, sites, table
from callscope.schema import EXTERNAL, MIN_LABELED_COMMUNITY, UNGROUPED_ID

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, model: bool = True):
    """Registers a query under its function's name, with its SQL (after the mapping's expressions if ``model``)."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = f"{SQL if model else ''}{sql}"
        return f

    return add


def joined(c: str, sep: str = "|"):
    return F.array_join(c, sep)


# Resolution ---------------------------------------------------------------
@query("SELECT * FROM internal")
def resolve_internal(spark, d):
    return resolve.internal_edges(resolved(spark, d))


@query("SELECT * FROM outside")
def resolve_external(spark, d):
    return resolve.external_edges(resolved(spark, d))


@query("SELECT repo_name, caller_id, string_agg(name, '|' ORDER BY first_ordinal, name) AS ambiguous_calls FROM outcome WHERE matches > 1 GROUP BY repo_name, caller_id")
def resolve_ambiguous(spark, d):
    return resolve.ambiguous_names(resolved(spark, d)).withColumn("ambiguous_calls", joined("ambiguous_calls"))


@query("SELECT repo_name, resolution, CASE WHEN matches > 1 THEN 'ambiguous' WHEN matches = 1 THEN 'internal' ELSE 'external' END AS outcome, count(*) AS names, sum(n_sites)::BIGINT AS n_sites FROM outcome GROUP BY ALL")
def resolution_summary(spark, d):
    what = F.when(F.col("matches") > 1, "ambiguous").when(F.col("matches") == 1, "internal").otherwise("external")
    return resolved(spark, d).groupBy("repo_name", "resolution", what.alias("outcome")).agg(F.count(F.lit(1)).alias("names"), F.sum("n_sites").alias("n_sites"))


@query("SELECT repo_name, caller_id, name, string_agg(candidate, '|' ORDER BY depth DESC) AS candidates FROM cand GROUP BY ALL")
def scope_candidates(spark, d):
    rows = sites(spark, d, definitions(spark, d)).select("repo_name", "caller_id", "qualified_name", "name").distinct()
    return rows.select("repo_name", "caller_id", "name", joined(resolve.candidates(F.col("qualified_name"), F.col("name"))).alias("candidates"))


_FLAT = """,
flat_sites AS (SELECT repo_name, caller_id, name AS target, (ordinal % 1000)::INTEGER AS line FROM sites),
exact AS (SELECT repo_name, qualified_name AS target, max(entity_id) AS id FROM defs GROUP BY ALL),
simple AS (SELECT repo_name, name, min(entity_id) AS id FROM defs GROUP BY ALL HAVING count(*) = 1),
flat AS (
  SELECT s.repo_name, s.caller_id, coalesce(e.id, m.id, 'external::' || s.target) AS target_id, s.line
  FROM flat_sites s LEFT JOIN exact e ON s.repo_name = e.repo_name AND s.target = e.target
  LEFT JOIN simple m ON s.repo_name = m.repo_name AND list_last(string_split(s.target, '.')) = m.name)
"""


def _flat(spark, d):
    defs = definitions(spark, d)
    rows = sites(spark, d, defs).select("repo_name", "caller_id", F.col("name").alias("target"), F.pmod("ordinal", F.lit(1000)).cast("int").alias("line"))
    return resolve.resolve_flat(rows, defs)


@query(_FLAT + "SELECT caller_id AS source, target_id AS target, count(*) AS count, string_agg(line::VARCHAR, ',' ORDER BY line) AS locations FROM flat GROUP BY repo_name, caller_id, target_id")
def legacy_edges(spark, d):
    return graph.flat_edges(_flat(spark, d)).withColumn("locations", joined(F.col("locations").cast("array<string>"), ","))


@query("SELECT DISTINCT entity_id AS id, name, qualified_name, file_path AS file, start_line AS line FROM defs WHERE entity_id IN (SELECT caller_id FROM linked)")
def legacy_callers(spark, d):
    return graph.flat_callers(sample_graph(spark, d))


@query("SELECT entity_id AS id, name, qualified_name, file_path AS file, start_line AS line, false AS external FROM defs UNION ALL SELECT 'external::' || name, name, name, NULL, NULL, true FROM externals")
def legacy_nodes(spark, d):
    return graph.flat_nodes(sample_graph(spark, d, calls=False))


# Traversals -----------------------------------------------------------------
_CALLERS = """,
grouped AS (
  SELECT repo_name, t_name AS func_name, c_qn AS caller, coalesce(t_qn, t_name) AS target, t_file AS target_file, target_kind <> 'Function' AS target_is_external, string_agg(DISTINCT c_file, '|' ORDER BY c_file) AS file_paths
  FROM linked GROUP BY ALL)
"""


@query(_CALLERS + f"SELECT * FROM grouped QUALIFY row_number() OVER (PARTITION BY repo_name, func_name ORDER BY caller, target_file NULLS LAST, target NULLS LAST, target_is_external) <= {graph.CALLER_LIMIT}")
def callers(spark, d):
    return graph.callers(sample_graph(spark, d)).withColumn("file_paths", joined("file_paths"))


@query(_CALLERS + f"SELECT * FROM grouped WHERE repo_name = 'org/r0' AND func_name = (SELECT min(p_name) FROM part WHERE p_name LIKE 'blue %') ORDER BY caller, target_file NULLS LAST, target NULLS LAST, target_is_external LIMIT {graph.CALLER_LIMIT}")
def callers_of_one(spark, d):
    name = table(spark, d, "part").where(F.startswith("p_name", F.lit("blue "))).agg(F.min("p_name")).first()[0]
    return graph.callers(sample_graph(spark, d).of("org/r0"), name).withColumn("file_paths", joined("file_paths"))


@query("SELECT repo_name, c_qn AS caller_name, c_file AS caller_file, coalesce(t_qn, t_name) AS target_name, t_file AS target_file, target_kind <> 'Function' AS is_external FROM linked")
def outgoing_deps(spark, d):
    return graph.outgoing(sample_graph(spark, d))


@query("""SELECT repo_name, c_qn AS caller_name, c_file AS caller_file, count(*) AS n,
  string_agg(CASE WHEN target_kind <> 'Function' THEN t_name || ' (External/Built-in)' ELSE t_qn || ' (' || t_file || ')' END, '|' ORDER BY coalesce(t_qn, t_name), t_file NULLS FIRST) AS dependencies
FROM linked GROUP BY ALL""")
def outgoing_grouped(spark, d):
    return graph.grouped_dependencies(graph.outgoing(sample_graph(spark, d))).withColumn("dependencies", joined("dependencies"))


@query("SELECT repo_name, file_path, qualified_name AS function_name, start_line FROM defs")
def functions_in_file(spark, d):
    return graph.functions_in_file(sample_graph(spark, d, calls=False))


@query("SELECT repo_name, path AS file_path FROM files")
def list_files(spark, d):
    return graph.file_list(sample_graph(spark, d, calls=False))


@query("SELECT repo_name, name AS function_name FROM externals")
def external_deps(spark, d):
    return graph.external_list(sample_graph(spark, d, calls=False))


@query("""SELECT c.repo_name, c.community_id AS id, c.name AS module_title, c.description AS module_description, count(f.entity_id) AS function_count
FROM communities c LEFT JOIN defs f ON f.repo_name = c.repo_name AND f.community = c.community_id GROUP BY ALL""")
def subsystems(spark, d):
    return graph.subsystems(sample_graph(spark, d, calls=False))


_WINDOW = """SELECT n.repo_name, n.kind, n.id, n.label, n.community, e.edge, e.target_kind, e.target,
  nc.name AS n_community_name, nc.description AS n_community_description, mc.name AS m_community_name, mc.description AS m_community_description
FROM nodes n LEFT JOIN edges e ON e.repo_name = n.repo_name AND e.source_kind = n.kind AND e.source = n.id
LEFT JOIN defs m ON m.repo_name = e.repo_name AND e.target_kind = 'Function' AND m.entity_id = e.target
LEFT JOIN communities nc ON nc.repo_name = n.repo_name AND nc.community_id = n.community
LEFT JOIN communities mc ON mc.repo_name = m.repo_name AND mc.community_id = m.community"""


@query(_WINDOW + f" ORDER BY n.repo_name, n.kind, n.id, e.edge NULLS LAST, e.target_kind NULLS LAST, e.target NULLS LAST LIMIT {graph.WINDOW_LIMIT}")
def graph_window(spark, d):
    return graph.window(sample_graph(spark, d))


@query(_WINDOW)
def graph_expanded(spark, d):
    return graph.window(sample_graph(spark, d), None)


@query("SELECT 'def ' || name AS code, file_path, name FROM defs WHERE repo_name = 'org/r1' AND p_partkey = (SELECT min(p_partkey) FROM defs WHERE repo_name = 'org/r1')")
def node_code(spark, d):
    g = sample_graph(spark, d, calls=False).of("org/r1")
    least = g.functions.agg(F.min(F.col("entity_id").cast("bigint"))).first()[0]
    return graph.node_code(g, str(least))


@query("SELECT sum(start_line)::BIGINT AS total_tokens FROM defs WHERE repo_name = 'org/r0'")
def repo_tokens(spark, d):
    return graph.token_baseline(sample_graph(spark, d, calls=False).of("org/r0"))


@query("SELECT repo_name, file_path, entity_id FROM defs")
def defines_edges(spark, d):
    return graph.defines(sample_graph(spark, d, calls=False))


@query("""SELECT DISTINCT f.repo_name, 'Function:' || f.entity_id AS s, c.target_kind || ':' || c.target_key AS t, CASE WHEN c.caller_id IS NOT NULL THEN 'CALLS' END AS type
FROM defs f LEFT JOIN calls c ON c.repo_name = f.repo_name AND c.caller_id = f.entity_id
UNION SELECT repo_name, 'File:' || file_path, 'Function:' || entity_id, 'DEFINES' FROM defs""")
def projection_edges(spark, d):
    return community.projection(sample_graph(spark, d))


_NODES3 = """,
all_nodes AS (SELECT repo_name, kind, id FROM nodes UNION ALL SELECT repo_name, 'ExternalFunction', name FROM externals),
ends AS (SELECT repo_name, source_kind AS kind, source AS id FROM edges UNION ALL SELECT repo_name, target_kind, target FROM edges),
degree AS (SELECT n.repo_name, n.kind, n.id, count(e.id) AS degree FROM all_nodes n LEFT JOIN ends e ON e.repo_name = n.repo_name AND e.kind = n.kind AND e.id = n.id GROUP BY ALL)
"""


def _all_nodes(g):
    outside = g.external_functions.select("repo_name", F.lit(EXTERNAL).alias("kind"), F.col("name").alias("id"))
    return graph.nodes(g).select("repo_name", "kind", "id").unionByName(outside)


@query(_NODES3 + "SELECT * FROM degree")
def degrees(spark, d):
    g = sample_graph(spark, d)
    return graph.degrees(_all_nodes(g), graph.edges(g))


@query(
    _NODES3
    + """, most AS (SELECT repo_name, greatest(1, max(degree)) AS most FROM degree GROUP BY repo_name)
SELECT d.repo_name, kind, id, degree, round((CASE WHEN kind = 'File' THEN 190 ELSE 150 END + sqrt(degree / most) * (CASE WHEN kind = 'File' THEN 80 ELSE 30 END)), 6) AS width,
  round((CASE WHEN kind = 'File' THEN 72 ELSE 52 END + sqrt(degree / most) * (CASE WHEN kind = 'File' THEN 20 ELSE 10 END)), 6) AS height
FROM degree d JOIN most m ON d.repo_name = m.repo_name"""
)
def node_sizes(spark, d):
    g = sample_graph(spark, d)
    return graph.sized(_all_nodes(g), graph.edges(g)).withColumns({"width": F.round("width", 6), "height": F.round("height", 6)})


@query(_NODES3 + "SELECT * FROM degree WHERE kind <> 'ExternalFunction' QUALIFY row_number() OVER (PARTITION BY repo_name ORDER BY degree DESC, kind, id) = 1")
def most_connected(spark, d):
    g = sample_graph(spark, d)
    return graph.most_connected(_all_nodes(g), graph.edges(g))


@query("""SELECT repo_name, id, neighbour, count(*) AS n_edges
FROM (SELECT repo_name, source AS id, target AS neighbour FROM edges UNION ALL SELECT repo_name, target, source FROM edges) GROUP BY ALL""")
def adjacency(spark, d):
    return graph.adjacency(graph.edges(sample_graph(spark, d)))


@query("SELECT e.* FROM edges e WHERE (repo_name, target_kind, target) IN (SELECT (repo_name, kind, id) FROM nodes)")
def edges_with_ends(spark, d):
    g = sample_graph(spark, d)
    return graph.with_both_ends(graph.edges(g), graph.nodes(g))


@query("""SELECT e.repo_name, e.edge, e.source, e.target, NOT (coalesce(s.community IN (1, 3), false) OR coalesce(t.community IN (1, 3), false)) AS dimmed
FROM edges e LEFT JOIN nodes s ON s.repo_name = e.repo_name AND s.kind = e.source_kind AND s.id = e.source LEFT JOIN nodes t ON t.repo_name = e.repo_name AND t.kind = e.target_kind AND t.id = e.target""")
def cluster_highlight(spark, d):
    g = sample_graph(spark, d)
    _, links = graph.highlighted(graph.nodes(g), graph.edges(g), graph.toggled([1], 3))
    return links.select("repo_name", "edge", "source", "target", "dimmed")


@query("SELECT repo_name, kind, id, (row_number() OVER (PARTITION BY repo_name ORDER BY kind, id) - 1) AS ordinal, ((row_number() OVER (PARTITION BY repo_name ORDER BY kind, id) - 1) % 8) * 220 AS x, ((row_number() OVER (PARTITION BY repo_name ORDER BY kind, id) - 1) // 8) * 120 AS y FROM nodes")
def grid_positions(spark, d):
    return graph.positioned(graph.nodes(sample_graph(spark, d, calls=False))).select("repo_name", "kind", "id", F.col("ordinal").cast("bigint").alias("ordinal"), "x", "y")


@query("""SELECT 'Repository' AS type, count(DISTINCT repo_name) AS count FROM defs UNION ALL SELECT 'File', count(*) FROM files UNION ALL SELECT 'Function', count(*) FROM defs
UNION ALL SELECT 'ExternalFunction', count(*) FROM externals UNION ALL SELECT 'Community', count(*) FROM communities""")
def label_counts(spark, d):
    return graph.label_counts(sample_graph(spark, d, calls=False))


@query("SELECT repo_name, name FROM externals WHERE (repo_name, name) NOT IN (SELECT (repo_name, target_name) FROM outside)")
def orphan_externals(spark, d):
    return graph.orphan_externals(sample_graph(spark, d))


@query("""SELECT repo_name, count(*) AS functions, count(DISTINCT entity_id) AS unique_functions, 0::BIGINT AS embedded_functions, count(*) AS defines_links, 0::BIGINT AS invalid_defines, 0::BIGINT AS invalid_vectors,
  count(DISTINCT (qualified_name, file_path)) AS embedding_inputs FROM defs GROUP BY repo_name""")
def integrity_counts(spark, d):
    return graph.integrity(sample_graph(spark, d, calls=False))


@query("SELECT repo_name, count(*) AS missing_communities FROM defs WHERE community IS NOT NULL AND (repo_name, community) NOT IN (SELECT (repo_name, community_id) FROM communities) GROUP BY repo_name")
def missing_communities(spark, d):
    return graph.missing_communities(sample_graph(spark, d, calls=False))


# Communities ------------------------------------------------------------------
_TRADE = """
WITH deals AS (SELECT 'c' || o_custkey AS s, 's' || l_suppkey AS t, count(*)::DOUBLE AS weight FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY ALL),
member AS (SELECT 'c' || c_custkey AS node, c_nationkey AS community FROM customer UNION ALL SELECT 's' || s_suppkey, s_nationkey FROM supplier),
both_ AS (SELECT weight, a.community AS ca, b.community AS cb FROM deals JOIN member a ON s = a.node JOIN member b ON t = b.node),
per AS (SELECT community, sum(weight) AS d, sum(inner_) AS l FROM (SELECT ca AS community, weight, CASE WHEN ca = cb THEN weight ELSE 0 END AS inner_ FROM both_ UNION ALL SELECT cb, weight, 0 FROM both_) GROUP BY community),
total AS (SELECT sum(d) / 2 AS m FROM per)
SELECT 'trade' AS repo_name, count(*) AS communities, round(sum(l / m - (d / (2 * m)) * (d / (2 * m))), 6) AS modularity FROM per, total
"""


@query(_TRADE, model=False)
def modularity_fixed(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("k"), "o_custkey")
    li = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("k"), "l_suppkey")
    deals = o.join(li, "k").groupBy(F.concat(F.lit("c"), "o_custkey").alias("s"), F.concat(F.lit("s"), "l_suppkey").alias("t")).agg(F.count(F.lit(1)).cast("double").alias("weight"))
    members = table(spark, d, "customer").select(F.concat(F.lit("c"), "c_custkey").alias("node"), F.col("c_nationkey").alias("community"))
    members = members.unionByName(table(spark, d, "supplier").select(F.concat(F.lit("s"), "s_suppkey").alias("node"), F.col("s_nationkey").alias("community")))
    repo = F.lit("trade").alias("repo_name")
    return community.modularity(deals.select(repo, "*"), members.select(repo, "*")).withColumn("modularity", F.round("modularity", 6))


@query("""SELECT repo_name, count(*) AS community_count, sum(n)::BIGINT AS function_count, count(*) FILTER (n = 1) AS singleton_count, round(count(*) FILTER (n = 1) / count(*), 6) AS singleton_ratio
FROM (SELECT repo_name, community, count(*) AS n FROM defs WHERE community IS NOT NULL GROUP BY ALL) GROUP BY repo_name""")
def community_summary(spark, d):
    g = sample_graph(spark, d)
    found = community.report(g.functions, community.projection(g))
    return found.select("repo_name", "community_count", "function_count", "singleton_count", F.round("singleton_ratio", 6).alias("singleton_ratio"))


@query("""SELECT c.repo_name, c.community AS comm_id, function_count, func_names, file_paths
FROM (SELECT repo_name, community, count(*) AS function_count FROM defs WHERE community IS NOT NULL GROUP BY ALL) c
JOIN (SELECT repo_name, community, string_agg(qualified_name, '|' ORDER BY qualified_name) AS func_names FROM (SELECT * FROM defs QUALIFY row_number() OVER (PARTITION BY repo_name, community ORDER BY qualified_name, entity_id) <= 15) GROUP BY ALL) a ON a.repo_name = c.repo_name AND a.community = c.community
JOIN (SELECT repo_name, community, string_agg(file_path, '|' ORDER BY file_path) AS file_paths FROM (SELECT * FROM (SELECT DISTINCT repo_name, community, file_path FROM defs) QUALIFY row_number() OVER (PARTITION BY repo_name, community ORDER BY file_path) <= 5) GROUP BY ALL) b ON b.repo_name = c.repo_name AND b.community = c.community""")
def community_samples(spark, d):
    rows = graph.community_samples(sample_graph(spark, d, calls=False).functions)
    return rows.withColumns({"func_names": joined("func_names"), "file_paths": joined("file_paths")})


@query(f"""SELECT d.repo_name, d.entity_id, CASE WHEN n < {MIN_LABELED_COMMUNITY} THEN {UNGROUPED_ID} ELSE x END AS community
FROM (SELECT repo_name, entity_id, hash_x AS x, count(*) OVER (PARTITION BY repo_name, hash_x) AS n FROM (SELECT *, (p_partkey // 5) * 5 AS hash_x FROM defs)) d""")
def small_community_pooling(spark, d):
    rows = sample_graph(spark, d, calls=False).functions.withColumn("leiden_community", (F.floor(F.col("entity_id").cast("bigint") / 5) * 5).cast("bigint"))
    return graph.pooled(rows, MIN_LABELED_COMMUNITY).select("repo_name", "entity_id", F.col("leiden_community").alias("community"))


_LEGEND = """,
shown AS (SELECT n.repo_name, n.id, n.community, c.name, c.description FROM nodes n LEFT JOIN communities c ON c.repo_name = n.repo_name AND c.community_id = n.community)
SELECT repo_name, community AS id, count(*) AS count, CASE WHEN community IS NOT NULL THEN coalesce(arg_min(name, id) FILTER (name IS NOT NULL), 'Cluster #' || community) END AS name,
  CASE WHEN community IS NOT NULL THEN coalesce(arg_min(description, id) FILTER (description IS NOT NULL), '') END AS description,
  CASE WHEN community IS NOT NULL THEN 'hsl(' || regexp_replace(printf('%.1f', round((community * 137.5) % 360, 1)), '\\.0$', '') || ', 70%, 55%)' END AS color
FROM shown GROUP BY repo_name, community
"""


@query(_LEGEND)
def legend(spark, d):
    g = sample_graph(spark, d, calls=False)
    named = g.communities.select("repo_name", F.col("community_id").alias("community"), F.col("name").alias("stored"), F.col("description").alias("community_description"))
    rows = graph.nodes(g).join(named, ["repo_name", "community"], "left")
    return graph.legend(rows.withColumn("community_name", view.community_name(F.col("stored"), F.col("community"))))


@query()
def leiden(spark, d):
    """Communities of the whole sample graph."""
    return community.detect(sample_graph(spark, d))


@query()
def leiden_report(spark, d):
    g = sample_graph(spark, d)
    edges = cut(community.projection(g))  # read twice
    functions = community.write_back(g.functions, community.detect(g, edges=edges))
    return community.report(functions, edges)


# Identity and functions ---------------------------------------------------------
@query("""SELECT entity_id AS part, 'fn:v1:' || sha256('["' || repo_name || '","' || file_path || '","python","' || qualified_name || '","signature:' || signature || ';occurrence:' || occurrence || '"]') AS entity_id
FROM (SELECT *, row_number() OVER (PARTITION BY repo_name, file_path, qualified_name, signature ORDER BY p_partkey) AS occurrence FROM defs)""")
def entity_ids(spark, d):
    defs = definitions(spark, d)
    n = F.row_number().over(W.partitionBy("repo_name", "file_path", "qualified_name", "signature").orderBy("p_partkey"))
    rows = defs.withColumn("occ", n)
    found = identity.entity_id(F.col("repo_name"), F.col("file_path"), F.lit(" Python "), F.col("qualified_name"), identity.discriminator(F.col("signature"), F.col("occ")))
    return rows.select(F.col("entity_id").alias("part"), found.alias("entity_id"))


@query("SELECT entity_id, 'signature:' || signature || ';occurrence:' || row_number() OVER (PARTITION BY repo_name, file_path, qualified_name, signature ORDER BY p_partkey) AS discriminator FROM defs")
def occurrence_discriminator(spark, d):
    n = F.row_number().over(W.partitionBy("repo_name", "file_path", "qualified_name", "signature").orderBy("p_partkey"))
    return definitions(spark, d).select("entity_id", identity.discriminator(F.col("signature"), n).alias("discriminator"))


@query("SELECT p_partkey, p_brand || '/' || p_size || '/' || p_name AS path FROM part", model=False)
def normalized_paths(spark, d):
    raw = F.concat(F.lit(".\\x/../"), "p_brand", F.lit("\\"), F.col("p_size").cast("string"), F.lit("//./"), "p_name")
    return table(spark, d, "part").select("p_partkey", identity.normalize_path(raw).alias("path"))


@query("SELECT page_id, regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) AS host, list_last(string_split(regexp_extract(url, '^[a-z]+://[^/?#]+([^?#]*)', 1), '/')) AS base FROM pages", model=False)
def page_parts(spark, d):
    path = F.coalesce(F.parse_url("url", F.lit("PATH")), F.lit(""))
    return table(spark, d, "pages").select("page_id", F.parse_url("url", F.lit("HOST")).alias("host"), view.basename(path).alias("base"))


@query("SELECT repo_name, entity_id, 'Function: ' || qualified_name || chr(10) || 'File: ' || file_path AS text FROM defs")
def embedding_texts(spark, d):
    return definitions(spark, d).select("repo_name", "entity_id", identity.embedding_text(F.col("qualified_name"), F.col("file_path")).alias("text"))


@query("SELECT c_custkey, upper(c_mktsegment) AS segment, lower(list_last(string_split(c_name, '#'))) AS last_segment FROM customer", model=False)
def name_parts(spark, d):
    return table(spark, d, "customer").select("c_custkey", F.upper("c_mktsegment").alias("segment"), F.lower(view.last_segment(F.replace("c_name", F.lit("#"), F.lit(".")))).alias("last_segment"))


# Vectors ------------------------------------------------------------------------
_VECTORS = """
WITH q AS (SELECT list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings WHERE vec_id = (SELECT min(vec_id) FROM embeddings)),
s AS (SELECT vec_id, 'org/r' || (label % 2) AS repo_name, list_cosine_similarity(list_transform(embedding, lambda x: x::DOUBLE), v) AS score FROM embeddings, q)
"""


def _vectors(spark, d):
    rows = table(spark, d, "embeddings").select(F.concat(F.lit("org/r"), F.pmod("label", F.lit(2))).alias("repo_name"), F.lpad(F.col("vec_id").cast("string"), 12, "0").alias("entity_id"), F.col("vec_id").cast("string").alias("name"), F.lit(None).cast("string").alias("qualified_name"), F.lit("v").alias("file_path"), "embedding")
    return rows, rows.orderBy("entity_id").first()["embedding"]


@query(_VECTORS + "SELECT vec_id::VARCHAR AS function_name, round(score, 6) AS score FROM s ORDER BY s.score DESC, vec_id LIMIT 20", model=False)
def vector_topk(spark, d):
    rows, q = _vectors(spark, d)
    return vectors.top_k(rows, list(q), 20).select("function_name", F.round("score", 6).alias("score"))


@query(_VECTORS + "SELECT function_name, round(score, 6) AS score FROM (SELECT repo_name, vec_id::VARCHAR AS function_name, score FROM s ORDER BY score DESC, vec_id LIMIT 20) WHERE repo_name = 'org/r1'", model=False)
def vector_topk_scoped(spark, d):
    rows, q = _vectors(spark, d)
    return vectors.top_k(rows, list(q), 20, "org/r1").select("function_name", F.round("score", 6).alias("score"))


@query(_VECTORS + "SELECT vec_id::VARCHAR AS function_name, round(score, 6) AS score FROM s WHERE repo_name = 'org/r1' ORDER BY s.score DESC, vec_id LIMIT 20", model=False)
def vector_topk_prefiltered(spark, d):
    rows, q = _vectors(spark, d)
    return vectors.top_k(rows, list(q), 20, "org/r1", prefilter=True).select("function_name", F.round("score", 6).alias("score"))


@query("SELECT count(*) AS functions, count(DISTINCT text) AS inputs, count(text) - count(DISTINCT text) AS saved FROM documents", model=False)
def embed_dedup(spark, d):
    rows = table(spark, d, "documents").select("text")
    return rows.agg(F.count(F.lit(1)).alias("functions"), F.count_distinct("text").alias("inputs"), (F.count("text") - F.count_distinct("text")).alias("saved"))


@query()
def embed_definitions(spark, d):
    """Every definition's vector, each distinct input embedded once."""
    return vectors.embed_functions(definitions(spark, d), vectors.hash_embedder(), 64).select("entity_id", "embedding")


# Changes ------------------------------------------------------------------------
_STATE = "SELECT user_id::VARCHAR AS path, arg_max(CASE WHEN event_type = 'error' THEN 'removed' ELSE 'updated' END, (ts, event_id)) AS state FROM events GROUP BY user_id"


@query(_STATE, model=False)
def change_set(spark, d):
    from callscope.streaming.push import file_changes

    return changes.path_states(file_changes(table(spark, d, "events")))


@query("SELECT repo_name, entity_id, file_path FROM defs WHERE (repo_name, file_path) IN (SELECT (repo_name, file_path) FROM defs WHERE start_line % 3 = 0) AND start_line % 5 = 0")
def stale_functions(spark, d):
    defs = definitions(spark, d)
    at = defs.where(F.col("start_line") % 3 == 0).select("repo_name", F.col("file_path").alias("path")).distinct()
    return changes.stale_functions(defs, at, defs.where(F.col("start_line") % 5 != 0)).select("repo_name", "entity_id", "file_path")


def _again(sql: str) -> str:
    """The mapping's expressions for resolution once more, over the definitions that an update leaves."""
    part = sql[sql.index("sites AS (") : sql.index("targets AS (")].rstrip().rstrip(",")
    for name in ("defs", "sites", "asked", "cand", "hits", "m0", "m1", "m2", "outcome", "internal", "outside", "calls"):
        part = re.sub(rf"\b{name}\b", f"{name}_after", part)
    return part


@query(
    f""",
defs_after AS (SELECT * FROM defs WHERE NOT (start_line % 7 = 1 AND start_line % 3 <> 0)),
{_again(SQL)}
SELECT c.* FROM calls_after c JOIN defs d ON c.repo_name = d.repo_name AND c.caller_id = d.entity_id WHERE d.start_line % 3 = 0
UNION ALL
SELECT c.* FROM calls c JOIN defs_after d ON c.repo_name = d.repo_name AND c.caller_id = d.entity_id
WHERE d.start_line % 3 <> 0 AND (c.target_kind <> 'Function' OR (c.repo_name, c.target_key) IN (SELECT (repo_name, entity_id) FROM defs_after))"""
)
def incremental_apply(spark, d):
    """A third of the files parsed again, another few deleted: the calls that result."""
    g = sample_graph(spark, d)
    g.calls, g.functions, defs = cut(g.calls), cut(g.functions), cut(definitions(spark, d))
    again = defs.where(F.col("start_line") % 3 == 0)
    gone = defs.where(F.col("start_line") % 7 == 1).select("repo_name", F.col("file_path").alias("path"))
    files = g.files.join(again.select("repo_name", F.col("file_path").alias("path")), ["repo_name", "path"], "left_semi")
    new = g.functions.where(F.col("start_line") % 3 == 0)
    where = sites(spark, d, defs).join(new.select("repo_name", F.col("entity_id").alias("caller_id")), ["repo_name", "caller_id"], "left_semi")
    return changes.apply_change_set(g, files, new, where, gone).calls


@query(_STATE, model=False)
def stream_change_set(spark, d):
    """The fold of ``change_set`` over a stream that reads the table in batches, kept in a state table."""
    from callscope.streaming.folds import fold_stream

    return fold_stream(spark, f"{d}/events.parquet")


# Metrics ------------------------------------------------------------------------
_CONTEXT = """
WITH c AS (SELECT conv_id, string_agg(text, chr(10) ORDER BY turn, text) FILTER (role = 'assistant') AS context, sum(len(text))::BIGINT AS total FROM conversations GROUP BY conv_id)
"""


def _context(spark, d):
    rows = table(spark, d, "conversations")
    total = rows.groupBy("conv_id").agg(F.sum(F.length("text")).alias("total"))
    return text.context(rows, ["conv_id"], ["turn"], "text", F.col("role") == "assistant").join(total, "conv_id")


@query(_CONTEXT + "SELECT conv_id, context FROM c", model=False)
def context_concat(spark, d):
    return _context(spark, d).select("conv_id", "context")


@query(_CONTEXT + "SELECT conv_id, CASE WHEN total > 0 THEN total - coalesce(len(context), 0) ELSE 0 END AS saved, CASE WHEN total > 0 THEN round((total - coalesce(len(context), 0)) / total * 100, 2) ELSE 0 END AS percent FROM c", model=False)
def token_efficiency(spark, d):
    saved, percent = text.saved_tokens(F.col("total"), F.coalesce(F.length("context"), F.lit(0)))
    return _context(spark, d).select("conv_id", saved.cast("bigint").alias("saved"), percent.alias("percent"))


@query("SELECT page_id, unnest(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1)) AS href FROM pages", model=False)
def href_edges(spark, d):
    return table(spark, d, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), 1)).alias("href"))


@query("""SELECT n_nationkey, n_name, count(DISTINCT c_custkey) AS customers FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey AND c_acctbal > 9000 GROUP BY ALL""", model=False)
def scope_counts(spark, d):
    c = table(spark, d, "customer").where(F.col("c_acctbal") > 9000).select("c_custkey", F.col("c_nationkey").alias("n_nationkey"))
    rows = table(spark, d, "nation").join(c, "n_nationkey", "left")
    return rows.groupBy("n_nationkey", "n_name").agg(F.count_distinct("c_custkey").alias("customers"))


@query("SELECT doc_id FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)", model=False)
def semi_join(spark, d):
    return table(spark, d, "documents").select("doc_id").join(table(spark, d, "labels").where(F.col("quality") == 1), "doc_id", "left_semi")


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)", model=False)
def anti_join(spark, d):
    return table(spark, d, "documents").select("doc_id").join(table(spark, d, "labels"), "doc_id", "left_anti")


@query("SELECT user_id, event_id, (20 + (row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) * 60) // count(*) OVER (PARTITION BY user_id))::INTEGER AS progress FROM events", model=False)
def progress_steps(spark, d):
    rows = table(spark, d, "events").select(F.col("user_id").alias("stream"), F.struct("ts", "event_id").alias("seq"), F.lit("x").alias("path"), "event_id")
    return text.progress_records(rows).select(F.col("stream").alias("user_id"), "event_id", "progress")


@query("SELECT event_id, ('{\"event_id\":' || event_id || ',\"kind\":\"' || event_type || '\"}') AS record FROM events", model=False)
def ndjson_records(spark, d):
    return table(spark, d, "events").select("event_id", text.ndjson(F.col("event_id"), F.col("event_type").alias("kind")).alias("record"))


# Sources ------------------------------------------------------------------------
@query()
def parse_functions(spark, d):
    """Definitions of generated files in each language, parsed: a file per part."""
    from callscope.sources.files import parse_files, parsed_records

    p = table(spark, d, "part")
    word = F.regexp_replace("p_name", "[^A-Za-z]+", "_")
    kinds = [(".py", "def %s(a):\n    return other(a)\n"), (".js", "function %s(a) { return other(a); }\n"), (".ts", "export function %s(a: string): void { other(a); }\n"), (".go", "package p\nfunc %s(a int) { other(a) }\n"), (".java", "class C { void %s(int a) { other(a); } }\n")]
    pick = F.pmod("p_partkey", F.lit(len(kinds)))
    path, code = F.lit(None).cast("string"), F.lit(None).cast("string")
    for k, (suffix, template) in enumerate(kinds):
        path = F.when(pick == k, F.concat(F.lit("src/f"), "p_partkey", F.lit(suffix))).otherwise(path)
        code = F.when(pick == k, F.format_string(template, word)).otherwise(code)
    files = p.select(F.lit("org/parts").alias("repo_name"), path.alias("path"), code.cast("binary").alias("content"))
    rows = parsed_records(parse_files(files)).select("repo_name", F.explode("functions").alias("f"))
    return rows.select("repo_name", "f.name", "f.qualified_name", "f.file_path", "f.language", "f.signature", "f.entity_id", F.size("f.calls").alias("n_calls"))


ORACLES["parse_functions"] = """
WITH p AS (SELECT p_partkey AS k, regexp_replace(p_name, '[^A-Za-z]+', '_', 'g') AS name, p_partkey % 5 AS x FROM part),
f AS (
  SELECT name, 'src/f' || k || ['.py', '.js', '.ts', '.go', '.java'][x + 1] AS file_path, ['python', 'javascript', 'typescript', 'go', 'java'][x + 1] AS language,
         ['(a)', '(a)', '(a: string)', '(a int)', '(int a)'][x + 1] AS signature, CASE WHEN x = 4 THEN 'C.' ELSE '' END || name AS qualified_name FROM p)
SELECT 'org/parts' AS repo_name, name, qualified_name, file_path, language, signature,
  'fn:v1:' || sha256('["org/parts","' || file_path || '","' || language || '","' || qualified_name || '","signature:' || signature || ';occurrence:1"]') AS entity_id, 1::INTEGER AS n_calls
FROM f
"""

