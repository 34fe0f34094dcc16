"""The driver's tables read as source graphs, and the same mapping in SQL.

Parts are definitions in two repositories; of an order's lines the least part is the
caller and every other part is called by its name.  Parts named ``red ...`` are not
defined, so calls to them are external; of ``blue ...`` one per repository is.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from callscope.operators import resolve
from callscope.operators.graph import Graph
from callscope.schema import EXTERNAL


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def definitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Many rows of a small file are few tasks' to read: they are dealt out before any work on them.
    p = table(spark, sf_dir, "part").where(~F.startswith("p_name", F.lit("red "))).select("p_partkey", "p_name", "p_brand", "p_type", "p_size").repartition("p_partkey")
    rows = p.select(
        F.concat(F.lit("org/r"), F.pmod("p_partkey", F.lit(2))).alias("repo_name"), F.col("p_partkey").cast("string").alias("entity_id"), "p_partkey", F.col("p_name").alias("name"),
        F.concat("p_type", F.lit("."), "p_name").alias("qualified_name"), F.concat("p_brand", F.lit("/"), "p_size").alias("file_path"), F.col("p_type").alias("signature"), F.col("p_size").alias("start_line"),
    )
    blue = F.startswith("name", F.lit("blue "))
    once = rows.where(blue).groupBy("repo_name", "name").agg(F.min("p_partkey").alias("p_partkey"))
    return rows.where(~blue).unionByName(rows.where(blue).join(once, ["repo_name", "name", "p_partkey"], "left_semi"))


def _called(spark: SparkSession, sf_dir: str) -> DataFrame:
    """caller (a part), name, ordinal of each call."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber")
    # One exchange by order; parts are unique, so the hashed sides here and below are even.
    first = F.min("l_partkey").over(W.partitionBy("l_orderkey"))
    called = lines.withColumn("caller", first).where(F.col("l_partkey") != F.col("caller"))
    names = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_name").alias("name"))
    return called.join(names.hint("shuffle_hash"), "l_partkey").select("caller", "name", (F.col("l_orderkey") * 16 + F.col("l_linenumber")).alias("ordinal"))


def _by_caller(called: DataFrame, defs: DataFrame, *columns: str) -> DataFrame:
    by = defs.select("repo_name", F.col("p_partkey").alias("caller"), F.col("entity_id").alias("caller_id"), "file_path", "qualified_name")
    return called.join(by.hint("shuffle_hash"), "caller").select("repo_name", "caller_id", "file_path", "qualified_name", "name", *columns)


def sites(spark: SparkSession, sf_dir: str, defs: DataFrame) -> DataFrame:
    """repo_name, caller_id, file_path, qualified_name, name, ordinal of each call."""
    return _by_caller(_called(spark, sf_dir), defs, "ordinal")


def resolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outcomes of all calls, summed up by the caller's number, before it gets its long names."""
    defs = definitions(spark, sf_dir)
    calls = _called(spark, sf_dir).repartition("caller").groupBy("caller", "name").agg(F.count(F.lit(1)).alias("n_sites"), F.min("ordinal").alias("first_ordinal"))
    return resolve.outcomes(_by_caller(calls, defs, "n_sites", "first_ordinal"), defs)


def sample_graph(spark: SparkSession, sf_dir: str, calls: bool = True) -> Graph:
    """A graph of two repositories; a function's community is its part size modulo 7, modulo 3 of them without a row."""
    defs = definitions(spark, sf_dir)
    none = F.lit(None)
    community = F.when(F.col("start_line") % 10 == 0, none).otherwise(F.col("start_line") % 7).cast("bigint")
    functions = defs.select(
        "repo_name", "entity_id", "name", "qualified_name", "file_path", F.lit("python").alias("language"), "signature", none.cast("string").alias("definition_discriminator"), "start_line",
        none.cast("int").alias("end_line"), none.cast("int").alias("start_column"), none.cast("int").alias("end_column"), F.concat(F.lit("def "), "name").alias("raw_code"), none.cast("array<string>").alias("ambiguous_calls"),
        none.cast("array<float>").alias("embedding"), community.alias("leiden_community"),
    )
    files = defs.select("repo_name", F.col("file_path").alias("path")).distinct().withColumn("updated_at", none.cast("timestamp"))
    links = resolve.call_table(resolved(spark, sf_dir)) if calls else spark.createDataFrame([], "repo_name string, caller_id string, target_kind string, target_key string, resolution string, call_count bigint, source_file string")
    parts = table(spark, sf_dir, "part")
    red = parts.where(F.startswith("p_name", F.lit("red "))).select(F.col("p_name").alias("name")).unionByName(parts.select(F.col("p_type").alias("name"))).distinct()
    # Every undefined name is known to both repositories; types are, too, and nothing calls them.
    externals = red.select(F.explode(F.array(F.lit("org/r0"), F.lit("org/r1"))).alias("repo_name"), "name")
    regions = table(spark, sf_dir, "region").select(F.explode(F.array(F.lit("org/r0"), F.lit("org/r1"))).alias("repo_name"), F.col("r_regionkey").cast("bigint").alias("community_id"), F.col("r_name").alias("name"), F.concat(F.lit("about "), "r_name").alias("description"))
    tokens = defs.groupBy("repo_name").agg(F.sum("start_line").cast("bigint").alias("total_tokens")).select("repo_name", F.element_at(F.split("repo_name", "/"), -1).alias("name"), "total_tokens", F.lit("pattern").alias("tokenizer_model"), none.cast("timestamp").alias("tokens_updated_at"))
    return Graph(files=files, functions=functions, external_functions=externals, calls=links, communities=regions, repositories=tokens)


def numbered(rows: DataFrame, *keys: str) -> DataFrame:
    return rows.withColumn("n", F.row_number().over(W.partitionBy(*keys[:-1]).orderBy(keys[-1])))


#: The same mapping as common table expressions.
SQL = f"""
WITH raw_defs AS (
  SELECT 'org/r' || (p_partkey % 2) AS repo_name, p_partkey, p_partkey::VARCHAR AS entity_id, p_name AS name, p_type || '.' || p_name AS qualified_name,
         p_brand || '/' || p_size AS file_path, p_type AS signature, p_size AS start_line
  FROM part WHERE p_name NOT LIKE 'red %'),
defs AS (
  SELECT *, CASE WHEN start_line % 10 = 0 THEN NULL ELSE start_line % 7 END::BIGINT AS community FROM raw_defs
  WHERE name NOT LIKE 'blue %' OR (repo_name, name, p_partkey) IN (SELECT (repo_name, name, min(p_partkey)) FROM raw_defs GROUP BY repo_name, name)),
files AS (SELECT DISTINCT repo_name, file_path AS path FROM defs),
externals AS (
  SELECT DISTINCT r.repo_name, n.name FROM (SELECT p_name AS name FROM part WHERE p_name LIKE 'red %' UNION SELECT p_type FROM part) n, (VALUES ('org/r0'), ('org/r1')) r(repo_name)),
communities AS (SELECT r.repo_name, r_regionkey::BIGINT AS community_id, r_name AS name, 'about ' || r_name AS description FROM region, (VALUES ('org/r0'), ('org/r1')) r(repo_name)),
firsts AS (SELECT l_orderkey, min(l_partkey) AS caller FROM lineitem GROUP BY l_orderkey),
sites AS (
  SELECT d.repo_name, d.entity_id AS caller_id, d.file_path, d.qualified_name, p.p_name AS name, l.l_orderkey * 16 + l.l_linenumber AS ordinal
  FROM lineitem l JOIN firsts f USING (l_orderkey) JOIN defs d ON d.p_partkey = f.caller JOIN part p ON p.p_partkey = l.l_partkey WHERE l.l_partkey <> f.caller),
asked AS (SELECT repo_name, caller_id, file_path, qualified_name, name, count(*) AS n_sites, min(ordinal) AS first_ordinal FROM sites GROUP BY ALL),
cand AS (
  SELECT repo_name, caller_id, name, file_path, u.depth,
         array_to_string(list_concat(list_slice(string_split(qualified_name, '.'), 1, u.depth), [name]), '.') AS candidate
  FROM asked, (SELECT unnest(range(0, 20)) AS depth) u WHERE u.depth <= len(string_split(qualified_name, '.'))),
hits AS (
  SELECT c.repo_name, c.caller_id, c.name, c.depth, count(*) AS matches, min(d.entity_id) AS target_id
  FROM cand c JOIN defs d ON d.repo_name = c.repo_name AND d.file_path = c.file_path AND d.qualified_name = c.candidate GROUP BY ALL),
m0 AS (SELECT repo_name, caller_id, name, arg_max(matches, depth) AS matches, arg_max(target_id, depth) AS target_id FROM hits GROUP BY ALL),
m1 AS (SELECT repo_name, file_path, name, count(*) AS matches, min(entity_id) AS target_id FROM defs GROUP BY ALL),
m2 AS (SELECT repo_name, name, count(*) AS matches, min(entity_id) AS target_id FROM defs GROUP BY ALL),
outcome AS (
  SELECT a.repo_name, a.caller_id, a.file_path, a.name, a.n_sites, a.first_ordinal,
         coalesce(m0.matches, m1.matches, m2.matches, 0) AS matches,
         CASE WHEN m0.matches IS NOT NULL THEN 'lexical_scope' WHEN m1.matches IS NOT NULL THEN 'same_file' WHEN m2.matches IS NOT NULL THEN 'repository_unique' ELSE 'external' END AS resolution,
         CASE WHEN coalesce(m0.matches, m1.matches, m2.matches) = 1 THEN coalesce(m0.target_id, m1.target_id, m2.target_id) END AS target_id
  FROM asked a LEFT JOIN m0 ON a.repo_name = m0.repo_name AND a.caller_id = m0.caller_id AND a.name = m0.name
  LEFT JOIN m1 ON a.repo_name = m1.repo_name AND a.file_path = m1.file_path AND a.name = m1.name
  LEFT JOIN m2 ON a.repo_name = m2.repo_name AND a.name = m2.name),
internal AS (
  SELECT repo_name, caller_id, target_id, arg_min(resolution, (first_ordinal, name)) AS resolution, sum(n_sites)::BIGINT AS call_count, min(file_path) AS source_file
  FROM outcome WHERE matches = 1 GROUP BY repo_name, caller_id, target_id),
outside AS (SELECT repo_name, caller_id, name AS target_name, n_sites::BIGINT AS call_count, file_path AS source_file FROM outcome WHERE matches = 0),
calls AS (
  SELECT repo_name, caller_id, 'Function' AS target_kind, target_id AS target_key, resolution, call_count, source_file FROM internal
  UNION ALL SELECT repo_name, caller_id, '{EXTERNAL}', target_name, 'external', call_count, source_file FROM outside),
targets AS (
  SELECT repo_name, 'Function' AS kind, entity_id AS key, name, qualified_name, file_path FROM defs
  UNION ALL SELECT repo_name, '{EXTERNAL}', name, name, NULL, NULL FROM externals),
linked AS (
  SELECT c.*, t.name AS t_name, t.qualified_name AS t_qn, t.file_path AS t_file, d.name AS c_name, d.qualified_name AS c_qn, d.file_path AS c_file
  FROM calls c JOIN targets t ON c.repo_name = t.repo_name AND c.target_kind = t.kind AND c.target_key = t.key JOIN defs d ON d.repo_name = c.repo_name AND d.entity_id = c.caller_id),
nodes AS (
  SELECT repo_name, 'File' AS kind, path AS id, path AS label, path AS file_path, NULL::BIGINT AS community FROM files
  UNION ALL SELECT repo_name, 'Function', entity_id, qualified_name, file_path, community FROM defs),
edges AS (
  SELECT repo_name, 'DEFINES' AS edge, 'File' AS source_kind, file_path AS source, 'Function' AS target_kind, entity_id AS target FROM defs
  UNION ALL SELECT repo_name, 'CALLS', 'Function', caller_id, target_kind, target_key FROM calls)
"""
