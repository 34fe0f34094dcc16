"""Stored graphs: Parquet by repository, each write a new version that becomes visible as a whole.

``<root>/<table>/repo_name=<name>/version=<id>`` holds a repository's rows of a table;
``<root>/heads/repo_name=<name>`` names the version that readers see.  It is written last,
so a reader never sees half of a write, and a failed write leaves the former one.
"""

from __future__ import annotations

import time
import uuid
from urllib.parse import quote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from callscope.operators import changes, community, resolve
from callscope.operators.checkpoints import cut
from callscope.operators.graph import Graph
from callscope.operators.vectors import embed_functions, known_embeddings
from callscope.schema import EXTERNAL, TABLES


def empty(spark: SparkSession) -> Graph:
    return Graph(**{t: spark.createDataFrame([], s) for t, s in TABLES.items()})


def function_rows(parsed: DataFrame) -> DataFrame:
    """Definitions of parsed files (repo_name and the columns of PARSED_FILE), a row each.

    Declarations without a body, and rows without name, qualified name, language or
    discriminator are left out; of equal ids the first stays.  An id that is not its row's
    is an error.
    """
    from callscope.functions.identity import entity_id

    rows = parsed.select("repo_name", F.col("file_path").alias("path"), F.posexplode("functions").alias("pos", "f")).select("repo_name", "path", "pos", "f.*")
    blank = lambda c: F.coalesce(F.trim(c) == "", F.lit(True))
    rows = rows.where(F.coalesce("has_body", F.lit(True)) & ~blank("name") & ~blank("qualified_name") & ~blank("language") & ~blank("definition_discriminator"))
    own = entity_id(F.col("repo_name"), F.col("path"), F.col("language"), F.col("qualified_name"), F.col("definition_discriminator"))
    rows = rows.withColumn("own", own)
    checked = F.when(F.col("entity_id").isNull() | (F.col("entity_id") == F.col("own")), F.col("own")).otherwise(F.raise_error(F.concat(F.lit("entity id does not match: "), "entity_id")).cast("string"))
    rows = rows.select("repo_name", checked.alias("entity_id"), "name", "qualified_name", F.col("path").alias("file_path"), "language", "signature", "definition_discriminator", "start_line", "end_line", "start_column", "end_column", F.coalesce("raw_code", F.lit("")).alias("raw_code"), "calls", "pos")
    first = rows.groupBy("repo_name", "entity_id").agg(F.min_by(F.struct(*(c for c in rows.columns if c not in ("repo_name", "entity_id"))), F.struct("file_path", "pos")).alias("r"))
    return first.select("repo_name", "entity_id", "r.*").drop("pos")


def build(parsed: DataFrame, provider=None, dimensions: int = 64, tokenizer_model: str = "pattern", total_tokens: int | None = None, cache: DataFrame | None = None) -> Graph:
    """A whole graph from parsed files: definitions, resolved calls, embeddings, communities and labels.

    Files are read and parsed once: their records are kept before anything uses them.
    ``total_tokens`` overrides the sum of the records' tokens.
    """
    spark = parsed.sparkSession
    parsed = cut(parsed)
    functions = cut(function_rows(parsed))
    resolved = cut(resolve.resolve(resolve.sites_of(functions), functions.select("repo_name", "entity_id", "file_path", "qualified_name", "name")))
    calls = resolve.call_table(resolved)
    ambiguous = resolve.ambiguous_names(resolved).withColumnRenamed("caller_id", "entity_id")
    rows = functions.drop("calls").join(ambiguous, ["repo_name", "entity_id"], "left").withColumn("ambiguous_calls", F.coalesce("ambiguous_calls", F.array().cast("array<string>")))
    rows = cut(embed_functions(rows, provider, dimensions, cache)) if provider else rows.withColumn("embedding", F.lit(None).cast("array<float>"))
    rows = rows.withColumn("leiden_community", F.lit(None).cast("bigint"))
    now = F.current_timestamp()
    files = parsed.select("repo_name", F.col("file_path").alias("path")).distinct().withColumn("updated_at", now)
    tokens = F.sum(F.when(F.col("source_tokens") >= 0, F.col("source_tokens"))).cast("bigint") if total_tokens is None else F.lit(total_tokens).cast("bigint")
    repositories = parsed.groupBy("repo_name").agg(tokens.alias("total_tokens")).select("repo_name", F.element_at(F.split("repo_name", "/"), -1).alias("name"), "total_tokens", F.lit(tokenizer_model).alias("tokenizer_model"), now.alias("tokens_updated_at"))
    externals = calls.where(F.col("target_kind") == EXTERNAL).select("repo_name", F.col("target_key").alias("name")).distinct()
    g = Graph(files=files, functions=rows, external_functions=externals, calls=calls, communities=spark.createDataFrame([], TABLES["communities"]), repositories=repositories)
    return cluster(g)


def cluster(g: Graph, labeler=community.sample_labeler) -> Graph:
    """The graph with communities found anew, small ones pooled, the others labelled."""
    functions = cut(community.write_back(g.functions, community.detect(g)))
    functions, labels = community.label(functions, labeler)
    return Graph(files=g.files, functions=functions, external_functions=g.external_functions, calls=g.calls, communities=labels, repositories=g.repositories)


class Store:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _head(self, repo: str) -> str:
        if not repo.strip():
            raise ValueError("a repository needs a name")
        return f"{self.root}/heads/repo_name={quote(repo.strip(), safe='')}"

    def _exists(self, uri: str) -> bool:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(uri)
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path)

    def _set_head(self, repo: str, version: str | None) -> None:
        row = self.spark.createDataFrame([(repo.strip(), version)], "repo string, version string")
        row.coalesce(1).write.mode("overwrite").parquet(self._head(repo))

    def version(self, repo: str) -> str | None:
        head = self._head(repo)
        return self.spark.read.parquet(head).first()["version"] if self._exists(f"{head}/_SUCCESS") else None

    def write(self, repo: str, g: Graph) -> str:
        """Replace the repository's rows in all tables; returns the version.

        Two functions of one id are an error, raised before readers see anything.
        """
        repo, version = repo.strip(), uuid.uuid4().hex
        twice = g.functions.where(F.col("repo_name") == repo).groupBy("entity_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("entity_id").isNotNull() & (F.col("n") > 1)).first()
        if twice:
            raise ValueError(f"{twice['n']} functions have the id {twice['entity_id']}")
        for table, schema in TABLES.items():
            names = [c.split()[0] for c in schema.split(", ")]
            rows = getattr(g, table).where(F.col("repo_name") == repo).select(*names).drop("repo_name")
            if table == "functions":  # readers skip row groups by file
                rows = rows.repartitionByRange("file_path").sortWithinPartitions("file_path", "name")
            rows.write.parquet(f"{self.root}/{table}/repo_name={quote(repo, safe='')}/version={version}")
        self._set_head(repo, version)
        return version

    def read(self, repo: str) -> Graph:
        """A repository's graph; no rows if it is unknown or deleted.  Only its own files are listed and read."""
        version = self.version(repo)
        if version is None:
            return empty(self.spark)
        at = f"repo_name={quote(repo.strip(), safe='')}/version={version}"
        tables = {}
        for table, schema in TABLES.items():
            names = [c.split()[0] for c in schema.split(", ")]
            tables[table] = self.spark.read.parquet(f"{self.root}/{table}/{at}").withColumn("repo_name", F.lit(repo.strip())).select(*names)
        return Graph(**tables)

    def repositories(self) -> list[str]:
        """Names of the stored repositories."""
        if not self._exists(f"{self.root}/heads"):
            return []
        heads = self.spark.read.parquet(f"{self.root}/heads")
        return sorted(r["repo"] for r in heads.where(F.col("version").isNotNull()).select("repo").toLocalIterator())

    def delete(self, repo: str) -> None:
        """Hide all of a repository's rows; a blank name is an error.  :meth:`vacuum` frees them."""
        self._set_head(repo, None)

    def delete_all(self) -> None:
        for repo in self.repositories():
            self.delete(repo)

    def vacuum(self, keep_seconds: float = 86_400.0) -> int:
        """Remove versions that no head names and that were written more than ``keep_seconds`` ago; returns how many folders went.

        Readers that opened an older version have that long to finish.  A write in progress
        is younger than its own start, so it must take less.
        """
        fs_path = self.spark._jvm.org.apache.hadoop.fs.Path
        fs = fs_path(self.root).getFileSystem(self.spark._jsc.hadoopConfiguration())
        heads = {quote(r["repo"], safe=""): r["version"] for r in self.spark.read.parquet(f"{self.root}/heads").select("repo", "version").toLocalIterator()} if self._exists(f"{self.root}/heads") else {}
        oldest, gone = time.time() * 1000 - keep_seconds * 1000, 0
        for table in TABLES:
            if not self._exists(f"{self.root}/{table}"):
                continue
            for repo in fs.listStatus(fs_path(f"{self.root}/{table}")):
                name = repo.getPath().getName().removeprefix("repo_name=")
                for version in fs.listStatus(repo.getPath()):
                    if version.getPath().getName() != f"version={heads.get(name)}" and version.getModificationTime() <= oldest:
                        gone += fs.delete(version.getPath(), True)
        return gone

    def all_functions(self) -> DataFrame:
        """Narrow function rows (with embeddings) of all stored repositories: one scan of the table, and a join with the versions that readers see."""
        names = ["repo_name", "entity_id", "name", "qualified_name", "file_path", "embedding"]
        if not self._exists(f"{self.root}/heads") or not self._exists(f"{self.root}/functions"):
            return empty(self.spark).functions.select(*names)
        heads = self.spark.read.parquet(f"{self.root}/heads").where(F.col("version").isNotNull()).select(F.col("repo").alias("repo_name"), "version")
        rows = self.spark.read.option("basePath", f"{self.root}/functions").parquet(f"{self.root}/functions").withColumn("repo_name", F.url_decode("repo_name"))
        return rows.join(heads, ["repo_name", "version"]).select(*names)

    def apply(self, repo: str, parsed: DataFrame, deleted: list[str], provider=None, dimensions: int = 64) -> str:
        """An incremental update: changed files (parsed) and deleted paths; the token baseline stays.

        The changed files are fetched and parsed once, all before anything is written.
        Texts that the stored graph has a vector for are not embedded again.
        """
        g = self.read(repo)
        parsed = cut(parsed)
        functions = cut(function_rows(parsed))
        rows = functions.drop("calls")
        rows = cut(embed_functions(rows, provider, dimensions, known_embeddings(g.functions))) if provider else rows.withColumn("embedding", F.lit(None).cast("array<float>"))
        files = parsed.select("repo_name", F.col("file_path").alias("path")).distinct().withColumn("updated_at", F.current_timestamp())
        gone = self.spark.createDataFrame([(repo, p) for p in deleted], "repo_name string, path string")
        rows = rows.withColumn("ambiguous_calls", F.array().cast("array<string>")).withColumn("leiden_community", F.lit(None).cast("bigint"))
        return self.write(repo, cluster(changes.apply_change_set(g, files, rows, resolve.sites_of(functions), gone)))
