"""The engine's surface: ingest, update, ask, delete."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from callscope import settings
from callscope.functions.text import count_tokens, progress_records, token_counter
from callscope.operators import graph, store, vectors
from callscope.operators.checkpoints import cut
from callscope.operators.vectors import hash_embedder
from callscope.sources import files
from callscope.streaming import push

DIMENSIONS = 64
WINDOW_LIMIT = graph.WINDOW_LIMIT


class Engine:
    """Graphs of repositories under ``root``; ``provider`` embeds texts, by default without a model."""

    def __init__(self, spark: SparkSession, root: str, provider: Callable | None = None, dimensions: int = DIMENSIONS, cache: vectors.EmbeddingCache | None = None):
        self.spark, self.store = spark, store.Store(spark, root)
        self.provider, self.dimensions, self.cache = provider or hash_embedder(dimensions), dimensions, cache

    # Writing --------------------------------------------------------------
    def _write(self, repo: str, parsed: DataFrame) -> str:
        g = store.build(parsed, self.provider, self.dimensions, cache=self.cache.read() if self.cache else None)
        version = self.store.write(repo, g)
        if self.cache:
            self.cache.add(self.store.read(repo).functions)
        return version

    def ingest(self, repo: str, folder: str) -> str:
        """Read, parse and store a source tree; any file that fails ends it before anything is written."""
        found = files.source_files(self.spark, folder).withColumn("repo_name", F.lit(repo))
        return self._write(repo, files.parsed_records(files.parse_files(found, count_tokens=count_tokens)))

    def ingest_archive(self, repo: str, content: bytes | Callable[[str], bytes]) -> str:
        """Store the source files of an archive: its bytes, or what fetches them by the repository's name."""
        data = content(repo) if callable(content) else content
        archives = self.spark.createDataFrame([(repo, bytearray(data))], "repo_name string, content binary")
        return self._write(repo, files.parsed_records(files.parse_files(files.archive_files(archives), count_tokens=count_tokens)))

    def progress(self, repo: str, folder: str):
        """Ingest with progress records (JSON lines): a record per file from 20 to 80 per cent, in order of paths; errors end it.

        Files are parsed in parallel and once; their records follow when all are done.
        """
        line = lambda **x: json.dumps(x, separators=(",", ":"))
        yield line(status="Discovering source files", progress=10)
        found = files.source_files(self.spark, folder).withColumn("repo_name", F.lit(repo))
        parsed = cut(files.parse_files(found, count_tokens=count_tokens))
        steps = progress_records(parsed.select(F.col("repo_name").alias("stream"), "path", "error", F.col("path").alias("seq")))
        total = bad = 0
        for r in steps.orderBy("done").toLocalIterator():
            total, bad = r["total"], bad + (r["error"] is not None)
            yield line(status=r["message"], progress=r["progress"])
        yield line(status=f"Parsed {total} files", progress=80)
        if bad:
            yield line(status="Ingestion failed", progress=80, error=f"{bad} of {total} files could not be parsed")
            return
        yield line(status="Resolving calls and finding communities", progress=85)
        self._write(repo, files.parsed_records(parsed))
        yield line(status="Done", progress=100, repo_name=repo, total_repo_tokens=graph.token_baseline(self.graph(repo)).first()["total_tokens"])

    def update(self, repo: str, sha: str, updated: list[str], deleted: list[str], fetch: Callable) -> str | None:
        return push.apply_push(self.store, repo, sha, updated, deleted, fetch, self.provider, self.dimensions)

    def follow(self, events: DataFrame, fetch: Callable, checkpoint: str, **trigger):
        """Apply a stream of push events to the stored graphs."""
        return push.apply_pushes(events, self.store, fetch, checkpoint, self.provider, self.dimensions, **trigger)

    def delete(self, repo: str) -> None:
        self.store.delete(repo)

    # Asking ---------------------------------------------------------------
    def graph(self, repo: str) -> graph.Graph:
        return self.store.read(repo.strip())

    def blast_radius(self, repo: str, name: str) -> str:
        """JSON of a function's direct callers."""
        repo, name = repo.strip(), name.strip()
        rows = []
        if repo and name:
            columns = ("caller", "file_paths", "target", "target_file", "target_is_external")
            rows = [r.asDict(True) for r in graph.callers(self.graph(repo), name).select(*columns).collect()]
        return json.dumps({"repo_name": repo, "function_name": name, "target_is_external": any(r["target_is_external"] for r in rows), "callers": rows})

    def structure(self, repo: str) -> str:
        """Paths of the repository's files, a line each."""
        return "\n".join(r["file_path"] for r in graph.file_list(self.graph(repo), ordered=True).toLocalIterator()) if repo.strip() else ""

    def functions_in_file(self, repo: str, path: str) -> str:
        repo, path = repo.strip(), path.strip()
        if not repo or not path:
            return "No functions found."
        names = [r["function_name"] for r in graph.functions_in_file(self.graph(repo), path, ordered=True).collect() if r["function_name"]]
        return "\n".join([f"Functions in {path}:", *(f"- {n}" for n in names)]) if names else f"No functions found in {path}."

    def outgoing_dependencies(self, repo: str, name: str) -> str:
        """What a function calls, apart for each definition of the name."""
        repo, name = repo.strip(), name.strip()
        if not repo or not name:
            return "No outgoing dependencies found."
        rows = graph.grouped_dependencies(graph.outgoing(self.graph(repo), name)).orderBy(F.col("caller_file").asc_nulls_last(), F.col("caller_name").asc_nulls_last()).collect()
        if not rows:
            return f"No outgoing dependencies found for {name}."
        if len(rows) == 1:
            return "\n".join([f"Outgoing dependencies for {name}:", *(f"- {d}" for d in rows[0]["dependencies"])])
        lines = [f"Outgoing dependencies for {len(rows)} definitions named {name}:"]
        for r in rows:
            lines += [f"{r['caller_name']} ({r['caller_file'] or 'unknown file'}):", *(f"  - {d}" for d in r["dependencies"])]
        return "\n".join(lines)

    def external_dependencies(self, repo: str) -> str:
        names = [r["function_name"] for r in graph.external_list(self.graph(repo), ordered=True).toLocalIterator()] if repo.strip() else []
        return "\n".join(["External dependencies:", *(f"- {n}" for n in names)]) if names else "No external dependencies found."

    def search(self, query: str, repo: str, top_k: int = vectors.DEFAULT_K, prefilter: bool = False) -> str:
        """The functions whose embedding text is nearest to the query.

        Stored repositories are searched together and filtered afterwards, unless ``prefilter``.
        """
        query, repo = query.strip(), repo.strip()
        if not query or not repo:
            return "No semantic code matches found."
        found = self.graph(repo).functions if prefilter else self.store.all_functions()
        rows = vectors.top_k(found, self.provider([query])[0], top_k, repo, prefilter).collect()
        lines = [f"- {r['function_name']} ({r['file_path'] or 'unknown file'}) — similarity {r['score']:.4f}" for r in rows if r["function_name"]]
        return "\n".join([f'Semantic code matches for "{query}":', *lines]) if lines else f'No semantic code matches found for "{query}".'

    def subsystems(self, repo: str) -> str:
        """JSON array of communities, largest first."""
        if not repo.strip():
            return "[]"
        return json.dumps([r.asDict() for r in graph.subsystems(self.graph(repo)).select("id", "module_title", "module_description", "function_count").collect()])

    def node_code(self, repo: str, entity_id: str) -> dict | None:
        row = graph.node_code(self.graph(repo), entity_id).first()
        return row.asDict() if row else None

    def graph_window(self, repo: str, limit: int = WINDOW_LIMIT) -> DataFrame:
        return graph.window(self.graph(repo), limit)

    def ask(self, request: dict) -> tuple[str, str]:
        """Message and repository of a chat request, checked (see :mod:`callscope.settings`)."""
        return settings.message(request.get("message")), settings.repository(request.get("repo_name"))

    def context_metrics(self, repo: str, context: str) -> dict:
        """Tokens of a context against the repository's baseline."""
        total = graph.token_baseline(self.graph(repo)).first()["total_tokens"]
        used = self.spark.createDataFrame([(context,)], "t string").select(token_counter()("t").alias("n")).first()["n"]
        good = total > 0
        return {"total_repo_tokens": total, "context_tokens": used, "tokens_saved": total - used if good else 0, "percent_saved": round((total - used) / total * 100, 2) if good else 0.0}
