"""Push events as a stream: checked, folded into change sets, applied to stored graphs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from callscope.functions.text import hmac_valid
from callscope.operators import changes
from callscope.operators.checkpoints import cut
from callscope.operators.store import Store
from callscope.schema import PUSH_EVENT
from callscope.sources.files import fetched_files, parse_files, parsed_records


def push_events(spark: SparkSession, folder: str, files_per_batch: int = 100) -> DataFrame:
    """JSON push events that arrive as files."""
    return spark.readStream.schema(PUSH_EVENT).option("maxFilesPerTrigger", files_per_batch).json(folder)


def verified(bodies: DataFrame, secret: str) -> DataFrame:
    """Events of raw deliveries (body binary, signature) whose signature holds."""
    good = bodies.where(hmac_valid(secret)(F.col("body"), F.col("signature")))
    return good.select(F.from_json(F.col("body").cast("string"), PUSH_EVENT).alias("e")).where(F.col("e").isNotNull()).select("e.*")


def once(events: DataFrame, delivery: str, time: str, delay: str = "1 day") -> DataFrame:
    """Events without those whose ``delivery`` came before, within ``delay`` of event time: what is remembered stays bounded."""
    return events.withWatermark(time, delay).dropDuplicatesWithinWatermark([delivery])


def file_changes(events: DataFrame) -> DataFrame:
    """The changes of a stream or table of simple events (ts, event_id, user_id, event_type): path, seq, op."""
    op = F.when(F.col("event_type") == "error", "removed").otherwise("updated")
    return events.select(F.col("user_id").cast("string").alias("path"), F.struct("ts", "event_id").alias("seq"), op.alias("op"))


def apply_pushes(events: DataFrame, store: Store, fetch: Callable[[str, str, str], bytes], checkpoint: str, provider: Callable | None = None, dimensions: int = 64, order: str = "pushed_at", **trigger) -> StreamingQuery:
    """Apply each admissible push to its repository's stored graph.

    The pushes of a batch are folded into one change set per repository: of each path the
    last state counts, by the field ``order`` of the event, then by its ``after``.  Each
    repository is fetched at the states of its paths' last pushes and written once.  A file
    that can't be fetched or parsed fails the batch before anything of its repository is
    written.
    """

    def run(batch: DataFrame, _: int) -> None:
        rows = batch.withColumn("repo_name", changes.repository()).where(F.col("repo_name").isNotNull() & changes.admissible())
        folded = changes.change_set(rows.where(changes.valid_paths(rows)), "repo_name", order, "after")
        each = F.array(*(F.struct(F.lit(op).alias("op"), F.col(c).alias("paths")) for c, op in (("updated", "updated"), ("deleted", "removed"))))
        paths = folded.select("repo_name", order, "after", F.inline(each)).select("repo_name", "op", "after", F.explode("paths").alias("path"), F.struct(order, "after").alias("seq"))
        last = cut(paths.groupBy("repo_name", "path").agg(F.max_by(F.struct("op", "after"), "seq").alias("s")).select("repo_name", "path", "s.*"))
        for r in last.select("repo_name").distinct().orderBy("repo_name").toLocalIterator():  # a row per repository of this batch
            mine = last.where(F.col("repo_name") == r["repo_name"])
            wanted = mine.where(F.col("op") == "updated").select("repo_name", "path", F.col("after").alias("sha"))
            deleted = [x["path"] for x in mine.where(F.col("op") == "removed").select("path").toLocalIterator()]
            store.apply(r["repo_name"], parsed_records(parse_files(fetched_files(wanted, fetch))), deleted, provider, dimensions)

    return events.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def apply_push(store: Store, repo: str, sha: str, updated: list[str], deleted: list[str], fetch: Callable[[str, str, str], bytes], provider: Callable | None = None, dimensions: int = 64) -> str | None:
    """One push; its version, None if it changes nothing."""
    if not updated and not deleted:
        return None
    wanted = store.spark.createDataFrame([(repo, p, sha) for p in updated], "repo_name string, path string, sha string")
    parsed = parsed_records(parse_files(fetched_files(wanted, fetch)))
    return store.apply(repo, parsed, list(deleted), provider, dimensions)
