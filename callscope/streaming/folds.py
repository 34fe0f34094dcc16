"""Folds of streams into tables that batches update."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from callscope.operators.checkpoints import cut
from callscope.streaming.push import file_changes


def _shared(spark: SparkSession) -> str:
    cut(spark.range(1))  # sets the folder if nothing has
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir().rsplit("/", 1)[0]
    return f"{folder.rstrip('/')}/fold-{uuid.uuid4().hex}"


def fold_stream(spark: SparkSession, table: str) -> DataFrame:
    """path and last state (updated or removed) of a Parquet table of events, read as a stream.

    Each micro-batch keeps the last change per path; batches are written beside each other
    by number, so one that runs again overwrites its own, and the last of all is taken when
    read.
    """
    root = _shared(spark)
    schema = spark.read.parquet(table).schema
    # A stream reads folders: a table that is one file is named by pattern.
    events = spark.readStream.schema(schema).parquet(table if table.endswith("/") else f"{table}*")

    def write(batch: DataFrame, number: int) -> None:
        last = file_changes(batch).groupBy("path").agg(F.max(F.struct("seq", "op")).alias("last"))
        last.select("path", "last.*").write.mode("overwrite").parquet(f"{root}/state/batch={number}")

    query = events.writeStream.foreachBatch(write).option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    states = spark.read.parquet(f"{root}/state")
    return states.groupBy("path").agg(F.max_by("op", F.struct("seq", "op")).alias("state"))
