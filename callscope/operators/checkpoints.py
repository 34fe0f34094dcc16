"""Cutting lineage in a folder that driver and executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame


def _folder(spark) -> str:
    """The checkpoint folder; a local session without one gets a temporary one."""
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        found = spark.conf.get("spark.checkpoint.dir", None)
        if not found:
            if not sc.master.startswith("local[") and sc.master != "local":
                raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
            found = tempfile.mkdtemp(prefix="callscope-")
            atexit.register(shutil.rmtree, found, ignore_errors=True)
        sc.setCheckpointDir(found)
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """``df``, computed once and kept in ``spark.checkpoint.dir``; a local session without it gets a temporary folder."""
    _folder(df.sparkSession)
    return df.checkpoint()


def kept(df: DataFrame) -> DataFrame:
    """Like :func:`cut`, as Parquet, for loops.

    A checkpoint hands on the estimate of its plan's size, a product over joins, so it takes
    a time exponential in the number of rounds; a file has the size that it has.
    """
    folder = f"{_folder(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)
