"""Helpers shared by the corpus operators."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Java and Python regex class for the white space that separates words.
SPACE = r"\x20\x09-\x0D"
#: Bytes of an Arrow batch that goes to a Python worker.
BATCH_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (``spark.checkpoint.dir``).

    Only a local session without that setting gets a temporary folder.
    """
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or getattr(sc, "_callscope_dir", None)
    if not found:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        found = sc._callscope_dir = tempfile.mkdtemp(prefix="callscope-")
        atexit.register(shutil.rmtree, found, ignore_errors=True)
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(found)
    return found


def settle(df: DataFrame) -> DataFrame:
    """``df``, computed once and kept in the shared folder; its lineage is cut."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def packed(docs: DataFrame, **more) -> DataFrame:
    """All columns of ``docs`` as the fields of one column, row, beside the columns ``more``: names of the input and of operators can't clash."""
    row = F.struct(*(docs[k].alias(f"c{k}") for k in range(len(docs.columns))))
    return docs.select(row.alias("row"), *(c.alias(n) for n, c in more.items()))


def unpacked(rows: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of ``docs`` from the column row of :func:`packed`."""
    return rows.select(*(F.col(f"row.c{k}").alias(n) for k, n in enumerate(docs.columns)))


def fresh_dir(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def held_out(doc_id) -> F.Column:
    """Rows that no model may learn from: crc32 of the id's text leaves 2 modulo 4."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def map_arrow(df: DataFrame, run, schema) -> DataFrame:
    """``df.mapInArrow`` with batches of at most ``BATCH_BYTES``, or of one row: rows may be long, and a worker holds a few batches.

    Lowers ``spark.sql.execution.arrow.maxBytesPerBatch`` of the session and leaves it so: it
    is read when the result is computed.
    """
    name, conf = "spark.sql.execution.arrow.maxBytesPerBatch", df.sparkSession.conf
    now = conf.get(name).lower().removesuffix("b")
    if not now.isdigit() or int(now) > BATCH_BYTES:
        conf.set(name, str(BATCH_BYTES))
    return df.mapInArrow(run, schema)


def slices(batch: pa.RecordBatch, name: str, most: int = 4 << 20):
    """Row slices of about ``most`` bytes in column ``name``; one long row is a slice of its own."""
    size = pc.fill_null(pc.binary_length(batch.column(name)), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(size.astype(np.int64) + 64)
    at = 0
    while at < len(ends):
        base = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, base + most, "right")))
        yield batch.slice(at, to - at)
        at = to


def code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """All code points of the texts, each text followed by one line feed, and where each text starts (plus the end)."""
    whole = "\n".join(texts) + "\n"
    points = np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), np.uint32)
    starts = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) + 1 for t in texts], out=starts[1:])
    return points, starts


def cut_hot(df: DataFrame, keys: list[str], by: str, cap: int, counted: DataFrame | None = None) -> DataFrame:
    """``df`` with long columns ``ca`` <= ``cb`` and ``c``: groups of ``keys`` with more than ``cap`` rows become blocks.

    A large group is dealt into blocks by the hash of column ``by``; its rows are sent
    to every pair of blocks they take part in, so each (keys, ca, cb) holds about
    2 * cap rows at most, and each pair of rows meets once (ca < cb: only across
    the two blocks).  ``c`` is the row's own block.  ``counted`` has the keys of the same
    rows, where these are had for less than ``df``.
    """
    zero = F.lit(0).cast("int")
    hot = settle((df if counted is None else counted).groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > cap))
    if hot.isEmpty():
        return df.withColumns({"c": zero, "ca": zero, "cb": zero})
    wide = df.join(hot, keys, "left").withColumn("_m", F.ceil(F.coalesce(F.col("_n"), F.lit(1)) / F.lit(cap)).cast("int"))
    wide = wide.withColumn("c", F.pmod(F.xxhash64(by), F.col("_m")).cast("int"))
    wide = wide.withColumn("_o", F.explode(F.sequence(zero, F.col("_m") - 1)))
    wide = wide.withColumns({"ca": F.least("c", "_o"), "cb": F.greatest("c", "_o")})
    return wide.drop("_n", "_m", "_o")


def grouped(batches, keys: list[str], most: int = 1 << 16):
    """Chunks of whole groups from batches sorted by ``keys``: (table, where each group starts and the end)."""
    rest = None

    def starts(t: pa.Table) -> np.ndarray:
        new = np.ones(t.num_rows, bool)
        new[1:] = False
        for k in keys:
            v = t.column(k).combine_chunks().to_numpy(zero_copy_only=False)
            new[1:] |= v[1:] != v[:-1]
        return np.append(np.flatnonzero(new), t.num_rows)

    for batch in batches:
        t = pa.Table.from_batches([batch])
        rest = t if rest is None else pa.concat_tables([rest, t])
        if rest.num_rows < most:
            continue
        s = starts(rest)
        if len(s) > 2:
            yield rest.slice(0, s[-2]), s[:-1]
            rest = rest.slice(s[-2])
    if rest is not None and rest.num_rows:
        yield rest, starts(rest)


def union_labels(labels: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Merge the classes of rows i and j; ``labels`` point to the smallest row of each class."""
    while len(i):
        a, b = labels[i], labels[j]
        open_ = a != b
        if not open_.any():
            break
        i, j, a, b = i[open_], j[open_], a[open_], b[open_]
        np.minimum.at(labels, np.maximum(a, b), np.minimum(a, b))
        while True:
            up = labels[labels]
            if np.array_equal(up, labels):
                break
            labels = up
    return labels
