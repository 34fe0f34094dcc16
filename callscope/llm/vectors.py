"""Near-duplicate embeddings: random-hyperplane sign hashing in several tables, exact cosine verification, components.

Vectors of one label (and dimension) are compared.  Equal vectors are taken together
first, as one with a multiplicity, so copies are counted and linked without comparing
them.  Each table cuts the space by random hyperplanes; vectors on the same side of all
of them share a bucket.  The number of planes follows the number of vectors, so buckets
stay small; the number of tables follows from it and from the recall wanted at the
threshold.

Buckets are compared twice.  First by the signs alone, which are all that is sent to every
table: the signs of all tables together, as bits, tell how many planes part two vectors, and
pairs parted by more than a pair at the threshold can be (but for one in ``MISSED``) are
out.  A row is wanted in a table if a pair that is left meets there for the first time.
Only wanted rows then get their vectors, and are compared in full, in blocks, in double
precision.

A pair that meets in several tables counts in the first of them.  So no pair is ever sent
anywhere, only each row's number of links and a spanning set of the links of each block.
"""

from __future__ import annotations

import hashlib
import math
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callscope.llm.common import cut_hot, grouped, map_arrow, settle, union_labels
from callscope.llm.components import connected_components

THRESHOLD, RECALL, SEED = 0.98, 0.995, 17
#: Vectors per bucket aimed at, planes of a table at least and at most, tables at most.
AIM, LEAST_PLANES, MOST_PLANES, MOST_TABLES = 16, 10, 40, 64
#: Rows of a bucket above which it is dealt into pairs of blocks.
BUCKET_ROWS = 1024
#: Share of the pairs at the threshold that signs may part too much to be compared.
MISSED = 1e-9


def layout(n: int, threshold: float = THRESHOLD, recall: float = RECALL) -> tuple[int, int]:
    """Planes per table and tables for ``n`` vectors of a label."""
    same = 1 - math.acos(threshold) / math.pi
    planes = min(max(LEAST_PLANES, math.ceil(math.log2(max(n, 1) / AIM))), MOST_PLANES)
    tables = lambda k: math.ceil(math.log(1 - recall) / math.log1p(-(same**k)))
    while planes > 1 and tables(planes) > MOST_TABLES:
        planes -= 1
    return planes, tables(planes)


def most_parted(bits: int, threshold: float = THRESHOLD) -> int:
    """Planes of ``bits`` that part a pair at the threshold at most, but for a share of ``MISSED`` of such pairs (exact binomial tail)."""
    p = math.acos(threshold) / math.pi
    left, k, term = 1.0, 0, math.exp(bits * math.log1p(-p))
    while k < bits and left - term > MISSED:
        left -= term
        term *= (bits - k) / (k + 1) * p / (1 - p)
        k += 1
    return k


@lru_cache(8)
def _planes(dim: int, count: int) -> np.ndarray:
    return np.random.default_rng([SEED, dim]).standard_normal((count, dim)).T.copy()


def _sides(unit: np.ndarray, planes: int, tables: int) -> np.ndarray:
    """(rows, tables, planes): on which side of each plane."""
    return (unit @ _planes(unit.shape[1], planes * tables) > 0).reshape(len(unit), tables, planes)


def _units(raw: list[bytes], dim: int) -> np.ndarray:
    """Unit vectors in double precision from the bytes of floats or doubles."""
    v = np.frombuffer(b"".join(raw), f"<f{len(raw[0]) // dim}").reshape(-1, dim).astype(np.float64)
    v /= np.abs(v).max(axis=1, keepdims=True)  # no overflow in the squares
    return v / np.sqrt(np.einsum("ij,ij->i", v, v))[:, None]


def prepare(vectors: DataFrame) -> DataFrame:
    """vec_id, label, key (16 bytes, equal for equal vectors of a label), dim, raw (its numbers as they came, floats or doubles): rows that may link."""
    kind = "array<float>" if vectors.schema["embedding"].dataType.simpleString() == "array<float>" else "array<double>"
    rows = vectors.select("vec_id", F.col("label").cast("string").alias("label"), F.col("embedding").cast(kind).alias("v"))
    rows = rows.where(F.col("label").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0) & ~F.exists("v", lambda x: x.isNull()))

    def run(batches):
        for batch in batches:
            lists = batch.column("v")
            flat, offset = lists.flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy())])
            keep, keys, dims, raw = [], [], [], []
            for k, label in enumerate(batch.column("label").to_pylist()):
                v = flat[offset[k] : offset[k + 1]] + flat.dtype.type(0)  # no negative zeros
                if not np.isfinite(v).all() or not v.any():
                    continue
                data = v.astype(v.dtype.newbyteorder("<")).tobytes()
                keep.append(k)
                keys.append(hashlib.md5(label.encode() + b"\0" + data).digest())
                dims.append(len(v))
                raw.append(data)
            part = batch.take(pa.array(keep, pa.int64()))
            yield pa.RecordBatch.from_arrays([part.column("vec_id"), part.column("label"), pa.array(keys, pa.binary()), pa.array(dims, pa.int32()), pa.array(raw, pa.binary())], ["vec_id", "label", "key", "dim", "raw"])

    kind = vectors.schema["vec_id"].dataType.simpleString()
    return map_arrow(rows, run, f"vec_id {kind}, label string, key binary, dim int, raw binary")


def hashed(reps: DataFrame, planes: int, tables: int) -> DataFrame:
    """A row per table of each of ``reps`` (label, key, dim, raw): label, dim, t, its signature sig, s (the signs of all tables as bits, table by table) and key."""
    powers = np.int64(1) << np.arange(planes, dtype=np.int64)

    def run(batches):
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            for dim in np.unique(dims):
                part = batch.filter(pa.array(dims == dim))
                side = _sides(_units(part.column("raw").to_pylist(), int(dim)), planes, tables)
                packed = pa.array([s.tobytes() for s in np.packbits(side.reshape(len(side), -1), axis=1)], pa.binary())
                sig = side @ powers
                for t in range(tables):
                    yield pa.RecordBatch.from_arrays([part.column("label"), part.column("dim"), pa.array([t] * len(sig), pa.int32()), pa.array(sig[:, t]), packed, part.column("key")], ["label", "dim", "t", "sig", "s", "key"])

    return map_arrow(reps.select("label", "key", "dim", "raw"), run, "label string, dim int, t int, sig long, s binary, key binary")


def _pairs(part: pa.Table, a: int, b: int, planes: int, most: int, tile: int = 512):
    """Pairs (row, later row) of rows a to b of one bucket that their signs leave, and that meet in no table before, tile by tile."""
    bits = np.frombuffer(b"".join(part.column("s").slice(a, b - a).to_pylist()), np.uint8).reshape(b - a, -1)
    size = 8 * -(-bits.shape[1] // 8)
    words = np.zeros((b - a, size), np.uint8)
    words[:, : bits.shape[1]] = bits
    words = words.view(np.uint64)
    t = part.column("t")[a].as_py()
    signs = np.unpackbits(bits, axis=1)[:, : t * planes].reshape(b - a, t, planes)
    powers = np.int64(1) << np.arange(planes, dtype=np.int64)
    before = signs.astype(np.int64) @ powers  # signatures in the tables before
    own, across = part.column("c").slice(a, b - a).to_numpy(), part.column("ca")[a].as_py() != part.column("cb")[a].as_py()
    for i in range(0, b - a, tile):
        for j in range(i, b - a, tile):
            apart = np.zeros((len(words[i : i + tile]), len(words[j : j + tile])), np.uint16)
            for k in range(words.shape[1]):
                apart += np.bitwise_count(words[i : i + tile, k][:, None] ^ words[j : j + tile, k][None, :])
            x, y = np.nonzero(apart <= most)
            x, y = x + i, y + j
            use = x < y
            if across:
                use &= own[x] != own[y]  # pairs inside a block meet where ca = cb
            x, y = x[use], y[use]
            met = np.zeros(len(x), bool)
            for k in range(t):  # counted in an earlier table
                met |= before[x, k] == before[y, k]
            yield x[~met], y[~met]


def _compare(part: pa.Table, starts: np.ndarray, threshold: float, planes: int, most: int):
    """Number of links of each row found first here, and spanning links (row, smaller row), in whole groups of rows."""
    n = part.num_rows
    count, labels = np.zeros(n, np.int64), np.arange(n)
    weight, dims = part.column("n").to_numpy(), part.column("dim").to_numpy()
    raw = part.column("raw").combine_chunks()
    for a, b in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
        if b - a < 2:
            continue
        v = _units(raw.slice(a, b - a).to_pylist(), int(dims[a]))
        for x, y in _pairs(part, a, b, planes, most):
            for at in range(0, len(x), 1 << 16):
                p, q = x[at : at + (1 << 16)], y[at : at + (1 << 16)]
                near = np.einsum("ij,ij->i", v[p], v[q]) >= threshold
                p, q = a + p[near], a + q[near]
                np.add.at(count, p, weight[q])
                np.add.at(count, q, weight[p])
                labels = union_labels(labels, p, q)
    linked = np.flatnonzero(labels != np.arange(n))
    return count, linked, labels[linked]


def near_vectors(vectors: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """vec_id, n_links, component_id, kept: a row per row of ``vectors`` (vec_id, embedding, label).

    Vectors without label, null, zero, or with null or non-finite components link with
    nothing, nor do vectors of different length.  Repeated rows link with each other.  A
    row with null vec_id counts and links, and names its component only where all ids are
    null; other columns are ignored.
    """
    rows = settle(prepare(vectors))
    reps = settle(rows.groupBy("key").agg(F.first("label").alias("label"), F.first("dim").alias("dim"), F.first("raw").alias("raw"), F.count(F.lit(1)).alias("n"), F.min("vec_id").alias("least")))
    largest = reps.groupBy("label").agg(F.count(F.lit(1)).alias("m")).agg(F.max("m")).first()[0] or 0
    planes, tables = layout(largest, threshold, recall)
    most = most_parted(planes * tables, threshold)
    keys = ["label", "dim", "t", "sig"]
    dealt = cut_hot(hashed(reps, planes, tables), keys, "key", BUCKET_ROWS)
    keys += ["ca", "cb"]

    def sift(batches):
        for part, starts in grouped(batches, keys, 1 << 13):
            wanted = np.zeros(part.num_rows, bool)
            for a, b in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
                if b - a > 1:
                    for x, y in _pairs(part, a, b, planes, most):
                        wanted[a + x] = wanted[a + y] = True
            if wanted.any():
                yield from part.filter(pa.array(wanted)).combine_chunks().to_batches()

    rows_ = dealt.select(*keys, "c", "s", "key").repartition(*keys).sortWithinPartitions(*keys)
    wanted = settle(map_arrow(rows_, sift, rows_.schema))

    def run(batches):
        for part, starts in grouped(batches, keys, 1 << 13):
            count, a, b = _compare(part, starts, threshold, planes, most)
            key = part.column("key").combine_chunks()
            some = np.flatnonzero(count)
            yield pa.RecordBatch.from_arrays([key.take(pa.array(some)), pa.array(count[some]), pa.nulls(len(some), pa.binary())], ["a", "n", "b"])
            yield pa.RecordBatch.from_arrays([key.take(pa.array(a)), pa.nulls(len(a), pa.int64()), key.take(pa.array(b))], ["a", "n", "b"])

    full = wanted.join(reps.select("key", "raw", "n"), "key").select(*keys, "c", "s", "key", "raw", "n")
    found = settle(map_arrow(full.repartition(*keys).sortWithinPartitions(*keys), run, "a binary, n long, b binary"))
    links = found.where(F.col("n").isNotNull()).groupBy(F.col("a").alias("key")).agg(F.sum("n").alias("near"))
    comp = connected_components(found.where(F.col("b").isNotNull()), "a", "b").withColumnRenamed("node", "key")
    joined = reps.select("key", "n", "least").join(links, "key", "left").join(comp, "key", "left")
    classed = settle(joined.select("key", "least", (F.col("n") - 1 + F.coalesce("near", F.lit(0))).alias("n_links"), F.coalesce("component", "key").alias("class")))
    names = classed.groupBy("class").agg(F.min("least").alias("component_id"))
    done = settle(classed.join(settle(names), "class").select("key", "n_links", "component_id"))
    linked = rows.select("vec_id", "key").join(done, "key").select("vec_id", "n_links", "component_id")
    # Rows that prepare() left out, by the same conditions: alone.
    alone = vectors.select("vec_id", "label", F.col("embedding").cast("array<double>").alias("v"))
    good = F.col("label").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0)
    finite = ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists("v", lambda x: x != 0)
    alone = alone.where(~F.coalesce(good & finite, F.lit(False))).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    out = linked.unionByName(alone)
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
