"""Near-duplicate documents by SimHash fingerprints, compared bit-sliced."""

from __future__ import annotations

from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callscope.llm.common import cut_hot, grouped, map_arrow, packed, settle, slices, union_labels, unpacked
from callscope.llm.components import connected_components

SHINGLE, RADIUS, SEED = 4, 4, 42
#: Rows of a candidate bucket above which it is dealt into pairs of blocks.
BUCKET_ROWS = 2048
#: Different fingerprints of a bucket aimed at, were they spread evenly.
AIM = 512


def shingle_hashes(text: bytes, n: int = SHINGLE) -> list[int]:
    words = text.lower().split()  # bytes: A-Z and ASCII white space only
    if len(words) <= n:
        return [xxhash.xxh64_intdigest(b" ".join(words), SEED)] if words else []
    line = b" ".join(words)
    at = [0, *accumulate(len(w) + 1 for w in words)]
    h = xxhash.xxh64_intdigest
    return [h(line[s : e - 1], SEED) for s, e in zip(at, at[n:], strict=False)]


def fingerprint_batch(texts: list[bytes | None]) -> np.ndarray:
    """Fingerprints as uint64; null and wordless texts have zero."""
    out = np.zeros(len(texts), np.uint64)
    for i, text in enumerate(texts):
        h = shingle_hashes(text) if text else []
        if h:
            bits = np.unpackbits(np.array(h, "<u8").view(np.uint8), bitorder="little").reshape(-1, 64)
            ones = bits.sum(axis=0, dtype=np.int32)
            out[i] = np.packbits(2 * ones > len(h), bitorder="little").view("<u8")[0]
    return out


def fingerprints(rows: DataFrame) -> DataFrame:
    """``rows`` with fp, the fingerprint as a signed long, in place of their column text."""
    rest = [c for c in rows.columns if c != "text"]

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text", 16 << 20):
                fp = fingerprint_batch(part.column("text").cast(pa.binary()).to_pylist())
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in rest), pa.array(fp.view(np.int64))], [*rest, "fp"])

    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != "text"]
    return map_arrow(rows, run, ", ".join([*kinds, "fp long"]))


class BitPlanes:
    """Fingerprints of one word or more a row, stored vertically: plane p holds bit p of 64 rows in each word."""

    def __init__(self, fps: np.ndarray):
        n = len(fps)
        self.fps = fps.reshape(n, -1) if n else fps.reshape(0, 1)
        bits = np.unpackbits(self.fps.astype("<u8").view(np.uint8), bitorder="little").reshape(n, 64 * self.fps.shape[1])
        flat = np.zeros((bits.shape[1], -(-n // 64) * 64), np.uint8)
        flat[:, :n] = bits.T
        self.planes = np.packbits(flat, axis=1, bitorder="little").view("<u8")

    def near(self, rows: np.ndarray, words: np.ndarray, mask: np.ndarray, radius: int) -> tuple[np.ndarray, ...]:
        """Lanes within ``radius`` of each (row, word of 64 lanes): (rows, words, mask of hits).

        Distances of 64 lanes are counted at once by carry-save adders over pairs of
        planes; words whose lanes have all exceeded the radius are abandoned.
        """
        width = radius.bit_length() + 1
        zeros = lambda: [np.zeros(len(rows), np.uint64) for _ in range(width + 1)]
        count, full = zeros(), np.uint64(0xFFFFFFFFFFFFFFFF)
        query = self.fps[rows]
        for p in range(0, len(self.planes), 2):
            own, q = query[:, p // 64], p % 64
            d1 = self.planes[p][words] ^ ((own >> np.uint64(q) & np.uint64(1)) * full)
            d2 = self.planes[p + 1][words] ^ ((own >> np.uint64(q + 1) & np.uint64(1)) * full)
            half = count[0] ^ d1
            carry = (count[0] & d1) | (half & d2)
            count[0] = half ^ d2
            for b in range(1, width):
                count[b], carry = count[b] ^ carry, count[b] & carry
            count[width] |= carry  # sticky: far beyond the radius
            if p % 8 == 6:
                over, same = count[width].copy(), np.full(len(rows), full)
                for b in reversed(range(width)):
                    if radius >> b & 1:
                        same &= count[b]
                    else:
                        over |= same & count[b]
                        same &= ~count[b]
                mask = mask & ~over
                live = mask != 0
                if not live.all():
                    rows, words, mask, query = rows[live], words[live], mask[live], query[live]
                    count = [c[live] for c in count]
                if not len(rows):
                    break
        return rows, words, mask


def link_groups(fps: np.ndarray, starts: np.ndarray, radius: int = RADIUS, most: int = 1 << 16) -> tuple[np.ndarray, np.ndarray]:
    """Links (row, smaller row) that span the near pairs within each group of rows starts[k]:starts[k+1]."""
    n, first = len(fps), np.repeat(starts[:-1], np.diff(starts))
    labels = np.arange(n)
    if n < 2:
        return labels[:0], labels[:0]
    planes = BitPlanes(fps)
    rows = np.flatnonzero(labels > first)  # each row meets the earlier rows of its group
    wide = rows // 64 - first[rows] // 64 + 1
    ends = np.cumsum(wide)
    at = 0
    while at < len(rows):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, "right")))
        r = np.repeat(rows[at:to], wide[at:to])
        k = np.arange(len(r)) - np.repeat(np.cumsum(wide[at:to]) - wide[at:to], wide[at:to])
        w = first[r] // 64 + k
        low, high = np.maximum(first[r] - w * 64, 0), np.minimum(r - w * 64, 64)
        ones = np.uint64(0xFFFFFFFFFFFFFFFF)
        below = np.where(high >= 64, ones, (np.uint64(1) << (high % 64).astype(np.uint64)) - np.uint64(1))
        mask = below & ~((np.uint64(1) << low.astype(np.uint64)) - np.uint64(1))
        live = mask != 0
        r, w, hits = planes.near(r[live], w[live], mask[live], radius)
        if len(r):
            task, lane = np.nonzero(np.unpackbits(hits.astype("<u8").view(np.uint8), bitorder="little").reshape(-1, 64))
            labels = union_labels(labels, r[task], w[task] * 64 + lane)
        at = to
    linked = np.flatnonzero(labels != np.arange(n))
    return linked, labels[linked]


def fields(n: int, radius: int = RADIUS) -> int:
    """Bit fields that fingerprints are cut into.

    Two that differ in at most ``radius`` bits agree on all but ``radius`` of the fields, so
    one candidate table per choice of those misses none.  More fields make more tables
    with longer keys, so the work per fingerprint grows slowly with ``n``, the number of
    fingerprints, where the buckets of few tables would grow with it.
    """
    blocks = radius + 2
    while blocks < 64 and n >> (64 * (blocks - radius) // blocks) > AIM:
        blocks += 1
    return blocks


def link_fingerprints(distinct: DataFrame, radius: int = RADIUS, blocks: int | None = None, cap: int = BUCKET_ROWS) -> DataFrame:
    """Links (a, b) between distinct fingerprints (column fp) that join all pairs within ``radius`` bits.

    Exact: candidate tables by pigeonhole, all buckets compared in full, whatever ``blocks``
    (by default :func:`fields` of their number).
    """
    blocks = blocks or fields(distinct.count(), radius)
    if blocks <= radius:
        raise ValueError("blocks must exceed radius")
    edge = [64 * k // blocks for k in range(blocks + 1)]
    field = lambda k: F.shiftrightunsigned(F.shiftleft("fp", 64 - edge[k + 1]), 64 - edge[k + 1] + edge[k])
    tables = []
    for t, some in enumerate(combinations(range(blocks), blocks - radius)):
        key = F.lit(0).cast("long")
        for k in some:
            key = F.shiftleft(key, edge[k + 1] - edge[k]).bitwiseOR(field(k))
        tables.append(F.struct(F.lit(t).alias("t"), key.alias("key")))
    rows = distinct.select("fp", F.inline(F.array(*tables)))
    rows = cut_hot(rows, ["t", "key"], "fp", cap)
    keys = ["t", "key", "ca", "cb"]

    def run(batches):
        for part, starts in grouped(batches, keys):
            fps = part.column("fp").to_numpy()
            a, b = link_groups(fps.view(np.uint64), starts, radius)
            yield pa.RecordBatch.from_arrays([pa.array(fps[a]), pa.array(fps[b])], ["a", "b"])

    rows = rows.select("fp", *keys).repartition(*keys).sortWithinPartitions(*keys)
    return map_arrow(rows, run, "a long, b long")


def simhash_components(fps: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(fp, class, component_id) for each distinct fp of ``fps`` (doc_id, fp).

    class is the smallest reachable fingerprint, component_id the smallest doc_id of
    the class (null if all its ids are null).
    """
    own = settle(fps.groupBy("fp").agg(F.min("doc_id").alias("own")))
    comp = connected_components(link_fingerprints(own.select("fp"), radius))
    classed = own.join(comp, own["fp"] == comp["node"], "left").select("fp", "own", F.coalesce("component", "fp").alias("class"))
    classed = settle(classed)
    least = classed.groupBy("class").agg(F.min("own").alias("component_id"))
    return classed.join(settle(least), "class").select("fp", "class", "component_id")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id: one row per input row.

    Null, empty and wordless texts have fingerprint zero and link like any other;
    repeated rows each get a row; a null id gets its component like others, and is
    never the component's name unless all ids are null.  Other columns are ignored.
    """
    fps = settle(fingerprints(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))))
    out = fps.join(simhash_components(fps, radius), "fp")
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS) -> DataFrame:
    """``docs`` with one row of each group of near-duplicates, that with the smallest id; columns as in ``docs``.

    Null, empty and wordless texts have fingerprint zero and are near each other; of rows
    with equal id and text one stays; a row without id stays only where its whole group has none.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("h"), F.col(text_col).alias("text"))
    fps = settle(fingerprints(rows))
    classes = simhash_components(fps, radius).select("fp", "class")
    rank = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("i"), F.col("h"))
    first = fps.join(classes, "fp").groupBy("class").agg(F.min(rank).alias("k"))
    keep = settle(first.select(F.col("k.i").alias("_i"), F.col("k.h").alias("_h")))
    keyed = packed(docs, id=F.col(id_col), h=F.xxhash64(text_col))
    kept = keyed.join(keep, keyed["id"].eqNullSafe(keep["_i"]) & (keyed["h"] == keep["_h"]), "left_semi")
    return unpacked(kept.dropDuplicates(["id", "h"]), docs)
