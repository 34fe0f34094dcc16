"""Near-duplicate documents by SimHash fingerprints of word shingles, compared bit-sliced.

Two texts are near-duplicates if the Jaccard similarity of their sets of five-word
shingles is at least 0.8.  Fingerprints of such texts may differ in a fifth of their
bits, too many for tables by pigeonhole: wide fingerprints meet in tables of drawn
bits and are compared with a wide radius, and the sets themselves decide.
"""

from __future__ import annotations

from math import lgamma

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callscope.llm.common import cut_hot, grouped, map_arrow, packed, settle, slices, union_labels, unpacked
from callscope.llm.components import connected_components
from callscope.llm.simhash import link_groups, shingle_hashes

SHINGLE = 5
#: Least similarity, as a fraction of whole numbers.
LEAST = (4, 5)
#: 64-bit words of a fingerprint, and how many of them are compared (tables draw from all).
WORDS, COMPARED = 16, 4
#: Probability that a bit differs at the least similarity, by exact count the largest where both sets have SMALL shingles or more, and anywhere (4 and 5 shingles).
SMALL, PARTED, PARTED_SMALL = 16, 0.1582, 0.1875
#: Probability allowed, each, of sharing no table and of exceeding the radius.
MISSED = 2.5e-8
#: Least bits of a table's key, and rows of a bucket beyond which keys get longer.
KEY_BITS, AIM = 12, 1024
#: Rows of a class of fingerprints above which it is dealt into pairs of blocks: each carries its whole set; buckets of tables hold eight times as many.
BUCKET_ROWS = 512
#: Candidates (three numbers each) up to which they are broadcast; beyond, the join is left to the planner.
BROADCAST_ROWS = 100_000
_rng = np.random.default_rng(42)
_XOR, _MUL, _FOLD = (_rng.integers(0, 1 << 63, WORDS, np.uint64) << np.uint64(1) | np.uint64(1) for _ in range(3))


def shingle_set(text: bytes | None) -> np.ndarray:
    """Different shingle hashes of a text, ascending; a shorter text is one shingle, a wordless one has none."""
    return np.unique(np.array(shingle_hashes(text, SHINGLE) if text else [], np.uint64))


def fingerprint(own: np.ndarray) -> np.ndarray:
    """SimHash of a set of hashes, ``WORDS`` unsigned 64-bit: a bit is 1 if set in over half of the mixed hashes."""
    ones = np.zeros(64 * WORDS, np.int64)
    for at in range(0, len(own), 255):
        h = (own[at : at + 255, None] ^ _XOR) * _MUL
        h = (h ^ h >> np.uint64(29)) * _FOLD
        h ^= h >> np.uint64(32)
        ones += np.unpackbits(h.astype("<u8", copy=False).view(np.uint8), axis=1, bitorder="little").sum(axis=0, dtype=np.uint8)
    return np.packbits(2 * ones > len(own), bitorder="little").view("<u8")


def _differing(p: float, bits: int) -> np.ndarray:
    """Probability of each number of differing bits."""
    d = np.arange(bits + 1)
    choose = np.array([lgamma(bits + 1) - lgamma(k + 1) - lgamma(bits - k + 1) for k in d])
    return np.exp(choose + d * np.log(p) + (bits - d) * np.log1p(-p))


def tables(key_bits: int, p: float) -> int:
    """Tables of drawn bits after which two fingerprints that differ by ``p`` share none with probability ``MISSED``."""
    bits = 64 * WORDS
    part, d, j = _differing(p, bits), np.arange(bits + 1)[:, None], np.arange(key_bits)
    apart = 1 - np.prod(np.maximum(bits - d - j, 0) / (bits - j), axis=1)
    n = 1
    while part @ apart**n > MISSED:
        n += 1
    return n


def radius() -> int:
    """Bits of the compared words that near sets differ in at most, but for a probability of ``MISSED``."""
    return int(np.flatnonzero(np.cumsum(_differing(PARTED_SMALL, 64 * COMPARED)[::-1])[::-1] > MISSED)[-1])


def link_sets(sets: list[np.ndarray]) -> tuple[list[int], list[int]]:
    """Links (row, row) that span the near pairs of sets; a set meets only those that are not linked yet."""
    up, down = LEAST
    if len(sets) == 2:
        both = len(np.intersect1d(*sets, assume_unique=True))
        return ([1], [0]) if (up + down) * both >= up * (len(sets[0]) + len(sets[1])) else ([], [])
    size = np.array([len(s) for s in sets])
    value, ids = np.unique(np.concatenate(sets), return_inverse=True)
    starts = np.concatenate([[0], np.cumsum(size)])
    mark = np.zeros(len(value), bool)
    a, b, rest, todo = [], [], np.arange(len(sets)), []
    while len(rest):
        if not todo:
            todo, rest = [int(rest[0])], rest[1:]
        i = todo.pop()
        able = (down * size[rest] >= up * size[i]) & (down * size[i] >= up * size[rest])
        near = rest[able]
        if not len(near):
            continue
        own = ids[starts[i] : starts[i + 1]]
        mark[own] = True
        n = size[near]
        ends = np.cumsum(n)
        flat = np.repeat(starts[near] - ends + n, n) + np.arange(ends[-1])
        both = np.add.reduceat(mark[ids[flat]], ends - n, dtype=np.int64)
        mark[own] = False
        found = near[(up + down) * both >= up * (size[i] + n)]
        a += found.tolist()
        b += [i] * len(found)
        todo += found.tolist()
        rest = rest[~np.isin(rest, found)]
    return a, b


def spanning(found) -> pa.RecordBatch:
    """Links (a, b) from each node to the least of its class, of the links (a, b) in arrays that ``found`` yields."""
    a = b = np.zeros(0, np.int64)
    held, size = [], 0

    def joined():
        x, y = (np.concatenate(c) for c in zip((a, b), *held, strict=True))
        nodes, at = np.unique(np.concatenate([x, y]), return_inverse=True)
        labels = union_labels(np.arange(len(nodes)), at[: len(x)], at[len(x) :])
        far = np.flatnonzero(labels != np.arange(len(nodes)))
        return nodes[far], nodes[labels[far]]

    for links in found:
        held.append(links)
        size += len(links[0])
        if size > 1 << 20:
            (a, b), held, size = joined(), [], 0
    a, b = joined()
    return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])


def _sketches(rows: DataFrame) -> DataFrame:
    """doc_id, h, sig (names the set of shingles; zero for none), n (its size) and fp (its fingerprint, none for none)."""

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                sets = [shingle_set(t) for t in part.column("text").cast(pa.binary()).to_pylist()]
                sig = np.array([xxhash.xxh3_64_intdigest(s.tobytes()) if len(s) else 0 for s in sets], np.uint64)
                fp = pa.array([fingerprint(s).tobytes() if len(s) else None for s in sets], pa.binary())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("h"), pa.array(sig.view(np.int64)), pa.array([len(s) for s in sets], pa.int64()), fp], ["doc_id", "h", "sig", "n", "fp"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return map_arrow(rows, run, f"doc_id {kind}, h long, sig long, n long, fp binary")


def _entries(own: DataFrame, key_bits: int, whole: bool) -> DataFrame:
    """key (table and bucket) of each row (sig, n, fp) in each table it takes part in; if ``whole``, with sig and the compared words f0, f1, ..."""
    usual, most = tables(key_bits, PARTED), tables(key_bits, PARTED_SMALL)
    rng = np.random.default_rng(43)
    drawn = np.array([rng.choice(64 * WORDS, key_bits, replace=False) for _ in range(most)])
    words = [f"f{k}" for k in range(COMPARED)]

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                fp = np.frombuffer(b"".join(part.column("fp").to_pylist()), "<u8").reshape(-1, WORDS)
                bits = np.unpackbits(fp.view(np.uint8), axis=1, bitorder="little")
                key = np.zeros((len(fp), most), np.int64)
                for k in range(key_bits):
                    key = key << 1 | bits[:, drawn[:, k]]
                # A set near one of less than SMALL shingles has less than 5/4 of that.
                small = 4 * part.column("n").to_numpy() < 5 * SMALL
                live = np.arange(most) < np.where(small, most, usual)[:, None]
                out = [pa.array((key | np.arange(most) << 40)[live])]
                if whole:
                    row = np.nonzero(live)[0]
                    out += [pa.array(part.column("sig").to_numpy()[row]), *(pa.array(fp[row, k].view(np.int64)) for k in range(COMPARED))]
                yield pa.RecordBatch.from_arrays(out, ["key", "sig", *words] if whole else ["key"])

    return map_arrow(own.select("sig", "n", "fp"), run, "key long" + "".join(f", {c} long" for c in ["sig", *words] if whole))


def link_fingerprints(own: DataFrame, cap: int = 8 * BUCKET_ROWS) -> DataFrame:
    """Links (a, b) between the sigs of ``own`` (sig, n, fp) that span all pairs which share a bucket and are within the radius.

    Keys grow with the number of rows, and tables with the keys, so that buckets do not
    grow with it and no more pairs are missed.
    """
    key_bits, count, within = KEY_BITS, own.count(), radius()
    while count >> key_bits > AIM:
        key_bits += 1
    keys, words = ["key", "ca", "cb"], [f"f{k}" for k in range(COMPARED)]

    def found(batches):
        for part, starts in grouped(batches, keys):
            sig = part.column("sig").to_numpy()
            a, b = link_groups(np.stack([part.column(c).to_numpy().view(np.uint64) for c in words], axis=1), starts, within)
            yield sig[a], sig[b]

    def run(batches):
        yield spanning(found(batches))

    dealt = cut_hot(_entries(own, key_bits, True), ["key"], "sig", cap, _entries(own, key_bits, False)).select("sig", *words, *keys)
    return map_arrow(dealt.repartition(*keys).sortWithinPartitions(*keys), run, "a long, b long")


def _sets(rows: DataFrame) -> DataFrame:
    """sig and set (hashes, unsigned 64-bit) of each row (sig, text)."""

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                sets = [shingle_set(t).tobytes() for t in part.column("text").cast(pa.binary()).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("sig"), pa.array(sets, pa.binary())], ["sig", "set"])

    return map_arrow(rows, run, "sig long, set binary")


def link_candidates(rows: DataFrame, sets: DataFrame, cap: int = BUCKET_ROWS) -> DataFrame:
    """Links (a, b) between sigs that join all near pairs which share a ``key`` of ``rows`` (sig, key)."""
    keys = ["key", "ca", "cb"]

    def found(batches):
        for part, starts in grouped(batches, keys, 1024):
            sig = part.column("sig").to_numpy()
            own = [np.frombuffer(s, np.uint64) for s in part.column("set").to_pylist()]
            a, b = [], []
            for s, e in zip(starts.tolist(), starts[1:].tolist(), strict=False):
                if e - s > 1:
                    i, j = link_sets(own[s:e])
                    a += [s + x for x in i]
                    b += [s + x for x in j]
            yield sig[np.array(a, int)], sig[np.array(b, int)]

    def run(batches):
        yield spanning(found(batches))

    dealt = cut_hot(rows, ["key"], "sig", cap).select("sig", *keys).join(sets, "sig")
    return map_arrow(dealt.repartition(*keys).sortWithinPartitions(*keys), run, "a long, b long")


def _place(id_, h) -> list:
    """Columns that name a row by its id, null or not, and the hash of its text."""
    return [F.coalesce(id_.cast("string"), F.lit("")).alias("_i"), id_.isNull().alias("_none"), h.alias("_h")]


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", cap: int = BUCKET_ROWS) -> DataFrame:
    """``docs`` with one row of each group of near-duplicates, that with the smallest id; columns as in ``docs``.

    Groups are connected: a row belongs to one if it is near any of its rows.  Null, empty
    and wordless texts are one group; a row without id stays only where its whole group has none.
    """
    id_, text, h = F.col(id_col), F.col(text_col), F.xxhash64(text_col)
    rows = docs.select(id_.alias("doc_id"), h.alias("h"), text.alias("text"))
    rank = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("i"), F.col("h"))
    made = settle(_sketches(rows))
    own = settle(made.groupBy("sig").agg(F.min(rank).alias("k"), F.first("n").alias("n"), F.first("fp").alias("fp")))
    # Near sets are in one class of fingerprints; the sets of a class meet once.
    alike = settle(connected_components(link_fingerprints(own.where("n > 0"), 8 * cap)).select(F.col("node").alias("sig"), F.col("component").alias("key")))
    some = settle(own.join(alike, "sig", "left_semi").select("sig", *_place(F.col("k.i"), F.col("k.h"))))
    place = ["_i", "_none", "_h"]
    placed = docs.select(*_place(id_, h), text.alias("text"))
    found = placed.join(F.broadcast(some) if some.count() <= BROADCAST_ROWS else some, place).select("sig", "text")
    sets = settle(_sets(found).dropDuplicates(["sig"]))
    comp = connected_components(link_candidates(alike, sets, cap))
    classed = own.join(comp, own["sig"] == comp["node"], "left").select("k", F.coalesce("component", "sig").alias("class"))
    keep = settle(classed.groupBy("class").agg(F.min("k").alias("k")).select(*_place(F.col("k.i"), F.col("k.h"))))
    keyed = packed(docs, **dict(zip(place, _place(id_, h), strict=True)))
    return unpacked(keyed.join(keep, place, "left_semi").dropDuplicates(place), docs)
