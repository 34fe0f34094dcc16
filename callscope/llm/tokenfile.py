"""Token ids as binary files, each document compressed by itself with a shared zstandard dictionary.

A folder holds the dictionary, ``ids-<hash>.dict``, and files of documents in ascending
order of id.  A file, all numbers little-endian:

    magic  TOKZIDS1 | width of an id: u8 | SHA-256 of the dictionary: 32 bytes
    frames: each document's ids, serialized and compressed
    index: doc_id i64[n] | has an id u8[n] | number of ids u64[n] | offset of the frame u64[n + 1]
    index offset u64 | n u64 | crc32 of the index u32 | magic

So a reader gets one document with two reads, and knows which dictionary it needs.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from callscope.llm import files
from callscope.llm.bpe import default_tokenizer, tokenizer
from callscope.llm.common import fresh_dir, map_arrow, settle, slices

MAGIC = b"TOKZIDS1"
HEAD, FOOT = struct.Struct("<8sB32s"), struct.Struct("<QQI8s")
END_ID = 2
#: Documents that the dictionary learns from, bytes of each, and its size.
SAMPLE_DOCS, SAMPLE_BYTES, DICT_BYTES = 400, 16_384, 65_536
LEVEL = 3
#: Bytes after which a task begins another file.
FILE_BYTES = 64 << 20


def _width(bpe) -> int:
    return 2 if bpe.size <= 1 << 16 else 4


def train_dictionary(samples: list[bytes]) -> bytes:
    """A dictionary from serialized id arrays; where they are too few to train one, they themselves."""
    try:
        return zstandard.train_dictionary(DICT_BYTES, samples).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b"".join(samples)[-DICT_BYTES:]


def _dictionary(data: bytes):
    return zstandard.ZstdCompressionDict(data) if data else None


class Writer:
    """Documents of one task into files; ``done`` collects (uri, documents, ids) of each."""

    def __init__(self, folder: str, dictionary: bytes, width: int, most: int = FILE_BYTES):
        self.out = files.Rolling(folder, ".ids", most)
        self.hash, self.width, self.done = hashlib.sha256(dictionary).digest(), width, []
        self.press = zstandard.ZstdCompressor(level=LEVEL, dict_data=_dictionary(dictionary))

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        if not self.out.open:
            self.out.start()
            self.out.write(HEAD.pack(MAGIC, self.width, self.hash))
            self.ids, self.counts, self.places = [], [], []
        self.places.append(self.out.write(self.press.compress(ids.astype(f"<u{self.width}").tobytes())))
        self.ids.append(doc_id)
        self.counts.append(len(ids))
        if self.out.full:
            self.close()

    def close(self) -> None:
        if not self.out.open:
            return
        known = np.array([i is not None for i in self.ids], np.uint8)
        index = np.array([i or 0 for i in self.ids], "<i8").tobytes() + known.tobytes() + np.array(self.counts, "<u8").tobytes() + np.array([*self.places, self.out.at], "<u8").tobytes()
        at = self.out.write(index)
        self.out.write(FOOT.pack(at, len(self.ids), zlib.crc32(index), MAGIC))
        self.done.append((self.out.close()[0], len(self.ids), sum(self.counts)))


class Reader:
    """One file of ids; ``doc_ids``, ``counts`` and ``offsets`` come from its index."""

    def __init__(self, uri: str, dictionary: bytes):
        store, path = files.locate(uri)
        self.file = store.open_input_file(path)
        size = self.file.size()
        if size < HEAD.size + FOOT.size:
            raise ValueError(f"{uri} is no whole file of ids")
        magic, self.width, digest = HEAD.unpack(self.file.read_at(HEAD.size, 0))
        at, n, crc, tail = FOOT.unpack(self.file.read_at(FOOT.size, size - FOOT.size))
        if magic != MAGIC or tail != MAGIC or not HEAD.size <= at <= size - FOOT.size:
            raise ValueError(f"{uri} is no whole file of ids")
        index = self.file.read_at(size - FOOT.size - at, at)
        if zlib.crc32(index) != crc:
            raise ValueError(f"{uri} has a broken index")
        if digest != hashlib.sha256(dictionary).digest():
            raise ValueError(f"{uri} was written with another dictionary")
        known = np.frombuffer(index, np.uint8, n, 8 * n)
        self.doc_ids = [int(i) if k else None for i, k in zip(np.frombuffer(index, "<i8", n), known, strict=True)]
        self.counts = np.frombuffer(index, "<u8", n, 9 * n).astype(np.int64)
        self.offsets = np.frombuffer(index, "<u8", n + 1, 17 * n).astype(np.int64)
        self.unpress = zstandard.ZstdDecompressor(dict_data=_dictionary(dictionary))

    def document(self, k: int) -> np.ndarray:
        """Ids of the k-th document."""
        frame = self.file.read_at(int(self.offsets[k + 1] - self.offsets[k]), int(self.offsets[k]))
        return np.frombuffer(self.unpress.decompress(frame), f"<u{self.width}").astype("<u4")

    def documents(self, most: int = 8 << 20):
        """All documents in order, read in runs of about ``most`` bytes."""
        k = 0
        while k < len(self.counts):
            to = max(k + 1, int(np.searchsorted(self.offsets, self.offsets[k] + most, "right")) - 1)
            to = min(to, len(self.counts))
            data = memoryview(self.file.read_at(int(self.offsets[to] - self.offsets[k]), int(self.offsets[k])))
            for j in range(k, to):
                frame = data[self.offsets[j] - self.offsets[k] : self.offsets[j + 1] - self.offsets[k]]
                yield np.frombuffer(self.unpress.decompress(frame), f"<u{self.width}").astype("<u4")
            k = to


@lru_cache(2)
def _load(uri: str) -> bytes:
    return files.read_bytes(uri)


def _excerpt(ids: np.ndarray) -> bytes:
    """Up to ``SAMPLE_BYTES`` of serialized ids, from a hashed place of the whole array."""
    n, data = SAMPLE_BYTES // ids.itemsize, ids.tobytes()
    at = xxhash.xxh64_intdigest(data) % (len(ids) - n + 1) if len(ids) > n else 0
    return ids[at : at + n].tobytes()


def _samples(docs: DataFrame, path: str) -> list[bytes]:
    """Serialized ids of the documents with the least hashes of their ids."""
    picked = docs.select("doc_id").where(F.col("doc_id").isNotNull()).distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE_DOCS)
    rows = docs.join(F.broadcast(picked), "doc_id", "left_semi").select("text")

    def run(batches):
        bpe = tokenizer(path)
        for batch in batches:
            for part in slices(batch, "text"):
                texts = [t or "" for t in part.column("text").to_pylist()]
                some = [_excerpt(np.frombuffer(i, "<u4").astype(f"<u{_width(bpe)}")) for i in bpe.encode_batch(texts)]
                yield pa.RecordBatch.from_arrays([pa.array(some, pa.binary())], ["ids"])

    found = map_arrow(rows, run, "ids binary").limit(2 * SAMPLE_DOCS).collect()
    return sorted(bytes(r["ids"]) for r in found if r["ids"])


def write_ids(docs: DataFrame, path: str | None = None, folder: str | None = None, file_bytes: int = FILE_BYTES) -> tuple[DataFrame, str]:
    """Write the ids of ``docs`` (doc_id integer, text) with an end id each, in ascending order of doc_id, nulls first.

    Returns the manifest (file, docs, ids, start) and the dictionary's URI.  Null texts
    are empty; rows with one id follow each other; an empty table has an empty manifest.
    """
    path = path or default_tokenizer()
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    folder = files.make_folder(folder or fresh_dir(docs.sparkSession, "ids"))
    dictionary = train_dictionary(_samples(rows, path))
    where = f"{folder.rstrip('/')}/ids-{hashlib.sha256(dictionary).hexdigest()[:16]}.dict"
    files.write_bytes(where, dictionary)

    def run(batches):
        bpe = tokenizer(path)
        end = np.array([END_ID], "<u4")
        writer = Writer(folder, _load(where), _width(bpe), file_bytes)
        for batch in batches:
            for part in slices(batch, "text"):
                coded = bpe.encode_batch([t or "" for t in part.column("text").to_pylist()])
                for doc_id, ids in zip(part.column("doc_id").to_pylist(), coded, strict=True):
                    writer.add(doc_id, np.concatenate([np.frombuffer(ids, "<u4"), end]))
        writer.close()
        if writer.done:
            name, n, ids = (list(x) for x in zip(*writer.done, strict=True))
            task = TaskContext.get().partitionId()
            yield pa.RecordBatch.from_arrays([pa.array(name), pa.array(n, pa.int64()), pa.array(ids, pa.int64()), pa.array([task] * len(name), pa.int32()), pa.array(range(len(name)), pa.int32())], ["file", "docs", "ids", "task", "seq"])

    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text")]
    sorted_ = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    manifest = settle(map_arrow(sorted_, run, "file string, docs long, ids long, task int, seq int"))
    before = W.orderBy("task", "seq").rowsBetween(W.unboundedPreceding, -1)  # a row per file
    return manifest.select("file", "docs", "ids", F.coalesce(F.sum("ids").over(before), F.lit(0)).alias("start")), where


def read_ids(manifest: DataFrame, dictionary: str, with_ids: bool = True) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each document in the files, and its ids (little-endian unsigned 32-bit) if wanted."""

    def run(batches):
        for batch in batches:
            for uri, start in zip(batch.column("file").to_pylist(), batch.column("start").to_pylist(), strict=True):
                reader = Reader(uri, _load(dictionary))
                at, rows, size = start, [], 0
                for doc_id, ids in zip(reader.doc_ids, reader.documents(), strict=True):
                    data = ids.tobytes()
                    rows.append((doc_id, at, len(ids), zlib.crc32(data), data if with_ids else None))
                    at += len(ids)
                    size += len(data) * with_ids + 64
                    if size > 4 << 20:
                        yield _batch(rows, with_ids)
                        rows, size = [], 0
                if rows:
                    yield _batch(rows, with_ids)

    files_ = settle(manifest)
    kinds = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids binary" * with_ids
    return files_.repartition(max(1, files_.count())).mapInArrow(run, kinds)


def _batch(rows: list[tuple], with_ids: bool) -> pa.RecordBatch:
    doc_id, start, n, crc, ids = (list(x) for x in zip(*rows, strict=True))
    columns = {"doc_id": pa.array(doc_id, pa.int64()), "start": pa.array(start, pa.int64()), "n_tokens": pa.array(n, pa.int64()), "ids_crc32": pa.array(crc, pa.int64())}
    if with_ids:
        columns["ids"] = pa.array(ids, pa.binary())
    return pa.RecordBatch.from_pydict(columns)
