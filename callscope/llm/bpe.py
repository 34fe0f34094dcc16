"""Byte-level BPE encoding and decoding by tree concatenation.

A text of more than ``LEAF`` characters is halved, wherever the middle lies, until its parts
are short enough; all parts are encoded (in parallel) and joined pairwise, level by level.
At a join a window of text around it is encoded anew.  It begins and ends where a
white-space character follows any other: no alternative of the splitting pattern crosses
such a place or looks past it from the left, so tokens of either side end there, too.
The window grows until its first and its last token equal those of the two sides, and
replaces theirs.

Where a run without such a place is longer than ``LEAF`` bytes, no window of text is small.
Such a text is cut at those places, and its pattern matches that exceed ``LEAF`` bytes are
encoded by a tree over their bytes.  Windows are made of tokens there: a sequence of tokens
is the encoding of its bytes exactly if each neighbouring pair is, so agreement on one token
on either side makes the whole exact.
"""

from __future__ import annotations

import hashlib
import re
from concurrent.futures import ThreadPoolExecutor
from functools import lru_cache
from itertools import chain
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callscope.llm.common import map_arrow, slices

#: Longest text, in characters, and longest pattern match, in bytes, that is encoded in one go.
LEAF = 4096
#: Tokens on each side of a join of bytes in the first window, and characters at a join of texts.
WINDOW, SPAN = 8, 32
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: The characters that the pattern's white space stands for (fixed values: Unicode's White_Space).
_WHITE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_PIECE = re.compile(f"[{_WHITE}]*[^{_WHITE}]+|[{_WHITE}]+")
_PLACE = re.compile(f"[^{_WHITE}](?=[{_WHITE}])")


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _byte_chars() -> dict[str, int]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class ByteBpe:
    """Encoder and decoder for a byte-level BPE file of the tokenizers library."""

    def __init__(self, path: str, leaf: int = LEAF):
        import json

        import regex
        import tiktoken

        spec = json.loads(Path(path).read_text(encoding="utf-8"))
        chars = _byte_chars()
        added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        vocab = {bytes(chars[c] for c in k): v for k, v in spec["model"]["vocab"].items() if k not in added}
        self.bytes_of = {v: k for k, v in vocab.items()}
        self.bpe = tiktoken.Encoding(Path(path).stem, pat_str=PATTERN, mergeable_ranks=vocab, special_tokens=added)
        self.match = regex.compile(PATTERN.replace(r"[^\s", f"[^{_WHITE}").replace(r"\s", f"[{_WHITE}]").replace(r"\S", f"[^{_WHITE}]"))
        self.special = re.compile("(" + "|".join(map(re.escape, sorted(added, key=len, reverse=True))) + ")") if added else None
        self.added = {k: np.array([v], "<u4").tobytes() for k, v in added.items()}
        self.size = self.bpe.n_vocab
        self.leaf, self.pool = leaf, ThreadPoolExecutor(2)
        self.widths = np.zeros(max(self.bytes_of, default=0) + 1, np.int64)
        for k, v in self.bytes_of.items():
            self.widths[k] = len(v)
        #: Joins of texts and of bytes that this coder has made.
        self.joins = {"text": 0, "bytes": 0}

    def _leaves(self, data: bytes) -> list[bytes]:
        n = 1
        while len(data) / n > self.leaf:
            n *= 2
        return [data[len(data) * i // n : len(data) * (i + 1) // n] for i in range(n)]

    def _join(self, a: list[int], b: list[int]) -> list[int]:
        self.joins["bytes"] += 1
        piece, of = self.bpe._encode_single_piece, self.bytes_of
        k = WINDOW
        while True:
            left, right = a[-k:], b[:k]
            mid = piece(b"".join(of[t] for t in left) + b"".join(of[t] for t in right))
            if (len(left) == len(a) or mid[0] == left[0]) and (len(right) == len(b) or mid[-1] == right[-1]):
                return a[: len(a) - len(left)] + mid + b[len(right) :]
            k *= 2

    def tree(self, data: bytes) -> list[int]:
        """Ids of one pattern match of any length."""
        leaves = self._leaves(data)
        if len(leaves) == 1:
            return self.bpe._encode_single_piece(data)
        parts = list(self.pool.map(self.bpe._encode_single_piece, leaves))
        while len(parts) > 1:
            pairs = [(parts[i], parts[i + 1]) for i in range(0, len(parts), 2)]
            parts = list(self.pool.map(lambda p: self._join(*p), pairs))
        return parts[0]

    def _long(self, piece: str) -> list[int]:
        ids: list[int] = []
        for m in self.match.findall(piece):
            data = m.encode("utf-8")
            ids += self.tree(data) if len(data) > self.leaf else self.bpe._encode_single_piece(data)
        return ids

    def _long_runs(self, text: str) -> bool:
        """Whether a run of one kind may exceed ``LEAF`` bytes: it would fill one of these blocks."""
        step = max(self.leaf // 8, 1)
        for k in range(0, len(text) - step + 1, step):
            first = text[k : k + step].split(None, 1)
            if not first or len(first[0]) == step:
                return True
        return False

    def _kept(self, ids: np.ndarray, size: int, last: bool) -> int | None:
        """Tokens at the end (``last``) or the start of ``ids`` that make up ``size`` bytes; None if a token crosses that place."""
        few = min(size, len(ids))
        widths = np.cumsum(self.widths[ids[len(ids) - few :][::-1] if last else ids[:few]])
        k = int(np.searchsorted(widths, size))
        return k + 1 if k < few and widths[k] == size else 0 if not size else None

    def _join_texts(self, text: str, start: int, at: int, end: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Ids of text[start:end] from those of its parts before and after ``at``."""
        self.joins["text"] += 1
        k = SPAN
        while True:
            places = [m.end() for m in _PLACE.finditer(text, max(start, at - 2 * k), max(start, at - k) + 1)]
            p = start if at - k <= start else places[-1] if places else None
            found = _PLACE.search(text, at + k, min(end, at + 2 * k)) if at + k < end else None
            q = end if at + k >= end else found.end() if found else None
            if p is not None and q is not None:
                mid = np.array(self.bpe.encode_ordinary(text[p:q]), "<u4")
                left, right = self._kept(a, len(text[p:at].encode()), True), self._kept(b, len(text[at:q].encode()), False)
                if left is not None and right is not None and (p == start or mid[0] == a[len(a) - left]) and (q == end or mid[-1] == b[right - 1]):
                    return np.concatenate([a[: len(a) - left], mid, b[right:]])
            k *= 2

    def tree_text(self, text: str) -> np.ndarray:
        """Ids of a text without long runs, by halves."""
        n = 1
        while len(text) / n > self.leaf:
            n *= 2
        edges = [len(text) * i // n for i in range(n + 1)]
        leaves = [text[x:y] for x, y in zip(edges, edges[1:], strict=False)]
        parts = [np.array(x, "<u4") for x in self.pool.map(self.bpe.encode_ordinary, leaves)]
        while len(parts) > 1:
            parts = [self._join_texts(text, edges[i], edges[i + 1], edges[i + 2], parts[i], parts[i + 1]) for i in range(0, len(parts), 2)]
            edges = edges[::2]
        return parts[0]

    def _plain(self, text: str) -> bytes:
        if len(text) <= self.leaf:
            ids = self.bpe.encode_ordinary(text)
        elif self._long_runs(text):
            ids = list(chain.from_iterable(map(self._long, _PIECE.findall(text))))
        else:
            ids = self.tree_text(text)
        return np.asarray(ids, "<u4").tobytes()

    def encode(self, text: str) -> bytes:
        """Ids of a text as little-endian unsigned 32-bit integers."""
        if self.special and self.special.search(text):
            return b"".join(self.added.get(x) or self._plain(x) for x in self.special.split(text))
        return self._plain(text)

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        return [self.encode(t) for t in texts]

    def decode(self, ids: bytes) -> str:
        return self.bpe.decode_bytes(np.frombuffer(ids, "<u4").tolist()).decode("utf-8", "replace")


@lru_cache(2)
def tokenizer(path: str, leaf: int = LEAF) -> ByteBpe:
    return ByteBpe(path, leaf)


def encode_ids(rows: DataFrame, path: str | None = None) -> DataFrame:
    """``rows`` with ids (binary, little-endian unsigned 32-bit) in place of their columns text and, if there is one, ids; a null text has none."""
    path = path or default_tokenizer()
    rest = [c for c in rows.columns if c not in ("text", "ids")]
    rows = rows.select(*(f"`{c}`" for c in rest), "text")

    def run(batches):
        bpe = tokenizer(path)
        for batch in batches:
            for part in slices(batch, "text"):
                ids = bpe.encode_batch([t or "" for t in part.column("text").to_pylist()])
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in rest), pa.array(ids, pa.binary())], [*rest, "ids"])

    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != "text"]
    return map_arrow(rows, run, ", ".join([*kinds, "ids binary"]))


def decode_ids(rows: DataFrame, path: str | None = None) -> DataFrame:
    """``rows`` with text in place of their columns ids (binary) and, if there is one, text; null ids have a null text."""
    path = path or default_tokenizer()
    rest = [c for c in rows.columns if c not in ("text", "ids")]
    rows = rows.select(*(f"`{c}`" for c in rest), "ids")

    def run(batches):
        bpe = tokenizer(path)
        for batch in batches:
            for part in slices(batch, "ids"):
                text = [None if i is None else bpe.decode(i) for i in part.column("ids").to_pylist()]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in rest), pa.array(text, pa.string())], [*rest, "text"])

    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != "ids"]
    return map_arrow(rows, run, ", ".join([*kinds, "text string"]))


def round_trip(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of each row: encoded, and decoded from those ids.

    Null and empty texts have no tokens; a row is treated alone, so repeated rows and null
    ids come out as they went in.  Other columns are ignored.
    """
    path = path or default_tokenizer()

    def run(batches):
        bpe = tokenizer(path)
        for batch in batches:
            for part in slices(batch, "text"):
                n, a, b = [], [], []
                for ids in bpe.encode_batch([t or "" for t in part.column("text").to_pylist()]):
                    n.append(len(ids) // 4)
                    a.append(hashlib.sha256(ids).hexdigest())
                    b.append(hashlib.sha256(bpe.decode(ids).encode("utf-8")).hexdigest())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(n, pa.int64()), pa.array(a), pa.array(b)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return map_arrow(rows, run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
