"""Language identification by cross-parsing entropy.

Each language is represented by the suffix automaton of labelled text in it.  A text is
parsed greedily against an automaton into the longest phrases that occur in that
language's reference; the fewer phrases a character needs, the closer the languages.
Phrases are normalised by what one costs, the logarithm of the reference's length, so
references of unequal length compare.  Only letters count: each run of anything else is
one space.

Every letter of the references has a number, whatever the script.  The transitions of all
automata lie in one array, each state's displaced so that no two collide.  A state is
named by its displacement, so a step looks up one place, which tells the state that owns
it and where that one goes.

All blocks of ``BLOCK`` characters of a batch of texts step through all automata at once.
Each begins as if a phrase did; then those whose predecessor ended inside a phrase are
parsed anew from the state in which it ended, until both parses are in one state, so
phrases run across blocks and the count is that of the whole text.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callscope.llm.common import code_points, held_out, map_arrow, settle, slices

#: Labelled rows per language that are learned from at most, those with the least hashes,
#: and letters or other characters of each, from a hashed place of the whole text.
REFERENCE_ROWS, REFERENCE_CHARS = 64, 320
#: Picked rows (a name and a number each) up to which they are broadcast; beyond, the join is left to the planner.
BROADCAST_ROWS = 100_000
BLOCK = 2048
#: Score below which a document's language counts as unknown where documents are rejected.
KEEP_SCORE = 0.1
UNKNOWN = "und"


@lru_cache(1)
def _letters() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def _letter_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Lower-case letters of the texts, each run of anything else as one space, and where each text starts (plus the end)."""
    points, starts = code_points([t.lower() for t in texts])
    letter = _letters()[points]
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    at = np.concatenate([[0], np.cumsum(keep)])[starts]
    return np.where(letter, points, np.uint32(32))[keep], at


def automaton(text: list[int]) -> list[dict[int, int]]:
    """Suffix automaton of a text: transitions of each state, the first is the root."""
    nxt: list[dict[int, int]] = [{}]
    link, length = [-1], [0]
    last = 0
    for c in text:
        cur = len(nxt)
        nxt.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in nxt[p]:
            nxt[p][c] = cur
            p = link[p]
        if p >= 0:
            q = nxt[p][c]
            if length[p] + 1 == length[q]:
                link[cur] = q
            else:
                twin = len(nxt)
                nxt.append(dict(nxt[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and nxt[p].get(c) == q:
                    nxt[p][c] = twin
                    p = link[p]
                link[q] = link[cur] = twin
        last = cur
    return nxt


def pack(states: list[dict[int, int]], width: int) -> tuple[np.ndarray, np.ndarray]:
    """names, table: state s goes with c (0 to ``width`` - 1) to the state named n if table[names[s] + c] is names[s] << 32 | n, else nowhere.

    Rows are placed where they fit, those with most transitions first; the search for a
    place goes on where the last row of that size found one.
    """
    taken, used, begin = bytearray(width), set(), {}
    names = np.zeros(len(states), np.int64)
    for s in sorted(range(len(states)), key=lambda s: -len(states[s])):
        row = sorted(states[s]) or [0]
        first, rest = row[0], [c - row[0] for c in row[1:]]
        at = max(begin.get(len(row), 0), first)
        while True:
            at = taken.find(0, at)
            if at < 0:
                at = len(taken)
            if at + row[-1] - first >= len(taken):
                taken.extend(bytes(len(taken) + width))
            if at - first not in used and not any(taken[at + c] for c in rest):
                break
            at += 1
        taken[at] = 1
        for c in rest:
            taken[at + c] = 1
        names[s] = at - first
        used.add(at - first)
        begin[len(row)] = at
    table = np.full(int(names.max(initial=0)) + width, -1, np.int64)
    for s, row in enumerate(states):
        for c, t in row.items():
            table[names[s] + c] = names[s] << 32 | names[t]
    return names, table


@dataclass
class Model:
    """langs: their names; letters: code points of the references, ascending; roots: states where phrases begin; table: see :func:`pack`; cost: of a phrase."""

    langs: list[str]
    letters: np.ndarray
    roots: np.ndarray
    table: np.ndarray
    cost: np.ndarray

    def _step(self, state: np.ndarray, c: np.ndarray, root: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """States after character ``c``; where a phrase ends with it, and how many: that before it as it can't go on, and the character itself if no phrase begins with it."""
        found = self.table.take(state + c)
        after = found & 0xFFFFFFFF
        miss = np.flatnonzero(found >> 32 != state)
        was, own = state[miss], root[miss]
        found = self.table.take(own + c[miss])
        known = found >> 32 == own
        after[miss] = np.where(known, found & 0xFFFFFFFF, own)
        return after, miss, (was != own).astype(np.int32) + ~known

    def phrases(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Phrases of each text in each language, its characters, and whether it has a letter."""
        points, starts = _letter_points(texts)
        n, width = np.diff(starts), len(self.langs)
        count = np.zeros((len(texts), width), np.int64)
        if not len(points) or not width:
            return count, n, n > 0
        known = np.minimum(np.searchsorted(self.letters, points), len(self.letters) - 1)
        chars = np.where(self.letters[known] == points, known + 1, 0).astype(np.int64)  # 0: in no reference
        blocks = -(-n // BLOCK)
        doc = np.repeat(np.arange(len(texts)), blocks)
        k = np.arange(len(doc)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
        at, size = starts[doc] + k * BLOCK, np.minimum(n[doc] - k * BLOCK, BLOCK)
        # All blocks from the root, longest first, so those that go on are a prefix.
        order = np.argsort(-size, kind="stable")
        live = np.searchsorted(-size[order], -np.arange(BLOCK), "left")  # blocks longer than each step
        root = np.tile(self.roots, len(doc))
        state, ended, places = root.copy(), np.zeros(len(root), np.int32), at[order]
        for step in range(int(size.max())):
            m = live[step]
            state[: m * width], miss, more = self._step(state[: m * width], np.repeat(chars[places[:m] + step], width), root)
            ended[miss] += more
        out, total = np.empty((len(doc), width), np.int64), np.empty((len(doc), width), np.int32)
        out[order], total[order] = state.reshape(-1, width), ended.reshape(-1, width)
        # (block, language) pairs whose predecessor ends elsewhere than they began.
        began = root.reshape(-1, width)
        inner = np.flatnonzero(k > 0)
        b, g = np.nonzero(out[inner - 1] != began[inner])
        b = inner[b]
        while len(b):
            entry = out[b - 1, g]
            new, old, own = entry.copy(), began[b, g], self.roots[g]
            began[b, g] = entry
            left, ran = np.arange(len(b)), []
            for step in range(BLOCK + 1):
                over = size[b[left]] == step
                ran.append(left[over])
                left = left[~over]
                if not len(left):
                    break
                c = chars[at[b[left]] + step]
                new[left], miss, more = self._step(new[left], c, own[left])
                np.add.at(total, (b[left[miss]], g[left[miss]]), more)
                old[left], miss, less = self._step(old[left], c, own[left])
                np.subtract.at(total, (b[left[miss]], g[left[miss]]), less)
                left = left[new[left] != old[left]]
            ran = np.concatenate(ran)  # these never met: the next block begins in another state
            out[b[ran], g[ran]] = new[ran]
            b, g = b[ran] + 1, g[ran]
            use = b < len(doc)
            b, g = b[use], g[use]
            use = (k[b] > 0) & (out[b - 1, g] != began[b, g])
            b, g = b[use], g[use]
        np.add.at(count, doc, total)
        last = np.cumsum(blocks)[n > 0] - 1
        count[n > 0] += out[last] != self.roots  # the phrase that the text's end cuts
        return count, n, n > 0

    def predict(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Language and score of each text: the margin over the second best, from 0 (none) to 1."""
        if not self.langs:
            return np.full(len(texts), UNKNOWN, object), np.zeros(len(texts))
        count, n, has = self.phrases(texts)
        bits = count * self.cost / np.maximum(n, 1)[:, None]
        best = np.argmin(bits, axis=1)
        least = bits[np.arange(len(texts)), best]
        if len(self.langs) > 1:
            second = np.partition(bits, 1, axis=1)[:, 1]
            score = np.clip(4 * (second - least) / np.maximum(second, 1e-9), 0, 1)
        else:
            score = np.ones(len(texts))
        langs = np.array(self.langs, object)[best]
        langs[~has] = UNKNOWN
        return langs, np.where(has, score, 0.0)


def build(references: dict[str, list[str]]) -> Model:
    """A model from texts per language."""
    used = {lang: _letter_points(["\n".join(references[lang])])[0] for lang in sorted(references)}
    used = {lang: points for lang, points in used.items() if len(points)}
    letters = np.unique(np.concatenate([np.zeros(0, np.uint32), *used.values()]))
    states: list[dict[int, int]] = []
    roots, cost = [], []
    for points in used.values():
        first = len(states)
        roots.append(first)
        own = automaton((np.searchsorted(letters, points) + 1).tolist())
        states += [{c: t + first for c, t in row.items()} for row in own]
        cost.append(np.log2(len(points) + 1))
    names, table = pack(states, len(letters) + 1)
    return Model(list(used), letters, names[np.array(roots, np.int64)], table, np.array(cost))


def train(docs: DataFrame, rows: int = REFERENCE_ROWS, chars: int = REFERENCE_CHARS) -> Model:
    """A model from ``docs`` (text, lang) that are not held out: per language, at most ``rows`` rows with the least hashes of their ids, ``chars`` characters of each."""
    known = docs.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    h = F.xxhash64("doc_id", F.lit("reference"))
    # The least hash in each of ``rows`` parts of a language: aggregated on narrow rows, no text.
    pick = known.where(F.length("text") > 0).groupBy("lang", F.pmod(h, F.lit(rows)).alias("part")).agg(F.min(h).alias("h")).select("lang", "h")
    pick = settle(pick)
    place = F.pmod(F.xxhash64("text"), F.greatest(F.length("text") - chars + 1, F.lit(1))) + 1
    text = known.select("lang", h.alias("h"), F.substring("text", place.cast("int"), F.lit(chars)).alias("text"))
    text = text.join(F.broadcast(pick) if pick.count() <= BROADCAST_ROWS else pick, ["lang", "h"])
    found: dict[str, list] = {}
    for r in text.distinct().toLocalIterator():
        found.setdefault(r["lang"], []).append((r["h"], r["text"]))
    return build({k: [t for _, t in sorted(v)] for k, v in found.items()})


def _run(model, threshold: float | None):
    def run(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                lang, score = model.value.predict([t or "" for t in part.column("text").to_pylist()])
                if threshold is not None:
                    yield part.filter(pa.array((lang != UNKNOWN) & (score >= threshold)))
                else:
                    kept = [c for c in part.schema.names if c != "text"]
                    yield pa.RecordBatch.from_arrays([*(part.column(c) for c in kept), pa.array(lang, pa.string()), pa.array(score)], [*kept, "lang_pred", "score"])

    return run


def identify(docs: DataFrame, rows: int = REFERENCE_ROWS, chars: int = REFERENCE_CHARS) -> DataFrame:
    """doc_id, held_out, lang_pred, score of each row of ``docs``; only the text is looked at.

    Null texts and texts without a letter are ``und`` with score 0, as are all texts if no
    row can be learned from; ties go to the first language by name; repeated rows and null
    ids get a row each; other columns are ignored.
    """
    model = docs.sparkSession.sparkContext.broadcast(train(docs, rows, chars))
    texts = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text")
    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_arrow(texts, _run(model, None), f"doc_id {kind}, held_out boolean, lang_pred string, score double")


def drop_unknown(docs: DataFrame, threshold: float = KEEP_SCORE, rows: int = REFERENCE_ROWS, chars: int = REFERENCE_CHARS) -> DataFrame:
    """The rows of ``docs`` in a language that is recognised with ``threshold`` at least, with all their columns.

    Null texts, texts without a letter, and all texts if no row can be learned from go;
    repeated rows stay or go together; columns besides doc_id, text and lang are only carried.
    """
    model = docs.sparkSession.sparkContext.broadcast(train(docs, rows, chars))
    return map_arrow(docs, _run(model, threshold), docs.schema)
