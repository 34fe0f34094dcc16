"""Toxicity by subword-bag embeddings averaged into a linear softmax.

A bag holds the character n-grams of words (with word ends marked), each hashed to a row
of an embedding table.  The rows are averaged and a linear softmax gives the probability
of the toxic label; table and softmax are trained jointly in numpy.  A misspelling that was
never seen shares most n-grams, and so most of the average, with the words that were.

Two such models are trained.  In the first a bag is a whole labelled text, so every word
of a document counts in its average.  In the second a bag is one word, with the share of
its documents that are toxic as its label; it tells which single words are strong.  A
logistic map, fitted on rows that neither model saw, turns a text's average, its
strongest words and its length into a probability.

As averaging and softmax are linear in the table, scoring needs one number per n-gram:
the table times the difference of the two softmax columns.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callscope.llm.common import code_points, held_out, map_arrow, slices

#: Score from which a document counts as toxic.
THRESHOLD = 0.3
#: Labelled rows learned from at most, of each label: those with the smallest hashes of their ids.
TRAIN_ROWS = {1: 1000, 0: 2000}
NGRAMS = (3, 4, 5, 6)
#: Strongest words of a text that are looked at beside its average.
TOP = 4
#: N-grams without evidence that are added to a text's average: a short text says little.
PRIOR = 1000
#: Labelled texts that must hold an n-gram for the text model to learn it.
LEAST_TEXTS = 5
#: What the text model's averages are multiplied by: of thousands of n-grams few are telling.
SCALE = 20.0
#: Updates of a model at any size of the input, and items of each: words, and texts.
UPDATES, WORD_BATCH, TEXT_BATCH = 120, 8192, 256
BUCKETS, DIM, RATE, DECAY, FOLDS = 1 << 18, 8, 0.3, 1e-4, 3
_MIX = np.uint32(0x9E3779B1)


@lru_cache(1)
def _letters() -> np.ndarray:
    """Which code points are part of words: letters, digits and combining marks."""
    out = np.zeros(0x110000, bool)
    for c in range(0x110000):
        out[c] = chr(c).isalnum()
    out[0x300:0x370] = True
    return out


def _words(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of each word; ``points`` must begin and end outside of words."""
    step = np.diff(_letters()[points].view(np.int8))
    return np.flatnonzero(step == 1) + 1, np.flatnonzero(step == -1) + 1


def _ngrams(points: np.ndarray):
    """For each length: the bucket of the n-gram that starts at each place, and whether it is one.

    Its inner characters lie in one word; the first and the last may be the word's border.
    """
    inside = _letters()[points]
    c = np.where(inside, points, 0).astype(np.uint32)
    n = len(c)
    place = np.arange(n, dtype=np.int32)
    stop = np.minimum.accumulate(np.where(inside, np.int32(n), place)[::-1])[::-1]
    run = (stop - place)[1:]  # letters from the next place on
    h = np.zeros(n, np.uint32)
    for k in range(NGRAMS[-1]):
        h = (h[: n - k] ^ c[k:]) * _MIX
        h ^= h >> np.uint32(15)
        if k + 1 in NGRAMS:
            yield ((h + np.uint32(k)) * _MIX) >> np.uint32(32 - 18), run[: len(h)] >= k - 1


def _per_word(length: np.ndarray) -> np.ndarray:
    """How many n-grams a word of so many letters has."""
    return sum(np.maximum(length + 3 - n, 0) for n in NGRAMS)


def _sums(tables: tuple, points: np.ndarray, s: np.ndarray, e: np.ndarray) -> list[np.ndarray]:
    """For each table, the sum of the numbers of the n-grams of each word s[k]:e[k]."""
    total = [np.zeros(len(points), np.float32) for _ in tables]
    for bucket, good in _ngrams(points):
        for t, table in zip(total, tables, strict=True):
            t[: len(bucket)] += table[bucket] * good
    sums = [np.concatenate([[0.0], np.cumsum(t, dtype=np.float64)]) for t in total]
    return [x[e - 1] - x[s - 1] for x in sums]


def _strongest(odds: np.ndarray, first: np.ndarray, none: float) -> np.ndarray:
    """The ``TOP`` largest of odds[first[k]:first[k + 1]] for each k, largest first, and ``none`` for what lacks."""
    out = np.full((len(first) - 1, TOP), none)
    odds, doc = odds.copy(), np.repeat(np.arange(len(first) - 1), np.diff(first))
    full = np.flatnonzero(np.diff(first))
    for k in range(TOP):
        if not len(full):
            break
        best = np.maximum.reduceat(odds, first[:-1][full])
        out[full, k] = np.where(np.isfinite(best), best, none)
        place = np.full(len(first) - 1, np.inf)
        place[full] = best
        hit = np.flatnonzero(odds == place[doc])
        odds[hit[np.unique(doc[hit], return_index=True)[1]]] = -np.inf  # one word of each text
    return out


@dataclass
class Model:
    """texts, words: a number for each n-gram bucket by either model; bias: of the word model; coef: the map from evidence to log odds."""

    texts: np.ndarray
    words: np.ndarray
    bias: float
    coef: np.ndarray

    def evidence(self, texts: list[str]) -> np.ndarray:
        """Average of each text, log odds of its strongest words (``bias`` where it has none left), and the log of its word count plus 1."""
        points, starts = code_points(["", *(t.lower() for t in texts)])
        s, e = _words(points)
        first, grams = np.searchsorted(s, starts[1:]), _per_word(e - s)
        of_texts, of_words = _sums((self.texts, self.words), points, s, e)
        n, total = (np.diff(np.concatenate([[0.0], np.cumsum(x)])[first]) for x in (grams, of_texts))
        strong = _strongest(of_words / np.maximum(grams, 1), first, 0.0) + self.bias
        return np.column_stack([SCALE * total / (n + PRIOR), strong, np.log1p(np.diff(first))])

    def scores(self, texts: list[str]) -> np.ndarray:
        z = self.evidence(texts) @ self.coef[:-1] + self.coef[-1]
        return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


class _Softmax:
    """Embeddings of the buckets in use and a linear softmax over their averages, updated by Adagrad."""

    def __init__(self, size: int, rng: np.random.Generator):
        self.E, self.W, self.b = rng.normal(0, 0.1, (size, DIM)).astype(np.float32), rng.normal(0, 0.1, (DIM, 2)).astype(np.float32), np.zeros(2, np.float32)
        self.place = np.zeros(size, np.int32)
        self.gE, self.gW, self.gb = np.full_like(self.E, 1e-4), np.full_like(self.W, 1e-4), np.full_like(self.b, 1e-4)

    def update(self, bag: np.ndarray, ids: np.ndarray, share: np.ndarray, target: np.ndarray, weight: np.ndarray) -> None:
        """One step: bag[k] holds row ids[k] with a share of share[k] of its average; target: how toxic each bag should be."""
        self.place[ids] = 1
        near = np.flatnonzero(self.place)
        self.place[near] = np.arange(len(near), dtype=np.int32)
        back = self.place[ids]
        self.place[near] = 0
        rows, n, w = self.E[near], len(target), self.W[:, 1] - self.W[:, 0]
        # With two labels all that passes between bags and rows is one number each.
        odds = np.bincount(bag, share * (rows @ w)[back], n) + self.b[1] - self.b[0]
        d = (1 / (1 + np.exp(-np.clip(odds, -500, 500))) - target) * weight
        g = np.bincount(back, share * d[bag], len(near)).astype(np.float32)
        dE = np.outer(g, w) + DECAY * rows
        dW, db = np.outer(rows.T @ g, (-1, 1)).astype(np.float32), d.sum() * np.array((-1, 1), np.float32)
        self.gE[near] += dE * dE
        self.E[near] = rows - RATE * dE / np.sqrt(self.gE[near])
        self.gW += dW * dW
        self.W -= RATE * dW / np.sqrt(self.gW)
        self.gb += db * db
        self.b -= RATE * db / np.sqrt(self.gb)

    def table(self, used: np.ndarray) -> np.ndarray:
        out = np.zeros(BUCKETS, np.float32)
        out[used] = self.E @ (self.W[:, 1] - self.W[:, 0])
        return out


def _batches(n: int, size: int, rng: np.random.Generator):
    """``UPDATES`` batches of about ``size`` of ``n`` items, each pass over all of them in another order."""
    made = 0
    while made < UPDATES and n:
        for part in np.array_split(rng.permutation(n), -(-n // size)):
            if made < UPDATES:
                yield part
            made += 1


def _take(begin: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Places begin[k], ..., begin[k] + n[k] - 1 of all k, one after another."""
    return np.repeat(begin - np.cumsum(n) + n, n) + np.arange(n.sum())


def fit_texts(texts: list[str], toxic: np.ndarray, seed: int = 7) -> np.ndarray:
    """Train table and softmax jointly on the averages of labelled texts; the table's numbers."""
    rng = np.random.default_rng(seed)
    bags: list[tuple[np.ndarray, np.ndarray]] = []  # of each text: its buckets, and their shares
    seen = np.zeros(BUCKETS, np.int64)
    for at in range(0, len(texts), 16):  # few at once, and narrow numbers: this runs on the driver
        points, starts = code_points(["", *(t.lower() for t in texts[at : at + 16])])
        owner = np.repeat(np.arange(len(starts) - 1), np.diff(starts)) - 1  # -1: the line feed before the first text
        own = [owner[np.minimum(np.flatnonzero(good) + 1, len(owner) - 1)] * BUCKETS + bucket[good] for bucket, good in _ngrams(points)]
        key, n = np.unique(np.concatenate(own), return_counts=True)
        edges, bucket = np.searchsorted(key, np.arange(len(starts) - 1) * BUCKETS), (key % BUCKETS).astype(np.int32)
        seen += np.bincount(bucket, minlength=BUCKETS)
        bags += [(bucket[i:j].copy(), (SCALE * n[i:j] / max(n[i:j].sum(), 1)).astype(np.float32)) for i, j in zip(edges, edges[1:], strict=False)]
    used = np.flatnonzero(seen >= LEAST_TEXTS)
    place = np.full(BUCKETS, -1, np.int32)
    place[used] = np.arange(len(used), dtype=np.int32)
    for k, (bucket, share) in enumerate(bags):
        bags[k] = place[bucket[keep := place[bucket] >= 0]], share[keep]
    model = _Softmax(len(used), rng)
    both = len(toxic) / (2 * np.maximum(np.bincount(toxic, minlength=2), 1))  # both labels weigh alike
    for some in _batches(len(texts), TEXT_BATCH, rng):
        ids, share = (np.concatenate(x) for x in zip(*(bags[k] for k in some), strict=True))
        model.update(np.repeat(np.arange(len(some)), [len(bags[k][0]) for k in some]), ids, share, toxic[some], both[toxic[some]] / len(some))
    return model.table(used)


def fit_words(texts: list[str], toxic: np.ndarray, seed: int = 7) -> tuple[np.ndarray, float]:
    """Train table and softmax jointly on the averages of the words of labelled texts; the table's numbers and the bias."""
    count: dict[str, list[int]] = {}
    for text, label in zip(texts, toxic.tolist(), strict=True):
        points, _ = code_points(["", text.lower()])
        line = "\n" + text.lower() + "\n"
        s, e = _words(points)
        for w in {line[a:b] for a, b in zip(s.tolist(), e.tolist(), strict=True)}:
            count.setdefault(w, [0, 0])[label] += 1
    words = sorted(count)
    seen = np.array([count[w] for w in words], np.float32).reshape(-1, 2)
    # Both labels weigh alike; a word's weight grows slowly with its documents.
    docs = np.maximum(np.bincount(toxic, minlength=2), 1)
    seen = seen * (docs.sum() / (2 * docs)).astype(np.float32)
    target = (seen[:, 1] + 0.5 * 0.2) / (seen.sum(axis=1) + 0.2)
    weight = np.sqrt(seen.sum(axis=1))
    points, _ = code_points(["", *words])
    s, e = _words(points)
    where = np.full(len(points), -1, np.int32)
    where[_take(s - 1, e - s)] = np.repeat(np.arange(len(s)), e - s)
    ids, bags = [], []
    for bucket, good in _ngrams(points):
        w = where[: len(bucket)]
        use = good & (w >= 0)
        ids.append(bucket[use].astype(np.int32))
        bags.append(w[use])
    ids, bags = np.concatenate(ids), np.concatenate(bags)
    ids = ids[np.argsort(bags, kind="stable")]
    place = np.zeros(BUCKETS, np.int32)
    place[ids] = 1
    used = np.flatnonzero(place)
    place[used] = np.arange(len(used), dtype=np.int32)
    ids = place[ids]
    n = np.bincount(bags, minlength=len(words))
    del bags
    begin = np.cumsum(n) - n
    rng = np.random.default_rng(seed)
    model = _Softmax(len(used), rng)
    for some in _batches(len(words), WORD_BATCH, rng):
        m = n[some]
        model.update(np.repeat(np.arange(len(some)), m), ids[_take(begin[some], m)], np.repeat(1 / np.maximum(m, 1), m), target[some], weight[some] / weight[some].mean() / 16)
    return model.table(used), float(model.b[1] - model.b[0])


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Coefficients (the constant last) of a lightly regularised logistic regression, by Newton's method on standardised columns."""
    mean, spread = x.mean(axis=0), x.std(axis=0) + 1e-9
    x = np.column_stack([(x - mean) / spread, np.ones(len(x))])
    beta = np.zeros(x.shape[1])
    ridge = np.diag([1e-2] * (x.shape[1] - 1) + [1e-6])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -500, 500)))
        step = np.linalg.solve((x.T * (weight * p * (1 - p) + 1e-9)) @ x + ridge, x.T @ (weight * (y - p)) - ridge @ beta)
        beta += np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-6:
            break
    slope = beta[:-1] / spread
    return np.append(slope, beta[-1] - slope @ mean)


def fit(texts: list[str], toxic: np.ndarray, weight: np.ndarray) -> Model:
    """A model from labelled texts; ``weight``: how many labelled rows each stands for."""
    none = np.zeros(BUCKETS, np.float32)
    if len(set(toxic.tolist())) < 2:
        share = float(toxic.mean()) if len(toxic) else 0.0
        return Model(none, none, 0.0, np.array([0.0] * (TOP + 2) + [np.log((share + 1e-3) / (1 - share + 1e-3))]))
    fold = np.zeros(len(texts), int)
    for label in (0, 1):
        fold[toxic == label] = np.arange((toxic == label).sum()) % FOLDS
    seen = np.zeros((len(texts), TOP + 2))
    for k in range(FOLDS):
        rest, own = np.flatnonzero(fold != k), np.flatnonzero(fold == k)
        some = [texts[i] for i in rest]
        part = Model(fit_texts(some, toxic[rest]), *fit_words(some, toxic[rest]), np.zeros(0))
        for few in np.array_split(own, -(-len(own) // 16)):
            seen[few] = part.evidence([texts[i] for i in few])
    return Model(fit_texts(texts, toxic), *fit_words(texts, toxic), _logistic(seen, toxic, weight))


def train(docs: DataFrame, labels: DataFrame, rows: dict[int, int] | None = None) -> Model:
    """A model from the rows of ``docs`` (doc_id, text) that ``labels`` (doc_id, toxic 0/1) marks and that are not held out.

    At most ``rows`` of each label are read, those whose ids have the smallest hashes.
    """
    rows = rows or TRAIN_ROWS
    marks = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    marks = marks.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    total = {r["toxic"]: r["n"] for r in marks.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    picked = None
    for label, most in rows.items():
        some = marks.where(F.col("toxic") == label).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
        picked = some if picked is None else picked.unionByName(some)
    found = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id").where(F.col("text").isNotNull())
    found = sorted({(r["doc_id"], r["text"], r["toxic"]) for r in found.toLocalIterator()})
    toxic = np.array([r[2] for r in found], int)
    have = np.maximum(np.bincount(toxic, minlength=2), 1)
    weight = np.array([total.get(k, 0) / have[k] for k in (0, 1)])
    return fit([r[1] for r in found], toxic, weight[toxic] if len(toxic) else np.zeros(0))


def _run(spark, model: Model, rows: DataFrame, only_clean: bool, threshold: float):
    held = spark.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                score = held.value.scores([t or "" for t in part.column("text").to_pylist()])
                if only_clean:
                    yield part.filter(pa.array(score < threshold))
                else:
                    kept = [c for c in part.schema.names if c != "text"]
                    yield pa.RecordBatch.from_arrays([*(part.column(c) for c in kept), pa.array(score), pa.array((score >= threshold).astype(np.int32))], [*kept, "score", "predicted"])

    return run


def score_documents(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted of each row of ``docs``; only the text is scored.

    Null and empty texts score as a text without words; repeated rows and rows with a null
    id (not held out, never learned from) get a row each; other columns are ignored.
    """
    rows = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text")
    run = _run(docs.sparkSession, train(docs, labels), rows, False, threshold)
    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_arrow(rows, run, f"doc_id {kind}, held_out boolean, score double, predicted int")


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that score below ``threshold``, with all their columns.

    Null and empty texts score as a text without words and are judged like any other;
    repeated rows stay or go together; columns besides doc_id and text are only carried.
    """
    plain = docs.withColumn("text", F.col("text"))
    return map_arrow(plain, _run(docs.sparkSession, train(docs, labels), plain, True, threshold), docs.schema)
