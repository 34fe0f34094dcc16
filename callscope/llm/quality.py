"""Quality rules with risk-controlled thresholds, in DataFrame operations only.

Two fixed base rules reject a document outright.  Beyond them, each rule of ``RULES``
rejects what exceeds a cutoff.  The cutoffs of all rules tighten together, level by level:
a level is one cutoff of each rule, and rejects what exceeds any of them.  A labelled
holdout decides, for each stratum (language), how far to go: it counts how many good
documents a level would reject, and a level may be used only if the exact binomial
(Clopper-Pearson) upper bound of that share stays within ``RISK``.

The tests of a stratum are a fixed sequence from lenient to strict that ends at the first
level that fails, so the number of levels costs no confidence; that is divided by the
number of strata tested only.  A stratum whose holdout could certify nothing even without
a single loss is not tested (that is known from its size alone) and uses the base rules.
So with probability ``1 - DELTA`` no stratum loses more than ``RISK`` of its good documents
to the cutoffs.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callscope.llm.common import settle

SPACES = " \t\n\x0b\f\r"
SYMBOLS = "#*$%&|<>"
MIN_WORDS, MOST_REPEATED = 50, 50
#: Most good documents that a stratum may lose, and the chance that it loses more.
RISK, DELTA = 0.02, 0.05
#: Cutoffs of each rule, one for each level, lenient last.  All values are shares in per cent, but for characters per word.
RULES = {
    "symbols": [5, 10, 15, 20, 30, 40, 50, 75, 100, 150, 200, 300],
    "exclaims": [5, 10, 15, 20, 30, 40, 50, 75, 100, 150, 200, 300],
    "dup_lines": [5, 10, 15, 20, 25, 30, 40, 50, 60, 70, 80, 90],
    "repeats": [5, 8, 10, 12, 15, 18, 20, 25, 30, 35, 40, 45],
    "word_length": [8, 9, 10, 11, 12, 13, 14, 16, 18, 20, 30, 50],
}
#: Terms of a binomial tail that are added up; what is left is bounded from above.
TERMS = 4096
#: Different windows of a text found twice up to which only their places are sorted.
FEW = 8
#: Strata up to which their thresholds, a row each, are broadcast; beyond, the join is left to the planner.
BROADCAST_STRATA = 10_000


def _let(value, body):
    """``body`` of ``value``, which is worked out once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _words(text):
    return F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "")


def _repeat_words(words):
    """Words that lie in a 3-word window found twice or more.

    Sorted hashes show whether a window may repeat.  Where few do, only their places are
    looked at, else all; windows there are sorted as text, equal neighbours kept, and their
    union is measured.
    """
    hashes = F.transform(F.sequence(F.lit(1), F.size(words) - 2), lambda i: F.xxhash64(F.get(words, i - 1), F.get(words, i), F.get(words, i + 1)))
    again = lambda h: _let(F.sort_array(h), lambda s: F.array_distinct(F.filter(s, lambda x, k: x == F.get(s, k - 1))))
    every = lambda h: F.sequence(F.lit(1), F.size(h))
    places = lambda h, d: F.when(F.size(d) <= FEW, F.filter(every(h), lambda i: F.array_contains(d, F.get(h, i - 1)))).otherwise(every(h))
    window = lambda i: F.struct(F.concat_ws(" ", F.get(words, i - 1), F.get(words, i), F.get(words, i + 1)).alias("g"), i.alias("p"))
    twice = lambda s: F.filter(s, lambda x, k: (x["g"] == F.get(s, k - 1)["g"]) | (x["g"] == F.get(s, k + 1)["g"]))
    start = F.struct(F.lit(0).alias("n"), F.lit(-9).alias("last"))
    step = lambda a, p: F.struct((a["n"] + F.least(F.lit(3), p - a["last"])).alias("n"), p.alias("last"))
    union = lambda s: F.aggregate(F.sort_array(F.transform(twice(s), lambda x: x["p"])), start, step, lambda a: a["n"])
    covered = lambda at: _let(F.sort_array(F.transform(at, window)), union)
    found = _let(hashes, lambda h: _let(again(h), lambda d: F.when(F.size(d) == 0, 0).otherwise(covered(places(h, d)))))
    return F.when(F.size(words) < 3, 0).otherwise(found)


def base_columns(text) -> F.Column:
    """Struct of n_words, word_chars, n_symbols, n_exclaims, n_lines, n_dup_lines and n_repeat_words of a text (null: empty)."""
    text = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: F.length(F.btrim(x, F.lit(SPACES))) > 0)

    def columns(words):
        parts = {
            "n_words": F.size(words),
            "word_chars": F.length(F.array_join(words, "")),
            "n_symbols": F.length(text) - F.length(F.translate(text, SYMBOLS, "")),
            "n_exclaims": F.length(text) - F.length(F.replace(text, F.lit("!"), F.lit(""))),
            "n_repeat_words": _repeat_words(words),
        }
        counted = _let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines")))
        return F.struct(*(v.cast("long").alias(k) for k, v in parts.items()), counted.alias("lines"))

    return _let(_words(text), columns)


def _values(n) -> dict[str, F.Column]:
    words = F.greatest(n("n_words"), F.lit(1))
    return {
        "symbols": 100 * n("n_symbols") / words,
        "exclaims": 100 * n("n_exclaims") / words,
        "dup_lines": 100 * n("n_dup_lines") / F.greatest(n("n_lines"), F.lit(1)),
        "repeats": 100 * n("n_repeat_words") / words,
        "word_length": n("word_chars") / words,
    }


def measure(docs: DataFrame) -> DataFrame:
    """doc_id, stratum, the base columns, base_failed, and over: the number of levels that reject the document."""
    parts = docs.select("doc_id", F.coalesce("lang", F.lit("")).alias("stratum"), base_columns(F.col("text")).alias("b"))
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_exclaims", "n_lines"]
    rows = parts.select("doc_id", "stratum", *(F.col(f"b.lines.{n}" if "line" in n else f"b.{n}").alias(n) for n in names))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    over = F.greatest(*(sum((v > c).cast("int") for c in RULES[r]) for r, v in _values(F.col).items()))
    return rows.withColumns({"base_failed": failed, "over": over})


def _log_gamma(x):
    """Logarithm of the gamma function for x >= 1: Stirling's series, moved up by eight."""
    y = x + 8
    low = sum((F.log(x + k) for k in range(8)), F.lit(0.0))
    return (y - 0.5) * F.log(y) - y + 0.9189385332046727 + 1 / (12 * y) - 1 / (360 * y * y * y) + 1 / (1260 * y * y * y * y * y) - low


def binomial_tail(k, n, p: float):
    """P(X <= k) for X binomial (n, p), never too small; 1 where k is at or over the mean."""
    log_p = _log_gamma(n + 1) - _log_gamma(k + 1) - _log_gamma(n - k + 1) + k * F.log(F.lit(p)) + (n - k) * F.log(F.lit(1 - p))
    odds = (1 - p) / p
    start = F.struct(F.lit(1.0).alias("t"), F.lit(1.0).alias("s"))

    def step(a, j):
        i = k - j + 1  # from the term of i to that of i - 1
        t = a["t"] * (i / (n - i + 1) * odds)
        return F.struct(t.alias("t"), (a["s"] + t).alias("s"))

    ratio = k / (n - k + 1) * odds  # of all ratios the largest
    added = F.aggregate(F.sequence(F.lit(1), F.least(k, F.lit(TERMS)).cast("int")), start, step, lambda a: a["s"] + F.when(k > TERMS, a["t"] * ratio / (1 - ratio)).otherwise(0.0))
    return F.when(k >= n * p, 1.0).when(k == 0, F.exp(log_p)).otherwise(F.least(F.lit(1.0), F.exp(log_p) * added))


def least_holdout(risk: float = RISK, delta: float = DELTA) -> int:
    """Good documents below which a stratum can certify nothing, even alone and without a loss."""
    return math.ceil(math.log(delta) / math.log1p(-risk))


def thresholds(measured: DataFrame, labels: DataFrame, risk: float = RISK, delta: float = DELTA) -> tuple[DataFrame, int]:
    """(stratum, most: the levels that a document may exceed, good: its holdout, lost: those of it that are rejected) of each tested stratum, and their number.

    The holdout: documents marked with quality 1 that pass the base rules.  ``most`` is the
    number of levels where not even the most lenient is safe.
    """
    levels = len(next(iter(RULES.values())))
    good = labels.where((F.col("quality") == 1) & F.col("doc_id").isNotNull()).select("doc_id").distinct()
    held = measured.where(~F.col("base_failed")).join(good, "doc_id", "left_semi")
    counts = [F.sum((F.col("over") > g).cast("long")).alias(f"k_{g}") for g in range(levels)]
    counted = settle(held.groupBy("stratum").agg(F.count(F.lit(1)).alias("n"), *counts).where(F.col("n") >= least_holdout(risk, delta)))
    strata = counted.count()
    each = [F.struct(F.lit(g).alias("g"), F.col(f"k_{g}").alias("k")) for g in range(levels)]
    rows = counted.select("stratum", "n", F.inline(F.array(*each)))
    failed = binomial_tail(F.col("k").cast("double"), F.col("n").cast("double"), risk) > delta / max(strata, 1)
    last = rows.withColumn("failed", failed).groupBy("stratum", "n").agg(F.coalesce(F.max(F.when(F.col("failed"), F.col("g"))), F.lit(-1)).alias("last"), F.collect_list(F.struct("g", "k")).alias("ks"))
    most = F.col("last") + 1
    lost = F.coalesce(F.get(F.transform(F.filter("ks", lambda x: x["g"] == most), lambda x: x["k"]), F.lit(0)), F.lit(0))
    return last.select("stratum", most.alias("most"), F.col("n").alias("good"), lost.alias("lost")), strata


def judge(docs: DataFrame, labels: DataFrame, risk: float = RISK, delta: float = DELTA) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, stratum: a row per row of ``docs``.

    Null and empty texts have no words and fail; a null language is the stratum of the
    empty name; repeated rows are judged alike; no labels mean no rejection but by the
    base rules; other columns are ignored.
    """
    measured = settle(measure(docs))
    found, strata = thresholds(measured, labels, risk, delta)
    found = settle(found.select("stratum", "most"))
    rows = measured.join(F.broadcast(found) if strata <= BROADCAST_STRATA else found, "stratum", "left")
    rejected = F.coalesce(F.col("over") > F.col("most"), F.lit(False))
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & ~rejected).alias("kept"), "stratum")


def oracle() -> str:
    """DuckDB SQL for :func:`judge` on the tables documents and labels."""
    levels = len(next(iter(RULES.values())))
    value = {
        "symbols": "100 * n_symbols / greatest(n_words, 1)",
        "exclaims": "100 * n_exclaims / greatest(n_words, 1)",
        "dup_lines": "100 * n_dup_lines / greatest(n_lines, 1)",
        "repeats": "100 * n_repeat_words / greatest(n_words, 1)",
        "word_length": "word_chars / greatest(n_words, 1)",
    }
    over = ", ".join(f"len(list_filter({cuts}, lambda c: {value[r]} > c))" for r, cuts in RULES.items())
    return rf"""
WITH docs AS (
  SELECT doc_id, coalesce(lang, '') AS stratum, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM documents),
spans AS (
  SELECT doc_id, unnest(range(1, len(w) - 1)) AS p, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) AS g
  FROM docs WHERE len(w) >= 3),
twice AS (SELECT doc_id, p FROM (SELECT doc_id, p, count(*) OVER (PARTITION BY doc_id, g) AS n FROM spans) WHERE n > 1),
covered AS (
  SELECT doc_id, sum(least(3, p - was))::BIGINT AS n_repeat_words
  FROM (SELECT doc_id, p, lag(p, 1, -9) OVER (PARTITION BY doc_id ORDER BY p) AS was FROM twice) GROUP BY doc_id),
measured AS (
  SELECT d.doc_id, stratum, len(w)::BIGINT AS n_words, len(array_to_string(w, ''))::BIGINT AS word_chars,
         (len(text) - len(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
         (len(text) - len(replace(text, '!', '')))::BIGINT AS n_exclaims,
         len(lines)::BIGINT AS n_lines, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
         coalesce(c.n_repeat_words, 0)::BIGINT AS n_repeat_words
  FROM docs d LEFT JOIN covered c ON d.doc_id = c.doc_id),
based AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MOST_REPEATED} * n_words AS base_failed FROM measured),
judged AS (SELECT *, greatest({over}) AS over FROM based),
held AS (SELECT * FROM judged WHERE NOT base_failed AND doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)),
sizes AS (SELECT stratum, count(*) AS n FROM held GROUP BY stratum HAVING count(*) >= {least_holdout()}),
counts AS (
  SELECT s.stratum, s.n, g, count(*) FILTER (over > g) AS k
  FROM held h JOIN sizes s ON h.stratum = s.stratum, (SELECT unnest(range(0, {levels})) AS g) GROUP BY s.stratum, s.n, g),
tails AS (
  SELECT *, CASE WHEN k >= n * {RISK} THEN 1.0 ELSE list_sum(list_transform(range(0, k + 1),
    lambda i: exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln({RISK}) + (n - i) * ln(1 - {RISK})))) END AS tail
  FROM counts),
safe AS (SELECT stratum, coalesce(max(g) FILTER (tail > {DELTA} / (SELECT count(*) FROM sizes)), -1) + 1 AS most FROM tails GROUP BY stratum)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND NOT coalesce(over > most, false) AS kept, j.stratum
FROM judged j LEFT JOIN safe s ON j.stratum = s.stratum
"""
