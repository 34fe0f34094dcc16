"""Mixing sources to target weights by weighted fair queueing, in DataFrame operations only.

Each source's documents are shuffled by a hash.  A document's virtual finish time is the
words of its source up to and with it, divided by the source's target; in a second pass
the source starts over.  All documents of all passes, sorted by finish time, are taken
until the total budget is used.  As time 1 is where each source meets its target, the
cut keeps every source near its own.

No sum runs through all rows of a source or of the table: running sums are taken inside
``4096`` hash buckets of each source and carried over by the sums of the buckets, and the
cut is looked for among sums of equal slices of time, then inside one slice.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from callscope.llm.common import packed, settle, unpacked

#: Weights of the sources in order, repeating; words of the mix as a share of all words; passes over a source at most.
WEIGHTS, SHARE, PASSES = (5, 2, 1), 1.5, 2
#: Slices of each unit of virtual time, and units told apart.
SLICES, UNITS = 4096, 4


def _places(doc_id, text, source) -> dict:
    """Of a document: its source as a key that sorts nulls last, size, place in the shuffle, and bucket."""
    place = F.md5(F.concat_ws(":", doc_id.cast("string"), text).cast("binary"))
    size = F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")
    key = F.when(source.isNull(), "1").otherwise(F.concat(F.lit("0"), source))
    return {"_key": key, "_size": size, "_place": place, "_bucket": F.substring(place, 1, 3)}


def targets(sources: DataFrame) -> DataFrame:
    """(_key, source_size, target) of each source, from (_key, source_size): the budget by weight, what exceeds the passes shared again.

    A source is full if its passes are used up before the others' level is reached; full
    ones come first by words per weight, so the level follows from running sums.
    """
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.pmod(F.row_number().over(W.orderBy("_key")) - 1, F.lit(len(WEIGHTS))) + 1).cast("int"))
    rows = sources.withColumn("_w", weight).withColumn("_cap", F.lit(PASSES) * F.col("source_size")).withColumn("_r", F.col("_cap") / F.col("_w"))
    all_, before = W.partitionBy(), W.orderBy("_r", "_key").rowsBetween(W.unboundedPreceding, -1)
    spent, used = (F.coalesce(F.sum(c).over(before), F.lit(0)) for c in ("_cap", "_w"))
    rows = rows.withColumn("_level", (F.lit(SHARE) * F.sum("source_size").over(all_) - spent) / (F.sum("_w").over(all_) - used))
    rows = rows.withColumn("_level", F.max(F.when(F.col("_level") <= F.col("_r"), F.col("_level"))).over(all_))
    share = F.coalesce(F.col("_level") * F.col("_w"), F.col("_cap").cast("double"))
    return rows.select("_key", "source_size", F.least(F.col("_cap").cast("double"), share).alias("target"))


class Plan:
    """What the mix needs to know of all rows: each bucket's start, each source's target, and where the budget ends."""

    def __init__(self, ranked: DataFrame):
        sums = settle(ranked.groupBy("_key", "_bucket").agg(F.sum("_size").alias("_sum")))
        goal = settle(targets(sums.groupBy("_key").agg(F.sum("_sum").alias("source_size"))))
        start = F.coalesce(F.sum("_sum").over(W.partitionBy("_key").orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
        self.buckets = settle(sums.withColumn("_start", start).join(goal, "_key").drop("_sum"))
        self.budget = (goal.agg(F.sum("source_size")).first()[0] or 0) * SHARE
        self.time, self.key = self._cut(settle(self.timed(ranked.select("_key", "_bucket", "_place", "_size"))))

    def timed(self, ranked: DataFrame) -> DataFrame:
        """``ranked`` with source_size, target and the finish times of its passes; a document without words finishes at 0."""
        own = F.sum("_size").over(W.partitionBy("_key", "_bucket").orderBy("_place", "_size").rowsBetween(W.unboundedPreceding, 0))
        rows = ranked.join(self.buckets, ["_key", "_bucket"]).withColumn("_end", F.col("_start") + own)
        finish = [F.when(F.col("_size") > 0, (F.col("_end") + p * F.col("source_size")) / F.col("target")).otherwise(0.0) for p in range(PASSES)]
        return rows.withColumn("_times", F.array(*finish)).drop("_start", "_end")

    def _cut(self, timed: DataFrame) -> tuple[float, str]:
        """Time and source of the last document that the budget takes."""
        each = timed.where(F.col("_size") > 0).select("_key", "_size", F.explode("_times").alias("_time"))
        each = each.withColumn("_slice", F.least(F.floor(F.col("_time") * SLICES), F.lit(SLICES * UNITS)))
        sums = each.groupBy("_slice").agg(F.sum("_size").alias("_sum"))
        sums = sums.withColumn("_before", F.coalesce(F.sum("_sum").over(W.orderBy("_slice").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
        last = sums.where(F.col("_before") <= self.budget).orderBy(F.desc("_slice")).first()
        if last is None:
            return -1.0, ""
        run = F.sum("_size").over(W.orderBy("_time", "_key").rowsBetween(W.unboundedPreceding, 0))
        inside = each.where(F.col("_slice") == last["_slice"]).withColumn("_run", run + last["_before"])
        found = inside.where(F.col("_run") <= self.budget).agg(F.max(F.struct("_time", "_key")).alias("m")).first()["m"]
        return (found["_time"], found["_key"]) if found else (last["_slice"] / SLICES, "")

    def copies(self):
        """Times that a row of :meth:`timed` is taken; without words, once."""
        at = F.struct(F.lit(self.time).cast("double").alias("t"), F.lit(self.key).alias("k"))
        hits = F.filter("_times", lambda t: F.struct(t.alias("t"), F.col("_key").alias("k")) <= at)
        return F.when(F.col("_size") > 0, F.size(hits)).otherwise(1)


def mix_plan(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target, taken, copies: a row per row of ``docs``.

    size counts the words (null text: none).  Sources come in order of code points, the
    null source last; a source without words has target 0.  Equal rows are told apart by
    the order in which they are met, so one may be taken twice and the other once.  An
    empty table gives no rows; other columns are ignored.
    """
    ranked = settle(docs.select("doc_id", *(c.alias(n) for n, c in _places(F.col("doc_id"), F.col("text"), F.col("source")).items())))
    plan = Plan(ranked)
    rows = plan.timed(ranked).withColumn("copies", plan.copies())
    return rows.select("doc_id", F.col("_size").alias("size"), "source_size", "target", (F.col("copies") * F.col("_size")).cast("long").alias("taken"), "copies")


def mix(docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text, source) mixed: each row as many times as the mix takes it, columns as in ``docs``, whatever their names.

    Nulls, empty texts, ties and repeated rows are treated as in :func:`mix_plan`; a row
    without words comes once.
    """
    ranked = packed(docs, **_places(docs["doc_id"], docs["text"], docs["source"]))
    plan = Plan(settle(ranked.drop("row")))
    rows = plan.timed(ranked).withColumn("_copies", plan.copies())
    return unpacked(rows.where(F.col("_copies") > 0).withColumn("_n", F.explode(F.sequence(F.lit(1), "_copies"))), docs)


ORACLE = rf"""
WITH docs AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         md5(concat_ws(':', doc_id::VARCHAR, text)) AS place
  FROM documents),
sizes AS (SELECT source, sum(size)::BIGINT AS source_size FROM docs GROUP BY source),
weighed AS (
  SELECT source, source_size, [{", ".join(map(str, WEIGHTS))}][1 + (row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) % {len(WEIGHTS)}] AS w,
         row_number() OVER (ORDER BY encode(source) NULLS LAST) AS pos
  FROM sizes),
levels AS (
  SELECT *, {PASSES} * source_size / w AS r,
         ({SHARE} * sum(source_size) OVER ()::DOUBLE - coalesce(sum({PASSES} * source_size) OVER b, 0)::DOUBLE) / (sum(w) OVER () - coalesce(sum(w) OVER b, 0))::DOUBLE AS level
  FROM weighed WINDOW b AS (ORDER BY {PASSES} * source_size / w, pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
goal AS (
  SELECT source, source_size, pos,
         least(({PASSES} * source_size)::DOUBLE, coalesce((SELECT max(level) FROM levels WHERE level <= r) * w, ({PASSES} * source_size)::DOUBLE)) AS target
  FROM levels),
ends AS (
  SELECT d.doc_id, d.size, g.source_size, g.target, g.pos, d.place,
         sum(d.size) OVER (PARTITION BY g.pos ORDER BY d.place, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS done
  FROM docs d JOIN goal g ON d.source IS NOT DISTINCT FROM g.source),
entries AS (
  SELECT *, (done + pass * source_size)::DOUBLE / target AS finish FROM ends, (SELECT unnest(range(0, {PASSES})) AS pass) WHERE size > 0),
cut AS (
  SELECT *, sum(size) OVER (ORDER BY finish, pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) <= {SHARE} * (SELECT sum(source_size) FROM sizes) AS fits
  FROM entries),
won AS (SELECT pos, place, done, count(*) FILTER (fits) AS times FROM cut GROUP BY pos, place, done)
SELECT e.doc_id, e.size, e.source_size, e.target, (coalesce(times, 0) * e.size)::BIGINT AS taken, (CASE WHEN e.size > 0 THEN coalesce(times, 0) ELSE 1 END)::INTEGER AS copies
FROM ends e LEFT JOIN won n ON e.size > 0 AND e.pos = n.pos AND e.place = n.place AND e.done = n.done
"""
