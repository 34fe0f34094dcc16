"""Mixing, the pipeline against brute force, and the SQL of the corpus operators."""

import hashlib
import os
import random
from collections import defaultdict

import duckdb
import numpy as np
import pytest

import corpus_pipeline
from callscope.llm import mixing, queries

DATA = "/root/testdata/sf0.001"


def words(text):
    return len((text or "").replace("\x0b", " ").replace("\f", " ").replace("\r", " ").replace("\t", " ").replace("\n", " ").split(" ")) - sum(not w for w in (text or "").replace("\x0b", " ").replace("\f", " ").replace("\r", " ").replace("\t", " ").replace("\n", " ").split(" "))


def goals(sizes):
    """Target of each source, by raising the level until the budget is spent."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    budget, full = 1.5 * sum(sizes.values()), set()
    while True:
        rest = [s for s in order if s not in full]
        level = (budget - sum(2 * sizes[s] for s in full)) / sum(weight[s] for s in rest) if rest else 0
        over = {s for s in rest if level * weight[s] > 2 * sizes[s]}
        if not over:
            return {s: 2 * sizes[s] if s in full else level * weight[s] for s in order}
        full |= over


def mixed(rows):
    """Copies of each row (doc_id, text, source), as the plan should have them."""
    sizes = defaultdict(int)
    for _, t, s in rows:
        sizes[s] += words(t)
    goal = goals(sizes)
    place = lambda r: hashlib.md5(":".join(x for x in (None if r[0] is None else str(r[0]), r[1]) if x is not None).encode()).hexdigest()
    done, entries = defaultdict(int), []
    for k in sorted(range(len(rows)), key=lambda k: (place(rows[k]), words(rows[k][1]))):
        s, n = rows[k][2], words(rows[k][1])
        done[s] += n
        if n:
            entries += [((done[s] + p * sizes[s]) / goal[s], s is None, s or "", k, n) for p in range(2)]
    copies, run = [0 if words(r[1]) else 1 for r in rows], 0
    for *_, k, n in sorted(entries):
        run += n
        if run > 1.5 * sum(sizes.values()):
            break
        copies[k] += 1
    return copies, goal, sizes


def some_rows(seed, n=400):
    rng = random.Random(seed)
    sources = ["a", "b", "é", "z", None, "tiny", ""]
    return [(i, " ".join(["w"] * rng.choice((0, 3, 10, 40, 200)) + [f"n{i}"]), rng.choice(sources[:5]) if i > 3 else sources[5 + i % 2]) for i in range(n)]


@pytest.mark.parametrize("seed", range(3))
def test_mix_against_brute_force(documents, seed):
    rows = some_rows(seed)
    copies, goal, sizes = mixed(rows)
    docs = documents([(i, t, "en", s) for i, t, s in rows])
    got = {r.doc_id: r for r in mixing.mix_plan(docs).collect()}
    taken = defaultdict(int)
    for (i, t, s), c in zip(rows, copies, strict=True):
        assert (got[i].size, got[i].source_size, got[i].taken) == (words(t), sizes[s], c * words(t))
        assert abs(got[i].target - goal[s]) < 1e-6 * max(1, goal[s])
        taken[s] += got[i].taken
    assert all(abs(taken[s] - goal[s]) <= 201 for s in goal)
    out = defaultdict(int)
    for r in mixing.mix(docs).collect():
        out[r.doc_id] += 1
    assert out == {i: c for (i, _, _), c in zip(rows, copies, strict=True) if c}


def test_targets_share_what_exceeds(spark):
    sizes = {"a": 10, "b": 100_000, "c": 5, "d": 300, "e": 0}
    df = spark.createDataFrame([("0" + s, n) for s, n in sizes.items()], "_key string, source_size bigint")
    got = {r._key[1:]: r.target for r in mixing.targets(df).collect()}
    assert all(abs(got[s] - g) < 1e-6 * max(1, g) for s, g in goals(sizes).items())


def test_mix_of_odd_rows(odd, none):
    rows = mixing.mix_plan(odd).collect()
    assert len(rows) == odd.count() and all(r.taken <= 2 * r.size for r in rows)
    assert sorted(map(str, rows)) == sorted(map(str, mixing.mix_plan(odd).collect()))
    assert mixing.mix(odd).columns == odd.columns
    assert mixing.mix_plan(none).count() == mixing.mix(none).count() == 0


@pytest.mark.parametrize("names", [("source_size", "target", "_size"), ("_key", "_bucket", "_copies"), ("row", "_place", "_times"), ("id", "_row_hash", "h"), ("_i", "_none", "_h"), ("sig", "keys", "k")])
def test_columns_of_any_name_are_carried(spark, names):
    """Stages return the values of extra columns whose names they might use themselves."""
    from callscope.llm import langid, shingles, simhash, toxicity

    rows = [(i, f"word{i} and {'more ' * (i % 5)}text {i}", "en", "ab"[i % 2], f"x{i}", i * 10, None if i % 3 else f"z{i}") for i in range(40)]
    docs = spark.createDataFrame(rows, f"doc_id bigint, text string, lang string, source string, `{names[0]}` string, `{names[1]}` bigint, `{names[2]}` string")
    labels = spark.createDataFrame([(i, 1, i % 4 // 3) for i in range(40)], "doc_id bigint, quality int, toxic int")
    want = {r[0]: r for r in rows}
    for out in (mixing.mix(docs), shingles.drop_near_duplicates(docs), simhash.drop_near_duplicates(docs), langid.drop_unknown(docs), toxicity.drop_toxic(docs, labels)):
        found = out.collect()
        assert out.columns == docs.columns and found and all(tuple(r) == want[r[0]] for r in found)


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for name in os.listdir(DATA):
        con.execute(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM read_parquet('{DATA}/{name}')")
    return con


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_its_sql(spark, tables, name):
    got, want = queries.QUERIES[name](spark, DATA).toPandas(), tables.execute(queries.ORACLES[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    shown = [sorted(map(tuple, df[columns].round(6).astype(object).where(df[columns].notna(), None).map(lambda v: str(float(v)) if isinstance(v, (int, float)) else str(v)).itertuples(index=False))) for df in (got, want)]
    assert shown[0] == shown[1]


def test_cutoffs_reject_documents_of_the_table(spark):
    """At sf0.01 English has a holdout large enough to certify cutoffs; the SQL agrees on what they reject."""
    data = DATA.replace("0.001", "0.01")
    con = duckdb.connect()
    for name in ("documents", "labels"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{data}/{name}.parquet')")
    want = {(i, k) for i, k in con.execute(f"SELECT doc_id, kept FROM ({queries.ORACLES['op3_quality']})").fetchall()}
    rows = queries.QUERIES["op3_quality"](spark, data).collect()
    assert {(r.doc_id, r.kept) for r in rows} == want and sum(not r.kept and not r.base_failed for r in rows) > 10


def test_every_operator_has_a_query():
    assert [n.split("_")[0] for n in queries.QUERIES] == [f"op{k}" for k in range(1, 11)]


def test_pipeline_against_brute_force(spark):
    """Each stage's decisions in plain Python: all pairs of shingle sets, the mix and the library's ids; the two classifiers' models are tested by themselves."""
    from test_shingles import kept
    from tokenizers import Tokenizer

    from callscope.llm import bpe, langid, toxicity
    from callscope.llm.common import held_out

    docs, labels = spark.read.parquet(f"{DATA}/documents.parquet"), spark.read.parquet(f"{DATA}/labels.parquet")
    rows = {r.doc_id: (r.text, r.source) for r in docs.collect()}
    model = toxicity.train(docs, labels)
    rows = {i: r for i, r in rows.items() if model.scores([r[0] or ""])[0] < toxicity.THRESHOLD}
    model = langid.train(docs.where(docs.doc_id.isin(*rows)))
    assert not docs.where(held_out(docs.doc_id)).isEmpty()
    verdicts = {i: [x[0] for x in model.predict([r[0] or ""])] for i, r in rows.items()}
    rows = {i: r for i, r in rows.items() if verdicts[i][0] != "und" and verdicts[i][1] >= langid.KEEP_SCORE}
    rows = [(i, *rows[i]) for i in kept([(i, r[0]) for i, r in sorted(rows.items())])]
    copies, *_ = mixed(rows)
    library = Tokenizer.from_file(bpe.default_tokenizer())
    library.no_truncation()
    library.no_padding()
    ids = {i: library.encode(t or "", add_special_tokens=False).ids for i, t, _ in rows}
    want = sorted((i, ids[i]) for (i, *_), c in zip(rows, copies, strict=True) for _ in range(c))
    got = sorted((r.doc_id, np.frombuffer(r.ids, "<u4").tolist()) for r in corpus_pipeline.run(spark, DATA).collect())
    assert got == want
