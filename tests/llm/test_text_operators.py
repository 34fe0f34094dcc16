"""Operators that judge documents one by one: toxicity, quality, language, BPE."""

import hashlib
import math
import random
import zlib
from pathlib import Path

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from callscope.llm import bpe, langid, quality, toxicity

DATA = "/root/testdata/sf0.01"


def held_out(i):
    return zlib.crc32(str(i).encode()) % 4 == 2


def invented(rng, sounds, n):
    return " ".join("".join(rng.choices(sounds, k=rng.randint(1, 3))) for _ in range(n))


# Toxicity -----------------------------------------------------------------
@pytest.fixture(scope="module")
def corpus(documents, spark):
    rng = random.Random(3)
    sounds = ["la", "mi", "ro", "ten", "su", "ka"]
    insults = ["grobnash", "vilkrut", "dumfleck"]
    rows, marks = [], []
    for i in range(400):
        text, bad = invented(rng, sounds, rng.randint(20, 60)).split(), i % 5 == 0
        if bad:
            for _ in range(2):
                text.insert(rng.randrange(len(text)), rng.choice(insults))
        rows.append((i, " ".join(text), "xx", "s"))
        marks.append((i, 1, int(bad)))
    rows += [(1000, invented(rng, sounds, 30) + " grobnashh vilkrutt dumflekc", "xx", "s"), (1001, invented(rng, sounds, 30), "xx", "s")]
    return documents(rows), spark.createDataFrame(marks, "doc_id bigint, quality int, toxic int")


def test_toxicity_learns_and_catches_misspellings(corpus):
    docs, labels = corpus
    rows = {r.doc_id: r for r in toxicity.score_documents(docs, labels).collect()}
    assert all(r.held_out == held_out(i) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for i, r in rows.items())
    wrong = [i for i in range(400) if rows[i].held_out and rows[i].predicted != (i % 5 == 0)]
    assert len(wrong) <= 3
    assert rows[1000].predicted == 1 and rows[1001].predicted == 0
    kept = toxicity.drop_toxic(docs, labels)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {i for i, r in rows.items() if not r.predicted}


def test_toxicity_of_odd_rows(odd, none, corpus, spark):
    labels = corpus[1]
    assert toxicity.score_documents(odd, labels).count() == odd.count()
    assert toxicity.score_documents(none, labels).count() == toxicity.drop_toxic(none, labels).count() == 0
    scores = [r.score for r in toxicity.score_documents(odd, labels.where("false")).collect()]
    assert len(scores) == odd.count() and all(0 <= s < 0.3 for s in scores)
    nulls = spark.createDataFrame([(None, None, None), (2, None, 1), (4, None, None)], "doc_id bigint, quality int, toxic int")
    assert toxicity.score_documents(odd, nulls).count() == odd.count()


def test_toxicity_never_reads_held_out_labels(corpus, spark):
    docs, labels = corpus
    flipped = labels.withColumn("toxic", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = (sorted((r.doc_id, r.score) for r in toxicity.score_documents(docs, x).collect()) for x in (labels, flipped))
    assert a == b


def grams(word):
    """Buckets of a word's n-grams, one by one; its ends are marked by zero."""
    marked = [0, *map(ord, word), 0]
    for n in toxicity.NGRAMS:
        for at in range(len(marked) - n + 1):
            h = 0
            for c in marked[at : at + n]:
                h = (h ^ c) * 0x9E3779B1 % 2**32
                h ^= h >> 15
            yield (h + n - 1) * 0x9E3779B1 % 2**32 >> 14


def test_toxicity_evidence_against_brute_force():
    """All n-grams of all words of a text make its average; words are averaged alone."""
    rng = np.random.default_rng(1)
    model = toxicity.Model(*rng.normal(0, 1, (2, toxicity.BUCKETS)).astype(np.float32), 0.25, np.zeros(0))
    texts = ["", "a", "Two words!", "émile 42 ", " ".join(f"w{i}x{i % 7}" for i in range(3000)), "x" * 2000]
    for text, row in zip(texts, model.evidence(texts), strict=True):
        words = "".join(c if c.isalnum() else " " for c in text.lower()).split()
        found = [list(grams(w)) for w in words]
        total, n = sum(float(model.texts[b]) for g in found for b in g), sum(map(len, found))
        assert abs(row[0] - toxicity.SCALE * total / (n + toxicity.PRIOR)) < 1e-4
        strong = sorted((sum(float(model.words[b]) for b in g) / len(g) for g in found), reverse=True)[: toxicity.TOP]
        assert np.allclose(row[1:-1], np.array(strong + [0.0] * (toxicity.TOP - len(strong))) + 0.25, atol=1e-4)
        assert abs(row[-1] - math.log1p(len(words))) < 1e-9


def test_toxicity_of_many_mild_words():
    """No single word is telling, a text full of them is: the average over all words decides."""
    rng = random.Random(2)
    mild, plain = [f"mi{a}{b}" for a in "abcdefgh" for b in "xyzuvw"], [f"la{a}{b}" for a in "abcdefgh" for b in "xyzuvw"]
    make = lambda bad: " ".join(rng.choice(mild if rng.random() < (0.6 if bad else 0.4) else plain) for _ in range(300))
    toxic = np.array([k % 3 == 0 for k in range(300)], int)
    model = toxicity.fit([make(t) for t in toxic], toxic, np.ones(300))
    seen = np.array([k % 2 for k in range(60)])
    assert ((model.scores([make(t) for t in seen]) >= 0.5) == seen).mean() >= 0.95


# Quality ------------------------------------------------------------------
def words_of(text):
    out, word = [], ""
    for c in text:
        if c in " \t\n\x0b\f\r":
            if word:
                out.append(word)
            word = ""
        else:
            word += c
    return out + [word] * bool(word)


def base(text):
    text = text or ""
    words = words_of(text)
    grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    seen = set()
    for i, g in enumerate(grams):
        if grams.count(g) > 1:
            seen |= {i, i + 1, i + 2}
    lines, dup, before = text.split("\n"), 0, set()
    for line in lines:
        if words_of(line):
            dup += line in before
            before.add(line)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(seen)


@settings(max_examples=4, deadline=None)
@given(st.lists(st.lists(st.sampled_from(["a", "b", "c", "dé", "#x", "|", "🙂", "\n", "\n\n", "\t", "a b c\n", "\x0b", "\xa0"]), max_size=60).map(" ".join), min_size=1, max_size=30))
def test_quality_counts(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", quality.base_columns(F.col("t")).alias("b"))
    got = {r.i: (r.b.n_words, r.b.word_chars, r.b.n_symbols, r.b.lines.n_dup_lines, r.b.n_repeat_words) for r in df.collect()}
    assert got == {i: base(t) for i, t in enumerate(texts)}


def test_quality_counts_with_many_repeats(spark):
    rng = random.Random(1)
    texts = [" ".join(rng.choices("abcdefgh", k=n)) for n in (40, 300, 900)] + [" ".join(f"w{i % 40}" for i in range(400))]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", quality.base_columns(F.col("t"))["n_repeat_words"].alias("n"))
    assert {r.i: r.n for r in df.collect()} == {i: base(t)[4] for i, t in enumerate(texts)}


def test_binomial_tail(spark):
    cases = [(0, 10, 0.3), (3, 40, 0.2), (7, 1000, 0.01), (30, 20_000, 0.004), (50, 100, 0.2), (0, 5000, 0.004)]
    for k, n, p in cases:
        got = spark.range(1).select(quality.binomial_tail(F.lit(float(k)), F.lit(float(n)), p)).first()[0]
        exact = math.fsum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1)) if n <= 1000 else math.fsum(math.exp(math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p)) for i in range(k + 1))
        assert got == 1.0 if k >= n * p else abs(got - exact) < 1e-7 * max(exact, 1e-6)


def test_quality_rejects_only_what_the_holdout_allows(documents, spark):
    rng = random.Random(5)
    good = [(i, " ".join(rng.choices("lamirotensukadebo", k=70)), "en", "s") for i in range(3500)]
    junk = [(10_000 + i, " ".join(w + "***" for w in rng.choices("lamirotensukadebo", k=70)), "en", "s") for i in range(200)]
    few = [(20_000 + i, " ".join(w + "***" for w in rng.choices("lamirotensukadebo", k=70)), "de", "s") for i in range(5)]
    labels = spark.createDataFrame([(r[0], int(r[0] < 10_000), 0) for r in good + junk], "doc_id bigint, quality int, toxic int")
    got = {r.doc_id: (r.base_failed, r.kept) for r in quality.judge(documents(good + junk + few), labels).collect()}
    assert not any(got[r[0]][1] for r in junk)
    lost = [r[0] for r in good if not got[r[0]][0] and not got[r[0]][1]]
    assert len(lost) <= 0.02 * len(good)
    assert all(got[r[0]][1] != got[r[0]][0] for r in few)  # no labels there: only the base rules reject


def test_quality_levels_against_brute_force(documents, spark):
    """Levels from lenient to strict while the exact tail is small enough; strata too small are not tested."""
    rng = random.Random(8)
    word = "lamirotensukadebo"
    rows, marks = [], []
    for lang, n in (("en", 700), ("de", 260), ("fr", 200), ("es", 100)):
        for _ in range(n):
            share = rng.choice((0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 8, 25, 60 if rng.random() < 0.3 else 0))
            words = rng.choices(word, k=100)
            for k in range(share):
                words[k] += "#"
            rows.append((len(rows), " ".join(w + str(rng.randrange(10**6)) for w in words), lang, "s"))
            if rng.random() < 0.9:
                marks.append((rows[-1][0], 1, 0))
    good = {m[0] for m in marks}
    over = {i: sum(100 * base(t)[2] / 100 > c for c in quality.RULES["symbols"]) for i, t, *_ in rows}
    held = {g: [over[i] for i, _, lang, _ in rows if lang == g and i in good] for g in ("en", "de", "fr", "es")}
    tested = {g for g, v in held.items() if 0.98 ** len(v) <= 0.05}
    most = {}
    for g in tested:
        n = len(held[g])
        tail = lambda k: math.fsum(math.comb(n, i) * 0.02**i * 0.98 ** (n - i) for i in range(k + 1))  # noqa: E731, B023
        level = 12
        while level and tail(sum(o > level - 1 for o in held[g])) <= 0.05 / len(tested):
            level -= 1
        most[g] = level
    assert len(tested) >= 2 and len(set(most.values())) > 1 and min(most.values()) < 12
    labels = spark.createDataFrame(marks, "doc_id bigint, quality int, toxic int")
    got = {r.doc_id: r.kept for r in quality.judge(documents(rows), labels).collect()}
    assert got == {i: not (lang in most and over[i] > most[lang]) for i, _, lang, _ in rows}
    found = {r.stratum: r for r in quality.thresholds(quality.measure(documents(rows)), labels)[0].collect()}
    assert {g: (r.most, r.good, r.lost) for g, r in found.items()} == {g: (most[g], len(held[g]), sum(o > most[g] for o in held[g])) for g in tested}


def test_quality_of_odd_rows(odd, none, spark):
    labels = spark.createDataFrame([(None, 1, 0), (5, 1, None), (5, 0, 1)], "doc_id bigint, quality int, toxic int")
    rows = quality.judge(odd, labels).collect()
    assert len(rows) == odd.count()
    by = {r.doc_id: r for r in rows if r.doc_id}
    assert (by[1].n_words, by[2].n_words, by[3].n_words, by[5].n_words) == (0, 0, 0, 2)
    assert by[7].n_words == 120_001
    assert quality.judge(none, labels).count() == 0


# Language -----------------------------------------------------------------
def test_language_on_held_out_rows(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    rows = langid.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    right = sum(r.lang == r.lang_pred for r in rows)
    assert all(held_out(r.doc_id) for r in rows) and right >= 0.97 * len(rows)


def test_language_of_odd_rows(odd, none):
    rows = langid.identify(odd).collect()
    by = {r.doc_id: r for r in rows if r.doc_id}
    assert len(rows) == odd.count()
    assert {by[i].lang_pred for i in (1, 2, 3, 8)} == {"und"} and by[8].score == 0
    assert all(0 <= r.score <= 1 for r in rows)
    assert langid.identify(none).count() == langid.drop_unknown(none).count() == 0
    assert langid.drop_unknown(odd).columns == odd.columns


def parsed(reference, text):
    """Phrases of the whole text, greedily, each looked for in the reference."""
    count, at = 0, 0
    while at < len(text):
        n = 0
        while at + n < len(text) and text[at : at + n + 1] in reference:
            n += 1
        at += max(n, 1)
        count += 1
    return count


def shown(text):
    return "".join(chr(c) for c in langid._letter_points([text])[0])


def test_automaton_parses_into_longest_phrases():
    """Against search in the reference text; letters that it lacks are phrases by themselves."""
    rng = random.Random(2)
    references = {"x": "".join(rng.choices("abc ", k=300)).strip(), "y": "".join(rng.choices("bcde ", k=200)).strip()}
    model = langid.build({k: [v] for k, v in references.items()})
    texts = ["".join(rng.choices("abcez ", k=rng.randint(1, 80))) for _ in range(30)]
    want = [[parsed(shown(references[g]), shown(t)) for g in "xy"] for t in texts]
    assert model.phrases(texts)[0].tolist() == want


@pytest.mark.parametrize("block", [1, 3, 7, 64])
def test_phrases_run_across_blocks(monkeypatch, block):
    """Whatever the blocks, the count is that of the uncut text; runs of one letter never meet again, so each block is parsed in turn."""
    monkeypatch.setattr(langid, "BLOCK", block)
    rng = random.Random(block)
    references = {"x": "".join(rng.choices("ab ", k=400)) + "a" * 10, "y": "ab" * 40, "z": "q"}
    model = langid.build({k: [v] for k, v in references.items()})
    texts = ["".join(rng.choices("ab ", weights=(5, 3, 1), k=rng.randint(0, 300))) for _ in range(20)] + ["a" * 200, "ab" * 150, "", "q" * 65, "b" + "a" * 127]
    want = [[parsed(shown(references[g]), shown(t)) if t else 0 for g in "xyz"] for t in texts]
    assert model.phrases(texts)[0].tolist() == want


def test_large_scripts_are_told_apart():
    """Thousands of letters, each with transitions of its own."""
    rng = random.Random(3)
    han, kana = [chr(0x4E00 + i) for i in range(3000)], [chr(0x4E00 + i) for i in range(1500, 4500)]
    grams = {k: ["".join(rng.choices(v, k=4)) for _ in range(400)] for k, v in (("h", han), ("k", kana))}
    make = lambda k: "".join(rng.choice(grams[k]) for _ in range(60))
    references = {k: [make(k) for _ in range(20)] for k in grams} | {"en": ["plain words of another script"]}
    model = langid.build(references)
    assert len(model.letters) > 1500
    texts = [make(k) for k in "hk" * 20]
    assert model.predict(texts)[0].tolist() == list("hk" * 20)
    whole = {k: shown("\n".join(v)) for k, v in references.items()}
    assert model.phrases(texts[:4])[0].tolist() == [[parsed(whole[g], shown(t)) for g in ("en", "h", "k")] for t in texts[:4]]


def test_references_come_from_whole_texts(documents):
    """Excerpts lie anywhere in a text; no row is left out because it is long."""
    rows = [(i, "a" * 2000 + f"b{'c' * 5000}" + "d" * 3000, "xx", "s") for i in range(200)]
    model = langid.train(documents(rows).withColumn("text", F.concat("text", F.col("doc_id").cast("string"))))
    assert model.langs == ["xx"] and {chr(c) for c in model.letters} >= {"a", "c", "d"}
    assert 40 * langid.REFERENCE_CHARS < 2 ** model.cost[0] <= langid.REFERENCE_ROWS * (langid.REFERENCE_CHARS + 1) + 1


# BPE ----------------------------------------------------------------------
@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    found = Tokenizer.from_file(bpe.default_tokenizer())
    found.no_truncation()
    found.no_padding()
    return found


def ids_of(library, text):
    return np.array(library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


_CHARS = st.sampled_from([*"abcXYZ 0129'.!\t\n\r", "'ll", "'s", "  ", "\x85", "\xa0", "\x1c", " ", "　", "᠎", "é", "漢", "🙂", "́", "Ⅷ", "<|endoftext|>", "\x00"])


@settings(max_examples=150, deadline=None)
@given(st.lists(_CHARS, max_size=60).map("".join), st.lists(_CHARS, min_size=1, max_size=3).map("".join), st.integers(1, 200))
def test_bpe_equals_the_library(library, text, piece, times):
    for leaf in (16, bpe.LEAF):
        coder = bpe.tokenizer(bpe.default_tokenizer(), leaf)
        for t in (text, text + piece * times):
            got = coder.encode(t)
            assert got == ids_of(library, t)
            assert coder.decode(got) == library.decode(np.frombuffer(got, "<u4").tolist(), skip_special_tokens=False)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.text(st.sampled_from("abcXYZ 019'.!é漢🙂Ⅷ\x85\xa0"), max_size=20), st.sampled_from([" ", "\n", "  ", "\t ", " \n\n", "'s ", "\u3000"])), min_size=60, max_size=120))
def test_bpe_joins_halves_of_texts(library, parts):
    text = "".join(a + b for a, b in parts)
    coder = bpe.ByteBpe(bpe.default_tokenizer(), 256)
    assert coder.encode(text) == ids_of(library, text)
    if len(text) > 256 and not coder._long_runs(text):
        assert coder.joins["text"] >= len(text) // 512


def test_bpe_tree_carries_documents_of_the_table(library):
    """At the production leaf, whole documents are encoded by halves and joins."""
    import pyarrow.parquet as pq

    coder = bpe.ByteBpe(bpe.default_tokenizer())
    texts = [t or "" for t in pq.read_table(f"{DATA}/documents.parquet", columns=["text"]).column("text").to_pylist()]
    assert [coder.encode(t) for t in texts] == [ids_of(library, t) for t in texts]
    assert coder.joins["text"] > 100 and sum(len(t) > bpe.LEAF for t in texts) > 50


@pytest.mark.parametrize("text", ["ab" * 30_000, " " * 30_000, "\n" * 9000 + "x", "漢" * 9000, "a" * 5000 + " b" + "!" * 9000, "7" * 20_000])
def test_bpe_of_long_unsplit_text(library, text):
    assert bpe.tokenizer(bpe.default_tokenizer()).encode(text) == ids_of(library, text)


def test_bpe_round_trip(odd, none, library):
    rows = bpe.round_trip(odd).collect()
    texts = [(r.doc_id, r.text or "") for r in odd.collect()]
    digest = lambda b: hashlib.sha256(b).hexdigest()
    want = sorted((i or 0, len(ids_of(library, t)) // 4, digest(ids_of(library, t)), digest(t.encode())) for i, t in texts)
    assert sorted((r.doc_id or 0, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in rows) == want
    clash = odd.withColumn("ids", F.lit("x")).withColumn("n_tokens", F.lit(7))
    coded = bpe.encode_ids(clash)
    assert coded.columns == [c for c in odd.columns if c != "text"] + ["n_tokens", "ids"] and {r.n_tokens for r in coded.collect()} == {7}
    assert sorted((r.doc_id or 0, bytes(r.ids)) for r in coded.collect()) == sorted((i or 0, ids_of(library, t)) for i, t in texts)
    again = bpe.decode_ids(coded.withColumn("text", F.lit("old")))
    assert sorted((r.doc_id or 0, r.text) for r in again.collect()) == sorted((i or 0, t) for i, t in texts)
    back = bpe.decode_ids(bpe.encode_ids(odd))
    assert sorted((r.doc_id or 0, r.text) for r in back.collect()) == sorted((i or 0, t) for i, t in texts)
    assert bpe.round_trip(none).count() == 0


def test_no_vocabulary_in_the_repository():
    root = Path(__file__).resolve().parents[2]
    assert not [p for p in root.rglob("*") if p.suffix in (".tiktoken", ".model") and ".git" not in p.parts]
