"""Near-duplicates of the pipeline: five-word shingles, similarity of at least 0.8, against brute force."""

import math
import random

import corpus_pipeline
import numpy as np
import pytest

from callscope.llm import shingles

DATA = "/root/testdata/sf0.001"


def shingle_set(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def kept(rows):
    """Ids that stay: the least of each connected group of near texts."""
    sets, group = [shingle_set(t) for _, t in rows], list(range(len(rows)))

    def find(x):
        while group[x] != x:
            x = group[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] == sets[j] or 10 * len(sets[i] & sets[j]) >= 8 * max(1, len(sets[i] | sets[j])):
                a, b = find(i), find(j)
                group[max(a, b)] = min(a, b)
    return sorted(rows[k][0] for k in range(len(rows)) if find(k) == k)


def copies(seed):
    rng = random.Random(seed)
    rows = [(0, None), (1, ""), (2, " \n"), (3, "one"), (4, "ONE"), (5, "one two")]
    for k in range(40):
        text = [f"w{rng.randrange(3000)}" for _ in range(rng.choice((6, 40, 150, 250)))]
        for v in range(4):
            changed = list(text)
            for _ in range(v * len(text) // 70):
                changed[rng.randrange(len(text))] = f"c{rng.randrange(9999)}"
            rows.append((10 + 4 * k + v, " ".join(changed)))
    return rows


@pytest.mark.parametrize("cap", [3, shingles.BUCKET_ROWS])
def test_drop_against_brute_force(documents, cap):
    rows = copies(5)
    got = shingles.drop_near_duplicates(documents(rows), cap=cap)
    want = kept(rows)
    assert sorted(r.doc_id for r in got.collect()) == want and len(rows) - 110 < len(want) < len(rows) - 40


def test_drop_of_odd_rows(odd, none):
    got = shingles.drop_near_duplicates(odd)
    assert got.columns == odd.columns and sorted(str(r.doc_id) for r in got.collect()) == ["1", "4", "5", "7", "8", "9", "None"]
    assert shingles.drop_near_duplicates(none).count() == 0


def test_stage_drops_what_fingerprints_keep_apart(spark):
    """Documents 1 and 177: similarity of at least 0.8, fingerprints 9 bits apart."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    rows = sorted((r.doc_id, r.text) for r in docs.collect())
    got = sorted(r.doc_id for r in corpus_pipeline.dedup_stage(spark, docs, DATA).collect())
    assert 177 not in got and got == kept(rows)


def pairs(rng, count):
    """Pairs of sets at the least similarity: of the worst small size and of larger ones."""
    for _ in range(count):
        for size, common in ((4, 4), (12, 12), (40, 36), (99, 88)):
            both = rng.integers(0, 1 << 63, common, np.uint64)
            more = common // 4 if size == common else size - common
            yield [np.unique(np.concatenate([both, rng.integers(0, 1 << 63, k, np.uint64)])) for k in (size - common, more)]


def test_fingerprint_is_the_majority_of_each_bit():
    rng = np.random.default_rng(2)
    for n in (1, 2, 254, 256, 1000):
        own = np.unique(rng.integers(0, 1 << 63, n, np.uint64))
        each = np.array([np.unpackbits(shingles.fingerprint(own[k : k + 1]).view(np.uint8)) for k in range(n)])
        assert (np.unpackbits(shingles.fingerprint(own).view(np.uint8)) == (2 * each.sum(axis=0) > n)).all()
    bits = [np.mean([np.unpackbits((shingles.fingerprint(a) ^ shingles.fingerprint(b)).view(np.uint8)).mean() for a, b in list(pairs(rng, 60))[k::4]]) for k in range(4)]
    assert abs(bits[0] - shingles.PARTED_SMALL) < 0.01 and max(bits[1:]) < shingles.PARTED + 0.01


@pytest.mark.parametrize("cap", [6, 8 * shingles.BUCKET_ROWS])
def test_fingerprints_link_all_near_pairs(spark, cap):
    """The candidates come from fingerprints alone: all pairs at the least similarity, hardly one of others."""
    sets = [s for pair in pairs(np.random.default_rng(3), 100) for s in pair]
    rows = [(k, len(s), bytearray(shingles.fingerprint(s).tobytes())) for k, s in enumerate(sets)]
    links = shingles.link_fingerprints(spark.createDataFrame(rows, "sig bigint, n bigint, fp binary").repartition(3), cap).collect()
    found = {(min(r.a, r.b), max(r.a, r.b)) for r in links}
    assert all(10 * len(np.intersect1d(sets[k], sets[k + 1])) >= 8 * len(np.union1d(sets[k], sets[k + 1])) for k in range(0, len(sets), 2))
    assert {(k, k + 1) for k in range(0, len(sets), 2)} <= found and len(found) < len(sets) // 2 + 20


def test_tables_and_radius_miss_few():
    """By an own sum: what no table joins, with keys of any length."""
    for p in (shingles.PARTED, shingles.PARTED_SMALL):
        for key_bits in (12, 16):
            n = shingles.tables(key_bits, p)
            chance = [math.comb(1024, d) * p**d * (1 - p) ** (1024 - d) * (1 - math.comb(1024 - d, key_bits) / math.comb(1024, key_bits)) ** n for d in range(700)]
            assert 0.9 * shingles.MISSED < sum(chance) <= shingles.MISSED * 1.001
    far = lambda r: sum(math.comb(256, d) * shingles.PARTED_SMALL**d * (1 - shingles.PARTED_SMALL) ** (256 - d) for d in range(r + 1, 257))
    assert far(shingles.radius()) <= shingles.MISSED < far(shingles.radius() - 1)
