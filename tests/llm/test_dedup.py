"""Near-duplicates by fingerprints and by vectors, and connected components."""

import random

import numpy as np
import pytest
import xxhash

from callscope.llm import simhash, vectors
from callscope.llm.components import connected_components


def roots(n, pairs):
    p = list(range(n))

    def find(x):
        while p[x] != x:
            p[x] = p[p[x]]
            x = p[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        p[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


# Components ---------------------------------------------------------------
@pytest.mark.parametrize("seed", range(2))
def test_components_of_random_links(spark, seed):
    rng = random.Random(seed)
    pairs = [(rng.randrange(120), rng.randrange(120)) for _ in range(80)] + [(200 + i, 201 + i) for i in range(40)] + [(300, 300 + i) for i in range(60)] + [(5, 5)]
    rows = connected_components(spark.createDataFrame([*pairs, (None, 3), (7, None)], "a bigint, b bigint")).collect()
    want = roots(400, pairs)
    linked = {x for a, b in pairs if a != b for x in (a, b)}
    assert {r.node: r.component for r in rows} == {x: want[x] for x in linked} and len(rows) == len(linked)


def test_components_of_nothing(spark):
    assert connected_components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


# SimHash ------------------------------------------------------------------
def fingerprint(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", low) if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def check_fingerprints(docs):
    rows = sorted(((r.doc_id, r.text) for r in docs.collect()), key=lambda r: (r[0] is None, r[0]))
    fps = [fingerprint(t) for _, t in rows]
    pairs = [(i, j) for i in range(len(rows)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 4]
    component = [rows[k][0] for k in roots(len(rows), pairs)]
    got = sorted(((r.doc_id, r.fingerprint, r.component_id) for r in simhash.near_duplicates(docs).collect()), key=str)
    assert got == sorted(((rows[i][0], f"{fps[i]:016x}", component[i]) for i in range(len(rows))), key=str)
    return component


def test_simhash_against_brute_force(documents):
    rng = random.Random(4)
    words = [f"w{i}" for i in range(400)]
    rows = [(0, None), (1, ""), (2, " "), (3, "one"), (4, "ONE")]
    for k in range(30):
        text = rng.choices(words, k=rng.choice((5, 60, 150)))
        rows += [(10 * k + 10 + v, " ".join(text[: len(text) - v])) for v in range(3)] + [(10 * k + 13, " ".join(text).upper())]
    component = check_fingerprints(documents(rows))
    assert len(set(component)) < len(rows) - 30


def test_simhash_of_odd_rows(odd, none):
    check_fingerprints(odd)
    assert simhash.near_duplicates(none).count() == simhash.drop_near_duplicates(none).count() == 0
    kept = simhash.drop_near_duplicates(odd)
    ids = sorted((r.doc_id for r in kept.collect()), key=str)
    first = {r.component_id for r in simhash.near_duplicates(odd).collect()}
    assert kept.columns == odd.columns and ids == sorted(first, key=str)


def test_fields_follow_the_number_of_fingerprints():
    assert simhash.fields(0) == simhash.fields(10**6) == 6 < simhash.fields(10**11) < simhash.fields(10**13) < 12


@pytest.mark.parametrize("cap, blocks", [(4, None), (2048, None), (2048, 8)])
def test_links_in_hot_buckets(spark, cap, blocks):
    """Many near fingerprints, dealt into blocks or not: the same classes as by all pairs."""
    rng = random.Random(9)
    base = [rng.getrandbits(64) for _ in range(4)]
    fps = sorted({b ^ sum(1 << x for x in rng.sample(range(64), rng.randint(0, 5))) for b in base for _ in range(40)})
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    links = simhash.link_fingerprints(spark.createDataFrame([(f,) for f in signed], "fp bigint"), cap=cap, blocks=blocks).collect()
    place = {f: i for i, f in enumerate(signed)}
    want = roots(len(fps), [(i, j) for i in range(len(fps)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 4])
    assert roots(len(fps), [(place[r.a], place[r.b]) for r in links]) == want
    assert all((fps[place[r.a]] ^ fps[place[r.b]]).bit_count() <= 64 for r in links)


def test_bit_planes_count_distances():
    rng = np.random.default_rng(1)
    fps = rng.integers(0, 1 << 63, 200, np.uint64)
    fps[100:] = fps[:100] ^ (np.uint64(1) << rng.integers(0, 60, 100).astype(np.uint64)) * np.uint64(7)
    planes = simhash.BitPlanes(fps)
    rows = np.repeat(np.arange(200), 4)
    words = np.tile(np.arange(4), 200)
    mask = np.where(words == 3, np.uint64(255), np.uint64(0xFFFFFFFFFFFFFFFF))
    r, w, hits = planes.near(rows, words, mask, 4)
    got = {(a, 64 * b + k) for a, b, h in zip(r.tolist(), w.tolist(), hits.tolist(), strict=True) for k in range(64) if h >> k & 1}
    assert got == {(i, j) for i in range(200) for j in range(200) if int(fps[i] ^ fps[j]).bit_count() <= 4}


# Vectors ------------------------------------------------------------------
VECTORS = "vec_id bigint, embedding array<float>, label int, key string, n bigint"


def table(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], g, "x", 1) for i, v, g in rows], VECTORS).repartition(3)


def brute(rows, threshold=0.98):
    units = []
    for _, v, g in rows:
        good = g is not None and v is not None and len(v) and all(x is not None and np.isfinite(np.float32(x)) for x in v) and any(np.float32(x) != 0 for x in v)
        a = np.asarray(v, np.float32).astype(float) if good else None
        units.append(a / np.sqrt(a @ a) if good else None)
    ok = lambda i, j: units[i] is not None and units[j] is not None and rows[i][2] == rows[j][2] and len(units[i]) == len(units[j]) and units[i] @ units[j] >= threshold
    pairs = [(i, j) for i in range(len(rows)) for j in range(i) if ok(i, j)]
    links = [0] * len(rows)
    for i, j in pairs:
        links[i] += 1
        links[j] += 1
    return links, roots(len(rows), pairs)


def got(df):
    return sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in vectors.near_vectors(df).collect())


def want(rows):
    links, root = brute(rows)
    return sorted((r[0], links[k], rows[root[k]][0], rows[root[k]][0] == r[0]) for k, r in enumerate(rows))


def test_vectors_against_brute_force(spark):
    rng = np.random.default_rng(3)
    rows, n = [], 0
    for _ in range(25):
        v = rng.standard_normal(32)
        for noise in (0.0, 0.0, 0.02, 0.05, 0.4):
            rows.append((n, v * rng.uniform(0.5, 3) + noise * rng.standard_normal(32), int(rng.integers(0, 3))))
            n += 1
    assert got(table(spark, rows)) == want(rows)


def test_vectors_with_a_hot_group(spark, monkeypatch):
    monkeypatch.setattr(vectors, "BUCKET_ROWS", 16)
    rng = np.random.default_rng(4)
    v = rng.standard_normal(16)
    rows = [(i, v + 0.03 * rng.standard_normal(16), 1) for i in range(150)] + [(200 + i, v, 1) for i in range(100)] + [(400 + i, rng.standard_normal(16), 1) for i in range(50)]
    assert got(table(spark, rows)) == want(rows)


def test_recall_at_the_threshold(spark):
    """Pairs at cosine 0.98 exactly enough to count: at least nine in ten are found."""
    rng = np.random.default_rng(6)
    rows = []
    for k in range(400):
        a, b = rng.standard_normal((2, 24))
        a /= np.linalg.norm(a)
        b -= (b @ a) * a
        b /= np.linalg.norm(b)
        rows += [(2 * k, a, 0), (2 * k + 1, 0.9805 * a + np.sqrt(1 - 0.9805**2) * b, 0)]
    total = sum(r.n_links for r in vectors.near_vectors(table(spark, rows)).collect())
    assert total >= 0.95 * sum(brute(rows)[0])


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, None, 1), (2, [], 1), (3, [0.0, 0.0], 1), (4, [1.0, None], 1), (5, [nan, 1.0], 1), (6, [inf, 1.0], 1), (7, [1.0, 0.0], None), (8, [1.0, 0.0], 1), (9, [2.0, 0.0], 1), (10, [1.0, 0.0, 0.0], 1), (11, [1.0, 0.0], 2), (12, [-0.0, -1.0], 3), (13, [0.0, -1.0], 3), (8, [1.0, 0.0], 1)]
    assert got(table(spark, rows)) == want(rows)
    assert vectors.near_vectors(table(spark, rows).where("false")).count() == 0
    out = {(r.vec_id, r.n_links, r.component_id) for r in vectors.near_vectors(table(spark, [(None, [1.0], 1), (4, [2.0], 1), (None, [1.0], 9)])).collect()}
    assert out == {(None, 1, 4), (4, 1, 4), (None, 0, None)}


def test_layout_follows_the_number_of_vectors():
    small, large = vectors.layout(1000), vectors.layout(10**9)
    assert small[0] < large[0] and small[1] < large[1] <= vectors.MOST_TABLES


def test_signs_that_part_a_pair_at_the_threshold():
    import math

    for bits in (8, 80, 700):
        most, p = vectors.most_parted(bits), math.acos(vectors.THRESHOLD) / math.pi
        tail = lambda k: sum(math.comb(bits, i) * p**i * (1 - p) ** (bits - i) for i in range(k + 1, bits + 1))  # noqa: E731, B023
        assert tail(most) <= vectors.MISSED * 1.01 and (most == bits or tail(most - 1) > vectors.MISSED * 0.99)
