"""Token files, WARC files and page extraction."""

import base64
import gzip
import hashlib
import random
import zlib

import numpy as np
import pytest

from callscope.llm import bpe, files, html, tokenfile, warc


# Token files --------------------------------------------------------------
def expected(docs):
    coder = bpe.tokenizer(bpe.default_tokenizer())
    rows, at = [], 0
    for r in sorted(docs.collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.text or "")):
        ids = np.append(np.frombuffer(coder.encode(r.text or ""), "<u4"), np.uint32(tokenfile.END_ID)).astype("<u4").tobytes()
        rows.append((r.doc_id, at, len(ids) // 4, zlib.crc32(ids), ids))
        at += len(ids) // 4
    return rows


def test_ids_survive_their_files(documents, tmp_path):
    rng = random.Random(1)
    docs = documents([(i, " ".join(rng.choices("alpha beta gamma delta".split(), k=rng.randint(0, 80))), "en", "s") for i in rng.sample(range(10_000), 300)])
    manifest, dictionary = tokenfile.write_ids(docs, folder=str(tmp_path / "ids"), file_bytes=1500)
    assert manifest.count() > 4
    got = sorted(tuple(r) for r in tokenfile.read_ids(manifest, dictionary).collect())
    assert [(i, s, n, c, bytes(b)) for i, s, n, c, b in got] == expected(docs)
    row = manifest.orderBy("start").first()
    reader = tokenfile.Reader(row.file, files.read_bytes(dictionary))
    assert reader.document(1).astype("<u4").tobytes() == expected(docs)[1][4]
    with pytest.raises(ValueError, match="another dictionary"):
        tokenfile.Reader(row.file, b"other")
    (tmp_path / "cut").write_bytes(files.read_bytes(row.file)[:-3])
    with pytest.raises(ValueError):
        tokenfile.Reader(str(tmp_path / "cut"), files.read_bytes(dictionary))


def test_ids_of_odd_rows(odd, none):
    rows = tokenfile.read_ids(*tokenfile.write_ids(odd), with_ids=False).collect()
    want = expected(odd)
    assert sorted((r.doc_id or 0, r.n_tokens, r.ids_crc32) for r in rows) == sorted((i or 0, n, c) for i, _, n, c, _ in want)
    at = 0
    for r in sorted(rows, key=lambda r: r.start):
        assert r.start == at
        at += r.n_tokens
    assert [r.doc_id for r in sorted(rows, key=lambda r: r.start)] == [w[0] for w in want]
    assert tokenfile.read_ids(*tokenfile.write_ids(none)).count() == 0


# WARC ---------------------------------------------------------------------
def pages(spark, rows):
    return spark.createDataFrame([(i, u, h, "x", 1) for i, u, h in rows], "page_id bigint, url string, html string, digest string, size int").repartition(2)


def test_warc_round_trip(spark, tmp_path):
    rng = random.Random(2)
    texts = ["".join(rng.choices("<p>abc é</p>\r\n", k=rng.randint(0, 3000))) for _ in range(60)] + ["", "WARC/1.1\r\n\r\n", "x" * 300_000]
    rows = [(i, f"http://a/{i}\r\nX-Page-ID: 9", texts[rng.randrange(len(texts))]) for i in range(300)] + [(400, None, None)]
    manifest = warc.write_warc(pages(spark, rows), str(tmp_path / "warc"), file_bytes=20_000)
    assert manifest.count() > 2
    first = {}
    for i, _, h in rows:
        first[h or ""] = min(i, first.get(h or "", i))
    want = []
    for i, _, h in rows:
        data = (h or "").encode()
        again = first[h or ""] != i
        want.append((i, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "revisit" if again else "response", first[h or ""] if again else None, None if again else data))
    for split in (1000, 16 << 20):  # many ranges a file, or one
        got = sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to, r.payload and bytes(r.payload) or (b"" if r.record_type == "response" else None)) for r in warc.read_warc(manifest, split).collect()), key=lambda r: r[0])
        assert got == sorted(want)


def test_warc_members_are_plain_gzip(spark, tmp_path):
    manifest = warc.write_warc(pages(spark, [(1, "http://a/", "<p>é</p>")]), str(tmp_path / "warc"))
    data = gzip.decompress(files.read_bytes(manifest.first().file))
    assert data.startswith(b"WARC/1.1\r\nWARC-Type: response\r\n") and data.endswith("<p>é</p>\r\n\r\n".encode())


def stored(payload):
    """A record whose member keeps its bytes as they are, so whatever the payload holds shows in the file."""
    block = zlib.compressobj(0, zlib.DEFLATED, 31)
    http = b"HTTP/1.1 200 OK\r\n\r\n" + payload
    digest = base64.b32encode(hashlib.sha1(payload).digest())
    head = b"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <x>\r\nWARC-Payload-Digest: sha1:%s\r\nX-Page-ID: %d\r\nContent-Length: %d\r\n\r\n" % (digest, len(payload), len(http))
    return block.compress(head + http + b"\r\n\r\n") + block.flush()


def read_file(spark, path, split, records=None):
    rows = [(str(path), path.stat().st_size, records)]
    manifest = spark.createDataFrame(rows, "file string, size bigint, records bigint")
    return sorted(bytes(r.payload) for r in warc.read_warc(manifest if records is not None else manifest.drop("records"), split).collect())


def test_magic_inside_a_payload_is_no_record(tmp_path):
    noise = b"".join(bytes([0x1F, 0x8B, 8, k]) for k in range(200)) + gzip.compress(b"WARC/0.0 no header")
    one = stored(noise)
    path = tmp_path / "x.warc.gz"
    path.write_bytes(one * 3)
    whole = [at for at, _ in warc.members(str(path), 0, len(one) * 3)]
    assert whole == [0, len(one), 2 * len(one)]
    store, place = files.locate(str(path))
    with store.open_input_file(place) as file:
        parts = [warc.find(file, k, k + 97, 3 * len(one)) for k in range(1, 3 * len(one), 97)]
    assert [p for p in parts if p is not None] == whole[1:]


def test_records_inside_a_payload_are_no_records(spark, tmp_path):
    """An archive in a stored block: ranges that begin inside it are set right, whatever their size."""
    inner = b"".join(warc.record(k, "u", bytes([65 + k]) * 50, "X") for k in range(4))
    payloads = [b"a" * 10, inner, b"", inner + b"tail", b"z" * 500]
    path = tmp_path / "y.warc.gz"
    path.write_bytes(b"".join(map(stored, payloads)))
    for split in (64, 300, 501, 1000, 1 << 20):
        assert read_file(spark, path, split, len(payloads)) == sorted(payloads)


def test_broken_archives_are_errors(spark, tmp_path):
    good = b"".join(warc.record(k, f"http://a/{k}", b"<p>%d</p>" % k * 40, base64.b32encode(hashlib.sha1(b"<p>%d</p>" % k * 40).digest()).decode()) for k in range(6))
    path = tmp_path / "z.warc.gz"
    path.write_bytes(good)
    assert len(read_file(spark, path, 200, 6)) == 6
    edges = [at for at, _ in warc.members(str(path), 0, len(good))]
    broken = {
        "flipped in a body": good[: edges[2] + 60] + bytes([good[edges[2] + 60] ^ 0xFF]) + good[edges[2] + 61 :],
        "flipped in a magic": good[: edges[3]] + b"\0" + good[edges[3] + 1 :],
        "truncated": good[:-9],
        "bytes between": good[: edges[1]] + b"garbage" + good[edges[1] :],
    }
    for data in broken.values():
        path.write_bytes(data)
        for split in (200, 1 << 20):
            with pytest.raises(Exception, match="broken record|ends early"):
                read_file(spark, path, split)
    path.write_bytes(good[: edges[5]])  # whole records, but one too few
    for split in (200, 1 << 20):
        with pytest.raises(Exception, match="5 records, 6 were written"):
            read_file(spark, path, split, 6)


def test_warc_of_odd_rows(spark):
    rows = [(None, "u", "same"), (5, None, "same"), (5, "v", "same"), (3, "", None), (4, "w", ""), (None, None, "alone")]
    got = sorted(((r.page_id, r.payload_bytes, r.record_type, r.refers_to) for r in warc.round_trip(pages(spark, rows)).collect()), key=str)
    assert got == sorted([(None, 4, "revisit", 5), (5, 4, "response", None), (5, 4, "response", None), (3, 0, "response", None), (4, 0, "revisit", 3), (None, 5, "response", None)], key=str)
    assert warc.round_trip(pages(spark, rows).where("false")).count() == 0


# HTML ---------------------------------------------------------------------
def test_weights_find_generated_pages():
    """Pages with telling tags or classes nearly all, bare ones (nothing but div and random classes) mostly."""
    weights, right = html.weights(), {True: [], False: []}
    for text in html.labelled_pages(200, seed=77):
        page = html.Page(text, weights)
        a, b = page.region(weights)
        skip = page.left_out(a, b)
        marked = "<main" in text or "<article" in text or any(f'class="{c}"' in text for c in "content post entry article story main-content post-body article-text".split())
        right[marked].append(all((a <= k < b and not skip[k]) == label for k, label in enumerate(page.label) if page.words[k]))
    assert sum(right[True]) >= 0.95 * len(right[True]) and sum(right[False]) >= 0.5 * len(right[False]) and len(right[False]) > 20


@pytest.mark.parametrize("seed", range(3))
def test_best_region_against_brute_force(seed):
    """Over random scores, and over those of real pages: no contiguous region scores higher."""
    rng = random.Random(seed)
    weights = html.weights()
    rows = [[rng.choice((-3, -1, -0.5, 0, 0.5, 1, 2)) for _ in range(rng.randint(0, 40))] for _ in range(200)] + [html.Page(p, weights).scores(weights)[:300] for p in html.labelled_pages(6, seed=seed)]
    for scores in rows:
        a, b = html.best_region(scores)
        best = max([0.0, *(sum(scores[i:j]) for i in range(len(scores)) for j in range(i + 1, len(scores) + 1))]) if len(scores) <= 40 else max(np.subtract.outer(c := np.concatenate([[0], np.cumsum(scores)]), c)[np.tril_indices(len(c))])
        assert abs(sum(scores[a:b]) - best) < 1e-6 and (a, b) != (0, 0) or best == 0


@pytest.mark.parametrize("inside", ['<section id="related-work"><h2>K</h2><p>kept words</p></section>', '<p class="notice">kept words</p>', '<p class="text-share-price">kept words</p>', '<h2 id="search-trees">kept words</h2>', '<div id="tags-in-html"><p>kept words</p></div>', '<p class="meta">kept words</p>', "<ul><li><a href=x>kept words</a><li><a href=y>more</a></ul>", "<table><tr><td>kept words<td>more</table>"])
def test_article_keeps_its_blocks(inside):
    text = html.extract_text(f"<body><nav><a href=x>Home</a></nav><article><h1>T</h1><p>{'main words ' * 30}</p>{inside}<p>{'last words ' * 20}</p></article><footer>&copy; x</footer>")
    assert "kept words" in text and text.startswith("T\nmain words") and text.endswith("last words")


@pytest.mark.parametrize("inside", ['<div class="share"><ul><li><a href=1>gone</a><li><a href=2>gone</a></ul></div>', '<div class="ad-banner">gone <p>gone</p></div>', "<form><p>gone x</p><label>gone</label></form>", "<aside>gone beside the text</aside>", '<div class="comments"><p>gone reader says this</p></div>', "<nav><ul><li><a href=x>gone</a></ul></nav>", "<svg><text>gone</text></svg>"])
def test_article_loses_what_is_no_part_of_it(inside):
    text = html.extract_text(f"<body><article><h1>T</h1><p>{'main words ' * 30}</p>{inside}<p>{'last words ' * 20}</p></article>")
    assert "gone" not in text and text.startswith("T\nmain words") and text.endswith("last words")


def test_scan_decides_where_nothing_is_marked():
    page = f"<div class=q1><ul><li><a href=a>Home a</a><li><a href=b>More b</a></ul></div><div class=w3><p>small advert here</p></div><div class=q9><h1>T</h1><p>{'main words ' * 30}</p><p>short</p><p>{'last words ' * 20}</p></div><div class=z2>&copy; bottom <ul><li><a>q</a></ul></div>"
    text = html.extract_text(page)
    assert text.startswith("T\nmain words") and text.endswith("last words") and "short" in text


ARTICLE = "<h1>Title &amp; more</h1><p>First  <b>bold</b>\n text &eacute;&#8364;.</p><ul><li>One item<li>Two items</ul><p>Last <a href='/x'>linked</a> words here"


@pytest.mark.parametrize(
    "page",
    [
        f"<html><head><title>no</title><script>var a = '<p>no</p>';</script></head><body><nav><ul><li><a>no</a></ul></nav><article>{ARTICLE}</article><footer>no</footer></body></html>",
        f"<body><header><h1>no site</h1></header><main>{ARTICLE}<div class='ad-banner'>no <p>no</p></div><aside>no</aside></main><div id='comments'><p>no reader says this and that and more</p></div>",
        f"<div class='cookie-notice'>no we use cookies</div><div class='post-content'>{ARTICLE}<form><label>no</label><input><button>no</button></form><style>no</style></div><div class='sidebar'><p>no no no</p></div>",
        f"<!-- <p>no --><article><header>{ARTICLE[:25]}</header>{ARTICLE[25:]}</article><script>no",
    ],
)
def test_main_text(page):
    assert html.extract_text(page) == "Title & more\nFirst bold text é€.\nOne item\nTwo items\nLast linked words here"


@pytest.mark.parametrize("page", [None, "", " ", "<html>", "<nav><a>menu</a></nav>", "<!--", "<p", "<p class='x", "<script>x"])
def test_no_main_text(page):
    assert html.extract_text(page) == ""


def test_attributes_may_hold_brackets():
    page = "<article><p title='a > b' class=\"x<y\">One <img src=\"data:" + "A" * 5000 + "\"> two 3 < 4</p></article>"
    assert html.extract_text(page) == "One two 3 < 4"


def test_hostile_pages_take_linear_time():
    for p in ("<div>" * 100_000, "<p>a" * 100_000, "</b>" * 100_000, "<!--" * 50_000, '<a title="' * 50_000, "<b><p>" * 50_000):
        html.extract_text(p)


def test_extract_table(spark):
    df = pages(spark, [(1, "u", f"<article>{ARTICLE}</article>"), (None, None, None), (2, "v", ""), (2, "v", "")])
    rows = sorted(((r.page_id, r.url, r.n_chars, len(r.text)) for r in html.extract(df).collect()), key=str)
    assert rows == [(1, "u", 74, 74), (2, "v", 0, 0), (2, "v", 0, 0), (None, None, 0, 0)]
    assert html.extract(df.where("false")).count() == 0


def test_extract_equals_the_articles_of_the_table(spark):
    import re

    for r in spark.read.parquet("/root/testdata/sf0.001/pages.parquet").collect():
        inner = r.html[r.html.index("<article>") + 9 : r.html.rindex("</article>")]
        blocks = [" ".join(html._html.unescape(re.sub("</?(b|br)>", " ", b)).split()) for b in re.split("</?(?:p|h1)>", inner)]
        assert html.extract_text(r.html) == "\n".join(b for b in blocks if b)
