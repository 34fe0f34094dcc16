"""Paths, entity ids and other scalar functions."""

import hashlib
import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from callscope.functions import identity, text, view


def column(spark, values, kind="string"):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")


def results(df, c):
    return [r[0] for r in df.orderBy("i").select(c).collect()]


def test_paths_are_normalised(spark):
    df = column(spark, ["src/./payments.py", "src\\payments.py", "a/../src//payments.py", "src/payments.py", None])
    assert results(df, identity.normalize_path(F.col("v"))) == ["src/payments.py"] * 4 + [None]


@pytest.mark.parametrize("path", ["/absolute/x.py", "../escape.py", "C:\\root\\x.py", "", ".", "a/..", "a/../../b/c"])
def test_paths_outside_are_rejected(spark, path):
    df = column(spark, [path])
    assert results(df, identity.is_repository_path(F.col("v"))) == [False]
    with pytest.raises(Exception, match="not a path inside a repository"):
        results(df, identity.normalize_path(F.col("v")))


def test_entity_id_is_the_hash_of_a_compact_array(spark):
    fields = ["o/r", "src/a.py", "python", 'A."quoted"\t\u2028é', "signature:(x);occurrence:1"]
    want = "fn:v1:" + hashlib.sha256(json.dumps(fields, ensure_ascii=False, separators=(",", ":")).encode()).hexdigest()
    df = spark.createDataFrame([(0, " o/r\n", "src\\.\\a.py", " Python ", fields[3], "\u00a0" + fields[4])], "i int, r string, p string, l string, q string, d string")
    assert results(df, identity.entity_id(*(F.col(c) for c in "rplqd"))) == [want]
    assert identity.canonical_id(fields) == want


@settings(max_examples=5, deadline=None)
@given(st.lists(st.text(st.characters(codec="utf-8"), min_size=1).filter(lambda s: s.strip()), min_size=20, max_size=20))
def test_entity_ids_agree_with_python(spark, names):
    df = column(spark, names)
    found = results(df, identity.entity_id(F.lit("o/r"), F.lit("a.py"), F.lit("go"), F.col("v"), F.lit("d"), normalized=True))
    assert found == [identity.canonical_id(["o/r", "a.py", "go", n.strip(), "d"]) for n in names]


def test_blank_fields_have_no_id(spark):
    df = column(spark, ["", "  ", None])
    assert results(df, identity.entity_id(F.lit("o/r"), F.lit("a.py"), F.lit("go"), F.col("v"), F.lit("d"))) == [None] * 3


def test_repository_names(spark):
    df = column(spark, ["o/r", " o/r.git ", "o", "o/r/x", "o /r"])
    assert results(df, identity.repository_name(F.col("v"))) == ["o/r", "o/r", None, None, None]
    df = column(spark, ["https://github.com/o/r.git", "https://www.github.com/o/r/", "http://github.com/o/r", "https://example.com/o/r", "https://github.com/o%2Fr"])
    assert results(df, identity.repository_of_url(F.col("v"))) == ["o/r", "o/r", None, None, "o/r"]


def test_languages_by_suffix(spark):
    df = column(spark, ["a/B.PY", "x.jsx", "x.tsx", "Makefile", "a.b/c", "x.rs", ".py"])
    assert results(df, text.language(F.col("v"))) == ["python", "javascript", "tsx", None, None, None, None]


def test_signature_check(spark):
    import hmac

    body = b'{"a":1}'
    good = "sha256=" + hmac.new(b"key", body, hashlib.sha256).hexdigest()
    df = spark.createDataFrame([(0, bytearray(body), good), (1, bytearray(body), "sha256=00"), (2, bytearray(body), None), (3, None, good)], "i int, b binary, h string")
    assert results(df, text.hmac_valid("key")(F.col("b"), F.col("h"))) == [True, False, False, False]


def test_saved_tokens(spark):
    df = spark.createDataFrame([(0, 1000, 125), (1, 0, 10), (2, 10, 30)], "i int, t long, c long")
    saved, percent = text.saved_tokens(F.col("t"), F.col("c"))
    assert [tuple(r) for r in df.orderBy("i").select(saved, percent).collect()] == [(875, 87.5), (0, 0.0), (-20, -200.0)]


def test_message_text(spark):
    df = column(spark, ["plain", '[{"type":"text","text":"a"},{"type":"text","text":"b"}]', None])
    assert results(df, text.message_text(F.col("v"))) == ["plain", "ab", None]


def test_token_counts(spark):
    assert results(column(spark, ["def f(x):", "", None, "  "]), text.token_counter()(F.col("v"))) == [6, 0, 0, 0]


def test_colours_and_names(spark):
    df = column(spark, [1, None, 8], "bigint")
    assert results(df, view.color(F.col("v"))) == ["hsl(137.5, 70%, 55%)", "#64748b", "hsl(20, 70%, 55%)"]
    df = spark.createDataFrame([(0, " Auth ", 1), (1, "", 2), (2, None, None)], "i int, n string, c bigint")
    assert results(df, view.community_name(F.col("n"), F.col("c"))) == ["Auth", "Cluster #2", None]
    df = spark.createDataFrame([(0, "", "n", "p"), (1, None, None, "p")], "i int, q string, n string, p string")
    assert results(df, view.node_label(F.col("q"), F.col("n"), F.col("p"), F.lit("File"))) == ["n", "p"]
