"""Limits of requests, settings, and deliveries that come twice."""

import json

import pytest

from callscope import settings
from callscope.functions import text
from callscope.streaming import push


@pytest.mark.parametrize("check, good, bad", [(settings.message, [" hi ", "x" * 10_000], ["", "  ", None, "x" * 10_001]), (settings.url, ["https://a/b"], ["", " ", "x" * 2049]), (settings.repository, ["o/r", "o/r.git", " o/r "], ["o", "ab", "a b/c", "o/r/s", "o/" + "x" * 200])])
def test_requests(check, good, bad):
    for value in good:
        assert check(value) == value.strip().removesuffix(".git")
    for value in bad:
        with pytest.raises(ValueError):
            check(value)


def test_settings_come_from_the_environment():
    assert settings.Settings.load({}) == settings.Settings()
    found = settings.Settings.load({"CALLSCOPE_ROOT": "/x", "CALLSCOPE_DIMENSIONS": "8"})
    assert (found.root, found.dimensions) == ("/x", 8)


def test_deliveries_count_once(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for k, ids in enumerate((["a", "b"], ["a", "c", "c"])):
        (tmp_path / f"in/{k}.json").write_text("\n".join(json.dumps({"id": i, "at": f"2024-01-01T00:0{k}:00Z"}) for i in ids))
    events = spark.readStream.schema("id string, at timestamp").option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    query = push.once(events, "id", "at").writeStream.format("memory").queryName("deliveries").trigger(availableNow=True).start()
    query.awaitTermination()
    assert sorted(r.id for r in spark.table("deliveries").collect()) == ["a", "b", "c"]


def test_token_counts_agree(spark):
    """The JVM's pattern counts what the Python one does."""
    texts = ["def f(x):", "a_b __init__ été 12345 1 22 x9y", "日本語 漢字", "", "  ", "…—\t\n(){}", "naïve_1 Ⅷ ²"]
    df = spark.createDataFrame([(t,) for t in texts], "v string")
    assert [r.n for r in df.select(text.token_counter()("v").alias("n")).collect()] == [text.count_tokens(t) for t in texts]


def test_embedded_definitions(spark):
    """Each definition has the provider's vector of its own text."""
    from callscope.functions.identity import embedding_text
    from callscope.operators.vectors import hash_embedder
    from callscope.plans.registry import QUERIES
    from callscope.plans.sample import definitions

    data = "/root/testdata/sf0.001"
    defs = definitions(spark, data)
    texts = {r.entity_id: r.t for r in defs.select("entity_id", embedding_text(defs["qualified_name"], defs["file_path"]).alias("t")).collect()}
    got = {r.entity_id: list(r.embedding) for r in QUERIES["embed_definitions"](spark, data).collect()}
    assert got == {i: hash_embedder()([t.strip()])[0] for i, t in texts.items()}
