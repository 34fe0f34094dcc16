import pytest
from pyspark.sql import functions as F

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, score double, _key string"


@pytest.fixture(scope="session")
def documents(spark):
    """Makes a table of documents from (id, text, lang, source), with columns whose names operators use themselves."""

    def make(rows):
        rows = [(*r, None, None)[:4] for r in rows]
        return spark.createDataFrame([(i, t, g, s, None if t is None else len(t), 0.5, "x") for i, t, g, s in rows], DOCS).repartition(3)

    return make


@pytest.fixture(scope="session")
def odd(documents):
    """Nulls everywhere, empty, blank and long texts, ties and repeated rows."""
    long = " ".join(f"word{i % 977} and" for i in range(60_000)) + " " + "x" * 50_000
    rows = [(1, None, None, None), (2, "", "en", "a"), (3, " \t\n", "en", "a"), (4, "one", None, "a"), (None, "no id here", "en", None), (5, "same text", "en", "b"), (5, "same text", "en", "b"), (6, "same text", "de", "b"), (7, long, "en", "c"), (8, "1234 567!", "en", ""), (9, "é 漢字 🙂 \x00 \x1c <|endoftext|>", "fr", "é"), (None, None, None, None)]
    return documents(rows)


@pytest.fixture(scope="session")
def none(odd):
    return odd.where(F.lit(False))
