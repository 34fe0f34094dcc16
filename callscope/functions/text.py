"""Tokens, signatures of requests, messages and progress."""

from __future__ import annotations

import hashlib
import hmac
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Languages by file suffix.
LANGUAGES = {".py": "python", ".js": "javascript", ".jsx": "javascript", ".ts": "typescript", ".tsx": "tsx", ".go": "go", ".java": "java"}
#: Token counting without a vocabulary: words, runs of digits up to three, single symbols.
_TOKEN = re.compile(r"[^\W\d_]+|\d{1,3}|[^\w\s]|_+")

#: The same for the JVM.
_JAVA_TOKEN = r"(?U)[\w&&[^\d_]]+|\d{1,3}|[^\w\s]|_+"


def suffix(path: Column) -> Column:
    """Lower-case suffix of a path's last part, with its dot; empty if there is none."""
    name = F.element_at(F.split(path, "/"), -1)
    return F.lower(F.regexp_extract(name, r"^.+(\.[^.]+)$", 1))


def language(path: Column) -> Column:
    """Language by suffix; null if it is not supported."""
    table = F.create_map(*(F.lit(x) for pair in LANGUAGES.items() for x in pair))
    return F.try_element_at(table, suffix(path))


def is_supported(path: Column) -> Column:
    return suffix(path).isin(*LANGUAGES)


def count_tokens(text: str | None) -> int:
    """Tokens of one text by the pattern."""
    return len(_TOKEN.findall(text)) if text and text.strip() else 0


def token_counter(tokenizer=None):
    """Column function that counts tokens of a text; ``tokenizer`` is a callable from text to a number, by default a pattern that stays in the JVM."""
    if tokenizer is None:
        return lambda text: F.regexp_count(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")), F.lit(_JAVA_TOKEN)).cast("int")

    @F.pandas_udf(T.IntegerType())
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: tokenizer(t) if t and t.strip() else 0).astype("int32")

    return run


def hmac_valid(secret: str):
    """Column function (body binary, header string) that checks ``sha256=<hex>`` in constant time; missing parts are invalid."""

    @F.udf(T.BooleanType())
    def run(body, header) -> bool:
        if body is None or not header or not secret:
            return False
        want = "sha256=" + hmac.new(secret.encode(), bytes(body), hashlib.sha256).hexdigest()
        return hmac.compare_digest(want.encode(), header.encode("utf-8", "replace"))

    return run


def message_text(content: Column) -> Column:
    """Text of a message: itself, or the joined texts of a JSON array of text blocks."""
    blocks = F.from_json(content, "array<struct<type:string,text:string>>")
    joined = F.array_join(F.transform(F.filter(blocks, lambda b: b["text"].isNotNull()), lambda b: b["text"]), "")
    return F.when(F.startswith(F.ltrim(content), F.lit("[")) & blocks.isNotNull(), joined).otherwise(content)


def saved_tokens(total: Column, context: Column) -> tuple[Column, Column]:
    """Tokens that a context saves against the whole (may be negative), and their share in per cent; 0 for a total of 0."""
    good = total > 0
    return F.when(good, total - context).otherwise(F.lit(0).cast("long")), F.when(good, F.round((total - context) / total * 100, 2)).otherwise(0.0)


def progress_message(done: Column, total: Column, path: Column) -> Column:
    return F.format_string("Parsed %d of %d files: %s", done, total, path)


def progress_records(rows: DataFrame, low: int = 20, high: int = 80) -> DataFrame:
    """Rows (stream, seq, path) with done (1 to total, by seq), total, progress (from ``low`` to ``high`` per cent) and message, per stream."""
    w = W.partitionBy("stream")
    rows = rows.withColumns({"done": F.row_number().over(w.orderBy("seq")), "total": F.count(F.lit(1)).over(w)})
    return rows.withColumns({"progress": (low + F.floor(F.col("done") * (high - low) / F.col("total"))).cast("int"), "message": progress_message(F.col("done"), F.col("total"), F.col("path"))})


def context(rows: DataFrame, keys: list[str], order: list[str], text: str, use: Column) -> DataFrame:
    """keys and context: the texts of the rows to ``use`` (null if there are none), joined by line feeds in order."""
    mine = F.sort_array(F.collect_list(F.when(use & F.col(text).isNotNull(), F.struct(*order, text))))
    per = rows.groupBy(*keys).agg(mine.alias("m"))
    return per.select(*keys, F.when(F.size("m") > 0, F.array_join(F.transform("m", lambda x: x[text]), "\n")).alias("context"))


def ndjson(*columns: Column) -> Column:
    """A compact JSON record of the columns, without its nulls."""
    return F.to_json(F.struct(*columns))
