"""Embeddings: exact cosine search, inputs embedded once, and a provider that needs no network."""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from callscope.functions.identity import embedding_text

DEFAULT_K, MOST_K = 5, 20


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a.cast("array<double>"), b.cast("array<double>"), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two vectors; null if one is zero or null, or their lengths differ."""
    size = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.size(a) == F.size(b)) & (size > 0), dot(a, b) / size)


def clamp(k: int) -> int:
    return max(1, min(k, MOST_K))


def top_k(functions: DataFrame, query: list[float], k: int = DEFAULT_K, repo: str | None = None, prefilter: bool = False) -> DataFrame:
    """function_name, file_path, score of the nearest functions by cosine, best first.

    The search is over all repositories; the repository is filtered afterwards, so fewer
    than k rows may remain.  ``prefilter`` searches in the repository instead.
    """
    at = F.lit(True) if repo is None else F.col("repo_name") == repo
    rows = functions.where(at) if prefilter else functions
    vector = F.array(*(F.lit(float(x)) for x in query))
    scored = rows.select("repo_name", "entity_id", F.coalesce("qualified_name", "name").alias("function_name"), "file_path", cosine(F.col("embedding"), vector).alias("score"))
    best = scored.where(F.col("score").isNotNull()).orderBy(F.col("score").desc(), "entity_id").limit(clamp(k))
    return best.where(at).select("function_name", "file_path", "score").orderBy(F.col("score").desc(), "function_name")


def hash_embedder(dimensions: int = 64):
    """Embeds texts without a model: signed feature hashing of words, unit length."""

    def embed(texts: list[str]) -> list[list[float]]:
        out = []
        for text in texts:
            v = np.zeros(dimensions)
            for word in text.lower().split():
                h = hashlib.blake2b(word.encode(), digest_size=8).digest()
                v[int.from_bytes(h[:4], "little") % dimensions] += 1 if h[4] & 1 else -1
            n = np.linalg.norm(v)
            out.append((v / n if n else v).astype(np.float32).tolist())
        return out

    return embed


def embed_texts(texts: DataFrame, provider, dimensions: int, request: int = 512) -> DataFrame:
    """(text, embedding) of distinct texts (column text); ``provider`` maps up to ``request`` texts to vectors.

    Blank texts are an error, as are vectors of another length.
    """
    trimmed = texts.select(F.trim("text").alias("text")).distinct()

    def run(batches):
        for pdf in batches:
            for at in range(0, len(pdf), request):
                part = pdf["text"].iloc[at : at + request].tolist()
                if not all(part):
                    raise ValueError("a text to embed must not be blank")
                got = provider(part)
                if len(got) != len(part) or any(len(v) != dimensions for v in got):
                    raise ValueError("the provider returned other vectors than asked for")
                yield pd.DataFrame({"text": part, "embedding": got})

    return trimmed.mapInPandas(run, "text string, embedding array<float>")


def known_embeddings(functions: DataFrame) -> DataFrame:
    """(text, embedding) of the functions that have a vector, as a cache for :func:`embed_functions`."""
    text = F.trim(embedding_text(F.col("qualified_name"), F.col("file_path")))
    return functions.where(F.col("embedding").isNotNull()).select(text.alias("text"), "embedding").dropDuplicates(["text"])


class EmbeddingCache:
    """Vectors by model and text in Parquet under ``root``, so nothing is embedded twice across ingests.

    Each model and dimension has a folder; writers add files beside each other, and of a
    text that two of them added at once either vector serves.
    """

    def __init__(self, spark, root: str, model: str, dimensions: int):
        self.spark, self.dimensions = spark, dimensions
        self.path = f"{root.rstrip('/')}/model={hashlib.blake2b(model.encode(), digest_size=12).hexdigest()}/dimensions={dimensions}"

    def read(self) -> DataFrame:
        """(text, embedding), empty if nothing was stored."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        if not path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path):
            return self.spark.createDataFrame([], "text string, embedding array<float>")
        return self.spark.read.schema("text string, embedding array<float>").parquet(self.path)

    def add(self, functions: DataFrame) -> None:
        """Store the vectors of functions whose texts the cache lacks."""
        fresh = known_embeddings(functions).where(F.size("embedding") == self.dimensions)
        fresh.join(self.read().select("text"), "text", "left_anti").write.mode("append").parquet(self.path)


def embed_functions(functions: DataFrame, provider, dimensions: int, cache: DataFrame | None = None) -> DataFrame:
    """Functions with their embedding: each distinct input is embedded once, and not at all if the cache (text, embedding) has it in the right length."""
    rows = functions.drop("embedding").withColumn("text", embedding_text(F.col("qualified_name"), F.col("file_path")))
    texts = rows.select(F.trim("text").alias("text")).distinct()
    if cache is None:
        known = embed_texts(texts, provider, dimensions)
    else:
        good = cache.where(F.size("embedding") == dimensions).select("text", "embedding").dropDuplicates(["text"])
        fresh = embed_texts(texts.join(good, "text", "left_anti"), provider, dimensions)
        known = good.join(texts, "text", "left_semi").unionByName(fresh)
    return rows.withColumn("text", F.trim("text")).join(known, "text", "left").drop("text")
