"""Approximate vector search: an index of signatures that a scan can skip through, and exact ranking of what it finds.

Each vector has a signature in several tables: on which side of random planes it lies.  The
index has a row per vector and table, sorted by signature, so a search reads the row
groups of its own signatures only.  A search also looks up the signatures that differ in the
planes nearest to the query.  What it finds is ranked by exact cosine.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callscope.operators.vectors import DEFAULT_K, clamp, cosine

#: Tables, planes of each, planes nearest to a query that are crossed, and how many of them at once.
TABLES, PLANES, NEAR, FLIPS, SEED = 8, 12, 8, 3, 11


def _planes(dimensions: int, tables: int, planes: int) -> np.ndarray:
    return np.random.default_rng([SEED, dimensions]).standard_normal((tables, planes, dimensions))


def index(functions: DataFrame, dimensions: int, tables: int = TABLES, planes: int = PLANES) -> DataFrame:
    """(signature, repo_name, entity_id, function_name, file_path, embedding), ``tables`` rows for each function with a vector of ``dimensions`` that is not zero.

    Written as it comes, in ranges of signatures, it can be searched without being read.
    """
    sides = _planes(dimensions, tables, planes)
    powers = np.int64(1) << np.arange(planes, dtype=np.int64)

    @F.pandas_udf("array<bigint>")
    def signatures(vectors: pd.Series) -> pd.Series:
        v = np.array(vectors.tolist(), float).reshape(-1, dimensions)
        found = (np.einsum("tpd,nd->ntp", sides, v) > 0) @ powers + (np.arange(tables, dtype=np.int64) << planes)
        return pd.Series(found.tolist())

    rows = functions.where((F.size("embedding") == dimensions) & F.exists("embedding", lambda x: x != 0))
    rows = rows.select("repo_name", "entity_id", F.coalesce("qualified_name", "name").alias("function_name"), "file_path", "embedding")
    rows = rows.select(F.explode(signatures("embedding")).alias("signature"), "*")
    return rows.repartitionByRange("signature", "entity_id").sortWithinPartitions("signature")


def probes(query: list[float], tables: int = TABLES, planes: int = PLANES, near: int = NEAR, flips: int = FLIPS) -> list[int]:
    """Signatures to look up: those of the query, and those with up to ``flips`` of its ``near`` nearest planes crossed."""
    margins = _planes(len(query), tables, planes) @ np.asarray(query, float)
    out = []
    for t in range(tables):
        own = sum(1 << p for p in range(planes) if margins[t, p] > 0)
        close = np.argsort(np.abs(margins[t]), kind="stable")[:near].tolist()
        out += [(t << planes) | own ^ sum(1 << p for p in some) for k in range(flips + 1) for some in combinations(close, k)]
    return out


def search(indexed: DataFrame, query: list[float], k: int = DEFAULT_K, repo: str | None = None, **layout) -> DataFrame:
    """function_name, file_path, score of the nearest functions that the index finds, best first; of one repository if named.

    ``layout`` as in :func:`index` and :func:`probes`.  Fewer than k rows come back where the
    looked up signatures hold fewer.
    """
    rows = indexed.where(F.col("signature").isin(probes(query, **layout)))
    if repo is not None:
        rows = rows.where(F.col("repo_name") == repo)
    vector = F.array(*(F.lit(float(x)) for x in query))
    scored = rows.withColumn("score", cosine(F.col("embedding"), vector)).groupBy("repo_name", "entity_id").agg(F.first("function_name").alias("function_name"), F.first("file_path").alias("file_path"), F.first("score").alias("score"))
    best = scored.where(F.col("score").isNotNull()).orderBy(F.col("score").desc(), "entity_id").limit(clamp(k))
    return best.select("function_name", "file_path", "score").orderBy(F.col("score").desc(), "function_name")
