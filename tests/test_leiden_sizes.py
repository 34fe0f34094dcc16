"""Leiden gives the same communities wherever it runs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from callscope.operators import community
from callscope.operators.store import empty
from callscope.schema import TABLES


def graph_of(spark, n, seed, repos=("o/r",)):
    """Functions in files of five that call at random, mostly inside blocks of 20, some themselves."""
    rng = np.random.default_rng(seed)
    g = empty(spark)
    blank = dict.fromkeys(c.split()[0] for c in TABLES["functions"].split(", "))
    rows, files, calls = [], [], []
    for repo in repos:
        files += [(repo, f"f{k}.py", None) for k in range(0, n, 5)]
        rows += [tuple((blank | {"repo_name": repo, "entity_id": f"{i:03}", "name": f"n{i}", "qualified_name": f"n{i}", "file_path": f"f{i // 5 * 5}.py"}).values()) for i in range(n)]
        pairs = {(i, int(rng.integers(i // 20 * 20, min(i // 20 * 20 + 20, n)) if rng.random() < 0.8 else rng.integers(0, n))) for i in range(n) for _ in range(4)}
        calls += [(repo, f"{i:03}", "Function", f"{j:03}", "lexical_scope", 1, "f") for i, j in sorted(pairs)]
    g.functions, g.files, g.calls = spark.createDataFrame(rows, TABLES["functions"]), spark.createDataFrame(files, TABLES["files"]), spark.createDataFrame(calls, TABLES["calls"])
    return g


def test_joins_and_kernel_agree(spark):
    g = graph_of(spark, 40, 3)
    edges = community.cut(community.projection(g))
    want = {(r.repo_name, r.entity_id): r.leiden_community for r in community.detect(g, 10**6, edges).collect()}
    assert len(want) == 40 and 1 < len(set(want.values())) < 20
    for limit in (0, 40):  # joins to the end, and joins up to a level that one task takes over
        assert {(r.repo_name, r.entity_id): r.leiden_community for r in community.detect(g, limit, edges).collect()} == want


def test_numbers_run_from_zero(spark):
    found = community.detect(graph_of(spark, 40, 1)).agg(F.min("leiden_community"), F.max("leiden_community"), F.count_distinct("leiden_community")).first()
    assert found[0] == 0 and found[1] >= found[2] - 1 < 40


@pytest.mark.parametrize("r", [0, 1, 7])
def test_turns_are_alike_for_arrays_and_columns(spark, r):
    ids = np.concatenate([np.arange(200), np.array([2**31 - 1, 2**30 + 12345])])
    got = [x[0] for x in spark.createDataFrame([(int(i),) for i in ids], "id bigint").select(community._mixed(F.col("id"), r)).collect()]
    assert got == community._mixed(ids, r).tolist()
