"""Approximate search against the exact one."""

import numpy as np

from callscope.operators import ann, vectors


def test_recall_and_skipping(spark, tmp_path):
    rng = np.random.default_rng(5)
    centres = rng.standard_normal((40, 32))
    rows = [("a" if i % 2 else "b", f"{i:05d}", f"n{i}", None, "f", (centres[i % 40] + 0.35 * rng.standard_normal(32)).tolist()) for i in range(2000)]
    rows += [("a", "x", "zero", None, "f", [0.0] * 32), ("a", "y", "short", None, "f", [1.0]), ("a", "z", "none", None, "f", None)]
    functions = spark.createDataFrame(rows, "repo_name string, entity_id string, name string, qualified_name string, file_path string, embedding array<float>")
    ann.index(functions, 32).write.parquet(str(tmp_path / "index"))
    stored = spark.read.parquet(str(tmp_path / "index"))
    assert stored.count() == 2000 * ann.TABLES
    found = total = 0
    for k in range(6):
        query = (centres[k] + 0.35 * rng.standard_normal(32)).tolist()
        exact = [r.function_name for r in vectors.top_k(functions, query, 10).collect()]
        near = ann.search(stored, query, 10)
        got = {r.function_name: r.score for r in near.collect()}
        found += len(set(exact) & set(got))
        total += len(exact)
    assert found >= 0.9 * total
    assert "In(signature" in near._jdf.queryExecution().executedPlan().toString()  # row groups are skipped
    assert all(r.score <= 1 for r in ann.search(stored, query, 5, "a").collect())
    assert ann.search(stored, query, 5, "none").count() == 0
