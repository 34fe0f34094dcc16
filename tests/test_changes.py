"""Push events, change sets and incremental updates."""

import json

import pytest
from pyspark.sql import functions as F

from callscope.operators import changes
from callscope.schema import PUSH_EVENT

SHA = "a" * 40


def push(commits, **other):
    event = {"before": "b" * 40, "after": SHA, "size": len(commits) if isinstance(commits, list) else 1, "forced": False, "created": False, "deleted": False, "commits": commits}
    return event | {"repository": {"name": "r", "full_name": "o/r", "owner": {"login": "o"}}} | other


def commit(added=(), modified=(), removed=()):
    return {"added": list(added), "modified": list(modified), "removed": list(removed)}


def events(spark, *rows):
    df = spark.createDataFrame([(k, json.dumps(r)) for k, r in enumerate(rows)], "n int, j string")
    return df.select("n", F.from_json("j", PUSH_EVENT).alias("e")).select("n", "e.*")


def test_fold_takes_the_last_state(spark):
    rows = events(spark, push([commit(added=["src/new.py"], modified=["src/old.py"]), commit(modified=["src/./new.py", "README.md"], removed=["src/old.py"])]))
    got = changes.change_set(rows, "n").first()
    assert (got.updated, got.deleted) == (["src/new.py"], ["src/old.py"])


def test_removal_wins_in_a_commit_and_addition_after(spark):
    rows = events(spark, push([commit(added=["a.py"], removed=["a.py"])]), push([commit(removed=["a.py"]), commit(added=["a.py"])]))
    got = {r.n: (r.updated, r.deleted) for r in changes.change_set(rows, "n").collect()}
    assert got == {0: ([], ["a.py"]), 1: (["a.py"], [])}


@pytest.mark.parametrize(
    "bad",
    [
        push([]), push([commit()] * 20), push([commit()], size=2), push([commit()], forced=True), push([commit()], created=True), push([commit()], deleted=True),
        push([commit()], before="0" * 40), push([commit()], after=""), push([{"added": [], "modified": []}]), push(None), push([commit()], size=None), push([commit()], after=None),
    ],
)
def test_incomplete_pushes_are_refused(spark, bad):
    assert [r[0] for r in events(spark, bad, push([commit()])).orderBy("n").select(changes.admissible()).collect()] == [False, True]


def test_repository_of_a_push(spark):
    rows = events(spark, push([commit()]), push([commit()], repository={"full_name": "x/y"}), push([commit()], repository={"name": "y"}), push([commit()], repository={"name": "y", "owner": {"name": "z"}}))
    assert [r[0] for r in rows.orderBy("n").select(changes.repository()).collect()] == ["o/r", "x/y", None, "z/y"]


def test_stale_functions(spark):
    functions = spark.createDataFrame([("r", "1", "a.py"), ("r", "2", "a.py"), ("r", None, "a.py"), ("r", "3", "b.py")], "repo_name string, entity_id string, file_path string")
    affected = spark.createDataFrame([("r", "a.py")], "repo_name string, path string")
    kept = spark.createDataFrame([("r", "1")], "repo_name string, entity_id string")
    assert {r.entity_id for r in changes.stale_functions(functions, affected, kept).collect()} == {"2", None}
