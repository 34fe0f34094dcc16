"""Ingest, ask, update and delete, end to end."""

import io
import json
import uuid
import zipfile

import pytest
from pyspark.sql import functions as F

from callscope.engine import Engine
from callscope.operators import graph, vectors
from callscope.sources import files
from callscope.streaming import push

TREE = {
    "src/auth.py": "import hmac\ndef validate(token):\n    return hmac.new(token)\ndef login(user):\n    return validate(user)\n",
    "src/pay.js": "function charge(x) { return validate(x); }\nfunction refund(x) { return charge(x); }\n",
    "node_modules/lib.js": "function hidden() {}\n",
    "rebuild/x.py": "def again():\n    pass\n",
    "README.md": "text",
}


@pytest.fixture(scope="module")
def tree(tmp_path_factory):
    root = tmp_path_factory.mktemp("tree")
    for path, text in TREE.items():
        (root / path).parent.mkdir(parents=True, exist_ok=True)
        (root / path).write_text(text)
    return str(root)


@pytest.fixture(scope="module")
def engine(spark, tree, tmp_path_factory):
    e = Engine(spark, str(tmp_path_factory.mktemp("store")))
    e.ingest("o/r", tree)
    return e


def test_scans(spark, tree):
    paths = lambda df: [r.path for r in df.orderBy("path").collect()]
    assert paths(files.source_files(spark, tree)) == ["rebuild/x.py", "src/auth.py", "src/pay.js"]
    assert paths(files.seed_files(spark, tree)) == ["src/auth.py", "src/pay.js"]
    assert paths(files.script_files(spark, tree)) == ["rebuild/x.py", "src/auth.py"]


def test_structure(engine):
    assert engine.structure(" o/r ") == "rebuild/x.py\nsrc/auth.py\nsrc/pay.js"
    assert engine.structure(" ") == engine.structure("o/none") == ""
    assert engine.functions_in_file("o/r", "src/auth.py") == "Functions in src/auth.py:\n- validate\n- login"
    assert engine.functions_in_file("o/r", "x") == "No functions found in x."
    assert engine.functions_in_file("o/r", " ") == "No functions found."


def test_callers(engine):
    got = json.loads(engine.blast_radius("o/r", "validate"))
    assert [(c["caller"], c["file_paths"], c["target"]) for c in got["callers"]] == [("charge", ["src/pay.js"], "validate"), ("login", ["src/auth.py"], "validate")]
    assert json.loads(engine.blast_radius("o/r", "new"))["target_is_external"] is True
    assert json.loads(engine.blast_radius("o/r", " "))["callers"] == []


def test_dependencies(engine):
    assert engine.outgoing_dependencies("o/r", "login") == "Outgoing dependencies for login:\n- validate (src/auth.py)"
    assert engine.outgoing_dependencies("o/r", "validate") == "Outgoing dependencies for validate:\n- new (External/Built-in)"
    assert engine.outgoing_dependencies("o/r", "none") == "No outgoing dependencies found for none."
    assert engine.external_dependencies("o/r") == "External dependencies:\n- new"


def test_search_and_code(engine):
    assert engine.search("Function: login File: src/auth.py", "o/r", 1) == 'Semantic code matches for "Function: login File: src/auth.py":\n- login (src/auth.py) — similarity 1.0000'
    assert engine.search("x", "o/none").startswith("No semantic code matches")
    row = engine.graph("o/r").functions.where(F.col("name") == "charge").first()
    assert engine.node_code("o/r", row.entity_id) == {"code": "function charge(x) { return validate(x); }", "file_path": "src/pay.js", "name": "charge"}
    assert engine.node_code("o/r", "nope") is None


def test_invariants_and_metrics(engine):
    g = engine.graph("o/r")
    row = graph.integrity(g, 64).first()
    assert row.functions == row.unique_functions == row.embedded_functions == row.defines_links == 5
    assert row.invalid_defines == row.invalid_vectors == 0
    assert graph.missing_communities(g).count() == 0
    got = engine.context_metrics("o/r", "def f(x):")
    assert got["tokens_saved"] == got["total_repo_tokens"] - 6
    assert sum(r["function_count"] for r in json.loads(engine.subsystems("o/r"))) == 5
    nodes, edges = graph.payload(g)
    assert nodes.count() == 8 and "raw_code" not in json.loads(nodes.first().json)
    assert edges.count() == 9


def test_update_keeps_incoming_edges(spark, tree, tmp_path):
    e = Engine(spark, str(tmp_path / "store"))
    e.ingest("o/r", tree)
    before = {r.name: r.entity_id for r in e.graph("o/r").functions.collect()}
    fetched = {"src/auth.py": b"def validate(token):\n    return added(token)\ndef added(x):\n    return x\n"}
    e.update("o/r", "sha", ["src/auth.py"], ["rebuild/x.py"], lambda repo, path, sha: fetched[path])
    g = e.graph("o/r")
    after = {r.name: r.entity_id for r in g.functions.collect()}
    assert set(after) == {"validate", "added", "charge", "refund"} and after["validate"] == before["validate"]
    assert [c["caller"] for c in json.loads(e.blast_radius("o/r", "validate"))["callers"]] == ["charge"]
    assert e.external_dependencies("o/r") == "No external dependencies found."
    assert {r.path for r in g.files.collect()} == {"src/auth.py", "src/pay.js"}
    assert g.functions.where("embedding IS NULL").count() == 0  # an update keeps and makes vectors
    assert "- added (src/auth.py)" in e.search("Function: added File: src/auth.py", "o/r", 1)
    e.delete("o/r")
    assert e.structure("o/r") == "" and e.store.repositories() == []
    with pytest.raises(ValueError):
        e.delete(" ")


def test_files_are_fetched_and_parsed_once(spark, tree, tmp_path):
    """A counting fetcher, provider and parser: each file once per update, each text once for good."""
    log = tmp_path / "log"
    log.mkdir()

    def note(kind, what):
        (log / f"{kind}-{uuid.uuid4().hex}").write_text(str(what))

    def embedder(texts):
        for t in texts:
            note("embed", t)
        return vectors.hash_embedder(8)(list(texts))

    def seen(kind):
        return sorted(p.read_text() for p in log.glob(f"{kind}-*"))

    def fetch(repo, path, sha):
        note("fetch", path)
        return f"def one():\n    two()\ndef two():\n    return '{sha}'\n".encode()

    e = Engine(spark, str(tmp_path / "store"), embedder, 8)
    e.ingest("o/r", tree)
    assert len(seen("embed")) == 5
    e.update("o/r", "s1", ["lib/a.py", "lib/b.py"], [], fetch)
    assert seen("fetch") == ["lib/a.py", "lib/b.py"] and len(seen("embed")) == 9
    e.update("o/r", "s2", ["lib/a.py"], ["lib/b.py"], fetch)
    assert len(seen("fetch")) == 3 and len(seen("embed")) == 9  # same texts: the stored vectors serve
    total = e.context_metrics("o/r", "x")["total_repo_tokens"]
    assert total > 20


def test_embedding_cache(spark, tree, tmp_path):
    calls = tmp_path / "calls"
    calls.mkdir()

    def embedder(texts):
        (calls / uuid.uuid4().hex).write_text(str(len(texts)))
        return vectors.hash_embedder(8)(list(texts))

    made = lambda: sum(int(p.read_text()) for p in calls.iterdir())
    for store in ("one", "two"):
        e = Engine(spark, str(tmp_path / store), embedder, 8, vectors.EmbeddingCache(spark, str(tmp_path / "cache"), "hash", 8))
        e.ingest("o/r", tree)
        assert e.graph("o/r").functions.where("embedding IS NULL").count() == 0
    assert made() == 5 and vectors.EmbeddingCache(spark, str(tmp_path / "cache"), "hash", 16).read().count() == 0


def test_search_reads_all_repositories_at_once(spark, tree, tmp_path):
    e = Engine(spark, str(tmp_path / "store"))
    for repo in ("o/r", "o/s", "o/gone"):
        e.ingest(repo, tree)
    e.ingest("o/s", tree)
    e.delete("o/gone")
    rows = e.store.all_functions()
    assert sorted({r.repo_name for r in rows.collect()}) == ["o/r", "o/s"] and rows.count() == 10
    assert "login (src/auth.py)" in e.search("Function: login File: src/auth.py", "o/s", 2)
    assert e.store.vacuum(3600) == 0 and e.store.vacuum(0) == 12  # the older version of one, and what is deleted
    assert e.structure("o/s") and e.store.all_functions().count() == 10


def test_equal_ids_are_an_error(spark, engine, tmp_path):
    from callscope.operators.store import Store

    g = engine.graph("o/r")
    g.functions = g.functions.unionByName(g.functions.limit(1))
    s = Store(spark, str(tmp_path / "store"))
    with pytest.raises(ValueError, match="have the id"):
        s.write("o/r", g)
    assert s.version("o/r") is None


def test_change_request_files(spark):
    rows = spark.createDataFrame([("a.py", "added", "1"), ("b.py", "removed", "1"), ("c.md", "added", "1"), ("./d.go", None, "2"), ("d.go", "modified", "3")], "filename string, status string, sha string")
    assert sorted((r.path, r.sha) for r in files.requested_files(rows, "o/r").collect()) == [("a.py", "1"), ("d.go", "3")]


def test_ignored_folders_are_not_read(spark, tree):
    import os

    blocked = os.path.join(tree, "node_modules")
    plan = files.source_files(spark, tree)._jdf.inputFiles()
    assert all(blocked not in p for p in plan) and len(list(plan)) == 3


def test_a_failed_parse_writes_nothing(spark, tmp_path):
    (tmp_path / "t").mkdir()
    (tmp_path / "t/good.py").write_text("def f():\n    pass\n")
    (tmp_path / "t/bad.py").write_text("def (")
    e = Engine(spark, str(tmp_path / "store"))
    with pytest.raises(Exception, match="could not parse bad.py"):
        e.ingest("o/r", str(tmp_path / "t"))
    assert e.store.version("o/r") is None
    steps = [json.loads(x) for x in e.progress("o/r", str(tmp_path / "t"))]
    assert [s["progress"] for s in steps] == [10, 50, 80, 80, 80] and "1 of 2" in steps[-1]["error"]
    assert steps[1]["status"] == "Parsed 1 of 2 files: bad.py"


def archive(members):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in members:
            z.writestr(name, text)
    return out.getvalue()


def test_archives(spark):
    rows = spark.createDataFrame([("o/r", bytearray(archive([("root/a.py", "x = f()"), ("root/build/b.py", ""), ("root/c.txt", "")])))], "repo_name string, content binary")
    assert [r.path for r in files.archive_files(rows).collect()] == ["a.py"]
    for bad in ([("root/../x.py", "")], [("/x.py", "")], [("a/x.py", ""), ("b/y.py", "")], []):
        with pytest.raises(ValueError):
            files.extract_archive(archive(bad))


def test_the_last_push_wins(spark, tree, tmp_path):
    """Whatever file a push arrives in: order is by the event's own time."""
    e = Engine(spark, str(tmp_path / "store"))
    e.ingest("o/r", tree)
    event = {"before": "b" * 40, "size": 1, "forced": False, "created": False, "deleted": False, "repository": {"full_name": "o/r"}}
    new = event | {"pushed_at": "2024-01-02T00:00:00Z", "after": "a" * 40, "commits": [{"added": ["src/x.py"], "modified": [], "removed": ["src/pay.js"]}]}
    old = event | {"pushed_at": "2024-01-01T00:00:00Z", "after": "c" * 40, "commits": [{"added": ["src/pay.js", "src/y.py"], "modified": [], "removed": ["src/x.py"]}]}
    (tmp_path / "events").mkdir()
    (tmp_path / "events/1.json").write_text(json.dumps(new))
    (tmp_path / "events/2.json").write_text(json.dumps(old))
    e.follow(push.push_events(spark, str(tmp_path / "events")), lambda repo, path, sha: f"def at_{sha[0]}():\n    pass\n".encode(), str(tmp_path / "checkpoint")).awaitTermination()
    got = {r.file_path: r.name for r in e.graph("o/r").functions.where("file_path LIKE 'src/_.py'").collect()}
    assert got == {"src/x.py": "at_a", "src/y.py": "at_c"} and "src/pay.js" not in e.structure("o/r")


def test_pushes_as_a_stream(spark, tree, tmp_path):
    e = Engine(spark, str(tmp_path / "store"))
    e.ingest("o/r", tree)
    event = {"before": "b" * 40, "after": "c" * 40, "size": 1, "forced": False, "created": False, "deleted": False, "commits": [{"added": ["src/new.py"], "modified": [], "removed": ["src/pay.js"]}], "repository": {"full_name": "o/r"}}
    (tmp_path / "events").mkdir()
    (tmp_path / "events/1.json").write_text(json.dumps(event) + "\n" + json.dumps(event | {"forced": True}))
    stream = push.push_events(spark, str(tmp_path / "events"))
    push.apply_pushes(stream, e.store, lambda repo, path, sha: b"def fresh():\n    validate()\n", str(tmp_path / "checkpoint")).awaitTermination()
    assert e.structure("o/r") == "rebuild/x.py\nsrc/auth.py\nsrc/new.py"
    assert "fresh" in engine_callers(e, "validate")


def engine_callers(e, name):
    return [c["caller"] for c in json.loads(e.blast_radius("o/r", name))["callers"]]


def test_reads_only_its_repository(engine):
    plan = engine.graph("o/r").calls._jdf.queryExecution().executedPlan().toString()
    assert "repo_name=o%252Fr" in plan or "repo_name=o%2Fr" in plan


def test_embeddings_are_made_once(spark):
    asked = spark.createDataFrame([("same",), (" other ",), (" same ",)], "text string")
    got = vectors.embed_texts(asked, vectors.hash_embedder(8), 8)
    assert sorted(r.text for r in got.collect()) == ["other", "same"]
    with pytest.raises(Exception, match="blank"):
        vectors.embed_texts(spark.createDataFrame([(" ",)], "text string"), vectors.hash_embedder(8), 8).collect()


def test_search_filters_after_the_search(spark):
    rows = spark.createDataFrame([("a", "1", "x", None, "f", [1.0, 0.0]), ("b", "2", "y", None, "f", [0.9, 0.1]), ("b", "3", "z", None, "f", [0.0, 0.0])], "repo_name string, entity_id string, name string, qualified_name string, file_path string, embedding array<float>")
    assert [r.function_name for r in vectors.top_k(rows, [1.0, 0.0], 1, "b").collect()] == []
    assert [r.function_name for r in vectors.top_k(rows, [1.0, 0.0], 1, "b", prefilter=True).collect()] == ["y"]
    assert vectors.clamp(0) == 1 and vectors.clamp(99) == 20
