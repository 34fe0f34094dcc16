"""The resolution ladder against a plain model of it."""

from hypothesis import given, settings
from hypothesis import strategies as st

from callscope.operators import resolve

DEF = "repo_name string, entity_id string, file_path string, qualified_name string, name string"
SITE = "repo_name string, caller_id string, file_path string, qualified_name string, name string, ordinal int"


def model(defs, sites):
    """Outcome of each (repo, caller, name): (resolution, number of matches, target)."""
    out = {}
    for repo, caller, path, qualified, name, _ in sites:
        scope = qualified.split(".")
        mine = [d for d in defs if d[0] == repo]
        tiers = [("lexical_scope", [d for d in mine if d[2] == path and d[3] == ".".join([*scope[:k], name])]) for k in range(len(scope), -1, -1)]
        tiers += [("same_file", [d for d in mine if d[2] == path and d[4] == name]), ("repository_unique", [d for d in mine if d[4] == name])]
        hit = next(((t, m) for t, m in tiers if m), ("external", []))
        out[repo, caller, name] = (hit[0], len(hit[1]), hit[1][0][1] if len(hit[1]) == 1 else None)
    return out


def frames(spark, defs, sites):
    return spark.createDataFrame(sites, SITE), spark.createDataFrame(defs, DEF)


def outcome(spark, defs, sites):
    rows = resolve.resolve(*frames(spark, defs, sites)).collect()
    return {(r.repo_name, r.caller_id, r.name): (r.resolution, r.matches, r.target_id) for r in rows}


def test_method_with_every_outcome(spark):
    defs = [("o/r", "m", "a.py", "Service.validate", "validate"), ("o/r", "c", "a.py", "Service.check", "check"), ("o/r", "u", "b.py", "util", "util"), ("o/r", "s1", "b.py", "shared", "shared"), ("o/r", "s2", "c.py", "shared", "shared")]
    calls = ["check", "check", "util", "shared", "print"]
    sites = [("o/r", "m", "a.py", "Service.validate", n, k) for k, n in enumerate(calls)]
    rows = resolve.resolve(*frames(spark, defs, sites))
    inside = {r.target_id: (r.resolution, r.call_count) for r in resolve.internal_edges(rows).collect()}
    assert inside == {"c": ("lexical_scope", 2), "u": ("repository_unique", 1)}
    assert [(r.target_name, r.call_count) for r in resolve.external_edges(rows).collect()] == [("print", 1)]
    assert [r.ambiguous_calls for r in resolve.ambiguous_names(rows).collect()] == [["shared"]]


def test_same_name_in_two_files_stays_local(spark):
    defs = [("o/r", f"{f}{n}", f"{f}.py", n, n) for f in "ab" for n in ("helper", "run")]
    sites = [("o/r", f"{f}run", f"{f}.py", "run", "helper", 0) for f in "ab"]
    assert {k[1]: v for k, v in outcome(spark, defs, sites).items()} == {"arun": ("lexical_scope", 1, "ahelper"), "brun": ("lexical_scope", 1, "bhelper")}


def test_repositories_never_mix(spark):
    defs = [("o/a", "t", "x.py", "target", "target"), ("o/b", "c", "x.py", "caller", "caller")]
    assert outcome(spark, defs, [("o/b", "c", "x.py", "caller", "target", 0)]) == {("o/b", "c", "target"): ("external", 0, None)}


def test_ambiguity_stops_the_ladder_and_keeps_order(spark):
    defs = [("r", "c", "f", "c", "c"), *(("r", f"{n}{k}", "f", f"K{k}.{n}", n) for n in ("zed", "abc") for k in (1, 2))]
    rows = resolve.resolve(*frames(spark, defs, [("r", "c", "f", "c", n, k) for k, n in enumerate(["zed", "abc", "zed"])]))
    assert resolve.ambiguous_names(rows).first().ambiguous_calls == ["zed", "abc"]
    assert resolve.call_table(rows).count() == 0


def test_recursion_finds_itself(spark):
    assert outcome(spark, [("r", "c", "f", "A.c", "c")], [("r", "c", "f", "A.c", "c", 0)])["r", "c", "c"] == ("lexical_scope", 1, "c")


def test_empty_tables(spark):
    rows = resolve.resolve(*frames(spark, [], []))
    assert resolve.call_table(rows).count() == resolve.ambiguous_names(rows).count() == 0


names = st.sampled_from(["a", "b", "c", "A.a", "A.b", "A.a.b", "B.c", "A.B.a"])


@settings(max_examples=6, deadline=None)
@given(st.lists(st.tuples(st.sampled_from("rs"), st.sampled_from("fg"), names), min_size=1, max_size=14), st.lists(st.tuples(st.integers(0, 13), st.sampled_from("abcx")), max_size=30))
def test_against_the_model(spark, found, asked):
    defs = [(r, f"id{k}", f, q, q.split(".")[-1]) for k, (r, f, q) in enumerate(found)]
    sites = [(*[defs[k % len(defs)][i] for i in (0, 1, 2, 3)], n, o) for o, (k, n) in enumerate(asked)]
    assert outcome(spark, defs, sites) == model(defs, sites)
    rows = resolve.resolve(*frames(spark, defs, sites))
    assert sum(r.n_sites for r in rows.collect()) == len(sites)


def test_flat_resolver(spark):
    defs = spark.createDataFrame([("r", "f::a.x", "f", "a.x", "x"), ("r", "f::y", "f", "y", "y"), ("r", "g::z", "g", "m.z", "z"), ("r", "h::z", "h", "n.z", "z")], DEF)
    sites = spark.createDataFrame([("r", "f::y", "a.x", 3), ("r", "f::y", "a.x", 1), ("r", "f::y", "q.y", 2), ("r", "f::y", "z", 5)], "repo_name string, caller_id string, target string, line int")
    rows = {r.target_id: (r["count"], r.locations) for r in resolve.resolve_flat(sites, defs).collect()}
    assert rows == {"f::a.x": (2, [1, 3]), "f::y": (1, [2]), "external::z": (1, [5])}
