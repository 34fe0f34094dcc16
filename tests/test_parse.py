"""Parsers of all languages."""

import pytest

from callscope.parse import parse_source
from callscope.parse.records import flat_calls

CASES = [
    ("m.py", "class Api:\n    def get(self):\n        net.fetch()\ndef main():\n    get()\n", ["get", "main"], ["fetch", "get"], ["Api"]),
    ("m.js", "class Api { get() { net.fetch() } }\nconst make = () => get();\nfunction main() { make(); }\n", ["get", "make", "main"], ["fetch", "get", "make"], ["Api"]),
    ("m.jsx", "const Box = () => <div />;\nfunction draw() { put(Box()); }\n", ["Box", "draw"], ["put", "Box"], []),
    ("m.ts", "abstract class Api { get(): void { net.fetch(); } }\nconst make = (): void => get();\nfunction main(): void { make(); }\n", ["get", "make", "main"], ["fetch", "get", "make"], ["Api"]),
    ("m.tsx", "const Box = (): JSX.Element => <div />;\nfunction draw(): void { put(Box()); }\n", ["Box", "draw"], ["put", "Box"], []),
    ("m.go", "package p\ntype Api struct{}\nfunc Main() { help(); net.Fetch() }\nfunc (a *Api) Get() { Main() }\n", ["Main", "Get"], ["help", "Fetch", "Main"], ["Api"]),
    ("Api.java", "package p;\nclass Api {\n  Api() { setUp(); }\n  void get() { net.fetch(); help(); }\n}\n", ["Api", "get"], ["setUp", "fetch", "help"], ["Api"]),
]


def calls(record):
    return [c["name"] for c in record["calls"]]


@pytest.mark.parametrize(("path", "source", "functions", "called", "classes"), CASES)
def test_each_language(path, source, functions, called, classes):
    got = parse_source(path, source.encode())
    assert (got["defined_functions"], got["outgoing_calls"], got["defined_classes"]) == (functions, called, classes)
    assert all(f["name"] in f["raw_code"] for f in got["functions"])


def test_exact_source_and_lines():
    first, second = parse_source("m.py", b"def one(v):\n    return v + 1\n\ndef two():\n    return one(2)\n")["functions"]
    assert first["raw_code"] == "def one(v):\n    return v + 1"
    assert [(f["start_line"], f["end_line"], f["start_column"], f["end_column"]) for f in (first, second)] == [(1, 2, 0, 16), (4, 5, 0, 17)]


def test_calls_belong_to_the_innermost_body():
    got = parse_source("m.py", b"def one():\n    api.check()\n    def inner():\n        deep()\ndef two(x=default()):\n    pay()\noutside()\nrun = lambda: hidden()\n")
    assert [f["qualified_name"] for f in got["functions"]] == ["one", "one.inner", "two"]
    assert [calls(f) for f in got["functions"]] == [["check"], ["deep"], ["pay"]]
    assert [c["name"] for c in got["unattributed_calls"]] == ["default", "outside", "hidden"]
    assert got["functions"][0]["calls"][0]["syntax"] == "api.check"


@pytest.mark.parametrize(
    ("path", "source", "own", "rest"),
    [
        ("m.js", "function outer() { run(() => hidden()); seen(); }", ["run", "seen"], ["hidden"]),
        ("m.js", "const outer = async (a) => { await seen(a); list.map(function (x) { return hidden(x); }); };", ["seen", "map"], ["hidden"]),
        ("m.go", "package p\nfunc Outer() { f := func() { hidden() }; seen(); _ = f }\n", ["seen"], ["hidden"]),
        ("M.java", "class M { void outer() { list.forEach(x -> hidden(x)); seen(); } }", ["forEach", "seen"], ["hidden"]),
    ],
)
def test_anonymous_functions_are_a_border(path, source, own, rest):
    got = parse_source(path, source.encode())
    assert calls(got["functions"][0]) == own
    assert [c["name"] for c in got["unattributed_calls"]] == rest


def test_overloads():
    got = parse_source("V.java", b"class V { V() {} void check(String v) {} void check(int v) {} abstract int no(); }")
    assert [(f["qualified_name"], f["signature"]) for f in got["functions"]] == [("V.V", "()"), ("V.check", "(String v)"), ("V.check", "(int v)")]
    got = parse_source("v.ts", b"class V {\n  run(a: string): void;\n  run(a: number): void;\n  run(a: any): void { go(a); }\n}\n")
    assert [f["has_body"] for f in got["functions"]] == [False, False, True]
    assert got["defined_functions"] == ["run"]


def test_occurrences_count_equal_signatures():
    got = parse_source("v.py", b"def check(v):\n    pass\ndef check(v):\n    pass\n", "o/r")
    assert [f["definition_discriminator"] for f in got["functions"]] == ["signature:(v);occurrence:1", "signature:(v);occurrence:2"]
    assert len({f["entity_id"] for f in got["functions"]}) == 2


def test_strings_comments_and_templates_hide_nothing_else():
    got = parse_source("m.js", b"// no()\nconst s = 'no()' + `x ${yes(`${deep()}`)} no()`;\nconst r = /no()/.test(s); /* no() */ new Thing(arg());")
    assert got["outgoing_calls"] == ["yes", "deep", "test", "arg"]


def test_receivers_and_generics():
    got = parse_source("m.go", b"package p\nfunc Map[T any](xs []T, f func(T) T) interface{} { return f(xs[0]) }\nfunc (l List[T]) Len() (int, error) { return l.a.b().c(), nil }\n")
    assert [f["qualified_name"] for f in got["functions"]] == ["Map", "List.Len"]
    assert calls(got["functions"][1]) == ["b", "c"]


def test_byte_columns():
    got = parse_source("m.py", "é = 1; ü = f(é)\n".encode())
    assert got["unattributed_calls"][0]["start_column"] == 13


def test_errors():
    with pytest.raises(TypeError):
        parse_source("m.py", "text")
    with pytest.raises(ValueError, match="unsupported"):
        parse_source("m.rs", b"")
    with pytest.raises(SyntaxError):
        parse_source("m.py", b"def (")
    assert parse_source("m.js", b"function broken( { call(")["defined_functions"] == []


def test_flat_walker():
    nodes, sites = flat_calls("f.py", "def a():\n    b.c()\nclass K:\n    def m(self):\n        a()\na()\n")
    assert [n["qualified_name"] for n in nodes] == ["<module>", "a", "K.m"]
    assert [(s["caller_id"], s["target"], s["line"]) for s in sites] == [("f.py::a", "b.c", 2), ("f.py::K.m", "a", 5), ("f.py::<module>", "a", 6)]
