"""Parsed file records, from whichever parser the language has."""

from __future__ import annotations

import ast
import hashlib
import re
from bisect import bisect_right

from callscope.functions.text import LANGUAGES
from callscope.parse.braces import Call, Definition, Found, Walker
from callscope.parse.lexer import Tokens


def _python(source: str) -> Found:
    """Definitions and calls by the interpreter's own parser; a syntax error is the caller's."""
    tree = ast.parse(source)
    lines = [0]
    for line in source.splitlines(keepends=True):
        lines.append(lines[-1] + len(line))
    text = source.splitlines(keepends=True)

    def place(row: int, column: int) -> int:
        line = text[row - 1] if row <= len(text) else ""
        return lines[row - 1] + (column if line.isascii() else len(line.encode("utf-8", "surrogatepass")[:column].decode("utf-8", "surrogatepass")))

    def span(node) -> tuple[int, int]:
        return place(node.lineno, node.col_offset), place(node.end_lineno, node.end_col_offset)

    found = Found()

    def visit(node) -> None:
        if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
            start, end = span(node)
            found.scopes.append((start, end, node.name))
            if isinstance(node, ast.ClassDef):
                found.classes.append((start, node.name))
            else:
                body = (span(node.body[0])[0], end)
                found.definitions.append(Definition(node.name, start, end, _parameters(source, start, node.name), body))
        elif isinstance(node, ast.Lambda):
            found.anonymous.append(span(node))
        elif isinstance(node, ast.Call) and isinstance(node.func, (ast.Name, ast.Attribute)):
            start, end = span(node)
            name = node.func.id if isinstance(node.func, ast.Name) else node.func.attr
            first, last = span(node.func)
            found.calls.append(Call(name, last - len(name), start, end, source[first:last]))
        for child in ast.iter_child_nodes(node):
            visit(child)

    visit(tree)
    return found


def _parameters(source: str, start: int, name: str) -> tuple[int, int] | None:
    m = re.compile(r"(?:async\s+)?def\s+" + re.escape(name) + r"\s*").match(source, start)
    if not m:
        return None
    depth, k, first = 0, m.end(), -1
    while k < len(source):
        c = source[k]
        if c in "\"'":
            quote = c * 3 if source.startswith(c * 3, k) else c
            k += len(quote)
            while k < len(source) and not source.startswith(quote, k):
                k += 1 + (source[k] == "\\")
            k += len(quote)
            continue
        if c == "#":
            k = source.find("\n", k)
            if k < 0:
                return None
        elif c in "([{":
            if c == "(" and not depth:
                first = k
            depth += 1
        elif c in ")]}":
            depth -= 1
            if not depth and c == ")":
                return first, k + 1
        k += 1
    return None


class _Places:
    """Rows and byte columns of character offsets."""

    def __init__(self, source: str):
        self.source, self.ascii = source, source.isascii()
        self.rows = [0, *(m.end() for m in re.finditer("\n", source))]

    def __call__(self, at: int) -> tuple[int, int]:
        row = bisect_right(self.rows, at) - 1
        column = at - self.rows[row] if self.ascii else len(self.source[self.rows[row] : at].encode("utf-8", "surrogatepass"))
        return row + 1, column


def _site(call: Call, place: _Places) -> dict:
    (row, column), (end_row, end_column) = place(call.start), place(call.end)
    return {"name": call.name, "syntax": call.syntax, "start_line": row, "end_line": end_row - (end_column == 0), "start_column": column, "end_column": end_column, "resolution": "unresolved"}


def _attribute(found: Found) -> tuple[list[list[Call]], list[Call]]:
    """Calls of each definition: those in its body, in no inner one's and in no anonymous function between; and the rest."""
    own: list[list[Call]] = [[] for _ in found.definitions]
    rest: list[Call] = []
    # Bodies and anonymous spans open and close in order of place: a stack holds those around a call.
    events = [(d.body[0], -d.body[1], 0, k) for k, d in enumerate(found.definitions) if d.body]
    events += [(s, -e, 1, k) for k, (s, e) in enumerate(found.anonymous)]
    events += [(c.start, -c.end, 2, k) for k, c in enumerate(found.calls)]
    stack: list[tuple[int, int, int]] = []
    for start, end, kind, k in sorted(events):
        while stack and stack[-1][0] <= start:
            stack.pop()
        if kind < 2:
            stack.append((-end, kind, k))
            continue
        blocked, owner = False, None
        for _, what, j in reversed(stack):
            if what == 0:
                owner = j
                break
            blocked = True
        call = found.calls[k]
        if owner is None or blocked:
            rest.append(call)
        else:
            own[owner].append(call)
    return own, rest


def _expression_bodies(found: Found) -> None:
    """An arrow function that a variable is given is no anonymous one."""
    values = {d.value for d in found.definitions if d.value}
    found.anonymous = sorted({a for a in found.anonymous if a not in values and not any(v[0] == a[0] for v in values)})


def parse_source(path: str, content: bytes, repository: str | None = None, relative: str | None = None, count_tokens=None) -> dict:
    """The record of one file (columns of PARSED_FILE).

    A suffix that is not supported is a ValueError, content that is not bytes a TypeError,
    Python that does not parse a SyntaxError; other languages are read as far as they go.
    """
    if not isinstance(content, (bytes, bytearray)):
        raise TypeError("content must be bytes")
    suffix = "." + path.rsplit("/", 1)[-1].rsplit(".", 1)[-1].lower()
    if suffix not in LANGUAGES:
        raise ValueError(f"unsupported suffix {suffix}; supported: {', '.join(sorted(LANGUAGES))}")
    language, source = LANGUAGES[suffix], bytes(content).decode("utf-8", "replace")
    found = _python(source) if language == "python" else Walker(source, language).run()
    _expression_bodies(found)
    shown = relative or path
    place = _Places(source)
    order = sorted(range(len(found.definitions)), key=lambda k: (found.definitions[k].start, found.definitions[k].end))
    own, rest = _attribute(found)
    scopes = sorted(set(found.scopes), key=lambda s: (s[0], -s[1]))
    records, seen = [], {}
    around: list[tuple[int, int, str]] = []
    at = 0
    for k in order:
        d = found.definitions[k]
        while at < len(scopes) and scopes[at][0] <= d.start:
            around = [s for s in around if s[1] > scopes[at][0]]
            around.append(scopes[at])
            at += 1
        names = [s[2] for s in around if s[0] <= d.start and s[1] >= d.end and (s[0], s[1]) != (d.start, d.end)]
        if d.receiver:
            names.append(d.receiver)
        sig = " ".join(source[d.params[0] : d.params[1]].split()) if d.params else None
        qualified = ".".join([*names, d.name])
        seen[qualified, sig] = seen.get((qualified, sig), 0) + 1
        (row, column), (end_row, end_column) = place(d.start), place(d.end)
        record = {
            "name": d.name, "qualified_name": qualified, "file_path": shown, "language": language, "repository": repository, "signature": sig, "has_body": d.body is not None,
            "start_line": row, "end_line": end_row - (end_column == 0), "start_column": column, "end_column": end_column, "raw_code": source[d.start : d.end],
            "definition_discriminator": f"signature:{sig or 'unknown'};occurrence:{seen[qualified, sig]}", "entity_id": None,
            "calls": [_site(c, place) for c in sorted(own[k], key=lambda c: c.name_start)],
        }
        if repository:
            from callscope.functions.identity import canonical_id

            record["entity_id"] = canonical_id([repository.strip(), shown, language, qualified.strip(), record["definition_discriminator"].strip()])
        records.append(record)
    return {
        "file_path": shown, "repository": repository, "source_tokens": count_tokens(source) if count_tokens else None,
        "defined_classes": [c for _, c in sorted(found.classes)], "defined_functions": [r["name"] for r in records if r["has_body"]],
        "outgoing_calls": [c.name for c in sorted(found.calls, key=lambda c: c.name_start)], "functions": records,
        "unattributed_calls": [_site(c, place) for c in sorted(rest, key=lambda c: c.name_start)],
    }


def flat_calls(path: str, source: str) -> tuple[list[dict], list[dict]]:
    """The earlier walker for Python: nodes and call sites, file scope as ``<module>``; a call belongs to the nearest definition around it."""
    tree = ast.parse(source)
    nodes = [{"id": f"{path}::<module>", "name": "<module>", "qualified_name": "<module>", "file": path, "line": 1}]
    sites: list[dict] = []

    def visit(node, names: tuple[str, ...], owner: str) -> None:
        for child in ast.iter_child_nodes(node):
            inner, mine = names, owner
            if isinstance(child, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
                inner = (*names, child.name)
                if not isinstance(child, ast.ClassDef):
                    mine = f"{path}::{'.'.join(inner)}"
                    nodes.append({"id": mine, "name": child.name, "qualified_name": ".".join(inner), "file": path, "line": child.lineno})
            if isinstance(child, ast.Call):
                sites.append({"caller_id": owner, "target": ast.unparse(child.func), "line": child.lineno})
            visit(child, inner, mine)

    visit(tree, (), nodes[0]["id"])
    return nodes, sites


def content_key(content: bytes) -> str:
    """Names one content; equal files need parsing once."""
    return hashlib.sha256(content).hexdigest()


__all__ = ["Tokens", "content_key", "flat_calls", "parse_source"]
