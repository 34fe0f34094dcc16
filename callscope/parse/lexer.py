"""A tolerant tokenizer for languages with braces: JavaScript, TypeScript, Go, Java."""

from __future__ import annotations

import re
from typing import NamedTuple

_NAME = re.compile(r"[A-Za-z_$\u0080-\U0010ffff][\w$\u0080-\U0010ffff]*")
_SPACE = re.compile(r"\s+")
_NUMBER = re.compile(r"\d[\w.]*")
_MULTI = ("=>", "->", "?.", "...", "::", ":=", "&&", "||", "??", "==", "!=", "<=", ">=", "++", "--", "+=", "-=")
_OPEN = {"(": ")", "[": "]", "{": "}"}
#: Words after which a slash starts a regular expression.
_BEFORE_REGEX = frozenset("return typeof case in of delete void throw new else do instanceof yield await".split())


class Token(NamedTuple):
    kind: str  # name, text, number, mark
    text: str
    start: int
    end: int
    line_start: bool


class Tokens:
    """Tokens of a source; ``mate`` gives the index of a bracket's other half, ``inside`` that of the bracket around a token (-1: none)."""

    def __init__(self, source: str, language: str):
        self.source, self.language = source, language
        self.all: list[Token] = []
        self._lex()
        self.mate: dict[int, int] = {}
        self.inside: list[int] = []
        stack: list[int] = []
        for i, t in enumerate(self.all):
            if t.kind == "mark" and t.text in (")", "]", "}"):
                for k in range(len(stack) - 1, -1, -1):  # an unmatched opener is left behind
                    if _OPEN[self.all[stack[k]].text] == t.text:
                        self.mate[stack[k]], self.mate[i] = i, stack[k]
                        del stack[k:]
                        break
            self.inside.append(stack[-1] if stack else -1)
            if t.kind == "mark" and t.text in _OPEN:
                stack.append(i)

    def _string(self, at: int, quote: str) -> int:
        s = self.source
        k = at + 1
        while k < len(s):
            if s[k] == "\\":
                k += 2
            elif s[k] == quote:
                return k + 1
            elif s[k] == "\n" and quote != "`":
                return k
            else:
                k += 1
        return len(s)

    def _regex(self, at: int) -> int:
        s, k, group = self.source, at + 1, False
        while k < len(s) and s[k] != "\n":
            if s[k] == "\\":
                k += 1
            elif s[k] == "[":
                group = True
            elif s[k] == "]":
                group = False
            elif s[k] == "/" and not group:
                k += 1
                while k < len(s) and s[k].isalpha():
                    k += 1
                return k
            k += 1
        return -1

    def _lex(self) -> None:
        s, i, fresh = self.source, 0, True
        script = self.language in ("javascript", "typescript", "tsx")
        depth: list[int] = []  # braces open in each template expression

        def add(kind: str, end: int) -> None:
            nonlocal i, fresh
            self.all.append(Token(kind, s[i:end], i, end, fresh))
            i, fresh = end, False

        def template(k: int) -> int:
            """End of template text from k on: after the closing quote or an opening ``${``."""
            while k < len(s):
                if s[k] == "\\":
                    k += 2
                elif s[k] == "`":
                    return k + 1
                elif s.startswith("${", k):
                    depth.append(0)
                    return k + 2
                else:
                    k += 1
            return len(s)

        while i < len(s):
            c = s[i]
            if m := _SPACE.match(s, i):
                fresh = fresh or "\n" in m[0]
                i = m.end()
            elif s.startswith("//", i):
                end = s.find("\n", i)
                i = len(s) if end < 0 else end
            elif s.startswith("/*", i):
                end = s.find("*/", i + 2)
                fresh = fresh or "\n" in s[i : end if end >= 0 else len(s)]
                i = len(s) if end < 0 else end + 2
            elif self.language == "java" and s.startswith('"""', i):
                end = s.find('"""', i + 3)
                add("text", len(s) if end < 0 else end + 3)
            elif c == "`" and script:
                add("text", template(i + 1))
            elif c == "`":
                end = s.find("`", i + 1)
                add("text", len(s) if end < 0 else end + 1)
            elif c in "\"'":
                add("text", self._string(i, c))
            elif m := _NAME.match(s, i):
                add("name", m.end())
            elif m := _NUMBER.match(s, i):
                add("number", m.end())
            elif c == "/" and script and self._regex_here() and (end := self._regex(i)) > 0:
                add("text", end)
            elif c == "}" and depth and not depth[-1]:
                depth.pop()
                add("text", template(i + 1))
            else:
                if depth:
                    depth[-1] += (c == "{") - (c == "}")
                mark = next((x for x in _MULTI if s.startswith(x, i)), c)
                add("mark", i + len(mark))

    def _regex_here(self) -> bool:
        if not self.all:
            return True
        last = self.all[-1]
        if last.kind == "name":
            return last.text in _BEFORE_REGEX
        return last.kind == "mark" and last.text not in (")", "]", "}", "++", "--", ">")

    def text(self, i: int) -> str:
        """Text of token i; empty outside."""
        return self.all[i].text if 0 <= i < len(self.all) else ""

    def is_name(self, i: int) -> bool:
        return 0 <= i < len(self.all) and self.all[i].kind == "name"

    def after(self, i: int) -> int:
        """The token after i, or after the bracket that i opens."""
        return self.mate.get(i, i) + 1 if self.text(i) in _OPEN else i + 1

    def past_angles(self, i: int) -> int:
        """After ``<...>`` that starts at i, or i if none that looks like types does."""
        if self.text(i) != "<":
            return i
        depth, k = 0, i
        while k < len(self.all) and k < i + 200:
            t = self.text(k)
            if t in ("<", ">"):
                depth += 1 if t == "<" else -1
                if not depth:
                    return k + 1
            elif t in ("(", "[", "{"):
                k = self.mate.get(k, k)
            elif self.all[k].kind == "mark" and t not in (",", ".", "|", "&", "?", "=", ":", "...", "*", "]", "=>"):
                return i
            k += 1
        return i
