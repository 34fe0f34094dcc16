"""Definitions and calls of languages with braces, from tokens."""

from __future__ import annotations

from dataclasses import dataclass, field

from callscope.parse.lexer import Tokens

#: Words that precede a parenthesis without being called.
KEYWORDS = {
    "javascript": frozenset("if for while switch catch function return typeof await yield delete void new super import in of with do else throw case instanceof let const var class extends async constructor_".split()),
    "java": frozenset("if for while switch catch return new super this synchronized try throw assert else do case instanceof yield".split()),
    "go": frozenset("if for switch select return func go defer range case else chan map struct interface type var const import package".split()),
}
_JAVA_MODIFIERS = frozenset("public private protected static final abstract synchronized native default strictfp sealed transient volatile".split())
_SCRIPT_MODIFIERS = frozenset("async get set static public private protected readonly override declare abstract accessor".split())
_EXPRESSION = frozenset(("=", "(", ",", ":", "?", "=>", "[", "&&", "||", "??", "return", "!", "+", "new", "case", "typeof", "await", "...", "yield"))
_GOES_ON = frozenset(". ?. + - * / % ? : => && || ?? = == != < > <= >= & | ^ , ) ] } ( [ instanceof in of as satisfies".split())
_WANTS_MORE = frozenset(". ?. + - * / % ? : => && || ?? = == != < > <= >= & | ^ , ( [ { ! ~ ... return typeof await new instanceof in of as".split())


@dataclass
class Definition:
    name: str
    start: int
    end: int
    params: tuple[int, int] | None
    body: tuple[int, int] | None
    value: tuple[int, int] | None = None  # the function that a variable is given
    receiver: str | None = None


@dataclass
class Call:
    name: str
    name_start: int
    start: int
    end: int
    syntax: str


@dataclass
class Found:
    definitions: list[Definition] = field(default_factory=list)
    scopes: list[tuple[int, int, str]] = field(default_factory=list)
    anonymous: list[tuple[int, int]] = field(default_factory=list)
    classes: list[tuple[int, str]] = field(default_factory=list)
    calls: list[Call] = field(default_factory=list)


class Walker:
    def __init__(self, source: str, language: str):
        self.t = Tokens(source, language)
        self.source, self.language = source, language
        self.typed = language in ("typescript", "tsx")
        self.family = "javascript" if language in ("javascript", "typescript", "tsx") else language
        self.found = Found()
        self.named: set[int] = set()  # tokens that name a definition
        self.bodies: dict[int, str] = {}  # opening braces of class and interface bodies

    # spans -------------------------------------------------------------
    def at(self, i: int) -> int:
        return self.t.all[i].start if i < len(self.t.all) else len(self.source)

    def end(self, i: int) -> int:
        """End of token i, or of the bracket it opens."""
        return self.t.all[min(self.t.mate.get(i, i) if self.t.text(i) in ("(", "[", "{") else i, len(self.t.all) - 1)].end

    def expression_end(self, i: int) -> int:
        """Index after the expression that starts at token i."""
        k = i
        while k < len(self.t.all):
            x = self.t.text(k)
            if self.t.all[k].kind == "mark" and x in (";", ",", ")", "]", "}"):
                return k
            if k > i and self.t.all[k].line_start and x not in _GOES_ON and self.t.text(k - 1) not in _WANTS_MORE and self.family == "javascript":
                return k
            k = self.t.after(k)
        return k

    def chain_start(self, i: int) -> int:
        """First token of the expression whose last member is token i."""
        k = i
        while self.t.text(k - 1) in (".", "?."):
            k -= 2
            while self.t.text(k) in (")", "]") and k in self.t.mate:
                k = self.t.mate[k] - 1
                if not (self.t.is_name(k) or self.t.text(k) in (")", "]")):
                    return k + 1
            if self.t.text(k - 1) == "new" and self.family != "go":
                k -= 1
        return k

    def add_call(self, i: int, paren: int) -> None:
        first = self.chain_start(i)
        name = self.t.all[i]
        syntax = self.source[self.at(first) : name.end]
        self.found.calls.append(Call(name.text, name.start, self.at(first), self.end(paren), syntax))

    def run(self) -> Found:
        {"javascript": self._script, "java": self._java, "go": self._go}[self.family]()
        return self.found

    # JavaScript and TypeScript ------------------------------------------
    def _past_type(self, i: int) -> int:
        """After a ``: type`` at i; stops before a body, ``=>``, ``=`` or the end of the statement."""
        t = self.t
        if t.text(i) != ":":
            return i
        k = t.after(i + 1) if t.text(i + 1) in ("{", "(", "[") else i + 2
        while k < len(t.all) and t.text(k) not in ("{", "=>", "=", ";", ",", ")", "}"):
            if t.all[k].line_start and t.text(k) not in ("|", "&") and t.text(k - 1) not in ("|", "&", "<", ","):
                break
            k = t.past_angles(k) if t.text(k) == "<" and t.past_angles(k) > k else t.after(k)
        return k

    def _function(self, i: int) -> tuple[int, int, int, int] | None:
        """(name or -1, paren, body brace or -1, index after) of ``function`` at i."""
        t = self.t
        k = i + 1 + (t.text(i + 1) == "*")
        name = k if t.is_name(k) else -1
        k = t.past_angles(k + (name >= 0))
        if t.text(k) != "(" or k not in t.mate:
            return None
        after = self._past_type(t.after(k))
        body = after if t.text(after) == "{" else -1
        return name, k, body, t.after(body) if body >= 0 else after

    def _arrow(self, i: int) -> tuple[int | None, int, int] | None:
        """(paren or None, body, index after) of an arrow function at i."""
        t = self.t
        k = i + (t.text(i) == "async" and not t.all[min(i + 1, len(t.all) - 1)].line_start and t.text(i + 1) != "=>")
        k = t.past_angles(k)
        if t.text(k) == "(" and k in t.mate:
            paren, after = k, self._past_type(t.after(k))
        elif t.is_name(k):
            paren, after = None, k + 1
        else:
            return None
        if t.text(after) != "=>":
            return None
        body = after + 1
        return paren, body, t.after(body) if t.text(body) == "{" else self.expression_end(body)

    def _value(self, i: int) -> tuple[tuple[int, int] | None, tuple[int, int] | None, int] | None:
        """(params, body, index after) of the function that starts at token i."""
        t = self.t
        k = i + (t.text(i) == "async" and t.text(i + 1) == "function")
        if t.text(k) == "function" and t.text(k + (1 + (t.text(k + 1) == "*"))) and (got := self._function(k)):
            if t.text(k + 1) == "*":
                return None  # a generator function is no function_expression
            _, paren, body, after = got
            return (self.at(paren), self.end(paren)), (self.at(body), self.end(body)) if body >= 0 else None, after
        if arrow := self._arrow(i):
            paren, body, after = arrow
            return None if paren is None else (self.at(paren), self.end(paren)), (self.at(body), self.end(after - 1) if t.text(body) != "{" else self.end(body)), after
        return None

    def _variables(self, i: int) -> None:
        """Declarators after const, let or var at i."""
        t = self.t
        k = i + 1
        while k < len(t.all):
            if not t.is_name(k):
                k = t.after(k)
                if t.text(k) != "=":
                    return
            name = k if t.is_name(k) else -1
            after = self._past_type(k + 1 + (t.text(k + 1) == "!")) if name >= 0 else k
            if t.text(after) != "=":
                if t.text(after) != "," or name < 0:
                    return
                k = after + 1
                continue
            value = after + 1
            stop = self.expression_end(value)
            if name >= 0 and stop > value:
                span = (self.at(name), self.end(stop - 1))
                got = self._value(value)
                if got:
                    params, body, past = got
                    span = (span[0], self.end(past - 1))
                    self.found.definitions.append(Definition(t.text(name), *span, params, body, (self.at(value), span[1])))
                    self.named.add(name)
                self.found.scopes.append((*span, t.text(name)))
            if t.text(stop) != ",":
                return
            k = stop + 1

    def _method(self, i: int) -> bool:
        """Whether token i names a method; records it."""
        t = self.t
        if not t.is_name(i) or t.text(i) in KEYWORDS["javascript"]:
            return False
        inside = t.inside[i]
        kind = self.bodies.get(inside)
        if inside < 0 or t.text(inside) != "{":
            return False
        before = t.text(i - 1)
        if not (before in ("{", "}", ";", ",", "*", ")") or before in _SCRIPT_MODIFIERS or (kind and t.all[i].line_start)):
            return False
        k = t.past_angles(i + 1 + (t.text(i + 1) == "?"))
        if t.text(k) != "(" or k not in t.mate:
            return False
        after = self._past_type(t.after(k))
        first = i
        while t.text(first - 1) in _SCRIPT_MODIFIERS or t.text(first - 1) == "*":
            first -= 1
        abstract = any(t.text(x) == "abstract" for x in range(first, i))
        params = (self.at(k), self.end(k))
        if t.text(after) == "{" and kind != "interface" and (kind or before in ("{", ",", "*") or before in _SCRIPT_MODIFIERS):
            span = (self.at(first), self.end(after))
            self.found.definitions.append(Definition(t.text(i), *span, params, (self.at(after), span[1])))
        elif kind and self.typed and not abstract and (t.text(after) in (";", ",", "}") or after >= len(t.all) or t.all[after].line_start):
            span = (self.at(first), self.end(after - 1))
            self.found.definitions.append(Definition(t.text(i), *span, params, None))
        else:
            return False
        self.found.scopes.append((*span, t.text(i)))
        self.named.add(i)
        return True

    def _script(self) -> None:
        t = self.t
        for i, tok in enumerate(t.all):
            if tok.kind == "mark":
                if tok.text == "=>":
                    self._lambda(i)
                continue
            if tok.kind != "name" or t.text(i - 1) in (".", "?."):
                if tok.kind == "name":
                    self._script_call(i)
                continue
            word, before = tok.text, t.text(i - 1)
            if word in ("class", "interface", "namespace") and t.is_name(i + 1) and t.text(i + 1) not in ("extends", "implements"):
                brace = i + 2
                while brace < len(t.all) and t.text(brace) not in ("{", ";"):
                    brace = t.after(brace)
                if t.text(brace) != "{" or (word != "class" and not self.typed):
                    continue
                self.bodies[brace] = "interface" if word == "interface" else word if word == "class" else ""
                if word == "namespace":
                    del self.bodies[brace]
                if not (before in _EXPRESSION and not tok.line_start):
                    first = i - (before == "abstract")
                    self.found.scopes.append((self.at(first), self.end(brace), t.text(i + 1)))
                    if word == "class":
                        self.found.classes.append((self.at(i + 1), t.text(i + 1)))
                self.named.add(i + 1)
            elif word == "class":
                brace = i + 1
                while brace < len(t.all) and t.text(brace) not in ("{", ";"):
                    brace = t.after(brace)
                self.bodies[brace] = "class"
            elif word == "function" and (got := self._function(i)):
                name, paren, body, after = got
                first = i - (before == "async")
                if name >= 0:
                    self.named.add(name)
                if name >= 0 and (t.text(first - 1) not in _EXPRESSION or (t.all[first].line_start and t.text(first - 1) not in ("=", "(", ",", ":", "=>"))):
                    if body >= 0 or self.typed:
                        span = (self.at(first), self.end(body if body >= 0 else after - 1) + (body < 0 and t.text(after) == ";"))
                        self.found.definitions.append(Definition(t.text(name), *span, (self.at(paren), self.end(paren)), (self.at(body), self.end(body)) if body >= 0 else None))
                        self.found.scopes.append((*span, t.text(name)))
                elif body >= 0:
                    self.found.anonymous.append((self.at(first), self.end(body)))
            elif word in ("const", "let", "var"):
                self._variables(i)
            elif i not in self.named and not self._method(i):
                self._script_call(i)

    def _lambda(self, i: int) -> None:
        """The span of the arrow function whose arrow is token i."""
        t = self.t
        k = i - 1
        if t.text(k) != ")" and not (t.is_name(k) and t.text(k - 1) not in (":", ".", "|", "&")):
            while k > 0 and i - k < 40 and not (t.text(k) == ":" and t.text(k - 1) == ")"):  # a return type
                k = t.mate[k] - 1 if t.text(k) in (")", "]", "}") and k in t.mate else k - 1
            k -= 1
        first = t.mate.get(k, k) if t.text(k) == ")" else k
        first -= t.text(first - 1) == "async"
        body = i + 1
        if t.text(body) == "{":
            self.found.anonymous.append((self.at(first), self.end(body)))
        else:
            stop = self.expression_end(body)
            if stop > body:
                self.found.anonymous.append((self.at(first), self.end(stop - 1)))

    def _script_call(self, i: int) -> None:
        t = self.t
        if i in self.named or (t.text(i) in KEYWORDS["javascript"] and t.text(i - 1) not in (".", "?.")) or self.source[max(self.at(i) - 1, 0)] == "#":
            return
        k = i + 1 + (t.text(i + 1) == "?." and t.text(i + 2) == "(")
        if t.text(k) == "<" and self.typed:
            k = t.past_angles(k)
        if t.text(k) == "(" and k in t.mate:
            first = self.chain_start(i)
            if t.text(first - 1) != "new" and t.text(first) != "new" and t.text(i - 1) != "function":
                self.add_call(i, k)

    # Java ---------------------------------------------------------------
    def _statement_start(self, i: int) -> int:
        t, k = self.t, i
        while k > 0 and not (t.text(k - 1) in (";", "{", "}")):
            k = t.mate[k - 1] if t.text(k - 1) in (")", "]") and k - 1 in t.mate else k - 1
        return k

    def _java(self) -> None:
        t = self.t
        types: dict[int, str] = {}  # opening braces of type bodies
        for i, tok in enumerate(t.all):
            word, before = tok.text, t.text(i - 1)
            if word == "->":
                first = t.mate.get(i - 1, i - 1) if before == ")" else i - 1
                if t.text(self._statement_start(i)) not in ("case", "default"):
                    stop = i + 1 if t.text(i + 1) == "{" else self.expression_end(i + 1) - 1
                    self.found.anonymous.append((self.at(first), self.end(max(stop, i))))
                continue
            if tok.kind != "name":
                continue
            if word in ("class", "interface", "enum", "record") and before != "." and t.is_name(i + 1):
                brace = i + 2
                while brace < len(t.all) and t.text(brace) not in ("{", ";"):
                    brace = t.after(brace)
                if t.text(brace) == "{":
                    types[brace] = t.text(i + 1)
                    self.named.add(i + 1)
                    if word != "enum":
                        self.found.scopes.append((self.at(self._statement_start(i)), self.end(brace), t.text(i + 1)))
                    if word == "class":
                        self.found.classes.append((self.at(i + 1), t.text(i + 1)))
                continue
            if t.text(i + 1) == "=" and (t.is_name(i - 1) or before in (">", "]")) and before not in KEYWORDS["java"]:
                stop = self.expression_end(i + 2)
                if stop > i + 2:
                    self.found.scopes.append((self.at(i), self.end(stop - 1), word))
            paren = i + 1
            if t.text(paren) != "(" or paren not in t.mate or word in KEYWORDS["java"] or i in self.named:
                continue
            after = t.after(paren)
            if t.text(after) == "throws":
                while after < len(t.all) and t.text(after) not in ("{", ";"):
                    after += 1
            typed = (t.is_name(i - 1) and before not in KEYWORDS["java"] and before not in _JAVA_MODIFIERS) or before in (">", "]")
            owner = types.get(t.inside[i])
            maker = owner == word and not (typed and before not in (">",))
            if t.text(after) == "{" and before not in (".", "new") and (typed or maker):
                span = (self.at(self._statement_start(i)), self.end(after))
                self.found.definitions.append(Definition(word, *span, (self.at(paren), self.end(paren)), (self.at(after), span[1])))
                self.found.scopes.append((*span, word))
                continue
            if typed and before != "." and t.text(after) in (";", "default") and t.inside[i] in types:
                self.found.scopes.append((self.at(self._statement_start(i)), self.end(after - 1), word))
                continue  # declared without a body
            first = self.chain_start(i)
            if t.text(i - 1) not in ("new", "@") and not (t.text(first - 1) == "new" and first == i):
                self.add_call(i, paren)

    # Go -------------------------------------------------------------------
    def _go(self) -> None:
        t = self.t
        protocols: set[int] = set()
        for i, tok in enumerate(t.all):
            if tok.kind != "name":
                continue
            word, before = tok.text, t.text(i - 1)
            if word == "func":
                self._go_function(i)
                continue
            if word in ("struct", "interface") and t.text(i + 1) == "{":
                if word == "interface":
                    protocols.add(i + 1)
                name = t.mate[i - 1] - 1 if before == "]" and i - 1 in t.mate else i - 1
                group = t.inside[i]
                if t.is_name(name) and (t.text(name - 1) == "type" or (group >= 0 and t.text(group) == "(" and t.text(group - 1) == "type" and t.all[name].line_start)):
                    self.found.classes.append((self.at(name), t.text(name)))
                continue
            k = i + 1
            if t.text(k) == "[" and k in t.mate and t.text(t.after(k)) == "(" and before != ".":
                k = t.after(k)
            if t.text(k) == "(" and k in t.mate and i not in self.named and t.inside[i] not in protocols and (word not in KEYWORDS["go"] or before == ".") and before != "func":
                self.add_call(i, k)

    def _go_function(self, i: int) -> None:
        t = self.t
        k, receiver = i + 1, None
        if t.text(k) == "(" and t.all[i].line_start and t.inside[i] < 0 and t.is_name(t.after(k)):
            parts = [x for x in range(k + 1, t.mate.get(k, k)) if t.is_name(x) and t.text(t.inside[x]) == "("]
            receiver = t.text(parts[-1]) if parts else None
            k = t.after(k)
        name = k if t.is_name(k) else -1
        k += name >= 0
        if name >= 0 and t.text(k) == "[":
            k = t.after(k)
        if t.text(k) != "(" or k not in t.mate:
            return
        after = t.after(k)
        while after < len(t.all) and t.text(after) != "{" and not (t.all[after].line_start and name >= 0) and t.text(after) not in (",", ")", "}", ";", "=", ":="):
            after = t.after(after)
            if t.text(after) == "{" and t.text(after - 1) in ("interface", "struct"):
                after = t.after(after)
        body = (self.at(after), self.end(after)) if t.text(after) == "{" else None
        if name < 0:
            if body:
                self.found.anonymous.append((self.at(i), body[1]))
            return
        self.named.add(name)
        span = (self.at(i), body[1] if body else self.end(after - 1))
        self.found.definitions.append(Definition(t.text(name), *span, (self.at(k), self.end(k)), body, receiver=receiver))
        self.found.scopes.append((*span, t.text(name)))
