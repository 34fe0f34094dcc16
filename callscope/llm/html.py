"""Main text of web pages by a maximum-scoring subsequence.

A page is a sequence of text pieces and tags.  Words score positive and tags negative; one
linear scan finds the contiguous region of the highest total.  A word's score is its log
odds of being main text by where it stands: in links or not, below which elements, in
blocks of which class.  A tag's score is how often its kind occurs inside and outside of the
main text.  Both come from labelled pages; no list says what is boilerplate.

The region grows to the block around it where the words so gained score positive, and to
all of an element whose own weights mark it as main.  Blocks inside the region whose words
score negative in total and far below the others, such as menus, forms or adverts, are left
out; the rest is the text.

The pages at hand have no labels, so the labelled pages are made by rule
(:func:`labelled_pages`): layouts with and without semantic tags and telling classes, their
main text marked by comments.
"""

from __future__ import annotations

import html as _html
import math
import random
import re
from collections import Counter
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callscope.llm.common import map_arrow, slices

#: Elements whose content is no markup, up to their end tag or the page's end.
_RAW = frozenset("script style textarea title iframe noscript xmp noembed noframes template".split())
_TOKEN = re.compile(r"<!--[\s\S]*?(?:--!?>|\Z)|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/<>]*)|(?P<text>(?:[^<]++|<(?![a-zA-Z!?/]))+)|<[!?/][^>]*(?:>|\Z)|<")
#: What begins with a name but is no whole tag.
_BROKEN = re.compile(r"</[^>]*(?:>|\Z)|<[a-zA-Z][^<>]*\Z|<")
#: What ends a run of attributes, and a quote that opens a value.
_STOP = re.compile(r"[<>]|=\s*+[\"']")
_END_RAW = {name: re.compile(rf"</{name}\s*>|\Z", re.IGNORECASE) for name in _RAW}
_ATTR = re.compile(r"(?:^|[\s\"'])(?:class|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.IGNORECASE)
_SPLIT = re.compile(r"[^A-Za-z]+|(?<=[a-z])(?=[A-Z])")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split()
)
#: A start tag of a block ends an open paragraph; these end an open one of their own kind, too.
_ENDS_OWN = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr",), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
_SCOPE = frozenset("ul ol dl table article section div body aside nav main".split())
#: Blocks that can be left out as a whole, and whose class and role count: what pages are laid out with, but for the page itself.
_PARTS = frozenset("address article aside details dialog div dl fieldset figure footer form header hgroup main menu nav ol section table td ul".split())
#: What holds no text of the page (by the HTML standard).
_NO_TEXT = frozenset("head script style template noscript object svg math canvas audio video select datalist button".split())
#: Labelled pages that must show a feature for it to be learned.
LEAST_PAGES = 3
#: Log odds from which an element's own weights mark it as main.
MAIN_ODDS = 1.0
#: How far below the region's mean log odds a block's must be to be left out.
GAP = 4.0
#: Shares of a word's log odds that are tried as its weight.
SHARES = (1.0, 0.5, 0.3, 0.2, 0.1, 0.05)
_ITEMS = frozenset("li dd dt td th".split())


def _tag_end(html: str, at: int, failed: set[int], last: dict[str, int]) -> int:
    """Where the tag whose attributes begin at ``at`` has its >, or -1: quoted values of any length may hold brackets.

    A quote that is never closed is a character.  ``failed`` (quotes after which no end
    came) and ``last`` (quotes that are never closed) keep all scans of a page linear.
    """
    seen = []
    while (m := _STOP.search(html, at)) and m[0] != "<":
        if m[0] == ">":
            return m.start()
        q = m.end() - 1
        if q in failed:
            break
        seen.append(q)
        to = -1 if q >= last.get(html[q], len(html)) else html.find(html[q], q + 1)
        if to < 0:
            last[html[q]] = min(q, last.get(html[q], q))
        at = max(q, to) + 1
    failed.update(seen)
    return -1


def _tokens(html: str):
    """(text, None, whether it ends an element, attributes) of each text, (None, name, ...) of each tag, (whole, "", ...) of each comment."""
    at, failed, last = 0, set(), {}
    while at < len(html):
        m = _TOKEN.match(html, at)
        if (name := m["name"]) is None:
            at = m.end()
            if m["text"] is not None:
                yield m[0], None, False, ""
            elif m[0].startswith("<!--"):
                yield m[0], "", False, ""
            continue
        to = _tag_end(html, m.end(), failed, last)
        if to < 0:
            at = _BROKEN.match(html, at).end()
            continue
        name, at = name.lower(), to + 1
        if name in _RAW and not m["end"]:
            at = _END_RAW[name].search(html, at).end()
        else:
            yield None, name, bool(m["end"]), html[m.end() : to]


@lru_cache(1 << 14)
def _features(name: str, attrs: str, inside: str) -> tuple[str, ...]:
    """What an element says of the words in it: its name, the words of its class and role, and its name where it lies inside an article or main."""
    out = ["in " + name]
    if inside:
        out.append(f"in {name} of {inside}")
    if name in _PARTS and "=" in attrs:
        for m in _ATTR.finditer(attrs):
            out += ["class " + x.lower() for x in _SPLIT.split(m[1] or m[2] or m[3] or "") if x]
    return tuple(dict.fromkeys(out))


class Page:
    """Pieces of a page (texts and tags) in order, and its blocks.

    Of each piece: kind (of a tag; empty for texts), words, text, block (its line) and odds
    (log odds of each of its words).  parts: (first piece, end, odds of its own, parent) of
    each block of ``_PARTS``.
    """

    def __init__(self, html: str, weights: dict[str, float] | None = None):
        self.kind: list[str] = []
        self.words: list[int] = []
        self.text: list[str] = []
        self.block: list[int] = []
        self.odds: list[float] = []
        self.part: list[int] = []  # innermost part that a piece lies in, -1 for none
        self.parts: list[list] = []
        self.label: list[bool] = []  # as comments of labelled pages say
        self.features: list[frozenset[str]] = []  # of text pieces, only without weights
        self._read(html, weights)

    def _read(self, html: str, weights: dict[str, float] | None) -> None:
        stack: list[tuple] = []  # name, its new features, odds before it, part before it, article or main before it
        open_: Counter = Counter()
        known: Counter = Counter()  # features of the elements that are open
        odds = weights["bias"] if weights else 0.0
        block, hidden, inside, part, within = 0, 0, False, -1, ""

        def pop() -> None:
            nonlocal odds, part, within, hidden
            name, new, odds, outer, within = stack.pop()
            open_[name] -= 1
            hidden -= name in _NO_TEXT
            for f in new:
                known[f] -= 1
            if part != outer:
                self.parts[part][1] = len(self.kind)
                part = outer

        def close(names: tuple[str, ...], until: frozenset = frozenset()) -> None:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] in names:
                    while len(stack) > k:
                        pop()
                    return
                if stack[k][0] in until:
                    return

        def piece(kind: str, words: int, text: str) -> None:
            self.kind.append(kind)
            self.words.append(words)
            self.text.append(text)
            self.block.append(block)
            self.odds.append(odds)
            self.part.append(part)
            self.label.append(inside)

        for text, name, end, attrs in _tokens(html):
            if name is None:
                if hidden:
                    continue
                text = _html.unescape(text)
                if weights is None:
                    self.features.append(frozenset(f for f, n in known.items() if n))
                piece("", len(text.split()), text)
                continue
            if not name:
                if text in ("<!--[-->", "<!--]-->"):  # labelled pages only
                    inside = text == "<!--[-->"
                continue
            if name in BLOCK:
                block += 1
            kind, gap = name if name in BLOCK or name == "a" else "inline", " " if name in BLOCK or (name == "br" and not end) else ""
            if end:
                piece(kind, 0, gap)
                if open_[name]:
                    close((name,))
                continue
            if name in BLOCK and open_["p"]:
                close(("p",), _SCOPE)
            if name in _ENDS_OWN and any(open_[x] for x in _ENDS_OWN[name]):
                close(_ENDS_OWN[name], _SCOPE)
            if name in VOID:
                piece(kind, 0, gap)
                continue
            new = [f for f in _features(name, attrs if name in _PARTS else "", within) if not known[f]]
            own = sum(weights.get(f, 0.0) for f in new) if weights else 0.0
            stack.append((name, new, odds, part, within))
            open_[name] += 1
            hidden += name in _NO_TEXT
            known.update(new)
            odds += own
            if name in _PARTS:
                self.parts.append([len(self.kind), -1, own, part])
                part = len(self.parts) - 1
            if name in ("article", "main"):
                within = within or name
            piece(kind, 0, gap)
        while stack:
            pop()

    def scores(self, weights: dict[str, float]) -> list[float]:
        """Of each piece: its words' odds, as the words of a piece go together times their share, or its tag's cost."""
        share, other = weights["share"], weights["other tag"]
        return [share * o * n if not kind else weights.get("tag " + kind, other) for kind, o, n in zip(self.kind, self.odds, self.words, strict=True)]

    def region(self, weights: dict[str, float]) -> tuple[int, int]:
        """Start and end of the pieces of the main region; empty if no word scores positive."""
        a, b = best_region(self.scores(weights))
        around = []  # parts around the region's middle, innermost first
        p = self.part[a + (b - a) // 2] if a < b else -1
        while p >= 0:
            around.append(p)
            p = self.parts[p][3]
        for p in around:
            first, end, own, _ = self.parts[p]
            if first <= a and b <= end and sum(o * n for o, n in zip(self.odds[first:a] + self.odds[b:end], self.words[first:a] + self.words[b:end], strict=True)) > 0:
                a, b = first, end
        for p in around:
            first, end, own, _ = self.parts[p]
            if own >= MAIN_ODDS:
                a, b = min(a, first), max(b, end)
        return a, b

    def left_out(self, a: int, b: int) -> list[bool]:
        """Of each piece: whether it lies in a block whose words score negative in total, and on average far below those of pieces ``a`` to ``b``."""
        total, words = [0.0] * (len(self.parts) + 1), [0] * (len(self.parts) + 1)
        for p, o, n in zip(self.part, self.odds, self.words, strict=True):
            total[p] += o * n
            words[p] += n
        for p in range(len(self.parts) - 1, -1, -1):  # a block comes after those around it
            total[self.parts[p][3]] += total[p]
            words[self.parts[p][3]] += words[p]
        usual = sum(o * n for o, n in zip(self.odds[a:b], self.words[a:b], strict=True)) / max(sum(self.words[a:b]), 1)
        out = [False] * (len(self.parts) + 1)
        for p, (*_, outer) in enumerate(self.parts):
            out[p] = total[p] < min(0.0, (usual - GAP) * words[p]) or (outer >= 0 and out[outer])
        return [out[p] for p in self.part]

    def main_text(self, weights: dict[str, float]) -> str:
        a, b = self.region(weights)
        skip = self.left_out(a, b)
        blocks: list[str] = []
        parts: list[str] = []
        now = -1
        for k in range(a, b):
            if skip[k]:
                continue
            if self.block[k] != now:
                blocks.append("".join(parts))
                parts, now = [], self.block[k]
            parts.append(self.text[k])
        blocks.append("".join(parts))
        return "\n".join(x for x in (" ".join(t.split()) for t in blocks) if x)


def best_region(scores: list[float]) -> tuple[int, int]:
    """Start and end of the contiguous scores of the highest positive total, (0, 0) if there is none; one linear scan."""
    best, at, total, first = 0.0, (0, 0), 0.0, 0
    for k, score in enumerate(scores):
        total += score
        if total <= 0:
            total, first = 0.0, k + 1
        elif total > best:
            best, at = total, (first, k + 1)
    return at


def labelled_pages(count: int = 300, seed: int = 5) -> list[str]:
    """Pages by rule; comments ``[`` and ``]`` enclose their main text, in which what is no part of it is enclosed by ``]`` and ``[``."""
    rng = random.Random(seed)
    sounds = ["".join(p) for p in zip("bdfgklmnprstv" * 5, "aeiou" * 13, strict=True)]

    def words(low: int, high: int) -> str:
        line = " ".join("".join(rng.choices(sounds, k=rng.randint(1, 4))) for _ in range(rng.randint(low, high)))
        return line.capitalize() + rng.choice((".", ".", "?", ""))

    def links(n: int) -> str:
        return "".join(f'<li><a href="/{k}">{words(1, 3)}</a></li>' for k in range(n))

    def paragraph() -> str:
        inner = words(1, 60)
        if rng.random() < 0.3:
            inner += f' <a href="/x">{words(1, 3)}</a> <b>{words(1, 4)}</b> <em>{words(1, 2)}</em> {words(4, 20)}'
        table = f"<table><tr><th>{words(1, 2)}<th>{words(1, 2)}</tr><tr><td>{inner}</td><td>{words(1, 3)}</td></tr></table>"
        figure = f'<figure><img src="x"><figcaption>{words(3, 12)}</figcaption></figure>'
        rest = f"<div>{inner}</div>", f"<section><h3>{words(1, 4)}</h3><p>{inner}</p></section>", f"<ol><li>{inner}<li>{words(3, 12)}</ol>", f"<dl><dt>{words(1, 2)}<dd>{inner}</dl>", f"<pre>{inner}</pre>", table, figure, f'<ul><li><a href="/y">{words(2, 6)}</a></li></ul>'
        return rng.choice((f"<p>{inner}</p>",) * 9 + (f"<p>{inner}<br>{words(1, 9)}", f"<p><b>{inner}<br><p>{words(1, 20)}", f"<blockquote>{inner}</blockquote>", f"<ul><li>{inner}</li><li>{words(3, 12)}</li></ul>", f"<h2>{words(2, 6)}</h2><p>{inner}</p>") + rest)

    def pick(line: str) -> str:
        return rng.choice(line.split())

    def blank() -> str:
        """A class that tells nothing."""
        return "".join(rng.choices("bcdfghjklmnpqrstvwxz", k=7))

    def off(named: bool, inner: bool = False) -> str:
        """What is no main text, beside or inside of it; inside, something must tell it apart."""
        kind = rng.randrange(5)
        name = (pick("ad ads advert advertisement banner promo sponsored"), pick("cookie-notice notice alert consent newsletter popup modal"), pick("share sharing social toolbar"), pick("related recommended more-links pagination breadcrumb tags"), pick("comments comment-list replies disqus"))[kind]
        body = (f"<p>{words(3, 20)}</p>" if rng.random() < 0.5 else words(3, 15), f"<p>{words(6, 25)}</p><button>{words(1, 2)}</button>", f"<ul>{links(rng.randint(2, 5))}</ul>", f"<h3>{words(1, 3)}</h3><ul>{links(rng.randint(2, 8))}</ul>", "".join(f"<div><b>{words(1, 2)}</b><p>{words(3, 30)}</p></div>" for _ in range(rng.randint(1, 5))))[kind]
        tag = rng.choice(("div", "div", "div", "section", "aside") if named else ("aside",) if inner else ("div", "div", "aside"))
        return f'<{tag} class="{name if named else blank()}">{body}</{tag}>'

    out = []
    for _ in range(count):
        plain = rng.random() < 0.4  # no semantic tags
        named = rng.random() < 0.6  # but telling classes
        tag = lambda t, c, x: f'<div class="{c if named else blank()}">{x}</div>' if plain else f"<{t}>{x}</{t}>"  # noqa: E731, B023
        menu = tag("nav", pick("menu nav navbar navigation topnav"), f"<ul>{links(rng.randint(3, 12))}</ul>")
        top = tag("header", pick("header masthead topbar"), f"<h1>{words(1, 3)}</h1>" + menu) if rng.random() < 0.5 else menu
        side = tag("aside", pick("sidebar sidenav widget"), f"<h3>{words(1, 3)}</h3><ul>{links(rng.randint(2, 10))}</ul>" + (f"<p>{words(5, 15)}</p>" if rng.random() < 0.5 else ""))
        form = f"<form><label>{words(1, 3)}</label><input name='q'><p>{words(1, 8)}</p><button>{words(1, 2)}</button></form>"
        blocks = [paragraph() for _ in range(rng.randint(1, 14))]
        if named or not plain:
            for extra in [f"<aside>{words(3, 20)}</aside>"] * (rng.random() < 0.1) + [off(named, True)] * (rng.random() < 0.4) + [form] * (rng.random() < 0.1) + [f"<nav><ul>{links(3)}</ul></nav>"] * (rng.random() < 0.1):
                blocks.insert(rng.randint(1, len(blocks)), f"<!--]-->{extra}<!--[-->")
        title = f"<h1>{words(3, 10)}</h1>"
        body = (f"<header>{title}<p>{words(2, 8)}</p></header>" if not plain and rng.random() < 0.3 else title) + "".join(blocks)
        main = f"<!--[-->{body}<!--]-->"
        main = f'<div class="{pick("content post entry article story main-content post-body article-text") if named else blank()}">{main}</div>' if plain else rng.choice((f"<article>{main}</article>", f"<main>{main}</main>", f"<main><article>{main}</article></main>"))
        foot = tag("footer", pick("footer copyright bottom"), f"&copy; {words(2, 12)} " + f"<ul>{links(rng.randint(0, 5))}</ul>")
        around = [off(named) for _ in range(rng.randint(0, 2))] if named or not plain else []
        parts = [top, *around, *rng.sample([side, main], 2), *([off(named)] if around else []), *([form] if rng.random() < 0.5 else []), foot]
        out.append(f"<html><head><title>{words(2, 8)}</title></head><body>{''.join(parts)}</body></html>")
    return out


def fit(labelled: list[str]) -> dict[str, float]:
    """Weights from labelled pages.

    Features of words: a regularised logistic regression over all text pieces, each
    weighing the root of its words, by Newton's method.  Tags: log odds of their kind inside and
    outside of main text; a tag costs even where it is usual there, and no more than some
    words bring.  Their balance, the share of a word, is that which finds most pages' text.
    """
    pages = [Page(html) for html in labelled]
    usual = Counter(f for page in pages for f in frozenset().union(*page.features))
    names = sorted(f for f, n in usual.items() if n >= LEAST_PAGES)
    place = {f: k for k, f in enumerate(names)}
    texts = [k for page in pages for k, kind in enumerate(page.kind) if not kind]
    rows = [(fs, page.label[k], page.words[k]) for page in pages for fs, k in zip(page.features, (k for k, kind in enumerate(page.kind) if not kind), strict=True)]
    x = np.zeros((len(texts), len(names) + 1))
    x[:, -1] = 1
    for r, (fs, *_) in enumerate(rows):
        x[r, [place[f] for f in fs if f in place]] = 1
    y, w = np.array([label for _, label, _ in rows], float), np.sqrt([n for *_, n in rows])
    beta = np.zeros(x.shape[1])
    ridge = np.diag([0.5] * len(names) + [1e-3])
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        beta += np.clip(np.linalg.solve((x.T * (w * p * (1 - p))) @ x + ridge, x.T @ (w * (y - p)) - ridge @ beta), -3, 3)
    found = {f: float(beta[k]) for f, k in place.items()} | {"bias": float(beta[-1]), "other tag": -0.5}
    inside: Counter = Counter()
    outside: Counter = Counter()
    for page in pages:
        for kind, label in zip(page.kind, page.label, strict=True):
            if kind:
                (inside if label else outside)[kind] += 1
    for kind in inside.keys() | outside.keys():
        found["tag " + kind] = max(-3.0, min(-0.02, math.log((inside[kind] + 0.5) / (outside[kind] + 0.5))))
    best: tuple[int, dict[str, float]] = (-1, {})
    scored = [Page(html, found) for html in labelled]
    for share in SHARES:
        tried = found | {"share": share}
        right = 0
        for page in scored:
            a, b = page.region(tried)
            skip = page.left_out(a, b)
            right += all((a <= k < b and not skip[k]) == label for k, label in enumerate(page.label) if page.words[k])
        if right > best[0]:
            best = (right, tried)
    return best[1]


@lru_cache(1)
def weights() -> dict[str, float]:
    return fit(labelled_pages())


def extract_text(html: str | None, found: dict[str, float] | None = None) -> str:
    """Main text of one page, a line per block, by the weights ``found``; empty if there is none."""
    found = found or weights()
    return Page(html, found).main_text(found) if html else ""


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars (code points) of each row of ``pages`` (page_id, url, html).

    A null or empty page, and one without main text, has an empty text; repeated rows get
    a row each; other columns are ignored.
    """
    rows, found = pages.select("page_id", "url", "html"), weights()

    def run(batches):
        for batch in batches:
            for part in slices(batch, "html"):
                text = [extract_text(h, found) for h in part.column("html").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array(text, pa.string())], ["page_id", "url", "text"])

    kind = pages.schema["page_id"].dataType.simpleString()
    texts = map_arrow(rows, run, f"page_id {kind}, url string, text string")
    return texts.withColumn("n_chars", F.length("text").cast("long"))
