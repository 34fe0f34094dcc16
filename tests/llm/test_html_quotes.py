"""Quoted attribute values of any length."""

import time

import pytest

from callscope.llm import html

MAIN = "<article><p>" + "the main text of this page has many words " * 8 + "</p></article>"


@pytest.mark.parametrize("n", [900, 1100, 200_000])
@pytest.mark.parametrize("q", ['"', "'"])
def test_long_values_with_brackets(n, q):
    for value in ("<b>" + "x" * n + "</b>", "{a > b " + "x" * n + "}", "a<b " + "x" * n):
        for tag in (f"<div data-embed={q}{value}{q}>after</div>", f"<aside class=ad data-j={q}{value}{q}>gone</aside>", f"<script data-j={q}{value}{q}>code()</script>"):
            page = html.Page(f"<body>{tag}{MAIN}</body>")
            text = "".join(page.text)
            assert "xxx" not in text and "code()" not in text and ("after" in text) == ("after" in tag)
            assert "gone" not in html.extract_text(f"<body>{tag}{MAIN}</body>")


def test_a_quote_that_opens_no_value_is_a_character():
    assert "".join(html.Page("<p it's>one</p> " + "y " * 800 + "<p it's>two</p>").text).split()[::801] == ["one", "two"]
    assert "".join(html.Page('<p title="open>one').text).strip() == "one"


@pytest.mark.parametrize("unit", ['<b " ="', "<b ='\" =\"", '<a "', "<a ='", '<a b="<', "<a =\"' ='", "<script a='\""])
def test_scans_stay_linear(unit):
    began = time.perf_counter()
    html.Page(unit * 60_000)
    assert time.perf_counter() - began < 10
