"""Italics, brackets and figures."""

import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from inkwell.functions import brackets, figures
from inkwell.functions.text import strip_italics

TEXTS = ["_a_", "a_b_c", "_a_ _b_", "_a__b_", "__a__", "x _a b_ y", "_a_b_", "é_x_ _é_", "_", "__", "___", "", "no", "_\n_", "(_x_)", "_a_._b_", "_a_ b_ _c_", "a _b", "_1_2_ _3_"]


def plainly(text):
    """Italic text from the left, looking at one underscore after the other."""
    out, at = "", 0
    word = lambda c: c.isalnum() or c == "_"
    while at < len(text):
        end = text.find("_", at + 1) if text[at] == "_" and not (at and word(text[at - 1])) else -1
        if end > at + 1 and not (end + 1 < len(text) and word(text[end + 1])):
            out, at = out + text[at + 1 : end], end + 1
        else:
            out, at = out + text[at], at + 1
    return out


def test_italics(spark):
    import random

    random.seed(1)
    texts = TEXTS + ["".join(random.choices("__a .é\n", k=random.randint(0, 25))) for _ in range(600)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    assert [r.t for r in df.select("i", strip_italics(F.col("t")).alias("t")).orderBy("i").collect()] == [plainly(t) for t in texts]


@pytest.mark.parametrize("text, want", [("x[ˆ]2", "x^2"), ("a [(] i [)] b", "a (i) b"), ("[(][i][)]", "(i)"), ("[(] [ i ] [)]", "( i )"), ("[(][)]", "()"), ("[a] [b] c", "a b c"), ("[a][b]", "a b "), ("[a] [1] [b]", "[a] [1] [b]"), ("[1][2]", "[1][2]"), ("[a] x [b]", "[a] x [b]"), ("[] [a] [b]  z", "[] a b z"), ("[", "["), ("a]", "a]"), ("[(] [a] [b] [)]", "( a b ) "), ("[(] x", "[(] x")])
def test_brackets(text, want):
    assert brackets.clean(text) == want
    assert brackets.clean_lines(f" | {text}\n{text}") == f" | {text}\n{want}"


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["[a]", "[b c]", "[1]", "[(]", "[)]", " ", "x", "[]", "^"]), max_size=12).map("".join))
def test_brackets_lose_no_letters(text):
    assert re.sub(r"[\[\]\s]", "", brackets.clean(text)) == re.sub(r"[\[\]\s]", "", text)
    assert brackets.clean(text.replace("[", "").replace("]", "")) == text.replace("[", "").replace("]", "")


def test_figures():
    text = "a \\includegraphics [w={1}]{x/{y}.png} \\begin{figure}[ht]\n\\includegraphicsx{no}\\includegraphics{g}\\caption{A {b {c {d}}} \\} e}\n\\label{f:1}\\end{figure} \\begin{figure}none\\end{figure} \\includegraphics{} \\includegraphics{open"
    assert [(h.name, text[h.start : h.end][:20]) for h in figures.graphics(text)] == [("x/{y}.png", "\\includegraphics [w="), ("g", "\\includegraphics{g}")]
    (only,) = figures.figures(text)
    assert (only.name, only.label, only.caption) == ("g", "\\label{f:1}", "A {b {c {d}}} \\} e") and text[only.end :].startswith(" \\begin{figure}none")


def test_many_italics_in_one_text(spark):
    import time

    start, n = time.monotonic(), 20_000
    df = spark.createDataFrame([("_a_ b " * n,)], "x string").repartition(1)
    assert df.select(strip_italics(F.col("x")).alias("y")).first().y == "a b " * n
    assert time.monotonic() - start < 30  # a text cut anew at each of its signs takes minutes
