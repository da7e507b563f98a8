"""The macro stage: depth, circles, length, and a plain expansion to hold it against."""

import re
import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from inkwell.functions import macros as M

TENS = "abcdefghij"


def chain(n):
    letter = lambda k: chr(97 + k % 26)
    names = [f"\\m{letter(k // 676)}{letter(k // 26)}{letter(k)}" for k in range(n)]
    made = "".join(f"\\newcommand{{{a}}}{{{b}}}\n" for a, b in zip(names, [*names[1:], "BODY"], strict=True))
    return made, names


@pytest.mark.parametrize("n", [1, 12, 100, 2000])
@pytest.mark.parametrize("turned", [False, True])
def test_chains_of_any_depth(n, turned):
    made, names = chain(n)
    made = "".join(sorted(made.splitlines(keepends=True))) if turned else made
    assert M.expand_with_notes(f"{made}{names[0]}!") == ("BODY!", [])


def test_circles_stay_whatever_their_size():
    for body in ("x\\a", "\\a" * 10, "\\a{}" * 1000):
        text = f"\\newcommand{{\\a}}{{{body}}} A \\a"
        assert M.expand_with_notes(text) == (text, ["runaway:a"])
    text = "\\def\\a{\\b}\\def\\b{\\verb|x|\\a \\d}\\def\\c{<\\a>}\\def\\d{D}\\c \\d"
    assert M.expand_with_notes(text) == ("\\def\\a{\\b}\\def\\b{\\verb|x|\\a \\d}\\def\\d{D}<\\a> D", ["runaway:a", "runaway:b"])


@pytest.mark.parametrize("levels", [6, 10, 60])
def test_overlong_macros_stay(levels):
    names = [f"\\l{'ab'[k % 2]}{'c' * (k // 2)}" for k in range(levels)]
    made = "".join(f"\\newcommand{{{a}}}{{{b * 10}}}\n" for a, b in zip(names, [*names[1:], "xy"], strict=True))
    start = time.perf_counter()
    text, notes = M.expand_with_notes(f"{made}{names[0]} {names[-1]}")
    assert time.perf_counter() - start < 1
    assert text.startswith(made) and text.endswith(f"{names[0]} " + "xy" * 10)
    assert notes and all(n.startswith("overlong:") for n in notes)


def test_many_uses_are_bounded_together():
    text = "\\def\\a{" + "x" * 900 + "}\\def\\b{y}" + "\\a\\b" * 30_000
    out, notes = M.expand_with_notes(text)
    assert notes == ["overlong:a"] and out == "\\def\\a{" + "x" * 900 + "}" + "\\ay" * 30_000
    out, notes = M.expand_with_notes(text, bounds=M.Bounds(text=30_000_000))
    assert not notes and len(out) == 901 * 30_000
    assert M.expand_with_notes("\\newcommand{\\w}[1]{#1#1}" + "\\w{" * 40 + "x" + "}" * 40)[1] == ["overlong:w"]


def test_arguments_of_later_macros():
    assert M.expand_macros("\\newcommand{\\x}{\\y}\\newcommand{\\y}[1]{<#1>}\\x{a}") == "<a>"
    assert M.expand_macros("\\newcommand{\\m}[1]{<#1>}\\newcommand{\\br}{{a}}\\m\\br") == "<a>"
    assert M.expand_macros("\\newcommand{\\b}[1]{\\c{#1#1}}\\newcommand{\\c}[1]{\\d{#1#1}}\\newcommand{\\d}[1]{(#1)}\\b{\\b{x}}") == "((xxxx)(xxxx)(xxxx)(xxxx))"
    assert M.expand_macros("\\newcommand{\\no}[1]{}\\no{\\no{x}}y") == "y"
    assert M.expand_macros("\\newcommand{\\a}[1]{<#1#2>}\\a{\\a{\\a{1}}}") == "<<<1#2>#2>#2>"


def test_macros_that_feed_themselves():
    for body in ("x#1{#1}", "#1{#1}#1{#1}"):
        text = f"\\newcommand{{\\d}}[1]{{{body}}}\\def\\e{{E}}\\d{{\\d}} \\e"
        assert M.expand_with_notes(text) == (text.replace("\\def\\e{E}", "").replace("\\e", "E"), ["overlong:d"])
    assert M.expand_with_notes("\\newcommand{\\d}[1]{#1{#1}}\\d{\\d}")[0].endswith("\\d{\\d}")


def passes(text):
    """All uses from the left, again and again, until nothing changes."""
    macros, text = M.harvest(text)
    names = "|".join(sorted(map(re.escape, macros), key=len, reverse=True))
    while True:
        out, at = "", 0
        for m in re.finditer(rf"\\\\|\\({names})(?![A-Za-z@])", text):
            if m.start() >= at and m[1] and (got := M.arguments(text, m.end(), macros[m[1]])):
                out += text[at : m.start()] + re.sub(r"#(\d)", lambda d: got[0][int(d[1]) - 1] if 0 < int(d[1]) <= len(got[0]) else d[0], macros[m[1]].body)
                at = got[1]
        if (out := out + text[at:]) == text:
            return text
        text = out


PIECE = st.sampled_from(["x", " ", "{", "}", "{}", "[y]", "#1", "#2", "\\\\", "\n", "{z}", "\\\\a"])


@settings(max_examples=500, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 2), st.booleans(), st.lists(st.one_of(PIECE, st.integers(0, 9)), max_size=5)), min_size=1, max_size=6), st.lists(st.one_of(PIECE, st.integers(0, 5)), max_size=12))
def test_as_plain_passes_give_it(made, rest):
    # A macro uses later ones only, so nothing is circular.
    use = lambda x, least: x if isinstance(x, str) else f"\\{TENS[x]}" if least <= x < len(made) else "u"
    text = ""
    for k, (arity, default, body) in enumerate(made):
        body = "".join(use(x, k + 1) for x in body if x not in ("{", "}"))
        text += f"\\newcommand{{\\{TENS[k]}}}" + (f"[{arity}]" if arity else "") + ("[d]" if default and arity else "") + f"{{{body}}}"
    text += "".join(use(x, 0) for x in rest)
    got, notes = M.expand_with_notes(text)
    if not notes:
        assert got == re.sub("\n{3,}", "\n\n", passes(text))


def test_definitions_are_kept_or_gone():
    assert M.expand_with_notes("\\providecommand{\\a}{no}\\newcommand{\\a}{\\b}\n\\def\\b{1}\n\\a") == ("1", [])
    assert M.expand_with_notes("plain # text \\\\ \\unknown{x}") == ("plain # text \\\\ \\unknown{x}", [])
    assert M.expand_with_notes(None) == (None, []) and M.expand_with_notes("") == ("", [])
