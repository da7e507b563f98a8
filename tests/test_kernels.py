"""Parsers: literal passages, macros, BibTeX, math markup, office files."""

import io
import zipfile

from hypothesis import given
from hypothesis import strategies as st

from inkwell.functions import kernels as K
from inkwell.operators.includes import flatten

LATEX = st.lists(st.sampled_from([*"ab%\\{}[]# \n|", "\\verb|", "\\begin{verbatim}", "\\end{verbatim}"]), max_size=40).map("".join)


@given(LATEX)
def test_mask_is_undone(text):
    assert K.unmask(*K.mask(text)) == text


@given(LATEX)
def test_comments_are_stripped_once_and_for_all(text):
    once = K.strip_comments(text)
    assert K.strip_comments(once) == once


def test_comments():
    assert K.strip_comments("50\\% of % c\n  % only\na\\\\% c\nb") == "50\\% of\na\\\\\nb"
    assert K.strip_comments("\\verb|%| x % y") == "\\verb|%| x"
    assert K.strip_comments("a\n\\begin{lstlisting}\n% keep\n\\end{lstlisting}") == "a\n\\begin{lstlisting}\n% keep\n\\end{lstlisting}"
    assert K.strip_comments(None) is None


def test_macros():
    run = K.expand_macros
    assert run("\\newcommand{\\a}[2][d]{#1#2}\\a{x} \\a[y]{z}") == "dx yz"
    assert run("\\newcommand{\\a}[1]{<#1>}\\a") == "\\a"
    assert run("\\newcommand{\\R}{r}\\newcommand{\\Rn}{n}\\Rn \\R{} \\Rx") == "n r \\Rx"
    assert run("\\newcommand{\\a}[2]{#1}\\a{#2}{x}") == "#2"
    assert run("x\\\\a\\def\\a{b}") == "x\\\\a"
    assert run("\\newcommand{\\o}{\\newcommand{\\i}{1}}next line") == "next line"
    assert run("\\newcommand{\\a}{\\a\\a}\\a") == "\\newcommand{\\a}{\\a\\a}\\a"  # circular: as it was
    assert run("\\usepackage{x}\na", keep_packages=True) == "\\usepackage{x}\na"
    assert run("\\begin{verbatim}\\a\\end{verbatim}\\def\\a{b}\\a") == "\\begin{verbatim}\\a\\end{verbatim}b"


def test_macros_of_long_texts():
    long = "x" * 5_000_001
    assert K.expand_with_notes("\\newcommand{\\a}[1]{<#1>}\\a{b}" + long) == ("<b>" + long, [])
    assert K.expand_macros("\\def\\b{" + "y" * 1000 + "}" + "\\b" * 6000) == "y" * 6_000_000


def test_runaway_macros_keep_their_definitions():
    made = "\\newcommand{\\a}{" + "\\a" * 10 + "}"
    text, notes = K.expand_with_notes(made + "\\def\\ok{fine}\\a \\ok")
    assert (text, notes) == (made + "\\a fine", ["runaway:a"])


def test_bibtex():
    found = K.parse_bibtex('@string{j = "Jour"}@comment{x}@Article{k1, author = {A and {B}}, journal = j # " nal", year=1999}@book{k2,title="T {x}"}')
    assert found == [("k1", "article", {"author": "A and {B}", "journal": "Jour nal", "year": "1999"}), ("k2", "book", {"title": "T {x}"})]
    assert K.parse_bibtex("") == [] and K.parse_bibtex("@article{broken") == []


def test_includes():
    files = {"main.tex": "a \\input{x} % \\input{y}\n\\include{sub/y}", "x.tex": "X", "sub/y.tex": "Y \\input{z}", "sub/z.tex": "\\input{main} \\input{no}"}
    text, notes = flatten(files, "main.tex")
    assert text == "a X % \\input{y}\n\\clearpage\nY \\input{main} \\input{no}\n\\clearpage"
    assert notes == ["cycle:main", "not-found:no"]


def package(parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for path, text in parts.items():
            z.writestr(path, text)
    return out.getvalue()


def test_few_texts_are_objects_at_a_time():
    import pyarrow as pa

    from inkwell.functions import kernels

    texts = pa.array([None if k % 7 == 0 else f"t{k}" for k in range(1000)])
    assert kernels.mapped(texts, str.upper, pa.string()).to_pylist() == [None if k % 7 == 0 else f"T{k}" for k in range(1000)]
    assert kernels.mapped(texts.slice(0, 0), str.upper, pa.string()).to_pylist() == []


def test_modules_need_no_session():
    import subprocess
    import sys
    from pathlib import Path

    done = subprocess.run([sys.executable, "-c", "import __spark_entry__; __spark_entry__.queries()"], cwd=Path(__file__).resolve().parent.parent, capture_output=True)
    assert done.returncode == 0, done.stderr[-500:]
