"""Masks, retries and whole runs."""

import pytest
from pyspark.sql import functions as F

from inkwell.functions import kernels as K
from inkwell.operators import assets
from inkwell.plans import run


@pytest.mark.parametrize("text", ["a\x007\x00b % c", "\x000\x00 \\verb|y|", "\uf8ff0\uf8ff \\verb|%| \uf8ff1", "\\verb!%! % x"])
def test_keys_are_no_text(text):
    assert K.unmask(*K.mask(text)) == text
    assert K.strip_comments(text) == K.strip_comments(text.replace("\x00", "N").replace("\uf8ff", "P")).replace("N", "\x00").replace("P", "\uf8ff")


@pytest.mark.parametrize("errors, text, error", [([], "figure of 3", None), (["HTTP 502", "Rate Limit hit"], "figure of 3", None), (["Connection reset"] * 3, None, "Connection reset"), (["500 bad"], None, "500 bad")])
def test_calls_are_made_again(spark, errors, text, error):
    class Flaky:  # in here, so that workers get it by value
        def __init__(self, errors):
            self.errors = list(errors)

        def describe(self, data, mime, kind):
            if self.errors:
                raise RuntimeError(self.errors.pop(0))
            return f" {kind} of {len(data)} "

    rows = spark.createDataFrame([("a", b"xyz", "image/png", "figure"), ("b", b"xyz", "image/png", "figure")], "stem string, bytes binary, mime string, prompt_kind string").coalesce(1)
    none = spark.createDataFrame([], "stem string, text string")
    got = assets.summarize(rows, none, Flaky(errors), wait=lambda s: None).collect()
    assert sorted((r.stem, r.text, r.error) for r in got) == [("a", text, error), ("b", text, error)]


def test_a_folder(spark, tmp_path):
    top = tmp_path / "p"
    (top / "ch").mkdir(parents=True)
    (top / "main.tex").write_text("% c\n\\newcommand{\\w}[1]{<#1>}\n\\input{ch/a}\n\\includegraphics{ch/g.png}\nSee \\cite{k}.\n\\bibliography{refs}\n")
    (top / "ch" / "a.tex").write_text("body \\w{1}")
    (top / "ch" / "g_summary.txt").write_text("a picture\n")
    (top / "refs.bib").write_text("@article{k, author={A B}, title={T}, year=1999}")
    (tmp_path / "solo.tex").write_text("hi % x\r\n\\bibliography{z}")
    (tmp_path / "solo.bbl").write_text("BBL")
    (tmp_path / "x.PDF").write_bytes(b"%PDF")
    pdf = spark.createDataFrame([("x.PDF", "from pages")], "path string, text string")
    got = {r.path: (r.kind, r.text) for r in run.clean_folder(spark, str(tmp_path), ["p/main.tex", "solo.tex", "x.PDF"], pdf=pdf).collect()}
    assert got["solo.tex"] == ("tex", "hi\nBBL") and got["x.PDF"] == ("pdf", "from pages")
    assert got["p/main.tex"] == ("tex", "body <1>\n% [Image: a picture]\nSee \\cite{k}.\n\\begin{thebibliography}{1}\n\n\\bibitem{k}\nA B. \\textit{T}. 1999.\n\n\\end{thebibliography}\n")
    with pytest.raises(FileNotFoundError):
        run.clean_folder(spark, str(tmp_path), ["none.tex"])
    assert run.parser().parse_args(["f", "a.tex", "-o", "out", "--no-macros"]).macros is False


def test_prompts_and_media_types(spark):
    got = spark.range(1).select(assets.mime_of(F.lit("a/b.JPEG")).alias("a"), assets.mime_of(F.lit("a.png/b")).alias("b")).first()
    assert (got.a, got.b) == ("image/jpeg", "application/octet-stream") and set(assets.PROMPTS) == {"figure", "table"}
