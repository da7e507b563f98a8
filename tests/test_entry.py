"""The driver contract, and sources that need files."""

import subprocess
import sys
from pathlib import Path

from pyspark.sql import functions as F

from inkwell.operators import assets, bibliography
from inkwell.plans.cleaning import clean_latex
from inkwell.options import CleanOptions
from inkwell.sources import tex
from inkwell.streaming.ingest import clean_arrivals

ROOT = Path(__file__).resolve().parent.parent


def test_entry_is_imported_without_a_session():
    code = "import __spark_entry__ as e; q = e.queries(); assert q and set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True, timeout=120)


def test_bib_files(spark):
    files = spark.createDataFrame([("r", "a.bib", "@article{k, title={T}, year=2001}@book{l, author={A}}"), ("r", "b.bib", None)], "root_dir string, bib_path string, content string")
    got = [(r.entry_no, r.key, r.kind, r.fields) for r in tex.bib_entries(files).orderBy("entry_no").collect()]
    assert got == [(0, "k", "article", {"title": "T", "year": "2001"}), (1, "l", "book", {"author": "A"})]


def test_bib_paths(spark):
    wanted = spark.createDataFrame([(1, "refs, gone.bib")], "doc_id long, names string")
    files = spark.createDataFrame([("b/refs.bib",), ("a/refs.bib",)], "path string")
    got = {r.name: r.path for r in bibliography.resolve_bibs(wanted, files, ["", "a", "b"]).collect()}
    assert got == {"refs.bib": "a/refs.bib", "gone.bib": None}


def test_all_stages_off_is_identity(spark):
    docs = spark.createDataFrame([(1, "a % b \\input{x}"), (2, None), (3, "")], "doc_id long, content string")
    off = CleanOptions(flatten=False, comments=False, macros=False, bibliography=False, figures=False)
    assert sorted(clean_latex(docs, off).collect()) == sorted(docs.collect())
    assert clean_latex(docs.limit(0)).count() == 0


def test_macro_diagnostics(spark):
    made = "\\newcommand{\\a}{" + "\\a" * 10 + "}\\a"
    docs = spark.createDataFrame([(1, made), (2, "\\def\\b{c}\\b"), (None, None)], "doc_id long, content string")
    got = {r.doc_id: (r.content, r.diagnostics) for r in clean_latex(docs, diagnostics=True).collect()}
    assert got == {1: (made, ["runaway:a"]), 2: ("c", []), None: (None, [])}


def test_summaries(spark):
    class Echo:
        def describe(self, data, mime, kind):
            if data == b"bad":
                raise ValueError("broken")
            return f" {kind}:{data.decode()} "

    rows = [("a", b"x", "image/png", "figure"), ("b", b"x", "image/png", "figure"), ("c", b"bad", "image/png", "table"), ("d", b"y", "image/png", "figure")]
    given = spark.createDataFrame(rows, "stem string, bytes binary, mime string, prompt_kind string")
    known = spark.createDataFrame([("d", "old")], "stem string, text string")
    got = {r.stem: (r.text, r.error) for r in assets.summarize(given, known, Echo(), wait=lambda s: None).collect()}
    assert got == {"a": ("figure:x", None), "b": ("figure:x", None), "c": (None, "broken")}
    assert assets.distinct_calls(given).count() == 3


def test_scan_and_stream(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    (source / "a.tex").write_bytes(b"x % c\r\ny\r\n")
    assert [r.content for r in tex.read_files(spark, str(source)).collect()] == ["x % c\ny\n"]
    assert [r.content for r in tex.read_files(spark, str(source), "latin-1").collect()] == ["x % c\ny\n"]
    assert [r.content for r in tex.read_files(spark, str(source), "cp1252").collect()] == ["x % c\ny\n"]
    clean_arrivals(spark, str(source), str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination(60)
    assert [r.content for r in spark.read.parquet(str(tmp_path / "out")).collect()] == ["x\ny\n"]
    kinds = spark.createDataFrame([("a.PDF",), ("b/c.docx",), ("x",)], "p string").select(tex.kind_of(F.col("p")).alias("k")).collect()
    assert [r.k for r in kinds] == ["pdf", "docx", "tex"]
