"""Whole runs: reachability, notes, pictures and side files."""

import io
import re
import zipfile

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import Observation
from pyspark.sql import functions as F

from inkwell.functions import notes
from inkwell.functions.graphs import circular, components
from inkwell.functions.paths import below, folder_of
from inkwell.operators import includes, latex
from inkwell.options import CleanOptions
from inkwell.plans import run

from test_kernels import package


def test_components():
    edges = {"a": ["b"], "b": ["c", "d"], "c": ["a"], "d": ["d"], "e": ["a", "f"], "f": []}
    found = components(edges)
    place = {n: k for k, part in enumerate(found) for n in part}
    assert sorted(map(sorted, found)) == [["a", "b", "c"], ["d"], ["e"], ["f"]]
    assert all(place[b] <= place[a] for a in edges for b in edges[a])
    assert [sorted(p) for p in components(edges, ["f"])] == [["f"]] and circular(["d"], edges) and not circular(["f"], edges)
    assert len(components({str(i): [str(i + 1)] if i < 5000 else [] for i in range(5001)})) == 5001


def test_paths(spark):
    rows = [("", "a", "a"), ("x/y", "../a", "x/a"), ("x", "./b//c", "x/b/c"), ("x", "../../a", None), ("", "../a/b", None), ("x/y", "../../z", "z"), ("x", "/abs", "x/abs")]
    df = spark.createDataFrame(rows, "f string, n string, want string")
    assert [r[0] for r in df.select(below(F.col("f"), F.col("n"))).collect()] == [r[2] for r in rows]
    assert [r[0] for r in spark.createDataFrame([("a/b/c.tex",), ("c",)], "p string").select(folder_of(F.col("p"))).collect()] == ["a/b", ""]


def test_a_flat_folder_of_many_roots(spark):
    n = 1000
    files = [(f"d{i}.tex", f"\\input{{s{i % 10}}} % \\input{{d{(i + 1) % n}}}\n\\include{{sub/x}}") for i in range(n)]
    files += [(f"s{i}.tex", f"S{i}") for i in range(10)] + [("sub/x.tex", "X \\input{y}"), ("sub/y.tex", "Y"), ("d1.bib", "no"), (None, "z")]
    texts = spark.createDataFrame(files, "path string, content string").repartition(4)
    roots = texts.where("path RLIKE '^d[0-9]+[.]tex$'").select("path")
    assert includes.reached(roots, texts).count() == 4 * n  # itself, its s, x and y
    flat = {r.path: (r.content, r.notes) for r in includes.flatten_roots(roots, texts).collect()}
    assert len(flat) == n and flat["d7.tex"] == ("S7 % \\input{d8}\n\\clearpage\nX Y\n\\clearpage", [])


def test_cycles_diamonds_and_outside_names(spark):
    files = [("p/a.tex", "A \\input{b} \\input{c} \\input{../q/e} \\input{../../no}"), ("p/b.tex", "B \\input{d}"), ("p/c.tex", "C \\input{d.tex} \\input{a}"), ("p/d.tex", "D"), ("q/e.tex", "E \\input{f} \\input{null}"), ("q/f.tex", "F"), ("q/null.tex", None)]
    texts = spark.createDataFrame(files, "path string, content string")
    got = includes.flatten_roots(spark.createDataFrame([("p/a.tex",), ("p/a.tex",), ("p/none.tex",)], "path string"), texts).collect()
    assert [(r.path, r.content) for r in got] == [("p/a.tex", "A B D C D \\input{a} E F \\input{null} \\input{../../no}")]
    assert [tuple(n) for n in got[0].notes] == [("cycle", "a"), ("unreadable", "null"), ("not-found", "../../no")]
    assert not includes.flatten_roots(texts.limit(0).select("path"), texts).collect()


def test_includes_are_bounded():
    files = {f"f{i}.tex": f"\\input{{f{i + 1}}}\\input{{f{i + 1}}}" for i in range(40)} | {"f40.tex": "x"}
    text, told = includes.flatten(files, "f0.tex")
    assert len(text) <= 8_000_000 and all(t.startswith("overlong:") for t in told) and told
    assert includes.flatten({f"f{i}.tex": f"\\input{{f{i + 1}}}" for i in range(3000)} | {"f3000.tex": "x"}, "f0.tex") == ("x", [])
    tangle = {f"f{i}.tex": "".join(f"\\input{{f{k}}}" for k in range(9)) for i in range(9)}
    text, told = includes.flatten(tangle, "f0.tex")
    assert "cycle:f0" in told and len(text) < 9_000_000


def test_notes_are_counted(spark, tmp_path):
    rows = [("r.tex", "\\input{r} \\input{no} \\def\\a{\\a} \\bibliography{x, y} \\includegraphics{g} \\includegraphics{g.png}"), ("s.tex", "fine \\includegraphics{h}"), ("y.bib", "@article{k, title={T}}"), ("h_summary.txt", "told")]
    texts = spark.createDataFrame(rows, "path string, content string")
    seen = Observation("notes")
    done = notes.observed(run.clean_projects(spark.createDataFrame([("r.tex",), ("s.tex",)], "path string"), texts), seen)
    done.write.parquet(str(tmp_path / "out"))
    assert seen.get == {"cycle": 1, "not-found": 1, "unreadable": 0, "runaway": 1, "overlong": 0, "missing-bib": 1, "missing-summary": 1}
    got = {r.doc_id: (r.content, sorted(tuple(n) for n in r.notes)) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got["s.tex"] == ("fine % [Image: told]", [])
    assert got["r.tex"][1] == [("cycle", "r"), ("missing-bib", "x.bib"), ("missing-summary", "g"), ("not-found", "no"), ("runaway", "a")]
    off = run.clean_projects(spark.createDataFrame([("r.tex",)], "path string"), texts, CleanOptions(flatten=False, comments=False, macros=False, bibliography=False, figures=False)).first()
    assert (off.content, off.notes) == (rows[0][1], [])


def deck(with_notes=True):
    ns = 'xmlns:p="p" xmlns:a="a" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
    sp = lambda i, t, ph="": f'<p:sp><p:nvSpPr><p:cNvPr id="{i}"/><p:nvPr>{ph}</p:nvPr></p:nvSpPr><p:txBody><a:p><a:r><a:t>{t}</a:t></a:r></a:p></p:txBody></p:sp>'
    rel = lambda i, kind, target: f'<Relationship Id="{i}" Type="x/{kind}" Target="{target}"/>'
    return package({
        "ppt/presentation.xml": f'<p:presentation {ns}><p:sldIdLst><p:sldId r:id="b"/></p:sldIdLst></p:presentation>',
        "ppt/_rels/presentation.xml.rels": f"<Relationships>{rel('b', 'slide', 'slides/slide1.xml')}</Relationships>",
        "ppt/slides/slide1.xml": f'<p:sld {ns}><p:cSld><p:spTree>{sp(1, "in")}<p:pic><p:nvPicPr><p:cNvPr id="9"/></p:nvPicPr></p:pic></p:spTree></p:cSld></p:sld>',
        "ppt/slides/_rels/slide1.xml.rels": f"<Relationships>{rel('n', 'notesSlide', '../notes/n.xml')}</Relationships>",
        "ppt/notes/n.xml": f"""<p:notes {ns}><p:cSld><p:spTree>{sp(1, 'say', '<p:ph type="body"/>')}</p:spTree></p:cSld></p:notes>""",
    })


@pytest.mark.parametrize("said", [True, False])
def test_speaker_notes_and_pictures_in_runs(spark, tmp_path, said):
    top = tmp_path / "t"
    (top / "talks").mkdir(parents=True)
    (top / "talks" / "d.PPTX").write_bytes(deck())
    (top / "talks" / "d_slide1_image1_summary.txt").write_text(" a\u00a0graph \n")
    (top / "d_slide1_image1_summary.txt").write_text("of another folder")
    (top / "broken.docx").write_bytes(b"no zip")
    got = {r.path: (r.kind, r.text, [tuple(n) for n in r.notes]) for r in run.clean_folder(spark, str(top), ["talks/d.PPTX", "broken.docx"], CleanOptions(notes=said)).collect()}
    assert got["talks/d.PPTX"] == ("pptx", "# Slide 1\n\nin\n\n[Image: a\u00a0graph]\n" + ("\n> **Notes:** say\n" if said else ""), [])
    assert got["broken.docx"] == ("docx", None, [("unreadable", "broken.docx")])


def _uses_by_line(text):
    """The include commands before each line's comment sign, plainly."""
    found = []
    for line in text.split("\n"):
        at = 0
        while at < len(line) and line[at] != "%":
            at += 2 if line[at] == "\\" and line[at + 1 : at + 2] in ("\\", "%") else 1
        found += re.findall(r"\\(?:input|include|subfile)\{[^}]+\}", line[:at])
    return found


@given(st.lists(st.sampled_from(["\\input{a}", "\\include{b c}", "\\subfile{", "}", "%", "\\", "\n", "x ", "\\input{", "\\includeonly{z}"]), max_size=14).map("".join))
@settings(max_examples=400, deadline=None)
def test_uses_are_found_as_line_by_line(text):
    files = {"r.tex": text}
    pieces = includes._Project({"r.tex": "", "t.tex": ""}, "r.tex", "", 100)
    pieces.files = files
    own = pieces.parse("r.tex")
    assert [u.text for u in own if not isinstance(u, str)] == _uses_by_line(text)
    assert "".join(u if isinstance(u, str) else u.text for u in own) == text


def test_one_hop_gives_what_the_stages_give_one_by_one(spark):
    texts = ["", None, "plain % gone\n\n\n\nx", "\\newcommand{\\a}{A}% c\n\\a{} \\verb|%\\a| %x", "100\\% \\x % y", "% only\n\\newcommand{\\l}{x\\l}\\l", "\\begin{comment}\\newcommand{\\z}{Z}\\end{comment}\\z", "% \\a\nx\n\n\n\ny"]
    df = spark.createDataFrame([(t,) for t in texts], "c string").select("c", latex.strip_comments("c").alias("bare"))
    rows = df.select(latex.text_stages(F.col("c")).alias("one"), latex.macro_stage(F.col("bare")).alias("two"), latex.text_stages(F.col("c"), expand=False)["text"].alias("bare2"), "bare").collect()
    assert [r.one for r in rows] == [r.two for r in rows] and [r.bare for r in rows] == [r.bare2 for r in rows]
    clean = latex.cleaner()
    assert [(r.one.text, r.one.notes) for r in rows] == [clean(t) for t in texts]
