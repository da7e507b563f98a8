"""Office files through their rows: blocks, spans, tables, shapes, pictures and notes."""

import pytest

from inkwell.plans import office

from test_kernels import package


def markdown(spark, kind, data, told=None, notes=False):
    files = spark.createDataFrame([("f", kind, data)], "doc_id string, kind string, content binary")
    known = spark.createDataFrame([("f", k, v) for k, v in (told or {}).items()], "doc_id string, place string, summary string")
    return office.office_documents(files, known, notes).first().markdown


W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'


def test_docx(spark):
    run = lambda t, p="": f"<w:r><w:rPr>{p}</w:rPr><w:t>{t}</w:t></w:r>"
    body = f"""<w:p><w:pPr><w:pStyle w:val="Heading2"/></w:pPr>{run("Head", "<w:b/>")}</w:p>
<w:p>{run("a", "<w:b/>")}{run("b ", "<w:b/>")}{run("c")}{run("d", '<w:i w:val="0"/>')}<w:r><w:commentReference w:id="5"/></w:r></w:p>
<w:p><w:r><w:drawing/></w:r></w:p>
<w:tbl><w:tr><w:tc><w:p>{run("x|")}</w:p></w:tc><w:tc><w:p>{run("y")}</w:p></w:tc></w:tr><w:tr><w:tc><w:p>{run("1")}</w:p></w:tc></w:tr></w:tbl>"""
    data = package({"word/document.xml": f"<w:document {W}><w:body>{body}</w:body></w:document>", "word/comments.xml": f'<w:comments {W}><w:comment w:id="5" w:author="Al"><w:p>{run("why")}</w:p></w:comment></w:comments>'})
    assert markdown(spark, "docx", data, {"image1": "pic"}) == "## Head\n\n**ab** cd\n\n> **Comment (Al):** why\n\n[Image: pic]\n\n| x\\| | y |\n| --- | --- |\n| 1 |  |\n"
    assert markdown(spark, "docx", None) is None and markdown(spark, "docx", b"no zip") is None and markdown(spark, "pptx", b"") is None


def test_pptx(spark):
    ns = 'xmlns:p="p" xmlns:a="a" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships" xmlns:mc="mc"'
    sp = lambda i, t, ph="": f'<p:sp><p:nvSpPr><p:cNvPr id="{i}"/><p:nvPr>{ph}</p:nvPr></p:nvSpPr><p:txBody><a:p><a:r><a:t>{t}</a:t></a:r></a:p></p:txBody></p:sp>'
    pic = '<p:pic><p:nvPicPr><p:cNvPr id="9"/></p:nvPicPr></p:pic>'
    slide = f"<p:sld {ns}><p:cSld><p:spTree>{sp(1, 'T', '<p:ph type=&quot;title&quot;/>'.replace('&quot;', chr(34)))}<p:grpSp>{sp(2, 'in group')}</p:grpSp>{pic}<mc:AlternateContent><mc:Choice>{sp(7, 'hidden')}</mc:Choice></mc:AlternateContent></p:spTree></p:cSld></p:sld>"
    rel = lambda i, kind, target: f'<Relationship Id="{i}" Type="x/{kind}" Target="{target}"/>'
    data = package({
        "ppt/presentation.xml": f'<p:presentation {ns}><p:sldIdLst><p:sldId r:id="b"/></p:sldIdLst></p:presentation>',
        "ppt/_rels/presentation.xml.rels": f"<Relationships>{rel('b', 'slide', 'slides/slide3.xml')}</Relationships>",
        "ppt/slides/slide3.xml": slide,
        "ppt/slides/_rels/slide3.xml.rels": f"<Relationships>{rel('n', 'notesSlide', '../notes/n.xml')}</Relationships>",
        "ppt/notes/n.xml": f"<p:notes {ns}><p:cSld><p:spTree>{sp(1, 'say', '<p:ph type=' + chr(34) + 'body' + chr(34) + '/>')}</p:spTree></p:cSld></p:notes>",
    })
    assert markdown(spark, "pptx", data, {"slide1_image1": "pic"}, notes=True) == "# Slide 1: T\n\nin group\n\n[Image: pic]\n\nhidden\n\n> **Notes:** say\n"


RELS = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
M = "http://schemas.openxmlformats.org/officeDocument/2006/math"


def rels(**targets):
    return "<Relationships>" + "".join(f'<Relationship Id="{k}" Type="x/image" Target="{t}"/>' for k, t in targets.items()) + "</Relationships>"


def test_docx_pictures_math_and_choices(spark):
    image = lambda r: f'<w:r><w:t>gone</w:t><mc:AlternateContent><mc:Choice><w:drawing><wp:inline><a:blip r:embed="{r}"/></wp:inline></w:drawing></mc:Choice><mc:Fallback><w:pict/></mc:Fallback></mc:AlternateContent></w:r>'
    math = "<m:oMath><m:sSup><m:e><m:r><m:t>x</m:t></m:r></m:e><m:sup><m:r><m:t>2</m:t></m:r></m:sup></m:sSup></m:oMath>"
    text = lambda t, p="": f"<w:r><w:rPr>{p}</w:rPr><w:t>{t}</w:t></w:r>"
    body = f"<w:p>{text(' a ', '<w:b/>')}{image('p1')}{text('b', '<w:b/><w:i/>')}{math}{text('c', '<w:i/>')}</w:p><w:sectPr/><w:tbl><w:tr><w:tc><w:p>{image('p2')}</w:p><w:p>{text('y')}</w:p></w:tc><w:tc><w:p>{math}</w:p></w:tc></w:tr></w:tbl><w:p>{image('p1')}</w:p><w:p/>"
    data = package({
        "word/document.xml": f'<w:document {W} xmlns:m="{M}" xmlns:mc="mc" xmlns:wp="wp" xmlns:a="a" xmlns:r="{RELS}"><w:body>{body}</w:body></w:document>',
        "word/_rels/document.xml.rels": rels(p1="media/one.png", p2="media/two.jpeg"), "word/media/one.png": "PNG", "word/media/two.jpeg": "JPG", "word/media/unused.png": "x",
    })
    assert markdown(spark, "docx", data, {"image2": " two "}) == "**a** [Image]***b***$x^{2}$*c*\n\n| [Image: two] y | $x^{2}$ |\n| --- | --- |\n\n[Image]\n"
    files = spark.createDataFrame([("f", "docx", data), ("g", "docx", b"no"), ("h", "docx", None)], "doc_id string, kind string, content binary")
    got = sorted((r.doc_id, r.place, bytes(r.bytes), r.mime, r.prompt_kind) for r in office.pictures(files).collect())
    assert got == [("f", "image1", b"PNG", "image/png", "figure"), ("f", "image2", b"JPG", "image/jpeg", "figure"), ("f", "image3", b"PNG", "image/png", "figure")]


@pytest.mark.parametrize("told", [{}, {"slide1_image2": "second"}])
def test_pptx_groups_choices_and_pictures(spark, told):
    ns = f'xmlns:p="p" xmlns:a="a" xmlns:a14="a14" xmlns:m="{M}" xmlns:r="{RELS}" xmlns:mc="mc"'
    para = lambda *t: "".join(f"<a:p>{x}</a:p>" for x in t)
    run = lambda t: f"<a:r><a:t>{t}</a:t></a:r>"
    sp = lambda i, b, ph="", more="": f'<p:sp><p:nvSpPr><p:cNvPr id="{i}"/><p:nvPr>{ph}</p:nvPr></p:nvSpPr>{more}<p:txBody>{b}</p:txBody></p:sp>'
    pic = lambda i, r: f'<p:pic><p:nvPicPr><p:cNvPr id="{i}"/></p:nvPicPr><a:blip r:embed="{r}"/></p:pic>'
    math = '<a14:m><m:oMath><m:r><m:t>α</m:t></m:r></m:oMath></a14:m>'
    title = '<p:ph type="title"/>'
    shapes = (
        f"<mc:AlternateContent><mc:Choice>{sp(4, para(run('taken')))}{sp(20, para(run('late ') + math))}{pic(21, 'x')}</mc:Choice></mc:AlternateContent>"
        + sp(4, para(run("one"), "", run(" two ") + run("three"))) + sp(2, para(run("He"), run("ad")), title)
        + f"<p:grpSp><p:nvGrpSpPr><p:cNvPr id='9'/></p:nvGrpSpPr>{pic(10, 'x')}<p:grpSp>{sp(11, para(run('deep')))}{sp(12, '', '', chr(60) + 'a:blip r:embed=' + chr(34) + 'y' + chr(34) + '/>')}</p:grpSp></p:grpSp>"
        + sp(13, para(run("again")), title)
    )
    data = package({
        "ppt/presentation.xml": f'<p:presentation {ns}><p:sldIdLst><p:sldId r:id="b"/><p:sldId r:id="c"/></p:sldIdLst></p:presentation>',
        "ppt/_rels/presentation.xml.rels": rels(b="slides/s.xml", c="slides/e.xml"),
        "ppt/slides/s.xml": f"<p:sld {ns}><p:cSld><p:spTree>{shapes}</p:spTree></p:cSld></p:sld>",
        "ppt/slides/e.xml": f"<p:sld {ns}><p:cSld><p:spTree/></p:cSld></p:sld>",
        "ppt/slides/_rels/s.xml.rels": rels(x="../media/a.png", y="../media/b.gif"), "ppt/media/a.png": "A", "ppt/media/b.gif": "B",
    })
    second = "[Image: second]" if told else "[Image]"
    want = f"# Slide 1: He\nad\n\none\n\ntwo three\n\n[Image]\n\ndeep\n\n{second}\n\nagain\n\nlate $\\alpha $\n\n---\n\n# Slide 2\n"
    assert markdown(spark, "pptx", data, told) == want
    files = spark.createDataFrame([("f", "pptx", data)], "doc_id string, kind string, content binary")
    assert sorted((r.place, bytes(r.bytes), r.mime) for r in office.pictures(files).collect()) == [("slide1_image1", b"A", "image/png"), ("slide1_image2", b"B", "image/gif")]


def deck_of_pictures():
    ns = f'xmlns:p="p" xmlns:a="a" xmlns:r="{RELS}"'
    pic = lambda i, r: f'<p:pic><p:nvPicPr><p:cNvPr id="{i}"/></p:nvPicPr><a:blip r:embed="{r}"/></p:pic>'
    return package({
        "ppt/presentation.xml": f'<p:presentation {ns}><p:sldIdLst><p:sldId r:id="b"/></p:sldIdLst></p:presentation>', "ppt/_rels/presentation.xml.rels": rels(b="slides/s.xml"),
        "ppt/slides/s.xml": f"<p:sld {ns}><p:cSld><p:spTree>{pic(1, 'x')}{pic(2, 'y')}</p:spTree></p:cSld></p:sld>",
        "ppt/slides/_rels/s.xml.rels": rels(x="../media/a.png", y="../media/b.png"), "ppt/media/a.png": "one", "ppt/media/b.png": "two",
    })


@pytest.mark.parametrize("kind", ["docx", "pptx"])
def test_no_text_is_exchanged_or_stored(spark, kind):
    files = spark.range(3).selectExpr("id AS doc_id", f"'{kind}' AS kind", "CAST(NULL AS binary) AS content")
    made = office.office_documents(files, notes=True)
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and not any(x in plan for x in ("Exchange", "Sort", "Join", "ExistingRDD"))
    assert sorted(map(tuple, made.collect())) == [(k, kind, None) for k in range(3)]


def test_a_comment_twice_a_ragged_table_and_an_empty_deck(spark):
    run = lambda t, p="": f"<w:r><w:rPr>{p}</w:rPr><w:t>{t}</w:t></w:r>"
    ref = lambda i: f'<w:r><w:commentReference w:id="{i}"/></w:r>'
    cell = lambda *t: f"<w:tc>{''.join(f'<w:p>{x}</w:p>' for x in t)}</w:tc>"
    body = (
        f'<w:p>{ref(1)}{ref(9)}{ref(1)}</w:p><w:p>{run(" ", "<w:b/>")}{run("x", "<w:b/>")}{run(" ")}{run("y ", "<w:i/>")}</w:p><w:p><w:pPr><w:pStyle w:val="Heading9"/></w:pPr>{run("h", "<w:i/>")}{run("i")}</w:p>'
        f"<w:tbl><w:tr/></w:tbl><w:tbl><w:tr>{cell(run('a', '<w:b/>'), '', run('b'))}</w:tr><w:tr/><w:tr>{cell()}{cell(run('c'))}{cell()}</w:tr></w:tbl>"
    )
    comments = "".join(f'<w:comment w:id="1" w:author="{a}"><w:p>{run("said")}</w:p></w:comment>' for a in ("B", "A"))
    data = package({"word/document.xml": f"<w:document {W}><w:body>{body}</w:body></w:document>", "word/comments.xml": f"<w:comments {W}>{comments}</w:comments>"})
    quotes = "> **Comment (A):** said\n\n> **Comment (B):** said"
    assert markdown(spark, "docx", data) == f"{quotes}\n\n{quotes}\n\n**x** *y*\n\n###### hi\n\n| a b |  |  |\n| --- | --- | --- |\n|  | c |  |\n"
    deck = package({"ppt/presentation.xml": "<p:presentation xmlns:p='p'/>"})
    assert markdown(spark, "pptx", deck) == "\n"
