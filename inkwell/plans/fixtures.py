"""Small office files made of columns, so that a query can read them back."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Callable, Iterator
from xml.sax.saxutils import escape

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import kernels

W = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
A = "http://schemas.openxmlformats.org/drawingml/2006/main"
P = "http://schemas.openxmlformats.org/presentationml/2006/main"
R = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
LINKS = "http://schemas.openxmlformats.org/package/2006/relationships"


def _zip(parts: dict[str, str]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in parts.items():
            z.writestr(name, text)
    return out.getvalue()


def docx(title: str, text: str, bold: str) -> bytes:
    """A heading, a paragraph with a bold run and a linked one, a table of two rows, and
    a comment on the paragraph."""
    run = lambda t, props="": f'<w:r>{props}<w:t xml:space="preserve">{escape(t)}</w:t></w:r>'
    cell = lambda t: f"<w:tc><w:p>{run(t)}</w:p></w:tc>"
    body = (
        f'<w:p><w:pPr><w:pStyle w:val="Heading2"/></w:pPr>{run(title, "<w:rPr><w:b/></w:rPr>")}</w:p>'
        f'<w:p>{run(text)}{run(" ")}{run(bold, "<w:rPr><w:b/></w:rPr>")}<w:hyperlink>{run(" link")}</w:hyperlink><w:r><w:commentReference w:id="7"/></w:r></w:p>'
        f"<w:tbl><w:tr>{cell('Name')}{cell('Text')}</w:tr><w:tr>{cell(title)}{cell(bold + '|')}</w:tr></w:tbl>"
    )
    return _zip({
        "word/document.xml": f'<w:document xmlns:w="{W}"><w:body>{body}</w:body></w:document>',
        "word/comments.xml": f'<w:comments xmlns:w="{W}"><w:comment w:id="7" w:author="Ann"><w:p>{run("so " + title)}</w:p></w:comment></w:comments>',
    })


def pptx(title: str, text: str, cell: str) -> bytes:
    """Two slides: a title with a text in a group; a table without a title."""
    para = lambda t: f'<a:p><a:r><a:t>{escape(t)}</a:t></a:r></a:p>'
    shape = lambda n, t, kind="": f'<p:sp><p:nvSpPr><p:cNvPr id="{n}" name="x"/><p:nvPr>{kind}</p:nvPr></p:nvSpPr><p:txBody>{para(t)}</p:txBody></p:sp>'
    slide = lambda shapes: f'<p:sld xmlns:p="{P}" xmlns:a="{A}"><p:cSld><p:spTree>{shapes}</p:spTree></p:cSld></p:sld>'
    table = "".join(f"<a:tr>{''.join(f'<a:tc><a:txBody>{para(t)}</a:txBody></a:tc>' for t in row)}</a:tr>" for row in (("Key", "Value"), (title, cell)))
    links = "".join(f'<Relationship Id="r{i}" Type="{R}/slide" Target="slides/slide{i}.xml"/>' for i in (1, 2))
    # The second file is the first slide: the order is the presentation's.
    return _zip({
        "ppt/presentation.xml": f'<p:presentation xmlns:p="{P}" xmlns:r="{R}"><p:sldIdLst><p:sldId id="256" r:id="r2"/><p:sldId id="257" r:id="r1"/></p:sldIdLst></p:presentation>',
        "ppt/_rels/presentation.xml.rels": f'<Relationships xmlns="{LINKS}">{links}</Relationships>',
        "ppt/slides/slide2.xml": slide(shape(1, title, '<p:ph type="title"/>') + f"<p:grpSp>{shape(2, text)}</p:grpSp>"),
        "ppt/slides/slide1.xml": slide(f'<p:graphicFrame><p:nvGraphicFramePr><p:cNvPr id="3" name="t"/></p:nvGraphicFramePr><a:graphic><a:graphicData><a:tbl>{table}</a:tbl></a:graphicData></a:graphic></p:graphicFrame>'),
    })


def deck_with_groups(title: str, text: str, picture: str) -> bytes:
    """A slide with a picture and a text in nested groups, alternate contents of which one
    shape is at the top too, and a second picture."""
    para = lambda t: f'<a:p><a:r><a:t>{escape(t)}</a:t></a:r></a:p>'
    shape = lambda n, t, kind="": f'<p:sp><p:nvSpPr><p:cNvPr id="{n}" name="x"/><p:nvPr>{kind}</p:nvPr></p:nvSpPr><p:txBody>{para(t)}</p:txBody></p:sp>'
    pic = lambda n, r: f'<p:pic><p:nvPicPr><p:cNvPr id="{n}" name="x"/></p:nvPicPr><p:blipFill><a:blip r:embed="{r}"/></p:blipFill></p:pic>'
    link = lambda i, kind, target: f'<Relationship Id="{i}" Type="{R}/{kind}" Target="{target}"/>'
    rels = lambda *x: f'<Relationships xmlns="{LINKS}">{"".join(x)}</Relationships>'
    shapes = (
        f"<mc:AlternateContent><mc:Choice>{shape(5, 'not again')}{shape(8, 'late ' + title)}</mc:Choice></mc:AlternateContent>"
        f"<p:grpSp>{pic(2, 'one')}<p:grpSp>{shape(3, text)}</p:grpSp></p:grpSp>{shape(5, 'top')}{pic(6, 'two')}{shape(1, title, '<p:ph type=%stitle%s/>' % (chr(34), chr(34)))}"
    )
    return _zip({
        "ppt/presentation.xml": f'<p:presentation xmlns:p="{P}" xmlns:r="{R}"><p:sldIdLst><p:sldId id="256" r:id="s"/></p:sldIdLst></p:presentation>',
        "ppt/_rels/presentation.xml.rels": rels(link("s", "slide", "slides/slide1.xml")),
        "ppt/slides/slide1.xml": f'<p:sld xmlns:p="{P}" xmlns:a="{A}" xmlns:r="{R}" xmlns:mc="http://schemas.openxmlformats.org/markup-compatibility/2006"><p:cSld><p:spTree>{shapes}</p:spTree></p:cSld></p:sld>',
        "ppt/slides/_rels/slide1.xml.rels": rels(link("one", "image", "../media/a.png"), link("two", "image", "../media/b.jpg")),
        "ppt/media/a.png": picture, "ppt/media/b.jpg": text,
    })


def office_files(docs: DataFrame, make: Callable[..., bytes], kind: str, *columns: Column) -> DataFrame:
    """doc_id, kind and content: the files that ``make`` builds of three text columns."""
    texts = docs.select("doc_id", *[c.alias(n) for c, n in zip(columns, "abc", strict=True)])

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # A few files at a time: a whole batch of them is several times as large as its texts.
        for b in batches:
            for few in (b.slice(k, kernels.AT_ONCE) for k in range(0, b.num_rows, kernels.AT_ONCE)):
                made = [make(*x) for x in zip(*[few.column(n).to_pylist() for n in "abc"], strict=True)]
                yield pa.RecordBatch.from_arrays([few.column("doc_id"), pa.array(made, pa.binary())], ["doc_id", "content"])

    files = texts.mapInArrow(build, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, content binary")
    return files.select("doc_id", F.lit(kind).alias("kind"), "content")
