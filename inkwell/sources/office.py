"""Word-processor files and slide decks as rows, from their bytes.

A file is unzipped and its XML walked once, in the task that holds it; what comes out is a
row for each file, with blocks, spans, cells, comments and shapes as nested columns in
their order, and rows of media.  What they mean is up to the expressions of ``plans.office``.
"""

from __future__ import annotations

import io
import itertools
import posixpath
import zipfile
from collections.abc import Callable, Iterator
from xml.etree import ElementTree as ET

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

R_ID = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
MATH = ("oMath", "oMathPara")


def name(e: ET.Element) -> str:
    return e.tag.rpartition("}")[2]


def child(e: ET.Element | None, *path: str) -> ET.Element | None:
    for wanted in path:
        e = None if e is None else next((c for c in e if name(c) == wanted), None)
    return e


def value(e: ET.Element | None) -> str | None:
    return None if e is None else next((v for k, v in e.attrib.items() if k.rpartition("}")[2] == "val"), "")


def _part(z: zipfile.ZipFile, path: str) -> ET.Element | None:
    return ET.fromstring(z.read(path)) if path in z.namelist() else None


def _links(z: zipfile.ZipFile, path: str) -> dict[str, tuple[str, str]]:
    """Relationship id to its last type word and target path."""
    folder, file = posixpath.split(path)
    found = _part(z, f"{folder}/_rels/{file}.rels")
    if found is None:
        return {}
    return {r.get("Id"): (r.get("Type", "").rpartition("/")[2], posixpath.normpath(posixpath.join(folder, r.get("Target", ""))).lstrip("/")) for r in found}


def _blips(e: ET.Element, links: dict[str, tuple[str, str]]) -> list[str | None]:
    """The parts of the pictures inside an element, in order; None where there is no link."""
    return [links.get(b.get(f"{R_ID}embed", ""), ("", None))[1] for b in e.iter() if name(b) == "blip"]


#: A span is a text, a formula (its number among the file's formulas) or a picture (its
#: number in a word-processor file, and its part).
SPAN = "struct<what string, fmt string, text string, formula int, image int, media string>"
#: Formulas as XML, and blocks in order: paragraphs with spans and what is said of them in
#: comments, tables as rows of cells of paragraphs of spans.
DOCX = f"formulas array<string>, blocks array<struct<style string, spans array<{SPAN}>, comments array<struct<author string, text string>>, rows array<array<array<array<{SPAN}>>>>>>"


def docx_file(z: zipfile.ZipFile) -> Iterator[dict]:
    links = _links(z, "word/document.xml")
    comments = next((_part(z, t) for kind, t in links.values() if kind == "comments"), _part(z, "word/comments.xml"))
    said: dict[str, list[dict]] = {}
    for c in comments if comments is not None else ():
        get = {k.rpartition("}")[2]: v for k, v in c.attrib.items()}
        said.setdefault(get.get("id"), []).append({"author": get.get("author", ""), "text": "".join(t.text or "" for t in c.iter() if name(t) == "t").strip()})
    formulas: list[str] = []
    images = itertools.count(1)

    def on(props: ET.Element | None, what: str) -> bool:
        e = child(props, what)
        return e is not None and value(e) not in ("false", "0", "off", "none")

    def run(e: ET.Element) -> Iterator[dict]:
        props = child(e, "rPr")
        fmt = ("bold" if on(props, "b") else "") + ("italic" if on(props, "i") else "") or None
        pictures = [m for d in e.iter() if name(d) in ("inline", "anchor") for m in _blips(d, links)] or [None for c in e if name(c) in ("drawing", "pict")]
        yield from ({"what": "image", "fmt": "raw", "image": next(images), "media": m} for m in pictures)
        if not pictures:
            text = "".join({"t": c.text or "", "tab": "\t", "br": "\n"}.get(name(c), "") for c in e)
            yield from [{"what": "text", "fmt": fmt, "text": text}] * bool(text)

    def spans(e: ET.Element) -> Iterator[dict]:
        for c in e:
            if name(c) == "r":
                yield from run(c)
            elif name(c) in MATH:
                yield {"what": "math", "fmt": "raw", "formula": len(formulas)}
                formulas.append(ET.tostring(c, "unicode"))
            elif name(c) in ("hyperlink", "ins", "smartTag"):
                yield from spans(c)

    blocks: list[dict] = []
    for e in child(_part(z, "word/document.xml"), "body"):
        if name(e) == "p":
            ids = [next((v for n, v in r.attrib.items() if n.endswith("}id")), None) for r in e.iter() if name(r) == "commentReference"]
            told = [c for x in ids if x is not None for c in sorted(said.get(x, ()), key=lambda c: f'{c["author"]}):** {c["text"]}')]
            blocks.append({"style": value(child(e, "pPr", "pStyle")), "spans": list(spans(e)), "comments": told})
        elif name(e) == "tbl":
            blocks.append({"rows": [[[list(spans(p)) for p in cell if name(p) == "p"] for cell in row if name(cell) == "tc"] for row in e if name(row) == "tr"]})
    yield {"formulas": formulas, "blocks": blocks}


#: Slides in order, with their shapes in order, groups before what they hold.  A shape's
#: ``depth`` is 1 at the top; ``choices`` are the ids of those of its elements, or of itself,
#: that stand right under a choice of alternate contents.  Notes are paragraphs of spans.
SHAPE = f"struct<depth int, kind string, shape_id string, is_title boolean, is_image boolean, choices array<string>, media string, lines array<array<{SPAN}>>, rows array<array<array<array<{SPAN}>>>>>"
PPTX = f"formulas array<string>, slides array<struct<shapes array<{SHAPE}>, notes array<array<{SPAN}>>>>"
_SHAPES = ("sp", "pic", "graphicFrame", "grpSp", "AlternateContent")


def pptx_file(z: zipfile.ZipFile) -> Iterator[dict]:
    links = _links(z, "ppt/presentation.xml")
    order = [links[e.get(f"{R_ID}id")][1] for e in _part(z, "ppt/presentation.xml").iter() if name(e) == "sldId"]
    formulas: list[str] = []

    def math(e: ET.Element) -> dict:
        formulas.append(ET.tostring(e, "unicode"))
        return {"what": "math", "formula": len(formulas) - 1}

    def spans(p: ET.Element) -> Iterator[dict]:
        for c in p:
            if name(c) == "r":
                yield {"what": "text", "text": "".join(t.text or "" for t in c if name(t) == "t")}
            elif name(c) in MATH:
                yield math(c)
            elif name(c) == "m":  # a wrapper of formulas
                yield from (math(m) for m in c if name(m) in MATH)

    def body(e: ET.Element | None) -> list[list[dict]]:
        return [list(spans(p)) for p in (e if e is not None else ()) if name(p) == "p"]

    def shape(e: ET.Element, depth: int, choices: list[str], linked: dict) -> Iterator[dict]:
        kind = name(e)
        if kind not in _SHAPES:
            return
        own = next((x.get("id") for x in e.iter() if name(x) == "cNvPr"), None)
        pictures = _blips(e, linked) if kind in ("sp", "pic") else []
        title = kind == "sp" and any(name(x) == "ph" and x.get("type") in ("title", "ctrTitle") for x in e.iter())
        here = {"depth": depth, "kind": kind, "shape_id": own, "is_title": title, "is_image": kind == "pic" or bool(pictures), "choices": choices, "media": next(iter(pictures), None)}
        if kind == "grpSp":
            yield here
            yield from inside(e, depth, choices, linked)
        elif kind == "AlternateContent":
            yield here
            choice = child(e, "Choice")
            yield from inside(choice, depth, choices, linked, True) if choice is not None else ()
        elif kind == "graphicFrame":
            rows = [tr for t in e.iter() if name(t) == "tbl" for tr in t if name(tr) == "tr"]
            yield here | {"rows": [[body(child(cell, "txBody")) for cell in row if name(cell) == "tc"] for row in rows]}
        else:
            yield here | {"lines": body(child(e, "txBody"))}

    def inside(e: ET.Element, depth: int, choices: list[str], linked: dict, chosen: bool = False) -> Iterator[dict]:
        for c in e:
            own = next((x.get("id") or "" for x in c.iter() if name(x) == "cNvPr"), "")
            yield from shape(c, depth + 1, [*choices, own] if chosen else choices, linked)

    slides: list[dict] = []
    for path in order:
        linked = _links(z, path)
        tree = child(_part(z, path), "cSld", "spTree")
        slides.append({"shapes": list(inside(tree, 0, [], linked)) if tree is not None else [], "notes": []})
        if target := next((t for kind, t in linked.values() if kind == "notesSlide"), None):
            frames = [e for e in _part(z, target).iter() if name(e) == "sp" and any(name(x) == "ph" and x.get("type") == "body" for x in e.iter())]
            slides[-1]["notes"] = body(child(frames[0], "txBody")) if frames else []
    yield {"formulas": formulas, "slides": slides}


MEDIA = "part string, bytes binary"


def media_rows(z: zipfile.ZipFile) -> Iterator[dict]:
    """The files of pictures and the like that a package holds."""
    for part in sorted(n for n in z.namelist() if "/media/" in n and not n.endswith("/")):
        yield {"part": part, "bytes": z.read(part)}


#: Bytes of files whose content is Python objects at a time.
AT_ONCE = 4_000_000


def _read(files: DataFrame, rows_of: Callable[[zipfile.ZipFile], Iterator[dict]], schema: str, otherwise: Callable[[], list[dict]] = list) -> DataFrame:
    """doc_id and the rows of each of ``files`` (doc_id, content).  A null content, or one
    that is no such file, has ``otherwise``: no rows."""
    schema = f"doc_id {files.schema['doc_id'].dataType.simpleString()}, {schema}"
    fields = to_arrow_schema(T._parse_datatype_string(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows: list[dict] = []
            held = 0
            for k in range(b.num_rows):
                doc_id, data = b.column("doc_id")[k].as_py(), b.column("content")[k].as_py() or b""
                try:
                    with zipfile.ZipFile(io.BytesIO(data)) as z:
                        found = list(rows_of(z))
                except (zipfile.BadZipFile, ET.ParseError, TypeError, KeyError):
                    found = otherwise()
                rows += [r | {"doc_id": doc_id} for r in found]
                held += len(data)
                if held >= AT_ONCE or schema.endswith("binary"):
                    yield pa.RecordBatch.from_pylist(rows, schema=fields)
                    rows, held = [], 0
            yield pa.RecordBatch.from_pylist(rows, schema=fields)

    return files.select("doc_id", "content").mapInArrow(run, schema)


def docx_parts(files: DataFrame) -> DataFrame:
    """A row for each file, null besides doc_id where it can't be read."""
    return _read(files, docx_file, DOCX, lambda: [{}])


def pptx_parts(files: DataFrame) -> DataFrame:
    """The same of slide decks."""
    return _read(files, pptx_file, PPTX, lambda: [{}])


def media_parts(files: DataFrame) -> DataFrame:
    return _read(files, media_rows, MEDIA)
