"""Word-processor files and slide decks as markdown: expressions over a file's nested columns.

All that makes a file's text lies in its own row, so that no text is sorted or exchanged;
only summaries come by a join.  ``told`` is a table of the pictures' summaries: doc_id, place
(``image2``, or ``slide3_image1``) and summary.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.text import bound
from ..operators import assets, latex
from ..sources import office

Of = Callable[[Column], Column]
L = F.lit


def _with_told(parts: DataFrame, told: DataFrame | None) -> DataFrame:
    """``parts`` with the summaries of each file by their places."""
    if told is None:
        return parts
    known = told.where("place IS NOT NULL").groupBy("doc_id", "place").agg(F.max("summary").alias("summary"))
    maps = known.groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("place", "summary"))).alias("told"))
    return parts.join(maps, "doc_id", "left")


def _picture(place: Column, told: bool) -> Column:
    """What stands for a picture."""
    if not told:
        return L("[Image]")
    return bound(X.strip(F.element_at("told", place)), lambda s: F.when(s != "", F.concat(L("[Image: "), s, L("]"))).otherwise("[Image]"))


def _line(spans: Column, text: Of) -> Column:
    return X.strip(F.array_join(F.transform(spans, text), ""))


def _lines(paragraphs: Column, text: Of, separator: str) -> Column:
    """The lines that are not empty."""
    return F.array_join(F.filter(F.transform(paragraphs, lambda p: _line(p, text)), lambda x: x != ""), separator)


def _merged(spans: Column, text: Of) -> Column:
    """Neighbouring spans of one format as one, wrapped in its marks, blanks at its ends
    left outside; raw spans are never merged."""

    def marked(run: Column) -> Column:
        fmt = F.get(run, L(0))["fmt"]
        mark = F.when(fmt == "bold", "**").when(fmt == "italic", "*").when(fmt == "bolditalic", "***").otherwise("")
        blanks = lambda t, pattern: F.regexp_extract(t, pattern, 1)
        around = lambda t, core: F.concat(blanks(t, r"(?U)^(\s*)"), mark, core, mark, blanks(t, r"(?U)(\s*)$"))
        return bound(F.array_join(F.transform(run, text), ""), lambda t: bound(X.strip(t), lambda core: F.when(core == "", t).otherwise(around(t, core))))

    def runs(s: Column) -> Column:
        begins = lambda i: (i == 0) | (F.get(s, i)["fmt"] == "raw") | ~F.get(s, i)["fmt"].eqNullSafe(F.get(s, i - 1)["fmt"])
        starts = F.filter(F.transform(s, lambda _, i: i), lambda i: F.coalesce(begins(i), L(False)))
        run = lambda b, at, j: bound(F.slice(s, at + 1, F.coalesce(F.get(b, j + 1), F.size(s)) - at), marked)
        return bound(starts, lambda b: F.array_join(F.transform(b, lambda at, j: run(b, at, j)), ""))

    return X.strip(bound(spans, runs))


def _table(rows: Column, cell: Of) -> Column:
    """A pipe table, null where no row has a cell.  Shorter rows are filled up to the widest;
    line feeds become spaces."""
    escaped = lambda c: F.replace(F.replace(cell(c), L("|"), L("\\|")), L("\n"), L(" "))
    row = lambda r: F.struct(F.concat(L("| "), F.array_join(F.transform(r, escaped), " | "), L(" |")).alias("line"), F.size(r).alias("width"))

    def whole(made: Column, width: Column) -> Column:
        rule = F.concat(L("| "), F.array_join(F.array_repeat(L("---"), width), " | "), L(" |"))
        lines = F.transform(made, lambda x: F.concat(x["line"], F.repeat(L("  |"), width - x["width"])))
        return bound(lines, lambda x: F.array_join(F.concat(F.slice(x, 1, 1), F.array(rule), F.slice(x, L(2), F.size(x))), "\n"))

    made = F.transform(F.filter(rows, lambda r: F.size(r) > 0), row)
    return bound(made, lambda m: F.when(F.size(m) > 0, bound(F.array_max(F.transform(m, lambda x: x["width"])), lambda w: whole(m, w))))


def _with_formulas(body: Of) -> Column:
    """``body`` of a file's formulas as LaTeX, each written once."""
    return bound(F.transform("formulas", latex.omml_to_latex), body)


def _text_of(formulas: Column, picture: Of) -> Of:
    return lambda s: F.when(s["what"] == "math", F.get(formulas, s["formula"])).when(s["what"] == "image", picture(s)).otherwise(s["text"])


def docx_markdown(parts: DataFrame, told: DataFrame | None = None) -> DataFrame:
    """doc_id and markdown of the files whose parts (``office.docx_parts``) are given; null
    where a file can't be read."""

    def whole(formulas: Column) -> Column:
        text = _text_of(formulas, lambda s: _picture(F.concat(L("image"), s["image"]), told is not None))

        def paragraph(b: Column) -> Column:
            level = X.heading_level(b["style"])
            heading = bound(_line(b["spans"], text), lambda t: F.when(t != "", F.concat(F.repeat(L("#"), level), L(" "), t)))
            said = F.transform(b["comments"], lambda c: F.concat(L("> **Comment ("), c["author"], L("):** "), c["text"]))
            plain = bound(_merged(b["spans"], text), lambda t: F.nullif(t, L("")))
            return F.concat_ws("\n\n", F.when(level.isNotNull(), heading).otherwise(plain), F.when(F.size(said) > 0, F.array_join(said, "\n\n")))

        block = lambda b: F.when(b["rows"].isNotNull(), _table(b["rows"], lambda c: _lines(c, text, " "))).otherwise(paragraph(b))
        return F.array_join(F.filter(F.transform("blocks", block), lambda x: x != ""), "\n\n")

    return _with_told(parts, told).select("doc_id", F.when(F.col("blocks").isNotNull(), F.concat(_with_formulas(whole), L("\n"))).alias("markdown"))


def shown_shapes(shapes: Column) -> Column:
    """A slide's shapes that are shown, in order: kind, is_image, media, is_late (alternate
    contents come last), is_heading, lines and rows.

    What stands under a choice is shown unless its id is that of a shape at the top; the
    first title at the top is the slide's heading."""
    top = F.filter(shapes, lambda s: (s["depth"] == 1) & (s["kind"] != "AlternateContent") & s["shape_id"].isNotNull())
    first = F.array_position(F.transform(shapes, lambda s: (s["depth"] == 1) & s["is_title"]), True)

    def flagged(s: Column, i: Column, exposed: Column, heading: Column) -> Column:
        late = F.size(s["choices"]) > 0
        leaf = s["kind"].isin("sp", "pic", "graphicFrame")
        return F.struct(
            s["kind"].alias("kind"), s["media"].alias("media"), s["lines"].alias("lines"), s["rows"].alias("rows"), late.alias("is_late"),
            (s["is_image"] & ~late).alias("is_image"), (i + 1 == heading).alias("is_heading"), (leaf & ~(late & F.arrays_overlap(s["choices"], exposed))).alias("shown"))

    all_of = lambda exposed, heading: F.transform(shapes, lambda s, i: flagged(s, i, exposed, heading))
    made = bound(F.transform(top, lambda s: s["shape_id"]), lambda exposed: bound(first, lambda heading: all_of(exposed, heading)))
    return F.filter(made, lambda s: s["shown"])


def pptx_markdown(parts: DataFrame, told: DataFrame | None = None, notes: bool = False) -> DataFrame:
    """doc_id and markdown of the decks whose parts (``office.pptx_parts``) are given; with
    ``notes``, the speaker notes of each slide too.  Null where a file can't be read."""

    def slide(s: Column, slide_no: Column, text: Of) -> Column:
        def titled(shown: Column) -> Column:
            title = F.get(F.filter(shown, lambda x: x["is_heading"] & ~x["is_image"]), L(0))["lines"]
            named = bound(F.trim(F.coalesce(_lines(title, text, "\n"), L(""))), lambda t: F.when(t != "", F.concat(L(": "), t)).otherwise(""))
            rest = F.filter(shown, lambda x: ~x["is_heading"])
            ordered = bound(rest, lambda r: F.concat(F.filter(r, lambda x: ~x["is_late"]), F.filter(r, lambda x: x["is_late"])))
            return F.concat(F.array(F.concat(L("# Slide "), slide_no, named)), bound(ordered, told_of))

        def told_of(items: Column) -> Column:
            images = F.filter(F.transform(items, lambda x, i: F.when(x["is_image"], i)), lambda i: i.isNotNull())
            place = lambda at, i: F.concat(L("slide"), slide_no, L("_image"), F.array_position(at, i))
            one = lambda x, i, at: (
                F.when(x["kind"] == "graphicFrame", _table(x["rows"], lambda c: _lines(c, text, "\n")))
                .when(x["is_image"], _picture(place(at, i), told is not None))
                .otherwise(_lines(x["lines"], text, "\n\n"))
            )
            return bound(images, lambda at: F.filter(F.transform(items, lambda x, i: one(x, i, at)), lambda t: t != ""))

        made = bound(shown_shapes(s["shapes"]), titled)
        if notes:
            heard = F.transform(F.filter(s["notes"], lambda p: F.size(p) > 0), lambda p: F.array_join(F.transform(p, text), ""))
            spoken = bound(X.strip(F.array_join(heard, "\n")), lambda t: F.when(t != "", F.concat(L("> **Notes:** "), t)))
            made = F.concat(made, F.array(spoken))
        return F.array_join(made, "\n\n")

    def whole(formulas: Column) -> Column:
        text = _text_of(formulas, lambda s: s["text"])
        return F.array_join(F.transform("slides", lambda s, i: slide(s, i + 1, text)), "\n\n---\n\n")

    return _with_told(parts, told).select("doc_id", F.when(F.col("slides").isNotNull(), F.concat(_with_formulas(whole), L("\n"))).alias("markdown"))


def office_documents(files: DataFrame, told: DataFrame | None = None, notes: bool = False) -> DataFrame:
    """doc_id, kind and markdown of ``files`` (doc_id, kind, content): those of kind
    ``docx`` or ``pptx``; null where the content is no such file."""
    words = docx_markdown(office.docx_parts(files.where("kind = 'docx'")), told).withColumn("kind", L("docx"))
    decks = pptx_markdown(office.pptx_parts(files.where("kind = 'pptx'")), told, notes).withColumn("kind", L("pptx"))
    return words.unionByName(decks).select("doc_id", "kind", "markdown")


def pictures(files: DataFrame) -> DataFrame:
    """doc_id, place, bytes, mime and prompt_kind of the pictures in ``files`` (doc_id,
    kind, content) that have bytes, numbered as their summaries are."""
    words, decks = office.docx_parts(files.where("kind = 'docx'")), office.pptx_parts(files.where("kind = 'pptx'"))
    spans = F.flatten(F.transform("blocks", lambda b: F.coalesce(b["spans"], F.flatten(F.flatten(F.flatten(b["rows"]))))))
    in_words = words.select("doc_id", F.explode(F.filter(spans, lambda s: s["what"] == "image")).alias("s")).select("doc_id", F.concat(L("image"), "s.image").alias("place"), "s.media")
    slides = decks.select("doc_id", F.posexplode(F.transform("slides", lambda s: F.filter(shown_shapes(s["shapes"]), lambda x: x["is_image"] & ~x["is_heading"]))).alias("slide", "images"))
    in_decks = slides.select("doc_id", "slide", F.posexplode(F.transform("images", lambda x: x["media"])).alias("image", "media"))
    found = in_words.unionByName(in_decks.select("doc_id", F.concat(L("slide"), F.col("slide") + 1, L("_image"), F.col("image") + 1).alias("place"), "media"))
    data = office.media_parts(files.where("kind IN ('docx', 'pptx')"))
    joined = found.where("media IS NOT NULL").join(data.withColumnRenamed("part", "media"), ["doc_id", "media"])
    return joined.select("doc_id", "place", "bytes", assets.mime_of(F.col("media")).alias("mime"), L("figure").alias("prompt_kind"))
