"""Pages of layout extraction and of text recognition as whole documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import convert_ocr_markup
from ..operators import assets, blocks, layout, markdown

PAGE = layout.PAGE
#: Classes of boxes that cap the padding of pictures and tables.
OBSTACLES = ("caption", "text", "section-header", "list-item")


def _page_tables(pages: DataFrame) -> DataFrame:
    """doc_id, page_no, table_no and markdown of the pipe blocks of each page."""
    return blocks.table_blocks(pages.select(F.struct(*PAGE).alias("doc_id"), "text"), "text").select("doc_id.*", "table_no", "markdown")


def page_markdown(pages: DataFrame, images: DataFrame, tables: DataFrame) -> DataFrame:
    """doc_id and text of documents from page chunks (doc_id, page_no, text).

    Picture markers and pipe blocks are replaced by summaries (``images`` and
    ``tables``: doc_id, page_no, idx, summary), pages joined in order, and the whole
    cleaned of what layout extraction leaves.  A null page is empty.
    """
    pages = pages.select(*PAGE, F.coalesce("text", F.lit("")).alias("text"))
    marked = assets.replace_markers(pages, images)
    one = marked.select(F.struct(*PAGE).alias("doc_id"), "text")
    told = tables.select(F.struct(*PAGE).alias("doc_id"), F.col("idx").cast("long").alias("table_no"), "summary")
    done = blocks.replace_tables(one, told, "text").select("doc_id.*", "text")
    return layout.document_texts(done).select("doc_id", markdown.clean_markdown(F.col("text")).alias("text"))


def ocr_documents(lines: DataFrame, boxes: DataFrame, pages: DataFrame, images: DataFrame, tables: DataFrame, zoom: float = 2.0) -> DataFrame:
    """doc_id and text of documents from recognised lines.

    ``lines``: doc_id, page_no, line_no, text, x0..y1.  ``boxes``: doc_id, page_no,
    box_no, class, x0..y1 in units of the page.  ``pages``: doc_id, page_no, width of the
    raster, and text, the layout's own reading (for its tables).  ``images`` and
    ``tables``: summaries.  Lines inside pictures and tables go; their summaries or
    tables take their place; a page without any has its summaries at the end.
    """
    sides = ["x0", "y0", "x1", "y1"]
    kind = lambda *names: boxes.where(F.col("class").isin(*names))
    zoomed = lambda rows: rows.withColumns({s: F.col(s) * zoom for s in sides})
    pictures = zoomed(layout.significant(layout.merge_boxes(kind("picture"))))
    grids = zoomed(kind("table")).select(*PAGE, "box_no", *sides)
    both = pictures.select(*PAGE, "box_no", *sides).unionByName(grids.withColumn("box_no", -F.col("box_no") - 1))
    kept = layout.outside_regions(lines, layout.capped_padding(both, zoomed(kind(*OBSTACLES))))
    nth = F.row_number().over(Window.partitionBy(*PAGE).orderBy("box_no"))
    figures = pictures.withColumn("idx", nth).join(images.select(*PAGE, "idx", F.col("summary").alias("text")), [*PAGE, "idx"]).where("text <> ''")
    told = layout.zip_tables(grids, _page_tables(pages), tables)
    virtual = layout.virtual_lines(figures, told.select(*PAGE, "text", *sides), pages.select(*PAGE, "width"))
    last = F.lit(1 << 40)  # at one height, a virtual line comes after the page's own
    virtual = virtual.withColumn("line_no", last + F.row_number().over(Window.partitionBy(*PAGE).orderBy("y0", "x0", "text")))
    every = kept.select(*PAGE, F.col("line_no").cast("long").alias("line_no"), "text", *[F.col(s).cast("double").alias(s) for s in sides]).unionByName(virtual)
    texts = layout.page_texts(layout.reading_order(every, pages.select(*PAGE, "width"), both))
    bare = pages.select(*PAGE).join(both, PAGE, "left_anti")
    rest = layout.fallback_summaries(bare, images.where("summary <> ''")).groupBy(*PAGE).agg(blocks.joined(F.col("text"), F.col("idx"), "\n\n").alias("rest"))
    whole = pages.select(*PAGE).join(texts, PAGE, "left").join(rest, PAGE, "left")
    text = F.concat(F.coalesce("text", F.lit("")), F.when(F.col("rest").isNotNull(), F.concat(F.lit("\n\n"), "rest")).otherwise(""))
    return layout.document_texts(whole.select(*PAGE, text.alias("text")), "\n\n").select("doc_id", convert_ocr_markup(F.col("text")).alias("text"))
