"""Runs of lines and spans: islands over windows, ordered concatenation, tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import strip


def joined(value: Column, order: Column, separator: str) -> Column:
    """An aggregate: values in order, with a separator between."""
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order.alias("o"), value.alias("v")))), lambda x: x["v"]), separator)


def islands(rows: DataFrame, by: list[str], order: str, kind: str) -> DataFrame:
    """Adds ``island``: numbers neighbouring rows of one ``kind`` (null is a kind)."""
    w = Window.partitionBy(*by).orderBy(order)
    change = F.when(F.lag(F.struct(kind)).over(w).eqNullSafe(F.struct(kind)), 0).otherwise(1)
    return rows.withColumn("_change", change).withColumn("island", F.sum("_change").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_change")


def lines_of(docs: DataFrame, content: str = "content") -> DataFrame:
    """doc_id, line_no (from 0) and line."""
    return docs.select("doc_id", F.posexplode(F.split(content, "\n")).alias("line_no", "line"))


def table_blocks(docs: DataFrame, content: str = "content") -> DataFrame:
    """doc_id, table_no (from 1), first line and markdown of each run of pipe lines."""
    lines = lines_of(docs, content).withColumn("pipe", F.col("line").rlike(r"(?U)^\s*\|"))
    runs = islands(lines, ["doc_id"], "line_no", "pipe").where("pipe")
    blocks = runs.groupBy("doc_id", "island").agg(F.min("line_no").alias("line_no"), joined(F.col("line"), F.col("line_no"), "\n").alias("markdown"))
    return blocks.select("doc_id", F.row_number().over(Window.partitionBy("doc_id").orderBy("line_no")).alias("table_no"), "line_no", "markdown")


def replace_tables(docs: DataFrame, summaries: DataFrame, content: str = "content", label: str = "") -> DataFrame:
    """``docs`` (doc_id and content) with each summarised pipe block replaced.
    ``summaries``: doc_id, table_no, summary; blocks without one, or with an empty one,
    stay.  With a ``label``, the summary stands in brackets after it."""
    lines = lines_of(docs, content).withColumn("pipe", F.col("line").rlike(r"(?U)^\s*\|"))
    runs = islands(lines, ["doc_id"], "line_no", "pipe")
    parts = runs.groupBy("doc_id", "island", "pipe").agg(F.min("line_no").alias("line_no"), joined(F.col("line"), F.col("line_no"), "\n").alias("text"))
    parts = parts.withColumn("table_no", F.sum(F.col("pipe").cast("int")).over(Window.partitionBy("doc_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)))
    told = parts.join(summaries, ["doc_id", "table_no"], "left")
    summary = F.concat(F.lit(f"[{label}: "), "summary", F.lit("]")) if label else F.col("summary")
    text = F.when(F.col("pipe") & (F.col("summary") != ""), summary).otherwise(F.col("text"))
    return told.groupBy("doc_id").agg(joined(text, F.col("line_no"), "\n").alias(content))


def merge_spans(spans: DataFrame, by: list[str]) -> DataFrame:
    """Neighbouring spans of one format as one, wrapped in its marks, blanks at its ends
    left outside; raw spans (``raw``) are never merged.  ``spans``: by, span_no, text, fmt."""
    alone = spans.withColumn("_kind", F.when(F.col("fmt") == "raw", F.concat(F.lit("raw"), "span_no")).otherwise(F.col("fmt")))
    runs = islands(alone, by, "span_no", "_kind").groupBy(*by, "island", "fmt").agg(F.min("span_no").alias("span_no"), joined(F.col("text"), F.col("span_no"), "").alias("text"))
    mark = F.when(F.col("fmt") == "bold", "**").when(F.col("fmt") == "italic", "*").when(F.col("fmt") == "bolditalic", "***").otherwise("")
    core = strip(F.col("text"))
    marked = F.concat(F.regexp_extract("text", r"(?U)^(\s*)", 1), mark, core, mark, F.regexp_extract("text", r"(?U)(\s*)$", 1))
    return runs.select(*by, "span_no", "fmt", F.when(core == "", F.col("text")).otherwise(marked).alias("text"))


def pipe_tables(cells: DataFrame, by: list[str]) -> DataFrame:
    """by and markdown, from cells (by, row_no, col_no, text).  Shorter rows are filled up
    to the widest; line feeds become spaces."""
    escaped = F.replace(F.replace(F.coalesce("text", F.lit("")), F.lit("|"), F.lit("\\|")), F.lit("\n"), F.lit(" "))
    rows = cells.groupBy(*by, "row_no").agg(joined(escaped, F.col("col_no"), " | ").alias("line"), F.count("*").alias("width"))
    rows = rows.withColumn("line", F.concat(F.lit("| "), "line", F.lit(" |")))
    made = rows.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("row_no", "line", "width"))).alias("r"), F.max("width").alias("w"))
    rule = F.concat(F.lit("| "), F.array_join(F.array_repeat(F.lit("---"), F.col("w").cast("int")), " | "), F.lit(" |"))
    lines = F.transform("r", lambda x: F.concat(x["line"], F.repeat(F.lit("  |"), (F.col("w") - x["width"]).cast("int"))))
    return made.select(*by, F.array_join(F.concat(F.slice(lines, 1, 1), F.array(rule), F.slice(lines, 2, F.greatest(F.size(lines) - 1, F.lit(0)))), "\n").alias("markdown"))


def slides_markdown(slides: DataFrame, shapes: DataFrame, notes: DataFrame | None = None) -> DataFrame:
    """doc_id and markdown.  ``slides``: doc_id, slide_no, title; ``shapes``: doc_id,
    slide_no, shape_no, text; ``notes``: doc_id, slide_no, text."""
    title = F.trim(F.coalesce("title", F.lit("")))
    head = F.concat(F.lit("# Slide "), "slide_no", F.when(title != "", F.concat(F.lit(": "), title)).otherwise(""))
    parts = slides.select("doc_id", "slide_no", F.lit(-1).cast("long").alias("n"), head.alias("text")).unionByName(shapes.where("text <> ''").select("doc_id", "slide_no", F.col("shape_no").cast("long").alias("n"), "text"))
    if notes is not None:
        parts = parts.unionByName(notes.where("text <> ''").select("doc_id", "slide_no", F.lit((1 << 62)).alias("n"), F.concat(F.lit("> **Notes:** "), "text").alias("text")))
    each = parts.groupBy("doc_id", "slide_no").agg(joined(F.col("text"), F.col("n"), "\n\n").alias("text"))
    return each.groupBy("doc_id").agg(joined(F.col("text"), F.col("slide_no"), "\n\n---\n\n").alias("m")).select("doc_id", F.concat("m", F.lit("\n")).alias("markdown"))


def with_comments(paragraphs: DataFrame, refs: DataFrame, comments: DataFrame) -> DataFrame:
    """doc_id, block_no and text followed by its comments as quotes, in their order.
    ``refs``: doc_id, block_no, ref_no, comment_id; ``comments``: doc_id, comment_id, author, text."""
    quoted = refs.join(comments.withColumnRenamed("text", "said"), ["doc_id", "comment_id"]).groupBy("doc_id", "block_no").agg(
        joined(F.concat(F.lit("> **Comment ("), "author", F.lit("):** "), "said"), F.col("ref_no"), "\n\n").alias("quotes"))
    return paragraphs.join(quoted, ["doc_id", "block_no"], "left").select("doc_id", "block_no", F.concat_ws("\n\n", "text", "quotes").alias("text"))
