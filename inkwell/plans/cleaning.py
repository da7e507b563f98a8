"""The whole cleaning of LaTeX documents, as one chain of stages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import notes
from ..lineage import stored
from ..operators import assets, bibliography, includes, latex
from ..options import CleanOptions


def clean_with_notes(docs: DataFrame, options: CleanOptions | None = None, entries: DataFrame | None = None, bbl: DataFrame | None = None, summaries: DataFrame | None = None) -> DataFrame:
    """doc_id, content and notes of ``docs`` (doc_id, content, and notes so far), cleaned.

    All stages but flattening, chosen while the plan is built; a stage without its table
    is left out.  The macro stage adds what it could not do to its row's notes.  Stages
    that read a text and then join with what they found read it from a table, so that the
    stages before are not run again for each reading.
    """
    o = options or CleanOptions()
    if "notes" not in docs.columns:
        docs = docs.withColumn("notes", notes.none())
    return _with_tables(_texts_done(docs.select("doc_id", "content", "notes"), o), o, entries, bbl, summaries)


def _texts_done(docs: DataFrame, o: CleanOptions) -> DataFrame:
    """``docs`` (with content and notes) after the stages that look at nothing but the text."""
    if not (o.comments or o.macros):
        return docs
    done = docs.withColumn("_done", latex.text_stages(F.col("content"), o.comments, o.macros, o.keep_usepackage))
    return done.withColumns({"content": F.col("_done.text"), "notes": F.concat("notes", notes.parsed(F.col("_done.notes")))}).drop("_done")


def _with_tables(docs: DataFrame, o: CleanOptions, entries: DataFrame | None, bbl: DataFrame | None, summaries: DataFrame | None) -> DataFrame:
    if o.bibliography and entries is not None:
        docs = stored(docs)
        docs = bibliography.inline_bibliography(docs, entries, bbl)
    if o.figures and summaries is not None:
        docs = stored(docs)
        docs = assets.substitute_figures(docs, summaries)
    return docs.select("doc_id", "content", "notes")


def clean_latex(docs: DataFrame, options: CleanOptions | None = None, files: DataFrame | None = None, entries: DataFrame | None = None, bbl: DataFrame | None = None, summaries: DataFrame | None = None, diagnostics: bool = False) -> DataFrame:
    """``docs`` (doc_id, content) cleaned.

    ``files`` (root_dir = doc_id, rel_path, content, is_root) are needed to flatten,
    ``entries`` or ``bbl`` for bibliographies, ``summaries`` for figures; a stage without
    its table is left out.  With ``diagnostics``, a column of that name has the notes of
    includes and macros as sorted texts (see ``functions.notes``).
    """
    o = options or CleanOptions()
    if o.flatten and files is not None:
        # The text stages follow in the tasks that flatten; behind the join, which is dealt
        # by bytes and not by work, they are left for documents without files.
        flat = includes.flatten_includes(files).select(F.col("root_dir").alias("doc_id"), "content", notes.parsed(F.col("diagnostics")).alias("notes"))
        flat = _texts_done(flat, o).select("doc_id", F.col("content").alias("_flat"), F.col("notes").alias("_told"))
        joined = docs.select("doc_id", "content").join(flat, "doc_id", "left")
        rest = joined.withColumn("content", F.when(F.col("_flat").isNull(), F.col("content"))).withColumn("notes", notes.none())
        docs = _texts_done(rest, o).select("doc_id", F.coalesce("_flat", "content").alias("content"), F.coalesce("_told", "notes").alias("notes"))
        done = _with_tables(docs, o, entries, bbl, summaries)
    else:
        done = clean_with_notes(docs, o, entries, bbl, summaries)
    told = [notes.texts(F.col("notes")).alias("diagnostics")] if diagnostics else []
    return done.select("doc_id", "content", *told)
