"""A whole run: a folder of mixed files becomes a table of clean texts."""

from __future__ import annotations

import argparse
import importlib
from dataclasses import replace
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..functions import notes
from ..functions.paths import below, extension, folder_of
from ..functions.text import strip, strip_line_comments
from ..lineage import cut, stored
from ..operators import assets, bibliography, includes, latex
from ..options import CleanOptions
from ..sources import tex
from . import cleaning, office

#: Commands that name bibliography files.
BIBLIOGRAPHY = r"\\(?:bibliography|addbibresource)\{([^}]+)\}"
#: Extensions of text files; the empty one is a name without a dot.
TEXTUAL = ("tex", "bib", "bbl", "txt", "sty", "cls", "ltx", "")


def listed(spark: SparkSession, folder: str) -> DataFrame:
    """path (below ``folder``) and content, in bytes, of all its files."""
    top = folder.rstrip("/")
    home = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(top)
    home = home.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(home).toString()
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(top).select("path", "content")
    return raw.withColumn("top", F.lit(f"{home}/")).select(F.expr("substring(path, length(top) + 1)").alias("path"), "content")


def _beside(docs: DataFrame, names: str, files: DataFrame) -> DataFrame:
    """``files`` (path, and more) that the array ``names`` of documents has, as seen from
    their own folder: doc_id, pos, name and the file's columns, null where there is none."""
    asked = docs.select("doc_id", F.posexplode(names).alias("pos", "name")).withColumn("_at", below(folder_of(F.col("doc_id")), F.col("name")))
    return asked.join(files, F.col("_at") == F.col("path"), "left").drop("_at")


def described_figures(docs: DataFrame, images: DataFrame, known: DataFrame, provider: assets.Provider, calls: assets.Calls | None = None) -> DataFrame:
    """doc_id, stem and text of the graphics of ``docs`` (doc_id, content) that ``known``
    (doc_id, stem) has no summary of, as a provider describes them.  ``images``: path,
    content, in bytes; a name without an extension is looked up with each of them."""
    refs = assets.distinct_refs(docs).select("doc_id", "ref")
    bare = ~F.col("ref").rlike(rf"(?i)\.(?:{'|'.join(e[1:] for e in assets.EXTENSIONS)})$")
    tries = F.when(bare, F.array("ref", *[F.concat("ref", F.lit(e)) for e in assets.EXTENSIONS])).otherwise(F.array("ref"))
    each = refs.select("*", F.posexplode(tries).alias("priority", "tried")).withColumn("path", below(folder_of(F.col("doc_id")), F.col("tried")))
    hits = each.join(images.select("path", F.col("content").alias("bytes")), "path")
    first = hits.groupBy("doc_id", "ref").agg(F.min_by(F.struct("path", "bytes"), "priority").alias("file"))
    found = first.select("doc_id", assets.stem(F.col("ref")).alias("stem"), "file.bytes", assets.mime_of(F.col("file.path")).alias("mime"), F.lit("figure").alias("prompt_kind")).dropDuplicates(["doc_id", "stem"])
    return assets.summarize(found, known.select("doc_id", "stem"), provider, calls=calls).where("text IS NOT NULL").select("doc_id", "stem", "text")


def clean_projects(roots: DataFrame, texts: DataFrame, options: CleanOptions | None = None, images: DataFrame | None = None, provider: assets.Provider | None = None, calls: assets.Calls | None = None, kept: list[DataFrame] | None = None) -> DataFrame:
    """doc_id, content and notes of the LaTeX documents at ``roots`` (path).

    ``texts``: path, content of all text files.  A root's includes, bibliographies and
    summaries are found by the names that stand in it, one join each, so that files it
    does not name cost it nothing.  Notes tell what was not there: includes, ``.bib``
    files (unless a ``.bbl`` beside the root is taken) and summaries of graphics.  Where
    the options ask for summaries, ``provider`` describes the graphics among ``images``
    (path, content) that have none; ``kept`` gets a table of these (path, text).
    """
    o = options or CleanOptions()
    # Texts go through Python once and are written once, with all that needs no other
    # table; the stages below give one small row for a document, which meets its text once.
    if o.flatten:
        after = latex.cleaner(o.comments, o.macros, o.keep_usepackage)
        docs = includes.flatten_roots(roots, texts, after).select(F.col("path").alias("doc_id"), "content", "notes")
    else:
        docs = texts.join(roots.select("path").distinct(), "path", "left_semi").select(F.col("path").alias("doc_id"), "content")
        docs = cleaning.clean_with_notes(docs, replace(o, bibliography=False, figures=False))
    docs = stored(docs)
    bare = F.col("content") if o.comments else strip_line_comments(F.col("content"))
    side = stored(texts.where(F.col("path").rlike(r"\.(?:bib|bbl)$") | F.col("path").endswith(o.figure_summary_suffix)).where("content IS NOT NULL").select("path", "content"))
    # What a document names, from one reading of its text.
    named = {}
    if o.bibliography:
        names = F.transform(F.split(F.array_join(F.regexp_extract_all(bare, F.lit(BIBLIOGRAPHY), 1), ","), ","), lambda x: F.trim(x))
        named["bibs"] = F.transform(F.filter(names, lambda n: n != ""), lambda n: F.when(n.endswith(".bib"), n).otherwise(F.concat(n, F.lit(".bib"))))
        named["keys"] = bibliography.wanted_keys(F.col("content"))
    if o.figures:
        named["sides"] = F.array_distinct(F.transform(assets.graphics_of(bare), lambda g: F.concat(assets.stem(g), F.lit(o.figure_summary_suffix))))
    facts = cut(docs.select("doc_id", *[v.alias(c) for c, v in named.items()]))
    found = [docs.limit(0).select("doc_id", F.lit(None).cast("string").alias("block"), F.lit(None).cast("map<string, string>").alias("told"), notes.none().alias("more"))]
    missing = []
    if o.bibliography:
        own = facts.select("doc_id", F.regexp_replace("doc_id", r"\.[^./]+$", ".bbl").alias("path"))
        bbl = own.join(side.where("path LIKE '%.bbl'"), "path").select("doc_id", F.lit(0).alias("priority"), "content")
        files = side.where("path LIKE '%.bib'")
        bibs = _beside(facts, "bibs", files.select("path").distinct())
        cited = bibs.where("path IS NOT NULL").select("doc_id", F.col("pos").alias("file_ord"), F.col("path").alias("bib_path"))
        # A file that many documents name is read once.
        read = files.join(cited.select(F.col("bib_path").alias("path")).distinct(), "path", "left_semi").distinct()
        read = tex.bib_entries(read.select(F.lit("").alias("root_dir"), F.col("path").alias("bib_path"), "content"))
        entries = cited.join(read, "bib_path").select("doc_id", "file_ord", "entry_no", "key", "kind", "fields")
        found.append(bibliography.blocks_of(facts.select("doc_id", "keys"), entries, bbl))
        missing.append(bibs.where("path IS NULL").join(bbl, "doc_id", "left_anti").select("doc_id", F.lit("missing-bib").alias("code"), F.col("name").alias("detail")))
    if o.figures:
        told = _beside(facts, "sides", side.where(F.col("path").endswith(o.figure_summary_suffix))).withColumn("stem", F.expr(f"left(name, length(name) - {len(o.figure_summary_suffix)})"))
        summaries = told.where("content IS NOT NULL").select("doc_id", "stem", strip(F.col("content")).alias("text"))
        asked = told.where("content IS NULL").select("doc_id", "stem")
        if o.auto_summarize and provider is not None and images is not None:
            new = cut(described_figures(docs.withColumn("content", bare), images, summaries, provider, calls))  # asked once
            if kept is not None:
                kept.append(new.select(below(folder_of(F.col("doc_id")), F.col("stem")).alias("stem"), "text"))
            summaries, asked = summaries.unionByName(new), asked.join(new, ["doc_id", "stem"], "left_anti")
        found.append(summaries.groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("stem", "text"))).alias("told")))
        missing.append(asked.select("doc_id", F.lit("missing-summary").alias("code"), F.col("stem").alias("detail")))
    if missing:
        found.append(reduce(DataFrame.unionAll, missing).groupBy("doc_id").agg(F.array_sort(F.collect_set(F.struct("code", "detail"))).cast(notes.TYPE).alias("more")))
    each = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), found)
    small = each.groupBy("doc_id").agg(*[F.first(c, ignorenulls=True).alias(c) for c in ("block", "told", "more")])
    whole = docs.join(small, "doc_id", "left")
    content = assets.with_summaries(bibliography.inline_block(F.col("content"), F.col("block")), F.col("told"))
    return whole.select("doc_id", content.alias("content"), F.concat("notes", F.coalesce("more", notes.none())).alias("notes"))


def picture_summaries(documents: DataFrame, texts: DataFrame, suffix: str = "_summary.txt") -> DataFrame:
    """doc_id, place and summary of the pictures in ``documents`` (doc_id, a path), from
    side files such as ``deck_slide2_image1_summary.txt`` beside them."""
    named = texts.where(F.col("path").endswith(suffix) & F.col("content").isNotNull()).select(F.expr(f"left(path, length(path) - {len(suffix)})").alias("key"), "content")
    # A key of a slide's picture may also be that of a picture in a document named so.
    ways = [F.struct(F.regexp_extract("key", rf"^(.*)_{place}$", 1).alias("stem"), F.regexp_extract("key", rf"({place})$", 1).alias("place")) for place in (r"slide\d+_image\d+", r"image\d+")]
    told = named.select(F.inline(F.array(*ways)), strip(F.col("content")).alias("summary")).where("stem <> ''")
    stems = documents.select("doc_id", F.regexp_replace("doc_id", r"\.[^./]+$", "").alias("stem"))
    return stems.join(told, "stem").select("doc_id", "place", "summary")


def clean_folder(spark: SparkSession, folder: str, roots: list[str] | DataFrame, options: CleanOptions | None = None, pdf: DataFrame | None = None, provider: assets.Provider | None = None, calls: assets.Calls | None = None) -> DataFrame:
    """path, kind, text and notes of the files of ``folder`` whose names below it are in
    ``roots`` (a list, or a table with ``path``).

    The kind is chosen by extension.  A LaTeX root sees what it names, below the folder;
    ``.docx`` and ``.pptx`` are read from their bytes, with the summaries of their pictures
    beside them, and speaker notes if the options ask for them; ``.pdf`` files get their
    text from ``pdf`` (path, text; see ``plans.pages``), since no reader of them is part
    of this engine.  A root that is not there is an error.

    With ``auto_summarize``, ``provider`` describes the pictures that have no summary, each
    different one once, and the answers are written beside them as side files before the
    texts are made; a file that is there is never written over.
    """
    o = options or CleanOptions()
    if o.auto_summarize and provider is None:
        raise ValueError("auto_summarize needs a provider")
    kept: list[DataFrame] = []
    files = listed(spark, folder)
    wanted = roots.select("path") if isinstance(roots, DataFrame) else spark.createDataFrame([(r,) for r in roots], "path string")
    if absent := [r.path for r in wanted.join(files.select("path"), "path", "left_anti").limit(20).collect()]:
        raise FileNotFoundError(", ".join(sorted(absent)))
    found = files.join(wanted.distinct(), "path", "left_semi").withColumn("kind", tex.kind_of(F.col("path")))
    textual = files.where(extension(F.col("path")).isin(*TEXTUAL) | F.col("path").endswith(o.figure_summary_suffix))
    rooted = found.where("kind = 'tex'").where(~extension(F.col("path")).isin(*TEXTUAL)).select("path", "content")
    texts = textual.select("path", "content").unionByName(rooted).select("path", tex.universal_newlines(tex.decoded(F.col("content"), o.encoding)).alias("content"))
    images = files.where(F.concat(F.lit("."), extension(F.col("path"))).isin(*assets.EXTENSIONS))
    clean = clean_projects(found.where("kind = 'tex'").select("path"), texts, o, images, provider, calls, kept)
    out = clean.select(F.col("doc_id").alias("path"), F.lit("tex").alias("kind"), F.col("content").alias("text"), "notes")
    files = found.where("kind IN ('docx', 'pptx')").select(F.col("path").alias("doc_id"), "kind", "content")
    told = picture_summaries(files, texts, o.figure_summary_suffix)
    if o.auto_summarize:
        new = assets.summarize(office.pictures(files), told.select("doc_id", "place"), provider, calls=calls)
        new = cut(new.where("text IS NOT NULL").select("doc_id", "place", F.col("text").alias("summary")))
        kept.append(new.select(F.concat(F.regexp_replace("doc_id", r"\.[^./]+$", ""), F.lit("_"), "place").alias("stem"), F.col("summary").alias("text")))
        told = told.unionByName(new)
        assets.write_summaries(reduce(DataFrame.unionAll, kept), folder, o.figure_summary_suffix, o.encoding).write.format("noop").mode("overwrite").save()
    made = office.office_documents(files, told, o.notes).select(F.col("doc_id").alias("path"), "kind", F.col("markdown").alias("text"))
    unread = F.array(F.struct(F.lit("unreadable").alias("code"), F.col("path").alias("detail"))).cast(notes.TYPE)
    out = out.unionByName(made.withColumn("notes", F.when(F.col("text").isNull(), unread).otherwise(notes.none())))
    pages = found.where("kind = 'pdf'").select("path", "kind")
    read = pages.withColumn("text", F.lit(None).cast("string")) if pdf is None else pages.join(pdf.select("path", "text"), "path", "left")
    return out.unionByName(read.withColumn("notes", notes.none()))


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="python -m inkwell", description="Clean documents of a folder into a Parquet table of texts.")
    p.add_argument("folder")
    p.add_argument("roots", nargs="+", help="documents to clean, named below the folder")
    p.add_argument("-o", "--output", required=True)
    for stage in ("flatten", "bibliography", "comments", "macros", "figures"):
        p.add_argument(f"--no-{stage}", dest=stage, action="store_false")
    p.add_argument("--keep-usepackage", action="store_true")
    p.add_argument("--figure-summary-suffix", default="_summary.txt")
    p.add_argument("--encoding", default="utf-8")
    p.add_argument("--notes", action="store_true", help="speaker notes of slides")
    p.add_argument("--auto-summarize", action="store_true", help="have a provider describe pictures without a summary")
    p.add_argument("--provider", metavar="MODULE:NAME", help="what makes the provider, without arguments")
    p.add_argument("-v", "--verbose", action="store_true", help="print how many notes of each kind there are")
    return p


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    chosen = {k: v for k, v in vars(a).items() if k not in ("folder", "roots", "output", "provider")}
    module, _, made = (a.provider or "").partition(":")
    provider = getattr(importlib.import_module(module), made)() if made else None
    spark = SparkSession.builder.appName("inkwell").getOrCreate()
    counts = Observation("notes")
    try:
        out = clean_folder(spark, a.folder, a.roots, CleanOptions(**chosen), provider=provider)
    except FileNotFoundError as e:
        print(f"not found: {e}")
        return 1
    tex.write_clean(notes.observed(out, counts), a.output)
    if a.verbose:
        print(", ".join(f"{k}: {v}" for k, v in counts.get.items() if v) or "no notes")
    return 0
