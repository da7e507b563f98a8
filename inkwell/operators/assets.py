"""Images and their summaries: numbering, deduplication, substitution."""

from __future__ import annotations

import re
import threading
import time
import uuid
from collections.abc import Iterator
from concurrent import futures
from concurrent.futures import Future
from dataclasses import dataclass
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..functions import figures
from ..functions.text import strip
from .blocks import joined

#: The marker of an omitted picture, and extensions of images.
MARKER = r"\*\*==> picture \[(\d+) x (\d+)\] intentionally omitted <==\*\*"
EXTENSIONS = (".png", ".pdf", ".jpg", ".jpeg", ".eps", ".svg")
#: How often a call is made, seconds before it is made again, and what
#: marks its error as passing.
RETRIES, FIRST_WAIT, LONGEST_WAIT = 3, 10, 60
PASSING = ("timeout", "503", "502", "504", "429", "unavailable", "cancelled", "overloaded", "rate limit", "connection")
#: Media types by extension, and those that a provider takes as they are.
MIMES = {"png": "image/png", "jpg": "image/jpeg", "jpeg": "image/jpeg", "gif": "image/gif", "bmp": "image/bmp", "tif": "image/tiff", "tiff": "image/tiff", "webp": "image/webp", "svg": "image/svg+xml", "pdf": "application/pdf", "eps": "application/postscript"}
TAKEN = ("image/png", "image/jpeg", "image/webp", "image/heic", "image/heif")
#: What a provider is asked for, by prompt_kind.
PROMPTS = {
    "figure": "A language model will read a paper without its pictures. Replace this one by text: its kind and subject first, then whatever can be read off it, such as values, names, steps and links. State only what is visible.",
    "table": "A language model will read a paper without its pictures. This one is a table: copy it into pipe-table markdown, cell by cell, headings included.",
}

#: What is cut off an image's name to have the key of its summary.
_EXTENSION = r"(?i)\.(?:" + "|".join(e[1:] for e in EXTENSIONS) + r")$"


@F.pandas_udf(T.ArrayType(T.StringType()))
def _graphics(texts):
    return texts.map(lambda t: [h.name for h in figures.graphics(t or "")])


@F.pandas_udf(T.StringType())
def _substituted(texts, told):
    stem_of = re.compile(_EXTENSION)
    return pd.Series([figures.substituted(t, dict(m), stem_of) if t is not None and m is not None else t for t, m in zip(texts, told, strict=True)], dtype="object")


def graphics_of(c: Column) -> Column:
    """The names of a text's graphics, in order.  Texts without one stay native."""
    some = c.contains(figures.GRAPHIC)
    names = F.when(some, _graphics(F.when(some, c)))
    return F.transform(F.coalesce(names, F.array().cast("array<string>")), strip)


def stem(path: Column) -> Column:
    """A path without its image extension: the key of a summary."""
    return F.regexp_replace(strip(path), _EXTENSION, "")


def summary_key(doc: Column, place: str, number: Column, kind: str, index: Column) -> Column:
    """Such as ``paper_page3_image2``."""
    return F.concat_ws("_", doc, F.concat(F.lit(place), number), F.concat(F.lit(kind), index))


def numbered(assets: DataFrame, by: list[str], order: str) -> DataFrame:
    return assets.withColumn("idx", F.row_number().over(Window.partitionBy(*by).orderBy(order)))


def missing(assets: DataFrame, summaries: DataFrame, key: str = "stem") -> DataFrame:
    """Assets that have no summary yet."""
    return assets.join(summaries, key, "left_anti")


def distinct_calls(assets: DataFrame) -> DataFrame:
    """One row for each image and prompt: digest, prompt_kind, bytes, mime, n_targets.
    Its targets are found again by digest and prompt, so none is gathered."""
    return assets.groupBy(F.md5("bytes").alias("digest"), "prompt_kind").agg(F.min("bytes").alias("bytes"), F.min("mime").alias("mime"), F.count("*").alias("n_targets"))


def distinct_refs(docs: DataFrame, content: str = "content") -> DataFrame:
    """doc_id, ref and pos (from 0, of its first use) of a document's different graphics."""
    return docs.select("doc_id", F.posexplode(graphics_of(F.col(content))).alias("pos", "ref")).groupBy("doc_id", "ref").agg(F.min("pos").alias("pos"))


def image_files(refs: DataFrame, files: DataFrame) -> DataFrame:
    """``refs`` (doc_id, ref) with path: the file itself, else, for a name without an
    image extension, the first of its extensions there is (null: none).  ``files``:
    doc_id, path."""
    bare = ~F.col("ref").rlike(rf"(?i)\.(?:{'|'.join(e[1:] for e in EXTENSIONS)})$")
    tries = F.when(bare, F.array("ref", *[F.concat("ref", F.lit(e)) for e in EXTENSIONS])).otherwise(F.array("ref"))
    each = refs.select("*", F.posexplode(tries).alias("priority", "tried"))
    there = files.select(F.col("doc_id").alias("_doc"), F.col("path").alias("_found")).distinct()
    hit = each.join(there, (F.col("doc_id") == F.col("_doc")) & (F.col("tried") == F.col("_found")), "left")
    return hit.groupBy(*refs.columns).agg(F.min_by("_found", F.when(F.col("_found").isNotNull(), F.col("priority"))).alias("path"))


def mime_of(path: Column) -> Column:
    """Media type by the extension; unknown ones are plain bytes."""
    known = F.create_map(*[F.lit(x) for pair in MIMES.items() for x in pair])
    return F.coalesce(F.element_at(known, F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))), F.lit("application/octet-stream"))


def side_files(files: DataFrame, suffix: str = "_summary.txt") -> DataFrame:
    """root_dir, stem and text of the summaries among ``files`` (root_dir, rel_path,
    content): those whose names end in ``suffix``.  The stem is the key of figures, and
    of pages' and slides' images and tables (see ``summary_key``)."""
    found = files.where(F.col("rel_path").endswith(suffix) & F.col("content").isNotNull())
    return found.select("root_dir", F.expr(f"left(rel_path, length(rel_path) - {len(suffix)})").alias("stem"), strip(F.col("content")).alias("text"))


def missing_notes(refs: DataFrame, summaries: DataFrame) -> DataFrame:
    """doc_id, code and detail for every graphic of ``refs`` (doc_id, ref) without a summary."""
    return refs.withColumn("stem", stem(F.col("ref"))).join(summaries.select("stem").distinct(), "stem", "left_anti").select("doc_id", F.lit("missing-summary").alias("code"), F.col("ref").alias("detail"))


def choose_images(markers: DataFrame, embedded: DataFrame, boxes: DataFrame, by: tuple[str, ...] = ("doc_id", "page_no"), least: int = 64) -> DataFrame:
    """by, idx (from 1), source and number of the images of each page: its large
    embedded images in order; where the page has more large markers, as many boxes as
    are then missing.  ``markers`` and ``embedded``: by, number, width, height;
    ``boxes``: by, number.  A page without a large marker has none."""
    large = (F.col("width") > least) & (F.col("height") > least)
    wanted = markers.where(large).groupBy(*by).agg(F.count("*").alias("wanted"))
    own = embedded.where(large).join(wanted, list(by)).select(*by, "wanted", F.lit("embedded").alias("source"), "number")
    counts = own.groupBy(*by).agg(F.count("*").alias("held"))
    nth = F.row_number().over(Window.partitionBy(*by).orderBy("number"))
    crops = boxes.select(*by, "number", nth.alias("n")).join(wanted, list(by)).join(counts, list(by), "left").where(F.col("n") <= F.col("wanted") - F.coalesce("held", F.lit(0)))
    both = own.select(*by, "source", "number").unionByName(crops.select(*by, F.lit("crop").alias("source"), "number"))
    place = F.row_number().over(Window.partitionBy(*by).orderBy(F.col("source") == "crop", "number"))
    return both.select(*by, place.alias("idx"), "source", "number")


class Provider(Protocol):
    """Describes an image.  Not part of this engine: hand one in."""

    def describe(self, data: bytes, mime: str, prompt_kind: str) -> str: ...


@dataclass(frozen=True)
class Calls:
    """How a task asks its provider: ``at_once`` calls in flight, ``seconds`` for one
    with its retries (None: no end), and ``ledger``, a shared folder where each answer
    is kept by its digest and prompt, so that a repeated task asks nothing twice."""

    at_once: int = 4
    seconds: float | None = None
    ledger: str | None = None
    passing: tuple[str, ...] = PASSING


def _answer(provider: Provider, call: tuple, calls: Calls, pause) -> tuple[str | None, str | None]:
    """Text and error of one call, made again while its errors are passing ones."""
    _, kind, data, mime = call
    for k in range(RETRIES):
        try:
            return provider.describe(data, mime, kind).strip(), None
        except Exception as e:  # noqa: BLE001 - a failing call becomes a row
            error = str(e)
            if not any(x in error.lower() for x in calls.passing) or k == RETRIES - 1:
                break
            pause(min(FIRST_WAIT * 2**k, LONGEST_WAIT))
    return None, error


class Ledger:
    """Answers in a shared folder, one file each, put in place by a rename."""

    def __init__(self, folder: str):
        from pyarrow import fs

        self.fs, self.root = fs.FileSystem.from_uri(folder)
        self.fs.create_dir(self.root)

    def _path(self, call: tuple) -> str:
        return f"{self.root}/{call[0]}-{call[1]}.txt"

    def get(self, call: tuple) -> str | None:
        try:
            with self.fs.open_input_stream(self._path(call)) as f:
                return f.read().decode("utf-8")
        except FileNotFoundError:
            return None

    def put(self, call: tuple, text: str) -> None:
        put_file(self.fs, self._path(call), text.encode("utf-8", "surrogatepass"))


def put_file(fs, path: str, data: bytes) -> None:
    """Write a file so that a reader sees all of it or none: attempts have names of
    their own, and the last one to finish is the file."""
    attempt = f"{path}.{uuid.uuid4().hex}.attempt"
    with fs.open_output_stream(attempt) as f:
        f.write(data)
    fs.move(attempt, path)


def asked(batches: Iterator[pd.DataFrame], provider: Provider, calls: Calls, pause) -> Iterator[pd.DataFrame]:
    """The answers to a task's calls, in their order.  At most ``at_once`` are in flight;
    one that takes too long becomes an error and its thread is left behind."""
    ledger = Ledger(calls.ledger) if calls.ledger else None

    def one(call: tuple) -> tuple[str | None, str | None]:
        if ledger and (known := ledger.get(call)) is not None:
            return known, None
        text, error = _answer(provider, call, calls, pause)
        if ledger and text is not None:
            ledger.put(call, text)
        return text, error

    def started(call: tuple) -> Future:
        done: Future = Future()

        def run() -> None:
            try:
                done.set_result(one(call))
            except Exception as e:  # noqa: BLE001 - of the ledger
                done.set_exception(e)

        threading.Thread(target=run, daemon=True).start()
        return done

    for frame in batches:
        todo = list(frame[["digest", "prompt_kind", "bytes", "mime"]].itertuples(index=False, name=None))
        answers: dict[int, tuple] = {}
        open_: dict[Future, tuple[int, float]] = {}
        at = 0
        while len(answers) < len(todo):
            while at < len(todo) and len(open_) < calls.at_once:
                open_[started(todo[at])] = (at, time.monotonic())
                at += 1
            wait = None if calls.seconds is None else max(0.0, min(t for _, t in open_.values()) + calls.seconds - time.monotonic())
            for f in futures.wait(open_, wait, futures.FIRST_COMPLETED).done:
                answers[open_.pop(f)[0]] = f.result()
            for f, (k, t) in list(open_.items()):
                if calls.seconds is not None and time.monotonic() - t >= calls.seconds:
                    answers[k] = (None, f"no answer in {calls.seconds:g} seconds")
                    del open_[f]
        rows = [(*todo[k][:2], *answers[k]) for k in range(len(todo))]
        yield pd.DataFrame(rows, columns=["digest", "prompt_kind", "text", "error"])


def summarize(assets: DataFrame, summaries: DataFrame, provider: Provider, passing: tuple[str, ...] = PASSING, wait=None, calls: Calls | None = None) -> DataFrame:
    """stem, text and error for each asset without a summary.

    ``assets``: stem, bytes, mime, prompt_kind; ``stem`` may stand for several columns
    that ``summaries`` has too.  Each different image and prompt is asked once; passing
    errors are tried again, others become the error column.
    """
    c = calls or Calls(passing=passing)
    key = [x for x in assets.columns if x not in ("bytes", "mime", "prompt_kind") and x in summaries.columns]

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        yield from asked(batches, provider, c, wait or time.sleep)

    wanted = assets.join(summaries, key, "left_anti").withColumn("digest", F.md5("bytes"))
    told = distinct_calls(wanted).mapInPandas(ask, "digest string, prompt_kind string, text string, error string")
    return wanted.join(told, ["digest", "prompt_kind"]).select(*key, "text", "error")


def write_summaries(told: DataFrame, folder: str, suffix: str = "_summary.txt", encoding: str = "utf-8") -> DataFrame:
    """Writes each summary of ``told`` (stem, text) beside its image, as
    ``folder/stem`` + ``suffix``; returns stem, path and written (false: it was there).

    The rows are worked out when the result is.  A file is put in place by a rename and
    never written over, so a task that is repeated leaves what the first one wrote; of
    several texts for one stem the smallest counts, null texts are none.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        there, root = fs.FileSystem.from_uri(folder)
        for frame in batches:
            rows = []
            for name, text in frame[["stem", "text"]].itertuples(index=False, name=None):
                path = f"{root}/{name}{suffix}"
                new = there.get_file_info(path).type == fs.FileType.NotFound
                if new:
                    there.create_dir(path.rpartition("/")[0])
                    put_file(there, path, text.encode(encoding))
                rows.append((name, f"{name}{suffix}", new))
            yield pd.DataFrame(rows, columns=["stem", "path", "written"])

    one = told.where("stem IS NOT NULL AND text IS NOT NULL").groupBy("stem").agg(F.min("text").alias("text"))
    return one.mapInPandas(run, "stem string, path string, written boolean")


def told_maps(docs: DataFrame, summaries: DataFrame) -> DataFrame:
    """doc_id and a map of the summaries of the graphics that stand in it, for documents
    that have one.  ``summaries``: stem, text, and doc_id where they belong to one
    document; of several for one key the largest counts."""
    asked = docs.select("doc_id", F.explode(F.array_distinct(F.transform(graphics_of(F.col("content")), stem))).alias("stem"))
    key = ["doc_id", "stem"] if "doc_id" in summaries.columns else ["stem"]
    told = asked.join(summaries.select(*key, strip(F.col("text")).alias("summary")).where("summary IS NOT NULL"), key)
    one = told.groupBy("doc_id", "stem").agg(F.max("summary").alias("summary"))
    return one.groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("stem", "summary"))).alias("told"))


def with_summaries(content: Column, told: Column) -> Column:
    """Figures and single graphics by their summaries; texts without one stay native."""
    return F.when(told.isNull(), content).otherwise(_substituted(F.when(told.isNotNull(), content), told))


def substitute_figures(docs: DataFrame, summaries: DataFrame) -> DataFrame:
    """Figures and single graphics of ``docs`` (doc_id, content) by their summaries
    (stem, text, and doc_id where they belong to one document); those without one stay
    as they are, and so do all other columns."""
    joined = docs.join(told_maps(docs, summaries).withColumnRenamed("told", "_told"), "doc_id", "left")
    return joined.withColumn("content", with_summaries(F.col("content"), F.col("_told"))).select(*docs.columns)


def replace_markers(pages: DataFrame, summaries: DataFrame) -> DataFrame:
    """Picture markers of ``pages`` (doc_id, page_no, text): the summary of the idx-th
    large picture of the page, else nothing.  ``summaries``: doc_id, page_no, idx, summary."""
    cut = pages.select("doc_id", "page_no", F.regexp_extract_all("text", F.lit(MARKER), 0).alias("hits"), F.split("text", MARKER).alias("rest"), "text")
    hits = cut.select("doc_id", "page_no", F.posexplode("hits").alias("n", "hit"))
    large = (F.regexp_extract("hit", MARKER, 1).cast("int") > 64) & (F.regexp_extract("hit", MARKER, 2).cast("int") > 64)
    w = Window.partitionBy("doc_id", "page_no").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    told = hits.withColumn("large", large).withColumn("idx", F.sum(F.col("large").cast("int")).over(w)).join(summaries, ["doc_id", "page_no", "idx"], "left")
    new = F.when(F.col("large") & F.col("summary").isNotNull(), F.concat(F.lit("[Image: "), "summary", F.lit("]"))).otherwise("")
    each = told.groupBy("doc_id", "page_no").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", new.alias("new")))), lambda x: x["new"]).alias("news"))
    whole = F.concat(F.array_join(F.zip_with(F.slice("rest", 1, F.size("news")), "news", lambda a, b: F.concat(a, b)), ""), F.element_at("rest", -1))
    return cut.join(each, ["doc_id", "page_no"], "left").select("doc_id", "page_no", F.when(F.col("news").isNull(), F.col("text")).otherwise(whole).alias("text"))


__all__ = ["Calls", "Provider", "choose_images", "distinct_calls", "distinct_refs", "image_files", "mime_of", "missing_notes", "side_files", "joined", "missing", "numbered", "replace_markers", "stem", "substitute_figures", "summarize", "summary_key", "write_summaries"]
