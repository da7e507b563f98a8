"""Line dedup by a log-template tree.

A line's place in the tree is its token count and its leading tokens, with tokens
that hold a digit as variable fields: a fixed depth.  In each leaf, lines that agree
in enough places share a template, whose differing places become variable too.  A
template that recurs across documents is boilerplate: its lines are dropped, but for
those of the first document.  Short lines say too little to be generalised: each has a
leaf of its own, the whole line, and recurs only as it is.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import slices, stored

FIELD = "<*>"
_DIGIT = re.compile(r"\d")


@dataclass(frozen=True)
class Tree:
    """``depth`` leading tokens lead to a leaf.  Lines of under ``least_tokens``
    tokens are left alone, and blank lines always.  Lines of under ``whole_under``
    tokens, lines of scripts without spaces among them, are compared whole.  Other
    lines share a template from ``agree`` equal tokens in a hundred on.  It recurs when
    its lines are in ``least_texts`` different texts.  With ``copies_keep``, copies of
    the text that keeps its lines keep theirs too."""

    depth: int = 4
    least_tokens: int = 4
    whole_under: int = 4
    agree: int = 75
    least_texts: int = 10
    salts: int = 32
    copies_keep: bool = False


#: Every line is looked at, and recurs from the second text on.
EVERY_LINE = Tree(least_tokens=1, least_texts=2)
#: For use in front of a search for near copies: every line is looked at, a pair or
#: two of near copies is left to that search, and whole copies stay equal.
FEW_TEXTS = Tree(least_tokens=1, least_texts=4, copies_keep=True)


def masked(tokens: list[str]) -> list[str]:
    return [FIELD if _DIGIT.search(t) else t for t in tokens]


def leaf_of(tokens: list[str], tree: Tree) -> int:
    """A signed 64-bit hash of the token count and the leading tokens; of a short
    line, of all its tokens as they are."""
    path = tokens if len(tokens) < tree.whole_under else masked(tokens[: tree.depth])
    key = "\x1f".join((str(len(tokens)), *path))
    return xxhash.xxh64_intdigest(key.encode("utf-8", "surrogatepass")) - (1 << 63)


def grow(lines: list[str], agree: int) -> list[int]:
    """The template number of each line of a leaf, given in a fixed order."""
    ids: dict[str, int] = {FIELD: -1}
    width, out = len(lines[0].split(" ")), []
    table, n = np.zeros((16, width), np.int64), 0
    for line in lines:
        row = np.array([ids.setdefault(t, len(ids)) for t in line.split(" ")])
        best = -1
        if n:
            score = ((table[:n] == row) | (table[:n] == -1)).sum(axis=1)
            fixed = (table[:n] != -1).any(axis=1)
            best = int(np.where(fixed, score, -1).argmax())
            if 100 * score[best] < agree * width or not fixed[best]:
                best = -1
        if best < 0:
            if n == len(table):
                table = np.concatenate((table, np.zeros_like(table)))
            table[n], best, n = row, n, n + 1
        else:
            # A place that would leave no fixed token stays as it is.
            merged = np.where(table[best] == row, row, -1)
            if (merged != -1).any():
                table[best] = merged
        out.append(best)
    return out


def drop_templates(docs: DataFrame, tree: Tree | None = None, counts: bool = True) -> DataFrame:
    """``docs`` with recurring lines dropped from ``text``; with ``counts``, adds n_lines
    and n_dropped.

    Lines are split at line feeds and joined by them again.  A null text stays null
    and a text without recurring lines stays as it is, empty ones included.  A row
    without a doc_id is left alone and does not count.  Equal texts count once and
    lose the same lines, but that the smallest doc_id of a template keeps its lines
    (with ``copies_keep``, so do rows with the same text).  An empty table stays empty.
    Other columns stay, whatever their names, and n_chars, where there is one, follows
    the new text; with ``counts``, a column named n_lines or n_dropped is replaced.
    """
    o, spark = tree or Tree(), docs.sparkSession
    least = max(1, o.least_tokens)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    id_type = docs.schema["doc_id"].dataType.simpleString()
    # A row's own columns stay inside one struct, apart from the names used here.
    keyed = docs.select(F.struct("*").alias("row"), F.col("doc_id").alias("id"), F.xxhash64("text").alias("hash"), "text")
    known = keyed.where("id IS NOT NULL AND text IS NOT NULL").select("id", "hash", "text")

    def leaves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            out: list[tuple] = []
            for i, h, text in zip(b.column("id").to_pylist(), b.column("hash").to_pylist(), b.column("text").to_pylist(), strict=True):
                found = set()
                for line in text.split("\n"):
                    tokens = line.split()
                    if len(tokens) >= least:
                        found.add(leaf_of(tokens, o))
                out += [(i, h, x) for x in found]
            if out:
                ids, hashes, leaf = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(ids, b.column("id").type), pa.array(hashes, pa.int64()), pa.array(leaf, pa.int64())], ["id", "hash", "leaf"])

    def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Lines of the leaves asked for."""
        names = ["id", "hash", "number", "leaf", "shape", "line"]
        for b in slices(batches):
            kinds = [b.column("id").type, pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.string()]
            out: list[tuple] = []
            for i, h, text, asked in zip(*[b.column(c).to_pylist() for c in ("id", "hash", "text", "asked")], strict=True):
                asked = set(asked)
                for k, line in enumerate(text.split("\n")):
                    tokens = line.split()
                    if len(tokens) >= least and (leaf := leaf_of(tokens, o)) in asked:
                        shape = " ".join(tokens if len(tokens) < o.whole_under else masked(tokens))
                        out.append((i, h, k, leaf, xxhash.xxh64_intdigest(shape.encode("utf-8", "surrogatepass")) - (1 << 63), shape))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names)

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each shape's template, named by the shape that began it; only templates
        whose shapes have texts enough between them."""
        now, held = None, []

        def done() -> pa.RecordBatch:
            # A fixed order, the commonest first, whatever the order of arrival.
            held.sort(key=lambda r: (-r[2], r[1]))
            label = np.array(grow([r[1] for r in held], o.agree))
            texts = np.bincount(label, [r[2] for r in held])
            began = np.unique(label, return_index=True)[1]
            keep = [(r[0], held[began[t]][0]) for r, t in zip(held, label, strict=True) if texts[t] >= o.least_texts]
            shape, template = zip(*keep, strict=True) if keep else ((), ())
            return pa.RecordBatch.from_arrays([pa.array(shape, pa.int64()), pa.array(template, pa.int64())], ["shape", "template"])

        for b in batches:
            for leaf, *row in zip(*[b.column(c).to_pylist() for c in ("leaf", "shape", "line", "texts")], strict=True):
                if held and leaf != now:
                    yield done()
                    held = []
                now = leaf
                held.append(row)
        if held:
            yield done()

    def salted(big: DataFrame, small: DataFrame, key: str) -> DataFrame:
        """An inner join in which a hot key is shared out."""
        many = small.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(o.salts - 1))))
        return big.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(o.salts)).cast("int")).join(many.hint("shuffle_merge"), [key, "salt"]).drop("salt")

    seen = stored(known.mapInArrow(leaves, f"id {id_type}, hash long, leaf long"), "leaves")
    common = seen.groupBy("leaf", "hash").count().groupBy("leaf").agg(F.count("*").alias("texts")).where(F.col("texts") >= o.least_texts).select("leaf")
    asked = salted(seen, common, "leaf").groupBy(F.col("id").alias("i"), F.col("hash").alias("h")).agg(F.collect_set("leaf").alias("asked"))
    texts = known.join(asked.hint("shuffle_merge"), (F.col("id") == F.col("i")) & (F.col("hash") == F.col("h"))).select("id", "hash", "text", "asked")
    found = stored(texts.mapInArrow(lines, f"id {id_type}, hash long, number int, leaf long, shape long, line string"), "lines")
    shapes = found.groupBy("leaf", "shape", "line", "hash").count().groupBy("leaf", "shape", "line").agg(F.count("*").alias("texts"))
    label = stored(shapes.repartition(parts, "leaf").sortWithinPartitions("leaf").mapInArrow(gather, "shape long, template long"), "templates")
    # A template's different texts: those of its shapes overlap.
    of_text = salted(found.select("id", "hash", "shape"), label, "shape").groupBy("template", "hash").agg(F.min("id").alias("id"))
    again = of_text.groupBy("template").agg(F.count("*").alias("texts"), F.min(F.struct("id", "hash")).alias("first")).where(F.col("texts") >= o.least_texts).select("template", "first")
    again = stored(label.join(again, "template").select("shape", "first"), "recurring")
    later = F.col("hash") != F.col("first.hash") if o.copies_keep else F.col("id") > F.col("first.id")
    dropped = salted(found.select("id", "hash", "number", "shape"), again, "shape").where(later).groupBy(F.col("id").alias("i"), F.col("hash").alias("h")).agg(F.collect_set("number").alias("drop"))

    out = keyed.join(dropped.hint("shuffle_merge"), (F.col("id") == F.col("i")) & (F.col("hash") == F.col("h")), "left")
    split = F.split("text", "\n")
    kept = F.array_join(F.filter(split, lambda x, k: ~F.array_contains("drop", k)), "\n")
    new = {c: F.col("row").getField(c) for c in docs.columns}
    if counts:
        new["n_lines"] = F.when(F.col("text").isNull(), 0).otherwise(F.size(split)).cast("long")
        new["n_dropped"] = F.coalesce(F.when(F.col("drop").isNotNull(), F.size("drop")), F.lit(0)).cast("long")
    new["text"] = F.when(F.col("drop").isNull(), F.col("text")).otherwise(kept)
    out = out.select(*[v.alias(c) for c, v in new.items()])
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out
