"""Document fingerprints from closed syncmers.

A k-mer of a text is chosen when the smallest of its inner s-mers is the first or
the last one.  The choice depends on the k-mer alone, so an edit disturbs only the
k-mers that touch it and every other anchor keeps its hash.  The fingerprint is the
bottom sketch of the anchors, the n-th occurrence of an anchor under a hash of its
own: their smallest hashes, each with its place in the text.  Two fingerprints are
matched by position: of the anchors that both have, those count that stand in the
same order in both texts.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from . import hashing
from .ordering import in_order, ranges_of


@dataclass(frozen=True)
class Syncmers:
    """k and s in bytes, and how many of the smallest hashes a fingerprint keeps.
    ``segment`` k-mers of a text are looked at together."""

    k: int = 16
    s: int = 8
    size: int = 64
    segment: int = 1 << 20


_runs = hashing.runs


def _least(x: np.ndarray, n: int) -> np.ndarray:
    """The smallest of each run of n numbers, by doubling the run."""
    size = 1
    while size * 2 <= n:
        x = np.minimum(x[:-size], x[size:])
        size *= 2
    return np.minimum(x[: len(x) - (n - size)], x[n - size :]) if n > size else x


def anchors(text: str, opts: Syncmers) -> tuple[np.ndarray, np.ndarray]:
    """Places (in UTF-8 bytes) and hashes of the closed syncmers of ``text``.

    Equal smallest s-mers count alike: one at an edge is enough.  A text shorter than k has
    one anchor, the hash of the whole; an empty one has none.
    """
    return _anchors(text.encode("utf-8", "surrogatepass"), opts)


def _anchors(data: bytes, opts: Syncmers) -> tuple[np.ndarray, np.ndarray]:
    if len(data) - opts.k >= opts.segment:  # the choice depends on the k-mer alone
        parts = [(a, *_anchors(data[a : a + opts.segment + opts.k - 1], opts)) for a in range(0, len(data) - opts.k + 1, opts.segment)]
        return np.concatenate([a + at for a, at, _ in parts]), np.concatenate([h for *_, h in parts])
    if len(data) < opts.k:
        return (np.zeros(1, np.int64), _runs(data, len(data))) if data else (np.zeros(0, np.int64), np.zeros(0, np.uint64))
    inner, span = _runs(data, opts.s), opts.k - opts.s + 1
    first, last, least = inner[: len(inner) - span + 1], inner[span - 1 :], _least(inner, span)
    at = np.flatnonzero((first == least) | (last == least))
    if opts.k == 2 * opts.s:  # a k-mer is two s-mers side by side
        return at, hashing.mix(inner[at] * hashing.ODD + inner[at + opts.s])
    return at, hashing.mix(_runs(data, opts.k)[at])


def sketch(text: str, opts: Syncmers) -> bytes:
    """The anchors with the smallest hashes, ascending: hash and place (in UTF-8 bytes,
    at most 2**32 - 1) as big-endian numbers of 64 and 32 bits.  A repeated anchor's
    later occurrences, in order, have hashes of their own."""
    at, h = anchors(text, opts)
    order = np.argsort(h, kind="stable")  # places ascend among equal hashes
    at, h = at[order], h[order]
    if len(h):
        new = np.concatenate(([True], h[1:] != h[:-1]))
        turn = (np.arange(len(h)) - np.maximum.accumulate(np.where(new, np.arange(len(h)), 0))).astype(np.uint64)
        h = np.where(turn > 0, hashing.mix(h + turn * hashing.ODD), h)
    order = np.argsort(h, kind="stable")[: opts.size]
    out = np.zeros(len(order), MARK)
    out["hash"], out["place"] = h[order], np.minimum(at[order], 0xFFFFFFFF)
    return out.tobytes()


MARK = np.dtype([("hash", ">u8"), ("place", ">u4")])


def in_order_in_both(a: list[int], b: list[int]) -> int:
    """How many of the pairs of places can be taken so that both places ascend."""
    ends: list[int] = []
    for _, y in sorted(zip(a, b, strict=True)):
        k = bisect_left(ends, y)
        ends[k : k + 1] = [y]
    return len(ends)


def likeness(a: bytes, b: bytes, size: int) -> float:
    """The share of the smallest hashes of both texts' anchors that both have, in the
    same order.  Two empty fingerprints are alike, an empty one is unlike any other."""
    x, y = np.frombuffer(a, MARK), np.frombuffer(b, MARK)
    if not len(x) or not len(y):
        return float(len(x) == len(y))
    if a == b:
        return 1.0
    both = np.union1d(x["hash"], y["hash"])[:size]
    last = both[-1]
    _, i, j = np.intersect1d(x["hash"][x["hash"] <= last], y["hash"][y["hash"] <= last], assume_unique=True, return_indices=True)
    return in_order_in_both(x["place"][i].tolist(), y["place"][j].tolist()) / len(both)


def fingerprint(text: Column | str, opts: Syncmers | None = None) -> Column:
    """Hexadecimal fingerprint of a text column; a null text counts as empty."""
    o = opts or Syncmers()

    @F.pandas_udf("string")
    def of(texts):
        return texts.map(lambda t: sketch(t or "", o).hex())

    return of(text)


def compare_with_edits(docs: DataFrame, opts: Syncmers | None = None) -> DataFrame:
    """Fingerprint each text, its edited form, and compare with the next text's.

    The edited text has its last quarter of code points replaced by the first as
    many of the next row's text, by ascending doc_id; after the last row comes the
    first.  Rows with equal ids are ordered by their text; a null id comes first
    and a null text counts as empty.  One row alone is its own next.
    """
    o = opts or Syncmers()
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    ranges = ranges_of(rows)
    ids = rows.select("doc_id", ranges.number.alias("part")).groupBy("part").agg(F.min("doc_id").alias("first"), F.count(F.when(F.col("doc_id").isNull(), 1)).alias("nulls"))
    full = {r.part: None if r.nulls else r.first for r in ids.collect()}  # a row for each range
    order = sorted(full)
    # A range's first row is also sent to the range before it; the very first to the last.
    before = {p: order[i - 1] for i, p in enumerate(order)}
    kind = docs.schema["doc_id"].dataType.simpleString()
    first = F.array(*[F.lit(full.get(p)).cast(kind) for p in range(ranges.count)])
    sent_to = F.array(*[F.lit(before.get(p, 0)) for p in range(ranges.count)])
    here = F.array(F.struct(F.col("number").alias("part"), F.lit(False).alias("ahead")))
    both = F.concat(here, F.array(F.struct(F.get(sent_to, F.col("number")).alias("part"), F.lit(True).alias("ahead"))))
    dealt = rows.withColumn("number", ranges.number).select("doc_id", "text", F.inline(F.when(F.get(first, F.col("number")).eqNullSafe(F.col("doc_id")), both).otherwise(here)))
    schema = f"doc_id {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"

    def row(doc_id, text: str, own: bytes, after: str, its: bytes) -> tuple:
        n = len(text) // 4
        edited = text[: len(text) - n] + after[:n]
        changed = sketch(edited, o)
        return doc_id, len(text), hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(), own.hex(), changed.hex(), likeness(own, changed, o.size), likeness(own, its, o.size)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for b in batches:
            out = []
            for i in range(b.num_rows):
                doc_id, text, part, ahead = (b.column(c)[i].as_py() for c in ("doc_id", "text", "part", "ahead"))
                if ahead and (last is None or last[0] != part):
                    continue  # one of several rows with the first id: the first of them was enough
                own = sketch(text, o)
                if last is not None:
                    out.append(row(*last[1:], text, own))
                last = None if ahead else (part, doc_id, text, own)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*out, strict=True), fields, strict=True)], schema=fields)

    fields = to_arrow_schema(T._parse_datatype_string(schema))
    return in_order(dealt, ranges, "ahead", "doc_id", "text").mapInArrow(run, schema)
