"""Removal of byte strings that earlier documents hold, by threshold-bounded
interval expansion on a Burrows-Wheeler transform.

Finding what can match.  Every run of ``length`` bytes has one anchor, its smallest
hashed q-gram; equal runs have equal anchors.  Runs with the same anchor stand side
by side and form a stretch.  Only anchors that occur in several documents matter; of
equal stretches only the smallest doc_id goes on.

Finding what does match.  The stretches of some anchors are laid end to end in a
block.  Breadth first, an interval of suffixes that share ``l`` bytes is extended
backwards to those that share ``l + 1``, so boundaries between suffixes are found by
increasing common prefix, up to ``length``.  Suffixes without a boundary between them
share ``length`` bytes or more.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import sha256

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import hashing
from .shared import slices, stored


@dataclass(frozen=True)
class Matching:
    """``gram``: bytes of an anchor.  ``block``: bytes of stretches that one index
    holds.  ``hot``: an anchor of more different stretches has its runs dealt one by
    one, each with its copies.  ``flush``: stretches that a task sorts at a time.
    ``slices``: a partition of anchors is worked off in so many steps.  ``segment``: runs
    of one text that are looked at together."""

    length: int = 50
    gram: int = 20
    block: int = 500_000
    hot: int = 5_000
    flush: int = 500_000
    slices: int = 8
    segment: int = 1 << 20


#: An anchor, a hash of the stretch's bytes, its document and where its runs start.
#: ``row`` tells apart the texts of rows that repeat an id.
REC = np.dtype([("anchor", "<u8"), ("content", "<u8"), ("doc", "<i8"), ("row", "<i4"), ("start", "<i4"), ("runs", "<i4")])


def stretches(data: bytes, doc: int, opts: Matching, row: int = 0) -> np.ndarray:
    """The stretches of one document: neighbouring runs with the same smallest q-gram.
    A run's anchor depends on the run alone, so a long text is cut in segments."""
    if len(data) < opts.length:
        return np.zeros(0, REC)
    if len(data) - opts.length >= opts.segment:
        parts = []
        for a in range(0, len(data) - opts.length + 1, opts.segment):
            parts.append(stretches(data[a : a + opts.segment + opts.length - 1], doc, opts, row))
            parts[-1]["start"] += a
        return np.concatenate(parts)
    h, span = hashing.runs(data, opts.gram), opts.length - opts.gram + 1
    low, size = h, 1
    while size * 2 <= span:
        low, size = np.minimum(low[:-size], low[size:]), size * 2
    low = np.minimum(low[: len(low) - (span - size)], low[span - size :]) if span > size else low
    first = np.concatenate(([0], np.flatnonzero(np.diff(low)) + 1))
    size = np.diff(np.append(first, len(low)))
    if size.max() > span:  # the same gram over and over: cut into stretches of usual size
        parts = -(-size // span)
        within = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
        first, size = np.repeat(first, parts) + within * span, np.minimum(span, np.repeat(size, parts) - within * span)
    out = np.zeros(len(first), REC)
    out["anchor"], out["doc"], out["row"], out["start"], out["runs"] = low[first], doc, row, first, size
    # Overlapping grams from the first byte to the last say all bytes of a stretch.
    c, total = hashing.ODD, size - 1 + opts.length - opts.gram
    x = size.astype(np.uint64)
    for at in range(0, 2 * span + opts.gram, opts.gram):
        inside = np.minimum(first + at, first + total)
        x = hashing.mix(x * c + h[inside])
    out["content"] = x
    return out


def _by_anchor(recs: np.ndarray) -> np.ndarray:
    """The order of anchor, content, doc, row and start.  Most anchors are rare, so
    only what has an anchor's upper bits in common is sorted by all five."""
    bits = len(recs).bit_length()
    key = np.sort((recs["anchor"] >> np.uint64(bits) << np.uint64(bits)) | np.arange(len(recs), dtype=np.uint64))
    order, key = (key & np.uint64((1 << bits) - 1)).astype(np.int64), key >> np.uint64(bits)
    same = key[1:] == key[:-1]
    tied = np.flatnonzero(np.concatenate((same, [False])) | np.concatenate(([False], same)))
    some = recs[order[tied]]
    order[tied] = order[tied][np.lexsort((some["start"], some["row"], some["doc"], some["content"], some["anchor"]))]
    return order


def _combine(recs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted stretches without copies, and the copies of a smaller doc's stretch.
    Copies inside the same document stay."""
    recs = recs[_by_anchor(recs)]
    new = np.concatenate(([True], (np.diff(recs["anchor"]) != 0) | (np.diff(recs["content"]) != 0)))[: len(recs)]
    least = recs["doc"][np.maximum.accumulate(np.where(new, np.arange(len(recs)), 0))]
    later = recs["doc"] > least
    return recs[~later], recs[later]


def _spans(recs: np.ndarray, hot: np.ndarray | None = None) -> pa.RecordBatch:
    none = pa.nulls(len(recs), pa.int64())
    anchor = none if hot is None else pa.array(recs["anchor"].view(np.int64))
    flag = pa.array(np.zeros(len(recs), bool) if hot is None else hot)
    return pa.RecordBatch.from_arrays([pa.array(recs["doc"]), pa.array(recs["row"]), pa.array(recs["start"]), pa.array(recs["runs"]), anchor, flag], ["doc_id", "row", "start", "runs", "anchor", "single"])


def _sorted_places(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The places of the keys in ascending order, and the keys in that order."""
    bits = len(key).bit_length()
    if int(key.max()).bit_length() + bits > 64:
        at = np.argsort(key, kind="stable")
        return at, key[at]
    both = np.sort((key << np.uint64(bits)) | np.arange(len(key), dtype=np.uint64))  # far faster than argsort
    return (both & np.uint64((1 << bits) - 1)).astype(np.int64), both >> np.uint64(bits)


def _heads(key: np.ndarray) -> np.ndarray:
    return np.concatenate(([True], key[1:] != key[:-1]))


def sort_suffixes(text: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Suffixes in order of their first ``length`` bytes or more; whether a suffix and
    the one before it differ within ``size`` bytes, and within one byte less; ``size``."""
    n = len(text)
    kinds = np.unique(text)
    code = np.zeros(256, np.uint64)
    code[kinds] = np.arange(1, len(kinds) + 1)
    bits = len(kinds).bit_length()
    size = min(length, max(1, (64 - n.bit_length()) // bits))
    padded, key = np.concatenate((code[text], np.zeros(size, np.uint64))), np.zeros(n, np.uint64)
    for i in range(size):
        key = (key << np.uint64(bits)) | padded[i : i + n]
    order, key = _sorted_places(key)
    new, depth = _heads(key), size
    differ, before = new.copy(), _heads(key >> np.uint64(bits))
    rank = np.empty(n, np.int64)  # the first row of a suffix's group
    rank[order] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    while depth < length:  # prefix doubling of what is still tied, no deeper than needed
        rows = np.flatnonzero(~(new & np.append(new[1:], True)))
        if not len(rows):
            break
        at = order[rows]
        ahead = np.where(at + depth < n, rank[np.minimum(at + depth, n - 1)] + 1, 0)
        place, key = _sorted_places((np.cumsum(new[rows]).astype(np.uint64) << np.uint64(n.bit_length())) | ahead.astype(np.uint64))
        order[rows], new[rows] = at[place], _heads(key)
        rank[order[rows]] = np.maximum.accumulate(np.where(new[rows], rows, 0))
        depth *= 2
    return order, differ, before, size


def find_boundaries(text: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes in order of their first ``length`` bytes or more, and for each
    whether its common prefix with the one before is shorter than ``length``.  That
    holds for suffixes that meet no separator (255) within ``length`` bytes.

    Breadth first from the prefixes that the sort keys show: the boundaries found last
    (common prefixes of one length) split their intervals.  Every row of an interval's
    smaller parts is extended backwards by its byte of the transform; where it and the
    neighbour there come from different parts, a boundary of the next length is found.
    The rows of a largest part, and intervals that are not split, are not visited.
    """
    n = len(text)
    order, found, shorter, size = sort_suffixes(text, length)
    before = text[order - 1]  # the transform: the byte in front of each suffix
    source = np.argsort(before, kind="stable").astype(np.int32)  # row r's suffix is one byte and the suffix of row source[r]
    back = np.empty(n, np.int32)  # the other way: a row's suffix with the byte in front of it
    back[source] = np.arange(n, dtype=np.int32)
    fresh = np.flatnonzero(found & ~shorter)
    part, made = (np.cumsum(shorter) - 1).astype(np.int32), int(shorter.sum())
    low, high = np.zeros(n, np.int64), np.zeros(n, np.int64)
    low[:made] = np.flatnonzero(shorter)
    high[:made] = np.append(low[1:made], n)
    for _ in range(size, length):
        if not len(fresh):
            break
        parent = part[fresh]
        first = np.flatnonzero(_heads(parent))
        start = np.insert(fresh, first, low[parent[first]])  # of each part of an interval
        group = first + np.arange(len(first))
        end = np.append(start[1:], 0)
        end[np.append(group[1:], len(start)) - 1] = high[parent[first]]
        width = end - start
        largest = np.flatnonzero(width == np.repeat(np.maximum.reduceat(width, group), np.diff(np.append(group, len(start)))))
        largest = largest[_heads(np.searchsorted(group, largest, "right"))]
        low[parent[first]], high[parent[first]] = start[largest], end[largest]
        small = np.ones(len(start), bool)
        small[largest] = False
        start, end, width = start[small], end[small], width[small]
        own = np.arange(made, made + len(start), dtype=np.int32)
        low[own], high[own], made = start, end, made + len(start)
        rows = np.repeat(start - (np.cumsum(width) - width), width) + np.arange(width.sum())
        own = np.repeat(own, width)
        part[rows] = own
        to = back[rows]
        here = np.flatnonzero(~found[to])
        a = to[here]
        a = a[part[source[a - 1]] != own[here]]
        here = np.flatnonzero(~found[np.minimum(to + 1, n - 1)] & (to + 1 < n))
        b = to[here] + 1
        b = b[part[source[b]] != own[here]]
        fresh = np.sort(np.concatenate((a, b))).astype(np.int64)
        fresh = fresh[_heads(fresh)] if len(fresh) else fresh
        found[fresh] = True
    return order, found


def earlier_runs(pieces: list[bytes], docs: list[int], rows: list[int], starts: list[int], runs: list[int], length: int) -> np.ndarray:
    """Spans (as REC) of the pieces' runs that also start in a piece of a smaller doc."""
    text = np.frombuffer(b"\xff".join(pieces) + b"\xff", np.uint8)  # no byte of UTF-8 text
    size, n = np.array([len(p) + 1 for p in pieces]), np.array(runs)
    base, doc = np.cumsum(size) - size, np.array(docs, np.int64)
    piece = np.full(len(text), -1)
    at = np.repeat(base - (np.cumsum(n) - n), n) + np.arange(n.sum())
    piece[at] = np.repeat(np.arange(len(pieces)), n)
    order, found = find_boundaries(text, length)
    group, owner = np.cumsum(found), piece[order]
    order, group, owner = order[owner >= 0], group[owner >= 0], owner[owner >= 0]
    first = np.concatenate(([0], np.flatnonzero(np.diff(group)) + 1))
    least = np.repeat(np.minimum.reduceat(doc[owner], first), np.diff(np.append(first, len(group))))
    hit = np.sort(order[doc[owner] > least])
    own = piece[hit]
    new = np.concatenate(([True], (np.diff(hit) != 1) | (np.diff(own) != 0)))[: len(hit)]
    head = np.flatnonzero(new)
    out = np.zeros(len(head), REC)
    out["doc"], out["row"] = doc[own[head]], np.array(rows)[own[head]]
    out["start"], out["runs"] = np.array(starts)[own[head]] + hit[head] - base[own[head]], np.diff(np.append(head, len(hit)))
    return out


def find_repeats(docs: DataFrame, opts: Matching | None = None) -> DataFrame:
    """Spans of runs that a document with a smaller doc_id also holds: doc_id, row,
    start (byte) and runs (how many neighbouring runs start from there).  ``docs`` has
    doc_id, row and text."""
    o, spark = opts or Matching(), docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = parts * o.slices

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sorted stretches, packed, by slice of the anchors; copies' spans."""
        pack, held, n = zstandard.ZstdCompressor(level=1), [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            recs, copies = _combine(np.concatenate(held))
            place = (recs["anchor"] >> np.uint64(40)) % np.uint64(dealt)
            order = np.argsort(place, kind="stable")
            recs, place = recs[order], place[order]
            edges = np.concatenate(([0], np.flatnonzero(np.diff(place)) + 1, [len(recs)]))
            rows = [(int(place[a]), _packed(recs[a:b], pack), True) for a, b in zip(edges[:-1], edges[1:], strict=True) if b > a]
            rows += [(int(copies["doc"][a] % dealt), _packed(copies[a : a + 50_000], pack), False) for a in range(0, len(copies), 50_000)]
            for a in range(0, len(rows), 2_000):
                slot, blob, recs_in = zip(*rows[a : a + 2_000], strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(slot, pa.int32()), pa.array(blob, pa.binary()), pa.array(recs_in)], ["slot", "blob", "fresh"])

        for b in slices(batches):
            for doc_id, row, text in zip(*[b.column(c).to_pylist() for c in ("doc_id", "row", "text")], strict=True):
                held.append(stretches(text.encode("utf-8", "surrogatepass"), doc_id, o, row))
                n += len(held[-1])
                if n >= o.flush:
                    yield from flush()
                    held, n = [], 0
        if n:
            yield from flush()

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """All stretches of a slice of anchors: spans of copies, and what to compare."""
        unpack, slot, held = zstandard.ZstdDecompressor(), None, []

        def done() -> Iterator[pa.RecordBatch]:
            recs, copies = _combine(np.concatenate(held))
            if len(copies):
                yield _spans(copies)
            new = np.concatenate(([True], np.diff(recs["anchor"]) != 0))
            first = np.flatnonzero(new)
            sizes = np.diff(np.append(first, len(recs)))
            several = np.minimum.reduceat(recs["doc"], first) != np.maximum.reduceat(recs["doc"], first)
            ask = np.repeat(several, sizes)
            if ask.any():
                yield _spans(recs[ask], np.repeat(sizes > o.hot, sizes)[ask])

        for b in batches:
            for s, blob, fresh in zip(*[b.column(c).to_pylist() for c in ("slot", "blob", "fresh")], strict=True):
                if held and s != slot:
                    yield from done()
                    held = []
                recs = _unpacked(blob, unpack)
                if fresh:
                    slot = s
                    held.append(recs)
                else:
                    yield _spans(recs)
        if held:
            yield from done()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The bytes of the stretches to compare."""
        for b in slices(batches):
            rows = []
            for doc_id, own, text, asked in zip(*[b.column(c).to_pylist() for c in ("doc_id", "row", "text", "asked")], strict=True):
                if not asked:
                    continue
                data = text.encode("utf-8", "surrogatepass")
                for x in asked:
                    if x["single"]:
                        for k in range(x["start"], x["start"] + x["runs"]):
                            run = data[k : k + o.length]
                            rows.append((int.from_bytes(sha256(run).digest()[:8], "little", signed=True), doc_id, own, k, 1, run))
                    else:
                        rows.append((x["anchor"], doc_id, own, x["start"], x["runs"], data[x["start"] : x["start"] + x["runs"] + o.length - 1]))
                if len(rows) > 20_000:
                    yield _cut(rows)
                    rows = []
            if rows:
                yield _cut(rows)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, size, first, alike = [], 0, None, True
        for b in batches:
            for row in zip(*[b.column(c).to_pylist() for c in ("anchor", "doc_id", "row", "start", "runs", "bytes")], strict=True):
                new = first is None or row[0] != first[0]
                # A block may end among an anchor's rows only while these are all equal, as
                # those of a run dealt alone are: the next begins with the smallest document again.
                if size >= o.block and (new or alike):
                    yield _found(rows)
                    rows, size = ([], 0) if new else ([first], len(first[5]) + 1)
                first = row if new else first
                alike = new or alike and row[5] == first[5]
                rows.append(row)
                size += len(row[5]) + 1
        if rows:
            yield _found(rows)

    def _found(rows: list[tuple]) -> pa.RecordBatch:
        _, doc, row, start, runs, data = zip(*rows, strict=True)
        return _spans(earlier_runs(list(data), list(doc), list(row), list(start), list(runs), o.length)).select(["doc_id", "row", "start", "runs"])

    known = docs.where("doc_id IS NOT NULL AND text IS NOT NULL")
    slots = known.mapInArrow(deal, "slot int, blob binary, fresh boolean")
    met = slots.repartitionById(parts, F.expr(f"cast(slot / {o.slices} AS int)")).sortWithinPartitions("slot", F.col("fresh"))
    spans = stored(met.mapInArrow(meet, "doc_id long, row int, start int, runs int, anchor long, single boolean"), "repeats")
    asked = spans.where("anchor IS NOT NULL").groupBy(F.col("doc_id").alias("doc"), F.col("row").alias("r")).agg(F.collect_list(F.struct("start", "runs", "anchor", "single")).alias("asked"))
    # A left join, so that these texts are dealt out as for the last join and only once.
    pieces = docs.join(asked.hint("shuffle_merge"), (F.col("doc_id") == F.col("doc")) & (F.col("row") == F.col("r")), "left").select("doc_id", "row", "text", "asked").mapInArrow(cut, "anchor long, doc_id long, row int, start int, runs int, bytes binary")
    compared = pieces.repartition(parts, "anchor").sortWithinPartitions("anchor", "doc_id", "row", "start").mapInArrow(compare, "doc_id long, row int, start int, runs int")
    return spans.where("anchor IS NULL").select("doc_id", "row", "start", "runs").unionAll(compared)


def _packed(recs: np.ndarray, pack) -> bytes:
    """Columns one after another, the anchors as differences."""
    anchor = np.diff(recs["anchor"], prepend=np.uint64(0))
    planes = [np.ascontiguousarray(recs[f]).view(np.uint8).reshape(len(recs), -1).T.tobytes() for f in ("doc", "row", "start", "runs")]
    raw = b"".join([anchor.tobytes(), recs["content"].tobytes(), *planes])
    return len(recs).to_bytes(4, "little") + pack.compress(raw)


def _unpacked(blob: bytes, unpack) -> np.ndarray:
    n, raw = int.from_bytes(blob[:4], "little"), unpack.decompress(blob[4:])
    out = np.zeros(n, REC)
    out["anchor"] = np.cumsum(np.frombuffer(raw, "<u8", n))
    out["content"] = np.frombuffer(raw, "<u8", n, 8 * n)
    planes = lambda at, width: np.ascontiguousarray(np.frombuffer(raw, np.uint8, width * n, at).reshape(width, n).T).view(f"<i{width}").reshape(-1)
    out["doc"], out["row"], out["start"], out["runs"] = planes(16 * n, 8), planes(24 * n, 4), planes(28 * n, 4), planes(32 * n, 4)
    return out


def _cut(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["anchor", "doc_id", "row", "start", "runs", "bytes"])


def _with_spans(docs: DataFrame, opts: Matching) -> DataFrame:
    """own (a struct of all columns), text and spans for every row of ``docs``.  Rows
    with one id and different texts are told apart by a hash of the text."""
    if not isinstance(docs.schema["doc_id"].dataType, T.IntegralType):
        raise TypeError(f"doc_id is {docs.schema['doc_id'].dataType.simpleString()}, not a whole number")
    keyed = docs.select(F.struct("*").alias("own"), F.col("doc_id").cast("long").alias("doc_id"), F.expr("cast(xxhash64(text) & 2147483647 AS int)").alias("row"), "text")
    found = find_repeats(keyed.select("doc_id", "row", "text"), opts).groupBy(F.col("doc_id").alias("doc"), F.col("row").alias("r")).agg(F.collect_list(F.struct("start", "runs")).alias("spans"))
    return keyed.join(found.hint("shuffle_merge"), (F.col("doc_id") == F.col("doc")) & (F.col("row") == F.col("r")), "left").select("own", "text", "spans")


def _left_over(data: bytes, spans: list[dict] | None, length: int) -> tuple[bytes, int]:
    """What spans of runs leave of the bytes, and how many maximal spans went."""
    end, kept, n = 0, [], 0
    for x in sorted(spans or (), key=lambda x: x["start"]):
        a, z = x["start"], min(len(data), x["start"] + x["runs"] + length - 1)
        if a > end or not n and a == 0:
            kept.append(data[end:a])
            n += 1
        end = max(end, z)
    kept.append(data[end:])
    return b"".join(kept), n


def remove_repeats(docs: DataFrame, opts: Matching | None = None) -> DataFrame:
    """Remove every byte covered by a run of ``length`` bytes that also starts in a
    document with a smaller doc_id: doc_id, n_bytes, n_removed, n_spans (maximal
    removed runs) and kept (the remaining bytes).

    Every whole text is UTF-8 bytes; runs are judged on the input.  A null text is
    empty and a text under ``length`` bytes stays whole; so does a row without an id,
    which no other row is compared with.  doc_id is a whole number.  Rows that repeat
    an id count as one document, so they lose nothing to each other; each loses what
    its own text shares with smaller ids.  An empty table gives no row; other columns
    are dropped.
    """
    o = opts or Matching()

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, kinds = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"], [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
        for b in slices(batches):
            rows = []
            for doc_id, text, spans in zip(*[b.column(c).to_pylist() for c in ("doc_id", "text", "spans")], strict=True):
                data = (text or "").encode("utf-8", "surrogatepass")
                left, n = _left_over(data, spans, o.length)
                rows.append((doc_id, len(data), len(data) - len(left), n, left))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    found = _with_spans(docs.select("doc_id", "text"), o).select(F.col("own.doc_id").cast("long").alias("doc_id"), "text", "spans")
    return found.mapInArrow(apply, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")


def without_repeats(docs: DataFrame, opts: Matching | None = None) -> DataFrame:
    """``docs`` with repeated runs cut out of ``text``, all its columns kept, whatever
    their names.

    As in ``remove_repeats``, so doc_id is a whole number, else it is an error; where a cut goes through a character its remaining
    bytes are dropped.  A null text stays null.  n_chars, where there is one, follows
    the new text.  Repeated rows stay as many as they are; an empty table stays empty.
    """
    o = opts or Matching()

    @F.arrow_udf("string")
    def cut(texts: pa.Array, spans: pa.Array) -> pa.Array:
        cut_out = lambda t, s: _left_over(t.encode("utf-8", "surrogatepass"), s, o.length)[0].decode("utf-8", "ignore")
        return pa.array((None if t is None else cut_out(t, s) for t, s in zip(texts.to_pylist(), spans.to_pylist(), strict=True)), pa.string())

    found = _with_spans(docs, o)
    changed = cut(F.when(F.col("spans").isNotNull(), F.col("text")), "spans")  # other texts don't go to Python
    text_of = {c: F.col("own").getField(c) for c in docs.columns} | {"text": F.coalesce(changed, F.col("text"))}
    out = found.select(*[v.alias(c) for c, v in text_of.items()])
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out
