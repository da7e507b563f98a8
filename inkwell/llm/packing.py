"""Hierarchical best-fit packing of token sequences.

Every input partition packs its own pieces by best fit and emits the nearly full
sequences.  The underfull ones go on as items of their own, a size and an id each; one
that has much room left is taken apart again first, as its pieces fit in more places.
The items of ``fan_in`` partitions meet and are packed again by best fit, then those of as
many groups, up a tree, until all have met.  What becomes full on the way is emitted.  At
the end every piece finds its sequence and offset by the merges on its path.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import slices, stored
from .tokens import encoder


@dataclass(frozen=True)
class Packing:
    """``full``: from this length on a sequence is emitted.  ``solid``: from this share of
    the length on an underfull one is one item.  ``fan_in`` groups meet in a round.  ``at_once`` items are packed together: a group with more of them deals
    them out at random, so that every part has all sizes and complements still meet."""

    length: int = 1024
    full: int = 1022
    solid: float = 0.875
    fan_in: int = 16
    at_once: int = 200_000


ROW = pa.schema([("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("ids", pa.binary()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("open", pa.bool_())])
SCHEMA = "piece int, start long, length long, ids_crc32 long, ids binary, sequence_id long, offset long, open boolean"
#: Bits of a sequence's id below its partition; bits of a key that hold an item's rank
#: below its size.
_ORIGIN, _RANK = 31, 44


def best_fit(sizes: list[int], length: int) -> list[list[int]]:
    """Indexes of the items in each sequence, by best fit of decreasing sizes."""
    room: list[list[int]] = [[] for _ in range(length + 1)]  # sequences by the room left
    some, made = 0, []  # some: bit r is set when room[r] holds a sequence
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        n = sizes[i]
        fits = some >> n
        if fits:
            r = n + (fits & -fits).bit_length() - 1
            k = room[r].pop()
            if not room[r]:
                some &= ~(1 << r)
            made[k].append(i)
        else:
            r, k = length, len(made)
            made.append([i])
        room[r - n].append(k)
        some |= 1 << (r - n)
    return made


def best_fit_counts(counts: dict[int, int], length: int) -> list[tuple[int, int, int, int, int]]:
    """``best_fit`` of ``counts[n]`` items of each size n, without the items.

    Runs (size, rank, each, sequence, offset): from its rank on, items of the size go
    into sequences numbered from ``sequence`` on, ``each`` of them into one, the first
    at ``offset``; up to the next run of the same size.
    """
    room: list[list[tuple[int, int]]] = [[] for _ in range(length + 1)]  # first number and count of sequences
    runs, made = [], 0
    for n in sorted(counts, reverse=True):
        rank, left, r = 0, counts[n], n
        while left:
            while r < length and not room[r]:
                r += 1
            at, many = room[r].pop() if r < length else (made, -(-left // (length // n)))
            if r == length:
                made += many
            each = r // n
            runs.append((n, rank, each, at, length - r))
            whole = min(many, left // each)
            placed = min(left, many * each)
            if whole:
                room[r - each * n].append((at, whole))
            if rest := placed - whole * each:
                room[r - rest * n].append((at + whole, 1))
            used = whole + (rest > 0)
            if used < many:
                room[r].append((at + used, many - used))
            rank, left = rank + placed, left - placed
    return runs


class _Packer:
    """Packs a partition's pieces and writes out rows; ``open`` are those of underfull
    sequences."""

    def __init__(self, opts: Packing):
        self.o, self.origin, self.id_type = opts, TaskContext.get().partitionId(), pa.null()
        self.next_id = self.origin << _ORIGIN
        self.items: list[tuple] = []
        self.rows: list[tuple] = []

    def add(self, piece: tuple) -> None:
        if piece[3] >= self.o.full:
            self._emit([piece], False)
            return
        self.items.append(piece)
        if len(self.items) >= self.o.at_once:
            self.pack()

    def _emit(self, pieces: list[tuple], is_open: bool) -> None:
        at = 0
        for p in pieces:
            self.rows.append((*p, self.next_id, at, is_open))
            at += p[3]
        self.next_id += 1

    def pack(self) -> None:
        items, self.items = self.items, []
        for group in best_fit([p[3] for p in items], self.o.length):
            pieces = [items[i] for i in group]
            n = sum(p[3] for p in pieces)
            if n >= self.o.solid * self.o.length:
                self._emit(pieces, n < self.o.full)
            else:
                for p in pieces:
                    self._emit([p], True)

    def batches(self) -> Iterator[pa.RecordBatch]:
        rows, self.rows = self.rows, []
        for a in range(0, len(rows), 2_000):
            ids, *cols = zip(*rows[a : a + 2_000], strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(ids, self.id_type), *[pa.array(c, f.type) for c, f in zip(cols, ROW, strict=True)]], ["doc_id", *ROW.names])


def merged(ids: np.ndarray, sizes: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Items packed by best fit: their ids and sizes, the id of the item that each one's
    sequence begins with, their offsets there, and the sequences' sizes.  The order of the items
    given makes no difference."""
    order = np.lexsort((ids, -sizes))
    ids, sizes = ids[order], sizes[order]
    first = np.flatnonzero(np.concatenate(([True], np.diff(sizes) != 0)))
    n = np.diff(np.append(first, len(sizes)))
    runs = best_fit_counts(dict(zip(sizes[first].tolist(), n.tolist(), strict=True)), length)
    size, rank, each, sequence, offset = np.array(sorted(runs), np.int64).reshape(-1, 5).T
    own = np.arange(len(sizes)) - np.repeat(first, n)
    run = np.searchsorted((size << _RANK) | rank, (sizes << _RANK) | own, "right") - 1
    own -= rank[run]
    at, into = offset[run] + own % each[run] * sizes, sequence[run] + own // each[run]
    head = np.zeros(into.max(initial=-1) + 1, np.int64)
    head[into[at == 0]] = ids[at == 0]
    return ids, sizes, head[into], at, np.bincount(into, sizes).astype(np.int64)[into]


MERGE = "sequence long, size long, parent long, at long, whole long"


def merge_round(open_: DataFrame, groups: int, o: Packing) -> DataFrame:
    """One round over underfull sequences (sequence, size): where each goes, MERGE.
    Those of ``groups`` neighbouring partitions meet."""
    parts = int(open_.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    grouped = open_.withColumn("group", F.shiftright("sequence", _ORIGIN).cast("long") / groups).withColumn("group", F.floor("group"))
    most = grouped.groupBy("group").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 1
    dealt = grouped.withColumn("part", F.pmod(F.xxhash64("sequence"), F.lit(-(-most // o.at_once))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []

        def done() -> pa.RecordBatch:
            columns = merged(*(np.concatenate(c) for c in zip(*held, strict=True)), o.length)
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["sequence", "size", "parent", "at", "whole"])

        for b in batches:
            group, part, ids, sizes = (b.column(c).to_numpy() for c in ("group", "part", "sequence", "size"))
            edges = np.flatnonzero((np.diff(group) != 0) | (np.diff(part) != 0)) + 1
            for a, z in zip((0, *edges), (*edges, len(ids)), strict=True):
                if z > a and (group[a], part[a]) != now:
                    if held:
                        yield done()
                    now, held = (group[a], part[a]), []
                held.append((ids[a:z], sizes[a:z]))
        if held:
            yield done()

    by_group = dealt.repartition(parts, "group", "part").sortWithinPartitions("group", "part")
    return by_group.select("group", "part", "sequence", "size").mapInArrow(run, MERGE)


def merge_tree(open_: DataFrame, partitions: int, o: Packing) -> DataFrame:
    """sequence, parent and at: where each underfull sequence (sequence, size) ends up.
    Every round is written to the shared folder."""
    open_ = stored(open_, "open")
    path, now, groups = open_.select("sequence", F.col("sequence").alias("parent"), F.lit(0).cast("long").alias("at")), open_, 1
    while groups == 1 or groups < partitions:
        groups *= o.fan_in
        step = stored(merge_round(now, groups, o), "merges")
        solid = (F.col("whole") >= o.solid * o.length) | F.lit(groups >= partitions)  # the last round decides
        head = step.where(solid & (F.col("at") == 0) & (F.col("whole") < o.full)).select("sequence", F.col("whole").alias("size"))
        now = head.unionAll(step.where(~solid).select("sequence", "size"))
        moved = step.where(solid & (F.col("sequence") != F.col("parent"))).select(F.col("sequence").alias("_from"), F.col("parent").alias("_to"), F.col("at").alias("_more"))
        path = path.join(moved, F.col("parent") == F.col("_from"), "left").select("sequence", F.coalesce("_to", "parent").alias("parent"), (F.col("at") + F.coalesce("_more", F.lit(0))).alias("at"))
    return path


def pieces_of(ids: bytes, length: int) -> Iterator[tuple[int, int, bytes]]:
    """Number, start and ids of a document's pieces: all of ``length`` ids, but the
    first, which takes what is over."""
    n = len(ids) // 4
    size, at, k = n % length or length, 0, 0
    while at < n:
        yield k, at, ids[4 * at : 4 * (at + size)]
        at, size, k = at + size, length, k + 1


def pack_documents(docs: DataFrame, vocabulary: str, end_id: int, opts: Packing | None = None, with_ids: bool = True) -> DataFrame:
    """Pack all documents' tokens into as few sequences as it can.

    One row for each piece: doc_id, piece, start, length, ids_crc32, ids (little-endian
    unsigned 32-bit numbers; null unless ``with_ids``), sequence_id and offset.  A null
    or empty text has the end id alone; repeated rows and ids are packed each for
    itself, a null id too; an empty table gives no row.  Ids are of any type.  Other
    columns are dropped.
    """
    o = opts or Packing()
    end = int(end_id).to_bytes(4, "little")

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer, tokens = _Packer(o), encoder(vocabulary)
        for b in slices(batches):
            packer.id_type = b.column("doc_id").type
            for doc_id, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True):
                for k, start, ids in pieces_of(tokens.encode(text) + end, o.length):
                    packer.add((doc_id, k, start, len(ids) // 4, zlib.crc32(ids), ids if with_ids else None))
            yield from packer.batches()
        packer.pack()
        yield from packer.batches()

    id_type = docs.schema["doc_id"].dataType.simpleString()
    found = stored(docs.select("doc_id", "text").mapInArrow(local, f"doc_id {id_type}, {SCHEMA}"), "packing")
    open_ = found.where("open").groupBy(F.col("sequence_id").alias("sequence")).agg(F.sum("length").alias("size"))
    last = found.agg(F.max(F.shiftright("sequence_id", _ORIGIN))).first()[0]
    path = merge_tree(open_, (last or 0) + 1, o)
    kept = found.where("NOT open").drop("open")
    left = found.where("open").join(path, F.col("sequence_id") == F.col("sequence"))
    moved = left.withColumns({"sequence_id": F.col("parent"), "offset": F.col("offset") + F.col("at")})
    return kept.unionAll(moved.select(*kept.columns))
