"""Set similarity join of n-gram sets with a prefix tree.

All n-grams have one global order, the rarest first by a sketch of their counts over
the whole table.  Sets that are alike enough share one of their first n-grams (their
prefix), so documents meet by those; n-grams at which the same sets meet count as one
meeting.  Where several meet, the counts of their n-grams by hash class bound their
overlap.  Candidates that are left are dealt into neighbourhoods, each set once into
each.  There the sets make one prefix tree: in global order, the commonest first, they
share the paths of their common n-grams.  All sets walk down the tree together; their
overlaps are carried along shared paths, and a set leaves a subtree when the n-grams
that remain cannot suffice.

Equal sets count as one.  Where many sets meet (a family of near copies), neighbours
by size are compared first; once they are known to be connected, only pairs from
different components are looked at.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import hashing
from .components import connected_components
from .shared import slices, stored


@dataclass(frozen=True)
class Likeness:
    """Sets of ``words``-word shingles are linked from ``percent`` on.  ``sketch``:
    log2 of the counters behind the global order, and of the bits that say whose sets
    are asked for; to grow with the corpus.  ``crowd``: from so many sets at one
    meeting on, they are connected first, ``share`` of them in a task.  ``near``: sets
    of a neighbourhood, and ``grams`` their n-grams, about."""

    words: int = 4
    percent: int = 85
    sketch: int = 20
    crowd: int = 64
    classes: int = 256
    flush: int = 1_000_000
    slices: int = 16
    share: int = 4096
    near: int = 128
    grams: int = 500_000


def shingles(text: str | None, n: int) -> np.ndarray:
    """Sorted distinct hashes of a text's n-word shingles, A-Z in lower case.  With
    fewer words the whole sequence is one; without words there is none."""
    return hashing.shingles([text], n)[0]


def needed(a, b, percent: int):
    """The least overlap of linked sets of these sizes."""
    return -(-percent * (a + b) // (100 + percent))


class PrefixTree:
    """Sets, each an array in the global order, as a tree of shared paths.

    A node has the n-grams on the path to it from its parent, the sizes of the sets
    below it and the sets that end there.
    """

    def __init__(self, sets: list[np.ndarray]):
        self.label: list[np.ndarray] = [np.zeros(0, np.uint64)]
        self.children: list[dict[int, int]] = [{}]
        self.ends: list[list[int]] = [[]]
        self.low, self.high = [1 << 60], [0]
        for k, s in enumerate(sets):
            self._insert(k, s)

    def _node(self, label: np.ndarray, low: int, high: int) -> int:
        self.label.append(label)
        self.children.append({})
        self.ends.append([])
        self.low.append(low)
        self.high.append(high)
        return len(self.label) - 1

    def _insert(self, k: int, s: np.ndarray) -> None:
        at, size, node = 0, len(s), 0
        while True:
            self.low[node], self.high[node] = min(self.low[node], size), max(self.high[node], size)
            if at == size:
                self.ends[node].append(k)
                return
            head = int(s[at])
            child = self.children[node].get(head)
            if child is None:
                self.children[node][head] = leaf = self._node(s[at:], size, size)
                self.ends[leaf].append(k)
                return
            label = self.label[child]
            m = min(len(label), size - at)
            differ = np.flatnonzero(label[:m] != s[at : at + m])
            shared = int(differ[0]) if len(differ) else m
            if shared < len(label):  # split the path
                self.children[node][head] = upper = self._node(label[:shared], self.low[child], self.high[child])
                self.children[upper][int(label[shared])] = child
                self.label[child] = label[shared:]
                child = upper
            at, node = at + shared, child

    def join(self, probes: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
        """Pairs (probe, set) that are linked.  All probes walk the tree together."""
        n = np.fromiter(map(len, probes), np.int64, len(probes))
        every = np.concatenate(probes)
        by = np.argsort(every, kind="stable")
        owner = np.repeat(np.arange(len(probes)), n)[by]
        grams, first = np.unique(every[by], return_index=True)
        last = np.append(first[1:], len(every))
        found, stack = [], [(0, 0, np.zeros(len(probes), np.int64), np.arange(len(probes)))]
        while stack:
            node, depth, overlap, alive = stack.pop()  # overlap of every probe, alive those still on the way
            label = self.label[node]
            if len(label):
                at = np.minimum(np.searchsorted(grams, label), len(grams) - 1)
                at = at[grams[at] == label]
                size = last[at] - first[at]
                held = np.repeat(first[at] - (np.cumsum(size) - size), size) + np.arange(size.sum())
                overlap = overlap + np.bincount(owner[held], minlength=len(probes))
                depth += len(label)
            # At best all that remains of the longest set below, or of the probe, is shared.
            o, m = overlap[alive], n[alive]
            alive = alive[o + np.minimum(self.high[node] - depth, m - o) >= needed(m, self.low[node], percent)]
            if not len(alive):
                continue
            if self.ends[node]:
                hit = alive[overlap[alive] >= needed(n[alive], depth, percent)].tolist()
                found += [(p, k) for k in self.ends[node] for p in hit]
            stack += [(c, depth, overlap, alive) for c in self.children[node].values()]
        return found

    def search(self, probe: np.ndarray, percent: int) -> list[int]:
        """Sets linked with one probe."""
        return [k for _, k in self.join([probe], percent)]


def _by_count(s: np.ndarray, counts: np.ndarray, bits: int) -> np.ndarray:
    """A set in the global order: by the count of its n-grams' class, then by hash."""
    count = counts[(s >> np.uint64(64 - bits)).astype(np.int64)].astype(np.uint64)
    key = np.sort((count << np.uint64(32)) | np.arange(len(s), dtype=np.uint64))
    return s[(key & np.uint64(0xFFFFFFFF)).astype(np.int64)]


def _set_key(s: np.ndarray) -> int | None:
    return xxhash.xxh3_64_intdigest(s.tobytes()) - (1 << 63) if len(s) else None


def _signatures(sets: list[np.ndarray], classes: int) -> list[bytes | None]:
    """How many n-grams are in each hash class, up to 15, in half bytes."""
    size = np.fromiter(map(len, sets), np.int64, len(sets))
    place = np.repeat(np.arange(len(sets)) * classes, size) + (np.concatenate(sets) & np.uint64(classes - 1)).astype(np.int64)
    c = np.bincount(place, minlength=len(sets) * classes).clip(0, 15).astype(np.uint8).reshape(len(sets), classes)
    packed = c[:, ::2] | (c[:, 1::2] << 4)
    return [packed[k].tobytes() if m else None for k, m in enumerate(size.tolist())]


def _unpack(sig: list[bytes]) -> np.ndarray:
    packed = np.frombuffer(b"".join(sig), np.uint8).reshape(len(sig), -1)
    return np.stack((packed & 15, packed >> 4), axis=-1).reshape(len(sig), -1)


def _alike(a: np.ndarray, na: np.ndarray, b: np.ndarray, nb: np.ndarray, percent: int) -> np.ndarray:
    """Whether sets could be linked: by sizes, and by the overlap within hash classes.
    What a class holds beyond 15 may be shared too."""
    fits = 100 * np.minimum(na, nb) >= percent * np.maximum(na, nb)
    beyond = np.minimum(na - a.sum(axis=-1, dtype=np.int64), nb - b.sum(axis=-1, dtype=np.int64))
    return fits & (np.minimum(a, b).sum(axis=-1, dtype=np.int64) + beyond >= needed(na, nb, percent))


REC = np.dtype([("token", "<u8"), ("set", "<i8"), ("n", "<i4")])


def describe(docs: DataFrame, o: Likeness) -> DataFrame:
    """A row for each document (doc_id, n, set: a hash of its set, signature), and
    for each task's part of the sketch (slice, counts)."""
    size = 1 << o.sketch

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, pack, kind = np.zeros(size, np.int64), zstandard.ZstdCompressor(level=1), None
        for b in slices(batches, 500):
            kind, rows = b.schema.field("doc_id").type, b.num_rows
            sets = hashing.shingles(b.column("text").to_pylist(), o.words)
            np.add.at(counts, (np.concatenate(sets) >> np.uint64(64 - o.sketch)).astype(np.int64), 1)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(map(len, sets), pa.int64()), pa.array(map(_set_key, sets), pa.int64()), pa.array(_signatures(sets, o.classes), pa.binary()), pa.nulls(rows, pa.int32()), pa.nulls(rows, pa.binary())], names)
        if counts.any():
            k, parts = o.slices, [pack.compress(p.tobytes()) for p in np.split(counts, o.slices)]
            yield pa.RecordBatch.from_arrays([pa.nulls(k, kind), pa.nulls(k, pa.int64()), pa.nulls(k, pa.int64()), pa.nulls(k, pa.binary()), pa.array(range(k), pa.int32()), pa.array(parts, pa.binary())], names)

    names = ["doc_id", "n", "set", "signature", "slice", "counts"]
    kind = docs.schema["doc_id"].dataType.simpleString()
    return stored(docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n long, set long, signature binary, slice int, counts binary"), "sets")


def _gathered(parts: DataFrame, o: Likeness, size: int, dtype: str, join: Callable) -> np.ndarray:
    """One array of a fixed size from the tasks' parts of it (slice, counts), which
    are put together a slice at a time."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack, total = zstandard.ZstdDecompressor(), {}
        for b in batches:
            for k, c in zip(b.column("slice").to_pylist(), b.column("counts").to_pylist(), strict=True):
                part = np.frombuffer(unpack.decompress(c), dtype)
                total[k] = join(total[k], part) if k in total else part
        if total:
            yield pa.RecordBatch.from_arrays([pa.array(total.keys(), pa.int32()), pa.array([v.tobytes() for v in total.values()], pa.binary())], ["slice", "counts"])

    out = np.zeros(size, dtype)
    for p in parts.select("slice", "counts").repartitionById(o.slices, F.col("slice")).mapInArrow(add, "slice int, counts binary").collect():
        out.reshape(o.slices, -1)[p["slice"]] = np.frombuffer(p["counts"], dtype)
    return out


def global_counts(described: DataFrame, o: Likeness) -> np.ndarray:
    """The sketch: 2 ** sketch counters over all documents, whatever their number."""
    out = _gathered(described.where("slice IS NOT NULL"), o, 1 << o.sketch, "<i8", np.add)
    return np.minimum(out, np.iinfo(np.int32).max).astype(np.int32)


def meetings(docs: DataFrame, counts: np.ndarray, o: Likeness) -> DataFrame:
    """Where two or more different sets have an n-gram in their prefixes: meeting (a
    hash of the sets that meet), members (how many), part, set and n.  A large meeting
    has several parts, its sets in order of their sizes."""
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = parts * o.slices

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack, held, seen, n = zstandard.ZstdCompressor(level=1), [], set(), 0

        def flush() -> Iterator[pa.RecordBatch]:
            recs = np.concatenate(held)
            place = hashing.mix(recs["token"]) % np.uint64(dealt)
            key = np.sort((place << np.uint64(32)) | np.arange(len(recs), dtype=np.uint64))
            recs, place = recs[(key & np.uint64(0xFFFFFFFF)).astype(np.int64)], (key >> np.uint64(32)).astype(np.int64)
            edges = np.concatenate(([0], np.flatnonzero(np.diff(place)) + 1, [len(recs)]))
            slot = [int(place[a]) for a in edges[:-1]]
            blob = [pack.compress(b"".join(np.ascontiguousarray(recs[f][a:z]).tobytes() for f in REC.names)) for a, z in zip(edges[:-1], edges[1:], strict=True)]
            for a in range(0, len(slot), 2_000):
                yield pa.RecordBatch.from_arrays([pa.array(slot[a : a + 2_000], pa.int32()), pa.array(blob[a : a + 2_000], pa.binary())], ["slot", "blob"])

        for b in slices(batches, 500):
            for s in hashing.shingles(b.column("text").to_pylist(), o.words):
                size, key = len(s), _set_key(s)
                if not size or key in seen:
                    continue
                seen.add(key)  # copies among the sets at hand
                first = _by_count(s, counts, o.sketch)[: size - -(-o.percent * size // 100) + 1]
                recs = np.zeros(len(first), REC)
                recs["token"], recs["set"], recs["n"] = first, key, size
                held.append(recs)
                n += len(recs)
            if n >= o.flush:
                yield from flush()
                held, seen, n = [], set(), 0
        if n:
            yield from flush()

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack, slot, held = zstandard.ZstdDecompressor(), None, []

        def done() -> Iterator[pa.RecordBatch]:
            recs = np.concatenate(held)
            recs = recs[np.lexsort((recs["set"], recs["n"], recs["token"]))]
            recs = recs[np.concatenate(([True], (np.diff(recs["token"]) != 0) | (np.diff(recs["set"]) != 0)))]
            first = np.flatnonzero(np.concatenate(([True], np.diff(recs["token"]) != 0)))
            last = np.append(first[1:], len(recs))
            name = np.add.reduceat(hashing.mix(recs["set"].view(np.uint64)), first)
            several = np.flatnonzero(last - first > 1)
            several = several[np.unique(name[several], return_index=True)[1]]
            rows = [(int(name[g]), z - a, k, x, min(z, x + o.share)) for g, a, z in zip(several.tolist(), first[several].tolist(), last[several].tolist(), strict=True) for k, x in enumerate(range(a, z, o.share))]
            for i in range(0, len(rows), 1_000):
                some = rows[i : i + 1_000]
                at = np.concatenate([np.arange(x, z) for *_, x, z in some])
                edges = pa.array(np.concatenate(([0], np.cumsum([z - x for *_, x, z in some]))), pa.int32())
                sets, sizes = (pa.ListArray.from_arrays(edges, pa.array(recs[f][at].astype(np.int64))) for f in ("set", "n"))
                yield pa.RecordBatch.from_arrays([pa.array(np.array([r[0] for r in some], np.uint64).view(np.int64)), pa.array([r[1] for r in some], pa.int64()), pa.array([r[2] for r in some], pa.int32()), sets, sizes], ["meeting", "members", "part", "sets", "sizes"])

        for b in batches:
            for s, blob in zip(b.column("slot").to_pylist(), b.column("blob").to_pylist(), strict=True):
                if held and s != slot:
                    yield from done()
                    held = []
                slot, raw = s, unpack.decompress(blob)
                k = len(raw) // REC.itemsize
                recs = np.zeros(k, REC)
                recs["token"], recs["set"], recs["n"] = np.frombuffer(raw, "<u8", k), np.frombuffer(raw, "<i8", k, 8 * k), np.frombuffer(raw, "<i4", k, 16 * k)
                held.append(recs)
        if held:
            yield from done()

    slots = docs.select("text").mapInArrow(deal, "slot int, blob binary")
    met = slots.repartitionById(parts, F.expr(f"cast(slot / {o.slices} AS int)")).sortWithinPartitions("slot")
    lists = met.mapInArrow(meet, "meeting long, members long, part int, sets array<long>, sizes array<long>").dropDuplicates(["meeting", "part"])
    return lists.select("meeting", "members", "part", F.inline(F.arrays_zip(F.col("sets").alias("set"), F.col("sizes").alias("n"))))


def _groups(batches: Iterator[pa.RecordBatch], key: tuple[str, ...], names: tuple[str, ...]) -> Iterator[list[tuple]]:
    """The rows of each key, sorted by it."""
    held, now = [], None
    for b in batches:
        for k, row in zip(zip(*[b.column(c).to_pylist() for c in key], strict=True), zip(*[b.column(c).to_pylist() for c in names], strict=True), strict=True):
            if held and k != now:
                yield held
                held = []
            now = k
            held.append(row)
    if held:
        yield held


def _pairs(rows: set[tuple[int, int]]) -> pa.RecordBatch:
    a, b = zip(*rows, strict=True) if rows else ((), ())
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


def _first_pairs(o: Likeness):
    """Pairs that could be linked: all of a small group, of a crowd only neighbours."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: set[tuple[int, int]] = set()
        for rows in _groups(batches, ("meeting", "part"), ("set", "n", "signature", "members")):
            node, n, sig, members = zip(*rows, strict=True)
            node, n, sig = np.array(node), np.array(n), _unpack(sig)
            for shift in range(1, len(node) if members[0] <= o.crowd else 9):
                if shift >= len(node) or not (100 * n[:-shift] >= o.percent * n[shift:]).any():
                    break
                for i in np.flatnonzero(_alike(sig[:-shift], n[:-shift], sig[shift:], n[shift:], o.percent)).tolist():
                    a, b = int(node[i]), int(node[i + shift])
                    if a != b:
                        out.add((max(a, b), min(a, b)))
            if len(out) > 50_000:
                yield _pairs(out)
                out = set()
        yield _pairs(out)

    return run


def _other_pairs(o: Likeness, most: int | None):
    """Pairs of a crowd that could be linked and are not yet in one component: a part's
    sets and, of the whole crowd, those outside its largest component (``apart``).
    With ``most``, only so many for each set, the likeliest first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: set[tuple[int, int]] = set()
        for rows in _groups(batches, ("meeting", "part"), ("set", "n", "signature", "component", "apart")):
            node, n, sig, part, apart = zip(*rows, strict=True)
            node, n, sig, part, apart = np.array(node), np.array(n), _unpack(sig), np.array(part), np.array(apart)
            for i in np.flatnonzero(apart).tolist():
                lo, hi = np.searchsorted(n, -(-o.percent * n[i] // 100)), np.searchsorted(n, 100 * n[i] // o.percent, "right")
                near = ~apart[lo:hi] & (part[lo:hi] != part[i])
                near[near] = _alike(sig[lo:hi][near], n[lo:hi][near], sig[i], n[i], o.percent)
                found = np.flatnonzero(near) + lo
                if most and len(found) > most:
                    found = found[np.argsort(-np.minimum(sig[found], sig[i]).sum(axis=-1, dtype=np.int64), kind="stable")[:most]]
                for j in found.tolist():
                    a, b = int(node[i]), int(node[j])
                    out.add((max(a, b), min(a, b)))
                if len(out) > 50_000:
                    yield _pairs(out)
                    out = set()
        yield _pairs(out)

    return run


def _verify(pairs: DataFrame, classes: DataFrame, docs: DataFrame, counts: np.ndarray, o: Likeness, parts: int) -> DataFrame:
    """Links between sets, as stars of what they connect.  Candidates are dealt into neighbourhoods: a set is at
    home with its smallest candidate partner, and goes once to each pair of homes in
    which it has partners.  A home of many sets is split."""
    size = 1 << o.sketch

    def asked_for(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, pack = np.zeros(size, np.uint8), zstandard.ZstdCompressor(level=1)
        for b in batches:
            bits[b.column("who").to_numpy() & (size - 1)] = 1
        yield pa.RecordBatch.from_arrays([pa.array(range(o.slices), pa.int32()), pa.array([pack.compress(p.tobytes()) for p in np.split(bits, o.slices)], pa.binary())], ["slice", "counts"])

    def asked_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Packed texts of the rows asked for: far smaller than their n-grams."""
        pack, seen = zstandard.ZstdCompressor(level=1), set()
        for b in batches:
            b = b.filter(pa.array(np.unpackbits(wanted)[b.column("who").to_numpy() & (size - 1)].astype(bool)))
            for part in slices([b], 500):
                texts, who = part.column("text").to_pylist(), part.column("who").to_pylist()
                rows = []
                for t, w, s in zip(texts, who, hashing.shingles(texts, o.words), strict=True):
                    if len(s) and (key := (_set_key(s), w)) not in seen:
                        seen.add(key)  # repeated rows count once in a task
                        rows.append((*key, pack.compress(t.encode("utf-8", "surrogatepass"))))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.binary()), strict=True)], ["node", "who", "packed"])

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Every set that is linked with others of its neighbourhood, with the smallest
        that its links reach there."""
        out, unpack = set(), zstandard.ZstdDecompressor()
        for rows in _groups(batches, ("p", "q"), ("node", "packed")):
            texts = {node: unpack.decompress(t).decode("utf-8", "surrogatepass") for node, t in rows}
            node = list(texts)
            held = [_by_count(s, counts, o.sketch)[::-1] for s in hashing.shingles(list(texts.values()), o.words)]
            least = dict(zip(node, node, strict=True))

            def top(x: int) -> int:
                while least[x] != x:
                    least[x] = x = least[least[x]]  # noqa: B023
                return x

            for i, j in PrefixTree(held).join(held, o.percent):
                a, b = top(node[i]), top(node[j])
                least[max(a, b)] = min(a, b)
            out |= {(x, top(x)) for x in node if top(x) != x}
            if len(out) > 50_000:
                yield _pairs(out)
                out = set()
        yield _pairs(out)

    both = pairs.unionAll(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    host = both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("host"))
    known = stored(host.join(classes.select("set", "first", "n"), F.col("node") == F.col("set")).select("node", "host", "n", F.xxhash64("first").alias("who")), "hosts")
    load = known.groupBy(F.col("host").alias("h")).agg(F.ceil(F.greatest(F.count("*") / o.near, F.sum("n") / o.grams)).alias("rooms"))
    homes = stored(known.join(load, F.col("host") == F.col("h")).select("node", "who", F.xxhash64("host", F.pmod(F.xxhash64("node"), "rooms")).alias("home")), "homes")
    a, b = (homes.select(F.col("node").alias(x), F.col("home").alias(f"home_{x}"), F.col("who").alias(f"who_{x}")) for x in ("a", "b"))
    met = pairs.join(a, "a").join(b, "b").select("a", "b", "who_a", "who_b", F.least("home_a", "home_b").alias("p"), F.greatest("home_a", "home_b").alias("q"))
    members = met.select(F.explode(F.array(F.struct(F.col("a").alias("node"), F.col("who_a").alias("who")), F.struct(F.col("b").alias("node"), F.col("who_b").alias("who")))).alias("x"), "p", "q").select("x.*", "p", "q").distinct()
    bits = _gathered(homes.select("who").mapInArrow(asked_for, "slice int, counts binary"), o, size, "<u1", np.maximum)
    wanted = np.packbits(bits)
    texts = docs.where("doc_id IS NOT NULL AND text IS NOT NULL").select(F.xxhash64("doc_id").alias("who"), "text")
    sets = texts.mapInArrow(asked_texts, "node long, who long, packed binary")
    # Of equal sets that of the smallest doc_id is taken.
    dealt = members.join(sets.hint("shuffle_merge"), ["node", "who"]).repartition(parts, "p", "q").sortWithinPartitions("p", "q", "node")
    return stored(dealt.select("p", "q", "node", "packed").mapInArrow(link, "a long, b long"), "linked")


def similar_components(docs: DataFrame, opts: Likeness | None = None) -> DataFrame:
    """doc_id, n_shingles and component_id, the smallest doc_id that links reach.

    A null or empty text, or one without words, has no shingle and is linked with
    nothing.  Rows with equal sets are linked with each other.  A row without an id
    has no component.  Rows that repeat an id are one document with several sets: all
    of them are linked with each other, and so is what each is linked with.  An empty
    table gives no row; other columns are dropped.
    """
    o, spark = opts or Likeness(), docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    docs = docs.select("doc_id", "text")
    described = describe(docs, o)
    counts = global_counts(described, o)
    rows = described.where("slice IS NULL").select("doc_id", "n", "set", "signature")
    named = rows.where("doc_id IS NOT NULL")
    classes = stored(named.where("set IS NOT NULL").groupBy("set").agg(F.min("doc_id").alias("first"), F.min("signature").alias("signature"), F.first("n").alias("n"), F.count("*").alias("rows")), "classes")
    several = stored(named.groupBy("doc_id").agg(F.min("set").alias("lo"), F.max("set").alias("hi"), F.count("set").alias("sets"), F.count("*").alias("rows")).where("lo <> hi OR sets < rows AND sets > 0").select(F.col("doc_id").alias("id"), "lo"), "repeated")
    same = named.where("set IS NOT NULL").join(several, F.col("doc_id") == F.col("id")).where("set <> lo").select(F.greatest("set", "lo").alias("a"), F.least("set", "lo").alias("b"))

    met = meetings(docs, counts, o).join(classes.select("set", "signature").hint("shuffle_merge"), "set")
    met = stored(met, "meetings")
    in_parts = lambda x: x.repartition(parts, "meeting", "part").sortWithinPartitions("meeting", "part", "n", "set")
    pairs = stored(in_parts(met).mapInArrow(_first_pairs(o), "a long, b long").distinct(), "pairs")
    verify = lambda x: _verify(x, classes, docs, counts, o, parts)
    linked = verify(pairs).unionAll(same)
    known = connected_components(linked)
    crowds = met.where(F.col("members") > o.crowd)
    if not crowds.isEmpty():
        for most in (8, None):  # join components by few pairs, then look at all that are left
            seen = crowds.join(known, F.col("set") == F.col("node"), "left").withColumn("component", F.coalesce("component", "set")).drop("node")
            seen = stored(seen, "crowds")
            largest = seen.groupBy("meeting", "component").count().groupBy("meeting").agg(F.max_by("component", F.struct("count", "component")).alias("largest"), F.count("*").alias("kinds")).where("kinds > 1").select("meeting", "largest")
            marked = seen.join(largest, "meeting").withColumn("apart", F.col("component") != F.col("largest"))
            every_part = marked.groupBy("meeting", "part").agg(F.min("n").alias("from"), F.max("n").alias("to"))
            # Those apart go to every part of the crowd with sizes like theirs.
            asking = marked.where("apart").drop("part").join(every_part, "meeting").where((100 * F.col("to") >= o.percent * F.col("n")) & (o.percent * F.col("from") <= 100 * F.col("n")))
            names = ["meeting", "part", "set", "n", "signature", "component", "apart"]
            met_again = marked.withColumn("apart", F.lit(False)).select(*names).unionAll(asking.select(*names))
            more = stored(in_parts(met_again).mapInArrow(_other_pairs(o, most), "a long, b long").distinct(), "pairs")
            if more.isEmpty():
                break
            known = connected_components(verify(more).unionAll(known.select(F.col("node").alias("a"), F.col("component").alias("b"))))
    # Only classes of several rows or sets need a label; any other row is its own.
    grouped = classes.join(known, F.col("set") == F.col("node"), "left").where("component IS NOT NULL OR rows > 1").select("set", "first", F.coalesce("component", "set").alias("component"))
    grouped = stored(grouped, "grouped")
    least = grouped.groupBy(F.col("component").alias("c")).agg(F.min("first").alias("least"))
    labels = grouped.join(least, F.col("component") == F.col("c")).select(F.col("set").alias("_set"), "least")
    # A row without words takes part by the other sets of its id.
    blank = named.where("set IS NULL").join(several, F.col("doc_id") == F.col("id"), "left").select("doc_id", "n", F.col("lo").alias("set"))
    every = rows.where("doc_id IS NULL OR set IS NOT NULL").select("doc_id", "n", "set").unionAll(blank)
    out = every.join(labels.hint("shuffle_merge"), F.col("set") == F.col("_set"), "left")
    own = F.when(F.col("doc_id").isNotNull(), F.coalesce("least", "doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), own.alias("component_id"))
