"""Hard negatives by blocked dense matrix products.

Anchors are broadcast in blocks of a bounded size; every candidate partition streams its
rows against a block, a few thousand at a time, as one product in float64.  Components
are whole numbers, so products are exact below 2**53.  The first pass keeps each anchor's
best positives, the second, with their scores as windows, its best negatives.  What a
task keeps is a few rows an anchor; those of all tasks are merged by a window.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .shared import shared_dir, slices, stored


@dataclass(frozen=True)
class Mining:
    """``scale``: components become floor(scale * x).  ``positives`` of an anchor and
    ``negatives`` of each positive are kept; a negative's score is at least ``percent``
    of the positive's, and at most as high.  ``block_bytes`` bounds the anchors that are
    broadcast at once, ``rows`` and ``tile`` the candidates and anchors of one product."""

    scale: int = 256
    positives: int = 5
    negatives: int = 5
    percent: int = 80
    block_bytes: int = 32 << 20
    rows: int = 4096
    tile: int = 512


NONE = np.iinfo(np.int64).min  # no score: below all others
EXACT = float(1 << 53)
FITS = float(1 << 63)


@dataclass
class Block:
    """Rows of vectors, by ascending id."""

    ids: np.ndarray
    labels: np.ndarray
    matrix: np.ndarray
    norms: np.ndarray

    @classmethod
    def of(cls, batch: pa.RecordBatch, scale: int) -> Block:
        ids, labels = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("vec_id", "label"))
        lists = batch.column("embedding")
        values = np.floor(lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64) * scale)
        sizes = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        matrix = np.zeros((len(ids), int(sizes.max(initial=0))))
        matrix[np.arange(matrix.shape[1]) < sizes[:, None]] = values  # shorter vectors end in zeros
        order = np.argsort(ids, kind="stable")
        with np.errstate(over="ignore"):  # a norm beyond all numbers is one that is too long
            return cls(ids[order], labels[order], matrix[order], np.sqrt(np.square(matrix[order]).sum(axis=1)) * (1 + 1e-9))

    def part(self, at: slice) -> Block:
        return Block(self.ids[at], self.labels[at], self.matrix[at], self.norms[at])


def products(a: Block, b: Block) -> np.ndarray:
    """All inner products as 64-bit numbers.  Where lengths allow 2**53 or more, they are
    worked out in whole numbers; one that does not fit into 64 bits is an error."""
    dims = min(a.matrix.shape[1], b.matrix.shape[1])
    x, y = a.matrix[:, :dims], b.matrix[:, :dims]
    long_rows, long_columns = a.norms * b.norms.max(initial=0) >= EXACT, b.norms * a.norms.max(initial=0) >= EXACT
    if not long_rows.any():
        return (x @ y.T).astype(np.int64)
    with np.errstate(all="ignore"):
        out = np.nan_to_num(x @ y.T, nan=0, posinf=0, neginf=0)
        out = np.where(np.abs(out) < FITS, out, 0).astype(np.int64)
    whole = lambda m: np.array([[int(v) for v in r] for r in m], dtype=object).reshape(m.shape)
    if long_rows.sum() * len(y) <= long_columns.sum() * len(x):
        out[long_rows] = _fitting(whole(x[long_rows]), whole(y).T)
    else:
        out[:, long_columns] = _fitting(whole(x), whole(y[long_columns]).T)
    return out


def _fitting(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    exact = np.zeros((x.shape[0], y.shape[1]), dtype=object) if not x.shape[1] else x @ y
    if exact.size and (exact.max() >= 1 << 63 or exact.min() <= NONE):
        raise OverflowError("a score does not fit into 64 bits")
    return exact.astype(np.int64)


class Best:
    """The k best (score, id) of each of n lists; higher scores first, then smaller ids."""

    def __init__(self, n: int, k: int):
        self.k, self.scores, self.ids = k, np.full((n, k), NONE), np.zeros((n, k), np.int64)

    def add(self, at: int, ids: np.ndarray, scores: np.ndarray, fit: np.ndarray) -> None:
        """Offer ``scores`` of ``ids`` (ascending), where they ``fit``, to the lists from ``at`` on."""
        fit &= scores >= self.scores[at : at + len(scores), -1:]
        rows = np.flatnonzero(fit.any(axis=1))
        if not len(rows):
            return
        s, n = np.where(fit[rows], scores[rows], NONE), scores.shape[1]
        if n <= self.k:
            first = np.broadcast_to(np.arange(n), s.shape)
        elif np.abs(scores[rows]).max() < (1 << 62) // n:  # score and place in one number
            keys = np.where(fit[rows], s * n + np.arange(n - 1, -1, -1), NONE) if n else s
            first = np.argpartition(keys, n - self.k, axis=1)[:, n - self.k :]
        else:
            first = np.argsort(~s, axis=1, kind="stable")[:, : self.k]
        both = np.concatenate([self.scores[at + rows], np.take_along_axis(s, first, 1)], axis=1)
        whose = np.concatenate([self.ids[at + rows], ids[first]], axis=1)
        order = np.lexsort((whose, ~both), axis=-1)[:, : self.k]
        self.scores[at + rows], self.ids[at + rows] = np.take_along_axis(both, order, 1), np.take_along_axis(whose, order, 1)


def least_score(score: np.ndarray, percent: int) -> np.ndarray:
    """The smallest whole number s with 100 * s >= percent * score, without overflow."""
    whole, rest = np.divmod(score, 100)
    return percent * whole - (-percent * rest) // 100


def _positives(anchors: Block, m: Mining) -> Callable[[Iterator[Block]], Iterator[list]]:
    def run(blocks: Iterator[Block]) -> Iterator[list]:
        best = Best(len(anchors.ids), m.positives)
        for b in blocks:
            for at in range(0, len(anchors.ids), m.tile):
                a = anchors.part(slice(at, at + m.tile))
                best.add(at, b.ids, products(a, b), (a.labels[:, None] == b.labels) & (a.ids[:, None] != b.ids))
        i, k = np.nonzero(best.scores != NONE)
        yield [anchors.ids[i], best.ids[i, k], best.scores[i, k]]

    return run


def _negatives(anchors: Block, found: np.ndarray, m: Mining) -> Callable[[Iterator[Block]], Iterator[list]]:
    """``found``: of each anchor its positives' (id, score), in any order; NONE where fewer."""

    def run(blocks: Iterator[Block]) -> Iterator[list]:
        best = [Best(len(anchors.ids), m.negatives) for _ in range(m.positives)]
        high = found[:, :, 1]
        low = np.where(high == NONE, np.iinfo(np.int64).max, least_score(np.where(high == NONE, 0, high), m.percent))
        for b in blocks:
            for at in range(0, len(anchors.ids), m.tile):
                a = anchors.part(slice(at, at + m.tile))
                scores, differs = products(a, b), a.labels[:, None] != b.labels
                for k, own in enumerate(best):
                    inside = slice(at, at + m.tile)
                    own.add(at, b.ids, scores, differs & (scores >= low[inside, k, None]) & (scores <= high[inside, k, None]))
        for k, own in enumerate(best):
            i, j = np.nonzero(own.scores != NONE)
            yield [anchors.ids[i], found[i, k, 0], found[i, k, 1], own.ids[i, j], own.scores[i, j]]

    return run


def _against(candidates: DataFrame, task: Callable, schema: str, m: Mining) -> DataFrame:
    fields = to_arrow_schema(T._parse_datatype_string(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for columns in task()(Block.of(b, m.scale) for b in slices(batches, m.rows)):
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], schema=fields)

    return candidates.mapInArrow(run, schema)


POSITIVES = "anchor_id long, positive_id long, positive_score long"
NEGATIVES = f"{POSITIVES}, negative_id long, negative_score long"
MINED = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def participants(vectors: DataFrame) -> DataFrame:
    """vec_id, label, embedding of the rows that take part, one for each vec_id."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.where("vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL").where(finite)
    rows = rows.select(F.col("vec_id").cast("long"), F.struct(F.col("label").cast("long").alias("label"), "embedding").alias("own"))
    return rows.groupBy("vec_id").agg(F.min("own").alias("own")).select("vec_id", "own.label", "own.embedding")


def mine_negatives(vectors: DataFrame, is_anchor: Column, mining: Mining | None = None) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score: the first
    negatives of each anchor and each of its first positives, by inner product.

    ``vectors``: vec_id, label (whole numbers) and embedding (an array of numbers); other
    columns are not read.  ``is_anchor`` is a condition on vec_id and label.  Rows with a
    null id, label or vector or a component that is null or not finite take no part.  Of
    rows that repeat a vec_id one takes part, the smallest by label, then vector.  Vectors
    of unequal lengths are compared as if the shorter one ended in zeros.  Equal scores are
    ordered by vec_id.  No anchor, no positive or no negative gives no row.
    """
    m, spark = mining or Mining(), vectors.sparkSession
    rows = stored(participants(vectors), "vectors")
    anchors = rows.where(is_anchor)
    size = anchors.agg(F.count("*").alias("n"), F.coalesce(F.max(F.size("embedding")), F.lit(0)).alias("dims")).first()
    if not size.n:
        return spark.createDataFrame([], MINED)
    # Ids are unique, so a hash deals them evenly; half of the bound is aimed at.
    rounds = math.ceil(size.n * (8 * size.dims + 64) / (m.block_bytes / 2))
    dealt = stored(anchors.withColumn("round", F.pmod(F.xxhash64("vec_id"), F.lit(rounds)).cast("int")), "anchors")

    def each_round(task: Callable, schema: str, purpose: str) -> DataFrame:
        paths = []
        for r in range(rounds):
            block = _fetched(dealt.where(F.col("round") == r).drop("round"), m)
            if len(block.ids):
                sent = spark.sparkContext.broadcast(task(r, block))
                paths.append(shared_dir(spark, purpose))
                _against(rows, lambda sent=sent: sent.value(), schema, m).write.parquet(paths[-1])
                sent.destroy()
        return spark.read.schema(schema).parquet(*paths)

    def first(found: DataFrame, k: int, score: str, then: str, *of: str) -> DataFrame:
        by = Window.partitionBy(*of).orderBy(F.desc(score), then)
        return found.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k)

    near = first(each_round(lambda r, block: Task(block, None, m), POSITIVES, "positives"), m.positives, "positive_score", "positive_id", "anchor_id")
    near = stored(near.withColumn("round", F.pmod(F.xxhash64("anchor_id"), F.lit(rounds)).cast("int")), "positives")

    def windows(r: int, block: Block) -> Task:
        own = near.where(F.col("round") == r).select("anchor_id", "rank", "positive_id", "positive_score").toArrow()
        found = np.full((len(block.ids), m.positives, 2), NONE)
        anchor, rank, *pair = (own.column(c).to_numpy() for c in own.column_names)
        found[np.searchsorted(block.ids, anchor), rank - 1] = np.stack(pair, axis=1) if len(rank) else np.zeros((0, 2), np.int64)
        return Task(block, found, m)

    far = first(each_round(windows, NEGATIVES, "negatives"), m.negatives, "negative_score", "negative_id", "anchor_id", "positive_id")
    return far.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


@dataclass
class Task:
    """What is broadcast for a round: a block of anchors and, in the second pass, their
    positives."""

    anchors: Block
    found: np.ndarray | None
    mining: Mining

    def __call__(self) -> Callable[[Iterator[Block]], Iterator[list]]:
        return _positives(self.anchors, self.mining) if self.found is None else _negatives(self.anchors, self.found, self.mining)


def _fetched(anchors: DataFrame, m: Mining) -> Block:
    """The anchors of one round, after a check of their size."""
    got = anchors.toArrow().combine_chunks()
    if got.nbytes > m.block_bytes:
        raise ValueError(f"a block of anchors has {got.nbytes} bytes, more than block_bytes={m.block_bytes}")
    batches = got.to_batches()
    return Block.of(batches[0] if batches else pa.RecordBatch.from_pylist([], schema=got.schema), m.scale)


def relabelled(vectors: DataFrame, every: int = 7, labels: int = 10) -> DataFrame:
    """``vectors`` where the label of every such vec_id has become the next one."""
    return vectors.withColumn("label", F.when(F.col("vec_id") % every == 0, (F.col("label") + 1) % labels).otherwise(F.col("label")))


def oracle() -> str:
    """The registered query's rows in DuckDB SQL over the view ``embeddings``."""
    return """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND vec_id IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, CAST(coalesce(list_sum(list_transform(list_zip(a.e, b.e), lambda z: z[1] * z[2])), 0) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT anchor_id, positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND 80 * positive_score <= 100 * score AND score <= positive_score
WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) QUALIFY row_number() OVER w <= 5"""
