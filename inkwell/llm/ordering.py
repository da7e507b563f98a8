"""Rows in ascending doc_id order, dealt into ranges without one global task."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass(frozen=True)
class Ranges:
    """Ascending, about equally full ranges of a key: ``number`` is a row's range
    from 0, ``count`` how many there are.  A null key is in range 0."""

    number: Column
    count: int


def ranges_of(docs: DataFrame, key: str = "doc_id") -> Ranges:
    """Ranges between quantiles of ``key``, as many as shuffle partitions.  Only
    the quantiles come to the driver; of a key that is no number, 100 rows a range,
    drawn at random, from which they are taken."""
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = None
    if n > 1 and isinstance(docs.schema[key].dataType, T.NumericType):
        found = docs.agg(F.percentile_approx(key, [i / n for i in range(1, n)], 20 * n).alias("q")).first()["q"]
    elif n > 1:
        drawn = sorted((r[0] for r in docs.where(F.col(key).isNotNull()).orderBy(F.rand(1)).limit(100 * n).select(key).collect()), key=_as_spark_sorts)
        found = [drawn[len(drawn) * i // n] for i in range(1, n)] if drawn else None
    edges = sorted(set(found or []), key=_as_spark_sorts)
    edge, number = F.array(*map(F.lit, edges)), F.lit(0)
    for bit in reversed(range(len(edges).bit_length())):  # a binary search for the edges below the key
        number = _bound(number, edge, 1 << bit, F.col(key))
    return Ranges(F.coalesce(number, F.lit(0)), len(edges) + 1)


def _as_spark_sorts(key):
    return key.encode("utf-8", "surrogatepass") if isinstance(key, str) else key


def _bound(number: Column, edge: Column, step: int, key: Column) -> Column:
    return F.transform(F.array(number), lambda a: F.when(F.get(edge, a + (step - 1)) < key, a + step).otherwise(a))[0]


def in_order(docs: DataFrame, ranges: Ranges, *then: str) -> DataFrame:
    """Rows of one range in one partition, sorted by its number and ``then``."""
    return docs.repartitionById(ranges.count, F.col("part")).sortWithinPartitions("part", *then)
