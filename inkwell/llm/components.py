"""Connected components of an edge table, by rounds of stars."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from .shared import stored


def connected_components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """node and component (its smallest node) for every node of an edge (a, b).

    In each round every node hands its smallest neighbour (or itself) to all its
    neighbours and takes it for its own; edges become stars around smallest nodes, in a
    number of rounds that grows with the logarithm of a component's width.  Every round
    is written to the shared folder.  An empty table gives no row.
    """
    now, state, before = *_watched(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()), None
    for _ in range(most_rounds):
        if before == state:
            break
        before = state
        both = now.unionAll(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy(F.col("u").alias("n")).agg(F.least(F.min("v"), F.first("u")).alias("m"))
        met = both.join(least, F.col("u") == F.col("n"))
        now, state = _watched(met.select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v")).where("u <> v").distinct())
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionAll(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def _watched(links: DataFrame) -> tuple[DataFrame, dict]:
    """The links, stored, and what tells whether they have changed, seen as they are written."""
    seen = Observation()
    told = links.observe(seen, F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h"))
    return stored(told, "links"), seen.get
