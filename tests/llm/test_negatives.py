"""Hard negatives: brute force, ties, long numbers and edge cases."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from inkwell.llm import negatives, queries
from inkwell.llm.negatives import Best, Block, Mining

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, every, m):
    own = {}
    for i, e, label in rows:
        if i is not None and label is not None and e is not None and all(x is not None and math.isfinite(x) for x in e):
            e = [float(np.float32(x)) for x in e]
            own[i] = min(own.get(i, (label, e)), (label, e))
    own = {i: (label, [math.floor(m.scale * x) for x in e]) for i, (label, e) in own.items()}
    score = lambda i, j: sum(x * y for x, y in zip(own[i][1], own[j][1]))
    out = set()
    for a in own:
        if a % every:
            continue
        all_ = sorted((-score(a, j), j) for j in own if j != a)
        for ps, p in [(-s, j) for s, j in all_ if own[j][0] == own[a][0]][: m.positives]:
            fit = [(-s, j) for s, j in all_ if own[j][0] != own[a][0] and m.percent * ps <= -100 * s <= 100 * ps]
            out |= {(a, p, k + 1, j, ps, s) for k, (s, j) in enumerate(fit[: m.negatives])}
    return out


def vectors(n, dims, seed, kinds=4, spread=3):
    rng = np.random.default_rng(seed)
    return [(int(i), [float(x) for x in rng.integers(-spread, spread + 1, dims) / 8], int(rng.integers(kinds))) for i in rng.permutation(n)]


@pytest.mark.parametrize("m", [Mining(), Mining(rows=7, tile=3, block_bytes=2048), Mining(positives=2, negatives=9, percent=50, rows=5)])
def test_brute_force_with_ties(spark, m):
    rows = vectors(160, 3, 1) + [(1000, None, 1), (1005, [1.0, None, 0.5], 1), (1010, [float("nan"), 1.0, 1.0], 2), (1020, [float("inf")], 0), (1030, [0.5, 0.5, 0.5], None), (None, [1.0, 1.0, 1.0], 1)]
    rows += [(1040, [], 1), (1050, [1.0], 1), (1051, [0.5] * 5, 2), (1060, [0.5] * 5, 2), rows[0], (rows[1][0], [0.25, 0.5, 1.0], 3)]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], f"{SCHEMA}, score int, rank int").repartition(4)
    got = list(map(tuple, negatives.mine_negatives(df, F.col("vec_id") % 5 == 0, m).collect()))
    assert len(got) == len(set(got)) and set(got) == brute(rows, 5, m)


def test_hot_vector_and_long_numbers(spark):
    m = Mining(rows=16)
    rows = [(i, [0.5, 0.25], i % 3) for i in range(90)] + [(100 + i, [2.0**18 + i, 2.0**17], i % 2) for i in range(40)] + [(200 + i, [2.0**22 - i, 3.0], i % 2) for i in range(20)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    assert set(map(tuple, negatives.mine_negatives(df, F.col("vec_id") % 10 == 0, m).collect())) == brute(rows, 10, m)


def test_a_score_beyond_64_bits_is_an_error():
    import pyarrow as pa

    block = Block.of(pa.record_batch({"vec_id": [1, 2], "label": [1, 1], "embedding": [[3e38, 1.0], [1.0, 2.0]]}), 256)
    with pytest.raises(OverflowError):
        negatives.products(block, block)


def test_empty_tables(spark):
    for rows in ([], [(1, [1.0], 1)], [(100, [1.0], 1)], [(100, [1.0], 1), (101, [1.0], 2)]):
        assert not negatives.mine_negatives(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") % 100 == 0).collect()


def test_best_lists_merge_in_any_order():
    rng = np.random.default_rng(3)
    scores, ids = rng.integers(-3, 4, (5, 60)), np.arange(60)
    scores[0] = [(1 << 61) + int(x) for x in scores[0]]
    best = Best(5, 4)
    for part in np.array_split(rng.permutation(60), 9):
        part = np.sort(part)
        best.add(0, ids[part], scores[:, part], np.ones((5, len(part)), bool))
    for i in range(5):
        want = sorted((-int(s), int(j)) for s, j in zip(scores[i], ids))[:4]
        assert [(-int(s), int(j)) for s, j in zip(best.scores[i], best.ids[i])] == want


@pytest.mark.parametrize("percent", [0, 1, 50, 80, 99, 100])
def test_least_score(percent):
    s = np.concatenate([np.arange(-500, 500), [(1 << 62) + 7]])
    assert negatives.least_score(s, percent).tolist() == [-((-percent * int(x)) // 100) for x in s]


def test_query_equals_sql(spark, tmp_path):
    import duckdb

    rows = vectors(420, 6, 5, kinds=10) + [(700, None, 1), (707, [1.0] * 6, None), (800, [float("nan")] * 6, 3)]
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{tmp_path}/embeddings.parquet")
    with duckdb.connect() as c:
        c.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
        want = c.execute(negatives.oracle()).fetchall()
    got = queries.op11_hard_negatives(spark, str(tmp_path))
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert sorted(map(tuple, got.collect())) == sorted(want) and len(want) > 20
