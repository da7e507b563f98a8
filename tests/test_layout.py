"""Boxes of dense pages against plain comparisons of all pairs."""

import time

import numpy as np
import pytest

from inkwell.operators import layout
from inkwell.plans import queries as Q


def plainly(boxes, gap):
    hulls = [list(b) for b in boxes]
    while True:
        pair = next(((i, j) for i in range(len(hulls)) for j in range(i) if max(hulls[i][0] - hulls[j][2], hulls[j][0] - hulls[i][2]) <= gap and max(hulls[i][1] - hulls[j][3], hulls[j][1] - hulls[i][3]) <= gap), None)
        if pair is None:
            return sorted(hulls, key=lambda b: (b[1], b[0]))
        a, b = hulls.pop(pair[0]), hulls.pop(pair[1])
        hulls.append([min(a[0], b[0]), min(a[1], b[1]), max(a[2], b[2]), max(a[3], b[3])])


@pytest.mark.parametrize("seed", range(30))
def test_hulls_of_random_boxes(seed):
    rng = np.random.default_rng(seed)
    n, spread = int(rng.integers(0, 40)), float(rng.choice([200, 800, 3000]))
    at, size = rng.uniform(-100, spread, (n, 2)), rng.choice([0, 5, 40, 400], (n, 2)) * rng.uniform(0.5, 1, (n, 2))
    boxes = np.hstack([at, at + size]).tolist()
    assert layout.united(boxes, 30) == plainly(boxes, 30)
    assert layout.united([[0, 0, 10, 10], [35, 35, 45, 45], [0, 70, 2, 80]], 30) == [[0, 0, 45, 80]]


@pytest.mark.parametrize("spread, least", [(200_000, 5000), (2000, 1)])
def test_ten_thousand_boxes_on_a_page(spread, least):
    rng = np.random.default_rng(1)
    at = rng.uniform(0, spread, (10_000, 2))
    start = time.perf_counter()
    hulls = layout.united(np.hstack([at, at + rng.uniform(1, 50, (10_000, 2))]).tolist(), 30)
    assert time.perf_counter() - start < 10 and len(hulls) >= least


def test_padding_of_dense_pages(spark):
    rng = np.random.default_rng(2)
    box = lambda n, size: [(int(p), 1, i, *map(float, (x, y, x + w, y + h))) for i, (p, x, y, w, h) in enumerate(zip(rng.integers(0, 3, n), rng.integers(0, 900, n), rng.integers(-50, 1500, n), rng.integers(1, size, n), rng.integers(1, size, n)))]
    boxes, obstacles = box(60, 300), box(300, 60)
    schema = "doc_id int, page_no int, box_no int, x0 double, y0 double, x1 double, y1 double"
    got = {(r.doc_id, r.box_no): (r.x0, r.y0, r.x1, r.y1) for r in layout.capped_padding(spark.createDataFrame(boxes, schema), spark.createDataFrame(obstacles, schema)).collect()}
    for d, _, n, x0, y0, x1, y1 in boxes:
        own = [o[3:] for o in obstacles if o[0] == d]
        along, across = [o for o in own if o[3] > y0 and o[1] < y1], [o for o in own if o[2] > x0 and o[0] < x1]
        want = (max([x0 - 30, *(o[2] for o in along if o[2] <= x0)]), max([y0 - 30, *(o[3] for o in across if o[3] <= y0)]), min([x1 + 30, *(o[0] for o in along if o[0] >= x1)]), min([y1 + 30, *(o[1] for o in across if o[1] >= y1)]))
        assert got[d, n] == want


def test_fallback_summaries_are_numbered_before_the_join(spark):
    told = spark.createDataFrame([(1, 1, 1, "a"), (1, 1, 2, "b"), (1, 1, 4, "c"), (2, 1, 2, "d"), (3, 1, 1, "e")], "doc_id int, page_no int, idx int, summary string")
    pages = spark.createDataFrame([(1, 1), (2, 1)], "doc_id int, page_no int")
    found = layout.fallback_summaries(pages, told)
    assert sorted((r.doc_id, r.idx, r.text) for r in found.collect()) == [(1, 1, "[Image: a]"), (1, 2, "[Image: b]")]
    made = found._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in made and made.index("SortMergeJoin") < made.index("Window")


def test_a_large_table_is_dealt_over_more_tasks(spark, monkeypatch):
    data = "/root/testdata/sf0.001"
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    few = Q.reading_order(spark, data)
    assert "Broadcast" not in plan(few)
    monkeypatch.setattr(Q, "TASK_ROWS", 500)
    n = -(-Q.read(spark, data, "lineitem").count() // 500)
    many = Q.reading_order(spark, data)
    # The lines are dealt once, pages and edges go to their tasks, and none of them whole to all.
    made = plan(many)
    assert n > 4 and made.count(f", {n}), REPARTITION_BY_NUM") == 1 and made.count(f", {n}), ENSURE_REQUIREMENTS") == 2
    assert "Broadcast" not in made
    assert sorted(many.collect()) == sorted(few.collect())
