"""Line dedup against a brute-force template tree."""

import re

import pytest
from pyspark.sql import functions as F

from inkwell.llm import templates

from test_operators import prose


def alike(shapes, agree):
    """Greedy templates over shapes in their fixed order: a list of lists."""
    groups = []
    for shape in shapes:
        row = shape.split(" ")
        best = None
        for fixed, members in groups:
            same = sum(f is None or r == "<*>" or f == r for f, r in zip(fixed, row))
            if any(f is not None for f in fixed) and (best is None or same > best[0]):
                best = (same, fixed, members)
        if best and 100 * best[0] >= agree * len(row):
            new = [f if f == r else None for f, r in zip(best[1], row)]
            if any(f is not None for f in new):
                best[1][:] = new
            best[2].append(shape)
        else:
            groups.append(([None if r == "<*>" else r for r in row], [shape]))
    return [members for _, members in groups]


def brute(rows, o):
    """doc_id, text: the text without recurring lines."""
    mask = lambda ts: ["<*>" if re.search(r"\d", t) else t for t in ts]
    shape = lambda ts: " ".join(ts if len(ts) < o.whole_under else mask(ts))
    path = lambda ts: (len(ts), *(ts if len(ts) < o.whole_under else mask(ts[: o.depth])))
    leaves = {}
    for i, text in rows:
        for line in (text or "").split("\n") if i is not None else ():
            if len(ts := line.split()) >= max(1, o.least_tokens):
                leaves.setdefault(path(ts), {}).setdefault(shape(ts), set()).add(text)
    first = {}
    for p, shapes in leaves.items():
        if len(set.union(*shapes.values())) < o.least_texts:
            continue
        for members in alike(sorted(shapes, key=lambda s: (-len(shapes[s]), s)), o.agree):
            texts = set.union(*(shapes[m] for m in members))
            if len(texts) >= o.least_texts:
                keeper = min((i, t) for i, t in rows if i is not None and t in texts)
                first |= {(p, m): keeper for m in members}
    out = []
    for i, text in rows:
        kept = []
        for line in (text or "").split("\n"):
            ts = line.split()
            keeper = first.get((path(ts), shape(ts))) if i is not None and ts else None
            later = keeper and (text != keeper[1] if o.copies_keep else i > keeper[0])
            if not later:
                kept.append(line)
        out.append((i, None if text is None else "\n".join(kept)))
    return out


@pytest.fixture(scope="module")
def rows():
    tag = lambda i: chr(97 + i % 26) * 3
    texts = [f"{prose(i, 8)}\nOrder {i} was shipped to {tag(i % 3)} on day {i * 7}\nAll rights reserved.\nby {tag(i)} and {tag(i + 1)} in the old town of Ulm" for i in range(14)]
    out = [(i, t) for i, t in enumerate(texts)]
    # One text with many variants of a line is one text, however many variants there are.
    out += [(50 + k, "\n".join(f"see the short note about {w} here" for w in ("alpha", "beta", "gamma", tag(k)))) for k in range(3)]
    return [*out, (30, texts[0]), (31, texts[5]), (60, ""), (61, None), (62, "\n \n"), (None, texts[2]), (63, "版权所有"), (64, "x\n版权所有"), (65, "版权所有\ny"), (66, "z\n版权所有")]


@pytest.mark.parametrize("tree", [templates.Tree(), templates.EVERY_LINE, templates.FEW_TEXTS, templates.Tree(least_texts=4, agree=50, depth=2)])
def test_brute_force(spark, rows, tree):
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = [(r.doc_id, r.text) for r in templates.drop_templates(df, tree).collect()]
    assert sorted(got, key=repr) == sorted(brute(rows, tree), key=repr)


def test_texts_count_once(spark, rows):
    few = [r for r in rows if r[0] and 50 <= r[0] < 53]
    df = spark.createDataFrame(few, "doc_id long, text string")
    assert templates.drop_templates(df, templates.Tree(least_texts=4)).agg(F.sum("n_dropped")).first()[0] == 0
    assert templates.drop_templates(df, templates.Tree(least_texts=3)).agg(F.sum("n_dropped")).first()[0] == 8


def test_clashing_columns(spark, rows):
    names = ["i", "h", "id", "hash", "row", "drop", "salt", "leaf", "shape", "template", "first", "number", "asked", "n_lines"]
    df = spark.createDataFrame([(*r, *(f"{n} of {r[0]}" for n in names)) for r in rows], ", ".join(f"{n} string" if n != "doc_id" else "doc_id long" for n in ["doc_id", "text", *names]))
    got = templates.drop_templates(df, templates.EVERY_LINE)
    assert got.columns == [*df.columns, "n_dropped"]
    assert all(r[n] == f"{n} of {r.doc_id}" for r in got.collect() for n in names[:-1])


def test_string_ids(spark, rows):
    df = spark.createDataFrame([(f"d{i:03d}", t) for i, t in rows if i is not None], "doc_id string, text string")
    assert templates.drop_templates(df, templates.EVERY_LINE).agg(F.sum("n_dropped")).first()[0] > 0
