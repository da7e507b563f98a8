"""Repeated rows, clashing columns and hot runs of the substring operator."""

import pytest

from inkwell.llm import substrings

from test_operators import prose


def brute(rows, length=50):
    first = {}
    for i, t in rows:
        b = t.encode()
        for k in range(len(b) - length + 1):
            first[b[k : k + length]] = min(i, first.get(b[k : k + length], i))
    out = []
    for i, t in rows:
        b = t.encode()
        gone = bytearray(len(b))
        for k in range(len(b) - length + 1):
            if first[b[k : k + length]] < i:
                gone[k : k + length] = b"\1" * length
        out.append((i, bytes(x for x, g in zip(b, gone) if not g)))
    return out


def test_rows_that_repeat_an_id_keep_their_own_texts(spark):
    a, b, shared = prose(1, 30), prose(2, 40), prose(3, 40)
    size = len(a) + len(b)
    one, two = f"{a}. {shared} {b}"[: size], (f"{b}, " + prose(4, 60))[: size]
    rows = [(1, shared), (2, one), (2, two), (2, two), (3, f"{b} {a}")]
    assert len(one) == len(two)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    got = sorted((r.doc_id, bytes(r.kept)) for r in substrings.remove_repeats(df).collect())
    assert got == sorted(brute(rows))
    texts = sorted((r.doc_id, r.text.encode()) for r in substrings.without_repeats(df).collect())
    assert texts == sorted(brute(rows))


def test_clashing_columns(spark):
    names = ["_id", "_n", "_kept", "own", "row", "spans", "doc", "r", "start", "runs", "anchor"]
    text = prose(5, 60)
    rows = [(i, t, 7, *(f"{n}{i}" for n in names)) for i, t in ((1, text), (2, "x " + text + " y"), (3, None), (4, ""), (None, text))]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_chars int, " + ", ".join(f"{n} string" for n in names))
    got = {r.doc_id: r for r in substrings.without_repeats(df).collect()}
    assert substrings.without_repeats(df).columns == df.columns
    assert all(got[i][n] == f"{n}{i}" for i in (1, 2, 3, 4) for n in names)
    assert got[2].text == "x  y" [:len(got[2].text)] and got[2].n_chars == len(got[2].text) and got[1].text == got[None].text == text
    assert got[3].text is None and got[4].text == ""


@pytest.mark.parametrize("opts", [substrings.Matching(hot=2, block=200), substrings.Matching(block=300, flush=30, slices=2), substrings.Matching(segment=70)])
def test_one_run_in_many_documents(spark, opts):
    hot = prose(9, 12)
    rows = [(i, f"{prose(100 + i, 8)} {hot} {prose(200 + i, 8)}") for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert sorted((r.doc_id, bytes(r.kept)) for r in substrings.remove_repeats(df, opts).collect()) == sorted(brute(rows))


def test_blocks_end_between_anchors(spark):
    # Many anchors of a few short stretches fill a block amid the stretches of one of them.
    passages = [prose(300 + i, 14) for i in range(40)]
    rows = [(40 * k + i, p[(k * 5) % 9 :][: 50 + k % 3]) for i, p in enumerate(passages) for k in range(12)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = substrings.remove_repeats(df, substrings.Matching(hot=12, block=800)).collect()
    assert sorted((r.doc_id, bytes(r.kept)) for r in got) == sorted(brute(rows))


def test_boundaries_of_whole_blocks():
    import numpy as np

    rng = np.random.default_rng(1)
    for kinds, length in ((2, 50), (3, 5), (30, 12), (250, 50)):
        part = rng.integers(0, kinds, 800).astype(np.uint8)
        text = np.concatenate((part, [255], part[100:], [255], np.zeros(200, np.uint8), [255])).astype(np.uint8)
        at, found = substrings.find_boundaries(text, length)
        heads = [bytes(text[i : i + length]) for i in at]
        assert heads == sorted(heads) and sorted(at.tolist()) == list(range(len(text)))
        assert all(f == (a != b) for a, b, f in zip(heads, heads[1:], found[1:]) if len(b) == length and b"\xff" not in b)
