"""Fingerprints against a brute-force version."""

import hashlib
from itertools import combinations

import pytest

from inkwell.llm import fingerprints, hashing

from test_operators import prose

O = fingerprints.Syncmers(size=12)


def marks(text, o):
    """hash and place of the sketch's anchors, by definition."""
    b = text.encode()
    one = lambda x: int(hashing.runs(x, len(x))[0])
    if len(b) < o.k:
        found = [(one(b), 0)] if b else []
    else:
        found = []
        for i in range(len(b) - o.k + 1):
            inner = [one(b[j : j + o.s]) for j in range(i, i + o.k - o.s + 1)]
            if min(inner) in (inner[0], inner[-1]):
                found.append((b[i : i + o.k], i))
        whole = dict(zip(*[x.tolist() for x in fingerprints.anchors(text, o)]))
        assert sorted(whole) == [i for _, i in found]
        assert len({k for k, _ in found}) == len({whole[i] for _, i in found})
        found = [(whole[i], i) for _, i in found]
    out, seen = [], {}
    for h, i in found:
        n = seen[h] = seen.get(h, -1) + 1
        out.append((h if not n else int(hashing.mix((hashing.np.array([h], "u8") + hashing.np.uint64(n) * hashing.ODD))[0]), i))
    return sorted(out)[: o.size]


def alike(x, y, size):
    if not x or not y:
        return float(not x and not y)
    both = sorted({h for h, _ in x} | {h for h, _ in y})[:size]
    shared = [(dict(x)[h], dict(y)[h]) for h in both if h in dict(x) and h in dict(y)]
    best = max((len(c) for n in range(len(shared) + 1) for c in combinations(sorted(shared), n) if all(p[0] < q[0] and p[1] < q[1] for p, q in zip(c, c[1:]))), default=0)
    return best / len(both)


def text_of(hexed):
    raw = bytes.fromhex(hexed)
    return [(int.from_bytes(raw[i : i + 8], "big"), int.from_bytes(raw[i + 8 : i + 12], "big")) for i in range(0, len(raw), 12)]


@pytest.fixture(scope="module")
def rows():
    a, b = prose(1, 40), prose(2, 50)
    texts = [a, a, b, f"{b} {a}", None, "", "short", "aaaa" * 40, "aaaa" * 30 + "b" * 30, "é" * 50, prose(3, 12) * 4, a[::-1]]
    return [*enumerate(texts), (3, "again"), (None, b)]


@pytest.mark.parametrize("opts", [O, fingerprints.Syncmers(k=11, s=4, size=10), fingerprints.Syncmers(size=9, segment=50)])
def test_brute_force(spark, rows, opts):
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, fingerprint string, part int").repartition(3)
    ordered = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    want = []
    for k, (i, t) in enumerate(ordered):
        t, nxt = t or "", ordered[(k + 1) % len(ordered)][1] or ""
        n = len(t) // 4
        edited = t[: len(t) - n] + nxt[:n]
        own, changed, its = marks(t, opts), marks(edited, opts), marks(nxt, opts)
        want.append((i, len(t), hashlib.sha256(edited.encode()).hexdigest(), own, changed, alike(own, changed, opts.size), alike(own, its, opts.size)))
    got = [(r.doc_id, r.n_chars, r.edited_sha256, text_of(r.fingerprint), text_of(r.edited_fingerprint), r.near_edited, r.near_next) for r in fingerprints.compare_with_edits(df, opts).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_edits_stay_near():
    o = fingerprints.Syncmers()
    for text in (prose(7, 400), "aaaa" * 200, "one line again\n" * 90):
        edited = text[: len(text) * 3 // 4] + prose(8, 300)[: len(text) // 4]
        own = fingerprints.sketch(text, o)
        assert fingerprints.likeness(own, fingerprints.sketch(edited, o), o.size) > 0.3
        assert fingerprints.likeness(own, fingerprints.sketch(prose(9, 400), o), o.size) < 0.1
    half = prose(1, 300), prose(2, 300)
    swapped = fingerprints.likeness(fingerprints.sketch(" ".join(half), o), fingerprints.sketch(" ".join(half[::-1]), o), o.size)
    assert 0.3 < swapped < 0.75  # all anchors are there, half of them in order
