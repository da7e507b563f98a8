"""Word and shingle hashes against plain sets of words."""

import numpy as np
import pytest

from inkwell.llm import hashing

from test_operators import prose


@pytest.mark.parametrize("most", [7, 64, 1 << 19])
def test_words_in_pieces(most):
    for text in ("", " ", "a", " a  bc\td ", "x" * 300, "x" * 300 + " y " + "z" * 200, prose(1, 200), "\x1c a\x85b"):
        data = text.encode()
        got, start = hashing.words(data, most)
        want = [(h[0], s) for w, s in found(data) for h in [hashing.words(w)[0]]]
        assert list(zip(got.tolist(), start.tolist())) == [(int(h), s) for h, s in want]


def found(data):
    out, at = [], 0
    for w in data.split():
        at = data.index(w, at)
        out.append((w, at))
        at += len(w)
    return out


@pytest.mark.parametrize("n", [1, 4, 5])
def test_shingles_are_sets_of_words(n):
    texts = [None, "", " \n", "one", "Two  WORDS", "two words", prose(1, 50), prose(1, 50).upper(), prose(2, 3) * 9, "A b c d e a b c d e", "\x0ba b\x0cc"]
    got = hashing.shingles(texts, n)
    sets = []
    for t in texts:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[k : k + n]) for k in range(len(w) - n + 1)} or ({tuple(w)} if w else set()))
    for a, x in zip(sets, got):
        assert len(a) == len(x) and (np.diff(x.astype(float)) >= 0).all()
        for b, y in zip(sets, got):
            assert len(a & b) == len(np.intersect1d(x, y))
