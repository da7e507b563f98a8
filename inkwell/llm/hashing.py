"""64-bit hashes of runs of bytes and of words, for whole arrays at a time."""

from __future__ import annotations

from functools import cache

import numpy as np

ODD = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def runs(data: bytes, n: int) -> np.ndarray:
    """A hash of each run of n bytes, eight at a time."""
    count, padded = len(data) - n + 1, data + b"\0" * 8
    h = np.full(count, n, np.uint64)
    for at in range(0, n, 8):
        size = min(8, n - at)
        part = np.ndarray((count,), "<u8", padded, at, (1,)) & np.uint64((1 << 8 * size) - 1)
        h = mix(h * ODD + part)
    return h


#: Bytes between words: space and the controls 9 to 13.
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
#: A number for each byte, A-Z as a-z.
_BYTES = mix(np.arange(1, 257, dtype=np.uint64))
_BYTES[65:91] = _BYTES[97:123]
_KEPT = 1 << 19


def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    back = np.uint64(pow(int(ODD), -1, 1 << 64))
    return tuple(np.multiply.accumulate(np.concatenate(([np.uint64(1)], np.full(size, x, np.uint64)))) for x in (ODD, back))


@cache
def _kept_powers() -> tuple[np.ndarray, np.ndarray]:
    return _powers(_KEPT)


def words(data: bytes, most: int = _KEPT) -> tuple[np.ndarray, np.ndarray]:
    """A hash of each word of ``data``, A-Z read as a-z, and where it starts.  About
    ``most`` bytes are worked on at a time, or one longer word."""
    code, at, found = np.frombuffer(data, np.uint8), 0, []
    while len(code) - at > most:
        gaps = np.flatnonzero(_SPACE[code[at : at + most]])
        end = at + int(gaps[-1]) + 1 if len(gaps) else at + most
        while not len(gaps) and end < len(code) and not _SPACE[code[end]]:  # in a long word
            ahead = np.flatnonzero(_SPACE[code[end : end + most]])
            end += int(ahead[0]) if len(ahead) else min(most, len(code) - end)
        found.append((at, *_words(code[at:end])))
        at = end
    found.append((at, *_words(code[at:])))
    return np.concatenate([h for _, h, _ in found]), np.concatenate([a + s for a, _, s in found])


def _words(code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    space = np.concatenate(([True], _SPACE[code], [True]))
    edge = np.flatnonzero(space[1:] != space[:-1])
    start, end = edge[::2], edge[1::2]
    power, back = _kept_powers() if len(code) <= _KEPT else _powers(len(code))
    # A word's sum of weighted bytes, shifted to weights from one on.
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_BYTES[code] * power[: len(code)], dtype=np.uint64)))
    return mix((total[end] - total[start]) * back[start] + (end - start).astype(np.uint64) * ODD), start


def shingles(texts: list[str | None], n: int) -> list[np.ndarray]:
    """Sorted distinct hashes of each text's n-word shingles, A-Z as a-z.  With fewer
    words the whole sequence is one; without words there is none."""
    out: list[np.ndarray] = []
    held, size = [], 0
    for t in texts:
        data = (t or "").encode("utf-8", "surrogatepass")
        if held and size + len(data) >= _KEPT:
            out += _shingles(held, n)
            held, size = [], 0
        held.append(data)
        size += len(data) + 1
    return out + (_shingles(held, n) if held else [])


def _shingles(held: list[bytes], n: int) -> list[np.ndarray]:
    size = np.fromiter(map(len, held), np.int64, len(held)) + 1
    w, start = words(b"\n".join(held))
    if not len(w):
        return [np.zeros(0, np.uint64)] * len(held)
    doc = np.repeat(np.arange(len(held)), np.diff(np.searchsorted(start, np.concatenate(([0], np.cumsum(size))))))
    count = np.bincount(doc, minlength=len(held))
    m = max(0, len(w) - n + 1)
    h = w[:m]
    for i in range(1, n):
        h = mix(h * ODD + w[i : i + m])
    inside = doc[:m] == doc[n - 1 :][:m] if m else np.zeros(0, bool)
    h = h[inside]
    edge, first = np.concatenate(([0], np.cumsum(np.maximum(count - n + 1, 0)))).tolist(), np.concatenate(([0], np.cumsum(count))).tolist()
    out = []
    for k, c in enumerate(count.tolist()):
        if c >= n:
            s = np.sort(h[edge[k] : edge[k + 1]])
            out.append(s[np.concatenate(([True], s[1:] != s[:-1]))])
        elif c:
            x = np.full(1, c, np.uint64)
            for v in w[first[k] : first[k + 1]]:
                x = mix(x * ODD + v)
            out.append(x)
        else:
            out.append(np.zeros(0, np.uint64))
    return out
