"""SentencePiece encoding and decoding by suffix-array matching.

The distinct words of a batch are laid end to end and their suffixes sorted.  A
binary search finds every vocabulary piece's range of occurrences at once; these are
the edges over each word's characters.  Sorted by position they are relaxed in the
model's own order (best score first, then leftmost): an edge joins the two symbols
that it covers.
"""

from __future__ import annotations

import heapq
import re
import zlib
from array import array
from collections.abc import Iterator
from functools import cache
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

SPACE = "▁"


class Pieces:
    """A byte-pair model of normal, byte and control pieces without a normalizer;
    another one is an error."""

    def __init__(self, path: str, most_words: int = 500_000):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        names = [model.id_to_piece(i) for i in range(n)]
        self.byte_ids = {int(names[i][3:5], 16): i for i in range(n) if model.is_byte(i)}
        self.unknown = model.unk_id()
        normal = [i for i in range(n) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
        self.score = {i: model.get_score(i) for i in normal}
        self.rank = np.zeros(n, np.int32)  # of scores: the best first, equal ones alike
        self.rank[normal] = np.unique([-self.score[i] for i in normal], return_inverse=True)[1]
        self.as_bytes = [bytes([int(names[i][3:5], 16)]) if model.is_byte(i) else b"" if model.is_control(i) else names[i].encode() for i in range(n)]
        self.longest = max(len(names[i]) for i in normal)
        order = sorted(normal, key=lambda i: names[i])
        self.ids = np.array(order)
        self.sizes = np.array([len(names[i]) for i in order])
        self.low = np.array([names[i] for i in order], dtype=f"U{self.longest + 1}")
        self.high = np.array([names[i] + "\U0010ffff" for i in order], dtype=f"U{self.longest + 1}")
        # No piece reaches from a word into the next space: words are encoded alone.
        self.words = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+").findall if not any(re.search(f"[^{SPACE}]{SPACE}", names[i]) for i in normal) else lambda t: [t]
        self.known: dict[str, bytes] = {}
        self.before: dict[str, bytes] = {}  # words known before the last change of generation
        self.most = most_words
        # A normalizer, or pieces that the user defined, would show here.
        probes = ["a  b\tc", "ﬁ Ａ ｱ ½ e\u0301", *[names[i].replace(SPACE, " ") + "x" for i in normal[:: max(1, len(normal) // 400)]]]
        for text, ids in zip(probes, self.encode(probes), strict=True):
            if array("I", ids).tolist() != model.encode(text):
                raise ValueError(f"{path}: not a byte-pair model that keeps texts as they are")
        self.known = {}

    def edges(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start, size and id of every piece that occurs in the words laid end to
        end with one separator after each, by position."""
        text = np.frombuffer("".join(w + "\0" for w in words).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
        rank, size = np.unique(text, return_inverse=True)[1].astype(np.int64) + 1, 1
        suffixes = np.argsort(rank, kind="stable")
        while size < self.longest:  # prefix doubling, as deep as the longest piece
            later = np.zeros_like(rank)
            later[:-size] = rank[size:] if size < len(rank) else 0
            key = rank * (len(text) + 2) + later
            suffixes = np.argsort(key, kind="stable")
            rank = np.empty_like(rank)
            rank[suffixes] = np.concatenate(([1], 1 + np.cumsum(np.diff(key[suffixes]) != 0)))
            size *= 2
        padded = np.concatenate((text, np.zeros(self.longest, np.int64))).astype("<u4")
        heads = np.lib.stride_tricks.sliding_window_view(padded, self.longest)[suffixes]
        heads = np.ascontiguousarray(heads).view(f"<U{self.longest}").reshape(-1)
        first, last = np.searchsorted(heads, self.low, "left"), np.searchsorted(heads, self.high, "left")
        counts = last - first
        at = suffixes[np.repeat(first - np.concatenate(([0], np.cumsum(counts)[:-1])), counts) + np.arange(counts.sum())]
        by = np.lexsort((np.repeat(self.sizes, counts), at))
        return at[by], np.repeat(self.sizes, counts)[by], np.repeat(self.ids, counts)[by]

    def relax(self, word: str, edge: dict[tuple[int, int], int]) -> list[int]:
        """Ids of one word from its edges: (start, end) to id."""
        n, score = len(word), self.score
        end, before = list(range(1, n + 1)), list(range(-1, n - 1))  # of the symbol that starts at a place
        heap = [(-score[p], i, i + 2) for i in range(n - 1) if (p := edge.get((i, i + 2))) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, j = heapq.heappop(heap)
            mid = end[i]
            if mid < 0 or mid >= n or end[mid] != j:
                continue  # a symbol has changed since
            end[i], end[mid] = j, -1
            if j < n:
                before[j] = i
                if (p := edge.get((i, end[j]))) is not None:
                    heapq.heappush(heap, (-score[p], i, end[j]))
            if (k := before[i]) >= 0 and (p := edge.get((k, j))) is not None:
                heapq.heappush(heap, (-score[p], k, j))
        out, i = [], 0
        while i < n:
            p = edge.get((i, end[i]))
            if p is not None:
                out.append(p)
            elif self.byte_ids:
                out += [self.byte_ids[b] for b in word[i : end[i]].encode("utf-8", "surrogatepass")]
            else:
                out.append(self.unknown)
            i = end[i]
        return out

    def learn(self, words: list[str]) -> None:
        starts, sizes, ids = self.edges(words)
        size = np.array([len(w) for w in words])
        base = np.cumsum(size + 1) - (size + 1)
        bounds = np.searchsorted(starts, np.append(base, base[-1] + size[-1] + 1)).tolist()
        short = size <= 64
        self.known.update(self._relax_all([w for w, s in zip(words, short, strict=True) if s], base[short], size[short], starts, sizes, ids))
        for k in np.flatnonzero(~short).tolist():
            a, b = bounds[k], bounds[k + 1]
            edge = {(x, x + n): i for x, n, i in zip((starts[a:b] - base[k]).tolist(), sizes[a:b].tolist(), ids[a:b].tolist(), strict=True)}
            self.known[words[k]] = array("I", self.relax(words[k], edge)).tobytes()

    def _relax_all(self, words: list[str], base: np.ndarray, size: np.ndarray, starts: np.ndarray, sizes: np.ndarray, ids: np.ndarray) -> dict[str, bytes]:
        """All words at once, a round after another: each word's best edge, the leftmost
        of equals, joins its two symbols."""
        if not words:
            return {}
        none, key, total = np.iinfo(np.int32).max, starts * (self.longest + 1) + sizes, int(base[-1] + size[-1])
        rank_of = self.rank[ids]

        def find(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            wanted = np.where(end - start > self.longest, -1, start * (self.longest + 1) + end - start)
            at = np.minimum(np.searchsorted(key, wanted), len(key) - 1)
            hit = key[at] == wanted if len(key) else np.zeros(len(wanted), bool)
            return hit, at

        def rank(start: np.ndarray, end: np.ndarray) -> np.ndarray:
            hit, at = find(start, end)
            return np.where(hit, rank_of[at], none) if len(key) else np.full(len(start), none, np.int32)

        # Positions in the words' order; gaps of words left out are not visited.
        place = np.repeat(base - (np.cumsum(size) - size), size) + np.arange(size.sum())
        first, stop = np.cumsum(size) - size, np.repeat(base + size, size)
        end, before = np.full(total + 2, -1), np.full(total + 2, -1)
        end[place], before[place] = place + 1, place - 1
        before[base] = -1
        limit = np.zeros(total + 2, np.int64)
        limit[place] = stop
        best = np.full(total + 2, none, np.int32)
        inner = place[place + 1 < stop]
        best[inner] = rank(inner, inner + 2)
        while True:
            here = best[place]
            least = np.minimum.reduceat(here, first)
            active = np.flatnonzero(least != none)
            if not len(active):
                break
            hits = np.flatnonzero((here == np.repeat(least, size)) & (here != none))
            word = np.searchsorted(first, hits, "right") - 1
            p = place[hits[np.concatenate(([True], np.diff(word) != 0))]]  # the leftmost of each word
            m = end[p]
            j = end[m]
            end[p], end[m], best[m] = j, -1, none
            inside = j < limit[p]
            before[j[inside]] = p[inside]
            best[p] = none
            best[p[inside]] = rank(p[inside], end[j[inside]])
            q = before[p]
            left = q >= 0
            best[q[left]] = rank(q[left], j[left])
        alive = place[end[place] >= 0]
        hit, at = find(alive, end[alive])
        code = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), "<u4")[end[place] >= 0]
        count, other = np.ones(len(alive), np.int64), np.flatnonzero(~hit)
        spelled = {c: [self.byte_ids[b] for b in chr(c).encode("utf-8", "surrogatepass")] if self.byte_ids else [self.unknown] for c in set(code[other].tolist())}
        count[other] = [len(spelled[c]) for c in code[other].tolist()]
        out, to = np.zeros(count.sum(), "<u4"), np.cumsum(count) - count
        out[to[hit]] = ids[at[hit]]
        for k in other.tolist():
            out[to[k] : to[k] + count[k]] = spelled[int(code[k])]
        edges = np.append(to, len(out))[np.searchsorted(alive, np.append(base, total + 2))].tolist()
        raw = out.tobytes()
        return {w: raw[4 * a : 4 * b] for w, a, b in zip(words, edges[:-1], edges[1:], strict=True)}

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids as little-endian unsigned 32-bit numbers; an empty text has none."""
        if len(self.known) > self.most:
            self.before, self.known = self.known, {}
        split = [self.words(SPACE + t.replace(" ", SPACE)) if t else [] for t in texts]
        new, held = [], 0
        for w in set().union(*split):
            if w not in self.known:
                if (ids := self.before.get(w)) is not None:
                    self.known[w] = ids
                    continue
                new.append(w)
                held += len(w)
                if held > 400_000:
                    self.learn(new)
                    new, held = [], 0
        if new:
            self.learn(new)
        return [b"".join(map(self.known.__getitem__, ws)) for ws in split]

    def decode(self, ids: bytes) -> str:
        """The text of ids; byte pieces that are no UTF-8 become U+FFFD."""
        text = b"".join(map(self.as_bytes.__getitem__, array("I", ids))).decode("utf-8", "replace").replace(SPACE, " ")
        return text[1:] if text[:1] == " " else text


@cache
def pieces(path: str) -> Pieces:
    return Pieces(path)


def encode_texts(docs: DataFrame, vocabulary: str, batch_chars: int = 12_000_000) -> DataFrame:
    """doc_id, ids (little-endian unsigned 32-bit numbers), n_tokens, ids_crc32 and
    decoded_sha256, of the text that the ids decode to.

    Every row is encoded whole; a null or empty text has no ids.  Repeated rows give
    repeated results, an empty table none; other columns are dropped.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, keys, texts, held = pieces(vocabulary), [], [], 0

        def done() -> pa.RecordBatch:
            ids = model.encode(texts)
            decoded = [sha256(model.decode(i).encode("utf-8", "surrogatepass")).hexdigest() for i in ids]
            return pa.RecordBatch.from_arrays([pa.array(keys, key_type), pa.array(ids, pa.binary()), pa.array([len(i) // 4 for i in ids], pa.int64()), pa.array([zlib.crc32(i) for i in ids], pa.int64()), pa.array(decoded)], ["doc_id", "ids", "n_tokens", "ids_crc32", "decoded_sha256"])

        for b in batches:
            key_type = b.schema.field("doc_id").type
            for key, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True):
                keys.append(key)
                texts.append(text)
                held += len(text or "")
                if held > batch_chars:
                    yield done()
                    keys, texts, held = [], [], 0
        if keys:
            yield done()

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, ids binary, n_tokens long, ids_crc32 long, decoded_sha256 string")
