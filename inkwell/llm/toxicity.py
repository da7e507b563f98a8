"""Toxicity scores from subword-bag embeddings and a linear softmax.

A word's vector is the mean of its hashed character n-gram vectors, so an unseen
misspelling shares most of its vector with the word it distorts.  A window's
vector is the mean of its words', and a linear softmax over that gives the
window's log-odds.  Vectors and softmax are trained jointly in numpy; a toxic
text need only have one toxic window, so its best window carries its label.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Settings:
    """``rows_each`` and ``max_chars`` bound the training sample: rows of either
    label, and characters in all.  The rows come in the order of a hash of their id."""

    rows_each: int = 2500
    max_chars: int = 10_000_000
    buckets: int = 1 << 17
    width: int = 8
    window: int = 16
    epochs: int = 50
    warm_up: int = 20
    rate: float = 0.05
    least_texts: int = 8
    seed: int = 1


@dataclass(frozen=True)
class Model:
    """What scoring needs: each n-gram's vector times the softmax's direction."""

    ngram_odds: np.ndarray
    bias: float
    slope: float
    shift: float
    window: int


#: The softmax reads a window's mean vector times this (its temperature), so that
#: one word among many can carry a window.
SCALE = 16.0
#: Lengths of the character n-grams; a word is read between two boundary marks.
LENGTHS = (3, 4, 5)


def _ngrams(words: list[str], buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all words' n-grams one after another, and where each word's start."""
    text = "".join([f"<{w}>" for w in words])
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint64)
    code = np.concatenate((code, np.zeros(max(LENGTHS), np.uint64)))  # room for the last word's longest n-gram
    size = np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 2
    left = np.repeat(np.cumsum(size), size) - np.arange(size.sum())  # characters from here to the word's end
    found, place, h = [], [], np.zeros(len(code), np.uint64)
    for n in range(1, max(LENGTHS) + 1):
        h[: len(h) - n + 1] = h[: len(h) - n + 1] * np.uint64(0x9E3779B97F4A7C15) + code[n - 1 :]
        if n in LENGTHS:
            at = np.flatnonzero(left >= n)
            x = (h[at] + np.uint64(n)) * np.uint64(0xBF58476D1CE4E5B9)
            found.append((x >> np.uint64(40)) % np.uint64(buckets))
            place.append(at)
    word = np.concatenate([np.repeat(np.arange(len(words)), size)[at] for at in place])
    order = np.argsort(word, kind="stable")
    counts = np.bincount(word, minlength=len(words))
    return np.concatenate(found)[order].astype(np.int64), np.concatenate(([0], np.cumsum(counts)[:-1])).astype(np.int64)


def _window_sums(odds: np.ndarray, window: int) -> np.ndarray:
    """Sums over windows that start every half window; a short text has one."""
    starts = np.arange(0, max(1, len(odds) - window // 2), window // 2)
    c = np.concatenate(([0.0], np.cumsum(odds)))
    return c[np.minimum(starts + window, len(odds))] - c[starts]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def fit(texts: list[str | None], toxic: list[int], settings: Settings | None = None, share: float | None = None) -> Model:
    """Train on texts and 0/1 labels; ``share`` is that of label 1 outside the sample.
    Texts without words are left out.  With one label only, or no rows, the model gives
    every text that share."""
    s = settings or Settings()
    rng = np.random.default_rng(s.seed)
    worded = [k for k, t in enumerate(texts) if (t or "").split()]  # texts without words teach nothing
    texts, label = [texts[k] for k in worded], np.asarray([toxic[k] for k in worded], dtype=np.float64)
    if not len(label) or label.min() == label.max():
        return Model(np.zeros(s.buckets, np.float32), 0.0, 0.0, 40.0 * (label.mean() * 2 - 1) if len(label) else -4.0, s.window)

    ids: dict[str, int] = {}
    words, window_of, doc_of, n_windows = [], [], [], 0
    for d, text in enumerate(texts):
        w = np.fromiter((ids.setdefault(x, len(ids)) for x in (text or "").lower().split()), dtype=np.int64)
        for a in range(0, max(1, len(w) - s.window // 2), s.window // 2):
            part = w[a : a + s.window]
            words.append(part)
            window_of.append(np.full(len(part), n_windows))
            doc_of.append(d)
            n_windows += 1
    words, window_of, doc_of = np.concatenate(words), np.concatenate(window_of), np.asarray(doc_of)
    flat, starts = _ngrams(list(ids), s.buckets)
    sizes = np.diff(np.append(starts, len(flat)))
    seen = np.unique(words * len(texts) + doc_of[window_of])  # word and document
    spread = np.bincount(flat, np.repeat(np.bincount(seen // len(texts), minlength=len(ids)), sizes), s.buckets)
    usual = (spread >= s.least_texts).astype(np.float32)[:, None]  # what few texts hold would only be learned by heart

    first = np.concatenate(([0], np.flatnonzero(np.diff(doc_of)) + 1))
    per_doc = np.diff(np.append(first, len(doc_of)))
    y = label[doc_of]
    balance = np.where(label > 0, 0.5 / label.sum(), 0.5 / (len(label) - label.sum()))
    even = (balance / per_doc)[doc_of]
    vectors = usual * rng.uniform(-1, 1, (s.buckets, s.width)).astype(np.float32) / s.width
    way, bias = rng.normal(0, 0.5, s.width), -1.0
    state = {k: [np.zeros_like(v), np.zeros_like(v)] for k, v in (("vectors", vectors), ("way", way), ("bias", np.zeros(1)))}

    def step(name: str, grad: np.ndarray, t: int) -> np.ndarray:
        m, v = state[name]
        m *= 0.9
        m += 0.1 * grad
        v *= 0.99
        v += 0.01 * grad * grad
        return s.rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)

    def forward() -> tuple[np.ndarray, np.ndarray]:
        odds = np.add.reduceat((vectors @ way)[flat], starts) / sizes
        return odds, np.bincount(window_of, odds[words], n_windows) * (SCALE / s.window) + bias

    for t in range(1, s.epochs + 1):
        _, z = forward()
        weight = even
        if t > s.warm_up:  # of a toxic text only the best window counts
            best = np.repeat(np.maximum.reduceat(z, first), per_doc)
            weight = np.where(y > 0, np.where(z >= best, balance[doc_of], 0.0), even * np.sqrt(per_doc)[doc_of])
        g = (_sigmoid(z) - y) * weight
        by_word = np.bincount(words, (g * (SCALE / s.window))[window_of], len(ids)) / sizes
        by_gram = np.bincount(flat, np.repeat(by_word, sizes), s.buckets)
        grad_way = by_gram @ vectors
        vectors -= usual * step("vectors", (by_gram[:, None] * way).astype(np.float32), t)
        way = way - step("way", grad_way, t)
        bias -= float(step("bias", np.array([g.sum()]), t)[0])

    _, z = forward()
    top = np.maximum.reduceat(z, first)
    a, c = 1.0, 0.0  # logistic calibration of the best window's log-odds, by Newton's method with a ridge
    for _ in range(30):
        p = _sigmoid(a * top + c)
        d, h = (p - label), np.maximum(p * (1 - p), 1e-6)
        grad = np.array([d @ top + 0.1 * (a - 1), d.sum() + 0.1 * c])
        hess = np.array([[h @ (top * top) + 0.1, h @ top], [h @ top, h.sum() + 0.1]])
        a, c = np.array([a, c]) - np.linalg.solve(hess, grad)
    if share and 0 < share < 1:  # the sample holds more of label 1 than there is outside
        c += np.log(share / (1 - share)) - np.log(label.mean() / (1 - label.mean()))
    return Model((vectors @ way).astype(np.float32), bias, float(a), float(c), s.window)


def training_rows(docs: DataFrame, labels: DataFrame, settings: Settings) -> tuple[list[str], list[int], float | None]:
    """A bounded sample of labelled rows outside the held-out fifth, and label 1's share of all those rows."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & ~_held_out()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    by_hash = [F.xxhash64("doc_id"), F.col("doc_id")]
    some = known.where("toxic = 1").orderBy(*by_hash).limit(settings.rows_each).unionAll(known.where("toxic = 0").orderBy(*by_hash).limit(settings.rows_each))
    texts = docs.select("doc_id", "text", F.xxhash64("text").alias("content"))
    sized = texts.select("doc_id", "content", F.coalesce(F.length("text"), F.lit(0)).alias("n")).join(F.broadcast(some), "doc_id")  # 2 * rows_each ids at most
    picked, room = {}, settings.max_chars  # without the texts: only those that fit are fetched
    for row in sized.orderBy(*by_hash, "content").limit(2 * settings.rows_each).collect():
        if row.content not in picked and (room := room - row.n) >= 0:
            picked[row.content] = (len(picked), row.doc_id, row.toxic)  # of equal texts the first counts
    if not picked:
        return [], [], known.agg(F.avg("toxic")).first()[0]
    wanted = docs.sparkSession.createDataFrame([(i, c, k, t) for c, (k, i, t) in picked.items()], f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, content long, place int, toxic int")
    sample = {row.place: (row.text, row.toxic) for row in texts.join(F.broadcast(wanted), ["doc_id", "content"]).toLocalIterator()}
    found = [sample[k] for k in sorted(sample)]
    return [t for t, _ in found], [y for _, y in found], known.agg(F.avg("toxic")).first()[0]


def _held_out():
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0


def score_texts(texts: list[str | None], model: Model, cache: dict[str, float]) -> np.ndarray:
    """Scores of whole texts; ``cache`` keeps words' odds and is emptied when large."""
    if len(cache) > 300_000:
        cache.clear()
    split = [(t or "").lower().split() for t in texts]
    new = [w for w in set().union(*split) if w not in cache]
    if new:
        flat, starts = _ngrams(new, len(model.ngram_odds))
        cache.update(zip(new, (np.add.reduceat(model.ngram_odds[flat], starts) / np.diff(np.append(starts, len(flat)))).tolist(), strict=True))
    out = np.empty(len(texts))
    for k, words in enumerate(split):
        odds = np.fromiter(map(cache.__getitem__, words), dtype=np.float64, count=len(words))
        out[k] = _window_sums(odds, model.window).max() * (SCALE / model.window) + model.bias if words else model.bias
    return _sigmoid(model.slope * out + model.shift)


def score_toxicity(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score and predicted for every row of ``docs``.

    Only the text is read for a score; equal texts score equally.  A null or
    empty text scores as an empty window.  A null id counts as not held out.
    An empty table gives an empty result; other columns are dropped.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict[str, float] = {}
        for b in batches:
            for a in range(0, b.num_rows, 256):  # bounds the words held at once
                part = b.slice(a, 256)
                score = score_texts(part.column("text").to_pylist(), model, cache)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(score)], ["doc_id", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    scored = docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, score double")
    return scored.select("doc_id", F.coalesce(_held_out(), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
