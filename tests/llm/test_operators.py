"""Operators against brute force, with nulls, empty and long texts, ties, repeated
rows, empty tables and columns with clashing names."""

import hashlib
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from inkwell.llm import components, fingerprints, packing, pieces, planes, quality, similar, substrings, templates, tokens, toxicity, warc
from inkwell.llm.queries import vocabulary

SCHEMA = "doc_id long, text string, kept string, n_words string, node string, n string"
WORDS = "the of and to a in is it for was on with be as by at from".split()


def prose(seed, n=120):
    rng = np.random.default_rng(seed)
    return " ".join(str(rng.choice(WORDS)) if rng.random() < 0.45 else "".join(rng.choice(list("abcdefgh"), rng.integers(3, 8))) for _ in range(n))


@pytest.fixture(scope="module")
def docs(spark):
    base = prose(1)
    near = " ".join(w if i != 60 else "changed" for i, w in enumerate(base.split()))
    texts = [(7, base), (3, base), (9, near), (4, None), (5, ""), (6, " \n\t"), (8, "two words"), (10, "two words"), (1, prose(2) + " " + base[:300]), (2, prose(3, 4000)), (11, "é" * 90), (12, "x" + "é" * 90), (13, prose(4)), (None, base), (13, prose(4)), (14, "<s> a\x00b   c"), (15, "aaaa" * 200)]
    return spark.createDataFrame([(i, t, "k", "w", "x", "y") for i, t in texts], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def pairs(df):
    return [(r["doc_id"], r["text"]) for r in df.collect()]


def order(rows):
    return sorted(rows, key=repr)


def test_quality(docs, empty):
    for r in quality.score_quality(docs).collect():
        words = [w for w in __import__("re").split("[ \t-\r]+", r["text"] or "") if w]
        wins = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
        hit = {i + k for i, w in enumerate(wins) if wins.count(w) > 1 for k in range(3)} if len(words) < 1000 else None
        assert r["n_words"] == len(words) and r["word_chars"] == sum(map(len, words))
        assert hit is None or r["n_repeat_words"] == len(hit)
        assert r["base_failed"] == (len(words) < 50 or 100 * r["n_repeat_words"] > 50 * len(words))
    kept = quality.keep_quality(docs)
    assert kept.columns == docs.columns and kept.where("doc_id = 13").count() == 2
    assert quality.score_quality(empty).count() == 0


def test_short_junk_is_judged_by_its_classes(spark):
    junk = " ".join(f"#|{'$%&*'[i % 4] * (i % 3 + 1)}{i}|#" for i in range(60))
    docs = spark.createDataFrame([(1, junk), (2, prose(7, 60))], "doc_id long, text string")
    assert [r.doc_id for r in quality.keep_quality(docs, quality.CLASSES_JUDGED).collect()] == [2]
    assert {r.doc_id for r in quality.keep_quality(docs).collect()} == {1, 2}


def test_long_texts_count_repeats_alike(spark):
    df = spark.createDataFrame([("a b c a b c d",), ("x y z",), ("q q q q",)], "text string").withColumn("w", F.split("text", " "))
    assert [r[0] for r in df.select(quality._repeated_long(F.col("w"))).collect()] == [6, 0, 4]


def test_components(spark):
    edges = spark.createDataFrame([(i + 1, i) for i in range(40)] + [(100, 99), (99, 101), (5, 5)], "a long, b long")
    found = {r.node: r.component for r in components.connected_components(edges).collect()}
    assert found == {i: 0 for i in range(41)} | {99: 99, 100: 99, 101: 99}
    assert components.connected_components(edges.limit(0)).count() == 0


@pytest.mark.parametrize("opts", [similar.Likeness(), similar.Likeness(words=5, percent=80), similar.Likeness(crowd=2)])
def test_similar(docs, empty, opts):
    rows = [(i, t) for i, t in pairs(docs) if i is not None]
    sets = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[k : k + opts.words]) for k in range(len(w) - opts.words + 1)} or ({tuple(w)} if w else set())
    part = {i: i for i in sets}
    for _ in sets:
        for a in sets:
            for b in sets:
                both = len(sets[a] & sets[b])
                if sets[a] and sets[b] and 100 * both >= opts.percent * len(sets[a] | sets[b]):
                    part[a] = part[b] = min(part[a], part[b])
    got = [(r.doc_id, r.n_shingles, r.component_id) for r in similar.similar_components(docs, opts).collect()]
    assert len(got) == docs.count()
    assert {g for g in got if g[0] is not None} == {(i, len(s), part[i]) for i, s in sets.items()}
    assert similar.similar_components(empty, opts).count() == 0


def test_prefix_tree():
    rng = np.random.default_rng(5)
    sets = [np.unique(rng.integers(0, 40, rng.integers(1, 30))).astype(np.uint64) for _ in range(60)]
    for probe in sets[:20]:
        want = [k for k, s in enumerate(sets) if 100 * len(np.intersect1d(s, probe)) >= 60 * len(np.union1d(s, probe))]
        assert sorted(similar.PrefixTree(sets).search(probe, 60)) == want


@pytest.mark.parametrize("opts", [substrings.Matching(), substrings.Matching(hot=1), substrings.Matching(block=100, flush=20)])
def test_substrings(docs, empty, opts):
    rows = [(i, (t or "").encode()) for i, t in pairs(docs) if i is not None]
    first = {}
    for i, b in rows:
        for k in range(len(b) - 49):
            first[b[k : k + 50]] = min(i, first.get(b[k : k + 50], i))
    want = []
    for i, b in rows:
        gone = bytearray(len(b))
        for k in range(len(b) - 49):
            if first[b[k : k + 50]] < i:
                gone[k : k + 50] = b"\1" * 50
        kept = bytes(x for x, g in zip(b, gone) if not g)
        want.append((i, len(b), sum(gone), sum(g and not p for p, g in zip(b"\0" + gone, gone)), kept))
    got = [(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in substrings.remove_repeats(docs, opts).collect()]
    assert order(g for g in got if g[0] is not None) == order(want) and len(got) == docs.count()
    assert substrings.remove_repeats(empty, opts).count() == 0
    assert substrings.without_repeats(docs, opts).columns == docs.columns and substrings.without_repeats(docs, opts).count() == docs.count()


def test_boundaries():
    text = np.frombuffer(b"abracadabra\xffabracadabra\xffcadabra\xff", np.uint8)
    for length in (1, 3, 7, 9):
        at, found = substrings.find_boundaries(text, length)
        heads = [bytes(text[i : i + length]) for i in at]
        for h0, h1, f in zip(heads, heads[1:], found[1:]):
            if len(h1) == length and b"\xff" not in h1:
                assert f == (h0 != h1)


def test_templates(spark, empty):
    lines = [(i, f"own {prose(i, 9)}\nPage {i} of this fine {'book' if i % 2 else 'tome'} here today\nlast", "en", 0) for i in range(12)]
    rows = [*lines, (20, lines[0][1], "en", 0), (21, None, "en", 0), (22, "", "en", 0), (None, lines[1][1], "en", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, n_chars long")
    got = {r.doc_id: r for r in templates.drop_templates(df).collect()}
    assert got[0].text == lines[0][1] and got[None].text == lines[1][1] and got[21].text is None and got[22].text == ""
    assert all(got[i].n_dropped == 1 and got[i].text.split("\n")[1] == "last" and got[i].n_chars == len(got[i].text) for i in (*range(1, 12), 20))
    assert templates.drop_templates(df.where("doc_id < 9")).agg(F.sum("n_dropped")).first()[0] == 0
    assert templates.drop_templates(empty).count() == 0
    assert templates.grow(["a b c 1", "a b c 2", "x y z q"], 75) == [0, 0, 1]


def test_short_and_unspaced_lines_recur(spark):
    rows = [(i, f"{prose(100 + i, 9)}\nAll rights reserved.\n\n版权所有保留一切权利\nNo {i}") for i in range(3)] + [(9, "All rights kept.\n\nNo 2")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in templates.drop_templates(df, templates.EVERY_LINE).collect()}
    assert got[0].text == rows[0][1] and got[9].text == "All rights kept.\n" and got[9].n_dropped == 1
    assert all(got[i].text == f"{prose(100 + i, 9)}\n\nNo {i}" and got[i].n_dropped == 2 for i in (1, 2))


@pytest.mark.parametrize("name, end", [("byte_bpe_50k.json", 2), ("word_bpe_49k.json", 1)])
def test_tokens(docs, name, end):
    enc = tokens.Encoder(vocabulary(name))
    texts = [t for _, t in pairs(docs)] + ["a  b\n c", " x", "it's İ́ 1²½", "<|endoftext|>"]
    for t in texts:
        assert np.frombuffer(enc.encode(t), "<u4").tolist() == (enc.library.encode(t, add_special_tokens=False).ids if t else [])


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_added_tokens_as_the_plain_library_has_them(name):
    from tokenizers import Tokenizer

    enc, plain = tokens.Encoder(vocabulary(name)), Tokenizer.from_file(vocabulary(name))
    added = [t.content for t in plain.get_added_tokens_decoder().values()]
    assert added
    for t in [*added, *(f"one {a} two{a.upper()} {a}" for a in added), "no such token"]:
        assert np.frombuffer(enc.encode(t), "<u4").tolist() == plain.encode(t, add_special_tokens=False).ids


def test_packing(docs, empty):
    opts = packing.Packing(length=64, full=64, fan_in=2)
    enc = tokens.encoder(vocabulary("byte_bpe_50k.json"))
    rows = packing.pack_documents(docs, vocabulary("byte_bpe_50k.json"), 2, opts).collect()
    texts = dict(pairs(docs))
    by_seq = {}
    for r in rows:
        ids = enc.encode(texts[r.doc_id]) + (2).to_bytes(4, "little")
        assert bytes(r.ids) == ids[4 * r.start : 4 * (r.start + r.length)] and r.ids_crc32 == zlib.crc32(r.ids)
        assert r.length == 64 or r.piece == 0
        by_seq.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by_seq.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= 64
    assert sum(r.length for r in rows) == sum(len(enc.encode(t)) // 4 + 1 for _, t in pairs(docs))
    assert packing.pack_documents(empty, vocabulary("byte_bpe_50k.json"), 2).count() == 0


def test_counted_packing_is_best_fit():
    rng = np.random.default_rng(3)
    for length in (7, 64, 1024):
        sizes = rng.integers(1, length, 500).tolist()
        counts = {n: sizes.count(n) for n in sizes}
        runs, held, made = sorted(packing.best_fit_counts(counts, length)), {}, packing.best_fit(sizes, length)
        for k, (n, rank, each, sequence, offset) in enumerate(runs):
            last = runs[k + 1][1] if k + 1 < len(runs) and runs[k + 1][0] == n else counts[n]
            for i in range(last - rank):
                held.setdefault(sequence + i // each, []).append((offset + i % each * n, n))
        for parts in held.values():
            ends = [0, *(a + n for a, n in sorted(parts))]
            assert [a for a, _ in sorted(parts)] == ends[:-1] and ends[-1] <= length
        whole = sorted(sorted(n for _, n in parts) for parts in held.values())
        assert whole == sorted(sorted(sizes[i] for i in group) for group in made)


def test_packing_fills_the_room_of_other_partitions(spark):
    texts = [(i, " the" * (39 if i < 40 else 23)) for i in range(80)]
    docs = spark.createDataFrame(texts, "doc_id long, text string").repartitionByRange(2, "doc_id")
    rows = packing.pack_documents(docs, vocabulary("byte_bpe_50k.json"), 2, packing.Packing(length=64, full=64)).collect()
    assert len({r.sequence_id for r in rows}) == 40 and {r.length for r in rows} == {40, 24}


@pytest.mark.parametrize("form", [planes.Format(block=7), planes.Format(block=16, unit="bit"), planes.Format()])
def test_token_files(docs, form):
    enc = tokens.encoder(vocabulary("word_bpe_49k.json"))
    rows = sorted(pairs(docs), key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    want, at = [], 0
    for i, t in rows:
        ids = enc.encode(t) + (1).to_bytes(4, "little")
        want.append((i, at, len(ids) // 4, zlib.crc32(ids)))
        at += len(ids) // 4
    files = planes.write_token_files(docs, vocabulary("word_bpe_49k.json"), 1, form)
    assert order((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in planes.read_token_files(files).collect()) == order(want)


def test_planes(tmp_path):
    ids = np.random.default_rng(0).integers(0, 1 << 32, 1000).astype("<u4")
    for unit in ("bit", "byte"):
        assert (planes.from_planes(planes.to_planes(ids, unit), 1000, unit) == ids).all()
    path = tmp_path / "x.ids"
    with path.open("wb") as f:
        w = planes.Writer(f, planes.Format(block=64))
        w.add(1, ids.tobytes())
        w.close()
    with path.open("rb") as f:
        assert (planes.Reader(f, path.stat().st_size).ids(100, 333) == ids[100:433]).all()


def test_empty_token_files(empty):
    files = planes.write_token_files(empty, vocabulary("word_bpe_49k.json"), 1)
    assert planes.read_token_files(files).count() == 0


def test_pieces(docs):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=vocabulary("piece_bpe_32k.model"))
    model = pieces.Pieces(vocabulary("piece_bpe_32k.model"), most_words=5)
    texts = [t for _, t in pairs(docs)] + ["▁a▁▁b", "🙂 中文 ́", "<0x41></s>"]
    for t, ids in zip(texts, model.encode(texts), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == (sp.encode(t) if t else [])
        assert model.decode(ids) == (sp.decode(sp.encode(t)) if t else "")


def test_fingerprints(docs, empty):
    rows = sorted(pairs(docs), key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    want = []
    for k, (i, t) in enumerate(rows):
        t, nxt = t or "", rows[(k + 1) % len(rows)][1] or ""
        n = len(t) // 4
        want.append((i, len(t), hashlib.sha256((t[: len(t) - n] + nxt[:n]).encode()).hexdigest()))
    got = fingerprints.compare_with_edits(docs).collect()
    assert order((r.doc_id, r.n_chars, r.edited_sha256) for r in got) == order(want)
    by_text = {r.doc_id: r.fingerprint for r in got}
    assert by_text[3] == by_text[7] and all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got)
    assert fingerprints.compare_with_edits(empty).count() == 0


def test_syncmers():
    text, o = prose(8), fingerprints.Syncmers()
    at, _ = fingerprints.anchors(text, o)
    data = text.encode()
    inner = [int(fingerprints._runs(data[i : i + o.s], o.s)[0]) for i in range(len(data) - o.s + 1)]
    span = o.k - o.s + 1
    assert at.tolist() == [i for i in range(len(data) - o.k + 1) if min(inner[i : i + span]) in (inner[i], inner[i + span - 1])]


def test_warc(spark):
    rows = [(5, "u\n", "é" * 100), (3, None, "é" * 100), (None, "z", "é" * 100), (7, "a", None), (8, "b", "x"), (9, "b", "x"), (2, "w", "\r\n\r\nWARC/1.1\r\n" * 20)]
    pages = spark.createDataFrame([(*r, "c") for r in rows], "page_id long, url string, html string, digest string")
    got = {r.page_id: r for r in warc.read_archives(warc.write_archives(pages)).collect()}
    assert len(got) == len(rows)
    for i, _, html in rows:
        payload = (html or "").encode()
        assert got[i].payload_bytes == len(payload) and got[i].payload_digest == hashlib.sha256(payload).hexdigest()
        assert (got[i].record_type, got[i].refers_to) == (("revisit", 3) if i in (5, None) else ("response", None))
        assert got[i].record_type == "revisit" or bytes(got[i].payload) == payload
    assert warc.read_archives(warc.write_archives(pages.limit(0))).count() == 0


def test_toxicity(spark):
    bad = ["idiot", "moron", "scumbag"]
    texts = [prose(i, 60) + (f" you {bad[i % 3]} {bad[(i + 1) % 3]} " if i % 2 else " ") + prose(1000 + i, 40) for i in range(400)]
    model = toxicity.fit(texts, [i % 2 for i in range(400)], toxicity.Settings(least_texts=3))
    fresh = [prose(5000 + i, 80) + (" you idiott morron " if i % 2 else "") for i in range(40)]
    hit = toxicity.score_texts(fresh, model, {}) >= 0.5
    assert (hit == np.array([bool(i % 2) for i in range(40)])).mean() >= 0.9
    df = spark.createDataFrame([(1, texts[1]), (1, texts[1]), (2, None), (None, ""), (4, texts[3])], "doc_id long, text string")
    got = toxicity.score_toxicity(df, model).collect()
    assert len(got) == 5 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    one = toxicity.fit([], [])
    assert 0 <= toxicity.score_texts(["a"], one, {})[0] < 0.5


def test_toxicity_without_rows(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    assert toxicity.training_rows(docs, labels, toxicity.Settings()) == ([], [], None)
