"""Repeated ids, wordless texts, other id types and plain libraries."""

import hashlib
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from inkwell.llm import fingerprints, packing, pieces, planes, quality, shared, similar, substrings, tokens, toxicity, warc
from inkwell.llm.queries import vocabulary

from test_operators import prose


def test_repeated_ids_join_their_components(spark):
    a, b, c = prose(1), prose(2), prose(3)
    rows = [(3, a), (5, a), (5, b), (8, b), (9, c), (9, ""), (9, None), (7, c), (10, ""), (None, a)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = [(r.doc_id, r.component_id) for r in similar.similar_components(df).collect()]
    want = {3: 3, 5: 3, 8: 3, 9: 7, 7: 7, 10: 10, None: None}
    assert sorted(got, key=repr) == sorted(((i, want[i]) for i, _ in rows), key=repr)


@pytest.mark.parametrize("opts", [similar.Likeness(crowd=4, share=5, near=3), similar.Likeness(crowd=1000, near=2), similar.Likeness(crowd=2, share=2)])
def test_family_of_near_copies(spark, opts):
    base = prose(11, 200).split()
    rng = np.random.default_rng(4)
    rows = []
    for i in range(60):
        words = list(base)
        for k in rng.choice(len(words), rng.integers(0, 9), replace=False):
            words[k] = f"w{rng.integers(1 << 30)}"
        rows.append((100 - i, " ".join(words)))
    sets = {i: {tuple(w[k : k + 4]) for w in [t.split()] for k in range(len(w) - 3)} for i, t in rows}
    part = {i: i for i in sets}
    for _ in range(8):
        for x in sets:
            for y in sets:
                if 100 * len(sets[x] & sets[y]) >= 85 * len(sets[x] | sets[y]):
                    part[x] = part[y] = min(part[x], part[y])
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert {(r.doc_id, r.component_id) for r in similar.similar_components(df, opts).collect()} == set(part.items())
    assert 1 < len(set(part.values())) < 60


def test_string_ids(spark):
    rows = [("b", prose(1)), ("a", prose(1)), ("c", None)]
    df = spark.createDataFrame(rows, "doc_id string, text string")
    assert {(r.doc_id, r.component_id) for r in similar.similar_components(df).collect()} == {("a", "a"), ("b", "a"), ("c", "c")}
    assert {r.doc_id for r in packing.pack_documents(df, vocabulary("byte_bpe_50k.json"), 2).collect()} == {"a", "b", "c"}
    files = planes.write_token_files(spark.createDataFrame([(1, "x")], "doc_id int, text string"), vocabulary("word_bpe_49k.json"), 1)
    assert planes.read_token_files(files, "int").first().doc_id == 1


def test_toxicity_of_wordless_texts(spark):
    for texts, labels in (["", None], [0, 1]), ([" ", "a b"], [1, 0]):
        assert 0 <= toxicity.score_texts(["a", None, ""], toxicity.fit(texts, labels), {}).min() <= 1
    docs = spark.createDataFrame([(i, prose(i % 7, 30)) for i in range(40)] + [(40, None), (3, prose(90, 30))], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(41)], "doc_id long, toxic int")
    texts, toxic, share = toxicity.training_rows(docs, labels, toxicity.Settings())
    assert len(texts) == len(set(texts)) == len(toxic) and 0 < share < 1 and set(texts) <= {None, prose(90, 30), *(prose(i, 30) for i in range(7))}
    few, _, _ = toxicity.training_rows(docs, labels, toxicity.Settings(max_chars=sum(len(t or "") for t in texts[:3])))
    assert few == texts[:3]


def test_toxicity_of_held_out_labels(spark):
    top = Path("/root/testdata/sf0.1")
    if not top.exists():
        pytest.skip("no tables here")
    docs, labels = (spark.read.parquet(f"{top}/{t}.parquet") for t in ("documents", "labels"))
    settings = toxicity.Settings()
    texts, toxic, share = toxicity.training_rows(docs, labels, settings)
    scored = toxicity.score_toxicity(docs, toxicity.fit(texts, toxic, settings, share))
    got = scored.where("held_out").join(labels.select("doc_id", "toxic"), "doc_id").select("score", "toxic").toPandas()
    rank = got.score.rank()
    bad = got.toxic == 1
    auc = (rank[bad].sum() - bad.sum() * (bad.sum() + 1) / 2) / (bad.sum() * (~bad).sum())
    assert bad.sum() > 10 and auc > 0.85


def test_encode_texts_in_spark(spark):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=vocabulary("piece_bpe_32k.model"))
    texts = [None, "", " ", "a  b", prose(1, 3000), "中文 é ✓", "x" * 3000]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate([*texts, texts[4]])], "doc_id long, text string, ids string")
    got = {r.doc_id: r for r in pieces.encode_texts(df, vocabulary("piece_bpe_32k.model")).collect()}
    assert len(got) == len(texts) + 1
    for i, t in enumerate([*texts, texts[4]]):
        ids = sp.encode(t) if t else []
        assert np.frombuffer(got[i].ids, "<u4").tolist() == ids and got[i].n_tokens == len(ids) and got[i].ids_crc32 == zlib.crc32(got[i].ids)
    assert pieces.encode_texts(df.limit(0), vocabulary("piece_bpe_32k.model")).count() == 0


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_encoder_against_the_plain_library(name):
    from tokenizers import Tokenizer

    plain, enc = Tokenizer.from_file(vocabulary(name)), tokens.Encoder(vocabulary(name))
    rng, letters = np.random.default_rng(2), list("ab eé'’.,!?12²\n  stremlvdªµ×%İ<|>")
    texts = ["".join(rng.choice(letters, rng.integers(1, 60))) for _ in range(3000)]
    texts += ["<|endoftext|> a<|startoftext|>", " " * 3000 + "x", "a\n\nb  c", "I'll don't 's't those !'s", "a" * 5000, prose(3, 300_000), "\x01 \x02a", "a\tb"]
    for t in texts:
        assert np.frombuffer(enc.encode(t), "<u4").tolist() == plain.encode(t, add_special_tokens=False).ids
    # A token's own string is that token, so merges by rank and whole-word look-ups agree.
    letter = {c: bytes([b]) for b, c in tokens._byte_letters().items()}
    for word, i in plain.get_vocab(with_added_tokens=False).items():
        if set(word.removesuffix("</w>")) <= set(letter) and (name[0] == "b" or word.endswith("</w>")):
            assert [t.id for t in plain.model.tokenize(word.removesuffix("</w>"))] == [i]


def test_packing_against_the_plain_library(spark):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(vocabulary("byte_bpe_50k.json"))
    rows = [(i, prose(i, n)) for i, n in enumerate([5, 40, 200, 800, 3000, 60, 7, 900, 450, 300])] + [(50, None), (51, ""), (52, "x <|endoftext|> y"), (0, prose(0, 5))]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, ids string").repartition(4)
    got = packing.pack_documents(df, vocabulary("byte_bpe_50k.json"), 2).collect()
    ids_of = lambda t: (plain.encode(t, add_special_tokens=False).ids if t else []) + [2]
    want = []
    for i, t in rows:
        ids, at, k = ids_of(t), 0, 0
        size = len(ids) % 1024 or 1024
        while at < len(ids):
            part = np.array(ids[at : at + size], "<u4").tobytes()
            want.append((i, k, at, size, zlib.crc32(part)))
            at, size, k = at + size, 1024, k + 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == Counter(want)
    # Best fit of decreasing sizes needs at most 11/9 of the fewest sequences, and one.
    fewest = -(-sum(w[3] for w in want) // 1024)
    made = {r.sequence_id for r in got}
    assert len(made) <= fewest * 11 / 9 + 1
    for s in made:
        at = 0
        for r in sorted((r for r in got if r.sequence_id == s), key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 1024


def test_warc_with_repeated_page_ids(spark):
    long = "z" * 150
    rows = [(4, "u", long), (4, "u", long), (4, "v", long), (6, "u", long), (2, "u", "short"), (2, "u", "short")]
    pages = spark.createDataFrame([(*r, "c") for r in rows], "page_id long, url string, html string, refers_to string")
    got = [(r.page_id, r.record_type, r.refers_to) for r in warc.read_archives(warc.write_archives(pages)).collect()]
    assert sorted(got, key=repr) == sorted([(4, "response", None)] * 3 + [(6, "revisit", 4)] + [(2, "response", None)] * 2, key=repr)


def test_kept_by_the_rules_and_by_sql(spark):
    import duckdb

    rows = [(i, prose(i, n)) for i, n in enumerate([3, 49, 50, 79, 80, 400])] + [(20, "#$% |&*< " * 80), (21, "the cat sat " * 60), (22, None), (23, ""), (24, "AAAA 1234 " * 50 + prose(30, 60))]
    documents = spark.createDataFrame(rows, "doc_id long, text string")
    frame = documents.toPandas()  # noqa: F841  (read by name in the SQL)
    sql = quality.oracle().replace("FROM documents", "FROM frame")
    expected = {r[0]: r[1:] for r in duckdb.sql(sql).fetchall()}
    got = {r.doc_id: tuple(r[c] for c in quality.BASE) for r in quality.score_quality(documents).collect()}
    assert got == expected
    assert not got[20][-1] and not got[21][-1] and not got[22][-1]


def test_passing_folders_go(spark, tmp_path):
    df = spark.range(3)
    with shared.passing(spark):
        inside = shared.stored(df, "gone")
        path = inside.inputFiles()[0].removeprefix("file://").removeprefix("file:")
        assert inside.count() == 3 and Path(path).exists()
    assert not Path(path).parent.exists()
    assert shared.stored(df.where(F.col("id") > 0), "stays").count() == 2


def test_ordered_operators_take_ids_of_any_type(spark):
    rows = [(f"k{i:02}", prose(i, 20 + i)) for i in range(30)] + [(None, prose(99)), ("k05", "twice"), ("é", ""), ("Z", None)]
    df = spark.createDataFrame(rows, "doc_id string, text string").repartition(5)
    there = sorted(rows, key=lambda r: (r[0] is not None, (r[0] or "").encode(), r[1] or ""))
    enc, want, at = tokens.encoder(vocabulary("word_bpe_49k.json")), [], 0
    for i, t in there:
        ids = enc.encode(t) + (1).to_bytes(4, "little")
        want.append((i, at, len(ids) // 4, zlib.crc32(ids)))
        at += len(ids) // 4
    files = planes.write_token_files(df, vocabulary("word_bpe_49k.json"), 1)
    got = planes.read_token_files(files, "string").select("doc_id", "start", "n_tokens", "ids_crc32").collect()
    assert sorted(map(tuple, got), key=lambda r: r[1]) == want
    marks = {(r.doc_id, r.fingerprint, r.edited_sha256) for r in fingerprints.compare_with_edits(df).collect()}
    texts = [t or "" for _, t in there]
    edited = [t[: len(t) - len(t) // 4] + after[: len(t) // 4] for t, after in zip(texts, [*texts[1:], texts[0]], strict=True)]
    opts = fingerprints.Syncmers()
    assert marks == {(i, fingerprints.sketch(t, opts).hex(), hashlib.sha256(e.encode()).hexdigest()) for (i, _), t, e in zip(there, texts, edited, strict=True)}


def test_repeats_need_whole_numbers(spark):
    df = spark.createDataFrame([("a", "x")], "doc_id string, text string")
    for f in (substrings.remove_repeats, substrings.without_repeats):
        with pytest.raises(TypeError):
            f(df)


@pytest.mark.parametrize("rules", [quality.Rules(), quality.CLASSES_JUDGED, quality.Rules(min_class_words=60, max_class_distance=0.1)])
def test_the_oracle_follows_every_guard(spark, rules):
    import duckdb

    rows = [(i, " ".join(prose(i, 40 + i).split()[: 40 + i]) if i % 3 else "#$ %| " * i + prose(i, 60)) for i in range(70)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    documents = frame.toPandas()  # noqa: F841 - DuckDB reads it by its name
    want = {r[0]: r[1] for r in duckdb.sql(f"SELECT doc_id, kept FROM ({quality.oracle(rules)})").fetchall()}
    got = {r.doc_id: r.kept for r in quality.score_quality(frame, rules).collect()}
    assert got == want and len(set(got.values())) == 2


def test_the_tree_packs_as_best_fit_does(spark):
    rng = np.random.default_rng(5)
    for n, length in ((1, 16), (400, 64), (3000, 1024)):
        sizes = rng.integers(1, length, n)
        ids, _, parent, at, whole = packing.merged(rng.permutation(n), sizes, length)
        held = {}
        for i, p, a, w in zip(ids.tolist(), parent.tolist(), at.tolist(), whole.tolist(), strict=True):
            held.setdefault(p, []).append((a, w, i))
        assert len(held) == len(packing.best_fit(sizes.tolist(), length)) and all(min(x)[2] == p and min(x)[0] == 0 for p, x in held.items())
    for opts in (packing.Packing(length=64, full=60, fan_in=2), packing.Packing(length=64, full=64, fan_in=3, at_once=40)):
        many = [((origin << 31) | k, int(rng.integers(1, 60))) for origin in range(11) for k in range(rng.integers(0, 30))]
        size = dict(many)
        path = packing.merge_tree(spark.createDataFrame(many, "sequence long, size long").repartition(3), 11, opts).collect()
        assert {r.sequence for r in path} == set(size)
        into = {}
        for r in path:
            into.setdefault(r.parent, []).append((r.at, size[r.sequence]))
        for parts in into.values():
            ends = [0, *(a + n for a, n in sorted(parts))]
            assert [a for a, _ in sorted(parts)] == ends[:-1] and ends[-1] <= 64
        assert len(into) <= 1.12 * -(-sum(size.values()) // 64) + 2
