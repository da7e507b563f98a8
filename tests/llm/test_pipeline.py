"""The corpus pipeline, stage by stage, against brute-force versions."""

import pytest

import corpus_pipeline
from inkwell.llm import quality, templates

import test_substrings
import test_templates
from test_operators import prose

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def documents():
    long = " ".join(prose(50, 70).split() * 1)
    base = [prose(i, 120) for i in range(12)]
    near = " ".join(w if k != 60 else "changed" for k, w in enumerate(base[1].split()))
    rows = [(i, f"{t}\nAll rights are reserved by the {['owner', 'maker', 'author', 'seller'][i % 4]}") for i, t in enumerate(base)]
    rows += [(20, rows[0][1]), (21, rows[0][1]), (22, near), (23, f"{prose(60, 80)} {long} {prose(61, 60)}"), (24, f"{prose(62, 90)} {long}")]
    rows += [(30, None), (31, ""), (32, "two words"), (33, "#$% |&*< " * 90), (23, f"{prose(63, 100)}"), (24, f"{prose(62, 90)} {long}"), (None, prose(64, 90))]
    return [(i, t, "en", "src", len(t) if t is not None else None) for i, t in rows]


def stage(name):
    return dict(corpus_pipeline.STAGES)[name]


def ids(rows):
    return sorted((r[0] for r in rows), key=repr)


def test_stages_against_brute_force(spark, documents):
    docs = spark.createDataFrame(documents, SCHEMA).repartition(3)
    good = stage("quality_rules")(spark, docs, "")
    verdict = {(r.doc_id, r.text): r.kept for r in quality.score_quality(docs, quality.CLASSES_JUDGED).collect()}
    kept = [d for d in documents if verdict[d[:2]]]
    assert good.columns == docs.columns and sorted(map(tuple, good.collect()), key=repr) == sorted(kept, key=repr)
    assert ids(kept) == ids([d for d in documents if d[0] not in (30, 31, 32, 33)])

    lines = stage("line_dedup")(spark, good, "")
    now = test_templates.brute([d[:2] for d in kept], templates.FEW_TEXTS)
    assert lines.columns == docs.columns
    assert sorted(((r.doc_id, r.text, r.n_chars) for r in lines.collect()), key=repr) == sorted(((i, t, len(t)) for i, t in now), key=repr)
    assert sum("All rights" in t for _, t in now) < sum("All rights" in d[1] for d in kept)

    single = stage("near_duplicates")(spark, lines, "")
    sets = {}
    for i, t in now:
        w = t.lower().split()
        sets.setdefault(i, []).append({tuple(w[k : k + 5]) for k in range(len(w) - 4)})
    part = {i: i for i in sets if i is not None}
    alike = lambda a, b: any(x and y and 100 * len(x & y) >= 80 * len(x | y) for x in sets[a] for y in sets[b])
    for _ in range(4):
        for a in part:
            for b in part:
                if alike(a, b):
                    part[a] = part[b] = min(part[a], part[b])
    left = [(i, t) for i, t in now if i is None or part[i] == i]
    assert sorted(((r.doc_id, r.text) for r in single.collect()), key=repr) == sorted(left, key=repr)
    assert not {20, 21, 22} & {i for i, _ in left}

    clean = stage("suffix_array_dedup")(spark, single, "")
    cut = test_substrings.brute([r for r in left if r[0] is not None]) + [(i, t.encode()) for i, t in left if i is None]
    assert sorted(((r.doc_id, r.text.encode()) for r in clean.collect()), key=repr) == sorted(cut, key=repr)
    assert sum(len(t) for _, t in cut) < sum(len(t.encode()) for _, t in left)

    packed = stage("best_fit_packing")(spark, clean, "").collect()
    assert ids(r for r in packed if not r.piece) == ids(cut)
    assert {sum(r.length for r in packed if r.sequence_id == s) <= 1024 for s in {r.sequence_id for r in packed}} == {True}


def test_run_over_a_folder(spark, documents, tmp_path):
    spark.createDataFrame(documents, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    rows = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in rows} == {i for i in (*range(12), 23, 24, None)}


def test_empty_tables_and_other_columns(spark, documents):
    for docs in spark.createDataFrame([], SCHEMA), spark.createDataFrame([(*d, "a", "b", "c") for d in documents], SCHEMA + ", first string, own string, _first string"):
        for name, f in corpus_pipeline.STAGES[:-1]:
            out = f(spark, docs, "")
            assert out.columns == docs.columns, name
            assert (out.count() > 0) == (docs.count() > 0)
        assert (corpus_pipeline.STAGES[-1][1](spark, docs, "").count() > 0) == (docs.count() > 0)


NAMES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "class_distance", "word_distance", "base_failed", "kept", "row", "n_lines", "n_dropped", "id", "hash", "drop", "spans", "changed", "first", "_quality_text", "_quality_row", "a.b", "doc", "r"]


def test_columns_of_any_name_come_through_every_stage(spark, documents):
    docs = spark.createDataFrame([(*d, *(f"{n}{d[0]}" for n in NAMES)) for d in documents], SCHEMA + "".join(f", `{n}` string" for n in NAMES)).repartition(3)
    for name, f in corpus_pipeline.STAGES[:-1]:
        out = f(spark, docs, "")
        assert out.columns == docs.columns, name
        rows = out.collect()
        assert rows and all(r[n] == f"{n}{r.doc_id}" for r in rows for n in NAMES), name
        docs = out
    assert corpus_pipeline.STAGES[-1][1](spark, docs, "").count()
