"""Fill-in-the-middle: brute force, round trips and edge cases."""

import hashlib
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

import regex
from inkwell.llm import middle, queries

LINES = regex.compile(middle.Settings().unit)


def plainly(doc_id, text):
    """The contract, step by step."""
    text = text or ""
    lines = re.findall(r"[^\n]*\n|[^\n]+", text)
    digest = hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    n = len(lines)
    low, high = min(h[0] % (n + 1), h[1] % (n + 1)), max(h[0] % (n + 1), h[1] % (n + 1))
    p, m, s = "".join(lines[:low]), "".join(lines[low:high]), "".join(lines[high:])
    if not text or re.search("<[PSM]>", text):
        return n, "plain", None, None, text
    if h[3] % 100 < 50:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


ROWS = [(i, t) for i, t in enumerate(["one\ntwo\nthree", "", None, "\n", "\n\n\n", "a <P> b\nc", "<S>", "x<M>\n", "né\n😀 two\r\nthree\n", "no end", "<\n<P\nS>\n", "long line " * 30_000 + "\n" + "y\n" * 20_000])] + [(None, "a\nb"), (7, "same\nrows\n"), (7, "same\nrows\n")]


def test_rows_as_by_hand(spark):
    df = spark.createDataFrame([(*r, "z", 1, "w") for r in ROWS], "doc_id long, text string, output string, n int, form string").repartition(3)
    made = middle.fill_in_middle(df)
    got = made.withColumn("back", middle.restored("output", "form")).collect()
    want = [(i, *plainly(i, t), hashlib.sha256(plainly(i, t)[-1].encode()).hexdigest(), t or "") for i, t in ROWS]
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)


def test_empty_table_and_string_ids(spark):
    assert not middle.fill_in_middle(spark.createDataFrame([], "doc_id long, text string")).collect()
    r = middle.fill_in_middle(spark.createDataFrame([("k", "a\nb\n")], "doc_id string, text string")).first()
    assert (r.n, r.form, r.prefix_chars, r.middle_chars, r.output) == plainly("k", "a\nb\n")


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from("ab<>PSM\né😀\r "), max_size=60), st.integers(-5, 5000))
def test_round_trip(text, doc_id):
    s = middle.Settings()
    n, form, a, b, output = middle.rearrange(text, str(doc_id), s, LINES)
    assert (n, form, a, b, output) == plainly(doc_id, text)
    assert middle.put_back(output, form, s) == text


def test_settings():
    s = middle.Settings(unit=r"\S+", percent=30, spm_percent=0, prefix="[pre]", suffix="[suf]", middle="[mid]")
    unit = regex.compile(s.unit)
    text = "  some words that end  here  "
    made = [middle.rearrange(text, str(i), s, unit) for i in range(500)]
    forms = [m[1] for m in made]
    assert set(forms) == {"plain", "psm"} and 100 < forms.count("psm") < 200
    assert all(middle.put_back(m[-1], m[1], s) == text and m[0] == 5 for m in made)
    for bad in ({"prefix": ""}, {"prefix": "<S"}, {"middle": "M<"}, {"suffix": "<P>"}):
        with pytest.raises(ValueError):
            middle.Settings(**bad)


def test_query_equals_sql(spark, tmp_path):
    import duckdb

    spark.createDataFrame([(i, t) for i, t in ROWS], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    with duckdb.connect() as c:
        c.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
        want = c.execute(f"SELECT {', '.join(OUT)} FROM ({middle.oracle()})").fetchall()
    got = queries.op13_fill_in_middle(spark, str(tmp_path)).select(*OUT).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)


OUT = ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256"]
