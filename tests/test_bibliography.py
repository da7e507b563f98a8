"""Bibliographies: results on odd texts, and how much work their plans ask for."""

import re

from inkwell.operators import bibliography as B
from inkwell.plans.cleaning import clean_latex
from inkwell.plans import queries as Q

DATA = "/root/testdata/sf0.001"
DOCS = [
    (1, "\\cite{b, a}\\cite{ b ,\tc}\n\\bibliography{x} and \\addbibresource{y}."),
    (2, "\\cite{a} without a command"),
    (3, "nothing cited \\bibliography{x}"),
    (4, "\\cite{zz,,a}\\bibliographystyle{plain}\n\\bibliography{x}\\bibliography{x}"),
    (5, None),
]


def entries(spark):
    rows = [(0, 0, k, "misc", {"author": f"old {k}"}) for k in "ab"] + [(1, 0, k, "misc", {"author": f"new {k}"}) for k in "abc"]
    return spark.createDataFrame(rows, "file_ord int, entry_no int, key string, kind string, fields map<string,string>")


def block(*keys):
    items = "".join(f"\\bibitem{{{k}}}\nnew {k}.\n\n" for k in keys)
    return f"\\begin{{thebibliography}}{{{len(keys)}}}\n\n{items}\\end{{thebibliography}}"


def test_shared_and_own_entries_give_the_same_blocks(spark):
    docs = spark.createDataFrame(DOCS, "doc_id int, content string")
    shared = entries(spark)
    own = docs.select("doc_id").crossJoin(shared)
    first = f"\\cite{{b, a}}\\cite{{ b ,\tc}}\n{block('b', 'a', 'c')} and ."
    want = {1: first, 2: DOCS[1][1], 3: DOCS[2][1], 4: f"\\cite{{zz,,a}}{block('a')}", 5: None}
    for e in (shared, own):
        assert {r.doc_id: r.content for r in B.inline_bibliography(docs, e).collect()} == want


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_keys_are_ordered_without_a_window(spark):
    docs = spark.createDataFrame(DOCS, "doc_id int, content string")
    ordered = B.citation_order(docs)
    assert "Window" not in plan(ordered) and "Exchange" not in plan(ordered)
    assert [(r.key, r.ord) for r in ordered.where("doc_id = 1").orderBy("ord").collect()] == [("b", 1), ("a", 2), ("c", 3)]


def test_an_entry_is_written_once_and_a_text_read_once(spark):
    found = plan(Q.bib_inline(spark, DATA))
    # Behind the join with the citations, nothing is made of an entry's fields any more.
    join = next(x for x in re.finditer(r"Join \[key#", found))
    assert "author" not in found[: join.start()] and "author" in found[join.start() :]
    assert "Filter CASE" not in found


def test_a_text_is_flattened_once(spark):
    assert "_flattened" not in plan(Q.full_pipeline_bib(spark, DATA))


def test_documents_with_and_without_files(spark):
    docs = spark.createDataFrame([(1, "own"), (2, "own % gone"), (3, "\\def\\r{\\r}\\r{}"), (4, None)], "doc_id int, content string")
    files = spark.createDataFrame([(1, "main.tex", "\\def\\q{\\q}\\input{a} \\input{b}", True), (1, "a.tex", "x % y", False)], "root_dir int, rel_path string, content string, is_root boolean")
    got = {r.doc_id: (r.content, r.diagnostics) for r in clean_latex(docs, files=files, entries=entries(spark), diagnostics=True).collect()}
    assert got[1][1] == ["not-found:b", "runaway:q"]
    assert got[2] == ("own", []) and got[3][1] == ["runaway:r"] and got[4][0] is None


def test_ready_blocks_need_no_window_either(spark):
    found = plan(Q.bbl_priority(spark, DATA))
    assert "Window" not in found and "Filter CASE" not in found


def test_cited_lines_of_a_large_table_are_dealt_over_more_tasks(spark, monkeypatch):
    few = Q.bbl_priority(spark, DATA)
    monkeypatch.setattr(Q, "TASK_ROWS", 500)
    n = -(-Q.read(spark, DATA, "lineitem").count() // 500)
    many = Q.bbl_priority(spark, DATA)
    # Every reading of the lines has its own tasks, and joins of documents take them over.
    made = plan(many)
    assert n > 4 and made.count(f", {n}), REPARTITION_BY_NUM") == 4 and not re.search(r"hashpartitioning\((l_orderkey|doc_id)#\d+L?, 4\)", made)
    assert sorted(many.collect()) == sorted(few.collect())
