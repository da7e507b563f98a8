"""The registered queries of the training-data operators: whole tables, production
parameters, and the columns that each query promises."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import fingerprints, licenses, middle, negatives, packing, pieces, planes, quality, similar, substrings, templates, toxicity, warc
from .shared import table

def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


Query = Callable[[SparkSession, str], DataFrame]


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality.score_quality(docs, quality.CLASSES_JUDGED).select("doc_id", *quality.BASE)


def op3_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = warc.write_archives(table(spark, sf_dir, "pages"))
    return warc.read_archives(files).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


#: DuckDB has SHA-256 of text; lengths of text in bytes come from its encoding.
OP3_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes FROM pages),
g AS (SELECT h, min(page_id) AS original FROM p WHERE payload_bytes >= 100 GROUP BY h)
SELECT page_id, payload_bytes, sha256(p.h) AS payload_digest,
  CASE WHEN g.original IS NULL OR g.original = page_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN g.original <> page_id THEN g.original END AS refers_to
FROM p LEFT JOIN g USING (h)"""


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, settings = table(spark, sf_dir, "documents"), toxicity.Settings()
    texts, toxic, share = toxicity.training_rows(docs, table(spark, sf_dir, "labels"), settings)
    return toxicity.score_toxicity(docs, toxicity.fit(texts, toxic, settings, share))


def op10_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.compare_with_edits(table(spark, sf_dir, "documents"))


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), 2, with_ids=False).drop("ids")


def op5_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar.similar_components(table(spark, sf_dir, "documents"))


def op6_line_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = templates.drop_templates(table(spark, sf_dir, "documents").select("doc_id", "text"), templates.EVERY_LINE)
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.encode("text", "UTF-8"), 256).alias("text_sha256"))


def op7_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substrings.remove_repeats(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode_texts(table(spark, sf_dir, "documents"), vocabulary("piece_bpe_32k.model")).drop("ids")


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = planes.write_token_files(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"), 1)
    return planes.read_token_files(files)


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = negatives.relabelled(table(spark, sf_dir, "embeddings"))
    return negatives.mine_negatives(vectors, F.col("vec_id") % 100 == 0)


def op12_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(table(spark, sf_dir, "documents")).withColumn("n_spans", F.size("spans")).drop("spans")


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = middle.fill_in_middle(table(spark, sf_dir, "documents"))
    text = middle.restored("output", "form")
    return made.select(*[c for c in made.columns if c != "output"], F.sha2(F.encode(text, "UTF-8"), 256).alias("restored_sha256"))


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in (op1_quality_rules, op2_best_fit_packing, op3_warc_revisits, op4_toxicity, op5_ngram_jaccard, op6_line_templates, op7_suffix_array_dedup, op8_sentencepiece, op9_token_files, op10_fingerprints, op11_hard_negatives, op12_license_scan, op13_fill_in_middle)}


def oracle_sql() -> dict[str, str]:
    return {"op1_quality_rules": quality.oracle(quality.CLASSES_JUDGED), "op3_warc_revisits": OP3_SQL, "op11_hard_negatives": negatives.oracle(), "op13_fill_in_middle": middle.oracle()}
