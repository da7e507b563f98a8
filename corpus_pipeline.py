"""The corpus pipeline: raw documents to packed training sequences in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; its result is written
and read again as the next stage's documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkwell.llm import packing, quality, similar, substrings, templates
from inkwell.llm.queries import vocabulary
from inkwell.llm.shared import delete, passing, shared_dir, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep.  Null and empty texts have no words and go;
    repeated rows are judged alike; an empty table stays empty."""
    return quality.keep_quality(docs, quality.CLASSES_JUDGED)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without lines whose template recurs in a few texts; the first of
    them and its copies keep theirs.  Null and empty texts stay, as do rows without an
    id; an empty table stays empty."""
    return templates.drop_templates(docs, templates.FEW_TEXTS, counts=False)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest doc_id of each group of similar documents: shingles of five words,
    linked from a similarity of 0.8 on.  Texts without words, null ones too, and rows
    without an id are in no group and stay; rows that repeat an id stay or go together;
    an empty table stays empty."""
    groups = similar.similar_components(docs, similar.Likeness(words=5, percent=80))
    first = groups.where("doc_id = component_id OR doc_id IS NULL").select(F.col("doc_id").alias("first")).distinct()
    rows = docs.select(F.struct("*").alias("own"))  # its columns' names stay apart
    kept = rows.join(first.hint("shuffle_merge"), F.col("own.doc_id").eqNullSafe(F.col("first")), "left_semi")
    return kept.select("own.*")


def suffix_array_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the bytes of passages that earlier ones hold.  What a
    cut through a character leaves of it is dropped.  Null texts stay null; rows without
    an id lose nothing; rows that repeat an id lose nothing to each other; an empty
    table stays empty.  An id that is no whole number is an error."""
    return substrings.without_repeats(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document's tokens, packed into sequences.  A null or empty text is its end
    token; repeated rows are packed each for itself; an empty table gives no row."""
    return packing.pack_documents(docs, vocabulary("byte_bpe_50k.json"), 2)


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("near_duplicates", near_duplicates),
    ("suffix_array_dedup", suffix_array_dedup),
    ("best_fit_packing", best_fit_packing),
]

#: Tokenizing and packing have no form in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to ``documents``.  A stage's folders are deleted once the next
    stage has been written."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        path = shared_dir(spark, f"stage-{name}")
        with passing(spark):
            stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            delete(spark, before)
        before = path
    return docs
