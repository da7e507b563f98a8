"""Scans and sinks of text files."""

from __future__ import annotations

import codecs

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.kernels import parse_bibtex
from ..functions.text import universal_newlines


#: The encodings that Spark knows, by Python's names.
NATIVE = {"iso8859-1": "ISO-8859-1", "ascii": "US-ASCII", "utf-16": "UTF-16", "utf-16-be": "UTF-16BE", "utf-16-le": "UTF-16LE", "utf-8": "UTF-8"}


def decoded(content: Column, encoding: str) -> Column:
    """Bytes as text; natively where Spark knows the encoding."""
    known = NATIVE.get(codecs.lookup(encoding).name)
    if known:
        return F.decode(content, known)

    @F.pandas_udf(T.StringType())
    def decode(values):
        return values.map(lambda b: b.decode(encoding), na_action="ignore")

    return decode(content)


def read_files(spark: SparkSession, path: str, encoding: str = "utf-8") -> DataFrame:
    """path and content of every file below ``path``, line ends made uniform."""
    if encoding.lower() in ("utf-8", "utf8"):
        raw = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("content"))
    else:
        raw = spark.read.format("binaryFile").load(path).select("path", decoded(F.col("content"), encoding).alias("content"))
    return raw.withColumn("content", universal_newlines(F.col("content")))


def read_binary(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select("path", "content")


def kind_of(path: Column) -> Column:
    """pdf, docx or pptx by the lower-cased extension; anything else is LaTeX."""
    ext = F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))
    return F.when(ext.isin("pdf", "docx", "pptx"), ext).otherwise("tex")


ENTRY = T.StructType([T.StructField("key", T.StringType()), T.StructField("kind", T.StringType()), T.StructField("fields", T.MapType(T.StringType(), T.StringType()))])


@F.pandas_udf(T.ArrayType(ENTRY))
def _entries(texts):
    return texts.map(lambda t: [{"key": k, "kind": e, "fields": f} for k, e, f in parse_bibtex(t or "")])


def bib_entries(files: DataFrame) -> DataFrame:
    """root_dir, bib_path, entry_no, key, kind and fields of each entry in ``files``
    (root_dir, bib_path, content).  A null or empty content has no entry."""
    found = files.select("root_dir", "bib_path", F.posexplode(_entries("content")).alias("entry_no", "entry"))
    return found.select("root_dir", "bib_path", "entry_no", "entry.key", "entry.kind", "entry.fields")


def write_clean(docs: DataFrame, path: str) -> None:
    docs.write.mode("overwrite").parquet(path)
