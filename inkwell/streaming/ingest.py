"""Stateless ingest: files that arrive are cleaned batch by batch.

An addition: there is no streaming to match.
"""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.text import universal_newlines
from ..operators import latex


def clean_arrivals(spark: SparkSession, source: str, target: str, checkpoint: str) -> StreamingQuery:
    """Every new text file below ``source``, cleaned of comments and macros, as Parquet."""
    arrived = spark.readStream.format("text").option("wholetext", True).load(source)
    content = latex.expand_macros(latex.strip_comments(universal_newlines(F.col("value"))))
    cleaned = arrived.select(F.col("_metadata.file_path").alias("path"), content.alias("content"))
    return cleaned.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
