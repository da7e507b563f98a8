"""One channel for what a stage could not do: an array of code and detail.

Codes: ``cycle``, ``not-found`` and ``unreadable`` of includes, ``runaway`` and
``overlong`` of macros and includes, ``missing-bib``, ``missing-summary``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

TYPE = "array<struct<code: string, detail: string>>"
CODES = ("cycle", "not-found", "unreadable", "runaway", "overlong", "missing-bib", "missing-summary")


def none() -> Column:
    return F.array().cast(TYPE)


def parsed(told: Column) -> Column:
    """Texts such as ``cycle:main`` as notes."""
    return F.transform(told, lambda x: F.struct(F.substring_index(x, ":", 1).alias("code"), F.regexp_replace(x, "^[^:]*:", "").alias("detail")))


def texts(notes: Column) -> Column:
    """Notes as texts such as ``cycle:main``, sorted."""
    return F.array_sort(F.transform(notes, lambda n: F.concat(n["code"], F.lit(":"), n["detail"])))


def observed(docs: DataFrame, observation: Observation) -> DataFrame:
    """``docs``, whose notes are counted by code while they are written."""
    count = lambda code: F.coalesce(F.sum(F.size(F.filter("notes", lambda n: n["code"] == code))), F.lit(0)).alias(code)
    return docs.observe(observation, *map(count, CODES))
