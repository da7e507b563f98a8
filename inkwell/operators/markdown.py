"""Cleaning of page text; only texts with brackets leave native expressions."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import brackets, kernels
from ..functions.text import merge_diacritics, off_tables, strip_italics


@F.arrow_udf(T.StringType())
def _clean(texts: pa.Array) -> pa.Array:
    return kernels.mapped(texts, brackets.clean, pa.string())


@F.arrow_udf(T.StringType())
def _clean_lines(texts: pa.Array) -> pa.Array:
    return kernels.mapped(texts, brackets.clean_lines, pa.string())


def clean_brackets(c: Column) -> Column:
    """Hats, parenthesised indexes, and two or more adjacent non-numeric brackets."""
    some = c.contains("[")
    return F.when(some, _clean(F.when(some, c))).otherwise(c)


def clean_markdown(c: Column) -> Column:
    """Italics, and in lines off pipe tables diacritics and brackets."""
    plain = off_tables(strip_italics(c), merge_diacritics)
    some = plain.contains("[")
    return F.when(some, _clean_lines(F.when(some, plain))).otherwise(plain)
