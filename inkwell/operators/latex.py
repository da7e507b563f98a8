"""LaTeX stages that need a parser, one Arrow hop each."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import kernels, macros
from ..functions.omml import omml_to_latex as omml_to_latex
from ..functions.text import squeeze_blank_lines, strip_comment_environments, strip_line_comments


@F.arrow_udf(T.StringType())
def _strip_around_literals(texts: pa.Array) -> pa.Array:
    return kernels.mapped(texts, kernels.strip_comments, pa.string())


def strip_comments(c: Column | str) -> Column:
    """Comments outside literal passages.  Only texts that may have such a passage
    need the parser; the others stay in native expressions."""
    c = F.col(c) if isinstance(c, str) else c
    literal = c.rlike(r"\\verb|\\begin\{(?:" + "|".join(kernels.VERBATIM) + r")\}")
    return F.when(literal, _strip_around_literals(F.when(literal, c))).otherwise(strip_line_comments(strip_comment_environments(c)))


EXPANDED = T.StructType([T.StructField("text", T.StringType()), T.StructField("notes", T.ArrayType(T.StringType()))])
ARROW_EXPANDED = pa.struct([("text", pa.string()), ("notes", pa.list_(pa.string()))])


def cleaner(comments: bool = True, expand: bool = True, keep_packages: bool = False) -> Callable[[str | None], tuple[str | None, list[str]]]:
    """What gives a text without comments, its macros expanded, and the macro stage's notes."""

    def clean(text: str | None) -> tuple[str | None, list[str]]:
        text = kernels.strip_comments(text) if comments else text
        return macros.expand_with_notes(text, keep_packages) if expand else (text, [])

    return clean


def text_stages(c: Column, comments: bool = True, expand: bool = True, keep_packages: bool = False) -> Column:
    """text and notes of the stages that look at nothing but the text, in one hop: comments
    go, macro definitions are harvested, removed and expanded, with notes on what was left
    (``runaway:name``, ``overlong:name``).  Texts without a backslash have no literal passage
    and no macro, and stay in native expressions."""
    none = F.array().cast("array<string>").alias("notes")
    if not expand:
        return F.struct((strip_comments(c) if comments else c).alias("text"), none)
    clean = cleaner(comments, expand, keep_packages)

    @F.arrow_udf(EXPANDED)
    def run(texts: pa.Array) -> pa.Array:
        return kernels.mapped(texts, lambda t: dict(zip(("text", "notes"), clean(t), strict=True)), ARROW_EXPANDED)

    some = c.contains("\\")
    plain = F.struct(squeeze_blank_lines(strip_line_comments(c) if comments else c).alias("text"), none)
    return F.when(some, run(F.when(some, c))).otherwise(plain)


def macro_stage(c: Column, keep_packages: bool = False) -> Column:
    """text and notes of the macro stage alone."""
    return text_stages(c, comments=False, keep_packages=keep_packages)


def expand_macros(c: Column, keep_packages: bool = False) -> Column:
    """Definitions harvested, removed and expanded."""
    return macro_stage(c, keep_packages)["text"]


def macro_notes(c: Column) -> Column:
    """Notes on macros that ``expand_macros`` leaves in place."""
    return macro_stage(c)["notes"]


MACRO = T.StructType([T.StructField("name", T.StringType()), T.StructField("arity", T.IntegerType()), T.StructField("default", T.StringType()), T.StructField("body", T.StringType())])


@F.pandas_udf(T.ArrayType(MACRO))
def harvested(texts):
    """The macros that a text defines, by name."""
    return texts.map(lambda t: [{"name": m.name, "arity": m.arity, "default": m.default, "body": m.body} for _, m in sorted(kernels.harvest(t or "")[0].items())])
