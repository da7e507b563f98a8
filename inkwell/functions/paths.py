"""Paths below a folder, natively."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def folder_of(path: Column) -> Column:
    """The path of the folder that holds a file; empty at the top."""
    return F.regexp_replace(F.regexp_extract(path, r"^(.*/)?[^/]*$", 1), "/$", "")


def below(folder: Column, name: Column) -> Column:
    """``name`` seen from ``folder``, without steps up and down; null where it leads
    out above the top."""
    parts = F.split(F.concat(folder, F.lit("/"), name), "/")
    out = F.lit("..")  # once above the top, always so
    step = lambda acc, x: (
        F.when(x.isin("", ".") | (F.get(acc, F.lit(0)) == out), acc)
        .when((x == "..") & (F.size(acc) == 0), F.array(out))
        .when(x == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))))
        .otherwise(F.concat(acc, F.array(x)))
    )
    made = F.aggregate(parts, F.array().cast("array<string>"), step)
    return F.when(F.get(made, F.lit(0)) == out, None).otherwise(F.array_join(made, "/"))


def extension(path: Column) -> Column:
    """The lower-cased extension; empty where the name has no dot."""
    return F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))
