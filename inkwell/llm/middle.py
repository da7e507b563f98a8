"""Fill-in-the-middle: texts cut at unit ends and put in another order.

A batch's texts go through one pandas UDF.  The ends of a text's units (lines, unless
another pattern is given) are gathered in a compact array of offsets; the two cuts are
two lookups there, and three slices make the output.  Where the cuts fall, and which
form a text gets, follows from a digest of its id alone, so any run gives the same.
"""

from __future__ import annotations

import hashlib
from array import array
from dataclasses import dataclass

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Settings:
    """``unit``: pattern of the units, matched left to right; what no unit covers goes
    with the unit after it.  ``percent`` of the texts are rearranged, ``spm_percent`` of
    those with the suffix first.  ``seed`` stands before the id in what is digested."""

    unit: str = r"[^\n]*\n|[^\n]+"
    seed: str = "7:"
    percent: int = 100
    spm_percent: int = 50
    prefix: str = "<P>"
    suffix: str = "<S>"
    middle: str = "<M>"

    def __post_init__(self):
        marks = (self.prefix, self.suffix, self.middle)
        # A marker is found where it was put: none can begin in a text and end in a marker.
        if not all(marks) or any(m[0] in x[1:] for m in marks for x in marks) or any(a != b and marks[a].startswith(marks[b]) for a in range(3) for b in range(3)):
            raise ValueError("a marker must not be empty, start another or start inside one")


def ends_of_units(text: str, unit: regex.Pattern) -> array:
    return array("q", (m.end() for m in unit.finditer(text)))


def numbers(seed: str, doc_id: str) -> list[int]:
    """Four unsigned numbers of 32 bits from the digest of an id."""
    digest = hashlib.sha256(f"{seed}{doc_id}".encode("utf-8", "surrogatepass")).hexdigest()
    return [int(digest[k : k + 8], 16) for k in (0, 8, 16, 24)]


def rearrange(text: str, doc_id: str, s: Settings, unit: regex.Pattern) -> tuple:
    """n, form, prefix_chars, middle_chars, output of one text."""
    ends = ends_of_units(text, unit)
    n = len(ends)
    first, second, share, kind = numbers(s.seed, doc_id)
    if not text or any(m in text for m in (s.prefix, s.suffix, s.middle)) or share % 100 >= s.percent:
        return n, "plain", None, None, text
    low, high = sorted((first % (n + 1), second % (n + 1)))
    a, b = (ends[k - 1] if k else 0 for k in (low, high))
    before, between, after = text[:a], text[a:b], text[b:]
    if kind % 100 < s.spm_percent:
        return n, "spm", a, b - a, f"{s.suffix}{after}{s.prefix}{before}{s.middle}{between}"
    return n, "psm", a, b - a, f"{s.prefix}{before}{s.suffix}{after}{s.middle}{between}"


def put_back(output: str, form: str, s: Settings) -> str:
    """The text that was rearranged into ``output``."""
    if form == "plain":
        return output
    one, two = (s.suffix, s.prefix) if form == "spm" else (s.prefix, s.suffix)
    cut = output.index(two, len(one))
    end = output.index(s.middle, cut + len(two))
    x, y, between = output[len(one) : cut], output[cut + len(two) : end], output[end + len(s.middle) :]
    return y + between + x if form == "spm" else x + between + y


FIELDS = ["n", "form", "prefix_chars", "middle_chars", "output", "output_sha256"]


def _sha256(text: str) -> str:
    return hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()


def fill_in_middle(docs: DataFrame, settings: Settings | None = None) -> DataFrame:
    """doc_id, n, form (plain, psm or spm), prefix_chars, middle_chars, output and
    output_sha256 of every row of ``docs`` (doc_id, text; other columns are not read).

    ``n`` counts units and the lengths code points; lengths are null for plain texts.
    A null text counts as empty; empty texts and those that hold a marker stay plain.  A
    null id is digested as an empty one.  Repeated rows give equal rows; an empty table
    gives none.
    """
    s = settings or Settings()

    @F.pandas_udf("n long, form string, prefix_chars long, middle_chars long, output string, output_sha256 string")
    def run(ids: pd.Series, texts: pd.Series) -> pd.DataFrame:
        unit = regex.compile(s.unit)
        rows = [rearrange(t or "", i or "", s, unit) for i, t in zip(ids, texts, strict=True)]
        out = pd.DataFrame(rows, columns=FIELDS[:-1]).astype({"prefix_chars": "Int64", "middle_chars": "Int64"})
        return out.assign(output_sha256=[_sha256(r[-1]) for r in rows])

    made = docs.select("doc_id", run(F.col("doc_id").cast("string"), F.col("text")).alias("made"))
    return made.select("doc_id", *[F.col(f"made.{f}") for f in FIELDS])


def restored(output: Column | str, form: Column | str, settings: Settings | None = None) -> Column:
    """The texts that ``fill_in_middle`` rearranged, from its output and form."""
    s = settings or Settings()

    @F.pandas_udf("string")
    def run(outputs: pd.Series, forms: pd.Series) -> pd.Series:
        return pd.Series([put_back(o, f, s) for o, f in zip(outputs, forms, strict=True)], dtype="object")

    return run(output, form)


def oracle() -> str:
    """The registered query's rows in DuckDB SQL over the view ``documents``."""
    number = lambda k: f"('0x' || substr(h, {8 * k + 1}, 8))::UBIGINT::BIGINT"
    return rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('7:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
u AS (SELECT *, regexp_extract_all(t, '[^\n]*\n|[^\n]+') AS l FROM d),
c AS (SELECT *, len(l)::BIGINT AS n, {number(0)} % (len(l) + 1) AS x, {number(1)} % (len(l) + 1) AS y,
  CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') THEN 'plain'
    WHEN {number(3)} % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM u),
s AS (SELECT *, array_to_string(list_slice(l, 1, least(x, y)), '') AS p, array_to_string(list_slice(l, least(x, y) + 1, greatest(x, y)), '') AS m,
  array_to_string(list_slice(l, greatest(x, y) + 1, n), '') AS e FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || e || '<M>' || m ELSE '<S>' || e || '<P>' || p || '<M>' || m END) AS output_sha256,
  sha256(t) AS restored_sha256
FROM s"""
