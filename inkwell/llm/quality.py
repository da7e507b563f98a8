"""Quality rules: distribution divergence from language references.

A document's character-class histogram and its common-word histogram are
compared with per-language references by Jensen-Shannon distance (base 2, 0 to
1).  Everything is a projection over one row: no shuffle, no Python.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import SPACE

#: Character classes in the order of the histograms: lower-case ASCII, upper-case
#: ASCII, white space, other letters, digits, sentence punctuation, the rest.
CLASSES = ("lower", "upper", "space", "other_letter", "digit", "punct", "rest")


@dataclass(frozen=True)
class Reference:
    """Shares of the character classes, and of common words among all words."""

    classes: tuple[float, ...]
    words: dict[str, float]


#: Rounded shares of character classes and function words in
#: running prose of each language.
REFERENCES: dict[str, Reference] = {
    "en": Reference(
        (0.79, 0.02, 0.16, 0.00, 0.005, 0.02, 0.005),
        {"the": 0.065, "of": 0.032, "and": 0.027, "to": 0.024, "a": 0.02, "in": 0.019, "is": 0.012, "that": 0.011, "for": 0.009, "it": 0.009, "was": 0.009, "on": 0.007, "with": 0.007, "be": 0.006, "as": 0.006, "by": 0.005},
    ),
    "de": Reference(
        (0.79, 0.03, 0.14, 0.015, 0.005, 0.02, 0.00),
        {"der": 0.035, "die": 0.033, "und": 0.028, "in": 0.019, "den": 0.013, "von": 0.011, "zu": 0.01, "das": 0.01, "mit": 0.009, "sich": 0.009, "des": 0.008, "auf": 0.008, "für": 0.008, "ist": 0.008, "im": 0.008, "nicht": 0.007},
    ),
    "fr": Reference(
        (0.77, 0.02, 0.16, 0.03, 0.005, 0.015, 0.00),
        {"de": 0.05, "la": 0.028, "le": 0.022, "et": 0.02, "les": 0.019, "des": 0.017, "en": 0.012, "un": 0.011, "du": 0.01, "une": 0.01, "que": 0.01, "est": 0.009, "pour": 0.008, "qui": 0.008, "dans": 0.008, "par": 0.006},
    ),
    "es": Reference(
        (0.78, 0.02, 0.165, 0.015, 0.005, 0.015, 0.00),
        {"de": 0.06, "la": 0.036, "que": 0.028, "el": 0.027, "en": 0.026, "y": 0.024, "los": 0.016, "se": 0.013, "del": 0.012, "las": 0.011, "un": 0.01, "por": 0.009, "con": 0.009, "no": 0.008, "una": 0.008, "para": 0.007},
    ),
}


@dataclass(frozen=True)
class Rules:
    """Limits.  The guards ``min_chars`` and ``min_judged_words`` say from which length
    a histogram is judged at all; ``min_class_words``, where given, takes their place
    for the character classes, whose shares settle sooner than those of words."""

    references: dict[str, Reference] = field(default_factory=lambda: REFERENCES)
    max_class_distance: float = 0.28
    max_word_distance: float = 0.4
    max_distance_sum: float = 0.47
    min_chars: int = 400
    min_words: int = 50
    min_judged_words: int = 80
    min_class_words: int | None = None
    max_repeat_percent: int = 50


#: The classes of every document that the base rules let through are judged.
CLASSES_JUDGED = Rules(min_class_words=Rules.min_words)


def _bind(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once, as a lambda's argument."""
    return F.transform(F.array(value), body)[0]


def _dropped(text: Column, pattern: str) -> Column:
    return F.regexp_replace(text, F.lit(pattern), F.lit(""))


def _class_counts(text: Column) -> Column:
    """Counts of CLASSES and of ``[#*$%&|<>]``; each pass reads what is left."""
    n = F.length
    return _bind(text, lambda a: _bind(_dropped(a, "[a-z]+"), lambda b: _bind(_dropped(b, f"[{SPACE}]+"), lambda c: _bind(_dropped(c, "[A-Z]+"), lambda d: _bind(
        _dropped(d, r"\p{L}+"), lambda e: _bind(_dropped(e, "[0-9]+"), lambda f: _bind(_dropped(f, "[.,;:!?'\"()-]+"), lambda g: F.array(
            n(a) - n(b), n(c) - n(d), n(b) - n(c), n(d) - n(e), n(e) - n(f), n(f) - n(g), n(g), n(f) - n(_dropped(f, "[#*$%&|<>]+"))))))))))


#: Bits of a sort key that hold a window's place; the bits above hold its hash.
_PLACE = 22


def _window_keys(words: Column) -> Column:
    """A sortable number for each three-word window: upper hash bits, then place."""
    return F.transform(words, lambda w, i: F.xxhash64(w, F.get(words, i + 1), F.get(words, i + 2)).bitwiseAND(F.lit(-(1 << _PLACE))).bitwiseOR(i.cast("long")))


def _covered(found: Column) -> Column:
    """Words covered by three-word windows that start at the sorted places ``found``."""
    steps = F.transform(F.sequence(F.lit(1), F.size(found) - 1), lambda k: F.least(F.lit(3), F.get(found, k) - F.get(found, k - 1)))
    return F.when(F.size(found) == 0, 0).when(F.size(found) == 1, 3).otherwise(3 + F.aggregate(steps, F.lit(0), lambda s, x: s + x.cast("int")))


def _repeated(words: Column, keys: Column) -> Column:
    """Words in three-word windows found twice or more in the same text.

    ``keys`` are sorted, so windows with equal hash bits are neighbours; those
    are then compared word by word.
    """
    place = lambda x: x.bitwiseAND(F.lit((1 << _PLACE) - 1)).cast("int")
    window = lambda x: _bind(place(x), lambda i: F.struct(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)))

    def same(x: Column, y: Column) -> Column:
        return (F.coalesce(F.shiftright(x.bitwiseXOR(y), _PLACE), F.lit(1)) == 0) & (window(x) == window(y))

    hits = F.filter(keys, lambda x, k: (place(x) < F.size(words) - 2) & (same(x, F.get(keys, k - 1)) | same(x, F.get(keys, k + 1))))
    return _bind(F.sort_array(F.transform(hits, place)), _covered)


def _repeated_long(words: Column) -> Column:
    """The same for texts of more words than a key's place can hold."""
    windows = F.sort_array(F.transform(F.sequence(F.lit(0), F.size(words) - 3), lambda i: F.struct(F.get(words, i).alias("a"), F.get(words, i + 1).alias("b"), F.get(words, i + 2).alias("c"), i.alias("i"))))
    same = lambda x, y: (x["a"] == y["a"]) & (x["b"] == y["b"]) & (x["c"] == y["c"])
    return _bind(windows, lambda s: _bind(F.sort_array(F.transform(F.filter(s, lambda x, k: F.coalesce(same(x, F.get(s, k - 1)), F.lit(False)) | F.coalesce(same(x, F.get(s, k + 1)), F.lit(False))), lambda x: x["i"])), _covered))


def _distance(p: Column, q: list[float]) -> Column:
    """Jensen-Shannon distance of two distributions of the same length."""
    pairs = F.zip_with(p, F.array(*map(F.lit, q)), lambda a, b: F.when(a > 0, a * F.log2(2 * a / (a + b))).otherwise(0.0) + F.when(b > 0, b * F.log2(2 * b / (a + b))).otherwise(0.0))
    return F.sqrt(F.greatest(F.lit(0.0), F.aggregate(pairs, F.lit(0.0), lambda s, x: s + x) / 2))


def score_quality(docs: DataFrame, rules: Rules | None = None, text: str = "text") -> DataFrame:
    """Add the base counts, the two distances and the verdict to ``docs``.

    Added: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (long),
    class_distance, word_distance (double; null under the guards), base_failed
    and kept (boolean).  Columns of ``docs`` with these names are replaced; all
    others stay.  A null text counts as one without words, so it fails the base
    rules.  Repeated rows are each judged alone; an empty table stays empty.
    """
    rules = rules or Rules()
    common = sorted({w for r in rules.references.values() for w in r.words})
    forms = sorted({*common, *(w.capitalize() for w in common)})
    tag = "_quality_"
    t, words, keys, counts = (F.col(tag + x) for x in ("text", "words", "keys", "counts"))
    trimmed = F.btrim(t, F.lit(" \t\n\x0b\x0c\r"))
    split = F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, f"[{SPACE}]+"))

    def common_counts(ws: Column) -> Column:
        seen = F.concat(F.lit(" "), F.lower(F.array_join(F.filter(ws, lambda w: w.isin(forms)), "  ")), F.lit(" "))
        return _bind(seen, lambda s: F.array(*[(F.length(s) - F.length(F.replace(s, F.lit(f" {w} "), F.lit("")))) / F.lit(len(w) + 2) for w in common]))

    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(f"[^{SPACE}]"))

    def class_distance(c: Column) -> Column:
        total = F.aggregate(F.slice(c, 1, len(CLASSES)), F.lit(0), lambda s, x: s + x)
        p = _bind(total, lambda n: F.transform(F.slice(c, 1, len(CLASSES)), lambda x: x / n))
        return _bind(p, lambda v: F.least(*[_distance(v, _shares(r.classes)) for r in rules.references.values()]))

    def to_reference(r: Reference, w: Column, n: Column) -> Column:
        own = F.array(*[F.get(w, F.lit(common.index(x))) / n for x in r.words])
        others = [*r.words.values(), 1 - sum(r.words.values())]
        return _bind(own, lambda v: _distance(F.concat(v, F.array(F.greatest(F.lit(0.0), 1 - F.aggregate(v, F.lit(0.0), lambda s, x: s + x)))), others))

    def word_distance(ws: Column) -> Column:
        return _bind(common_counts(ws), lambda c: F.least(*[to_reference(r, c, F.size(ws)) for r in rules.references.values()]))

    long_enough = (F.length(t) >= rules.min_chars) & (F.size(words) >= rules.min_judged_words)
    class_guard = long_enough if rules.min_class_words is None else F.size(words) >= rules.min_class_words
    out = docs.withColumn(tag + "text", F.coalesce(F.col(text), F.lit("")))
    out = out.withColumns({tag + "words": split, tag + "counts": _class_counts(t), tag + "dups": _bind(lines, lambda x: F.size(x) - F.size(F.array_distinct(x)))})
    out = out.withColumn(tag + "keys", F.sort_array(_window_keys(words)))
    out = out.withColumns({
        "n_words": F.size(words).cast("long"),
        "word_chars": (F.length(t) - F.get(counts, F.lit(2))).cast("long"),
        "n_symbols": F.get(counts, F.lit(7)).cast("long"),
        "n_dup_lines": F.col(tag + "dups").cast("long"),
        "n_repeat_words": F.when(F.size(words) < 3, 0).when(F.size(words) < 1 << _PLACE, _repeated(words, keys)).otherwise(_repeated_long(words)).cast("long"),
        "class_distance": F.when(class_guard, class_distance(counts)),
        "word_distance": F.when(long_enough, word_distance(words)),
    }).drop(*[tag + x for x in ("text", "words", "keys", "counts", "dups")])
    failed = (F.col("n_words") < rules.min_words) | (100 * F.col("n_repeat_words") > rules.max_repeat_percent * F.col("n_words"))
    near = lambda c, most: F.coalesce(F.col(c), F.lit(0.0)) <= most
    both = F.coalesce(F.col("class_distance") + F.col("word_distance"), F.lit(0.0)) <= rules.max_distance_sum
    fits = near("class_distance", rules.max_class_distance) & near("word_distance", rules.max_word_distance) & both
    return out.withColumns({"base_failed": failed, "kept": ~failed & fits})


def keep_quality(docs: DataFrame, rules: Rules | None = None, text: str = "text") -> DataFrame:
    """The rows of ``docs`` that the rules keep, with its columns as they are, whatever
    their names.  A null text goes; an empty table stays empty."""
    # A row's own columns stay inside one struct, apart from the names used here.  The row
    # number keeps the filter above the projections: pushed below, every use of a verdict's
    # inputs would be written out and computed again.
    rows = docs.select(F.struct("*").alias("own")).withColumn("text", F.col("own").getField(text))
    scored = score_quality(rows, rules).withColumn("row", F.monotonically_increasing_id())
    return scored.where("kept AND row >= 0").select("own.*")


def _shares(x: tuple[float, ...]) -> list[float]:
    return [v / sum(x) for v in x]


BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]


def oracle(rules: Rules | None = None) -> str:
    """The same verdicts in DuckDB SQL over the view ``documents``."""
    rules = rules or Rules()
    js = lambda p, q: f"sqrt(greatest(0, list_sum(list_transform(list_zip({p}, {q}), lambda z: CASE WHEN z[1] > 0 THEN z[1] * log2(2 * z[1] / (z[1] + z[2])) ELSE 0 END + CASE WHEN z[2] > 0 THEN z[2] * log2(2 * z[2] / (z[1] + z[2])) ELSE 0 END)) / 2))"
    arr = lambda v: "[" + ", ".join(f"{float(x)!r}::DOUBLE" for x in v) + "]"
    quoted = lambda v: "[" + ", ".join(f"'{x}'" for x in v) + "]"
    by_class = ", ".join(js("p", arr(_shares(r.classes))) for r in rules.references.values())
    share = lambda r: f"list_transform({quoted(r.words)}, lambda x: coalesce(wc[x], 0)::DOUBLE / n_words)"
    by_word = ", ".join(js(f"list_concat({share(r)}, [greatest(0::DOUBLE, 1 - list_sum({share(r)}))])", arr([*r.words.values(), 1 - sum(r.words.values())])) for r in rules.references.values())
    common = sorted({w for r in rules.references.values() for w in r.words})
    forms = quoted(sorted({*common, *(w.capitalize() for w in common)}))
    short = f"(length(t) < {rules.min_chars} OR n_words < {rules.min_judged_words})"
    short_for_classes = short if rules.min_class_words is None else f"n_words < {rules.min_class_words}"
    count = lambda c: f"length(regexp_replace(t, '[^{c}]', '', 'g'))"
    return f"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, list_filter(regexp_split_to_array(t, '[{SPACE}]+'), lambda x: x <> '') AS ws,
  list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^{SPACE}]')) AS ls FROM d),
win AS (SELECT k, i, list_slice(ws, i, i + 2) AS g FROM (SELECT k, ws, unnest(range(1, len(ws) - 1)) AS i FROM w WHERE len(ws) > 2)),
rep AS (SELECT k, i FROM (SELECT k, i, count(*) OVER (PARTITION BY k, g) AS c FROM win) WHERE c > 1),
cov AS (SELECT k, count(DISTINCT i + o) AS n FROM rep, (VALUES (0), (1), (2)) v(o) GROUP BY k),
lw AS (SELECT k, map(list(x), list(c)) AS wc FROM (SELECT k, x, count(*) AS c FROM (SELECT k, lower(unnest(list_filter(ws, lambda x: list_contains({forms}, x)))) AS x FROM w) GROUP BY k, x) GROUP BY k),
b AS (SELECT w.k, doc_id, t, len(ws)::BIGINT AS n_words, length(regexp_replace(t, '[{SPACE}]', '', 'g'))::BIGINT AS word_chars,
  length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines,
  coalesce(cov.n, 0)::BIGINT AS n_repeat_words, wc,
  list_transform([{count('a-z')}, {count('A-Z')}, {count(SPACE)}, length(regexp_replace(t, '[a-zA-Z]|[^' || chr(92) || 'p{{L}}]', '', 'g')), {count('0-9')}, length(regexp_replace(t, '[^.,;:!?''"()-]', '', 'g'))], lambda x: x::DOUBLE) AS c6
  FROM w LEFT JOIN cov USING (k) LEFT JOIN lw USING (k)),
c AS (SELECT *, list_transform(list_concat(c6, [length(t) - list_sum(c6)]), lambda x: x / greatest(1, length(t))) AS p,
  n_words < {rules.min_words} OR 100 * n_repeat_words > {rules.max_repeat_percent} * n_words AS base_failed FROM b),
e AS (SELECT *, least({by_class}) AS cd, least({by_word}) AS wd FROM c)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND ({short_for_classes} OR cd <= {rules.max_class_distance})
    AND ({short} OR (wd <= {rules.max_word_distance} AND cd + wd <= {rules.max_distance_sum})) AS kept
FROM e"""
