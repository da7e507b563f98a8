"""Native column functions over text: no Python at run time."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Commands whose braces hold citation keys.
CITE_COMMANDS = ("cite", "citep", "citet", "autocite", "textcite", "parencite", "fullcite", "nocite")
#: Marks that layout extraction splits from their letters.
MARKS = "ˆˇ˜¯˙"
#: Markup of recognised text, as both regex dialects read it.
DISPLAY_MATH = r'<math display="block">(.*?)</math>'
INLINE_MATH = r"<math>(.*?)</math>"
BOLD = r"<b>(.*?)</b>"
SUPERSCRIPT = r"<sup>(.*?)</sup>"
SUBSCRIPT = r"<sub>(.*?)</sub>"
#: Symbols and their LaTeX.
SYMBOLS = {
    "−": "-", "×": "\\times ", "·": "\\cdot ", "≤": "\\leq ", "≥": "\\geq ", "≠": "\\neq ", "∞": "\\infty", "∑": "\\sum", "∏": "\\prod", "∫": "\\int",
    "∂": "\\partial ", "∈": "\\in ", "∉": "\\notin ", "⊂": "\\subset ", "⊆": "\\subseteq ", "∩": "\\cap ", "∪": "\\cup ", "∧": "\\land ", "∨": "\\lor ",
    "¬": "\\neg ", "∀": "\\forall ", "∃": "\\exists ", "…": "\\ldots ", "⋯": "\\cdots ", "→": "\\to ", "⇒": "\\Rightarrow ", "←": "\\leftarrow ",
    "⇐": "\\Leftarrow ", "↔": "\\leftrightarrow ", "⇔": "\\Leftrightarrow ", "√": "\\sqrt", "≈": "\\approx ", "≡": "\\equiv ", "±": "\\pm ", "∓": "\\mp ",
    "⋅": "\\cdot ", "∣": "\\mid ", "∥": "\\parallel ", "⊥": "\\perp ", "∠": "\\angle ", "°": "^\\circ", "′": "'", "″": "''",
}
#: Names of the Greek letters, from alpha and from Alpha; those without
#: a command are their Latin look-alikes.
GREEK = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi o pi rho varsigma sigma tau upsilon phi chi psi omega".split()
GREEK_CAPITALS = {"Γ": "Gamma", "Δ": "Delta", "Θ": "Theta", "Λ": "Lambda", "Ξ": "Xi", "Π": "Pi", "Σ": "Sigma", "Φ": "Phi", "Ψ": "Psi", "Ω": "Omega"}


def math_characters() -> dict[str, str]:
    """What each mathematical character stands for.

    Styled alphabets follow one another from U+1D400 in blocks of 26 capitals and 26
    small letters, styled digits from U+1D7CE in tens.  A Greek command keeps a space
    after it, so that it never runs into the next letter.
    """
    table = dict(SYMBOLS)
    table |= {chr(0x3B1 + i): name if name == "o" else f"\\{name} " for i, name in enumerate(GREEK)}
    table |= {c: f"\\{name} " for c, name in GREEK_CAPITALS.items()}
    for i in range(13 * 52):
        table[chr(0x1D400 + i)] = chr((65 if i % 52 < 26 else 71) + i % 52)
    table |= {chr(0x1D7CE + i): chr(48 + i % 10) for i in range(50)}
    return table


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once, however often ``body`` looks at it."""
    return F.transform(F.array(value), body)[0]


def strip(c: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def universal_newlines(c: Column) -> Column:
    return F.regexp_replace(c, "\r\n?", "\n")


def strip_comment_environments(c: Column) -> Column:
    return F.regexp_replace(c, r"(?s)\\begin\{comment\}.*?\\end\{comment\}", "")


#: A line up to its first unescaped percent sign; linear on any length.
_COMMENT = r"(?s)^([^%\\]*+(?:\\.[^%\\]*+)*+)%.*$"


def strip_line_comments(c: Column) -> Column:
    """Without unescaped ``%`` and what follows; lines that were only a comment go."""

    def line(x: Column) -> Column:
        head = F.regexp_replace(F.regexp_extract(x, _COMMENT, 1), r"(?U)\s+$", "")
        return F.when(x.rlike(_COMMENT), F.when(head != "", head)).otherwise(x)

    left = F.array_join(F.filter(F.transform(F.split(c, "\n"), line), lambda x: x.isNotNull()), "\n")
    return F.when(c.contains("%"), left).otherwise(c)


def resolve_conditionals(c: Column) -> Column:
    r"""``\ifodd 1 A [\else B] \fi`` becomes A; ``\fi`` and ``\else`` end at a letter boundary."""
    return F.regexp_replace(c, r"(?s)\\ifodd\s+1\s(.*?)(?:\\else(?![A-Za-z]).*?)?\\fi(?![A-Za-z])", "$1")


def strip_math_alphabets(c: Column) -> Column:
    return F.regexp_replace(c, r"\\(?:DeclareMathAlphabet|SetMathAlphabet)\{[^\n]*\n?", "")


def strip_packages(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)\\usepackage(?:\[[^\]]*\])?\{[^}]*\}\s*", "")


def squeeze_blank_lines(c: Column) -> Column:
    return F.regexp_replace(c, "\n{3,}", "\n\n")


def strip_italics(c: Column) -> Column:
    """Without the underscores around italic text.

    The text is cut at its underscores, and each is looked at with its two neighbours: one
    may open where no word ends before it and the text up to the next one is not empty, if
    no word begins behind that.  Of neighbours that may open, the first one does."""
    # A sign for each piece: empty, or where a word touches its ends.
    word = lambda x, at: F.substring(x, at, 1).rlike(r"(?U)^\w")
    sign = lambda x: F.when(x == "", "e").when(word(x, 1), F.when(word(x, -1), "b").otherwise("s")).otherwise(F.when(word(x, -1), "z").otherwise("n"))
    signs = F.array_join(F.transform(F.split(c, "_"), sign), "")
    opening = F.regexp_replace(signs, r"(?<=^e|[ns])[nszb](?=e\z|[nz])", "o")  # by the sign of the piece behind it
    paired = F.regexp_replace(F.regexp_replace(opening, "o.", "xx"), "^.", "x")  # the first piece has none before it
    left = F.zip_with(F.split(c, "_"), F.split(paired, ""), lambda a, p: F.when(p == "x", a).otherwise(F.concat(F.lit("_"), a)))
    return F.when(c.contains("_"), F.array_join(left, "")).otherwise(c)


def merge_diacritics(c: Column) -> Column:
    return F.regexp_replace(c, rf"(?U)([{MARKS}])\s+([a-zA-Z])", "$1$2")


def off_tables(c: Column, body) -> Column:
    """Apply to every line but those of pipe tables."""
    return F.array_join(F.transform(F.split(c, "\n"), lambda x: F.when(x.rlike(r"(?U)^\s*\|"), x).otherwise(body(x))), "\n")


def convert_ocr_markup(c: Column) -> Column:
    for pattern, by in (
        (f"(?s){DISPLAY_MATH}", r"\$\$$1\$\$"),
        (INLINE_MATH, r"\$$1\$"),
        (BOLD, "**$1**"),
        (SUPERSCRIPT, "^{$1}"),
        (SUBSCRIPT, "_{$1}"),
    ):
        c = F.regexp_replace(c, f"(?d){pattern}", by)
    return c


#: All that ``math_characters`` has, and some others between them.
_MATH_RANGES = r"\x{AC}-\x{B7}\x{D7}\x{391}-\x{3C9}\x{2026}-\x{2033}\x{2190}-\x{22EF}\x{1D400}-\x{1D7FF}"


def normalize_math(c: Column) -> Column:
    """Styled letters and digits by ``translate``, symbols by a map: only the characters in
    question are looked up, what lies between them stays in whole pieces."""
    table = math_characters()
    single = {k: v for k, v in table.items() if len(v) == 1}
    several = F.create_map(*[F.lit(x) for k, v in table.items() if len(v) != 1 for x in (k, v)])
    pieces = F.regexp_extract_all(c, F.lit(f"[{_MATH_RANGES}]|[^{_MATH_RANGES}]+"), 0)
    meant = lambda x: F.coalesce(F.element_at(several, x), F.translate(x, "".join(single), "".join(single.values())))
    known = F.transform(pieces, lambda x: F.when((F.length(x) == 1) & x.rlike(f"[{_MATH_RANGES}]"), meant(x)).otherwise(x))
    return F.when(c.rlike(f"[{_MATH_RANGES}]"), F.array_join(known, "")).otherwise(c)


def cited_keys(c: Column) -> Column:
    """All citation keys in order, repeated as often as they are cited."""
    groups = F.regexp_extract_all(c, F.lit(rf"\\(?:{'|'.join(CITE_COMMANDS)})(?:\[[^\]]*\])*\{{([^}}]+)\}}"), 1)
    # Most groups have no white space; of those, no key is looked at.
    keys = lambda g: F.when(g.rlike(r"(?U)\s"), F.transform(F.split(g, ","), strip)).otherwise(F.split(g, ","))
    return F.filter(F.flatten(F.transform(groups, keys)), lambda k: k != "")


def format_entry(fields: Column, kind: Column) -> Column:
    """One bibliography entry as a readable line, from its field map and type."""
    f = lambda name: F.coalesce(F.element_at(fields, name), F.lit(""))
    has = lambda name: f(name) != ""
    ended = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts], F.lit("."))
    volume = F.concat(f("volume"), F.when(has("number"), F.concat(F.lit("("), f("number"), F.lit(")"))).otherwise(""), F.when(has("pages"), F.concat(F.lit(":"), f("pages"))).otherwise(""))
    return F.concat_ws(
        " ",
        F.when(has("author"), ended(f("author"))),
        F.when(has("title"), ended("\\textit{", F.translate(f("title"), "{}", ""), "}")),
        F.when(has("journal"), ended(f("journal"))).when(has("booktitle"), ended("In ", f("booktitle"))),
        F.when(has("volume"), ended(volume)).when(has("pages"), ended("pp.~", f("pages"))),
        F.when(has("year"), ended(f("year"))),
        F.when(has("publisher") & kind.isin("book", "inbook"), ended(f("publisher"))),
    )


def heading_level(style: Column) -> Column:
    """Level of a ``HeadingN`` style, 6 at most; null for any other style."""
    n = F.regexp_extract(style, r"^[Hh]eading\s*(\d+)$", 1)
    return F.when(n != "", F.greatest(F.lit(1), F.least(n.cast("int"), F.lit(6))))
