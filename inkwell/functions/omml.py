"""Office math markup to LaTeX, natively, from the innermost elements outwards.

The XML's tags are reduced to their names and values.  Then, level by level, every element
without open elements inside is written by the rule for its name and leaves a record in its
place, which the element around it reads.  So every element is written once, after its
children, and what no rule of nesting fits is left over.  A level is one pass over the text.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import bound as _bind
from .text import normalize_math

#: Operators, accents, delimiters and function names.
OPERATORS = {"∑": "\\sum", "∏": "\\prod", "∫": "\\int", "∬": "\\iint", "∭": "\\iiint", "∮": "\\oint", "⋀": "\\bigwedge", "⋁": "\\bigvee", "⋂": "\\bigcap", "⋃": "\\bigcup"}
ACCENTS = {"\u0302": "\\hat", "\u0304": "\\bar", "\u0303": "\\tilde", "\u0307": "\\dot", "\u0308": "\\ddot", "\u20d7": "\\vec", "\u0305": "\\overline"}
DELIMITERS = {"{": "\\{", "}": "\\}", "\u2329": "\\langle", "\u232a": "\\rangle", "⟨": "\\langle", "⟩": "\\rangle", "‖": "\\|"}
FUNCTIONS = frozenset("sin cos tan sec csc cot arcsin arccos arctan sinh cosh tanh log ln exp lim max min sup inf det dim gcd arg".split())
#: Characters that open a brace above.
OVER = ("\u23de", "\ufe37")

_TAG = r"""<[^<>"']*+(?:"[^"]*+"[^<>"']*+|'[^']*+'[^<>"']*+)*+>"""
_TOKEN = rf"(?s)<!--.*?-->|<\?.*?\?>|<!\[CDATA\[.*?\]\]>|{_TAG}|[^<]++"
_NAME = r"^</?(?:[^\s:/>]*:)?([^\s:/>]+)"
_VALUE = r"""[\s:]val\s*=\s*(?:"([^"]*)"|'([^']*)')"""

#: A record is RECORD, tag, SEP, value, SEP, LaTeX, SEP, settings, END; a setting is ITEM,
#: tag, EQUALS, value.  LT and GT stand for angle brackets in texts; no XML has these signs.
RECORD, SEP, END, ITEM, EQUALS, LT, GT = "\x01\x02\x03\x04\x05\x06\x07"
_ILLEGAL = r"[\x00-\x08\x0B\x0C\x0E-\x1F]"
_ILLEGAL_REFERENCE = r"&#(?:0*(?:[0-8]|1[124-9]|2[0-9]|3[01])|x0*(?:[0-8BbCcEeFf]|1[0-9A-Fa-f]));"
#: An element with no other inside, any other tag, or what is between tags.
_PIECE = rf"<([^<>{SEP}]*+){SEP}[^<>]*+>[^<>]*+</\1>|<[^<>]*+>|[^<>]++"
_ELEMENT = rf"^<([^<>{SEP}]*+){SEP}([^<>]*+)>([^<>]*+)</"


def _unescaped(c: Column) -> Column:
    """Character references as what they stand for."""
    code = lambda e: F.when(e.startswith("&#x"), F.regexp_extract(e, "^&#x([0-9A-Fa-f]+);$", 1)).otherwise(F.hex(F.regexp_extract(e, "^&#([0-9]+);$", 1).cast("long")))
    one = lambda acc, e: F.replace(acc, e, F.decode(F.unhex(F.lpad(code(e), 8, "0")), "UTF-32"))
    numbered = F.when(c.contains("&#"), F.aggregate(F.array_distinct(F.regexp_extract_all(c, F.lit("&#x?[0-9A-Fa-f]+;"), 0)), c, one)).otherwise(c)
    for name, sign in (("lt", "<"), ("gt", ">"), ("quot", '"'), ("apos", "'"), ("amp", "&")):
        numbered = F.replace(numbered, F.lit(f"&{name};"), F.lit(sign))
    return F.when(c.contains("&"), numbered).otherwise(c)


def _value(token: Column) -> Column:
    """The value of a tag's ``val``, empty where it has none."""
    found = F.when(F.regexp_extract(token, _VALUE, 1) != "", F.regexp_extract(token, _VALUE, 1)).otherwise(F.regexp_extract(token, _VALUE, 2))
    return F.when(token.contains("val"), _unescaped(found)).otherwise("")


def _joined(inside: Column, tag: str | None, between: str = "") -> Column:
    """The children's LaTeX, of those of one name or of all."""
    name = f"[^{SEP}]*" if tag is None else tag
    return F.array_join(F.regexp_extract_all(inside, F.lit(f"{RECORD}{name}{SEP}[^{SEP}]*{SEP}([^{SEP}]*){SEP}"), 1), between)


def _joined_by(inside: Column, tag: str, between: Column) -> Column:
    texts = F.regexp_extract_all(inside, F.lit(f"{RECORD}{tag}{SEP}[^{SEP}]*{SEP}([^{SEP}]*){SEP}"), 1)
    return F.array_join(F.transform(texts, lambda x, i: F.when(i == 0, x).otherwise(F.concat(between, x))), "")


def _of(table: dict[str, str], key: Column, other: Column) -> Column:
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for pair in table.items() for x in pair]), key), other)


def _written(tag: Column, inside: Column) -> Column:
    """What the element ``tag`` gives, from its children's records."""
    part = lambda name: F.regexp_extract(inside, f"{RECORD}{name}{SEP}[^{SEP}]*{SEP}([^{SEP}]*){SEP}", 1)  # noqa: E731  of the first
    braced = lambda name: F.concat(F.lit("{"), part(name), F.lit("}"))
    lit = F.lit

    def setting(group: str, item: str, default: str = "") -> Column:
        """A property's value, or the default where it is absent or empty."""
        first = F.regexp_extract(inside, f"{RECORD}{group}{SEP}[^{SEP}]*{SEP}[^{SEP}]*{SEP}([^{END}]*)", 1)
        found = F.regexp_extract(first, f"{ITEM}{item}{EQUALS}([^{ITEM}]*)", 1)
        return F.coalesce(F.nullif(found, lit("")), lit(default))

    def optional(before: str, name: str, after: str) -> Column:
        return _bind(part(name), lambda x: F.when(x != "", F.concat(lit(before), x, lit(after))).otherwise(""))

    called = lambda x: F.when(F.lower(x).isin(*sorted(FUNCTIONS)), F.concat(lit("\\"), F.lower(x))).otherwise(x)
    rules = {
        "r": _joined(inside, "t"),
        "sSub": F.concat(part("e"), lit("_"), braced("sub")),
        "sSup": F.concat(part("e"), lit("^"), braced("sup")),
        "sSubSup": F.concat(part("e"), lit("_"), braced("sub"), lit("^"), braced("sup")),
        "limLow": F.concat(part("e"), lit("_"), braced("lim")),
        "limUpp": F.concat(part("e"), lit("^"), braced("lim")),
        "sPre": F.concat(lit("{}_"), braced("sub"), lit("^"), braced("sup"), part("e")),
        "f": F.concat(lit("\\frac"), braced("num"), braced("den")),
        "rad": F.concat(lit("\\sqrt"), optional("[", "deg", "]"), braced("e")),
        "nary": F.concat(_of(OPERATORS, setting("naryPr", "chr"), lit("\\sum")), optional("_{", "sub", "}"), optional("^{", "sup", "}"), optional(" ", "e", "")),
        "d": F.concat(
            lit("\\left"), _bind(setting("dPr", "begChr", "("), lambda x: _of(DELIMITERS, x, x)), lit(" "),
            _bind(setting("dPr", "sepChr", "|"), lambda s: _joined_by(inside, "e", F.concat(lit(" "), s, lit(" ")))),
            lit(" \\right"), _bind(setting("dPr", "endChr", ")"), lambda x: _of(DELIMITERS, x, x))),
        "func": F.concat(_bind(F.regexp_replace(part("fName"), r"(?U)^\s+|\s+$", ""), called), part("e")),
        "acc": F.concat(_of(ACCENTS, setting("accPr", "chr"), lit("\\hat")), braced("e")),
        "bar": F.concat(F.when(setting("barPr", "pos") == "bot", "\\underline").otherwise("\\overline"), braced("e")),
        "mr": _joined(inside, "e", " & "),
        "m": F.concat(lit("\\begin{pmatrix} "), _joined(inside, "mr", " \\\\ "), lit(" \\end{pmatrix}")),
        "eqArr": F.concat(lit("\\begin{aligned} "), _joined(inside, "e", " \\\\ "), lit(" \\end{aligned}")),
        "groupChr": F.concat(F.when(setting("groupChrPr", "chr").isin(*OVER), "\\overbrace").otherwise("\\underbrace"), braced("e")),
        "oMathPara": _joined(inside, "oMath", " \\\\ "),
    }
    out = F.when(tag == "t", _bind(F.regexp_replace(inside, f"{RECORD}[^{END}]*{END}", ""), normalize_math))
    for name, made in rules.items():
        out = out.when(tag == name, made)
    return out.when(tag.endswith("Pr"), lit("")).otherwise(_joined(inside, None))


def omml_to_latex(xml: Column) -> Column:
    """A formula's XML as LaTeX between dollar signs, display math for a paragraph of
    formulas.  Null stays null; a text that is no XML with one root gives null."""
    hidden = lambda c: F.translate(c, "<>", LT + GT)

    def reduced(token: Column) -> Column:
        name = F.regexp_extract(token, _NAME, 1)
        opening = F.concat(F.lit("<"), name, F.lit(SEP), hidden(_value(token)), F.lit(">"))
        closing = F.concat(F.lit("</"), name, F.lit(">"))
        return (
            F.when(~token.startswith("<"), hidden(_unescaped(token)))
            .when(token.startswith("</"), closing)
            .when(token.startswith("<![CDATA["), hidden(F.regexp_extract(token, r"(?s)^<!\[CDATA\[(.*)\]\]>$", 1)))
            .when(token.startswith("<?") | token.startswith("<!--"), "")
            .when(token.startswith("<!"), hidden(token))
            .when(token.endswith("/>"), F.concat(opening, closing))
            .otherwise(opening)
        )

    def record(piece: Column) -> Column:
        tag, value, inside = (F.regexp_extract(piece, _ELEMENT, k).alias(n) for k, n in ((1, "tag"), (2, "value"), (3, "inside")))
        return _bind(F.struct(tag, value, inside), lambda e: as_record(e["tag"], e["value"], e["inside"]))

    def as_record(tag: Column, value: Column, inside: Column) -> Column:
        items = F.regexp_replace(inside, f"[^{RECORD}]*{RECORD}([^{SEP}]*){SEP}([^{SEP}]*){SEP}[^{END}]*{END}[^{RECORD}]*", f"{ITEM}$1{EQUALS}$2")
        settings = F.when(tag.endswith("Pr") & inside.contains(RECORD), items).otherwise("")
        return F.concat(F.lit(RECORD), tag, F.lit(SEP), value, F.lit(SEP), _written(tag, inside), F.lit(SEP), settings, F.lit(END))

    def level(text: Column, _: Column) -> Column:
        pieces = F.regexp_extract_all(text, F.lit(_PIECE), 0)
        done = F.array_join(F.transform(pieces, lambda p: F.when(p.startswith("<") & p.contains("</") & ~p.startswith("</"), record(p)).otherwise(p)), "")
        # What no longer changes is no XML, and null from here on.
        return F.when(text.contains("<"), _bind(done, lambda d: F.when(d != text, d))).otherwise(text)

    def finished(text: Column) -> Column:
        root = rf"^\s*{RECORD}([^{SEP}]*){SEP}[^{SEP}]*{SEP}([^{SEP}]*){SEP}[^{END}]*{END}\s*$"
        sign = F.when(F.regexp_extract(text, root, 1) == "oMathPara", "$$").otherwise("$")
        return F.when(text.rlike(root), F.translate(F.concat(sign, F.regexp_extract(text, root, 2), sign), LT + GT, "<>"))

    def made(tokens: Column) -> Column:
        # What no token covers is no XML, nor are signs that it must not have.
        illegal = xml.rlike(_ILLEGAL) | (xml.contains("&#") & F.exists(tokens, lambda t: ~t.startswith("<!") & t.rlike(_ILLEGAL_REFERENCE)))
        whole = (F.length(F.array_join(tokens, "")) == F.length(xml)) & ~illegal
        # There are no more levels than tags that close.
        levels = lambda text: F.sequence(F.lit(0), F.regexp_count(text, F.lit("</")))
        return F.when(whole, _bind(F.array_join(F.transform(tokens, reduced), ""), lambda text: F.aggregate(levels(text), text, level, finished)))

    return _bind(F.regexp_extract_all(xml, F.lit(_TOKEN), 0), made)
