"""Office math markup to LaTeX by recursion over a parsed tree, to hold the native form against."""

from __future__ import annotations

from collections.abc import Callable
from xml.etree import ElementTree as ET

from inkwell.functions.omml import ACCENTS, DELIMITERS, FUNCTIONS, OPERATORS
from inkwell.functions.text import math_characters

_CHARACTERS = str.maketrans(math_characters())


def name(e: ET.Element) -> str:
    return e.tag.rpartition("}")[2]


def child(e: ET.Element, wanted: str) -> ET.Element | None:
    return next((c for c in e if name(c) == wanted), None)


def setting(e: ET.Element, group: str, item: str) -> str | None:
    """The value of a property such as ``dPr/begChr``; None where it is not given."""
    found = child(e, group)
    found = child(found, item) if found is not None else None
    return None if found is None else next((v for k, v in found.attrib.items() if k.rpartition("}")[2] == "val"), "")


def part(e: ET.Element, wanted: str) -> str:
    found = child(e, wanted)
    return "" if found is None else inside(found)


def inside(e: ET.Element) -> str:
    return "".join(convert(c) for c in e)


def _run(e: ET.Element) -> str:
    return "".join(c.text or "" for c in e if name(c) == "t").translate(_CHARACTERS)


def _radical(e: ET.Element) -> str:
    degree = part(e, "deg")
    return f"\\sqrt{f'[{degree}]' if degree else ''}{{{part(e, 'e')}}}"


def _nary(e: ET.Element) -> str:
    sub, sup, body = part(e, "sub"), part(e, "sup"), part(e, "e")
    return OPERATORS.get(setting(e, "naryPr", "chr") or "", "\\sum") + (f"_{{{sub}}}" if sub else "") + (f"^{{{sup}}}" if sup else "") + (f" {body}" if body else "")


def _delimited(e: ET.Element) -> str:
    left, right, between = ((setting(e, "dPr", k) or d) for k, d in (("begChr", "("), ("endChr", ")"), ("sepChr", "|")))
    body = f" {between} ".join(inside(c) for c in e if name(c) == "e")
    return f"\\left{DELIMITERS.get(left, left)} {body} \\right{DELIMITERS.get(right, right)}"


def _function(e: ET.Element) -> str:
    called = part(e, "fName").strip()
    return (f"\\{called.lower()}" if called.lower() in FUNCTIONS else called) + part(e, "e")


def _matrix(e: ET.Element) -> str:
    rows = [" & ".join(inside(c) for c in row if name(c) == "e") for row in e if name(row) == "mr"]
    return f"\\begin{{pmatrix}} {' \\\\ '.join(rows)} \\end{{pmatrix}}"


def _aligned(e: ET.Element) -> str:
    return f"\\begin{{aligned}} {' \\\\ '.join(inside(c) for c in e if name(c) == 'e')} \\end{{aligned}}"


def _brace(e: ET.Element) -> str:
    return f"\\{'overbrace' if setting(e, 'groupChrPr', 'chr') in ('\u23de', '\ufe37') else 'underbrace'}{{{part(e, 'e')}}}"


def _shape(form: str) -> Callable[[ET.Element], str]:
    """A rule that fills the element's parts into ``form``, where ``<x>`` is part x in braces."""
    pieces = form.replace(">", "<").split("<")
    return lambda e: "".join(p if i % 2 == 0 else f"{{{part(e, p)}}}" for i, p in enumerate(pieces))


def _based(tail: str) -> Callable[[ET.Element], str]:
    rest = _shape(tail)
    return lambda e: part(e, "e") + rest(e)


RULES: dict[str, Callable[[ET.Element], str]] = {
    "r": _run,
    "t": lambda e: (e.text or "").translate(_CHARACTERS),
    "sSub": _based("_<sub>"),
    "sSup": _based("^<sup>"),
    "sSubSup": _based("_<sub>^<sup>"),
    "limLow": _based("_<lim>"),
    "limUpp": _based("^<lim>"),
    "sPre": lambda e: _shape("{}_<sub>^<sup>")(e) + part(e, "e"),
    "f": _shape("\\frac<num><den>"),
    "rad": _radical,
    "nary": _nary,
    "d": _delimited,
    "func": _function,
    "acc": lambda e: f"{ACCENTS.get(setting(e, 'accPr', 'chr') or '', chr(92) + 'hat')}{{{part(e, 'e')}}}",
    "bar": lambda e: f"\\{'underline' if setting(e, 'barPr', 'pos') == 'bot' else 'overline'}{{{part(e, 'e')}}}",
    "m": _matrix,
    "eqArr": _aligned,
    "groupChr": _brace,
}


def convert(e: ET.Element) -> str:
    """One element.  Properties give nothing, unknown elements what is in them."""
    tag = name(e)
    if tag in RULES:
        return RULES[tag](e)
    return "" if tag.endswith("Pr") else inside(e)


def math_to_latex(e: ET.Element) -> str:
    """A formula between its dollar signs; a paragraph of formulas as display math."""
    if name(e) == "oMathPara":
        return f"$${' \\\\ '.join(inside(c) for c in e if name(c) == 'oMath')}$$"
    return f"${inside(e) if name(e) == 'oMath' else convert(e)}$"


def omml_to_latex(xml: str | None) -> str | None:
    """A formula's XML as LaTeX; null stays null, text that is no XML gives null."""
    if xml is None:
        return None
    try:
        return math_to_latex(ET.fromstring(xml))
    except ET.ParseError:
        return None
