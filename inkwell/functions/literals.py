"""Literal passages and balanced groups of LaTeX texts."""

from __future__ import annotations

import re

#: Environments whose content is never read as LaTeX.
VERBATIM = ("verbatim", "lstlisting", "minted")
_LITERAL = re.compile(r"\\verb\*?([^A-Za-z\s*])(?:(?!\1)[^\n])+\1|\\begin\{(" + "|".join(VERBATIM) + r")\}.*?\\end\{\2\}", re.S)


#: Characters that may stand around a key: private use, then the rarest planes.
_SIGNS = (*range(0xF8FF, 0xDFFF, -1), *range(0x10FFFD, 0xEFFFF, -1))


def mask(text: str) -> tuple[str, list[str]]:
    """Literal passages replaced by keys, in one pass from the left.  A key stands
    between two signs, a character that the text does not have: the first of ``kept``."""
    if not _LITERAL.search(text):
        return text, []
    kept: list[str] = [free_sign(text)]
    return _LITERAL.sub(lambda m: put_away(m[0], kept), text), kept


def free_sign(text: str) -> str:
    seen = set(text)
    sign = next((c for c in map(chr, _SIGNS) if c not in seen), None)
    if sign is None:
        raise ValueError("a text holds every private character")
    return sign


def put_away(passage: str, kept: list[str]) -> str:
    """The key of a passage that is added to ``kept``."""
    kept.append(passage)
    return f"{kept[0]}{len(kept) - 1}{kept[0]}"


def unmask(text: str, kept: list[str]) -> str:
    return re.sub(f"{kept[0]}(\\d+){kept[0]}", lambda m: kept[int(m[1])], text) if kept else text


_SIGNS_OF_GROUPS = {"{": re.compile(r"\\.|[{}]", re.S), "[": re.compile(r"\\.|[\[\]]", re.S)}


def group_end(text: str, at: int, opening: str = "{", closing: str = "}") -> int:
    """The place after the group that opens at ``at``; -1 where it has no end."""
    if not text.startswith(opening, at):
        return -1
    depth = 0
    for m in _SIGNS_OF_GROUPS[opening].finditer(text, at):
        depth += (m[0] == opening) - (m[0] == closing)
        if not depth:
            return m.end()
    return -1


def after_blanks(text: str, at: int) -> int:
    while at < len(text) and text[at].isspace():
        at += 1
    return at
