"""Brackets that layout extraction leaves around pieces of formulas."""

from __future__ import annotations

#: A bracketed hat, and the brackets around an index's parentheses.
HAT, OPENING, CLOSING = "[ˆ]", "[(]", "[)]"


def _tokens(text: str) -> list[str]:
    """Bracket groups (from ``[`` to the next ``]``) and the texts between them."""
    out, at = [], 0
    while (a := text.find("[", at)) >= 0 and (z := text.find("]", a)) >= 0:
        out += [text[at:a]] * (a > at) + [text[a : z + 1]]
        at = z + 1
    return out + [text[at:]] * (at < len(text))


def _is_group(token: str) -> bool:
    return token.startswith("[") and token.endswith("]")


def _index(tokens: list[str], at: int) -> tuple[str, int] | None:
    """What stands between an index's parentheses, one group or text, and the place
    after the closing one."""
    held: list[str] = []
    for k in range(at, min(at + 4, len(tokens))):
        if tokens[k] == CLOSING:
            if len(held) > 1:
                return None
            inner = held[0] if held else ""
            return inner[1:-1] if _is_group(inner) else inner.strip(), k + 1
        held += [tokens[k]] * bool(tokens[k].strip())
    return None


def _without_indexes(text: str) -> str:
    tokens, out, at = _tokens(text), [], 0
    while at < len(tokens):
        found = _index(tokens, at + 1) if tokens[at] == OPENING else None
        inner, at = (f"({found[0]})", found[1]) if found else (tokens[at], at + 1)
        out.append(inner)
    return "".join(out)


def _without_runs(text: str) -> str:
    """Two or more groups side by side that are no numbers give their contents."""
    tokens, out, at = _tokens(text), [], 0
    while at < len(tokens):
        run, k = [], at
        while k < len(tokens) and _is_group(tokens[k]) and tokens[k][1:-1] and not tokens[k][1].isdecimal():
            run.append(tokens[k][1:-1])
            k += 1
            if k < len(tokens) and not tokens[k].strip():
                k += 1
        if len(run) < 2:
            out.append(tokens[at])
            at += 1
            continue
        out.append(" ".join(run) + " ")
        if k < len(tokens) and not _is_group(tokens[k]):
            tokens[k] = tokens[k].lstrip()
        at = k
    return "".join(out)


def clean(text: str) -> str:
    """Hats, indexes and runs of groups, in this order."""
    return _without_runs(_without_indexes(text.replace(HAT, "^"))) if "[" in text else text


def clean_lines(text: str) -> str:
    """The same in every line but those of pipe tables."""
    return "\n".join(x if x.lstrip().startswith("|") else clean(x) for x in text.split("\n"))
