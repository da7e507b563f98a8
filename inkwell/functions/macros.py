"""The macro stage of LaTeX texts: definitions harvested, removed and expanded.

The macros of a text are a grammar: each stands for its body, and bodies use other
macros.  Before anything is written, the length of every macro's expansion follows from
those of the macros it uses, as a constant and a factor for each argument.  Macros that
lead back to themselves, or whose expansion would be too long, stay as they are, with
their definitions and a note; all others are expanded, whatever their depth.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass, replace
from functools import lru_cache

from .graphs import circular, components
from .literals import after_blanks, free_sign, group_end, mask, put_away, unmask


@dataclass(frozen=True)
class Macro:
    name: str
    arity: int
    default: str | None
    body: str


@dataclass(frozen=True)
class Definition:
    rank: int
    start: int
    end: int
    optional: bool
    macro: Macro


@dataclass(frozen=True)
class Bounds:
    """Characters that one use of a macro, and a whole text, may expand to; either bound
    is ``growth`` times the text where that is more."""

    use: int = 100_000
    text: int = 8_000_000
    growth: int = 16


_COMMAND = re.compile(r"\\(newcommand|renewcommand|providecommand)\*?\s*(?:\{\s*\\([A-Za-z@]+)\s*\}|\\([A-Za-z@]+))\s*(?:\[(\d)\])?")
_DEF = re.compile(r"\\def\s*\\([A-Za-z@]+|\d)((?:#\d)*)\s*(?=\{)")
_OPERATOR = re.compile(r"\\DeclareMathOperator(\*?)\s*\{\s*\\([A-Za-z@]+)\s*\}\s*")
_USED = re.compile(r"\\([A-Za-z@]+|\d)")
_USE = re.compile(r"\\\\|\\(?:([A-Za-z@]+)|(\d)(?![A-Za-z@]))")
_USE_OR_PLACE = re.compile(_USE.pattern + "|#([1-9])")


def definitions(text: str) -> list[Definition]:
    """All definitions, in the order in which they count: operators come after ``def``,
    which comes after the commands."""
    found: list[Definition] = []
    for m in _COMMAND.finditer(text):
        at, default = after_blanks(text, m.end()), None
        if (end := group_end(text, at, "[", "]")) > 0:
            default, at = text[at + 1 : end - 1], after_blanks(text, end)
        if (end := group_end(text, at)) > 0:
            found.append(Definition(0, m.start(), end, m[1] == "providecommand", Macro(m[2] or m[3], int(m[4] or 0), default, text[at + 1 : end - 1])))
    for m in _DEF.finditer(text):
        if (end := group_end(text, m.end())) > 0:
            found.append(Definition(1, m.start(), end, False, Macro(m[1], m[2].count("#"), None, text[m.end() + 1 : end - 1])))
    for m in _OPERATOR.finditer(text):
        if (end := group_end(text, m.end())) > 0:
            found.append(Definition(2, m.start(), end, False, Macro(m[2], 0, None, f"\\operatorname{m[1]}{{{text[m.end() + 1 : end - 1]}}}")))
    return sorted(found, key=lambda d: (d.rank, d.start))


def counting(found: Iterable[Definition]) -> dict[str, Macro]:
    """Macros by name: the last definition, ``providecommand`` only where there is none."""
    macros: dict[str, Macro] = {}
    for d in found:
        if not (d.optional and d.macro.name in macros):
            macros[d.macro.name] = d.macro
    return macros


def without(text: str, found: Iterable[Definition], keep: frozenset[str] = frozenset(), kept: list[str] | None = None) -> str:
    """The text without its definitions; those of ``keep`` are put away in ``kept``
    and leave their key.  A definition inside another one goes with it."""
    out, at = [], 0
    for d in sorted(found, key=lambda d: (d.start, -d.end)):
        if d.start < at:
            continue
        out.append(text[at : d.start])
        if d.macro.name in keep and kept is not None:
            out.append(put_away(text[d.start : d.end], kept))
            at = d.end
        else:
            at = d.end + (text[d.end : d.end + 1] == "\n")
    return "".join(out) + text[at:]


def harvest(text: str) -> tuple[dict[str, Macro], str]:
    """Macros by name, and the text without their definitions."""
    found = definitions(text)
    return counting(found), without(text, found)


class Calls:
    """Which macros use which."""

    def __init__(self, macros: dict[str, Macro]):
        self.uses = {n: sorted({u for u in _USED.findall(m.body + (m.default or "")) if u in macros}) for n, m in macros.items()}
        self.used_by: dict[str, list[str]] = {n: [] for n in macros}
        for n, used in self.uses.items():
            for u in used:
                self.used_by[u].append(n)
        parts = components(self.uses)
        self.circular = {n for p in parts if circular(p, self.uses) for n in p}
        #: Every macro that is not circular after those that it uses.
        self.inner_first = [n for p in parts for n in p if n not in self.circular]

    def _reach(self, names: Iterable[str], edges: dict[str, list[str]]) -> frozenset[str]:
        found, todo = set(names), list(names)
        while todo:
            for x in edges[todo.pop()]:
                if x not in found:
                    found.add(x)
                    todo.append(x)
        return frozenset(found)

    def needed_by(self, names: Iterable[str]) -> frozenset[str]:
        return self._reach(names, self.uses)

    def leading_to(self, names: Iterable[str]) -> frozenset[str]:
        return self._reach(names, self.used_by)


def arguments(text: str, at: int, macro: Macro) -> tuple[list[str], int] | None:
    """A use's arguments and the place after it; None where it has too few."""
    end, args = at, []
    if not macro.arity:
        gap = after_blanks(text, end)
        return args, gap + 2 if text.startswith("{}", gap) else end
    for k in range(macro.arity):
        place = after_blanks(text, end)
        if k == 0 and macro.default is not None:
            stop = group_end(text, place, "[", "]")
            args.append(text[place + 1 : stop - 1] if stop > 0 else macro.default)
            end = stop if stop > 0 else end
        elif (stop := group_end(text, place)) > 0:
            args.append(text[place + 1 : stop - 1])
            end = stop
        else:
            return None
    return args, end


#: Characters of an expansion, and how often each of nine arguments stands in it.
Length = list[int]


class Lengths:
    """The length of every macro's expansion, from the inner macros outwards."""

    deepest = 60  # arguments inside arguments that are looked into

    def __init__(self, macros: dict[str, Macro], order: Iterable[str]):
        self.macros, self.of = macros, {}
        for n in order:
            self.of[n] = self.measure(macros[n].body)

    def measure(self, text: str, left: frozenset[str] = frozenset(), depth: int = 0) -> Length:
        total, at = [0] * 10, 0
        for m in _USE_OR_PLACE.finditer(text):
            if m.start() < at:
                continue
            name = m[1] or m[2]
            if m[3]:
                total[0] += m.start() - at
                total[int(m[3])] += 1
                at = m.end()
            elif name in self.of and name not in left and (got := arguments(text, m.end(), self.macros[name])) is not None:
                own = self.of[name]
                total[0] += m.start() - at + own[0]
                for k, a in enumerate(got[0]):
                    if own[k + 1]:
                        inner = self.measure(a, left, depth + 1) if depth < self.deepest else [len(a)]
                        total = [t + own[k + 1] * x for t, x in zip(total, inner + [0] * (10 - len(inner)), strict=True)]
                at = got[1]
        total[0] += len(text) - at
        return total

    def whole(self, text: str, left: frozenset[str]) -> int:
        length = self.measure(text, left)
        return length[0] + 2 * sum(length[1:])


class Outgrown(Exception):
    """A macro whose uses grow in a way that no definition shows."""


_PLACE = re.compile(r"#(\d)")


class Expansion:
    """The texts and argument numbers, by turns, of which a macro's body is made."""

    def __init__(self, macro: Macro):
        self.macro = macro
        parts = _PLACE.split(macro.body)
        self.parts: list[str | int] = [x if k % 2 == 0 else int(x) - 1 if 0 < int(x) <= macro.arity else f"#{x}" for k, x in enumerate(parts)]
        self.fixed = sum(len(x) for x in self.parts if isinstance(x, str))
        self.given = [x for x in self.parts if isinstance(x, int)]

    def length(self, args: list[str]) -> int:
        return self.fixed + sum(len(args[g]) for g in self.given)

    def write(self, args: list[str]) -> list[str]:
        return [x if isinstance(x, str) else args[x] for x in self.parts]


def _deepest(text: str) -> int:
    """How many braces lie in braces, at most."""
    depth = most = 0
    for m in re.finditer(r"\\.|[{}\[\]]", text, re.S):
        depth = max(0, depth + (m[0] in "{[") - (m[0] in "}]"))
        most = max(most, depth)
    return most


def _settled(text: str, at: int, macro: Macro) -> bool:
    """Whether a use inside a body, whose name ends at ``at``, takes nothing from what
    will stand after the body or in place of an argument."""
    after = after_blanks(text, at)
    return after < len(text) and text[after] != "#" if not macro.arity or macro.default is not None else True


def expanded(text: str, macros: dict[str, Macro], most: int, inside: bool = False) -> str:
    """All uses of ``macros`` replaced at once, again and again until nothing changes;
    ``inside`` a body only those that are settled there.

    A pass goes one step down the calls or into the arguments, so their depths bound the
    passes, unless arguments feed a macro to itself.  Its length is known before a pass is
    written."""
    bodies = {n: Expansion(m) for n, m in macros.items()}
    first, passes, deep = text, len(macros) + 2, False
    while True:
        found, at, length = [], 0, len(text)
        for m in _USE.finditer(text):
            name = m[1] or m[2]
            if m.start() >= at and name in bodies and (got := arguments(text, m.end(), macros[name])) is not None and not (inside and not _settled(text, m.end(), macros[name])):
                found.append((m.start(), bodies[name], *got))
                at = got[1]
                length += bodies[name].length(got[0]) - (at - m.start())
        if not found:
            return text
        if not passes and not deep:  # few texts need so many that their depth must be known
            passes, deep = _deepest(first), True
        if length > most or not passes:
            raise Outgrown(max(found, key=lambda f: f[1].length(f[2]))[1].macro.name)
        out, at = [], 0
        for start, body, args, end in found:
            out.append(text[at:start])
            out += body.write(args)
            at = end
        changed = "".join(out) + text[at:]
        if changed == text:
            return text
        text, passes = changed, passes - 1


class Grammar:
    """What follows from a text's macros alone."""

    def __init__(self, macros: tuple[Macro, ...]):
        self.macros = {m.name: m for m in macros}
        self.calls = Calls(self.macros)
        self.lengths = Lengths({n: self.macros[n] for n in self.calls.inner_first}, self.calls.inner_first)
        self.weight = {n: sum(self.lengths.of[n]) for n in self.calls.inner_first}
        self._flat: dict[frozenset[str], dict[str, Macro]] = {}

    def flat(self, left: frozenset[str], most: int) -> dict[str, Macro]:
        """The macros that are not ``left``, their bodies expanded from the inner ones
        outwards, so that a chain of any depth is one step."""
        if left not in self._flat:
            made: dict[str, Macro] = {}
            for n in self.calls.inner_first:
                if n not in left:
                    m = self.macros[n]
                    uses = {u: made[u] for u in self.calls.uses[n] if u in made}
                    made[n] = replace(m, body=expanded(m.body, uses, most, inside=True)) if uses else m
            self._flat = {left: made}
        return self._flat[left]


@lru_cache(maxsize=32)
def grammar(macros: tuple[Macro, ...]) -> Grammar:
    """Documents of one author often share their macros."""
    return Grammar(macros)


_CONDITIONAL = re.compile(r"\\ifodd\s+1\s(.*?)(?:\\else(?![A-Za-z]).*?)?\\fi(?![A-Za-z])", re.S)


def expand_with_notes(text: str | None, keep_packages: bool = False, bounds: Bounds | None = None) -> tuple[str | None, list[str]]:
    """The whole macro stage for one document, and what it left undone.

    Macros are expanded whatever their depth.  Circular ones stay as they are, whatever
    their size, with their definitions and a note ``runaway:name`` for each.  So do those
    with which a use, or the whole text, would outgrow ``bounds``, and all that lead to
    them, with ``overlong:name``; also one that feeds itself through its arguments.
    Definitions that stay are not expanded, and those of the macros they use stay too.
    """
    if text is None:
        return None, []
    b = bounds or Bounds()
    text, literals = mask(text)
    text = _CONDITIONAL.sub(lambda m: m[1], text)
    found = definitions(text)
    made = grammar(tuple(counting(found).values()))
    calls, lengths, weight = made.calls, made.lengths, made.weight
    most = max(b.text, b.growth * len(text))
    bare = without(text, found)
    overlong = calls.leading_to(n for n in weight if weight[n] > max(b.use, b.growth * len(text))) - calls.circular
    if lengths.whole(bare, overlong) > most:
        # The longest are left, as few of them as bring the text below the bound.
        by_weight = sorted((n for n in weight if n not in overlong), key=lambda n: (-weight[n], n))
        low, high = 1, len(by_weight)
        leave = lambda k: calls.leading_to([*overlong, *by_weight[:k]]) - calls.circular
        while low < high:
            middle = (low + high) // 2
            low, high = (low, middle) if lengths.whole(bare, leave(middle)) <= most else (middle + 1, high)
        overlong = leave(low)

    while True:
        left = calls.circular | overlong
        kept = literals or [free_sign(text)]
        size = len(kept)
        out = without(text, found, calls.needed_by(left), kept)
        out = re.sub(r"\\(?:DeclareMathAlphabet|SetMathAlphabet)\{[^\n]*\n?", "", out)
        out = out if keep_packages else re.sub(r"\\usepackage(?:\[[^\]]*\])?\{[^}]*\}\s*", "", out)
        try:
            out = expanded(out, made.flat(frozenset(left), most), most)
            break
        except Outgrown as e:
            overlong = calls.leading_to([*overlong, e.args[0]]) - calls.circular
            del kept[size:]
    out = re.sub("\n{3,}", "\n\n", out)
    while kept[0] in out:  # literal passages may stand inside definitions
        out = unmask(out, kept)
    notes = [f"runaway:{n}" for n in sorted(calls.circular)] + [f"overlong:{n}" for n in sorted(overlong)]
    return out, notes


def expand_macros(text: str | None, keep_packages: bool = False) -> str | None:
    """The whole macro stage for one document."""
    return expand_with_notes(text, keep_packages)[0]
