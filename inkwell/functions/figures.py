"""Figures and graphics of LaTeX texts, found by their braces."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

from .literals import after_blanks, group_end

GRAPHIC, BEGIN, END = "\\includegraphics", "\\begin{figure}", "\\end{figure}"


@dataclass(frozen=True)
class Hit:
    """A stretch of a text with its graphic, and a figure's label and caption."""

    start: int
    end: int
    name: str
    label: str | None = None
    caption: str | None = None


def argument(text: str, command: str, at: int, end: int, options: bool = False) -> tuple[int, int, str] | None:
    """Start and end of the first use of ``command`` with a group behind it, and what the
    group holds, braces of any depth included."""
    while (start := text.find(command, at, end)) >= 0:
        place = start + len(command)
        if options:
            place = after_blanks(text, place)
            if (after := group_end(text, place, "[", "]")) > 0:
                place = after
            place = after_blanks(text, place)
        stop = group_end(text, place)
        if place + 1 < stop - 1 and stop <= end:
            return start, stop, text[place + 1 : stop - 1]
        at = start + len(command)
    return None


def graphics(text: str) -> Iterator[Hit]:
    at = 0
    while (found := argument(text, GRAPHIC, at, len(text), options=True)) is not None:
        yield Hit(*found)
        at = found[1]


def figures(text: str) -> Iterator[Hit]:
    """The figure environments that hold a graphic, with the first one's name."""
    at = 0
    while (start := text.find(BEGIN, at)) >= 0 and (end := text.find(END, start)) >= 0:
        at = end + len(END)
        if (graphic := argument(text, GRAPHIC, start, end, options=True)) is not None:
            label, caption = (argument(text, c, start, end) for c in ("\\label", "\\caption"))
            yield Hit(start, at, graphic[2], label and text[label[0] : label[1]], caption and caption[2])


def commented(text: str) -> str:
    """A text that goes on in a comment from line to line."""
    return text.replace("\n", "\n% ")


def in_a_figure(hit: Hit, summary: str) -> str:
    caption = None if hit.caption is None else f"% Caption: {commented(hit.caption)}"
    lines = ["% --- Figure summary ---", hit.label, caption, f"% {commented(summary)}", "% --- End figure summary ---"]
    return "\n".join(x for x in lines if x)


def _replaced(text: str, hits: Iterator[Hit], told: dict[str, str], stem: re.Pattern, made: Callable[[Hit, str], str]) -> str:
    out, at = [], 0
    for h in hits:
        if (summary := told.get(stem.sub("", h.name.strip()))) is not None:
            out += [text[at : h.start], made(h, summary)]
            at = h.end
    return "".join(out) + text[at:]


def substituted(text: str, told: dict[str, str], stem: re.Pattern) -> str:
    """The text where figures, then single graphics, give way to their summaries.
    ``stem``: what is cut off a graphic's name to have its key in ``told``."""
    text = _replaced(text, figures(text), told, stem, in_a_figure)
    return _replaced(text, graphics(text), told, stem, lambda _, s: f"% [Image: {commented(s)}]")
