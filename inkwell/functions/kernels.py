"""Parsers that regular expressions cannot express, for Arrow-batched use."""

from __future__ import annotations

import re
from collections.abc import Callable

import pyarrow as pa

from .literals import VERBATIM as VERBATIM
from .literals import group_end, mask, unmask
from .macros import expand_macros as expand_macros
from .macros import expand_with_notes as expand_with_notes
from .macros import harvest as harvest

#: Rows whose texts are Python objects at a time.
AT_ONCE = 100


def mapped(texts: pa.Array, body: Callable, kind: pa.DataType) -> pa.Array:
    """``body`` of each text that is not null, a few rows at a time: what comes of a batch
    is held as Arrow data only."""
    parts = [pa.array([None if t is None else body(t) for t in texts.slice(k, AT_ONCE).to_pylist()], kind) for k in range(0, len(texts), AT_ONCE)]
    return pa.concat_arrays(parts) if parts else pa.array([], kind)


_PERCENT = re.compile(r"((?:[^%\\]++|\\.)*+)%", re.S)


def strip_comments(text: str | None) -> str | None:
    """Comments removed outside literal passages."""
    if text is None:
        return None
    text, kept = mask(text)
    text = re.sub(r"\\begin\{comment\}.*?\\end\{comment\}", "", text, flags=re.S)
    out = []
    for line in text.split("\n"):
        if "%" in line and (m := _PERCENT.match(line)):
            if not (line := m[1].rstrip()):
                continue
        out.append(line)
    return unmask("\n".join(out), kept)


def parse_bibtex(text: str) -> list[tuple[str, str, dict[str, str]]]:
    """Key, type and fields of each entry; strings and concatenation resolved."""
    entries, strings, at = [], {}, 0
    while (m := re.compile(r"@\s*([A-Za-z]+)\s*\{").search(text, at)) is not None:
        end = group_end(text, m.end() - 1)
        if end < 0:
            break
        kind, body, at = m[1].lower(), text[m.end() : end - 1], end
        if kind in ("comment", "preamble"):
            continue
        key, _, rest = body.partition(",") if kind != "string" else ("", "", body)
        fields, i = {}, 0
        while (f := re.compile(r"\s*,?\s*([\w-]+)\s*=\s*").match(rest, i)) is not None:
            i, value = f.end(), []
            while True:
                if rest[i : i + 1] == "{":
                    stop = group_end(rest, i)
                    stop = len(rest) if stop < 0 else stop
                    value.append(rest[i + 1 : stop - 1])
                elif rest[i : i + 1] == '"':
                    stop = i + 1
                    while stop < len(rest) and rest[stop] != '"':
                        stop = group_end(rest, stop) if rest[stop] == "{" and group_end(rest, stop) > 0 else stop + 1
                    value.append(rest[i + 1 : stop])
                    stop += 1
                else:
                    word = re.compile(r"[^\s,#]*").match(rest, i)
                    value.append(strings.get(word[0].lower(), word[0]))
                    stop = word.end()
                more = re.compile(r"\s*#\s*").match(rest, stop)
                i = more.end() if more else stop
                if not more:
                    break
            fields[f[1].lower()] = re.sub(r"\s+", " ", "".join(value)).strip()
        if kind == "string":
            strings |= fields
        elif key.strip():
            entries.append((key.strip(), kind, fields))
    return entries
