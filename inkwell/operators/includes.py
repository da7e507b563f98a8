"""Includes: which files a root leads to, by joins, and the root's text with them."""

from __future__ import annotations

import posixpath
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import notes
from ..functions.graphs import circular, components
from ..functions.paths import below, folder_of
from ..functions.text import strip_line_comments
from ..lineage import cut

#: The commands that include a file, and the list of those allowed.
USE = r"\\(input|include|subfile)\{([^}]+)\}"
_USE = re.compile(USE.replace("[^}]", "[^}\\n]"))
_ONLY = re.compile(r"\\includeonly\{([^}]*)\}")
_LITERAL = re.compile(r"(?<!\\)(?:\\\\)*%")


def _stem(path: str) -> str:
    return posixpath.splitext(path.strip())[0]


def _body(text: str) -> str:
    _, start, rest = text.partition("\\begin{document}")
    return (rest if start else text).partition("\\end{document}")[0].strip()


@dataclass(frozen=True)
class _Use:
    """An include command of a file: its text, kind and name, and the file it names."""

    text: str
    kind: str
    name: str
    target: str | None


class _Project:
    def __init__(self, files: dict[str, str | None], root: str, top: str, most: int):
        self.files, self.top, self.most = files, top, most
        only = _ONLY.search(files.get(root) or "")
        self.allowed = {_stem(x) for x in only[1].split(",")} if only else None
        self.pieces = {p: self.parse(p) for p in files}
        self.edges = {p: sorted({u.target for u in own if isinstance(u, _Use) and self.is_read(u)}) for p, own in self.pieces.items()}
        self.done: dict[str, tuple[str, list[str]]] = {}
        self.steps = 0
        for part in components(self.edges, [root]):
            loop = frozenset(part) if circular(part, self.edges) else frozenset()
            for path in part:
                self.done[path] = self.expand(path, (path,), loop)

    def find(self, name: str, folder: str) -> str | None:
        name = name.strip()
        name = name if posixpath.splitext(name)[1] else f"{name}.tex"
        tries = [posixpath.normpath(posixpath.join(f, name)) for f in (self.top, folder)]
        return next((t for t in tries if t in self.files), None)

    def parse(self, path: str) -> list[str | _Use]:
        text, out, at, line, end = self.files[path] or "", [], 0, -1, -1
        for m in _USE.finditer(text):
            if m.start() > line:  # the first on its line: where that line's comment begins
                start = text.rfind("\n", 0, m.start()) + 1
                line = text.find("\n", m.end())
                line = len(text) if line < 0 else line
                sign = _LITERAL.search(text, start, line)
                end = sign.end() - 1 if sign else line
            if m.end() <= end:
                out += [text[at : m.start()], _Use(m[0], m[1], m[2], self.find(m[2], posixpath.dirname(path)))]
                at = m.end()
        return [*out, text[at:]]

    def is_left_out(self, u: _Use) -> bool:
        return u.kind == "include" and self.allowed is not None and _stem(u.name) not in self.allowed

    def is_read(self, u: _Use) -> bool:
        return not self.is_left_out(u) and u.target is not None and self.files[u.target] is not None

    def expand(self, path: str, above: tuple[str, ...], loop: frozenset[str]) -> tuple[str, list[str]]:
        """A file's text and notes.  Files outside of its loop are done already, as what
        they give does not depend on where they are used."""
        out, told, length = [], [], 0
        self.steps += 1
        for u in self.pieces[path]:
            text = u
            if isinstance(u, _Use):
                text = u.text
                if self.is_left_out(u):
                    text = ""
                elif u.target is None:
                    told.append(f"not-found:{u.name}")
                elif self.files[u.target] is None:
                    told.append(f"unreadable:{u.name}")
                elif u.target in above:
                    told.append(f"cycle:{u.name}")
                elif u.target in loop and self.steps > 10_000:
                    told.append(f"overlong:{u.name}")
                else:
                    inner, more = self.expand(u.target, (*above, u.target), loop) if u.target in loop else self.done[u.target]
                    told += more
                    inner = _body(inner) if u.kind == "subfile" else inner
                    inner = f"\\clearpage\n{inner}\n\\clearpage" if u.kind == "include" else inner
                    if length + len(inner) > self.most:
                        told.append(f"overlong:{u.name}")
                    else:
                        text = inner
            out.append(text)
            length += len(text)
        return "".join(out), list(dict.fromkeys(told))


def flatten(files: dict[str, str | None], root: str, top: str = "", most: int = 8_000_000) -> tuple[str, list[str]]:
    """The root file with its includes, and different notes on what was left.

    A name is looked up below ``top``, the project's folder, then beside the file that
    uses it; ``.tex`` is added to names without an extension.  A file that includes one of
    its own ancestors is left out there and reported; the same file in two places is not a
    cycle, and its text is made once.  What follows a comment sign is not read.  A use
    that would make its file longer than ``most`` characters, or 16 times all the files,
    stays as it is, with a note; so do uses in a tangle of cycles beyond 10,000 steps.
    """
    most = max(most, 16 * sum(len(t or "") for t in files.values()))
    return _Project(files, root, top, most).done[root]


FLAT = T.StructType([T.StructField("content", T.StringType()), T.StructField("diagnostics", T.ArrayType(T.StringType()))])


@F.pandas_udf(T.ArrayType(FLAT))
def _flattened(projects):
    def one(files):
        found = {f["rel_path"]: f["content"] for f in files}
        roots = sorted({f["rel_path"] for f in files if f["is_root"]})
        return [dict(zip(("content", "diagnostics"), flatten(found, r), strict=True)) for r in roots]

    return projects.map(one)


def flatten_includes(files: DataFrame) -> DataFrame:
    """root_dir, content and diagnostics of each project.

    ``files``: root_dir, rel_path, content, is_root.  A project's files meet in one row,
    as they would in an editor, and many projects go to Python in one batch.  A project
    without a root gives no row; of files with one path the last by content counts.
    """
    file = F.struct("rel_path", "content", F.coalesce("is_root", F.lit(False)).alias("is_root"))
    projects = files.groupBy("root_dir").agg(F.array_sort(F.collect_list(file)).alias("files"))
    return projects.where(F.exists("files", lambda f: f["is_root"])).select("root_dir", F.explode(_flattened("files")).alias("flat")).select("root_dir", "flat.content", "flat.diagnostics")


def used_names(content: Column) -> Column:
    """The different names that a text includes, outside of comments; ``.tex`` is added
    to those without an extension."""
    named = F.transform(F.regexp_extract_all(strip_line_comments(content), F.lit(USE), 2), lambda x: F.trim(x))
    return F.array_distinct(F.transform(named, lambda x: F.when(x.rlike(r"[^./]\.[^./]*$"), x).otherwise(F.concat(x, F.lit(".tex")))))


def reached(roots: DataFrame, files: DataFrame) -> DataFrame:
    """root and path of every file that a root's text leads to, the root included.

    ``roots``: path; ``files``: path, content.  A frontier of (root, path) pairs takes one
    step along the includes at a time; pairs seen before are not taken again, so cycles
    end and the rows are as many as pairs there are, whatever lies beside the roots.  The
    top of a root is its own folder.  Each step is cut from its lineage.
    """
    known = cut(files.select("path", used_names(F.col("content")).alias("names")))  # texts are read once
    edges = known.select("path", F.explode("names").alias("name"))
    there = cut(known.select(F.col("path").alias("found")).distinct())  # a table, so that a join with it can be split at a hot name
    frontier = roots.select(F.col("path").alias("root")).distinct().join(there, F.col("root") == F.col("found"), "left_semi").withColumn("path", F.col("root"))
    frontier = seen = cut(frontier)
    while True:
        tops = F.array(folder_of(F.col("root")), folder_of(F.col("path")))
        tries = frontier.join(edges, "path").select("root", "path", "name", F.posexplode(F.transform(tops, lambda t: below(t, F.col("name")))).alias("priority", "tried"))
        hits = tries.join(there, F.col("tried") == F.col("found")).groupBy("root", "path", "name").agg(F.min_by("found", "priority").alias("next"))
        frontier = cut(hits.select("root", F.col("next").alias("path")).distinct().join(seen, ["root", "path"], "left_anti"))
        if frontier.isEmpty():
            return seen
        seen = cut(seen.unionByName(frontier))


def _last_of(own: list[dict]) -> dict[str, str | None]:
    last: dict[str, str | None] = {}
    for f in own:
        path, content = f["path"], f["content"]
        last[path] = last.get(path) if content is None else max(last.get(path) or "", content)
    return last


def flatten_roots(roots: DataFrame, files: DataFrame, after: Callable[[str], tuple[str, list[str]]] | None = None) -> DataFrame:
    """path, content and notes of each root, with the files that it leads to.  ``after``
    is what else a text needs from Python, its new text and notes, in the same hop.

    ``roots``: path; ``files``: path, content (null: unreadable).  Only the files that a
    root reaches meet in its row.  A root that is not among the files gives no row; of
    files with one path the last by content counts.
    """
    pairs = reached(roots, files).join(files.select("path", "content"), "path")
    whole = pairs.groupBy("root").agg(F.collect_list(F.struct("path", "content")).alias("files"))

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 256):  # so many projects are Python objects at a time
                some, rows = b.slice(at, 256), []
                for root, own in zip(some.column("root").to_pylist(), some.column("files").to_pylist(), strict=True):
                    text, told = flatten(_last_of(own), root, posixpath.dirname(root))
                    text, more = after(text) if after else (text, [])
                    rows.append((root, text, told + more))
                kinds = (pa.string(), pa.string(), pa.list_(pa.string()))
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["path", "content", "diagnostics"])

    flat = whole.mapInArrow(made, "path string, content string, diagnostics array<string>")
    return flat.select("path", "content", notes.parsed(F.col("diagnostics")).alias("notes"))
