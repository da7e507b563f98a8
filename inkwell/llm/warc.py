"""WARC archives with resolved revisits.

Headers (no payloads) are grouped by payload digest; each digest with copies names
one original.  Pages join that small table, and every task writes an archive in
which a copy is a revisit record that refers to the original's response record.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from typing import BinaryIO

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import shared_dir, stored


@dataclass(frozen=True)
class Archive:
    """Payloads under ``least_bytes`` are never revisits.  ``date`` stamps the fresh
    headers, so that a repeated task writes the same bytes.  ``salts`` tasks share
    the pages of one digest."""

    least_bytes: int = 100
    date: str = "2025-01-01T00:00:00Z"
    salts: int = 32
    level: int = 1


PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def record_id(page_id: int | None) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def page_of(identifier: str) -> int | None:
    number = identifier.removeprefix("<urn:page:").removesuffix(">")
    return int(number) if number else None


def _one_line(value: str) -> str:
    """A header's value: control characters as percent escapes."""
    return "".join(c if c >= " " and c != "\x7f" else f"%{ord(c):02X}" for c in value)


def write_record(page_id: int | None, url: str | None, payload: bytes, refers_to: tuple[int | None] | None, archive: Archive) -> bytes:
    """One record, a gzip member of its own.  A revisit holds no payload but says
    its length, digest and original."""
    digest = base64.b32encode(hashlib.sha256(payload).digest()).decode()
    fields = [("WARC-Type", "revisit" if refers_to else "response"), ("WARC-Record-ID", record_id(page_id)), ("WARC-Date", archive.date), ("WARC-Payload-Digest", f"sha256:{digest}")]
    if url is not None:
        fields.append(("WARC-Target-URI", _one_line(url)))
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    if refers_to:
        fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To", record_id(refers_to[0]))]
    block = head if refers_to else head + payload
    fields += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    text = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n"
    return gzip.compress(text.encode() + block + b"\r\n\r\n", archive.level, mtime=0)


def read_records(stream: BinaryIO) -> Iterator[tuple[dict[str, str], dict[str, str], bytes]]:
    """WARC headers, HTTP headers and payload of each record of an archive."""

    def headers(read) -> dict[str, str]:
        found = {}
        while (line := read().rstrip(b"\r\n")):
            key, _, value = line.decode().partition(": ")
            found[key] = value
        return found

    with gzip.open(stream) as f:
        while line := f.readline():
            if not line.startswith(b"WARC/"):
                raise ValueError("not at the start of a record")
            warc = headers(f.readline)
            block = f.read(int(warc["Content-Length"]))
            if f.read(4) != b"\r\n\r\n":
                raise ValueError("a record has a wrong length")
            head, _, payload = block.partition(b"\r\n\r\n")
            lines = iter([*head.split(b"\r\n")[1:], b""])
            yield warc, headers(lambda lines=lines: next(lines)), payload


def resolve_revisits(pages: DataFrame, archive: Archive | None = None) -> DataFrame:
    """Add ``refers_to``, a struct with the original's page_id: null for responses.

    Of the rows with equal payloads of ``least_bytes`` or more, the smallest page_id
    is the original; a null page_id counts as the largest, and of rows with the same
    id as the original (repeated rows) all are responses.
    """
    o = archive or Archive()
    payload = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    headers = pages.select("page_id", F.octet_length(payload).alias("n"), F.unhex(F.sha2(payload, 256)).alias("digest")).where(F.col("n") >= o.least_bytes)
    groups = headers.groupBy("digest").agg(F.min("page_id").alias("original"), F.count("*").alias("copies")).where("copies > 1")
    salted = groups.select(F.col("digest").alias("_digest"), F.struct("original").alias("_original"), F.explode(F.sequence(F.lit(0), F.lit(o.salts - 1))).alias("_salt"))
    known = pages.select("page_id", "url", "html", F.unhex(F.sha2(payload, 256)).alias("_own"), F.pmod(F.xxhash64("page_id", "url"), F.lit(o.salts)).cast("int").alias("_share"))
    joined = known.join(salted, (F.col("_own") == F.col("_digest")) & (F.col("_share") == F.col("_salt")), "left")
    revisit = F.col("_original").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("_original.original"))
    return joined.select("page_id", "url", "html", F.when(revisit, F.col("_original")).alias("refers_to"))


def write_archives(pages: DataFrame, archive: Archive | None = None) -> DataFrame:
    """Write a record for every row of ``pages`` (page_id, url, html) and list the
    archives: path, n_records and n_bytes.

    A null html is an empty payload, a null url leaves the header out; other columns
    are ignored, an empty table writes no archive.  Every attempt of a task writes a
    file of its own into the shared folder; only those of attempts that ended count.
    """
    o = archive or Archive()
    folder = shared_dir(pages.sparkSession, "warc")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, n = None, 0
        for b in batches:
            for page_id, url, html, ref in zip(*[b.column(c).to_pylist() for c in ("page_id", "url", "html", "refers_to")], strict=True):
                if out is None:
                    task = TaskContext.get()
                    store, top = fs.FileSystem.from_uri(folder)
                    store.create_dir(top, recursive=True)
                    path = f"{top}/part-{task.partitionId():06d}-{task.taskAttemptId()}.warc.gz"
                    out = store.open_output_stream(path, compression=None)
                out.write(write_record(page_id, url, (html or "").encode("utf-8", "surrogatepass"), (ref["original"],) if ref else None, o))
                n += 1
        if out is not None:
            size = out.tell()
            out.close()
            yield pa.RecordBatch.from_pydict({"path": [path], "n_records": [n], "n_bytes": [size], "folder": [folder]})

    return stored(resolve_revisits(pages, o).mapInArrow(run, "path string, n_records long, n_bytes long, folder string"), "warc-list")


def read_archives(files: DataFrame) -> DataFrame:
    """Read listed archives back, record by record: page_id, url, record_type,
    refers_to, payload_bytes and payload_digest (hexadecimal SHA-256) of the full
    payload, and payload (null for a revisit).  A response's digest is computed anew
    from its payload."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, folder in zip(b.column("path").to_pylist(), b.column("folder").to_pylist(), strict=True):
                store, _ = fs.FileSystem.from_uri(folder)
                with store.open_input_stream(path, compression=None) as stream:
                    rows, held = [], 0
                    for warc, http, payload in read_records(stream):
                        kind, digest = warc["WARC-Type"], base64.b32decode(warc["WARC-Payload-Digest"].removeprefix("sha256:")).hex()
                        if kind == "response" and hashlib.sha256(payload).hexdigest() != digest:
                            raise ValueError(f"{path}: a payload differs from its digest")
                        refers = page_of(warc["WARC-Refers-To"]) if kind == "revisit" else None
                        rows.append((page_of(warc["WARC-Record-ID"]), warc.get("WARC-Target-URI"), kind, refers, int(http["Content-Length"]), digest, payload if kind == "response" else None))
                        held += len(payload)
                        if len(rows) >= 2000 or held > 8_000_000:
                            yield batch(rows)
                            rows, held = [], 0
                    if rows:
                        yield batch(rows)

    names = ["page_id", "url", "record_type", "refers_to", "payload_bytes", "payload_digest", "payload"]
    kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary()]

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    dealt = files.repartition(files.sparkSession.sparkContext.defaultParallelism * 4, "path")
    return dealt.mapInArrow(run, "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary")
