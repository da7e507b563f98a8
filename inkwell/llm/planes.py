"""Token files of bit-plane shuffled, compressed id blocks with a chunk index.

A file holds ids of many documents one after another.  Ids are cut into blocks of a
fixed size; a block is transposed into byte planes (first all lowest bytes, then the
next) or bit planes, and every plane is one zstandard frame.  The footer has the
chunk index (each plane's length) and the documents' keys and id counts.

Layout: magic, frames, footer (zstandard of JSON), footer length as 8 bytes, magic.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from .ordering import in_order, ranges_of
from .shared import shared_dir, stored
from .tokens import encoder

MAGIC = b"IDPLANE1"


@dataclass(frozen=True)
class Format:
    """``unit``: "byte" or "bit" planes.  ``block`` ids are transposed at a time."""

    block: int = 1 << 16
    unit: str = "byte"
    level: int = 1


def to_planes(ids: np.ndarray, unit: str) -> list[bytes]:
    """Planes of one block, lowest first."""
    data = np.ascontiguousarray(ids, "<u4").view(np.uint8).reshape(-1, 4)
    if unit == "byte":
        return [data[:, i].tobytes() for i in range(4)]
    return [np.packbits(row).tobytes() for row in np.unpackbits(data, axis=1, bitorder="little").T]


def from_planes(planes: list[bytes], n: int, unit: str) -> np.ndarray:
    if unit == "byte":
        out = np.empty((n, 4), np.uint8)
        for i, p in enumerate(planes):
            out[:, i] = np.frombuffer(p, np.uint8)
    else:
        bits = np.stack([np.unpackbits(np.frombuffer(p, np.uint8), count=n) for p in planes], axis=1)
        out = np.packbits(bits, axis=1, bitorder="little")
    return out.reshape(-1).view("<u4")


class Writer:
    """Appends documents' ids to an open binary stream."""

    def __init__(self, stream, form: Format):
        self.out, self.form, self.waiting, self.held = stream, form, [], 0
        self.index, self.keys, self.counts = [], [], []
        self.packer = zstandard.ZstdCompressor(level=form.level)
        self.out.write(MAGIC)

    def add(self, key, ids: bytes) -> None:
        self.keys.append(key)
        self.counts.append(len(ids) // 4)
        self.waiting.append(ids)
        self.held += len(ids)
        if self.held >= 4 * self.form.block:
            self._flush(False)

    def _flush(self, last: bool) -> None:
        data, size = b"".join(self.waiting), 4 * self.form.block
        whole = len(data) if last else len(data) // size * size
        for a in range(0, whole, size):
            frames = [self.packer.compress(p) for p in to_planes(np.frombuffer(data[a : min(a + size, whole)], "<u4"), self.form.unit)]
            self.index.append([len(f) for f in frames])
            self.out.write(b"".join(frames))
        self.waiting, self.held = [data[whole:]], len(data) - whole

    def close(self) -> int:
        self._flush(True)
        footer = self.packer.compress(json.dumps({"block": self.form.block, "unit": self.form.unit, "index": self.index, "keys": self.keys, "counts": self.counts}).encode())
        self.out.write(footer + len(footer).to_bytes(8, "little") + MAGIC)
        return sum(self.counts)


class Reader:
    """Reads a file's documents in order, or the ids of any range of places."""

    def __init__(self, stream, size: int):
        self.f = stream
        self.f.seek(size - 16)
        tail = self.f.read(16)
        if tail[8:] != MAGIC:
            raise ValueError("not a complete token file")
        length = int.from_bytes(tail[:8], "little")
        self.f.seek(size - 16 - length)
        self.unpacker = zstandard.ZstdDecompressor()
        meta = json.loads(self.unpacker.decompress(self.f.read(length)))
        self.block, self.unit, self.index, self.keys, self.counts = (meta[k] for k in ("block", "unit", "index", "keys", "counts"))
        self.at = np.cumsum([len(MAGIC)] + [sum(x) for x in self.index]).tolist()
        self.total = sum(self.counts)

    def read_block(self, k: int) -> np.ndarray:
        self.f.seek(self.at[k])
        data, planes, a = self.f.read(self.at[k + 1] - self.at[k]), [], 0
        for n in self.index[k]:
            planes.append(self.unpacker.decompress(data[a : a + n]))
            a += n
        return from_planes(planes, min(self.block, self.total - k * self.block), self.unit)

    def ids(self, start: int, count: int) -> np.ndarray:
        """Any range of ids; only the blocks that it touches are read."""
        if not count:
            return np.zeros(0, "<u4")
        first, last = start // self.block, (start + count - 1) // self.block
        some = np.concatenate([self.read_block(k) for k in range(first, last + 1)])
        return some[start - first * self.block :][:count]

    def documents(self) -> Iterator[tuple[object, int, Iterator[bytes]]]:
        """Key, id count and the ids in pieces.  Take each piece before the next document."""
        k, data, used = -1, b"", 0

        def take(n: int) -> Iterator[bytes]:
            nonlocal k, data, used
            left = 4 * n
            while left:
                if used == len(data):
                    k, used = k + 1, 0
                    data = self.read_block(k).tobytes()
                part = data[used : used + left]
                used += len(part)
                left -= len(part)
                yield part

        for key, n in zip(self.keys, self.counts, strict=True):
            yield key, n, take(n)


def write_token_files(docs: DataFrame, vocabulary: str, end_id: int, form: Format | None = None) -> DataFrame:
    """Encode every whole text, end it with ``end_id`` and write token files.

    Files hold ascending ranges of doc_id, rows with equal ids by their text, a null
    id first; a null text counts as empty and so has the end id alone.  An empty
    table gives no file.  Files are written into the shared folder under names of
    their own for every attempt, so a repeated task never meets a half-written one;
    the result lists those of the attempts that ended: part, path, n_docs, n_ids and
    the place of the first id among all files (base).
    """
    form, spark = form or Format(), docs.sparkSession
    folder = shared_dir(spark, "token-files")
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    ranges = ranges_of(rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = None
        for b in batches:
            if not b.num_rows:
                continue
            if out is None:
                task, tokens = TaskContext.get(), encoder(vocabulary)
                store, path = fs.FileSystem.from_uri(folder)
                store.create_dir(path, recursive=True)
                part = b.column("part")[0].as_py()
                path = f"{path}/{part:06d}-{task.taskAttemptId()}.ids"
                stream = store.open_output_stream(path)
                out = Writer(stream, form)
            for key, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True):
                out.add(key, tokens.encode(text) + end)
        if out is not None:
            n = out.close()
            stream.close()
            yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "path": [path], "n_docs": [len(out.keys)], "n_ids": [n]})

    end = int(end_id).to_bytes(4, "little")
    dealt = in_order(rows.withColumn("part", ranges.number), ranges, "doc_id", "text")
    files = stored(dealt.mapInArrow(run, "part int, path string, n_docs long, n_ids long"), "token-list").orderBy("part").collect()  # a row for each range
    base, listed = 0, []
    for f in files:
        listed.append((folder, f.path, f.n_docs, f.n_ids, base))
        base += f.n_ids
    return spark.createDataFrame(listed, "folder string, path string, n_docs long, n_ids long, base long")


def read_token_files(files: DataFrame, key_type: str = "bigint") -> DataFrame:
    """Read the listed files back, a task each: doc_id, start (ids before the
    document in all files), n_tokens and the crc32 of its ids as little-endian
    unsigned 32-bit numbers."""
    found, keys_as = files.collect(), to_arrow_type(T._parse_datatype_string(key_type))  # a row for each file

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in b.column("id").to_pylist():
                f = found[i]
                store, _ = fs.FileSystem.from_uri(f.folder)
                with store.open_input_file(f.path) as stream:
                    keys, starts, counts, sums, at = [], [], [], [], f.base
                    for key, n, parts in Reader(stream, store.get_file_info(f.path).size).documents():
                        crc = 0
                        for p in parts:
                            crc = zlib.crc32(p, crc)
                        keys.append(key)
                        starts.append(at)
                        counts.append(n)
                        sums.append(crc)
                        at += n
                    yield pa.RecordBatch.from_arrays([pa.array(keys, keys_as), pa.array(starts, pa.int64()), pa.array(counts, pa.int64()), pa.array(sums, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    spark = files.sparkSession
    return spark.range(0, len(found), 1, max(1, len(found))).mapInArrow(run, f"doc_id {key_type}, start long, n_tokens long, ids_crc32 long")
