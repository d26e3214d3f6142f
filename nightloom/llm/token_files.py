"""Token ids in seekable zstandard files: independent frames, a trailing seek table and a checksum for each frame.

A file holds documents in ascending order of their ids. Each frame is a zstandard frame of its own with the entries of some
documents: (count), then doc ids, flags and lengths, then the token ids as little-endian unsigned 32-bit integers. A document
longer than a frame goes on in the next one (flag 1); a null id has flag 2. Then follow a skippable frame with each frame's
first and last id, and the seek table of the public seekable format, with sizes and the lower half of each frame's XXH64. So a
reader fetches the table, looks up frames, and decompresses those of the documents that were asked for, no others.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from bisect import bisect_left
from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.fs
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from nightloom.llm import segments
from nightloom.llm.common import settle, shared_dir

#: Fixed values of the public seekable format: skippable frames of the index and the table, and the footer.
INDEX_MAGIC, TABLE_MAGIC, FOOTER_MAGIC = 0x184D2A50, 0x184D2A5E, 0x8F92EAB1
#: Token ids of a frame, about; level of compression.
FRAME_IDS, LEVEL = 1 << 16, 3
GOES_ON, NULL_ID = 1, 2
#: What stands for a null id, so that ids ascend: null ones come first.
NO_ID = -(1 << 63)


def opened(uri: str) -> tuple[pa.fs.FileSystem, str]:
    """The file system that holds ``uri``: local, HDFS, S3 and others that Arrow knows."""
    if uri.startswith("/"):
        return pa.fs.LocalFileSystem(), uri
    return pa.fs.FileSystem.from_uri(uri if "://" in uri else uri.replace("file:/", "file:///", 1))


class Writer:
    """Writes one file, frame by frame; never holds more than a frame."""

    def __init__(self, stream):
        self.stream, self.zstd, self.table, self.index = stream, zstandard.ZstdCompressor(level=LEVEL), [], []
        self.entries, self.ids, self.n, self.tokens, self.docs = [], [], 0, 0, 0

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.docs += 1
        self.tokens += len(ids)
        at, flag = 0, NULL_ID * (doc_id is None)
        while True:
            part = ids[at : at + FRAME_IDS - self.n]
            self.entries.append((NO_ID if doc_id is None else doc_id, flag, len(part)))
            self.ids.append(part)
            self.n += len(part)
            at += len(part)
            if self.n >= FRAME_IDS or len(self.entries) >= FRAME_IDS:
                self.flush()
            if at >= len(ids):
                return
            flag |= GOES_ON

    def flush(self) -> None:
        if not self.entries:
            return
        keys, flags, sizes = zip(*self.entries, strict=True)
        raw = b"".join([struct.pack("<I", len(keys)), np.array(keys, "<i8").tobytes(), np.array(flags, "u1").tobytes(), np.array(sizes, "<u4").tobytes(), np.concatenate(self.ids).astype("<u4").tobytes()])
        packed = self.zstd.compress(raw)
        self.stream.write(packed)
        self.table.append((len(packed), len(raw), xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF))
        self.index.append((keys[0], keys[-1]))
        self.entries, self.ids, self.n = [], [], 0

    def close(self) -> None:
        self.flush()
        body = b"".join(struct.pack("<qq", *x) for x in self.index)
        self.stream.write(struct.pack("<II", INDEX_MAGIC, len(body)) + body)
        table = [*self.table, (len(body) + 8, 0, 0)]
        body = b"".join(struct.pack("<III", *x) for x in table) + struct.pack("<IBI", len(table), 0x80, FOOTER_MAGIC)
        self.stream.write(struct.pack("<II", TABLE_MAGIC, len(body)) + body)
        self.stream.close()


class Reader:
    """Reads one file; ``frames_read`` counts the frames that were decompressed."""

    def __init__(self, uri: str):
        fs, path = opened(uri)
        self.file, self.frames_read = fs.open_input_file(path), 0
        size = self.file.size()
        self.file.seek(size - 9)
        count, _, magic = struct.unpack("<IBI", self.file.read(9))
        if magic != FOOTER_MAGIC:
            raise ValueError(f"{uri}: no seek table")
        self.file.seek(size - 9 - 12 * count)
        table = list(struct.iter_unpack("<III", self.file.read(12 * count)))
        starts = np.cumsum([0] + [x[0] for x in table]).tolist()
        self.table = [(s, *x) for s, x in zip(starts, table[:-1], strict=False)]
        self.file.seek(starts[-2] + 8)
        self.index = list(struct.iter_unpack("<qq", self.file.read(table[-1][0] - 8)))

    def frame(self, k: int) -> list[tuple[int | None, bool, np.ndarray]]:
        """(doc id, whether it goes on from the frame before, ids) of a frame's entries."""
        start, packed, size, check = self.table[k]
        self.file.seek(start)
        raw = zstandard.ZstdDecompressor().decompress(self.file.read(packed), max_output_size=size)
        self.frames_read += 1
        if xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF != check:
            raise ValueError(f"frame {k}: checksum differs")
        n = struct.unpack_from("<I", raw)[0]
        keys, flags = np.frombuffer(raw, "<i8", n, 4), np.frombuffer(raw, "u1", n, 4 + 8 * n)
        sizes, ids = np.frombuffer(raw, "<u4", n, 4 + 9 * n), np.frombuffer(raw, "<u4", -1, 4 + 13 * n)
        ends = np.cumsum(sizes.astype(np.int64))
        return [(None if f & NULL_ID else int(k), bool(f & GOES_ON), ids[e - s : e]) for k, f, s, e in zip(keys, flags, sizes.astype(np.int64), ends, strict=True)]

    def __iter__(self) -> Iterator[tuple[int | None, bool, np.ndarray]]:
        for k in range(len(self.table)):
            yield from self.frame(k)

    def get(self, doc_id: int) -> np.ndarray | None:
        """One document's ids from the frames that may hold it; None if it isn't here. Of rows that share an id, the first."""
        out = None
        k = bisect_left([last for _, last in self.index], doc_id)
        while k < len(self.table) and self.index[k][0] <= doc_id:
            for key, on, ids in self.frame(k):
                if key is not None and key == doc_id and (on if out is not None else not on):
                    out = ids if out is None else np.concatenate([out, ids])
                elif out is not None:
                    return out
            k += 1
        return out


def write_part(batches: Iterator[pa.RecordBatch], tokenizer: str, folder: str, end_id: int) -> Iterator[pa.RecordBatch]:
    task = TaskContext.get()
    uri = f"{folder}/part-{task.partitionId():06d}-{uuid.uuid4().hex}.ids.zst"  # a retried task writes another file
    out = None
    for batch in segments.slices(batches):
        if out is None:
            fs, path = opened(uri)
            fs.create_dir(path.rpartition("/")[0], recursive=True)
            out = Writer(fs.open_output_stream(path, compression=None))
        ids, sizes = segments.library(tokenizer).batch(batch.column("text"))
        end = np.array([end_id], np.uint32)
        for doc_id, hi, n in zip(batch.column("doc_id").to_pylist(), np.cumsum(sizes), sizes, strict=True):
            out.add(doc_id, np.concatenate([ids[hi - n : hi], end]))
    if out is not None:
        out.close()
        yield pa.record_batch([[task.partitionId()], [uri], [out.docs], [out.tokens]], names=["part", "file", "docs", "tokens"])


def write_tokens(docs: DataFrame, tokenizer: str, folder: str | None = None, *, id_col: str = "doc_id", text_col: str = "text", end_id: int = 0) -> DataFrame:
    """Encode every text, append ``end_id``, write the ids in ascending order of id, and return the files' table.

    The table has a row for each file: part (files in this order hold ascending ids), file, docs, tokens, before (ids in all
    files before it). ``folder`` defaults to a new one in the shared folder. ``tokenizer`` is a file of the tokenizers
    library at the same place on every executor. Null ids come first, null texts are empty, rows that share an id are
    neighbours; only the id and text columns are read. No rows: no files and an empty table. Files of failed tasks stay
    behind, unlisted.
    """
    folder = folder or f"{shared_dir(docs.sparkSession).rstrip('/')}/tokens-{uuid.uuid4().hex}"
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    # Rows that share an id, or have none, are parted by their texts, and equal ones by a number.
    placed = rows.withColumns({"__t": F.xxhash64("text"), "__n": F.monotonically_increasing_id()})
    placed = placed.repartitionByRange("doc_id", "__t", "__n").sortWithinPartitions("doc_id", "__t", "__n").select("doc_id", "text")
    written = settle(placed.mapInArrow(partial(write_part, tokenizer=tokenizer, folder=folder, end_id=end_id), "part long, file string, docs long, tokens long"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each file, not for each document
    return settle(written.withColumn("before", F.coalesce(F.sum("tokens").over(before), F.lit(0))))


def documents_of(reader: Reader) -> Iterator[tuple[int | None, Iterator[np.ndarray]]]:
    """(doc id, its runs of ids), one run from each frame, so that no document need be held whole."""
    from itertools import groupby

    number = -1

    def numbered():
        nonlocal number
        for key, on, ids in reader:
            number += not on
            yield number, key, ids

    for _, runs in groupby(numbered(), key=lambda x: x[0]):
        first = next(runs)
        yield first[1], (x[2] for x in [first, *runs])


def digest(runs: Iterator[np.ndarray]) -> tuple[int, int]:
    n = crc = 0
    for ids in runs:
        n, crc = n + len(ids), zlib.crc32(ids.tobytes(), crc)
    return n, crc


def whole(runs: Iterator[np.ndarray]) -> tuple[int, list[int]]:
    ids = np.concatenate(list(runs))
    return len(ids), ids


def read_parts(batches: Iterator[pa.RecordBatch], make: Callable, last: str) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for uri, start in zip(batch.column("file").to_pylist(), batch.column("before").to_pylist(), strict=True):
            rows: list[tuple] = []
            held = 0
            for doc_id, runs in documents_of(Reader(uri)):
                n, value = make(runs)
                rows.append((doc_id, start, n, value))
                start += n
                held += 1 if last == "ids_crc32" else n
                if held >= 1 << 18:
                    yield made(rows, last)
                    rows, held = [], 0
            if rows:
                yield made(rows, last)


def made(rows: list[tuple], last: str) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64() if last == "ids_crc32" else pa.list_(pa.int64())]
    return pa.record_batch([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["doc_id", "start", "n_tokens", last])


def read_tokens(files: DataFrame, *, digests: bool = False) -> DataFrame:
    """Read all documents back: doc_id, start (ids before it in all files), n_tokens, and ids, or ids_crc32 instead."""
    n = max(1, files.count())
    last, kind, make = ("ids_crc32", "long", digest) if digests else ("ids", "array<bigint>", whole)
    each = files.select("file", "before").repartition(n, "file")  # an explicit number: files aren't put together again
    return each.mapInArrow(partial(read_parts, make=make, last=last), f"doc_id long, start long, n_tokens long, {last} {kind}")
