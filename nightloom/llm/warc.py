"""Web archives (WARC 1.1, a gzip member for each record) from and to a chunked record table.

A payload is rows of (record, chunk number, bytes), so neither a shuffle nor a writer or reader holds a whole one: the writer
streams chunks into the record's member and carries the digest along, the reader streams a member out as chunk rows with the
bytes and the digest so far. Which records are revisits is settled on digests alone.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from functools import partial

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nightloom.llm.common import HOT, joined, settle, shared_dir
from nightloom.llm.token_files import opened

CHUNK = 64 << 10
#: Chunk rows that are handed over at once: about 16 MB.
AT_ONCE = 256
#: Fixed values of the format.
DATE = "2025-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
NO_ID = -(1 << 63)


def base32(sha1_hex: str) -> str:
    return base64.b32encode(bytes.fromhex(sha1_hex)).decode()


def record_id(key: int, sha1: str, url: str, copy: int) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{key}:{sha1}:{copy}:{url}')}>"


def head(r: dict) -> bytes:
    """The header of one record; ids of pages are extension fields, so that a reader gets them back."""
    response = r["record_type"] == "response"
    fields = [
        ("WARC-Type", r["record_type"]), ("WARC-Record-ID", record_id(r["key"], r["sha1"], r["url"], r["copy"])), ("WARC-Date", DATE),
        *([("WARC-Target-URI", "".join(c for c in r["url"][1:] if c >= " "))] if r["url"][1:] else []), ("WARC-Payload-Digest", f"sha1:{base32(r['sha1'])}"),
        *([] if response else [("WARC-Profile", PROFILE), ("WARC-Refers-To", record_id(r["refers_key"], r["sha1"], r["refers_url"], 0)), ("X-Refers-To-Page", r["refers_key"])]),
        *([] if r["key"] == NO_ID else [("X-Page", r["key"])]), ("X-Payload-Length", r["payload_bytes"]),
        ("Content-Type", "application/http; msgtype=response"), ("Content-Length", len(HTTP) + r["payload_bytes"] * response),
    ]
    return b"WARC/1.1\r\n" + b"".join(f"{k}: {v}\r\n".encode() for k, v in fields) + b"\r\n" + HTTP


class Writer:
    """Writes records to one stream from chunk rows in order."""

    def __init__(self, stream):
        self.stream, self.zip, self.row, self.records = stream, None, None, 0

    def put(self, r: dict) -> None:
        name = (r["key"], r["sha1"], r["url"], r["copy"])
        if self.row is None or name != self.name:
            self.end()
            self.zip, self.row, self.name, self.sha, self.next = zlib.compressobj(1, zlib.DEFLATED, 31), r, name, hashlib.sha1(), 0
            self.stream.write(self.zip.compress(head(r)))
        if r["chunk_no"] != self.next:  # a repeated row's chunk
            return
        self.next += 1
        if r["record_type"] == "response":
            self.sha.update(r["chunk"])
            self.stream.write(self.zip.compress(r["chunk"]))

    def end(self) -> None:
        if self.row is not None:
            if self.row["record_type"] == "response" and self.sha.hexdigest() != self.row["sha1"]:
                raise ValueError(f"page {self.row['key']}: digest differs")
            self.stream.write(self.zip.compress(b"\r\n\r\n") + self.zip.flush())
            self.records += 1
            self.row = None


def write_part(batches: Iterator[pa.RecordBatch], folder: str) -> Iterator[pa.RecordBatch]:
    uri, out = f"{folder}/part-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.warc.gz", None
    for batch in batches:
        if out is None and batch.num_rows:
            fs, path = opened(uri)
            fs.create_dir(path.rpartition("/")[0], recursive=True)
            out = Writer(fs.open_output_stream(path, compression=None))
        for lo in range(0, batch.num_rows, 64):
            for row in batch.slice(lo, 64).to_pylist():
                out.put(row)
    if out is not None:
        out.end()
        out.stream.close()
        yield pa.record_batch([[uri], [out.records]], names=["file", "records"])


def write_archives(pages: DataFrame, folder: str | None = None, *, id_col: str = "page_id", url_col: str = "url", body_col: str = "html", least: int = 0, chunk: int = CHUNK) -> DataFrame:
    """Write a record for each page and return the files' table: file, records.

    Every row of ``pages`` is a record with its own url. The payload is the body in UTF-8; null is empty. Of records with equal
    payloads of at least ``least`` bytes, one with the largest id is a response (of several such the one with the smallest
    url), the others are revisits of it; smaller payloads are all responses. Rows that repeat an id, a url and a payload are
    told apart by a number; a null id counts as smallest. Other columns are ignored; no rows: no files. Files of failed tasks
    stay behind, unlisted.
    """
    folder = folder or f"{shared_dir(pages.sparkSession).rstrip('/')}/warc-{uuid.uuid4().hex}"
    body = F.coalesce(F.col(body_col), F.lit("")).cast("binary")
    rows = pages.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("key"), F.coalesce(F.concat(F.lit("u"), url_col), F.lit("")).alias("url"), body.alias("body"))  # a url that is never null
    rows = rows.withColumn("sha1", F.sha1("body"))
    large = rows.filter(F.octet_length("body") >= least)
    light = settle(large.groupBy("key", "sha1", "url", F.octet_length("body").cast("long").alias("payload_bytes")).agg(F.count(F.lit(1)).alias("copies")))
    # ~key is smallest where the key is largest; no url is smaller than any
    first = light.groupBy("sha1").agg(F.min(F.struct(F.bitwise_not("key").alias("not_key"), "url")).alias("first"), F.count(F.lit(1)).alias("n"))
    first = settle(first.select("sha1", F.bitwise_not("first.not_key").alias("refers_key"), F.col("first.url").alias("refers_url"), "n"))
    each = joined(light, first, ["sha1"], "n", light.count()).withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)))
    chosen = (F.col("key") == F.col("refers_key")) & (F.col("url") == F.col("refers_url")) & (F.col("copy") == 0)
    records = each.withColumn("record_type", F.when(chosen, "response").otherwise("revisit"))
    names = ["key", "sha1", "url", "copy", "chunk_no", "chunk", "payload_bytes", "record_type", "refers_key", "refers_url"]

    def cut(df: DataFrame) -> DataFrame:
        count = F.greatest(F.ceil(F.octet_length("body") / chunk), F.lit(1)).cast("int")
        each = df.withColumn("payload_bytes", F.octet_length("body").cast("long")).withColumn("chunk_no", F.explode(F.sequence(F.lit(0), count - 1)))
        return each.withColumn("chunk", F.substring("body", F.col("chunk_no") * chunk + 1, F.lit(chunk))).drop("body")

    # Only responses need their bytes. A row that repeats very often sends its chunks once from each task.
    chunks, own = cut(large), ["key", "sha1", "url"]
    often = light.filter(F.col("copies") * HOT > light.agg(F.sum("copies")).first()[0]).select(*own) if not light.isEmpty() else light
    if not often.isEmpty():
        once = chunks.join(F.broadcast(often), own, "left_semi").groupBy(*own, "chunk_no", "payload_bytes").agg(F.any_value("chunk").alias("chunk"))
        chunks = chunks.join(F.broadcast(often), own, "left_anti").unionByName(once)
    # The writer needs a record's rows together; a join's own exchange is given up for a broadcast, or split, this one is not.
    one = records.filter("record_type = 'response'").select(*own, "copy", "record_type", "refers_key", "refers_url")
    full = chunks.repartition(*own).join(one, own).select(*names).sortWithinPartitions(*own, "chunk_no")
    bare = records.filter("record_type = 'revisit'").withColumns({"chunk_no": F.lit(0), "chunk": F.lit(None).cast("binary")}).select(*names).repartition(*own, "copy")
    table = full.unionByName(bare)
    if least > 0:  # small payloads are responses as they stand
        small = cut(rows.filter(F.octet_length("body") < least).withColumn("copy", F.monotonically_increasing_id()))
        table = table.unionByName(small.withColumns({"record_type": F.lit("response"), "refers_key": F.lit(None).cast("long"), "refers_url": F.lit(None).cast("string")}).select(*names))
    return settle(table.mapInArrow(partial(write_part, folder=folder), "file string, records long"))


class Source:
    """Bytes of a file of gzip members, decompressed a block at a time."""

    def __init__(self, stream):
        self.stream, self.zip, self.raw, self.buffer = stream, zlib.decompressobj(31), b"", b""

    def more(self) -> bool:
        while True:
            if self.zip.eof:
                self.raw, self.zip = self.zip.unused_data + self.raw, zlib.decompressobj(31)
            if not self.raw:
                self.raw = self.stream.read(1 << 18)
                if not self.raw:
                    return False
            got = self.zip.decompress(self.raw, 1 << 18)
            self.raw = self.zip.unconsumed_tail if not self.zip.eof else b""
            if got:
                self.buffer += got
                return True

    def line(self) -> bytes:
        while (i := self.buffer.find(b"\r\n")) < 0:
            if not self.more():
                raise EOFError("a record's header is cut off")
        out, self.buffer = self.buffer[:i], self.buffer[i + 2 :]
        return out

    def take(self, n: int) -> bytes:
        while len(self.buffer) < n and self.more():
            pass
        if len(self.buffer) < n:
            raise EOFError("a record is cut off")
        out, self.buffer = self.buffer[:n], self.buffer[n:]
        return out

    def fields(self) -> dict[str, str]:
        out = {}
        while line := self.line():
            k, _, v = line.decode().partition(":")
            out[k.lower()] = v.strip()
        return out


def records_of(stream, chunk: int) -> Iterator[tuple]:
    """Chunk rows of one file, as ``read_archives`` has them."""
    source = Source(stream)
    while source.buffer or source.more():
        if not source.line().startswith(b"WARC/"):
            raise ValueError("not a WARC record")
        f = source.fields()
        left = int(f["content-length"])
        before = source.line()
        left -= len(before) + 2
        while line := source.line():
            left -= len(line) + 2
        left -= 2
        page, refers = f.get("x-page"), f.get("x-refers-to-page")
        kind, digest = f["warc-type"], f["warc-payload-digest"].removeprefix("sha1:")
        base = (page and int(page), f.get("warc-target-uri"), kind, refers and (None if int(refers) == NO_ID else int(refers)))
        if kind == "revisit":
            source.take(left)
            yield (*base, 0, True, None, int(f["x-payload-length"]), digest)
        else:
            sha, seen, number = hashlib.sha1(), 0, 0
            while True:
                data = source.take(min(chunk, left))
                left, seen = left - len(data), seen + len(data)
                sha.update(data)
                now = base64.b32encode(sha.copy().digest()).decode()
                if not left and now != digest:
                    raise ValueError(f"page {page}: digest differs")
                yield (*base, number, not left, data, seen, now)
                number += 1
                if not left:
                    break
        source.take(4)


_KINDS = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int32(), pa.bool_(), pa.binary(), pa.int64(), pa.string()]
_NAMES = ["page_id", "url", "record_type", "refers_to", "chunk_no", "is_last", "chunk", "payload_bytes", "payload_digest"]


def read_part(batches: Iterator[pa.RecordBatch], chunk: int, with_data: bool) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for uri in batch.column("file").to_pylist():
            fs, path = opened(uri)
            rows: list[tuple] = []
            with fs.open_input_stream(path, compression=None) as stream:
                for r in records_of(stream, chunk):
                    if with_data or r[5]:
                        rows.append(r if with_data else (*r[:6], None, *r[7:]))
                    if len(rows) >= AT_ONCE:
                        yield pa.record_batch([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), _KINDS, strict=True)], names=_NAMES)
                        rows = []
            if rows:
                yield pa.record_batch([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), _KINDS, strict=True)], names=_NAMES)


def read_archives(files: DataFrame, *, chunk: int = CHUNK, with_data: bool = True) -> DataFrame:
    """Chunk rows of all records: page_id, url, record_type, refers_to, chunk_no, is_last, chunk, and payload_bytes and
    payload_digest (base32 SHA-1) so far, which on the last row are the whole payload's. A revisit is one row, without bytes,
    with its payload's figures. ``with_data`` False: last rows only, without their bytes. A payload that doesn't have its
    record's digest is an error."""
    n = max(1, files.count())
    kinds = "page_id long, url string, record_type string, refers_to long, chunk_no int, is_last boolean, chunk binary, payload_bytes long, payload_digest string"
    return files.select("file").repartition(n, "file").mapInArrow(partial(read_part, chunk=chunk, with_data=with_data), kinds)
