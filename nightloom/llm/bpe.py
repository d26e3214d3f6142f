"""Byte-level BPE encoding and decoding with numpy matrices.

The distinct pieces of a batch are laid out as rows of padded matrices, one matrix for pieces of about the same length. In
each round every row looks its adjacent pairs up in a hash table, merges the leftmost pair of least rank and closes the gap;
rows without a pair to merge leave, and the matrix is compacted to those that remain. Decoding gathers the bytes of all ids
from one buffer.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nightloom.llm import segments

NONE = np.int32(2**31 - 1)
#: Entries of a matrix, or one longer row.
ENTRIES = 1 << 20


class PairTable:
    """Ranks of adjacent pairs: open addressing in arrays, looked up for whole matrices at once."""

    def __init__(self, pairs: np.ndarray, ranks: np.ndarray):
        bits = max(4, int(np.ceil(np.log2(2.5 * len(pairs) + 1))))
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys, self.ranks = np.full(1 << bits, -1, np.int64), np.full(1 << bits, NONE, np.int32)
        todo, at = np.arange(len(pairs)), self.slot(pairs)
        while len(todo):
            free = todo[self.keys[at[todo]] == -1]
            self.keys[at[free]] = pairs[free]  # of several for one slot the last wins, the others go on
            self.ranks[at[free]] = ranks[free]
            todo = todo[self.keys[at[todo]] != pairs[todo]]
            at[todo] = (at[todo] + 1) & self.mask

    def slot(self, pairs: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((pairs.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def __call__(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank that a pair merges to, NONE if it doesn't; negative ids are padding."""
        shape = left.shape
        pairs = ((left.astype(np.int64) << 32) | right).ravel()
        out = np.full(len(pairs), NONE, np.int32)
        todo = np.flatnonzero((left.ravel() >= 0) & (right.ravel() >= 0))
        want = pairs[todo]
        at = self.slot(want)
        while len(todo):
            key = self.keys[at]
            hit = key == want
            out[todo[hit]] = self.ranks[at[hit]]
            on = ~hit & (key != -1)
            todo, want, at = todo[on], want[on], (at[on] + 1) & self.mask
        return out.reshape(shape)


class Codec:
    """A rank file (base64 of the token's bytes, and its rank, in each line) with a pattern that splits text before."""

    def __init__(self, path: str, pattern: str):
        import regex

        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in f if x.strip())}
        self.split = regex.compile(pattern).findall
        self.bytes = np.array([self.ranks[bytes([b])] for b in range(256)], np.int32)
        pairs = [(self.ranks[t[:i]] << 32 | self.ranks[t[i:]], r) for t, r in self.ranks.items() for i in range(1, len(t)) if t[:i] in self.ranks and t[i:] in self.ranks]
        self.table = PairTable(np.array([x[0] for x in pairs], np.int64), np.array([x[1] for x in pairs], np.int32))
        top = max(self.ranks.values()) + 1
        self.last = np.ones(top, bool)  # no pair with this token has a lower rank than the token itself
        for p, r in pairs:
            for part in (p >> 32, p & 0xFFFFFFFF):
                self.last[part] &= r > part
        words = [b""] * top
        for t, r in self.ranks.items():
            words[r] = t
        self.sizes = np.array([len(x) for x in words], np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.buffer = np.frombuffer(b"".join(words), np.uint8)
        self.texts = [str(i) for i in range(top)]
        self.segments = segments.Segments(self.encode_each, pattern in segments.CUT)

    def rows(self, m: np.ndarray) -> list[list[int]]:
        """All rows of a padded matrix (padding: -1), each merged to its ids.

        In a round each row merges the leftmost of its pairs of least rank. Where the new token makes no pair of lower rank
        (``last``), the equal pairs to the right of it, which would be next anyway, are merged in the same round, so a long
        row takes about as many rounds as it has ranks.
        """
        out: list[list[int]] = [[]] * len(m)
        own, size = np.arange(len(m)), (m >= 0).sum(1)
        r = self.table(m[:, :-1], m[:, 1:])
        while len(m):
            value = r.min(1) if r.shape[1] else np.full(len(m), NONE)
            over = value == NONE
            if over.any():
                for i, ids, n in zip(own[over].tolist(), m[over].tolist(), size[over].tolist(), strict=True):
                    out[i] = ids[:n]
                on = ~over
                width = int(size[on].max()) if on.any() else 0
                m, r, own, size, value = m[on, :width], r[on, : max(width - 1, 0)], own[on], size[on], value[on]
                if not len(m):
                    break
            row, at = np.nonzero(r == value[:, None])
            if len(row) > len(m):
                before = np.append(False, row[1:] == row[:-1])
                follows = before & np.append(False, at[1:] == at[:-1] + 1)
                nth = np.arange(len(at))
                on = (nth - np.maximum.accumulate(np.where(follows, 0, nth))) % 2 == 0  # of pairs that overlap, every other one
                on &= self.last[value[row]] | ~before
                row, at = row[on], at[on]
            m[row, at] = value[row]
            if len(at) == len(m) == 1:  # one row closes its gap by moving what stands behind
                i, n = int(at[0]), int(size[0]) - 1
                m[0, i + 1 : n], r[0, i + 1 : n - 1] = m[0, i + 2 : n + 1].copy(), r[0, i + 2 : n].copy()
                m, r, size = m[:, :n], r[:, : n - 1], size - 1
                near = slice(max(i - 1, 0), min(i + 1, n - 1))
                r[0, near] = self.table(m[0, near], m[0, near.start + 1 : near.stop + 1])
                continue
            keep = m >= 0
            keep[row, at + 1] = False
            to = np.cumsum(keep, 1) - 1
            size = keep.sum(1)
            width = int(size.max())
            lines, cols = np.nonzero(keep)
            places = to[lines, cols]
            m2, r2 = np.full((len(m), width), -1, np.int32), np.full((len(m), width), NONE, np.int32)
            m2[lines, places] = m[lines, cols]
            paired = cols < r.shape[1]
            r2[lines[paired], places[paired]] = r[lines[paired], cols[paired]]
            m, r = m2, r2[:, : width - 1]
            here = to[row, at]
            for left in (here, here - 1):
                fits = (left >= 0) & (left < width - 1)
                line, left = row[fits], left[fits]
                r[line, left] = self.table(m[line, left], m[line, left + 1])
        return out

    def pieces(self, pieces: list[bytes]) -> list[list[int]]:
        """Ids of each piece: its own rank if it has one, else by merges."""
        out: list[list[int]] = [[self.ranks[p]] if p in self.ranks else [] for p in pieces]
        todo = [i for i, x in enumerate(out) if not x and pieces[i]]
        sizes = np.array([len(pieces[i]) for i in todo], np.int64)
        width = np.where(sizes <= 16, sizes, 1 << np.ceil(np.log2(np.maximum(sizes, 1))).astype(np.int64))
        for w in np.unique(width):
            bucket = [todo[j] for j in np.flatnonzero(width == w)]
            for lo in range(0, len(bucket), max(1, ENTRIES // int(w))):
                some = bucket[lo : lo + max(1, ENTRIES // int(w))]
                raw = np.frombuffer(b"".join(pieces[i].ljust(int(w), b"\0") for i in some), np.uint8).reshape(len(some), int(w))
                n = np.array([len(pieces[i]) for i in some])
                m = np.where(np.arange(int(w)) < n[:, None], self.bytes[raw], np.int32(-1)).astype(np.int32)
                for i, ids in zip(some, self.rows(m), strict=True):
                    out[i] = ids
        return out

    def encode_each(self, texts: list[str]) -> list[list[int]]:
        split = [self.split(t) for t in texts]
        place = {p: i for i, p in enumerate(dict.fromkeys(p for s in split for p in s))}
        ids = self.pieces([p.encode() for p in place])
        return [ids[place[s[0]]] if len(s) == 1 else [x for p in s for x in ids[place[p]]] for s in split]

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after another, number of ids of each)."""
        return self.segments.batch(texts)

    def decode(self, ids: np.ndarray) -> bytes:
        return segments.gather(self.buffer, self.starts[ids], self.sizes[ids]).tobytes()


_open: dict[tuple[str, str], Codec] = {}


def codec(path: str, pattern: str) -> Codec:
    """One codec for each rank file in a Python worker."""
    if (path, pattern) not in _open:
        _open[path, pattern] = Codec(path, pattern)
    return _open[path, pattern]


def parts(ids: np.ndarray, sizes: np.ndarray) -> Iterator[np.ndarray]:
    ends = np.cumsum(sizes)
    return (ids[e - n : e] for e, n in zip(ends.tolist(), sizes.tolist(), strict=True))


def encoded(batches: Iterator[pa.RecordBatch], path: str, pattern: str) -> Iterator[pa.RecordBatch]:
    for batch in segments.slices(batches, most=2 << 20):
        ids, sizes = codec(path, pattern).encode(batch.column("text"))
        yield pa.record_batch([batch.column("doc_id"), pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)), pa.int32()), pa.array(ids.astype(np.int32)))], names=["doc_id", "ids"])


def encode(docs: DataFrame, path: str, pattern: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and ids of every row's whole text, each match of ``pattern`` merged separately, without special tokens.

    A null or empty text has no ids. Rows that repeat are encoded each, a null id stays null, other columns are ignored.
    ``path`` is a rank file at the same place on every executor.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(partial(encoded, path=path, pattern=pattern), "doc_id long, ids array<int>")


def decoded(batches: Iterator[pa.RecordBatch], path: str, pattern: str) -> Iterator[pa.RecordBatch]:
    c = codec(path, pattern)
    for batch in batches:
        lists = pc.fill_null(batch.column("ids"), [])
        flat, sizes = lists.flatten().to_numpy(zero_copy_only=False), pc.list_value_length(lists).to_numpy(zero_copy_only=False)
        yield pa.record_batch([batch.column("doc_id"), pa.array([c.decode(x) for x in parts(flat, sizes)], pa.binary())], names=["doc_id", "bytes"])


def decode(rows: DataFrame, path: str, pattern: str, *, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """doc_id and the bytes that the ids stand for; null or no ids give no bytes. An id that the file lacks is an error."""
    rows = rows.select(F.col(id_col).cast("long").alias("doc_id"), F.col(ids_col).alias("ids"))
    return rows.mapInArrow(partial(decoded, path=path, pattern=pattern), "doc_id long, bytes binary")


def round_trip(batches: Iterator[pa.RecordBatch], path: str, pattern: str) -> Iterator[pa.RecordBatch]:
    c = codec(path, pattern)
    for batch in segments.slices(batches, most=2 << 20):
        ids, sizes = c.encode(batch.column("text"))
        shas = [[], []]
        for own in parts(ids, sizes):
            shas[0].append(hashlib.sha256(" ".join([c.texts[i] for i in own.tolist()]).encode()).hexdigest())
            shas[1].append(hashlib.sha256(c.decode(own)).hexdigest())
        yield pa.record_batch([batch.column("doc_id"), pa.array(sizes, pa.int64()), *(pa.array(x, pa.string()) for x in shas)], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])


def digests(docs: DataFrame, path: str, pattern: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``encode`` and ``decode`` in one pass: doc_id, n_tokens, SHA-256 of the decimal ids and of the decoded bytes."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(partial(round_trip, path=path, pattern=pattern), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
