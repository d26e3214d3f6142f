"""Byte-level BPE over whole columns of text by distinct segments.

The pattern that splits a text before the merges never crosses a single space or line feed between two other characters:
the space belongs to what follows, the line feed is a piece of its own. So a text is cut at these places by Arrow, each
distinct segment is encoded once and remembered, and a text's ids are put together from its segments'. Texts with other
white space or runs of it (and empty ones) are encoded whole.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: White space other than single spaces and line feeds within a text: such a text has no safe places to cut.
_OTHER = r"[\t\r\x0b\x0c\x1c-\x1f\x{85}\x{a0}\x{1680}\x{180e}\x{2000}-\x{200b}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]|[ \n][ \n]|^[ \n]|[ \n]$|^$"
#: The patterns that a text is cut for.
CUT = (r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+",)
#: Marks a text's first segment, which has no space before it; texts with this character are encoded whole.
_FIRST = "\r"
#: Bytes of text that are worked on at once, segments that are remembered, segments that are encoded at once.
SLICE, REMEMBERED, AT_ONCE = 8 << 20, 800_000, 20_000


def gather(flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """flat[s : s + n] of all (s, n) one after another."""
    ends = np.cumsum(sizes)
    if not len(ends) or not ends[-1]:
        return flat[:0]
    return flat[np.repeat(starts - (ends - sizes), sizes) + np.arange(ends[-1], dtype=starts.dtype)]


class Segments:
    """``encode``: ids of each string of a list, as the tokenizer gives them for that string alone. ``cut``: its pattern parts texts
    where this module says; others' texts are encoded whole."""

    def __init__(self, encode: Callable[[list[str]], list[list[int]]], cut: bool = True):
        self.encode, self.cut = encode, cut
        self.forget()

    def forget(self) -> None:
        self.known, self.flat, self.sizes = pa.array([], pa.string()), np.zeros(0, np.uint32), np.zeros(0, np.int64)

    def learn(self, keys: pa.Array, texts: list[str]) -> None:
        for lo in range(0, len(texts), AT_ONCE):
            ids = self.encode(texts[lo : lo + AT_ONCE])
            sizes = np.fromiter(map(len, ids), np.int64, len(ids))
            self.flat = np.concatenate([self.flat, np.fromiter(itertools.chain.from_iterable(ids), np.uint32, int(sizes.sum()))])
            self.sizes = np.concatenate([self.sizes, sizes])
        self.known = pa.concat_arrays([self.known, keys])

    def places(self, keys: pa.Array) -> np.ndarray:
        found = pc.index_in(keys, value_set=self.known)
        if found.null_count:
            if len(self.known) > REMEMBERED:
                self.forget()
                return self.places(keys)
            new = keys.filter(pc.is_null(found))
            self.learn(new, [k[1:] if k[0] == _FIRST else k if k[0] == "\n" else " " + k for k in new.to_pylist()])
            found = pc.index_in(keys, value_set=self.known)
        return found.to_numpy(zero_copy_only=False)

    def fast(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        parts = pc.split_pattern(pc.replace_substring(pc.binary_join_element_wise(_FIRST, texts, ""), "\n", " \n"), " ")
        words = parts.flatten().dictionary_encode()
        place = self.places(words.dictionary)[words.indices.to_numpy()]
        starts, sizes = (np.cumsum(self.sizes) - self.sizes)[place], self.sizes[place]
        begin = parts.offsets.to_numpy()[:-1] - parts.offsets[0].as_py()
        return gather(self.flat, starts, sizes), np.add.reduceat(sizes, begin) if len(begin) else np.zeros(0, np.int64)

    def batch(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(all ids in one array, number of ids of each text); null is empty."""
        texts = pc.fill_null(texts, "").cast(pa.string())
        other = pc.match_substring_regex(texts, _OTHER) if self.cut else pa.array(np.ones(len(texts), bool))
        if not pc.any(other).as_py():
            return self.fast(texts)
        ids, n = self.fast(texts.filter(pc.invert(other)))
        rest = self.encode(texts.filter(other).to_pylist())
        flat = np.concatenate([ids, np.fromiter(itertools.chain.from_iterable(rest), np.uint32)])
        whole, sizes = other.to_numpy(zero_copy_only=False), np.zeros(len(texts), np.int64)
        sizes[~whole], sizes[whole] = n, list(map(len, rest))
        starts = np.zeros(len(texts), np.int64)
        starts[~whole] = np.cumsum(n) - n
        starts[whole] = len(ids) + np.cumsum(sizes[whole]) - sizes[whole]
        return gather(flat, starts, sizes), sizes


def slices(batches: Iterator[pa.RecordBatch], text: str = "text", most: int = SLICE) -> Iterator[pa.RecordBatch]:
    """The rows in order, about ``most`` bytes of text at a time, or one longer text."""
    for batch in batches:
        size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False))
        lo = 0
        while lo < batch.num_rows:
            hi = max(lo + 1, int(np.searchsorted(size, (size[lo - 1] if lo else 0) + most, side="right")))
            yield batch.slice(lo, hi - lo)
            lo = hi


_open: dict[str, Segments] = {}


def library(path: str) -> Segments:
    """A file of the tokenizers library, loaded once in a Python worker; without special tokens."""
    if path not in _open:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(path)
        t.encode_special_tokens = True
        _open[path] = Segments(lambda texts: [x.ids for x in t.encode_batch_fast(texts, add_special_tokens=False)])
    return _open[path]
