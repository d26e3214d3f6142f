"""Names that are alike: a similarity join by sequence matching that loses no pair.

The ratio of two names is at most twice the characters that they have in common (as a multiset) by the sum of their lengths,
and also twice the length of their longest common subsequence by that sum. Distinct names of either side are dealt to
blocks; of two blocks the pairs of fitting lengths are counted by a matrix product of their characters, then by common
subsequences with the bits of a word, both for many pairs at once, and only what is left is matched block by block of
characters. Records fan out from distinct names. That looks at all pairs of fitting lengths, by a few operations of
arithmetic each, and is quadratic in the distinct names.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, GroupedData
from pyspark.sql import functions as F

from nightloom.functions import names
from nightloom.operators.graph import parts_for, settle
from nightloom.operators.nearby import within

#: Least ratio, metres.
RATIO, NEAR = 0.8, 200.0
#: Distinct names of a block of the first and the second side; of the first that are compared at once; pairs at once.
BLOCKS, CHUNK, PAIRS = (8192, 16_384), 512, 1 << 17
#: Columns of the matrices and character codes of the masks: what comes later shares them, which only lets more pairs through.
COLUMNS, CODES = 256, 2048


def counted(left: list[str], right: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """For each name how many of its tokens (a character and which occurrence of it this is) each column has; frequent ones come first."""
    listed, number = [], Counter()
    for name in (*left, *right):
        seen = Counter()
        own = []
        for c in name:
            own.append((c, seen[c]))
            seen[c] += 1
        listed.append(own)
        number.update(own)
    column = {t: i % COLUMNS for i, (t, _) in enumerate(number.most_common())}
    out = np.zeros((len(listed), min(COLUMNS, max(1, len(number)))), np.float32)
    sizes = np.array([len(x) for x in listed], np.int64)
    np.add.at(out, (np.repeat(np.arange(len(listed)), sizes), np.array([column[t] for x in listed for t in x], np.int64)), 1)
    return out[: len(left)], out[len(left) :]


def coded(names: list[str], code: dict[str, int]) -> np.ndarray:
    """A line of character codes for each name, filled up with CODES."""
    out = np.full((len(names), max(map(len, names), default=0)), CODES, np.int32)
    for i, name in enumerate(names):
        out[i, : len(name)] = [code[c] for c in name]
    return out


def subsequence(masks: np.ndarray, sizes: np.ndarray, codes: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Length of the longest common subsequence of each pair of a first name ``i`` (its ``masks``: for each code the bits of the
    places that have it) and a second one ``j`` (its ``codes``); for a first name of over 64 characters its size."""
    row = np.full(len(i), ~np.uint64(0))
    for t in range(codes.shape[1]):
        met = row & masks[i, codes[j, t]]
        row = (row + met) | (row - met)
    m = sizes[i]
    low = np.where(m >= 64, ~np.uint64(0), (np.uint64(1) << np.minimum(m, 63).astype(np.uint64)) - np.uint64(1))
    return np.where(m > 64, m, np.minimum(m, 64) - np.bitwise_count(row & low))


def met(left: list[str], right: list[str], ratio: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of the pairs of two lists of names, both by length, that may have the ratio."""
    a, b = counted(left, right)
    code = {c: n % CODES for n, (c, _) in enumerate(Counter("".join(left) + "".join(right)).most_common())}
    size, b_size, codes = np.array([len(x) for x in left]), np.array([len(x) for x in right]), coded(right, code)
    for lo in range(0, len(left), CHUNK):
        some = left[lo : lo + CHUNK]
        first, last = (np.searchsorted(b_size, k) for k in (math.floor(len(some[0]) * ratio / (2 - ratio) - 1e-9), math.floor(len(some[-1]) * (2 - ratio) / ratio + 1e-9) + 1))
        masks = np.zeros((len(some), CODES + 1), np.uint64)
        for k, name in enumerate(some):
            for at, c in enumerate(name[:64]):
                masks[k, code[c]] |= np.uint64(1 << at)
        for start in range(first, last, PAIRS // CHUNK * 16):
            end = min(last, start + PAIRS // CHUNK * 16)
            least = ratio * (size[lo : lo + CHUNK, None] + b_size[None, start:end]) / 2 - 1e-6
            i, j = np.nonzero((a[lo : lo + CHUNK] @ b[start:end].T >= least) & (np.minimum(size[lo : lo + CHUNK, None], b_size[None, start:end]) >= least))
            for k in range(0, len(i), PAIRS):
                x, y = i[k : k + PAIRS], j[k : k + PAIRS] + start
                longest = codes[:, : b_size[y.max()]]
                fits = subsequence(masks, size[lo : lo + CHUNK], longest, x, y) >= ratio * (size[lo + x] + b_size[y]) / 2 - 1e-6
                yield lo + x[fits], y[fits]


def candidates(a: DataFrame, b: DataFrame, ratio: float = RATIO) -> DataFrame:
    """name, b_name: pairs of distinct names of which none with that ratio is missing, with enough characters in common in one order."""
    listed = lambda d: settle(d.select("name").filter("name != ''").distinct())
    left, right = listed(a), listed(b)
    n, m = (max(1, math.ceil(d.count() / k)) for d, k in zip((left, right), BLOCKS, strict=True))

    def dealt(d: DataFrame, own: str, parts: int, other: str, others: int) -> GroupedData:
        """Each name in the block that its hash says, and that block beside every one of the other side."""
        rows = d.withColumn(own, F.pmod(F.xxhash64("name"), F.lit(parts)).cast("int")).withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(others - 1))))
        return rows.repartition(n * m, "i", "j").groupBy("i", "j")

    def compared(x: pa.Table, y: pa.Table) -> pa.Table:
        left, right = (sorted(t.column("name").to_pylist(), key=len) for t in (x, y))
        out = [pa.table({"name": pa.array(left).take(pa.array(i)), "b_name": pa.array(right).take(pa.array(j))}) for i, j in met(left, right, ratio) if len(i)] if left and right else []
        return pa.concat_tables(out) if out else pa.table({"name": pa.array([], pa.string()), "b_name": pa.array([], pa.string())})

    return dealt(left, "i", n, "j", m).cogroup(dealt(right, "j", m, "i", n)).applyInArrow(compared, "name string, b_name string")


def alike(a: DataFrame, b: DataFrame, ratio: float = RATIO) -> DataFrame:
    """name, b_name, ratio for all pairs of distinct names, one of ``a`` and one of ``b``, whose ratio is at least ``ratio``.

    Names are compared as they are, so callers normalise them first. Null and empty names are alike to none.
    """
    pairs = settle(candidates(a, b, ratio))
    pairs = pairs.repartition(parts_for(pairs.count(), 20_000), "b_name").sortWithinPartitions("b_name")  # a name's pairs stand together
    return pairs.withColumn("ratio", names.ratio("name", "b_name")).filter(F.col("ratio") >= ratio)


def checked(new: DataFrame, known: DataFrame, ratio: float = RATIO, near: float = NEAR) -> DataFrame:
    """Each new record (id, name, lat, lon) with what speaks against it: hits (known records at most ``near`` metres away or with a name
    of at least that ratio, each counted once), alike (those by name), close (those by distance), best_ratio and best_id (the
    best name's ratio and the least id that has it), verdict (duplicate or new).

    Names are normalised; a null name is alike to none, a record without a place is close to none; repeated ids are records.
    """
    tidy = lambda d: d.select("id", names.normalized("name").alias("name"), "lat", "lon")
    new, known = settle(tidy(new).withColumn("row", F.monotonically_increasing_id())), settle(tidy(known))
    pairs = settle(alike(new, known, ratio))
    copies = known.groupBy(F.col("name").alias("b_name")).agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("b_id"))
    best = F.max(F.struct("ratio", (-F.col("b_id")).alias("back")))
    by_name = pairs.join(copies, "b_name").groupBy("name").agg(F.sum("n").alias("alike"), best.alias("best"))
    placed = lambda d: d.filter("lat is not null and lon is not null")
    # the fewer rows go around: known ones stay in their cells
    around = within(placed(known), placed(new), near).select(F.col("b_row").alias("row"), F.col("b_name").alias("name"), F.col("name").alias("b_name"))
    around = around.join(pairs.select("name", "b_name", F.lit(True).alias("known")), ["name", "b_name"], "left")
    by_place = around.groupBy("row").agg(F.count(F.lit(1)).alias("close"), F.count(F.when(F.col("known").isNull(), 1)).alias("only_close"))
    found = new.join(by_name, "name", "left").join(by_place, "row", "left")
    count = lambda c: F.coalesce(c, F.lit(0).cast("long"))
    hits = count(F.col("alike")) + count(F.col("only_close"))
    return found.select("id", "name", hits.alias("hits"), count(F.col("alike")).alias("alike"), count(F.col("close")).alias("close"), F.col("best.ratio").alias("best_ratio"), (-F.col("best.back")).alias("best_id"), F.when(hits > 0, "duplicate").otherwise("new").alias("verdict"))
