"""Near-duplicate classes by DartMinHash signatures, banded joining and exact verification.

A document is a weighted set: its shingles of five words, each with its number of occurrences as its weight. Every element
owns a strip of the plane, one unit of the weight axis for each unit of weight. Darts fall on strips as a Poisson process
that a hash of (element, unit, cell of the rank axis) fixes, so equal regions of two documents hold equal darts. A document
collects the darts of its regions in order of rank until each of the signature's coordinates has one, and keeps the earliest
dart of each coordinate. Two signatures agree in a coordinate with the probability of their weighted Jaccard similarity.
A document of n shingles and a signature of k take O(n + k log k), not O(n k).

With 32 bands of 5 coordinates a pair at similarity 0.8 shares no band with a probability of 3e-6. Within a band's bucket
nobody compares all pairs: each member meets the bucket's pivot, another one in each band, links are verified exactly on
whole texts, and only where a bucket still falls into several components those of its members are compared in blocks that share
one of their rarest elements with a member of another component.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nightloom.llm.common import HOT, joined, settle
from nightloom.operators.graph import components, parts_for

WORDS, SIMILAR, BANDS, ROWS = 5, 0.8, 32, 5
#: Rank cells: the first has this length, each of the following is half as long as all before it.
FIRST_CELL = 1 / 16
#: Bytes and rows of text that are hashed at once, and rows of a block in block comparisons.
SLICE, SLICE_ROWS, BLOCK = 1 << 20, 1024, 256
#: Rounds in which members outside a bucket's largest class meet one of it, before the rest is compared in blocks.
MEETINGS = 2
#: Counters of a sketch of element frequencies, a power of two: 2 MB.
SKETCH = 1 << 18
#: Links of a node that may meet in one task, however few links there are.
FEW = 256

U = np.uint64
ODD = U(0x9E3779B97F4A7C15)
with np.errstate(over="ignore"):
    BASE = U(0x100000001B3)
    INVERSE = U(pow(0x100000001B3, -1, 1 << 64))
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values (the finaliser of splitmix64)."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


_powers: list[np.ndarray] = []


def powers(n: int) -> list[np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        _powers[:] = [np.concatenate([np.ones(1, U), np.multiply.accumulate(np.full(max(n, 2 * SLICE), b, U))]) for b in (BASE, INVERSE)]
    return _powers


def word_hashes(data: np.ndarray, breaks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and start of each word in UTF-8 bytes; a word also ends at the places in ``breaks``."""
    space = _SPACE[data]
    inside = ~space
    first = inside.copy()
    first[1:] &= space[:-1]
    cut = breaks[(breaks > 0) & (breaks < len(data))]
    first[cut] = inside[cut]
    starts = np.flatnonzero(first)
    last = inside.copy()
    last[:-1] &= space[1:]
    last[cut - 1] = inside[cut - 1]
    ends = np.flatnonzero(last) + 1
    up, down = powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, U)
    np.cumsum((data.astype(U) + U(1)) * up[: len(data)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(U) * ODD), starts


def elements(data: np.ndarray, offsets: np.ndarray, words: int = WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, element) pairs of texts in one buffer, and a 128-bit fingerprint of each text's words.

    An element stands for a shingle's i-th occurrence in its document. A text of fewer words than a shingle takes is one
    shingle; one without words has none.
    """
    n = len(offsets) - 1
    hashed, at = [np.zeros(0, U)], [np.zeros(0, np.int64)]
    lo = 0
    while lo < len(data):  # slices end at white space or between texts
        hi = min(lo + SLICE, len(data))
        while hi < len(data) and not _SPACE[data[hi]]:
            step = np.flatnonzero(_SPACE[data[hi : hi + SLICE]])
            hi = hi + int(step[0]) if len(step) else min(hi + SLICE, len(data))
        h, s = word_hashes(data[lo:hi], offsets - lo)
        hashed.append(h)
        at.append(s + lo)
        lo = hi
    w, at = np.concatenate(hashed), np.concatenate(at)
    ends = np.searchsorted(at, offsets)  # words before each text
    count = np.diff(ends)
    doc = np.repeat(np.arange(n), count)
    place = np.arange(len(w)) - ends[doc]
    up = powers(int(place.max()) + 2 if len(place) else 1)[0]
    prints = np.zeros((n, 2), U)
    for i, salt in enumerate((U(1), U(0x7FEB352D))):
        full = count > 0
        if full.any():
            prints[full, i] = mix(np.add.reduceat(mix(w + salt) * up[place], ends[:-1][full]) + count[full].astype(U))
    whole = np.flatnonzero(place + words <= count[doc])
    short = np.flatnonzero((count > 0) & (count < words))
    sh = np.zeros(len(whole), U)
    for i in range(words):
        sh = sh * U(0xD6E8FEB86659FD93) + w[whole + i]
    e_doc, e = np.concatenate([doc[whole], short]), mix(np.concatenate([sh, prints[short, 0]]))
    key = mix(e + e_doc.astype(U) * ODD)  # brings equal shingles of a document together
    order = np.argsort(key, kind="stable")
    key, e, e_doc = key[order], e[order], e_doc[order]
    new = np.ones(len(key), bool)
    new[1:] = key[1:] != key[:-1]
    run = np.flatnonzero(new)
    nth = np.arange(len(key)) - np.repeat(run, np.diff(np.append(run, len(key))))
    return e_doc, mix(e + nth.astype(U) * U(0xA0761D6478BD642F)), prints


@lru_cache(64)
def poisson_cdf(mean: float) -> np.ndarray:
    """Cumulative probabilities of 0, 1, 2 ... as far as they differ from 1."""
    i = np.arange(int(mean + 12 * np.sqrt(mean) + 40))
    logs = np.concatenate([[0.0], np.cumsum(np.log(i[1:]))])
    return np.cumsum(np.exp(i * np.log(mean) - mean - logs))


def signatures(e_doc: np.ndarray, e: np.ndarray, n: int, k: int, share: np.ndarray | None = None) -> np.ndarray:
    """n x k signatures: of each document the earliest dart of each coordinate; rows without elements are 0.

    ``share``: how much of its unit of weight an element fills, 1 where not given, so real weights are sums of units and
    a rest.
    """
    weight = np.bincount(e_doc, weights=share, minlength=n)
    goal = k * (np.log(k) + 1) / np.maximum(weight, 1e-9)  # up to this rank most coordinates have a dart
    best, sig = np.full(n * k, np.inf), np.zeros(n * k, U)
    todo, cell, lo, size = weight > 0, 0, 0.0, FIRST_CELL
    while todo.any():
        pick = todo[e_doc]
        x, d = e[pick], e_doc[pick]
        base = mix(x + U(cell + 1) * U(0xE7037ED1A0B428DB))
        number = np.searchsorted(poisson_cdf(size), (base >> U(11)) * 2.0**-53, side="right")
        hit = np.repeat(np.arange(len(x)), number)
        nth = np.arange(len(hit)) - np.repeat(np.cumsum(number) - number, number)
        dart = mix(base[hit] + (nth + 1).astype(U) * U(0x8EBC6AF09C88C6E3))
        if share is not None:
            on = (mix(dart ^ ODD) >> U(11)) * 2.0**-53 < share[pick][hit]
            dart, hit = dart[on], hit[on]
        rank = lo + size * ((mix(dart + ODD) >> U(11)) * 2.0**-53)
        slot = d[hit] * k + (dart % U(k)).astype(np.int64)
        late = rank < best[slot]
        slot, rank, dart = slot[late], rank[late], dart[late]
        np.minimum.at(best, slot, rank)
        won = best[slot] == rank
        sig[slot[won]] = dart[won]
        lo, cell = lo + size, cell + 1
        size = lo / 2
        due = np.flatnonzero(todo & (lo >= goal))
        todo[due] = np.isinf(best.reshape(n, k)[due]).any(1)
    return sig.reshape(n, k)


def banded(sig: np.ndarray, bands: int) -> np.ndarray:
    rows = sig.reshape(len(sig), bands, -1)
    key = np.broadcast_to(np.arange(1, bands + 1).astype(U) * ODD, rows.shape[:2]).copy()
    for i in range(rows.shape[2]):
        key = mix(key + rows[:, :, i]) * ODD
    return key.view(np.int64)


def slices(batches: Iterator[pa.RecordBatch], text: str = "text") -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """The rows in order, about SLICE bytes of text at a time, with the lower-case text's bytes and offsets; null is empty."""
    for batch in batches:
        size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False))
        lo = 0
        while lo < batch.num_rows:
            hi = min(lo + SLICE_ROWS, max(lo + 1, int(np.searchsorted(size, (size[lo - 1] if lo else 0) + SLICE, side="right"))))
            part = batch.slice(lo, hi - lo)
            low = pc.utf8_lower(pc.fill_null(part.column(text), "")).cast(pa.large_string())
            offsets = np.frombuffer(low.buffers()[1], np.int64)[low.offset : low.offset + len(low) + 1]
            data = np.frombuffer(low.buffers()[2], np.uint8)[offsets[0] : offsets[-1]] if low.buffers()[2] is not None else np.zeros(0, np.uint8)
            yield part, data, offsets - offsets[0]
            lo = hi


def printed(prints: np.ndarray) -> pa.Array:
    return pa.FixedSizeBinaryArray.from_buffers(pa.binary(16), len(prints), [None, pa.py_buffer(np.ascontiguousarray(prints).tobytes())]).cast(pa.binary())


def listed(values: np.ndarray, counts: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), pa.array(values))


def sign(batches: Iterator[pa.RecordBatch], words: int, bands: int, rows: int) -> Iterator[pa.RecordBatch]:
    with np.errstate(over="ignore"):
        for part, data, offsets in slices(batches):
            doc, e, prints = elements(data, offsets, words)
            n = part.num_rows
            keys = banded(signatures(doc, e, n, bands * rows), bands)
            some = np.bincount(doc, minlength=n) > 0
            more = [c for c in part.schema.names if c != "text"]
            yield pa.record_batch([*(part.column(c) for c in more), printed(prints), listed(keys[some].ravel(), some * bands)], names=[*more, "print", "keys"])


def element_lists(batches: Iterator[pa.RecordBatch], words: int) -> Iterator[pa.RecordBatch]:
    """Of rows (text, node, print) those whose text has that fingerprint, as (node, elements)."""
    with np.errstate(over="ignore"):
        for part, data, offsets in slices(batches):
            doc, e, prints = elements(data, offsets, words)
            order = np.argsort(doc, kind="stable")
            all_of = listed(e[order].view(np.int64), np.bincount(doc, minlength=part.num_rows))
            same = pc.equal(part.column("print"), printed(prints))
            yield pa.record_batch([part.column("node"), all_of], names=["node", "elements"]).filter(same)


def blocks(pdf, similar: float):
    """Links that join rows of different components in one pair of blocks: a spanning forest of the similar pairs.

    Rows: node, comp, half (False: the first block), elements. Two rows of one block meet only in that block's own task.
    """
    import pandas as pd

    sets = [np.unique(np.asarray(x)) for x in pdf["elements"]]
    vocab, code = np.unique(np.concatenate(sets), return_inverse=True)
    sizes = np.array([len(x) for x in sets])
    begin = np.cumsum(sizes) - sizes
    codes = [code[b : b + s] for b, s in zip(begin, sizes, strict=True)]
    owner = np.repeat(np.arange(len(sets)), sizes)
    comp, half, mark, found = pd.factorize(pdf["comp"])[0], pdf["half"].to_numpy(), np.zeros(len(vocab), bool), []
    alone = half.all() or not half.any()
    for i in range(len(sets)):
        meet = (comp != comp[i]) & (np.arange(len(sets)) > i) & (alone | (half != half[i])) & (np.minimum(sizes, sizes[i]) >= similar * np.maximum(sizes, sizes[i]) - 1e-9)
        if meet.any():
            mark[codes[i]] = True
            both = np.bincount(owner[mark[code]], minlength=len(sets))
            mark[codes[i]] = False
            for j in np.flatnonzero(meet & (both >= similar * (sizes + sizes[i] - both) - 1e-9)):
                if comp[j] != comp[i]:
                    found.append((pdf["node"].iat[i], pdf["node"].iat[j]))
                    comp[comp == comp[j]] = comp[i]
    return pd.DataFrame(found, columns=["a", "b"]).astype("int64")


def several(rows: DataFrame) -> DataFrame:
    """Members (key, node, comp) of the buckets that hold several classes, with large, n_large and n_small."""
    each = rows.groupBy("key", "comp").agg(F.count(F.lit(1)).alias("n"))
    most = each.groupBy("key").agg(F.max_by("comp", "n").alias("top"), F.max("n").alias("n_large"), (F.sum("n") - F.max("n")).alias("n_small")).filter("n_small > 0")
    return rows.join(most, "key").select("key", "node", "comp", (F.col("comp") == F.col("top")).alias("large"), "n_large", "n_small")


def sketch(open_sets: DataFrame) -> np.ndarray:
    """How often elements occur, added up over those of the same lower bits: SKETCH numbers, whatever the table."""
    counts = open_sets.select(F.explode("elements").alias("e")).groupBy(F.col("e").bitwiseAND(F.lit(SKETCH - 1)).alias("at")).agg(F.count(F.lit(1)).alias("n")).toPandas()
    out = np.zeros(SKETCH, np.int64)
    out[counts["at"].to_numpy(np.int64)] = counts["n"].to_numpy(np.int64)
    return out


def rare_elements(batches: Iterator[pa.RecordBatch], counts: np.ndarray, similar: float) -> Iterator[pa.RecordBatch]:
    """(key, node, comp) for the rarest elements of each set, as many as leave less than the share that similar sets have in common.

    Sets of similarity ``similar`` or more share one of these, for in an order that all sets follow, the first element that
    they share is among them. Any such order does; this one follows ``counts``, so that what is common to a family comes last.
    """
    for b in batches:
        keys, nodes, comps = [np.zeros(0, np.int64)], [], []
        for node, comp, elements in zip(b.column("node").to_pylist(), b.column("comp").to_pylist(), b.column("elements"), strict=True):
            own = np.unique(elements.values.to_numpy(zero_copy_only=False))
            n = len(own) - math.ceil(similar * len(own) - 1e-9) + 1
            keys.append(own[np.lexsort((own, counts[own & (SKETCH - 1)]))[:n]])
            nodes.append(np.full(len(keys[-1]), node))
            comps.append(np.full(len(keys[-1]), comp))
        columns = (np.concatenate(keys), *(np.concatenate(x) if x else np.zeros(0, np.int64) for x in (nodes, comps)))
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["key", "node", "comp"])


def near_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, words: int = WORDS, similar: float = SIMILAR, bands: int = BANDS, rows: int = ROWS, carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per input row: doc_id, class_id, class_size, first, and the columns in ``carry``.

    A link joins two texts whose shingles (``words`` words in lower case, split at white space, counted with their
    multiplicity) have a weighted Jaccard similarity of ``similar`` or more; classes are the connected components, named by
    their smallest doc_id. Texts of the same words are always of one class. Null, empty and blank texts have no words and
    are each a class of their own, as are rows with no partner; a class whose ids are all null has a null class_id. Rows
    that repeat an id count as rows. ``first``: the row has the class' smallest id, and of the texts with that id the one
    with the least fingerprint; rows without an id are all first. Other columns are ignored; no rows, no result.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("__h"), *carry)
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in docs.schema if f.name != "text")
    signed = settle(docs.mapInArrow(partial(sign, words=words, bands=bands, rows=rows), f"{kinds}, print binary, keys array<bigint>"))
    full = signed.filter(F.size("keys") > 0)
    total = full.count()
    groups = full.groupBy("print").agg(F.first("keys").alias("keys"), F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "__h")).alias("of"), F.count(F.lit(1)).alias("copies"))
    nodes = settle(groups.withColumn("node", F.monotonically_increasing_id()))
    parts = parts_for(nodes.count(), 20_000)

    def kept(df: DataFrame) -> DataFrame:
        """``settle`` for tables of a few small rows a node."""
        return settle(df.coalesce(parts))

    buckets = nodes.select("node", F.explode("keys").alias("key"))
    pivots = buckets.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.max_by("node", F.xxhash64("node", "key")).alias("pivot")).filter("n > 1")
    met = kept(buckets.join(pivots.drop("n"), "key"))  # members of buckets with two or more
    pairs = kept(met.filter("node != pivot").groupBy(F.greatest("node", "pivot").alias("a"), F.least("node", "pivot").alias("b")).agg(F.count(F.lit(1)).alias("bands")))
    wanted = nodes.join(met.select("node").distinct(), "node").select("node", "print", F.col("of.doc_id").alias("of"), F.col("of.__h").alias("h"))
    # An id may be null or repeated, so the text's hash is joined too; ``print`` tells the texts apart that it doesn't.
    texts = docs.join(wanted, docs["doc_id"].eqNullSafe(wanted["of"]) & (docs["__h"] == wanted["h"])).select("text", "node", "print")
    sets = settle(texts.mapInArrow(partial(element_lists, words=words), "node long, elements array<bigint>").dropDuplicates(["node"]))

    def copies(some: DataFrame, x: str, rows: int) -> Column:
        """Copies that a node of ``some`` has, each for a part of its links: 1, but for nodes that many links share a power of two."""
        often = some.groupBy(x).agg(F.count(F.lit(1)).alias("n")).filter((F.col("n") * HOT > rows) & (F.col("n") > FEW))
        by_parts: dict[int, list[int]] = {}
        for node, n in often.collect():  # fewer than HOT
            by_parts.setdefault(1 << math.ceil(math.log2(max(2, n * HOT / rows))), []).append(node)
        return F.coalesce(*(F.when(F.col(x).isin(found), parts) for parts, found in by_parts.items()), F.lit(1))

    def verified(some: DataFrame) -> DataFrame:
        """Those of the links that hold; settled in as many tasks as the work has, then few partitions."""
        some = kept(some)
        rows = some.count()
        parts_of = {x: copies(some, x, rows) for x in "ab"}  # before elements are joined, which are large
        for x, y in ("ab", "ba"):
            own = sets.select(F.col("node").alias(x), F.col("elements").alias(f"of_{x}"))
            own = own.withColumn("part", F.explode(F.sequence(F.lit(0), parts_of[x] - 1)))
            some = some.withColumn("part", F.pmod(F.xxhash64(y), parts_of[x]).cast("int")).join(own, [x, "part"]).drop("part")
        n = F.size("of_a") + F.size("of_b")
        both = F.size(F.array_intersect("of_a", "of_b"))
        close = F.least(F.size("of_a"), F.size("of_b")) >= similar * F.greatest(F.size("of_a"), F.size("of_b")) - 1e-9
        return settle(some.filter(close).filter(both >= similar * (n - both) - 1e-9).select("a", "b")).coalesce(parts)

    def named(rows: DataFrame, col: str, out: str, comps: DataFrame) -> DataFrame:
        c = comps.select(F.col("node").alias(col), F.col("comp").alias(out))
        return rows.join(c, col, "left").withColumn(out, F.coalesce(out, col))

    def merged(comps: DataFrame, links: DataFrame) -> DataFrame:
        """``comps`` with further links between its nodes: only components that these join are gone through."""
        if links.isEmpty():
            return comps
        over = kept(components(named(named(links, "a", "of_a", comps), "b", "of_b", comps).select(F.col("of_a").alias("a"), F.col("of_b").alias("b"))))
        fresh = links.select(F.col("a").alias("node")).union(links.select("b")).distinct().join(comps, "node", "left_anti").select("node", F.col("node").alias("comp"))
        return kept(comps.union(fresh).join(over.select(F.col("node").alias("comp"), F.col("comp").alias("top")), "comp", "left").select("node", F.coalesce("top", "comp").alias("comp")))

    def still_open(members: DataFrame, comps: DataFrame) -> DataFrame:
        """Of members (key, node) of buckets those whose bucket still holds several classes. Classes only grow, so the next round
        need only ask for these."""
        return kept(several(kept(named(members.select("key", "node"), "node", "comp", comps))))

    # Each node first meets the pivot that it shares the most bands with; mostly that joins a class.
    sides = pairs.select(F.col("a").alias("node"), F.col("b").alias("other"), "bands").union(pairs.select("b", "a", "bands"))
    best = sides.groupBy("node").agg(F.max_by("other", F.col("bands") * 1000 + F.pmod(F.xxhash64("node", "other"), F.lit(1000))).alias("other"))
    first = best.select(F.greatest("node", "other").alias("a"), F.least("node", "other").alias("b")).distinct()
    comps = kept(components(verified(first)))
    # Then the other pivots that are still of another class.
    rest = named(named(pairs.join(first, ["a", "b"], "left_anti"), "a", "of_a", comps), "b", "of_b", comps).filter("of_a != of_b").select("a", "b")
    comps = merged(comps, verified(rest))
    # Then members of a bucket that still holds several classes: those outside its largest class meet members of that.
    left = met.filter("node != pivot")  # whom everybody has met
    for seed in range(MEETINGS):
        left = still_open(left, comps)
        if left.isEmpty():
            break
        other = left.filter("large").groupBy("key").agg(F.max_by("node", F.xxhash64("node", "key", F.lit(seed))).alias("pivot"))
        again = left.filter("not large").join(other, "key").select(F.greatest("node", "pivot").alias("a"), F.least("node", "pivot").alias("b")).distinct()
        comps = merged(comps, verified(again))
    # Last, whoever is still outside, and shares a rare element with one of another class, meets everybody of the bucket of whom
    # that is true, in blocks of bounded size.
    left = still_open(left, comps)
    if not left.isEmpty():
        still = settle(left.select("node", "comp").distinct().join(sets, "node"))
        rare = still.mapInArrow(partial(rare_elements, counts=sketch(still), similar=similar), "key long, node long, comp long")
        able = settle(several(settle(rare)).select("node").distinct())
        left = kept(several(left.select("key", "node", "comp").join(able, "node", "left_semi")))
    if not left.isEmpty():
        blocks_of = lambda n: F.ceil(F.col(n) / BLOCK).cast("int")
        tag = F.pmod(F.xxhash64("node", F.lit(7)), F.when(F.col("large"), blocks_of("n_large")).otherwise(blocks_of("n_small"))).cast("int")
        mine = left.withColumn("few", blocks_of("n_small")).withColumn("mine", tag + F.when(F.col("large"), F.col("few")).otherwise(0))
        last = F.when(F.col("large"), F.col("few")).otherwise(F.col("few") + blocks_of("n_large")) - 1
        spread = mine.withColumn("other", F.explode(F.sequence(F.lit(0), last))).select(
            "key", "node", "comp", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), (F.col("mine") > F.col("other")).alias("half")
        )
        # buckets of the same members in several bands are compared once
        task = spread.groupBy("key", "i", "j").agg(F.sum(F.xxhash64("node").cast("decimal(20,0)")).alias("s"), F.count(F.lit(1)).alias("c"))
        task = task.groupBy("s", "c", "i", "j").agg(F.min("key").alias("key")).select("key", "i", "j")
        held = spread.join(task, ["key", "i", "j"]).join(sets, "node")
        links = held.groupBy("key", "i", "j").applyInPandas(lambda pdf: blocks(pdf, similar), "a long, b long").distinct()
        comps = merged(comps, settle(links))  # compared on whole texts' elements as ``verified`` does
    labels = settle(nodes.join(comps, "node", "left").select("print", F.coalesce("comp", "node").alias("comp"), "copies"))
    rows_ = settle(joined(full.select("doc_id", *carry, "print"), labels, ["print"], "copies", total))
    by = F.struct("doc_id", "print")
    named_by = settle(rows_.groupBy("comp").agg(F.min("doc_id").alias("class_id"), F.count(F.lit(1)).alias("class_size"), F.min(F.when(F.col("doc_id").isNotNull(), by)).alias("least")))
    out = ["doc_id", "class_id", "class_size", "first", *carry]
    found = joined(rows_, named_by.withColumn("n", F.col("class_size")), ["comp"], "n", total).withColumn("first", F.col("doc_id").isNull() | (by == F.col("least"))).select(*out)
    blank = signed.filter(F.size("keys") == 0).withColumns({"class_id": F.col("doc_id"), "class_size": F.lit(1).cast("long"), "first": F.lit(True)}).select(*out)
    return found.unionByName(blank)


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **more) -> DataFrame:
    """``docs`` with one document of each class: the ``first``; columns as they are, no rows give none. Rows without an id stay;
    rows that share an id and a text stay or go together. Texts move once, to meet the verdict."""
    raw = lambda text: F.sha2(F.coalesce(text, F.lit("")), 256)
    seen = near_classes(docs.withColumn("__raw", raw(F.col(text_col))), id_col, text_col, carry=("__raw",), **more)
    gone = seen.filter(~F.col("first")).select(F.col("doc_id").alias("__gone"), "__raw").distinct()
    return docs.join(gone, (docs[id_col] == gone["__gone"]) & (raw(docs[text_col]) == gone["__raw"]), "left_anti")
