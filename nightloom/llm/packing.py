"""Packing documents into fixed-length sequences by a configuration linear program.

Only the histogram of piece lengths reaches the driver: at most ``size`` numbers, whatever the corpus. Over it, the program
asks for the fewest sequences, each filled by one configuration (a multiset of lengths that fits), so that every length is
covered. It is solved by multiplicative weights: lengths that lag behind get dearer, and a knapsack dynamic program prices
the most valuable configurations of the moment. The solution is rounded to whole numbers of sequences and the program solved
anew for what is left; the last tenth is packed best-fit, or by the fullest choice for the longest piece. Sequences with room
are then mended: packed anew together with some full ones, as long as that saves any. Whichever start ends with the fewest
sequences is the plan; best fit alone, mended likewise, is among the starts, so that the plan never needs more. The plan is a table of runs - the r-th to s-th piece of a length go to these sequences -
that is joined with the pieces, which are numbered within their lengths partition by partition.
"""

from __future__ import annotations

import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from nightloom.llm import segments
from nightloom.llm.common import settle

SIZE, END = 1024, 2
#: Shares to which all lengths are covered one after another, how fast a price falls with the share that is covered, the power
#: of a length that it starts from, and lengths for which configurations are bought at the same prices.
LEVELS, RATE, STEEP, AT_ONCE = (0.25, 0.5, 0.75, 0.9, 1.0), 3.0, 1.2, 1024
#: Rounding: least part of the value that is taken from each solution, how full its configurations are, and where it ends.
SHARE, FULL, LAST = 0.5, 0.995, 0.1
#: How many full sequences are mended with each that has room, at most.
MENDED = 64
#: Rows of a plan up to which it is broadcast: about 5 MB.
BROADCAST = 100_000


def pieces_of(batches: Iterator[pa.RecordBatch], tokenizer: str, size: int, end_id: int, with_ids: bool) -> Iterator[pa.RecordBatch]:
    seen = np.zeros(size + 1, np.int64)  # pieces of each length so far in this partition
    part = TaskContext.get().partitionId()
    for batch in segments.slices(batches):
        flat, n = segments.library(tokenizer).batch(batch.column("text"))
        n = n + 1
        out = np.full(int(n.sum()), end_id, "<u4")
        stops = np.cumsum(n)
        keep = np.ones(len(out), bool)
        keep[stops - 1] = False
        out[keep] = flat
        head = (n - 1) % size + 1  # the first piece; all others are full
        count = (n - head) // size + 1
        row = np.repeat(np.arange(len(n)), count)
        piece = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
        start = np.where(piece == 0, 0, head[row] + (piece - 1) * size)
        length = np.where(piece == 0, head[row], size)
        at = (stops - n)[row] + start
        raw = memoryview(out.tobytes())
        crc = [zlib.crc32(raw[4 * a : 4 * (a + k)]) for a, k in zip(at.tolist(), length.tolist(), strict=True)]
        order = np.argsort(length, kind="stable")
        of = length[order]
        first = np.searchsorted(of, of)
        rank = np.empty(len(of), np.int64)
        rank[order] = seen[of] + np.arange(len(of)) - first
        seen += np.bincount(length, minlength=size + 1)
        cols = {
            "doc_id": batch.column("doc_id").take(pa.array(row)), "piece": pa.array(piece, pa.int32()), "start": pa.array(start), "length": pa.array(length), "ids_crc32": pa.array(crc, pa.int64()),
            "part": pa.array(np.full(len(row), part), pa.int32()), "rank": pa.array(rank),
        }
        if with_ids:
            cols["ids"] = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(length)), pa.int32()), pa.array(segments.gather(out, at, length).astype(np.int32)))
        yield pa.RecordBatch.from_pydict(cols)


def best_fit(counts: dict[int, int], size: int) -> Counter:
    """Configurations of a histogram by best fit, longest first: equal lengths at a time, over bins that are alike."""
    room: dict[int, Counter] = defaultdict(Counter)  # free space: configurations that have it
    for length in sorted(counts, reverse=True):
        left = counts[length]
        for free in sorted(f for f in room if f >= length):
            if not left:
                break
            while left and room[free]:
                config, n = next(iter(room[free].items()))
                k = min(free // length, left)  # put as many into one bin as fit
                bins = min(n, left // k)
                room[free] -= Counter({config: bins})
                room[free - k * length][(*config, *[length] * k)] += bins
                left -= bins * k
            if not room[free]:
                del room[free]
        if left:
            k = size // length
            if left >= k:
                room[size - k * length][(length,) * k] += left // k
            if left % k:
                room[size - (left % k) * length][(length,) * (left % k)] += 1
    out: Counter = Counter()
    for configs in room.values():
        out.update(configs)
    return out


def knapsack(price: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """For every capacity the value of its most valuable configuration, and a length of it (0: the capacity below is as good).

    An unbounded knapsack by dynamic programming; ``price`` holds a price for each length up to ``size``, minus infinity for
    lengths that can't be had. Of lengths of equal worth the longest is taken, which leaves short ones to fill gaps later.
    """
    back, last = np.zeros(size + 1), np.zeros(size + 1, np.int64)  # back[size - c]: value of capacity c
    own = price[1:]
    for c in range(1, size + 1):
        worth = back[size - c + 1 :] + own[:c]
        j = c - 1 - int(worth[::-1].argmax())
        below = back[size - c + 1]
        if worth[j] > below:
            back[size - c], last[c] = worth[j], j + 1
        else:
            back[size - c] = below
    return back[::-1], last


def configurations(last: np.ndarray, first: np.ndarray, size: int) -> list[tuple[int, ...]]:
    """For each length in ``first`` the most valuable configuration that holds it."""
    with_item = np.maximum.accumulate(np.where(last > 0, np.arange(size + 1), 0))
    rem, columns = with_item[size - first], [first]
    while rem.any():
        columns.append(last[rem])
        rem = with_item[rem - columns[-1]]
    rows = -np.sort(-np.stack(columns, 1), 1)
    return [tuple(r[:n]) for r, n in zip(rows.tolist(), (rows > 0).sum(1).tolist(), strict=True)]


def fractional(counts: dict[int, int], size: int, levels: tuple[float, ...] = LEVELS) -> tuple[dict[tuple[int, ...], float], float]:
    """A feasible solution of the configuration program by multiplicative weights, and a lower bound from its prices.

    A length's price falls exponentially with the share of its pieces that is covered, so what lags behind gets dearer. For
    one level after the other, nearly every length is brought to that share: a knapsack prices the lengths of the moment,
    and for those that lag most, longest first, the most valuable configuration that holds them is bought, as much of it as
    takes none of its lengths beyond the next level. The last level is 1, so every length is covered exactly, and the
    solution's value is never below the bound. Any prices, scaled so that no configuration is worth more than 1, bound it.
    """
    lengths = np.array(sorted(counts), np.int64)
    need = np.array([counts[x] for x in lengths.tolist()], float)
    at = {x: i for i, x in enumerate(lengths.tolist())}
    start, covered, bought = (lengths / size) ** STEEP, np.zeros(len(lengths)), defaultdict(float)
    bound = float((need * lengths).sum() / size)
    for level, cap in zip(levels, (*levels[1:], levels[-1]), strict=True):
        room = np.maximum(cap - covered, 0) * need
        first = True
        while (late := np.flatnonzero(room > (cap - level + 1e-6) * need)).size > (0 if cap == level else len(lengths) // 20):
            covered = cap - room / need
            weight = start * np.exp(-RATE * (covered - covered.min()))
            price = np.full(size + 1, -np.inf)
            price[lengths[room > 0]] = weight[room > 0]
            value, last = knapsack(price, size)
            if first and (room > 0).all():
                bound = max(bound, float((weight * need).sum() / value[size]))
            first = False
            late = late[np.lexsort((-lengths[late], covered[late]))][:AT_ONCE]
            for config in configurations(last, lengths[late], size):
                have = Counter(config)
                amount = min(room[at[x]] / k for x, k in have.items())
                if amount > 0:
                    bought[config] += amount
                    for x, k in have.items():
                        rest = room[at[x]] - amount * k
                        room[at[x]] = rest if rest > 1e-7 * need[at[x]] else 0.0
        covered = cap - room / need
    return dict(bought), bound


def rounded(counts: dict[int, int], size: int) -> tuple[Counter, dict[int, int]]:
    """Whole configurations from the program, and what they leave of the histogram.

    The solution's whole parts are taken, and where they come to less than half of its value, single sequences of the full
    configurations with the fewest pieces, as far as there are pieces for them; then the program is solved for what is left,
    until that is a tenth of the first solution.
    """
    left, made, total = {x: n for x, n in counts.items() if n}, Counter(), None
    while left:
        solution, _ = fractional(left, size)
        value, taken = sum(solution.values()), 0
        total = total or value
        if value < LAST * total or value < 2:
            break
        whole = {c: int(x + 1e-6) for c, x in solution.items()}
        for config in sorted((c for c in solution if sum(c) >= FULL * size), key=lambda c: (-whole[c], len(c), -solution[c], c)):
            if not whole[config] and taken >= SHARE * value:
                break
            have = Counter(config)
            n = min(max(whole[config], 1), *(left.get(x, 0) // k for x, k in have.items()))
            if n:
                made[config] += n
                taken += n
                for x, k in have.items():
                    left[x] -= n * k
        left = {x: n for x, n in left.items() if n}
        if not taken:
            break
    return made, left


def fullest(counts: dict[int, int], size: int) -> Counter:
    """Configurations of a histogram, each the longest piece left and those of the others that fill it most, long ones first.

    What sums the pieces reach is a set of bits, length by length; a configuration is taken as often as its pieces are left.
    """
    left, made = {x: n for x, n in counts.items() if n}, Counter()
    while left:
        top = max(left)
        room = size - top
        reach, mask, steps = 1, (1 << (room + 1)) - 1, []
        for x in sorted((x for x in left if x <= room), reverse=True):
            steps.append((x, reach))
            some, more = min(left[x] - (x == top), room // x), 1
            while some > 0:  # any number of them, by numbers that double
                step = min(more, some)
                reach |= (reach << (step * x)) & mask
                some, more = some - step, 2 * more
            if reach >> room & 1:
                break
        config, at = [top], reach.bit_length() - 1
        for x, without in reversed(steps):
            while not without >> at & 1:
                config.append(x)
                at -= x
        have = Counter(config)
        n = min(left[x] // k for x, k in have.items())
        made[tuple(sorted(config, reverse=True))] += n
        left = {x: m for x, m in ((x, m - n * have.get(x, 0)) for x, m in left.items()) if m}
    return made


def histogram_of(configs: Counter) -> dict[int, int]:
    out: Counter = Counter()
    for config, n in configs.items():
        for x in config:
            out[x] += n
    return dict(out)


#: Which full sequences are packed anew with those that have room: of many pieces, of short ones, without long ones, any.
ORDERS = (lambda c: (-len(c), c), lambda c: (c[-1], c), lambda c: (c[0], c), lambda c: (sum(x * x for x in c) % 1009, c))


def mended(made: Counter, size: int) -> Counter:
    """``made`` with fewer sequences, where packing those with room anew, with up to MENDED times as many full ones, saves some."""
    least = -(-sum(sum(c) * n for c, n in made.items()) // size)
    share, order = 1, 0
    while sum(made.values()) > least and share <= MENDED:
        old = Counter({c: n for c, n in made.items() if sum(c) < size})
        want = share * sum(old.values())
        for c in sorted((c for c in made if sum(c) == size), key=ORDERS[order]):
            if want <= 0:
                break
            old[c] = min(made[c], want)
            want -= old[c]
        new = min((f(histogram_of(old), size) for f in (best_fit, fullest)), key=lambda m: sum(m.values()))
        if sum(new.values()) < sum(old.values()):
            made = made - old + new
        else:
            order = (order + 1) % len(ORDERS)
            share *= 1 if order else 2
    return made


def plan(counts: dict[int, int], size: int = SIZE) -> Counter:
    """Configurations with their whole numbers of sequences, which hold each length exactly as often as it occurs.

    Full-length pieces take a sequence each; the other lengths go by ``rounded``, its rest by ``best_fit`` or ``fullest``, and
    ``mended``; or all by ``best_fit`` and ``mended``, if that takes fewer.
    """
    alone = Counter({(size,): counts[size]}) if counts.get(size) else Counter()
    rest = {x: n for x, n in counts.items() if x != size}
    made, left = rounded(rest, size)
    starts = (made + best_fit(left, size), made + fullest(left, size), best_fit(rest, size))
    return alone + min((mended(start, size) for start in starts), key=lambda m: sum(m.values()))


def runs(configs: Counter) -> list[tuple[int, int, int, int, int, int]]:
    """(length, from rank, to rank, first sequence, slots a sequence, first offset) for every length of every configuration."""
    used: Counter = Counter()
    out, sequence = [], 0
    for config, n in sorted(configs.items(), reverse=True):
        offset = 0
        for length, k in sorted(Counter(config).items(), reverse=True):
            out.append((length, used[length], used[length] + n * k, sequence, k, offset))
            used[length] += n * k
            offset += k * length
        sequence += n
    return out


def packed(docs: DataFrame, tokenizer: str, *, size: int = SIZE, end_id: int = END, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset, and the ids if ``with_ids``.

    A document is its text's ids and ``end_id``, so a null or empty text is one id. Documents of more than ``size`` ids are
    cut into pieces, of which only the first may be shorter. No sequence is longer than ``size``, offsets are gapless, and
    sequences are numbered from 0. Rows that repeat an id are documents of their own; a null id stays null; only the id
    and text columns are read. No rows: no rows.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    kinds = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, rank long" + ", ids array<int>" * with_ids
    pieces = settle(rows.mapInArrow(partial(pieces_of, tokenizer=tokenizer, size=size, end_id=end_id, with_ids=with_ids), kinds))
    counts = settle(pieces.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n")))
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most ``size`` rows
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("length", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    kind = "length long, lo long, hi long, sequence long, slots long, at long"
    table = [tuple(map(int, x)) for x in runs(plan(histogram, size))]
    planned = docs.sparkSession.createDataFrame(table, kind)
    ranked = pieces.join(offsets, ["length", "part"]).withColumn("rank", F.col("rank") + F.col("before"))
    # The plan grows with ``size``, not with the corpus: some 7,000 rows for 1,024. Should it be large, it is shuffled instead.
    planned = F.broadcast(planned) if len(table) <= BROADCAST else planned
    own = ranked.join(planned, (ranked["length"] == planned["length"]) & (F.col("lo") <= F.col("rank")) & (F.col("rank") < F.col("hi"))).drop(planned["length"])
    nth = F.col("rank") - F.col("lo")
    sequence = F.col("sequence") + F.floor(nth / F.col("slots")).cast("long")
    offset = F.col("at") + F.pmod(nth, F.col("slots")) * F.col("length")
    more = ["ids"] if with_ids else []
    return own.select("doc_id", "piece", "start", "length", "ids_crc32", sequence.alias("sequence_id"), offset.cast("long").alias("offset"), *more)
