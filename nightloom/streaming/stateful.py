"""Streams with state of their own: requests held back until a budget allows them, snapshots that expire by their model.

Rows wait in the state of their key until the watermark has passed them, so they are worked off in the order of their times,
whatever batches they came in; a timer calls each key when its next row is due, and the state is empty once nothing is.
"""

from __future__ import annotations

import pickle
from collections import defaultdict
from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

STORE = "spark.sql.streaming.stateStore.providerClass"
#: Buckets that keys are dealt to: each holds that share of what waits.
BUCKETS = 1024
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def keyed_state(spark: SparkSession) -> Iterator[None]:
    """The state store that state of one's own needs, for the streams that start within."""
    before = spark.conf.get(STORE, None)
    spark.conf.set(STORE, ROCKS)
    try:
        yield
    finally:
        spark.conf.set(STORE, before) if before else spark.conf.unset(STORE)


def released(sent: list[tuple[int, float]], waiting: list[tuple[int, int, float]], limit: float, window: int, now: int) -> tuple[list[tuple[int, int, int]], list[tuple[int, float]], int | None]:
    """(id, at, release) of the requests that go by ``now``, what has been sent of late, and when the next one goes.

    ``waiting``: (at, id, weight) in order; ``sent``: (release, weight) in order. A request goes once it is there, those before
    it are gone, and the weights of the last ``window`` milliseconds and its own are at most ``limit``, or none are left.
    """
    out: list[tuple[int, int, int]] = []
    sent = list(sent)
    for at, key, weight in waiting:
        time = max(at, sent[-1][0] if sent else at)
        while True:
            live = [(t, w) for t, w in sent if t > time - window]
            if not live or sum(w for _, w in live) + weight <= limit:
                break
            time = live[0][0] + window
        if time > now:
            return out, sent, time
        sent = [*live, (time, weight)]
        out.append((key, at, time))
    return out, sent, None


class InOrder(StatefulProcessor):
    """Rows wait for the watermark; ``work`` gets those of a key that it has passed, in order, and says when to call again.

    Keys are dealt to buckets, whose state is called once for many keys: a call costs far more than a key's rows. What a bucket
    gets in a call is one value of its state, and what its keys remember another.
    """

    columns: dict[str, str] = {}

    def init(self, handle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "rows binary")
        self.past = handle.getValueState("past", "of binary")

    def work(self, due: list[tuple], past, now: int) -> tuple[list[tuple], list[tuple], object, int | None]:
        """Rows to give, rows that go on waiting, what the key remembers (None: nothing), and when to call again."""
        raise NotImplementedError

    def rows_of(self, pdf: pd.DataFrame) -> list[tuple]:
        """(key, at, id, more) of each row."""
        raise NotImplementedError

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        new = [r for pdf in rows for r in self.rows_of(pdf)]
        if new:
            self.waiting.appendValue((pickle.dumps(new),))
            self.handle.registerTimer(max(min(r[1] for r in new), timerValues.getCurrentWatermarkInMs() + 1))
        yield pd.DataFrame()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        held: dict[str, list[tuple]] = defaultdict(list)
        for chunk in self.waiting.get():
            for k, *row in pickle.loads(chunk[0]):
                held[k].append(tuple(row))
        past = pickle.loads(self.past.get()[0]) if self.past.exists() else {}
        out, left, kept, due = [], [], {}, []
        for k in sorted(held.keys() | past.keys()):
            rows = sorted(held[k])
            gone, waits, remembered, again = self.work([r for r in rows if r[0] <= now], past.get(k), now)
            later = [r for r in rows if r[0] > now]
            out += [(k, *r) for r in gone]
            left += [(k, *r) for r in [*waits, *later]]
            if remembered is not None:
                kept[k] = remembered
            due += [t for t in (again, later[0][0] if later else None) if t is not None]
        if left:
            self.waiting.put([(pickle.dumps(left),)])
        else:
            self.waiting.clear()
        if kept:
            self.past.update((pickle.dumps(kept),))
        else:
            self.past.clear()
        if due:
            self.handle.registerTimer(max(min(due), now + 1))
        yield pd.DataFrame(out, columns=list(self.columns)).astype(self.columns)

    def close(self) -> None:
        pass


def in_buckets(rows: DataFrame, keys: list[str], of: InOrder, columns: str, buckets: int) -> DataFrame:
    """keys and ``columns`` that ``of`` makes of a stream, worked off bucket by bucket."""
    named = F.to_json(F.struct(*keys), {"ignoreNullFields": "false"})  # nulls and whole numbers stay as they are in pandas
    kinds = ", ".join(f"`{k}` {rows.schema[k].dataType.simpleString()}" for k in keys)
    dealt = rows.withColumns({"key_text": named, "key_bucket": F.pmod(F.xxhash64(*keys), F.lit(buckets))})
    out = dealt.groupBy("key_bucket").transformWithStateInPandas(of, f"key_text string, {columns}", "append", "eventTime")
    return out.withColumn("key_text", F.from_json("key_text", kinds)).select("key_text.*", *(c.split()[0] for c in columns.split(", ")))


class Pacer(InOrder):
    """Requests (at, id, weight) of a key leave within a budget."""

    columns = {"key_text": "object", "id": "int64", "at": "int64", "release": "int64"}

    def __init__(self, limit: float, window: int):
        self.limit, self.window = limit, window

    def rows_of(self, pdf):
        return [(k, int(a), int(i), float(w)) for k, a, i, w in zip(pdf["key_text"], pdf["at"], pdf["id"], pdf["weight"], strict=True)]

    def work(self, due, past, now):
        gone, sent, again = released(past or [], due, self.limit, self.window, now)
        sent = [(t, w) for t, w in sent if t > now - self.window]  # older ones count for nothing that is still to come
        if sent:
            again = min(again or sent[-1][0] + self.window, sent[-1][0] + self.window)  # to forget them
        went = {i for i, _, _ in gone}
        return gone, [r for r in due if r[1] not in went], sent or None, again


def paced(requests: DataFrame, keys: list[str], limit: float, window: int, buckets: int = BUCKETS) -> DataFrame:
    """keys, id, at, release (milliseconds) of a stream of requests: keys, id (unique in a key), at, weight, and a watermark.

    Each key has its own budget of ``limit`` in ``window`` milliseconds; a request that alone is over it goes when none other
    counts. What the watermark hasn't released yet stays in the state.
    """
    return in_buckets(requests, keys, Pacer(limit, window), "id long, at long, release long", buckets)


class Snapshots(InOrder):
    """Reads (at, id, ttl) of a key are served by the last fetch as long as that lives."""

    columns = {"key_text": "object", "id": "int64", "at": "int64", "hit": "bool", "fetched": "int64"}

    def rows_of(self, pdf):
        return [(k, int(a), int(i), int(t)) for k, a, i, t in zip(pdf["key_text"], pdf["at"], pdf["id"], pdf["ttl"], strict=True)]

    def work(self, due, past, now):
        held, out = past, []
        for at, i, ttl in due:
            hit = held is not None and at < held[0] + held[1]
            held = held if hit else (at, ttl)
            out.append((i, at, hit, held[0]))
        lives = held is not None and now < held[0] + held[1]
        return out, [], held if lives else None, held[0] + held[1] if lives else None


def snapshots(reads: DataFrame, keys: list[str], buckets: int = BUCKETS) -> DataFrame:
    """keys, id, at, hit, fetched (milliseconds) of a stream of reads: keys, id, at, ttl (milliseconds, by the row's model), and a
    watermark. A read is a hit while the last fetch of its key is younger than its time to live, else it fetches; a snapshot
    leaves the state when its time is over."""
    return in_buckets(reads, keys, Snapshots(), "id long, at long, hit boolean, fetched long", buckets)
