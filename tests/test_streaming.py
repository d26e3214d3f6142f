"""Streams: restarts of merged tables, budgets and snapshots against plain loops."""

import random

import pytest
from pyspark.sql import functions as F

from nightloom.streaming import stateful, tables, windows

SCHEMA = "k long, at long, v string"


def put(spark, folder, name, rows):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(f"{folder}/{name}")


def stream(spark, folder):
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(folder)


def latest(rows):
    best = {}
    for k, at, v in rows:
        if k not in best or (at, v) > best[k]:
            best[k] = (at, v)
    return sorted((k, at, v) for k, (at, v) in best.items())


def test_merged_table_survives_restarts(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    first = [(i % 5, i, f"a{i}") for i in range(20)]
    put(spark, source, "one", first)
    put(spark, source, "two", more := [(i % 7, 100 + i, f"b{i}") for i in range(7)])
    read = lambda: sorted(tuple(r) for r in tables.merged(stream(spark, source), ["k"], "at", out).collect())
    assert read() == latest(first + more)
    put(spark, source, "three", late := [(1, 50, "late"), (9, 1, "new")])
    assert read() == latest(first + more + late)  # a second start goes on
    assert read() == latest(first + more + late)  # a third one finds nothing new


def test_an_empty_source(spark, tmp_path):
    source = str(tmp_path / "in")
    put(spark, source, "none", [])
    assert tables.merged(stream(spark, source), ["k"], "at", str(tmp_path / "out")).collect() == []


def test_batches_that_come_again(spark, tmp_path):
    table = tables.LatestTable(spark, str(tmp_path / "t"), spark.createDataFrame([], SCHEMA).schema, ["k"], "at", shards=4)
    rows = lambda: sorted(repr(tuple(r)) for r in table.rows().collect())
    df = lambda x: spark.createDataFrame(x, SCHEMA)
    assert rows() == []
    table.put(df([(1, 1, "a"), (2, 1, "b"), (None, 3, "n")]), 0)
    table.put(df([(1, 2, "c")]), 1)
    held = table.held()
    table.put(df([(1, 9, "not this")]), 1)  # committed before
    table.put(df([(2, 9, "nor this")]), 0)
    assert rows() == ["(1, 2, 'c')", "(2, 1, 'b')", "(None, 3, 'n')"]
    assert table.held() == held
    table.put(df([]), 2)
    assert table.held() == held and table.versions() == [1, 2]  # only the last versions stay
    table.put(df([(1, 5, "d")]), 3)
    changed = [s for s in held if table.held()[s] != held[s]]
    assert len(changed) == 1  # other shards' files are as they were
    other = tables.LatestTable(spark, str(tmp_path / "t"), table.schema, ["k"], "at", shards=4)
    assert sorted(map(repr, (tuple(r) for r in other.rows().collect()))) == sorted(["(1, 5, 'd')", "(2, 1, 'b')", "(None, 3, 'n')"])


def loop(requests, limit, window):
    """Each request waits until the window has room, one after another."""
    sent, out = [], []
    for at, key, weight in sorted(requests):
        now = max(at, sent[-1][0] if sent else at)
        while sum(w for t, w in sent if now - window < t) + weight > limit and any(now - window < t for t, _ in sent):
            now = min(t for t, _ in sent if now - window < t) + window
        sent.append((now, weight))
        out.append((key, at, now))
    return out


@pytest.mark.parametrize("seed", range(4))
def test_pacing_function(seed):
    rng = random.Random(seed)
    requests = sorted((rng.randrange(300), i, rng.choice([1.0, 2.0, 5.0, 11.0])) for i in range(60))
    want = loop(requests, 10.0, 60)
    assert stateful.released([], requests, 10.0, 60, 10**9)[0] == want
    # In steps of a watermark, with what each step leaves.
    sent, gone, waiting = [], [], []
    for now in range(0, 3000, 17):
        waiting = [r for r in requests if r[0] <= now and r[1] not in {g[0] for g in gone}]
        out, sent, _ = stateful.released([(t, w) for t, w in sent if t > now - 17 - 60], waiting, 10.0, 60, now)
        gone += out
    assert gone == want


def timed(df):
    return df.withColumn("t", F.timestamp_millis("at")).withWatermark("t", "1 second")


def run(spark, tmp_path, rows, schema, over):
    """Rows in files of a few, in any order within the lateness; a last one far off lets all others go."""
    source = str(tmp_path / "in")
    for n in range(0, len(rows), 25):
        spark.createDataFrame(rows[n : n + 25], schema).coalesce(1).write.mode("append").parquet(f"{source}/{n:04d}")
    df = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(source)
    with stateful.keyed_state(spark):
        return windows.finished(spark, over(timed(df))).collect()


def test_paced_stream(spark, tmp_path):
    rng = random.Random(7)
    rows = sorted((rng.randrange(200_000), rng.choice([1, 2]), i, rng.choice([1.0, 2.0])) for i in range(120))
    rows = [(k, i, at, w) for at, k, i, w in rows] + [(3, 999, 10_000_000, 1.0)]
    got = run(spark, tmp_path, rows, "k long, id long, at long, weight double", lambda df: stateful.paced(df, ["k"], 4.0, 20_000))
    want = [(k, *r) for k in (1, 2) for r in loop([(at, i, w) for q, i, at, w in rows if q == k], 4.0, 20_000)]
    assert sorted((r.k, r.id, r["at"], r.release) for r in got if r.k < 3) == sorted(want)
    assert any(r.release > r["at"] for r in got)


def test_snapshots_expire_by_model(spark, tmp_path):
    rng = random.Random(9)
    rows = sorted((rng.randrange(400_000), rng.choice([1, 2]), i) for i in range(100))
    rows = [(k, i, at, 30_000 * k) for at, k, i in rows] + [(3, 999, 10_000_000, 1)]
    got = run(spark, tmp_path, rows, "k long, id long, at long, ttl long", lambda df: stateful.snapshots(df, ["k"]))
    want = []
    for k in (1, 2):
        fetched = None
        for q, i, at, ttl in rows:
            if q == k:
                hit = fetched is not None and at < fetched + ttl
                fetched = fetched if hit else at
                want.append((k, i, at, hit, fetched))
    assert sorted((r.k, r.id, r["at"], r.hit, r.fetched) for r in got if r.k < 3) == sorted(want)
    assert {r.hit for r in got} == {True, False}


def test_what_a_call_brings_for_many_keys_waits_as_one_value():
    """A value for each row would go to the state store and back one by one."""
    import pandas as pd

    class Held:
        def __init__(self):
            self.values, self.timers = [], []

        def appendValue(self, value):
            self.values.append(value)

        def appendList(self, values):
            self.values += values

        def getListState(self, name, schema):
            return self

        def getValueState(self, name, schema):
            return self

        def registerTimer(self, at):
            self.timers.append(at)

        def getCurrentWatermarkInMs(self):
            return 0

    held, of = Held(), stateful.Snapshots()
    of.init(held)
    list(of.handleInputRows((1,), iter([pd.DataFrame({"key_text": ["a", "b"] * 25, "at": range(5, 55), "id": range(50), "ttl": [3] * 50})]), held))
    assert len(held.values) == 1 and held.timers == [5]
