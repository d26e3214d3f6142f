"""The forecast source: tries, pruned partitions, columns by option."""

import pytest
from pyspark.sql.datasource import EqualTo, GreaterThan, In

from nightloom.sources import forecasts

ANSWER = "model int, cell long, attempt int, status int, reason string, hourly struct<time:array<string>,cloud_cover:array<double>,wind:array<double>>"


def answer(status, attempt=1, reason=None):
    return {"status": status, "attempt": attempt, "reason": reason, "hourly": {"time": ["t"]} if status == 200 else None}


@pytest.mark.parametrize("statuses, want", [
    ([200], (1, None, None)), ([503, 200], (2, None, None)), ([408, 503, 200], (3, None, None)), ([503, 503, 503, 200], (3, "HTTP 503", None)), ([404, 200], (1, "client_error (HTTP 404)", None)),
    ([429, 200], (1, "HTTP 429 (daily)", "daily")), ([503, 429], (2, "HTTP 429 (daily)", "daily")), ([], (3, "connection", None)), ([500], (3, "connection", None)),
])
def test_tries(statuses, want):
    pauses = []
    got = forecasts.fetched(iter([answer(s, reason="Daily API request limit exceeded") for s in statuses]), 3, 2.0, pauses.append)
    assert (got.attempts, got.reason, got.limited) == want and (got.hourly is not None) == (want[1] is None)
    assert pauses == [2.0 * i for i in range(1, want[0])]


def test_kinds_of_limits():
    assert [forecasts.limit_kind(x) for x in ("Hourly limit", "minutely and DAILY", None, "?")] == ["hourly", "daily", "unknown", "unknown"]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("answers") / "all")
    hours = lambda n: (["2024-01-01T%02d:00" % i for i in range(n)], [float(i) if i % 2 else None for i in range(n)], [1.5])
    rows = [(m, c, 1, 200 if c % 5 else 404, None, hours(c % 4) if c % 5 else None) for m in (0, 1, 2) for c in range(40)] + [(0, 99, 2, 200, None, hours(2)), (0, 99, 1, 503, None, None)]
    forecasts.write_answers(spark.createDataFrame(rows, ANSWER).repartition(5), path, shelves=8)
    return path


def reader(folder, filters=(), **options):
    r = forecasts.Reader({"path": folder, "shelves": "8", **options}, ["cloud_cover"])
    return r, list(r.pushFilters(list(filters)))


def test_pruned_partitions(folder):
    whole, kept = reader(folder, pushdown="once")
    assert len(whole.partitions()) == 24 and kept == []
    one, kept = reader(folder, [EqualTo(("model",), 1), EqualTo(("cell",), 11), rest := GreaterThan(("cloud_cover",), 0.0)], pushdown="once")
    assert len(one.partitions()) == 1 and kept == [rest]
    some, _ = reader(folder, [In(("cell",), (3, 11, 4))], what=forecasts.OUTCOMES, pushdown="once")
    assert len(some.partitions()) == 6 and {r[1] for p in some.partitions() for r in some.read(p)} == {3, 4, 11}
    none, _ = reader(folder, [EqualTo(("model",), 1), EqualTo(("model",), 2)], pushdown="once")
    assert none.partitions() == []


def test_read(spark, folder):
    df = forecasts.read(spark, folder, shelves="8", variables="cloud_cover,wind")
    assert df.columns == ["model", "cell", "time", "cloud_cover", "wind"]
    rows = df.filter("model = 1 and cell in (3, 7)").collect()
    assert sorted((r.cell, r.time[-5:], r.cloud_cover, r.wind) for r in rows) == [(c, f"0{i}:00", float(i) if i % 2 else None, 1.5 if i == 0 else None) for c in (3, 7) for i in range(3)]
    whole = df.count()
    assert whole > df.filter("model = 1").count() > 0 and df.count() == whole  # a frame may be filtered again
    once = lambda: forecasts.read(spark, folder, shelves="8", pushdown="once")
    assert once().filter("model = 1 and cell = 7").rdd.getNumPartitions() == 1 < once().rdd.getNumPartitions() == 24
    assert once().filter("model = 1 and cell = 7 and cloud_cover is not null").count() == 1
    outcomes = {(r.model, r.cell): r for r in forecasts.read(spark, folder, shelves="8", what="outcomes").collect()}
    assert len(outcomes) == 121 and outcomes[0, 99].attempts == 2 and outcomes[0, 99].ok and not outcomes[2, 5].ok and outcomes[2, 5].reason.startswith("client_error")
