"""Hourly forecast series: spines, sources that complete each other, shares and votes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MODELS = ("MSM", "ECMWF")


def hour_spine(windows: DataFrame, start: str, end: str, out: str = "hour") -> DataFrame:
    """A row for each hour from ``start``, floored to the hour, up to ``end`` (inclusive)."""
    return windows.withColumn(out, F.explode(F.sequence(F.date_trunc("hour", F.col(start).cast("timestamp")), F.col(end).cast("timestamp"), F.expr("interval 1 hour"))))


def long_series(payload: DataFrame, keys: list[str], variables: list[str]) -> DataFrame:
    """Parallel arrays (``time`` and one per variable) as rows: keys, ts, variables. Hours without any value are left out."""
    zipped = payload.select(*keys, F.explode(F.arrays_zip("time", *variables)).alias("z"))
    rows = zipped.select(*keys, F.to_timestamp("z.time", "yyyy-MM-dd'T'HH:mm").alias("ts"), *(F.col(f"z.{v}").alias(v) for v in variables))
    return rows.filter(F.coalesce(*(F.col(v) for v in variables)).isNotNull())


def two_sources(spine: DataFrame, first: DataFrame, second: DataFrame, keys: list[str], values: list[str], names: tuple[str, str] = MODELS) -> DataFrame:
    """Per value the first source's, else the second's; ``source`` is the one that supplied most, the first on ties, N/A if none."""
    a = first.select(*keys, *(F.col(v).alias(f"a_{v}") for v in values))
    b = second.select(*keys, *(F.col(v).alias(f"b_{v}") for v in values))
    both = spine.join(a, keys, "left").join(b, keys, "left")
    n_a = sum((F.col(f"a_{v}").isNotNull().cast("int") for v in values), F.lit(0))
    n_b = sum(((F.col(f"a_{v}").isNull() & F.col(f"b_{v}").isNotNull()).cast("int") for v in values), F.lit(0))
    source = F.when((n_a + n_b) == 0, "N/A").when(n_a >= n_b, names[0]).otherwise(names[1])
    return both.select(*spine.columns, *(F.coalesce(f"a_{v}", f"b_{v}").alias(v) for v in values), source.alias("source"))


def regime(rows: DataFrame, keys: list[str], source: str = "source") -> DataFrame:
    """The first model where it supplied more than half of the hours, else the second (also without hours)."""
    votes = F.sum(F.when(F.col(source) == MODELS[0], 1).otherwise(0))
    return rows.groupBy(*keys).agg(F.when(votes > F.count(F.lit(1)) / 2, MODELS[0]).otherwise(MODELS[1]).alias("regime"))


def clear_share(value: Column, threshold: float = 30.0) -> Column:
    """Percentage of the valid hours at or under the threshold; null without a valid hour."""
    return F.avg(F.when(value.isNotNull(), F.when(value <= threshold, 100.0).otherwise(0.0)))


def stat_of(value: Column, stat: str) -> Column:
    if stat not in ("mean", "max", "min"):
        raise ValueError(f"unknown stat: {stat}")
    return {"mean": F.avg, "max": F.max, "min": F.min}[stat](value)


def latest_snapshot(snapshots: DataFrame, keys: list[str], fetched: str, now: Column, hours: Column) -> DataFrame:
    """The newest snapshot of each key that isn't older than its time to live."""
    from nightloom.operators.runs import first_by

    return first_by(snapshots.filter(F.col(fetched).cast("timestamp") > now - F.make_interval(hours=hours)), keys, F.desc(fetched))


def merged_by_key(old: DataFrame, own: DataFrame, keys: list[str]) -> DataFrame:
    """Both tables by key, the own row where both have one."""
    return own.unionByName(old.join(own.select(*keys).distinct(), keys, "left_anti"))


def daily_average(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    return rows.filter(F.col(value).isNotNull()).groupBy(*keys).agg(F.avg(value).alias("mean"))


def differences(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of either table that the other lacks, with multiplicity; ``side`` tells which has them."""
    return a.exceptAll(b).withColumn("side", F.lit("first")).unionByName(b.exceptAll(a).withColumn("side", F.lit("second")))
