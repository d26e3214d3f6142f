"""Runs of true flags in ordered series (gaps and islands)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def marked(df: DataFrame, keys: list[str], time: str, flag: Column) -> DataFrame:
    """``df`` with ok (the flag, null as false), run (rows of one run share it within a key) and next (the following time)."""
    w = Window.partitionBy(*keys).orderBy(time)
    df = df.withColumn("ok", F.coalesce(flag, F.lit(False)))
    return df.withColumn("run", F.count(F.when(~F.col("ok"), 1)).over(w)).withColumn("next", F.lead(time).over(w))


def all_runs(df: DataFrame, keys: list[str], time: str, flag: Column, *more: Column) -> DataFrame:
    """One row per run: keys, start, last (its last true row), end (the first false row after it, else last), n, and ``more``."""
    m = marked(df, keys, time, flag).filter("ok")
    return m.groupBy(*keys, "run").agg(F.min(time).alias("start"), F.max(time).alias("last"), F.max(F.coalesce("next", time)).alias("end"), F.count(F.lit(1)).alias("n"), *more).drop("run")


def hours_between(start: str | Column, end: str | Column) -> Column:
    second = lambda c: F.unix_micros((F.col(c) if isinstance(c, str) else c).cast("timestamp"))
    return (second(end) - second(start)) / 3.6e9


def first_by(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """Of each key the first row in ``order``; ties must be settled by the order itself."""
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("__n = 1").drop("__n")


def longest_sampled(df: DataFrame, keys: list[str], time: str, flag: Column, *more: Column) -> DataFrame:
    """The longest run of a sampled series, the first on ties. It ends at the first false sample; runs of no length never win."""
    runs = all_runs(df, keys, time, flag, *more).withColumn("hours", hours_between("start", "end")).filter("hours > 0")
    return first_by(runs, keys, F.desc("hours"), F.asc("start"))


def longest_clear(df: DataFrame, keys: list[str], time: str, value: str, lo: str, hi: str, threshold: float = 30.0, least_hours: float = 1.0) -> DataFrame:
    """The longest run of hourly rows with ``value`` <= threshold, clamped to the window ``lo``..``hi``.

    Keys, start, end, hours, mean. A run lasts until an hour after its last row; the mean is over all its rows, also those
    that the window cuts off; a run shorter than ``least_hours`` is none.
    """
    m = marked(df, keys, time, F.col(value) <= threshold).filter("ok")
    runs = m.groupBy(*keys, "run", lo, hi).agg(F.min(time).alias("first"), F.max(time).alias("last"), F.avg(value).alias("mean"))
    runs = runs.withColumn("start", F.greatest("first", lo)).withColumn("end", F.least(F.col("last") + F.expr("interval 1 hour"), F.col(hi)))
    runs = runs.filter(F.col("end") > F.col("start")).withColumn("hours", hours_between("start", "end"))
    return first_by(runs, keys, F.desc("hours"), F.asc("start")).filter(F.col("hours") >= least_hours).select(*keys, "start", "end", "hours", "mean")


def merged_runs(runs: DataFrame, keys: list[str], start: str, last: str, gap: str) -> DataFrame:
    """Runs whose distance is at most ``gap`` (an interval) as one: keys, start, last, runs."""
    w = Window.partitionBy(*keys).orderBy(start)
    reach = F.max(last).over(w.rowsBetween(Window.unboundedPreceding, -1))
    new = F.when(F.col(start) > reach + F.expr(f"interval {gap}"), 1)
    return runs.withColumn("__g", F.count(new).over(w)).groupBy(*keys, "__g").agg(F.min(start).alias("start"), F.max(last).alias("last"), F.count(F.lit(1)).alias("runs")).drop("__g")


def peak_in_runs(df: DataFrame, keys: list[str], time: str, flag: Column, value: str) -> DataFrame:
    """All runs with the first of their greatest values: keys, start, end, peak_time, peak, rises, sets.

    ``rises``: the run doesn't begin with the series' first row; ``sets``: it doesn't end with the last.
    """
    w = Window.partitionBy(*keys)
    m = marked(df, keys, time, flag).withColumn("t0", F.min(time).over(w)).withColumn("t1", F.max(time).over(w)).filter("ok")
    r = Window.partitionBy(*keys, "run")
    m = m.withColumn("start", F.min(time).over(r)).withColumn("last", F.max(time).over(r)).withColumn("end", F.max(F.coalesce("next", time)).over(r))
    top = first_by(m, [*keys, "run"], F.desc(value), F.asc(time))
    return top.select(*keys, "start", "end", F.col(time).alias("peak_time"), F.col(value).alias("peak"), (F.col("start") > F.col("t0")).alias("rises"), (F.col("last") < F.col("t1")).alias("sets"))


def sign_changes(df: DataFrame, keys: list[str], time: str, value: str) -> DataFrame:
    """The first upward and the first downward crossing of zero for each key: keys, kind (rise, set), at."""
    before = F.lag(value).over(Window.partitionBy(*keys).orderBy(time))
    kind = F.when((F.col("before") <= 0) & (F.col(value) > 0), "rise").when((F.col("before") > 0) & (F.col(value) <= 0), "set")
    return df.withColumn("before", before).withColumn("kind", kind).filter("kind is not null").groupBy(*keys, "kind").agg(F.min(time).alias("at"))


def first_after(anchors: DataFrame, events: DataFrame, keys: list[str], at: str, time: str) -> DataFrame:
    """Each anchor with the first later event of its key, null if none. One sort of both together instead of a range join."""
    both = anchors.select(*keys, F.col(at).alias("__t"), F.lit(1).alias("__k")).unionByName(events.select(*keys, F.col(time).alias("__t"), F.lit(0).alias("__k")))
    w = Window.partitionBy(*keys).orderBy(F.desc("__t"), F.desc("__k")).rowsBetween(Window.unboundedPreceding, 0)
    seen = both.withColumn(time, F.min(F.when(F.col("__k") == 0, F.col("__t"))).over(w))
    return seen.filter("__k = 1").select(*keys, F.col("__t").alias(at), time)


def last_before(anchors: DataFrame, events: DataFrame, keys: list[str], at: str, time: str, value: str) -> DataFrame:
    """Backward as-of join: each anchor with the value of the latest event of its key that is not later."""
    both = anchors.select(*keys, F.col(at).alias("__t"), F.lit(1).alias("__k"), F.lit(None).cast(events.schema[value].dataType).alias("__v")).unionByName(
        events.select(*keys, F.col(time).alias("__t"), F.lit(0).alias("__k"), F.col(value).alias("__v"))
    )
    w = Window.partitionBy(*keys).orderBy("__t", "__k", "__v").rowsBetween(Window.unboundedPreceding, 0)
    seen = both.withColumn("__s", F.last(F.when(F.col("__k") == 0, F.struct(F.col("__t").alias("t"), F.col("__v").alias("v"))), ignorenulls=True).over(w))
    return seen.filter("__k = 1").select(*keys, F.col("__t").alias(at), F.col("__s.t").alias(time), F.col("__s.v").alias(value))
