"""Scores, ranks and order statistics."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from nightloom.operators.graph import settle
from nightloom.operators.joins import joined


def final_score(obstruction: Column, alt: Column, horizon: Column, clear: Column, light: Column) -> Column:
    return (100 - obstruction) + 0.5 * F.greatest(F.lit(0.0), alt - F.coalesce(horizon, F.lit(0.0))) + 3 * clear - 10 * light


def outlook_score(alt: Column, horizon: Column, moon_free: Column, light: Column) -> Column:
    return (100 - 10 * light) + 0.5 * F.greatest(F.lit(0.0), alt - F.coalesce(horizon, F.lit(0.0))) + 3 * moon_free


def ranked(df: DataFrame, groups: list[str], *order: Column, out: str = "rank") -> DataFrame:
    return df.withColumn(out, F.row_number().over(Window.partitionBy(*groups).orderBy(*order)))


def numbered(df: DataFrame, groups: list[str], *order: Column, out: str = "rank") -> DataFrame:
    """``ranked`` for few groups of many rows: rows are dealt by ranges of groups and order, each range numbers its rows, and is
    shifted by its group's rows in the ranges before it. No task sees more than its range. The order must be total.

    Rows are settled first: the ranges' bounds take a run over them of their own, which would work them out once more."""
    base = settle(settle(df).repartitionByRange(*(F.asc(g) for g in groups), *order).withColumn("__p", F.spark_partition_id()))
    own = [*groups, "__p"]
    before = Window.partitionBy(*groups).orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    shift = base.groupBy(*own).agg(F.count(F.lit(1)).alias("__n")).select(*own, F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__b"))
    mine = base.withColumn("__o", F.row_number().over(Window.partitionBy(*own).orderBy(*order)))
    return mine.join(shift, own).withColumn(out, (F.col("__o") + F.col("__b")).cast("int")).drop("__p", "__o", "__b")


def kept_nights(nights: DataFrame, keep: int = 6) -> DataFrame:
    """Stage 1: reason (null for nights that go on) and rank of nights by their moon-free hours.

    Reasons in this order: no_sunset_or_sunrise, no_astronomical_darkness, no_moon_free_window; of the nights without one,
    ordered by hours (earlier date first on ties), those after the first ``keep`` get not_in_top_n.
    """
    reason = F.when(F.col("sunset").isNull() | F.col("sunrise").isNull(), "no_sunset_or_sunrise").when(F.col("dark_start").isNull() | F.col("dark_end").isNull(), "no_astronomical_darkness")
    reason = reason.when(F.coalesce("moon_free_hours", F.lit(0.0)) <= 0, "no_moon_free_window")
    hours = F.when(reason.isNull(), F.col("moon_free_hours")).when(reason == "no_moon_free_window", 0.0)
    df = nights.withColumn("moon_free_hours", hours).withColumn("reason", reason)
    df = ranked(df.withColumn("open", F.col("reason").isNull()), ["open"], F.desc("moon_free_hours"), F.asc("night"))
    late = F.col("open") & (F.col("rank") > keep)
    return df.withColumn("reason", F.when(late, "not_in_top_n").otherwise(F.col("reason"))).withColumn("rank", F.when(F.col("open"), F.col("rank"))).drop("open")


def running(df: DataFrame, order: str, amount: str, out: str) -> DataFrame:
    """``df`` with the sum of ``amount`` over all rows before it in the order, for distinct values of ``order``.

    Rows are dealt by ranges of the order; each range sums up for itself and is shifted by the sums of the ranges before it, of
    which there are as many as partitions. No task sees more than its range.
    """
    base = settle(df.repartitionByRange(order).withColumn("__p", F.spark_partition_id()))
    ranges = base.groupBy("__p").agg(F.sum(amount).alias("__s")).withColumn("__b", F.coalesce(F.sum("__s").over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    own = F.coalesce(F.sum(amount).over(Window.partitionBy("__p").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return base.withColumn("__o", own).join(ranges.select("__p", "__b"), "__p").withColumn(out, F.col("__o") + F.col("__b")).drop("__p", "__o", "__b")


def lagged(df: DataFrame, order: str, value: str, out: str) -> DataFrame:
    """``df`` with the ``value`` of the row before it in the order of all rows, null for the first; for distinct values of ``order``.

    Rows are dealt by ranges of the order; the first row of each range gets the last value of the range with rows before it, of
    which there are as many as partitions. No task sees more than its range.
    """
    base = settle(df.repartitionByRange(order).withColumn("__p", F.spark_partition_id()))
    kept = F.struct(F.col(value).alias("v"))  # tells a null value from no row
    ranges = base.groupBy("__p").agg(F.max_by(kept, order).alias("__l")).withColumn("__b", F.lag("__l").over(Window.orderBy("__p")))
    own = F.lag(kept).over(Window.partitionBy("__p").orderBy(order))
    return base.withColumn("__o", own).join(ranges.select("__p", "__b"), "__p").withColumn(out, F.coalesce("__o", "__b")["v"]).drop("__p", "__o", "__b")


def average_rank_pct(df: DataFrame, value: str, out: str) -> DataFrame:
    """Average-tie rank over n - 1, in percent; a single row has 0, a null value null."""
    known, none = settle(df.filter(F.col(value).isNotNull())), df.filter(F.col(value).isNull())
    ties = running(known.groupBy(value).agg(F.count(F.lit(1)).alias("__n")), value, "__n", "__before")
    rows = known.count()
    pct = F.coalesce(F.try_divide((F.col("__before") + (F.col("__n") - 1) / 2) * 100, F.lit(rows - 1)), F.lit(0.0))
    found = joined(known, ties.select(value, pct.alias(out), "__n"), [value], "__n", rows)
    return found.unionByName(none.withColumn(out, F.lit(None).cast("double"))).select(*df.columns, out)


def share_at_most(df: DataFrame, reference: DataFrame, value: str, out: str) -> DataFrame:
    """Percentage of the reference's values that are at most a row's: running counts of distinct values, joined by value."""
    known, none = settle(df.filter(F.col(value).isNotNull())), df.filter(F.col(value).isNull())
    both = known.select(value, F.lit(0).alias("__r"), F.lit(1).alias("__o")).unionByName(reference.select(value, F.lit(1).alias("__r"), F.lit(0).alias("__o"))).filter(F.col(value).isNotNull())
    counts = running(both.groupBy(value).agg(F.sum("__r").alias("__n"), F.sum("__o").alias("__own")), value, "__n", "__before")
    n = counts.agg(F.sum("__n").alias("__all"))
    share = counts.crossJoin(F.broadcast(n)).select(value, "__own", F.try_divide((F.col("__before") + F.col("__n")) * 100.0, F.col("__all")).alias(out))  # one row
    found = joined(known, share, [value], "__own", known.count())
    return found.unionByName(none.withColumn(out, F.lit(None).cast("double"))).select(*df.columns, out)


def quantiles(df: DataFrame, value: str, shares: dict[str, float]) -> DataFrame:
    """One row with a column for each share: linear between order statistics, nulls left out; null for no values.

    Order statistics come from running counts of distinct values, of which every range has its own task.
    """
    counts = settle(running(df.filter(F.col(value).isNotNull()).groupBy(value).agg(F.count(F.lit(1)).alias("__n")), value, "__n", "__before"))
    rows = counts.agg(F.coalesce(F.sum("__n"), F.lit(0))).first()[0]
    at = lambda k: F.max(F.when((F.col("__before") <= k) & (F.col("__before") + F.col("__n") > k), F.col(value)))

    def between(p: float) -> Column:
        place = p * max(rows - 1, 0)
        lo = math.floor(place)
        return at(lo) + (at(min(lo + 1, max(rows - 1, 0))) - at(lo)) * (place - lo)

    return counts.agg(*(between(p).alias(n) for n, p in shares.items()))


def threshold_for(df: DataFrame, value: str, n: int) -> DataFrame:
    """The midpoint between the n-th and the next smallest value; an error if they are equal, for then no threshold lets n pass."""
    counts = running(df.filter(F.col(value).isNotNull()).groupBy(value).agg(F.count(F.lit(1)).alias("__n")), value, "__n", "__before")
    at = lambda k: F.max(F.when((F.col("__before") < k) & (F.col("__before") + F.col("__n") >= k), F.col(value)))
    mid = counts.agg(at(n).alias("a"), at(n + 1).alias("b"))
    return mid.select(F.when(F.col("a") < F.col("b"), (F.col("a") + F.col("b")) / 2).otherwise(F.raise_error(F.lit("a tie at the threshold"))).alias("threshold"))


def spearman(df: DataFrame, a: str, b: str) -> DataFrame:
    """Correlation of average-tie ranks."""
    ranks = average_rank_pct(average_rank_pct(df.select(a, b), a, "__a"), b, "__b")
    return ranks.agg(F.corr("__a", "__b").alias("spearman"))


def strided(df: DataFrame, step: int, key: str) -> DataFrame:
    """Every ``step``-th row in the order of a unique key: a sampling operator."""
    return running(df.withColumn("__one", F.lit(1)), key, "__one", "__n").filter(F.col("__n") % step == 0).drop("__n", "__one")
