"""What the corpus operators share: gapless ranks, word classes, and lineage cuts from the library."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from nightloom.operators.graph import settle, shared_dir
from nightloom.operators.joins import HOT, joined

__all__ = ["HOT", "SPACE", "WORD", "gapless", "joined", "settle", "shared_dir", "text_of"]

#: White space as the contracts have it: space, tab, line feed, vertical tab, form feed, carriage return.
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"


def text_of(col: str) -> Column:
    """A text column with null as the empty text."""
    return F.coalesce(F.col(col), F.lit(""))


def gapless(df: DataFrame, keys: list[str], out: str, order: list[str]) -> DataFrame:
    """Add ``out``: 0, 1, 2 ... within each key, without gaps, in no promised order across partitions.

    A plain ``row_number`` sends a key's rows to one task. Here every (key, partition) pair counts for itself,
    and only the counts - one row for each pair - are summed up over a key, so a key with a third of all rows
    is still spread over all tasks. ``keys`` must not be null.
    """
    base = settle(df.withColumn("__p", F.spark_partition_id()))
    pair = [*keys, "__p"]
    before = Window.partitionBy(*keys).orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    offsets = base.groupBy(*pair).agg(F.count(F.lit(1)).alias("__n")).select(*pair, F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    own = base.withColumn("__own", F.row_number().over(Window.partitionBy(*pair).orderBy(*order)) - 1)
    return own.join(offsets, pair).withColumn(out, (F.col("__own") + F.col("__before")).cast("long")).drop("__p", "__own", "__before")
