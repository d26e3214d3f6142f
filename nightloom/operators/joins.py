"""Joins on keys of which a few may hold a large part of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key is hot when it holds more than this part of all rows, so there are fewer than a thousand hot ones, whatever the table.
HOT = 1000


def joined(rows: DataFrame, table: DataFrame, keys: list[str], count: str, total: int) -> DataFrame:
    """The inner join of ``rows`` and ``table`` on ``keys``, for keys that may be hot; the column ``count`` goes.

    ``count``: how many of the ``total`` rows have the key, in every row of ``table``. A hot key's rows would all meet in one
    task; they stay where they are instead, and the table's rows of hot keys, of which there are fewer than HOT keys, are
    broadcast. ``rows`` and ``table`` are read twice, so they should be settled; keys must not be null.
    """
    hot = F.col(count) * HOT > total
    few = F.broadcast(table.filter(hot).withColumn("__hot", F.lit(True)).drop(count))
    split = rows.join(few, keys, "left")  # the same in both branches, so broadcast once
    rest = split.filter("__hot is null").select(rows.columns).join(table.filter(~hot).drop(count), keys)
    return split.filter("__hot").drop("__hot").unionByName(rest)
