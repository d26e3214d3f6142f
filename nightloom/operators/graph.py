"""Lineage cuts and connected components of link tables."""

from __future__ import annotations

import re
import tempfile
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Seconds between two requests to the driver to collect its garbage, and when it was last asked.
PATIENCE = 0.5
_asked = 0.0


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``. Where it is unset, a new one if all runs on this machine, as in
    tests; on a cluster that is an error."""
    found = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="nightloom-")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(found)
    return found


def settle(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and go on from there, so that a lost executor costs no recomputation
    and what follows sees the same rows, in the same partitions, however often it reads them.

    Shuffle and checkpoint files of what was cut off go when the driver collects its garbage, which may be late, so this asks
    for it, at most twice a second.
    """
    global _asked
    shared_dir(df.sparkSession)
    out = df.checkpoint(eager=True)
    if time.monotonic() - _asked > PATIENCE:
        df.sparkSession.sparkContext._jvm.System.gc()
        _asked = time.monotonic()
    return out


def discard(spark: SparkSession, folder: str) -> None:
    """Delete a folder of intermediate files, wherever Spark keeps it."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def parts_for(rows: int, each: int) -> int:
    """Partitions of a table of small rows: as many as its rows ask for, not as many as the shuffle before it had."""
    return max(8, rows // each)


def dealt(df: DataFrame, each: int) -> DataFrame:
    """``df`` in partitions of about ``each`` rows, for rows that take long: a table in one file of one row group is one task."""
    return df.repartition(parts_for(df.count(), each))


def components(links: DataFrame) -> DataFrame:
    """(node, comp) for every node of ``links`` (a, b: longs): comp is the smallest node that it is connected with.

    Alternating large-star and small-star rounds. Links stay distributed; each round is aggregations and joins on nodes, so
    a node with very many links is summed up map-side and split by the skew handling of joins. Rounds grow with the
    logarithm of the longest chain. A link of a node with itself or with null is ignored; no links give no rows.
    """
    edges = settle(links.filter("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    before, parts = None, parts_for(edges.count(), 250_000)
    while True:
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if now == before or not now[0]:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("comp")).union(edges.select(F.col("v"), F.col("v")).distinct())
        before = now
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").filter("v > u and v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(down, "u").filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = settle(small.union(down.select("u", F.col("m").alias("v"))).distinct().coalesce(parts))
