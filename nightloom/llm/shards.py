"""Sharding by longest-processing-time scheduling: groups that stay together go, largest first, to the least-loaded shard.

The heap runs on the driver over the distinct sizes of groups, with their counts, not over groups. However large a corpus is,
sizes that differ sum up to at most its bytes, so there are at most sqrt(2 * bytes) of them: 14 million for 100 TB, about a
thousandth of that where sizes crowd together, as texts' do. Groups of one size are dealt at once, with the result that the
heap would give one by one. What the driver holds is the shards' loads, a partition of the ordered sizes and a block of the
plan; each block is written to the shared folder before the next one is worked out. The plan has a row for each size, with the
shards that take its groups and how many groups each; it is joined with the groups, which are numbered within their size
partition by partition.
"""

from __future__ import annotations

import heapq
import uuid
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nightloom.llm.common import gapless, joined, settle, shared_dir, text_of
from nightloom.operators.graph import discard

SHARDS, OVERHEAD = 40, 16
#: Sizes whose plan is worked out and written at once.
BLOCK = 4000


def dealt(loads: list[tuple[int, int]], size: int, count: int) -> dict[int, int]:
    """Groups that each shard gets of ``count`` groups of one size; ``loads``, a heap of (load, shard), is brought up to date.

    A group goes to the least-loaded shard, of several to the one with the least number. Each shard takes a group whenever its
    load is the least, that is at load, load + size, load + 2 * size and so on; so all that come before the level which
    ``count`` groups can reach are taken at once, and the heap deals out the rest.
    """
    given: dict[int, int] = {}
    if count > len(loads):
        lowest = min(loads)[0]
        lo, hi = lowest, lowest + size * count  # the highest level that no more than ``count`` groups lie below
        while lo < hi:
            level = (lo + hi + 1) // 2
            if sum(max(0, -((load - level) // size)) for load, _ in loads) <= count:
                lo = level
            else:
                hi = level - 1
        given = {shard: n for load, shard in loads if (n := max(0, -((load - lo) // size)))}
        loads[:] = [(load + size * given.get(shard, 0), shard) for load, shard in loads]
        heapq.heapify(loads)
        count -= sum(given.values())
    for _ in range(count):
        load, shard = loads[0]
        heapq.heapreplace(loads, (load + size, shard))
        given[shard] = given.get(shard, 0) + 1
    return given


def schedule(sizes: np.ndarray, counts: np.ndarray, shards: int, loads: list[tuple[int, int]] | None = None) -> pa.Table:
    """(total, lo, hi, shard): where the groups numbered lo to hi of each size go. Equal sizes are dealt in order of shards.

    ``loads``: the heap that earlier, larger sizes have left, which is brought up to date.
    """
    loads = [(0, s) for s in range(shards)] if loads is None else loads
    rows: list[tuple[int, int, int, int]] = []
    order = np.argsort(-sizes)
    for size, count in zip(sizes[order].tolist(), counts[order].tolist(), strict=True):
        lo = 0
        for shard, n in sorted(dealt(loads, size, count).items()):
            rows.append((size, lo, lo + n, shard))
            lo += n
    columns = np.array(rows, np.int64).reshape(-1, 4).T
    return pa.table({"total": columns[0], "lo": columns[1], "hi": columns[2], "shard": columns[3].astype(np.int32)})


def blocks(kinds: Iterator[tuple[int, int]], shards: int, block: int = BLOCK) -> Iterator[pa.Table]:
    """The plan for (size, groups), largest first, in blocks: total, groups, to (where each shard's groups end), shards."""
    loads = [(0, s) for s in range(shards)]
    while some := list(islice(kinds, block)):
        sizes, counts = (np.array(x, np.int64) for x in zip(*some, strict=True))
        table = schedule(sizes, counts, shards, loads)
        of = table["total"].to_numpy()
        begins = pa.array(np.append(np.flatnonzero(np.append(True, of[1:] != of[:-1])), len(of)), pa.int32())
        lists = [pa.ListArray.from_arrays(begins, table[c].combine_chunks()) for c in ("hi", "shard")]
        yield pa.table([pa.array(sizes), pa.array(counts), *lists], ["total", "groups", "to", "shards"])


PLAN = "total long, groups long, to array<long>, shards array<int>"


def write_plan(spark: SparkSession, kinds: DataFrame, shards: int, folder: str) -> DataFrame:
    spark.createDataFrame([], PLAN).write.parquet(folder)
    ordered = ((r["total"], r["groups"]) for r in kinds.orderBy(F.desc("total")).toLocalIterator())
    for table in blocks(ordered, shards):
        spark.createDataFrame(table).coalesce(1).write.mode("append").parquet(folder)
    return spark.read.schema(PLAN).parquet(folder)


def sharded(docs: DataFrame, shards: int = SHARDS, *, id_col: str = "doc_id", text_col: str = "text", overhead: int = OVERHEAD) -> DataFrame:
    """One row per input row: doc_id, size, text_crc32, law, shard, slot, grown_shard.

    The law is ``bytes``: shards' sizes are near equal, unless a group alone is larger than an even share; the largest exceeds
    the least by no more than a group. A row's size is
    its text's UTF-8 bytes and ``overhead``; rows of equal texts are a group and share a shard (null counts as empty).
    Slots number a shard's rows from 0 without gaps. Repeated rows and null ids are rows like others; only the id and text
    columns are read. No rows: no rows.
    """
    t = text_of(text_col)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), (F.octet_length(t) + overhead).cast("long").alias("size"), F.crc32(t).alias("text_crc32"), F.unhex(F.sha2(t, 256)).alias("same"))
    rows = settle(rows)
    groups = settle(rows.groupBy("same").agg(F.sum("size").alias("total"), F.count(F.lit(1)).alias("n")))
    kinds = settle(groups.groupBy("total").agg(F.count(F.lit(1)).alias("groups")))
    folder = f"{shared_dir(docs.sparkSession).rstrip('/')}/shards-{uuid.uuid4().hex}"
    plan = write_plan(docs.sparkSession, kinds, shards, folder)
    numbered = settle(gapless(groups, ["total"], "nth", ["same"]))
    shard = F.element_at("shards", F.size(F.filter("to", lambda x: x <= F.col("nth"))) + 1)
    placed = settle(joined(numbered, plan, ["total"], "groups", groups.count()).select("same", shard.alias("shard"), "n"))
    discard(docs.sparkSession, folder)
    placed = joined(rows, placed, ["same"], "n", rows.count()).drop("same")
    return gapless(placed, ["shard"], "slot", ["doc_id"]).select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
