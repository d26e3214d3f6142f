"""Lloyd's clustering of quantised vectors, each distinct vector once, in whole numbers.

Vectors become integer components; equal ones form one row with a multiplicity. Rounds run over the distinct rows: each task
assigns its rows with one matrix product a batch and sums components times multiplicities, so what a round shuffles is one
row for each (task, cluster, component), and what the driver sees is the centroids. All arithmetic is exact: batches use
floats where every intermediate value is a whole number below 2**53, longs below 2**62, and Python's integers beyond.
Assignments go back to the rows by a 256-bit digest of the components; a digest with many rows is not moved.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nightloom.llm.common import joined, settle

DIMENSIONS, SCALE, CLUSTERS, ROUNDS, SEED = 64, 256, 40, 5, "2"
#: Components beyond this are set to it, so that a squared distance always fits in a long.
MOST = 1 << 27
LONGEST = (1 << 63) - 1


def quantised(vectors: DataFrame, id_col: str, vector_col: str, dimensions: int, scale: int) -> DataFrame:
    """vec_id, q: the kept vectors' integer components."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    kept = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v")).filter((F.size("v") == dimensions) & F.forall("v", finite))
    whole = lambda x: F.floor(F.least(F.greatest(x * scale, F.lit(float(-MOST))), F.lit(float(MOST)))).cast("int")
    return kept.select("vec_id", F.transform("v", whole).alias("q"))


def digest(q: Column) -> Column:
    return F.unhex(F.sha2(F.array_join(q.cast("array<string>"), ","), 256))


def matrix(column: pa.ListArray) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), -1)


def nearest(q: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centroid of each row, the first on ties, and the squared distance to it."""
    far = 2 * max(int(np.abs(q).max(initial=0)), int(np.abs(centroids).max(initial=0)))
    kind = np.float64 if far * far * q.shape[1] < 1 << 53 else np.int64
    x, c = q.astype(kind), centroids.astype(kind)
    distances = (x * x).sum(axis=1)[:, None] - 2 * (x @ c.T) + (c * c).sum(axis=1)[None, :]
    best = distances.argmin(axis=1)
    return best, distances[np.arange(len(q)), best].astype(np.int64)


def weighted_sums(q: np.ndarray, counts: np.ndarray, best: np.ndarray, k: int) -> np.ndarray:
    """For each cluster the sums of components and, last, of counts, as Python integers."""
    wide = int(np.abs(q).max(initial=1)) * int(counts.sum(dtype=object) if len(counts) else 0)
    kind = np.int64 if wide < 1 << 62 else object
    out = np.zeros((k, q.shape[1] + 1), kind)
    rows = np.concatenate([q.astype(kind) * counts.astype(kind)[:, None], counts.astype(kind)[:, None]], axis=1)
    np.add.at(out, best, rows)
    return out.astype(object)


def summed(centroids: np.ndarray):
    """Batches of (q, n) to one row (cluster, sums) for each cluster that a task has met."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in batches:
            if b.num_rows:
                q, n = matrix(b.column("q")), b.column("n").to_numpy(zero_copy_only=False)
                sums = weighted_sums(q, n, nearest(q, centroids)[0], len(centroids))
                total = sums if total is None else total + sums
        met = [] if total is None else [(k, [str(x) for x in row]) for k, row in enumerate(total) if row[-1]]
        yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in met], pa.int32()), pa.array([s for _, s in met], pa.list_(pa.string()))], ["cluster", "sums"])

    return run


def assigned(centroids: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                best, distance = nearest(matrix(b.column("q")), centroids)
                yield pa.RecordBatch.from_arrays([b.column("same"), b.column("n"), pa.array(best, pa.int32()), pa.array(distance, pa.int64())], ["same", "n", "cluster", "distance"])

    return run


def clustered(
    vectors: DataFrame, clusters: int = CLUSTERS, rounds: int = ROUNDS, *, id_col: str = "vec_id", vector_col: str = "embedding", dimensions: int = DIMENSIONS, scale: int = SCALE, seed: str = SEED
) -> tuple[DataFrame, list[list[int]]]:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 for each kept vector), and the final centroids.

    Kept are vectors of exactly ``dimensions`` components, none null, infinite or NaN; component x is floor(scale * x), set to
    +-2**27 beyond these. Centroids start as the kept vectors with the least sha256 of ``seed:vec_id`` (null ids last, then by
    components), each round assigns (ties: the smaller number) and replaces non-empty centroids by the floor of their mean, and
    a last assignment follows. Fewer vectors than ``clusters``: so many clusters; repeated ids and vectors are rows like others
    and may start several centroids; inertias that no long holds are its greatest value. Only the id and vector columns are
    read. No kept vectors: no rows.
    """
    rows = quantised(vectors, id_col, vector_col, dimensions, scale)
    start = rows.select(F.when(F.col("vec_id").isNotNull(), F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)).alias("hash"), "q")
    centroids = np.array([r["q"] for r in start.orderBy(F.asc_nulls_last("hash"), "q").limit(clusters).collect()], np.int64)  # as many rows as clusters
    named = settle(rows.select("vec_id", digest(F.col("q")).alias("same")))
    distinct = settle(rows.groupBy("q").agg(F.count(F.lit(1)).alias("n")).select(digest(F.col("q")).alias("same"), "q", "n"))
    for _ in range(rounds if len(centroids) else 0):
        sums = distinct.select("q", "n").mapInArrow(summed(centroids), "cluster int, sums array<string>")
        sums = sums.select("cluster", F.posexplode("sums").alias("at", "x")).groupBy("cluster", "at").agg(F.sum(F.col("x").cast("decimal(38,0)")).alias("x"))
        found: dict[int, dict[int, int]] = {}
        for r in sums.collect():  # clusters times components
            found.setdefault(r["cluster"], {})[r["at"]] = int(r["x"])
        for k, s in found.items():
            centroids[k] = [s[j] // s[dimensions] for j in range(dimensions)]
    centroids = centroids.reshape(-1, dimensions)
    best = settle(distinct.mapInArrow(assigned(centroids), "same binary, n long, cluster int, distance long"))
    inertias = {r["cluster"]: int(r["x"]) for r in best.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)") * F.col("n")).alias("x")).collect()}
    facts = [(k, min(inertias.get(k, 0), LONGEST), min(sum(inertias.values()), LONGEST), hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest()) for k, c in enumerate(centroids)]
    facts = vectors.sparkSession.createDataFrame(facts, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    found = joined(named, best, ["same"], "n", named.count())
    return found.join(F.broadcast(facts), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"), centroids.tolist()
