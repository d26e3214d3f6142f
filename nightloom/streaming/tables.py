"""Tables that streams merge into, batch by batch, and that outlive restarts.

A table is a number of shards, by the hash of its keys. A batch rewrites the shards that it touches into a new folder, and then
commits a manifest with its batch id, which names the folder of every shard. The newest manifest is the table: a batch that
failed before its manifest has changed nothing, one that comes again after it is passed over, and nothing is kept in memory.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from nightloom.operators.graph import discard

#: Shards of a table, and versions whose files are kept.
SHARDS, KEPT = 16, 2


class Files:
    """A few small files in a folder of any of Spark's file systems."""

    def __init__(self, spark: SparkSession, folder: str):
        self.jvm = spark.sparkContext._jvm
        self.root = self.jvm.org.apache.hadoop.fs.Path(folder)
        self.fs = self.root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(self.root, name)

    def names(self) -> list[str]:
        return sorted(x.getPath().getName() for x in self.fs.listStatus(self.root)) if self.fs.exists(self.root) else []

    def read(self, name: str) -> str:
        stream = self.fs.open(self.path(name))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def put(self, name: str, text: str) -> None:
        """The file appears whole or not at all: it is written under another name first."""
        part = self.path(f".{name}-{uuid.uuid4().hex}")
        stream = self.fs.create(part)
        stream.write(bytearray(text.encode()))
        stream.close()
        if not self.fs.rename(part, self.path(name)):
            raise OSError(f"cannot commit {name} in {self.root}")


class LatestTable:
    """The latest row of each key by ``order`` (of equal ones the greatest by the other columns), in ``folder``."""

    def __init__(self, spark: SparkSession, folder: str, schema, keys: list[str], order: str, shards: int = SHARDS):
        self.spark, self.folder, self.schema, self.keys, self.order, self.shards = spark, folder.rstrip("/"), schema, keys, order, shards
        self.manifests = Files(spark, f"{self.folder}/manifests")

    def versions(self) -> list[int]:
        return sorted(int(n.removesuffix(".json")) for n in self.manifests.names() if n.endswith(".json") and not n.startswith("."))

    def held(self, version: int | None = None) -> dict[str, str]:
        """The folder of each shard that has rows, in a version, by default the newest."""
        found = self.versions()
        return json.loads(self.manifests.read(f"{(found[-1] if version is None else version):012d}.json")) if found else {}

    def rows(self, shards: list[str] | None = None) -> DataFrame:
        """The table, or some of its shards; without a version, or rows, it is empty."""
        held = self.held()
        paths = [f"{self.folder}/data/{f}/shard={s}" for s, f in held.items() if shards is None or s in shards]
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def shard(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.shards)).cast("int")

    def put(self, batch: DataFrame, batch_id: int) -> None:
        """Merge a batch: a batch id that is committed, or an older one, changes nothing."""
        found = self.versions()
        if found and batch_id <= found[-1]:
            return
        columns = self.schema.names
        body = F.struct(self.order, *(c for c in columns if c not in self.keys and c != self.order))
        newest = lambda df: df.groupBy(*self.keys).agg(F.max(body).alias("r")).select(*self.keys, "r.*").select(*columns)
        batch = newest(batch.select(*columns)).persist()
        try:
            touched = [str(r[0]) for r in batch.select(self.shard()).distinct().collect()]  # no more than shards
            held = self.held()
            if touched:
                name = f"{batch_id:012d}-{uuid.uuid4().hex}"
                merged = newest(self.rows(touched).unionByName(batch)).withColumn("shard", self.shard())
                merged.repartition(F.col("shard")).write.partitionBy("shard").parquet(f"{self.folder}/data/{name}")
                held |= dict.fromkeys(touched, name)
            self.manifests.put(f"{batch_id:012d}.json", json.dumps(held))
        finally:
            batch.unpersist()
        self.clean()

    def clean(self) -> None:
        """Delete versions before the last KEPT, and files that none of these names."""
        found = self.versions()
        named = {f for v in found[-KEPT:] for f in self.held(v).values()}
        for v in found[:-KEPT]:
            discard(self.spark, f"{self.folder}/manifests/{v:012d}.json")
        for f in Files(self.spark, f"{self.folder}/data").names():
            if f not in named:
                discard(self.spark, f"{self.folder}/data/{f}")


def merged(df: DataFrame, keys: list[str], order: str, folder: str) -> DataFrame:
    """Run a stream over what there is into the table in ``folder``, and read that.

    Started again with the same folder it goes on where it was: after a stop at any point, with new files, or with none.
    """
    table = LatestTable(df.sparkSession, folder, df.schema, keys, order)
    df.writeStream.foreachBatch(table.put).option("checkpointLocation", f"{folder.rstrip('/')}/state").trigger(availableNow=True).start().awaitTermination()
    return table.rows()
