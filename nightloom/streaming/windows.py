"""Streams: sessions, request budgets and state that expires, over files that arrive."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nightloom.operators.graph import discard, shared_dir
from nightloom.streaming import stateful, tables


def stream(spark: SparkSession, path: str, **options: str) -> DataFrame:
    """Parquet files of a folder (or a pattern) as a stream with the schema that they have."""
    folder, _, name = path.rpartition("/")
    return spark.readStream.schema(spark.read.parquet(path).schema).options(pathGlobFilter=name, **options).parquet(folder)


def sessions(events: DataFrame, keys: list[str], time: str, gap: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    """Runs whose gaps are under ``gap``; later rows than ``late`` are dropped and finished sessions leave the state."""
    at = F.col(time).cast("timestamp")
    return events.withColumn("at", at).withWatermark("at", late).groupBy(*keys, F.session_window("at", gap).alias("w")).agg(F.count(F.lit(1)).alias("n")).select(*keys, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def budgets(events: DataFrame, keys: list[str], time: str, cost: str, length: str = "1 hour", slide: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Cost of each sliding window."""
    at = F.col(time).cast("timestamp")
    return events.withColumn("at", at).withWatermark("at", late).groupBy(*keys, F.window("at", length, slide).alias("w")).agg(F.round(F.sum(cost), 6).alias("spent")).select(*keys, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "spent")


def first_seen(events: DataFrame, keys: list[str], time: str, late: str = "7 days") -> DataFrame:
    """The first row of each key; keys are forgotten once they are older than ``late``."""
    return events.withColumn("at", F.col(time).cast("timestamp")).withWatermark("at", late).dropDuplicatesWithinWatermark(keys)


def finished(spark: SparkSession, df: DataFrame) -> DataFrame:
    """Run a stream over what there is, into a table of the shared folder, and read that.

    Only what can't change any more is written (append mode): windows that the watermark has passed, which then leave the state.
    """
    out = f"{shared_dir(spark).rstrip('/')}/stream-{uuid.uuid4().hex}"
    df.writeStream.format("parquet").option("path", f"{out}/rows").option("checkpointLocation", f"{out}/state").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    discard(spark, f"{out}/state")
    return spark.read.schema(df.schema).parquet(f"{out}/rows")


def _text(df: DataFrame) -> DataFrame:
    return df.withColumn("start", F.date_format("start", "yyyy-MM-dd HH:mm")).withColumn("end", F.date_format("end", "yyyy-MM-dd HH:mm"))


def stream_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions of each user that are over by the watermark."""
    e = stream(spark, f"{sf_dir}/events.parquet").select("user_id", "ts")
    return _text(finished(spark, sessions(e, ["user_id"], "ts", "3 hours")))


def stream_budgets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each user spends in windows that are over by the watermark."""
    e = stream(spark, f"{sf_dir}/events.parquet").select("user_id", "ts", F.lit(1.5).alias("cost"))
    return _text(finished(spark, budgets(e, ["user_id"], "ts", "cost")))


def stream_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest event of each user, merged batch by batch into a table."""
    e = stream(spark, f"{sf_dir}/events.parquet", maxFilesPerTrigger="1").select("user_id", "event_id", "ts")
    return tables.merged(e, ["user_id"], "ts", f"{shared_dir(spark).rstrip('/')}/stream-{uuid.uuid4().hex}").select("user_id", "event_id")


#: A day's budget of requests, and hours that snapshots of two models live.
BUDGET, DAY, LIVES = 3.0, 86_400_000, (3, 6)


def timed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a stream: user_id, id, at (milliseconds), t with a watermark of an hour."""
    e = stream(spark, f"{sf_dir}/events.parquet")
    return e.select("user_id", F.col("event_id").alias("id"), F.unix_millis(F.col("ts").cast("timestamp")).alias("at"), F.col("ts").cast("timestamp").alias("t")).withWatermark("t", "1 hour")


def stream_pacing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests of each user within a day's budget: when each one goes, for those that are gone by the watermark."""
    with stateful.keyed_state(spark):
        return finished(spark, stateful.paced(timed(spark, sf_dir).withColumn("weight", F.lit(1.0)), ["user_id"], BUDGET, DAY)).select("user_id", "id", "at", "release")


def stream_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reads of each user's cell, served by a snapshot that lives three or six hours by its model."""
    ttl = F.when(F.col("user_id") % 2 == 0, LIVES[0]).otherwise(LIVES[1]) * 3_600_000
    with stateful.keyed_state(spark):
        return finished(spark, stateful.snapshots(timed(spark, sf_dir).withColumn("ttl", ttl.cast("long")), ["user_id"])).select("user_id", "id", "hit", "fetched")


def stream_first_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users that a stream has seen, each once: keys are state, and leave it after seven days."""
    e = stream(spark, f"{sf_dir}/events.parquet").select("user_id", "ts")
    return finished(spark, first_seen(e, ["user_id"], "ts", "60 days").select("user_id"))


QUERIES = {"stream_first_seen": stream_first_seen, "stream_sessions": stream_sessions, "stream_budgets": stream_budgets, "stream_latest": stream_latest, "stream_pacing": stream_pacing, "stream_snapshots": stream_snapshots}
SQL = {
    "stream_first_seen": "SELECT DISTINCT user_id FROM events",
    "stream_sessions": """WITH d AS (SELECT user_id, ts, CASE WHEN ts >= lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 3 HOUR THEN 1 ELSE 0 END AS new FROM events), g AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM d),
        s AS (SELECT user_id, min(ts) AS a, max(ts) + INTERVAL 3 HOUR AS b, count(*) AS n FROM g GROUP BY user_id, k)
        SELECT user_id, strftime(a, '%Y-%m-%d %H:%M') AS start, strftime(b, '%Y-%m-%d %H:%M') AS "end", n FROM s WHERE b <= (SELECT date_trunc('millisecond', max(ts)) FROM events) - INTERVAL 1 HOUR""",
    "stream_budgets": """WITH w AS (SELECT user_id, unnest([time_bucket(INTERVAL 30 MINUTE, ts), time_bucket(INTERVAL 30 MINUTE, ts) - INTERVAL 30 MINUTE]) AS s FROM events)
        SELECT user_id, strftime(s, '%Y-%m-%d %H:%M') AS start, strftime(s + INTERVAL 1 HOUR, '%Y-%m-%d %H:%M') AS "end", round(CAST(sum(1.5) AS DOUBLE), 6) AS spent FROM w WHERE s + INTERVAL 1 HOUR <= (SELECT date_trunc('millisecond', max(ts)) FROM events) - INTERVAL 1 HOUR GROUP BY user_id, s""",
    "stream_pacing": f"""WITH RECURSIVE q AS (SELECT user_id, event_id AS id, (epoch_us(ts) // 1000) AS "at", row_number() OVER (PARTITION BY user_id ORDER BY (epoch_us(ts) // 1000), event_id) AS n FROM events),
        r(user_id, id, "at", n, release, past) AS (SELECT user_id, id, "at", n, "at", ["at"] FROM q WHERE n = 1
            UNION ALL SELECT user_id, id, "at", n, release, list_append(past, release)[-{int(BUDGET)}:] FROM (SELECT q.*, past, greatest(q."at", past[-1], CASE WHEN len(past) = {int(BUDGET)} THEN past[1] + {DAY} ELSE 0 END) AS release FROM r JOIN q ON q.user_id = r.user_id AND q.n = r.n + 1))
        SELECT user_id, id, "at", release FROM r WHERE release <= (SELECT epoch_us(max(ts)) // 1000 FROM events) - 3600000""",
    "stream_snapshots": f"""WITH RECURSIVE q AS (SELECT user_id, event_id AS id, (epoch_us(ts) // 1000) AS "at", CASE WHEN user_id % 2 = 0 THEN {LIVES[0]} ELSE {LIVES[1]} END * 3600000 AS ttl, row_number() OVER (PARTITION BY user_id ORDER BY (epoch_us(ts) // 1000), event_id) AS n FROM events),
        r(user_id, id, "at", n, hit, fetched) AS (SELECT user_id, id, "at", n, false, "at" FROM q WHERE n = 1 UNION ALL SELECT q.user_id, q.id, q."at", q.n, q."at" < fetched + ttl, CASE WHEN q."at" < fetched + ttl THEN fetched ELSE q."at" END FROM r JOIN q ON q.user_id = r.user_id AND q.n = r.n + 1)
        SELECT user_id, id, hit, fetched FROM r WHERE "at" <= (SELECT epoch_us(max(ts)) // 1000 FROM events) - 3600000""",
    "stream_latest": "SELECT user_id, arg_max(event_id, (ts, event_id)) AS event_id FROM events GROUP BY 1",
}
