"""Queries over the forecast connector: answers that Spark writes from the events, fetched through the data source."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nightloom.plans.inputs import table
from nightloom.sources import documents, forecasts

LIMIT = "Minutely API request limit exceeded."


def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a service answers to up to three tries for each user's cell and model: the hours of the events, or a failure."""
    e = table(spark, sf_dir, "events").select((F.col("event_id") % 3).cast("int").alias("model"), F.col("user_id").alias("cell"), F.struct(F.col("event_id").alias("id"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm").alias("t"), F.when(F.col("value") <= 40, F.col("value")).alias("v")).alias("h"))
    rows = e.groupBy("model", "cell").agg(F.sort_array(F.collect_list("h")).alias("h"))  # a cell's own hours
    rows = rows.withColumn("attempt", F.explode(F.array(*map(F.lit, (1, 2, 3)))))
    code = (F.col("cell") * 7 + F.col("model") * 3 + F.col("attempt") * 5) % 8
    status = F.when(code == 0, 503).when(code == 1, 429).when(code == 2, 404).when(code == 3, 408).otherwise(200)
    hourly = F.struct(F.transform("h", lambda x: x["t"]).alias("time"), F.transform("h", lambda x: x["v"]).alias("cloud_cover"))
    return rows.select("model", "cell", "attempt", status.alias("status"), F.when(status == 429, LIMIT).alias("reason"), F.when(status == 200, hourly).alias("hourly"))


def fetched(spark: SparkSession, sf_dir: str, what: str) -> DataFrame:
    folder = documents.fresh(spark)
    forecasts.write_answers(answers(spark, sf_dir), folder)
    return forecasts.read(spark, folder, what=what, pushdown="once")


def forecast_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What became of each cell's fetch."""
    return fetched(spark, sf_dir, forecasts.OUTCOMES)


def forecast_hours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hours, known values and their sum of each cell that one model's fetch has got."""
    rows = fetched(spark, sf_dir, forecasts.HOURS).filter("model = 1")
    return rows.groupBy("cell").agg(F.count(F.lit(1)).alias("hours"), F.count("cloud_cover").alias("known"), F.round(F.sum("cloud_cover"), 6).alias("cloud"))


_STATUS = "CASE (cell * 7 + model * 3 + {0} * 5) % 8 WHEN 0 THEN 503 WHEN 1 THEN 429 WHEN 2 THEN 404 WHEN 3 THEN 408 ELSE 200 END"
_TRIED = f"""c AS (SELECT event_id % 3 AS model, user_id AS cell, count(*) AS hours, count(*) FILTER (value <= 40) AS known, sum(value) FILTER (value <= 40) AS cloud FROM events GROUP BY 1, 2),
    s AS (SELECT *, {_STATUS.format(1)} AS s1, {_STATUS.format(2)} AS s2, {_STATUS.format(3)} AS s3 FROM c),
    t AS (SELECT *, CASE WHEN s1 IN (200, 429, 404) THEN 1 WHEN s2 IN (200, 429, 404) THEN 2 ELSE 3 END AS attempts FROM s), o AS (SELECT *, [s1, s2, s3][attempts] AS status FROM t)"""
QUERIES = {f.__name__: f for f in (forecast_outcomes, forecast_hours)}
SQL = {
    "forecast_outcomes": f"""WITH {_TRIED} SELECT CAST(model AS INTEGER) AS model, cell, status = 200 AS ok, CAST(attempts AS INTEGER) AS attempts, CASE status WHEN 200 THEN NULL WHEN 429 THEN 'HTTP 429 (minutely)' WHEN 404 THEN 'client_error (HTTP 404)' ELSE 'HTTP ' || status END AS reason,
        CASE WHEN status = 429 THEN 'minutely' END AS limited, CAST(CASE WHEN status = 200 THEN hours ELSE 0 END AS INTEGER) AS hours FROM o""",
    "forecast_hours": f"WITH {_TRIED} SELECT cell, hours, known, round(cloud, 6) AS cloud FROM o WHERE status = 200 AND model = 1",
}
