"""Catalogues of sites, objects and targets, and what reports say of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from nightloom.functions import sky

#: The schema a commentary must have, its greatest age in hours and its number of images.
COMMENTARY, MOST_HOURS, IMAGES = "nightloom-commentary/2", 12, 3
#: Light ratio at the limit of dark sites and its index.
LIMIT_RATIO, LIMIT_INDEX = 10.66, 5.0


def spots_for(asked: DataFrame, sites: DataFrame) -> DataFrame:
    """For each ``key`` the site (id, name, ...) whose id or name it is; an error where none or several are.

    A site is found once by its id and once by its name, so keys are joined by equality.
    """
    by = sites.withColumn("key", F.explode(F.array_distinct(F.array(F.col("id").cast("string"), F.col("name")))))
    found = asked.select("key").distinct().join(by, "key", "left").groupBy("key").agg(F.count("id").alias("n"), F.first(F.struct(*sites.columns)).alias("site"))
    bad = F.raise_error(F.concat(F.lit("not one site: "), F.col("key")))
    return found.select("key", F.when(F.col("n") == 1, F.col("site")).otherwise(bad).alias("site")).select("key", "site.*")


def read_external(spark: SparkSession, path: str) -> DataFrame:
    """name, lat, lon of CSV files with both coordinates in one quoted field."""
    rows = spark.read.schema("name string, coordinates string").option("header", True).csv(path)
    part = F.split("coordinates", r"\s*,\s*")
    return rows.select("name", part[0].try_cast("double").alias("lat"), part[1].try_cast("double").alias("lon"))


def read_objects(spark: SparkSession, path: str) -> DataFrame:
    """id, ra and dec in degrees of JSON lines with hours, minutes and seconds, and degrees, minutes and seconds."""
    rows = spark.read.schema("id long, ra_hms array<double>, dec_dms array<double>").json(path)
    parts = lambda c: [F.get(c, i) for i in range(3)]
    return rows.select("id", (sky.sexagesimal(*parts("ra_hms")) * 15).alias("ra"), sky.sexagesimal(*parts("dec_dms")).alias("dec"))


def read_targets(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("id long, best_months array<int>").json(path)


def fingerprint(conditions: dict[str, Column]) -> Column:
    """The first 16 digits of the SHA-1 of the conditions as JSON, keys sorted."""
    return F.substring(F.sha1(F.to_json(F.struct(*(conditions[k].alias(k) for k in sorted(conditions))))), 1, 16)


def light_index(ratio: Column) -> Column:
    """Linear in the ratio; without one, infinite, so that no limit passes it."""
    return F.coalesce(ratio * LIMIT_INDEX / LIMIT_RATIO, F.lit(float("inf")))


def light_text(ratio: Column) -> Column:
    return F.when(ratio.isNull(), "no data").otherwise(F.format_string("ALR %.2f", ratio))


def tags(rules: dict[str, Column]) -> Column:
    """The names of the rules that hold, in their order."""
    return F.array_compact(F.array(*(F.when(ok, F.lit(name)) for name, ok in rules.items())))


def commentary_state(schema: Column, made: Column, images: Column, now: Column) -> Column:
    """valid, or the first thing that is wrong: schema, stale (of the future or too old), images."""
    age = (F.unix_micros(now) - F.unix_micros(made)) / 3.6e9
    return F.when(~schema.eqNullSafe(F.lit(COMMENTARY)), "schema").when(~F.coalesce(age.between(0, MOST_HOURS), F.lit(False)), "stale").when(F.coalesce(F.size(images), F.lit(0)) != IMAGES, "images").otherwise("valid")


def mosaic(cells: DataFrame, height: int, width: int, fill: float) -> DataFrame:
    """row, col, value of cells (ty, tx, iy, ix, value) of tiles side by side; the fill value is null."""
    return cells.select((F.col("ty") * height + F.col("iy")).alias("row"), (F.col("tx") * width + F.col("ix")).alias("col"), F.nullif("value", F.lit(fill)).alias("value"))
