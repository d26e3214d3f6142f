"""Horizons: profiles from rays, peaks and ranges over the circle of azimuths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from nightloom.functions.geo import apparent_angle, end_points
from nightloom.operators.graph import dealt


def ray_points(sites: DataFrame, reach: int = 50_000, step: int = 100, azimuths: int = 360) -> DataFrame:
    """A point every ``step`` metres of each azimuth's ray: site columns, az, d, lat2, lon2. All rows are made where the ray
    is, and nothing of them is kept: what follows is a join with the elevation table and an aggregation."""
    rays = sites.withColumn("az", F.explode(F.sequence(F.lit(0), F.lit(azimuths - 1))))
    rays = dealt(rays, 500).withColumn("d", F.explode(F.sequence(F.lit(step), F.lit(reach), F.lit(step))))  # a small table may be one partition
    return end_points(rays, F.col("lat"), F.col("lon"), F.col("az").cast("double") * (360.0 / azimuths), F.col("d").cast("double"))


def horizon(points: DataFrame, keys: list[str], elevation: str, own: str) -> DataFrame:
    """Of each azimuth the greatest angle and its distance, the nearest on ties; -90 and null where no elevation is known."""
    angle = F.coalesce(apparent_angle(F.col(elevation) - F.col(own), F.col("d").cast("double")), F.lit(-90.0))
    best = points.groupBy(*keys, "az").agg(F.max(F.struct(angle.alias("angle"), (-F.col("d")).alias("near"))).alias("x"))  # points are reduced where they are made
    best = best.select(*keys, "az", "x.angle", (-F.col("x.near")).alias("d"))
    return best.select(*keys, "az", "angle", F.when(F.col("angle") > -90, F.col("d")).alias("distance"))


def padded_circle(profile: DataFrame, keys: list[str], pad: int) -> DataFrame:
    """Rows (az, alt) with the ends of the circle repeated on the other side; ``own`` marks the original ones."""
    turns = F.array(F.lit(-360), F.lit(0), F.lit(360))
    rows = profile.withColumn("t", F.explode(turns)).withColumn("a", F.col("az") + F.col("t")).filter(F.col("a").between(-pad, 359 + pad))
    return rows.withColumn("own", F.col("t") == 0).drop("t")


def ridge_peaks(profile: DataFrame, keys: list[str], least: float = 3.0, prominence: float = 1.5, near: int = 15, valley: int = 30) -> DataFrame:
    """Peaks of a horizon: at least ``least`` high, greatest within ``near`` degrees with no equal one before, and standing out
    by ``prominence`` over the higher of the lowest points on its two sides."""
    w = Window.partitionBy(*keys).orderBy("a")
    rows = padded_circle(profile, keys, valley)
    rows = rows.withColumn("top", F.max("alt").over(w.rowsBetween(-near, near))).withColumn("ahead", F.max("alt").over(w.rowsBetween(-near, -1)))
    rows = rows.withColumn("left", F.min("alt").over(w.rowsBetween(-valley, -1))).withColumn("right", F.min("alt").over(w.rowsBetween(1, valley)))
    peak = F.col("own") & (F.col("alt") >= least) & (F.col("alt") == F.col("top")) & (F.col("ahead") < F.col("alt")) & (F.col("alt") - F.greatest("left", "right") >= prominence)
    return rows.filter(peak).select(*keys, "az", "alt")


def ridge_range(profile: DataFrame, keys: list[str], lo: Column, hi: Column) -> DataFrame:
    """Least and greatest altitude between two azimuths, going clockwise, over north where needed."""
    inside = F.pmod(F.col("az") - lo, F.lit(360)) <= F.pmod(hi - lo, F.lit(360))
    return profile.filter(inside).groupBy(*keys).agg(F.min("alt").alias("lowest"), F.max("alt").alias("highest"))


def interpolated_range(frames: DataFrame, windows: DataFrame, keys: list[str]) -> DataFrame:
    """Least and greatest altitude within windows (lo, hi: minutes) of frames (m, alt), the ends interpolated, clamped at 0.

    Rounded half up. Null where a window starts after the last frame or ends beyond it. Minutes go over midnight (+1440).
    """
    w = Window.partitionBy(*keys).orderBy("m")
    seg = frames.withColumn("m2", F.lead("m").over(w)).withColumn("alt2", F.lead("alt").over(w)).withColumn("last", F.max("m").over(Window.partitionBy(*keys)))
    j = windows.join(seg, keys, "left").filter(F.col("hi") <= F.col("last"))
    at = lambda t: F.col("alt") + (F.col("alt2") - F.col("alt")) * (t - F.col("m")) / (F.col("m2") - F.col("m"))
    ends = [F.when(F.col(c).between(F.col("m"), F.col("m2")), at(F.col(c))) for c in ("lo", "hi")]
    inner = F.when(F.col("m").between(F.col("lo"), F.col("hi")), F.col("alt"))
    values = j.select(*keys, "lo", "hi", F.explode(F.array_compact(F.array(*ends, inner))).alias("v"))
    found = values.groupBy(*keys, "lo", "hi").agg(F.min("v").alias("a"), F.max("v").alias("b"))
    out = windows.join(found, [*keys, "lo", "hi"], "left")
    up = lambda c: F.floor(F.greatest(F.col(c), F.lit(0.0)) + 0.5).cast("long")
    return out.select(*keys, "lo", "hi", F.when(F.col("a").isNotNull(), up("a")).alias("lowest"), F.when(F.col("b").isNotNull(), up("b")).alias("highest"))
