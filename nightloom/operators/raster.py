"""Rasters as long tables (iy, ix, value): lookups, binning, neighbourhood sums, connected areas."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nightloom.operators.graph import components


def bilinear(points: DataFrame, raster: DataFrame, lat_top: float, lon_left: float, step: float, out: str = "value") -> DataFrame:
    """The points (id, lat, lon, ...) with the weighted mean of their four cells; null where one is missing or null.

    Each point becomes four rows that are joined by cell, so neither side is gathered anywhere.
    """
    y, x = (lat_top - F.col("lat")) / step, (F.col("lon") - lon_left) / step
    at = points.withColumn("y0", F.floor(y)).withColumn("x0", F.floor(x)).withColumn("fy", y - F.floor(y)).withColumn("fx", x - F.floor(x))
    corners = F.array(*(F.struct((F.col("y0") + j).cast("long").alias("iy"), (F.col("x0") + i).cast("long").alias("ix"), ((F.col("fy") if j else 1 - F.col("fy")) * (F.col("fx") if i else 1 - F.col("fx"))).alias("w")) for j in (0, 1) for i in (0, 1)))
    rows = at.select("id", F.explode(corners).alias("c")).select("id", "c.*")
    found = rows.join(raster.filter(F.col("value").isNotNull()), ["iy", "ix"], "left").groupBy("id").agg(F.when(F.count("value") == 4, F.sum(F.col("value") * F.col("w"))).alias(out))
    return points.join(found, "id", "left")


def nearest_pixel(points: DataFrame, tiles: DataFrame, keys: list[str], out: str = "elev") -> DataFrame:
    """The points with their pixel's value: 0 where the tile exists without that pixel (sea), null where the tile is missing."""
    known = tiles.select("xtile", "ytile").distinct().withColumn("known", F.lit(True))
    found = points.join(tiles, keys, "left").join(known, ["xtile", "ytile"], "left")
    return found.withColumn(out, F.when(F.col("known"), F.coalesce(out, F.lit(0.0)))).drop("known")


def binned(points: DataFrame, x_min: float, y_min: float, pixel: float, weight: str, least: float = 0.5) -> DataFrame:
    """Sums of weights by pixel, pixels centred on their coordinates; weights that are null, NaN or under ``least`` count 0."""
    w = F.when(F.isnan(weight) | (F.col(weight) < least), 0.0).otherwise(F.coalesce(weight, F.lit(0.0)))
    at = lambda c, lo: F.floor((F.col(c) - lo) / pixel + 0.5).cast("long")
    return points.groupBy(at("y", y_min).alias("iy"), at("x", x_min).alias("ix")).agg(F.sum(w).alias("value"))


def neighbourhood_sum(raster: DataFrame, radius: int, weight) -> DataFrame:
    """Each cell's sum over the cells within ``radius`` (in cells), weighted by ``weight(distance)``; for kernels of some
    thousand cells. Every non-zero cell sends its share to the cells around it, which are summed up map-side first."""
    kernel = [(j, i, float(weight(math.hypot(j, i)))) for j in range(-radius, radius + 1) for i in range(-radius, radius + 1) if math.hypot(j, i) <= radius]
    offsets = raster.sparkSession.createDataFrame(kernel, "dy int, dx int, w double")
    spread = raster.filter("value != 0").crossJoin(F.broadcast(offsets))  # the kernel's size is the parameter's
    sums = spread.groupBy((F.col("iy") + F.col("dy")).alias("iy"), (F.col("ix") + F.col("dx")).alias("ix")).agg(F.sum(F.col("value") * F.col("w")).alias("sum"))
    return raster.select("iy", "ix").join(sums, ["iy", "ix"], "left").withColumn("sum", F.coalesce("sum", F.lit(0.0)))


def convolved(raster: DataFrame, block: int, radius: int, weight) -> DataFrame:
    """``neighbourhood_sum`` for large kernels: blocks with a margin of ``radius``, each by one FFT in a task of its own.

    A block's memory is (block + 2 radius) squared, whatever the raster's size.
    """
    import numpy as np
    import pandas as pd

    n = 1 << math.ceil(math.log2(block + 4 * radius + 1))
    # the kernel is worked out once, here; its transform once in each worker
    d = np.hypot(*np.meshgrid(np.arange(-radius, radius + 1), np.arange(-radius, radius + 1), indexing="ij"))
    kernel = np.where(d <= radius, np.vectorize(weight, otypes=[float])(d), 0.0)
    held: dict[str, np.ndarray] = {}

    def transform() -> np.ndarray:
        if "kernel" not in held:
            held["kernel"] = np.fft.rfft2(kernel, (n, n))
        return held["kernel"]

    def one(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        by, bx = key
        grid = np.zeros((n, n))
        y, x = (pdf["iy"] - by * block + radius).to_numpy(), (pdf["ix"] - bx * block + radius).to_numpy()
        grid[y, x] = pdf["value"]
        full = np.fft.irfft2(np.fft.rfft2(grid) * transform(), (n, n))[2 * radius : 2 * radius + block, 2 * radius : 2 * radius + block]
        own = pdf[pdf["own"]]
        return pd.DataFrame({"iy": own["iy"], "ix": own["ix"], "sum": np.maximum(full[own["iy"] - by * block, own["ix"] - bx * block], 0.0)})

    reach = math.ceil(radius / block)
    moves = F.array(*(F.struct(F.lit(j).alias("j"), F.lit(i).alias("i")) for j in range(-reach, reach + 1) for i in range(-reach, reach + 1)))
    home = raster.withColumn("hy", F.floor(F.col("iy") / block).cast("long")).withColumn("hx", F.floor(F.col("ix") / block).cast("long"))
    rows = home.withColumn("m", F.explode(moves)).withColumn("by", F.col("hy") + F.col("m.j")).withColumn("bx", F.col("hx") + F.col("m.i"))
    close = lambda i, b: (F.col(i) >= F.col(b) * block - radius) & (F.col(i) < (F.col(b) + 1) * block + radius)
    rows = rows.filter(close("iy", "by") & close("ix", "bx")).withColumn("own", (F.col("hy") == F.col("by")) & (F.col("hx") == F.col("bx")))
    return rows.select("by", "bx", "iy", "ix", "value", "own").groupBy("by", "bx").applyInPandas(one, "iy long, ix long, sum double")


def areas(pixels: DataFrame, width: int) -> DataFrame:
    """Connected areas (by edges) of pixels (y, x): each pixel with its area's smallest pixel number, y * width + x."""
    n = F.col("y") * width + F.col("x")
    nodes = pixels.select(n.cast("long").alias("a"), "x")
    right = nodes.filter(F.col("x") < width - 1).select("a", (F.col("a") + 1).alias("b"))
    links = right.union(nodes.select("a", (F.col("a") + width).alias("b"))).join(nodes.select(F.col("a").alias("b")), "b")
    comps = components(links.select("a", "b"))
    own = pixels.withColumn("node", n.cast("long")).join(comps, "node", "left")
    return own.withColumn("area", F.coalesce("comp", "node")).drop("node", "comp")


def fill_mask(pixels: DataFrame, width: int, least_area: int = 2000, least_fill: float = 0.95) -> DataFrame:
    """Pixels of solid rectangles: connected areas that are large and fill their box."""
    own = areas(pixels, width)
    box = (F.max("y") - F.min("y") + 1) * (F.max("x") - F.min("x") + 1)
    solid = own.groupBy("area").agg(F.count(F.lit(1)).alias("n"), box.alias("box")).filter((F.col("n") >= least_area) & (F.col("n") >= least_fill * F.col("box"))).select("area")
    return own.join(solid, "area", "left_semi").select("y", "x")


def bright_share(image: DataFrame, bounds: tuple[int, int, int, int], mask: DataFrame | None = None, threshold: int = 80) -> DataFrame:
    """Share of pixels of at least ``threshold`` within bounds (y0, y1, x0, x1; ends excluded), without those of ``mask``."""
    y0, y1, x0, x1 = bounds
    own = image.filter(F.col("y").between(y0, y1 - 1) & F.col("x").between(x0, x1 - 1))
    own = own if mask is None else own.join(mask, ["y", "x"], "left_anti")
    return own.agg(F.avg(F.when(F.col("brightness") >= threshold, 1.0).otherwise(0.0)).alias("share"), F.count(F.lit(1)).alias("n"))
