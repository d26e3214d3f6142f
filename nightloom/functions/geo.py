"""Geographic scalar functions on columns."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EARTH_M, EARTH_KM = 6_371_000.0, 6371.0088
#: Fixed values of the reference ellipsoid.
MAJOR, FLATTENING = 6_378_137.0, 1 / 298.257223563


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column, radius: float = EARTH_M) -> Column:
    """Great-circle distance in the unit of ``radius``."""
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * radius * F.asin(F.sqrt(F.least(a, F.lit(1.0))))


def grid_index(x: Column, step: float) -> Column:
    """Number of the nearest grid line; halves go to the even one."""
    return F.rint(x / step).cast("long")


def grid_cell(x: Column, step: float) -> Column:
    return F.round(F.rint(x / step) * step, 6)


def tile_fraction(lat: Column, lon: Column, zoom: int) -> tuple[Column, Column]:
    """Fractional tile coordinates of the web's map projection."""
    n = 1 << zoom
    phi = F.radians(lat)
    return (lon + 180.0) / 360.0 * n, (1.0 - F.log(F.tan(phi) + 1 / F.cos(phi)) / math.pi) / 2.0 * n


def tile_pixel(lat: Column, lon: Column, zoom: int, size: int = 256) -> list[Column]:
    """xtile, ytile, px, py of a point; pixels never go beyond the tile."""
    x, y = tile_fraction(lat, lon, zoom)
    pixel = lambda v: F.least(F.floor((v - F.floor(v)) * size), F.lit(size - 1)).cast("long")
    return [F.floor(x).cast("long").alias("xtile"), F.floor(y).cast("long").alias("ytile"), pixel(x).alias("px"), pixel(y).alias("py")]


def equidistant(lat: Column, lon: Column, lat0: float, lon0: float, radius: float = EARTH_KM) -> tuple[Column, Column]:
    """Azimuthal equidistant projection about a centre: x to the east, y to the north."""
    p, p0, d = F.radians(lat), math.radians(lat0), F.radians(lon - lon0)
    c = F.acos(F.least(F.lit(1.0), F.greatest(F.lit(-1.0), math.sin(p0) * F.sin(p) + math.cos(p0) * F.cos(p) * F.cos(d))))
    k = F.when(c < 1e-12, 1.0).otherwise(c / F.sin(c)) * radius
    return k * F.cos(p) * F.sin(d), k * (math.cos(p0) * F.sin(p) - math.sin(p0) * F.cos(p) * F.cos(d))


def from_equidistant(x: Column, y: Column, lat0: float, lon0: float, radius: float = EARTH_KM) -> tuple[Column, Column]:
    """Latitude and longitude of projected coordinates."""
    rho, p0 = F.sqrt(x * x + y * y), math.radians(lat0)
    c = rho / radius
    ratio = F.when(rho < 1e-12, 0.0).otherwise(y / rho)
    lat = F.degrees(F.asin(F.cos(c) * math.sin(p0) + ratio * F.sin(c) * math.cos(p0)))
    return lat, lon0 + F.degrees(F.atan2(x * F.sin(c), rho * math.cos(p0) * F.cos(c) - y * math.sin(p0) * F.sin(c)))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(x)`` with ``value`` named once: a lambda's parameter keeps an expression from being written out where it is used."""
    return F.get(F.transform(F.array(value), body), 0)


def rounded(x: Column, places: int) -> Column:
    """``x`` at so many decimals as SQL rounds a double: scaled first, halves of the scaled value away from zero. (Spark rounds the
    shortest decimal that stands for the value, so 16.4896875 would be 16.489688, not 16.489687.)"""
    return F.round(x * 10.0**places) / 10.0**places


def direct(lat: Column, lon: Column, bearing: Column, distance: Column, rounds: int = 6) -> Column:
    """struct(lat, lon) of the end point on the ellipsoid by Vincenty's direct formula; each of the ``rounds`` of its iteration
    gains several digits."""
    minor = MAJOR * (1 - FLATTENING)

    def with_start(p: Column) -> Column:
        sin_a = F.cos(p["u1"]) * F.sin(p["a1"])
        u2 = (1 - sin_a * sin_a) * (MAJOR**2 - minor**2) / minor**2
        a = 1 + u2 / 16384 * (4096 + u2 * (-768 + u2 * (320 - 175 * u2)))
        b = u2 / 1024 * (256 + u2 * (-128 + u2 * (74 - 47 * u2)))
        return let(F.struct(p["u1"].alias("u1"), p["a1"].alias("a1"), F.atan2(F.tan(p["u1"]), F.cos(p["a1"])).alias("s1"), sin_a.alias("sin_a"), (distance / (minor * a)).alias("s0"), b.alias("b")), with_line)

    def with_line(q: Column) -> Column:
        def step(s: Column, _: Column) -> Column:
            def longer(m: Column) -> Column:
                inner = F.cos(s) * (-1 + 2 * m * m) - q["b"] / 6 * m * (-3 + 4 * F.sin(s) * F.sin(s)) * (-3 + 4 * m * m)
                return q["s0"] + q["b"] * F.sin(s) * (m + q["b"] / 4 * inner)

            return let(F.cos(2 * q["s1"] + s), longer)

        return let(F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), q["s0"], step), lambda s: end(q, s))

    def end(q: Column, s: Column) -> Column:
        u1, a1, sin_a = q["u1"], q["a1"], q["sin_a"]
        x = F.sin(u1) * F.sin(s) - F.cos(u1) * F.cos(s) * F.cos(a1)
        lat2 = F.atan2(F.sin(u1) * F.cos(s) + F.cos(u1) * F.sin(s) * F.cos(a1), (1 - FLATTENING) * F.sqrt(sin_a * sin_a + x * x))
        turn = F.atan2(F.sin(s) * F.sin(a1), F.cos(u1) * F.cos(s) - F.sin(u1) * F.sin(s) * F.cos(a1))
        cos2_a, m = 1 - sin_a * sin_a, F.cos(2 * q["s1"] + s)
        c = FLATTENING / 16 * cos2_a * (4 + FLATTENING * (4 - 3 * cos2_a))
        turn = turn - (1 - c) * FLATTENING * sin_a * (s + c * F.sin(s) * (m + c * F.cos(s) * (-1 + 2 * m * m)))
        return F.struct(F.degrees(lat2).alias("lat"), (lon + F.degrees(turn)).alias("lon"))

    return let(F.struct(F.atan((1 - FLATTENING) * F.tan(F.radians(lat))).alias("u1"), F.radians(bearing).alias("a1")), with_start)


def end_points(df: DataFrame, lat: Column, lon: Column, bearing: Column, distance: Column, rounds: int = 6) -> DataFrame:
    """``df`` with lat2 and lon2, the end points that ``direct`` gives, for very many rows: each step is a column of its own, which
    Spark compiles, where the lambdas of ``direct`` are walked for each row."""
    minor, kept = MAJOR * (1 - FLATTENING), df.columns
    q = lambda n: F.col(f"__{n}")
    df = df.withColumns({"__u1": F.atan((1 - FLATTENING) * F.tan(F.radians(lat))), "__a1": F.radians(bearing)})
    df = df.withColumn("__sin_a", F.cos(q("u1")) * F.sin(q("a1")))
    df = df.withColumn("__u2", (1 - q("sin_a") * q("sin_a")) * (MAJOR**2 - minor**2) / minor**2)
    df = df.withColumns({"__a": 1 + q("u2") / 16384 * (4096 + q("u2") * (-768 + q("u2") * (320 - 175 * q("u2")))), "__b": q("u2") / 1024 * (256 + q("u2") * (-128 + q("u2") * (74 - 47 * q("u2"))))})
    df = df.withColumns({"__s1": F.atan2(F.tan(q("u1")), F.cos(q("a1"))), "__s0": distance / (minor * q("a"))}).withColumn("__s", q("s0"))
    for _ in range(rounds):
        df = df.withColumn("__m", F.cos(2 * q("s1") + q("s")))
        inner = F.cos(q("s")) * (-1 + 2 * q("m") * q("m")) - q("b") / 6 * q("m") * (-3 + 4 * F.sin(q("s")) * F.sin(q("s"))) * (-3 + 4 * q("m") * q("m"))
        df = df.withColumn("__s", q("s0") + q("b") * F.sin(q("s")) * (q("m") + q("b") / 4 * inner))
    u1, a1, sin_a, s = q("u1"), q("a1"), q("sin_a"), q("s")
    df = df.withColumns({"__x": F.sin(u1) * F.sin(s) - F.cos(u1) * F.cos(s) * F.cos(a1), "__cos2": 1 - sin_a * sin_a, "__m": F.cos(2 * q("s1") + s)})
    df = df.withColumn("__c", FLATTENING / 16 * q("cos2") * (4 + FLATTENING * (4 - 3 * q("cos2"))))
    c, m = q("c"), q("m")
    turn = F.atan2(F.sin(s) * F.sin(a1), F.cos(u1) * F.cos(s) - F.sin(u1) * F.sin(s) * F.cos(a1))
    turn = turn - (1 - c) * FLATTENING * sin_a * (s + c * F.sin(s) * (m + c * F.cos(s) * (-1 + 2 * m * m)))
    lat2 = F.atan2(F.sin(u1) * F.cos(s) + F.cos(u1) * F.sin(s) * F.cos(a1), (1 - FLATTENING) * F.sqrt(sin_a * sin_a + q("x") * q("x")))
    return df.withColumns({"lat2": F.degrees(lat2), "lon2": lon + F.degrees(turn)}).select(*kept, "lat2", "lon2")


def apparent_angle(rise: Column, distance: Column, k: float = 0.13, radius: float = EARTH_M) -> Column:
    """Elevation angle in degrees of something ``rise`` metres higher, with the earth's curvature and refraction."""
    return F.degrees(F.atan2(rise - (1 - k) * distance * distance / (2 * radius), distance))


#: The names of sixteen points of the compass.
COMPASS = "N NNE NE ENE E ESE SE SSE S SSW SW WSW W WNW NW NNW".split()


def compass_even(azimuth: Column) -> Column:
    """The nearest of sixteen points; azimuths halfway go to the even one."""
    return F.get(F.array(*map(F.lit, COMPASS)), F.pmod(F.rint(azimuth / 22.5), F.lit(16.0)).cast("int"))


def compass_up(azimuth: Column) -> Column:
    """The nearest of sixteen points; azimuths halfway go clockwise."""
    return F.get(F.array(*map(F.lit, COMPASS)), F.floor(F.pmod(azimuth + 11.25, F.lit(360.0)) / 22.5).cast("int"))


def circular_difference(a: Column, b: Column, turn: float = 360.0) -> Column:
    return F.abs(F.pmod(a - b + 1.5 * turn, F.lit(turn)) - turn / 2)


def horizon_at(profile: Column, azimuth: Column) -> Column:
    """A 360-element profile at the nearest whole degree."""
    return F.get(profile, F.pmod(F.rint(azimuth), F.lit(360.0)).cast("int"))


def light_weight(km: Column, coefficient: float = 2.3, reference: float = 350.0, exponent: float = 0.28, least: float = 0.4) -> Column:
    """Weight of a light source at a distance: a power that itself grows with the distance."""
    d = F.greatest(km, F.lit(least))
    return F.pow(d, -coefficient * F.pow(d / reference, F.lit(exponent)))


def tiles_of(south: Column, north: Column, west: Column, east: Column) -> Column:
    """Names of the 10-degree tiles that a box touches, hNNvNN."""
    at = lambda a, b: F.sequence(F.floor(a / 10).cast("int"), F.floor(b / 10).cast("int"))
    rows = F.transform(at(90 - north, 90 - south), lambda v: F.transform(at(west + 180, east + 180), lambda h: F.format_string("h%02dv%02d", h, v)))
    return F.flatten(rows)
