"""Planets by Kepler's laws: approximate elements and their change in a century, good to about 0.2 degrees from 1800 to 2050."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from nightloom.functions import sky
from nightloom.functions.geo import let

#: The published approximate elements (J2000 ecliptic) and their rates for a century: semi-major axis, eccentricity,
#: inclination, mean longitude, longitude of the perihelion, of the ascending node.
ELEMENTS = {
    "Mercury": ((0.38709927, 0.20563593, 7.00497902, 252.25032350, 77.45779628, 48.33076593), (0.00000037, 0.00001906, -0.00594749, 149472.67411175, 0.16047689, -0.12534081)),
    "Venus": ((0.72333566, 0.00677672, 3.39467605, 181.97909950, 131.60246718, 76.67984255), (0.00000390, -0.00004107, -0.00078890, 58517.81538729, 0.00268329, -0.27769418)),
    "Earth": ((1.00000261, 0.01671123, -0.00001531, 100.46457166, 102.93768193, 0.0), (0.00000562, -0.00004392, -0.01294668, 35999.37244981, 0.32327364, 0.0)),
    "Mars": ((1.52371034, 0.09339410, 1.84969142, -4.55343205, -23.94362959, 49.55953891), (0.00001847, 0.00007882, -0.00813131, 19140.30268499, 0.44441088, -0.29257343)),
    "Jupiter": ((5.20288700, 0.04838624, 1.30439695, 34.39644051, 14.72847983, 100.47390909), (-0.00011607, -0.00013253, -0.00183714, 3034.74612775, 0.21252668, 0.20469106)),
    "Saturn": ((9.53667594, 0.05386179, 2.48599187, 49.95424423, 92.59887831, 113.66242448), (-0.00125060, -0.00050991, 0.00193609, 1222.49362201, -0.41897216, -0.28867794)),
}
PLANETS = tuple(x for x in ELEMENTS if x != "Earth")
NAMES = ("a", "e", "i", "l", "peri", "node")
#: Newton steps on Kepler's equation; each doubles the digits. Degrees of a century that the equinox goes back.
STEPS, PRECESSION = 5, 1.39697


def listed(names: tuple[str, ...] = PLANETS) -> Column:
    """Array of struct(name, a, e ... node, and their rates d_a, d_e ... d_node)."""
    one = lambda n: F.struct(F.lit(n).alias("name"), *(F.lit(float(v)).alias(p + k) for p, values in zip(("", "d_"), ELEMENTS[n], strict=True) for k, v in zip(NAMES, values, strict=True)))
    return F.array(*map(one, names))


def eccentric(mean: Column, e: Column) -> Column:
    """The eccentric anomaly of a mean one, in radians: Newton's steps on Kepler's equation."""
    start = mean + e * F.sin(mean)
    return F.aggregate(F.sequence(F.lit(1), F.lit(STEPS)), start, lambda x, _: x - (x - e * F.sin(x) - mean) / (1 - e * F.cos(x)))


def heliocentric(centuries: Column, of: Column) -> Column:
    """struct(x, y, z) in the J2000 ecliptic, in astronomical units, of an element of ``listed``."""
    now = F.struct(*((of[k] + of[f"d_{k}"] * centuries).alias(k) for k in NAMES))

    def on_orbit(q: Column) -> Column:
        mean = F.radians(F.pmod(q["l"] - q["peri"] + 180.0, F.lit(360.0)) - 180.0)
        return let(eccentric(mean, q["e"]), lambda ecc: let(F.struct((q["a"] * (F.cos(ecc) - q["e"])).alias("u"), (q["a"] * F.sqrt(1 - q["e"] * q["e"]) * F.sin(ecc)).alias("v")), lambda p: turned(q, p["u"], p["v"])))

    def turned(q: Column, u: Column, v: Column) -> Column:
        w, n, i = q["peri"] - q["node"], q["node"], q["i"]
        x = (sky.cos(w) * sky.cos(n) - sky.sin(w) * sky.sin(n) * sky.cos(i)) * u + (-sky.sin(w) * sky.cos(n) - sky.cos(w) * sky.sin(n) * sky.cos(i)) * v
        y = (sky.cos(w) * sky.sin(n) + sky.sin(w) * sky.cos(n) * sky.cos(i)) * u + (-sky.sin(w) * sky.sin(n) + sky.cos(w) * sky.cos(n) * sky.cos(i)) * v
        return F.struct(x.alias("x"), y.alias("y"), (sky.sin(w) * sky.sin(i) * u + sky.cos(w) * sky.sin(i) * v).alias("z"))

    return let(now, on_orbit)


def ecliptic(d: Column, of: Column) -> Column:
    """struct(lon, lat, distance): a planet seen from the Earth, in degrees of the ecliptic of the date; light's time is left out."""
    t = d / 36525.0
    both = F.struct(heliocentric(t, of).alias("p"), heliocentric(t, F.get(listed(("Earth",)), 0)).alias("q"))

    def seen(b: Column) -> Column:
        return let(F.struct(*((b["p"][k] - b["q"][k]).alias(k) for k in "xyz")), lambda g: F.struct(
            sky.turn(F.degrees(F.atan2(g["y"], g["x"])) + PRECESSION * t).alias("lon"), F.degrees(F.atan2(g["z"], F.sqrt(g["x"] * g["x"] + g["y"] * g["y"]))).alias("lat"), F.sqrt(g["x"] * g["x"] + g["y"] * g["y"] + g["z"] * g["z"]).alias("distance")))

    return let(both, seen)


def horizontal(d: Column, lat: Column, lon: Column, of: Column) -> Column:
    """struct(alt, az) of a planet at a place."""
    return seen_from(d, lat, lon, ecliptic(d, of))


def seen_from(d: Column, lat: Column, lon: Column, ecliptic: Column) -> Column:
    """struct(alt, az), at a place, of what stands at ``ecliptic`` (lon, lat)."""

    def over(e: Column) -> Column:
        ra, dec = sky.equatorial(e["lon"], e["lat"])

        def at(q: Column) -> Column:
            alt, az = sky.horizontal(d, lat, lon, q["ra"], q["dec"])
            return F.struct(alt.alias("alt"), az.alias("az"))

        return let(F.struct(ra.alias("ra"), dec.alias("dec")), at)

    return let(ecliptic, over)
