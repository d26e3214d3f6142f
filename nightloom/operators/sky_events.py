"""What happens over a site's ridge in a night: objects that come over it and go behind it, the moon, the pole star.

A night's samples are an array in its row, and runs are found in that array, so events cost no shuffle; a row has as many
samples as its night has minutes.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nightloom.functions import planets, sky
from nightloom.functions.geo import let
from nightloom.operators import astro

#: Minutes between samples of objects and of the moon; samples that a run may miss; magnitude up to which stars are followed.
STEP, MOON_STEP, GAP, BRIGHT = 1, 5, 10, 2.0
#: Bright stars with their right ascension, declination and magnitude, and two clusters.
STARS = (
    ("Sirius", 101.287, -16.716, -1.46), ("Canopus", 95.988, -52.696, -0.74), ("Arcturus", 213.915, 19.182, -0.05), ("Vega", 279.235, 38.784, 0.03), ("Capella", 79.172, 45.998, 0.08), ("Rigel", 78.634, -8.202, 0.13),
    ("Procyon", 114.825, 5.225, 0.34), ("Betelgeuse", 88.793, 7.407, 0.50), ("Aldebaran", 68.980, 16.509, 0.86), ("Spica", 201.298, -11.161, 0.97), ("Antares", 247.352, -26.432, 1.06), ("Regulus", 152.093, 11.967, 1.35),
    ("Hyades", 66.75, 15.87, 0.5), ("Alcor", 201.306, 54.988, 4.0),
)
POLE_STAR = ("Polaris", 37.955, 89.264, 1.98)


def sampled(start: Column, end: Column, position: Callable[[Column], Column], offset: float, step: int = STEP) -> Column:
    """Array of (t, alt, az) from ``start`` up to ``end``; ``position(d)``: struct(alt, az) at a day number."""
    at = lambda t: let(position(astro.utc_days(t, offset)), lambda p: F.struct(t.alias("t"), p["alt"].alias("alt"), p["az"].alias("az")))
    return F.transform(F.sequence(start, end, F.expr(f"interval {step} minutes")), at)


def fixed(lat: Column, lon: Column, ra: Column, dec: Column) -> Callable[[Column], Column]:
    def position(d: Column) -> Column:
        alt, az = sky.horizontal(d, lat, lon, ra, dec)
        return F.struct(alt.alias("alt"), az.alias("az"))

    return position


def true_runs(places: Column, gap: int = 0) -> Column:
    """Array of (a, b), the first and last of each run of ascending numbers; up to ``gap`` missing ones don't end a run."""

    def ends(p: Column) -> Column:
        first = F.filter(p, lambda x, j: (j == 0) | (x - F.get(p, j - 1) - 1 > gap))
        last = F.filter(p, lambda x, j: (j == F.size(p) - 1) | (F.get(p, j + 1) - x - 1 > gap))
        return F.zip_with(first, last, lambda a, b: F.struct(a.alias("a"), b.alias("b")))

    return let(places, ends)


def flagged(samples: Column, over: Callable[[Column], Column]) -> Column:
    """The numbers, from 0, of the samples for which ``over`` holds."""
    numbers = F.transform(samples, lambda s, i: F.when(over(s), i))
    return F.filter(numbers, lambda i: i.isNotNull())


def ridge_runs(samples: Column, profile: Column, gap: int = GAP) -> Column:
    """Array of events: start, end, rises, sets, max_alt, max_alt_time, max_alt_az, rise_az (null unless it rises), set_az.

    A sample is up if its altitude is greater than the profile's at its azimuth (0 without a profile); runs that at most
    ``gap`` samples part are one; the highest sample is the first of a merged run, also one that isn't up.
    """

    def events(s: Column) -> Column:
        up = flagged(s, lambda x: x["alt"] > F.coalesce(astro.horizon_at(profile, x["az"]), F.lit(0.0)))

        def event(r: Column) -> Column:
            top = astro.best_sample(F.slice(s, r["a"] + 1, r["b"] - r["a"] + 1))
            rises, sets = r["a"] > 0, r["b"] < F.size(s) - 1
            one = lambda b: F.struct(
                F.get(s, r["a"])["t"].alias("start"), F.get(s, r["b"])["t"].alias("end"), rises.alias("rises"), sets.alias("sets"), b["alt"].alias("max_alt"), b["t"].alias("max_alt_time"), b["az"].alias("max_alt_az"),
                F.when(rises, F.get(s, r["a"])["az"]).alias("rise_az"), F.when(sets, F.get(s, r["b"])["az"]).alias("set_az"),
            )
            return let(top, one)

        return F.transform(true_runs(up, gap), event)

    return let(samples, events)


FIELDS = ("start", "end", "rises", "sets", "max_alt", "max_alt_time", "max_alt_az", "rise_az", "set_az")


def object_events(nights: DataFrame, keys: list[str], offset: float, stars: tuple = STARS, brightest: float = BRIGHT) -> DataFrame:
    """keys, kind, name and FIELDS for every stay of a bright star over the ridge; ``nights`` have dark_start, dark_end, lat, lon,
    profile."""
    listed = F.array(*(F.struct(F.lit(n).alias("name"), F.lit(float(ra)).alias("ra"), F.lit(float(dec)).alias("dec")) for n, ra, dec, mag in stars if mag <= brightest))
    rows = nights.withColumn("o", F.explode(listed))
    position = fixed(F.col("lat"), F.col("lon"), F.col("o.ra"), F.col("o.dec"))
    return _exploded(rows, keys, "star_above_ridge", position, offset)


def planet_events(nights: DataFrame, keys: list[str], offset: float, names: tuple[str, ...] = planets.PLANETS) -> DataFrame:
    rows = nights.withColumn("o", F.explode(planets.listed(names)))
    return _exploded(rows, keys, "planet_above_ridge", lambda d: planets.horizontal(d, F.col("lat"), F.col("lon"), F.col("o")), offset)


def _exploded(rows: DataFrame, keys: list[str], kind: str, position: Callable[[Column], Column], offset: float) -> DataFrame:
    found = ridge_runs(sampled(F.col("dark_start"), F.col("dark_end"), position, offset), F.col("profile"))
    out = rows.select(*keys, F.lit(kind).alias("kind"), F.col("o.name").alias("name"), F.explode_outer(found).alias("e")).filter("e is not null")  # explode works the runs out once more, to filter by their number
    return out.select(*keys, "kind", "name", *(F.col(f"e.{c}").alias(c) for c in FIELDS))


def moon_events(nights: DataFrame, keys: list[str], offset: float) -> DataFrame:
    """keys, kind (moon_up, or moon_below_horizon_all_night in one row), start, end, max_alt: samples every five minutes and the last
    minute of the night; a stay is a run of samples over 0 degrees."""
    minutes = F.sequence("dark_start", "dark_end", F.expr(f"interval {STEP} minutes"))
    times = let(minutes, lambda m: F.filter(m, lambda t, i: (i % MOON_STEP == 0) | (i == F.size(m) - 1)))
    samples = F.transform(times, lambda t: F.struct(t.alias("t"), astro.moon_altitude(t, F.col("lat"), F.col("lon"), offset).alias("alt")))

    def events(s: Column) -> Column:
        stay = lambda r: F.struct(F.lit("moon_up").alias("kind"), F.get(s, r["a"])["t"].alias("start"), F.get(s, r["b"])["t"].alias("end"), F.array_max(F.transform(F.slice(s, r["a"] + 1, r["b"] - r["a"] + 1), lambda x: x["alt"])).alias("max_alt"))
        none = F.array(F.struct(F.lit("moon_below_horizon_all_night").alias("kind"), F.lit(None).cast("timestamp").alias("start"), F.lit(None).cast("timestamp").alias("end"), F.lit(None).cast("double").alias("max_alt")))
        return let(F.transform(true_runs(flagged(s, lambda x: x["alt"] > 0)), stay), lambda found: F.when(F.size(found) > 0, found).when(s.isNotNull(), none))

    return nights.select(*keys, F.explode_outer(let(samples, events)).alias("e")).filter("e is not null").select(*keys, "e.*")


def pole_star(nights: DataFrame, keys: list[str], offset: float) -> DataFrame:
    """keys, alt, az of the pole star at the middle sample of the night."""
    n = F.floor((F.unix_seconds("dark_end") - F.unix_seconds("dark_start")) / 60) + 1
    t = F.timestamp_micros(F.unix_micros("dark_start") + F.floor(n / 2).cast("long") * 60_000_000)
    at = fixed(F.col("lat"), F.col("lon"), F.lit(POLE_STAR[1]), F.lit(POLE_STAR[2]))(astro.utc_days(t, offset))
    return nights.select(*keys, at.alias("p")).select(*keys, "p.alt", "p.az")
