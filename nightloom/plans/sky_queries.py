"""Queries over the sky of sites' nights: stays over the ridge, the moon, the pole star, planets."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nightloom.functions import planets, sky
from nightloom.functions.geo import rounded
from nightloom.operators import astro, sky_events
from nightloom.operators.graph import dealt, settle
from nightloom.plans import funnel, inputs
from nightloom.plans.inputs import OFFSET, table


def of_sites(spark: SparkSession, sf_dir: str, told: Callable[[DataFrame, list[str], float], DataFrame], ridge: bool = False) -> DataFrame:
    """What ``told`` says of the suppliers' sites in the nights that a run goes on with: id and the columns that it gives.

    Sites at one place (and, where the ``ridge`` counts, of one profile) see the same sky, so that is worked out once for each
    such spot, named by its first site, and sites are joined with their spot.
    """
    chosen = [r["night"] for r in funnel.Explore(spark, sf_dir).nights.filter("reason is null").select("night").orderBy("night").collect()]  # as many as a run goes on with
    sites, by = inputs.few_sites(spark, sf_dir).select("id", "lat", "lon"), ["lat", "lon"]
    if ridge:
        sites, by = sites.join(inputs.profiles(spark, sf_dir).withColumnRenamed("horizon_no", "id"), "id"), [*by, "profile"]
    spots = settle(sites.groupBy(*by).agg(F.min("id").alias("spot")))
    places = spots.select("lat", "lon").distinct().withColumn("night", F.explode(F.array(*map(F.lit, chosen)).cast("array<date>")))
    nights = astro.night_events(dealt(places, 100), OFFSET).filter("dark_start is not null and dark_end is not null")
    found = settle(shown(told(dealt(spots.join(nights, ["lat", "lon"]), 50), ["spot", "night"], OFFSET)))
    return sites.join(spots, by).select("id", "spot").join(found, "spot").drop("spot")


def shown(df: DataFrame) -> DataFrame:
    kinds = {"timestamp": lambda c: F.date_format(c, "yyyy-MM-dd HH:mm"), "double": lambda c: rounded(F.col(c), 4), "date": lambda c: F.col(c).cast("string")}
    return df.select(*(kinds.get(f.dataType.simpleString(), F.col)(f.name).alias(f.name) for f in df.schema))


def ridge_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bright stars that come over a site's ridge and go behind it."""
    return of_sites(spark, sf_dir, sky_events.object_events, ridge=True)


def moon_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return of_sites(spark, sf_dir, sky_events.moon_events)


def pole_star(spark: SparkSession, sf_dir: str) -> DataFrame:
    return of_sites(spark, sf_dir, sky_events.pole_star)


def planet_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where the planets stand at the time of each event: ecliptic of the date, and over a place that the user gives."""
    e = table(spark, sf_dir, "events").select("event_id", sky.days(F.col("ts")).alias("d"), (30 + F.col("user_id") % 15).cast("double").alias("lat"), (130 + F.col("user_id") % 20).cast("double").alias("lon"))
    rows = dealt(e, 20_000).withColumn("o", F.explode(planets.listed())).withColumn("g", planets.ecliptic(F.col("d"), F.col("o"))).withColumn("h", planets.seen_from(F.col("d"), F.col("lat"), F.col("lon"), F.col("g")))  # the ecliptic once
    shown_at = (rounded(F.col(c), 4).alias(n) for c, n in (("g.lon", "ecliptic_lon"), ("g.lat", "ecliptic_lat"), ("g.distance", "distance"), ("h.alt", "alt"), ("h.az", "az")))
    return rows.select("event_id", F.col("o.name").alias("planet"), *shown_at)


def horizontal_sql(d: str, ra: str, dec: str) -> tuple[str, str]:
    h = f"radians({inputs.turn_sql(f'280.46061837 + 360.98564736629 * {d} + lon - {ra}')})"
    alt = f"degrees(asin(sin(radians(lat)) * sin(radians({dec})) + cos(radians(lat)) * cos(radians({dec})) * cos({h})))"
    return alt, inputs.turn_sql(f"degrees(atan2(-sin({h}) * cos(radians({dec})), sin(radians({dec})) * cos(radians(lat)) - cos(radians({dec})) * cos({h}) * sin(radians(lat))))")


def sql() -> dict[str, str]:
    nights = f"""{funnel.nights_sql()}, {inputs.FEW_SITES}, rs AS (SELECT few.id, few.lat, few.lon, al.night FROM few, al WHERE reason IS NULL), {funnel.events_sql("rs", "id, night", "rg0")}, rg AS (SELECT * FROM rg0 WHERE dark_start IS NOT NULL AND dark_end IS NOT NULL), {inputs.HORIZONS}"""
    d = f"(epoch_us({funnel.utc('t')}) / 8.64e10 - 10957.5)"
    alt, az = horizontal_sql(d, "ra", "dec")
    text = lambda c: f"strftime({c}, '%Y-%m-%d %H:%M')"
    stars = ", ".join(f"('{n}', {ra}::DOUBLE, {dec}::DOUBLE)" for n, ra, dec, mag in sky_events.STARS if mag <= sky_events.BRIGHT)
    p_alt, p_az = horizontal_sql(d, f"{sky_events.POLE_STAR[1]}", f"{sky_events.POLE_STAR[2]}")
    el = ", ".join(f"('{n}', {', '.join(f'{v}::DOUBLE' for v in (*a, *b))})" for n, (a, b) in planets.ELEMENTS.items())
    steps, last = "", "k0"
    for n in range(planets.STEPS):
        steps += f", k{n + 1} AS (SELECT * REPLACE (x - (x - e * sin(x) - m) / (1 - e * cos(x)) AS x) FROM {last})"
        last = f"k{n + 1}"
    s, c = (lambda x: f"sin(radians({x}))"), (lambda x: f"cos(radians({x}))")
    place = f"""SELECT event_id, name, d, lat, lon, ({c("w")} * {c("node")} - {s("w")} * {s("node")} * {c("i")}) * u + (-{s("w")} * {c("node")} - {c("w")} * {s("node")} * {c("i")}) * v AS x, ({c("w")} * {s("node")} + {s("w")} * {c("node")} * {c("i")}) * u + (-{s("w")} * {s("node")} + {c("w")} * {c("node")} * {c("i")}) * v AS y, {s("w")} * {s("i")} * u + {c("w")} * {s("i")} * v AS z"""
    ecl = "radians(23.4393)"
    ra = f"degrees(atan2(sin(radians(elon)) * cos({ecl}) - tan(radians(elat)) * sin({ecl}), cos(radians(elon))))"
    dec = f"degrees(asin(sin(radians(elat)) * cos({ecl}) + cos(radians(elat)) * sin({ecl}) * sin(radians(elon))))"
    a2, z2 = horizontal_sql("d", "ra", "dec")
    return {
        "ridge_events": f"""WITH {nights}, ob(name, ra, dec) AS (VALUES {stars}), sa AS (SELECT id, night, name, i, t, {alt} AS alt, {az} AS az FROM (SELECT *, dark_start + i * INTERVAL 1 MINUTE AS t FROM (SELECT *, unnest(range(CAST(floor(epoch_us(dark_end - dark_start) / 6e7) AS BIGINT) + 1)) AS i FROM rg), ob)),
            fl AS (SELECT sa.*, sa.alt > coalesce(hz.alt, 0.0) AS ok, max(i) OVER (PARTITION BY id, night, name) AS n FROM sa LEFT JOIN hz ON hz.site = id AND hz.az = CAST(round_even(sa.az, 0) AS BIGINT) % 360),
            tr AS (SELECT *, CASE WHEN i - lag(i) OVER (PARTITION BY id, night, name ORDER BY i) - 1 <= {sky_events.GAP} THEN 0 ELSE 1 END AS new FROM fl WHERE ok), gr AS (SELECT *, sum(new) OVER (PARTITION BY id, night, name ORDER BY i) AS g FROM tr),
            ru AS (SELECT id, night, name, g, min(i) AS a, max(i) AS b, any_value(n) AS n FROM gr GROUP BY ALL),
            ev AS (SELECT ru.*, arg_min(sa.t, sa.i) AS s, arg_max(sa.t, sa.i) AS e, max(sa.alt) AS top, arg_min(sa.t, (-sa.alt, sa.i)) AS top_t, arg_min(sa.az, (-sa.alt, sa.i)) AS top_az, arg_min(sa.az, sa.i) AS az_a, arg_max(sa.az, sa.i) AS az_b FROM ru JOIN sa ON sa.id = ru.id AND sa.night = ru.night AND sa.name = ru.name AND sa.i BETWEEN ru.a AND ru.b GROUP BY ALL)
            SELECT id, CAST(night AS VARCHAR) AS night, 'star_above_ridge' AS kind, name, {text("s")} AS start, {text("e")} AS "end", a > 0 AS rises, b < n AS sets, round(top, 4) AS max_alt, {text("top_t")} AS max_alt_time, round(top_az, 4) AS max_alt_az, CASE WHEN a > 0 THEN round(az_a, 4) END AS rise_az, CASE WHEN b < n THEN round(az_b, 4) END AS set_az FROM ev""",
        "moon_events": f"""WITH {nights}, mi AS (SELECT *, dark_start + i * INTERVAL 1 MINUTE AS t FROM (SELECT *, n - 1 AS last, unnest(range(n)) AS i FROM (SELECT *, CAST(floor(epoch_us(dark_end - dark_start) / 6e7) AS BIGINT) + 1 AS n FROM rg))), m5 AS (SELECT id, night, lat, lon, t FROM mi WHERE i % 5 = 0 OR i = last),
            {inputs.sky_sql("m5", funnel.utc("t"), "my")}, ma AS (SELECT id, night, t, {inputs.altitude_sql("mlon", "mlat", "lat", "lon")} AS alt FROM my), mr AS (SELECT *, count(*) FILTER (NOT alt > 0) OVER (PARTITION BY id, night ORDER BY t) AS run FROM ma),
            up AS (SELECT id, night, min(t) AS s, max(t) AS e, max(alt) AS top FROM mr WHERE alt > 0 GROUP BY id, night, run)
            SELECT rg.id, CAST(rg.night AS VARCHAR) AS night, CASE WHEN s IS NULL THEN 'moon_below_horizon_all_night' ELSE 'moon_up' END AS kind, {text("s")} AS start, {text("e")} AS "end", round(top, 4) AS max_alt FROM rg LEFT JOIN up ON up.id = rg.id AND up.night = rg.night""",
        "pole_star": f"""WITH {nights}, mid AS (SELECT *, dark_start + ((CAST(floor(epoch(dark_end - dark_start) / 60) AS BIGINT) + 1) // 2) * INTERVAL 1 MINUTE AS t FROM rg) SELECT id, CAST(night AS VARCHAR) AS night, round({p_alt}, 4) AS alt, round({p_az}, 4) AS az FROM mid""",
        "planet_places": f"""WITH el(name, a, e, i, l, peri, node, da, de, di, dl, dperi, dnode) AS (VALUES {el}), ev AS (SELECT event_id, epoch_us(ts) / 8.64e10 - 10957.5 AS d, CAST(30 + user_id % 15 AS DOUBLE) AS lat, CAST(130 + user_id % 20 AS DOUBLE) AS lon FROM events),
            nw AS (SELECT event_id, d, lat, lon, name, a + da * (d / 36525.0) AS a, e + de * (d / 36525.0) AS e, i + di * (d / 36525.0) AS i, l + dl * (d / 36525.0) AS l, peri + dperi * (d / 36525.0) AS peri, node + dnode * (d / 36525.0) AS node FROM ev, el),
            mn AS (SELECT *, radians({inputs.turn_sql("l - peri + 180.0")} - 180.0) AS m, peri - node AS w FROM nw), k0 AS (SELECT *, m + e * sin(m) AS x FROM mn){steps},
            pl AS (SELECT *, a * (cos(x) - e) AS u, a * sqrt(1 - e * e) * sin(x) AS v FROM {last}), pt AS ({place} FROM pl),
            ge AS (SELECT p.event_id, p.name, p.d, p.lat, p.lon, p.x - q.x AS x, p.y - q.y AS y, p.z - q.z AS z FROM pt p JOIN pt q ON q.event_id = p.event_id AND q.name = 'Earth' WHERE p.name <> 'Earth'),
            ec AS (SELECT *, {inputs.turn_sql(f"degrees(atan2(y, x)) + {planets.PRECESSION} * (d / 36525.0)")} AS elon, degrees(atan2(z, sqrt(x * x + y * y))) AS elat, sqrt(x * x + y * y + z * z) AS r FROM ge), eq AS (SELECT *, {inputs.turn_sql(ra)} AS ra, {dec} AS dec FROM ec)
            SELECT event_id, name AS planet, round(elon, 4) AS ecliptic_lon, round(elat, 4) AS ecliptic_lat, round(r, 4) AS distance, round({a2}, 4) AS alt, round({z2}, 4) AS az FROM eq""",
    }


QUERIES = {f.__name__: f for f in (ridge_events, moon_events, pole_star, planet_places)}
SQL = sql()
