"""Queries of reports and of catalogue upkeep, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from nightloom.functions import clock, geo, sky
from nightloom.operators import rank, raster, runs
from nightloom.plans import inputs
from nightloom.plans.inputs import SITES, table, text_time
from nightloom.plans.time_queries import CLEAR, MODELS, clear_windows, merged_models

QUERIES: dict = {}
SQL: dict = {}


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return put


@query(f"""WITH {MODELS}, p AS (SELECT site, night, avg(cloud) AS mean FROM mm WHERE cloud IS NOT NULL GROUP BY 1, 2)
    SELECT count(*) AS pairs, count(*) FILTER (mean <= 30) AS passed, round(avg(mean), 6) AS mean, CASE WHEN avg(mean) < 30 THEN 'good' WHEN avg(mean) < 60 THEN 'mixed' ELSE 'poor' END AS tone FROM p""")
def casual_weather_note(spark, sf_dir):
    """The mean of the pairs' means and its tone: two aggregations, pairs without a valid hour left out."""
    pairs = merged_models(spark, sf_dir).filter("cloud is not null").groupBy("site", "night").agg(F.avg("cloud").alias("mean"))
    return pairs.agg(F.count(F.lit(1)).alias("pairs"), F.count(F.when(F.col("mean") <= 30, 1)).alias("passed"), F.round(F.avg("mean"), 6).alias("mean"), clock.tone(F.avg("mean")).alias("tone"))


@query(f"""WITH {CLEAR} SELECT site, CAST(night AS VARCHAR) AS night, hours, round(mean, 6) AS mean FROM (SELECT *, row_number() OVER (PARTITION BY site ORDER BY round(mean, 9), night) AS k FROM clear) WHERE k = 1""")
def best_night_per_site(spark, sf_dir):
    best = runs.first_by(clear_windows(spark, sf_dir), ["site"], F.asc(F.round("mean", 9)), F.asc("night"))
    return best.select("site", F.col("night").cast("string"), "hours", F.round("mean", 6).alias("mean"))


@query(f"""WITH {CLEAR} SELECT site, count(*) AS nights, round(avg(hours), 6) AS hours, round(avg(mean), 6) AS mean, round(max(hours), 6) AS most FROM clear GROUP BY site""")
def period_summary(spark, sf_dir):
    return clear_windows(spark, sf_dir).groupBy("site").agg(F.count(F.lit(1)).alias("nights"), F.round(F.avg("hours"), 6).alias("hours"), F.round(F.avg("mean"), 6).alias("mean"), F.round(F.max("hours"), 6).alias("most"))


@query(f"""WITH {CLEAR} SELECT CAST(night AS VARCHAR) AS night, site, hours, CAST(k AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY night ORDER BY hours DESC, site) AS k FROM clear) WHERE k <= 2""")
def top_per_course(spark, sf_dir):
    top = rank.ranked(clear_windows(spark, sf_dir), ["night"], F.desc("hours"), F.asc("site"))
    return top.filter("rank <= 2").select(F.col("night").cast("string"), "site", "hours", "rank")


@query("""SELECT p_type, count(*) AS n, round(avg(CASE WHEN p_size > 25 THEN 100.0 ELSE 0.0 END), 6) AS large_pct, round(avg(CASE WHEN p_name LIKE '%blue%' THEN 100.0 ELSE 0.0 END), 6) AS blue_pct FROM part GROUP BY 1""")
def tag_presence(spark, sf_dir):
    share = lambda c: F.round(F.avg(F.when(c, 100.0).otherwise(0.0)), 6)
    return table(spark, sf_dir, "part").groupBy("p_type").agg(F.count(F.lit(1)).alias("n"), share(F.col("p_size") > 25).alias("large_pct"), share(F.col("p_name").contains("blue")).alias("blue_pct"))


@query("""WITH q AS (SELECT c_custkey, unnest(range(3)) AS pos FROM customer), h AS (SELECT *, (c_custkey * 7 + pos * 3) % 5 = 0 AS hit, (c_custkey + pos) % 25 AS place FROM q)
    SELECT c_custkey, CAST(pos AS INTEGER) AS pos, place FROM (SELECT *, row_number() OVER (PARTITION BY c_custkey ORDER BY pos) AS n FROM h WHERE hit) WHERE n = 1""")
def geocode_cascade(spark, sf_dir):
    """The first of several queries that finds a place: candidates in order, joined with what the service knows."""
    c = table(spark, sf_dir, "customer").select("c_custkey", F.posexplode(F.array(*map(F.lit, range(3)))).alias("pos", "q"))
    found = c.filter((F.col("c_custkey") * 7 + F.col("pos") * 3) % 5 == 0).withColumn("place", (F.col("c_custkey") + F.col("pos")) % 25)
    return runs.first_by(found, ["c_custkey"], F.asc("pos")).select("c_custkey", "pos", "place")


@query("""SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'city ' || c_custkey WHEN c_custkey % 3 = 1 THEN 'town ' || c_custkey ELSE 'unknown' END AS municipality FROM customer""")
def address_priority(spark, sf_dir):
    """The first present key of an address."""
    k = F.col("c_custkey")
    body = F.when(k % 3 == 0, F.concat(F.lit('{"address":{"town":"t","city":"city '), k.cast("string"), F.lit('"}}'))).when(k % 3 == 1, F.concat(F.lit('{"address":{"town":"town '), k.cast("string"), F.lit('"}}'))).otherwise("{}")
    keys = [F.get_json_object(body, f"$.address.{x}") for x in ("city", "town", "village", "county")]
    return table(spark, sf_dir, "customer").select(k, F.coalesce(*keys, F.lit("unknown")).alias("municipality"))


@query("""SELECT p_brand, max(p_size) AS version, arg_max(p_partkey, p_size * 1000000 + p_partkey) AS granule FROM part WHERE p_name LIKE '%a%' GROUP BY 1""")
def latest_collection(spark, sf_dir):
    p = table(spark, sf_dir, "part").filter(F.col("p_name").contains("a"))
    return p.groupBy("p_brand").agg(F.max("p_size").alias("version"), F.max_by("p_partkey", F.col("p_size") * 1_000_000 + F.col("p_partkey")).alias("granule"))


@query("""SELECT c_custkey, coalesce(CASE WHEN c_custkey % 4 > 0 THEN 'own' END, CASE WHEN c_nationkey < 5 THEN n_name END) AS prefecture FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey""")
def null_patch(spark, sf_dir):
    """A patch table fills nulls of one origin and changes nothing else."""
    patch = table(spark, sf_dir, "nation").filter("n_nationkey < 5").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    c = table(spark, sf_dir, "customer").withColumn("prefecture", F.when(F.col("c_custkey") % 4 > 0, "own"))
    return c.join(patch, "c_nationkey", "left").select("c_custkey", F.coalesce("prefecture", "n_name").alias("prefecture"))


@query("""SELECT event_id, CAST(floor((max(epoch_us(ts)) OVER () - epoch_us(ts)) / 6e7) AS BIGINT) AS minutes_before FROM events WHERE event_type = 'signup'""")
def frame_labels(spark, sf_dir):
    t = F.unix_micros(F.col("ts").cast("timestamp"))
    e = table(spark, sf_dir, "events").filter("event_type = 'signup'").select("event_id", t.alias("t"))
    return e.crossJoin(F.broadcast(e.agg(F.max("t").alias("latest")))).select("event_id", F.floor((F.col("latest") - F.col("t")) / 6e7).alias("minutes_before"))


@query("""SELECT id FROM (SELECT c_custkey AS id, row_number() OVER (ORDER BY c_custkey) AS n FROM customer) WHERE (n - 1) % 10 = 0""")
def stride_sample(spark, sf_dir):
    return rank.strided(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id")), 10, "id")


@query(f"""WITH {SITES}, t AS (SELECT x, y, px, py, (x * 31 + y * 17 + px * 7 + py) % 900 / 10.0 AS elev FROM range(8) a(x), range(8) b(y), range(8) c(px), range(8) d(py) WHERE (x + y) % 5 <> 0 AND (px + py) % 4 <> 0), k AS (SELECT DISTINCT x, y FROM t),
    s AS (SELECT id, id % 8 AS x, id // 8 % 8 AS y, id * 3 % 8 AS px, id * 5 % 8 AS py FROM sites)
    SELECT id, CASE WHEN k.x IS NOT NULL THEN coalesce(elev, 0.0) END AS elev FROM s LEFT JOIN k USING (x, y) LEFT JOIN t USING (x, y, px, py)""")
def dem_lookup(spark, sf_dir):
    """Elevations by pixel: a missing pixel is sea, a missing tile is unknown."""
    n = spark.range(4096).select(*((F.floor(F.col("id") / d) % 8).cast("long").alias(c) for c, d in (("xtile", 512), ("ytile", 64), ("px", 8), ("py", 1))))
    tiles = n.filter("(xtile + ytile) % 5 <> 0 and (px + py) % 4 <> 0").withColumn("elev", (F.col("xtile") * 31 + F.col("ytile") * 17 + F.col("px") * 7 + F.col("py")) % 900 / 10.0)
    k = F.col("id")
    p = inputs.sites(spark, sf_dir).select("id", (k % 8).alias("xtile"), (F.floor(k / 8) % 8).alias("ytile"), (k * 3 % 8).alias("px"), (k * 5 % 8).alias("py"))
    return raster.nearest_pixel(p, tiles, ["xtile", "ytile", "px", "py"]).select("id", "elev")


@query("""SELECT c_custkey, CAST(p AS INTEGER) AS peak FROM (SELECT c_custkey, CAST(c_custkey * 11 % 360 AS INTEGER) AS az FROM customer), (SELECT unnest([2, 90, 181, 270, 358]) AS p) WHERE abs((az - p + 540) % 360 - 180) <= 3""")
def circular_range_join(spark, sf_dir):
    """Azimuths with the peaks within three degrees: each row over a constant list, no join."""
    az = (F.col("c_custkey") * 11 % 360).cast("int")
    near = F.filter(F.array(*map(F.lit, (2, 90, 181, 270, 358))), lambda p: geo.circular_difference(az.cast("double"), p.cast("double")) <= 3)
    return table(spark, sf_dir, "customer").select("c_custkey", F.explode(near).alias("peak"))


@query(f"""WITH {inputs.FEW_SITES}, m AS (SELECT month, epoch(make_date(2024, CAST(month AS INTEGER), 1)) / 86400.0 - 10957.5 AS d FROM range(1, 13) t(month)), h AS (SELECT id, month, -(280.46061837 + 360.98564736629 * d + lon - 266.4) AS x FROM m, few)
    SELECT id, CAST(month AS INTEGER) AS month, round((x - 360 * floor(x / 360)) / 15 / 1.00273790935, 4) AS wait FROM h""")
def monthly_transit(spark, sf_dir):
    """Hours from the first midnight of each month to the passage of the galactic centre, for each site."""
    m = inputs.few_sites(spark, sf_dir).withColumn("month", F.explode(F.sequence(F.lit(1), F.lit(12))))
    d = sky.days(F.make_timestamp(F.lit(2024), F.col("month"), F.lit(1), F.lit(0), F.lit(0), F.lit(0)))
    return m.select("id", "month", F.round(sky.transit_wait(d, F.col("lon"), F.lit(266.4)), 4).alias("wait"))


@query(f"""WITH {inputs.SITE_NIGHTS}, {inputs.sky_sql("sn", "lo")} SELECT site, CAST(night AS VARCHAR) AS night, round({inputs.turn_sql("mlon - slon")} / 360 * 29.530589, 3) AS age, round(phase, 3) AS phase, round((1 + cos(radians(phase))) / 2, 4) AS illuminated FROM sky""")
def moon_rows(spark, sf_dir):
    """Age, phase and lit share of the moon for each site and night: a low-precision series."""
    n = inputs.site_nights(spark, sf_dir)
    d = sky.days(F.col("lo"))
    return n.select("site", F.col("night").cast("string"), F.round(sky.moon_age(d), 3).alias("age"), F.round(sky.phase_angle(d), 3).alias("phase"), F.round(sky.illuminated(d), 4).alias("illuminated"))


@query(f"""WITH {inputs.SITE_NIGHTS}, ts AS (SELECT site, night, unnest(generate_series(lo - INTERVAL 12 HOUR, hi, INTERVAL 1 MINUTE)) AS t FROM sn), {inputs.sky_sql("ts", "t")}, al AS (SELECT site, night, t, {inputs.altitude_sql("slon", "0.0", "(35.0 + site / 10.0)", "0.0")} AS alt FROM sky),
    v AS (SELECT site, night, t, 'sun' AS what, alt + 0.8333 AS v FROM al UNION ALL SELECT site, night, t, 'dark', alt + 18.0 FROM al), b AS (SELECT *, lag(v) OVER (PARTITION BY site, night, what ORDER BY t) AS before FROM v),
    k AS (SELECT *, CASE WHEN before <= 0 AND v > 0 THEN 'rise' WHEN before > 0 AND v <= 0 THEN 'set' END AS kind FROM b)
    SELECT site, CAST(night AS VARCHAR) AS night, what, kind, strftime(min(t), '%Y-%m-%d %H:%M') AS at FROM k WHERE kind IS NOT NULL GROUP BY ALL""")
def sun_events(spark, sf_dir):
    """Sunset and sunrise, and the ends of twilight, of each night and site: minute samples, sign changes."""
    n = inputs.site_nights(spark, sf_dir).withColumn("t", F.explode(F.sequence(F.col("lo") - F.expr("interval 12 hours"), F.col("hi"), F.expr("interval 1 minute"))))
    d = sky.days(F.col("t"))
    ra, dec = sky.equatorial(sky.sun_longitude(d), F.lit(0.0))
    alt, _ = sky.horizontal(d, 35.0 + F.col("site") / 10, F.lit(0.0), ra, dec)
    rows = n.select("site", "night", "t", F.explode(F.array(F.struct(F.lit("sun").alias("what"), (alt + 0.8333).alias("v")), F.struct(F.lit("dark").alias("what"), (alt + 18.0).alias("v")))).alias("x")).select("site", "night", "t", "x.*")
    return runs.sign_changes(rows, ["site", "night", "what"], "t", "v").select("site", F.col("night").cast("string"), "what", "kind", text_time("at"))


@query(f"""WITH {SITES}, w AS (SELECT id, lag(alr) OVER (ORDER BY id) AS before, alr FROM sites) SELECT id, CASE WHEN before IS NULL THEN 'first' WHEN alr > before THEN 'up' ELSE 'down' END AS step FROM w""")
def step_direction(spark, sf_dir):
    s = rank.lagged(inputs.sites(spark, sf_dir), "id", "alr", "before")
    return s.select("id", F.when(F.col("before").isNull(), "first").when(F.col("alr") > F.col("before"), "up").otherwise("down").alias("step"))
