"""Queries of sources, sinks, small projections and order statistics, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from nightloom.functions import clock, geo, sky
from nightloom.operators import cloud, rank, series
from nightloom.operators.graph import settle
from nightloom.operators.joins import joined
from nightloom.plans import inputs
from nightloom.plans.inputs import SITES, table
from nightloom.plans.time_queries import MODELS, merged_models
from nightloom.sources import catalogues, documents

QUERIES: dict = {}
SQL: dict = {}


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return put


@query(f"WITH {SITES} SELECT id, name FROM sites")
def spot_lookup(spark, sf_dir):
    """Sites by id or by name; none or several is an error."""
    s = inputs.sites(spark, sf_dir).select("id", "name")
    asked = s.select(F.when(F.col("id") % 2 == 0, F.col("name")).otherwise(F.col("id").cast("string")).alias("key"))
    return catalogues.spots_for(asked, s).select("id", "name")


@query(f"WITH {SITES} SELECT name, round(CAST(lat AS DOUBLE), 2) AS lat, round(CAST(lon AS DOUBLE), 2) AS lon FROM sites")
def external_spots(spark, sf_dir):
    """A CSV file whose coordinates stand in one quoted field."""
    path = documents.fresh(spark)
    where = F.format_string("%.2f, %.2f", F.col("lat").cast("double"), F.col("lon").cast("double"))
    inputs.sites(spark, sf_dir).select("name", where.alias("coordinates")).write.option("header", True).csv(path)
    return catalogues.read_external(spark, path)


@query("""SELECT s_suppkey AS id, round((s_suppkey % 24) * 15 + (s_suppkey * 7 % 60) / 4.0 + (s_suppkey * 11 % 60) / 240.0, 9) AS ra, round(CASE WHEN s_suppkey % 3 = 0 THEN -1 ELSE 1 END * (CASE WHEN s_suppkey % 6 = 3 THEN 0 ELSE s_suppkey % 90 END + (s_suppkey * 13 % 60) / 60.0 + (s_suppkey * 17 % 59 + 1) / 3600.0), 9) AS dec FROM supplier""")
def object_catalogue(spark, sf_dir):
    """Objects of JSON lines, sexagesimal coordinates as decimals; a sign on any part counts for all."""
    path = documents.fresh(spark)
    k = F.col("s_suppkey")
    d = F.when(k % 6 == 3, 0).otherwise(k % 90)
    sign = F.when(k % 3 == 0, -1).otherwise(1)
    dec = F.array((d * sign).cast("double"), (k * 13 % 60).cast("double"), ((k * 17 % 59 + 1) * F.when(d == 0, sign).otherwise(1)).cast("double"))
    table(spark, sf_dir, "supplier").select(k.alias("id"), F.array((k % 24).cast("double"), (k * 7 % 60).cast("double"), (k * 11 % 60).cast("double")).alias("ra_hms"), dec.alias("dec_dms")).write.json(path)
    return catalogues.read_objects(spark, path).select("id", F.round("ra", 9).alias("ra"), F.round("dec", 9).alias("dec"))


@query("""SELECT s_suppkey AS id, CAST(month AS INTEGER) AS month, CAST(pos AS INTEGER) AS place FROM (SELECT s_suppkey, unnest([s_suppkey % 12 + 1, s_suppkey * 5 % 12 + 1]) AS month, unnest([0, 1]) AS pos FROM supplier)""")
def target_catalogue(spark, sf_dir):
    """Targets with their best months, a row each, in the order of the file."""
    path = documents.fresh(spark)
    k = F.col("s_suppkey")
    table(spark, sf_dir, "supplier").select(k.alias("id"), F.array((k % 12 + 1).cast("int"), (k * 5 % 12 + 1).cast("int")).alias("best_months")).write.json(path)
    return catalogues.read_targets(spark, path).select("id", F.posexplode("best_months").alias("place", "month"))


@query("""SELECT c_custkey, substr(sha1('{"model":"' || CASE WHEN c_custkey % 2 = 0 THEN 'MSM' ELSE 'ECMWF' END || '","step":' || c_custkey % 7 || '}'), 1, 16) AS fingerprint, c_nationkey || '_' || c_custkey % 7 AS cell FROM customer""")
def conditions_fingerprint(spark, sf_dir):
    k = F.col("c_custkey")
    conditions = {"step": k % 7, "model": F.when(k % 2 == 0, "MSM").otherwise("ECMWF")}
    return table(spark, sf_dir, "customer").select(k, catalogues.fingerprint(conditions).alias("fingerprint"), F.concat_ws("_", "c_nationkey", k % 7).alias("cell"))


@query(f"""WITH {SITES} SELECT round_even(lat * 2, 0) / 2 AS lat_key, round_even(lon * 2, 0) / 2 AS lon_key, count(*) AS n FROM sites GROUP BY 1, 2""")
def spatial_key(spark, sf_dir):
    """Sites by cells of half a degree, the order in which they are worked off."""
    half = lambda c: F.rint(F.col(c) * 2) / 2
    return inputs.sites(spark, sf_dir).groupBy(half("lat").alias("lat_key"), half("lon").alias("lon_key")).agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {SITES} SELECT id FROM sites ORDER BY round_even(lat * 2, 0) / 2, round_even(lon * 2, 0) / 2, id LIMIT 25""")
def geographic_batch(spark, sf_dir):
    """The first batch of sites in geographic order."""
    half = lambda c: F.rint(F.col(c) * 2) / 2
    return inputs.sites(spark, sf_dir).orderBy(half("lat"), half("lon"), "id").limit(25).select("id")


@query(f"""WITH {SITES} SELECT origin_no, CAST(min(lat) AS DOUBLE) AS south, CAST(max(lat) AS DOUBLE) AS north, CAST(min(lon) AS DOUBLE) AS west, CAST(max(lon) AS DOUBLE) AS east, round(min(lat) - 300 / 111.195, 6) AS reach_south FROM sites GROUP BY 1""")
def spot_bbox(spark, sf_dir):
    """The box around each origin's sites, and how far south the light that reaches it may stand."""
    b = lambda f, c: f(F.col(c).cast("double"))
    out = inputs.sites(spark, sf_dir).groupBy("origin_no").agg(b(F.min, "lat").alias("south"), b(F.max, "lat").alias("north"), b(F.min, "lon").alias("west"), b(F.max, "lon").alias("east"))
    return out.withColumn("reach_south", F.round(F.col("south") - 300 / 111.195, 6))


@query(f"""WITH {SITES} (SELECT 'darkest' AS list, id FROM sites ORDER BY alr, id LIMIT 5) UNION ALL (SELECT 'brightest', id FROM sites ORDER BY alr DESC, id LIMIT 5)""")
def darkest_brightest(spark, sf_dir):
    s = inputs.sites(spark, sf_dir)
    ends = {"darkest": F.asc("alr"), "brightest": F.desc("alr")}
    a, b = (s.orderBy(o, "id").limit(5).select(F.lit(n).alias("list"), "id") for n, o in ends.items())
    return a.union(b)


@query("""SELECT c_custkey, CAST(hours AS DOUBLE) AS hours FROM (SELECT c_custkey, CASE WHEN c_custkey % 4 > 0 THEN c_custkey * 7 % 97 / 8.0 END AS hours FROM customer) WHERE hours IS NOT NULL ORDER BY hours DESC, c_custkey LIMIT 10""")
def top_hours(spark, sf_dir):
    k = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(k, F.when(k % 4 > 0, k * 7 % 97 / 8.0).alias("hours")).filter("hours is not null").orderBy(F.desc("hours"), "c_custkey").limit(10)


@query(f"""WITH {SITES}, a AS (SELECT id, CASE WHEN id % 9 > 0 THEN alr END AS alr FROM sites) SELECT id, CASE WHEN alr IS NULL THEN 999.0 ELSE round(CAST(alr * 5 / 10.66 AS DOUBLE), 6) END AS index, CASE WHEN alr IS NULL THEN 'no data' ELSE printf('ALR %.2f', CAST(alr AS DOUBLE)) END AS text,
    CASE WHEN alr <= 10.66 THEN 'dark' ELSE 'bright' END AS passes FROM a""")
def light_index(spark, sf_dir):
    """The light's index, which is infinite outside the grid, its text, and whether a site passes by it."""
    s = inputs.sites(spark, sf_dir).select("id", F.when(F.col("id") % 9 > 0, F.col("alr").cast("double")).alias("alr"))
    index = catalogues.light_index(F.col("alr"))
    shown = F.when(index == float("inf"), 999.0).otherwise(F.round(index, 6))
    return s.select("id", shown.alias("index"), catalogues.light_text(F.col("alr")).alias("text"), F.when(index <= 5.0, "dark").otherwise("bright").alias("passes"))


@query(f"""WITH {SITES} SELECT id, array_to_string(list_filter([CASE WHEN alr < 5 THEN 'dark' END, CASE WHEN id % 300 > 200 THEN 'far' END, CASE WHEN id % 13 = 0 THEN 'island' END, CASE WHEN lift THEN 'lift' END], lambda x: x IS NOT NULL), ',') AS tags, (id % 101) || '%' AS percent FROM sites""")
def card_tags(spark, sf_dir):
    k = F.col("id")
    tags = catalogues.tags({"dark": F.col("alr") < 5, "far": k % 300 > 200, "island": k % 13 == 0, "lift": F.col("lift")})
    return inputs.sites(spark, sf_dir).select("id", F.array_join(tags, ",").alias("tags"), F.format_string("%d%%", k % 101).alias("percent"))


@query("""WITH s AS (SELECT c_custkey, m, t, [CAST(t * 5 % 12 + 1 AS INTEGER), CAST(t * 7 % 12 + 1 AS INTEGER)] AS b FROM (SELECT c_custkey, CAST(c_custkey % 12 + 1 AS INTEGER) AS m FROM customer), range(12) r(t)),
    p AS (SELECT *, CASE WHEN list_contains(b, m) THEN 0 WHEN list_contains(b, m % 12 + 1) THEN 1 WHEN list_contains(b, (m + 10) % 12 + 1) THEN 2 END AS p FROM s)
    SELECT c_custkey, t AS target, CAST(n AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY c_custkey ORDER BY p, t) AS n FROM p WHERE p IS NOT NULL) WHERE n <= 2""")
def chosen_targets(spark, sf_dir):
    """The two targets of a month: those in season, then those before and after it."""
    k, t = F.col("c_custkey"), F.col("target")
    month = lambda c: (c % 12 + 1).cast("int")
    rows = table(spark, sf_dir, "customer").select(k, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(11).cast("long"))).alias("target"))
    season = clock.season(F.array(month(t * 5), month(t * 7)), month(k))
    rows = rows.withColumn("season", season).filter("season != 'off'")
    order = F.when(F.col("season") == "best", 0).when(F.col("season") == "early", 1).otherwise(2)
    return rank.ranked(rows, ["c_custkey"], order.asc(), F.asc("target")).filter("rank <= 2").select("c_custkey", "target", "rank")


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN 'schema' WHEN (o_orderkey * 7 % 900) > 720 THEN 'stale' WHEN o_orderkey % 4 <> 3 THEN 'images' ELSE 'valid' END AS state, o_orderkey % 3 = 0 AS of_today FROM orders""")
def commentary_state(spark, sf_dir):
    """Whether a commentary may be shown: its schema, its age of at most twelve hours, its three images; and whether it is of today."""
    k = F.col("o_orderkey")
    now = F.to_timestamp(F.lit("2026-09-01 18:00:00"))
    made = now - F.make_dt_interval(mins=(k * 7 % 900).cast("int"))
    o = table(spark, sf_dir, "orders").select(k, F.when(k % 5 == 0, "old/1").otherwise(catalogues.COMMENTARY).alias("schema"), made.alias("made"), F.slice(F.array(*map(F.lit, "abc")), 1, (k % 4).cast("int")).alias("images"), F.when(k % 3 == 0, F.to_date(now)).otherwise(F.date_sub(F.to_date(now), 1)).alias("day"))
    return o.select(k, catalogues.commentary_state(F.col("schema"), F.col("made"), F.col("images"), now).alias("state"), (F.col("day") == F.to_date(now)).alias("of_today"))


@query("""SELECT c_mktsegment, c_nationkey, count(*) AS n, CAST(GROUPING_ID(c_mktsegment, c_nationkey) AS BIGINT) AS level FROM customer GROUP BY CUBE (c_mktsegment, c_nationkey)""")
def cube_counts(spark, sf_dir):
    return table(spark, sf_dir, "customer").cube("c_mktsegment", "c_nationkey").agg(F.count(F.lit(1)).alias("n"), F.grouping_id().alias("level"))


@query("""SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)""")
def rollup_counts(spark, sf_dir):
    return table(spark, sf_dir, "orders").rollup("o_orderstatus", "o_orderpriority").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier""")
def shared_nations(spark, sf_dir):
    return table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("k")).intersect(table(spark, sf_dir, "supplier").select("s_nationkey"))


@query("""SELECT c_custkey, CAST(ntile(4) OVER (PARTITION BY c_nationkey ORDER BY c_acctbal, c_custkey) AS INTEGER) AS quarter FROM customer""")
def quarters(spark, sf_dir):
    """Quarters of each nation's balances: rows are numbered by ranges, for nations are few and large."""
    rows = settle(table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_acctbal"))
    sizes = rows.groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("n"))
    placed = joined(rank.numbered(rows, ["c_nationkey"], F.asc("c_acctbal"), F.asc("c_custkey")), sizes.withColumn("all", F.col("n")), ["c_nationkey"], "n", rows.count())
    few, more = F.floor(F.col("all") / 4), F.col("all") % 4  # the first ``more`` quarters have one row more
    at = F.col("rank") - 1
    quarter = F.when(at < more * (few + 1), F.floor(at / (few + 1))).otherwise(more + F.floor((at - more * (few + 1)) / F.greatest(few, F.lit(1))))
    return placed.select("c_custkey", (quarter + 1).cast("int").alias("quarter"))


@query("""SELECT p_size AS tile, arg_min(p_partkey // 100, (-v, p_partkey)) AS iy, arg_min(p_partkey % 100, (-v, p_partkey)) AS ix, max(v) AS value FROM (SELECT *, p_partkey * 31 % 97 AS v FROM part) GROUP BY 1""")
def raster_argmax(spark, sf_dir):
    """The brightest cell of each tile, the first in row order on ties."""
    k = F.col("p_partkey")
    cells = table(spark, sf_dir, "part").select(F.col("p_size").alias("tile"), F.floor(k / 100).alias("iy"), (k % 100).alias("ix"), (k * 31 % 97).alias("value"))
    at = F.min(F.struct((-F.col("value")).alias("v"), "iy", "ix")).alias("m")
    return cells.groupBy("tile").agg(at).select("tile", F.col("m.iy").alias("iy"), F.col("m.ix").alias("ix"), (-F.col("m.v")).alias("value"))


@query("""WITH t AS (SELECT p_partkey % 2 AS tx, p_partkey // 2 % 2 AS ty, p_partkey // 4 % 20 AS ix, p_partkey // 80 AS iy, CASE WHEN p_size <> 7 THEN p_size * 1.5::DOUBLE END AS value FROM part) SELECT ty * 1000 + iy AS row, tx * 20 + ix AS col, value FROM t WHERE tx * 20 + ix BETWEEN 5 AND 30""")
def mosaic(spark, sf_dir):
    """Tiles put side by side with the fill value as null, and cut to an extent."""
    k = F.col("p_partkey")
    cells = table(spark, sf_dir, "part").select((k % 2).alias("tx"), (F.floor(k / 2) % 2).alias("ty"), (F.floor(k / 4) % 20).alias("ix"), F.floor(k / 80).alias("iy"), F.when(F.col("p_size") == 7, -999.0).otherwise(F.col("p_size") * 1.5).alias("value"))
    return catalogues.mosaic(cells, 1000, 20, fill=-999.0).filter(F.col("col").between(5, 30))


@query("""SELECT c_custkey, CAST(p AS INTEGER) AS p, CASE WHEN (c_custkey + p) % 3 > 0 THEN c_custkey % 500 + 10.0 * p ELSE round(44330.0 * (1.0 - pow(p / 1013.25, 1 / 5.255)), 4) END AS height FROM customer, (SELECT unnest([1000, 850, 500]) AS p)""")
def level_heights(spark, sf_dir):
    """A level's forecast height, else that of the standard atmosphere."""
    k = F.col("c_custkey")
    rows = table(spark, sf_dir, "customer").select(k, F.explode(F.array(*map(F.lit, (1000, 850, 500)))).alias("p"))
    known = F.when((k + F.col("p")) % 3 > 0, (k % 500 + F.col("p") * 10).cast("double"))
    return rows.select(k, "p", F.coalesce(known, F.round(cloud.pressure_height(F.col("p")), 4)).alias("height"))


@query("""SELECT c_custkey, CAST(p AS INTEGER) AS p, CASE WHEN c_custkey % 4 > 0 AND (c_custkey + p) % 3 > 0 THEN 'MSM' ELSE 'ECMWF' END AS source, CASE WHEN c_custkey % 4 > 0 AND (c_custkey + p) % 3 > 0 THEN c_custkey % 101 ELSE c_custkey * 7 % 101 END AS cloud
    FROM customer, (SELECT unnest([1000, 850, 500]) AS p) WHERE (c_custkey % 4 > 0 AND (c_custkey + p) % 3 > 0) OR (c_custkey % 5 > 0 AND p > 600)""")
def two_source_levels(spark, sf_dir):
    """Two models per pressure level: the finer one where it has the level, else the other."""
    k, p = F.col("c_custkey"), F.col("p")
    rows = table(spark, sf_dir, "customer").select(k, F.explode(F.array(*map(F.lit, (1000, 850, 500)))).alias("p"))
    fine = rows.filter((k % 4 > 0) & ((k + p) % 3 > 0)).select("c_custkey", "p", (k % 101).alias("cloud"))
    coarse = rows.filter((k % 5 > 0) & (p > 600)).select("c_custkey", "p", (k * 7 % 101).alias("cloud"))
    both = fine.withColumn("source", F.lit("MSM")).join(coarse.withColumnRenamed("cloud", "other"), ["c_custkey", "p"], "full")
    return both.select("c_custkey", "p", F.coalesce("source", F.lit("ECMWF")).alias("source"), F.coalesce("cloud", "other").alias("cloud"))


@query(f"""WITH {SITES} SELECT id, 'https://www.google.com/maps?q=' || printf('%.2f', CAST(lat AS DOUBLE)) || ',' || printf('%.2f', CAST(lon AS DOUBLE)) AS url, rpad(name, 24, ' ') AS padded, CASE WHEN abs(lat + dec) >= 90 THEN 'circumpolar' WHEN abs(lat - dec) >= 90 THEN 'never_rises' ELSE 'rises' END AS kind, strftime(TIMESTAMP '2026-09-01 00:00:00' + INTERVAL 9 HOUR + id % 60 * INTERVAL 1 MINUTE, '%Y-%m-%d %H:%M') AS at
    FROM (SELECT *, id % 170 - 85 AS dec FROM sites)""")
def small_functions(spark, sf_dir):
    k = F.col("id")
    two = lambda c: F.format_string("%.2f", F.col(c).cast("double"))
    at = clock.utc_basetime(F.concat(F.lit("2026090100"), F.lpad((k % 60).cast("string"), 2, "0"), F.lit("00")))
    return inputs.sites(spark, sf_dir).select("id", clock.map_url(two("lat"), two("lon")).alias("url"), clock.padded(F.col("name"), 24).alias("padded"), sky.rising_kind(F.col("lat"), (k % 170 - 85).cast("double")).alias("kind"), F.date_format(at, "yyyy-MM-dd HH:mm").alias("at"))


@query("""SELECT DISTINCT c_custkey, 'h' || lpad(CAST(h AS VARCHAR), 2, '0') || 'v' || lpad(CAST(v AS VARCHAR), 2, '0') AS tile FROM (SELECT c_custkey, c_custkey * 7 % 100 - 50 AS south, c_custkey * 11 % 300 - 150 AS west FROM customer), range(36) a(h), range(18) b(v) WHERE h BETWEEN floor((west + 180) / 10) AND floor((west + 195) / 10) AND v BETWEEN floor((90 - south - 12) / 10) AND floor((90 - south) / 10)""")
def extent_tiles(spark, sf_dir):
    """Names of the 10-degree tiles that each box touches."""
    k = F.col("c_custkey")
    south, west = k * 7 % 100 - 50, k * 11 % 300 - 150
    return table(spark, sf_dir, "customer").select(k, F.explode(geo.tiles_of(south, south + 12, west, west + 15)).alias("tile"))


@query("""SELECT c_custkey, CAST(CAST(DATE '2026-09-01' + CAST(c_custkey % 9 AS INTEGER) + n AS DATE) AS VARCHAR) AS night, n < 4 AS in_fine_model FROM customer, (SELECT CAST(unnest(range(14)) AS INTEGER) AS n)""")
def night_timeline(spark, sf_dir):
    """The fourteen nights from a day on, and which of them the finer model reaches."""
    k = F.col("c_custkey")
    rows = table(spark, sf_dir, "customer").select(k, F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(13)), lambda n: F.date_add(F.date_add(F.lit("2026-09-01").cast("date"), (k % 9).cast("int")), n))).alias("n", "night"))
    return rows.select("c_custkey", F.col("night").cast("string"), (F.col("n") < 4).alias("in_fine_model"))


@query("""SELECT c_nationkey, '[' || string_agg('{"rank":' || n || ',"id":' || c_custkey || '}', ',' ORDER BY n) || ']' AS course FROM (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS n FROM customer) WHERE n <= 3 GROUP BY 1""")
def course_json(spark, sf_dir):
    """The three best of each course as a JSON text."""
    top = rank.ranked(table(spark, sf_dir, "customer"), ["c_nationkey"], F.desc("c_acctbal"), F.asc("c_custkey")).filter("rank <= 3")
    return top.groupBy("c_nationkey").agg(F.to_json(F.sort_array(F.collect_list(F.struct("rank", F.col("c_custkey").alias("id"))))).alias("course"))


@query("""SELECT c_custkey AS cell, CAST(DATE '2026-09-01' + CAST(c_custkey % 10 AS INTEGER) AS VARCHAR) AS night, CASE WHEN c_custkey % 3 = 0 THEN 'new' ELSE 'old' END AS run FROM customer WHERE c_custkey % 10 >= 2 AND c_custkey % 5 <> 4 AND NOT (c_custkey % 3 > 0 AND c_custkey % 7 = 0)""")
def night_cache(spark, sf_dir):
    """A cache of nights that a second run merges its own into: its values win, failures are never written, old nights are deleted."""
    path = documents.fresh(spark)
    k = F.col("c_custkey")
    rows = table(spark, sf_dir, "customer").select(k.alias("cell"), F.date_add(F.lit("2026-09-01").cast("date"), (k % 10).cast("int")).alias("night"), F.when(k % 5 != 4, F.lit("old")).alias("run"))
    documents.merge_nights(spark, rows.filter("cell % 7 > 0 or cell % 3 = 0"), path, ["cell"], "run")
    documents.merge_nights(spark, rows.filter("cell % 3 = 0").withColumn("run", F.when(F.col("run").isNotNull(), "new")), path, ["cell"], "run")
    documents.prune_nights(spark, path, "2026-09-10")
    return spark.read.parquet(path).select("cell", F.col("night").cast("string"), "run")


@query("""SELECT event_id, n <= 5 AS retried, CAST(least(n, 5) * 65 AS BIGINT) AS waited FROM (SELECT event_id, row_number() OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY ts, event_id) AS n FROM events WHERE event_type = 'error')""")
def retry_budget(spark, sf_dir):
    """Failures of a run in order: five are retried after a wait of 65 seconds each, later ones are given up."""
    e = table(spark, sf_dir, "events").filter("event_type = 'error'").withColumn("day", F.col("ts").cast("date"))
    n = rank.ranked(e, ["user_id", "day"], F.asc("ts"), F.asc("event_id"), out="n")
    return n.select("event_id", (F.col("n") <= 5).alias("retried"), (F.least("n", F.lit(5)) * 65).cast("long").alias("waited"))


@query("""WITH s AS (SELECT user_id AS cell, arg_max(value, (ts, event_id)) AS value FROM events WHERE event_type = 'view' GROUP BY 1) SELECT c_custkey AS cell, value, value IS NULL AS missing FROM customer LEFT JOIN s ON cell = c_custkey""")
def frozen_cache(spark, sf_dir):
    """Cells from the newest snapshot of any age, nothing fetched and nothing written; those without one are missing."""
    e = table(spark, sf_dir, "events").filter("event_type = 'view'")
    newest = e.groupBy(F.col("user_id").alias("cell")).agg(F.max(F.struct("ts", "event_id", "value"))["value"].alias("value"))
    asked = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("cell"))
    return asked.join(newest, "cell", "left").select("cell", "value", F.col("value").isNull().alias("missing"))


@query(f"""WITH {MODELS}, r AS (SELECT site, night, count(*) FILTER (source = 'MSM') > count(*) / 2 AS fine FROM mm GROUP BY site, night), n AS (SELECT *, row_number() OVER (PARTITION BY site ORDER BY night) - 1 AS i FROM r)
    SELECT site, min(i) FILTER (NOT fine) AS horizon FROM n GROUP BY site""")
def regime_horizon(spark, sf_dir):
    """The first night of each site that the finer model doesn't carry, by its number from 0; null if it carries all."""
    nights = series.regime(merged_models(spark, sf_dir), ["site", "night"])
    n = rank.ranked(nights, ["site"], F.asc("night"), out="i")
    return n.groupBy("site").agg(F.min(F.when(F.col("regime") != "MSM", F.col("i") - 1)).cast("long").alias("horizon"))
