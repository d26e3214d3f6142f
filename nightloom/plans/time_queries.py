"""Queries over forecast series and nights, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from nightloom.functions import clock
from nightloom.operators import audit, cloud, rank, runs, series
from nightloom.plans.inputs import SITE_NIGHTS, hourly, hourly_sql, site_nights, table, text_time

QUERIES: dict = {}
SQL: dict = {}


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return put


def night_hours(spark: SparkSession, sf_dir: str) -> DataFrame:
    spine = series.hour_spine(site_nights(spark, sf_dir), "lo", "hi")
    return spine.join(hourly(spark, sf_dir), ["site", "hour"], "left")


MARKED = f"""{SITE_NIGHTS},
    f AS (SELECT sp.*, h.cloud, coalesce(h.cloud <= 30, false) AS ok FROM sp LEFT JOIN h USING (site, hour)),
    m AS (SELECT *, sum(CASE WHEN ok THEN 0 ELSE 1 END) OVER (PARTITION BY site, night ORDER BY hour) AS run, lead(hour) OVER (PARTITION BY site, night ORDER BY hour) AS nxt FROM f)"""
CLEAR = f"""{MARKED},
    g AS (SELECT site, night, lo, hi, run, min(hour) AS a, max(hour) AS b, avg(cloud) AS mean FROM m WHERE ok GROUP BY ALL),
    c AS (SELECT site, night, greatest(a, lo) AS s, least(b + INTERVAL 1 HOUR, hi) AS e, mean FROM g),
    l AS (SELECT *, epoch_us(e - s) / 3.6e9 AS hours FROM c WHERE e > s),
    clear AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY site, night ORDER BY hours DESC, s) AS n FROM l) WHERE n = 1 AND hours >= 1)"""


def clear_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.longest_clear(night_hours(spark, sf_dir), ["site", "night"], "hour", "cloud", "lo", "hi")


@query(f"""WITH {CLEAR} SELECT site, CAST(night AS VARCHAR) AS night, strftime(s, '%Y-%m-%d %H:%M') AS start, strftime(e, '%Y-%m-%d %H:%M') AS "end", hours, round(mean, 6) AS mean FROM clear""")
def longest_clear_window(spark, sf_dir):
    return clear_windows(spark, sf_dir).select("site", F.col("night").cast("string"), text_time("start"), text_time("end"), "hours", F.round("mean", 6).alias("mean"))


@query(f"""WITH {MARKED}, g AS (SELECT site, night, run, min(hour) AS s, max(hour) AS l, max(coalesce(nxt, hour)) AS e, count(*) AS n FROM m WHERE ok GROUP BY ALL)
    SELECT site, CAST(night AS VARCHAR) AS night, strftime(s, '%Y-%m-%d %H:%M') AS start, strftime(l, '%Y-%m-%d %H:%M') AS last, strftime(e, '%Y-%m-%d %H:%M') AS "end", n FROM g""")
def all_runs(spark, sf_dir):
    r = runs.all_runs(night_hours(spark, sf_dir), ["site", "night"], "hour", F.col("cloud") <= 30)
    return r.select("site", F.col("night").cast("string"), text_time("start"), text_time("last"), text_time("end"), "n")


@query(f"""WITH {MARKED}, g AS (SELECT site, night, run, min(hour) AS s, max(coalesce(nxt, hour)) AS e FROM m WHERE ok GROUP BY ALL),
    l AS (SELECT *, epoch_us(e - s) / 3.6e9 AS hours FROM g)
    SELECT site, CAST(night AS VARCHAR) AS night, strftime(s, '%Y-%m-%d %H:%M') AS start, strftime(e, '%Y-%m-%d %H:%M') AS "end", hours
    FROM (SELECT *, row_number() OVER (PARTITION BY site, night ORDER BY hours DESC, s) AS n FROM l WHERE hours > 0) WHERE n = 1""")
def longest_sampled_window(spark, sf_dir):
    r = runs.longest_sampled(night_hours(spark, sf_dir), ["site", "night"], "hour", F.col("cloud") <= 30)
    return r.select("site", F.col("night").cast("string"), text_time("start"), text_time("end"), "hours")


@query(f"""WITH {MARKED}, b AS (SELECT *, min(hour) OVER (PARTITION BY site, night) AS t0, max(hour) OVER (PARTITION BY site, night) AS t1 FROM m),
    r AS (SELECT *, min(hour) OVER w AS s, max(hour) OVER w AS l, max(coalesce(nxt, hour)) OVER w AS e FROM b WHERE ok WINDOW w AS (PARTITION BY site, night, run))
    SELECT site, CAST(night AS VARCHAR) AS night, strftime(s, '%Y-%m-%d %H:%M') AS start, strftime(e, '%Y-%m-%d %H:%M') AS "end", strftime(hour, '%Y-%m-%d %H:%M') AS peak_time, cloud AS peak, s > t0 AS rises, l < t1 AS sets
    FROM (SELECT *, row_number() OVER (PARTITION BY site, night, run ORDER BY cloud DESC, hour) AS n FROM r) WHERE n = 1""")
def peak_in_runs(spark, sf_dir):
    r = runs.peak_in_runs(night_hours(spark, sf_dir), ["site", "night"], "hour", F.col("cloud") <= 30, "cloud")
    return r.select("site", F.col("night").cast("string"), text_time("start"), text_time("end"), text_time("peak_time"), "peak", "rises", "sets")


@query(f"""WITH e AS (SELECT user_id AS site, ts FROM events WHERE event_type = 'error'),
    d AS (SELECT *, CASE WHEN ts > lag(ts) OVER (PARTITION BY site ORDER BY ts) + INTERVAL 3 HOUR THEN 1 ELSE 0 END AS new FROM e),
    g AS (SELECT *, sum(new) OVER (PARTITION BY site ORDER BY ts) AS k FROM d)
    SELECT site, strftime(min(ts), '%Y-%m-%d %H:%M') AS start, strftime(max(ts), '%Y-%m-%d %H:%M') AS last, count(*) AS runs FROM g GROUP BY site, k""")
def merge_gap_runs(spark, sf_dir):
    e = table(spark, sf_dir, "events").filter("event_type = 'error'").select(F.col("user_id").alias("site"), F.col("ts").alias("s"), F.col("ts").alias("l"))
    return runs.merged_runs(e, ["site"], "s", "l", "3 hours").select("site", text_time("start"), text_time("last"), "runs")


@query(f"""WITH {SITE_NIGHTS} SELECT site, CAST(night AS VARCHAR) AS night, strftime(hour, '%Y-%m-%d %H:%M') AS hour, cloud FROM sp LEFT JOIN h USING (site, hour)""")
def hour_spine_fill(spark, sf_dir):
    return night_hours(spark, sf_dir).select("site", F.col("night").cast("string"), text_time("hour"), "cloud")


def merged_models(spark, sf_dir):
    spine = series.hour_spine(site_nights(spark, sf_dir), "lo", "hi")
    return series.two_sources(spine, hourly(spark, sf_dir, "view"), hourly(spark, sf_dir, "click"), ["site", "hour"], ["cloud"])


MODELS = f"""{SITE_NIGHTS}, {hourly_sql("va", "view")}, {hourly_sql("vb", "click")},
    mm AS (SELECT sp.*, coalesce(va.cloud, vb.cloud) AS cloud, CASE WHEN va.cloud IS NOT NULL THEN 'MSM' WHEN vb.cloud IS NOT NULL THEN 'ECMWF' ELSE 'N/A' END AS source
        FROM sp LEFT JOIN va USING (site, hour) LEFT JOIN vb USING (site, hour))"""


@query(f"""WITH {MODELS} SELECT site, CAST(night AS VARCHAR) AS night, strftime(hour, '%Y-%m-%d %H:%M') AS hour, cloud, source FROM mm""")
def two_source_merge(spark, sf_dir):
    return merged_models(spark, sf_dir).select("site", F.col("night").cast("string"), text_time("hour"), "cloud", "source")


@query(f"""WITH {MODELS} SELECT CAST(night AS VARCHAR) AS night, CASE WHEN count(*) FILTER (source = 'MSM') > count(*) / 2 THEN 'MSM' ELSE 'ECMWF' END AS regime, site FROM mm GROUP BY site, night""")
def majority_regime(spark, sf_dir):
    return series.regime(merged_models(spark, sf_dir), ["site", "night"]).select("site", F.col("night").cast("string"), "regime")


@query(f"""WITH {MODELS} SELECT site, CAST(night AS VARCHAR) AS night, round(avg(CASE WHEN cloud <= 30 THEN 100.0 WHEN cloud IS NOT NULL THEN 0.0 END), 6) AS clear_pct, round(avg(cloud), 6) AS mean, max(cloud) AS most, min(cloud) AS least
    FROM mm GROUP BY 1, 2""")
def clear_sky_pct(spark, sf_dir):
    c = F.col("cloud")
    stats = [series.stat_of(c, s) for s in ("mean", "max", "min")]
    out = merged_models(spark, sf_dir).groupBy("site", "night").agg(F.round(series.clear_share(c), 6).alias("clear_pct"), F.round(stats[0], 6).alias("mean"), stats[1].alias("most"), stats[2].alias("least"))
    return out.withColumn("night", F.col("night").cast("string"))


@query(f"""WITH {MODELS} SELECT DISTINCT site, CAST(night AS VARCHAR) AS night FROM mm WHERE cloud < 10""")
def area_prescreen(spark, sf_dir):
    """Nights of areas with any hour under the threshold: a semi join stops at the first."""
    hours = merged_models(spark, sf_dir).filter("cloud < 10").select("site", "night")
    return site_nights(spark, sf_dir).join(hours, ["site", "night"], "left_semi").select("site", F.col("night").cast("string"))


def nights(spark, sf_dir):
    """The dates of the events as nights with derived sun events and hours, some of them null."""
    n = F.col("id")
    at = lambda h: F.when(n % 5 != 0, F.timestamp_seconds(1704067200 + n * 86400 + h * 3600))
    dates = table(spark, sf_dir, "events").select(F.col("ts").cast("date").alias("night")).distinct()
    return dates.withColumn("id", F.datediff("night", F.lit("2024-01-01").cast("date"))).select(
        "night", at(17).alias("sunset"), at(30).alias("sunrise"),
        F.when(n % 7 != 3, at(19)).alias("dark_start"), at(28).alias("dark_end"), (n * 37 % 11 / 2.0).alias("moon_free_hours"),
    )


@query("""WITH n AS (SELECT id, CAST(DATE '2024-01-01' + CAST(id AS INTEGER) AS DATE) AS night, id % 5 <> 0 AS sun, id % 5 <> 0 AND id % 7 <> 3 AS dark, id * 37 % 11 / 2.0 AS h FROM (SELECT DISTINCT date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS id FROM events)),
    r AS (SELECT *, CASE WHEN NOT sun THEN 'no_sunset_or_sunrise' WHEN NOT dark THEN 'no_astronomical_darkness' WHEN h <= 0 THEN 'no_moon_free_window' END AS reason FROM n),
    k AS (SELECT *, CASE WHEN reason IS NULL THEN h WHEN reason = 'no_moon_free_window' THEN 0.0 END AS hours, row_number() OVER (PARTITION BY reason IS NULL ORDER BY h DESC, night) AS n FROM r)
    SELECT CAST(night AS VARCHAR) AS night, hours AS moon_free_hours, CASE WHEN reason IS NULL AND n > 6 THEN 'not_in_top_n' ELSE reason END AS reason, CASE WHEN reason IS NULL THEN CAST(n AS INTEGER) END AS rank FROM k""")
def topn_not_selected_reason(spark, sf_dir):
    return rank.kept_nights(nights(spark, sf_dir)).select(F.col("night").cast("string"), "moon_free_hours", "reason", "rank")


@query(f"""WITH p AS (SELECT user_id AS k, ts FROM events WHERE event_type = 'purchase'), s AS (SELECT user_id AS k, ts FROM events WHERE event_type = 'signup')
    SELECT p.k, strftime(p.ts, '%Y-%m-%d %H:%M') AS at, strftime(min(s.ts), '%Y-%m-%d %H:%M') AS ts FROM p LEFT JOIN s ON s.k = p.k AND s.ts > p.ts GROUP BY p.k, p.ts""")
def first_event_after(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("k"), "ts", "event_type")
    a, b = e.filter("event_type = 'purchase'").select("k", F.col("ts").alias("at")), e.filter("event_type = 'signup'").select("k", "ts")
    return runs.first_after(a, b, ["k"], "at", "ts").select("k", text_time("at"), text_time("ts"))


@query("""WITH p AS (SELECT user_id AS k, ts AS at FROM events WHERE event_type = 'purchase'), v AS (SELECT user_id AS k, ts, value FROM events WHERE event_type = 'view')
    SELECT p.k, strftime(p.at, '%Y-%m-%d %H:%M') AS at, strftime(v.ts, '%Y-%m-%d %H:%M') AS ts, v.value FROM p ASOF LEFT JOIN v ON p.k = v.k AND p.at >= v.ts""")
def asof_backward(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("k"), "ts", "value", "event_type")
    a, b = e.filter("event_type = 'purchase'").select("k", F.col("ts").alias("at")), e.filter("event_type = 'view'").select("k", "ts", "value")
    return runs.last_before(a, b, ["k"], "at", "ts", "value").select("k", text_time("at"), text_time("ts"), "value")


@query("""WITH e AS (SELECT user_id AS k, date_trunc('day', ts) AS day, ts, value - 50 AS v FROM events), b AS (SELECT *, lag(v) OVER (PARTITION BY k, day ORDER BY ts) AS p FROM e),
    c AS (SELECT k, day, ts, CASE WHEN p <= 0 AND v > 0 THEN 'rise' WHEN p > 0 AND v <= 0 THEN 'set' END AS kind FROM b)
    SELECT k, strftime(day, '%Y-%m-%d %H:%M') AS day, kind, strftime(min(ts), '%Y-%m-%d %H:%M') AS at FROM c WHERE kind IS NOT NULL GROUP BY 1, 2, 3""")
def rise_set(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("k"), F.date_trunc("day", F.col("ts").cast("timestamp")).alias("day"), "ts", (F.col("value") - 50).alias("v"))
    return runs.sign_changes(e, ["k", "day"], "ts", "v").select("k", text_time("day"), "kind", text_time("at"))


@query("""WITH e AS (SELECT user_id, ts, CASE event_type WHEN 'view' THEN 40.0::DOUBLE ELSE 80.0::DOUBLE END AS cost FROM events),
    s AS (SELECT *, sum(cost) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 6 HOUR PRECEDING AND CURRENT ROW) AS spent FROM e)
    SELECT user_id, strftime(ts, '%Y-%m-%d %H:%M') AS ts, spent, spent > 300 AS over FROM s""")
def sliding_budget(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", "ts", F.when(F.col("event_type") == "view", 40.0).otherwise(80.0).alias("cost"))
    return audit.over_budget(e, ["user_id"], "ts", "cost", seconds=6 * 3600).select("user_id", text_time("ts"), "spent", "over")


@query("""SELECT o_custkey % 50 AS cell, count(*) AS total, count(*) FILTER (o_orderstatus = 'P' AND o_orderkey % 4 = 0) AS failed, bool_or(o_orderkey % 997 = 0) AS limited,
        round(count(*) FILTER (o_orderstatus = 'P' AND o_orderkey % 4 = 0) / count(*), 6) AS rate,
        CASE WHEN bool_or(o_orderkey % 997 = 0) OR (count(*) FILTER (o_orderstatus = 'P' AND o_orderkey % 4 = 0) > 0 AND count(*) FILTER (o_orderstatus = 'P' AND o_orderkey % 4 = 0) / count(*) >= 0.20) THEN 'abort'
             WHEN count(*) FILTER (o_orderstatus = 'P' AND o_orderkey % 4 = 0) > 0 THEN 'partial' ELSE 'ok' END AS status FROM orders GROUP BY 1""")
def fetch_summary(spark, sf_dir):
    o = table(spark, sf_dir, "orders").withColumn("cell", F.col("o_custkey") % 50)
    s = audit.summary(o, ["cell"], (F.col("o_orderstatus") == "P") & (F.col("o_orderkey") % 4 == 0), F.col("o_orderkey") % 997 == 0)
    return s.withColumn("rate", F.round("rate", 6))


@query("""WITH r AS (SELECT o_orderstatus, CASE o_orderkey % 4 WHEN 0 THEN 'http 429: daily limit' WHEN 1 THEN ' : x' WHEN 2 THEN o_orderpriority || ': late' END AS reason FROM orders)
    SELECT o_orderstatus, coalesce(nullif(trim(split_part(reason, ':', 1)), ''), 'unknown') AS kind, count(*) AS n FROM r GROUP BY 1, 2""")
def failures_by_reason(spark, sf_dir):
    k = F.col("o_orderkey") % 4
    reason = F.when(k == 0, "http 429: daily limit").when(k == 1, " : x").when(k == 2, F.concat("o_orderpriority", F.lit(": late")))
    return audit.by_reason(table(spark, sf_dir, "orders").withColumn("reason", reason), ["o_orderstatus"], "reason")


@query("""SELECT o_orderkey, CASE WHEN r LIKE '%daily%' THEN 'daily' WHEN r LIKE '%hourly%' THEN 'hourly' WHEN r LIKE '%minutely%' THEN 'minutely' ELSE 'unknown' END AS kind,
        greatest(1.0, (o_orderkey % 40) / 10.0) * greatest(1.0, (o_orderkey % 20) / 14.0) AS weight
    FROM (SELECT o_orderkey, ['Daily API limit', 'hourly or daily', 'Hourly', 'minutely', 'other'][1 + o_orderkey % 5] AS x, lower(x) AS r FROM orders)""")
def request_policy(spark, sf_dir):
    k = F.col("o_orderkey")
    texts = F.array(*map(F.lit, ("Daily API limit", "hourly or daily", "Hourly", "minutely", "other")))
    return table(spark, sf_dir, "orders").select(k, clock.rate_limit(F.get(texts, (k % 5).cast("int"))).alias("kind"), audit.weight(k % 40, k % 20).alias("weight"))


@query("""WITH s AS (SELECT user_id % 50 AS cell, event_type AS model, ts, value FROM events WHERE event_type IN ('view', 'click')),
    f AS (SELECT * FROM s WHERE ts > TIMESTAMP '2024-01-30 12:00:00' - CASE model WHEN 'view' THEN INTERVAL 3 HOUR ELSE INTERVAL 6 HOUR END)
    SELECT cell, model, strftime(ts, '%Y-%m-%d %H:%M') AS ts, value FROM (SELECT *, row_number() OVER (PARTITION BY cell, model ORDER BY ts DESC) AS n FROM f) WHERE n = 1""")
def cached_snapshot(spark, sf_dir):
    s = table(spark, sf_dir, "events").filter(F.col("event_type").isin("view", "click")).select((F.col("user_id") % 50).alias("cell"), F.col("event_type").alias("model"), "ts", "value")
    hours = F.when(F.col("model") == "view", 3).otherwise(6)
    return series.latest_snapshot(s, ["cell", "model"], "ts", F.lit("2024-01-30 12:00:00").cast("timestamp"), hours).select("cell", "model", text_time("ts"), "value")


@query("""WITH v AS (SELECT DISTINCT user_id AS k FROM events WHERE event_type = 'view'), c AS (SELECT DISTINCT user_id AS k FROM events WHERE event_type = 'signup' AND event_id % 10 = 0) SELECT k FROM v ANTI JOIN c USING (k)""")
def missing_cells(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    wanted = e.filter("event_type = 'view'").select(F.col("user_id").alias("k")).distinct()
    return wanted.join(e.filter("event_type = 'signup' and event_id % 10 = 0").select(F.col("user_id").alias("k")), "k", "left_anti")


@query("""WITH own AS (SELECT c_custkey AS k, c_acctbal AS v FROM customer WHERE c_custkey % 3 = 0), old AS (SELECT c_custkey AS k, -1.0 AS v FROM customer WHERE c_custkey % 2 = 0)
    SELECT k, coalesce(own.v, old.v) AS v FROM own FULL JOIN old USING (k)""")
def merge_own_wins(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    own, old = c.filter("c_custkey % 3 = 0").select(F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("v")), c.filter("c_custkey % 2 = 0").select(F.col("c_custkey").alias("k"), F.lit(-1.0).alias("v"))
    return series.merged_by_key(old, own, ["k"])


@query("""WITH a AS (SELECT o_orderstatus AS s, o_custkey % 100 AS k FROM orders WHERE o_orderkey % 2 = 0), b AS (SELECT o_orderstatus AS s, o_custkey % 100 AS k FROM orders WHERE o_orderkey % 2 = 1)
    SELECT *, 'first' AS side FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b) UNION ALL SELECT *, 'second' AS side FROM (SELECT * FROM b EXCEPT ALL SELECT * FROM a)""")
def compare_runs(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_orderstatus").alias("s"), (F.col("o_custkey") % 100).alias("k"), "o_orderkey")
    return series.differences(o.filter("o_orderkey % 2 = 0").drop("o_orderkey"), o.filter("o_orderkey % 2 = 1").drop("o_orderkey"))


LEVEL_SQL = """lv AS (SELECT c_custkey AS id, [{'h': CAST(100 + i * 1100 AS DOUBLE), 'c': CASE WHEN (c_custkey * 17 + i * 29) % 3 = 0 THEN 0.0 ELSE CAST((c_custkey * 17 + i * 29) % 101 AS DOUBLE) END} FOR i IN range(10)] AS levels, CAST(c_custkey * 53 % 3776 AS DOUBLE) AS z FROM customer)"""


def levels(spark, sf_dir):
    k = F.col("c_custkey")
    c = lambda i: (k * 17 + i * 29) % 101
    at = F.transform(F.sequence(F.lit(0), F.lit(9)), lambda i: F.struct((100 + i * 1100).cast("double").alias("h"), F.when((k * 17 + i * 29) % 3 == 0, 0.0).otherwise(c(i).cast("double")).alias("c")))
    return table(spark, sf_dir, "customer").select(k.alias("id"), at.alias("levels"), (k * 53 % 3776).cast("double").alias("z"))


@query(f"""WITH {LEVEL_SQL}, o AS (SELECT id, list_reduce([x.c FOR x IN levels], lambda a, x: {{'clear': CASE WHEN x > 0 THEN a.clear ELSE a.clear * (1 - least(a.cur, 100) / 100) END, 'cur': CASE WHEN x > 0 THEN greatest(a.cur, x) ELSE 0.0 END}}, {{'clear': 1.0::DOUBLE, 'cur': 0.0::DOUBLE}}) AS a FROM lv)
    SELECT id, round(100 * (1 - a.clear * (1 - least(a.cur, 100) / 100)), 6) AS overlap FROM o""")
def max_random_overlap(spark, sf_dir):
    return levels(spark, sf_dir).select("id", F.round(cloud.overlap(F.transform("levels", lambda x: x["c"])), 6).alias("overlap"))


@query(f"""WITH {LEVEL_SQL}, u AS (SELECT id, z, unnest(levels) AS x, generate_subscripts(levels, 1) AS i FROM lv),
    b AS (SELECT id, z, x.h AS h, x.c AS c, CASE WHEN lead(x.h) OVER w IS NULL THEN x.h + (x.h - lag(x.h) OVER w) / 2 ELSE (x.h + lead(x.h) OVER w) / 2 END AS up FROM u WINDOW w AS (PARTITION BY id ORDER BY i)),
    f AS (SELECT *, CASE WHEN z <= h THEN 1.0 WHEN z >= up THEN 0.0 ELSE (up - z) / (up - h) END AS w FROM b)
    SELECT id, CASE WHEN sum(w) > 1e-9 THEN round(sum(c * w) / sum(w), 6) END AS obstruction, CASE WHEN sum(1 - w) > 1e-9 THEN round(sum(c * (1 - w)) / sum(1 - w), 6) END AS sea FROM f GROUP BY id""")
def levels_only_obstruction(spark, sf_dir):
    none = F.lit(None).cast("double")
    out = levels(spark, sf_dir).select("id", cloud.obstruction(F.col("levels"), none, none, none, none, F.col("z")).alias("o"))
    return out.select("id", F.round("o.obstruction", 6).alias("obstruction"), F.round("o.sea", 6).alias("sea"))


def _overlap_sql(x: str) -> str:
    return f"list_reduce({x}, lambda a, x: {{'clear': CASE WHEN x > 0 THEN a.clear ELSE a.clear * (1 - least(a.cur, 100) / 100) END, 'cur': CASE WHEN x > 0 THEN greatest(a.cur, x) ELSE 0.0 END}}, {{'clear': 1.0::DOUBLE, 'cur': 0.0::DOUBLE}})"


def _total_sql(a: str) -> str:
    return f"100 * (1 - {a}.clear * (1 - least({a}.cur, 100) / 100))"


@query(f"""WITH {LEVEL_SQL}, n AS (SELECT id, levels, z, CAST(id * 7 % 101 AS DOUBLE) AS low, CAST(id * 11 % 101 AS DOUBLE) AS mid, CASE WHEN id % 5 = 0 THEN 0.0 ELSE CAST(id * 13 % 101 AS DOUBLE) END AS high, CAST(id * 19 % 101 AS DOUBLE) AS total FROM lv),
    u AS (SELECT id, z, unnest(levels) AS x, generate_subscripts(levels, 1) AS i FROM lv),
    b AS (SELECT id, z, x.h AS h, x.c AS c, CASE WHEN lead(x.h) OVER w IS NULL THEN x.h + (x.h - lag(x.h) OVER w) / 2 ELSE (x.h + lead(x.h) OVER w) / 2 END AS up FROM u WINDOW w AS (PARTITION BY id ORDER BY i)),
    f AS (SELECT *, CASE WHEN z <= h THEN 1.0 WHEN z >= up THEN 0.0 ELSE (up - z) / (up - h) END AS w FROM b),
    g AS (SELECT id, sum(c * w) FILTER (h < 3000) AS wl, sum(c) FILTER (h < 3000) AS ml, sum(c * w) FILTER (h >= 3000 AND h < 8000) AS wm, sum(c) FILTER (h >= 3000 AND h < 8000) AS mm, sum(c * w) FILTER (h >= 8000 AND h < 13000) AS wh, sum(c) FILTER (h >= 8000 AND h < 13000) AS mh FROM f GROUP BY id),
    q AS (SELECT n.*, CASE WHEN ml > 1e-9 THEN wl / ml WHEN z <= 0 THEN 1.0 WHEN z >= 3000 THEN 0.0 ELSE (3000 - z) / 3000 END AS fl, CASE WHEN mm > 1e-9 THEN wm / mm WHEN z <= 3000 THEN 1.0 WHEN z >= 8000 THEN 0.0 ELSE (8000 - z) / 5000 END AS fm,
        CASE WHEN mh > 1e-9 THEN wh / mh WHEN z <= 8000 THEN 1.0 WHEN z >= 13000 THEN 0.0 ELSE (13000 - z) / 5000 END AS fh FROM n JOIN g USING (id)),
    o AS (SELECT *, {_overlap_sql("[low, mid, high]")} AS r, {_overlap_sql("[low * fl, mid * fm, high * fh]")} AS p, {_overlap_sql("[low * (1 - fl), mid * (1 - fm), high * (1 - fh)]")} AS s FROM q)
    SELECT id, round(least(greatest(CASE WHEN {_total_sql("r")} <= 1e-9 THEN CASE WHEN least(fl, fm, fh) >= 1 - 1e-9 THEN total ELSE total * greatest(fl, fm, fh) END ELSE total * ({_total_sql("p")}) / ({_total_sql("r")}) END, 0), 100), 6) AS obstruction,
        round(least(greatest({_total_sql("s")}, 0), 100), 6) AS sea FROM o""")
def sky_obstruction(spark, sf_dir):
    k = F.col("id")
    d = lambda n: (k * n % 101).cast("double")
    out = levels(spark, sf_dir).select("id", cloud.obstruction(F.col("levels"), d(7), d(11), F.when(k % 5 == 0, 0.0).otherwise(d(13)), d(19), F.col("z")).alias("o"))
    return out.select("id", F.round("o.obstruction", 6).alias("obstruction"), F.round("o.sea", 6).alias("sea"))


@query("""SELECT o_orderkey, lpad(CAST(m // 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST(m % 60 AS VARCHAR), 2, '0') AS at, ((e - m + 1440) % 1440) / 60.0 AS hours, CAST(round_even(m / 30.0, 0) * 30 AS INTEGER) AS half,
        CASE o_orderkey % 5 WHEN 0 THEN d >= 0 AND d < 30 WHEN 1 THEN d >= -30 AND d < 0 WHEN 2 THEN abs(d) <= 30 WHEN 3 THEN d >= 0 AND d < 60 ELSE abs(d) <= 10 END AS fits
    FROM (SELECT o_orderkey, CAST(o_orderkey * 7 % 1440 AS INTEGER) AS m, CAST(o_orderkey * 11 % 1440 AS INTEGER) AS e, (e - m + 1440 + 720) % 1440 - 720 AS d FROM orders)""")
def time_phrase_match(spark, sf_dir):
    k = F.col("o_orderkey")
    m, e = (k * 7 % 1440).cast("int"), (k * 11 % 1440).cast("int")
    kind = F.get(F.array(*map(F.lit, ("after", "before", "about", "hour", "exact"))), (k % 5).cast("int"))
    return table(spark, sf_dir, "orders").select(k, clock.hhmm(m).alias("at"), clock.window_hours(clock.hhmm(m), clock.hhmm(e)).alias("hours"), clock.half_hour(m).alias("half"), clock.phrase_fits(kind, m, e).alias("fits"))


@query("""SELECT event_id, strftime(to_timestamp(floor(epoch(ts) / 1200) * 1200) AT TIME ZONE 'UTC', '%Y-%m-%d %H:%M') AS lo, strftime(to_timestamp(ceil(floor(epoch(ts)) / 1200) * 1200) AT TIME ZONE 'UTC', '%Y-%m-%d %H:%M') AS hi FROM events""")
def time_grid(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", clock.floor_to(F.col("ts"), 20).alias("lo"), clock.ceil_to(F.col("ts"), 20).alias("hi")).select("event_id", text_time("lo"), text_time("hi"))


@query("""WITH l AS (SELECT max(ts) AS latest FROM events), o AS (SELECT unnest([0, 60, 120, 360]) AS back) SELECT back, strftime(max(ts), '%Y-%m-%d %H:%M') AS at FROM o, l, events WHERE ts <= latest - back * INTERVAL 1 MINUTE GROUP BY back""")
def recent_basetimes(spark, sf_dir):
    """The latest time at or before each offset from the newest: conditional maxima in one pass."""
    e = table(spark, sf_dir, "events").select(F.unix_micros(F.col("ts").cast("timestamp")).alias("t"))
    latest = e.agg(F.max("t").alias("latest"))
    backs = (0, 60, 120, 360)
    found = e.crossJoin(F.broadcast(latest)).agg(*(F.max(F.when(F.col("t") <= F.col("latest") - b * 60_000_000, F.col("t"))).alias(f"m{b}") for b in backs))
    rows = found.select(F.explode(F.array(*(F.struct(F.lit(b).alias("back"), F.timestamp_micros(f"m{b}").alias("at")) for b in backs))).alias("r"))
    return rows.select("r.back", F.date_format("r.at", "yyyy-MM-dd HH:mm").alias("at"))


@query("""WITH d AS (SELECT user_id, CAST(ts AS DATE) AS day, max(value) AS v FROM events GROUP BY 1, 2), w AS (SELECT *, first_value(v) OVER p AS a, lag(v) OVER p AS b FROM d WINDOW p AS (PARTITION BY user_id ORDER BY day))
    SELECT user_id, CAST(day AS VARCHAR) AS day, CASE WHEN b IS NULL THEN 'first' WHEN v - a > 5 THEN 'up' WHEN v - a < -5 THEN 'down' ELSE 'flat' END AS trend FROM w""")
def trend(spark, sf_dir):
    d = table(spark, sf_dir, "events").groupBy("user_id", F.col("ts").cast("date").alias("day")).agg(F.max("value").alias("v"))
    w = Window.partitionBy("user_id").orderBy("day")
    change = F.col("v") - F.first("v").over(w)
    kind = F.when(F.lag("v").over(w).isNull(), "first").when(change > 5, "up").when(change < -5, "down").otherwise("flat")
    return d.select("user_id", F.col("day").cast("string"), kind.alias("trend"))


@query("""SELECT c_custkey, CASE WHEN list_contains(b, m) THEN 'best' WHEN list_contains(b, m % 12 + 1) THEN 'early' WHEN list_contains(b, (m + 10) % 12 + 1) THEN 'late' ELSE 'off' END AS season, CAST(round_even(p / 45.0, 0) % 8 AS INTEGER) AS icon
    FROM (SELECT c_custkey, CAST(c_custkey % 12 + 1 AS INTEGER) AS m, [CAST(c_custkey * 5 % 12 + 1 AS INTEGER), CAST(c_custkey * 7 % 12 + 1 AS INTEGER)] AS b, CAST(c_custkey * 15 % 360 AS DOUBLE) AS p FROM customer)""")
def seasons(spark, sf_dir):
    k = F.col("c_custkey")
    month = lambda n: (k * n % 12 + 1).cast("int")
    return table(spark, sf_dir, "customer").select(k, clock.season(F.array(month(5), month(7)), month(1)).alias("season"), clock.moon_icon((k * 15 % 360).cast("double")).alias("icon"))


@query("""SELECT DISTINCT CAST(d AS VARCHAR) AS today, CAST(unnest(CASE WHEN isodow(d) = 7 THEN [d] ELSE [CAST(d + CAST(6 - isodow(d) AS INTEGER) AS DATE), CAST(d + CAST(7 - isodow(d) AS INTEGER) AS DATE)] END) AS VARCHAR) AS night FROM (SELECT CAST(o_orderdate AS DATE) AS d FROM orders)""")
def weekend_nights(spark, sf_dir):
    d = table(spark, sf_dir, "orders").select(F.col("o_orderdate").cast("date").alias("d")).distinct()
    return d.select(F.col("d").cast("string").alias("today"), F.explode(clock.weekend(F.col("d"))).alias("night")).select("today", F.col("night").cast("string"))
