"""Queries that hold texts against tables. The SQL doesn't read the texts: it derives what is wrong from what they were made of."""

from __future__ import annotations

from pyspark.sql import functions as F

from nightloom.functions import clock, geo
from nightloom.operators import terrain, textcheck
from nightloom.plans import inputs
from nightloom.plans.inputs import HORIZONS, table

QUERIES: dict = {}
SQL: dict = {}

NAMES = ["Vega", "Moon", "Moon halo", "Milky Way", "Milky Way centre"]
VERBS = ["rises", "sets", "peaks"]
PHRASES = ["soon after", "shortly before", "around", "in the hour of", "at"]


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return put


def pick(values: list, i):
    return F.get(F.array(*map(F.lit, values)), i.cast("int"))


def orders(spark, sf_dir):
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), "o_custkey")


@query(f"""WITH p AS (SELECT o_orderkey AS id, 0 AS clause, o_orderkey % 5 AS n, o_orderkey % 3 AS v, o_orderkey * 7 % 1440 AS m, o_orderkey // 5 % 5 AS w FROM orders UNION ALL SELECT o_orderkey, 1, (o_orderkey * 3 + 1) % 5, (o_orderkey + 1) % 3, o_orderkey * 11 % 1440, 4 FROM orders),
    d AS (SELECT *, ((n * 311 + v * 479) % 1440 - m + 1440 + 720) % 1440 - 720 AS d FROM p)
    SELECT id, CAST(clause AS INTEGER) AS clause, {NAMES}[n + 1] AS name, {VERBS}[v + 1] AS verb, CAST(m AS INTEGER) AS minute FROM d
    WHERE NOT CASE w WHEN 0 THEN d >= 0 AND d < 30 WHEN 1 THEN d >= -30 AND d < 0 WHEN 2 THEN abs(d) <= 30 WHEN 3 THEN d >= 0 AND d < 60 ELSE abs(d) <= 10 END""")
def sentence_check(spark, sf_dir):
    """Times in clauses that name several objects go with the nearest object and verb; those that no event fits are found."""
    k = F.col("id")
    text = F.concat(
        F.lit("Past the "), pick(NAMES, (k * 2 + 3) % 5), F.lit(" the "), pick(NAMES, k % 5), F.lit(" "), pick(VERBS, k % 3), F.lit(" "), pick(PHRASES, F.floor(k / 5) % 5), F.lit(" "), clock.hhmm(k * 7 % 1440),
        F.lit(", while the "), pick(NAMES, (k * 3 + 1) % 5), F.lit(" "), pick(VERBS, (k + 1) % 3), F.lit(" at "), clock.hhmm(k * 11 % 1440), F.lit("."),
    )
    events = spark.range(15).select(pick(NAMES, F.floor(F.col("id") / 3)).alias("name"), pick(VERBS, F.col("id") % 3).alias("verb"), ((F.floor(F.col("id") / 3) * 311 + F.col("id") % 3 * 479) % 1440).cast("int").alias("event"))
    claimed = textcheck.timed_claims(orders(spark, sf_dir).select("id", text.alias("text")), ["id"], "text", NAMES, VERBS)
    return textcheck.without_event(claimed, F.broadcast(events), ["id"]).select("id", "clause", "name", "verb", "minute")  # 15 events


def frames(spark):
    """A frame every 20 minutes for each of five objects."""
    k = F.col("id")
    f, n = k % 72, F.floor(k / 72)
    return spark.range(360).select(pick(NAMES, n).alias("name"), (f * 20).cast("int").alias("m"), ((n * 13 + f * 7) % 90).cast("double").alias("alt"), ((n * 29 + f * 17) % 360).cast("double").alias("az"))


FRAME_SQL = "CASE WHEN m % 20 <= 10 THEN m // 20 ELSE m // 20 + 1 END"


@query(f"""WITH p AS (SELECT o_orderkey AS id, o_orderkey % 5 AS n, o_orderkey * 7 % 1440 AS m FROM orders), f AS (SELECT *, {FRAME_SQL} AS f FROM p), t AS (SELECT *, (n * 13 + f * 7) % 90 AS alt, (n * 29 + f * 17) % 360 AS az FROM f)
    SELECT id, {NAMES}[n + 1] AS name, 'no_frame' AS finding FROM t WHERE f > 71 UNION ALL SELECT id, {NAMES}[n + 1], 'altitude' FROM t WHERE f <= 71 AND id % 4 > 1 UNION ALL SELECT id, {NAMES}[n + 1], 'direction' FROM t WHERE f <= 71 AND id % 3 = 0""")
def altitude_direction_check(spark, sf_dir):
    """Altitudes to one degree and points of the compass, against the frame nearest in time."""
    k = F.col("id")
    m = k * 7 % 1440
    f = F.when(m % 20 <= 10, F.floor(m / 20)).otherwise(F.floor(m / 20) + 1)
    alt, az = (k % 5 * 13 + f * 7) % 90, ((k % 5 * 29 + f * 17) % 360).cast("double")
    text = F.concat(F.lit("At "), clock.hhmm(m), F.lit(" the "), pick(NAMES, k % 5), F.lit(" stands "), (alt + k % 4).cast("string"), F.lit(" degrees up in the "), geo.compass_up(az + F.when(k % 3 == 0, 90.0).otherwise(0.0)), F.lit("."))
    said = orders(spark, sf_dir).select("id", text.alias("text"))
    get = lambda p: F.regexp_extract("text", p, 1)
    claimed = said.select("id", F.regexp_extract("text", textcheck.any_of(NAMES), 0).alias("name"), clock.minutes(get(r"(\d{2}:\d{2})")).alias("minute"), get(r"(\d+) degrees").cast("double").alias("altitude"), get(r"in the ([NESW]{1,3})\b").alias("direction"))
    return textcheck.position_findings(claimed, frames(spark), ["name"]).select("id", "name", "finding")


@query(f"""WITH {HORIZONS}, r AS (SELECT site, min(alt) AS a, max(alt) AS b FROM hz WHERE az >= 350 OR az <= 15 GROUP BY 1), c AS (SELECT site, CAST(floor(a + 0.5) AS BIGINT) + site % 3 AS low, CAST(floor(b + 0.5) AS BIGINT) AS high, a, b FROM r) SELECT site, low, high FROM c WHERE site % 3 > 0""")
def ridge_range_check(spark, sf_dir):
    """What a text says of the ridge between two azimuths, over north, against the horizon."""
    truth = terrain.ridge_range(inputs.horizons(spark, sf_dir), ["site"], F.lit(350), F.lit(15))
    text = F.concat(F.lit("The ridge is "), (textcheck.half_up(F.col("lowest")) + F.col("site") % 3).cast("string"), F.lit(" to "), textcheck.half_up(F.col("highest")).cast("string"), F.lit(" degrees high."))
    said = truth.select("site", text.alias("text"))
    get = lambda n: F.regexp_extract("text", r"(\d+) to (\d+) degrees high", n).cast("long")
    return textcheck.range_findings(said.select("site", get(1).alias("low"), get(2).alias("high")), truth, ["site"]).select("site", "low", "high")


@query("""WITH m AS (SELECT o_custkey AS k, max(o_orderkey * 13 % 101) / 100.0 AS most FROM orders GROUP BY 1) SELECT o_orderkey AS id, ['moonless', 'dark'][o_orderkey % 2 + 1] AS word, CAST(most AS DOUBLE) AS most FROM orders JOIN m ON k = o_custkey WHERE o_orderkey % 4 < 2 AND most > 0.3""")
def moon_adjective_check(spark, sf_dir):
    """Texts that call a night dark though the moon is lit by more than three tenths at its most."""
    k = F.col("id")
    text = F.concat(F.lit("A "), F.when(k % 4 < 2, pick(["moonless", "dark"], k % 2)).otherwise("bright"), F.lit(" night awaits; darkroom owners rejoice."))
    o = orders(spark, sf_dir)
    moon = o.select("o_custkey", (k * 13 % 101 / 100.0).alias("illuminated"))
    return textcheck.dark_words(o.select("id", "o_custkey", text.alias("text")), moon, ["o_custkey"], "text").select("id", "word", "most")


@query("""WITH f AS (SELECT s_suppkey AS k, CAST(1080 + i * 20 AS INTEGER) AS m, (s_suppkey * 17 + i * i * 7) % 900 / 10.0 - 10 AS alt FROM supplier, range(60) t(i)), w AS (SELECT s_suppkey AS k, CAST(1200 + s_suppkey * 7 % 300 AS INTEGER) AS lo, CAST(lo + s_suppkey * 13 % 600 AS INTEGER) AS hi FROM supplier),
    g AS (SELECT *, lead(m) OVER o AS m2, lead(alt) OVER o AS alt2, max(m) OVER (PARTITION BY k) AS last FROM f WINDOW o AS (PARTITION BY k ORDER BY m)), j AS (SELECT g.*, lo, hi FROM w JOIN g USING (k) WHERE hi <= last),
    v AS (SELECT k, alt + (alt2 - alt) * (lo - m) / (m2 - m) AS v FROM j WHERE lo BETWEEN m AND m2 UNION ALL SELECT k, alt + (alt2 - alt) * (hi - m) / (m2 - m) FROM j WHERE hi BETWEEN m AND m2 UNION ALL SELECT k, alt FROM j WHERE m BETWEEN lo AND hi),
    a AS (SELECT k, CAST(floor(greatest(min(v), 0) + 0.5) AS BIGINT) AS lowest, CAST(floor(greatest(max(v), 0) + 0.5) AS BIGINT) AS highest FROM v GROUP BY k)
    SELECT k, lo, hi, lowest + k % 4 AS low, highest AS high FROM w JOIN a USING (k) WHERE k % 4 > 1""")
def altitude_window_check(spark, sf_dir):
    """Least and greatest altitude that a text gives for a time window, to one degree; windows may go over midnight."""
    k = F.col("s_suppkey")
    s = table(spark, sf_dir, "supplier")
    rows = s.select(k.alias("k"), F.explode(F.sequence(F.lit(0), F.lit(59))).alias("i")).select("k", (F.lit(1080) + F.col("i") * 20).alias("m"), ((F.col("k") * 17 + F.col("i") * F.col("i") * 7) % 900 / 10.0 - 10).alias("alt"))
    windows = s.select(k.alias("k"), (1200 + k * 7 % 300).cast("int").alias("lo")).withColumn("hi", (F.col("lo") + F.col("k") * 13 % 600).cast("int"))
    truth = terrain.interpolated_range(rows, windows, ["k"])
    text = F.concat(F.lit("From "), clock.hhmm(F.col("lo")), F.lit(" to "), clock.hhmm(F.col("hi")), F.lit(" it stands between "), (F.col("lowest") + F.col("k") % 4).cast("string"), F.lit(" and "), F.col("highest").cast("string"), F.lit(" degrees."))
    said = truth.select("k", text.alias("text"))
    get = lambda n: F.regexp_extract("text", r"(\d{2}:\d{2}) to (\d{2}:\d{2}) it stands between (\d+) and (\d+)", n)
    night = lambda n: clock.minutes(get(n)) + F.when(clock.minutes(get(n)) < 720, 1440).otherwise(0)
    claimed = said.select("k", night(1).alias("lo"), night(2).alias("hi"), get(3).cast("long").alias("low"), get(4).cast("long").alias("high"))
    return textcheck.range_findings(claimed, truth, ["k", "lo", "hi"], 1).select("k", "lo", "hi", "low", "high")


@query(f"""WITH p AS (SELECT o_orderkey AS id FROM orders) SELECT id, 'name' AS kind, {NAMES}[id % 5 + 1] AS claim FROM p WHERE id % 6 = 0 UNION ALL SELECT id, 'nights', CAST(id % 9 AS VARCHAR) FROM p WHERE id % 7 = 0 UNION ALL SELECT id, 'hours', (id % 5) || '.25' FROM p WHERE id % 8 = 0
    UNION ALL SELECT id, 'percent', CAST(id * 13 % 101 AS VARCHAR) FROM p WHERE id % 9 = 0 UNION ALL SELECT id, 'km', CAST(id * 17 % 300 AS VARCHAR) FROM p WHERE id % 10 = 0 UNION ALL SELECT id, 'alr', (id % 20) || '.5' FROM p WHERE id % 11 = 0
    UNION ALL SELECT id, 'time', lpad(CAST(id * 7 % 24 AS VARCHAR), 2, '0') || ':15' FROM p WHERE id % 12 = 0 UNION ALL SELECT id, 'mag', '5.2' FROM p WHERE id % 13 = 0""")
def verdict_check(spark, sf_dir):
    """Names, times, counts, hours to a twentieth, percentages, distances and light of a verdict against what it may say."""
    k = F.col("id")
    s = lambda c: c.cast("string")
    values = {
        "name": (pick(NAMES, k % 5), 6, pick(NAMES, (k + 1) % 5)), "nights": (s(k % 9), 7, s(k % 9 + 1)), "hours": (F.concat(s(k % 5), F.lit(".25")), 8, F.concat(s(k % 5), F.lit(".9"))), "percent": (s(k * 13 % 101), 9, F.lit("101")),
        "km": (s(k * 17 % 300), 10, F.lit("301")), "alr": (F.concat(s(k % 20), F.lit(".5")), 11, F.lit("99")), "time": (F.concat(F.lpad(s(k * 7 % 24), 2, "0"), F.lit(":15")), 12, F.lit("99:99")), "mag": (F.lit("5.2"), 1, F.lit("5.2")),
    }
    v = {n: x[0] for n, x in values.items()}
    text = F.concat(
        v["name"], F.lit(": "), v["nights"], F.lit(" nights from "), v["time"], F.lit(", "), v["hours"], F.lit(" h clear, cloud "), v["percent"], F.lit("%, "), v["km"], F.lit(" km away, ALR "), v["alr"], F.when(k % 13 == 0, ", mag 5.2.").otherwise(".")
    )
    # hours that may be said lie 0.04 beside what is said
    may = [F.struct(F.lit(n).alias("kind"), F.when(k % step == 0, other).otherwise(F.concat(s(k % 5), F.lit(".29")) if n == "hours" else value).alias("claim")) for n, (value, step, other) in values.items()]
    o = orders(spark, sf_dir)
    allowed = o.select("id", F.explode(F.array(*may)).alias("a")).select("id", "a.kind", "a.claim")
    return textcheck.verdict_findings(o.select("id", text.alias("text")), allowed, ["id"], "text", NAMES)


@query(f"""WITH p AS (SELECT o_orderkey AS id, o_orderkey % 6 AS n, o_orderkey * 7 % 1440 AS m FROM orders), f AS (SELECT *, {FRAME_SQL} AS f FROM p)
    SELECT id, {[*NAMES, "Rigel"]}[n + 1] AS name, n < 5 AS known, CASE WHEN n < 5 AND f <= 71 THEN CAST(f * 20 AS INTEGER) END AS frame, CASE WHEN n < 5 AND f <= 71 THEN CAST((n * 13 + f * 7) % 90 AS DOUBLE) END AS alt FROM f""")
def frame_lookup(spark, sf_dir):
    """The frame of a time, whether a name is known to the frames, and its position there."""
    k = F.col("id")
    asked = orders(spark, sf_dir).select("id", pick([*NAMES, "Rigel"], k % 6).alias("name"), (k * 7 % 1440).cast("int").alias("minute"))
    at = textcheck.nearest_frame(asked, frames(spark), ["name"])
    known = F.broadcast(frames(spark).select("name").distinct().withColumn("known", F.lit(True)))  # five names
    return at.join(known, "name", "left").select("id", "name", F.coalesce("known", F.lit(False)).alias("known"), F.col("frame.m").alias("frame"), F.col("frame.alt").alias("alt"))


@query("""SELECT c_custkey, 'title' AS place, c_name AS text FROM customer UNION ALL SELECT c_custkey, 'body.lead', c_mktsegment FROM customer WHERE c_custkey % 3 > 0 UNION ALL SELECT c_custkey, 'body.notes[0].note', 'a' || c_custkey FROM customer UNION ALL SELECT c_custkey, 'body.notes[1].note', 'b' || c_custkey FROM customer""")
def text_walk(spark, sf_dir):
    """All texts of nested documents with their places."""
    k = F.col("c_custkey")
    note = lambda x: F.struct(k.alias("n"), F.concat(F.lit(x), k.cast("string")).alias("note"))
    body = F.struct(F.when(k % 3 > 0, F.col("c_mktsegment")).alias("lead"), F.array(note("a"), note("b")).alias("notes"), F.lit(1.5).alias("score"))
    return textcheck.walked(table(spark, sf_dir, "customer").select("c_custkey", F.col("c_name").alias("title"), body.alias("body"), F.lit(2).alias("count")), ["c_custkey"])
