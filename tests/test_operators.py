"""Operators on small hand-made tables."""

import datetime as dt
import json
import math

import pytest
from pyspark.sql import functions as F

from nightloom.functions import clock, geo, names, sky
from nightloom.operators import audit, claims, cloud, graph, nearby, rank, raster, runs, series, sites, terrain


def hours(spark, values, start="2024-01-01 18:00:00"):
    t0 = dt.datetime.fromisoformat(start)
    rows = [("a", t0 + dt.timedelta(hours=i), v, t0, t0 + dt.timedelta(hours=len(values) - 1)) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "k string, t timestamp, v double, lo timestamp, hi timestamp")


def clear(spark, values, **more):
    return runs.longest_clear(hours(spark, values), ["k"], "t", "v", "lo", "hi", **more).collect()


def test_clear_window_breaks_at_null_and_keeps_the_first_tie(spark):
    r = clear(spark, [10.0, 30.0, None, 20.0, 40.0, 5.0, 99.0])[0]
    assert (r.start.hour, r.end.hour, r.hours, r.mean) == (18, 20, 2.0, 20.0)


def test_clear_window_touches_both_ends_and_is_clamped(spark):
    r = clear(spark, [1.0, 2.0, 3.0])[0]
    assert (r.start.hour, r.end.hour, r.hours, r.mean) == (18, 20, 2.0, 2.0)


def test_no_clear_window(spark):
    assert clear(spark, [31.0, None, 99.0]) == []
    assert clear(spark, [None, None]) == []
    assert clear(spark, [31.0, 99.0, 30.0]) == []  # the last hour is cut off by the window's end


def test_sampled_window_ends_at_the_first_false_sample(spark):
    r = runs.longest_sampled(hours(spark, [1.0, 1.0, 0.0, 1.0]), ["k"], "t", F.col("v") > 0).collect()
    assert [(x.start.hour, x.end.hour, x.hours) for x in r] == [(18, 20, 2.0)]
    assert runs.longest_sampled(hours(spark, [0.0, 0.0, 1.0]), ["k"], "t", F.col("v") > 0).collect() == []


def test_merged_runs(spark):
    df = hours(spark, [1.0] * 6).filter("hour(t) not in (19, 20)")
    got = runs.merged_runs(df.select("k", "t", F.col("t").alias("l")), ["k"], "t", "l", "1 hour").orderBy("start").collect()
    assert [(x.start.hour, x.last.hour, x.runs) for x in got] == [(18, 18, 1), (21, 23, 3)]


def test_two_sources(spark):
    spine = spark.createDataFrame([(1,), (2,), (3,)], "h int")
    a, b = spark.createDataFrame([(1, 5.0, None)], "h int, x double, y double"), spark.createDataFrame([(1, 9.0, 7.0), (2, 1.0, 2.0)], "h int, x double, y double")
    got = series.two_sources(spine, a, b, ["h"], ["x", "y"]).orderBy("h").collect()
    assert [tuple(r) for r in got] == [(1, 5.0, 7.0, "MSM"), (2, 1.0, 2.0, "ECMWF"), (3, None, None, "N/A")]


def one(spark, col):
    return spark.range(1).select(col.alias("x")).first().x


def array(*values):
    return F.array(*map(F.lit, values))


def test_overlap(spark):
    assert abs(one(spark, cloud.overlap(array(30.0, 20.0, 0.0, 40.0))) - 58.0) < 1e-9
    assert one(spark, cloud.overlap(F.array().cast("array<double>"))) == 0.0


def test_obstruction_without_native_cover_or_levels(spark):
    none = F.lit(None).cast("double")
    assert one(spark, cloud.obstruction(F.array().cast("array<struct<h:double,c:double>>"), none, none, none, none, F.lit(100.0))) is None
    levels = F.array(F.struct(F.lit(1000.0).alias("h"), F.lit(40.0).alias("c")))
    r = one(spark, cloud.obstruction(levels, none, none, none, none, F.lit(1500.0)))
    assert (r.obstruction, r.sea) == (40.0, 40.0)  # half of the only slab lies above


def test_rounding_goes_to_the_even_line(spark):
    assert [one(spark, geo.grid_cell(F.lit(x), 0.25)) for x in (0.125, 0.375, 0.13)] == [0.0, 0.5, 0.25]
    assert [one(spark, geo.compass_even(F.lit(x))) for x in (11.25, 359.5, 33.75)] == ["N", "N", "NE"]
    assert [one(spark, geo.compass_up(F.lit(x))) for x in (11.25, 359.5, 348.75)] == ["NNE", "N", "N"]


def vincenty(lat, lon, bearing, s):
    a, f = 6378137.0, 1 / 298.257223563
    b = a * (1 - f)
    u1, a1 = math.atan((1 - f) * math.tan(math.radians(lat))), math.radians(bearing)
    s1, sa = math.atan2(math.tan(u1), math.cos(a1)), math.cos(u1) * math.sin(a1)
    c2 = 1 - sa * sa
    uu = c2 * (a * a - b * b) / (b * b)
    big_a, big_b = 1 + uu / 16384 * (4096 + uu * (-768 + uu * (320 - 175 * uu))), uu / 1024 * (256 + uu * (-128 + uu * (74 - 47 * uu)))
    sigma, last = s / (b * big_a), 0.0
    while abs(sigma - last) > 1e-13:
        m, last = math.cos(2 * s1 + sigma), sigma
        sigma = s / (b * big_a) + big_b * math.sin(sigma) * (m + big_b / 4 * (math.cos(sigma) * (-1 + 2 * m * m) - big_b / 6 * m * (-3 + 4 * math.sin(sigma) ** 2) * (-3 + 4 * m * m)))
    m = math.cos(2 * s1 + sigma)
    x = math.sin(u1) * math.sin(sigma) - math.cos(u1) * math.cos(sigma) * math.cos(a1)
    lat2 = math.atan2(math.sin(u1) * math.cos(sigma) + math.cos(u1) * math.sin(sigma) * math.cos(a1), (1 - f) * math.hypot(sa, x))
    turn = math.atan2(math.sin(sigma) * math.sin(a1), math.cos(u1) * math.cos(sigma) - math.sin(u1) * math.sin(sigma) * math.cos(a1))
    c = f / 16 * c2 * (4 + f * (4 - 3 * c2))
    return math.degrees(lat2), lon + math.degrees(turn - (1 - c) * f * sa * (sigma + c * math.sin(sigma) * (m + c * math.cos(sigma) * (-1 + 2 * m * m))))


def test_direct_geodesic(spark):
    for args in ((35.0, 138.0, 45.0, 50_000.0), (-20.0, 10.0, 200.0, 1000.0), (60.0, 0.0, 359.0, 30_000.0)):
        r = one(spark, geo.direct(*map(F.lit, args)))
        want = vincenty(*args)
        assert abs(r.lat - want[0]) < 1e-10 and abs(r.lon - want[1]) < 1e-10


def test_sky(spark):
    assert abs(one(spark, sky.sun_longitude(sky.days(F.lit("2024-03-20 03:06:00").cast("timestamp"))))) < 0.02 or abs(one(spark, sky.sun_longitude(sky.days(F.lit("2024-03-20 03:06:00").cast("timestamp")))) - 360) < 0.02
    full = one(spark, sky.phase_angle(sky.days(F.lit("2024-01-25 17:54:00").cast("timestamp"))))
    new = one(spark, sky.phase_angle(sky.days(F.lit("2024-01-11 11:57:00").cast("timestamp"))))
    assert full < 8 and new > 172
    ra, dec = sky.from_galactic(F.lit(0.0), F.lit(0.0))
    assert abs(one(spark, ra) - 266.405) < 0.01 and abs(one(spark, dec) + 28.936) < 0.01
    assert abs(one(spark, sky.magnitudes(sky.nanolamberts(F.lit(21.5)))) - 21.5) < 1e-9
    assert one(spark, sky.moonlight(F.lit(0.0), F.lit(30.0), F.lit(95.0), F.lit(10.0))) == 0.0
    assert one(spark, sky.sexagesimal(F.lit(-1), F.lit(30), F.lit(0))) == -1.5


def test_clock(spark):
    assert one(spark, clock.window_hours(F.lit("22:30"), F.lit("01:00"))) == 2.5
    assert one(spark, clock.phrase_fits(F.lit("about"), F.lit(1435), F.lit(10))) is True  # over midnight
    assert one(spark, clock.half_hour(F.lit(15))) == 0 and one(spark, clock.half_hour(F.lit(45))) == 60
    assert one(spark, clock.display_width(F.lit("ab山"))) == 4
    assert [str(x) for x in one(spark, clock.weekend(F.lit("2024-01-07").cast("date")))] == ["2024-01-07"]
    assert [str(x) for x in one(spark, clock.weekend(F.lit("2024-01-03").cast("date")))] == ["2024-01-06", "2024-01-07"]
    assert one(spark, clock.failure_kind(F.lit(" : x"))) == "unknown"


def test_components(spark):
    links = spark.createDataFrame([(5, 4), (4, 3), (3, 2), (2, 1), (9, 8), (7, 7), (None, 1)], "a long, b long")
    assert {(r.node, r.comp) for r in graph.components(links).collect()} == {(1, 1), (2, 1), (3, 1), (4, 1), (5, 1), (8, 8), (9, 8)}
    assert graph.components(links.filter("false")).collect() == []


def test_pairs_within_match_all_pairs(spark):
    import random

    rng = random.Random(5)
    rows = [(i, 35 + rng.random() / 10, 138 + rng.random() / 10) for i in range(150)]
    got = {(r.id, r.b_id) for r in nearby.pairs_within(spark.createDataFrame(rows, "id long, lat double, lon double"), 1500.0).collect()}

    def d(a, b):
        x = math.sin(math.radians(b[1] - a[1]) / 2) ** 2 + math.cos(math.radians(a[1])) * math.cos(math.radians(b[1])) * math.sin(math.radians(b[2] - a[2]) / 2) ** 2
        return 2 * 6371000.0 * math.asin(math.sqrt(x))

    assert got == {(a[0], b[0]) for a in rows for b in rows if a[0] < b[0] and d(a, b) <= 1500}


def test_nearest_of_many_wherever_they_are(spark):
    import random

    rng = random.Random(7)
    kind = "id long, lat double, lon double"
    rows = [(i, rng.uniform(-90, 90), rng.uniform(-180, 180)) for i in range(60)] + [(60, 89.9, 10.0), (61, 0.0, 179.99), (62, 35.0, 139.0), (63, 35.0, 139.0), (64, None, 1.0)]
    many = [(i, 35 + rng.random(), 139 + rng.random()) for i in range(11_000)] + [(20_000 + i, rng.uniform(-90, 90), rng.uniform(-180, 180)) for i in range(300)] + [(30_000, 89.9, -170.0), (30_001, 0.0, -179.99), (30_002, 35.0, 139.0), (30_003, 35.0, 139.0)]

    def d(a, b):
        x = math.sin(math.radians(b[1] - a[1]) / 2) ** 2 + math.cos(math.radians(a[1])) * math.cos(math.radians(b[1])) * math.sin(math.radians(b[2] - a[2]) / 2) ** 2
        return round(2 * 6371000.0 * math.asin(math.sqrt(min(x, 1.0))), 6), b[0]

    for reference in (many, many[:2], many[-1:]):
        got = {r.id: (r.b_id, r.distance_m) for r in nearby.nearest_any(spark.createDataFrame(rows, kind), spark.createDataFrame(reference, kind)).collect()}
        want = {a[0]: min(d(a, b) for b in reference) for a in rows[:-1]}
        assert got.pop(64) == (None, None) and {i: b for i, (b, _) in got.items()} == {i: b for i, (_, b) in want.items()}
        assert all(abs(got[i][1] - m) < 1e-3 for i, (m, _) in want.items())
    assert {(r.b_id, r.distance_m) for r in nearby.nearest_any(spark.createDataFrame(rows, kind), spark.createDataFrame([], kind)).collect()} == {(None, None)}


def test_boxes(spark):
    p = spark.createDataFrame([(1, 1.0, 1.0), (2, 5.0, 5.0)], "id long, lat double, lon double")
    b = spark.createDataFrame([("x", 0.0, 1.0, 0.0, 1.0), ("y", 1.0, 2.0, 1.0, 2.0)], "area string, lat_min double, lat_max double, lon_min double, lon_max double")
    assert {(r.id, r.area) for r in nearby.in_boxes(p, b).collect()} == {(1, "x"), (1, "y"), (2, None)}


def test_names(spark):
    assert one(spark, sites.bare_name(F.lit("Lake View Parking"))) == "lakeview"
    df = spark.createDataFrame([("ＡＢＣ 展望", "ABC展望"), (None, "x")], "a string, b string")
    assert [r.x for r in df.select(names.normalized("a").alias("x")).collect()] == ["ABC展望", None]
    assert [r.x for r in df.select(names.similarity("a", "b").alias("x")).collect()] == [1.0, None]


def test_bilinear_is_null_outside(spark):
    cells = spark.createDataFrame([(y, x, float(x)) for y in range(3) for x in range(3)], "iy long, ix long, value double")
    p = spark.createDataFrame([(1, 9.5, 0.5), (2, 8.0, 0.0), (3, 7.9, 0.0)], "id long, lat double, lon double")
    got = {r.id: r.value for r in raster.bilinear(p, cells, 10.0, 0.0, 1.0).collect()}
    assert got == {1: 0.5, 2: None, 3: None}


def test_superposition_of_sums(spark):
    grid = spark.range(400).select((F.col("id") / 20).cast("long").alias("iy"), (F.col("id") % 20).alias("ix")).withColumn("value", F.when(F.col("iy") * 20 + F.col("ix") == 210, 100.0).otherwise(0.0))
    got = {(r.iy, r.ix): r.sum for r in raster.neighbourhood_sum(grid, 2, lambda d: 1 / (1 + d)).collect()}
    assert got[10, 10] == 100.0 and got[10, 11] == got[9, 10] == 50.0 and got[10, 13] == 0.0
    fft = {(r.iy, r.ix): r.sum for r in raster.convolved(grid, 7, 2, lambda d: 1 / (1 + d)).collect()}
    assert got.keys() == fft.keys() and all(abs(got[k] - fft[k]) < 1e-9 for k in got)


def test_peaks_over_north(spark):
    rows = [(1, az, 10.0 if az in (359, 0) else 4.0 if az == 180 else 0.0) for az in range(360)]
    got = terrain.ridge_peaks(spark.createDataFrame(rows, "site int, az int, alt double"), ["site"]).collect()
    assert sorted((r.az, r.alt) for r in got) == [(180, 4.0), (359, 10.0)]


def test_ranks(spark):
    df = spark.createDataFrame([(1, 1.0), (2, 1.0), (3, 2.0)], "id int, v double")
    assert [r.p for r in rank.average_rank_pct(df, "v", "p").orderBy("id").collect()] == [25.0, 25.0, 100.0]
    assert rank.threshold_for(df, "v", 2).first().threshold == 1.5


def test_lag_over_ranges(spark):
    values = {i * 7 % 1000: None if i % 13 == 0 else i for i in range(1000)}
    df = spark.createDataFrame(list(values.items()), "id long, v long").repartition(6)
    got = {r.id: r.before for r in rank.lagged(df, "id", "v", "before").collect()}
    assert got == {i: values.get(i - 1) for i in values}
    assert rank.lagged(df.filter("false"), "id", "v", "before").collect() == []


def test_horizon_profiles_are_whole(spark):
    from nightloom.plans import space_queries

    rows = space_queries.horizon_profile(spark, "/root/testdata/sf0.001").collect()
    suppliers = spark.read.parquet("/root/testdata/sf0.001/supplier.parquet").count()
    assert len(rows) == suppliers * 360 == len({(r.id, r.az) for r in rows})
    site = spark.createDataFrame([(1, 35.0, 138.0)], "id long, lat double, lon double")
    assert terrain.ray_points(site).agg(F.count(F.lit(1)), F.max("d"), F.max("az")).first()[:] == (360 * 500, 50_000, 359)
    one = terrain.horizon(spark.createDataFrame([(1, 0, 200, 20.0), (1, 0, 100, 10.0), (1, 0, 100, None), (1, 1, 100, None)], "id long, az int, d int, e double").withColumn("own", F.lit(0.0)), ["id"], "e", "own")
    assert sorted((r.az, r.distance) for r in one.collect()) == [(0, 100), (1, None)]


def test_status(spark):
    df = spark.createDataFrame([("a", i == 0, False) for i in range(5)] + [("b", i == 0, False) for i in range(6)] + [("c", False, True)] + [("d", False, False)], "k string, f boolean, l boolean")
    assert {r.k: r.status for r in audit.summary(df, ["k"], F.col("f"), F.col("l")).collect()} == {"a": "abort", "b": "partial", "c": "abort", "d": "ok"}


def test_claims(spark):
    df = spark.createDataFrame([(1, "At 21:30 it is 40% clear. 12 km off, soon."), (2, None), (3, "")], "id int, text string")
    got = {tuple(r) for r in claims.claims(df, ["id"], "text").collect()}
    assert got == {(1, "time", "21:30"), (1, "percent", "40"), (1, "km", "12")}
    assert [r.sentence for r in claims.vague(df, ["id"], "text").collect()] == ["12 km off, soon."]


def test_night_table_and_pruning(spark, tmp_path):
    from nightloom.sources.documents import prune, write_nights

    path = str(tmp_path / "nights")
    df = spark.createDataFrame([("2024-01-01", 1), ("2024-01-20", 2)], "night string, v int").withColumn("night", F.to_date("night"))
    write_nights(df, path)
    write_nights(df.filter("v = 2").withColumn("v", F.lit(3)), path)
    assert sorted(r.v for r in spark.read.parquet(path).collect()) == [1, 3]
    assert [r.v for r in prune(spark, path, "2024-01-22").collect()] == [3]


def test_pairs_over_the_date_line(spark):
    rows = [(1, 10.0, 179.999), (2, 10.0, -179.999), (3, 10.0, 180.02), (4, -59.99, 0.0), (5, -59.99, 359.999)]
    df = spark.createDataFrame(rows, "id long, lat double, lon double")
    assert {(r.id, r.b_id) for r in nearby.pairs_within(df, 1500.0).collect()} == {(1, 2), (4, 5)}
    assert {(r.id, r.b_id) for r in nearby.pairs_within(df, 9_000_000.0).collect()} == {(i, j) for i in (1, 2, 3, 4, 5) for j in (1, 2, 3, 4, 5) if i < j and (i > 3) == (j > 3)}
    with pytest.raises(Exception, match="latitudes beyond"):
        nearby.pairs_within(spark.createDataFrame([(1, 70.0, 0.0), (2, 70.0, 0.0)], "id long, lat double, lon double"), 100.0).collect()


def test_order_statistics(spark):
    import numpy as np

    from nightloom.operators import rank

    rng = np.random.default_rng(4)
    values = np.round(rng.normal(0, 3, 500)).tolist() + [7.0] * 300
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)] + [(9999, None)], "id int, v double").repartition(5)
    got = rank.quantiles(df, "v", {"a": 0.05, "b": 0.5, "c": 1.0}).first()
    assert np.allclose([got.a, got.b, got.c], np.quantile(values, [0.05, 0.5, 1.0]))
    assert rank.quantiles(df.filter("v is null"), "v", {"a": 0.5}).first().a is None
    pct = {r.id: r.p for r in rank.average_rank_pct(df, "v", "p").collect()}
    order = sorted(values)
    want = {v: (order.index(v) + (order.count(v) - 1) / 2) / (len(order) - 1) * 100 for v in set(values)}
    assert pct.pop(9999) is None and all(abs(pct[i] - want[v]) < 1e-9 for i, v in enumerate(values))
    share = {r.id: r.p for r in rank.share_at_most(df, df.filter("id % 3 = 0"), "v", "p").collect()}
    ref = [v for i, v in enumerate(values) if i % 3 == 0]
    assert all(abs(share[i] - 100 * sum(x <= v for x in ref) / len(ref)) < 1e-9 for i, v in enumerate(values))
    few = df.filter("v is not null").withColumn("g", F.col("id") % 2 == 0)
    a = {(r.id, r.rank) for r in rank.numbered(few, ["g"], F.desc("v"), F.asc("id")).collect()}
    assert a == {(r.id, r.rank) for r in rank.ranked(few, ["g"], F.desc("v"), F.asc("id")).collect()}


def test_hot_keys_are_joined_whole(spark):
    from nightloom.operators.joins import joined

    rows = spark.createDataFrame([("hot" if i < 700 else f"k{i}", i) for i in range(2000)], "k string, i int").repartition(4)
    table = rows.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.min("i").alias("least"))
    got = joined(rows, table, ["k"], "n", 2000).collect()
    assert len(got) == 2000 and {(r.i, r.least) for r in got} == {(i, 0 if i < 700 else i) for i in range(2000)}
    assert joined(rows.filter("i < 0"), table.filter("least < 0"), ["k"], "n", 0).collect() == []


def test_nearest_name_and_verb(spark):
    from nightloom.operators import textcheck

    text = "Vega rises at 20:10, the Milky Way centre sets around 3:05; nothing at 04:00. Moon halo near the Moon peaks at 21:00 and 22:00."
    df = spark.createDataFrame([(1, text), (2, None), (3, "")], "id int, text string")
    got = textcheck.timed_claims(df, ["id"], "text", ["Vega", "Moon", "Moon halo", "Milky Way", "Milky Way centre"], ["rises", "sets", "peaks"]).collect()
    assert sorted((r.clause, r.minute, r.name, r.verb, r.phrase) for r in got) == [
        (0, 1210, "Vega", "rises", "exact"), (1, 185, "Milky Way centre", "sets", "about"), (2, 240, None, None, "exact"), (3, 1260, "Moon", "peaks", "exact"), (3, 1320, "Moon", "peaks", "exact"),
    ]
    events = spark.createDataFrame([("Vega", "rises", 1215), ("Moon", "peaks", 1255)], "name string, verb string, event int")
    claimed = textcheck.timed_claims(df, ["id"], "text", ["Vega", "Moon", "Moon halo", "Milky Way", "Milky Way centre"], ["rises", "sets", "peaks"])
    assert sorted((r.name, r.minute) for r in textcheck.without_event(claimed, events, ["id"]).collect()) == [("Milky Way centre", 185), ("Moon", 1320)]


def test_spots_are_found_once(spark):
    from nightloom.sources import catalogues

    s = spark.createDataFrame([(1, "a"), (2, "b"), (3, "b")], "id long, name string")
    ask = lambda *keys: catalogues.spots_for(spark.createDataFrame([(k,) for k in keys], "key string"), s).collect()
    assert {(r.key, r.id) for r in ask("1", "a", "3")} == {("1", 1), ("a", 1), ("3", 3)}
    for bad in ("b", "zz"):
        with pytest.raises(Exception, match="not one site"):
            ask(bad)


def test_nights_are_merged_and_pruned(spark, tmp_path):
    from nightloom.sources import documents

    path, kind = str(tmp_path / "nights"), "cell long, night date, run string"
    day = lambda n: __import__("datetime").date(2026, 9, n)
    documents.merge_nights(spark, spark.createDataFrame([(1, day(1), "old"), (2, day(1), "old"), (1, day(5), "old"), (3, day(5), None)], kind), path, ["cell"], "run")
    documents.merge_nights(spark, spark.createDataFrame([(2, day(1), "new"), (3, day(1), "new"), (1, day(1), None)], kind), path, ["cell"], "run")
    read = lambda: sorted((r.cell, r.night.day, r.run) for r in spark.read.parquet(path).collect())
    assert read() == [(1, 1, "old"), (1, 5, "old"), (2, 1, "new"), (3, 1, "new")]
    assert documents.prune_nights(spark, path, "2026-09-09") == ["2026-09-01"] and read() == [(1, 5, "old")]


def test_late_rows_and_state_that_ends(spark, tmp_path):
    """A row behind the watermark is dropped; only sessions that the watermark has passed are written."""
    import datetime

    from nightloom.streaming import windows

    at = lambda minute: datetime.datetime(2026, 9, 1, 12) + datetime.timedelta(minutes=minute)
    for minutes in [(0, 5), (300,), (302,), (1,), (600,)]:  # the fourth file's row is late by then: rows are held against the watermark of the batch before
        spark.createDataFrame([(1, at(m)) for m in minutes], "user long, ts timestamp").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        __import__("time").sleep(1.1)  # files are taken by age
    e = windows.stream(spark, str(tmp_path / "in" / "*.parquet"), maxFilesPerTrigger="1")
    got = windows.finished(spark, windows.sessions(e, ["user"], "ts", "10 minutes", "30 minutes")).collect()
    assert sorted(((r.start - at(0)).seconds // 60, r.n) for r in got) == [(0, 2), (300, 2)]


def test_a_cluster_needs_a_shared_folder(spark, monkeypatch):
    class Context:
        master = "spark://somewhere:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()
        conf = type("Conf", (), {"get": lambda self, key, default=None: default})()

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        graph.shared_dir(Session())


def test_elements_of_pages(spark):
    from nightloom.sources import pages

    html = "<html><body><p>One <b>two</b> three<br>four</p><ul><li>a</li><li>b</li></ul></body></html>"
    df = spark.createDataFrame([(1, html), (2, None), (3, "")], "page_id long, html string")
    got = sorted((r.n, r.parent, r.depth, r.name, r.text) for r in pages.elements(df).collect() if r.page_id == 1)
    assert got == [(0, -1, 0, "html", ""), (1, 0, 1, "body", ""), (2, 1, 2, "p", "One  threefour"), (3, 2, 3, "b", "two"), (4, 2, 3, "br", ""), (5, 1, 2, "ul", ""), (6, 5, 3, "li", "a"), (7, 5, 3, "li", "b")]
    assert {r.page_id for r in pages.elements(df).collect()} == {1}


def test_pages_are_read_to_their_end(spark, tmp_path):
    """what a page leaves unfinished at its end, text outside all elements and pages without elements are in the result, and
    so are names, parents and own texts."""
    from nightloom.plans import text_queries

    rows = [(1, "<p>a &am"), (2, None), (3, "just text"), (4, "x<p>q</p>y"), (5, "<p>a</p><script>if (a<b) <i>z</i>"), (7, "<p>a<b class='"), (8, "<ul><li>a<li>b</ul>")]
    spark.createDataFrame(rows, "page_id long, html string").write.parquet(str(tmp_path / "pages.parquet"))
    got = {r.page_id: r for r in text_queries.html_tree(spark, str(tmp_path)).collect()}
    assert {i: (r.elements, r.depth, r.outside) for i, r in got.items()} == {1: (1, 0, ""), 2: (0, None, ""), 3: (0, None, "just text"), 4: (1, 0, "xy"), 5: (2, 0, ""), 7: (1, 0, ""), 8: (3, 2, "")}
    assert [tuple(x) for x in got[5].tree] == [(0, -1, 0, "p", "a"), (1, -1, 0, "script", "if (a<b) <i>z</i>")]
    assert got[1].tree[0].text == "a &am" and got[7].tree[0].text == "a<b class='"
    assert [tuple(x) for x in got[8].tree] == [(0, -1, 0, "ul", ""), (1, 0, 1, "li", "a"), (2, 1, 2, "li", "b")]


def test_end_points_are_those_of_direct(spark):
    """the compiled steps give the same end points as the formula in one expression, to the last bit but one."""
    from nightloom.functions import geo

    rows = [(lat, lon, b, d) for lat, lon in ((33.0, 136.0), (-60.5, 179.9), (0.0, 0.0)) for b in (0.0, 37.0, 180.0, 271.5) for d in (100.0, 50_000.0)]
    df = spark.createDataFrame(rows, "lat double, lon double, b double, d double")
    args = [F.col(c) for c in ("lat", "lon", "b", "d")]
    for r in geo.end_points(df.withColumn("e", geo.direct(*args)), *args).collect():
        assert abs(r.lat2 - r.e.lat) < 1e-13 and abs(r.lon2 - r.e.lon) < 1e-12


def test_horizons_of_sites_at_one_place(spark, tmp_path):
    """suppliers at one place have one horizon, each its own rows."""
    from nightloom.plans import space_queries

    spark.createDataFrame([(7,), (507,)], "s_suppkey long").withColumn("s_name", F.lit("x")).write.parquet(str(tmp_path / "supplier.parquet"))
    rows = space_queries.horizon_profile(spark, str(tmp_path)).collect()
    by = {k: sorted((r.az, r.angle, r.distance) for r in rows if r.id == k) for k in (7, 507)}
    assert len(by[7]) == 360 and by[7] == by[507]


def test_crowded_cells_are_shared(spark):
    """rows at one place meet in several tasks, each pair once, and no side is broadcast."""
    df = spark.createDataFrame([(i, 35.0 + i % 3 * 0.004, 138.0) for i in range(60)], "id long, lat double, lon double")
    got = nearby.pairs_within(df, 500.0)
    pairs = [(r.id, r.b_id) for r in got.collect()]
    assert len(pairs) == len(set(pairs)) and set(pairs) == {(i, j) for i in range(60) for j in range(i + 1, 60) if abs(i % 3 - j % 3) <= 1}
    assert "Broadcast" not in got._jdf.queryExecution().executedPlan().toString()


def test_rows_of_one_place_are_paired_as_blocks(spark, monkeypatch):
    """rows of one place and name go through the shuffle as blocks of ids, a crowd of them as several; pairs are those of rows."""
    monkeypatch.setattr(nearby, "BLOCK", 16)
    names = ["Lake", "Lake View", None, "Old"]
    rows = [(i, names[i % 4 if i < 40 else 0], 35.0 + i % 3 * 0.001, None if i == 39 else 138.0) for i in range(120)]
    df = spark.createDataFrame([*rows, rows[5]], "id long, name string, lat double, lon double")
    blocks, total = nearby.blocks(df.withColumn("bare", sites.bare_name(df["name"])), ["bare"])
    found = blocks.collect()
    assert total == 120 and sum(len(b.ids) for b in found) == 120 and len(found) < 40 and max(len(b.ids) for b in found) < 48
    placed = [r for r in [*rows, rows[5]] if r[3] is not None]
    bare = {r[0]: r.bare for r in df.select("id", sites.bare_name(df["name"]).alias("bare")).collect()}
    related = lambda a, b: None if a is None or b is None else a in b or b in a
    apart = lambda a, b: round(6_371_000 * math.radians(abs(a[2] - b[2])), 3)
    want = [(a[0], b[0], apart(a, b), related(bare[a[0]], bare[b[0]])) for a in placed for b in placed if a[0] < b[0]]
    got = [(r.id, r.b_id, r.distance_m, r.related) for r in sites.name_pairs(df).collect()]
    order = lambda x: sorted(map(repr, x))
    assert order(got) == order(want)
    near = [w[:3] for w in want if 50 < w[2] <= 200 and w[3] is False]
    assert order((r.id, r.b_id, r.distance_m) for r in sites.proximity_pairs(df).collect()) == order(near) and near
