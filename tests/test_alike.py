"""The similarity join of names against all pairs."""

import difflib
import os
import random
import unicodedata

import pytest

from nightloom.operators import alike, sites
from nightloom.plans import space_queries

SF = "/root/testdata/sf0.001"


def ratio(a, b):
    return difflib.SequenceMatcher(None, a, b).ratio()


def variants(rng, n):
    words = ["Lake", "Mount", "North", "View", "Point", "Star", "天文台", "高原", "展望", "é", "a", "ab", "Old", "Mill", "Hill"]
    names = [" ".join(rng.choice(words) for _ in range(rng.randint(1, 4))) for _ in range(n)]
    for x in list(names):
        i = rng.randrange(len(x) + 1)
        names.append(x[:i] + rng.choice("xyz ") + x[i + rng.randint(0, 1) :])
    return [*names, "", None, "a", "aa", "ab", "ba", "abc", "abcd", "aaaa", "x" * 60, "x" * 50, "abc" * 20]


@pytest.mark.parametrize("least", [0.8, 0.9, 0.6])
def test_alike_against_all_pairs(spark, least):
    rng = random.Random(8)
    a, b = variants(rng, 60), variants(rng, 60)
    left, right = (spark.createDataFrame([(x,) for x in s * 2], "name string") for s in (a, b))
    got = {(r["name"], r["b_name"]): r.ratio for r in alike.alike(left, right, least).collect()}
    want = {(x, y): ratio(x, y) for x in set(a) for y in set(b) if x and y and ratio(x, y) >= least}
    assert got == want and len(want) > 20


def test_fewer_candidates_than_pairs(spark):
    """Ten times as many names of another kind make hardly more candidates than ten times as many."""
    rng = random.Random(2)
    made = lambda n: ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(14)) for _ in range(n)]
    few, many = made(100), made(1000)
    count = lambda names: alike.candidates(*(spark.createDataFrame([(x,) for x in s], "name string") for s in (names, made(len(names))))).count()
    assert count(many) < 0.02 * len(many) ** 2 and count(few) < 0.05 * len(few) ** 2


def brute(new, known, distance):
    out = []
    for i, name, lat, lon in new:
        alike_, close, hits, best = 0, 0, 0, (0.0, 0)
        for j, other, y, x in known:
            r = ratio(name, other) if name and other else 0.0
            near = lat is not None and y is not None and distance(lat, lon, y, x) <= 200
            alike_, close, hits = alike_ + (r >= 0.8), close + near, hits + (near or r >= 0.8)
            if r >= 0.8:
                best = max(best, (r, -j))
        out.append((i, hits, alike_, close, best[0] or None, -best[1] if best[0] else None))
    return sorted(map(repr, out))


def metres(lat, lon, y, x):
    import math

    p, q = math.radians(lat), math.radians(y)
    a = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(x - lon) / 2) ** 2
    return 2 * 6_371_000.0 * math.asin(math.sqrt(a))


def clean(s):
    return None if s is None else "".join(unicodedata.normalize("NFKC", s).split())


def test_check_of_new_records(spark):
    rng = random.Random(3)
    rows = [(i, n, None if i % 17 == 0 else 35 + rng.random() / 100, 138 + rng.random() / 100) for i, n in enumerate(variants(rng, 40))]
    schema = "id long, name string, lat double, lon double"
    new, known = rows[::3] + rows[:1], rows[1:] + rows[2:4]
    got = alike.checked(spark.createDataFrame(new, schema), spark.createDataFrame(known, schema)).collect()
    tidy = lambda t: [(i, clean(n), y, x) for i, n, y, x in t]
    assert sorted(repr((r.id, r.hits, r.alike, r.close, r.best_ratio, r.best_id)) for r in got) == brute(tidy(new), tidy(known), metres)
    assert {r.verdict for r in got} == {"new", "duplicate"} and all((r.verdict == "new") == (r.hits == 0) for r in got)
    none = spark.createDataFrame([], schema)
    assert alike.checked(none, spark.createDataFrame(known, schema)).collect() == [] and {r.hits for r in alike.checked(spark.createDataFrame(new, schema), none).collect()} == {0}


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_candidate_query(spark):
    rows = [tuple(r) for r in space_queries.named_places(spark, SF).collect()]
    got = space_queries.candidate_check(spark, SF).collect()
    want = brute([(i, clean(n), y, x) for i, n, y, x in rows if i % 10 == 0], [(i, clean(n), y, x) for i, n, y, x in rows if i % 10], metres)
    assert sorted(repr((r.id, r.hits, r.alike, r.close)) for r in got) == sorted(repr(eval(w)[:4]) for w in want)


def test_names_before_distances(spark):
    """Groups by names within a kilometre are those of all pairs; many records that are merely near don't meet."""
    rng = random.Random(5)
    names = ["Lake", "Lake View", "a", "b", "ab", "Mount Old", "Old", "Star Point", "Point", "x", "湖", "湖展望台"]
    rows = [(i, rng.choice(names), 35 + rng.random() / 20, 138 + rng.random() / 20) for i in range(150)]
    df = spark.createDataFrame(rows, "id long, name string, lat double, lon double")
    got = {(min(p), max(p)) for p in ((r.id, r.b_id) for r in sites.related_within(df.withColumn("bare", sites.bare_name(df["name"])), 1000.0).collect())}
    bare = {r.id: r.bare for r in df.withColumn("bare", sites.bare_name(df["name"])).collect()}
    related = lambda a, b: a == b or (len(b) >= 2 and b in a) or (len(a) >= 2 and a in b)
    assert got == {(i, j) for i, _, y, x in rows for j, _, v, u in rows if i < j and related(bare[i], bare[j]) and metres(y, x, v, u) <= 1000}


def test_the_same_characters_in_another_order(spark):
    """names that have their characters, but not their order in common are told apart before they are matched."""
    rng = random.Random(4)
    shuffled = lambda: "".join(rng.sample("abcdefghijklmno", 15))
    a, b = [shuffled() for _ in range(60)], [shuffled() for _ in range(60)]
    b[:3] = [x[:7] + x[8:] for x in a[:3]]
    left, right = (spark.createDataFrame([(x,) for x in s], "name string") for s in (a, b))
    found = {(r["name"], r.b_name) for r in alike.candidates(left, right).collect()}
    assert len(found) < 60 and set(zip(a[:3], b[:3])) <= found


@pytest.mark.parametrize(("chars", "sizes", "least"), [("abc", (1, 9), 0.8), ("abcdé天", (1, 80), 0.7), ("abcdefgh", (60, 68), 0.5), ([chr(0x4E00 + i) for i in range(4000)], (1, 6), 0.5)])
def test_pairs_that_meet(monkeypatch, chars, sizes, least):
    """no pair of that ratio is missing, none meets twice, also where columns and codes are shared and names are longer than a word's bits."""
    monkeypatch.setattr(alike, "CHUNK", 16)
    monkeypatch.setattr(alike, "PAIRS", 128)
    rng = random.Random(6)
    made = lambda n: {"".join(rng.choice(chars) for _ in range(rng.randint(*sizes))) for _ in range(n)}
    left = sorted(made(60), key=len)
    right = sorted(made(60) | {x[:-1] + "q" for x in left}, key=len)
    met = [(left[i], right[j]) for x, y in alike.met(left, right, least) for i, j in zip(x, y, strict=True)]
    assert len(met) == len(set(met)) and set(met) >= {(x, y) for x in left for y in right if ratio(x, y) >= least} != set()
