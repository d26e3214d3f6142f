"""Conversation repair, mixing and clustering against brute-force versions."""

import collections
import functools
import hashlib
import math
import os
import random
import re
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

pytest.importorskip("public_tokenizers")
from nightloom.llm import clusters, conversations, mixing, queries  # noqa: E402

SF = "/root/testdata/sf0.001"
SPACES = "\x20\x09\x0a\x0b\x0c\x0d"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", ["op11_repair", "op12_mixing", "op13_clusters"])
def test_query_and_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "conversations", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = queries.QUERIES[name](spark, SF)
    found = con.execute(queries.ORACLE_SQL[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == sorted(df.columns)
    assert sorted(map(repr, (tuple(r) for r in df.select(*names).collect()))) == sorted(map(repr, found.fetchall()))


# --- conversations -------------------------------------------------------------------------------------------------------


def broken(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        out += [(conv, turn, "user" if kind == 4 else role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    return out


def audit_of(rows):
    """Every row's faults, and the least (cost, edits) over all edits, for one conversation's rows after damage."""
    rows = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[3]))
    seen, faults = set(), []
    for _, _, role, text in rows:
        bare = text.strip(SPACES)
        faults.append("blank" if not bare else "duplicate" if (role, text) in seen else "" if bare[-1] in ".!?" else "truncated")
        seen.add((role, text))

    so_far = {"": "", "s": "s", "u": "u", "a": "ua"}  # the shortest beginning that ends on an initial

    @functools.cache
    def least(i, last, added):
        found = []
        if i == len(rows):
            if re.fullmatch("(s?(ua)+)?", so_far[last]):
                found.append((0, "", ()))
        else:
            role, text, extra = rows[i][2], rows[i][3], 3 * (faults[i] == "truncated")
            options = [("D", 4, "", None)]
            if faults[i] not in ("blank", "duplicate"):
                options += [("K", extra, role[:1], f"{role}:{text}")] * bool(role) + [("R", 3 + extra, r[0], f"{r}:{text}") for r in ("user", "assistant")]
            for label, cost, initial, line in options:
                if re.fullmatch("s?(ua)*u?", so_far[last] + initial) and (rest := least(i + 1, initial or last, 0)):
                    found.append((cost + rest[0], label + rest[1], (line, *rest[2])))
        for r in ("user", "assistant") if added < 3 else ():
            if re.fullmatch("s?(ua)*u?", so_far[last] + r[0]) and (rest := least(i, r[0], added + 1)):
                found.append((3 + rest[0], "I" + rest[1], (r + ":", *rest[2])))
        return min(found, default=None)

    cost, audit, lines = least(0, "", 0)
    turns = [r[1] for r in rows if r[1] is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    initials = [r[2][:1] for r in rows]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False))
    sha = hashlib.sha256("\n".join(x for x in lines if x is not None).encode()).hexdigest()
    return gaps, faults.count("blank"), faults.count("duplicate"), faults.count("truncated"), illegal, cost, audit, sha


def expected(rows, ids):
    by = collections.defaultdict(list)
    for r in rows:
        by[r[0]].append(r)
    return sorted(repr((c, *(audit_of(by[c]) if c in by else (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())))) for c in ids)


def some_rows(seed=3):
    rng = random.Random(seed)
    roles = ["user", "assistant", "system", "user", "assistant", "tool", None, "sysop", ""]
    texts = ["Yes.", "No", "What?", "", " \t", None, "Same here.", "Ends so! \n", "Ends.  ", "x" * 5000 + "."]
    rows = [(conv, turn if rng.random() < 0.9 else None, rng.choice(roles), rng.choice(texts) if rng.random() < 0.6 else f"text {rng.randint(0, 40)}.") for conv in range(60) for turn in range(rng.randint(1, 9))]
    return rows + [(None, 1, "user", "Hi."), (None, 2, "assistant", "Hi."), (70, None, None, None), (71, 5, "system", "Only."), *[(72, 3, "user", "Again and again.")] * 30]


SCHEMA = "conv_id long, turn long, role string, text string"


def rows_of(df):
    return sorted(repr(tuple(r)) for r in df.collect())


@pytest.mark.parametrize("parts", [1, 7])
def test_audit(spark, parts):
    rows = some_rows()
    df = spark.createDataFrame(rows, SCHEMA).withColumns({"labels": F.lit(1), "fault": F.lit("x"), "kind": F.lit(9)}).repartition(5)
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        got = rows_of(conversations.audited(conversations.damaged(df), df))
        plain = [(c, t, " " if r is None else r, " " if x is None else x) for c, t, r, x in rows]
        whole = rows_of(conversations.audited(df))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert got == expected(broken(rows), {r[0] for r in rows})
    assert whole == expected(plain, {r[0] for r in rows})
    nothing = df.filter("turn > 99")
    assert conversations.audited(nothing).collect() == [] == conversations.repaired(nothing).collect()
    assert {r.audit for r in conversations.audited(nothing, df).collect()} == {""}


def test_a_conversation_that_holds_most_rows(spark):
    """It goes over many ranges, so it is searched in pieces."""
    rng = random.Random(5)
    long = [(1, i, rng.choice(["user", "assistant", "assistant", "system"]), rng.choice(["Yes.", "No"]) if rng.random() < 0.2 else f"{i}.") for i in range(900)]
    rows = long + [(c, t, r, "Hm.") for c in range(2, 40) for t, r in ((0, "user"), (1, "assistant"))]
    spark.conf.set("spark.sql.shuffle.partitions", "9")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        df = spark.createDataFrame(rows, SCHEMA).repartition(3)
        got = rows_of(conversations.audited(df))
        lines = [r for r in conversations.repaired(df).collect() if r.conv_id == 1]
        ranges = conversations.edited(conversations.keyed(df)).filter("conv_id = 1").select(F.spark_partition_id()).distinct().count()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    import sys

    before = sys.getrecursionlimit()
    sys.setrecursionlimit(20_000)
    try:
        assert got == expected(rows, {r[0] for r in rows})
    finally:
        sys.setrecursionlimit(before)
    assert ranges > 3
    sha = hashlib.sha256("\n".join(f"{r.role}:{r.text}" for r in sorted(lines, key=lambda r: r.place)).encode()).hexdigest()
    assert any(sha in x for x in got)


# --- mixing --------------------------------------------------------------------------------------------------------------

MIX = [
    (1, "a b c", "news"), (2, "one two", "news"), (2, "one two", "news"), (3, None, "news"), (None, "x y z w", "web"), (None, "x y z w", "web"), (4, " \t\n", "web"), (5, "q " * 5000, "web"),
    (6, "lone", ""), (7, "no source here", None), (8, "r s t u v", "books"), (9, "é ü ö", "books"), *((100 + i, "w " * (i % 7 + 1), "books") for i in range(200)),
]


def shares(sizes, weights=(3, 1, 2), share=1.5, most=2):
    """Targets by resharing the excess until none is above."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % 3] for i, s in enumerate(names)}
    full, amount = set(), share * sum(sizes.values())
    while True:
        left = amount - sum(most * sizes[s] for s in full)
        open_ = sum(weight[s] for s in names if s not in full)
        target = {s: most * sizes[s] if s in full else left * weight[s] / open_ for s in names}
        above = {s for s in names if target[s] > most * sizes[s]}
        if not above:
            return target
        full |= above


def words(t):
    return len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))


def test_mix(spark):
    df = spark.createDataFrame(MIX, "doc_id long, text string, source string").withColumns({"size": F.lit("x"), "target": F.lit(1), "n": F.lit(2), "epoch": F.lit(3)}).repartition(5)
    got = mixing.planned(df).collect()
    sizes = collections.Counter()
    for _, t, s in MIX:
        sizes[s] += words(t)
    target = shares({s: sizes[s] for s in {s for *_, s in MIX}})
    assert sorted((repr(r.doc_id), r.size) for r in got) == sorted((repr(d), words(t)) for d, t, _ in MIX)
    taken = collections.Counter()
    for r in got:
        name = None if r.no_source else r.source
        assert r.source_size == sizes[name] and abs(r.target - target[name]) < 1e-6 and 0 <= r.taken <= 2 * r.size and r.taken == r.epochs * r.size + r.part
        taken[name] += r.taken
    assert all(abs(taken[s] - target[s]) <= 0.5 + 1e-9 for s in target)
    assert sorted(map(repr, mixing.planned(df.repartition(2)).collect())) == sorted(map(repr, got))
    mix = mixing.mixed(df).collect()
    given = collections.Counter()
    for r in mix:
        given[r.source] += words(r.text)
    assert given == +taken and mixing.mixed(df).columns == [c for c in df.columns if c != "epoch"] + ["epoch"]
    whole = {(d, t) for d, t, _ in MIX}
    cut = [r for r in mix if (r.doc_id, r.text) not in whole]
    assert len(cut) <= len(target) and all(any(d == r.doc_id and t.startswith(r.text) for d, t in whole if t) for r in cut)
    assert mixing.planned(df.filter("doc_id = -5")).collect() == [] == mixing.mixed(df.filter("doc_id = -5")).collect()


def test_mix_without_words_and_beyond_the_bound(spark):
    df = spark.createDataFrame([(1, " ", "a"), (2, None, None)], "doc_id long, text string, source string")
    assert sorted((r.doc_id, r.target, r.taken) for r in mixing.planned(df).collect()) == [(1, 0.0, 0), (2, 0.0, 0)]
    df = spark.createDataFrame([(1, "a b", "a"), (2, "c", None)], "doc_id long, text string, source string")
    assert sorted((r.doc_id, r.target, r.taken) for r in mixing.planned(df, share=3.0).collect()) == [(1, 4.0, 4), (2, 2.0, 2)]


def test_a_source_of_copies(spark):
    """A third of the rows are one row, and it is the one at the cut."""
    rows = [(1, "same words here", "a")] * 300 + [(i, f"text {i}", f"s{i % 9}") for i in range(2, 600)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(6)
    got = mixing.planned(df).collect()
    by = collections.Counter()
    for r in got:
        by[r.source] += r.taken
    assert all(abs(by[r.source] - r.target) <= 0.5 + 1e-9 for r in got) and len(got) == len(rows)


# --- clustering ----------------------------------------------------------------------------------------------------------


def lloyd(rows, k, rounds, d):
    kept = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if v is not None and len(v) == d and all(x is not None and math.isfinite(x) for x in v)]
    kept = [(i, [max(-(1 << 27), min(1 << 27, x)) for x in q]) for i, q in kept]
    order = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"2:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1]))
    cents = [q for _, q in order[:k]]
    near = lambda q: min((sum((a - b) ** 2 for a, b in zip(q, c, strict=True)), n) for n, c in enumerate(cents))
    for _ in range(rounds):
        groups = collections.defaultdict(list)
        for _, q in kept:
            groups[near(q)[1]].append(q)
        cents = [[sum(x) // len(groups[n]) for x in zip(*groups[n], strict=True)] if n in groups else c for n, c in enumerate(cents)]
    best = [(i, *near(q)) for i, q in kept]
    own = collections.Counter()
    for _, distance, n in best:
        own[n] += distance
    limit = (1 << 63) - 1
    shas = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in cents]
    return sorted(repr((i, n, distance, min(own[n], limit), min(sum(own.values()), limit), shas[n])) for i, distance, n in best), cents


def vectors(n, d, seed=1):
    rng = random.Random(seed)
    base = [[rng.gauss(0, 0.3) for _ in range(d)] for _ in range(6)]
    return [(i, [x + rng.gauss(0, 0.05) for x in rng.choice(base)]) for i in range(n)]


@pytest.mark.parametrize("wide", [0, 3e38])
def test_clusters(spark, wide):
    d = 4
    rows = vectors(150, d) + [(7, [0.5] * d)] * 80 + [(None, [0.1] * d), (None, [0.1] * d), (None, [-0.2] * d), (900, None), (901, []), (902, [0.1] * (d + 1)), (903, [0.1, None, 0.2, 0.3]), (904, [math.nan] * d), (905, [math.inf, 0.0, 0.0, 0.0])]
    rows += [(910, [wide, -wide, 0.0, 1.0])] * bool(wide)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({"cluster": F.lit("x"), "n": F.lit(1), "same": F.lit(2), "q": F.lit(3)}).repartition(4)
    for k in (5, 1000):
        got, cents = clusters.clustered(df, k, 3, dimensions=d)
        want, cents_wanted = lloyd(rows, k, 3, d)
        assert rows_of(got) == want and cents == cents_wanted
    assert clusters.clustered(df.filter("vec_id = 900"), 5, 3, dimensions=d)[0].collect() == []
