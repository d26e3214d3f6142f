"""Queries over texts, pages and documents, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from nightloom.functions import clock, names
from nightloom.operators import claims
from nightloom.plans.inputs import SITES, table
from nightloom.sources import documents as docs
from nightloom.sources import pages

QUERIES: dict = {}
SQL: dict = {}


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return put


#: Texts that make claims: short sentences derived from orders, with numbers that fit or don't.
SAID = """said AS (SELECT o_orderkey AS id, 'At ' || lpad(CAST(o_orderkey * 7 % 24 AS VARCHAR), 2, '0') || ':' || lpad(CAST(o_orderkey * 11 % 60 AS VARCHAR), 2, '0') || ' the cloud is ' || (o_orderkey * 13 % 101) || '% for ' || (o_orderkey % 9) || '.5 hours. It is ' || (o_orderkey * 17 % 300) || ' km away' || CASE WHEN o_orderkey % 10 = 0 THEN '; it clears soon.' ELSE '.' END AS text FROM orders)"""


def said(spark, sf_dir):
    k = F.col("o_orderkey")
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    text = F.concat(
        F.lit("At "), two(k * 7 % 24), F.lit(":"), two(k * 11 % 60), F.lit(" the cloud is "), (k * 13 % 101).cast("string"), F.lit("% for "), (k % 9).cast("string"), F.lit(".5 hours. It is "), (k * 17 % 300).cast("string"),
        F.lit(" km away"), F.when(k % 10 == 0, "; it clears soon.").otherwise("."),
    )
    return table(spark, sf_dir, "orders").select(k.alias("id"), text.alias("text"))


CLAIMS = f"""{SAID}, cl AS (SELECT id, 'time' AS kind, unnest(regexp_extract_all(text, '([0-9]{{2}}:[0-9]{{2}})', 1)) AS claim FROM said UNION ALL SELECT id, 'percent', unnest(regexp_extract_all(text, '([0-9.]+)%', 1)) FROM said
    UNION ALL SELECT id, 'hours', unnest(regexp_extract_all(text, '([0-9.]+) hours', 1)) FROM said UNION ALL SELECT id, 'km', unnest(regexp_extract_all(text, '([0-9.]+) km', 1)) FROM said)"""


@query(f"WITH {CLAIMS} SELECT * FROM cl")
def extracted_claims(spark, sf_dir):
    return claims.claims(said(spark, sf_dir), ["id"], "text", ["time", "percent", "hours", "km"])


@query(f"""WITH {CLAIMS}, al AS (SELECT o_orderkey AS id, 'percent' AS kind, CAST(o_orderkey * 13 % 100 AS VARCHAR) AS claim FROM orders UNION ALL SELECT o_orderkey, 'km', CAST(o_orderkey * 17 % 301 AS VARCHAR) FROM orders) SELECT * FROM cl ANTI JOIN al USING (id, kind, claim) WHERE kind IN ('percent', 'km')""")
def claims_vs_allowed(spark, sf_dir):
    k = F.col("o_orderkey")
    o = table(spark, sf_dir, "orders")
    allowed = o.select(k.alias("id"), F.lit("percent").alias("kind"), (k * 13 % 100).cast("string").alias("claim")).unionByName(o.select(k.alias("id"), F.lit("km").alias("kind"), (k * 17 % 301).cast("string").alias("claim")))
    return claims.unsupported(claims.claims(said(spark, sf_dir), ["id"], "text", ["percent", "km"]), allowed, ["id"])


@query(f"""WITH {CLAIMS} SELECT id, kind, claim, CAST(claim AS DOUBLE) AS said, id * 13 % 97 * 1.0::DOUBLE AS value FROM cl WHERE kind = 'percent' AND abs(CAST(claim AS DOUBLE) - id * 13 % 97) > 1""")
def claims_out_of_range(spark, sf_dir):
    values = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.lit("percent").alias("kind"), (F.col("o_orderkey") * 13 % 97 * 1.0).alias("value"))
    out = claims.out_of_range(claims.claims(said(spark, sf_dir), ["id"], "text", ["percent"]), values, ["id"], 1.0)
    return out.select("id", "kind", "claim", "said", "value")


@query(f"""WITH {SAID} SELECT id, 'It is ' || (id * 17 % 300) || ' km away; it clears soon.' AS sentence FROM said WHERE id % 10 = 0""")
def vague_time_words(spark, sf_dir):
    return claims.vague(said(spark, sf_dir), ["id"], "text")


@query("""SELECT c_nationkey AS k, label FROM (SELECT c_nationkey, CAST(c_custkey % 701 AS INTEGER) AS label, count(*) OVER (PARTITION BY c_nationkey, c_custkey % 701) AS n FROM customer) WHERE n = 1""")
def unique_directions(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("k"), (F.col("c_custkey") % 701).cast("int").alias("label"))
    return claims.unique_only(c, ["k"], "label")


@query("""SELECT o_orderkey, unnest(list_filter([CASE WHEN o_totalprice <= 200000 IS NOT TRUE THEN 'price' END, CASE WHEN (o_orderstatus IN ('F', 'O')) IS NOT TRUE THEN 'status' END, CASE WHEN (CASE WHEN o_orderkey % 11 > 0 THEN true END) IS NOT TRUE THEN 'key' END], lambda x: x IS NOT NULL)) AS rule FROM orders""")
def document_violations(spark, sf_dir):
    rules = {"price": F.col("o_totalprice") <= 200_000, "status": F.col("o_orderstatus").isin("F", "O"), "key": F.when(F.col("o_orderkey") % 11 > 0, F.lit(True))}
    return claims.violations(table(spark, sf_dir, "orders"), ["o_orderkey"], rules)


@query("""SELECT p_partkey, a AS name, b AS other, (a = b OR contains(a, b) OR contains(b, a)) AS related FROM (SELECT p_partkey, regexp_replace(replace(lower(p_name), ' ', ''), '(park|parking|viewpoint|observatory)$', '') AS a, replace(lower(split_part(p_name, ' ', 2)), ' ', '') AS b FROM part)""")
def name_match(spark, sf_dir):
    from nightloom.operators.sites import bare_name, names_related

    a, b = bare_name(F.col("p_name")), bare_name(F.split("p_name", " ")[1])
    return table(spark, sf_dir, "part").select("p_partkey", a.alias("name"), b.alias("other")).withColumn("related", names_related(F.col("name"), F.col("other")))


@query()
def name_similarity(spark, sf_dir):
    """Normalised names and their similarity ratio: Unicode normalisation and sequence matching have no SQL."""
    p = table(spark, sf_dir, "part").select("p_partkey", F.col("p_name").alias("a"), F.concat(F.lit("Ｔｈｅ "), "p_name").alias("b"))
    return p.select("p_partkey", names.normalized("b").alias("name"), F.round(names.similarity("a", "b"), 6).alias("ratio"))


@query("""SELECT page_id, regexp_extract(html, '<html[^>]* lang="([a-z]+)"', 1) AS lang, len(regexp_extract_all(html, '<p[ >]')) AS paragraphs, len(regexp_extract_all(html, '<a [^>]*href="([^"]*)"', 1)) AS links, regexp_extract(html, '<a [^>]*href="([^"]*)"', 1) AS first_link, split_part(split_part(url, '://', 2), '/', 1) AS host, regexp_matches(url, '^https?://[^\\s"''<>]+$') AS safe FROM pages""")
def html_card_extract(spark, sf_dir):
    return pages.cards(table(spark, sf_dir, "pages"))


@query("""SELECT page_id, CAST(i AS INTEGER) AS pos, l[i + 1] AS href FROM (SELECT page_id, regexp_extract_all(html, '<a [^>]*href="([^"]*)"', 1) AS l, unnest(range(len(l))) AS i FROM pages)""")
def html_links(spark, sf_dir):
    return pages.links(table(spark, sf_dir, "pages"))


@query()
def html_tree(spark, sf_dir):
    """Elements of each page with their depth and own text, by an HTML parser in Arrow batches: how many, the greatest depth (null
    without any), the elements themselves, and the text outside them."""
    return pages.trees(table(spark, sf_dir, "pages")).select("page_id", F.size("tree").cast("long").alias("elements"), F.array_max(F.transform("tree", lambda x: x["depth"])).alias("depth"), "tree", "outside")


@query("""SELECT c_custkey, replace(replace(replace(replace(replace(x, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#x27;') AS escaped, replace(replace(replace(x, '<', '\\u003c'), '>', '\\u003e'), '&', '\\u0026') AS embedded, length(c_name) AS width FROM (SELECT c_custkey, c_name, '<b>"' || c_name || '" & ''co''</b>' AS x FROM customer)""")
def html_escape(spark, sf_dir):
    x = F.concat(F.lit('<b>"'), "c_name", F.lit("\" & 'co'</b>"))
    return table(spark, sf_dir, "customer").select("c_custkey", clock.html_escape(x).alias("escaped"), clock.script_embed(x).alias("embedded"), clock.display_width(F.col("c_name")).cast("long").alias("width"))


@query("""SELECT c_custkey, CASE WHEN c_custkey % 3 = 1 OR c_custkey % 3 = 2 THEN NULL ELSE c_acctbal END AS v FROM customer""")
def json_safe_numbers(spark, sf_dir):
    k = F.col("c_custkey") % 3
    v = F.when(k == 1, F.lit(float("nan"))).when(k == 2, F.lit(float("inf"))).otherwise(F.col("c_acctbal"))
    return table(spark, sf_dir, "customer").select("c_custkey", clock.json_safe(v).alias("v"))


@query("""SELECT s_suppkey, unnest([s_name || ' A', s_name]) AS alias FROM supplier UNION ALL SELECT s_suppkey, s_name || ' A・' || s_name FROM supplier""")
def alias_list(spark, sf_dir):
    rows = table(spark, sf_dir, "supplier").select("s_suppkey", F.concat("s_name", F.lit(" A・"), "s_name").alias("name"))
    return rows.select("s_suppkey", F.explode(claims.aliases(F.col("name"))).alias("alias"))


@query("""SELECT doc_id FROM documents WHERE NOT regexp_matches(text, '(?i)token')""")
def drop_log_lines(spark, sf_dir):
    return table(spark, sf_dir, "documents").filter(~F.col("text").rlike("(?i)token")).select("doc_id")


@query(f"""WITH {SITES} SELECT id, name, CAST(lat AS DOUBLE) AS lat, CAST(lon AS DOUBLE) AS lon, 'curated' AS origin, coalesce(lift, false) AS requires_lift_access FROM sites WHERE id % 9 > 0""")
def spot_json(spark, sf_dir):
    """Site annotations written as JSON lines with a declared schema, and read back."""
    return docs.json_round_trip(spark, sf_dir)


@query("""SELECT s AS site, CAST(az AS INTEGER) AS az, round((az * 7 + s * 13) % 200 / 10.0, 3) AS alt FROM (SELECT s_suppkey AS s, unnest(range(360)) AS az FROM supplier)""")
def horizon_csv(spark, sf_dir):
    """Horizon profiles written as CSV, sorted by site, and scanned with their checks."""
    return docs.csv_round_trip(spark, sf_dir)


@query("""SELECT s_suppkey AS tile, CAST(z AS INTEGER) AS py, CAST(x AS INTEGER) AS px, CASE WHEN (z * 16 + x + s_suppkey) % 7 <> 0 THEN (z * 31 + x * 17 + s_suppkey) % 500 / 10.0 END AS elev FROM supplier, range(16) a(z), range(16) b(x)""")
def dem_text(spark, sf_dir):
    """A tile's text, comma-separated with a marker for missing values, as rows."""
    return docs.tile_text(spark, sf_dir)


@query("""SELECT user_id % 3 AS model, CAST(CAST(ts AS DATE) AS VARCHAR) AS day, count(*) AS hours FROM events WHERE event_type = 'view' AND value <= 40 GROUP BY 1, 2""")
def forecast_payload(spark, sf_dir):
    """Parallel arrays as a forecast service returns them, as long rows with nulls left out."""
    return docs.payload_rows(spark, sf_dir)
