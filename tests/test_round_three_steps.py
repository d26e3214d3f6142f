"""steps that were one task, shuffled every claim, or held all elements of a batch."""

import pyarrow as pa

from nightloom.operators import alike, textcheck
from nightloom.sources import pages


def test_pairs_of_names_are_dealt(spark):
    df = spark.createDataFrame([(f"viewpoint {i:03d}",) for i in range(60)], "name string")
    assert alike.alike(df, df).rdd.getNumPartitions() >= 8


def test_claims_without_a_key(spark):
    """A claim that an event fits is no finding, also where its text has no key."""
    claims = spark.createDataFrame([(None, 0, "Moon", "rises", "exact", 60), (1, 0, "Moon", "rises", "exact", 60), (2, 0, "Moon", "rises", "exact", 300), (3, 0, "Vega", "sets", "exact", 60)], "id long, clause int, name string, verb string, phrase string, minute int")
    events = spark.createDataFrame([("Moon", "rises", 60), ("Moon", "rises", 900)], "name string, verb string, event int")
    assert sorted(r.id for r in textcheck.without_event(claims, events, ["id"]).collect()) == [2, 3]


def test_verdicts_meet_what_they_may_say_once(spark):
    docs = spark.createDataFrame([(1, "3 nights, 20%, 20%"), (2, "3 nights, mag 5.2")], "id long, text string")
    allowed = spark.createDataFrame([(1, "nights", "3"), (1, "percent", "21"), (2, "mag", "5.2"), (2, "nights", None)], "id long, kind string, claim string")
    found = textcheck.verdict_findings(docs, allowed, ["id"], "text", ["Moon"])
    assert sorted(tuple(r) for r in found.collect()) == [(1, "percent", "20"), (2, "mag", "5.2"), (2, "nights", "3")]
    assert "LeftAnti" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_elements_come_in_small_batches():
    html = "<div>" + "<p>x</p>" * 9_000 + "</div>"
    batch = pa.RecordBatch.from_pydict({"page_id": [1, 2, None], "html": [html, html, None]})
    got = list(pages.parsed(iter([batch])))
    assert len(got) == 2 and sum(b.num_rows for b in got) == 18_002
