"""The pipeline, stage by stage, against the operators' brute-force rules."""

import os

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")
SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, before = docs.columns, {r.doc_id: r.text for r in docs.collect()}
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:4]:
        docs = stage(spark, docs, SF)
        assert docs.columns == columns
        docs = spark.createDataFrame(docs.collect(), docs.schema)
        kept[name] = {r.doc_id: r.text for r in docs.collect()}
    assert all(len((t or "").split()) >= 50 for t in kept["quality"].values())
    bare = ["".join(t.split()) for t in kept["exact_dedup"].values()]
    assert len(set(bare)) == len(bare) and {"".join(t.split()) for t in kept["quality"].values()} == set(bare)
    from tests.llm.test_operators import near_truth

    classes = near_truth(sorted(kept["exact_dedup"].items()))
    assert len(kept["near_dedup"]) == len({eval(c)[1] for c in classes})
    assert all(before[d] == t or "[SECRET]" in t for d, t in kept["secrets"].items()) and kept["secrets"].keys() == kept["near_dedup"].keys()
    packed = corpus_pipeline.STAGES[4][1](spark, docs, SF).collect()
    assert {r.doc_id for r in packed} == set(kept["secrets"])
