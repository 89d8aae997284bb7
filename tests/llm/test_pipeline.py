import re

import corpus_pipeline
from keyloom.llm.shared import keep, table


def test_stages(spark, data):
    docs = table(spark, data, "documents")
    columns, counts = docs.columns, [docs.count()]
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, keep(stage(spark, docs, data), f"test-{name}")
        counts.append(docs.count())
        if name != "encoding":
            assert docs.columns == columns
        if name in ("quality", "dedup"):
            assert {r.doc_id for r in docs.collect()} <= {r.doc_id for r in before.collect()}
        if name == "secrets":
            assert counts[-1] == counts[-2]
            assert not any(re.search(r"AKIA[0-9A-Z]{16}", r.text) for r in docs.collect())
    assert counts[0] > counts[1] > counts[2] == counts[3] < counts[4] == counts[5]


def test_stages_of_odd_and_empty_input(odd, empty, spark, data):
    """Nulls, repeated rows, very long texts, clashing names and no rows at all end no stage."""
    for docs in (odd, empty):
        for name, stage in corpus_pipeline.STAGES:
            before, docs = docs, keep(stage(spark, docs, data), f"odd-{name}")
            if name != "encoding":
                assert docs.columns == before.columns
            if name in ("secrets", "encoding"):
                assert docs.count() == before.count()
