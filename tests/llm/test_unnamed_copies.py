"""Near copies among documents without an id are found too."""

from test_operators import DOCS

import corpus_pipeline


def test_documents_without_an_id_are_judged_among_themselves(spark):
    long = " ".join(f"w{i}" for i in range(100))
    rows = [(1, long, "en", "s", 1), (None, long + " a", "en", "s", 1), (None, long + " b", "en", "s", 1), (None, long + " b", "en", "s", 1), (None, "other words", "en", "s", 1), (2, long + " c", "en", "s", 1)]
    out = corpus_pipeline.near_dedup(spark, spark.createDataFrame(rows, DOCS), "").collect()
    named, unnamed = [r.doc_id for r in out if r.doc_id is not None], [r.text for r in out if r.doc_id is None]
    assert named == [1] and len(unnamed) == 2 and "other words" in unnamed and set(unnamed) <= {"other words", long + " a", long + " b"}
