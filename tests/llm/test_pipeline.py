"""The pipeline's stages: columns, edge cases, and results against DuckDB or brute force; the queries against their SQL."""

from __future__ import annotations

import collections

import pytest
from oracle import compare, duck
from pyspark.sql import functions as F
from test_operators import DOCS, EDGE, brute_components, brute_fingerprint

import corpus_pipeline
from decretum.llm import queries
from decretum.llm.byte_net import quality_scores, train_quality_net
from decretum.llm.common import settle
from decretum.llm.simhash import simhash_components

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_its_sql(spark, con, name):
    ok, note, _ = compare(spark, con, name, SF, queries.QUERIES, queries.ORACLES)
    assert ok, note


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES)
def test_stage_on_edge_cases(spark, name, stage):
    docs = spark.createDataFrame(EDGE, DOCS).withColumns({c: F.lit("x") for c in ("kept", "n_words", "n_lines", "mix_copies", "fingerprint", "_text", "doc")})
    out = stage(spark, docs, SF)
    if name != "best-fit packing":
        assert out.columns == docs.columns and out.dtypes == docs.dtypes
    rows = [r.doc_id for r in out.collect()]
    if name == "line dedup":
        assert len(rows) == len(EDGE)
    if name == "simhash near-dedup":
        assert collections.Counter(rows) == collections.Counter([1, 3, 6, 8, None, None])
    empty = stage(spark, docs.limit(0), SF)
    assert empty.columns == out.columns and empty.count() == 0


def test_stages_on_a_small_corpus(spark, con):
    docs = queries.table(spark, SF, "documents")
    kept = settle(corpus_pipeline.quality_rules(spark, docs, SF))
    labels = {r.doc_id: r.quality for r in queries.table(spark, SF, "labels").collect()}
    verdicts = {r.doc_id: r for r in queries.op1_quality_rules(spark, SF).collect()}
    assert {r.doc_id for r in kept.collect()} == {i for i, r in verdicts.items() if r.kept}
    assert all(verdicts[i].kept or verdicts[i].base_failed for i, q in labels.items() if q == 1)

    cut = settle(corpus_pipeline.boilerplate(spark, kept, SF))
    con.register("kept", kept.toPandas())
    want = con.execute(f"WITH {queries.line_sql('kept')} SELECT doc_id, array_to_string(kept, chr(10)) FROM lined").fetchall()
    assert dict(want) == {r.doc_id: r.text for r in cut.collect()}


def test_classifiers_on_held_out_labels(spark):
    """Both classifiers against labels that they have not seen."""
    sf = "/root/testdata/sf0.01"
    labels = queries.table(spark, sf, "labels")
    docs = queries.table(spark, sf, "documents")
    scored = quality_scores(docs, train_quality_net(docs, labels)).join(labels, "doc_id").where("held_out").collect()
    good, bad = [r.score for r in scored if r.quality], [r.score for r in scored if not r.quality]
    assert sum(g > b for g in good for b in bad) >= 0.8 * len(good) * len(bad)
    toxic = queries.op10_toxicity(spark, sf).join(labels.withColumnRenamed("toxic", "y"), "doc_id").collect()
    assert sum(r.toxic == bool(r.y) for r in toxic) >= 0.95 * len(toxic)


def test_fingerprints_equal_brute_force(spark):
    rows = simhash_components(queries.table(spark, SF, "documents")).collect()
    texts = {r.doc_id: r.text for r in queries.table(spark, SF, "documents").collect()}
    order = sorted(texts)
    prints = [brute_fingerprint(texts[i], 3) for i in order]
    comps = brute_components(prints)
    want = {i: (f"{p:016x}", order[comps.index(c)]) for i, p, c in zip(order, prints, comps, strict=True)}
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in rows} == want
