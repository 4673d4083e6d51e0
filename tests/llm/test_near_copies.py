"""Near copies of texts against brute-force Jaccard similarity."""

from __future__ import annotations

import collections
import random

import pytest
from oracle import duck
from test_operators import DOCS, EDGE

import corpus_pipeline
from decretum.llm import near_copies, queries
from decretum.llm.common import settle


def shingles(text, size=5):
    words = (text or "").lower().split()
    return {tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1))} if words else set()


def brute_kept(texts):
    """Index of the first text of each group that pairs at 0.8 or more connect."""
    sets, root = [shingles(t) for t in texts], list(range(len(texts)))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if root[i] != root[j] and 5 * len(a & b) >= 4 * len(a | b):
                low, high = sorted((root[i], root[j]))
                root = [low if r == high else r for r in root]
    return sorted(set(root))


def planted():
    """Unrelated texts, near copies of some at all degrees, one large group of near copies, short and empty texts."""
    r, words = random.Random(6), [f"w{i}" for i in range(900)]
    text = lambda n: [r.choice(words) for _ in range(n)]
    changed = lambda t, k: [r.choice(words) if i in at else w for at in [set(r.sample(range(len(t)), k))] for i, w in enumerate(t)]
    footer, out = text(30), []
    for n in (40, 120, 200, 600):
        for k in range(9):
            base = text(n)
            out += [base + footer, changed(base, k * n // 200) + footer]
    base = text(150)
    out += [changed(base, r.randint(0, 6)) for _ in range(90)]
    return [" ".join(t) for t in out] + ["", " ", "a b", "A  b", "a b c d e", "a b c d e f"]


@pytest.mark.parametrize("small", [32, 2])
def test_near_dedup_finds_all_pairs_at_the_similarity(spark, monkeypatch, small):
    monkeypatch.setattr(near_copies, "SMALL", small)
    texts = planted()
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in enumerate(texts)], DOCS)
    assert sorted(r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, "").collect()) == brute_kept(texts)


def test_near_dedup_drops_a_row_only_for_another_of_its_group(spark):
    long = " ".join(f"w{i}" for i in range(100))
    rows = [(1, "a b c", "en", "s", 1), (2, "other text of two", "en", "s", 1), (2, long, "en", "s", 1), (2, "a b c", "en", "s", 1), (3, long + " end", "en", "s", 1)]
    docs = spark.createDataFrame(rows, DOCS)
    assert sorted((r.doc_id, r.text) for r in corpus_pipeline.near_dedup(spark, docs, "").collect()) == sorted((r[0], r[1]) for r in rows[:3])
    assert corpus_pipeline.near_dedup(spark, spark.createDataFrame(EDGE[2:3] * 3, DOCS), "").count() == 1


def test_small_corpus_after_the_first_stages(spark):
    sf = "/root/testdata/sf0.001"
    docs = queries.table(spark, sf, "documents")
    cut = settle(corpus_pipeline.boilerplate(spark, settle(corpus_pipeline.quality_rules(spark, docs, sf)), sf))
    alone = settle(corpus_pipeline.near_dedup(spark, cut, sf))
    rows = sorted((r.doc_id, r.text) for r in cut.collect())
    assert sorted(r.doc_id for r in alone.collect()) == [rows[i][0] for i in brute_kept([t for _, t in rows])]

    mixed = settle(corpus_pipeline.mixture(spark, alone, sf))
    con = duck(sf)
    con.register("alone", alone.toPandas())
    want = con.execute(f"WITH {queries.mix_sql('alone')} SELECT doc_id, copies FROM mixed WHERE copies > 0").fetchall()
    assert dict(want) == dict(collections.Counter(r.doc_id for r in mixed.collect()))

    packed = corpus_pipeline.packing(spark, mixed, sf)
    assert packed.where("piece = 0").count() == mixed.count()
