"""Removal of repeated word windows against brute force, and the consistency of the symbols."""

from __future__ import annotations

import collections
import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_operators import DOCS, EDGE

from decretum.llm import passage_dedup, queries
from decretum.llm.passage_dedup import LAST, remove_passages
from decretum.llm.recompression import mixed, window_keys, window_symbols


def brute(rows, width=13):
    """Every window of every text in a table of its smallest id."""
    split = [(LAST if i is None else i, (t or "").encode().split()) for i, t in rows]
    least = {}
    for k, w in split:
        for p in range(len(w) - width + 1):
            key = tuple(w[p : p + width])
            least[key] = min(k, least.get(key, k))
    out = []
    for (i, _), (k, w) in zip(rows, split, strict=True):
        gone = {p + j for p in range(len(w) - width + 1) if least[tuple(w[p : p + width])] < k for j in range(width)}
        kept = b" ".join(x for j, x in enumerate(w) if j not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept).hexdigest()))
    return collections.Counter(out)


def found(spark, rows, width=13):
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], DOCS).withColumns({c: F.lit("x") for c in ("k", "th", "ranges", "id", "bucket")})
    return collections.Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in remove_passages(docs, width).collect())


@pytest.mark.parametrize("letters", [1, 2, 3, 50])
def test_equal_windows_have_equal_keys(letters):
    r = np.random.default_rng(letters)
    tokens, ends = r.integers(0, letters, 6000), r.random(6000) < 0.01
    for width in (1, 2, 5, 13):
        starts, keys = window_keys(mixed(tokens.astype(np.uint64)), ends, width)
        seen = {}
        for s, key in zip(starts.tolist(), keys.tolist(), strict=True):
            assert not ends[s : s + width].any()
            assert seen.setdefault(tuple(tokens[s : s + width]), key) == key
        assert len(starts) == sum(not ends[s : s + width].any() for s in range(6000 - width + 1))


def test_symbols_of_equal_stretches_agree_inside():
    """A long repeat is covered by a few symbols that both places share, and each stands inside its window."""
    r = np.random.default_rng(1)
    part = r.integers(0, 10**6, 60).astype(np.uint64)
    text = np.concatenate([r.integers(0, 10**6, 40).astype(np.uint64), part, r.integers(0, 10**6, 40).astype(np.uint64), part])
    starts, names, at = window_symbols(mixed(text), np.zeros(len(text), bool), 13)
    assert (at >= starts).all() and (at < starts + 13).all()
    assert names[40:88].tolist() == names[140:188].tolist() and len(set(names[40:88].tolist())) < 30


def test_edge_cases(spark):
    rows = [(i, t) for i, t, *_ in EDGE]
    assert found(spark, rows) == brute(rows)
    assert found(spark, [(None, "a b c d"), (None, "b c d"), (5, "c d b c"), (5, "b c d")], 3) == brute([(None, "a b c d"), (None, "b c d"), (5, "c d b c"), (5, "b c d")], 3)
    empty = remove_passages(spark.createDataFrame([], DOCS))
    assert empty.count() == 0 and empty.columns == ["doc_id", "n_words", "n_removed", "kept_sha256"]
    with pytest.raises(ValueError):
        remove_passages(spark.createDataFrame([("a", "b")], "doc_id string, text string"))


@pytest.mark.parametrize("block", [1 << 18, 64])
def test_planted_passages(spark, monkeypatch, block):
    """Passages at all lengths around the window, copies, runs and periods, in blocks of any size."""
    monkeypatch.setattr(passage_dedup, "BLOCK", block)
    r = random.Random(7)
    word = lambda n, kinds=400: [f"w{r.randrange(kinds)}" for _ in range(n)]
    parts = [word(n) for n in (11, 12, 13, 14, 20, 60, 150)] + [["a"] * 40, ["a", "b"] * 20, ["a", "b", "c"] * 9]
    rows = []
    for i in range(120):
        t = word(r.randint(0, 40))
        for _ in range(r.randint(0, 3)):
            p = r.choice(parts)
            t += p[: r.randint(5, len(p))] if r.random() < 0.4 else p
            t += word(r.randint(0, 25))
        rows.append((r.choice([i, i, i, 7, None]), " ".join(t)))
    rows += [(i, rows[3][1]) for i in range(200, 260)] + rows[:5]
    assert found(spark, rows) == brute(rows)


def test_kept_text(spark):
    text = " ".join(f"w{i}" for i in range(30))
    docs = spark.createDataFrame([(1, text, "en", "s", 1), (2, f"x {text}\ty\n", "en", "s", 1)], DOCS)
    assert {r.doc_id: r.kept_text for r in remove_passages(docs, with_text=True).collect()} == {1: text, 2: "x y"}


def test_query_equals_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in queries.table(spark, sf, "documents").collect()]
    assert collections.Counter(tuple(r) for r in queries.op12_substring_dedup(spark, sf).collect()) == brute(rows)
