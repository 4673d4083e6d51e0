"""The filter audit against a run of every chain of filters, one document at a time."""

from __future__ import annotations

import itertools
import re

from pyspark.sql import functions as F
from test_operators import DOCS, EDGE

from decretum.llm.filter_audit import ROW_LIMIT, filter_audit

LABELS = "doc_id long, quality int, toxic int"
COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")


def brute(docs, labels):
    texts = [t or "" for _, t, *_ in docs]
    fails = []
    for (i, *_), t in zip(docs, texts, strict=True):
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        smaller = any(j is not None and i is not None and j < i and u == t for (j, *_), u in zip(docs, texts, strict=True))
        tests = (len(words) < 200, 100 * len(set(words)) < 50 * len(words), 100 * len(re.findall("[A-Z]", t)) > 2 * len(t), bool(re.search("[#$%&*|]", t)), smaller)
        fails.append({x for x, bad in zip("ABCDE", tests, strict=True) if bad})
    parts = [d[3] or "" for d in docs]
    marked = lambda i, k: i is not None and any(x[k] == 1 for x in labels if x[0] == i)
    out, shapley = {}, {}
    for part in set(parts):
        for order in itertools.permutations("ABCDE"):
            left = [n for n, p in enumerate(parts) if p == part]
            gone = []
            for step, f in enumerate(order, 1):
                now = [n for n in left if f in fails[n]]
                redundant = sum(f in fails[n] for n in gone)
                alone = sum(fails[n] == {f} for n in left + gone)
                left = [n for n in left if n not in now]
                gone += now
                out[part, "".join(order), step] = [len(left), len(now), redundant, alone, *[sum(marked(docs[n][0], k) for n in now) for k in (1, 2)]]
                shapley[part, f] = shapley.get((part, f), 0) + len(now)
    return {k: (*v, shapley[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def compared(spark, docs, labels):
    frame = spark.createDataFrame(docs, DOCS).withColumns({c: F.lit("x") for c in ("part", "n", "digest", "quality", "id", "mask")})
    before = spark.conf.get(ROW_LIMIT)
    rows = filter_audit(frame, spark.createDataFrame(labels, LABELS)).collect()
    assert spark.conf.get(ROW_LIMIT) == before
    got = {(r.part, r.filter_order, r.step): (*[r[c] for c in COUNTS], r.shapley) for r in rows}
    assert len(got) == len(rows) and got == brute(docs, labels)
    return rows


def test_edge_cases(spark):
    labels = [(1, 1, 0), (1, None, 1), (2, 1, 0), (2, 0, None), (6, 1, 1), (8, 0, 1), (None, 1, 1), (99, 1, 1)]
    assert len(compared(spark, EDGE, labels)) == 600 * len({d[3] or "" for d in EDGE})
    empty = filter_audit(spark.createDataFrame([], DOCS), spark.createDataFrame([], LABELS))
    assert empty.count() == 0 and empty.columns[:3] == ["part", "filter_order", "step"]
    compared(spark, EDGE[:3], [])


def test_conditions_at_their_borders(spark):
    words = lambda n, kinds: " ".join(f"w{i % kinds}" for i in range(n))
    texts = [words(199, 199), words(200, 100), words(200, 99), words(201, 101), "X" + "y" * 49, "XX" + "y" * 98, "XXX" + "y" * 97, "é" * 50 + "X", "a|b", "a~b", "Ä" * 9]
    docs = [(i, t, "en", "s", 1) for i, t in enumerate(texts + texts[::-1])]
    compared(spark, docs, [(i, i % 2, int(i % 3 == 0)) for i in range(22)])


def test_a_text_with_a_third_of_all_rows(spark):
    docs = [(i, "same" if i % 3 == 0 else f"text {i}", "en", f"s{i % 2}", 1) for i in range(60)]
    rows = compared(spark, docs, [(i, 1, 0) for i in range(60)])
    assert {r.unique_fails for r in rows if r.filter_order[r.step - 1] == "E"} == {0}
