"""Lines that stand on a few hundredths of a site's pages, with the production ratio."""

from __future__ import annotations

import collections

import duckdb
from test_operators import DOCS

import corpus_pipeline
from decretum.llm import queries


def planted():
    """Lines on 2, 3 and 5 % of a site's pages, one on 1 % (not above the ratio), one on two pages of a small site; a site with a third of all rows."""
    rows = []
    for site, n in (("s1", 400), ("s2", 600), ("hot", 500)):
        for i in range(n):
            lines = [f"{site} own line {i}"]
            lines += [f"on {share} %" for share in (2, 3, 5, 1) if i * 100 < share * n]
            rows.append((len(rows), "\n".join(lines), "en", site, 1))
    return rows + [(len(rows) + i, f"small {i}\ntwice", "en", "small", 1) for i in range(2)]


def test_lines_on_a_few_hundredths_of_a_site_go(spark, tmp_path):
    rows = planted()
    docs = spark.createDataFrame(rows, DOCS)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    left = collections.Counter(line for r in corpus_pipeline.boilerplate(spark, docs, str(tmp_path)).collect() for line in r.text.split("\n"))
    assert {k: n for k, n in left.items() if n > 1} == {"on 1 %": 15, "twice": 2}
    got = {tuple(r) for r in queries.op8_line_dedup(spark, str(tmp_path)).collect()}
    assert sum(r[3] for r in got) == 150
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    names = ["doc_id", "source", "n_lines", "n_lines_removed", "kept_sha256"]
    assert got == set(con.execute(f"SELECT {', '.join(names)} FROM ({queries.LINE_SQL})").fetchall())
