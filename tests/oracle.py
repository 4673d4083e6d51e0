"""Run a registered query and its reference SQL side by side and compare the rows."""

from __future__ import annotations

import datetime
import decimal
import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def session(cores: int = 8):
    from pyspark.sql import SparkSession

    return (
        SparkSession.builder.master(f"local[{cores}]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )


def duck(sf_dir: str):
    import duckdb

    from decretum.catalog.fixtures import TABLES

    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def _plain(v):
    if v is None:
        return "~"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.9g}"
    if isinstance(v, int):
        return f"{float(v):.9g}" if abs(v) < 10**9 else str(v)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat(sep=" ")
    return str(v)


def _rows(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(_plain(r[i]) for i in order) for r in rows)


def compare(spark, con, name, sf_dir, queries, oracles):
    start = time.time()
    df = queries[name](spark, sf_dir)
    names = df.columns
    got = _rows(names, [tuple(r) for r in df.collect()])
    took = time.time() - start
    if name not in oracles:
        return len(got) > 0, f"{len(got)} rows, no oracle", took
    cur = con.execute(oracles[name])
    want_names = [c[0] for c in cur.description]
    want = _rows(want_names, cur.fetchall())
    if sorted(names) != sorted(want_names):
        return False, f"columns {sorted(names)} vs {sorted(want_names)}", took
    if got != want:
        a, b = [x for x in got if x not in set(want)][:3], [x for x in want if x not in set(got)][:3]
        return False, f"{len(got)} vs {len(want)} rows\n   spark {a}\n   duck  {b}", took
    return True, f"{len(got)} rows", took


if __name__ == "__main__":
    import __spark_entry__ as entry

    sf_dir = sys.argv[1]
    wanted = sys.argv[2:]
    spark = session()
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(sf_dir)
    queries, oracles = entry.queries(), entry.oracle_sql()
    bad = 0
    for name in queries:
        if wanted and not any(name.startswith(w) for w in wanted):
            continue
        try:
            ok, note, took = compare(spark, con, name, sf_dir, queries, oracles)
        except Exception as exc:  # noqa: BLE001
            ok, note, took = False, f"{type(exc).__name__}: {str(exc)[:700]}", 0.0
        bad += not ok
        print(f"{'ok ' if ok else 'BAD'} {name:36s} {took:6.1f}s {note}", flush=True)
    print("bad:", bad)
