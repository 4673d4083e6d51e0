"""Streams give what their batch twins give."""

from __future__ import annotations

import tempfile

import pytest
from pyspark.sql import functions as F

from decretum.functions import hooks
from decretum.sources import export as E
from decretum.sources import store as S
from decretum.streaming import jobs as K

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def folder():
    return tempfile.mkdtemp(prefix="spark-", dir="/tmp")


def run(df, folder, name, mode):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", f"{folder}/{name}").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert q.exception() is None
    return df.sparkSession.table(name)


def events(spark, folder):
    path = f"{folder}/events"
    src = spark.read.parquet(f"{SF}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    src.repartition(3).write.mode("ignore").parquet(path)
    return spark.read.parquet(path), spark.readStream.schema(src.schema).option("maxFilesPerTrigger", 1).parquet(path)


def test_request_rate(spark, folder):
    batch, stream = events(spark, folder)
    tokens = (F.get_json_object("props", "$.k").cast("long") * 100).alias("tokens")
    live = run(K.request_rate(stream.select("ts", tokens), lateness="90 days"), folder, "rate", "complete")
    want = K.request_rate(batch.select("ts", tokens))
    assert live.exceptAll(want).count() == 0 and live.count() == want.count()


def test_latest_state(spark, folder):
    batch, stream = events(spark, folder)
    cols = ["event_id", F.col("user_id").alias("record_id"), F.col("event_type").alias("after"), F.col("ts").alias("created_at")]
    live = run(K.latest_state(stream.select(*cols)), folder, "state", "complete")
    want = K.latest_state(batch.select(*cols))
    assert sorted(map(tuple, live.collect())) == sorted(map(tuple, want.collect()))


def test_dedup_by_hash(spark, folder):
    path = f"{folder}/docs"
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", F.to_timestamp(F.lit("2024-01-01")).alias("ts"))
    docs.repartition(2).write.mode("ignore").parquet(path)
    live = run(K.dedup_by_hash(spark.readStream.schema(docs.schema).parquet(path)), folder, "dedup", "append")
    assert live.count() == docs.select("text").distinct().count()


def test_job_progress(spark, folder):
    batch, stream = events(spark, folder)
    cols = [F.col("user_id").cast("string").alias("job_id"), F.when(F.col("event_type") == "error", "failure").otherwise("running").alias("state"),
            (F.col("event_id") % 7).cast("int").alias("stage_index"), "ts"]
    live = run(K.job_progress(stream.select(*cols), lateness="90 days"), folder, "progress", "update")
    last = live.where("not expired").groupBy("job_id").agg(F.max_by("state", "updated_at").alias("state"), F.max("updated_at").alias("at"))
    want = K.latest_progress(batch.select(*cols)).select("job_id", "state", F.date_trunc("millisecond", "updated_at").alias("at"))
    assert sorted(map(tuple, last.collect())) == sorted(map(tuple, want.collect()))


def test_sync_sink_is_idempotent(spark):
    src = spark.createDataFrame([("a", 1, 5), ("a", 2, 6), ("b", 3, 1)], "id string, v int, updated_at int")
    box = {"t": spark.createDataFrame([("b", 9, 4)], "id string, v int, updated_at int"), "s": []}

    def write(df):
        box["t"] = spark.createDataFrame(df.collect(), df.schema)

    push = K.sync_sink(lambda: box["t"], write, lambda df: box["s"].append(sorted((r["id"], r["sync_status"]) for r in df.collect())))
    push(src, 1)
    push(src, 1)
    assert sorted(map(tuple, box["t"].collect())) == [("a", 2, 6), ("b", 9, 4)]
    assert box["s"][0] == box["s"][1] == [("a", "synced"), ("b", "conflict")]


def test_store_merge_is_deep(spark):
    old = spark.sql("select 'x' id, named_struct('a', 1, 'b', named_struct('c', 2, 'd', 3)) data, map('k', 1, 'm', 2) tags")
    new = spark.sql("select 'x' id, named_struct('a', cast(null as int), 'b', named_struct('c', 7, 'd', cast(null as int))) data, map('m', 5) tags")
    r = S.upsert_documents(old, new, merge=True).first()
    assert (r["data"]["a"], r["data"]["b"]["c"], r["data"]["b"]["d"], r["tags"]) == (1, 7, 3, {"k": 1, "m": 5})


def test_manifest_directory_and_summary(spark, folder):
    import json
    import os

    base = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    item = {"pdf_path": "/x/a.pdf", "metadata_json": "{\"s\": \"m\"}", "expected": {"court": "C", "departments": ["D"], "metrics": {"duplicate_count": "1"}}}
    for name, body in (("list.json", [item, item]), ("one.json", item)):
        with open(f"{base}/{name}", "w") as f:
            json.dump(body, f)
    assert E.read_manifest(spark, f"{base}/list.json").count() == 2
    one = E.read_manifest(spark, f"{base}/one.json")
    assert one.first()["file_name"] == "a.pdf" and one.first()["metadata"] == {"s": "m"}
    assert sorted(r["field"] for r in E.expected_fields(one).collect()) == ["court", "departments"]
    assert [os.path.basename(r["path"]) for r in E.read_directory(spark, base, "*.json").collect()] == ["list.json", "one.json"]
    E.write_summary(one.select("file_name"), f"{base}/out")
    assert spark.read.json(f"{base}/out").count() == 1
    E.export_csv(spark.range(2).select(F.col("id").alias("record_id"), F.array(F.lit("a"), F.lit("b")).alias("departments")), f"{base}/csv")
    got = spark.read.option("header", True).csv(f"{base}/csv")
    assert tuple(got.columns) == E.CSV_COLUMNS and got.first()["departments"] == "a; b"


def test_hooks(spark):
    reqs = spark.createDataFrame([(1, "m", "hi"), (2, "m", "hi"), (3, "m", "yo")], "request_id int, model string, messages string")
    empty = spark.createDataFrame([], "request_key string, raw_response string")
    answers, fresh = hooks.complete_texts(reqs, empty, lambda texts: [t.upper() for t in texts])
    assert sorted((r["request_id"], r["raw_response"]) for r in answers.collect()) == [(1, "HI"), (2, "HI"), (3, "YO")]
    assert fresh.count() == 2
    again, none = hooks.complete_texts(reqs, fresh, lambda texts: ["no"] * len(texts))
    assert none.count() == 0 and again.count() == 3
    p = spark.createDataFrame([("r", 1, "a"), ("r", 2, "b")], "record_id string, page int, text string")
    out = hooks.extract_from_pages(p, lambda b: b.assign(field="court", value=b["text"], result_no=b["page"])[["record_id", "field", "value", "result_no"]],
                                   "record_id string, field string, value string, result_no int")
    assert hooks.page_result_fields(out).first()["value"] == "a"
