"""Changes rewrite only the buckets of their ids; refreshed metrics equal a full run."""

import os

from pyspark.sql import functions as F

from decretum.operators import metrics as M
from decretum.sources import store as S


def files(path):
    return {os.path.join(d, n) for d, _, names in os.walk(path) for n in names if n.endswith(".parquet")}


def test_ten_ids_rewrite_ten_buckets_at_most(spark, tmp_path):
    path = str(tmp_path / "store")
    rows = spark.range(5000).select(F.col("id").cast("string").alias("id"), F.lit("old").alias("state"), F.col("id").alias("n"))
    S.with_bucket(rows, 64).repartition("bucket").write.partitionBy("bucket").parquet(path)
    before = files(path)
    changes = spark.createDataFrame([(str(i * 700), "new") for i in range(10)], "id string, state string")
    touched = S.write_buckets(changes, path, 64, lambda part, new: S.upsert_documents(part, new, merge=True))
    after = files(path)
    assert touched <= 10 and len({os.path.dirname(f) for f in before ^ after}) == touched
    got = spark.read.parquet(path)
    assert got.count() == 5002 and got.where("state = 'new'").count() == 10
    assert got.where("id = '700'").first().n == 700 and got.where("id = '6300'").first().n is None
    assert S.write_buckets(changes.limit(0), path, 64, S.upsert_documents) == 0 and files(path) == after


def test_refresh_recomputes_changed_records_only(spark):
    kind = "record_id string, evidence array<struct<extraction_method:string>>, flags array<string>, ambiguous boolean"
    old = spark.createDataFrame([("a", [("text",)], ["x"], False), ("b", [], [], True), ("c", [("vision_ocr",)], [], False)], kind)
    new = spark.createDataFrame([("a", [], [], False), ("b", [("text",)], [], False), ("c", [], [], False)], kind)
    events = spark.createDataFrame([("b", "field_update"), ("b", "view"), ("a", "action_update")], "record_id string, event_type string")
    base = M.record_metrics(old)
    changed = spark.createDataFrame([("b",), ("b",), ("gone",)], "record_id string")
    got = {r.record_id: r for r in M.refresh_metrics(base, changed, new, audit=events).collect()}
    full = {r.record_id: r for r in M.record_metrics(new, audit=events).collect()}
    was = {r.record_id: r for r in base.collect()}
    assert got == {"a": was["a"], "b": full["b"], "c": was["c"]}
    assert full["b"].review_edit_count == 1 and full["b"].evidence_coverage_percent == 100 and was["c"].vision_ocr_used
