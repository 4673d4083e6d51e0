"""Record tables are dealt to more tasks as they grow, and what follows by the same key stays there."""

from pyspark.sql import functions as F

from decretum.catalog import actions as A
from decretum.operators import actions as O
from decretum.sources import tables


def test_tasks_grow_with_the_rows(spark, monkeypatch):
    monkeypatch.setattr(tables, "ROWS_A_TASK", 100)
    few, many = (tables.dealt(spark.range(n), "id").rdd.getNumPartitions() for n in (50, 5000))
    assert few == int(spark.conf.get("spark.sql.shuffle.partitions")) and many == 50


def test_actions_of_lines_are_dealt_by_record(spark, monkeypatch):
    monkeypatch.setattr(tables, "ROWS_A_TASK", 100)
    rows, outcomes, _ = A.line_actions(spark, "/root/testdata/sf0.001")
    traced = O.quality_trace(rows, outcomes)
    assert traced.count() == 1473
    tasks = traced.select("record_id", F.spark_partition_id().alias("p")).groupBy("p").agg(F.count("*").alias("n")).collect()
    assert len(tasks) > 40
