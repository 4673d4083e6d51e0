"""Costly passes over the rows of one input split run on many tasks, and once."""

from pyspark.sql import functions as F

from decretum.operators import candidates as C
from decretum.operators import fusion as U
from decretum.operators import payloads as Y
from decretum.operators import retrieval as R


def test_pages_of_one_split_are_spread(spark):
    pages = spark.range(200).select(F.col("id").alias("record_id"), F.lit(1).alias("page"), F.lit("The petition is dismissed.").alias("text")).coalesce(1)
    found = C.page_candidates(pages, ["page_disposition"])
    sizes = found.groupBy(F.spark_partition_id().alias("p")).count().collect()
    assert sum(r["count"] for r in sizes) == 200
    assert len(sizes) > 1 and max(r["count"] for r in sizes) < 200


def test_answers_of_one_split_are_spread(spark):
    answers = spark.range(200).select(F.col("id").alias("record_id"), F.lit('{"a": 1}').alias("json")).coalesce(1)
    docs = Y.parsed_answers(answers)
    assert docs.count() == 200 and docs.select(F.spark_partition_id()).distinct().count() > 1


def test_quotes_of_one_split_are_spread(spark):
    words = "the court directs that the registry shall file a compliance report within ten days"
    rows = spark.range(100).select(F.col("id").alias("record_id"), F.lit(1).alias("page"), F.lit(words).alias("text"), F.lit("the court then directs all that our registry should file one compliance report").alias("snippet"))
    found = R.locate_quotes(rows.coalesce(1))
    sizes = found.groupBy(F.spark_partition_id().alias("p")).count().collect()
    assert sum(r["count"] for r in sizes) == 100 and len(sizes) > 2


def test_second_source_answers_of_one_split_are_spread(spark):
    answers = spark.range(100).select(F.col("id").alias("record_id"), F.lit('{"court": "High Court of Kerala"}').alias("json")).coalesce(1)
    found = U.payload_to_candidates(answers).where("field = 'court'")
    sizes = found.groupBy(F.spark_partition_id().alias("p")).count().collect()
    assert sum(r["count"] for r in sizes) == 100 and len(sizes) > 1
