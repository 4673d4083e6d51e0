"""Exact dedup by content sort, with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from decretum.llm.common import SPACES, hot_keys, partitions, settle, with_salt


def normalised(text: Column) -> Column:
    """Runs of white space as one space; a null text counts as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACES, " ")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``id_col, keep_id, group_size, kept, text_sha256``.

    Spark samples splitters of the key (first characters, content digest, salt)
    and range-partitions the normalised texts; each partition is sorted
    externally by key, text and id, so equal texts are neighbours, and each row is
    compared in full with the one before it. A text with very many copies is
    dealt to several salts by id; the salts' results meet through the digest, in a
    table of at most four rows per partition.

    A null text counts as empty; a null id sorts last and is ``keep_id`` only where
    no copy has an id; of rows equal in id and text exactly one is kept; an empty
    table gives an empty result; other columns are ignored.
    """
    rows = docs.select(F.col(id_col).alias("id"), normalised(F.col(text_col)).alias("norm"))
    rows = rows.withColumn("sha", F.sha2("norm", 256))
    spread = with_salt(rows, hot_keys(rows.select("sha"), "sha"), "sha", F.xxhash64("id")).withColumn("head", F.substring("norm", 1, 32))
    key = ["head", "sha", "_salt"]
    dealt = spread.repartitionByRange(partitions(docs.sparkSession), *key)
    order = Window.partitionBy(*key).orderBy("norm", F.col("id").asc_nulls_last())
    before = F.lag("norm").over(order)
    compared = dealt.withColumn("starts", before.isNull() | (before != F.col("norm")))
    runs = compared.withColumn("run", F.sum(F.col("starts").cast("long")).over(order)).drop("norm")
    run = Window.partitionBy(*key, "run")
    sized = runs.select(
        "id", "sha", "starts", F.col("_salts").isNotNull().alias("hot"), F.min("id").over(run).alias("least"), F.count(F.lit(1)).over(run).alias("n")
    )
    found = settle(sized)
    merged = found.where("hot AND starts").groupBy("sha").agg(F.min("least").alias("all_least"), F.sum("n").alias("all_n"))
    out = found.join(F.broadcast(merged), "sha", "left")
    keep = F.when(F.col("hot"), F.col("all_least")).otherwise(F.col("least"))
    return out.select(
        F.col("id").alias(id_col),
        keep.alias("keep_id"),
        F.when(F.col("hot"), F.col("all_n")).otherwise(F.col("n")).alias("group_size"),
        (F.col("starts") & keep.eqNullSafe(F.col("id"))).alias("kept"),
        F.col("sha").alias("text_sha256"),
    )
