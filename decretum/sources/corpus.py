"""Page tables: the input of every extraction job."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from decretum.functions import text as T


def page_table(rows: DataFrame) -> DataFrame:
    """Rows with text, keyed by record and page; blank pages are left out."""
    keyed = rows.where(T.strip_ws(F.coalesce("text", F.lit(""))) != "")
    chunk = F.concat(F.lit("p"), F.col("page").cast("string"))
    if "chunk_id" in rows.columns:
        chunk = F.coalesce("chunk_id", chunk)
    return keyed.withColumn("chunk_id", chunk)


def read_pages(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    return page_table(spark.read.format(fmt).load(path))


def conversation_pages(turns: DataFrame) -> DataFrame:
    """Conversation turns read as the pages of one record each."""
    return page_table(
        turns.select(F.col("conv_id").alias("record_id"), (F.col("turn") + 1).cast("int").alias("page"), "text", "role")
    )
