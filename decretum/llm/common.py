"""Shared helpers: shared-folder tables, hot keys, Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from decretum.sources.tables import settle, shared_folder

__all__ = ["WORD", "SPACES", "bounded_broadcast", "fold", "hot_keys", "labelled_sample", "map_arrow", "partitions", "settle", "shared_folder", "small_batches", "with_salt"]

#: A word is a run of anything but the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"
SPACES = r"[\x20\x09-\x0D]+"


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def hot_keys(df: DataFrame, key: str, extra: dict[str, Column] | None = None) -> DataFrame:
    """Keys with more rows than a quarter of an even partition: ``key``, ``_rows``, ``_salts`` and ``extra`` aggregates.

    At most four keys per shuffle partition can have that many rows, so the
    table may be broadcast at any input size.
    """
    bound = max(1, df.count() // (4 * partitions(df.sparkSession)))
    counted = df.groupBy(key).agg(F.count(F.lit(1)).alias("_rows"), *[c.alias(n) for n, c in (extra or {}).items()])
    return counted.where(F.col("_rows") > bound).withColumn("_salts", F.ceil(F.col("_rows") / bound).cast("int"))


def with_salt(df: DataFrame, hot: DataFrame, key: str, by: Column) -> DataFrame:
    """Add ``_salt`` (0 for keys that are not hot) and the other columns of ``hot``; ``by`` deals a hot key's rows to its salts."""
    joined = df.join(F.broadcast(hot), key, "left")
    return joined.withColumn("_salt", F.when(F.col("_salts").isNull(), 0).otherwise(F.pmod(by, F.col("_salts"))).cast("int"))


def bounded_broadcast(table: DataFrame, max_rows: int) -> DataFrame:
    """Broadcast a settled table if it has at most ``max_rows`` rows; beyond that the join shuffles both sides."""
    return F.broadcast(table) if table.limit(max_rows + 1).count() <= max_rows else table


def map_arrow(df: DataFrame, schema: str, rows: Callable[[pa.RecordBatch], dict[str, list] | pa.RecordBatch]) -> DataFrame:
    """Apply ``rows`` (batch to columns) to each Arrow batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = rows(batch)
            yield out if isinstance(out, pa.RecordBatch) else pa.RecordBatch.from_pydict(out)

    return df.mapInArrow(run, schema)


@contextmanager
def small_batches(spark: SparkSession, rows: int):
    """Arrow batches of at most ``rows`` rows while results are written inside; for long rows, of which a task holds a whole batch."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(min(rows, int(before)) if int(before) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def fold(id_: Column, folds: int = 5) -> Column:
    """crc32 of the id as text, modulo ``folds``; 0 is held out of training."""
    return (F.crc32(F.coalesce(id_.cast("string"), F.lit("")).cast("binary")) % folds).cast("int")


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, rows: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, text, label`` of at most ``rows`` labelled ids that are not held out, the first in the order of their digests.

    Null ids, null labels and null texts are left out; of several labels of an id the
    largest counts. The sample of ids has at most ``rows`` rows, so it is broadcast.
    """
    known = labels.select(F.col(id_col).alias("id"), F.col(label).cast("int").alias("label")).where("id IS NOT NULL AND label IS NOT NULL")
    known = known.groupBy("id").agg(F.max("label").alias("label")).where(fold(F.col("id")) != 0)
    taken = known.orderBy(F.md5(F.col("id").cast("string")), "id").limit(rows)
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).where("text IS NOT NULL")
    return texts.join(F.broadcast(taken), "id")
