"""Intermediate tables in the shared folder."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_local_folders: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The cluster's folder for intermediate tables: ``spark.checkpoint.dir``.

    Only a local session without that setting gets a folder of its own, one per application.
    """
    folder = spark.conf.get("spark.checkpoint.dir", "")
    app = spark.sparkContext.applicationId
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        if app not in _local_folders:
            _local_folders[app] = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        folder = _local_folders[app]
    return f"{folder.rstrip('/')}/decretum-{app}"


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Deal rows to all tasks by ``keys`` before a costly pass: a file with one row group is one task, whatever its size.

    The keys should be unique or nearly so. The number of tasks is fixed, as small rows that cost much time must not be put together by their bytes.
    """
    session = df.sparkSession
    tasks = max(int(session.conf.get("spark.sql.shuffle.partitions")), 2 * session.sparkContext.defaultParallelism)
    return df.repartition(tasks, *keys)


#: Rows of one record table that a task sorts or groups at once.
ROWS_A_TASK = 200_000


def tasks_for(spark: SparkSession, rows: int) -> int:
    """As many tasks as hold each to about ``ROWS_A_TASK`` of ``rows``."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // ROWS_A_TASK))


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """Deal rows to tasks by ``keys``, as many tasks as hold each to about ``ROWS_A_TASK`` rows, however long the table.

    Groups, windows and joins by the same keys that follow stay in these tasks. The rows are counted first, which costs a
    plain Parquet table its footers only.
    """
    return df.repartition(tasks_for(df.sparkSession, df.count()), *keys)


@contextmanager
def joined_where_dealt(spark: SparkSession):
    """Joins planned inside take tables that are dealt alike by some of their keys as they lie, as groups and windows always do.

    It holds for what runs inside, so the result is to be settled there.
    """
    name = "spark.sql.requireAllClusterKeysForCoPartition"
    before = spark.conf.get(name)
    spark.conf.set(name, "false")
    try:
        yield
    finally:
        spark.conf.set(name, before)


@contextmanager
def broadcast_by_rows(spark: SparkSession):
    """Joins planned inside are broadcast by the size that their rows have at run time only, not by that of a file.

    Rows of a few repeated values take a hundredth of their size in a file: a table that is small there can be too large for
    a driver. It holds for what runs inside, so the result is to be settled there.
    """
    fixed, adaptive = "spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"
    before, known = spark.conf.get(fixed), spark.conf.get(adaptive, None)
    spark.conf.set(adaptive, known or before)
    spark.conf.set(fixed, "-1")
    try:
        yield
    finally:
        spark.conf.set(fixed, before)
        if known is None:
            spark.conf.unset(adaptive)
        else:
            spark.conf.set(adaptive, known)


def settle(df: DataFrame) -> DataFrame:
    """Write ``df`` as a table in the shared folder and go on from there.

    The result survives the loss of executors, is computed once however many
    consumers it has, starts a fresh, short plan, and is read column by column. It is
    packed with zstd, which takes less disk than the default.
    """
    path = f"{shared_folder(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove_settled(spark: SparkSession) -> bool:
    """Delete the application's intermediate tables; call it when no result that reads them is needed any more."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(shared_folder(spark))
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
