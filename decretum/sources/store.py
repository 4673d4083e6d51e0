"""Document store as a table: scans, point reads, merges, deletes, filters, sync.

A store row is ``(id, collection_path, doc_id, <typed columns or structs>,
updated_at)``. Writes produce a new snapshot of the table.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SENTINEL = "SERVER_TIMESTAMP"


def scan_collection(store: DataFrame, path: str) -> DataFrame:
    """All documents of one collection; prunes partitions where the path is one."""
    return store.where(F.col("collection_path") == path)


def point_get(store: DataFrame, ids: DataFrame) -> DataFrame:
    """Documents by id with an ``exists`` flag."""
    return ids.join(store.withColumn("exists", F.lit(True)), ["collection_path", "doc_id"], "left").withColumn(
        "exists", F.coalesce("exists", F.lit(False))
    )


def list_document_ids(store: DataFrame, path: str) -> DataFrame:
    return scan_collection(store, path).select("doc_id")


def nested_field(data: Column | str, path: str) -> Column:
    """Value at a dotted path of a JSON text; null when a step is missing."""
    return F.get_json_object(data, "$." + path)


def where(df: DataFrame, field: str | Column, op: str, value) -> DataFrame:
    """One filter with the store's null rules: ``==`` and ``!=`` are null-safe, ranges drop nulls."""
    col = F.col(field) if isinstance(field, str) else field
    if op == "==":
        return df.where(col.eqNullSafe(value))
    if op == "!=":
        return df.where(~col.eqNullSafe(value))
    if op in ("<", "<=", ">", ">="):
        test = {"<": col < value, "<=": col <= value, ">": col > value, ">=": col >= value}[op]
        return df.where(test)
    if op == "in":
        hit = col.isin([v for v in value if v is not None])
        return df.where(hit | col.isNull() if None in value else hit)
    if op == "array-contains":
        return df.where(F.array_contains(col, value))
    raise ValueError(f"unknown operator {op!r}")


def order_by(df: DataFrame, field: str, direction: str = "ASCENDING", limit: int | None = None) -> DataFrame:
    """Sort with missing values as ''; a limit of 0 or None keeps all rows."""
    key = F.coalesce(F.col(field).cast("string"), F.lit("")) if dict(df.dtypes)[field] == "string" else F.col(field)
    down = direction == "DESCENDING"
    order = key.desc_nulls_last() if down else key.asc_nulls_first()
    out = df.orderBy(order)
    return out.limit(limit) if limit else out


def latest_first(df: DataFrame, *tie: str) -> DataFrame:
    return df.orderBy(F.desc_nulls_last("updated_at"), *tie)


# ---- writes --------------------------------------------------------------------------


def _merged(old: Column, new: Column, kind: T.DataType) -> Column:
    """New leaf where given, else the old one; structs and maps merge member by member, also inside maps."""
    if isinstance(kind, T.StructType):
        fields = [_merged(old[f.name], new[f.name], f.dataType).alias(f.name) for f in kind.fields]
        return F.when(new.isNull(), old).when(old.isNull(), new).otherwise(F.struct(*fields))
    if isinstance(kind, T.MapType):
        def member(key: Column, a: Column, b: Column) -> Column:
            return F.when(F.map_contains_key(new, key), F.when(b.isNull(), b).otherwise(_merged(a, b, kind.valueType))).otherwise(a)

        return F.when(new.isNull(), old).when(old.isNull(), new).otherwise(F.map_zip_with(old, new, member))
    return F.coalesce(new, old)


#: Column of ``changes`` with the names of the fields that a merge sets to null.
SET_NULL = "set_null"


def upsert_documents(store: DataFrame, changes: DataFrame, *, merge: bool = False, keys: Sequence[str] = ("id",)) -> DataFrame:
    """New snapshot of the store: changed rows replaced, or merged deeply, others kept.

    Fields that only the changes have are added to the store. A merge keeps the old
    value where the new one is null, except for fields named in ``set_null`` and
    for map members given as null.
    """
    added = [f for f in changes.schema.fields if f.name not in store.columns and f.name not in (*keys, SET_NULL)]
    store = store.withColumns({f.name: F.lit(None).cast(f.dataType) for f in added}) if added else store
    columns = [c for c in store.columns if c not in keys]
    given = [c for c in columns if c in changes.columns]
    nulls = F.col(SET_NULL) if SET_NULL in changes.columns else F.lit(None).cast("array<string>")
    renamed = changes.select(*keys, F.lit(True).alias("_changed"), nulls.alias("_nulls"), *[F.col(c).alias(f"_n_{c}") for c in given])
    both = store.withColumn("_old", F.lit(True)).join(renamed, list(keys), "full")
    out = []
    for field in store.schema.fields:
        if field.name in keys:
            out.append(F.col(field.name))
            continue
        old, has_new = F.col(field.name), field.name in changes.columns
        new = F.col(f"_n_{field.name}") if has_new else F.lit(None).cast(field.dataType)
        if merge:
            value = _merged(old, new, field.dataType) if has_new else old
            value = F.when(~F.coalesce(F.array_contains("_nulls", field.name), F.lit(False)), value)
        else:
            value = F.when(F.col("_changed"), new).otherwise(old)
        out.append(value.alias(field.name))
    return both.select(*out)


def update_documents(store: DataFrame, changes: DataFrame, keys: Sequence[str] = ("id",)) -> tuple[DataFrame, DataFrame]:
    """Merge changes into existing rows; the second table holds changes whose row is missing."""
    known = store.select(*keys)
    found = changes.join(known, list(keys), "left_semi")
    missing = changes.join(known, list(keys), "left_anti")
    return upsert_documents(store, found, merge=True, keys=keys), missing


def delete_documents(store: DataFrame, ids: DataFrame, keys: Sequence[str] = ("id",)) -> tuple[DataFrame, DataFrame]:
    """Rows that stay, and the ids that were asked for but are not there."""
    asked = ids.select(*keys).distinct()
    return store.join(asked, list(keys), "left_anti"), asked.join(store.select(*keys), list(keys), "left_anti")


def with_bucket(df: DataFrame, buckets: int, keys: Sequence[str] = ("id",)) -> DataFrame:
    """Rows with ``bucket``, by their key's hash: the partition column of a stored table."""
    return df.withColumn("bucket", F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int"))


def write_buckets(changes: DataFrame, path: str, buckets: int, change, keys: Sequence[str] = ("id",)) -> int:
    """Apply a change to the table at ``path``, partitioned by ``bucket``, and rewrite only the buckets of the changed keys; their number is returned.

    ``change(part, changes)`` gives the new rows of the touched part of the table, for example ``upsert_documents``. The new rows are written
    to the shared folder first, so a lost executor or a failed change leaves the old rows; then the touched partitions are replaced one after another,
    and a reader meanwhile can see some of them old. A bucket that loses all its rows is kept until its table is written anew: ``change`` has to mark such rows as deleted.
    """
    from decretum.sources.tables import settle

    spark = changes.sparkSession
    new = settle(changes)
    touched = [r.bucket for r in with_bucket(new.select(*keys), buckets, keys).select("bucket").distinct().collect()]
    if not touched:
        return 0
    part = spark.read.parquet(path).where(F.col("bucket").isin(touched)).drop("bucket")
    rows = settle(with_bucket(change(part, new), buckets, keys))
    rows.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)
    return len(touched)


def event_id(columns: Sequence[str]) -> Column:
    """Identity of an event by its content: a repeated write yields the same id."""
    return F.sha2(F.concat_ws("\u0001", *[F.coalesce(F.col(c).cast("string"), F.lit("\u0000")) for c in columns]), 256)


def append_audit(audit: DataFrame | None, events: DataFrame) -> DataFrame:
    """Audit rows with the new events added; events already present are not repeated."""
    keyed = events.withColumn("event_id", event_id([c for c in events.columns if c != "event_id"])).dropDuplicates(["event_id"])
    if audit is None:
        return keyed
    return audit.unionByName(keyed.join(audit.select("event_id"), "event_id", "left_anti").select(*audit.columns), allowMissingColumns=True)


def write_audit(events: DataFrame, path: str) -> None:
    """Append events to the audit table at ``path``; those that it holds already are left out, so a repeated write adds nothing."""
    spark = events.sparkSession
    keyed = append_audit(None, events)
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(folder):
        keyed = keyed.join(spark.read.parquet(path).select("event_id"), "event_id", "left_anti")
    keyed.write.mode("append").parquet(path)


def resolve_server_timestamps(df: DataFrame, now: Column | None = None) -> DataFrame:
    """Replace the time sentinel in string leaves, also inside structs and arrays."""
    stamp = (F.current_timestamp() if now is None else now).cast("string")

    def fix(value: Column, kind: T.DataType) -> Column:
        if isinstance(kind, T.StringType):
            return F.when(value == SENTINEL, stamp).otherwise(value)
        if isinstance(kind, T.StructType):
            parts = [fix(value[f.name], f.dataType).alias(f.name) for f in kind.fields]
            return F.when(value.isNotNull(), F.struct(*parts))
        if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.StructType):
            return F.transform(value, lambda v: fix(v, kind.elementType))
        return value

    return df.select(*[fix(F.col(f.name), f.dataType).alias(f.name) for f in df.schema.fields])


# ---- two copies of a store -----------------------------------------------------------


def read_with_fallback(primary: DataFrame, local: DataFrame, keys: Sequence[str] = ("id",)) -> DataFrame:
    """Rows of the primary copy, else of the local one."""
    rest = local.join(primary.select(*keys), list(keys), "left_anti")
    return primary.withColumn("read_from", F.lit("primary")).unionByName(rest.withColumn("read_from", F.lit("local")))


def pending_documents(store: DataFrame, status: DataFrame, now: Column, limit: int | None = None) -> DataFrame:
    """Documents to push: never synced, pending, or failed more than 300 seconds ago; oldest first."""
    rows = store.join(status.select("id", "sync_status", "last_synced_at"), "id", "left")
    retry = (F.col("sync_status") == "failed") & (F.col("last_synced_at") < now - F.expr("interval 300 seconds"))
    due = rows.where(F.col("sync_status").isNull() | (F.col("sync_status") == "pending") | retry)
    ordered = due.orderBy("updated_at", "id")
    return ordered.limit(limit) if limit else ordered


def sync_last_write_wins(source: DataFrame, target: DataFrame) -> DataFrame:
    """Outcome of pushing each source row: ``conflict`` where the target is newer, else ``synced``."""
    remote = target.select("id", F.col("updated_at").alias("remote_updated_at"))
    newer = F.coalesce(F.col("remote_updated_at") > F.col("updated_at"), F.lit(False))
    return source.join(remote, "id", "left").withColumn("sync_status", F.when(newer, "conflict").otherwise("synced"))


def apply_sync(source: DataFrame, target: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Target snapshot after the push, and the status of every pushed document."""
    judged = sync_last_write_wins(source, target)
    pushed = judged.where("sync_status = 'synced'").select(*target.columns)
    return upsert_documents(target, pushed, merge=True), judged.select("id", "sync_status", "updated_at")
