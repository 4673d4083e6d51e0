"""Time-based jobs as Structured Streaming queries, with batch twins where they exist."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from decretum.functions import patterns as P

# ---- request rate --------------------------------------------------------------------


def _over(df: DataFrame) -> DataFrame:
    return df.withColumns(
        {
            "over_requests": F.col("requests") > P.REQUESTS_PER_MINUTE,
            "over_tokens": F.col("tokens") > P.TOKENS_PER_MINUTE,
        }
    )


def request_rate(events: DataFrame, *, lateness: str = "2 minutes", slide: str = "10 seconds") -> DataFrame:
    """Requests and tokens per sliding minute, with flags above the limits.

    ``events`` is a stream (or batch) of ts and tokens. State is one row per
    open window, so it does not grow with the number of events.
    """
    src = events.withWatermark("ts", lateness) if events.isStreaming else events
    sums = src.groupBy(F.window("ts", "60 seconds", slide)).agg(F.count("*").alias("requests"), F.sum("tokens").alias("tokens"))
    return _over(sums.select(F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), "requests", "tokens"))


def trailing_rate(events: DataFrame, key: str) -> DataFrame:
    """Batch twin: load over the 60 seconds before each event of a key.

    The hour is part of the partition so that no key fills one task; events of
    the last minute of the hour before are added to each hour.
    """
    minute, hour = 60_000_000, 3_600_000_000
    t = F.unix_micros(F.col("ts").cast("timestamp"))
    at_hour = F.floor(t / hour)
    rows = events.withColumns({"_t": t, "_hour": at_hour, "_own": F.lit(True)})
    carried = rows.where(F.pmod(F.col("_t"), F.lit(hour)) >= hour - minute).withColumns({"_hour": F.col("_hour") + 1, "_own": F.lit(False)})
    w = Window.partitionBy(key, "_hour").orderBy("_t").rangeBetween(1 - minute, 0)
    both = rows.unionByName(carried).withColumns({"requests": F.count("*").over(w), "tokens_in_minute": F.sum("tokens").over(w)})
    out = both.where("_own").drop("_t", "_hour", "_own", "tokens").withColumnRenamed("tokens_in_minute", "tokens")
    return _over(out)


# ---- first sight of a document -------------------------------------------------------


def dedup_by_hash(documents: DataFrame, *, lateness: str = "1 hour") -> DataFrame:
    """Each content hash once; state older than the watermark is dropped."""
    keyed = documents.withColumn("document_hash", F.sha2("text", 256))
    if not documents.isStreaming:
        first = keyed.groupBy("document_hash").agg(F.min_by(F.struct(*documents.columns), F.struct("ts", "doc_id")).alias("d"))
        return first.select("d.*", "document_hash")
    return keyed.withWatermark("ts", lateness).dropDuplicatesWithinWatermark(["document_hash"])


# ---- current state from the audit stream ---------------------------------------------


def latest_state(audit: DataFrame) -> DataFrame:
    """Current status of each record: the last change by event time, whatever the arrival order."""
    order = F.struct("created_at", "event_id")
    return audit.groupBy("record_id").agg(
        F.max_by("after", order).alias("review_status"), F.max("created_at").alias("changed_at"), F.count("*").alias("changes")
    )


# ---- job progress --------------------------------------------------------------------

PROGRESS_SCHEMA = "job_id string, state string, stage_index int, updated_at timestamp, expired boolean"
STATE_SCHEMA = "state string, stage_index int, updated_ms long"
EXPIRY_MS = 3_600_000


def _progress(key, batches, state):
    """Last stage and state of one job; it expires after an hour without events."""
    import pandas as pd

    if state.hasTimedOut:
        kind, stage, ms = state.get
        state.remove()
        rows = [(key[0], kind, stage, pd.Timestamp(ms, unit="ms"), True)]
    else:
        kind, stage, ms = state.get if state.exists else ("queued", 0, -1)
        for batch in batches:
            last = batch.loc[batch.sort_values(["ts", "stage_index"]).index[-1]] if len(batch) else None
            at = -1 if last is None else int(pd.Timestamp(last["ts"]).value // 1_000_000)
            if last is not None and at >= ms:
                kind, stage, ms = last["state"], int(last["stage_index"]), at
        state.update((kind, stage, ms))
        state.setTimeoutTimestamp(max(ms + EXPIRY_MS, state.getCurrentWatermarkMs() + 1))
        rows = [(key[0], kind, stage, pd.Timestamp(ms, unit="ms"), False)]
    yield pd.DataFrame(rows, columns=["job_id", "state", "stage_index", "updated_at", "expired"])


def job_progress(events: DataFrame, *, lateness: str = "10 minutes") -> DataFrame:
    """State per job from a stream of job_id, state, stage_index and ts.

    A job keeps three values of state and leaves it after an hour of silence.
    """
    return (
        events.withWatermark("ts", lateness)
        .groupBy("job_id")
        .applyInPandasWithState(_progress, PROGRESS_SCHEMA, STATE_SCHEMA, "update", "EventTimeTimeout")
    )


def latest_progress(events: DataFrame) -> DataFrame:
    """Batch twin: last state of each job by event time."""
    last = F.struct("ts", "stage_index")
    return events.groupBy("job_id").agg(
        F.max_by("state", last).alias("state"), F.max_by("stage_index", last).alias("stage_index"), F.max("ts").alias("updated_at")
    )


def stage_view(progress: DataFrame) -> DataFrame:
    """The seven ordered stages of each job: complete, active, pending or error."""
    names = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(k).alias("stage"), F.lit(label).alias("label"), F.lit(p).alias("pct"))
                      for i, (k, label, p) in enumerate(P.PROGRESS_STAGES)])
    rows = progress.select("job_id", "state", "stage_index", F.explode(names).alias("s"))
    i, at = F.col("s.i"), F.col("stage_index")
    kind = (
        F.when((F.col("state") == "success") | (i < at), "complete")
        .when((i == at) & (F.col("state") == "failure"), "error")
        .when(i == at, "active")
        .otherwise("pending")
    )
    return rows.select("job_id", i.alias("position"), "s.stage", "s.label", "s.pct", kind.alias("stage_state"))


# ---- sync ----------------------------------------------------------------------------


def sync_sink(read_target: Callable[[], DataFrame], write_target: Callable[[DataFrame], None], write_status: Callable[[DataFrame], None]):
    """``foreachBatch`` function that pushes changed documents, last write wins.

    Running a batch again gives the same target: rows are keyed by id and a
    row that is already there with the same time is written once more.
    """
    from decretum.sources.store import apply_sync

    def push(batch: DataFrame, epoch: int) -> None:
        cols = [c for c in batch.columns if c != "id"]
        last = batch.groupBy("id").agg(F.max_by(F.struct(*cols), "updated_at").alias("d")).select("id", "d.*")
        target, status = apply_sync(last, read_target())
        write_target(target)
        write_status(status.withColumn("epoch", F.lit(epoch)))

    return push
