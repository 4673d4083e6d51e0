"""Counts and rates over fields, actions, records and events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from decretum.functions import patterns as P
from decretum.operators.payloads import answer_scores, is_true, parsed_answers

SCORED_FIELDS = ("case_number", "court", "judgment_date", "parties")
#: Score of an action plan that asks for more context.
MORE_CONTEXT = 0.4


def overall_confidence(
    records: DataFrame, fields: DataFrame, actions: DataFrame, extra: DataFrame | None = None, *,
    details: DataFrame | None = None, plans: DataFrame | None = None,
) -> DataFrame:
    """Mean of the non-zero scores of four fields, all actions and the model's answers; 0 without any.

    ``details`` and ``plans`` hold record_id and json: a details answer adds its own score, an action plan that asks for more context adds
    ``MORE_CONTEXT`` (``answer_scores``). ``extra`` adds rows ``(record_id, confidence)``, such as the score of another source. The mean is
    rounded by its decimal value to nine digits, as the order of a sum would decide ties.
    """
    scores = fields.where(F.col("field").isin(*SCORED_FIELDS)).select("record_id", "confidence").unionByName(
        actions.select("record_id", "confidence")
    )
    for more in (extra, None if details is None else answer_scores(details), None if plans is None else plan_penalties(plans)):
        if more is not None:
            scores = scores.unionByName(more.select("record_id", "confidence"))
    mean = F.bround(F.round(F.avg("confidence"), 9), 2)
    means = scores.where("confidence <> 0").groupBy("record_id").agg(mean.alias("overall_confidence"))
    return records.select("record_id").distinct().join(means, "record_id", "left").select(
        "record_id", F.coalesce("overall_confidence", F.lit(0.0)).alias("overall_confidence")
    )


def plan_penalties(plans: DataFrame) -> DataFrame:
    """``record_id, confidence`` of the action plans that ask for more context."""
    return parsed_answers(plans).where(is_true(F.try_variant_get("doc", "$.needs_more_context", "variant"))).select("record_id", F.lit(MORE_CONTEXT).alias("confidence"))


def evidence_targets_long(fields: DataFrame, directions: DataFrame, actions: DataFrame) -> DataFrame:
    """Everything that should carry evidence: filled fields, directions, actions."""
    none = F.array().cast("array<string>")
    filled = fields.where("coalesce(value, '') not in ('', 'unknown')")
    return (
        filled.select("record_id", F.lit("field").alias("kind"), "evidence", none.alias("flags"),
                      (F.col("status") == "ambiguous").alias("ambiguous") if "status" in fields.columns else F.lit(False).alias("ambiguous"))
        .unionByName(directions.select("record_id", F.lit("direction").alias("kind"), "evidence", none.alias("flags"), F.lit(False).alias("ambiguous")))
        .unionByName(actions.select("record_id", F.lit("action").alias("kind"), "evidence", F.col("ambiguity_flags").alias("flags"), F.lit(False).alias("ambiguous")))
    )


def record_metrics(
    targets: DataFrame, *, records: DataFrame | None = None, profiles: DataFrame | None = None, duplicates: DataFrame | None = None,
    audit: DataFrame | None = None,
) -> DataFrame:
    """Evidence coverage, counts, page methods and confidence per record.

    ``targets`` is ``evidence_targets_long``; ``profiles`` holds page_count and
    ocr_used, ``duplicates`` one row per candidate, ``audit`` the events. ``records`` names the records to report, those without
    targets too (coverage 0), with overall_confidence, processing_ms and ``source_metadata``, a struct of ocr_routing, vision_fallback_used, ocr_used,
    ocr_pages and vision_pages; without it there is one row per record of ``targets``.
    """
    zero = F.lit(0).cast("long")
    method = F.coalesce("e.extraction_method", F.col("e.match_strategy") if "match_strategy" in targets.schema["evidence"].dataType.simpleString() else F.lit(None), F.lit("unknown"))
    rows = targets.groupBy("record_id").agg(
        F.bround(F.avg(F.when(F.size("evidence") > 0, 100.0).otherwise(0.0)), 0).cast("int").alias("evidence_coverage_percent"),
        (F.count_if("ambiguous") + F.sum(F.size("flags"))).alias("ambiguous_count"),
    )
    counts = targets.select("record_id", F.explode("evidence").alias("e")).groupBy("record_id", method.alias("method")).agg(F.count("*").alias("n"))
    methods = counts.groupBy("record_id").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("method", "n")))).alias("extraction_method_counts"))
    rows = rows.join(methods, "record_id", "left")
    if records is None:
        rows = rows.withColumns({"_meta": F.lit(None).cast(_META), "overall_confidence": F.lit(None).cast("double"), "processing_ms": F.lit(None).cast("long")})
    else:
        named = records.select("record_id", F.col("source_metadata").alias("_meta"), "overall_confidence", "processing_ms")
        rows = named.join(rows, "record_id", "left")
    if profiles is not None:
        rows = rows.join(profiles.select("record_id", "page_count", F.col("ocr_used").alias("_ocr")), "record_id", "left")
    else:
        rows = rows.withColumns({"page_count": F.lit(None).cast("long"), "_ocr": F.lit(False)})
    if duplicates is not None:
        rows = rows.join(duplicates.groupBy("record_id").agg(F.count("*").alias("duplicate_count")), "record_id", "left")
    else:
        rows = rows.withColumn("duplicate_count", zero)
    if audit is not None:
        edits = audit.where(F.col("event_type").isin("field_update", "action_update"))
        rows = rows.join(edits.groupBy("record_id").agg(F.count("*").alias("review_edit_count")), "record_id", "left")
    else:
        rows = rows.withColumn("review_edit_count", zero)

    def told(c) -> Column:
        return F.coalesce(c, F.lit(False))

    seen = F.exists(F.map_keys(F.coalesce("extraction_method_counts", F.create_map().cast("map<string,bigint>"))), lambda m: m.startswith("vision_"))
    vision = told(F.col("_meta.ocr_routing").startswith("vision_ocr")) | told(F.col("_meta.vision_fallback_used")) | seen
    some = lambda c: F.when(F.size(c) > 0, F.col(c))
    return rows.withColumns(
        {
            "evidence_coverage_percent": F.coalesce("evidence_coverage_percent", F.lit(0)),
            "ambiguous_count": F.coalesce("ambiguous_count", zero),
            "vision_ocr_used": vision,
            "ocr_used": told("_ocr") | told(F.col("_meta.ocr_used")) | vision,
            "ocr_pages": F.coalesce(some("_meta.ocr_pages"), some("_meta.vision_pages"), F.array().cast("array<int>")),
            "duplicate_count": F.coalesce("duplicate_count", zero),
            "review_edit_count": F.coalesce("review_edit_count", zero),
            "overall_confidence": F.coalesce("overall_confidence", F.lit(0.0)),
        }
    ).drop("_ocr", "_meta")


_META = "struct<ocr_routing:string,vision_fallback_used:boolean,ocr_used:boolean,ocr_pages:array<int>,vision_pages:array<int>>"


def refresh_metrics(metrics: DataFrame, changed: DataFrame, targets: DataFrame, **inputs: DataFrame) -> DataFrame:
    """Metrics with the rows of ``changed`` records computed anew from their inputs, the others as they are.

    ``changed`` holds record_id; records that no input has any more leave the table. The inputs are those of ``record_metrics``, each filtered to the
    changed ids before anything is grouped. ``store.write_buckets`` then rewrites only the parts of the stored table that hold those ids.
    """
    ids = changed.select("record_id").distinct()
    only = lambda df: df.join(ids, "record_id", "left_semi")
    fresh = record_metrics(only(targets), **{name: only(df) for name, df in inputs.items()})
    return metrics.join(ids, "record_id", "left_anti").unionByName(fresh.select(*metrics.columns))


def extraction_method_counts(targets: DataFrame) -> DataFrame:
    """Evidence items per record and method."""
    ev = targets.select("record_id", F.explode("evidence").alias("e"))
    strategy = F.col("e.match_strategy") if "match_strategy" in str(targets.schema["evidence"].dataType.simpleString()) else F.lit(None).cast("string")
    method = F.coalesce("e.extraction_method", strategy, F.lit("unknown"))
    return ev.groupBy("record_id", method.alias("method")).agg(F.count("*").alias("evidence_count"))


def dashboard_metrics(records: DataFrame) -> DataFrame:
    """One row over all records; zeros for an empty table."""
    zero = F.lit(0)
    return records.agg(
        F.count("*").alias("record_count"),
        F.count_if(F.col("review_status").isin(*P.PUBLISHED_STATUSES)).alias("approved_or_completed_count"),
        F.coalesce(F.sum("duplicate_count"), zero).alias("duplicate_count"),
        F.coalesce(F.bround(F.avg(F.coalesce("overall_confidence", F.lit(0.0))), 2), F.lit(0.0)).alias("average_confidence"),
        F.coalesce(F.bround(F.avg("evidence_coverage_percent"), 0).cast("int"), zero).alias("evidence_coverage_percent"),
        F.coalesce(F.bool_or("ocr_used"), F.lit(False)).alias("ocr_used"),
        F.coalesce(F.bool_or("vision_ocr_used"), F.lit(False)).alias("vision_ocr_used"),
    )


def kpi_strip(dashboard: DataFrame, queue: DataFrame) -> DataFrame:
    """Four counters: published actions and approvals from the dashboard, the rest from the queue.

    ``dashboard`` holds review_status and action_count; ``queue`` review_status.
    """
    shown = dashboard.select(
        F.col("action_count").cast("long").alias("published"), (F.col("review_status") == "approved").cast("long").alias("approved"),
        F.lit(0).cast("long").alias("pending"), F.lit(0).cast("long").alias("escalated"),
    )
    open_rows = queue.select(
        F.lit(0).cast("long").alias("published"), F.lit(0).cast("long").alias("approved"),
        (F.col("review_status") == "pending_review").cast("long").alias("pending"),
        F.col("review_status").isin("needs_clarification", "escalated").cast("long").alias("escalated"),
    )
    zero = F.lit(0).cast("long")
    return shown.unionByName(open_rows).agg(
        F.coalesce(F.sum("published"), zero).alias("published_actions"),
        F.coalesce(F.sum("pending"), zero).alias("pending_review"),
        F.coalesce(F.sum("escalated"), zero).alias("escalated"),
        F.coalesce(F.sum("approved"), zero).alias("approved"),
    )


def sync_stats(store: DataFrame, status: DataFrame) -> DataFrame:
    """Documents per sync status, never-synced ones as pending, with a total row."""
    rows = store.select("id").join(status.select("id", "sync_status"), "id", "left")
    state = F.coalesce("sync_status", F.lit("pending"))
    return rows.select(state.alias("sync_status")).rollup("sync_status").agg(F.count("*").alias("documents")).select(
        F.coalesce("sync_status", F.lit("total")).alias("sync_status"), "documents"
    )


def missing_field_count(fields: DataFrame) -> DataFrame:
    """Empty or unknown fields per record; list-like extras do not count."""
    counted = fields.where(~F.col("field").isin("directions", "risk_flags", "legal_phrases"))
    empty = F.lower(F.trim(F.coalesce("value", F.lit("")))).isin("", "unknown")
    return counted.groupBy("record_id").agg(F.count_if(empty).alias("missing_field_count"))


def queue_rows(records: DataFrame, departments: DataFrame, actions: DataFrame, missing: DataFrame) -> DataFrame:
    """Review queue: departments and owners in order, categories and roles sorted, counts.

    ``departments`` holds record_id and items. Owners are reduced to one row
    per record and name before they are gathered.
    """
    owners = actions.where("coalesce(responsible_department, '') <> ''").groupBy(
        "record_id", F.col("responsible_department").alias("name")
    ).agg((F.min("action_index") + 1_000_000).alias("ord"))
    listed = departments.select("record_id", F.posexplode("items").alias("ord", "name"))
    first = listed.unionByName(owners.select("record_id", "ord", "name")).groupBy("record_id", "name").agg(F.min("ord").alias("ord"))
    names = first.groupBy("record_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("ord", "name"))), lambda s: s["name"]).alias("departments")
    )
    counts = actions.groupBy("record_id").agg(
        F.count("*").alias("action_count"),
        F.array_sort(F.collect_set("category")).alias("action_categories"),
        F.array_sort(F.collect_set("escalation_recommendation")).alias("escalations"),
    )
    none = F.array().cast("array<string>")
    return (
        records.join(names, "record_id", "left").join(counts, "record_id", "left").join(missing, "record_id", "left")
        .withColumns(
            {
                "departments": F.coalesce("departments", none),
                "action_count": F.coalesce("action_count", F.lit(0)),
                "action_categories": F.coalesce("action_categories", none),
                "escalations": F.coalesce("escalations", none),
                "missing_field_count": F.coalesce("missing_field_count", F.lit(0)),
            }
        )
    )


# ---- timings -------------------------------------------------------------------------


def stage_totals(timings: DataFrame) -> DataFrame:
    """Total, count and mean duration per stage."""
    ms = F.coalesce("duration_ms", F.lit(0.0))
    return timings.where("coalesce(stage, '') <> ''").groupBy("stage").agg(
        F.bround(F.sum(ms), 2).alias("duration_ms"), F.count("*").alias("count"), F.bround(F.avg(ms), 2).alias("avg_duration_ms")
    )


def llm_timing_summary(events: DataFrame) -> DataFrame:
    """One row of transport, cache and parsing totals; a cache write is also a miss."""
    transport = F.coalesce(F.col("stage_name") == "llm_transport", F.lit(False))
    parse = F.coalesce(F.col("stage") == "llm_json_parse", F.lit(False))
    hit = F.coalesce("cache_hit", F.lit(False))
    event = F.when(hit, F.lit("hit")).otherwise(F.coalesce("cache_event", F.lit("")))
    failed = F.coalesce("timeout", F.lit(False)) | (F.coalesce("exception_type", F.lit("")) != "")

    def ms(column: str) -> Column:
        return F.coalesce(F.bround(F.sum(F.when(transport, F.coalesce(column, F.lit(0.0)) * 1000)), 2), F.lit(0.0))

    return events.agg(
        ms("http_elapsed_s").alias("http_elapsed_ms"),
        ms("rate_limiter_wait_s").alias("rate_limiter_wait_ms"),
        ms("retry_sleep_s").alias("retry_sleep_ms"),
        F.count_if(parse & (F.coalesce("json_attempt_index", F.lit(0)) > 0)).alias("json_repair_count"),
        F.count_if(transport & (F.coalesce("retry_attempt_index", F.lit(0)) > 0)).alias("transport_retry_count"),
        F.count_if(transport & hit).alias("cache_hits"),
        F.count_if(transport & event.isin("cache_miss", "cache_write")).alias("cache_misses"),
        F.count_if(transport & (event == "cache_write")).alias("cache_writes"),
        F.count_if(transport & (event == "cache_disabled")).alias("cache_disabled"),
        F.count_if(transport & F.coalesce("singleflight_joined", F.lit(False))).alias("singleflight_joins"),
        (
            F.count_if(transport & failed) + F.count_if(parse & (F.coalesce("exception_type", F.lit("")) != ""))
        ).alias("timeout_or_failure_count"),
    )


def effective_concurrency(files: DataFrame, wall_clock_ms: Column) -> DataFrame:
    """Summed file time over wall-clock time; 0 when the clock did not run."""
    total = F.bround(F.coalesce(F.sum(F.coalesce("duration_ms", F.lit(0.0))), F.lit(0.0)), 2)
    rows = files.agg(total.alias("total_file_processing_ms"), wall_clock_ms.alias("wall_clock_ms"))
    ratio = F.bround(F.try_divide("total_file_processing_ms", "wall_clock_ms"), 2)
    return rows.withColumn("effective_concurrency", F.when(F.col("wall_clock_ms") > 0, ratio).otherwise(0.0))


def slowest_files(files: DataFrame, n: int = 5) -> DataFrame:
    return files.select("file_name", "duration_ms").orderBy(F.desc(F.coalesce("duration_ms", F.lit(0.0))), "file_name").limit(n)


def slowest_stages(timings: DataFrame, n: int = 8) -> DataFrame:
    """The ``n`` longest stages of each file."""
    order = Window.partitionBy("file_name").orderBy(F.desc(F.coalesce("duration_ms", F.lit(0.0))), "stage_no")
    return timings.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)
