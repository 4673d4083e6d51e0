"""Queries over scores, timings, several sources and event streams, with their reference SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from decretum.catalog.extraction import J_BASE, J_TASKS
from decretum.catalog.fixtures import JUDGMENT_PAGES, judgment_pages, sql_table
from decretum.catalog.records import AUDIT, RECORDS, audit, read, records
from decretum.functions import text as T
from decretum.operators import evaluation as V
from decretum.operators import fusion as U
from decretum.operators import metrics as M
from decretum.operators import quality as Q
from decretum.sources.corpus import conversation_pages
from decretum.sources.tables import joined_where_dealt, settle, tasks_for
from decretum.streaming import jobs as K

QUERIES = {}
ORACLES = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


# ---- expected and actual actions -----------------------------------------------------

TITLES = """SELECT l_orderkey AS file_name, CAST(row_number() OVER (PARTITION BY l_orderkey
    ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate) - 1 AS INT) AS idx, concat('Task ', CAST(l_partkey AS VARCHAR(20))) AS title,
  concat('Unit ', CAST(l_suppkey % 3 AS VARCHAR(20))) AS owner, l_returnflag AS category, l_linestatus AS priority, l_partkey FROM lineitem"""
_E8 = f"""WITH e AS (SELECT * FROM ({TITLES})), a AS (SELECT file_name, idx, owner, category, priority,
    CASE WHEN l_partkey % 5 = 0 THEN concat('Other ', l_partkey) ELSE upper(title) END AS title FROM e WHERE l_partkey % 7 <> 0),
  t AS (SELECT e.file_name, e.idx, arg_min(a, a.idx) AS m FROM e JOIN a ON e.file_name = a.file_name AND lower(e.title) = lower(a.title) GROUP BY ALL),
  m AS (SELECT e.*, t.m IS NOT NULL AS by_title, coalesce(t.m, a) AS found FROM e LEFT JOIN t USING (file_name, idx) LEFT JOIN a ON a.file_name = e.file_name AND a.idx = e.idx)"""


def _titles(spark, sf_dir, kept=lambda rows: rows):
    e = kept(sql_table(spark, sf_dir, TITLES))
    return e, _altered(e)


def _altered(e):
    return e.where("l_partkey % 7 <> 0").withColumn(
        "title", F.when(F.col("l_partkey") % 5 == 0, F.concat(F.lit("Other "), "l_partkey")).otherwise(F.upper("title"))
    )


@query(
    "e8_match_expected_actions",
    f"{_E8} SELECT file_name, idx AS action_index, found.title AS actual_title, CASE WHEN found.idx IS NULL THEN 'no matching action found' WHEN by_title THEN 'matched by title' ELSE 'matched by index' END AS note FROM m",
)
def e8(spark, sf_dir):
    e, a = _titles(spark, sf_dir)
    return V.score_actions(e, a).select("file_name", "action_index", "actual_title", "note")


@query(
    "j2_score_actions",
    f"{_E8} SELECT file_name, idx AS action_index, by_title AS title_match, lower(owner) = lower(found.owner) AS owner_match, lower(category) = lower(found.category) AS category_match, lower(priority) = lower(found.priority) AS priority_match FROM m",
)
def j2(spark, sf_dir):
    e, a = _titles(spark, sf_dir)
    return V.score_actions(e, a).select("file_name", "action_index", "title_match", "owner_match", "category_match", "priority_match")


@query(
    "e9_match_expected_directions",
    f"{_E8} SELECT file_name, idx AS direction_index, found.title AS actual_text, by_title AS match FROM m",
)
def e9(spark, sf_dir):
    e, a = _titles(spark, sf_dir)
    out = V.score_directions(e.withColumnRenamed("title", "text"), a.withColumnRenamed("title", "text"))
    return out.select("file_name", "direction_index", "actual_text", "match")


@query(
    "j3_score_directions",
    f"{_E8} SELECT CASE WHEN found.idx IS NULL THEN 'no matching direction found' WHEN by_title THEN 'matched by text' ELSE 'matched by index' END AS note, count(*) AS n FROM m GROUP BY 1",
)
def j3(spark, sf_dir):
    e, a = _titles(spark, sf_dir)
    out = V.score_directions(e.withColumnRenamed("title", "text"), a.withColumnRenamed("title", "text"))
    return out.groupBy("note").agg(F.count("*").alias("n"))


@query(
    "j1_score_fields",
    f"""SELECT record_id AS file_name, 'case_number' AS field, true AS match, 'fuzzy_text' AS method FROM ({RECORDS})
    UNION ALL SELECT record_id, 'judgment_date', record_id % 3 <> 0, 'date' FROM ({RECORDS})
    UNION ALL SELECT record_id, 'departments', record_id % 4 <> 0, 'set_overlap' FROM ({RECORDS})
    UNION ALL SELECT record_id, 'court', NULL IS NOT NULL, 'fuzzy_text' FROM ({RECORDS})""",
)
def j1(spark, sf_dir):
    e, f = _expected_fields(spark, sf_dir)
    return V.score_fields(e, f).select("file_name", "field", "match", "method")


def _expected_fields(spark, sf_dir):
    r = records(spark, sf_dir)
    none = F.lit(None)

    def exp(field, value, items=None):
        return F.struct(F.lit(field).alias("field"), value.cast("string").alias("expected"), (none if items is None else items).cast("array<string>").alias("expected_items"),
                        F.lit(items is not None).alias("is_list"))

    def act(field, value, items=None):
        return F.struct(F.lit(field).alias("field"), value.cast("string").alias("value"), (none if items is None else items).cast("array<string>").alias("items"))

    wanted = F.array(
        exp("case_number", F.concat(F.upper("case_number"), F.lit(" "))), exp("judgment_date", F.date_format("judgment_date", "d MMMM yyyy")),
        exp("departments", none, F.array(F.lit("BBMP"), F.lit("PWD"))), exp("court", F.col("court")), exp("metrics", F.lit("x")),
    )
    found = F.array(
        act("case_number", F.col("case_number")),
        act("judgment_date", F.when(F.col("record_id") % 3 == 0, F.lit("1900-01-01")).otherwise(F.col("judgment_date").cast("string"))),
        act("departments", none, F.when(F.col("record_id") % 4 == 0, F.array(F.lit("BDA"))).otherwise(F.array(F.lit(" bbmp "), F.lit("x")))),
    )
    e = r.select(F.col("record_id").alias("file_name"), F.explode(wanted).alias("w")).select("file_name", "w.*")
    f = r.select(F.col("record_id").alias("file_name"), F.explode(found).alias("w")).select("file_name", "w.*")
    return e, f


@query(
    "g7_list_overlap",
    """SELECT o_orderkey AS id, CASE o_orderkey % 4 WHEN 0 THEN 'both empty' WHEN 1 THEN 'expected 2 vs actual 0' WHEN 2 THEN 'partial overlap (1/2)' ELSE 'full overlap (2/2)' END AS note,
      o_orderkey % 4 <> 1 AS match FROM orders""",
)
def g7(spark, sf_dir):
    k = F.col("o_orderkey") % 4
    none = F.array().cast("array<string>")
    e = F.when(k == 0, F.array(F.lit(""))).otherwise(F.array(F.lit("BBMP"), F.lit("PWD")))
    a = F.when(k <= 1, none).when(k == 2, F.array(F.lit("pwd"), F.lit("z"))).otherwise(F.array(F.lit("pwd "), F.lit("bbmp")))
    o = V.list_overlap(e, a)
    return read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), o["note"].alias("note"), o["match"].alias("match"))


_J4 = f"""SELECT record_id AS file_name, 'evidence_coverage_percent' AS metric, record_id % 11 <= 5 AS match FROM ({RECORDS})
  UNION ALL SELECT record_id, 'duplicate_count', record_id % 2 = 0 FROM ({RECORDS}) UNION ALL SELECT record_id, 'note', false FROM ({RECORDS})"""


def _metric_rows(spark, sf_dir):
    r = records(spark, sf_dir)

    def rows(shift_cov, shift_dup, note):
        s = lambda n, v: F.struct(F.lit(n).alias("metric"), v.cast("string").alias("value"))
        items = F.array(s("evidence_coverage_percent", F.col("evidence_coverage_percent") + shift_cov), s("duplicate_count", F.col("duplicate_count") + shift_dup), s("note", F.lit(note)))
        return r.select(F.col("record_id").alias("file_name"), F.explode(items).alias("m")).select("file_name", "m.*")

    return rows(F.lit(0), F.lit(0), "a"), rows(F.col("record_id") % 11, F.col("record_id") % 2, "b")


@query("j4_score_metrics", _J4)
def j4(spark, sf_dir):
    e, a = _metric_rows(spark, sf_dir)
    return V.score_metrics(e, a).select("file_name", "metric", "match")


@query(
    "j4_label_scores",
    """SELECT doc_id AS file_name, 'quality' AS metric, quality = toxic AS match FROM labels""",
)
def j4_labels(spark, sf_dir):
    lab = read(spark, sf_dir, "labels")
    e = lab.select(F.col("doc_id").alias("file_name"), F.lit("quality").alias("metric"), F.col("quality").cast("string").alias("value"))
    a = lab.select(F.col("doc_id").alias("file_name"), F.lit("quality").alias("metric"), F.col("toxic").cast("string").alias("value"))
    return V.score_metrics(e, a).select("file_name", "metric", "match")


_PER_FILE = f"""{_E8} SELECT record_id AS file_name, record_id % 10 <> 0 AS success, CAST(1 + CAST(record_id % 3 <> 0 AS INT) + CAST(record_id % 4 <> 0 AS INT) AS BIGINT) AS field_hits, 4 AS field_total,
    coalesce(ah, 0) AS action_hits, coalesce(at, 0) AS action_total, coalesce(ah, 0) AS direction_hits, coalesce(at, 0) AS direction_total, CAST(CAST(record_id % 11 <= 5 AS INT) + CAST(record_id % 2 = 0 AS INT) AS BIGINT) AS metrics_hits, 3 AS metrics_total
  FROM ({RECORDS}) LEFT JOIN (SELECT file_name AS f, count(*) FILTER (by_title) AS ah, count(*) AS at FROM m GROUP BY f) ON f = record_id"""


def _per_file(spark, sf_dir):
    """The lines are numbered once for both kinds; all tables are dealt by file once and scored where they lie."""
    e, _ = _titles(spark, sf_dir, settle)
    tasks = tasks_for(spark, e.count())

    def by_file(*tables):
        return tuple(x.repartition(tasks, "file_name") for x in tables)

    files = records(spark, sf_dir).select(F.col("record_id").alias("file_name"), (F.col("record_id") % 10 != 0).alias("success"))
    titles = by_file(e, _altered(e))
    expected, actual = (x.withColumnRenamed("title", "text") for x in titles)
    with joined_where_dealt(spark):
        fields, metrics = V.score_fields(*by_file(*_expected_fields(spark, sf_dir))), V.score_metrics(*by_file(*_metric_rows(spark, sf_dir)))
        return settle(V.per_file_scores(*by_file(files), fields, V.score_actions(*titles), V.score_directions(expected, actual), metrics))


@query("f7_per_file_scores", _PER_FILE.replace("coalesce(at, 0)", "coalesce(n_at, 0)").replace("count(*) AS at", "count(*) AS n_at"))
def f7(spark, sf_dir):
    return _per_file(spark, sf_dir).select("file_name", "success", "field_hits", "field_total", "action_hits", "action_total", "direction_hits", "direction_total", "metrics_hits", "metrics_total")


@query(
    "f6_accuracy_summary",
    f"""SELECT count(*) AS total, count(*) FILTER (success) AS successful, count(*) FILTER (NOT success) AS failed, round_even(sum(field_hits) / sum(field_total), 4) AS field_accuracy,
      round_even(sum(action_hits) / sum(action_total), 4) AS action_accuracy, round_even(sum(direction_hits) / sum(direction_total), 4) AS direction_accuracy, round_even(sum(metrics_hits) / sum(metrics_total), 4) AS metrics_accuracy FROM ({_PER_FILE.replace("coalesce(at, 0)", "coalesce(n_at, 0)").replace("count(*) AS at", "count(*) AS n_at")})""",
)
def f6(spark, sf_dir):
    return V.accuracy_summary(_per_file(spark, sf_dir))


@query("j5_evaluation_brief")
def j5(spark, sf_dir):
    from decretum.catalog.actions import flat_actions, j_parts  # noqa: F401
    from decretum.operators import actions as A

    directions, context, rows = j_parts(spark, sf_dir)
    acts = settle(A.directions_to_actions(directions, context))
    recs = records(spark, sf_dir).select("record_id", "original_file_name", "review_status", "overall_confidence", F.array(F.lit("x")).alias("risk_flags"))
    times = read(spark, sf_dir, "events").select(F.col("user_id").alias("record_id"), F.col("event_type").alias("stage"), F.col("value").alias("duration_ms"))
    return V.evaluation_lines(recs, rows, directions, acts, times.join(recs.select("record_id"), "record_id", "left_semi"))


# ---- timings -------------------------------------------------------------------------


@query("f8_stage_totals", "SELECT event_type AS stage, round_even(sum(value), 2) AS duration_ms, count(*) AS count, round_even(avg(value), 2) AS avg_duration_ms FROM events GROUP BY event_type")
def f8(spark, sf_dir):
    e = read(spark, sf_dir, "events").select(F.col("event_type").alias("stage"), F.col("value").alias("duration_ms"))
    return M.stage_totals(e)


_K = "CAST(json_extract(props, '$.k') AS BIGINT)"


def _llm_events(spark, sf_dir):
    k = F.get_json_object("props", "$.k").cast("long")
    names = F.array(F.lit("cache_miss"), F.lit("cache_write"), F.lit("cache_disabled"), F.lit("cache_hit"))
    return read(spark, sf_dir, "events").select(
        "ts", F.col("user_id"), F.when(F.col("event_type") == "error", "llm_json_parse").otherwise("llm").alias("stage"),
        F.when(F.col("event_type") != "error", "llm_transport").alias("stage_name"), F.bround("value", 0).alias("http_elapsed_s"),
        F.lit(0.0).alias("rate_limiter_wait_s"), F.lit(None).cast("double").alias("retry_sleep_s"), (k % 2).alias("retry_attempt_index"),
        (k % 4 == 3).alias("cache_hit"), F.element_at(names, (k % 4 + 1).cast("int")).alias("cache_event"), (k % 5 == 0).alias("singleflight_joined"),
        (k % 7 == 0).alias("timeout"), F.when(k % 3 == 0, "ValueError").alias("exception_type"), (k % 2).alias("json_attempt_index"), (k * 100).alias("tokens"),
    )


@query(
    "f9_llm_timing_summary",
    f"""WITH e AS (SELECT event_type = 'error' AS p, round_even(value, 0) AS v, {_K} AS k FROM events)
    SELECT sum(v) FILTER (NOT p) * 1000 AS http_elapsed_ms, 0.0 AS rate_limiter_wait_ms, 0.0 AS retry_sleep_ms, count(*) FILTER (p AND k % 2 > 0) AS json_repair_count,
      count(*) FILTER (NOT p AND k % 2 > 0) AS transport_retry_count, count(*) FILTER (NOT p AND k % 4 = 3) AS cache_hits, count(*) FILTER (NOT p AND k % 4 IN (0, 1)) AS cache_misses,
      count(*) FILTER (NOT p AND k % 4 = 1) AS cache_writes, count(*) FILTER (NOT p AND k % 4 = 2) AS cache_disabled, count(*) FILTER (NOT p AND k % 5 = 0) AS singleflight_joins,
      count(*) FILTER (NOT p AND (k % 7 = 0 OR k % 3 = 0)) + count(*) FILTER (p AND k % 3 = 0) AS timeout_or_failure_count FROM e""",
)
def f9(spark, sf_dir):
    return M.llm_timing_summary(_llm_events(spark, sf_dir))


@query(
    "f10_effective_concurrency",
    "SELECT round_even(sum(value), 2) AS total_file_processing_ms, round_even(round_even(sum(value), 2) / 100000.0, 2) AS effective_concurrency FROM events",
)
def f10(spark, sf_dir):
    e = read(spark, sf_dir, "events").select(F.col("value").alias("duration_ms"))
    return M.effective_concurrency(e, F.lit(100000.0)).drop("wall_clock_ms")


@query("g3_slowest_files", "SELECT event_id AS file_name, value AS duration_ms FROM events ORDER BY value DESC, event_id LIMIT 5")
def g3(spark, sf_dir):
    return M.slowest_files(read(spark, sf_dir, "events").select(F.col("event_id").alias("file_name"), F.col("value").alias("duration_ms")))


@query(
    "g5_slowest_stages",
    "SELECT user_id AS file_name, event_id AS stage_no, value AS duration_ms FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) <= 8",
)
def g5(spark, sf_dir):
    e = read(spark, sf_dir, "events").select(F.col("user_id").alias("file_name"), F.col("event_id").alias("stage_no"), F.col("value").alias("duration_ms"))
    return M.slowest_stages(e).drop("rank")


# ---- several sources -----------------------------------------------------------------


def field_sources(spark, sf_dir):
    """Primary and second-source fields of every order."""
    r = records(spark, sf_dir)
    k = F.col("record_id") % 4
    none = F.lit(None)

    def fld(name, value, conf, review):
        return F.struct(F.lit(name).alias("field"), value.cast("string").alias("value"), none.cast("array<string>").alias("items"), F.lit(conf).alias("confidence"), review.alias("requires_review"))

    first = F.array(
        fld("case_number", F.when(k == 0, "Writ Petition No.").when(k == 1, none).otherwise(F.col("case_number")), 0.92, F.lit(False)),
        fld("court", F.col("court"), 0.8, k == 2),
        fld("disposition", F.when(k == 3, "unknown").otherwise("allowed"), 0.9, F.lit(False)),
    )
    second = F.array(
        fld("case_number", F.concat(F.lit("WP "), "record_id"), 0.9, F.lit(False)), fld("court", F.lit("Supreme Court"), 0.9, F.lit(False)),
        fld("disposition", F.when(F.col("record_id") % 8 == 3, "granted maybe").otherwise("Partly Allowed"), 0.9, F.lit(False)),
    )
    make = lambda a: r.select("record_id", F.explode(a).alias("f")).select("record_id", "f.*")
    return make(first), make(second)


_FIRST = f"""SELECT record_id, 'case_number' AS field, CASE record_id % 4 WHEN 0 THEN 'Writ Petition No.' WHEN 1 THEN NULL ELSE case_number END AS value, record_id % 4 IN (0, 1) AS weak FROM ({RECORDS})
  UNION ALL SELECT record_id, 'court', court, record_id % 4 = 2 FROM ({RECORDS})
  UNION ALL SELECT record_id, 'disposition', CASE WHEN record_id % 4 = 3 THEN 'unknown' ELSE 'allowed' END, record_id % 4 = 3 FROM ({RECORDS})"""


@query("b10_is_weak_field", f"SELECT record_id, field, weak FROM ({_FIRST})")
def b10(spark, sf_dir):
    first, _ = field_sources(spark, sf_dir)
    return first.select("record_id", "field", U.is_weak_field(F.col("field"), F.col("value"), F.col("confidence"), F.col("requires_review")).alias("weak"))


@query(
    "e10_fuse_sources",
    f"""SELECT record_id, field, CASE WHEN weak AND field = 'case_number' THEN concat('WP ', record_id) WHEN weak AND field = 'court' THEN 'Supreme Court'
        WHEN weak AND record_id % 8 <> 3 THEN 'Partly Allowed' ELSE value END AS value, weak AND NOT (field = 'disposition' AND record_id % 8 = 3) AS filled FROM ({_FIRST})""",
)
def e10(spark, sf_dir):
    out = U.fuse_fields(*field_sources(spark, sf_dir))
    return out.select("record_id", "field", "value", (F.col("value_source") != "primary").alias("filled"))


@query("b16_empty_values", "SELECT o_orderkey AS id, o_orderkey % 5 IN (0, 1, 2) AS is_empty, o_orderkey % 5 IN (0, 2) OR o_custkey % 2 = 0 AS research FROM orders")
def b16(spark, sf_dir):
    k = F.col("o_orderkey") % 5
    said = F.when(k == 0, " Unknown ").when(k == 1, "null").when(k == 2, "").otherwise("x")
    conf = F.when(F.col("o_custkey") % 2 == 0, 0.4).otherwise(0.9)
    return read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), T.is_empty_text(said).alias("is_empty"), T.needs_research(said, conf).alias("research"))


@query(
    "b17_source_direction_filters",
    f"""SELECT record_id, page, kind <> 3 AS valid, false AS heading FROM ({J_TASKS})
    UNION ALL SELECT record_id, page, false, page = 1 FROM ({JUDGMENT_PAGES}) WHERE page IN (1, 99)""",
)
def b17(spark, sf_dir):
    p = judgment_pages(spark, sf_dir)
    said = F.when(F.col("page") == 1, "Order").otherwise(F.regexp_extract("text", r"record\. (.*)$", 1))
    return p.select("record_id", "page", U.valid_direction(said).alias("valid"), U.heading_only(said).alias("heading"))


@query(
    "b11_needs_fallback",
    """WITH c AS (SELECT conv_id AS record_id, count(*) FILTER (length(trim(text)) < 80) AS sp FROM conversations GROUP BY conv_id)
    SELECT record_id, sp > 0 OR record_id % 2 = 1 AS needs_fallback, CASE WHEN sp > 0 THEN 'sparse_pages' WHEN record_id % 2 = 1 THEN 'weak_fields' END AS why FROM c""",
)
def b11(spark, sf_dir):
    p = conversation_pages(read(spark, sf_dir, "conversations"))
    chars = F.length(F.trim("text"))
    prof = p.groupBy("record_id").agg(F.lit("digital").alias("profile_type"), F.count_if(chars < 80).alias("sparse_count"))
    strong = F.col("record_id") % 2 == 0
    said = {"parties": "Asha Rao; Dev Sen", "petitioners": "Asha Rao", "respondents": "Dev Sen", "bench": "Justice Tara Sen", "judgment_date": "2001-02-03"}
    body = F.array(*[F.struct(F.lit(n).alias("field"), F.when(strong, v).otherwise("").alias("value")) for n, v in said.items()])
    fields = p.select("record_id").distinct().select("record_id", F.explode(body).alias("f")).select(
        "record_id", "f.*", F.lit(0.9).alias("confidence"), F.lit(False).alias("requires_review")
    )
    return U.needs_fallback(p, fields, prof, Q.is_law_report(p))


@query(
    "b18_source_gates",
    f"SELECT record_id, true AS has_case_signal, record_id % 2 = 0 AND record_id % 3 = 0 AND record_id % 4 IN (0, 2) AS can_reuse FROM ({RECORDS})",
)
def b18(spark, sf_dir):
    first, _ = field_sources(spark, sf_dir)
    r = records(spark, sf_dir)
    more = r.select("record_id", F.explode(F.array(F.lit("bench"), F.lit("judgment_date"))).alias("field"), F.lit("v").alias("value"))
    rows = first.select("record_id", "field", "value").unionByName(more)
    sources = r.select("record_id", F.when(F.col("record_id") % 2 == 0, "vision_ocr_text").otherwise("text").alias("ocr_routing"), F.lit(True).alias("has_vision_pages"))
    directions = r.where("record_id % 3 = 0").select("record_id")
    a = U.has_case_signal(r, rows, directions)
    return a.join(U.can_reuse_source(sources, rows, directions), "record_id").select("record_id", "has_case_signal", "can_reuse")


@query(
    "b19_fields_needing_retry",
    f"""SELECT record_id, u.f AS field, u.f IN ('bench', 'case_number', 'court', 'judgment_date') AS critical FROM ({RECORDS}),
      (SELECT unnest(['bench', 'judgment_date', 'petitioners', 'respondents', 'departments', 'advocates', 'case_number', 'disposition']) AS f) u
    WHERE u.f NOT IN ('case_number', 'disposition') OR (u.f = 'case_number' AND record_id % 4 IN (0, 1)) OR (u.f = 'disposition' AND record_id % 4 = 3)""",
)
def b19(spark, sf_dir):
    first, _ = field_sources(spark, sf_dir)
    return U.fields_needing_retry(first, first)


@query(
    "d10_calibrated_confidence",
    "SELECT event_id, CASE WHEN event_id % 4 = 0 THEN least(least(1.0, round_even(value, 0) / 100), 0.3) WHEN event_id % 4 = 1 THEN least(least(1.0, round_even(value, 0) / 100), 0.5) WHEN event_id % 4 = 2 THEN least(least(1.0, round_even(value, 0) / 100), 0.65) ELSE least(1.0, round_even(value, 0) / 100) END AS confidence FROM events",
)
def d10(spark, sf_dir):
    e = read(spark, sf_dir, "events")
    k = F.col("event_id") % 4
    return e.select("event_id", T.calibrated_confidence(F.bround("value", 0) / 100, k == 0, k != 1, k != 2).alias("confidence"))


@query(
    "d11_normalise_labels",
    "SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'no_operational_action' WHEN 1 THEN 'direct_compliance' WHEN 2 THEN 'payment_release' ELSE 'legal_review' END AS category, CASE WHEN event_id % 2 = 0 THEN 'high' ELSE 'medium' END AS priority FROM events",
)
def d11(spark, sf_dir):
    k = F.col("event_id") % 4
    cat = F.when(k == 0, "No Action").when(k == 1, "compliance").when(k == 2, "Payment-Release").otherwise(F.lit(None))
    pri = F.when(F.col("event_id") % 2 == 0, " HIGH ").otherwise("urgent")
    return read(spark, sf_dir, "events").select("event_id", T.normalise_category(cat).alias("category"), T.normalise_priority(pri).alias("priority"))


@query(
    "d12_normalise_risk_flags",
    "SELECT event_id, concat('owner_unclear|', event_type, '_x|missing_timeline') AS flags FROM events",
)
def d12(spark, sf_dir):
    items = F.array(F.lit("No OWNER named"), F.concat("event_type", F.lit("  --X!")), F.lit("due date?"), F.lit("owner again"), F.lit(" "))
    return read(spark, sf_dir, "events").select("event_id", F.array_join(T.normalise_flags(items), "|").alias("flags"))


@query(
    "d13_salvage_json",
    f"SELECT event_id, CASE WHEN event_id % 4 < 3 THEN {_K} END AS k FROM events",
)
def d13(spark, sf_dir):
    e = read(spark, sf_dir, "events")
    n = F.col("event_id") % 4
    said = (
        F.when(n == 0, F.concat(F.lit("```json\n"), "props", F.lit("\n```"))).when(n == 1, F.col("props"))
        .when(n == 2, F.concat(F.lit("Here you are: "), "props", F.lit(" Bye."))).otherwise("nothing [1]")
    )
    return e.select("event_id", F.get_json_object(U.salvage_json(said), "$.k").cast("long").alias("k"))


@query("d14_as_list", "SELECT event_id, concat(event_type, '|b c') AS items FROM events")
def d14(spark, sf_dir):
    return read(spark, sf_dir, "events").select("event_id", F.array_join(U.as_list(F.concat(F.lit(" "), "event_type", F.lit(" ,, b c,"))), "|").alias("items"))


@query(
    "d15_names_compatible",
    "SELECT c_custkey, length(regexp_replace(c_name, '[^A-Za-z0-9_]', '', 'g')) >= 12 AS with_suffix, false AS with_other FROM customer",
)
def d15(spark, sf_dir):
    c = read(spark, sf_dir, "customer")
    key = T.name_match_key(F.col("c_name"))
    return c.select("c_custkey", T.names_compatible(key, T.name_match_key(F.concat("c_name", F.lit(" & Brothers Private Limited Company")))).alias("with_suffix"),
                    T.names_compatible(key, F.lit("zzz")).alias("with_other"))


@query(
    "e11_merge_page_results",
    """SELECT conv_id AS record_id, arg_min(text, turn) FILTER (role = 'user') AS value, count(DISTINCT text) AS directions FROM conversations WHERE trim(text) <> '' GROUP BY conv_id""",
)
def e11(spark, sf_dir):
    c = read(spark, sf_dir, "conversations").select(F.col("conv_id").alias("record_id"), F.col("turn").alias("result_no"), F.lit(0).alias("pos"), "role", F.col("text").alias("value"))
    fields = U.merge_page_results(c.withColumn("field", F.col("role"))).where("field = 'user'").select("record_id", "value")
    n = U.merge_page_directions(c).groupBy("record_id").agg(F.count("*").alias("directions"))
    return n.join(fields, "record_id", "left").select("record_id", "value", "directions")


def _two_readings(spark, sf_dir):
    """Rule and model fields of every order for the repair operators."""
    r = records(spark, sf_dir)
    k = F.col("record_id") % 3
    none = F.array().cast("array<string>")

    def fld(name, value, items=None):
        return F.struct(F.lit(name).alias("field"), value.cast("string").alias("value"), (none if items is None else items).alias("items"), F.lit(0.8).alias("confidence"), F.lit(True).alias("requires_review"))

    two, one = F.array(F.lit("Justice A. Rao"), F.lit("Justice B. Sen")), F.array(F.lit("B. SEN"))
    adv = F.array(F.lit("Mr. C. Das, Adv."))
    rules = F.array(fld("bench", F.array_join(two, "; "), two), fld("disposition", F.lit("allowed")), fld("advocates", F.lit("x"), adv), fld("judgment_date", F.lit("2001-01-01")))
    model = F.array(
        fld("bench", F.lit("x"), F.when(k == 0, one).otherwise(two)), fld("disposition", F.when(k == 1, "Dismissed").when(k == 2, "unknown").otherwise("allowed")),
        fld("advocates", F.when(k == 0, "x"), F.when(k == 0, adv).otherwise(none)), fld("judgment_date", F.lit("2001-01-01")),
    )
    make = lambda a: r.select("record_id", F.explode(a).alias("f")).select("record_id", "f.*")
    return make(rules), make(model)


_E12 = f"""SELECT record_id, 'bench' AS field, 'fewer_judges' AS why FROM ({RECORDS}) WHERE record_id % 3 = 0
  UNION ALL SELECT record_id, 'disposition', CASE record_id % 3 WHEN 1 THEN 'disagree' ELSE 'empty' END FROM ({RECORDS}) WHERE record_id % 3 IN (1, 2)
  UNION ALL SELECT record_id, 'advocates', 'empty' FROM ({RECORDS}) WHERE record_id % 3 <> 0"""


@query("e12_fields_to_repair", _E12)
def e12(spark, sf_dir):
    return U.fields_to_repair(*_two_readings(spark, sf_dir))


@query(
    "e12_apply_field_repair",
    f"""SELECT record_id, 'bench' AS field, CASE WHEN record_id % 3 = 0 THEN 'Justice A. Rao; Justice B. Sen' ELSE 'x' END AS value, record_id % 3 = 0 AS repaired FROM ({RECORDS})
    UNION ALL SELECT record_id, 'disposition', CASE record_id % 3 WHEN 0 THEN 'allowed' ELSE 'allowed' END, record_id % 3 <> 0 FROM ({RECORDS})
    UNION ALL SELECT record_id, 'advocates', CASE WHEN record_id % 3 = 0 THEN 'x' ELSE 'Mr. C. Das, Adv.' END, record_id % 3 <> 0 FROM ({RECORDS})
    UNION ALL SELECT record_id, 'judgment_date', '2001-01-01', false FROM ({RECORDS})""",
)
def e12_apply(spark, sf_dir):
    rules, model = _two_readings(spark, sf_dir)
    todo = U.fields_to_repair(rules, model)
    value = F.when(F.col("field") == "disposition", " ALLOWED ").otherwise("x")
    items = F.when(F.col("field") == "bench", F.array(F.lit("B. Sen"))).when(F.col("field") == "advocates", F.array(F.lit("C. Das"))).otherwise(F.array().cast("array<string>"))
    answers = todo.select("record_id", "field", value.alias("value"), items.alias("items"), F.lit(0.9).alias("confidence"))
    return U.apply_field_repair(model, answers, rules).select("record_id", "field", "value", "repaired")


@query(
    "e14_field_diagnosis",
    f"""SELECT CASE record_id % 4 WHEN 0 THEN 'deterministic_found_but_llm_final_empty' WHEN 1 THEN 'llm_value_written' WHEN 2 THEN 'deterministic_value_written' ELSE 'missing_everywhere' END AS diagnosis, count(*) AS records
    FROM ({RECORDS}) GROUP BY 1""",
)
def e14(spark, sf_dir):
    r = records(spark, sf_dir)
    k = F.col("record_id") % 4
    side = lambda cond: r.select("record_id", F.lit("court").alias("field"), F.when(cond, F.col("court")).alias("value"))
    out = U.field_diagnosis(side(k.isin(0, 1, 2)), side(k == 1), side(k.isin(1, 2)))
    return out.groupBy("diagnosis").agg(F.count("*").alias("records"))


@query(
    "e15_merge_action_repairs",
    f"SELECT record_id, CASE WHEN record_id % 3 = 0 THEN 'new' ELSE 'old' END AS title, record_id % 3 = 0 AS repaired FROM ({RECORDS})",
)
def e15(spark, sf_dir):
    r = records(spark, sf_dir)
    cur = r.select("record_id", F.lit(0).alias("idx"), F.lit("old").alias("title"), F.lit("s").alias("evidence_snippet"))
    rep = r.select("record_id", F.lit(0).alias("idx"), F.lit("new").alias("title"), F.when(F.col("record_id") % 3 == 0, "s").otherwise("").alias("evidence_snippet"))
    return U.merge_action_repairs(cur, rep).select("record_id", "title", "repaired")


@query(
    "h13_payload_to_candidates",
    f"""SELECT record_id, 'case_number' AS field, case_number AS value FROM ({RECORDS}) UNION ALL SELECT record_id, 'bench', 'A; B' FROM ({RECORDS})
    UNION ALL SELECT record_id, 'departments', 'Revenue Board' FROM ({RECORDS}) UNION ALL SELECT record_id, 'direction', 'We direct payment' FROM ({RECORDS})""",
)
def h13(spark, sf_dir):
    r = records(spark, sf_dir)
    flat = F.concat(F.lit('{"case_number": "'), "case_number", F.lit('", "bench": ["A", {"name": "B"}], "departments": ["Revenue Board", "Foo"], "directions": ["Order:", {"text": "We direct payment"}]}'))
    nested = F.concat(F.lit('{"case_details": {"case_number": "'), "case_number", F.lit('", "bench": ["A", "B"], "responsible_entities": "Revenue Board", "directions": "We direct payment"}}'))
    p = r.select("record_id", F.when(F.col("record_id") % 2 == 0, flat).otherwise(nested).alias("json"))
    d = U.payload_directions(p).select("record_id", F.lit("direction").alias("field"), "value")
    return U.payload_to_candidates(p).select("record_id", "field", "value").unionByName(d)


@query(
    "c22_candidates_to_text",
    f"SELECT record_id, CASE WHEN record_id % 2 = 0 THEN 3 ELSE 1 END AS page, concat('case_number: ', case_number, '.', chr(10), 'court: ', court, '.', chr(10), 'ACTION CONTEXT.', chr(10), 'Pay now') AS text FROM ({RECORDS})",
)
def c22(spark, sf_dir):
    r = records(spark, sf_dir)
    none = F.lit(None).cast("array<string>")
    f = r.select("record_id", F.lit("court").alias("field"), F.col("court").alias("value"), none.alias("items")).unionByName(
        r.select("record_id", F.lit("case_number").alias("field"), F.col("case_number").alias("value"), none.alias("items")))
    d = r.select("record_id", F.posexplode(F.array(F.lit(" Pay now "), F.lit("PAY NOW"), F.lit(""))).alias("direction_index", "value"))
    pages = r.where("record_id % 2 = 0").select("record_id", F.lit(3).alias("page"))
    return U.candidates_to_text(f, d, pages).select("record_id", "page", "text")


@query(
    "g6_union_documents",
    """SELECT source_system, extraction_method, count(*) AS pages FROM (SELECT 'manual_upload' AS source_system, 'text' AS extraction_method FROM conversations WHERE trim(text) <> ''
      UNION ALL SELECT 'ccms', 'ocr' FROM documents) GROUP BY ALL""",
)
def g6(spark, sf_dir):
    text = conversation_pages(read(spark, sf_dir, "conversations")).withColumn("extraction_method", F.lit("text"))
    ocr = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("record_id"), F.lit(1).alias("page"), "text", F.lit("ocr").alias("extraction_method"), F.lit("ccms").alias("source_system"))
    out = U.union_documents(text, ocr, defaults={"source_system": F.lit("manual_upload")})
    return out.groupBy("source_system", "extraction_method").agg(F.count("*").alias("pages"))


@query(
    "e10_rebuild_actions",
    f"SELECT record_id FROM ({RECORDS}) WHERE record_id % 2 = 1 OR record_id % 3 = 0",
)
def e10_rebuild(spark, sf_dir):
    r = records(spark, sf_dir)
    acts = r.where("record_id % 2 = 0").select("record_id", F.when(F.col("record_id") % 3 == 0, "no_operational_action").otherwise("compliance").alias("category"))
    return U.should_rebuild_actions(r, acts)


@query(
    "e10_fuse_directions",
    f"SELECT record_id, CASE WHEN record_id % 2 = 0 THEN 'own' ELSE 'Accordingly we allow the plea' END AS value FROM ({RECORDS})",
)
def e10_directions(spark, sf_dir):
    r = records(spark, sf_dir)
    first = r.where("record_id % 2 = 0").select("record_id", F.lit(0).alias("direction_index"), F.lit("own").alias("value"), F.lit(0.78).alias("confidence"), F.lit(True).alias("requires_review"))
    second = r.select("record_id", F.posexplode(F.array(F.lit("Accordingly we allow the plea"), F.lit("The High Court held that it shall stand"), F.lit("Ordered:"))).alias("direction_index", "value"))
    return U.fuse_directions(first, second).select("record_id", "value")


# ---- questions -----------------------------------------------------------------------


@query(
    "i8_answer_questions",
    f"""SELECT record_id, CASE record_id % 3 WHEN 0 THEN concat('Judgment date: ', strftime(d, '%Y-%m-%d'), '.')
      WHEN 1 THEN concat('Petitioners: ', cn, '. Respondents: not extracted.')
      ELSE concat('Writ Petition No. ', record_id, ' of ', y, ' from High Court of ', place, ' has disposition unknown and ', (SELECT count(*) FROM lineitem WHERE l_orderkey = record_id), ' extracted action item(s).') END AS answer FROM ({J_BASE})""",
)
def i8(spark, sf_dir):
    from decretum.operators.answers import answer_questions

    r = records(spark, sf_dir).join(
        read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("owner_id"), "c_name"), "owner_id"
    )
    none = F.array().cast("array<string>")
    fields = r.select("record_id", F.explode(F.create_map(
        F.lit("judgment_date"), F.col("judgment_date").cast("string"), F.lit("petitioners"), F.col("c_name"), F.lit("case_number"), F.col("case_number"), F.lit("court"), F.col("court"))).alias("field", "value")
    ).withColumns({"items": none, "evidence": F.array().cast("array<struct<page:int,snippet:string,confidence:double>>")})
    li = read(spark, sf_dir, "lineitem")
    acts = li.select(F.col("l_orderkey").alias("record_id"), F.lit("t").alias("title"), F.lit("c").alias("category"), F.lit("o").alias("responsible_department"),
                     F.lit(None).cast("date").alias("due_date"), F.col("l_linenumber").alias("action_index"), F.lit("a").alias("action_id"),
                     F.array().cast("array<struct<page:int,snippet:string,confidence:double>>").alias("evidence"))
    q = F.element_at(F.array(F.lit("When was it decided?"), F.lit("Who is the petitioner?"), F.lit("Summary please")), (F.col("record_id") % 3 + 1).cast("int"))
    return answer_questions(r.select("record_id", F.lit(0).alias("question_id"), q.alias("question")), fields, acts).select("record_id", "answer")


# ---- streams -------------------------------------------------------------------------


@query(
    "k1_request_rate",
    f"""WITH e AS (SELECT event_id, user_id, epoch_us(ts) AS t, {_K} * 100 AS tok FROM events)
    SELECT event_id, count(*) OVER w AS requests, sum(tok) OVER w AS tokens FROM e WINDOW w AS (PARTITION BY user_id ORDER BY t RANGE BETWEEN 59999999 PRECEDING AND CURRENT ROW)""",
)
def k1(spark, sf_dir):
    e = read(spark, sf_dir, "events").select("event_id", "user_id", "ts", (F.get_json_object("props", "$.k").cast("long") * 100).alias("tokens"))
    return K.trailing_rate(e, "user_id").select("event_id", "requests", "tokens")


@query(
    "k1_sliding_windows",
    f"""SELECT w AS window_start, count(*) AS requests, sum(k) * 100 AS tokens FROM (SELECT {_K} AS k,
      unnest([time_bucket(INTERVAL 10 SECOND, ts) - INTERVAL 50 SECOND, time_bucket(INTERVAL 10 SECOND, ts) - INTERVAL 40 SECOND, time_bucket(INTERVAL 10 SECOND, ts) - INTERVAL 30 SECOND,
        time_bucket(INTERVAL 10 SECOND, ts) - INTERVAL 20 SECOND, time_bucket(INTERVAL 10 SECOND, ts) - INTERVAL 10 SECOND, time_bucket(INTERVAL 10 SECOND, ts)]) AS w FROM events) GROUP BY w""",
)
def k1_windows(spark, sf_dir):
    e = read(spark, sf_dir, "events").select("ts", (F.get_json_object("props", "$.k").cast("long") * 100).alias("tokens"))
    return K.request_rate(e).select("window_start", "requests", "tokens")


@query("k2_dedup_by_hash", "SELECT min(doc_id) AS doc_id FROM documents GROUP BY text")
def k2(spark, sf_dir):
    d = read(spark, sf_dir, "documents").select("doc_id", "text", F.to_timestamp(F.lit("2024-01-01")).alias("ts"))
    return K.dedup_by_hash(d).select("doc_id")


@query("k3_latest_state", f"SELECT record_id, arg_max(after, (created_at, event_id)) AS review_status, count(*) AS changes FROM ({AUDIT}) GROUP BY record_id")
def k3(spark, sf_dir):
    return K.latest_state(audit(spark, sf_dir)).drop("changed_at")


@query(
    "k4_job_progress",
    """WITH l AS (SELECT user_id, arg_max(event_type, (ts, event_id % 7)) AS et, arg_max(event_id % 7, (ts, event_id % 7)) AS at_stage FROM events GROUP BY user_id)
    SELECT user_id AS job_id, u.i AS position, CASE WHEN et = 'signup' OR u.i < at_stage THEN 'complete' WHEN u.i = at_stage AND et = 'error' THEN 'error' WHEN u.i = at_stage THEN 'active' ELSE 'pending' END AS stage_state
    FROM l, (SELECT unnest([0, 1, 2, 3, 4, 5, 6]) AS i) u""",
)
def k4(spark, sf_dir):
    e = read(spark, sf_dir, "events").select(
        F.col("user_id").alias("job_id"), F.when(F.col("event_type") == "signup", "success").when(F.col("event_type") == "error", "failure").otherwise("running").alias("state"),
        (F.col("event_id") % 7).cast("int").alias("stage_index"), "ts")
    return K.stage_view(K.latest_progress(e)).select("job_id", "position", "stage_state")
