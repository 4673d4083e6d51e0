"""Queries over directions and actions, with their reference SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from decretum.catalog.extraction import J_BASE, J_LINES, J_NUMBERED, J_OUTCOME, J_TASKS
from decretum.catalog.fixtures import BY_RECORD, COURT_BASE, JUDGMENT_PAGES, court_pages, judgment_pages, sql_table
from decretum.functions import patterns as P
from decretum.functions import text as T
from decretum.operators import actions as A
from decretum.operators import candidates as C
from decretum.operators import fields as X
from decretum.sources.tables import settle

QUERIES = {}
ORACLES = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


# expected actions of the judgment corpus, before and after owners are resolved
J_ACTIONS = f"""
WITH d AS (SELECT n.record_id, n.page, n.direction, n.direction_index, t.dept, t.kind, t.days, b.d, {J_OUTCOME} AS disposition
  FROM ({J_NUMBERED}) n JOIN ({J_BASE}) b ON n.record_id = b.record_id
  LEFT JOIN (SELECT record_id, task, min(dept) AS dept, min(kind) AS kind, min(days) AS days FROM ({J_TASKS}) GROUP BY record_id, task) t
    ON n.record_id = t.record_id AND n.direction = t.task)
SELECT record_id, concat('action-', direction_index) AS action_id, direction,
  CASE kind WHEN 0 THEN 'File a compliance report' WHEN 1 THEN 'Release the arrears due'
    WHEN 2 THEN 'Remove the encroachment on the road' ELSE direction END AS title,
  dept AS owner, CASE WHEN days IS NOT NULL THEN concat('within ', days, ' days') END AS timeline_text,
  CASE WHEN days IS NOT NULL THEN strftime(d + days * INTERVAL 1 DAY, '%Y-%m-%d') END AS due_date,
  CASE WHEN days IS NULL THEN 'missing' ELSE 'explicit' END AS timeline_type,
  CASE kind WHEN 0 THEN 'affidavit_report_filing' WHEN 1 THEN 'payment_release' ELSE 'appeal_consideration' END AS category,
  CASE WHEN kind IN (0, 1) AND days IS NULL THEN 'medium' ELSE 'high' END AS priority,
  CASE WHEN dept IS NOT NULL AND days IS NOT NULL THEN 0.8 ELSE 0.64 END AS confidence,
  concat_ws('|', CASE WHEN kind IN (0, 1) THEN NULL ELSE 'appeal_review_required' END,
    CASE WHEN dept IS NULL THEN 'owner_unclear' END, CASE WHEN days IS NULL THEN 'missing_timeline' END,
    'page_or_ocr_evidence') AS flags,
  CASE WHEN kind IN (0, 1) THEN NULL ELSE 'legal_reviewer' END AS escalation FROM d
"""


def j_parts(spark, sf_dir, *, more: tuple[str, ...] = (), evidence: bool = True):
    """Directions, record context and fields of the judgment corpus; ``more`` names further fields, court and parties.

    Without ``evidence`` it is null everywhere, for results that do not read it.
    """
    pages = judgment_pages(spark, sf_dir)
    names = ("case_number", "judgment_date", "page_disposition", "directions", *more)
    found = C.page_candidates(pages, names, evidence=evidence)
    cands = settle(found if evidence else found.withColumn("evidence", F.lit(None).cast(X.EVIDENCE_TYPE)))
    rows = (
        X.first_fields(cands, tuple(f for f in ("case_number", "court") if f in names))
        .unionByName(X.text_dates(cands))
        .unionByName(X.page_dispositions(cands))
    )
    rows = settle(rows.unionByName(X.party_fields(cands)) if "parties" in more else rows)
    return settle(X.direction_fields(cands)), A.record_context(rows), rows


def flat_actions(rows):
    return rows.select(
        "record_id", "action_id", "title", F.col("responsible_department").alias("owner"), "category", "priority",
        F.date_format("timeline.due_date", "yyyy-MM-dd").alias("due_date"),
        F.col("timeline.timeline_type").alias("timeline_type"), "confidence",
        F.array_join("ambiguity_flags", "|").alias("flags"), F.col("escalation_recommendation").alias("escalation"),
    )


_ACTION_COLS = "record_id, action_id, title, owner, category, priority, due_date, timeline_type, confidence, flags, escalation"


def open_actions(spark, sf_dir):
    directions, context, _ = j_parts(spark, sf_dir)
    rows = A.directions_to_actions(directions, context).where("responsible_department is not null")
    return rows.groupBy(F.col("responsible_department").alias("owner"), "category").agg(
        F.count("*").alias("open_actions"),
        F.date_format(F.min("timeline.due_date"), "yyyy-MM-dd").alias("earliest_due"),
    )


@query(
    "open_actions_by_owner",
    f"""SELECT owner, category, count(*) AS open_actions, min(due_date) AS earliest_due FROM ({J_ACTIONS})
    WHERE owner IS NOT NULL GROUP BY owner, category""",
)
def flagship(spark, sf_dir):
    return open_actions(spark, sf_dir)


@query("h1_directions_to_actions", f"SELECT {_ACTION_COLS} FROM ({J_ACTIONS})")
def h1(spark, sf_dir):
    directions, context, _ = j_parts(spark, sf_dir)
    return flat_actions(A.directions_to_actions(directions, context))


@query(
    "h2_classify_action",
    """SELECT item, text, CASE WHEN item % 5 = 0 THEN 'affidavit_report_filing' WHEN item % 5 = 1 THEN 'payment_release'
        WHEN item % 5 = 2 THEN 'reconsideration' WHEN item % 5 = 3 THEN 'information_update'
        WHEN st IN ('F', 'O') THEN 'appeal_consideration' ELSE 'legal_review' END AS category,
      CASE WHEN item % 5 < 4 THEN NULL ELSE 'legal_reviewer' END AS escalation FROM (
      SELECT o_orderkey AS item, o_orderstatus AS st, CASE o_orderkey % 5 WHEN 0 THEN 'file an affidavit' WHEN 1 THEN 'pay the benefits'
        WHEN 2 THEN 'pass a speaking order' WHEN 3 THEN 'correct the entry' ELSE 'do the needful' END AS text FROM orders)""",
)
def h2(spark, sf_dir):
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    texts = ["file an affidavit", "pay the benefits", "pass a speaking order", "correct the entry", "do the needful"]
    said = F.element_at(F.array(*[F.lit(t) for t in texts]), (F.col("o_orderkey") % 5 + 1).cast("int"))
    outcome = F.when(F.col("o_orderstatus") == "F", "allowed").when(F.col("o_orderstatus") == "O", "dismissed").otherwise("unknown")
    c = A.classify(said, outcome)
    return o.select(F.col("o_orderkey").alias("item"), said.alias("text"), c["category"].alias("category"), c["escalation"].alias("escalation"))


@query("h3_priority", f"SELECT record_id, action_id, priority FROM ({J_ACTIONS})")
def h3(spark, sf_dir):
    directions, context, _ = j_parts(spark, sf_dir)
    rows = A.directions_to_actions(directions, context)
    return rows.select("record_id", "action_id", A.priority_of(F.col("category"), F.col("ambiguity_flags"), F.col("timeline.due_date").isNotNull()).alias("priority"))


@query(
    "h4_disposition_only_actions",
    f"""SELECT record_id, concat('Review partly allowed outcome for Writ Petition No. ', record_id, ' of ', y) AS title,
      'appeal_consideration' AS category, 'high' AS priority, 0.62 AS confidence,
      'appeal_review_required|no_explicit_operational_direction' AS flags FROM ({J_BASE}) WHERE st NOT IN ('F', 'O')
      AND record_id NOT IN (SELECT record_id FROM ({J_NUMBERED}))""",
)
def h4(spark, sf_dir):
    cands = settle(C.page_candidates(judgment_pages(spark, sf_dir), ("case_number", "page_disposition", "directions")))
    rows = X.first_fields(cands, ("case_number",)).unionByName(X.page_dispositions(cands))
    out = A.disposition_only_actions(A.record_context(rows), X.direction_fields(cands))
    return out.select("record_id", "title", "category", "priority", "confidence", F.array_join("ambiguity_flags", "|").alias("flags"))


def _court_parts(spark, sf_dir):
    pages = court_pages(spark, sf_dir)
    cands = settle(C.page_candidates(pages, ("case_number", "court", "judgment_date", "file_name_date", "parties", "departments",
                                             "page_disposition", "final_disposition", "directions")))
    rows = settle(
        X.first_fields(cands)
        .unionByName(X.party_fields(cands))
        .unionByName(X.list_field(cands, "departments"))
        .unionByName(X.apply_file_name_dates(X.text_dates(cands), X.file_name_dates(cands)))
        .unionByName(X.choose_disposition(X.page_dispositions(cands), X.final_dispositions(cands, pages)))
    )
    return pages, rows, settle(X.direction_fields(cands))


_H5 = f"""
SELECT record_id, 'action-0' AS action_id, CASE v WHEN 0 THEN 'State' WHEN 1 THEN 'Registry' WHEN 3 THEN concat('High Court of ', place)
    WHEN 4 THEN 'Municipal Board' ELSE 'Collector' END AS owner,
  CASE v WHEN 1 THEN 'procedural_registry' WHEN 3 THEN 'remand_destination' ELSE 'source_text' END AS owner_source,
  CASE v WHEN 1 THEN 'not_specified' WHEN 3 THEN 'not_specified' ELSE 'explicit' END AS timeline_type,
  CASE v WHEN 1 THEN 'appeal_review_required|page_or_ocr_evidence|inferred_assignee_review|timeline_not_specified'
    WHEN 3 THEN 'page_or_ocr_evidence|timeline_not_specified|inferred_assignee_review'
    ELSE 'page_or_ocr_evidence|inferred_assignee_review' END AS flags,
  CASE v WHEN 0 THEN strftime(CAST(concat(year(d) + 1, '-09-28') AS DATE) + INTERVAL 10 DAY, '%Y-%m-%d')
    WHEN 4 THEN strftime(CAST(concat(year(d) + 1, '-09-28') AS DATE) + INTERVAL 42 DAY, '%Y-%m-%d')
    WHEN 5 THEN strftime(CAST(concat(year(d) + 1, '-09-28') AS DATE) + INTERVAL 60 DAY, '%Y-%m-%d') END AS due_date,
  true AS requires_review FROM ({COURT_BASE}) WHERE v <> 2
UNION ALL
SELECT record_id, 'action-1', CASE v WHEN 1 THEN 'Registry' END, CASE v WHEN 1 THEN 'source_text' END, 'missing',
  CASE v WHEN 1 THEN 'missing_timeline|page_or_ocr_evidence|inferred_assignee_review'
    ELSE 'appeal_review_required|owner_unclear|missing_timeline|page_or_ocr_evidence' END, NULL, v = 1
FROM ({COURT_BASE}) WHERE v IN (1, 4)
"""


@query("h5_resolve_owner", _H5)
def h5(spark, sf_dir):
    _, rows, directions = _court_parts(spark, sf_dir)
    out = A.action_plan(rows, directions)
    return out.select(
        "record_id", "action_id", F.col("responsible_department").alias("owner"), "owner_source",
        F.col("timeline.timeline_type").alias("timeline_type"), F.array_join("ambiguity_flags", "|").alias("flags"),
        F.date_format("timeline.due_date", "yyyy-MM-dd").alias("due_date"), F.col("requires_human_review").alias("requires_review"),
    )


@query(
    "h6_specify_high_court",
    f"""SELECT record_id, concat('High Court of ', place) AS named_courts
    FROM ({COURT_BASE}) WHERE v IN (1, 3, 4)""",
)
def h6(spark, sf_dir):
    # the fields that the step reads; no other one is made for it
    cands = settle(C.page_candidates(court_pages(spark, sf_dir), ("case_number", "court", "parties", "departments")))
    rows = X.first_fields(cands, ("case_number", "court")).unionByName(X.party_fields(cands)).unionByName(X.list_field(cands, "departments"))
    return A.record_high_courts(settle(rows)).select("record_id", F.array_join(F.array_sort("named_courts"), "|").alias("named_courts"))


# action lists written from the order lines: one kind of wording for each line
ACTION_LINES = f"""
SELECT a.*, b.st, CASE b.st WHEN 'F' THEN 'allowed' WHEN 'O' THEN 'dismissed' ELSE 'partly_allowed' END AS disposition,
  CASE k WHEN 0 THEN 'Release arrears' WHEN 1 THEN 'Note the clause' WHEN 2 THEN 'Change the status' WHEN 3 THEN 'Issue notification'
    WHEN 4 THEN 'Comply with order' ELSE 'Remand to Tribunal' END AS title,
  CASE k WHEN 0 THEN 'The Board shall release arrears' WHEN 1 THEN 'There is no order as to costs'
    WHEN 2 THEN 'The High Court petition was dismissed' WHEN 3 THEN 'Background notification on eligibility'
    WHEN 4 THEN 'The department must comply' ELSE 'remit to Tribunal' END AS legal_basis,
  CASE k WHEN 0 THEN 0.8 WHEN 1 THEN 0.75 WHEN 2 THEN 0.7 WHEN 5 THEN 0.82 ELSE 0.6 END AS confidence,
  CASE k WHEN 0 THEN 'Board' WHEN 5 THEN 'Tribunal' END AS responsible_department,
  CASE k WHEN 5 THEN 'remand_destination' END AS owner_source
FROM (SELECT l_orderkey AS record_id, l_partkey % 6 AS k, CAST(row_number() OVER (PARTITION BY l_orderkey
    ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate) - 1 AS INT) AS action_index FROM lineitem) a
JOIN (SELECT o_orderkey AS rid, o_orderstatus AS st FROM orders) b ON a.record_id = b.rid
"""


def line_actions(spark, sf_dir):
    rows = sql_table(spark, sf_dir, ACTION_LINES, BY_RECORD)
    outcomes = rows.select("record_id", "disposition").distinct()
    return A.with_action_defaults(rows), outcomes, rows


_GATE = f"""WITH a AS (SELECT *, k = 1 AS cost FROM ({ACTION_LINES}) WHERE NOT (k = 2 AND st <> 'O')),
  f AS (SELECT record_id AS rid, count(*) FILTER (NOT cost) AS subst, min(action_index) FILTER (cost) AS first_cost FROM a GROUP BY record_id)"""


@query(
    "h7_action_quality_gate",
    f"""{_GATE} SELECT record_id, action_index, CASE WHEN cost THEN 'Record no cost recovery required' ELSE title END AS title,
      CASE WHEN cost THEN 'no_operational_action' ELSE 'compliance' END AS category,
      CASE WHEN cost THEN least(confidence, 0.72) ELSE confidence END AS confidence
    FROM a JOIN f ON record_id = rid WHERE NOT cost OR (subst = 0 AND action_index = first_cost)""",
)
def h7(spark, sf_dir):
    rows, outcomes, _ = line_actions(spark, sf_dir)
    return A.quality_gate(rows, outcomes).select("record_id", "action_index", "title", "category", F.col("confidence").cast("double").alias("confidence"))


@query(
    "h7_quality_trace",
    f"""SELECT record_id, count(*) AS original, count(*) FILTER (k = 2 AND st <> 'O') AS stale_removed,
      CASE WHEN count(*) FILTER (k <> 1 AND NOT (k = 2 AND st <> 'O')) > 0 THEN count(*) FILTER (k = 1) ELSE 0 END AS cost_removed,
      CASE WHEN count(*) FILTER (k <> 1 AND NOT (k = 2 AND st <> 'O')) = 0 AND count(*) FILTER (k = 1) > 0 THEN 1 ELSE 0 END AS cost_rewritten,
      CASE WHEN count(*) FILTER (k <> 1 AND NOT (k = 2 AND st <> 'O')) > 0 THEN count(*) FILTER (k <> 1 AND NOT (k = 2 AND st <> 'O'))
        ELSE least(count(*) FILTER (k = 1), 1) END AS kept FROM ({ACTION_LINES}) GROUP BY record_id""",
)
def h7_trace(spark, sf_dir):
    rows, outcomes, _ = line_actions(spark, sf_dir)
    return A.quality_trace(rows, outcomes)


@query(
    "h8_ensure_remand_action",
    f"""SELECT record_id, 'action-1' AS action_id, 'Fresh consideration of remanded matter by High Court' AS title, 'High Court' AS owner,
      'not_specified' AS timeline_type, 'timeline_not_specified' AS flags FROM ({COURT_BASE}) WHERE v = 3""",
)
def h8(spark, sf_dir):
    # the fields of the context; no other one is made for it
    pages = court_pages(spark, sf_dir)
    cands = settle(C.page_candidates(pages, ("case_number", "judgment_date", "file_name_date", "page_disposition", "final_disposition", "directions")))
    rows = settle(
        X.first_fields(cands, ("case_number",))
        .unionByName(X.apply_file_name_dates(X.text_dates(cands), X.file_name_dates(cands)))
        .unionByName(X.choose_disposition(X.page_dispositions(cands), X.final_dispositions(cands, pages)))
    )
    plain = A.directions_to_actions(settle(X.direction_fields(cands)), A.record_context(rows))
    out = A.ensure_remand(plain, A.remand_sentences(pages)).where("owner_source = 'remand_destination'")
    return out.select(
        "record_id", "action_id", "title", F.col("responsible_department").alias("owner"),
        F.col("timeline.timeline_type").alias("timeline_type"), F.array_join("ambiguity_flags", "|").alias("flags"),
    )


@query(
    "h9_prune_background_actions",
    f"""WITH a AS (SELECT * FROM ({ACTION_LINES})), r AS (SELECT DISTINCT record_id AS rid FROM a WHERE k = 5)
    SELECT record_id, action_index, title FROM a LEFT JOIN r ON record_id = rid WHERE rid IS NULL OR k NOT IN (2, 3)""",
)
def h9(spark, sf_dir):
    rows, _, _ = line_actions(spark, sf_dir)
    return A.prune_background(rows).select("record_id", "action_index", "title")


@query(
    "h10_no_operational_action",
    f"""WITH a AS (SELECT * FROM ({ACTION_LINES}) WHERE k = 0)
    SELECT o_orderkey AS record_id, 'Record no operational government action' AS title, concat('Order ', o_orderkey, ' closed') AS legal_basis,
      CASE WHEN o_custkey % 2 = 0 THEN 0.7 ELSE 0.5 END AS confidence, 'no_operational_action' AS category
    FROM orders WHERE o_orderstatus = 'O' AND o_orderkey NOT IN (SELECT record_id FROM a)""",
)
def h10(spark, sf_dir):
    rows, _, plain = line_actions(spark, sf_dir)
    kept = A.with_action_defaults(plain.where("k = 0"))
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").where("o_orderstatus = 'O'")
    declared = o.select(
        F.col("o_orderkey").alias("record_id"), F.concat(F.lit("Order "), "o_orderkey", F.lit(" closed")).alias("context_summary"),
        F.lit(0.7).alias("confidence"), (F.col("o_custkey") % 2 == 0).alias("has_evidence"), F.lit("").alias("decision_reason"),
        F.lit("").alias("review_recommendation"), F.array().cast("array<string>").alias("ambiguity_flags"),
    )
    out = A.no_operational_actions(kept, declared).where("category = 'no_operational_action'")
    return out.select("record_id", "title", "legal_basis", "confidence", "category")


@query(
    "h11_package_risk_flags",
    f"""SELECT record_id, CASE v WHEN 0 THEN 'source_review_required|inferred_assignee_review'
      WHEN 1 THEN 'appeal_review_required|source_review_required|inferred_assignee_review|timeline_not_specified|missing_timeline'
      WHEN 2 THEN 'missing_case_number' WHEN 3 THEN 'source_review_required|timeline_not_specified|inferred_assignee_review'
      WHEN 4 THEN 'source_review_required|inferred_assignee_review|owner_unclear|missing_timeline|appeal_review_required'
      ELSE 'missing_case_number|missing_court|source_review_required|inferred_assignee_review' END AS risk_flags FROM ({COURT_BASE})""",
)
def h11(spark, sf_dir):
    pages, rows, directions = _court_parts(spark, sf_dir)
    out = A.package_flags(pages.select("record_id"), rows, settle(A.action_plan(rows, directions)))
    return out.select("record_id", F.array_join("risk_flags", "|").alias("risk_flags"))


@query(
    "h14_review_packages",
    f"""WITH a AS (SELECT record_id, confidence, owner FROM ({J_ACTIONS})
        UNION ALL SELECT b.record_id, 0.62, NULL FROM ({J_BASE}) b WHERE b.record_id NOT IN (SELECT record_id FROM ({J_NUMBERED}))),
      s AS (SELECT record_id, confidence FROM a UNION ALL SELECT record_id, unnest([0.92, 0.88, 0.9, 0.82]) FROM ({J_BASE}))
    SELECT record_id, (SELECT count(*) FROM a WHERE a.record_id = s.record_id) AS action_count,
      round_even(avg(confidence), 2) AS overall_confidence, '' AS risk_flags FROM s GROUP BY record_id""",
)
def h14(spark, sf_dir):
    from decretum.plans.review_package import build_review_packages

    out = build_review_packages(judgment_pages(spark, sf_dir), with_retrieval=False)["packages"]
    return out.select("record_id", "action_count", "overall_confidence", F.array_join("risk_flags", "|").alias("risk_flags"))


@query(
    "h15_rule_fallback",
    f"""SELECT record_id, action_index, title, st <> 'F' AS requires_review,
      CASE WHEN st = 'F' THEN '' ELSE 'llm_actions_missing' END AS flags FROM ({ACTION_LINES})""",
)
def h15(spark, sf_dir):
    rows, _, plain = line_actions(spark, sf_dir)
    model = A.with_action_defaults(plain.where("st = 'F'"))
    out = A.rule_fallback(model, rows, "llm_actions_missing")
    return out.select("record_id", "action_index", "title", F.col("requires_human_review").alias("requires_review"), F.array_join("ambiguity_flags", "|").alias("flags"))


# ---- scalar functions ----------------------------------------------------------------


@query(
    "d1_clean_line",
    r"""SELECT doc_id, md5(trim(regexp_replace(text, '\s+', ' ', 'g'), ' .')) AS clean_md5,
      length(trim(regexp_replace(text, '\s+', ' ', 'g'))) AS flat_length FROM documents""",
)
def d1(spark, sf_dir):
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return d.select("doc_id", F.md5(T.clean_line(F.col("text"))).alias("clean_md5"), F.length(T.collapse_ws(F.col("text"))).alias("flat_length"))


@query(
    "d2_person_names",
    """SELECT c_custkey AS id, concat('A.B. ', place, ' Rao') AS name, concat('ab', lower(replace(place, ' ', '')), 'rao') AS name_key FROM (
      SELECT c_custkey, array_to_string(list_transform(string_split(regexp_replace(n_name, '[^A-Za-z ]', '', 'g'), ' '), lambda w: concat(upper(substr(w, 1, 1)), lower(substr(w, 2)))), ' ') AS place FROM customer
      JOIN nation ON c_nationkey = n_nationkey)""",
)
def d2(spark, sf_dir):
    c = spark.read.parquet(f"{sf_dir}/customer.parquet").join(
        spark.read.parquet(f"{sf_dir}/nation.parquet"), F.col("c_nationkey") == F.col("n_nationkey")
    )
    said = F.concat(F.lit("HON'BLE MR. JUSTICE a.b. "), F.lower("n_name"), F.lit("  RAO (3)"))
    name = T.person_name(said)
    return c.select(F.col("c_custkey").alias("id"), name.alias("name"), T.person_name_key(F.concat(F.lit("Justice "), name)).alias("name_key"))


@query(
    "d4_parse_date_parts",
    "SELECT o_orderkey AS id, strftime(o_orderdate, '%Y-%m-%d') AS day, CASE WHEN day(o_orderdate) <= 29 THEN 'ok' ELSE 'bad' END AS in_february "
    "FROM orders",
)
def d4(spark, sf_dir):
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    day, year = F.day("o_orderdate").cast("string"), F.year("o_orderdate").cast("string")
    parsed = T.date_from_parts(day, F.date_format("o_orderdate", "MMMM"), year)
    feb = T.date_from_parts(day, F.lit("Feb"), F.lit("2024"))
    return o.select(F.col("o_orderkey").alias("id"), F.date_format(parsed, "yyyy-MM-dd").alias("day"),
                    F.when(feb.isNull(), "bad").otherwise("ok").alias("in_february"))


@query(
    "d5_normalise_date",
    "SELECT o_orderkey AS id, CASE WHEN o_orderkey % 5 = 4 THEN concat('on ', strftime(o_orderdate, '%Y')) ELSE strftime(o_orderdate, '%Y-%m-%d') END AS iso FROM orders",
)
def d5(spark, sf_dir):
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    k = F.col("o_orderkey") % 5
    said = (
        F.when(k == 0, F.date_format("o_orderdate", "yyyy-MM-dd")).when(k == 1, F.date_format("o_orderdate", "d MMMM yyyy"))
        .when(k == 2, F.date_format("o_orderdate", "dd-MM-yyyy")).when(k == 3, F.date_format("o_orderdate", "MMMM d, yyyy"))
        .otherwise(F.concat(F.lit(" On "), F.year("o_orderdate")))
    )
    return o.select(F.col("o_orderkey").alias("id"), T.normalise_date(said).alias("iso"))


@query("d6_normalise_text", r"SELECT doc_id, md5(replace(regexp_replace(lower(text), '^\s+|\s+$', '', 'g'), '  ', ' ')) AS text_md5 FROM documents")
def d6(spark, sf_dir):
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return d.select("doc_id", F.md5(T.normalise_text(F.col("text"))).alias("text_md5"))


@query(
    "d7_parse_timeline",
    f"""SELECT record_id, page, CASE WHEN days IS NOT NULL THEN concat('within ', days, ' days') END AS timeline_text, days AS timeline_days FROM ({J_LINES})
    UNION ALL SELECT record_id, page, NULL, NULL FROM ({JUDGMENT_PAGES}) WHERE page IN (1, 99)""",
)
def d7(spark, sf_dir):
    p = judgment_pages(spark, sf_dir)
    return p.select("record_id", "page", T.timeline_text(F.col("text")).alias("timeline_text"), T.timeline_days(F.col("text")).alias("timeline_days"))


_STOP = "[" + ", ".join(f"'{w}'" for w in P.STOP_WORDS) + "]"


@query(
    "d9_token_set",
    f"""SELECT doc_id, len(list_filter(list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+')), lambda t: NOT list_contains({_STOP}, t))) AS tokens FROM documents""",
)
def d9(spark, sf_dir):
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return d.select("doc_id", F.size(T.token_set(F.col("text"))).alias("tokens"))


@query("d17_content_hash", "SELECT doc_id, sha256(text) AS document_hash FROM documents")
def d17(spark, sf_dir):
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return d.select("doc_id", T.content_hash(F.col("text")).alias("document_hash"))


@query(
    "d16_public_entities",
    """SELECT n_nationkey, u.k, u.k IN (0, 2) AS public_entity, u.k = 3 AS advocate FROM nation, (SELECT unnest([0, 1, 2, 3]) AS k) u""",
)
def d16(spark, sf_dir):
    n = spark.read.parquet(f"{sf_dir}/nation.parquet")
    said = [F.concat(F.lit("State of "), "n_name"), F.col("n_name"), F.concat("n_name", F.lit("  Municipal Corporation")),
            F.concat(F.lit("Counsel for the court of "), "n_name")]
    rows = n.select("n_nationkey", F.posexplode(F.array(*said)).alias("k", "text"))
    return rows.select("n_nationkey", "k", T.looks_public(F.col("text")).alias("public_entity"), T.looks_like_advocate(F.col("text")).alias("advocate"))


@query(
    "d18_entity_cleaning",
    """SELECT n_nationkey, concat('High Court of ', place) AS high_court,
      concat(place, ' High Court') AS suffix_form, concat(n_name, ' Board') AS owner, 'File the report' AS action
    FROM (SELECT *, array_to_string(list_transform(string_split(n_name, ' '), lambda w: concat(upper(substr(w, 1, 1)), lower(substr(w, 2)))), ' ') AS place FROM nation)""",
)
def d18(spark, sf_dir):
    n = spark.read.parquet(f"{sf_dir}/nation.parquet")
    name = F.col("n_name")
    return n.select(
        "n_nationkey",
        T.high_court_name(F.concat(F.lit("the HIGH COURT of "), name, F.lit(" in appeal"))).alias("high_court"),
        T.high_court_name(F.concat(name, F.lit(" high court, dated today"))).alias("suffix_form"),
        T.clean_owner(F.concat(F.lit("that the  "), name, F.lit(" Board,"))).alias("owner"),
        T.clean_action(F.lit(" file the report within two weeks")).alias("action"),
    )


@query("d19_humanize_label", "SELECT DISTINCT event_type, concat(upper(substr(event_type, 1, 1)), substr(event_type, 2), ' Of Day') AS label FROM events")
def d19(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_type").distinct()
    return e.select("event_type", T.humanize_label(F.concat("event_type", F.lit("_of_day"))).alias("label"))
