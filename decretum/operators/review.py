"""Review decisions, approval gate, dashboard, queue and audit history."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from decretum.functions import patterns as P
from decretum.functions import text as T

EVENT_COLUMNS = [
    "record_id", "event_type", "target_type", "target_id", "before", "after", "reviewer_id", "role", "reason", "notes", "created_at",
]


def decision_status(decision: Column) -> Column:
    return F.coalesce(T.lookup(P.DECISION_STATUS, F.lower(T.strip_ws(decision))), F.lit("needs_clarification"))


# ---- approval gate -------------------------------------------------------------------


def validate_approval(records: DataFrame, fields: DataFrame, actions: DataFrame) -> DataFrame:
    """``ok`` and the first reason against approval, per record.

    ``fields`` holds value, evidence and manual_override.
    """

    def fact(name: str, test: Column) -> Column:
        return F.coalesce(F.bool_or((F.col("field") == name) & test), F.lit(False))

    filled = F.coalesce("value", F.lit("")) != ""
    backed = filled & ((F.size("evidence") > 0) | F.coalesce("manual_override", F.lit(False)))
    names = ("case_number", "court", "judgment_date", "parties")
    facts = fields.groupBy("record_id").agg(
        *[fact(n, filled).alias(f"has_{n}") for n in names],
        *[fact(n, backed).alias(f"backed_{n}") for n in names],
        fact("departments", filled).alias("has_departments"),
    )
    open_action = (F.col("category") != "no_immediate_action") & (F.size("evidence") == 0)
    if "manual_override" in actions.columns:
        open_action = open_action & ~F.coalesce("manual_override", F.lit(False))
    acts = actions.groupBy("record_id").agg(F.bool_or(open_action).alias("unbacked_action"))
    rows = records.select("record_id").distinct().join(facts, "record_id", "left").join(acts, "record_id", "left")

    def yes(name: str) -> Column:
        return F.coalesce(F.col(name), F.lit(False))

    parties_needed = ~yes("has_parties") & ~yes("has_departments")
    reasons = []
    for n in names:
        needed = parties_needed if n == "parties" else F.lit(True)
        reasons.append(F.when(needed & ~yes(f"has_{n}"), f"Cannot approve: required field '{n}' is missing."))
        reasons.append(F.when(needed & yes(f"has_{n}") & ~yes(f"backed_{n}"), f"Cannot approve: required field '{n}' has no source evidence."))
    reasons.append(F.when(yes("unbacked_action"), "Cannot approve: every action item needs source evidence or manual override."))
    reason = F.coalesce(*reasons)
    return rows.select("record_id", reason.isNull().alias("ok"), reason.alias("reason"))


# ---- decisions -----------------------------------------------------------------------


def latest_decisions(decisions: DataFrame) -> DataFrame:
    """Last decision of each record by time."""
    cols = [c for c in decisions.columns if c != "record_id"]
    best = decisions.groupBy("record_id").agg(F.max_by(F.struct(*cols), F.struct("decided_at", "reviewer_id")).alias("d"))
    return best.select("record_id", "d.*")


def apply_field_updates(fields: DataFrame, updates: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Edited fields and one audit row for each edit; unknown fields are ignored.

    ``updates`` holds record_id, field, new_value, new_status, reason,
    override, reviewer_id, role, notes and created_at.
    """
    base = fields
    for name, kind in (("status", "string"), ("manual_override", "boolean"), ("reason", "string")):
        if name not in base.columns:
            base = base.withColumn(name, F.lit(None).cast(kind))
    u = updates.withColumnsRenamed({c: f"u_{c}" for c in updates.columns if c not in ("record_id", "field")})
    both = base.join(u.withColumn("_edit", F.lit(True)), ["record_id", "field"], "left")
    edit = F.coalesce("_edit", F.lit(False))
    after = both.withColumns(
        {
            "_before": F.col("value"),
            "value": F.when(edit, F.coalesce("u_new_value", "value")).otherwise(F.col("value")),
            "status": F.when(edit, F.coalesce("u_new_status", "status", F.lit("edited"))).otherwise(F.col("status")),
            "reason": F.when(edit, F.coalesce("u_reason", "reason")).otherwise(F.col("reason")),
            "manual_override": F.when(edit, F.coalesce("u_override", "manual_override", F.lit(False))).otherwise(F.col("manual_override")),
            "notes": F.when(edit, F.concat("notes", F.array(F.concat(F.lit("Edited by "), "u_reviewer_id")))).otherwise(F.col("notes"))
            if "notes" in fields.columns else F.lit(None),
        }
    )
    audit = after.where(edit).select(
        "record_id", F.lit("field_update").alias("event_type"), F.lit("extraction_field").alias("target_type"),
        F.col("field").alias("target_id"), F.col("_before").alias("before"), F.col("value").alias("after"),
        F.col("u_reviewer_id").alias("reviewer_id"), F.col("u_role").alias("role"), "reason", F.col("u_notes").alias("notes"),
        F.col("u_created_at").alias("created_at"),
    )
    return after.select(*base.columns), audit


def apply_action_updates(actions: DataFrame, updates: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Actions with edited attributes and one audit row for each edit; unknown ids are ignored.

    Columns of ``updates`` named as action columns replace them where not null.
    """
    names = [c for c in updates.columns if c in actions.columns and c not in ("record_id", "action_id")]
    u = updates.withColumnsRenamed({c: f"u_{c}" for c in updates.columns if c not in ("record_id", "action_id")})
    both = actions.join(u.withColumn("_edit", F.lit(True)), ["record_id", "action_id"], "left")
    edit = F.coalesce("_edit", F.lit(False))
    before = F.to_json(F.struct(*[F.col(c) for c in names])) if names else F.lit(None)
    after = both.withColumn("_before", before).withColumns({c: F.coalesce(f"u_{c}", c) for c in names})
    opt = lambda c: F.col(f"u_{c}") if c in updates.columns else F.lit(None).cast("string")
    audit = after.where(edit).select(
        "record_id", F.lit("action_update").alias("event_type"), F.lit("action_item").alias("target_type"),
        F.col("action_id").alias("target_id"), F.col("_before").alias("before"),
        (F.to_json(F.struct(*[F.col(c) for c in names])) if names else F.lit(None)).alias("after"),
        opt("reviewer_id").alias("reviewer_id"), opt("role").alias("role"), opt("reason").alias("reason"),
        opt("notes").alias("notes"), opt("created_at").alias("created_at"),
    )
    return after.select(*actions.columns), audit


def apply_reviews(records: DataFrame, decisions: DataFrame, gate: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """New record states, audit rows, and decisions refused by the approval gate.

    ``gate`` is ``validate_approval`` over the fields and actions after edits.
    """
    last = latest_decisions(decisions).withColumn("new_status", decision_status(F.col("decision")))
    known = last.join(records.select("record_id", F.col("review_status").alias("old_status")), "record_id")
    judged = known.join(gate, "record_id", "left")
    publishing = F.col("new_status").isin(*P.PUBLISHED_STATUSES)
    refused = publishing & ~F.coalesce("ok", F.lit(False))
    rejects = judged.where(refused).select("record_id", "decision", "reviewer_id", "reason")
    accepted = judged.where(~refused)
    changes = accepted.select(
        "record_id", F.col("new_status").alias("c_status"), F.col("reviewer_id").alias("c_reviewer"), F.col("decided_at").alias("c_at")
    )
    states = (
        records.drop(*[c for c in ("reviewer_id", "reviewed_at") if c in records.columns])
        .join(changes, "record_id", "left")
        .withColumns(
            {
                "review_status": F.coalesce("c_status", "review_status"),
                "reviewer_id": F.col("c_reviewer"),
                "reviewed_at": F.col("c_at"),
                "updated_at": F.coalesce(F.col("c_at").cast(dict(records.dtypes)["updated_at"]), F.col("updated_at")),
            }
        )
        .drop("c_status", "c_reviewer", "c_at")
    )
    none = F.lit(None).cast("string")
    audit = accepted.select(
        "record_id", F.lit("review_decision").alias("event_type"), F.lit("record").alias("target_type"),
        F.col("record_id").cast("string").alias("target_id"), F.col("old_status").alias("before"), F.col("new_status").alias("after"),
        "reviewer_id", (F.col("reviewer_role") if "reviewer_role" in decisions.columns else none).alias("role"), none.alias("reason"),
        (F.col("notes") if "notes" in decisions.columns else none).alias("notes"), F.col("decided_at").alias("created_at"),
    )
    return states, audit, rejects


def apply_review_edits(
    records: DataFrame, fields: DataFrame, actions: DataFrame, decisions: DataFrame, field_updates: DataFrame, action_updates: DataFrame
) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame, DataFrame]:
    """Decisions with their edits: new states, fields, actions, audit rows, and refused decisions.

    Edits are applied first and the approval gate judges the edited record; the
    edits of a refused decision are neither kept nor audited.
    """
    new_fields, field_audit = apply_field_updates(fields, field_updates)
    new_actions, action_audit = apply_action_updates(actions, action_updates)
    states, audit, rejects = apply_reviews(records, decisions, validate_approval(records, new_fields, new_actions))
    refused = rejects.select("record_id").distinct()

    def kept(after: DataFrame, before: DataFrame) -> DataFrame:
        old = before.join(refused, "record_id", "left_semi")
        return after.join(refused, "record_id", "left_anti").unionByName(old, allowMissingColumns=True)

    def text(rows: DataFrame) -> DataFrame:
        return rows.withColumns({c: F.col(c).cast("string") for c in ("before", "after", "target_id", "reason", "role")})

    edits = text(field_audit).unionByName(text(action_audit)).join(refused, "record_id", "left_anti")
    return states, kept(new_fields, fields), kept(new_actions, actions), text(audit).unionByName(edits), rejects


def resolve_duplicates(records: DataFrame, resolutions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Records with their duplicate resolution attached, and the audit rows.

    ``resolutions`` holds record_id, resolution, duplicate_record_id,
    reviewer_id, notes and created_at.
    """
    body = F.struct("resolution", "duplicate_record_id", "reviewer_id", "notes", "created_at")
    last = resolutions.groupBy("record_id").agg(F.max_by(body, "created_at").alias("duplicate_resolution"))
    states = records.join(last, "record_id", "left")
    none = F.lit(None).cast("string")
    audit = resolutions.join(records.select("record_id"), "record_id", "left_semi").select(
        "record_id", F.lit("duplicate_resolution").alias("event_type"), F.lit("record").alias("target_type"),
        F.col("record_id").cast("string").alias("target_id"), none.alias("before"), F.col("resolution").alias("after"), "reviewer_id",
        none.alias("role"), none.alias("reason"), "notes", "created_at",
    )
    return states, audit


def audit_timeline(audit: DataFrame) -> DataFrame:
    """Events of each record by time, with their position.

    Sorting by record and time is a range sort over the cluster; it gathers no
    record in one task.
    """
    return audit.orderBy("record_id", "created_at", "event_id")


def record_timeline(audit: DataFrame) -> DataFrame:
    """Per record: number of events and edits, first and last event."""
    order = F.struct("created_at", "event_id")
    return audit.groupBy("record_id").agg(
        F.count("*").alias("events"),
        F.count_if(F.col("event_type").isin("field_update", "action_update")).alias("review_edit_count"),
        F.min_by("event_type", order).alias("first_event"),
        F.max_by("event_type", order).alias("last_event"),
        F.max("created_at").alias("last_at"),
    )


# ---- dashboard -----------------------------------------------------------------------


def clean_register_owner(owner: Column, *context: Column) -> Column:
    """Owner of a register row; subjects such as costs or appeals give way to an authority in the text."""
    said = T.strip_chars(F.coalesce(owner, F.lit("")), " .,:;-")
    text = F.concat_ws(" ", *[F.coalesce(c, F.lit("")) for c in context])
    found = F.regexp_replace(T.strip_chars(T.extract(text, P.DASHBOARD_AUTHORITY, 1), " .,:;-"), T.WHITESPACE, " ")
    named = F.when(T.matches(found, r"^Spl\.?\s*LAO$"), "Special Land Acquisition Officer").otherwise(found)
    return (
        F.when((said != "") & ~T.matches(said, P.DASHBOARD_SUBJECT_OWNER), said)
        .when(found != "", named)
        .otherwise("Case reviewer")
    )


def dashboard_rows(records: DataFrame, actions: DataFrame) -> DataFrame:
    """Register rows of published records: reviewed actions only, where there are any."""
    public = records.where(F.col("review_status").isin(*P.PUBLISHED_STATUSES)).select("record_id", "review_status")
    reviewed = F.col("status").isin("approved", "edited")
    flags = actions.groupBy("record_id").agg(F.bool_or(reviewed).alias("_any"))
    rows = actions.join(public, "record_id").join(flags, "record_id")
    rows = rows.where(F.when(F.col("_any"), reviewed).otherwise(F.lit(True)))
    rows = rows.where(F.coalesce("category", F.lit("")) != "internal_review")
    first = F.get("evidence", F.lit(0))
    return rows.select(
        "record_id",
        "action_index",
        "title",
        F.col("responsible_department").alias("owner"),
        F.col("responsible_department").alias("department"),
        "category",
        "priority",
        F.col("timeline.due_date").alias("deadline"),
        F.col("timeline.raw_text").alias("timeline"),
        F.col("timeline.timeline_type").alias("timeline_type"),
        F.col("review_status").alias("status"),
        F.size("evidence").alias("evidence_count"),
        first["page"].alias("evidence_page"),
        F.col("escalation_recommendation").alias("escalation"),
    )


def ordered_values(rows: DataFrame, column: str, order: str = "action_index") -> DataFrame:
    """Distinct non-empty values of a column per record in first-seen order."""
    first = rows.where(F.coalesce(F.col(column).cast("string"), F.lit("")) != "").groupBy("record_id", column).agg(F.min(order).alias("o"))
    return first.groupBy("record_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("o", column))), lambda s: s[column]).alias(f"{column}_list")
    )


def dashboard_projection(records: DataFrame, actions: DataFrame) -> DataFrame:
    """One summary row per published record.

    Lists hold distinct values; ``pending_actions`` holds every title in order. The register itself stays a long table
    (``dashboard_rows``), so no record is gathered into one value.
    """
    rows = dashboard_rows(records, actions)
    rank = F.coalesce(T.lookup(P.PRIORITY_RANK, F.col("priority")), F.lit(0))
    sums = rows.groupBy("record_id").agg(
        F.count("*").alias("action_count"),
        F.max(F.struct(rank.alias("r"), F.when(rank > 0, F.col("priority")).otherwise(F.lit("low")).alias("p"))).alias("top"),
    )
    titles = F.transform(F.array_sort(F.collect_list(F.struct("action_index", "title"))), lambda t: t["title"])
    pending = rows.groupBy("record_id").agg(titles.alias("pending_actions"))
    out = records.where(F.col("review_status").isin(*P.PUBLISHED_STATUSES)).join(sums, "record_id", "left").join(pending, "record_id", "left")
    out = out.withColumn("pending_actions", F.coalesce("pending_actions", F.array().cast("array<string>")))
    for column in ("department", "category", "deadline", "escalation"):
        out = out.join(ordered_values(rows, column), "record_id", "left")
    return out.withColumns(
        {"action_count": F.coalesce("action_count", F.lit(0)), "highest_priority": F.coalesce("top.p", F.lit("low"))}
    ).drop("top").withColumnsRenamed(
        {"department_list": "departments", "category_list": "action_categories", "deadline_list": "due_dates", "escalation_list": "escalations"}
    )


def with_register(dashboard: DataFrame, register: DataFrame) -> DataFrame:
    """Dashboard rows with their register as one array, for exports of records of ordinary size."""
    body = [c for c in register.columns if c not in ("record_id", "action_index")]
    arrays = register.groupBy("record_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("action_index", *body))), lambda r: F.struct(*[r[c].alias(c) for c in body])).alias("action_register")
    )
    return dashboard.join(arrays, "record_id", "left")


def list_dashboard(dashboard: DataFrame, register: DataFrame, metrics: DataFrame) -> DataFrame:
    """Dashboard rows with cleaned owners, their departments, and fresh metrics; newest first."""
    cleaned = register.withColumn("owner", clean_register_owner(F.coalesce("owner", "department"), F.col("title"), F.col("timeline")))
    names = ordered_values(cleaned, "owner").withColumnRenamed("owner_list", "owners")
    out = dashboard.join(names, "record_id", "left").join(metrics, "record_id", "left")
    return out.withColumn("departments", F.coalesce("owners", "departments")).drop("owners").orderBy(F.desc("updated_at"), "record_id")


def filter_dashboard(
    dashboard: DataFrame,
    *,
    department: str | None = None,
    action_type: str | None = None,
    review_status: str | None = None,
    deadline_from: str | None = None,
    deadline_to: str | None = None,
    case_query: str | None = None,
    priority: str | None = None,
) -> DataFrame:
    """Dashboard rows that meet all given conditions; the register is narrowed to matching rows.

    ``dashboard`` holds an action_register array of structs with title, owner,
    department and category. Rows without due dates pass the deadline tests.
    """
    none = F.array().cast("array<string>")
    reg = F.col("action_register")
    out = dashboard

    def owner_of(r: Column) -> Column:
        return F.lower(F.concat_ws(" ", F.coalesce(r["owner"], F.lit("")), F.coalesce(r["department"], F.lit(""))))

    if department:
        said = F.lower(
            F.concat_ws(" ", F.array_join(F.coalesce("departments", none), " "),
                        F.array_join(F.transform(reg, lambda r: F.coalesce(T.null_if_blank(r["owner"]), r["department"], F.lit(""))), " "))
        )
        out = out.where(said.contains(department.lower()))
    if action_type:
        out = out.where(F.array_contains(F.coalesce("action_categories", none), action_type))
    if review_status:
        out = out.where(F.col("review_status") == review_status)
    if priority:
        out = out.where(F.col("highest_priority") == priority)
    if case_query:
        said = F.lower(
            F.concat_ws(" ", F.coalesce("case_number", F.lit("")), F.coalesce("court", F.lit("")), F.col("record_id").cast("string"),
                        F.array_join(F.transform(reg, lambda r: F.coalesce(r["title"], F.lit(""))), " "))
        )
        out = out.where(said.contains(case_query.lower()))
    dates = F.transform(F.coalesce(F.col("due_dates").cast("array<string>"), none), lambda d: d)
    if deadline_from:
        out = out.where(F.coalesce(F.array_min(dates) >= deadline_from, F.lit(True)))
    if deadline_to:
        out = out.where(F.coalesce(F.array_max(dates) <= deadline_to, F.lit(True)))
    if department or action_type:

        def fits(r: Column) -> Column:
            ok = F.lit(True)
            if action_type:
                ok = ok & (r["category"] == action_type)
            if department:
                ok = ok & owner_of(r).contains(department.lower())
            return ok

        out = out.withColumn("_rows", F.filter(reg, fits))
        some = F.size("_rows") > 0
        owners = F.array_distinct(
            F.filter(F.transform("_rows", lambda r: F.coalesce(T.null_if_blank(r["owner"]), r["department"])), lambda o: o.isNotNull() & (o != ""))
        )
        out = out.withColumns(
            {
                "departments": F.when(some & (F.size(owners) > 0), owners).otherwise(F.col("departments")),
                "action_register": F.when(some, F.col("_rows")).otherwise(reg),
            }
        ).drop("_rows")
    return out


def list_records(
    queue: DataFrame,
    *,
    status: str | None = None,
    department: str | None = None,
    role: str | None = None,
    case_query: str | None = None,
    limit: int | None = None,
) -> DataFrame:
    """Review queue: filtered, newest first; the first ``limit`` rows where one is given."""
    out = queue
    if status:
        out = out.where(F.col("review_status") == status)
    if department:
        out = out.where(F.lower(F.array_join("departments", " ")).contains(department.lower()))
    if role and role != "all":
        hit = F.lower(F.array_join("escalations", " ")).contains(role)
        if role == "data_reviewer":
            hit = hit | (F.col("review_status") == "pending_review")
        out = out.where(hit)
    if case_query:
        said = F.lower(F.concat_ws(" ", F.coalesce("case_number", F.lit("")), F.coalesce("court", F.lit("")), F.col("record_id").cast("string")))
        out = out.where(said.contains(case_query.lower()))
    ordered = out.orderBy(F.desc_nulls_last("updated_at"), "record_id")
    return ordered if limit is None else ordered.limit(max(1, limit))


def register_from_arrays(dashboard: DataFrame) -> DataFrame:
    """Register rows rebuilt from parallel lists; a missing entry takes the first one."""

    def at(column: str, i: Column) -> Column:
        items = F.coalesce(F.col(column).cast("array<string>"), F.array().cast("array<string>"))
        return F.coalesce(T.null_if_blank(F.get(items, i)), F.get(items, F.lit(0)), F.lit(""))

    titles = F.when(F.size(F.coalesce("pending_actions", F.array().cast("array<string>"))) > 0, F.col("pending_actions")).otherwise(
        F.array(F.lit("No published action"))
    )
    rows = dashboard.select("*", F.posexplode(titles).alias("position", "title"))
    i = F.col("position")
    return rows.select(
        "record_id", "position", "title", at("departments", i).alias("owner"), at("action_categories", i).alias("category"),
        at("due_dates", i).alias("deadline"),
        F.when(at("due_dates", i) != "", "specified").otherwise("missing").alias("timeline_type"),
        F.coalesce("review_status", F.lit("approved")).alias("status"),
    )
