"""Action items: rules that turn operative sentences into tasks with owner and deadline."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from decretum.functions import patterns as P
from decretum.functions import text as T
from decretum.operators.fields import EVIDENCE_TYPE, with_ordinals
from decretum.sources.tables import settle, spread

TIMELINE_TYPE = "struct<raw_text:string,due_date:date,confidence:double,timeline_type:string>"
ACTION_COLUMNS = [
    "record_id", "action_id", "action_index", "title", "responsible_department", "timeline", "category", "priority",
    "legal_basis", "confidence", "evidence", "notes", "direction_summary", "owner_source", "ambiguity_flags",
    "escalation_recommendation", "decision_reason", "review_recommendation", "requires_human_review", "status",
]


def timeline(raw: Column, due: Column, confidence: Column, kind: Column) -> Column:
    return F.struct(
        raw.cast("string").alias("raw_text"),
        due.cast("date").alias("due_date"),
        confidence.cast("double").alias("confidence"),
        kind.alias("timeline_type"),
    )


def no_timeline(kind: str) -> Column:
    return timeline(F.lit(None), F.lit(None), F.lit(0.0), F.lit(kind))


def parse_timeline(text: Column, judgment_date: Column) -> Column:
    """Explicit deadline phrase with its due date, or a missing one."""
    return dated_timeline(T.timeline_text(text), T.timeline_days(text), judgment_date)


def dated_timeline(phrase: Column, days: Column, judgment_date: Column) -> Column:
    due = F.when(days.isNotNull() & judgment_date.isNotNull(), F.date_add(judgment_date, days))
    return F.when(phrase.isNotNull(), timeline(T.strip_chars(phrase, " ."), due, F.lit(0.82), F.lit("explicit"))).otherwise(no_timeline("missing"))


def class_marks(text: Column) -> Column:
    """What the category takes from the text alone: the first rule that hits, and whether an appeal is named."""
    low = F.lower(text)
    rule = F.coalesce(*[F.when(T.matches(low, pattern), name) for name, pattern in P.ACTION_RULES])
    return F.struct(rule.alias("rule"), T.matches(low, P.APPEAL_RULE).alias("appeal"))


def classify(text: Column, disposition: Column) -> Column:
    """Category, flags and escalation of an action text."""
    return T.let(class_marks(text), lambda marks: class_of(marks, disposition))


def class_of(marks: Column, disposition: Column) -> Column:
    """Category, flags and escalation by the marks of a text and the outcome of its record."""

    def result(category: str, flag: str | None = None, role: str | None = None) -> Column:
        flags = F.array(F.lit(flag)) if flag else F.array().cast("array<string>")
        return F.struct(
            F.lit(category).alias("category"), flags.alias("flags"), F.lit(role).cast("string").alias("escalation")
        )

    chain = None
    for name, _ in P.ACTION_RULES:
        hit = marks["rule"] == name
        chain = F.when(hit, result(name)) if chain is None else chain.when(hit, result(name))
    appeal = marks["appeal"] | F.coalesce(disposition.isin("dismissed", "allowed", "partly_allowed"), F.lit(False))
    unknown = disposition.isNull() | (disposition == "unknown")
    return (
        chain.when(appeal, result("appeal_consideration", "appeal_review_required", "legal_reviewer"))
        .when(unknown, result("legal_review", "legal_outcome_unclear", "legal_reviewer"))
        .otherwise(result("compliance"))
    )


def priority_of(category: Column, flags: Column, has_due_date: Column) -> Column:
    urgent = (
        F.array_contains(flags, "appeal_review_required")
        | has_due_date
        | category.isin("legal_review", "appeal_consideration")
    )
    return F.when(urgent, "high").otherwise("medium")


def owner_and_action(text: Column) -> Column:
    """Owner and task by the first sentence pattern that fits."""
    chain = None
    for pattern in P.OWNER_AND_ACTION:
        fits = T.matches(text, pattern)
        parts = F.struct(
            T.clean_owner(T.extract(text, pattern, 1)).alias("owner"),
            T.clean_action(T.extract(text, pattern, 2)).alias("action"),
        )
        chain = F.when(fits, parts) if chain is None else chain.when(fits, parts)
    return chain.otherwise(F.struct(F.lit(None).cast("string").alias("owner"), text.alias("action")))


def record_context(fields: DataFrame) -> DataFrame:
    """Per record: what the action rules need to know about the case."""

    def value_of(name: str, column: str) -> Column:
        return F.max(F.when(F.col("field") == name, F.col(column)))

    return fields.groupBy("record_id").agg(
        value_of("case_number", "value").alias("case_number"),
        value_of("judgment_date", "date_value").alias("judgment_date"),
        F.coalesce(value_of("disposition", "value"), F.lit("unknown")).alias("disposition"),
        value_of("disposition", "raw_value").alias("disposition_raw"),
        F.max_by("evidence", F.when(F.col("field") == "disposition", 1)).alias("disposition_evidence"),
        F.max_by("confidence", F.when(F.col("field") == "disposition", 1)).alias("disposition_confidence"),
    )


def direction_parts(directions: DataFrame) -> DataFrame:
    """Owner, task, deadline phrase and class marks of each distinct direction text.

    Operative sentences repeat, and their patterns cost more than all else here: each text is read once. A table
    of few texts is small enough for every task; one of many meets the directions in a shuffle.
    """
    texts = spread(directions.select("value").where("value IS NOT NULL").distinct(), "value")
    text = F.col("value")
    return settle(
        texts.select(
            "value", owner_and_action(text).alias("_who"), class_marks(text).alias("_marks"),
            F.struct(T.timeline_text(text).alias("phrase"), T.timeline_days(text).alias("days")).alias("_said"),
        )
    )


def directions_to_actions(directions: DataFrame, context: DataFrame) -> DataFrame:
    """One action per direction. The directions are read twice, so costly ones should be settled first."""
    rows = directions.select("record_id", "direction_index", "value", "evidence").join(direction_parts(directions), "value", "left")
    rows = rows.join(context, "record_id", "left").withColumn("disposition", F.coalesce("disposition", F.lit("unknown")))
    rows = rows.withColumns(
        {
            "_time": dated_timeline(F.col("_said.phrase"), F.col("_said.days"), F.col("judgment_date")),
            "_class": class_of(F.col("_marks"), F.col("disposition")),
        }
    )
    owner, kind = F.col("_who.owner"), F.col("_time.timeline_type")
    on_page = F.exists(
        "evidence", lambda e: (e["source_quality"] != "text") | e["bbox"].isNull()
    )
    flags = F.concat(
        F.col("_class.flags"),
        F.array_compact(
            F.array(
                F.when(owner.isNull(), "owner_unclear"),
                F.when(kind == "missing", "missing_timeline"),
                F.when(on_page, "page_or_ocr_evidence"),
            )
        ),
    )
    has_time = F.col("_time.raw_text").isNotNull()
    return rows.select(
        "record_id",
        F.concat(F.lit("action-"), F.col("direction_index")).alias("action_id"),
        F.col("direction_index").alias("action_index"),
        F.col("_who.action").alias("title"),
        owner.alias("responsible_department"),
        F.col("_time").alias("timeline"),
        F.col("_class.category").alias("category"),
        priority_of(F.col("_class.category"), F.col("_class.flags"), F.col("_time.due_date").isNotNull()).alias("priority"),
        F.col("value").alias("legal_basis"),
        F.when(owner.isNotNull() & has_time, 0.8).otherwise(0.64).alias("confidence"),
        F.col("evidence").cast(f"array<{EVIDENCE_TYPE}>").alias("evidence"),
        F.when(has_time, F.array().cast("array<string>")).otherwise(F.array(F.lit("No explicit timeline found."))).alias("notes"),
        F.col("value").alias("direction_summary"),
        F.when(owner.isNotNull(), "source_text").alias("owner_source"),
        flags.alias("ambiguity_flags"),
        F.coalesce(F.col("_class.escalation"), F.when(owner.isNull(), "department_officer")).alias("escalation_recommendation"),
        F.lit(None).cast("string").alias("decision_reason"),
        F.lit(None).cast("string").alias("review_recommendation"),
        F.lit(False).alias("requires_human_review"),
        F.lit("pending_review").alias("status"),
    )


def disposition_only_actions(context: DataFrame, directions: DataFrame) -> DataFrame:
    """One review action for records whose only finding is an outcome that may be appealed."""
    rows = context.where("disposition <> 'unknown'").join(directions.select("record_id"), "record_id", "left_anti")
    said = F.coalesce("disposition_raw", "disposition")
    rows = rows.withColumn("_class", classify(said, F.col("disposition"))).where("_class.category = 'appeal_consideration'")
    outcome = F.replace("disposition", F.lit("_"), F.lit(" "))
    title = F.when(
        F.coalesce("case_number", F.lit("")) != "",
        F.concat(F.lit("Review "), outcome, F.lit(" outcome for "), F.col("case_number")),
    ).otherwise(F.concat(F.lit("Review "), outcome, F.lit(" judgment outcome")))
    return rows.select(
        "record_id",
        F.lit("action-0").alias("action_id"),
        F.lit(0).alias("action_index"),
        title.alias("title"),
        F.lit(None).cast("string").alias("responsible_department"),
        no_timeline("missing").alias("timeline"),
        F.col("_class.category").alias("category"),
        F.lit("high").alias("priority"),
        said.alias("legal_basis"),
        F.lit(0.62).alias("confidence"),
        F.col("disposition_evidence").cast(f"array<{EVIDENCE_TYPE}>").alias("evidence"),
        F.array(F.lit("No explicit operational direction found; legal review suggested from disposition.")).alias("notes"),
        said.alias("direction_summary"),
        F.lit(None).cast("string").alias("owner_source"),
        F.concat(F.col("_class.flags"), F.array(F.lit("no_explicit_operational_direction"))).alias("ambiguity_flags"),
        F.coalesce(F.col("_class.escalation"), F.lit("legal_reviewer")).alias("escalation_recommendation"),
        F.lit(None).cast("string").alias("decision_reason"),
        F.lit(None).cast("string").alias("review_recommendation"),
        F.lit(False).alias("requires_human_review"),
        F.lit("pending_review").alias("status"),
    )


# ---- owners --------------------------------------------------------------------------


def action_text(*extra: Column, with_evidence: bool = False) -> Column:
    parts = [F.coalesce(F.col(c), F.lit("")) for c in ("title", "legal_basis", "direction_summary")]
    parts += [F.coalesce(e, F.lit("")) for e in extra]
    if with_evidence:
        parts.append(F.array_join(F.transform("evidence", lambda e: e["snippet"]), " "))
    return F.concat_ws(" ", *parts)


def named_high_courts(text: Column) -> Column:
    """High Courts named in a text, each once."""
    names = F.transform(T.extract_all(text, P.NAMED_HIGH_COURT), T.high_court_name)
    return F.array_distinct(F.filter(names, lambda n: n != ""))


def record_high_courts(fields: DataFrame) -> DataFrame:
    """All High Courts named in the case fields, each once; a name is read once, however many records have it."""
    rows = fields.where(F.col("field").isin("departments", "court", "case_number", "respondents"))
    said = F.concat(
        F.coalesce("items", F.array().cast("array<string>")),
        F.array("value", "raw_value"),
        F.transform("evidence", lambda e: e["snippet"]),
    )
    texts = rows.select("record_id", F.explode(F.array_distinct(F.array_compact(said))).alias("text")).where(T.matches(F.col("text"), P.HIGH_COURT_OF))
    found = texts.select("record_id", F.explode(T.extract_all(F.col("text"), P.NAMED_HIGH_COURT)).alias("said")).distinct()
    read = found.select("said").distinct().withColumn("court", T.high_court_name(F.col("said"))).where("court <> ''")
    names = found.join(read, "said")
    distinct = names.groupBy("record_id", F.lower("court").alias("key")).agg(F.min("court").alias("court"))
    return distinct.groupBy("record_id").agg(F.array_sort(F.collect_list("court")).alias("named_courts"))


def _without(flags: Column, unwanted: list[str]) -> Column:
    return F.filter(flags, lambda f: ~F.lower(F.trim(f)).isin(*unwanted))


def _with(flags: Column, flag: str) -> Column:
    return F.when(F.array_contains(flags, flag), flags).otherwise(F.concat(flags, F.array(F.lit(flag))))


def resolve_owners(actions: DataFrame, high_courts: DataFrame | None = None) -> DataFrame:
    """Owner of every action by policy: internal, registry, named public body, remand destination."""
    said = action_text()
    owner = F.col("responsible_department")
    remand = T.clean_entity(T.extract(action_text(with_evidence=True), P.REMAND_DESTINATION, 1))
    rows = actions if high_courts is None else actions.join(high_courts, "record_id", "left")
    if high_courts is None:
        rows = rows.withColumn("named_courts", F.array().cast("array<string>"))
    known = F.array_distinct(
        F.concat(
            named_high_courts(action_text(with_evidence=True)),
            F.coalesce("named_courts", F.array().cast("array<string>")),
        )
    )
    rows = rows.withColumns(
        {
            "_internal": T.matches(said, P.INTERNAL_RECORD_UPDATE),
            "_registry": T.matches(said, P.REGISTRY_TASK),
            "_staff": F.coalesce(T.matches(owner, P.COURT_STAFF), F.lit(False)),
            "_public": F.coalesce(T.matches(owner, P.PUBLIC_OWNER), F.lit(False)),
            "_has_owner": F.coalesce(owner, F.lit("")) != "",
            "_remand": remand,
            "_known": F.when(F.lower(remand) == "high court", known),
        }
    )
    keep = F.col("_has_owner") & ~F.col("_staff")
    one_court = F.size(F.array_distinct(F.transform("_known", F.lower))) == 1
    destination = F.when(F.coalesce(one_court, F.lit(False)), F.get("_known", F.lit(0))).otherwise(F.col("_remand"))
    internal, registry = F.col("_internal"), F.col("_registry") & ~F.col("_internal")
    kept = keep & ~internal & ~registry
    sent = ~internal & ~registry & ~kept & (F.col("_remand") != "")
    dropped = ~internal & ~registry & ~kept & ~sent

    flags = F.col("ambiguity_flags")
    clear = _without(flags, P.OWNER_UNCLEAR_FLAGS)
    untimed = _with(_without(clear, P.TIMELINE_MISSING_FLAGS), "timeline_not_specified")
    no_time = F.col("timeline.timeline_type") == "missing"
    registry_flags = _with(_without(_with(clear, "inferred_assignee_review"), P.TIMELINE_MISSING_FLAGS), "timeline_not_specified")
    new_flags = (
        F.when(internal, F.array().cast("array<string>"))
        .when(registry, registry_flags)
        .when(kept & F.col("_public"), _with(clear, "inferred_assignee_review"))
        .when(sent, _with(untimed, "inferred_assignee_review"))
        .otherwise(flags)
    )
    new_time = (
        F.when(internal, no_timeline("not_configured"))
        .when(registry, no_timeline("not_specified"))
        .when(sent & no_time, F.col("timeline").withField("timeline_type", F.lit("not_specified")))
        .otherwise(F.col("timeline"))
    )
    out = {
        "responsible_department": F.when(internal, "Case reviewer").when(registry, "Registry").when(kept, owner)
        .when(sent, destination),
        "owner_source": F.when(internal, "system_policy").when(registry, "procedural_registry")
        .when(kept, F.col("owner_source")).when(sent, "remand_destination")
        .when(dropped & ~F.col("_has_owner"), F.col("owner_source")),
        "category": F.when(internal, "internal_review").otherwise(F.col("category")),
        "timeline": new_time,
        "ambiguity_flags": new_flags,
        "escalation_recommendation": F.when(internal, F.coalesce("escalation_recommendation", F.lit("case_reviewer")))
        .otherwise(F.col("escalation_recommendation")),
        "requires_human_review": F.col("requires_human_review") | internal | registry | sent | (kept & F.col("_public")),
    }
    return rows.withColumns(out).select(*actions.columns)


def with_action_defaults(rows: DataFrame) -> DataFrame:
    """Complete a partial action table; absent attributes get their defaults."""
    none = F.lit(None).cast("string")
    defaults = {
        "action_id": F.concat(F.lit("action-"), F.col("action_index")) if "action_index" in rows.columns else none,
        "responsible_department": none,
        "timeline": no_timeline("missing"),
        "category": F.lit("compliance"),
        "priority": F.lit("medium"),
        "legal_basis": none,
        "confidence": F.lit(0.75),
        "evidence": F.array().cast(f"array<{EVIDENCE_TYPE}>"),
        "notes": F.array().cast("array<string>"),
        "direction_summary": none,
        "owner_source": none,
        "ambiguity_flags": F.array().cast("array<string>"),
        "escalation_recommendation": none,
        "decision_reason": none,
        "review_recommendation": none,
        "requires_human_review": F.lit(False),
        "status": F.lit("pending_review"),
    }
    return rows.withColumns({c: v for c, v in defaults.items() if c not in rows.columns}).select(*ACTION_COLUMNS)


def action_plan(fields: DataFrame, directions: DataFrame) -> DataFrame:
    """Actions of all records: from directions, else from the outcome alone."""
    context = record_context(fields)
    rows = directions_to_actions(directions, context).unionByName(disposition_only_actions(context, directions))
    return resolve_owners(rows, record_high_courts(fields))


# ---- quality of an action list -------------------------------------------------------


def is_stale_dismissal(disposition: Column) -> Column:
    """Action that repeats a lower court's dismissal although the final outcome differs."""
    final = F.lower(T.strip_ws(F.coalesce(disposition, F.lit(""))))
    said = F.lower(action_text(F.col("decision_reason"), with_evidence=True))
    return ~final.isin("", "unknown", "dismissed") & T.matches(said, P.STALE_DISMISSAL) & T.matches(said, P.STALE_CONTEXT)


def is_cost_only() -> Column:
    basis = F.lower(action_text(F.col("decision_reason")))
    said = F.lower(action_text(F.col("decision_reason"), with_evidence=True))
    plain = F.replace(said, F.lit("notify parties of cost order"), F.lit(""))
    declared = (F.col("category") == "no_operational_action") & T.matches(basis, r"\bcosts?\b")
    return T.matches(said, P.COST_CLAUSE) & (declared | ~T.matches(plain, P.SUBSTANTIVE_WORD))


def quality_gate(actions: DataFrame, dispositions: DataFrame) -> DataFrame:
    """Drop stale dismissals; drop cost-only items beside others, or rewrite the first one."""
    rows = actions.join(dispositions.select("record_id", "disposition"), "record_id", "left")
    rows = rows.withColumn("_cost", is_cost_only()).where(~is_stale_dismissal(F.col("disposition")))
    facts = rows.groupBy("record_id").agg(
        F.count_if(~F.col("_cost")).alias("_substantive"), F.min(F.when(F.col("_cost"), F.col("action_index"))).alias("_first")
    )
    rows = rows.join(facts, "record_id")
    keep = ~F.col("_cost") | ((F.col("_substantive") == 0) & (F.col("action_index") == F.col("_first")))
    basis = F.coalesce("legal_basis", "direction_summary", F.lit("Cost clause does not create an operational task."))
    c = F.col("_cost")
    fixed = rows.where(keep).withColumns(
        {
            "title": F.when(c, "Record no cost recovery required").otherwise(F.col("title")),
            "responsible_department": F.when(~c, F.col("responsible_department")),
            "owner_source": F.when(~c, F.col("owner_source")),
            "timeline": F.when(c, no_timeline("missing")).otherwise(F.col("timeline")),
            "category": F.when(c, "no_operational_action").otherwise(F.col("category")),
            "priority": F.when(c, "low").otherwise(F.col("priority")),
            "legal_basis": F.when(c, basis).otherwise(F.col("legal_basis")),
            "direction_summary": F.when(c, basis).otherwise(F.col("direction_summary")),
            "confidence": F.when(c, F.least("confidence", F.lit(0.72))).otherwise(F.col("confidence")),
            "ambiguity_flags": F.when(c, F.array().cast("array<string>")).otherwise(F.col("ambiguity_flags")),
            "requires_human_review": F.col("requires_human_review") | c,
        }
    )
    return fixed.select(*actions.columns)


def quality_trace(actions: DataFrame, dispositions: DataFrame) -> DataFrame:
    """Per record: how many actions the gate saw, dropped, rewrote and kept."""
    rows = actions.join(dispositions.select("record_id", "disposition"), "record_id", "left").withColumns(
        {"_cost": is_cost_only(), "_stale": is_stale_dismissal(F.col("disposition"))}
    )
    live = ~F.col("_stale")
    counts = rows.groupBy("record_id").agg(
        F.count("*").alias("original"),
        F.count_if("_stale").alias("stale_removed"),
        F.count_if(live & F.col("_cost")).alias("cost_items"),
        F.count_if(live & ~F.col("_cost")).alias("substantive"),
    )
    beside = F.col("substantive") > 0
    return counts.select(
        "record_id",
        "original",
        "stale_removed",
        F.when(beside, F.col("cost_items")).otherwise(F.lit(0)).alias("cost_removed"),
        F.when(~beside & (F.col("cost_items") > 0), 1).otherwise(0).alias("cost_rewritten"),
        F.when(beside, F.col("substantive")).otherwise(F.least("cost_items", F.lit(1))).alias("kept"),
    )


def remand_sentences(pages: DataFrame) -> DataFrame:
    """First remand sentence with a destination on the last page of a record that has one."""
    flat = T.collapse_ws(F.coalesce("text", F.lit("")))

    def one(m: Column) -> Column:
        said = T.strip_chars(m, " .")
        return F.struct(said.alias("text"), T.clean_entity(T.extract(said, P.REMAND_DESTINATION, 1)).alias("owner"))

    found = F.filter(F.transform(T.extract_all(flat, P.REMAND_SENTENCE), one), lambda s: s["owner"] != "")
    rows = pages.select("record_id", "page", "chunk_id", F.get(found, F.lit(0)).alias("hit")).where("hit is not null")
    best = rows.groupBy("record_id").agg(F.max_by(F.struct("hit", "page"), F.struct("page", "chunk_id")).alias("b"))
    return best.select("record_id", F.col("b.hit.text").alias("text"), F.col("b.hit.owner").alias("owner"), F.col("b.page").alias("page"))


def ensure_remand(actions: DataFrame, sentences: DataFrame) -> DataFrame:
    """Add the remand task where no action covers its destination yet."""
    external = actions.where("category <> 'internal_review'")
    already = external.where("owner_source = 'remand_destination'").select("record_id")
    covered = (
        external.select("record_id", "responsible_department")
        .join(sentences.select("record_id", "owner"), "record_id")
        .where(F.lower(F.coalesce("responsible_department", F.lit(""))).contains(F.lower("owner")))
        .select("record_id")
    )
    counts = actions.groupBy("record_id").agg(F.count("*").cast("int").alias("n"))
    todo = sentences.join(already.unionByName(covered), "record_id", "left_anti").join(counts, "record_id", "left")
    n = F.coalesce("n", F.lit(0))
    numbers = T.strip_ws(T.extract(F.col("text"), P.REMAND_APPEAL_NUMBERS, 1))
    title = F.when(
        numbers != "", F.concat(F.lit("Fresh consideration of Appeal Nos. "), numbers, F.lit(" by "), F.col("owner"))
    ).otherwise(F.concat(F.lit("Fresh consideration of remanded matter by "), F.col("owner")))
    new = todo.select(
        "record_id",
        F.concat(F.lit("action-"), n).alias("action_id"),
        n.alias("action_index"),
        title.alias("title"),
        F.col("owner").alias("responsible_department"),
        no_timeline("not_specified").alias("timeline"),
        F.lit("direct_compliance").alias("category"),
        F.lit("medium").alias("priority"),
        F.col("text").alias("legal_basis"),
        F.lit(0.82).alias("confidence"),
        F.array(
            F.struct(
                F.lit("unknown").alias("source_id"), F.col("page").cast("int").alias("page"),
                F.concat(F.lit("p"), F.col("page")).alias("chunk_id"), F.col("text").alias("snippet"),
                F.lit(0.9).alias("confidence"), F.lit("deterministic").alias("extraction_method"),
                F.lit(None).cast("array<double>").alias("bbox"), F.lit(None).cast("double").alias("locator_confidence"),
                F.lit(None).cast("int").alias("char_start"), F.lit(None).cast("int").alias("char_end"),
                F.lit("text").alias("source_quality"),
            )
        ).alias("evidence"),
        F.array(F.lit("No explicit timeline specified by court.")).alias("notes"),
        F.col("text").alias("direction_summary"),
        F.lit("remand_destination").alias("owner_source"),
        F.array(F.lit("timeline_not_specified")).alias("ambiguity_flags"),
        F.lit(None).cast("string").alias("escalation_recommendation"),
        F.lit(None).cast("string").alias("decision_reason"),
        F.lit("Verify receiving court or authority before publication.").alias("review_recommendation"),
        F.lit(True).alias("requires_human_review"),
        F.lit("pending_review").alias("status"),
    )
    return actions.unionByName(new)


def prune_background(actions: DataFrame) -> DataFrame:
    """Beside a remand task, drop low-confidence and background items."""
    is_remand = (F.col("category") != "internal_review") & F.coalesce(F.col("owner_source") == "remand_destination", F.lit(False))
    remands = (
        actions.where(is_remand & F.col("responsible_department").isNotNull())
        .select("record_id", F.lower("responsible_department").alias("remand_owner"))
        .distinct()
    )
    has_remand = actions.where(is_remand).select("record_id").distinct().withColumn("_has", F.lit(True))
    said = F.lower(action_text(F.col("decision_reason"), F.col("review_recommendation"), with_evidence=True))
    near = T.matches(said, P.REMAND_CONTEXT)
    title_remand = T.matches(F.lower("title"), P.REMAND_TITLE)
    same_owner = (
        actions.select("record_id", "action_id", F.lower(F.coalesce("responsible_department", F.lit(""))).alias("o"))
        .join(remands, "record_id")
        .where("remand_owner <> '' and contains(o, remand_owner)")
        .select("record_id", "action_id")
        .distinct()
        .withColumn("_same", F.lit(True))
    )
    rows = actions.join(has_remand, "record_id", "left").join(same_owner, ["record_id", "action_id"], "left")
    conf = F.col("confidence")
    background = F.when(
        near, ((conf < 0.75) & F.col("_same").isNull()) | (~title_remand & (conf < 0.65))
    ).otherwise(~T.matches(said, P.MANDATORY_WORD) & ((conf < 0.7) | T.matches(said, P.BACKGROUND_WORD)))
    drop = F.coalesce("_has", F.lit(False)) & (F.col("category") != "internal_review") & ~is_remand & background
    return rows.where(~drop).select(*actions.columns)


def no_operational_actions(actions: DataFrame, declared: DataFrame) -> DataFrame:
    """Explicit, reviewable 'no action' rows for records that declare it and have nothing else.

    ``declared`` holds record_id, context_summary, confidence, has_evidence,
    decision_reason, review_recommendation and ambiguity_flags.
    """
    todo = declared.join(actions.select("record_id").distinct(), "record_id", "left_anti")
    summary = F.coalesce(
        T.null_if_blank(F.col("context_summary")), F.lit("The operative order does not create an immediate government task.")
    )
    conf = T.calibrated_confidence(
        F.coalesce(F.when(F.col("confidence") != 0, F.col("confidence")), F.lit(0.65)), F.lit(False), F.col("has_evidence"), F.lit(True)
    )
    new = todo.select(
        "record_id",
        F.lit("action-no-operational-action").alias("action_id"),
        F.lit(0).alias("action_index"),
        F.lit("Record no operational government action").alias("title"),
        F.lit(None).cast("string").alias("responsible_department"),
        no_timeline("missing").alias("timeline"),
        F.lit("no_operational_action").alias("category"),
        F.lit("low").alias("priority"),
        summary.alias("legal_basis"),
        conf.alias("confidence"),
        F.array().cast(f"array<{EVIDENCE_TYPE}>").alias("evidence"),
        F.array(F.lit("The source declared that the operative order asks for no government task.")).alias("notes"),
        summary.alias("direction_summary"),
        F.lit("llm_action_plan").alias("owner_source"),
        T.normalise_flags(F.coalesce("ambiguity_flags", F.array().cast("array<string>"))).alias("ambiguity_flags"),
        F.lit(None).cast("string").alias("escalation_recommendation"),
        F.coalesce(T.null_if_blank(F.col("decision_reason")), summary).alias("decision_reason"),
        F.coalesce(
            T.null_if_blank(F.col("review_recommendation")),
            F.lit("Verify the final order before marking this as no operational action."),
        ).alias("review_recommendation"),
        F.lit(True).alias("requires_human_review"),
        F.lit("pending_review").alias("status"),
    )
    return actions.unionByName(new)


def package_flags(records: DataFrame, fields: DataFrame, actions: DataFrame) -> DataFrame:
    """Risk flags of the whole package in first-seen order, as a long table with their rank.

    Flags come from a small vocabulary, so they are reduced to one row per
    record and flag before anything is gathered.
    """
    has = fields.where("coalesce(value, '') <> ''").groupBy("record_id").agg(F.collect_set("field").alias("present"))
    base = records.select("record_id").distinct().join(has, "record_id", "left")

    def missing(name: str) -> Column:
        return F.when(~F.coalesce(F.array_contains("present", name), F.lit(False)), F.lit(f"missing_{name}"))

    head = base.select(
        "record_id",
        F.posexplode(F.array_compact(F.array(missing("case_number"), missing("court"), missing("judgment_date")))).alias("pos", "flag"),
    ).select("record_id", "flag", F.struct(F.lit(-1).alias("a"), F.col("pos").alias("b")).alias("ord"))
    operational = ~F.col("category").isin(*P.NON_OPERATIONAL, "internal_review")
    said = F.concat(
        F.array_compact(
            F.array(
                F.when(operational & (F.coalesce("responsible_department", F.lit("")) == ""), "owner_unclear"),
                F.when(operational & (F.col("timeline.timeline_type") == "missing"), "missing_timeline"),
            )
        ),
        T.normalise_flags(F.col("ambiguity_flags")),
    )
    tail = actions.select("record_id", "action_index", F.posexplode(said).alias("pos", "flag")).select(
        "record_id", "flag", F.struct(F.col("action_index").cast("int").alias("a"), F.col("pos").alias("b")).alias("ord")
    )
    first = head.unionByName(tail).groupBy("record_id", "flag").agg(F.min("ord").alias("ord"))
    flags = first.groupBy("record_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("ord", "flag"))), lambda s: s["flag"]).alias("risk_flags")
    )
    return records.select("record_id").distinct().join(flags, "record_id", "left").select(
        "record_id", F.coalesce("risk_flags", F.array().cast("array<string>")).alias("risk_flags")
    )


def rule_fallback(model: DataFrame, rules: DataFrame, reason: str) -> DataFrame:
    """Rule actions for records for which the other source gave none, marked for review."""
    gaps = rules.join(model.select("record_id").distinct(), "record_id", "left_anti")
    marked = gaps.withColumns(
        {
            "requires_human_review": F.lit(True),
            "decision_reason": F.coalesce("decision_reason", F.lit("Rule-based action used because no usable model action was returned.")),
            "ambiguity_flags": F.array_distinct(F.concat("ambiguity_flags", F.array(F.lit(reason)))),
        }
    )
    return model.unionByName(marked.select(*model.columns))


def renumber(actions: DataFrame) -> DataFrame:
    """Consecutive action numbers per record after rows were added or dropped."""
    numbered = with_ordinals(actions, ["record_id"], ["action_index", "action_id"], F.floor(F.col("action_index") / 1024), "_n")
    return numbered.withColumns(
        {"action_index": F.col("_n"), "action_id": F.concat(F.lit("action-"), F.col("_n"))}
    ).drop("_n")
