"""Several sources for one record: weak values, merges, repairs, payload shapes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from decretum.functions import patterns as P
from decretum.functions import text as T
from decretum.sources.tables import spread

FUSED_FIELDS = (
    "case_number", "case_type", "court", "bench", "judgment_date", "parties", "petitioners", "respondents", "departments", "advocates",
    "disposition",
)
REPAIR_FIELDS = ("case_number", "court", "bench", "judgment_date", "petitioners", "respondents", "departments", "advocates", "disposition")
CRITICAL_FIELDS = ("case_number", "court", "bench", "judgment_date")


# ---- predicates ----------------------------------------------------------------------


def unusable_case_number(value: Column) -> Column:
    """No digit, or nothing but a label."""
    return ~value.rlike(r"(?U)\d") | T.matches(value, P.CASE_LABEL_ONLY)


def is_weak_field(field: Column, value: Column, confidence: Column, requires_review: Column) -> Column:
    """Value that another source may replace."""
    flat = F.lower(T.strip_ws(F.coalesce(value, F.lit(""))))
    conf = F.coalesce(confidence, F.lit(0.0))
    weak = (
        (F.coalesce(value, F.lit("")) == "")
        | flat.isin(*P.WEAK_WORDS)
        | (F.coalesce(requires_review, F.lit(False)) & (conf < 0.85))
        | ((conf != 0) & (conf < 0.65))
        | T.matches(F.coalesce(value, F.lit("")), P.WEAK_NOISE)
        | ((field == "case_number") & F.coalesce(unusable_case_number(value), F.lit(True)))
    )
    return F.coalesce(weak, F.lit(True))


def valid_direction(text: Column) -> Column:
    flat = T.collapse_ws(F.lower(F.coalesce(text, F.lit(""))))
    return (flat != "") & ~T.matches(flat, P.HELD_BY_OTHER_COURT) & T.matches(flat, P.SOURCE_DIRECTION)


def heading_only(text: Column) -> Column:
    return T.matches(T.strip_chars(T.collapse_ws(F.coalesce(text, F.lit(""))), " .:-"), P.DIRECTION_HEADING)


def valid_disposition(value: Column) -> Column:
    flat = F.replace(F.regexp_replace(F.lower(T.strip_ws(F.coalesce(value, F.lit("")))), T.WHITESPACE, "_"), F.lit("-"), F.lit("_"))
    return flat.isin(*P.DISPOSITIONS)


def missing_or_weak(field: Column, value: Column, items: Column) -> Column:
    """Value of a second source that should be asked for again."""
    blank = (F.coalesce(value, F.lit("")) == "") & (F.coalesce(F.size(items), F.lit(0)) <= 0)
    bench = F.forall(F.coalesce(items, F.array(value)), lambda x: F.lower(T.strip_ws(x)).isin(*P.PLACEHOLDER_BENCH))
    return F.coalesce(
        blank
        | ((field == "bench") & bench)
        | ((field == "case_number") & T.matches(T.strip_ws(value), P.CASE_LABEL_NUMBERLESS))
        | ((field == "disposition") & F.lower(T.strip_ws(value)).isin("unknown", "not extracted", "none", "null")),
        F.lit(True),
    )


def fields_needing_retry(records: DataFrame, fields: DataFrame, names=REPAIR_FIELDS) -> DataFrame:
    """Long list of (record, field) that are missing or weak; ``critical`` marks the four key ones."""
    wanted = records.select("record_id").distinct().select("record_id", F.explode(F.array(*[F.lit(n) for n in names])).alias("field"))
    rows = wanted.join(fields.select("record_id", "field", "value", "items"), ["record_id", "field"], "left")
    weak = missing_or_weak(F.col("field"), F.col("value"), F.col("items"))
    return rows.where(weak).select("record_id", "field", F.col("field").isin(*CRITICAL_FIELDS).alias("critical"))


def needs_fallback(records: DataFrame, fields: DataFrame, profiles: DataFrame, reports: DataFrame) -> DataFrame:
    """Whether a record should go through a second source, and why.

    ``profiles`` holds profile_type and sparse_count, ``reports`` law_report.
    """
    names = ("parties", "petitioners", "respondents", "bench", "judgment_date")
    weak = is_weak_field(F.col("field"), F.col("value"), F.col("confidence"), F.col("requires_review"))
    strong = fields.where(F.col("field").isin(*names) & ~weak).groupBy("record_id").agg(F.count_distinct("field").alias("strong"))
    rows = (
        records.select("record_id").distinct().join(profiles.select("record_id", "profile_type", "sparse_count"), "record_id", "left")
        .join(reports, "record_id", "left").join(strong, "record_id", "left")
    )
    why = (
        F.when(F.coalesce("profile_type", F.lit("")) != "digital", "profile")
        .when(F.coalesce("sparse_count", F.lit(0)) > 0, "sparse_pages")
        .when(F.coalesce("law_report", F.lit(False)), "law_report")
        .when(F.coalesce("strong", F.lit(0)) < len(names), "weak_fields")
    )
    return rows.select("record_id", why.isNotNull().alias("needs_fallback"), why.alias("why"))


def has_case_signal(records: DataFrame, fields: DataFrame, directions: DataFrame) -> DataFrame:
    """Whether another source's record says anything about the case."""
    names = ("case_number", "court", "bench", "disposition", "judgment_date", "petitioners", "respondents", "other_parties")
    said = fields.where(F.col("field").isin(*names) & (F.coalesce("value", F.lit("")) != "")).select("record_id")
    yes = said.unionByName(directions.select("record_id")).distinct().withColumn("has_case_signal", F.lit(True))
    return records.select("record_id").distinct().join(yes, "record_id", "left").withColumn("has_case_signal", F.coalesce("has_case_signal", F.lit(False)))


def can_reuse_source(sources: DataFrame, fields: DataFrame, directions: DataFrame) -> DataFrame:
    """Records whose second-source text is strong enough to take their fields from it.

    ``sources`` holds record_id, ocr_routing and has_vision_pages.
    """
    names = ("case_number", "court", "bench", "judgment_date", "disposition")
    full = fields.where(F.col("field").isin(*names) & ~T.is_empty_text(F.col("value"))).groupBy("record_id").agg(F.count_distinct("field").alias("n"))
    directed = directions.select("record_id").distinct().withColumn("_d", F.lit(True))
    rows = sources.join(full, "record_id", "left").join(directed, "record_id", "left")
    ok = (
        F.coalesce(F.col("ocr_routing").startswith("vision_ocr"), F.lit(False))
        & F.coalesce("has_vision_pages", F.lit(False))
        & (F.coalesce("n", F.lit(0)) == len(names))
        & F.coalesce("_d", F.lit(False))
    )
    return rows.select("record_id", ok.alias("can_reuse"))


# ---- fusion --------------------------------------------------------------------------


def fuse_fields(primary: DataFrame, secondary: DataFrame, provider: str = "second source") -> DataFrame:
    """Primary fields, with weak ones filled from the second source and marked for review."""
    usable = secondary.where(
        F.col("field").isin(*FUSED_FIELDS)
        & (F.coalesce("value", F.lit("")) != "")
        & ((F.col("field") != "disposition") | valid_disposition(F.col("value")))
    ).select("record_id", "field", F.col("value").alias("s_value"), F.col("items").alias("s_items"))
    both = primary.join(usable, ["record_id", "field"], "full")
    weak = is_weak_field(F.col("field"), F.col("value"), F.col("confidence"), F.col("requires_review"))
    fill = F.col("s_value").isNotNull() & weak
    return both.select(
        "record_id",
        "field",
        F.when(fill, F.col("s_value")).otherwise(F.col("value")).alias("value"),
        F.when(fill, F.col("s_items")).otherwise(F.col("items")).alias("items"),
        F.when(fill, 0.88).otherwise(F.col("confidence")).alias("confidence"),
        (fill | F.coalesce("requires_review", F.lit(False))).alias("requires_review"),
        F.when(fill, provider).otherwise("primary").alias("value_source"),
    )


def fuse_directions(primary: DataFrame, secondary: DataFrame) -> DataFrame:
    """Second-source directions for records without any; headings and foreign holdings left out."""
    gaps = secondary.join(primary.select("record_id").distinct(), "record_id", "left_anti")
    good = gaps.where(valid_direction(F.col("value")) & ~heading_only(F.col("value")))
    more = good.select("record_id", "direction_index", "value", F.lit(0.86).alias("confidence"), F.lit(True).alias("requires_review"))
    return primary.select(*more.columns).unionByName(more)


def should_rebuild_actions(records: DataFrame, actions: DataFrame) -> DataFrame:
    """Records with no action, or with none but non-operational ones."""
    busy = actions.where(~F.col("category").isin(*P.NON_OPERATIONAL)).select("record_id").distinct()
    return records.select("record_id").distinct().join(busy, "record_id", "left_anti")


def merge_page_results(results: DataFrame) -> DataFrame:
    """First non-empty value of each field over the page results of a record.

    ``results`` holds record_id, result_no, field and value.
    """
    rows = results.where("coalesce(value, '') <> ''")
    return rows.groupBy("record_id", "field").agg(F.min_by(F.struct("value", "result_no"), "result_no").alias("b")).select(
        "record_id", "field", F.col("b.value").alias("value"), F.col("b.result_no").alias("result_no")
    )


def merge_page_directions(results: DataFrame) -> DataFrame:
    """Distinct directions of all page results with their first place."""
    rows = results.where("coalesce(value, '') <> ''")
    return rows.groupBy("record_id", "value").agg(F.min(F.struct("result_no", "pos")).alias("o")).select(
        "record_id", "value", "o.result_no", "o.pos"
    )


# ---- field repair --------------------------------------------------------------------


def fields_to_repair(rules: DataFrame, model: DataFrame) -> DataFrame:
    """Fields where the model value falls short of the rule value.

    Both tables hold record_id, field, value and items.
    """
    names = ("bench", "judgment_date", "advocates", "disposition")
    r = rules.where(F.col("field").isin(*names)).select("record_id", "field", F.col("value").alias("rv"), F.col("items").alias("ri"))
    m = model.where(F.col("field").isin(*names)).select("record_id", "field", F.col("value").alias("mv"), F.col("items").alias("mi"))
    none = F.array().cast("array<string>")

    def names_of(items: Column) -> Column:
        return F.filter(F.coalesce(items, none), lambda x: T.strip_ws(F.coalesce(x, F.lit(""))) != "")

    def keys(items: Column) -> Column:
        return F.array_distinct(F.transform(items, T.person_name_key))

    rows = r.join(m, ["record_id", "field"], "left").withColumns({"ri": names_of(F.col("ri")), "mi": names_of(F.col("mi"))})
    rule_empty, model_empty = T.is_empty_text(F.col("rv")), T.is_empty_text(F.col("mv"))
    fewer = (F.size("ri") >= 2) & (F.size("mi") > 0) & (F.size("mi") < F.size("ri")) & (F.size(F.array_except(keys(F.col("ri")), keys(F.col("mi")))) > 0)
    a, b = F.lower(T.strip_ws(F.col("rv"))), F.lower(T.strip_ws(F.coalesce("mv", F.lit(""))))
    disagree = ~a.isin("", "unknown") & ~b.isin("", "unknown") & (a != b)
    why = (
        F.when((F.col("field") == "bench") & fewer, "fewer_judges")
        .when((F.col("field") == "disposition") & disagree, "disagree")
        .when(model_empty, "empty")
    )
    return rows.where(~rule_empty & why.isNotNull()).select("record_id", "field", why.alias("why"))


def prefer_richer(repaired: Column, rules: Column, field: Column) -> Column:
    """Repaired names, each replaced by a longer rule name that contains it; a bench by the fuller rule bench."""
    rule_keys = F.transform(rules, lambda x: F.struct(T.person_name_key(x).alias("k"), x.alias("v")))

    def richer(x: Column) -> Column:
        key = T.person_name_key(x)
        hits = F.filter(rule_keys, lambda r: (key != "") & r["k"].contains(key) & (F.length(r["v"]) > F.length(x)))
        return F.coalesce(F.get(hits, F.lit(0))["v"], x)

    keys = F.array_distinct(F.transform(repaired, T.person_name_key))
    inside = F.size(F.array_except(keys, F.transform(rule_keys, lambda r: r["k"]))) == 0
    fuller = (F.size(rules) > F.size(repaired)) & (F.size(keys) > 0) & inside
    return F.array_distinct(
        F.when(field == "advocates", F.transform(repaired, richer)).when((field == "bench") & fuller, rules).otherwise(repaired)
    )


def apply_field_repair(model: DataFrame, repairs: DataFrame, rules: DataFrame) -> DataFrame:
    """Model fields after repair answers; blank answers change nothing.

    ``repairs`` holds record_id, field, value, items and confidence.
    """
    none = F.array().cast("array<string>")
    rep = repairs.select("record_id", "field", F.col("value").alias("pv"), F.col("items").alias("pi"), F.col("confidence").alias("pc"))
    rul = rules.select("record_id", "field", F.col("items").alias("ri"), F.col("requires_review").alias("rr"))
    rows = model.select("record_id", "field", "value", "items", "confidence").join(rep, ["record_id", "field"], "full").join(rul, ["record_id", "field"], "left")
    listed = F.col("field").isin("bench", "advocates")
    new_items = prefer_richer(
        F.filter(F.coalesce("pi", none), lambda x: T.strip_ws(x) != ""), F.coalesce("ri", none), F.col("field")
    )
    rows = rows.withColumn("_items", F.when(listed, new_items))
    said = T.strip_ws(F.coalesce("pv", F.lit("")))
    scalar = F.col("field").isin("judgment_date", "disposition") & (said != "")
    lists = listed & (F.size(F.coalesce("_items", none)) > 0)
    conf = F.when((F.col("field") == "advocates") & F.coalesce("rr", F.lit(False)), F.least("pc", F.lit(0.74))).otherwise(F.coalesce("pc", F.lit(0.0)))
    return rows.select(
        "record_id",
        "field",
        F.when(scalar, F.when(F.col("field") == "disposition", F.lower(said)).otherwise(said)).when(lists, F.array_join("_items", "; "))
        .otherwise(F.col("value")).alias("value"),
        F.when(lists, F.col("_items")).otherwise(F.col("items")).alias("items"),
        F.when(scalar | lists, conf).otherwise(F.col("confidence")).alias("confidence"),
        (scalar | lists).alias("repaired"),
    )


def field_diagnosis(rules: DataFrame, model: DataFrame, final: DataFrame) -> DataFrame:
    """For each record and field: which of rule, model and final value is empty, in words."""

    def side(df: DataFrame, name: str) -> DataFrame:
        return df.select("record_id", "field", (~T.is_empty_text(F.col("value"))).alias(name))

    rows = side(rules, "r").join(side(model, "m"), ["record_id", "field"], "full").join(side(final, "f"), ["record_id", "field"], "full")
    r, m, f = (F.coalesce(c, F.lit(False)) for c in ("r", "m", "f"))
    said = (
        F.when(r & ~m & ~f, "deterministic_found_but_llm_final_empty")
        .when(~r & m & ~f, "llm_found_but_final_empty")
        .when(~f, "missing_everywhere")
        .when(m, "llm_value_written")
        .when(r, "deterministic_value_written")
        .otherwise("present")
    )
    return rows.select("record_id", "field", said.alias("diagnosis"))


def merge_action_repairs(current: DataFrame, repairs: DataFrame) -> DataFrame:
    """The repaired action list replaces the current one where it has usable items.

    Both tables hold record_id, idx, title and evidence_snippet.
    """
    usable = repairs.where("coalesce(title, '') <> '' and coalesce(evidence_snippet, '') <> ''")
    kept = current.join(usable.select("record_id").distinct(), "record_id", "left_anti")
    return kept.withColumn("repaired", F.lit(False)).unionByName(usable.select(*current.columns).withColumn("repaired", F.lit(True)))


# ---- payload shapes ------------------------------------------------------------------


def salvage_json(text: Column) -> Column:
    """JSON object inside a model answer: fences stripped, else the outermost braces; null when there is none."""
    bare = T.strip_ws(F.regexp_replace(F.regexp_replace(T.strip_ws(text), r"(?i)^```(?:json)?\s*", ""), r"\s*```$", ""))
    inner = F.regexp_extract(bare, r"(?s)\{.*\}", 0)

    def valid(t: Column) -> Column:
        return F.when(t.startswith("{") & F.try_parse_json(t).isNotNull(), t)

    return F.coalesce(valid(bare), valid(inner))


def as_list(value: Column) -> Column:
    """Comma-separated text as a list of stripped, non-empty items."""
    return F.filter(F.transform(F.split(F.coalesce(value, F.lit("")), ","), T.strip_ws), lambda x: x != "")


def json_items(json: Column, path: str) -> Column:
    """Strings at a JSON path: a scalar, a list of scalars, or objects with a name-like member."""
    raw = F.get_json_object(json, path)
    entries = F.from_json(raw, "array<string>")

    def text_of(x: Column) -> Column:
        named = [F.get_json_object(x, f"$.{k}") for k in ("name", "organization", "text", "direction", "value", "title", "content")]
        return T.strip_ws(F.when(x.startswith("{"), F.coalesce(*named, F.lit(""))).otherwise(x))

    found = F.when(raw.isNull() | (raw == ""), F.array().cast("array<string>")).when(
        raw.startswith("["), F.transform(entries, text_of)
    ).otherwise(F.array(text_of(raw)))
    return F.filter(found, lambda x: F.coalesce(x, F.lit("")) != "")


PAYLOAD_PATHS = {
    "case_number": ["$.case_details.case_number", "$.case_number"],
    "case_type": ["$.case_details.case_type", "$.case_type"],
    "court": ["$.case_details.court", "$.court"],
    "bench": ["$.case_details.bench", "$.bench"],
    "judgment_date": ["$.date_of_order.value", "$.date_of_order.raw_text", "$.case_details.judgment_date", "$.judgment_date"],
    "disposition": ["$.case_details.disposition", "$.disposition"],
    "advocates": ["$.case_details.advocates", "$.advocates"],
    "departments": ["$.case_details.departments", "$.case_details.responsible_entities", "$.departments"],
    "petitioners": ["$.parties.petitioners", "$.parties_involved.petitioners", "$.case_details.petitioners", "$.petitioners"],
    "respondents": ["$.parties.respondents", "$.parties_involved.respondents", "$.case_details.respondents", "$.respondents"],
}
DIRECTION_PATHS = [
    "$.key_directions_orders", "$.operative_directions", "$.directions", "$.case_details.key_directions_orders",
    "$.case_details.operative_directions", "$.case_details.directions",
]


#: Where second-source JSON holds each side of the parties, in the parties' own object and in the case details.
PARTY_OBJECTS = ("$.parties", "$.parties_involved")
#: Fields that a bare list of pages places: those of the first page, and those of the last.
FIRST_PAGE_FIELDS = ("case_number", "court", "bench", "parties", "petitioners", "respondents")
LAST_PAGE_FIELDS = ("judgment_date", "disposition", "directions")


def payload_parties(json: Column) -> Column:
    """Petitioners, respondents and all parties of second-source JSON as a struct of lists.

    Roles in the case details win over those of the parties' object, unless a name among them fits no party.
    """
    none = F.array().cast("array<string>")

    def side(name: str) -> Column:
        return _first_filled(json_items(json, f"$.parties.{name}"), json_items(json, f"$.parties_involved.{name}"))

    plain = none
    for path in reversed(PARTY_OBJECTS):
        raw = F.get_json_object(json, path)
        plain = _first_filled(F.when(raw.startswith("{"), none).otherwise(json_items(json, path)), plain)
    said = {name: side(name) for name in ("petitioners", "respondents")}
    both = F.concat(said["petitioners"], F.array_except(said["respondents"], said["petitioners"]))
    parties = _first_filled(both, plain)

    def role(name: str) -> Column:
        own = _first_filled(json_items(json, f"$.case_details.{name}"), json_items(json, f"$.{name}"))
        return F.when((F.size(own) > 0) & T.roles_consistent(own, parties), own).otherwise(said[name])

    return F.struct(role("petitioners").alias("petitioners"), role("respondents").alias("respondents"), parties.alias("parties"))


def payload_pages(json: Column) -> Column:
    """Evidence page of each field as a map: given by field, or as a list whose first and last page stand for fields.

    Directions without a page of their own take that of the last direction that names one.
    """
    raw = F.coalesce(F.get_json_object(json, "$.evidence_pages"), F.get_json_object(json, "$.case_details.evidence_pages"))

    def digits(x: Column) -> Column:
        return F.when(x.rlike(r"^\d+$"), x).try_cast("int")

    def page_of(x: Column, *names: str) -> Column:
        return digits(F.coalesce(*[F.get_json_object(x, f"$.{n}") for n in names]))

    named = F.map_filter(F.transform_values(F.from_json(raw, "map<string,string>"), lambda _, v: digits(v)), lambda _, v: v.isNotNull())
    listed = F.filter(F.transform(F.from_json(raw, "array<string>"), lambda x: page_of(x, "page_number", "page")), lambda p: p.isNotNull())
    first, last = F.get(listed, 0), F.element_at(listed, -1)
    pairs = [F.struct(F.lit(f).alias("f"), first.alias("p")) for f in FIRST_PAGE_FIELDS] + [F.struct(F.lit(f).alias("f"), last.alias("p")) for f in LAST_PAGE_FIELDS]
    none = F.create_map().cast("map<string,int>")
    placed = F.coalesce(
        F.when(raw.startswith("{"), named), F.when(raw.startswith("[") & (F.size(listed) > 0), F.map_from_entries(F.array(*pairs))), none
    )
    orders = F.coalesce(*[F.when(F.get_json_object(json, p).startswith("["), F.get_json_object(json, p)) for p in DIRECTION_PATHS])
    sources = F.filter(
        F.transform(F.from_json(orders, "array<string>"), lambda x: page_of(x, "source_page", "page_number", "page")), lambda p: p.isNotNull()
    )
    more = F.when(~F.map_contains_key(placed, F.lit("directions")) & (F.size(sources) > 0), F.create_map(F.lit("directions"), F.element_at(sources, -1)))
    return F.map_concat(placed, F.coalesce(more, none))


def payload_to_candidates(payloads: DataFrame) -> DataFrame:
    """Long field rows from second-source JSON in any of its accepted shapes.

    ``payloads`` holds record_id and json. The first path that yields items wins; parties follow ``payload_parties``.
    ``evidence_page`` is null where the payload places neither the field nor a page list.
    """
    none = F.array().cast("array<string>")
    found = {}
    for field, paths in PAYLOAD_PATHS.items():
        if field in ("petitioners", "respondents"):
            continue
        items = none
        for path in reversed(paths):
            here = json_items(F.col("json"), path)
            if field == "departments":
                here = F.filter(here, T.looks_public)
            if field == "advocates":
                here = F.filter(here, T.looks_like_advocate)
            items = _first_filled(here, items)
        found[field] = items
    dealt = spread(payloads.select("record_id", "json"), "record_id")
    named = dealt.select("record_id", "json", payload_parties(F.col("json")).alias("_sides"), payload_pages(F.col("json")).alias("_pages"))
    found |= {side: F.col(f"_sides.{side}") for side in ("petitioners", "respondents", "parties")}
    rows = [F.struct(F.lit(field).alias("field"), items.alias("items")) for field, items in found.items()]
    long = named.select("record_id", "_pages", F.explode(F.array(*rows)).alias("c")).select(
        "record_id", "c.field", "c.items", F.try_element_at("_pages", F.col("c.field")).alias("evidence_page")
    )
    return long.where(F.size("items") > 0).withColumn("value", F.array_join("items", "; "))


def _first_filled(items: Column, rest: Column) -> Column:
    return F.when(F.size(items) > 0, items).otherwise(rest)


def payload_directions(payloads: DataFrame) -> DataFrame:
    """Directions of second-source JSON; bare headings left out."""
    none = F.array().cast("array<string>")
    items = none
    for path in reversed(DIRECTION_PATHS):
        items = _first_filled(json_items(F.col("json"), path), items)
    rows = payloads.select("record_id", F.posexplode(items).alias("direction_index", "value"))
    return rows.where(~heading_only(F.col("value")))


def actions_from_payload(items: DataFrame, citations: DataFrame | None) -> DataFrame:
    """Typed action rows of a model answer.

    ``items`` holds record_id, idx, title, responsible_department, category,
    priority, confidence, ambiguity_flags, timeline_text and timeline_type;
    ``citations`` is keyed by idx as snippet_id, or None where the items have evidence_page already. A ``requires_human_review`` mark of the answer stays; further columns are carried along.
    """
    from decretum.operators.actions import classify, priority_of

    named = ("record_id", "idx", "title", "responsible_department", "category", "priority", "confidence", "ambiguity_flags", "timeline_type")
    more = [c for c in items.columns if c not in (*named, "requires_human_review", "evidence_page")]
    asked = F.coalesce("requires_human_review", F.lit(False)) if "requires_human_review" in items.columns else F.lit(False)

    rows = items.where("coalesce(title, '') <> ''")
    if citations is not None:
        cited = citations.select("record_id", F.col("snippet_id").alias("idx"), F.col("page").alias("evidence_page"))
        rows = rows.drop("evidence_page").join(cited, ["record_id", "idx"], "left")
    derived = classify(F.col("title"), F.lit(None).cast("string"))["category"]
    category = T.normalise_category(F.coalesce(T.null_if_blank(F.col("category")), derived))
    flags = T.normalise_flags(F.coalesce("ambiguity_flags", F.array().cast("array<string>")))
    priority = T.normalise_priority(
        F.coalesce(T.null_if_blank(F.col("priority")), priority_of(category, flags, F.coalesce("timeline_text", F.lit("")) != ""))
    )
    has = F.col("evidence_page").isNotNull()
    owner = (F.coalesce("responsible_department", F.lit("")) != "") | (category == "no_operational_action")
    conf = T.calibrated_confidence(F.col("confidence"), F.lit(False), has, owner)
    return rows.select(
        "record_id", "idx", "title", "responsible_department", category.alias("category"), priority.alias("priority"), conf.alias("confidence"),
        flags.alias("ambiguity_flags"), "evidence_page", (asked | (conf < 0.75) | (F.size(flags) > 0)).alias("requires_human_review"),
        F.coalesce("timeline_type", F.lit("missing")).alias("timeline_type"), *more,
    )


def candidates_to_text(fields: DataFrame, directions: DataFrame, pages: DataFrame) -> DataFrame:
    """Second-source values as one labelled text for each evidence page.

    ``pages`` holds record_id and page; a record without any gets page 1.
    Repeated directions are written once, whatever their letter case.
    """
    order = {n: i for i, n in enumerate(
        ("case_number", "case_type", "court", "judgment_date", "disposition", "bench", "petitioners", "respondents", "departments",
         "responsible_entities", "advocates"))}
    joined = F.coalesce(F.array_join(F.filter("items", lambda x: T.strip_ws(x) != ""), ", "), T.strip_ws(F.col("value")))
    labelled = fields.withColumn("_o", T.lookup(order, F.col("field"))).where("_o is not null").select(
        "record_id", F.lit(0).alias("s"), F.col("_o").cast("long").alias("o"), F.concat("field", F.lit(": "), joined, F.lit(".")).alias("line")
    )
    said = directions.withColumn("_t", T.strip_ws(F.col("value"))).where("_t <> ''")
    once = said.groupBy("record_id", F.lower("_t").alias("k")).agg(F.min_by("_t", "direction_index").alias("line"), F.min("direction_index").alias("o"))
    ordered = once.select("record_id", F.lit(2).alias("s"), F.col("o").cast("long").alias("o"), "line")
    ids = labelled.select("record_id").unionByName(ordered.select("record_id")).distinct()
    marks = ids.select("record_id", F.lit(1).alias("s"), F.lit(0).cast("long").alias("o"), F.lit("ACTION CONTEXT.").alias("line"))
    texts = labelled.unionByName(ordered).unionByName(marks).groupBy("record_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("s", "o", "line"))), lambda x: x["line"]), "\n").alias("text")
    )
    placed = ids.join(pages.select("record_id", "page").distinct(), "record_id", "left").select("record_id", F.coalesce("page", F.lit(1)).alias("page"))
    return placed.join(texts, "record_id").withColumn("chunk_id", F.concat(F.lit("vision-ocr-p"), F.col("page")))


def union_documents(text: DataFrame, *more: DataFrame, discard_text_layer: bool = False, defaults: dict[str, Column] | None = None) -> DataFrame:
    """Page tables of several layers as one; missing metadata gets its default."""
    parts = list(more) if discard_text_layer else [text, *more]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part, allowMissingColumns=True)
    for name, value in (defaults or {}).items():
        out = out.withColumn(name, F.coalesce(F.col(name), value) if name in out.columns else value)
    return out
