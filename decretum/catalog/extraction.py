"""Queries over page tables: fields, directions, evidence, and their reference SQL.

The reference SQL states what must come out, from the order tables that the
page texts were written from; it does not repeat the text rules.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from decretum.catalog.fixtures import COURT_BASE, JUDGMENT_PAGES, court_pages, judgment_pages
from decretum.functions import text as T
from decretum.operators import candidates as C
from decretum.operators import fields as X
from decretum.sources.tables import broadcast_by_rows, settle

QUERIES = {}
ORACLES = {}

# expected values of the judgment corpus
J_BASE = """SELECT o_orderkey AS record_id, o_orderstatus AS st, o_orderdate AS d, year(o_orderdate) AS y, c_name AS cn,
  CASE n_nationkey % 4 WHEN 0 THEN 'Karnataka' WHEN 1 THEN 'Bombay' WHEN 2 THEN 'Kerala' ELSE 'Delhi' END AS place
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey"""
J_LINES = """SELECT l_orderkey AS record_id, CAST(1 + row_number() OVER (PARTITION BY l_orderkey
    ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate) AS INT) AS page, l_returnflag AS rf,
  CASE l_suppkey % 3 WHEN 0 THEN 'Revenue Department' WHEN 1 THEN 'BBMP' ELSE 'Urban Development Department' END AS dept,
  l_partkey % 3 AS kind,
  CASE WHEN l_linestatus = 'O' THEN CAST(l_quantity AS INT) END AS days FROM lineitem"""
J_TASKS = f"""SELECT *, concat('The ', dept, CASE kind WHEN 0 THEN ' shall file a compliance report'
    WHEN 1 THEN ' is directed to release the arrears due' ELSE ' shall remove the encroachment on the road' END,
    CASE WHEN days IS NOT NULL THEN concat(' within ', days, ' days') ELSE '' END) AS task FROM ({J_LINES})"""
J_OUTCOME = "CASE st WHEN 'F' THEN 'allowed' WHEN 'O' THEN 'dismissed' ELSE 'partly_allowed' END"
J_DIRECTIONS = f"""SELECT record_id, min(page) AS page, task AS direction FROM ({J_TASKS}) GROUP BY record_id, task
  UNION ALL SELECT record_id, 99, concat('In the result, the petition is ', {J_OUTCOME})
  FROM ({J_BASE}) WHERE st IN ('F', 'O')"""
# numbered directions with everything the action rules read
J_NUMBERED = f"""SELECT record_id, page, direction,
  CAST(row_number() OVER (PARTITION BY record_id ORDER BY page) - 1 AS INT) AS direction_index FROM ({J_DIRECTIONS})"""


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def _cands(spark, sf_dir, *fields: str, court: bool = False) -> DataFrame:
    pages = court_pages(spark, sf_dir) if court else judgment_pages(spark, sf_dir)
    return C.page_candidates(pages, fields)


@query(
    "a1_read_pages",
    f"""SELECT record_id, count(*) AS pages, sum(length(text)) AS chars, max(concat('p', page)) AS last_chunk
    FROM ({JUDGMENT_PAGES}) GROUP BY record_id""",
)
def a1(spark, sf_dir):
    from decretum.sources.corpus import page_table

    pages = page_table(judgment_pages(spark, sf_dir).drop("chunk_id"))
    return pages.groupBy("record_id").agg(
        F.count("*").alias("pages"), F.sum(F.length("text")).alias("chars"), F.max("chunk_id").alias("last_chunk")
    )


@query(
    "c1_case_number",
    f"""SELECT record_id, concat('Writ Petition No. ', record_id, ' of ', y) AS case_number,
    'writ_petition' AS case_type, 0.92 AS confidence FROM ({J_BASE})""",
)
def c1(spark, sf_dir):
    rows = X.first_fields(_cands(spark, sf_dir, "case_number", "case_type"))
    return rows.groupBy("record_id").agg(
        F.max(F.when(F.col("field") == "case_number", F.col("value"))).alias("case_number"),
        F.max(F.when(F.col("field") == "case_type", F.col("value"))).alias("case_type"),
        F.max(F.when(F.col("field") == "case_number", F.col("confidence"))).alias("confidence"),
    )


@query(
    "c2_court",
    f"SELECT record_id, concat('High Court Of ', place) AS court, concat('IN THE HIGH COURT OF ', upper(place)) AS raw_value FROM ({J_BASE})",
)
def c2(spark, sf_dir):
    return X.first_fields(_cands(spark, sf_dir, "court")).select("record_id", F.col("value").alias("court"), "raw_value")


@query(
    "c3_bench",
    f"""SELECT record_id, CASE v WHEN 0 THEN concat('Justice ', j1, '; Justice ', j2)
      WHEN 1 THEN concat('Justice ', j1, '; Chief Justice ', j2) ELSE concat('Justice ', j1) END AS bench
    FROM ({COURT_BASE}) WHERE v < 4""",
)
def c3(spark, sf_dir):
    rows = X.list_field(_cands(spark, sf_dir, "bench", court=True), "bench")
    return rows.select("record_id", F.col("value").alias("bench"))


@query(
    "c4_judgment_date",
    f"""SELECT record_id, strftime(d, '%Y-%m-%d') AS judgment_date,
    concat('Judgment dated ', day(d), '-', month(d), '-', y) AS raw_value FROM ({J_BASE})""",
)
def c4(spark, sf_dir):
    rows = X.text_dates(settle(_cands(spark, sf_dir, "judgment_date", "case_number")))
    return rows.select("record_id", F.date_format("date_value", "yyyy-MM-dd").alias("judgment_date"), "raw_value")


@query(
    "c5_date_from_file_name",
    f"""SELECT record_id, CASE WHEN v = 3 THEN strftime(d, '%Y-%m-%d') ELSE concat(year(d) + 1, '-09-28') END AS judgment_date,
    CASE WHEN v = 3 THEN 0.9 ELSE 0.65 END AS confidence, v <> 3 AS requires_review FROM ({COURT_BASE})""",
)
def c5(spark, sf_dir):
    cands = settle(_cands(spark, sf_dir, "judgment_date", "case_number", "file_name_date", court=True))
    rows = X.apply_file_name_dates(X.text_dates(cands), X.file_name_dates(cands))
    return rows.select(
        "record_id", F.date_format("date_value", "yyyy-MM-dd").alias("judgment_date"), "confidence", "requires_review"
    )


_PARTY_OUT = """SELECT record_id, petitioners, respondents, concat(petitioners, '; ', respondents) AS parties"""


def _party_columns(rows: DataFrame) -> DataFrame:
    out = [F.max(F.when(F.col("field") == f, F.col("value"))).alias(f) for f in X.PARTY_FIELDS]
    return rows.groupBy("record_id").agg(*out)


@query(
    "c6_parties",
    f"{_PARTY_OUT} FROM (SELECT record_id, cn AS petitioners, 'State of Kerala; BBMP' AS respondents FROM ({J_BASE}))",
)
def c6(spark, sf_dir):
    return _party_columns(X.party_fields(_cands(spark, sf_dir, "parties")))


@query(
    "c6_parties_by_layout",
    f"""{_PARTY_OUT} FROM (SELECT record_id,
      CASE WHEN v = 2 THEN 'Ram Lal' ELSE cn END AS petitioners,
      CASE v WHEN 0 THEN concat('State of ', place) WHEN 1 THEN concat('Union Territory of ', place)
        WHEN 2 THEN concat('State Of ', place) WHEN 3 THEN 'Municipal Board' ELSE 'Collector' END AS respondents
      FROM ({COURT_BASE}) WHERE v < 5)""",
)
def c6_layouts(spark, sf_dir):
    return _party_columns(X.party_fields(_cands(spark, sf_dir, "parties", court=True)))


@query(
    "c7_split_parties",
    f"SELECT record_id, 1 AS page, u.i AS party_no, u.p AS party FROM ({J_BASE}), "
    "(SELECT 1 AS i, 'State of Kerala' AS p UNION ALL SELECT 2, 'BBMP' UNION ALL SELECT 3, 'Union of India') u "
    f"UNION ALL SELECT record_id, page, 1, 'Union of India' FROM ({JUDGMENT_PAGES}) WHERE page <> 1",
)
def c7(spark, sf_dir):
    pages = judgment_pages(spark, sf_dir)
    said = F.concat(F.regexp_extract("text", r"v\. (.*)\n", 1), F.lit(" & Ors., Union of India Respondent(s), X"))
    return pages.select("record_id", "page", F.posexplode(T.split_parties(said)).alias("party_no", "party")).withColumn(
        "party_no", F.col("party_no") + 1
    )


@query(
    "c8_departments",
    f"""WITH hits AS (SELECT record_id, 1 AS page, 1 AS pos, concat('High Court of ', place) AS dept FROM ({J_BASE})
      UNION ALL SELECT record_id, 1, 2, 'State of Kerala' FROM ({J_BASE})
      UNION ALL SELECT record_id, 1, 3, 'BBMP' FROM ({J_BASE})
      UNION ALL SELECT record_id, page, 1, dept FROM ({J_LINES})),
    firsts AS (SELECT record_id, dept, min(page * 10 + pos) AS first_at FROM hits GROUP BY record_id, dept)
    SELECT record_id, string_agg(dept, '; ' ORDER BY first_at) AS departments FROM firsts GROUP BY record_id""",
)
def c8(spark, sf_dir):
    rows = X.list_field(_cands(spark, sf_dir, "departments"), "departments")
    return rows.select("record_id", F.col("value").alias("departments"))


@query(
    "c9_advocates",
    f"""SELECT record_id, concat('Mr. ', j2, ', Adv.; Ms. ', j1, ', Adv.') AS advocates FROM ({COURT_BASE}) WHERE v = 0""",
)
def c9(spark, sf_dir):
    rows = X.list_field(_cands(spark, sf_dir, "advocates", court=True), "advocates")
    return rows.select("record_id", F.col("value").alias("advocates"))


@query(
    "c10_counsel_across_pages",
    f"""SELECT record_id, concat('Mr. ', j2, ', learned senior counsel for appellant') AS counsel, 1 AS page FROM ({COURT_BASE}) WHERE v = 4
    UNION ALL SELECT record_id, concat('Ms. ', j1, ', learned counsel for respondent'), 1 FROM ({COURT_BASE}) WHERE v = 4""",
)
def c10(spark, sf_dir):
    found = X.counsel_mentions(court_pages(spark, sf_dir).withColumn("source", F.lit(None).cast("string")))
    rows = X.listed(found, "advocates", 12).select("record_id", F.inline("rows"))
    return rows.select("record_id", F.col("value").alias("counsel"), F.col("evidence.page").alias("page"))


@query(
    "c11_page_disposition",
    f"""SELECT record_id, {J_OUTCOME} AS disposition, CASE st WHEN 'F' THEN 'petition is allowed'
      WHEN 'O' THEN 'petition is dismissed' ELSE 'partly allowed' END AS raw_value, 0.82 AS confidence FROM ({J_BASE})""",
)
def c11(spark, sf_dir):
    rows = X.page_dispositions(_cands(spark, sf_dir, "page_disposition"))
    return rows.select("record_id", F.col("value").alias("disposition"), "raw_value", "confidence")


@query(
    "c12_final_disposition",
    f"""SELECT record_id, {J_OUTCOME} AS disposition, CASE st WHEN 'F' THEN 'petition is allowed'
      WHEN 'O' THEN 'petition is dismissed' ELSE 'petition is partly allowed' END AS raw_value, 0.94 AS confidence FROM ({J_BASE})""",
)
def c12(spark, sf_dir):
    pages = judgment_pages(spark, sf_dir)
    cands = settle(C.page_candidates(pages, ["page_disposition", "final_disposition"]))
    rows = X.choose_disposition(X.page_dispositions(cands), X.final_dispositions(cands, pages))
    return rows.select("record_id", F.col("value").alias("disposition"), "raw_value", "confidence")


@query(
    "c12_final_disposition_by_layout",
    f"""SELECT record_id, CASE v WHEN 0 THEN 'allowed' WHEN 1 THEN 'leave_granted' WHEN 2 THEN 'quashed' WHEN 3 THEN 'remanded'
      WHEN 4 THEN 'allowed' ELSE 'partly_allowed' END AS disposition,
      CASE v WHEN 0 THEN 0.82 ELSE 0.94 END AS confidence FROM ({COURT_BASE})""",
)
def c12_layouts(spark, sf_dir):
    pages = court_pages(spark, sf_dir)
    cands = settle(C.page_candidates(pages, ["page_disposition", "final_disposition"]))
    rows = X.choose_disposition(X.page_dispositions(cands), X.final_dispositions(cands, pages))
    return rows.select("record_id", F.col("value").alias("disposition"), "confidence")


@query(
    "c13_legal_phrases",
    f"""WITH hits AS (
      SELECT record_id, page, 0 AS k, 'timeline' AS phrase_type, concat('within ', days, ' days') AS phrase FROM ({J_LINES}) WHERE days IS NOT NULL
      UNION ALL SELECT record_id, page, 2, 'compliance_report', 'compliance report' FROM ({J_LINES}) WHERE kind = 0
      UNION ALL SELECT record_id, page, 6, 'payment_release', 'release' FROM ({J_LINES}) WHERE kind = 1
      UNION ALL SELECT record_id, page, 7, 'payment_release', 'arrears' FROM ({J_LINES}) WHERE kind = 1)
    SELECT record_id, phrase_type, phrase, page, CAST(row_number() OVER (PARTITION BY record_id ORDER BY page, k) AS INT) AS phrase_no FROM hits
    QUALIFY phrase_no <= 40""",
)
def c13(spark, sf_dir):
    rows = X.listed(_cands(spark, sf_dir, "legal_phrases"), "legal_phrases").select("record_id", F.inline("rows"))
    return rows.select(
        "record_id", F.col("value").alias("phrase_type"), F.col("raw").alias("phrase"),
        F.col("evidence.page").alias("page"), F.col("rank").alias("phrase_no"),
    )


_GUARDED = "trim(regexp_replace(text, '\\s+', ' ', 'g'))"
for _abbr, _sub in (
    (r"(C)\.(A)\.(No)\.", "\\1\\2<DOT>\\3<DOT>\\4<DOT>"), (r"(C)\.(A)\.", "\\1\\2<DOT>\\3<DOT>"),
    (r"(S)\.(L)\.(P)\.", "\\1\\2<DOT>\\3<DOT>\\4<DOT>"), (r"(W)\.(P)\.", "\\1\\2<DOT>\\3<DOT>"),
    (r"(Nos)\.", "\\1\\2<DOT>"), (r"(No)\.", "\\1\\2<DOT>"), (r"(Mr)\.", "\\1\\2<DOT>"), (r"(Ms)\.", "\\1\\2<DOT>"),
    (r"(Dr)\.", "\\1\\2<DOT>"), (r"(Rs)\.", "\\1\\2<DOT>"),
):
    _GUARDED = f"regexp_replace({_GUARDED}, '(?i)(^|[^A-Za-z]){_abbr}', '{_sub}', 'g')"


@query(
    "c14_sentences",
    f"""SELECT doc_id, len(s) AS sentences, list_max(list_transform(s, lambda x: length(replace(x, '<DOT>', '.')))) AS longest,
      length(replace(s[1], '<DOT>', '.')) AS first_length
    FROM (SELECT doc_id, string_split(regexp_replace({_GUARDED}, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)) AS s FROM documents)""",
)
def c14(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    rows = docs.select("doc_id", C.sentence_array(T.collapse_ws(F.col("text"))).alias("s"))
    return rows.select(
        "doc_id", F.size("s").alias("sentences"), F.array_max(F.transform("s", F.length)).alias("longest"),
        F.length(F.get("s", F.lit(0))).alias("first_length"),
    )


@query(
    "c15_directions",
    f"SELECT record_id, page, direction, direction_index, 0.78 AS confidence FROM ({J_NUMBERED})",
)
def c15(spark, sf_dir):
    rows = X.direction_fields(settle(_cands(spark, sf_dir, "directions")))
    return rows.select("record_id", "page", F.col("value").alias("direction"), "direction_index", "confidence")


@query(
    "c16_law_reports",
    f"""SELECT record_id, 'Supreme Court of India' AS court, concat('Justice ', j1) AS bench, 'Ram Lal' AS petitioners,
      concat('State Of ', place) AS respondents, CAST(NULL AS VARCHAR) AS judgment_date, 'quashed' AS disposition
    FROM ({COURT_BASE}) WHERE v = 2""",
)
def c16(spark, sf_dir):
    pages = court_pages(spark, sf_dir)
    names = ("case_number", "court", "bench", "parties", "judgment_date", "page_disposition", "final_disposition", "report_page")
    cands = settle(C.page_candidates(pages, names))
    reports = settle(X.report_records(cands))
    # all steps stay inside a record: those without a report are out from here on
    cands, pages = (x.join(reports.select("record_id"), "record_id", "left_semi") for x in (cands, pages.select("record_id", "page")))
    cands = settle(cands)
    rows = settle(
        X.first_fields(cands, ("court",))
        .unionByName(X.list_field(cands, "bench"))
        .unionByName(X.party_fields(cands))
        .unionByName(X.text_dates(cands))
        .unionByName(X.choose_disposition(X.page_dispositions(cands), X.final_dispositions(cands, pages)))
    )
    with broadcast_by_rows(spark):
        fixed = settle(X.normalise_reports(rows, reports).join(reports.select("record_id"), "record_id", "left_semi"))
    names = ("court", "bench", "petitioners", "respondents", "judgment_date", "disposition")
    return X.wide_fields(fixed).select("record_id", *names)


@query(
    "c17_extraction_risk_flags",
    f"""SELECT record_id, CASE v WHEN 2 THEN 'missing_case_number' WHEN 5 THEN 'missing_case_number|missing_court|owner_unclear'
      ELSE '' END AS risk_flags FROM ({COURT_BASE})""",
)
def c17(spark, sf_dir):
    pages = court_pages(spark, sf_dir)
    names = ("case_number", "court", "judgment_date", "file_name_date", "departments", "page_disposition", "directions")
    cands = settle(C.page_candidates(pages, names, evidence=True))
    rows = (
        X.first_fields(cands)
        .unionByName(X.apply_file_name_dates(X.text_dates(cands), X.file_name_dates(cands)))
        .unionByName(X.list_field(cands, "departments"))
        .unionByName(X.page_dispositions(cands))
    )
    flags = X.extraction_flags(pages.select("record_id").distinct(), rows, X.direction_fields(cands))
    return flags.select("record_id", F.array_join("risk_flags", "|").alias("risk_flags"))


@query(
    "c18_extract_all",
    f"""SELECT record_id, concat('Writ Petition No. ', record_id, ' of ', y) AS case_number, 'writ_petition' AS case_type,
      concat('High Court Of ', place) AS court, strftime(d, '%Y-%m-%d') AS judgment_date,
      concat(cn, '; State of Kerala; BBMP') AS parties, cn AS petitioners, 'State of Kerala; BBMP' AS respondents,
      {J_OUTCOME} AS disposition FROM ({J_BASE})""",
)
def c18(spark, sf_dir):
    rows = X.extract_fields(judgment_pages(spark, sf_dir))
    names = ("case_number", "case_type", "court", "judgment_date", "parties", "petitioners", "respondents", "disposition")
    return X.wide_fields(rows).select("record_id", *names)


@query(
    "c19_evidence",
    f"""WITH m AS (SELECT record_id, page, text, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS flat,
        concat('Writ Petition No. ', record_id, ' of ', y) AS said
      FROM ({JUDGMENT_PAGES}) JOIN (SELECT record_id AS rid, y FROM ({J_BASE})) ON record_id = rid WHERE page = 1)
    SELECT record_id, page, strpos(text, said) - 1 AS char_start, strpos(text, said) - 1 + length(said) AS char_end,
      substr(flat, greatest(strpos(flat, said) - 40, 1),
        least(length(flat), strpos(flat, said) - 1 + length(said) + 40) - greatest(strpos(flat, said) - 41, 0)) AS snippet,
      'text' AS source_quality FROM m""",
)
def c19(spark, sf_dir):
    rows = X.first_fields(_cands(spark, sf_dir, "case_number"), ("case_number",))
    ev = F.get("evidence", F.lit(0))
    return rows.select(
        "record_id", ev["page"].alias("page"), ev["char_start"].alias("char_start"), ev["char_end"].alias("char_end"),
        ev["snippet"].alias("snippet"), ev["source_quality"].alias("source_quality"),
    )
