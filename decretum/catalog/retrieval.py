"""Queries over page windows, text quality, search and citation, with their reference SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from decretum.catalog.extraction import J_BASE, J_LINES, J_OUTCOME
from decretum.catalog.fixtures import COURT_BASE, JUDGMENT_PAGES, court_pages, judgment_pages
from decretum.functions import patterns as P
from decretum.functions import text as T
from decretum.operators import candidates as C
from decretum.operators import fields as X
from decretum.operators import quality as Q
from decretum.operators import retrieval as R
from decretum.sources.corpus import conversation_pages
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


CONV = "SELECT conv_id AS record_id, CAST(turn + 1 AS INT) AS page, text FROM conversations WHERE trim(text) <> ''"
FLAT = r"trim(regexp_replace(text, '\s+', ' ', 'g'))"


def conv_pages(spark, sf_dir):
    return conversation_pages(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


def doc_pages(spark, sf_dir):
    """Documents as pages: one record for each source."""
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return d.select(
        F.col("source").alias("record_id"), F.col("doc_id").cast("int").alias("page"), F.lit("t").alias("chunk_id"), "text"
    )


_LEGAL = "[" + ", ".join(f"'{w}'" for w in P.LEGAL_WORDS) + "]"


def _quality_sql(source: str, keys: str) -> str:
    return f"""
WITH t AS (SELECT {keys}, text, {FLAT} AS flat FROM {source}),
u AS (SELECT *, regexp_extract_all(flat, '[A-Za-z0-9.]+') AS toks, regexp_extract_all(flat, '[A-Za-z]{{2,}}') AS words FROM t),
c AS (SELECT *, len(toks) AS nt, len(words) AS nw, length(flat) AS n,
  len(list_filter(toks, lambda x: regexp_matches(x, '[A-Za-z]') AND regexp_matches(x, '[0-9]'))) AS mixed,
  len(list_filter(words, lambda x: regexp_matches(x, '[aeiouAEIOU]'))) AS vowel,
  len(list_filter(words, lambda x: list_contains({_LEGAL}, lower(x)))) AS legal,
  length(regexp_replace(flat, '[\\p{{L}}\\p{{N}}\\s.,:;/()\\[\\]&''"-]', '', 'g')) AS sym FROM u),
r AS (SELECT *, mixed / greatest(nt, 1) AS mr, vowel / greatest(nw, 1) AS vr,
  greatest(0.0, least(1.0, vowel / greatest(nw, 1) * 0.55 + legal / greatest(nw, 1) * 3.0 - mixed / greatest(nt, 1) * 0.9
    - sym / greatest(n, 1) * 0.8)) AS sc FROM c)
SELECT *, CASE WHEN n = 0 OR nt = 0 THEN 0.0 ELSE round_even(sc, 3) END AS score,
  n = 0 OR nt = 0 OR (n >= 80 AND (mr >= 0.18 OR (vr < 0.52 AND legal < 2) OR sc < 0.38)) AS unreliable FROM r"""


@query("b5_text_quality", f"SELECT doc_id, score, unreliable, legal AS legal_marker_hits FROM ({_quality_sql('documents', 'doc_id')})")
def b5(spark, sf_dir):
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return Q.text_quality(d).select("doc_id", "score", "unreliable", "legal_marker_hits")


_NEED = f"""SELECT record_id, count(*) AS page_count, count(*) FILTER (len < 80) AS sparse_count,
  count(*) FILTER (len >= 80 AND unreliable) AS unreliable_count, sum(len) AS total_text_chars, bool_or(len < 80 OR unreliable) AS needs_ocr
  FROM (SELECT *, length(regexp_replace(text, '^\\s+|\\s+$', '', 'g')) AS len FROM ({_quality_sql('(' + CONV + ')', 'record_id, page')})) GROUP BY record_id"""


@query("b6_sparse_pages", _NEED)
def b6(spark, sf_dir):
    return Q.record_ocr_need(conv_pages(spark, sf_dir)).drop("image_count")


@query(
    "b7_profiles",
    f"""SELECT record_id, CASE WHEN unreliable_count > 0 THEN 'ocr_required' WHEN total_text_chars = 0 THEN 'scanned'
      WHEN sparse_count / page_count >= 0.5 THEN 'mixed' WHEN sparse_count > 0 THEN 'low_text' ELSE 'digital' END AS profile_type FROM ({_NEED})""",
)
def b7(spark, sf_dir):
    return Q.profile_records(Q.record_ocr_need(conv_pages(spark, sf_dir))).select("record_id", "profile_type")


_ROLE_SQL = r"""CASE WHEN page <= 2 AND regexp_matches(flat, '\b(court|petition|appeal|versus|respondent|petitioner)\b') THEN 'case_header'
  WHEN regexp_matches(flat, '\b(judgment|order|reasons|analysis|held)\b') THEN 'judgment_body'
  WHEN regexp_matches(flat, '\b(annexure|memo|affidavit|schedule|appendix)\b') THEN 'attachment'
  WHEN regexp_matches(flat, '\b(directed|shall|within|disposed|allowed|dismissed|quashed)\b') THEN 'operative_order' ELSE 'unknown' END"""


@query("b8_page_roles", f"SELECT record_id, page, {_ROLE_SQL} AS page_role FROM (SELECT record_id, page, lower({FLAT}) AS flat FROM ({JUDGMENT_PAGES}))")
def b8(spark, sf_dir):
    return Q.classify_page_role(judgment_pages(spark, sf_dir)).select("record_id", "page", "page_role")


@query(
    "f4_page_role_counts",
    f"SELECT record_id, {_ROLE_SQL} AS page_role, count(*) AS pages FROM (SELECT record_id, page, lower({FLAT}) AS flat FROM ({JUDGMENT_PAGES})) GROUP BY ALL",
)
def f4(spark, sf_dir):
    return Q.page_counts(Q.classify_page_role(judgment_pages(spark, sf_dir)), "page_role")


_WINDOWS = f"SELECT record_id, page, max(page) OVER (PARTITION BY record_id) AS n FROM ({CONV})"


@query(
    "b12_page_windows",
    f"""SELECT record_id, page, 'first_2' AS win FROM ({_WINDOWS}) WHERE page <= 2
    UNION ALL SELECT record_id, page, 'last_3' FROM ({_WINDOWS}) WHERE page > n - 3
    UNION ALL SELECT record_id, page, 'previous' FROM ({_WINDOWS}) WHERE n - 3 >= 1 AND page BETWEEN greatest(1, n - 5) AND n - 3""",
)
def b12(spark, sf_dir):
    p = conv_pages(spark, sf_dir)
    parts = [("first_2", R.first_pages(p, 2)), ("last_3", R.final_pages(p, 3)),
             ("previous", R.previous_pages(p, 3, 3).where("page_count > 3"))]
    out = None
    for name, df in parts:
        rows = df.select("record_id", "page", F.lit(name).alias("win"))
        out = rows if out is None else out.unionByName(rows)
    return out


@query(
    "b12_page_requests",
    """SELECT conv_id AS record_id, CASE conv_id % 4 WHEN 0 THEN 1 WHEN 1 THEN greatest(1, n - 2) WHEN 2 THEN least(3, n) ELSE least(2, n) END AS first_page,
      CASE conv_id % 4 WHEN 0 THEN least(2, n) WHEN 1 THEN n WHEN 2 THEN least(3, n) ELSE n END AS last_page
    FROM (SELECT conv_id, CAST(max(turn) + 1 AS INT) AS n FROM conversations GROUP BY conv_id)""",
)
def b12_requests(spark, sf_dir):
    n = X.last_pages(conv_pages(spark, sf_dir))
    spec = F.element_at(F.array(F.lit("first_2"), F.lit(" Last_3"), F.lit("page: 3"), F.lit("pages:40-2")), (F.col("record_id") % 4 + 1).cast("int"))
    s = R.parse_page_request(spec, F.col("page_count"))
    return n.select("record_id", s["first"].alias("first_page"), s["last"].alias("last_page"))


@query(
    "b13_attention_pages",
    f"""WITH p AS (SELECT record_id, page, regexp_matches(text, '(?i)\\b(?:judgment|order|coram|versus|petitioner|respondent|cji|j\\.)\\b') AS hit,
        max(page) OVER (PARTITION BY record_id) AS n FROM ({JUDGMENT_PAGES})),
      c AS (SELECT DISTINCT record_id, n, unnest([1, 2, 3]) AS page, unnest([0, 1, 2]) AS rank FROM p
        UNION ALL SELECT record_id, n, page, 1000 + page FROM p WHERE hit
        UNION ALL SELECT DISTINCT record_id, n, unnest([n - 1, n]), unnest([10000000, 10000001]) FROM p),
      f AS (SELECT record_id, page, min(rank) AS rank FROM c WHERE page > 0 AND page <= n GROUP BY record_id, page)
    SELECT record_id, page, row_number() OVER (PARTITION BY record_id ORDER BY rank) AS position FROM f""",
)
def b13(spark, sf_dir):
    p = judgment_pages(spark, sf_dir)
    prof = X.last_pages(p).withColumn("profile_type", F.lit("digital"))
    return R.attention_pages(p, prof).select("record_id", "page", "position")


@query(
    "b14_repair_pages",
    f"""SELECT record_id, page FROM (SELECT record_id, page, text, max(page) OVER (PARTITION BY record_id) AS n FROM ({JUDGMENT_PAGES}))
    WHERE n <= 12 OR page <= 2 OR page > n - 6 OR regexp_matches(text, '(?i)\\b(?:in\\s+the\\s+result|shall|within)\\b')""",
)
def b14(spark, sf_dir):
    return R.repair_pages(judgment_pages(spark, sf_dir), 12).select("record_id", "page")


# ---- search --------------------------------------------------------------------------


def _search_sql(pages: str, queries: str, k: int) -> str:
    """Reference scoring over ``pages(record_id, page, text)`` and ``queries(record_id, query_id, query)``."""
    return f"""
WITH pg AS (SELECT *, regexp_extract_all(lower(text), '[a-z0-9]+') AS toks FROM ({pages})),
n AS (SELECT record_id, count(*) AS n FROM pg GROUP BY record_id),
post AS (SELECT record_id, page, len(toks) AS dl, tok, count(*) AS tf FROM (SELECT record_id, page, toks, unnest(toks) AS tok FROM pg) GROUP BY ALL),
df AS (SELECT record_id, tok, ln((n + 1) / (count(*) + 0.5)) + 1 AS idf FROM post JOIN n USING (record_id) GROUP BY record_id, tok, n),
qt AS (SELECT record_id, query_id, tok, count(*) AS qn FROM (SELECT record_id, query_id, unnest(regexp_extract_all(lower(query), '[a-z0-9]+')) AS tok FROM ({queries})) GROUP BY ALL),
qs AS (SELECT record_id, query_id, count(*) AS m FROM qt GROUP BY ALL),
s AS (SELECT query_id, record_id, page, sum(qn * idf * (tf * 2.2) / (tf + 1.2 * (0.25 + 0.75 * dl / 120))) AS lex, count(*) AS sh
  FROM qt JOIN post USING (record_id, tok) JOIN df USING (record_id, tok) GROUP BY ALL),
f AS (SELECT record_id, query_id, page, lex, sh / m AS dense, regexp_matches(text, '(?i)\\b(?:directed|shall|within|compliance|appeal|report)\\b') AS legal, text
  FROM s JOIN qs USING (record_id, query_id) JOIN pg USING (record_id, page))
SELECT record_id, query_id, page, round_even(0.7 * lex + 0.3 * dense, 4) AS retrieval_score,
  round_even(0.7 * lex + 0.3 * dense + CASE WHEN legal THEN 0.25 ELSE 0 END, 4) AS rerank_score,
  CASE WHEN lex > dense * 1.5 THEN 'hybrid_lexical' WHEN dense > lex * 1.5 THEN 'hybrid_dense' ELSE 'hybrid_fused' END AS match_strategy, text
FROM f QUALIFY row_number() OVER (PARTITION BY record_id, query_id ORDER BY rerank_score DESC, page) <= {k}"""


@query(
    "i1_evidence_index",
    f"""WITH pg AS (SELECT record_id, page, regexp_extract_all(lower(text), '[a-z0-9]+') AS toks FROM ({CONV})),
      post AS (SELECT record_id, page, len(toks) AS dl, tok, count(*) AS tf FROM (SELECT *, unnest(toks) AS tok FROM pg) GROUP BY ALL),
      n AS (SELECT record_id, count(*) AS n FROM pg GROUP BY record_id)
    SELECT record_id, tok AS token, count(*) AS df, sum(tf) AS total_tf, round_even(max(ln((n + 1) / (dfc + 0.5)) + 1), 6) AS idf
    FROM (SELECT *, count(*) OVER (PARTITION BY record_id, tok) AS dfc FROM post) JOIN n USING (record_id) GROUP BY record_id, tok""",
)
def i1(spark, sf_dir):
    idx = R.evidence_index(conv_pages(spark, sf_dir))
    return idx.groupBy("record_id", "token").agg(F.max("df").alias("df"), F.sum("tf").alias("total_tf"), F.bround(F.max("idf"), 6).alias("idf"))


_CONV_QUERIES = "SELECT conv_id AS record_id, turn AS query_id, text AS query FROM conversations"
_OUT = "record_id, query_id, page, retrieval_score, rerank_score, match_strategy"


@query("i2_search", f"SELECT {_OUT} FROM ({_search_sql(CONV, _CONV_QUERIES, 3)})")
def i2(spark, sf_dir):
    c = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    qs = c.select(F.col("conv_id").alias("record_id"), F.col("turn").alias("query_id"), F.col("text").alias("query"))
    return R.search(conv_pages(spark, sf_dir), qs, 3, snippets=False).select(*_OUT.split(", "))


_BENCH_QUERIES = "SELECT concat('src', item_id % 20) AS record_id, item_id AS query_id, text AS query FROM benchmark"
_DOC_PAGES = "SELECT source AS record_id, CAST(doc_id AS INT) AS page, text FROM documents"


@query("i2_search_documents", f"SELECT {_OUT} FROM ({_search_sql(_DOC_PAGES, _BENCH_QUERIES, 5)})")
def i2_documents(spark, sf_dir):
    b = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    qs = b.select(F.concat(F.lit("src"), F.col("item_id") % 20).alias("record_id"), F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    return R.search(doc_pages(spark, sf_dir), qs, 5, snippets=False).select(*_OUT.split(", "))


_FIELD_TARGETS = f"""SELECT record_id, 'case_number' AS query_id, concat('Writ Petition No. ', record_id, ' of ', y) AS query FROM ({J_BASE})
  UNION ALL SELECT record_id, 'disposition', CASE st WHEN 'F' THEN 'petition is allowed' WHEN 'O' THEN 'petition is dismissed' ELSE 'partly allowed' END FROM ({J_BASE})"""


@query(
    "i3_tag_evidence",
    f"SELECT record_id, query_id AS target_id, page AS best_page, retrieval_score, rerank_score, match_strategy FROM ({_search_sql(JUDGMENT_PAGES, _FIELD_TARGETS, 1)})",
)
def i3(spark, sf_dir):
    pages = judgment_pages(spark, sf_dir)
    cands = settle(C.page_candidates(pages, ("case_number", "page_disposition"), evidence=True))
    rows = X.first_fields(cands, ("case_number",)).unionByName(X.page_dispositions(cands))
    targets = rows.select("record_id", F.col("field").alias("target_id"), F.col("raw_value").alias("raw_text"), F.lit("layered_field").alias("layer"))
    return R.tag_evidence(pages, targets).select("record_id", "target_id", "best_page", "retrieval_score", "rerank_score", "match_strategy")


_QTOK = "regexp_extract_all(lower(query), '[a-z0-9]+')"


@query(
    "i4_best_snippet",
    f"""WITH t AS (SELECT doc_id, {FLAT} AS flat, lang AS query FROM documents),
      s AS (SELECT *, list_min(list_filter(list_transform({_QTOK}, lambda q: strpos(lower(flat), q) - 1), lambda p: p >= 0)) AS p0 FROM t)
    SELECT doc_id, md5(CASE WHEN length(flat) <= 260 THEN flat ELSE trim(substr(flat, coalesce(greatest(p0 - 70, 0), 0) + 1, 260)) END) AS snippet_md5 FROM s""",
)
def i4(spark, sf_dir):
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return d.select("doc_id", F.md5(R.best_snippet(F.col("text"), F.col("lang"))).alias("snippet_md5"))


@query(
    "i5_research_context",
    f"""SELECT record_id, query_id AS purpose, count(DISTINCT snip) AS snippets, max(rerank_score) AS best FROM (
      SELECT *, {FLAT} AS snip FROM ({_search_sql(JUDGMENT_PAGES, "SELECT record_id, query_id, query FROM (" + J_BASE + "), (VALUES " + ", ".join(
        f"('{n}', '{q}')" for n, q in [*P.RESEARCH_QUERIES, ("directions", P.DIRECTIONS_QUERY), ("action_items", P.ACTIONS_QUERY)]) + ") v(query_id, query)", 3)}))
    GROUP BY ALL""",
)
def i5(spark, sf_dir):
    pages = judgment_pages(spark, sf_dir)
    spark_fields = pages.where("page = 1").select(
        "record_id", F.explode(F.array(*[F.lit(n) for n, _ in P.RESEARCH_QUERIES])).alias("field"), F.lit("known").alias("value"), F.lit(0.9).alias("confidence")
    )
    none = spark_fields.where("false").select("record_id", F.lit(0).alias("direction_index"), "confidence")
    qs = R.research_queries(pages.select("record_id"), spark_fields, none)
    ctx = R.research_context(pages, qs)
    return ctx.groupBy("record_id", "purpose").agg(F.count("*").alias("snippets"), F.max("rerank_score").alias("best"))


# the first turn asks in every third record, every other record asks for its last pages, the rest asks for nothing
_ASKED = "SELECT conv_id AS record_id, 0 AS query_id, text AS query FROM conversations WHERE turn = 0 AND conv_id % 3 = 0"
_BARE = f"SELECT DISTINCT record_id FROM ({CONV}) WHERE record_id % 2 = 1 AND record_id NOT IN (SELECT record_id FROM ({_search_sql(CONV, _ASKED, 3)}))"
_CUT = f"""CASE WHEN length(flat) <= 260 THEN flat ELSE trim(substr(flat, coalesce(greatest(list_min(list_filter(list_transform({_QTOK},
  lambda q: strpos(lower(flat), q) - 1), lambda p: p >= 0)) - 70, 0), 0) + 1, 260)) END"""


@query(
    "i6_context_assembly",
    f"""WITH c AS (SELECT record_id, page, {FLAT} AS flat, max(page) OVER (PARTITION BY record_id) AS n FROM ({CONV})),
      bare AS ({_BARE}),
      d AS (SELECT record_id, 0 AS query_id, '{P.CASE_DETAIL_QUERY}' AS query FROM bare),
      hits AS (SELECT s.record_id, page, 0 AS o, 'agentic_query' AS label, query FROM ({_search_sql(CONV, _ASKED, 3)}) s JOIN ({_ASKED}) q USING (record_id, query_id)
        UNION ALL SELECT s.record_id, page, 2, 'reranked_evidence', query FROM ({_search_sql(CONV, f"SELECT record_id, 0 AS query_id, '{P.CASE_DETAIL_QUERY}' AS query FROM (" + _BARE + ")", 6)}) s JOIN d USING (record_id)),
      every AS (SELECT record_id, page, o, label, {_CUT} AS said FROM hits JOIN c USING (record_id, page)
        UNION ALL SELECT record_id, page, 1, 'agentic_page_request', flat FROM c WHERE page > n - 3 AND record_id % 2 = 0
        UNION ALL SELECT record_id, page, 3, 'agentic_default_last_pages', flat FROM c JOIN bare USING (record_id) WHERE page > n - 3)
    SELECT record_id, page, label, md5(said) AS text_md5 FROM every QUALIFY row_number() OVER (PARTITION BY record_id, page, said ORDER BY o) = 1""",
)
def i6(spark, sf_dir):
    p = conv_pages(spark, sf_dir)
    ids = p.select("record_id").distinct()
    requests = ids.where("record_id % 2 = 0").select("record_id", F.lit(0).alias("request_no"), F.lit("last_3").alias("spec"))
    first = spark.read.parquet(f"{sf_dir}/conversations.parquet").where("turn = 0 AND conv_id % 3 = 0")
    queries = first.select(F.col("conv_id").alias("record_id"), F.lit(0).alias("query_no"), F.col("text").alias("query"))
    return R.context_assembly(p, queries, requests).select("record_id", "page", "label", F.md5("text").alias("text_md5"))


@query(
    "g8_dedupe_context",
    r"""SELECT source, count(*) AS kept, min(doc_id) AS first_doc FROM (SELECT source, doc_id FROM documents
      QUALIFY row_number() OVER (PARTITION BY source, lang, text ORDER BY doc_id) = 1) GROUP BY source""",
)
def g8(spark, sf_dir):
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").select(
        F.col("source").alias("record_id"), F.col("lang").alias("page"), F.lit(0).alias("chunk_id"), "text", "doc_id"
    )
    rows = R.dedupe_context(d, ["doc_id"])
    return rows.groupBy(F.col("record_id").alias("source")).agg(F.count("*").alias("kept"), F.min("doc_id").alias("first_doc"))


_STOP = "[" + ", ".join(f"'{w}'" for w in P.STOP_WORDS) + "]"


def _tset(col: str) -> str:
    return f"list_filter(list_distinct(regexp_extract_all(lower({col}), '[a-z0-9]+')), lambda t: NOT list_contains({_STOP}, t))"


@query(
    "e5_cite_evidence",
    f"""WITH q AS (SELECT concat('src', item_id % 20) AS record_id, item_id AS snippet_id, text AS q, {_tset('text')} AS qs FROM benchmark),
      p AS (SELECT source AS record_id, CAST(doc_id AS INT) AS page, text, {_tset('text')} AS ps FROM documents),
      s AS (SELECT q.record_id, snippet_id, page, CASE WHEN contains(lower(text), lower(q)) THEN 1.0
          WHEN len(qs) = 0 THEN 0.0 ELSE len(list_intersect(qs, ps)) / len(qs) END AS score FROM q JOIN p USING (record_id))
    SELECT record_id, snippet_id, page, round_even(score, 4) AS retrieval_score,
      round_even(CASE WHEN score >= 0.99 THEN 0.95 ELSE least(0.88, greatest(0.45, score)) END, 2) AS confidence
    FROM s WHERE score >= 0.45 QUALIFY row_number() OVER (PARTITION BY record_id, snippet_id ORDER BY score DESC, page) = 1""",
)
def e5(spark, sf_dir):
    b = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    sn = b.select(F.concat(F.lit("src"), F.col("item_id") % 20).alias("record_id"), F.col("item_id").alias("snippet_id"), F.col("text").alias("snippet"))
    return R.cite_evidence(sn, doc_pages(spark, sf_dir)).select("record_id", "snippet_id", "page", "retrieval_score", "confidence")


@query(
    "e6_supported_by_context",
    f"""WITH c AS (SELECT conv_id, turn, text, lower(regexp_replace(text, '^\\s+|\\s+$', '', 'g')) AS t, {_tset('text')} AS ts FROM conversations)
    SELECT a.conv_id AS record_id, a.turn AS request_id, bool_or(contains(b.t, a.t) OR contains(a.t, b.t) OR
      (len(a.ts) >= 4 AND len(b.ts) >= 4 AND len(list_intersect(a.ts, b.ts)) / len(a.ts) >= 0.55)) AS supported
    FROM c a JOIN c b ON a.conv_id = b.conv_id AND b.turn % 2 = 1 GROUP BY ALL""",
)
def e6(spark, sf_dir):
    c = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    sources = c.where("turn % 2 = 1").select(F.col("conv_id").alias("record_id"), T.strip_ws(F.col("text")).alias("source_snippet"))
    requests = c.select(F.col("conv_id").alias("record_id"), F.col("turn").alias("request_id"), F.col("text").alias("snippet")).join(
        sources.select("record_id"), "record_id", "left_semi"
    )
    return R.supported_by_context(requests, sources).select("record_id", "request_id", "supported")


@query(
    "c20_locate_snippet",
    f"""SELECT record_id, page, CASE WHEN kind = 0 THEN task ELSE concat('Counsel for ', rf, ' was heard at length') END AS snippet,
      CASE WHEN kind = 0 THEN position(task IN text) - 1 ELSE 0 END AS char_start, 'quad_search' AS match_strategy, 0.92 AS locator_confidence
    FROM (SELECT l.*, concat('The ', dept, ' shall file a compliance report') AS task FROM ({J_LINES}) l) JOIN ({JUDGMENT_PAGES}) USING (record_id, page)
    UNION ALL SELECT record_id, page, CASE page WHEN 1 THEN 'IN THE HIGH COURT OF' ELSE 'No order as to costs' END,
      CASE page WHEN 1 THEN 0 ELSE position('No order as to costs' IN text) - 1 END, 'quad_search', 0.92
    FROM ({JUDGMENT_PAGES}) WHERE page IN (1, 99)""",
)
def c20(spark, sf_dir):
    p = judgment_pages(spark, sf_dir)
    head = F.regexp_extract("text", r"^Counsel for \w was heard at length", 0)
    task = F.regexp_extract("text", r"The [A-Za-z ]+ shall file a compliance report", 0)
    rows = R.locate_quotes(p.withColumn("snippet", F.when(F.col("page") == 1, "IN THE HIGH COURT OF").when(F.col("page") == 99, "No order as to costs").when(task != "", task).otherwise(head)), windows=False)
    return rows.select("record_id", "page", "snippet", "char_start", "match_strategy", "locator_confidence")


@query(
    "c20_token_windows",
    f"""WITH q AS (SELECT p.record_id, p.page, dept LIKE '% % %' AS head, regexp_extract_all(lower(text), '[a-z0-9]+') AS w,
        regexp_extract_all(lower(concat('the ', dept, ' must then shall quickly file on a')), '[a-z0-9]+') AS g FROM ({JUDGMENT_PAGES}) p JOIN ({J_LINES}) USING (record_id, page)),
      z AS (SELECT *, least(greatest(len(g) + 5, 8), 36) AS hi, least(greatest(len(g) - 5, 4), hi) AS lo FROM q),
      s AS (SELECT list_max(list_transform(flatten(list_transform(range(len(w)), lambda i: list_transform(range(lo, least(hi, len(w) - i) + 1), lambda m: [i, m]))), lambda x:
        0.68 * len(list_intersect(list_distinct(w[x[1] + 1 : x[1] + x[2]]), g)) / len(list_distinct(g))
        + 0.32 * (1 - levenshtein(array_to_string(w[x[1] + 1 : x[1] + x[2]], ' '), array_to_string(g, ' ')) / greatest(length(array_to_string(w[x[1] + 1 : x[1] + x[2]], ' ')), length(array_to_string(g, ' ')))))) AS score, head FROM z)
    SELECT CASE WHEN head THEN 'quad_search' WHEN score >= 0.58 THEN 'word_window_fuzzy' ELSE 'unmatched' END AS match_strategy, count(*) AS quotes,
      max(CASE WHEN head THEN 0.92 WHEN score >= 0.58 THEN round_even(least(0.88, greatest(0.62, score)), 2) ELSE 0.35 END) AS best FROM s GROUP BY 1""",
)
def c20_windows(spark, sf_dir):
    """Quotes with every other word changed: only the token windows can find them."""
    p = judgment_pages(spark, sf_dir).where("page between 2 and 98")
    quote = F.concat(F.lit("the "), F.regexp_extract("text", r"record\. The ([A-Za-z ]+) (?:shall|is)", 1), F.lit(" must then shall quickly file on a"))
    rows = R.locate_quotes(p.withColumn("snippet", quote))
    return rows.groupBy("match_strategy").agg(F.count("*").alias("quotes"), F.max("locator_confidence").alias("best"))


@query(
    "c21_highlight_positions",
    f"""WITH e AS (SELECT record_id, page FROM ({J_LINES}) UNION ALL SELECT record_id, 99 FROM ({J_BASE}) WHERE st IN ('F', 'O')),
      d AS (SELECT record_id, page, row_number() OVER (PARTITION BY record_id ORDER BY page) AS ordinal FROM e)
    SELECT record_id, min(page) AS page, 'direction' AS type, concat('Direction', CASE WHEN min(ordinal) > 1 THEN concat(' ', min(ordinal)) ELSE '' END) AS label,
      concat('Direction', CASE WHEN min(ordinal) > 1 THEN concat(' ', min(ordinal)) ELSE '' END, ' | p. ', page, ' | deterministic | 0.90') AS source_label
    FROM d GROUP BY record_id, page""",
)
def c21(spark, sf_dir):
    cands = C.page_candidates(judgment_pages(spark, sf_dir), ["directions"])
    # page and place on the page as one number in reading order; 64 pages are a block
    ev = settle(cands.select(
        "record_id", F.lit("direction").alias("target_type"), (F.col("page") * F.lit(1 << 32) + F.col("pos")).alias("ordinal"), "evidence.page", "evidence.bbox",
        "evidence.snippet", "evidence.extraction_method", "evidence.source_quality", F.lit(None).cast("string").alias("match_strategy"),
        "evidence.confidence", "evidence.locator_confidence",
    ))
    return R.highlight_positions(ev, 64 << 32).select("record_id", "page", "type", "label", "source_label")


_WORDS = {name: "|".join(w.replace(".", "[.]") for w in words) for name, words in P.FIELD_KEYWORDS.items()}


@query(
    "i7_field_repair_context",
    f"SELECT record_id, 'court' AS field, 1 AS page, 'deterministic_evidence' AS label FROM ({J_BASE}) "
    + " ".join(f"UNION ALL SELECT record_id, '{name}', page, 'section:context' FROM ({JUDGMENT_PAGES}) WHERE regexp_matches(text, '(?i)(?:{words})')" for name, words in _WORDS.items()),
)
def i7(spark, sf_dir):
    """Every page is context for every field; the court's own quote is its line on the first page."""
    p = judgment_pages(spark, sf_dir)
    ctx = p.select("record_id", F.lit("section").alias("section"), F.col("page").alias("rank"), "page", "chunk_id", "text")
    line = F.regexp_extract("text", r"^(IN THE HIGH COURT OF [A-Z]+)", 1)
    ev = p.where(line != "").select("record_id", F.lit("court").alias("field"), F.lit(0).alias("ordinal"), "page", "chunk_id", line.alias("text"))
    return R.field_repair_context(ev, ctx).select("record_id", "field", "page", "label")


@query(
    "law_report_pages",
    f"SELECT record_id, v = 2 AS law_report FROM ({COURT_BASE})",
)
def law_reports(spark, sf_dir):
    return Q.is_law_report(court_pages(spark, sf_dir))
