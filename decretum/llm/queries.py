"""Registered queries of the operators, with production parameters, and their reference SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from decretum.llm.byte_net import quality_scores, train_quality_net
from decretum.llm.exact_dedup import exact_dedup
from decretum.llm.filter_audit import filter_audit
from decretum.llm.line_dedup import line_dedup
from decretum.llm.mixing import LEVELS, mix
from decretum.llm.packing import pack
from decretum.llm.passage_dedup import remove_passages
from decretum.llm.quality_rules import COUNTS, apply_rules, train_rules
from decretum.llm.simhash import simhash_components
from decretum.llm.substring_dedup import remove_repeats
from decretum.llm.token_alignment import align_tokenizers
from decretum.llm.toxicity import toxicity_scores, train_toxicity
from decretum.llm.warc import read_bundles, warc_folder, write_bundles

#: Target weights of the mixture: domains, languages; sources of a language count alike.
MIX_WEIGHTS = {"domain": {"d0": 40, "d1": 30, "d2": 20, "d3": 10}, "lang": {"en": 60, "de": 15, "fr": 15, "es": 10, "*": 5}, "source": {}}
MIX_EPOCHS = 2
MIX_SEED = 42
#: Set from the shares of repeated lines over the whole sample (README); lines below it are on fewer than six of 500 pages.
LINE_RATIO = 0.01
LINE_MIN_PAGES = 3


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = apply_rules(docs.select("doc_id", "text"), train_rules(docs, table(spark, sf_dir, "labels")))
    return found.select("doc_id", *COUNTS, "base_failed", "kept", "quality_score")


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), tokenizer_path())


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality_scores(docs, train_quality_net(docs, table(spark, sf_dir, "labels")))


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = write_bundles(table(spark, sf_dir, "pages"), warc_folder(spark))
    return read_bundles(index).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op6_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"))


def op7_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_components(table(spark, sf_dir, "documents"))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_dedup(table(spark, sf_dir, "documents"), "source", "text", LINE_RATIO, LINE_MIN_PAGES)
    return found.select("doc_id", "source", "n_lines", "n_lines_removed", F.sha2("text", 256).alias("kept_sha256"))


def mix_domain():
    """A document's domain: its source's number decides."""
    number = F.regexp_extract("source", "[0-9]+", 0)
    return F.concat(F.lit("d"), F.pmod(F.when(number != "", number.cast("int")), F.lit(4)).cast("string"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = mix(table(spark, sf_dir, "documents"), MIX_WEIGHTS, None, MIX_EPOCHS, MIX_SEED, mix_domain())
    return found.select("doc_id", *[F.col(f"mix_{x}").alias(x) for x in LEVELS], F.col("mix_tokens").alias("n_tokens"), F.col("mix_copies").alias("copies"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity_scores(docs, train_toxicity(docs, table(spark, sf_dir, "labels")))


def op11_filter_interaction_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_passages(table(spark, sf_dir, "documents"))


def op13_cross_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align_tokenizers(table(spark, sf_dir, "documents"), tokenizer_path(), tokenizer_path("piece_bpe_32k.model"))


EXACT_SQL = r"""
WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY norm) AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size,
  row_number() OVER (PARTITION BY norm ORDER BY doc_id NULLS LAST) = 1 AS kept, sha256(norm) AS text_sha256
FROM n
"""


WARC_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS hex,
  max(page_id) OVER (PARTITION BY coalesce(html, '')) AS top,
  row_number() OVER (PARTITION BY coalesce(html, '') ORDER BY page_id DESC NULLS LAST) = 1 AS leads FROM pages)
SELECT page_id, CAST(octet_length(encode(html)) AS BIGINT) AS payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(
    ((CAST('0x' || substr(hex, CAST(5 * (i // 4) + 1 AS BIGINT), 5) AS BIGINT) >> (15 - 5 * (i % 4))) & 31) + 1 AS BIGINT), 1)), '') AS payload_digest,
  CASE WHEN leads THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN leads THEN NULL ELSE top END AS refers_to FROM p
"""


def line_sql(docs: str, ratio: float = LINE_RATIO, min_pages: int = LINE_MIN_PAGES) -> str:
    """CTEs that end in ``lined``: the rows of ``docs`` with their lines ``ls`` and kept lines ``kept``."""
    return rf"""
line_pages AS (SELECT source, count(*) AS pages FROM {docs} GROUP BY source),
line_rows AS (SELECT source, unnest(list_distinct(string_split(text, chr(10)))) AS line FROM {docs}),
line_counts AS (SELECT source, line, count(*) AS n FROM line_rows WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY source, line),
line_cut AS (SELECT c.source, list(line) AS cut FROM line_counts c JOIN line_pages p ON c.source IS NOT DISTINCT FROM p.source
  WHERE n >= {min_pages} AND n > pages * CAST({ratio} AS DOUBLE) GROUP BY c.source),
lined AS (SELECT d.*, string_split(text, chr(10)) AS ls,
  list_filter(string_split(text, chr(10)), lambda x: cut IS NULL OR NOT list_contains(cut, x)) AS kept
  FROM {docs} d LEFT JOIN line_cut k ON d.source IS NOT DISTINCT FROM k.source)"""


LINE_SQL = f"""
WITH {line_sql("documents")}
SELECT doc_id, source, coalesce(len(ls), 0) AS n_lines, coalesce(len(ls) - len(kept), 0) AS n_lines_removed,
  sha256(array_to_string(kept, chr(10))) AS kept_sha256 FROM lined
"""


def _share_sql(out: str, source: str, parents: str, level: str, weights: dict[str, int]) -> str:
    cases = " ".join(f"WHEN '{k}' THEN {w}" for k, w in weights.items() if k != "*")
    weight = f"CASE {level} {cases} ELSE {weights.get('*', 1)} END" if cases else str(weights.get("*", 1))
    order = f"PARTITION BY {parents} ORDER BY CAST(cap AS DOUBLE) / CAST(greatest(w, 1) AS DOUBLE), {level}"
    return f"""
{out}_w AS (SELECT *, CAST({weight} AS HUGEINT) AS w FROM {source}),
{out}_c AS (SELECT *, CAST(CASE WHEN w > 0 THEN capacity ELSE 0 END AS HUGEINT) AS cap FROM {out}_w),
{out}_o AS (SELECT *, coalesce(sum(cap) OVER ({order} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS taken,
  sum(w) OVER ({order} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS w_left FROM {out}_c),
{out}_f AS (SELECT *, cap * w_left <= w * (budget - taken) AS filled FROM {out}_o),
{out}_s AS (SELECT *, coalesce(sum(CASE WHEN filled THEN cap END) OVER (PARTITION BY {parents}), 0) AS spent,
  sum(CASE WHEN NOT filled THEN w END) OVER (PARTITION BY {parents}) AS w_over FROM {out}_f),
{out} AS (SELECT * EXCLUDE (budget, capacity, w, cap, taken, w_left, filled, spent, w_over),
  CAST(CASE WHEN filled THEN cap ELSE (w * (budget - spent)) // w_over END AS BIGINT) AS budget FROM {out}_s)"""


def mix_sql(docs: str, weights: dict = MIX_WEIGHTS, epochs: int = MIX_EPOCHS, seed: int = MIX_SEED) -> str:
    """CTEs that end in ``mixed``: the rows of ``docs`` with ``mix_domain, mix_lang, mix_source, tokens, copies``."""
    return rf"""
mix_docs AS (SELECT *, coalesce('d' || CAST(CAST(nullif(regexp_extract(source, '[0-9]+'), '') AS INT) % 4 AS VARCHAR), '') AS mix_domain,
  coalesce(lang, '') AS mix_lang, coalesce(source, '') AS mix_source,
  coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS tokens FROM {docs}),
mix_leaves AS (SELECT mix_domain, mix_lang, mix_source, CAST(sum(tokens) AS BIGINT) AS tokens, CAST({epochs} * sum(tokens) AS BIGINT) AS capacity
  FROM mix_docs GROUP BY ALL),
mix_d0 AS (SELECT 0 AS root, mix_domain, sum(capacity) AS capacity, (SELECT sum(tokens) FROM mix_leaves) AS budget FROM mix_leaves GROUP BY mix_domain),
{_share_sql("mix_d", "mix_d0", "root", "mix_domain", weights["domain"])},
mix_l0 AS (SELECT l.mix_domain, mix_lang, sum(capacity) AS capacity, any_value(budget) AS budget
  FROM mix_leaves l JOIN mix_d d ON l.mix_domain = d.mix_domain GROUP BY l.mix_domain, mix_lang),
{_share_sql("mix_l", "mix_l0", "mix_domain", "mix_lang", weights["lang"])},
mix_s0 AS (SELECT s.*, budget FROM mix_leaves s JOIN mix_l l ON s.mix_domain = l.mix_domain AND s.mix_lang = l.mix_lang),
{_share_sql("mix_s", "mix_s0", "mix_domain, mix_lang", "mix_source", weights["source"])},
mix_plan AS (SELECT mix_domain, mix_lang, mix_source, CASE WHEN tokens > 0 THEN budget // tokens ELSE 0 END AS epochs,
  budget - tokens * CASE WHEN tokens > 0 THEN budget // tokens ELSE 0 END AS rest FROM mix_s),
mix_placed AS (SELECT d.*, epochs, rest, md5('{seed}:' || CAST(epochs AS VARCHAR) || ':' || coalesce(CAST(doc_id AS VARCHAR), 'null')) AS place
  FROM mix_docs d JOIN mix_plan p ON d.mix_domain = p.mix_domain AND d.mix_lang = p.mix_lang AND d.mix_source = p.mix_source),
mixed AS (SELECT * EXCLUDE (epochs, rest, place), CAST(epochs + CASE WHEN rest > 0 AND
  sum(tokens) OVER (PARTITION BY mix_domain, mix_lang, mix_source ORDER BY place RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) <= rest
  THEN 1 ELSE 0 END AS INT) AS copies FROM mix_placed)"""


MIX_SQL = f"""
WITH {mix_sql("documents")}
SELECT doc_id, mix_domain AS domain, mix_lang AS lang, mix_source AS source, tokens AS n_tokens, copies FROM mixed
"""

AUDIT_SQL = r"""
WITH RECURSIVE texts AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t,
  regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
marks AS (SELECT doc_id, max(CAST(quality = 1 AS INT)) AS good, max(CAST(toxic = 1 AS INT)) AS toxic FROM labels GROUP BY doc_id),
fails AS (SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
  CAST(len(w) < 200 AS INT) + 2 * CAST(100 * len(list_distinct(w)) < 50 * len(w) AS INT)
  + 4 * CAST(100 * (length(t) - length(translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', ''))) > 2 * length(t) AS INT)
  + 8 * CAST(length(translate(t, '#$%&*|', '')) < length(t) AS INT)
  + 16 * CAST(coalesce(texts.doc_id > min(texts.doc_id) OVER (PARTITION BY t), FALSE) AS INT) AS mask
  FROM texts LEFT JOIN marks ON texts.doc_id = marks.doc_id),
cells AS (SELECT part, mask, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM fails GROUP BY part, mask),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS letter, unnest([1, 2, 4, 8, 16]) AS bit),
prefixes AS (SELECT '' AS prefix, '' AS letter, 0 AS step, 0 AS before, 0 AS bit
  UNION ALL SELECT prefix || l.letter, l.letter, step + 1, before + p.bit, l.bit FROM prefixes p JOIN letters l ON NOT contains(prefix, l.letter)),
steps AS (SELECT part, prefix, letter, step,
  sum(CASE WHEN mask & (before + bit) = 0 THEN n ELSE 0 END) AS kept,
  sum(CASE WHEN mask & bit != 0 AND mask & before = 0 THEN n ELSE 0 END) AS removed,
  sum(CASE WHEN mask & bit != 0 AND mask & before != 0 THEN n ELSE 0 END) AS redundant,
  sum(CASE WHEN mask = bit THEN n ELSE 0 END) AS unique_fails,
  sum(CASE WHEN mask & bit != 0 AND mask & before = 0 THEN good ELSE 0 END) AS good_lost,
  sum(CASE WHEN mask & bit != 0 AND mask & before = 0 THEN toxic ELSE 0 END) AS toxic_lost
  FROM cells CROSS JOIN prefixes WHERE step > 0 GROUP BY part, prefix, letter, step),
found AS (SELECT o.part, o.prefix AS filter_order, s.* EXCLUDE (part, prefix) FROM steps o
  JOIN steps s ON o.part = s.part AND starts_with(o.prefix, s.prefix) WHERE o.step = 5)
SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
  CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
  CAST(sum(removed) OVER (PARTITION BY part, letter) AS BIGINT) AS shapley FROM found
"""

QUERIES = {f.__name__: f for f in (op1_quality_rules, op2_best_fit_packing, op3_quality_classifier, op4_exact_dedup, op5_warc, op6_suffix_array_dedup, op7_simhash_near_dedup, op8_line_dedup, op9_mixing, op10_toxicity, op11_filter_interaction_audit, op12_substring_dedup, op13_cross_tokenizer_alignment)}
ORACLES = {"op4_exact_dedup": EXACT_SQL, "op5_warc": WARC_SQL, "op8_line_dedup": LINE_SQL, "op9_mixing": MIX_SQL, "op11_filter_interaction_audit": AUDIT_SQL}
