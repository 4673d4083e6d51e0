"""The corpus pipeline: five stages from documents to packed sequences.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame, which is written as
Parquet and reread as the next one's ``docs``; all but the last one return the
columns of ``docs``. Columns beyond ``doc_id, text, lang, source, n_chars`` pass through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from decretum.llm.common import settle
from decretum.llm.line_dedup import line_dedup
from decretum.llm.mixing import mix, take_copies
from decretum.llm.near_copies import near_copies, text_digest
from decretum.llm.packing import pack
from decretum.llm.quality_rules import apply_rules, train_rules
from decretum.llm.queries import LINE_MIN_PAGES, LINE_RATIO, MIX_EPOCHS, MIX_SEED, MIX_WEIGHTS, mix_domain, table, tokenizer_path

SHINGLE = 5
SIMILARITY = 0.8


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that the rules reject; null, empty and very short texts are rejected.

    The trees learn from the labelled documents among ``docs``; without two classes only
    the base rules reject. Repeated rows are judged each; an empty table stays empty.
    """
    forest = train_rules(docs, table(spark, sf_dir, "labels"))
    # through a struct, so that columns of the documents may have the names of the new ones
    rows = docs.select(F.struct("*").alias("doc"), F.col("text").alias("_text"))
    return apply_rules(rows, forest, text_col="_text").where("kept").select("doc.*")


def boilerplate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut each source's boilerplate lines out of the texts; no document goes.

    ``n_chars`` follows the text where lines were cut. Null texts stay null, a null source is a
    source of its own, a text of boilerplate alone becomes empty.
    """
    rows = docs.select(F.struct("*").alias("doc"), F.col("text").alias("_text"), F.col("source").alias("_source"))
    cut = line_dedup(rows, "_source", "_text", LINE_RATIO, LINE_MIN_PAGES)
    columns = [F.col(f"doc.{c}").alias(c) for c in docs.columns]
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        n = F.when(F.col("n_lines_removed") > 0, F.length("_text").cast(kind)).otherwise(F.col("doc.n_chars"))
        columns[docs.columns.index("n_chars")] = n.alias("n_chars")
    columns[docs.columns.index("text")] = F.col("_text").alias("text")
    return cut.select(*columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies keep the document with the smallest id.

    Near copies share 0.8 of their shingles of five words (exact Jaccard similarity; SimHash within
    two bits, as the operator has it, is too narrow for that). A row goes only if its own group keeps another: rows of
    one id and different texts are judged each, equal rows are one. Documents without an id cannot be named by
    others: they are judged among themselves, and of each group the row with the smallest digest stays. Null and empty
    texts form one group.
    """
    unnamed = docs.where("doc_id IS NULL")
    stay = _first_of_groups(docs.where("doc_id IS NOT NULL"), F.col("doc_id"))
    # a scan of the ids tells whether a second search is needed at all
    return stay if unnamed.isEmpty() else stay.union(_first_of_groups(unnamed, F.lit(0)))


def _first_of_groups(docs: DataFrame, key: Column) -> DataFrame:
    rows = docs.select(F.struct("*").alias("doc"), key.alias("_id"), F.col("text").alias("_text"))
    kept = near_copies(rows, SHINGLE, SIMILARITY, "_id", "_text").select(F.col("id").alias("_kept"), F.col("digest").alias("_digest"))
    first = F.row_number().over(Window.partitionBy("_kept", "_digest").orderBy("_text"))
    met = (F.col("_id") == F.col("_kept")) & (text_digest(F.col("_text")) == F.col("_digest"))
    return rows.join(kept, met).withColumn("_first", first).where("_first = 1").select("doc.*")


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bring sources to their target weights: a row per document and copy.

    The budget is as many tokens as ``docs`` has. Null languages and sources count as ''; documents
    without tokens come with their leaf's whole epochs and prefix.
    """
    rows = docs.select(F.struct("*").alias("doc"), "doc_id", "text", "lang", "source")
    return take_copies(mix(rows, MIX_WEIGHTS, None, MIX_EPOCHS, MIX_SEED, mix_domain())).select("doc.*")


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack all documents into sequences of 1024 tokens: a row per piece; copies are packed each, null texts as empty."""
    return pack(docs, tokenizer_path())


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", boilerplate),
    ("simhash near-dedup", near_dedup),
    ("mixing", mixture),
    ("best-fit packing", packing),
]

#: Trees, fingerprints and token ids cannot be expressed in SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, each one's result written and reread."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)


QUERIES = {"pipeline": run}
ORACLES = {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
