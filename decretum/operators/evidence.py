"""Source evidence: snippet, offsets and quality of a match on its page."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from decretum.functions import text as T

SNIPPET_WINDOW = 120
MARGIN = SNIPPET_WINDOW // 3

PAGE_DEFAULTS = {
    "source": "string",
    "chunk_id": "string",
    "original_file_name": "string",
    "extraction_method": "string",
    "source_quality": "string",
    "page_role": "string",
    "approx_bbox": "array<double>",
    "ocr_used": "boolean",
    "locator_confidence": "double",
}


def with_page_defaults(pages: DataFrame) -> DataFrame:
    """Add the optional page columns that are absent, as nulls."""
    missing = {c: F.lit(None).cast(t) for c, t in PAGE_DEFAULTS.items() if c not in pages.columns}
    return pages.withColumns(missing) if missing else pages


def snippet_of(flat: Column, match: Column) -> Column:
    """Match with 40 characters on both sides, or the head of the page when absent."""
    needle = T.collapse_ws(match)

    def cut(at: Column) -> Column:
        start = F.greatest(at - MARGIN, F.lit(0))
        end = F.least(F.length(flat), at + F.length(needle) + MARGIN)
        found = match.isNotNull() & (match != "") & (at >= 0)
        return F.when(found, flat.substr(start + 1, end - start)).otherwise(F.substring(flat, 1, SNIPPET_WINDOW))

    return T.let(T.find(F.lower(flat), F.lower(needle)), cut)


def span_of(text: Column, flat: Column, match: Column) -> Column:
    """Zero-based start and end in the raw text, else in the collapsed text, else nulls."""

    def in_raw(at: Column) -> Column:
        flat_at = T.find(F.lower(flat), F.lower(T.collapse_ws(match)))

        def in_flat(fat: Column) -> Column:
            start = F.when(match != "", F.when(at >= 0, at).when(fat >= 0, fat))
            size = F.when(at >= 0, F.length(match)).otherwise(F.length(T.collapse_ws(match)))
            return F.struct(start.cast("int").alias("start"), (start + size).cast("int").alias("end"))

        return T.let(F.when(at < 0, flat_at), in_flat)

    return T.let(T.find(F.lower(text), F.lower(match)), in_raw)


def evidence_struct(
    match: Column, confidence: Column, *, text: Column, flat: Column, method: str = "deterministic"
) -> Column:
    """Evidence of one match; page attributes come from the current row."""
    has_box = F.size(F.col("approx_bbox")) == 4
    is_ocr = F.coalesce(F.col("ocr_used"), F.lit(False))
    def build(span: Column) -> Column:
        return F.struct(
            F.coalesce(F.col("source"), F.lit("unknown")).alias("source_id"),
            F.col("page").cast("int").alias("page"),
            F.col("chunk_id").cast("string").alias("chunk_id"),
            snippet_of(flat, match).alias("snippet"),
            confidence.cast("double").alias("confidence"),
            F.lit(method).alias("extraction_method"),
            F.when(has_box, F.col("approx_bbox")).alias("bbox"),
            F.coalesce(F.col("locator_confidence"), F.when(has_box, 0.85).when(is_ocr, 0.35)).alias("locator_confidence"),
            span["start"].alias("char_start"),
            span["end"].alias("char_end"),
            F.coalesce(F.col("source_quality"), F.when(is_ocr, "ocr").otherwise("text")).alias("source_quality"),
        )

    return T.let(span_of(text, flat, match), build)


def normalize_evidence(pages: DataFrame, match_column: str, confidence: float = 0.9) -> DataFrame:
    """Evidence columns for rows that carry a page text and the text matched on it."""
    rows = with_page_defaults(pages).withColumn("_flat", T.collapse_ws(F.coalesce("text", F.lit(""))))
    ev = evidence_struct(F.col(match_column), F.lit(confidence), text=F.col("text"), flat=F.col("_flat"))
    return rows.withColumn("evidence", ev).drop("_flat")
