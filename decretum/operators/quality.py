"""Text quality, sparse pages, record profiles and page roles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from decretum.functions import patterns as P
from decretum.functions import text as T

PLAIN_SYMBOLS = r"[.,:;/()\[\]&'\"-]"


# One match per token or word, found in one pass: a token is a run of letters, digits and dots, a word a run of two letters or more.
TOKEN = "[A-Za-z0-9.]+"
MIXED_TOKEN = "[.]*(?:[A-Za-z][A-Za-z.]*[0-9]|[0-9][0-9.]*[A-Za-z])[A-Za-z0-9.]*"
WORD = "[A-Za-z]{2,}"
VOWEL_WORD = "(?:[b-df-hj-np-tv-zB-DF-HJ-NP-TV-Z]+[aeiouAEIOU][A-Za-z]*|[aeiouAEIOU][A-Za-z]+)"


def text_quality_columns(text: Column) -> dict[str, Column]:
    """Counts behind the quality score of a text; none of them builds an array of its words."""
    flat = T.collapse_ws(F.coalesce(text, F.lit("")))
    legal = "(?<![A-Za-z])(?i:" + "|".join(P.LEGAL_WORDS) + ")(?![A-Za-z])"
    symbols = F.regexp_replace(flat, r"[\p{L}\p{N}]|(?U)\s|" + PLAIN_SYMBOLS, "")
    count = lambda pattern: F.regexp_count(flat, F.lit(pattern))
    return {
        "n_chars": F.length(flat),
        "n_tokens": count(TOKEN),
        "n_words": count(WORD),
        "n_mixed": count(MIXED_TOKEN),
        "n_vowel_words": count(VOWEL_WORD),
        "legal_marker_hits": count(legal),
        "n_symbols": F.length(symbols),
    }


def text_quality(pages: DataFrame) -> DataFrame:
    """Quality score in [0, 1] and an ``unreliable`` flag per page."""
    rows = pages.withColumns(text_quality_columns(F.col("text")))
    at_least_1 = lambda c: F.greatest(F.col(c), F.lit(1))
    mixed = F.col("n_mixed") / at_least_1("n_tokens")
    vowels = F.col("n_vowel_words") / at_least_1("n_words")
    legal = F.col("legal_marker_hits") / at_least_1("n_words")
    symbols = F.col("n_symbols") / at_least_1("n_chars")
    score = F.greatest(F.lit(0.0), F.least(F.lit(1.0), vowels * 0.55 + legal * 3.0 - mixed * 0.9 - symbols * 0.8))
    empty = (F.col("n_chars") == 0) | (F.col("n_tokens") == 0)
    rows = rows.withColumns({"_mixed": mixed, "_vowels": vowels, "_score": score})
    bad = (F.col("n_chars") >= 80) & (
        (F.col("_mixed") >= 0.18)
        | ((F.col("_vowels") < 0.52) & (F.col("legal_marker_hits") < 2))
        | (F.col("_score") < 0.38)
    )
    return rows.withColumns(
        {
            "score": F.when(empty, 0.0).otherwise(F.bround("_score", 3)),
            "unreliable": empty | bad,
            "mixed_alnum_ratio": F.when(~empty, F.bround("_mixed", 3)),
            "vowel_word_ratio": F.when(~empty, F.bround("_vowels", 3)),
        }
    ).drop("_mixed", "_vowels", "_score", "n_tokens", "n_words", "n_mixed", "n_vowel_words", "n_symbols", "n_chars")


def sparse_pages(pages: DataFrame, min_chars: int = 80) -> DataFrame:
    """Page flags: too little text, or text that cannot be trusted."""
    rows = text_quality(pages)
    chars = F.length(T.strip_ws(F.coalesce("text", F.lit(""))))
    images = F.coalesce(F.col("has_images"), F.lit(False)) if "has_images" in pages.columns else F.lit(False)
    sparse = chars < min_chars
    return rows.withColumns(
        {
            "text_chars": chars,
            "is_sparse": sparse,
            "is_unreliable": ~sparse & (F.col("unreliable") | (images & (F.col("score") < 0.5))),
            "is_image": images,
        }
    )


def record_ocr_need(pages: DataFrame, min_chars: int = 80) -> DataFrame:
    """Counts of sparse and unreliable pages per record and whether it needs OCR."""
    rows = sparse_pages(pages, min_chars)
    return rows.groupBy("record_id").agg(
        F.count("*").alias("page_count"),
        F.count_if("is_sparse").alias("sparse_count"),
        F.count_if("is_unreliable").alias("unreliable_count"),
        F.count_if("is_image").alias("image_count"),
        F.sum("text_chars").alias("total_text_chars"),
        F.bool_or(F.col("is_sparse") | F.col("is_unreliable")).alias("needs_ocr"),
    )


def profile_records(need: DataFrame) -> DataFrame:
    """Profile type of each record from its page counts."""
    ratio = F.when(F.col("page_count") > 0, F.col("sparse_count") / F.col("page_count")).otherwise(1.0)
    kind = (
        F.when(F.col("unreliable_count") > 0, "ocr_required")
        .when(F.col("total_text_chars") == 0, "scanned")
        .when(ratio >= 0.5, "mixed")
        .when(F.col("sparse_count") > 0, "low_text")
        .otherwise("digital")
    )
    return need.withColumns(
        {"profile_type": kind, "source_quality": F.when(kind == "digital", "text").otherwise("mixed"), "ocr_used": F.lit(False)}
    )


def page_role(text: Column, page: Column) -> Column:
    """Role of a page by its words; headers only on the first two pages."""
    flat = T.collapse_ws(F.lower(F.coalesce(text, F.lit(""))))
    chain = None
    for name, pattern in P.PAGE_ROLES:
        hit = T.matches(flat, pattern) & ((page <= 2) if name == "case_header" else F.lit(True))
        chain = F.when(hit, name) if chain is None else chain.when(hit, name)
    return chain.otherwise("unknown")


def classify_page_role(pages: DataFrame) -> DataFrame:
    return pages.withColumn("page_role", page_role(F.col("text"), F.col("page")))


def page_counts(pages: DataFrame, column: str) -> DataFrame:
    """Pages per record and value of ``column`` (role or extraction method)."""
    value = F.coalesce(F.col(column), F.lit("unknown"))
    return pages.groupBy("record_id", value.alias(column)).agg(F.count("*").alias("pages"))


def is_law_report(pages: DataFrame) -> DataFrame:
    """Records whose first three pages are in law-report style."""
    from pyspark.sql import Window

    order = Window.partitionBy("record_id").orderBy("page", "chunk_id")
    styled = pages.select("record_id", "page", "chunk_id", T.matches(F.col("text"), P.LAW_REPORT_STYLE).alias("styled"))
    first = styled.withColumn("n", F.row_number().over(order)).where("n <= 3")
    return first.groupBy("record_id").agg(F.bool_or("styled").alias("law_report"))
