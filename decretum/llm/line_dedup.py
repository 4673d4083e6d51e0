"""Line dedup by site-relative frequency, with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from decretum.llm.common import WORD, settle

#: Line digests, and sites that have any, whose lists may be broadcast (16 bytes a digest); beyond that the join shuffles.
BROADCAST_LINES, BROADCAST_SITES = 500_000, 50_000


def _lines(text: Column) -> Column:
    return F.split(text, "\n")


def boilerplate_lines(pages: DataFrame, site_col: str, text_col: str, ratio: float, min_pages: int) -> DataFrame:
    """``site, keys``: digests of the lines on more than ``ratio`` of a site's pages and on ``min_pages`` at least.

    A line counts once per page, blank lines never. A site has at most (mean lines
    per page) / ``ratio`` such lines, whatever its number of pages.
    """
    rows = pages.select(F.col(site_col).alias("site"), F.col(text_col).alias("text"))
    totals = rows.groupBy("site").agg(F.count(F.lit(1)).alias("pages"))
    lines = rows.select("site", F.explode(F.array_distinct(_lines(F.col("text")))).alias("line")).where(F.col("line").rlike(WORD))
    counts = lines.groupBy("site", F.unhex(F.md5("line")).alias("key")).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_pages)
    frequent = counts.alias("c").join(totals.alias("t"), F.col("c.site").eqNullSafe(F.col("t.site"))).where(F.col("n") > F.col("pages") * F.lit(ratio))
    return frequent.groupBy("c.site").agg(F.collect_list("key").alias("keys"))


def line_dedup(pages: DataFrame, site_col: str = "source", text_col: str = "text", ratio: float = 0.1, min_pages: int = 3) -> DataFrame:
    """The pages with their site's boilerplate lines cut from ``text_col``; adds ``n_lines`` and ``n_lines_removed``.

    For each site, the pages that contain a line are divided by the site's pages;
    lines above ``ratio`` go. The texts are not shuffled: only digests of lines
    are counted, and the few lines of each site are joined to the pages.

    A null text stays null with zero lines, an empty text has one (blank) line,
    blank lines always stay, a text of boilerplate alone becomes empty; pages without
    a site form one site; repeated rows count as pages of their own; an empty table
    gives an empty result. Other columns stay (those named as the two new ones are
    replaced).
    """
    found = settle(boilerplate_lines(pages, site_col, text_col, ratio, min_pages))
    size = found.agg(F.coalesce(F.sum(F.size("keys")), F.lit(0)).alias("lines"), F.count(F.lit(1)).alias("sites")).first()
    cut = found.select(F.col("site").alias("_site"), F.col("keys").alias("_keys"))
    cut = F.broadcast(cut) if size["lines"] <= BROADCAST_LINES and size["sites"] <= BROADCAST_SITES else cut
    joined = pages.drop("n_lines", "n_lines_removed").join(cut, F.col(site_col).eqNullSafe(F.col("_site")), "left").drop("_site")
    # a page's digests are looked up together; only the few that are found are compared line by line
    digests = F.transform(_lines(F.col(text_col)), lambda line: F.unhex(F.md5(line)))
    joined = joined.withColumn("_hits", F.when(F.col("_keys").isNotNull(), F.array_intersect(digests, F.col("_keys")))).drop("_keys")
    kept = F.filter(_lines(F.col(text_col)), lambda line: ~F.array_contains(F.col("_hits"), F.unhex(F.md5(line))))
    joined = joined.withColumn("_kept", F.when(F.coalesce(F.size("_hits"), F.lit(0)) < 1, _lines(F.col(text_col))).otherwise(kept))
    size = F.coalesce(F.size(_lines(F.col(text_col))), F.lit(0))
    out = joined.withColumn("n_lines", F.when(F.col(text_col).isNull(), 0).otherwise(size).cast("long"))
    out = out.withColumn("n_lines_removed", F.when(F.col(text_col).isNull(), 0).otherwise(F.col("n_lines") - F.size("_kept")).cast("long"))
    text = F.when(F.col("n_lines_removed") > 0, F.array_join("_kept", "\n")).otherwise(F.col(text_col))
    return out.withColumn(text_col, text).drop("_hits", "_kept")
