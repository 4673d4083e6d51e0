"""What each filter of a chain removes, in every order of the filters."""

from __future__ import annotations

from math import factorial

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from decretum.llm.common import SPACES, settle

#: The filter that drops later copies; the others are decided by a text's own content.
COPIES = "E"
#: Recursive queries return so many rows at most; lifted while the steps are written, a part has 326 at any size.
ROW_LIMIT = "spark.sql.cteRecursionRowLimit"


def failure_conditions(text: Column) -> dict[str, Column]:
    """The conditions that a text's own content decides, by their letters."""
    inner = F.regexp_replace(text, rf"^{SPACES}|{SPACES}$", "")
    words = F.when(inner != "", F.split(inner, SPACES)).otherwise(F.array().cast("array<string>"))
    capitals = F.length(text) - F.length(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))
    return {
        "A": F.size(words) < 200,
        "B": 100 * F.size(F.array_distinct(words)) < 50 * F.size(words),
        "C": 100 * capitals > 2 * F.length(text),
        "D": F.length(F.translate(text, "#$%&*|", "")) < F.length(text),
    }


def mask_cells(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """``part, mask, n, good, toxic``: each part's documents by the set of filters they fail.

    Bit i of the mask is the i-th of ``failure_conditions``, the bit after them is ``COPIES``:
    a smaller id has the same text (SHA-256) anywhere in the table. Rows that agree in all that matters are counted before
    they move, so a text, id or part with a third of all rows moves as a few counts.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), text.alias("text"))
    own = list(failure_conditions(F.col("text")).values())
    bits = sum((F.when(c, 1 << i).otherwise(0) for i, c in enumerate(own)), F.lit(0))
    rows = rows.select("id", "part", bits.alias("own"), F.sha2("text", 256).alias("digest"))
    rows = rows.groupBy("id", "part", "own", "digest").agg(F.count(F.lit(1)).alias("n"))

    marks = [F.max((F.col(c) == 1).cast("int")).alias(name) for c, name in (("quality", "q"), ("toxic", "t"))]
    known = labels.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(*marks)
    rows = rows.join(known, "id", "left").fillna(0, ["q", "t"])
    named = F.when(F.col("id").isNotNull(), F.col("n"))
    kinds = rows.groupBy("digest", "part", "own", "q", "t").agg(
        F.sum("n").alias("n"), F.coalesce(F.sum(named), F.lit(0)).alias("named"), F.min(F.when(F.col("id").isNotNull(), F.struct("id", "n"))).alias("least")
    )
    first = F.col("least.id") == F.min("least.id").over(Window.partitionBy("digest"))
    kinds = kinds.withColumn("copies", F.col("named") - F.when(first, F.col("least.n")).otherwise(0))
    split = F.array(F.struct((F.col("n") - F.col("copies")).alias("n"), F.lit(0).alias("bit")), F.struct(F.col("copies").alias("n"), F.lit(1 << len(own)).alias("bit")))
    cells = kinds.select("part", "own", "q", "t", F.explode(split).alias("c")).where("c.n > 0")
    sums = [F.sum(F.col("c.n") * weight).alias(name) for name, weight in (("n", F.lit(1)), ("good", F.col("q")), ("toxic", F.col("t")))]
    return cells.groupBy("part", (F.col("own") + F.col("c.bit")).alias("mask")).agg(*sums)


def _total(what: str, condition: str) -> str:
    return f"aggregate(filter(c.cells, m -> {condition}), CAST(0 AS BIGINT), (x, m) -> x + m.{what})"


#: Prefixes of filter orders: every level puts each unused letter behind the prefixes of the last one, meets the part's
#: mask cells and gives that step's counts. ``applied`` carries the bits of the prefix.
STEPS = f"""
WITH RECURSIVE steps(part, prefix, letter, step, applied, kept, removed, redundant, unique_fails, good_lost, toxic_lost) AS (
  SELECT part, '', '', 0, 0, {", ".join(["CAST(0 AS BIGINT)"] * 6)} FROM {{cells}}
  UNION ALL
  SELECT c.part, concat(s.prefix, s.f.letter), s.f.letter, s.step + 1, s.applied | s.f.bit,
    {_total("n", "m.mask & (s.applied | s.f.bit) = 0")},
    {_total("n", "m.mask & s.f.bit != 0 AND m.mask & s.applied = 0")},
    {_total("n", "m.mask & s.f.bit != 0 AND m.mask & s.applied != 0")},
    {_total("n", "m.mask = s.f.bit")},
    {_total("good", "m.mask & s.f.bit != 0 AND m.mask & s.applied = 0")},
    {_total("toxic", "m.mask & s.f.bit != 0 AND m.mask & s.applied = 0")}
  FROM (SELECT part, prefix, step, applied, explode(filter({{letters}}, f -> applied & f.bit = 0)) AS f FROM steps) s
  JOIN {{cells}} c ON s.part = c.part
)
SELECT * FROM steps WHERE step > 0
"""


def filter_steps(cells: DataFrame) -> DataFrame:
    """One row per part and prefix of a filter order, with the counts of its last filter; written to the shared folder.

    ``cells`` come from ``mask_cells``. A part's cells, 32 at most, are one row, so a level has
    a row per part and prefix, 325 in all.
    """
    spark = cells.sparkSession
    cells = settle(cells.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("cells")))
    letters = [*failure_conditions(F.lit("")), COPIES]
    table = ", ".join(f"struct('{x}' AS letter, {1 << i} AS bit)" for i, x in enumerate(letters))
    before = spark.conf.get(ROW_LIMIT)
    spark.conf.set(ROW_LIMIT, "-1")
    try:
        return settle(spark.sql(STEPS.replace("{letters}", f"array({table})"), cells=cells))
    finally:
        spark.conf.set(ROW_LIMIT, before)


def filter_audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """One row per part, order of the five filters and step: ``part, filter_order, step`` and the counts of that step's filter.

    ``kept`` after the step, ``removed`` by it, ``redundant`` (fails it, removed earlier), ``unique_fails`` (fails it alone),
    ``good_lost`` and ``toxic_lost`` (removed by it, labelled so), ``shapley`` (removed by its filter in the part, over all orders).

    Null texts count as empty, null parts as ''. A document without an id is nobody's smaller copy and
    fails no copy filter; rows of one id are no copies of each other, each counts. Of several labels of an id any 1 counts,
    null labels do not. Zeros are rows; an empty table gives none; other columns are ignored.
    """
    steps = filter_steps(mask_cells(docs, labels, id_col, text_col, part_col))
    n = len(failure_conditions(F.lit(""))) + 1
    orders_of = F.element_at(F.array(*[F.lit(factorial(n - k)) for k in range(1, n + 1)]), F.col("step"))
    shapley = steps.groupBy("part", "letter").agg(F.sum(F.col("removed") * orders_of).alias("shapley"))
    orders = steps.where(F.col("step") == n).select("part", F.col("prefix").alias("filter_order"), F.explode(F.sequence(F.lit(1), F.lit(n))).alias("at"))
    orders = orders.select("part", "filter_order", F.expr("substring(filter_order, 1, at)").alias("prefix"))
    found = orders.join(steps, ["part", "prefix"]).join(shapley, ["part", "letter"])
    return found.select("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
