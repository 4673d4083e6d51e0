"""Mixing sources to target weights by hierarchical budgeting."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from decretum.llm.common import WORD, bounded_broadcast, settle

LEVELS = ("domain", "lang", "source")
#: Leaves whose plan may be broadcast; beyond that the join shuffles.
BROADCAST_LEAVES = 100_000


def word_tokens(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _weight(level: str, weights: Mapping[str, Mapping[str, int]]) -> Column:
    given = weights.get(level, {})
    out = F.lit(int(given.get("*", 1)))
    for name, w in given.items():
        if name != "*":
            out = F.when(F.col(level) == name, int(w)).otherwise(out)
    return out.cast("decimal(12,0)")


def _share(nodes: DataFrame, parents: list[str], level: str, weights) -> DataFrame:
    """Divide each parent's ``budget`` among its children by weight, none above its ``capacity``; what one can't take goes to its siblings.

    Children are sorted by capacity over weight; the first ones, which fill up, get
    their capacity, and the rest divide what is left by weight, rounded down.
    """
    big = "decimal(20,0)"
    weighted = nodes.withColumn("w", _weight(level, weights)).withColumn("cap", F.when(F.col("w") > 0, F.col("capacity")).otherwise(0).cast(big))
    order = Window.partitionBy(*parents).orderBy(F.col("cap").cast("double") / F.greatest(F.col("w"), F.lit(1)).cast("double"), level)
    whole = Window.partitionBy(*parents)
    taken = F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast(big)
    left = F.sum("w").over(order.rowsBetween(0, Window.unboundedFollowing)).cast("decimal(16,0)")
    full = weighted.withColumn("full", F.col("cap") * left <= F.col("w") * (F.col("budget").cast(big) - taken))
    full = full.withColumn("spent", F.coalesce(F.sum(F.when(F.col("full"), F.col("cap"))).over(whole), F.lit(0)).cast(big))
    full = full.withColumn("over", F.sum(F.when(~F.col("full"), F.col("w"))).over(whole).cast("decimal(16,0)"))
    part = F.expr("(w * (CAST(budget AS DECIMAL(20,0)) - spent)) DIV over")
    return full.withColumn("budget", F.when(F.col("full"), F.col("cap").cast("long")).otherwise(part).cast("long")).drop("w", "cap", "full", "spent", "over")


def mix_budgets(leaves: DataFrame, weights: Mapping[str, Mapping[str, int]], budget: int | None, max_epochs: int) -> DataFrame:
    """``domain, lang, source, tokens, budget`` from leaves with ``tokens``.

    A node's capacity is ``max_epochs`` times its tokens. Budgets go down the tree;
    a node gets no more than its subtree can give, so a short leaf is first made
    up by its siblings and only a short subtree by those of an ancestor.
    """
    leaves = leaves.withColumn("capacity", F.col("tokens") * max_epochs)
    langs = leaves.groupBy("domain", "lang").agg(F.sum("capacity").alias("capacity"))
    domains = leaves.groupBy("domain").agg(F.sum("capacity").alias("capacity"))
    total = leaves.groupBy().agg(F.coalesce(F.lit(budget).cast("long"), F.coalesce(F.sum("tokens"), F.lit(0))).alias("budget"))
    shared = _share(domains.withColumn("all", F.lit(0)).join(total.withColumn("all", F.lit(0)), "all"), ["all"], "domain", weights).drop("all", "capacity")
    shared = _share(langs.join(shared, "domain"), ["domain"], "lang", weights).drop("capacity")
    return _share(leaves.join(shared, ["domain", "lang"]), ["domain", "lang"], "source", weights).drop("capacity")


def mix(
    docs: DataFrame,
    weights: Mapping[str, Mapping[str, int]],
    budget: int | None = None,
    max_epochs: int = 2,
    seed: int = 42,
    domain: Column | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    source_col: str = "source",
) -> DataFrame:
    """The documents with ``mix_domain, mix_lang, mix_source, mix_tokens, mix_copies``: how often each one enters the mixture.

    ``weights[level][name]`` are whole numbers, ``"*"`` the one for other names (1
    if not given); ``budget`` is in tokens (None: as many as the documents have). A
    leaf's budget is spent on whole epochs first; of the next epoch, the prefix of a
    seeded order that fits the rest is taken. The order's digests are cut into 4,096
    ranges, so that only one range of a leaf is summed up row by row.

    Null domain, language or source count as ''; a null or empty text has no tokens
    and comes with the whole epochs, and with the prefix if it falls into it;
    rows of one id in a leaf stand or fall together; an empty table gives an empty
    result. Columns of the documents stay, except those named as new ones.
    """
    names = ["mix_domain", "mix_lang", "mix_source", "mix_tokens", "mix_copies"]
    blank = F.lit("")
    keyed = docs.drop(*names).select(
        "*",
        F.coalesce((domain if domain is not None else blank).cast("string"), blank).alias("mix_domain"),
        F.coalesce(F.col(lang_col).cast("string"), blank).alias("mix_lang"),
        F.coalesce(F.col(source_col).cast("string"), blank).alias("mix_source"),
        word_tokens(F.col(text_col)).alias("mix_tokens"),
    )
    narrow = settle(
        keyed.select(
            F.col(id_col).cast("string").alias("id"), *[F.col(f"mix_{x}").alias(x) for x in LEVELS], F.col("mix_tokens").alias("tokens")
        )
    )
    leaf = list(LEVELS)
    sums = narrow.groupBy(*leaf).agg(F.sum("tokens").alias("tokens"))
    budgets = mix_budgets(sums, weights, budget, max_epochs)
    whole = F.when(F.col("tokens") > 0, F.expr("budget DIV tokens")).otherwise(0)
    budgets = settle(budgets.withColumn("epochs", whole).withColumn("rest", F.col("budget") - F.col("epochs") * F.col("tokens")))

    def place(id_: Column) -> Column:
        return F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("epochs").cast("string"), F.coalesce(id_, F.lit("null"))))

    plan = bounded_broadcast(budgets.select(*leaf, "epochs", "rest"), BROADCAST_LEAVES)
    placed = narrow.join(plan, leaf).where("rest > 0").withColumn("place", place(F.col("id"))).withColumn("range", F.substring("place", 1, 3))
    ranges = placed.groupBy(*leaf, "range", "rest").agg(F.sum("tokens").alias("n"))
    upto = F.sum("n").over(Window.partitionBy(*leaf).orderBy("range"))
    crossing = (
        ranges.withColumn("upto", upto)
        .where("upto > rest")
        .groupBy(*leaf)
        .agg(F.min("range").alias("cross"), F.min_by(F.col("upto") - F.col("n"), "range").alias("before"))
    )
    crossing = settle(crossing)
    inside = placed.join(bounded_broadcast(crossing, BROADCAST_LEAVES), leaf).where("range = cross")
    running = F.sum("tokens").over(Window.partitionBy(*leaf).orderBy("place").rangeBetween(Window.unboundedPreceding, 0))
    last = inside.withColumn("upto", F.col("before") + running).where("upto <= rest").groupBy(*leaf).agg(F.max("place").alias("last"))
    # where no place of the crossing range fits, the prefix ends before that range
    cuts = budgets.join(crossing, leaf, "left").join(last, leaf, "left")
    cuts = settle(cuts.select(*[F.col(x).alias(f"mix_{x}") for x in leaf], "epochs", "rest", "cross", F.coalesce("last", "cross").alias("last")))
    joined = keyed.join(bounded_broadcast(cuts, BROADCAST_LEAVES).select(*names[:3], *[F.col(x).alias(f"_mix_{x}") for x in ("epochs", "rest", "last")]), names[:3])
    place_of = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("_mix_epochs").cast("string"), F.coalesce(F.col(id_col).cast("string"), F.lit("null"))))
    extra = F.when(F.col("_mix_rest") <= 0, 0).when(F.col("_mix_last").isNull() | (place_of <= F.col("_mix_last")), 1).otherwise(0)
    return joined.withColumn("mix_copies", (F.col("_mix_epochs") + extra).cast("int")).drop("_mix_epochs", "_mix_rest", "_mix_last")


def take_copies(mixed: DataFrame) -> DataFrame:
    """A row per document and copy, without the ``mix_`` columns."""
    taken = mixed.where("mix_copies > 0").withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("mix_copies"))))
    return taken.drop("_copy", *[x for x in mixed.columns if x.startswith("mix_")])
