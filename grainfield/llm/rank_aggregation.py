"""Problem 4: one ranking from scores of different scales, by robust rank aggregation."""

from __future__ import annotations

from functools import reduce
from math import comb

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from grainfield.operators.ranking import grouped_rank
from grainfield.session import stored


def beta_order_probability(r: Column, k: int, n: int) -> Column:
    """Chance that the k-th smallest of n uniform ranks is at most r: the Beta(k, n-k+1) distribution, as a binomial tail."""
    terms = [F.lit(float(comb(n, j))) * F.pow(r, F.lit(float(j))) * F.pow(1 - r, F.lit(float(n - j))) for j in range(k, n + 1)]
    return reduce(lambda a, b: a + b, terms)


def normalised_ranks(items: DataFrame, group: str, item: str, scores: list[str]) -> DataFrame:
    """For each item of each group its rank by every score over the number of items; ties share their average rank.

    A missing score (null or NaN) has rank 1.0, the worst. Items repeated in a group count once, with
    the best of each score. One group or one tied value may hold most rows: ranks come from
    counts per value, and those are ranked by `grouped_rank`.
    """
    clean = [F.max(F.when(~F.isnan(F.col(s).cast("double")), F.col(s).cast("double"))).alias(f"_s{i}") for i, s in enumerate(scores)]
    each = stored(items.groupBy(F.col(group).alias("_g"), F.col(item).alias("_item")).agg(*clean), "items")
    stacked = each.select("_g", "_item", F.explode(F.array(*[F.struct(F.lit(i).alias("s"), F.col(f"_s{i}").alias("v")) for i in range(len(scores))])).alias("x")).select("_g", "_item", "x.s", "x.v")
    sizes = each.groupBy(F.col("_g").alias("_gn")).agg(F.count("*").alias("_size"))
    values = stacked.filter("v IS NOT NULL").groupBy("_g", "s", "v").agg(F.count("*").alias("_n"))
    placed = stored(grouped_rank(values, ["_g", "s"], [F.col("v").desc()], "_place"), "values")
    # items above a value = the sum of the counts of the values before it
    block = F.shiftright(F.col("_place") - 1, 12)
    blocks = placed.groupBy("_g", "s", block.alias("_b")).agg(F.sum("_n").alias("_bn"))
    blocks = blocks.withColumn("_ahead", F.coalesce(F.sum("_bn").over(Window.partitionBy("_g", "s").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    blocks = blocks.select(F.col("_g").alias("_bg"), F.col("s").alias("_bs"), "_b", "_ahead")
    inner = Window.partitionBy("_g", "s", block).orderBy("_place").rowsBetween(Window.unboundedPreceding, -1)
    ranked = placed.withColumn("_in", F.coalesce(F.sum("_n").over(inner), F.lit(0))).join(blocks, F.col("_g").eqNullSafe(F.col("_bg")) & (F.col("s") == F.col("_bs")) & (F.col("_b") == block))
    ranked = ranked.select(F.col("_g").alias("_rg"), F.col("s").alias("_rs"), F.col("v").alias("_rv"), (F.col("_ahead") + F.col("_in") + (F.col("_n") + 1) / 2).alias("_rank"))
    got = stacked.join(ranked, F.col("_g").eqNullSafe(F.col("_rg")) & (F.col("s") == F.col("_rs")) & (F.col("v") == F.col("_rv")), "left")
    wide = got.groupBy("_g", "_item").agg(*[F.max(F.when(F.col("s") == i, F.col("_rank"))).alias(f"_r{i}") for i in range(len(scores))])
    wide = wide.join(sizes, F.col("_g").eqNullSafe(F.col("_gn")))
    return wide.select(F.col("_g").alias(group), F.col("_item").alias(item), *[F.coalesce(F.col(f"_r{i}") / F.col("_size"), F.lit(1.0)).alias(f"r_{s}") for i, s in enumerate(scores)])


def leaning_ranks(items: DataFrame, group: str, item: str, scores: list[str], lean: float = 1.5) -> DataFrame:
    """For each item of each group its normalised rank in as many consensus rankings as there are scores, and its mean rank by the scores.

    A consensus ranking orders the items by the weighted mean of their ranks by all scores, one of which counts `lean` times as
    much as each other; so every ranking hears all scores and none is led by one alone.
    """
    ranks = stored(normalised_ranks(items, group, item, scores), "ranks")
    total = lambda own: reduce(lambda a, b: a + b, [F.col(f"r_{s}") * (lean if s == own else 1.0) for s in scores])
    voices = ranks.select(group, item, *[(-F.round(total(s), 9)).alias(s) for s in scores])
    means = ranks.select(F.col(group).alias("_mg"), F.col(item).alias("_mi"), (total(None) / len(scores)).alias("mean_rank"))
    leaned = normalised_ranks(voices, group, item, scores)
    return leaned.join(means, F.col(group).eqNullSafe(F.col("_mg")) & F.col(item).eqNullSafe(F.col("_mi"))).drop("_mg", "_mi")


def significance(ranks: DataFrame, scores: list[str]) -> Column:
    """rho of an item: its normalised ranks sorted, the beta probability of each order statistic, the least of them times their number, at most 1."""
    n = len(scores)
    ordered = F.array_sort(F.array(*[F.col(f"r_{s}") for s in scores]))
    ps = [beta_order_probability(ordered[k - 1], k, n) for k in range(1, n + 1)]
    return F.least(F.lit(1.0), (F.least(*ps) if n > 1 else ps[0]) * n)


def robust_rank_aggregation(items: DataFrame, group: str, item: str, scores: list[str], lean: float | None = None) -> DataFrame:
    """Significance of each item by its ranks: by each score, or with `lean` in the consensus rankings of `leaning_ranks`.

    Columns: group, item, rho (small is good, at most 1) and mean_rank, which breaks ties of rho.
    Groups and items may be null and are then a group or an item of their own.
    """
    if lean is None:
        ranks = normalised_ranks(items, group, item, scores)
        ranks = ranks.withColumn("mean_rank", reduce(lambda a, b: a + b, [F.col(f"r_{s}") for s in scores]) / len(scores))
    else:
        ranks = leaning_ranks(items, group, item, scores, lean)
    return ranks.select(group, item, significance(ranks, scores).alias("rho"), "mean_rank")


def first_of_each(ranked: DataFrame, group: str, item: str) -> DataFrame:
    """The most significant item of each group; of equal rho the better mean rank, then the smaller item."""
    best = F.min(F.struct(F.round("rho", 12).alias("a"), F.round("mean_rank", 12).alias("b"), F.col(item).alias("d")))
    return ranked.groupBy(group).agg(best.alias("w")).select(group, F.col("w.d").alias(item))
