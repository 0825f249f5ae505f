"""Aggregates over reviews, contributions and ranks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from grainfield.operators.ranking import running_total

def first_reviews(reviews: DataFrame) -> DataFrame:
    """Of each page and contributor the first review, by time and id; scores outside 0..1 and null scores are left out. Combined before the shuffle."""
    good = reviews.filter(F.col("score").between(0.0, 1.0) & F.col("page_id").isNotNull())
    best = F.min(F.struct("reviewed_at", "id", "score")).alias("r")
    return good.groupBy("page_id", "contributor").agg(best).select("page_id", "contributor", F.col("r.id").alias("id"), F.col("r.score").alias("score"), F.col("r.reviewed_at").alias("reviewed_at"))


def geometric_quality(reviews: DataFrame, floor: float = 0.01) -> DataFrame:
    """(page_id, n_reviews, quality): geometric mean of the scores, each at least the floor, as the exponential of a mean of logarithms."""
    return reviews.groupBy("page_id").agg(F.count("*").alias("n_reviews"), F.exp(F.avg(F.log(F.greatest(F.col("score"), F.lit(floor))))).alias("quality"))


def coverage(pages: DataFrame, reviews: DataFrame, least: int) -> DataFrame:
    """(n_pages, n_covered, coverage): the part of the pages with at least so many reviews; 0 of none."""
    enough = reviews.groupBy("page_id").count().filter(F.col("count") >= least).select(F.col("page_id").alias("id"))
    covered = pages.join(enough, "id", "left_semi").agg(F.count("*").alias("n_covered"))
    total = pages.agg(F.count("*").alias("n_pages"))
    return total.crossJoin(covered).select("n_pages", "n_covered", F.when(F.col("n_pages") > 0, F.col("n_covered") / F.col("n_pages")).otherwise(0.0).alias("coverage"))


def leaderboard(contributions: DataFrame, kind: str | None = None, top: int = 10) -> DataFrame:
    """(place, contributor, n) of the contributors with most contributions; blank ones are left out, ties by name."""
    rows = contributions.filter(F.coalesce(F.col("contributor"), F.lit("")) != "")
    rows = rows if kind is None else rows.filter(F.lower("type") == kind)
    best = rows.groupBy("contributor").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "contributor").limit(top)
    return best.withColumn("place", F.row_number().over(Window.orderBy(F.desc("n"), "contributor")).cast("long")).select("place", "contributor", "n")


def failing_domains(rejects: DataFrame, domain: str, reason: str, least: int = 5) -> DataFrame:
    """(domain, n_failures) of domains with so many rejections that name a failed fetch."""
    failed = F.lower(reason).rlike("status |timeout|fetch failed")
    return rejects.filter(failed & (F.col(domain) != "")).groupBy(F.col(domain).alias("domain")).agg(F.count("*").alias("n_failures")).filter(F.col("n_failures") >= least)


def rank_sum_quality(pages: DataFrame, scores: list[str]) -> DataFrame:
    """(id, rank_sum, quality): ranks by each score (high first, ties share the average) added, then scaled so that the least sum is 1.

    Ranks come from counts per distinct value and their running total, for which no task holds more than a part of the values.
    """
    out = pages.select("id", *scores)
    for s in scores:
        counts = pages.groupBy(s).agg(F.count("*").alias("_n"))
        ranks = running_total(counts, [F.col(s).desc_nulls_last()], "_n", "_before").select(F.col(s).alias("_v"), (F.col("_before") + (F.col("_n") + 1) / 2).alias(f"_r_{s}"))
        out = out.join(ranks, F.col(s).eqNullSafe(F.col("_v"))).drop("_v")
    total = sum(F.col(f"_r_{s}") for s in scores)
    out = out.select("id", total.alias("rank_sum"))
    span = out.agg(F.min("rank_sum").alias("_lo"), F.max("rank_sum").alias("_hi"))
    return out.crossJoin(F.broadcast(span)).select("id", "rank_sum", F.when(F.col("_hi") > F.col("_lo"), 1 - (F.col("rank_sum") - F.col("_lo")) / (F.col("_hi") - F.col("_lo"))).otherwise(1.0).alias("quality"))
