"""Ranks within groups and one row per key, without ever putting a whole group into one task."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from grainfield.session import stored


def grouped_rank(df: DataFrame, group: list[str], order: list[Column], name: str = "rank") -> DataFrame:
    """Number the rows of each group from 1 in the given order; a hot group spreads over many tasks.

    The rows are range-partitioned by group and order, so one group may fill many partitions. Within
    a partition a row's place is its running number; the counts per group and partition (one row
    each) give the offset of each partition. Nulls in `group` form a group of their own. The order
    must end in a unique column for the result to be defined.
    """
    placed = stored(
        df.repartitionByRange(*[F.col(c) for c in group], *order)
        .sortWithinPartitions(*[F.col(c) for c in group], *order)
        .withColumn("_at", F.monotonically_increasing_id()),
        "placed",
    )
    part = F.shiftright("_at", 33)
    cells = placed.groupBy(*group, part.alias("_part")).agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    w = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.withColumn("_before", F.coalesce(F.sum("_n").over(w), F.lit(0))).drop("_n")
    cells = cells.select(*[F.col(c).alias(f"_g_{c}") for c in group], F.col("_part").alias("_g_part"), "_first", "_before")
    on = F.col("_g_part") == part
    for c in group:
        on = on & F.col(f"_g_{c}").eqNullSafe(F.col(c))
    joined = placed.join(cells, on)
    return joined.withColumn(name, (F.col("_at") - F.col("_first") + F.col("_before") + 1).cast("long")).select(*df.columns, name)


def running_total(df: DataFrame, order: list[Column], value: str, name: str) -> DataFrame:
    """Each row with the sum of `value` over the rows before it; rows are range-partitioned, and only the sums of partitions are added up in one task."""
    placed = stored(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()), "placed")
    part = F.shiftright("_at", 33)
    cells = placed.groupBy(part.alias("_cell")).agg(F.sum(value).alias("_sum"))
    before = F.coalesce(F.sum("_sum").over(Window.orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    inner = F.coalesce(F.sum(value).over(Window.partitionBy(part).orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return placed.withColumn("_inner", inner).join(cells.select("_cell", before.alias("_before")), part == F.col("_cell")).select(*df.columns, (F.col("_inner") + F.col("_before")).alias(name))


def latest_by(df: DataFrame, key: str, stamp: str) -> DataFrame:
    """One row per key, that of the greatest stamp (null stamps are oldest); of equal stamps one row is kept.

    Over files only the keys, stamps and row positions move: the few losing rows are found first and
    taken out by an anti-join, so wide columns are not shuffled. Other frames use a window. Rows
    whose key is null are one group like any other.
    """
    try:
        slim = df.select(F.col(key).alias("_k"), F.col(stamp).alias("_s"), F.xxhash64("_metadata.file_path").alias("_latest_file"), F.col("_metadata.row_index").alias("_latest_row"))
    except AnalysisException:
        w = Window.partitionBy(key).orderBy(F.col(stamp).desc_nulls_last(), F.xxhash64(*[F.col(c) for c in df.columns]))
        return df.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")
    best = (
        slim.groupBy(F.col("_k").alias("_bk"))
        .agg(F.count("*").alias("_n"), F.max(F.struct(F.col("_s").isNotNull().alias("a"), F.col("_s").alias("b"), F.col("_latest_file").alias("c"), F.col("_latest_row").alias("d"))).alias("_w"))
        .filter("_n > 1")
        .select("_bk", F.col("_w.c").alias("_win_file"), F.col("_w.d").alias("_win_row"))
    )
    losers = stored(
        slim.join(stored(best, "repeated"), F.col("_k").eqNullSafe(F.col("_bk")))
        .filter((F.col("_latest_file") != F.col("_win_file")) | (F.col("_latest_row") != F.col("_win_row")))
        .select("_latest_file", "_latest_row"),
        "older",
    )
    at = df.select("*", F.xxhash64("_metadata.file_path").alias("_latest_file"), F.col("_metadata.row_index").alias("_latest_row"))
    return at.join(losers, ["_latest_file", "_latest_row"], "left_anti").drop("_latest_file", "_latest_row")
