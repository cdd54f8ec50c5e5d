"""Selections that keep a fixed number of rows of each group, spread over a grid or by rank."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

COLUMNS, ROWS = 8, 6  # fixed values of the grid


def best_of_group(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int) -> DataFrame:
    """The first ``n`` rows of each group; each task keeps no more before the shuffle."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col("rank") <= n)


def spread_selection(df: DataFrame, keys: Sequence[str], x: Column, y: Column, width: Column | float, height: Column | float, idx: str, inlier: Column, k: int) -> DataFrame:
    """``keys, idx, cell, rank``: at most ``k`` rows of each group, spread over a grid of 8 by 6 cells.

    Each cell may give k/48 rows, and the first cells that hold any one more each until the remainder is
    used. A cell with more rows gives evenly spaced ones in the order of ``idx``. What is missing is filled
    with further rows in that order. Inliers rank first, then ``idx``, which must be unique in its group.
    Rows without a place take part in the filling only.
    """
    keys = list(keys)
    column = F.least(F.floor(x / (F.lit(1.0) * width / COLUMNS)).cast("int"), F.lit(COLUMNS - 1))
    row = F.least(F.floor(y / (F.lit(1.0) * height / ROWS)).cast("int"), F.lit(ROWS - 1))
    cell = F.greatest(row, F.lit(0)) * COLUMNS + F.greatest(column, F.lit(0))
    rows = df.select(*keys, F.col(idx).alias("idx"), cell.alias("cell"), F.coalesce(inlier, F.lit(False)).alias("ok"))
    sizes = rows.filter("cell IS NOT NULL").groupBy(*keys, "cell").agg(F.count(F.lit(1)).alias("n"))
    base, rest = divmod(k, COLUMNS * ROWS)
    nth = F.row_number().over(Window.partitionBy(*keys).orderBy("cell"))
    quotas = sizes.withColumn("quota", F.lit(base) + F.when(nth <= rest, 1).otherwise(0))
    placed = rows.join(quotas, [*keys, "cell"], "left").withColumn("at", F.row_number().over(Window.partitionBy(*keys, "cell").orderBy("idx")) - 1)
    i = F.ceil(F.col("at") * F.col("quota") / F.col("n"))
    even = (i < F.col("quota")) & (F.floor(i * F.col("n") / F.col("quota")) == F.col("at"))
    chosen = F.coalesce(F.when(F.col("quota") == 0, F.lit(False)).when(F.col("n") <= F.col("quota"), F.lit(True)).otherwise(even), F.lit(False))
    first = Window.partitionBy(*keys).orderBy(F.desc("chosen"), "idx")
    kept = placed.withColumn("chosen", chosen).withColumn("take", F.row_number().over(first)).filter(F.col("take") <= k)
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("ok"), "idx"))
    return kept.withColumn("rank", rank).select(*keys, "idx", "cell", "rank")
