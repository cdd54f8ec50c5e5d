"""Order statistics and outlier rules that hold exactly on any amount of rows."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

X84 = 5.2  # fixed value: as many median absolute deviations as an inlier may lie above the median
ACCURACY, MARGIN = 20_000, 0.0002  # a sketch errs by one in ACCURACY of the rows at most, a quarter of the margin


def on_group(df: DataFrame, groups: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Rows with the columns of their group; a null key is a group too. Without keys ``groups`` is one row, broadcast."""
    if not keys:
        return df.crossJoin(F.broadcast(groups))
    other = groups.select(*[F.col(k).alias(f"_on{n}") for n, k in enumerate(keys)], *[c for c in groups.columns if c not in keys])
    same = reduce(lambda a, b: a & b, [df[k].eqNullSafe(other[f"_on{n}"]) for n, k in enumerate(keys)])
    return df.join(other, same, how).drop(*[f"_on{n}" for n in range(len(keys))])


def middle_values(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """``keys, n, lower, upper``: elements (n - 1)/2 and n/2 of each group's sorted values; nulls and NaN are no values.

    A sketch brackets the middle with ``MARGIN`` of the rows on either side, more than its error; the rows
    below the bracket are counted, and only those within it are counted by value and summed up in order, so
    no group is ever gathered or sorted as a whole. Groups without values have no row.
    """
    keys = list(keys)
    v = F.col(value).cast("double")
    rows = df.filter(v.isNotNull() & ~F.isnan(v)).select(*keys, v.alias("_v"))
    sketch = [F.count(F.lit(1)).alias("n"), F.percentile_approx("_v", [0.5 - MARGIN, 0.5 + MARGIN], ACCURACY).alias("b")]
    bracket = (rows.groupBy(*keys).agg(*sketch) if keys else rows.agg(*sketch)).select(*keys, "n", F.col("b")[0].alias("low"), F.col("b")[1].alias("high"))
    placed = on_group(rows, bracket, keys).filter("_v <= high")
    at = F.when(F.col("_v") < F.col("low"), F.lit(None).cast("double")).otherwise(F.col("_v"))
    counts = placed.groupBy(*keys, "n", at.alias("at")).agg(F.count(F.lit(1)).alias("c"))
    order = Window.partitionBy(*keys).orderBy(F.col("at").asc_nulls_first())
    summed = counts.withColumn("upto", F.sum("c").over(order)).filter("at IS NOT NULL")
    ends = [F.min(F.when(F.col("upto") > F.floor((F.col("n") - less) / 2), F.col("at"))).alias(name) for name, less in (("lower", 1), ("upper", 0))]
    found = summed.groupBy(*keys).agg(F.max("n").alias("n"), *ends) if keys else summed.agg(F.max("n").alias("n"), *ends).filter("n IS NOT NULL")
    return found.select(*keys, "n", "lower", "upper")


def upper_median(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """``keys, n, upper_median``: element n/2 of each group's sorted values (see :func:`middle_values`)."""
    return middle_values(df, keys, value).select(*keys, "n", F.col("upper").alias("upper_median"))


def summary_with_upper_median(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Min, mean, max and upper median of each group with values."""
    v = F.col(value).cast("double")
    rows = df.filter(v.isNotNull() & ~F.isnan(v))
    stats = rows.groupBy(*keys).agg(F.min(v).alias("min"), F.avg(v).alias("mean"), F.max(v).alias("max"))
    return on_group(stats, upper_median(df, keys, value), keys)


def x84(df: DataFrame, keys: Sequence[str], value: str, times: float = X84) -> DataFrame:
    """Rows with ``threshold`` and ``is_inlier``: value < median + ``times`` median absolute deviations.

    Both medians are upper medians of the row's group, one row for each, so a single group's are taken to the
    driver and those of many are staged. Rows without a value are no inliers, a group without values has no threshold.
    """
    from sightline.runtime import Staging

    keys, v = list(keys), F.col(value).cast("double")
    centre = upper_median(df, keys, value).select(*keys, F.col("upper_median").alias("_m"))
    if not keys:
        median = (centre.first() or [None])[0]
        spread = None if median is None else upper_median(df.select(F.abs(v - F.lit(median)).alias("_d")), [], "_d").first()["upper_median"]
        rows = df.withColumn("threshold", F.lit(None if median is None else median + times * spread).cast("double"))
    else:
        staging = Staging(df.sparkSession, "medians")
        centre = staging.write(centre)
        off = on_group(df.select(*keys, v.alias("_d")), centre, keys).select(*keys, F.abs(F.col("_d") - F.col("_m")).alias("_d"))
        limits = on_group(centre, upper_median(off, keys, "_d"), keys).select(*keys, (F.col("_m") + times * F.col("upper_median")).alias("threshold"))
        rows = on_group(df, staging.write(limits), keys, "left")
    return rows.withColumn("is_inlier", F.coalesce((v < F.col("threshold")) & ~F.isnan(v), F.lit(False)))
