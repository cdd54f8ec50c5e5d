"""Reports over evaluation results in long form: algorithm, commit, metric, value, notes."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sightline.functions.parsing import smart_commit
from sightline.operators.robust import middle_values, on_group


def all_stats(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Mean, interpolated median, min, max, sample deviation and count of each group.

    Nulls are no values; a group of one value has a null deviation, one without values null statistics. The
    median is exact, and no group's values are gathered for it (see :func:`robust.middle_values`).
    """
    v = F.col(value)
    stats = df.groupBy(*keys).agg(F.avg(v).alias("mean"), F.min(v).alias("min"), F.max(v).alias("max"), F.stddev_samp(v).alias("stddev"), F.count(v).alias("count"))
    middle = middle_values(df, keys, value).select(*keys, ((F.col("lower") + F.col("upper")) / 2).alias("median"))
    return on_group(stats, middle, keys, "left").select(*keys, "mean", "median", "min", "max", "stddev", "count")


def comparison_pivot(df: DataFrame, row: str, column: str, value: str, columns: Sequence, stat=F.avg) -> DataFrame:
    """One row for each ``row``, one column for each of ``columns`` with the statistic of ``value``.

    The columns are given, so no extra pass looks for them; others are left out, missing cells are null.
    """
    return df.groupBy(row).pivot(column, list(columns)).agg(stat(F.col(value)))


def best_and_second(df: DataFrame, group: Sequence[str], name: str, value: str, lowest_is_best: bool = True) -> DataFrame:
    """The best and the second best ``name`` of each group with two numeric values or more.

    ``value`` may be text: what is no number, or is NaN, does not take part. Ties go to the smaller name.
    """
    number = F.col(value).cast("string").try_cast("double")
    numeric = df.withColumn("_v", number).filter(F.col("_v").isNotNull() & ~F.isnan("_v"))
    order = Window.partitionBy(*group).orderBy(F.col("_v").asc() if lowest_is_best else F.col("_v").desc(), F.col(name))
    top = numeric.withColumn("_r", F.row_number().over(order)).filter(F.col("_r") <= 2)
    best, second = F.col("_r") == 1, F.col("_r") == 2
    out = top.groupBy(*group).agg(
        F.max(F.when(best, F.col(name))).alias("best"), F.max(F.when(best, F.col("_v"))).alias("best_value"),
        F.max(F.when(second, F.col(name))).alias("second"), F.max(F.when(second, F.col("_v"))).alias("second_value"),
    )
    return out.filter(F.col("second").isNotNull())


def expand_notes(df: DataFrame, notes: str, names: Sequence[str] | str) -> DataFrame:
    """Notes (a map) as columns: the names in a list or joined by ``|``; ``"ALL"`` takes every key there is, ``""`` none."""
    if names == "ALL":
        names = sorted(r[0] for r in df.select(F.explode(F.map_keys(notes))).distinct().collect())
    elif isinstance(names, str):
        names = [n for n in names.split("|") if n]
    return df.select("*", *[F.col(notes)[n].alias(n) for n in names]).drop(notes)


def check_notes(df: DataFrame, n_values: Column, note_lengths: Column) -> DataFrame:
    """``notes_ok``: whether a note vector has a note for each value, one for all, or none."""
    return df.withColumn("notes_ok", (note_lengths == n_values) | note_lengths.isin(0, 1))


def with_smart_commit(df: DataFrame, commit: str) -> DataFrame:
    """The commit's prefix and number, where it reads ``prefix_number``."""
    prefix, number = smart_commit(F.col(commit))
    return df.withColumn("commit_prefix", prefix).withColumn("commit_number", number)


def success_ratio(df: DataFrame, keys: Sequence[str], success: Column) -> DataFrame:
    """Successes over attempts of each group; an unknown outcome is a failure."""
    ok = F.coalesce(success, F.lit(False))
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("total"), F.count_if(ok).alias("successful"), F.avg(ok.cast("double")).alias("ratio"))


def union_datasets(parts: Mapping[str, DataFrame]) -> DataFrame:
    """One table of all datasets with a ``dataset`` column in front; columns that a part lacks are null there."""
    named = [df.select(F.lit(name).alias("dataset"), "*") for name, df in parts.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), named)


def drop_unavailable_lines(lines: DataFrame, text: str, most: int = 3, header: Column | None = None) -> DataFrame:
    """Lines with at most ``most`` occurrences of N/A; header lines always stay."""
    few = F.coalesce(F.regexp_count(F.col(text), F.lit("N/A")), F.lit(0)) <= most
    return lines.filter(few if header is None else few | header)


def summary_over_metrics(df: DataFrame, keys: Sequence[str] = ("eval_type", "metric", "algorithm", "eval_commit"), value: str = "value") -> DataFrame:
    """All statistics of every type and metric in one table; metrics come from all algorithms."""
    return all_stats(df, keys, value)


def counts_by_reason(df: DataFrame, reason: Column) -> DataFrame:
    """Rows of each reason; null reasons are not counted."""
    return df.select(reason.alias("reason")).filter(F.col("reason").isNotNull()).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


def pipeline_table(df: DataFrame, dataset: str, pipeline: str, value: str, aliases: Mapping[str, str], pipelines: Sequence[str], main: str) -> DataFrame:
    """Datasets by pipelines, names made alike; datasets without the main pipeline are left out."""
    from sightline.functions.parsing import aliased

    named = df.withColumn("_p", aliased(F.col(pipeline), aliases))
    table = named.groupBy(dataset).pivot("_p", list(pipelines)).agg(F.avg(value))
    return table.filter(F.col(main).isNotNull())
