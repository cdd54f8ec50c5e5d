"""CSV files of the evaluator and the profiler: one file for each report."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sightline.operators import evaluation as ev


def write_csv(df: DataFrame, path: str) -> None:
    """A report as one CSV file; reports are small once they are aggregated."""
    df.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def write_evaluation(results: DataFrame, folder: str, commits: list, notes: list[str] | str = "") -> None:
    """All reports of ``eval_type, algorithm, eval_commit, metric, value, notes`` results, by type and metric.

    For each type that has results: statistics, a comparison of commits by mean, raw values with notes, and
    the values of every algorithm. Nothing below the folder but these reports is touched.
    """
    for kind, metric in sorted((r[0], r[1]) for r in results.select("eval_type", "metric").distinct().collect()):
        own = results.filter((F.col("eval_type") == kind) & (F.col("metric") == metric))
        base = f"{folder}/{kind}_{metric}"
        write_csv(ev.all_stats(own, ["algorithm", "eval_commit"], "value").orderBy("algorithm", "eval_commit"), f"{base}_ALL_STATS")
        write_csv(ev.comparison_pivot(own, "algorithm", "eval_commit", "value", commits).orderBy("algorithm"), f"{base}_comparison")
        raw = ev.expand_notes(own, "notes", notes)
        write_csv(raw.drop("eval_type", "metric"), f"{base}_raw")
        raw.drop("eval_type", "metric").repartition("algorithm").write.mode("overwrite").option("header", True).partitionBy("algorithm").csv(f"{base}_by_algorithm")


def write_profile(sessions: DataFrame, intervals: DataFrame, folder: str) -> None:
    write_csv(sessions, f"{folder}/profiler")
    write_csv(intervals, f"{folder}/profiler_stages")


def read_summaries(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """CSV reports of several datasets as one table with a dataset column; datasets without a file are skipped."""
    parts = {}
    for name, path in paths.items():
        file = spark._jvm.org.apache.hadoop.fs.Path(path)
        if file.getFileSystem(spark._jsc.hadoopConfiguration()).exists(file):
            parts[name] = spark.read.option("header", True).csv(path)
    if not parts:
        return spark.createDataFrame([], "dataset string")
    return ev.union_datasets(parts)


def append_statistics(rows: DataFrame, path: str, step: str, iteration: int) -> None:
    """Statistics of one step and iteration, appended to a table in long form."""
    rows.select(F.lit(step).alias("step"), F.lit(iteration).alias("iteration"), "data", "metric", "value", F.current_timestamp().alias("at")).write.mode("append").parquet(path)
