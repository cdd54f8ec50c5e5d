"""Profiler reports: sessions and the intervals between their checkpoints."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def session_summary(sessions: DataFrame, label: str, ms: str, memory: str | None = None, cpu_ms: str | None = None) -> DataFrame:
    """Count, total, mean, least and most of the sessions of each label, with peak memory and CPU share where measured."""
    more = []
    if memory:
        more.append(F.max(memory).alias("peak_memory"))
    if cpu_ms:
        more.append((100 * F.sum(cpu_ms) / F.nullif(F.sum(ms), F.lit(0.0))).alias("cpu_percent"))
    return sessions.groupBy(label).agg(
        F.count(ms).alias("n_sessions"), F.sum(ms).alias("total_ms"), F.avg(ms).alias("mean_ms"), F.min(ms).alias("min_ms"), F.max(ms).alias("max_ms"), *more
    )


def intervals(checkpoints: DataFrame, session: Sequence[str], stage: str, at: str, tie: str) -> DataFrame:
    """``interval, ms`` between consecutive checkpoints of each session, named ``from->to``.

    A session's order is by time, then by ``tie``; its last checkpoint begins no interval, nor does one
    without a time.
    """
    order = Window.partitionBy(*session).orderBy(at, tie)
    named = checkpoints.filter(F.col(at).isNotNull()).withColumn("_next", F.lead(F.struct(F.col(stage).alias("stage"), F.col(at).alias("at"))).over(order))
    ms = (F.unix_micros(F.col("_next.at").cast("timestamp")) - F.unix_micros(F.col(at).cast("timestamp"))) / 1000.0
    return named.filter(F.col("_next").isNotNull()).select(*session, F.concat(F.col(stage), F.lit("->"), F.col("_next.stage")).alias("interval"), ms.alias("ms"))


def interval_summary(found: DataFrame, label: str) -> DataFrame:
    return found.groupBy(label, "interval").agg(F.sum("ms").alias("total_ms"), F.avg("ms").alias("average_ms"), F.count(F.lit(1)).alias("count"))


def core_time(sessions: DataFrame, dataset: str, ms: str) -> DataFrame:
    """Total time of each dataset in whole milliseconds."""
    return sessions.groupBy(dataset).agg(F.round(F.sum(ms)).cast("long").alias("core_time_ms"))
