"""Streaming forms of the reports, for event streams; an addition to the batch operators."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType

INTERVALS = "user_id long, interval string, ms double"


def read_events(spark: SparkSession, path: str, schema: StructType | str, files_at_once: int = 100) -> DataFrame:
    """A stream of the event files that appear in a folder, with zone-less times read as session time."""
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_at_once).parquet(path)
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))


def windowed_stats(events: DataFrame, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Statistics of each type and window; repeats of an event and events later than ``late`` do not count."""
    once = events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])
    stats = once.groupBy(F.window("ts", width), "event_type").agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean"), F.min("value").alias("min"), F.max("value").alias("max"))
    return stats.select(F.col("window.start").alias("start"), "event_type", "n", "mean", "min", "max")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    """Sessions of each user, parted by gaps."""
    rows = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "user_id").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return rows.select("user_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n", "total")


def intervals(events: DataFrame) -> DataFrame:
    """Intervals between consecutive events of each user; the last event of a user is kept as state."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(frames)).sort_values(["ts", "event_id"])
        last = state.get if state.exists else None
        out = []
        for stage, ts in zip(rows["event_type"], rows["ts"], strict=True):
            micros = int(ts.value // 1000)
            if last is not None:
                out.append((key[0], f"{last[0]}->{stage}", (micros - last[1]) / 1000.0))
            last = (stage, micros)
        state.update(last)
        yield pd.DataFrame(out, columns=["user_id", "interval", "ms"])

    return events.groupBy("user_id").applyInPandasWithState(step, INTERVALS, "stage string, micros long", "append", GroupStateTimeout.NoTimeout)
