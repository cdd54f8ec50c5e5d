"""Queries of event streams: the event files are read as a stream, all that is there is run through, and the sink is read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sightline.runtime import Staging, table
from sightline.streaming import events as stream


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = table(spark, sf_dir, "events").schema
    rows = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))


def _drained(rows: DataFrame, purpose: str) -> DataFrame:
    """The rows a stream gives for what is there now, from a Parquet sink with a checkpoint in the shared folder."""
    spark = rows.sparkSession
    folder = Staging(spark, purpose).path
    query = rows.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(rows.schema).parquet(f"{folder}/out")


def stream_windowed_stats(spark, sf_dir):
    """Statistics of the hours that the watermark, two hours behind the last event, has closed."""
    out = _drained(stream.windowed_stats(_events(spark, sf_dir)), "windows")
    return out.select(F.date_format("start", "yyyy-MM-dd HH:mm").alias("start"), "event_type", "n", *[F.round(c, 6).alias(c) for c in ("mean", "min", "max")])


def stream_intervals(spark, sf_dir):
    """Steps between the events of each user, with the last event kept as state: their number and time by kind."""
    out = _drained(stream.intervals(_events(spark, sf_dir)), "intervals")
    return out.groupBy("interval").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("ms") / 1000, 1).alias("seconds"))


QUERIES = {f.__name__: f for f in (stream_windowed_stats, stream_intervals)}

SQL = {
    "stream_windowed_stats": """SELECT strftime(start, '%Y-%m-%d %H:%M') AS start, event_type, count(*) AS n, round(avg(value), 6) AS mean, round(min(value), 6) AS min, round(max(value), 6) AS max
        FROM (SELECT date_trunc('hour', ts) AS start, event_type, value FROM events) WHERE start + INTERVAL 1 HOUR <= (SELECT max(ts) - INTERVAL 2 HOUR FROM events) GROUP BY ALL""",
    "stream_intervals": """SELECT prior || '->' || event_type AS interval, count(*) AS n, round(sum(ms) / 1000, 1) AS seconds
        FROM (SELECT event_type, lag(event_type) OVER u AS prior, (epoch_us(ts) - lag(epoch_us(ts)) OVER u) / 1000.0 AS ms FROM events WINDOW u AS (PARTITION BY user_id ORDER BY ts, event_id)) WHERE prior IS NOT NULL GROUP BY 1""",
}
