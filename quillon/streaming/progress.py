"""Progress events as streams: rooms by case, latest state, windows with late data, expiring sessions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Events of documents in the order in which a document passes them.
STAGES = ["view", "click", "signup", "purchase", "error"]
SCHEMA = T.StructType([T.StructField("event_id", T.LongType()), T.StructField("ts", T.TimestampNTZType()), T.StructField("user_id", T.LongType()), T.StructField("event_type", T.StringType()), T.StructField("value", T.DoubleType()), T.StructField("props", T.StringType())])


def read_events(spark: SparkSession, path: str, glob: str = "events.parquet") -> DataFrame:
    """A folder's event files as a stream, ts as a timestamp of the session's zone (UTC), which watermarks need."""
    raw = spark.readStream.schema(SCHEMA).option("pathGlobFilter", glob).option("maxFilesPerTrigger", 16).parquet(path)
    return with_time(raw)


def with_time(events: DataFrame) -> DataFrame:
    return events.withColumn("ts", F.col("ts").cast("timestamp"))


def room(events: DataFrame, case: int) -> DataFrame:
    """What a subscriber of one case sees."""
    return events.where(F.col("user_id") == case)


def latest_state(events: DataFrame) -> DataFrame:
    """Per case the last event's type and value, and how many there were; works on a stream (complete or update mode) as on a table."""
    key = F.struct("ts", "event_id")
    return events.groupBy("user_id").agg(F.max_by("event_type", key).alias("status"), F.max_by("value", key).alias("value"), F.count(F.lit(1)).alias("n"))


def windowed_counts(events: DataFrame, size: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts by type in tumbling windows; on a stream rows later than late are let go."""
    seen = events.withWatermark("ts", late) if events.isStreaming else events
    counted = seen.groupBy(F.window("ts", size), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 6).alias("total"))
    return counted.select(F.col("window.start").alias("window_start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes") -> DataFrame:
    """A case's activity until nothing comes for gap: the lifetime of what would be cached for it."""
    seen = events.withWatermark("ts", gap) if events.isStreaming else events
    grouped = seen.groupBy(F.session_window("ts", gap), "user_id").agg(F.count(F.lit(1)).alias("n"))
    return grouped.select("user_id", F.col("session_window.start").alias("session_start"), F.col("session_window.end").alias("session_end"), "n")


def run_once(stream: DataFrame, sink: str, checkpoint: str, mode: str = "append") -> None:
    """Bring a file sink up to date with the stream and stop; a second run takes only what is new."""
    stream.writeStream.outputMode(mode).format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(sink).awaitTermination()
