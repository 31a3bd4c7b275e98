"""Job events as a stream: the last stage of every job, windows over event time, exactly-once publishing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EVENTS = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def stream(spark: SparkSession, folder: str, files_per_batch: int = 8) -> DataFrame:
    return spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def deduplicated(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """Each event once, as long as its copies are not later than ``late``."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])


def windowed(events: DataFrame, size: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """(start, event_type, events, total): sums by window of event time."""
    return (
        events.withWatermark("ts", late)
        .groupBy(F.window("ts", size).alias("w"), "event_type")
        .agg(F.count("*").alias("events"), F.sum("value").alias("total"))
        .select(F.col("w.start").alias("start"), "event_type", "events", "total")
    )


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    return (
        events.withWatermark("ts", late)
        .groupBy(F.session_window("ts", gap).alias("w"), "user_id")
        .agg(F.count("*").alias("events"))
        .select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "user_id", "events")
    )


def latest_stage(events: DataFrame) -> DataFrame:
    """(job, stage, events): a job's last stage so far; a job that is done or failed stays so."""
    final = F.col("event_type").isin("done", "failed")
    key = F.struct(final.cast("int").alias("final"), F.when(final, -F.unix_micros("ts")).otherwise(F.unix_micros("ts")).alias("at"), "event_id")
    return events.groupBy(F.col("user_id").alias("job")).agg(F.max_by("event_type", key).alias("stage"), F.count("*").alias("events"))


def run_once(frame: DataFrame, target: str, checkpoint: str, mode: str = "append") -> None:
    """Everything that is there, into Parquet (append) or as one table for each batch (complete)."""
    writer = frame.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).outputMode(mode)
    if mode == "append":
        query = writer.format("parquet").option("path", target).start()
    else:
        query = writer.foreachBatch(lambda df, _: df.write.mode("overwrite").parquet(target)).start()
    query.awaitTermination()
