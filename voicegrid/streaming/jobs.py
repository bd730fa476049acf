"""Streaming forms of the weekly counts and of the annotate-and-append loop."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming import StreamingQuery


def file_stream(spark: SparkSession, folder: str, schema: T.StructType, files: str = "*.parquet",
                files_per_trigger: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema).option("pathGlobFilter", files)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(folder)


def table_stream(spark: SparkSession, folder: str, name: str, schema: T.StructType) -> DataFrame:
    """The table ``name`` of ``folder`` as a stream, whether it is one Parquet file or a folder of them.

    The path is a pattern that only the table matches: a stream of a plain path takes it for a folder.
    """
    return spark.readStream.schema(schema).parquet(f"{folder}/{name}.parque[t]")


def weekly_mention_stream(events: DataFrame, time: str, key: str, late: str = "1 day") -> DataFrame:
    """Counts per key and Tuesday-to-Monday week; rows later than the watermark are dropped.

    Windows start at the epoch, a Thursday, so they are moved by five days. State is one counter
    per key and open week.
    """
    week = F.window(time, "7 days", "7 days", "5 days")
    events = events.withColumn(time, F.col(time).cast("timestamp"))
    return (events.withWatermark(time, late).groupBy(week, key).agg(F.count("*").alias("mentions"))
            .select(F.to_date(F.date_sub(F.to_date(F.col("window.end")), 1)).alias("week"), key, "mentions"))


def _write_batch(path: str) -> Callable[[DataFrame, int], None]:
    def write(batch: DataFrame, batch_id: int) -> None:
        # A repeated batch replaces its own folder, so a restart adds nothing twice.
        batch.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")
    return write


def start_weekly_mentions(events: DataFrame, path: str, checkpoint: str, time: str = "ts",
                          key: str = "event_type", late: str = "1 day") -> StreamingQuery:
    """Process what is there and stop; changed counts of every batch are stored by batch number."""
    return (weekly_mention_stream(events, time, key, late).writeStream.outputMode("update")
            .option("checkpointLocation", checkpoint).trigger(availableNow=True)
            .foreachBatch(_write_batch(path)).start())


def latest_counts(spark: SparkSession, path: str, keys: Sequence[str]) -> DataFrame:
    """Current counts: of every key the value stored by its last batch."""
    rows = spark.read.parquet(path)
    return rows.groupBy(*keys).agg(F.max_by("mentions", "batch_id").alias("mentions"))


def start_annotate_append(reviews: DataFrame, annotate: Callable[[DataFrame], DataFrame], path: str,
                          checkpoint: str) -> StreamingQuery:
    """Annotate newly arrived reviews and append them; the checkpoint is where a restart resumes."""
    return (annotate(reviews).writeStream.outputMode("append").format("parquet")
            .option("checkpointLocation", checkpoint).option("path", path)
            .trigger(availableNow=True).start())
