"""Daily snapshots as a file stream: deduplicated over all history, or within a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def snapshot_stream(spark: SparkSession, path: str, schema, files_per_trigger: int = 1, glob: str = "*.parquet") -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).option("pathGlobFilter", glob).parquet(path)


def deduplicated(stream: DataFrame, key: str | list[str] = "url", event_time: str | None = None, delay: str | None = None) -> DataFrame:
    """One row for each key. Without a delay all keys ever seen are state; with one, state is bounded by the watermark."""
    keys = [key] if isinstance(key, str) else key
    if delay:
        return stream.withWatermark(event_time, delay).dropDuplicatesWithinWatermark(keys)
    return stream.dropDuplicates(keys)


def run_available(stream: DataFrame, out: str, checkpoint: str) -> None:
    """Process what has arrived and stop; the next call goes on from there."""
    stream.writeStream.format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(out).awaitTermination()


def daily_counts(stream: DataFrame, event_time: str, delay: str = "1 day") -> DataFrame:
    return stream.withWatermark(event_time, delay).groupBy(F.window(event_time, "1 day")).agg(F.count("*").alias("n"))
