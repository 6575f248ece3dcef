"""Job states from an event log that keeps growing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def job_events(spark: SparkSession, path: str, schema: T.StructType, files_per_batch: int = 16) -> DataFrame:
    """The log as a stream of Parquet files."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def latest_states(events: DataFrame, job: str = "job_id", status: str = "status", at: str = "at", event: str = "event_id", late: str = "1 hour") -> DataFrame:
    """The last state of each job. An event that comes twice within the watermark counts once; state holds one row a job."""
    once = events.withWatermark(at, late).dropDuplicatesWithinWatermark([event])
    return once.groupBy(job).agg(F.max_by(status, at).alias("status"), F.max(at).alias("since"), F.count("*").alias("events"))


def states_by_window(events: DataFrame, status: str = "status", at: str = "at", width: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Events by state and time window; windows are final once the watermark has passed them."""
    return events.withWatermark(at, late).groupBy(F.window(at, width).alias("w"), status).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), status, "n")
