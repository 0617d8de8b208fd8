"""Streams of arriving agent answers and of arriving documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

OUTPUTS = "doc_id long, step_id string, attempt int, input_hash string, status string, arrived timestamp"


def answers(spark: SparkSession, path: str, late: str = "1 hour") -> DataFrame:
    """Answers as their files arrive, each (document, step, attempt) once within the watermark."""
    return spark.readStream.schema(OUTPUTS).json(path).withWatermark("arrived", late).dropDuplicatesWithinWatermark(["doc_id", "step_id", "attempt"])


def answer_rates(stream: DataFrame, window: str = "10 minutes") -> DataFrame:
    """Answers by window and status; windows close with the stream's watermark."""
    return stream.groupBy(F.window("arrived", window), "status").count()


def append_available(stream: DataFrame, path: str, checkpoint: str):
    """Appends all that has arrived to a Parquet table and stops; a later call goes on from there."""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
