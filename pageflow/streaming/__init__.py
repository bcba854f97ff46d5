"""Streams: feedback as it arrives."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def feedback_stream(spark: SparkSession, path: str, schema: str = "card_id string, ord long, action string, edited_text string, at timestamp") -> DataFrame:
    return spark.readStream.schema(schema).json(path)


def feedback_rates(feedback: DataFrame, width: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    """Actions by window; rows later than the watermark are left out."""
    return feedback.withWatermark("at", late).groupBy(F.window("at", width), "action").agg(F.count(F.lit(1)).alias("n"))
