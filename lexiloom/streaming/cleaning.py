"""Cleaning of streams: the array operators hold no state, so the batch functions serve."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiloom.operators.documents import clean


def clean_stream(spark: SparkSession, path: str, schema: str, **options) -> DataFrame:
    """Cleaned documents of a directory that Parquet files (doc_id, text, ...) keep coming to."""
    docs = spark.readStream.schema(schema).parquet(path)
    return clean(docs.withColumn("sentences", F.split("text", "\n")), **options)
