"""Streaming use of the fitted stages.

The fitted cleaning (without its row-dropping dedup), feature, encoding, scaling and
selection stages are projections and broadcast lookups, so a fitted ``PipelineModel``
applies to a streaming DataFrame unchanged. Deduplication on a stream needs state:
``dedup_stream`` keeps the first row per feature combination with Spark's own
watermarked ``dropDuplicatesWithinWatermark`` state store.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tableprep.functions.text import clean_text


def read_parquet_stream(spark: SparkSession, path: str, schema, max_files_per_trigger: int = 1) -> DataFrame:
    """Parquet files arriving in a folder; a single-file table streams from its folder
    with a name filter."""
    import os
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files_per_trigger)
    if path.endswith(".parquet") and not os.path.isdir(path):
        return reader.option("pathGlobFilter", os.path.basename(path)).parquet(os.path.dirname(path))
    return reader.parquet(path)


def clean_text_stream(stream: DataFrame, text_col: str, out_col: str = "text_clean", **options) -> DataFrame:
    """Stateless text cleaning of every arriving row."""
    return stream.withColumn(out_col, clean_text(text_col, **options))


def score_stream(model, stream: DataFrame) -> DataFrame:
    """Apply a fitted stateless model (e.g. ``PipelineResult.model``) to a stream."""
    return model.transform(stream)


def dedup_stream(stream: DataFrame, feature_cols: list[str], event_time: str, delay: str = "10 minutes") -> DataFrame:
    """Drop repeated feature combinations seen within the watermark delay."""
    return stream.withWatermark(event_time, delay).dropDuplicatesWithinWatermark(feature_cols)


def event_counts_stream(stream: DataFrame, time_col: str, window: str = "1 hour",
                        delay: str = "10 minutes") -> DataFrame:
    """Windowed event-type counts with a watermark (late rows beyond the delay are dropped)."""
    return (stream.withWatermark(time_col, delay)
            .groupBy(F.window(time_col, window), "event_type").agg(F.count(F.lit(1)).alias("n")))
