"""Profiling: column kinds, dataset profile, text-column and numeric-text detection, task inference.

Each function runs one aggregate job over all the columns it looks at; the result is
a small DataFrame (one row per column or one row in total) or a small dict.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tableprep.functions.numeric import to_numeric
from tableprep.functions.text import as_text
from tableprep.operators.stats import missing

TEXT_MEAN_LENGTH = 20      # a string column with a longer mean length is free text
CLASS_LIMIT = 20           # fewer distinct labels than this means classification


def numeric_cols(df: DataFrame, exclude=()) -> list[str]:
    return [f.name for f in df.schema.fields
            if isinstance(f.dataType, (T.NumericType, T.BooleanType)) and f.name not in exclude]


def string_cols(df: DataFrame, exclude=()) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType) and f.name not in exclude]


def timestamp_cols(df: DataFrame, exclude=()) -> list[str]:
    return [f.name for f in df.schema.fields
            if isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType, T.DateType)) and f.name not in exclude]


def dataset_profile(df: DataFrame, exclude=()) -> DataFrame:
    """One row: n_samples, n_features, missing_values (null cells over all features)."""
    cols = [c for c in df.columns if c not in exclude]
    total = F.lit(0).cast("bigint")
    for c in cols:
        total = total + F.sum(missing(df, c).cast("bigint"))
    return df.agg(F.count(F.lit(1)).alias("n_samples"), F.lit(len(cols)).cast("bigint").alias("n_features"),
                  total.alias("missing_values"))


def column_null_ratios(df: DataFrame, cols=None) -> DataFrame:
    """Long form (column_name, null_ratio) from one aggregate job."""
    cols = list(cols or df.columns)
    wide = df.agg(*[F.avg(missing(df, c).cast("double")).alias(f"_{i}") for i, c in enumerate(cols)])
    return wide.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("column_name"), F.col(f"_{i}").alias("null_ratio")) for i, c in enumerate(cols)
    ])).alias("e")).select("e.*")


def text_columns(df: DataFrame, cols=None, threshold: float = TEXT_MEAN_LENGTH) -> DataFrame:
    """(column_name, mean_length, is_text): mean length of the string form, a null counting as 'nan'."""
    cols = list(cols or string_cols(df))
    wide = df.agg(*[F.avg(F.length(as_text(c))).alias(f"_{i}") for i, c in enumerate(cols)])
    return wide.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("column_name"), F.col(f"_{i}").alias("mean_length")) for i, c in enumerate(cols)
    ])).alias("e")).select("e.*").withColumn("is_text", F.col("mean_length") > F.lit(threshold))


def detect_text_columns(df: DataFrame, cols=None, threshold: float = TEXT_MEAN_LENGTH) -> list[str]:
    return [r["column_name"] for r in text_columns(df, cols, threshold).collect() if r["is_text"]]


def numeric_text_stats(df: DataFrame, cols=None, min_share: float = 0.5) -> DataFrame:
    """(column_name, non_null, parsed, converts): a string column converts to DOUBLE when
    at least ``min_share`` of its non-null values parse as numbers."""
    cols = list(cols or string_cols(df))
    exprs = []
    for i, c in enumerate(cols):
        exprs += [F.count(c).alias(f"n{i}"), F.count(to_numeric(c)).alias(f"p{i}")]
    wide = df.agg(*exprs)
    long = wide.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("column_name"), F.col(f"n{i}").alias("non_null"), F.col(f"p{i}").alias("parsed"))
        for i, c in enumerate(cols)])).alias("e")).select("e.*")
    return long.withColumn("converts", F.col("parsed") >= F.col("non_null") * F.lit(min_share))


def infer_task(df: DataFrame, label_col: str | None) -> str:
    """'text' without a label; classification for string labels or < 20 distinct values."""
    if label_col is None:
        return "text"
    n = df.select(label_col).where(F.col(label_col).isNotNull()).distinct().limit(CLASS_LIMIT).count()
    if n == 0:
        return "text"
    if isinstance(df.schema[label_col].dataType, T.StringType) or n < CLASS_LIMIT:
        return "classification"
    return "regression"


def task_summary(df: DataFrame, label_col: str, table: str) -> DataFrame:
    """One row (table_name, label_col, n_distinct, task) computed on the cluster."""
    is_string = isinstance(df.schema[label_col].dataType, T.StringType)
    agg = df.agg(F.countDistinct(label_col).alias("n_distinct"))
    task = (F.when(F.col("n_distinct") == 0, F.lit("text"))
            .when(F.lit(is_string) | (F.col("n_distinct") < CLASS_LIMIT), F.lit("classification"))
            .otherwise(F.lit("regression")))
    return agg.select(F.lit(table).alias("table_name"), F.lit(label_col).alias("label_col"),
                      F.col("n_distinct"), task.alias("task"))
