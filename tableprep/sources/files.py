"""File scans and modality routing (CSV, text lines, single-column CSV as text).

Routing looks at the file name and, for CSV, at the header only (no data pass).
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

STRUCTURED_STAGES = ("cleaning", "encoding", "engineering", "scaling", "selection",
                     "model_select", "tuning", "ensemble")
TEXT_STAGES = ("cleaning", "model_select", "tuning", "ensemble")


def read_csv(spark: SparkSession, path: str, schema=None, infer_schema: bool = True) -> DataFrame:
    """Header row and inferred types. An explicit schema avoids the inference pass at scale."""
    reader = spark.read.option("header", True).option("mode", "PERMISSIVE")
    if schema is not None:
        return reader.schema(schema).csv(path)
    return reader.option("inferSchema", infer_schema).csv(path)


def read_text_lines(spark: SparkSession, path: str) -> DataFrame:
    """One row per line in column ``text``; line terminators are not kept."""
    return spark.read.text(path).withColumnRenamed("value", "text")


def preview(df: DataFrame, n: int = 5) -> DataFrame:
    return df.limit(n)


def rename_first_to_text(df: DataFrame) -> DataFrame:
    return df.withColumnRenamed(df.columns[0], "text")


def in_file_order(df: DataFrame, name: str = "row_number") -> DataFrame:
    """Number the rows of a file scan 0..n-1 in the order of the files (by path) and of the rows in them.

    A row is placed by its file, the start of its split and its place in the split; the splits' sizes, summed in order,
    give each split's first number. The numbers are the same however the files are split. The scan is written once to the
    checkpoint folder, so that both steps see the same splits; only the splits (one row each) meet in one task.
    """
    from tableprep.session import cut_lineage
    placed = cut_lineage(df.select("*", F.col("_metadata.file_path").alias("_file"),
                                   F.col("_metadata.file_block_start").alias("_start"),
                                   F.monotonically_increasing_id().alias("_at")))
    # the rows of a split are read one after another, so their running ids have no gap
    splits = placed.groupBy("_file", "_start").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_file", "_start").rowsBetween(Window.unboundedPreceding, -1)
    starts = splits.select("_file", "_start", "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    return placed.join(F.broadcast(starts), ["_file", "_start"]).withColumn(
        name, F.col("_before") + F.col("_at") - F.col("_first")).drop("_file", "_start", "_at", "_first", "_before")


@dataclass
class Dataset:
    """A loaded table with its modality, stage list and label column."""
    df: DataFrame
    modality: str                     # "structured" or "text"
    stages: tuple
    label_col: str | None
    feature_cols: list = field(default_factory=list)


def route(spark: SparkSession, path: str, target_column: str | None = None,
          id_cols: tuple = ()) -> Dataset:
    """Choose modality from the file name and CSV header width, then load.

    ``.txt`` -> text; ``.csv`` with one column -> text; other ``.csv`` -> structured.
    The label stays a column of the same DataFrame (last column unless named).
    """
    lower = path.lower()
    if lower.endswith(".txt"):
        df = read_text_lines(spark, path)
        return Dataset(df, "text", TEXT_STAGES, None, ["text"])
    if lower.endswith(".csv"):
        header = spark.read.option("header", True).csv(path).schema
        if len(header.fields) == 1:
            df = rename_first_to_text(spark.read.option("header", True).csv(path))
            return Dataset(df, "text", TEXT_STAGES, None, ["text"])
        df = read_csv(spark, path)
        label = target_column or df.columns[-1]
        if label not in df.columns:
            raise ValueError(f"{path} has no column named {label!r} to predict")
        feats = [c for c in df.columns if c != label and c not in id_cols]
        return Dataset(df, "structured", STRUCTURED_STAGES, label, feats)
    raise ValueError(f"{path}: only .txt and .csv files can be routed")


def with_dummy_label(df: DataFrame, name: str = "label") -> DataFrame:
    """Text datasets without supervision carry a constant label."""
    return df.withColumn(name, F.lit(0.0))
