"""Parquet table loading and the derived fixture views.

The derived views are defined once as SQL text that both Spark and DuckDB run
unchanged, so a query and its oracle start from the same rows.
"""

from __future__ import annotations

import os
import re

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

# Fixed definitions of the derived views (shared verbatim by Spark and the DuckDB oracle).
VIEW_SQL = {
    # orders with missing and extreme values: o_totalprice null for every 7th key and x20 for
    # key % 101 = 1, priority null for every 11th key, and a 50 % missing note column.
    "dirty_orders": """
        SELECT o_orderkey, o_custkey, o_orderstatus,
               CASE WHEN o_orderkey % 7 = 0 THEN NULL
                    WHEN o_orderkey % 101 = 1 THEN o_totalprice * 20
                    ELSE o_totalprice END AS o_totalprice,
               o_orderdate,
               CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE o_orderpriority END AS o_orderpriority,
               CASE WHEN o_orderkey % 2 = 0 THEN NULL ELSE o_orderstatus END AS o_note
        FROM orders""",
    # part with numeric text: size_txt parses for 80 % of rows, brand_txt never
    "dirty_part": """
        SELECT p_partkey, p_retailprice,
               CASE WHEN p_partkey % 5 = 0 THEN p_type ELSE CAST(p_size AS STRING) END AS size_txt,
               p_brand AS brand_txt
        FROM part""",
    # many repeated feature rows that carry different labels
    "dup_events": """
        SELECT event_id AS row_id, event_type, user_id % 20 AS user_bucket,
               CAST(floor(value / 50) AS BIGINT) AS value_bucket,
               CAST(event_id % 3 AS BIGINT) AS label
        FROM events""",
    # orders with a constant feature
    "const_features": """
        SELECT o_orderkey, o_totalprice, CAST(o_orderkey % 13 AS DOUBLE) AS k13,
               CAST(7.0 AS DOUBLE) AS k_const
        FROM orders""",
    # documents with their labels (unlabelled rows excluded)
    "text_corpus": """
        SELECT d.doc_id, d.text, d.lang, d.source, l.quality, l.toxic
        FROM documents d JOIN labels l ON d.doc_id = l.doc_id""",
    # per-row baseline predictors: mean price of the priority, majority status (ties by value)
    "baseline_pred": """
        WITH pm AS (SELECT o_orderpriority, avg(o_totalprice) AS pred_price
                    FROM orders GROUP BY o_orderpriority),
             sc AS (SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY o_orderstatus),
             maj AS (SELECT o_orderstatus AS pred_status FROM sc
                     ORDER BY n DESC, o_orderstatus LIMIT 1)
        SELECT o.o_orderkey, o.o_totalprice, o.o_orderstatus, pm.pred_price, maj.pred_status
        FROM orders o JOIN pm ON o.o_orderpriority = pm.o_orderpriority CROSS JOIN maj""",
    # orders with NaN prices and missing dates
    "nan_orders": """
        SELECT o_orderkey, o_orderpriority,
               CASE WHEN o_orderkey % 5 = 0 THEN CAST('NaN' AS DOUBLE)
                    WHEN o_orderkey % 13 = 0 THEN NULL ELSE o_totalprice END AS price,
               CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE CAST(CAST(o_orderdate AS DATE) AS TIMESTAMP) END AS placed
        FROM orders""",
    # run log derived from events: eight consecutive event ids make a run
    "run_log": """
        SELECT CAST(floor(event_id / 8e0) AS BIGINT) AS run_id, CAST(event_id % 8 + 1 AS BIGINT) AS stage_idx,
               (event_id % 97) / 97e0 AS val_score,
               (event_id * 7 % 89) / 89e0 AS train_score,
               value / 10 AS seconds,
               event_id % 700 + 1 AS n_features,
               CASE event_type WHEN 'click' THEN 'RandomForestClassifier'
                               WHEN 'view' THEN 'LogisticRegression'
                               WHEN 'error' THEN 'GBTClassifier'
                               WHEN 'purchase' THEN 'DecisionTreeClassifier'
                               ELSE 'LinearSVC' END AS model_name
        FROM events""",
}


def table_path(sf_dir: str, name: str) -> str:
    return os.path.join(sf_dir, f"{name}.parquet")


# Tables whose rows carry long text: per-row work (regex cleaning, tokenizing) dominates.
TEXT_TABLES = ("documents", "pages", "conversations", "benchmark")


def read_table(spark: SparkSession, sf_dir: str, name: str, spread: bool | None = None) -> DataFrame:
    """Scan one table. For text tables whose files give fewer splits than the cluster has
    cores (a single-row-group file is one task), rows are spread round-robin so the
    per-row text work before the first shuffle runs on every core. Numeric tables are
    scanned as is: their per-row work is cheap and their fits make several passes, each of
    which would pay the extra shuffle. With many splits, as at large scale, nothing changes."""
    df = spark.read.parquet(table_path(sf_dir, name))
    return spread_rows(df) if (name in TEXT_TABLES if spread is None else spread) else df


def spread_rows(df: DataFrame, min_partitions: int | None = None) -> DataFrame:
    want = min_partitions or df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(want) if df.rdd.getNumPartitions() < want else df


def register_tables(spark: SparkSession, sf_dir: str, names=TABLES) -> None:
    for name in names:
        read_table(spark, sf_dir, name).createOrReplaceTempView(name)


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One derived view as a DataFrame; the base tables that it names are registered first."""
    register_tables(spark, sf_dir, [t for t in TABLES if re.search(rf"\b{t}\b", VIEW_SQL[name])])
    return spark.sql(VIEW_SQL[name])
