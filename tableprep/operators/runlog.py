"""Run log scoring: a score per pipeline stage, a leaderboard per run, and long-form
stage reports.

The score is one projection with a ``lag`` over each run's stages (a run has at most a
handful of stages, so each window partition is tiny), for any number of runs at once.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Fixed weights and limits of the stage score.
IMPROVEMENT_WEIGHT = 0.2
OVERFIT_WEIGHT = 0.3
TIME_WEIGHT = 0.2
TIME_SCALE = 10.0
WIDTH_WEIGHT = 0.1
HEAVY_MODEL_PENALTY = 0.08
WIDE_PENALTY = 0.08
WIDE_FEATURES = 500
BALANCE_BONUS = 0.05
BALANCE_GAP = 0.05
CLIP_LOW, CLIP_HIGH = 0.01, 0.99
TEXT_SCORE = 0.3
SUCCESS_THRESHOLD = 0.5
HEAVY_MODEL_MARKERS = ("RandomForest", "Boost", "GBT")


def stage_scores(log: DataFrame, task_col: str | None = None, metric: str = "auto") -> DataFrame:
    """Adds ``score`` to a run log (run_id, stage_idx, val_score, train_score, seconds,
    n_features, model_name[, task]).

    score = val + 0.2 (val - previous val) - 0.3 max(0, train - val) - 0.2 tanh(seconds / 10)
            + 0.1 / (1 + ln(1 + n_features)), -0.08 for forest/boosting models, -0.08 above
            500 features, +0.05 when |train - val| < 0.05, clipped to [0.01, 0.99];
            text runs score 0.3. An error (RMSE of a regression) enters everywhere as its share of goodness
            1 / (1 + error), so that a smaller error never scores less; a stage of 0.5 that fits no model stays 0.5.
    """
    w = Window.partitionBy("run_id").orderBy("stage_idx")
    task = F.col(task_col) if task_col else F.lit("classification")
    error = (task == "regression") & F.lit(metric == "rmse") & (F.col("model_name") != "none")
    val, tr = [F.when(error, 1.0 / (1.0 + F.col(c))).otherwise(F.col(c)) for c in ("val_score", "train_score")]
    prev = F.coalesce(F.lag(val, 1).over(w), F.lit(0.0))
    raw = (val + F.lit(IMPROVEMENT_WEIGHT) * (val - prev)
           - F.lit(OVERFIT_WEIGHT) * F.greatest(F.lit(0.0), tr - val)
           - F.tanh(F.col("seconds") / F.lit(TIME_SCALE)) * F.lit(TIME_WEIGHT)
           + F.lit(WIDTH_WEIGHT) * (F.lit(1.0) / (F.lit(1.0) + F.log1p(F.col("n_features")))))
    heavy = F.lit(False)
    for marker in HEAVY_MODEL_MARKERS:
        heavy = heavy | F.col("model_name").contains(marker)
    raw = raw - F.when(heavy, HEAVY_MODEL_PENALTY).otherwise(0.0)
    raw = raw - F.when(F.col("n_features") > WIDE_FEATURES, WIDE_PENALTY).otherwise(0.0)
    raw = raw + F.when(F.abs(tr - val) < BALANCE_GAP, BALANCE_BONUS).otherwise(0.0)
    clipped = F.least(F.greatest(raw, F.lit(CLIP_LOW)), F.lit(CLIP_HIGH))
    return log.withColumn("score", F.when(task == "text", F.lit(TEXT_SCORE)).otherwise(clipped))


def leaderboard(scored: DataFrame, total_stages: int = 8) -> DataFrame:
    """Per run: stages done, mean score clipped to [0, 1], success flag, progress."""
    mean = F.least(F.greatest(F.avg("score"), F.lit(0.0)), F.lit(1.0))
    return scored.groupBy("run_id").agg(F.count(F.lit(1)).alias("n_stages"), mean.alias("mean_score")).select(
        "run_id", "n_stages", "mean_score", (F.col("mean_score") >= SUCCESS_THRESHOLD).alias("success"),
        (F.col("n_stages") / F.lit(float(total_stages))).alias("progress"))


def report_frame(spark: SparkSession, run_id: str, reports: dict) -> DataFrame:
    """Long-form stage report (run_id, stage, key, value as JSON text)."""
    rows = [(run_id, stage, k, json.dumps(v, default=str)) for stage, rep in reports.items() for k, v in rep.items()]
    return spark.createDataFrame(rows, "run_id string, stage string, key string, value string")
