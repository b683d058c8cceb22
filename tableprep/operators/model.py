"""Model choice and scoring: hash split, data analysis, the size/shape rule table, MLlib
estimators standing in for the single-machine models, and metrics as aggregates.

Metrics are DataFrame aggregates (confusion counts are at most classes^2 rows), so they
run where the predictions are.
"""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.ml.classification import (DecisionTreeClassifier, GBTClassifier, LinearSVC, LogisticRegression,
                                       RandomForestClassifier)
from pyspark.ml.regression import GBTRegressor, LinearRegression
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tableprep.operators import slots as SL
from tableprep.operators.encode import hash_bucket
from tableprep.operators.svc import WideOneVsRest

UNLIMITED_DEPTH = 30            # MLlib's deepest tree stands in for "no depth limit"
# Deep forests train level by level; larger node batches and a (checkpointed) node-id
# cache cut the number of passes over the data about ninefold at depth 30; the cache is
# checkpointed to the reliable dir every 10 iterations.
FOREST_OPTS = dict(maxMemoryInMB=1024, cacheNodeIds=True, checkpointInterval=10)
SGD_ALPHA = 1e-4


def hash_split(df: DataFrame, id_col: str, test_percent: int = 20) -> tuple[DataFrame, DataFrame]:
    """Deterministic train/test split: md5 bucket of the row id, bucket < test_percent is test."""
    b = hash_bucket(id_col, 100)
    return df.where(b >= test_percent), df.where(b < test_percent)


@dataclass
class DataMeta:
    n_samples: int
    n_features: int
    is_sparse: bool
    density: float | None


def analyze(df: DataFrame, features_col: str = "features", is_sparse: bool = False) -> DataMeta:
    """Rows, width, and (sparse input) density = non-zeros / (rows x width), one job."""
    if SL.is_sparse(df, features_col):  # no buffer of the whole width in any task
        v = F.unwrap_udt(F.col(features_col))
        n, d, nnz = df.agg(F.count(F.lit(1)), F.max(F.coalesce(v["size"], F.size(v["values"]))),
                           F.sum(F.size(F.filter(v["values"], lambda x: x != 0)))).first()
        return DataMeta(n, d, is_sparse, nnz / (n * d) if is_sparse and n and d else None)
    s = df.select(Summarizer.metrics("count", "numNonZeros").summary(F.col(features_col)).alias("s")).first()["s"]
    nnz = s["numNonZeros"].toArray()
    n, d = int(s["count"]), len(nnz)
    density = float(nnz.sum()) / (n * d) if (is_sparse and n and d) else None
    return DataMeta(n, d, is_sparse, density)


# The rule table (fixed values): sparse input, then width over 500, then rows below 1,000 and below 10,000, then the rest.
RULES = (
    ("LogisticRegression(sgd-log)", "LinearRegression(sgd)"),
    ("LinearSVC(sgd-hinge)", "LinearRegression(sgd)"),
    ("LogisticRegression", "LinearRegression"),
    ("DecisionTreeClassifier(depth=10)", "RandomForestRegressor(100)"),
    ("RandomForestClassifier(200)", "RandomForestRegressor(200)"),
)


def model_rule(n_samples: int, n_features: int, is_sparse: bool, task: str) -> str:
    """The rule table (classification / regression)."""
    tests = (is_sparse, n_features > 500, n_samples < 1000, n_samples < 10000, True)
    return RULES[tests.index(True)][0 if task == "classification" else 1]


def model_rule_expr(n: Column, d: Column, sparse: Column, task: Column) -> Column:
    """The same rule table as a Column expression (for profiles computed on the cluster)."""
    tests = (sparse, d > 500, n < 1000, n < 10000, F.lit(True))
    picks = [F.when(t, F.when(task == F.lit("classification"), c).otherwise(r)) for t, (c, r) in zip(tests, RULES)]
    return F.coalesce(*picks)


def build_estimator(name: str, n_classes: int = 2, n_train: int = 1, features_col: str = "features",
                    label_col: str = "label", seed: int = 42, **params):
    """MLlib estimator for a rule-table name (parameters may override the defaults; ``parallelism`` says how many classes of
    a one-vs-rest model are fitted at a time)."""
    common = dict(featuresCol=features_col, labelCol=label_col)
    if name == "LogisticRegression":
        c = params.get("C", 1.0)
        return LogisticRegression(maxIter=1000, regParam=1.0 / (c * max(n_train, 1)), standardization=False,
                                  **common)
    if name == "LogisticRegression(sgd-log)":
        return LogisticRegression(maxIter=1000, regParam=params.get("alpha", SGD_ALPHA), standardization=False,
                                  **common)
    if name == "LinearSVC(sgd-hinge)":
        svc = LinearSVC(maxIter=1000, regParam=params.get("alpha", SGD_ALPHA), standardization=False, **common)
        return svc if n_classes <= 2 else WideOneVsRest(classifier=svc, parallelism=params.get("parallelism", 1), **common)
    if name == "LinearRegression":
        return LinearRegression(regParam=0.0, solver="normal", **common)
    if name == "LinearRegression(sgd)":
        return LinearRegression(regParam=params.get("alpha", SGD_ALPHA), standardization=False, **common)
    if name.startswith("DecisionTreeClassifier"):
        return DecisionTreeClassifier(maxDepth=params.get("max_depth", 10), seed=seed, **common)
    if name.startswith("RandomForestClassifier"):
        trees = params.get("n_estimators", 200 if "200" in name else 100)
        _checkpoint_dir()
        return RandomForestClassifier(numTrees=trees, maxDepth=params.get("max_depth") or UNLIMITED_DEPTH,
                                      seed=seed, **FOREST_OPTS, **common)
    if name.startswith("RandomForestRegressor"):
        from tableprep.operators.forest import ForestRegressor
        trees = params.get("n_estimators", 200 if "200" in name else 100)
        _checkpoint_dir()
        return ForestRegressor(trees, params.get("max_depth") or UNLIMITED_DEPTH, seed, features_col, label_col)
    if name.startswith("GBTClassifier") and n_classes > 2:
        from tableprep.operators.boost import BoostedClassifier
        return BoostedClassifier(n_classes, params.get("n_estimators", 100), params.get("learning_rate", 0.1),
                                 params.get("max_depth", 3), seed, features_col, label_col)
    if name.startswith("GBTClassifier"):
        return GBTClassifier(maxIter=params.get("n_estimators", 100), stepSize=params.get("learning_rate", 0.1),
                             maxDepth=3, seed=seed, **common)
    if name.startswith("GBTRegressor"):
        return GBTRegressor(maxIter=params.get("n_estimators", 100), stepSize=params.get("learning_rate", 0.1),
                            maxDepth=3, seed=seed, **common)
    raise ValueError(f"Unknown model: {name}")


def _checkpoint_dir() -> None:
    from pyspark.sql import SparkSession

    from tableprep.session import ensure_checkpoint_dir
    spark = SparkSession.getActiveSession()
    if spark is not None:
        ensure_checkpoint_dir(spark)


# ----------------------------------------------------------------------------------------
# metrics
# ----------------------------------------------------------------------------------------

def classification_metrics(df: DataFrame, label: str, pred: str) -> DataFrame:
    """One row: accuracy and support-weighted F1 (F1_c = 2 tp / (support_c + predicted_c)).

    The confusion counts are one aggregate; each count goes to its label's and its prediction's class in a second one.
    """
    kind = df.schema[label].dataType
    conf = df.groupBy(F.col(label).alias("l"), F.col(pred).cast(kind).alias("p")).agg(F.count(F.lit(1)).alias("n"))
    n, zero = F.col("n"), F.lit(0).cast("long")
    sides = F.array(
        F.struct(F.col("l").alias("c"), n.alias("support"), zero.alias("predicted"),
                 F.when(F.col("l") == F.col("p"), n).otherwise(zero).alias("tp")),
        F.struct(F.col("p").alias("c"), zero.alias("support"), n.alias("predicted"), zero.alias("tp")))
    per = conf.select(F.explode(sides).alias("s")).select("s.*").groupBy("c").agg(
        *[F.sum(c).alias(c) for c in ("support", "predicted", "tp")])
    f1 = 2.0 * F.col("tp") / (F.col("support") + F.col("predicted"))
    return per.agg(F.try_divide(F.sum("tp"), F.sum("support")).alias("accuracy"),
                   F.try_divide(F.sum(f1 * F.col("support")), F.sum("support")).alias("f1_weighted"))


def regression_metrics(df: DataFrame, label: str, pred: str) -> DataFrame:
    """One row: R^2 = 1 - SSE/SST and RMSE."""
    y, p = F.col(label).cast("double"), F.col(pred).cast("double")
    stats = df.agg(F.sum((y - p) * (y - p)).alias("sse"), F.var_pop(y).alias("vy"), F.count(F.lit(1)).alias("n"))
    # a constant label has no variance: R^2 is undefined (null), never a division error under ANSI
    return stats.select((F.lit(1.0) - F.try_divide(F.col("sse"), F.col("vy") * F.col("n"))).alias("r2"),
                        F.sqrt(F.col("sse") / F.col("n")).alias("rmse"))


def higher_is_better(metric: str) -> bool:
    return metric != "rmse"


def score(df: DataFrame, task: str, label: str, pred: str = "prediction", metric: str = "auto") -> float:
    """Selector metric: accuracy (or f1) for classes, R^2 (or rmse) for regression. One aggregate row comes back."""
    if task == "classification":
        row = classification_metrics(df, label, pred).first()
        value = row["f1_weighted"] if metric == "f1" else row["accuracy"]
    else:
        row = regression_metrics(df, label, pred).first()
        value = row["rmse"] if metric == "rmse" else row["r2"]
    return float(value) if value is not None else 0.0


def index_label(df: DataFrame, label: str, out: str = "label_idx"):
    """Classes -> 0..k-1 in sorted order (MLlib classifiers need numeric labels); fit it on all labelled rows, so that a
    class found only in the test split has its number too."""
    from tableprep.operators.encode import CategoryIndexer
    model = CategoryIndexer([label], "_no", "minus_one").fit(df.where(F.col(label).isNotNull()))
    return model, index_with(model, df, label, out)


def index_with(model, df: DataFrame, label: str, out: str) -> DataFrame:
    """Apply a fitted label index to ``label``, writing ``out``."""
    source = f"_class_of_{label}"
    named = df.withColumn(source, F.col(label).cast("string"))
    mapped = type(model)([source], "_no", model.unknown, model.table, model.sizes, model.map_bytes).transform(named)
    mapped = mapped.drop(source, *([out] if out != label and out in df.columns else [])).withColumnRenamed(f"{source}_no", out)
    classes = {"ml_attr": {"type": "nominal", "name": out, "num_vals": model.sizes[0]}}
    return mapped.withMetadata(out, classes)


@dataclass
class TrainResult:
    model: object
    name: str
    val_score: float
    train_score: float
    seconds: float


def train_and_score(estimator, name: str, train: DataFrame, test: DataFrame, task: str, label: str,
                    metric: str = "auto") -> TrainResult:
    """Fit on train, score on test and on train (the train score is kept for the run log)."""
    t0 = time.time()
    model = estimator.fit(train)
    if hasattr(model, "scores"):  # a forest, whose long walks are dealt out
        val, tr = (model.scores(df, label, metric, [(model.n_trees, model.max_depth)])[0] for df in (test, train))
    else:
        val, tr = (score(model.transform(df), task, label, "prediction", metric) for df in (test, train))
    return TrainResult(model, name, val, tr, time.time() - t0)
