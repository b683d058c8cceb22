"""Gradient boosting for more than two classes: one regression tree a class and step on the softmax residuals.

MLlib boosts two classes only. Here the scores start at the log shares of the classes; a step fits K trees to the residuals
``y_k - p_k`` of the current probabilities, and a leaf adds ``(K - 1) / K * sum r / sum |r| (1 - |r|)`` over its rows (one
Newton step of the multinomial loss), times the learning rate. The leaf sums of all K trees come from one aggregate whose
groups are the leaves, so at most ``K * 2^depth`` rows reach the driver. The rows and their scores are checkpointed once a
step, so lineage does not grow with the steps and a lost executor costs one step at most.
"""

from __future__ import annotations

import math

from pyspark.ml import Estimator, Model
from pyspark.ml.functions import array_to_vector
from pyspark.ml.param.shared import HasPredictionCol, HasProbabilityCol
from pyspark.ml.regression import DecisionTreeRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tableprep.persist import Saved
from tableprep.session import cut_lineage


def softmax(scores: Column) -> Column:
    """Probabilities of an array of scores; the largest is taken off first, so no exponential overflows."""
    raised = F.transform(scores, lambda x: F.exp(x - F.array_max(scores)))
    return F.transform(raised, lambda x: x / F.aggregate(raised, F.lit(0.0), lambda a, b: a + b))


def _stepped(df: DataFrame, trees: list, values: list[list[float]], scores: str) -> DataFrame:
    """Adds each class's leaf value to its score."""
    out = df
    for k, tree in enumerate(trees):
        out = tree.copy()._set(leafCol=f"_leaf{k}", predictionCol=f"_tree{k}").transform(out)
    added = F.array(*[F.get(F.col(scores), k) + F.get(F.lit([float(v) for v in values[k]]), F.col(f"_leaf{k}").cast("int"))
                      for k in range(len(trees))])
    return out.withColumn(scores, added).drop(*[f"_{c}{k}" for c in ("leaf", "tree") for k in range(len(trees))])


class BoostedClassifier(Estimator):
    """Classes are numbered 0..n_classes-1 in ``label_col``."""

    def __init__(self, n_classes: int, n_estimators: int = 100, learning_rate: float = 0.1, max_depth: int = 3,
                 seed: int = 42, features_col: str = "features", label_col: str = "label"):
        super().__init__()
        self.n_classes, self.n_estimators, self.learning_rate = n_classes, n_estimators, learning_rate
        self.max_depth, self.seed, self.features_col, self.label_col = max_depth, seed, features_col, label_col

    def _fit(self, df: DataFrame) -> "BoostedModel":
        k_all = range(self.n_classes)
        x = self.features_col
        rows = df.select(x, F.col(self.label_col).cast("int").alias("_y"))
        counts = {r["_y"]: r["n"] for r in rows.groupBy("_y").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row a class
        total = sum(counts.values())
        # a class without rows keeps a score that no step moves far
        priors = [math.log(max(counts.get(k, 0), 1e-9) / total) if total else 0.0 for k in k_all]
        state = rows.withColumn("_f", F.lit(priors))
        steps = []
        for i in range(self.n_estimators if total else 0):
            state = cut_lineage(state.withColumn("_p", softmax(F.col("_f"))).select(
                x, "_y", "_f", *[((F.col("_y") == k).cast("double") - F.get("_p", F.lit(k))).alias(f"_r{k}") for k in k_all]))
            trees = [DecisionTreeRegressor(featuresCol=x, labelCol=f"_r{k}", maxDepth=self.max_depth, seed=self.seed + i,
                                           leafCol=f"_leaf{k}", predictionCol=f"_tree{k}").fit(state) for k in k_all]
            led = state
            for tree in trees:
                led = tree.transform(led)
            pairs = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.col(f"_leaf{k}").cast("int").alias("leaf"),
                                                 F.col(f"_r{k}").alias("r")) for k in k_all])).alias("e")
            sums = led.select(pairs).groupBy("e.k", "e.leaf").agg(
                F.sum("e.r").alias("r"), F.sum(F.abs("e.r") * (1 - F.abs("e.r"))).alias("h")).collect()
            share = (self.n_classes - 1) / self.n_classes
            values = [[0.0] * (max((r["leaf"] for r in sums if r["k"] == k), default=0) + 1) for k in k_all]
            for r in sums:
                values[r["k"]][r["leaf"]] = self.learning_rate * share * r["r"] / r["h"] if r["h"] > 1e-12 else 0.0
            steps.append((trees, values))
            state = _stepped(state.select(x, "_y", "_f"), trees, values, "_f")
        return BoostedModel(self.n_classes, self.features_col, priors, steps)


class BoostedModel(Saved, Model, HasPredictionCol, HasProbabilityCol):
    """Probability vector and class of the largest probability (the smallest class on ties)."""

    def __init__(self, n_classes: int, features_col: str, priors: list[float], steps: list):
        super().__init__()
        self.n_classes, self.features_col, self.priors, self.steps = n_classes, features_col, priors, steps

    @property
    def numClasses(self) -> int:
        return self.n_classes

    def _transform(self, df: DataFrame) -> DataFrame:
        prediction = self.getPredictionCol() if self.isDefined(self.predictionCol) else "prediction"
        probability = self.getProbabilityCol() if self.isDefined(self.probabilityCol) else "probability"
        out = df.withColumn("_f", F.lit(self.priors))
        for trees, values in self.steps:
            out = _stepped(out, trees, values, "_f")
        out = out.withColumn("_p", softmax(F.col("_f")))
        best = (F.array_position("_p", F.array_max("_p")) - 1).cast("double")
        return out.withColumns({probability: array_to_vector("_p"), prediction: best}).drop("_f", "_p")
