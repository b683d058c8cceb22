"""Ensembles of fitted MLlib models: soft voting / averaging, weighted, stacking, none.

Base models are applied one after another on the same rows with distinct output
columns (no join); combining is column arithmetic. Stacking builds out-of-fold
predictions with hash folds of the row id and a union of the held-out folds.
"""

from __future__ import annotations

from functools import reduce

from pyspark.ml import Model
from pyspark.ml.classification import LogisticRegression, OneVsRestModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import LinearRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tableprep.operators.encode import hash_bucket
from tableprep.persist import Saved

METHODS = ("voting", "stacking", "weighted", "none")


def _with_outputs(model, i: int):
    """Copy of a fitted model writing to column names of its own."""
    m = model.copy()
    for param, name in (("predictionCol", f"_p{i}"), ("probabilityCol", f"_prob{i}"),
                        ("rawPredictionCol", f"_raw{i}")):
        # a one-vs-rest model keeps its raw column's name; it is dropped after use
        if m.hasParam(param) and not (param == "rawPredictionCol" and isinstance(m, OneVsRestModel)):
            m._set(**{param: name})
    return m


def _has_probability(model) -> bool:
    return model.hasParam("probabilityCol")


def weighted_average(preds: list[Column], weights: list[float] | None = None, classification: bool = False):
    """sum(w_i p_i) / sum(w); classes round half to even."""
    w = weights or [1.0] * len(preds)
    if len(w) != len(preds):
        raise ValueError(f"{len(preds)} models need as many weights, not {len(w)}")
    total = reduce(lambda a, b: a + b, [F.lit(float(x)) * p for x, p in zip(w, preds)]) / F.lit(float(sum(w)))
    return F.bround(total, 0) if classification else total


def hard_vote(preds: list[Column]) -> Column:
    """Most common prediction, smallest class on ties."""
    arr = F.array(*preds)
    counted = F.transform(F.array_distinct(arr),
                          lambda v: F.struct((-F.size(F.filter(arr, lambda x: x == v))).alias("n"), v.alias("v")))
    return F.array_min(counted)["v"]


def meta_features(df: DataFrame, models: list, n_classes: int) -> DataFrame:
    """``_meta_x`` for stacking: a class model gives its probability vector (without one, its class as ones and zeros,
    so that class numbers never count as magnitudes), a regression model its prediction."""
    if not n_classes:
        return VectorAssembler(inputCols=[f"_p{i}" for i in range(len(models))], outputCol="_meta_x").transform(df)
    parts = [vector_to_array(f"_prob{i}") if _has_probability(m) else
             F.array(*[(F.col(f"_p{i}") == c).cast("double") for c in range(n_classes)]) for i, m in enumerate(models)]
    return df.withColumn("_meta_x", array_to_vector(F.concat(*parts)))


class EnsembleModel(Saved, Model):
    def __init__(self, models, method, task, weights=None, meta=None, output_col="prediction", n_classes=0):
        super().__init__()
        self.models, self.method, self.task, self.n_classes = models, method, task, n_classes
        self.weights, self.meta, self.output_col = weights, meta, output_col

    def _base_outputs(self, df: DataFrame) -> DataFrame:
        out = df
        for i, m in enumerate(self.models):
            out = _with_outputs(m, i).transform(out)
            if isinstance(m, OneVsRestModel) and "rawPrediction" not in df.columns:
                out = out.drop("rawPrediction")
        return out

    def _transform(self, df: DataFrame) -> DataFrame:
        cls = self.task == "classification"
        if self.method == "none":
            return self.models[0].transform(df)
        out = self._base_outputs(df)
        preds = [F.col(f"_p{i}") for i in range(len(self.models))]
        tmp = [c for c in out.columns if c not in df.columns]
        if self.method == "weighted":
            res = out.withColumn(self.output_col, weighted_average(preds, self.weights, cls))
        elif self.method == "voting":
            if not cls:
                res = out.withColumn(self.output_col, weighted_average(preds))
            elif all(_has_probability(m) for m in self.models):
                probs = [vector_to_array(f"_prob{i}") for i in range(len(self.models))]
                mean = reduce(lambda a, b: F.zip_with(a, b, lambda x, y: x + y), probs)
                res = out.withColumn("_mean_prob", mean).withColumn(
                    self.output_col, (F.array_position(F.col("_mean_prob"), F.array_max("_mean_prob")) - 1)
                    .cast("double")).drop("_mean_prob")
            else:
                res = out.withColumn(self.output_col, hard_vote(preds))
        else:  # stacking
            res = self.meta.transform(meta_features(out, self.models, self.n_classes))
            tmp.append("_meta_x")
            for c in ("rawPrediction", "probability"):
                if c in res.columns and c not in df.columns:
                    tmp.append(c)
        return res.drop(*[c for c in tmp if c != self.output_col])


def build_ensemble(estimators: list, method: str, task: str, train: DataFrame, label: str,
                   id_col: str | None = None, weights: list[float] | None = None, folds: int = 5) -> EnsembleModel:
    """Fit the base estimators (and the meta model for stacking) on ``train``."""
    if method not in METHODS:
        raise ValueError(f"method is one of {METHODS}, not {method}")
    cls = task == "classification"
    if method == "none":
        return EnsembleModel([estimators[0].fit(train)], "none", task)
    if method != "stacking":
        models = [e.fit(train) for e in estimators]
        return EnsembleModel(models, method, task, weights=weights)
    if id_col is None:
        raise ValueError("stacking needs a row id for its folds")
    fold = hash_bucket(id_col, folds)
    n_classes = int(train.agg(F.max(label)).first()[0] or 0) + 1 if cls else 0
    held = []
    for f in range(folds):
        fit_part, hold = train.where(fold != f), train.where(fold == f)
        fitted = [e.fit(fit_part) for e in estimators]
        out = hold
        for i, m in enumerate(fitted):
            out = _with_outputs(m, i).transform(out)
            if isinstance(m, OneVsRestModel):
                out = out.drop("rawPrediction")
        held.append(meta_features(_same_length(out, fitted, n_classes), fitted, n_classes).select(label, "_meta_x"))
    oof = reduce(lambda a, b: a.unionByName(b), held)
    meta_est = (LogisticRegression(maxIter=100) if cls else LinearRegression())
    meta = meta_est.setFeaturesCol("_meta_x").setLabelCol(label).fit(oof)
    models = [e.fit(train) for e in estimators]
    return EnsembleModel(models, "stacking", task, meta=meta, n_classes=n_classes)


def _same_length(df: DataFrame, models: list, n_classes: int) -> DataFrame:
    """Probability vectors of ``n_classes`` values each: a fold that lacks the last classes yields shorter ones."""
    for i, m in enumerate(models):
        if n_classes and _has_probability(m) and m.numClasses < n_classes:
            fill = F.array_repeat(F.lit(0.0), n_classes - m.numClasses)
            df = df.withColumn(f"_prob{i}", array_to_vector(F.concat(vector_to_array(f"_prob{i}"), fill)))
    return df
