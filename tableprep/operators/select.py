"""Feature selection on a vector column: variance, correlation pruning, k-best by F
statistic, model importance, or none. The fitted model is a ``VectorSlicer``.

Per-feature statistics are computed with one distributed aggregate each
(``Summarizer``/``Correlation``, tree-aggregated), so the driver only sees d-long
vectors or a d x d correlation matrix.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.ml import Estimator, Model
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorSlicer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import RandomForestRegressor
from pyspark.ml.stat import Correlation, Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tableprep.operators import slots as SL
from tableprep.persist import Saved
from tableprep.session import ship_package

METHODS = ("variance", "correlation", "kbest", "model", "none")


@dataclass
class FeatureSelectionConfig:
    method: str = "variance"
    threshold: float = 0.01            # variance
    corr_threshold: float = 0.95       # correlation
    k: int = 50                        # kbest
    task: str = "auto"                 # classification / regression / auto
    seed: int = 42


def population_variances(df: DataFrame, col: str) -> np.ndarray:
    if SL.is_sparse(df, col):  # a row a slot that occurs, no buffer of the whole width in any task
        n, width = SL.rows_and_width(df, col)
        out = np.zeros(width)
        found = SL.slot_statistics(SL.entries(df, col), n).select("slot", "variance").toArrow()
        out[found["slot"].to_numpy()] = found["variance"].to_numpy()
        return out
    s = df.select(Summarizer.metrics("variance", "count").summary(F.col(col)).alias("s")).first()["s"]
    n = s["count"]
    return s["variance"].toArray() * ((n - 1) / n if n > 1 else 0.0)


def max_abs_corr_with_earlier(df: DataFrame, col: str) -> list[float | None]:
    """For feature j: max |r(i, j)| over i < j, NaN pairs (constant columns) ignored."""
    m = Correlation.corr(df.select(col), col, "pearson").first()[0].toArray()
    earlier = np.where(np.triu(np.ones(m.shape, bool), 1) & ~np.isnan(m), np.abs(m), -1.0).max(axis=0)
    return [None if v < 0 else float(v) for v in earlier]


def anova_f(df: DataFrame, col: str, label: str) -> list[float | None]:
    """One-way ANOVA F per feature from per-class means and variances (one grouped job)."""
    per = df.groupBy(label).agg(Summarizer.metrics("mean", "variance", "count").summary(F.col(col)).alias("s"))
    per = per.select(F.col("s.count").alias("n"), vector_to_array("s.mean").alias("m"), vector_to_array("s.variance").alias("v"))
    # over the classes: vectors of n m, n m^2 and (n - 1) v, summed element by element (one row comes back)
    n = F.col("n").cast("double")
    parts = per.select("n", array_to_vector(F.transform("m", lambda x: x * n)).alias("nm"),
                       array_to_vector(F.transform("m", lambda x: x * x * n)).alias("nmm"),
                       array_to_vector(F.transform("v", lambda x: F.when(n > 1, x * (n - 1)).otherwise(0.0))).alias("nv"))
    row = parts.agg(F.count(F.lit(1)).alias("k"), F.sum("n").alias("n"), *[
        Summarizer.metrics("sum").summary(F.col(c)).alias(c) for c in ("nm", "nmm", "nv")]).first()
    k, n = row["k"], float(row["n"])
    nm, nmm, ssw = (row[c]["sum"].toArray() for c in ("nm", "nmm", "nv"))
    ssb = np.maximum(nmm - nm * nm / n, 0.0)
    out = []
    for b, w in zip(ssb, ssw):
        msb, msw = b / (k - 1) if k > 1 else float("nan"), w / (n - k) if n > k else float("nan")
        out.append(None if (msw == 0 and msb == 0) or math.isnan(msb) or math.isnan(msw)
                   else (math.inf if msw == 0 else msb / msw))
    return out


def regression_f(df: DataFrame, col: str, label: str) -> list[float | None]:
    """F = r^2 / (1 - r^2) * (n - 2) per feature, r = Pearson(x, y), from one aggregate."""
    y = F.col(label).cast("double")
    prod = array_to_vector(F.transform(vector_to_array(col), lambda x: x * y))
    s = df.select(Summarizer.metrics("mean", "variance", "count").summary(F.col(col)).alias("x"),
                  Summarizer.mean(prod).alias("xy"), F.avg(y).alias("my"), F.var_pop(y).alias("vy")).first()
    n = s["x"]["count"]
    mx, vx = s["x"]["mean"].toArray(), s["x"]["variance"].toArray() * ((n - 1) / n)
    cov = s["xy"].toArray() - mx * s["my"]
    out = []
    for c, v in zip(cov, vx):
        if v == 0 or s["vy"] == 0:
            out.append(None)
            continue
        r2 = c * c / (v * s["vy"])
        out.append(math.inf if r2 >= 1 else r2 / (1 - r2) * (n - 2))
    return out


def top_k(scores: list[float | None], k: int) -> list[int]:
    """Indices of the k best scores, ties by index; missing scores rank last."""
    order = sorted(range(len(scores)), key=lambda i: (scores[i] is None, -(scores[i] or 0.0), i))
    return sorted(order[:min(k, len(scores))])


class FeatureSelector(Estimator):
    def __init__(self, input_col: str = "features", output_col: str = "selected", label_col: str | None = None,
                 config: FeatureSelectionConfig | None = None):
        super().__init__()
        self.input_col, self.output_col, self.label_col = input_col, output_col, label_col
        self.config = config or FeatureSelectionConfig()

    def statistics(self, df: DataFrame) -> tuple[list, list[int]]:
        """(statistic per feature, kept indices)."""
        cfg = self.config
        if cfg.method not in METHODS:
            raise ValueError(f"Unknown method: {cfg.method}")
        task = cfg.task
        if task == "auto" and self.label_col:
            from tableprep.operators.profile import infer_task
            task = infer_task(df, self.label_col)
        if cfg.method == "variance":
            v = population_variances(df, self.input_col)
            return list(map(float, v)), [i for i, x in enumerate(v) if x > cfg.threshold]
        if cfg.method == "correlation" and SL.is_sparse(df, self.input_col) and cfg.corr_threshold >= 0.5:
            # only pairs above the threshold are ever held; a slot goes if an earlier one is among its pairs
            _, width = SL.rows_and_width(df, self.input_col)
            found = SL.correlated_slots(df, self.input_col, cfg.corr_threshold).groupBy("j").agg(
                F.max(F.abs("r")).alias("r")).collect()
            above = {r["j"]: float(r["r"]) for r in found}
            return [above.get(i) for i in range(width)], [i for i in range(width) if i not in above]
        if cfg.method == "correlation":
            m = max_abs_corr_with_earlier(df, self.input_col)
            return m, [i for i, x in enumerate(m) if x is None or x <= cfg.corr_threshold]
        if cfg.method in ("kbest", "model") and not self.label_col:
            raise ValueError(f"{cfg.method} scores features against a label: name one")
        if cfg.method == "kbest":
            f = anova_f(df, self.input_col, self.label_col) if task == "classification" \
                else regression_f(df, self.input_col, self.label_col)
            return f, top_k(f, cfg.k)
        if cfg.method == "model":
            cls = RandomForestClassifier if task == "classification" else RandomForestRegressor
            label = self.label_col
            if dict(df.dtypes)[label] == "string":
                from tableprep.operators.model import index_label
                _, df = index_label(df, label, "_label_idx")
                label = "_label_idx"
            rf = cls(numTrees=100, seed=cfg.seed, featuresCol=self.input_col, labelCol=label).fit(df)
            imp = rf.featureImportances.toArray()
            thr = float(np.mean(imp))
            return list(map(float, imp)), [i for i, x in enumerate(imp) if x >= thr]
        width = len(df.select(self.input_col).first()[0])
        return [None] * width, list(range(width))

    def _fit(self, df: DataFrame) -> "FeatureSelectorModel":
        scores, keep = self.statistics(df)
        return FeatureSelectorModel(self.input_col, self.output_col, keep, scores)


class FeatureSelectorModel(Saved, Model):
    def __init__(self, input_col, output_col, indices, scores):
        super().__init__()
        self.input_col, self.output_col, self.indices, self.scores = input_col, output_col, indices, scores

    def _transform(self, df: DataFrame) -> DataFrame:
        if len(self.indices) > SL.WIDE:
            ship_package(df.sparkSession)
            return df.withColumn(self.output_col, SL.kept_slots(self.input_col, self.indices).alias(
                self.output_col, metadata={"ml_attr": {"num_attrs": len(self.indices)}}))
        return VectorSlicer(inputCol=self.input_col, outputCol=self.output_col,
                            indices=list(self.indices)).transform(df)


def selection_report(spark, names: list[str], scores: list, keep: list[int]) -> DataFrame:
    """Long form (feature, statistic, kept) of a selection, rounded to 6 decimals."""
    rows = [(n, None if s is None or (isinstance(s, float) and math.isnan(s)) else float(s), i in keep)
            for i, (n, s) in enumerate(zip(names, scores))]
    df = spark.createDataFrame(rows, "feature string, statistic double, kept boolean")
    return df.select("feature", significant(F.col("statistic")).alias("statistic"), "kept")


def significant(x, digits: int = 10):
    """Round to ``digits`` significant digits (statistics span many magnitudes)."""
    p = F.pow(F.lit(10.0), F.floor(F.log10(F.abs(x))))
    return F.when(x == 0, F.lit(0.0)).when(F.isnan(x) | x.isNull(), None).otherwise(
        F.round(x / p, digits - 1) * p)
