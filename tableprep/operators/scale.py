"""Scaling of numeric columns or of a feature vector.

Statistics follow the reference definitions (population std; zero spread divides by
1; min-max of a constant column gives 0; robust = (x - median) / interpolated IQR),
which differ from MLlib's scaler classes. Statistics of sparse vectors and quantiles of
all vectors are tables by slot (``slots``), those of dense ones come from ``Summarizer``
(one tree aggregate); a sparse vector is only ever scaled, never centred, so it stays sparse.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.ml import Estimator, Model
from pyspark.ml.feature import ElementwiseProduct, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tableprep.operators import slots as SL
from tableprep.operators import stats
from tableprep.persist import Saved

METHODS = ("standard", "minmax", "robust", "none")


@dataclass
class ScalingConfig:
    method: str = "standard"
    with_mean: bool = False
    with_std: bool = True


def _safe(s: float | None) -> float:
    return 1.0 if (s is None or s == 0 or math.isnan(s)) else s


def column_scale_params(df: DataFrame, cols: list[str], cfg: ScalingConfig) -> dict[str, tuple[float, float]]:
    """(shift, divisor) per column so that scaled = (x - shift) / divisor."""
    if cfg.method not in METHODS:
        raise ValueError(f"Unknown scaling method: {cfg.method}")
    if cfg.method == "none" or not cols:
        return {c: (0.0, 1.0) for c in cols}
    if cfg.method == "standard":
        row = df.agg(*[F.avg(c).alias(f"m{i}") for i, c in enumerate(cols)],
                     *[F.stddev_pop(c).alias(f"s{i}") for i, c in enumerate(cols)]).first()
        return {c: ((row[f"m{i}"] or 0.0) if cfg.with_mean else 0.0,
                    _safe(row[f"s{i}"]) if cfg.with_std else 1.0) for i, c in enumerate(cols)}
    if cfg.method == "minmax":
        row = df.agg(*[F.min(c).alias(f"a{i}") for i, c in enumerate(cols)],
                     *[F.max(c).alias(f"b{i}") for i, c in enumerate(cols)]).first()
        return {c: (row[f"a{i}"] or 0.0, _safe((row[f"b{i}"] or 0.0) - (row[f"a{i}"] or 0.0)))
                for i, c in enumerate(cols)}
    q = stats.exact_quantiles(df, cols, [0.25, 0.5, 0.75])
    return {c: (q[c][1] or 0.0, _safe((q[c][2] or 0.0) - (q[c][0] or 0.0))) for c in cols}


def scale_columns(df: DataFrame, cols: list[str], cfg: ScalingConfig | None = None) -> DataFrame:
    cfg = cfg or ScalingConfig()
    params = column_scale_params(df, cols, cfg)
    return df.withColumns({c: (F.col(c) - F.lit(params[c][0])) / F.lit(params[c][1]) for c in cols})


class VectorScaler(Estimator):
    """Scale a vector column. ``sparse=True`` (text blocks) forces scale-only standard scaling."""

    def __init__(self, input_col: str = "features", output_col: str = "scaled",
                 config: ScalingConfig | None = None, sparse: bool = False):
        super().__init__()
        self.input_col, self.output_col = input_col, output_col
        self.config, self.sparse = config or ScalingConfig(), sparse

    def _fit(self, df: DataFrame) -> "VectorScalerModel":
        cfg = self.config
        if cfg.method not in METHODS:
            raise ValueError(f"Unknown scaling method: {cfg.method}")
        if cfg.method == "none":
            return VectorScalerModel(self.input_col, self.output_col, None, None)
        method = "standard" if self.sparse else cfg.method
        with_mean = cfg.with_mean and not self.sparse
        if method == "standard" and not with_mean and SL.is_sparse(df, self.input_col):
            n, width = SL.rows_and_width(df, self.input_col)
            stats_by_slot = SL.slot_statistics(SL.entries(df, self.input_col), n)
            div = np.ones(width)
            if cfg.with_std:  # what the model holds
                found = SL.slot_table(stats_by_slot).select("slot", "divisor").toArrow()
                div[found["slot"].to_numpy()] = found["divisor"].to_numpy()
            div, shift = div.tolist(), None
        elif method in ("standard", "minmax"):
            summ = df.select(Summarizer.metrics("mean", "variance", "count", "min", "max")
                             .summary(F.col(self.input_col)).alias("s")).first()["s"]
            n = summ["count"]
            if method == "standard":
                var = summ["variance"].toArray() * ((n - 1) / n if n > 1 else 0.0)
                div = [(_safe(math.sqrt(v)) if cfg.with_std else 1.0) for v in var]
                shift = list(summ["mean"].toArray()) if with_mean else None
            else:
                lo, hi = summ["min"].toArray(), summ["max"].toArray()
                div = [_safe(b - a) for a, b in zip(lo, hi)]
                shift = list(lo)
        else:
            n, width = SL.rows_and_width(df, self.input_col)
            shift, low, high = [0.0] * width, [0.0] * width, [0.0] * width
            found = SL.grouped_quantiles(SL.entries(df, self.input_col), "slot", "value", [0.25, 0.5, 0.75], n)
            for r in found.collect():  # three numbers a slot, as the model holds them
                {0.25: low, 0.5: shift, 0.75: high}[r["prob"]][r["slot"]] = r["quantile"]
            div = [_safe(b - a) for a, b in zip(low, high)]
        return VectorScalerModel(self.input_col, self.output_col, shift, div)


class VectorScalerModel(Saved, Model):
    def __init__(self, input_col, output_col, shift, div):
        super().__init__()
        self.input_col, self.output_col, self.shift, self.div = input_col, output_col, shift, div

    def _transform(self, df: DataFrame) -> DataFrame:
        if self.div is None:
            return df.withColumn(self.output_col, F.col(self.input_col))
        if self.shift is None or not any(self.shift):
            # scale only: JVM elementwise product keeps sparse vectors sparse
            return ElementwiseProduct(scalingVec=Vectors.dense([1.0 / d for d in self.div]),
                                      inputCol=self.input_col, outputCol=self.output_col).transform(df)
        sh = F.array(*[F.lit(float(s)) for s in self.shift])
        dv = F.array(*[F.lit(float(d)) for d in self.div])
        arr = F.zip_with(F.zip_with(vector_to_array(self.input_col), sh, lambda x, s: x - s), dv,
                         lambda x, d: x / d)
        return df.withColumn(self.output_col, array_to_vector(arr))


def assemble(df: DataFrame, cols: list[str], output_col: str = "features") -> DataFrame:
    return VectorAssembler(inputCols=cols, outputCol=output_col, handleInvalid="keep").transform(df)
