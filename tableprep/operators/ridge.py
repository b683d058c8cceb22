"""Linear models of every L2 penalty from one pass: co-moments of features and label, summed in tiles.

For penalty a, the coefficients of ``mean (y - x b - c)^2 / 2 + a |b|^2 / 2`` solve ``(Cov(x) + a I) b = Cov(x, y)``, and
the error on any rows follows from their own moments. So one aggregate over the training and the validation rows fits and
scores every penalty; nothing is refitted. Rows become blocks of ``BLOCK_ROWS``; each task adds the products of its blocks
and sends them once, in tiles of ``TILE`` x ``TILE``, which partial sums combine before and after the shuffle. Values are
taken relative to one row's, so that large offsets do not cancel. The matrix is (width + 2) squared on the driver: for the
widths where that is small (``MOST_WIDTH``); wider vectors are fitted by MLlib, penalty by penalty, to the same optimum
(``tune`` takes back that MLlib divides a penalty by the label's deviation).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml import Model
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.param.shared import HasPredictionCol
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tableprep.persist import Saved
from tableprep.session import ship_package

MOST_WIDTH, TILE, BLOCK_ROWS = 1024, 128, 4096


@dataclass
class Moments:
    """Means, covariances (population) and number of rows of (x, y)."""
    n: int
    mean_x: np.ndarray
    mean_y: float
    cov: np.ndarray
    cov_y: np.ndarray
    var_y: float

    def solve(self, alpha: float) -> tuple[np.ndarray, float]:
        """Coefficients and intercept; without a penalty the shortest of equally good solutions."""
        system = self.cov + alpha * np.eye(len(self.mean_x))
        coef = np.linalg.lstsq(system, self.cov_y, rcond=None)[0] if len(self.mean_x) else np.empty(0)
        return coef, float(self.mean_y - self.mean_x @ coef)

    def mean_squared_error(self, coef: np.ndarray, intercept: float) -> float:
        bias = self.mean_y - self.mean_x @ coef - intercept
        return max(0.0, float(self.var_y - 2 * coef @ self.cov_y + coef @ self.cov @ coef + bias * bias))

    def score(self, coef: np.ndarray, intercept: float, metric: str = "auto") -> float:
        """R^2 (0 where the label has no spread) or RMSE."""
        mse = self.mean_squared_error(coef, intercept)
        if metric == "rmse":
            return float(np.sqrt(mse))
        return 1.0 - mse / self.var_y if self.var_y > 0 else 0.0


def _products(shift: np.ndarray):
    size = len(shift) + 1  # a one, the features, the label
    edges = list(range(0, size, TILE))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK_ROWS):
                part = batch.slice(at, BLOCK_ROWS)
                z = np.empty((part.num_rows, size))
                z[:, 0] = 1.0
                z[:, 1:-1] = part.column(1).flatten().to_numpy().reshape(part.num_rows, size - 2)
                z[:, -1] = part.column(2).to_numpy()
                z[:, 1:] -= shift
                group = part.column(0).to_numpy()
                for g in np.unique(group):
                    own = z[group == g]
                    total = sums.setdefault(int(g), np.zeros((size, size)))
                    total += own.T @ own
        for g, total in sums.items():
            for i in edges:
                for j in edges:
                    if j >= i:
                        tile = total[i:i + TILE, j:j + TILE].ravel()
                        yield pa.RecordBatch.from_pydict({
                            "g": pa.array([g], pa.int32()), "i": pa.array([i], pa.int32()), "j": pa.array([j], pa.int32()),
                            "tile": pa.array([tile], pa.list_(pa.float64()))})

    return run


def moments(df: DataFrame, features_col: str, label_col: str, group) -> dict[int, Moments]:
    """Moments of each group (a small whole number) in one pass; rows with a null label do not count."""
    ship_package(df.sparkSession)
    rows = df.select(group.cast("int").alias("g"), vector_to_array(features_col).alias("x"),
                     F.col(label_col).cast("double").alias("y")).where("y is not null")
    first = rows.select("x", "y").first()
    if first is None:
        return {}
    shift = np.array([*first["x"], first["y"]])
    tiles = rows.mapInArrow(_products(shift), "g int, i int, j int, tile array<double>")
    added = tiles.groupBy("g", "i", "j").agg(Summarizer.sum(array_to_vector("tile")).alias("tile")).collect()
    out, size = {}, len(shift) + 1
    for g in {r["g"] for r in added}:
        m = np.zeros((size, size))
        for r in added:
            if r["g"] == g:
                tile = r["tile"].toArray().reshape(min(TILE, size - r["i"]), -1)
                m[r["i"]:r["i"] + tile.shape[0], r["j"]:r["j"] + tile.shape[1]] = tile
                m[r["j"]:r["j"] + tile.shape[1], r["i"]:r["i"] + tile.shape[0]] = tile.T
        n, mean = m[0, 0], m[0, 1:] / m[0, 0]
        cov = m[1:, 1:] / n - np.outer(mean, mean)
        out[g] = Moments(int(n), mean[:-1] + shift[:-1], float(mean[-1] + shift[-1]), cov[:-1, :-1], cov[:-1, -1],
                         float(max(cov[-1, -1], 0.0)))
    return out


class RidgeModel(Saved, Model, HasPredictionCol):
    """Prediction x b + c of a vector column."""

    def __init__(self, features_col: str, coefficients: np.ndarray, intercept: float):
        super().__init__()
        self.features_col, self.coefficients, self.intercept = features_col, coefficients, intercept

    def _transform(self, df: DataFrame) -> DataFrame:
        name = self.getPredictionCol() if self.isDefined(self.predictionCol) else "prediction"
        b = F.lit([float(x) for x in self.coefficients]) if len(self.coefficients) else F.array().cast("array<double>")
        products = F.zip_with(vector_to_array(self.features_col), b, lambda x, w: x * w)
        return df.withColumn(name, F.aggregate(products, F.lit(float(self.intercept)), lambda a, x: a + x))


@dataclass
class RidgeTrial:
    alpha: float
    coefficients: np.ndarray
    intercept: float
    val_score: float
    train_score: float


def search(train: DataFrame, test: DataFrame, label_col: str, features_col: str, alphas: list[float],
           metric: str = "auto") -> list[RidgeTrial]:
    """All penalties, fitted on ``train`` and scored on both, from one pass over both."""
    cols = [features_col, label_col]
    both = train.select(*cols, F.lit(0).alias("_g")).unionByName(test.select(*cols, F.lit(1).alias("_g")))
    m = moments(both, features_col, label_col, F.col("_g"))
    if 0 not in m:
        raise ValueError("no labelled rows to fit on")
    out = []
    for alpha in alphas:
        coef, intercept = m[0].solve(alpha)
        out.append(RidgeTrial(alpha, coef, intercept, m[1].score(coef, intercept, metric) if 1 in m else 0.0,
                              m[0].score(coef, intercept, metric)))
    return out
