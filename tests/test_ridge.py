"""Every penalty from one pass, against least squares on the rows and against MLlib."""

import numpy as np
from pyspark.ml.regression import LinearRegression
from pyspark.sql import functions as F

from tableprep.operators import ensemble as ENS
from tableprep.operators import ridge as R
from tableprep.operators import scale as S
from tableprep.operators import tune as T


def data(spark, n=400, d=5, seed=1, offset=0.0):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, d)) + offset
    y = (x - offset) @ np.arange(1, d + 1) + rng.normal(size=n) + 3 * offset
    df = spark.createDataFrame([(i, *map(float, r), float(v)) for i, (r, v) in enumerate(zip(x, y))],
                               ["id", *[f"x{j}" for j in range(d)], "y"]).repartition(5)
    return x, y, S.assemble(df, [f"x{j}" for j in range(d)], "features")


def test_moments_in_tiles_and_blocks(spark, monkeypatch):
    monkeypatch.setattr(R, "TILE", 3)
    monkeypatch.setattr(R, "BLOCK_ROWS", 37)
    x, y, df = data(spark, offset=1e7)
    m = R.moments(df, "features", "y", F.lit(0))[0]
    assert m.n == len(x) and np.allclose(m.mean_x, x.mean(0)) and np.isclose(m.mean_y, y.mean())
    assert np.allclose(m.cov, np.cov(x.T, bias=True), rtol=1e-6, atol=1e-7)
    assert np.allclose(m.cov_y, ((x - x.mean(0)) * (y - y.mean())[:, None]).mean(0), rtol=1e-6, atol=1e-6)


def test_all_penalties_equal_mllib(spark):
    """MLlib divides a penalty by the label's deviation."""
    x, y, df = data(spark)
    train, test = df.where("id % 4 <> 0"), df.where("id % 4 = 0")
    spread = float(y[np.arange(len(y)) % 4 != 0].std())
    for t in R.search(train, test, "y", "features", [0.0, 0.1, 10.0]):
        model = LinearRegression(featuresCol="features", labelCol="y", regParam=t.alpha * spread, standardization=False,
                                 solver="normal").fit(train)
        assert np.allclose(model.coefficients.toArray(), t.coefficients, atol=1e-6) and abs(model.intercept - t.intercept) < 1e-6
        held = np.arange(len(x)) % 4 == 0
        p = x[held] @ t.coefficients + t.intercept
        r2 = 1 - ((y[held] - p) ** 2).sum() / ((y[held] - y[held].mean()) ** 2).sum()
        assert abs(t.val_score - r2) < 1e-9
    t, held = R.search(train, test, "y", "features", [0.1], "rmse")[0], np.arange(len(x)) % 4 == 0
    assert abs(t.val_score - np.sqrt(((y[held] - x[held] @ t.coefficients - t.intercept) ** 2).mean())) < 1e-9


def test_tuning_uses_one_pass_and_its_models_work_in_ensembles(spark, tmp_path):
    x, y, df = data(spark)
    train, test = df.where("id % 4 <> 0"), df.where("id % 4 = 0")
    got = T.tune("LinearRegression(sgd)", train, test, "regression", "y", 0, len(x))
    assert len(got.trials) == 3 and all(isinstance(t.model, R.RidgeModel) for t in got.trials)
    ens = ENS.EnsembleModel([t.model for t in got.ranked], "voting", "regression")
    p = {r["id"]: r["prediction"] for r in ens.transform(test).select("id", "prediction").collect()}
    want = np.mean([x @ t.model.coefficients + t.model.intercept for t in got.ranked], axis=0)
    assert all(abs(p[i] - want[i]) < 1e-9 for i in p)
    got.best.write().save(str(tmp_path / "m"))
    again = R.RidgeModel.load(str(tmp_path / "m"))
    a, b = (m.transform(test).orderBy("id").select("prediction").collect() for m in (got.best, again))
    assert a == b


def test_constant_labels_and_unlabelled_rows(spark):
    df = S.assemble(spark.createDataFrame([(1.0, 2.0), (2.0, 2.0), (3.0, None)], "x double, y double"), ["x"], "features")
    t = R.search(df, df, "y", "features", [0.1])[0]
    assert t.val_score == 0.0 and abs(t.intercept - 2.0) < 1e-12 and abs(t.coefficients[0]) < 1e-12


def test_wide_vectors_take_mllib_to_the_same_models(spark, monkeypatch):
    x, y, df = data(spark)
    train, test = df.where("id % 4 <> 0"), df.where("id % 4 = 0")
    monkeypatch.setitem(T.PARAM_SPACES, "SGD", {"alpha": [0.01, 1.0]})
    found = []
    for most in (1024, 2):
        monkeypatch.setattr(R, "MOST_WIDTH", most)
        found.append(T.tune("LinearRegression(sgd)", train, test, "regression", "y", 0, len(x)).trials)
    for a, b in zip(*found):
        assert type(a.model) is not type(b.model) and abs(a.val_score - b.val_score) < 1e-6
