"""Linear support vector machines over wide one-hot blocks: optimum, ties to MLlib, fallbacks, saving, and slots kept by entry."""

import numpy as np
import pytest
from pyspark.ml.classification import LinearSVC, OneVsRest, OneVsRestModel
from pyspark.ml.feature import VectorSlicer
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors

from tableprep.operators import ensemble as ENS
from tableprep.operators import model as M
from tableprep.operators import select as SEL
from tableprep.operators import slots as SL
from tableprep.operators import svc as V


@pytest.fixture
def narrow(monkeypatch):
    monkeypatch.setattr(SL, "WIDE", 50)
    monkeypatch.setattr(V, "SHARED_ROWS", 100)


def rows_of(n, names, seed=1, second=False):
    """(label, dense row): two numbers, a constant, and the one-hot block of a name; every eleventh row has no name."""
    rng = np.random.default_rng(seed)
    y = rng.integers(0, 3, n)
    x = np.zeros((n, 3 + 2 * names))
    x[:, 0], x[:, 1], x[:, 2] = rng.normal(size=n) + 0.3 * y, rng.uniform(0, 2, n), 1.0
    for i in range(n):
        if i % 11:
            x[i, 3 + (i * 7919) % names] = 5.0 + (i % 3)
        if second and i % 5 == 0:
            x[i, 3 + names + i % names] = 1.0
    return y, x


def frame(spark, y, x):
    data = [(i, float(c), Vectors.sparse(len(r), {int(j): float(r[j]) for j in np.flatnonzero(r)})) for i, (c, r) in enumerate(zip(y, x))]
    return spark.createDataFrame(data, ["id", "label", "features"]).coalesce(2)


def objective(y, x, c, w, b, reg):
    s = np.where(y == c, 1.0, -1.0)
    return np.maximum(0, 1 - s * (x @ w + b)).mean() + reg / 2 * (w @ w)


@pytest.mark.parametrize("names,reg", [(300, 0.1), (60, 0.1)])
def test_the_optimum_is_reached_and_mllib_gets_no_lower(spark, narrow, names, reg):
    y, x = rows_of(300, names)
    df = frame(spark, y, x)
    est = M.build_estimator("LinearSVC(sgd-hinge)", 3, alpha=reg)
    model = est.fit(df)
    assert isinstance(model, V.WideOneVsRestModel)
    plain = OneVsRest(classifier=LinearSVC(maxIter=5, regParam=reg, standardization=False)).fit(df)
    rng = np.random.default_rng(2)
    for c in range(3):
        w, b = model.coefficients[c], model.intercepts[c]
        mine = objective(y, x, c, w, b, reg)
        assert mine == pytest.approx(model.values[c], rel=1e-9) and w[2] == 0.0  # a constant has no weight
        assert mine <= objective(y, x, c, plain.models[c].coefficients.toArray(), plain.models[c].intercept, reg)
        for size in (1e-3, 1e-2, 0.1):  # convex, so what is lowest around is lowest
            for _ in range(30):
                shift = rng.normal(size=x.shape[1] + 1) * size * (rng.random(x.shape[1] + 1) < rng.choice([0.02, 1.0]))
                shift[2] = 0.0
                assert objective(y, x, c, w + shift[:-1], b + shift[-1], reg) >= mine * (1 - 1e-6)


def test_predictions_are_the_largest_margin_and_survive_saving(spark, narrow, tmp_path):
    y, x = rows_of(300, 300)
    df = frame(spark, y, x)
    model = M.build_estimator("LinearSVC(sgd-hinge)", 3, alpha=0.1).fit(df)
    want = (x @ model.coefficients.T + model.intercepts).argmax(axis=1)
    got = [r["prediction"] for r in model.transform(df).orderBy("id").collect()]
    assert got == want.tolist()
    dense = df.select("id", SL.F.col("features")).rdd.map(lambda r: (r[0], Vectors.dense(r[1].toArray()))).toDF(["id", "features"])
    assert [r["prediction"] for r in model.transform(dense).orderBy("id").collect()] == got
    model.write().save(str(tmp_path / "svc"))
    again = V.WideOneVsRestModel.load(str(tmp_path / "svc"))
    assert [r["prediction"] for r in again.transform(df).orderBy("id").collect()] == got
    vote = ENS.EnsembleModel([model], "voting", "classification").transform(df)
    assert [r["prediction"] for r in vote.orderBy("id").collect()] == got and "rawPrediction" not in vote.columns


def test_rows_with_several_rare_slots_and_narrow_vectors_are_mllibs(spark, narrow, monkeypatch):
    y, x = rows_of(200, 200, second=True)
    est = M.build_estimator("LinearSVC(sgd-hinge)", 3).setClassifier(LinearSVC(maxIter=2, regParam=0.1, standardization=False))
    assert isinstance(est.fit(frame(spark, y, x)), OneVsRestModel)
    monkeypatch.setattr(SL, "WIDE", 4096)
    y, x = rows_of(200, 200)
    assert isinstance(est.fit(frame(spark, y, x)), OneVsRestModel)


def test_blocks_keep_the_rows_of_a_slot_together(spark, narrow, monkeypatch):
    y, x = rows_of(300, 40)
    df = frame(spark, y, x)
    est = M.build_estimator("LinearSVC(sgd-hinge)", 3, alpha=0.1)
    whole = est.fit(df).values
    monkeypatch.setattr(V, "BLOCK_VALUES", 250)
    assert est.fit(df).values == pytest.approx(whole, rel=1e-5)


def test_kept_slots_are_a_vector_slicers(spark, monkeypatch):
    y, x = rows_of(120, 50)
    df = frame(spark, y, x)
    keep = [0, 1, 3, 10, 11, 40, 52]
    want = VectorSlicer(inputCol="features", outputCol="kept", indices=keep).transform(df)
    monkeypatch.setattr(SL, "WIDE", 5)
    got = SEL.FeatureSelectorModel("features", "kept", keep, []).transform(df)
    a, b = ([r["kept"] for r in d.orderBy("id").select("kept").collect()] for d in (want, got))
    assert a == b
    assert got.schema["kept"].metadata["ml_attr"]["num_attrs"] == len(keep)
    meta = M.analyze(df, "features", True)
    assert (meta.n_samples, meta.n_features) == (120, x.shape[1]) and meta.density == pytest.approx((x != 0).mean())
    assert got.select(vector_to_array("kept")).count() == 120
