"""Boosting of three classes, against a loop over plain numbers."""

import numpy as np
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from tableprep.operators import ensemble as ENS
from tableprep.operators import model as M
from tableprep.operators import scale as S


def rows(spark, n=240):
    """Three groups that the features tell apart, classes mixed within each; group 2 is nearly all of class 2."""
    data = [(i, float(i % 3), [0, 0, 1, 1, 2, 0, 1, 2, 2][(i % 3) * 3 + (i // 3) % 3]) for i in range(n)]
    df = spark.createDataFrame([(i, g, float(y)) for i, g, y in data], "id long, g double, label double")
    return data, S.assemble(df, ["g"], "features")


def by_hand(data, steps, rate):
    g, y = np.array([d[1] for d in data]).astype(int), np.array([d[2] for d in data])
    onehot = np.eye(3)[y]
    f = np.tile(np.log(onehot.mean(0)), (len(y), 1))
    for _ in range(steps):
        p = np.exp(f) / np.exp(f).sum(1, keepdims=True)
        r = onehot - p
        for k in range(3):
            for group in range(3):
                m = g == group
                h = (abs(r[m, k]) * (1 - abs(r[m, k]))).sum()
                f[m, k] += rate * 2 / 3 * r[m, k].sum() / h
    return np.exp(f) / np.exp(f).sum(1, keepdims=True)


def test_steps_equal_the_loop(spark):
    data, df = rows(spark)
    est = M.build_estimator("GBTClassifier", 3, n_estimators=2, learning_rate=0.4, max_depth=3)
    out = est.fit(df).transform(df).orderBy("id").select(vector_to_array("probability").alias("p"), "prediction").collect()
    want = by_hand(data, 2, 0.4)
    assert np.allclose([r["p"] for r in out], want, atol=1e-9)
    assert [r["prediction"] for r in out] == want.argmax(1).tolist()


def test_separable_classes_saving_and_voting(spark, tmp_path):
    df = S.assemble(spark.range(300).select("id", (F.col("id") % 10 * 1.0).alias("x")).withColumn(
        "label", F.when(F.col("x") < 3, 1.0).when(F.col("x") < 7, 0.0).otherwise(2.0)), ["x"], "features")
    model = M.build_estimator("GBTClassifier", 3, n_estimators=2, learning_rate=1.0).fit(df)
    assert M.score(model.transform(df), "classification", "label") > 0.99
    model.write().save(str(tmp_path / "m"))
    again = type(model).load(str(tmp_path / "m"))
    a, b = (m.transform(df).orderBy("id").select("prediction").collect() for m in (model, again))
    assert a == b
    ens = ENS.EnsembleModel([model, model], "voting", "classification").transform(df)
    assert M.score(ens, "classification", "label") > 0.99 and ens.columns == [*df.columns, "prediction"]


def test_a_class_without_rows_and_an_empty_table(spark):
    data, df = rows(spark, 30)
    model = M.build_estimator("GBTClassifier", 4, n_estimators=1).fit(df)
    p = model.transform(df).select(vector_to_array("probability").alias("p")).collect()
    assert all(len(r["p"]) == 4 and r["p"][3] < 1e-6 for r in p)
    assert M.build_estimator("GBTClassifier", 3).fit(df.limit(0)).transform(df).count() == 30
