"""Scaling, selection, models, ensembles, run log."""

import math

import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from tableprep.operators import ensemble as ENS
from tableprep.operators import model as M
from tableprep.operators import runlog as RL
from tableprep.operators import scale as S
from tableprep.operators import select as SEL


def test_scalers_on_constant_column(spark):
    df = spark.createDataFrame([(1.0, 7.0), (2.0, 7.0), (4.0, 7.0)], "x double, k double")
    for method, expect_k in [("standard", 7.0), ("minmax", 0.0), ("robust", 0.0)]:
        out = S.scale_columns(df, ["x", "k"], S.ScalingConfig(method=method))
        assert {r["k"] for r in out.collect()} == {expect_k}
    with pytest.raises(ValueError):
        S.scale_columns(df, ["x"], S.ScalingConfig(method="zscore"))


def test_vector_scaler_matches_columns(spark):
    df = spark.createDataFrame([(1.0, 10.0), (2.0, 30.0), (4.0, 20.0), (8.0, 10.0)], "a double, b double")
    vec = S.assemble(df, ["a", "b"])
    for method in ("standard", "minmax", "robust"):
        cfg = S.ScalingConfig(method=method)
        got = S.VectorScaler("features", "s", cfg).fit(vec).transform(vec).select(vector_to_array("s")).collect()
        ref = S.scale_columns(df, ["a", "b"], cfg).collect()
        for g, r in zip(got, ref):
            assert all(abs(x - y) < 1e-12 for x, y in zip(g[0], r))


def test_kbest_keeps_feature_equal_to_label(spark):
    df = spark.createDataFrame([(float(i % 3), float(i % 3), float((i * 7) % 5), 1.0) for i in range(60)],
                               "y double, same double, noise double, const double")
    vec = S.assemble(df, ["same", "noise", "const"])
    sel = SEL.FeatureSelector("features", "x", "y", SEL.FeatureSelectionConfig(method="kbest", k=2,
                                                                             task="classification"))
    scores, keep = sel.statistics(vec)
    assert keep == [0, 1] and scores[2] is None


def test_correlation_drops_later_duplicate(spark):
    df = spark.createDataFrame([(float(i), 2.0 * i + 1, float((i * 7) % 5)) for i in range(30)], "a double, b double, c double")
    sel = SEL.FeatureSelector("features", "x", None, SEL.FeatureSelectionConfig(method="correlation"))
    _, keep = sel.statistics(S.assemble(df, ["a", "b", "c"]))
    assert keep == [0, 2]


def test_salary_linear_model_meets_target(spark, salary):
    df = S.assemble(salary, ["YearsExperience"])
    est = M.build_estimator(M.model_rule(30, 1, False, "regression"), features_col="features", label_col="Salary")
    model = est.fit(df)
    r2 = M.regression_metrics(model.transform(df), "Salary", "prediction").first()["r2"]
    assert r2 > 0.6


def test_metrics_by_hand(spark):
    df = spark.createDataFrame([(0.0, 0.0), (0.0, 1.0), (1.0, 1.0), (1.0, 1.0)], "y double, p double")
    row = M.classification_metrics(df, "y", "p").first()
    assert row["accuracy"] == 0.75
    f1_0, f1_1 = 2 * 1 / (2 + 1), 2 * 2 / (2 + 3)
    assert abs(row["f1_weighted"] - (f1_0 * 2 + f1_1 * 2) / 4) < 1e-12


def test_hash_split_is_deterministic(spark):
    df = spark.range(1000).withColumnRenamed("id", "rid")
    a, b = M.hash_split(df, "rid")
    a2, _ = M.hash_split(df.repartition(3), "rid")
    assert sorted(r[0] for r in a.collect()) == sorted(r[0] for r in a2.collect())
    assert 150 < b.count() < 250
    assert df.where(M.hash_bucket("rid", 100) == 71).where(F.col("rid") == 7).count() == 1


def test_hard_vote_and_weighted(spark):
    df = spark.createDataFrame([(1.0, 2.0, 2.0), (1.0, 2.0, 3.0), (0.0, 1.0, 1.0)], "a double, b double, c double")
    cols = [F.col("a"), F.col("b"), F.col("c")]
    assert [r[0] for r in df.select(ENS.hard_vote(cols)).collect()] == [2.0, 1.0, 1.0]
    assert [r[0] for r in df.select(ENS.weighted_average(cols[:2], classification=True)).collect()] == [2.0, 2.0, 0.0]


def test_stage_score_published_example(spark):
    # val 0.5, train 0.5, one feature, no time, after a stage that also scored 0.5
    log = spark.createDataFrame([("r", 1, 0.5, 0.5, 0.0, 1, "none"), ("r", 2, 0.5, 0.5, 0.0, 1, "none")],
                                "run_id string, stage_idx int, val_score double, train_score double, "
                                "seconds double, n_features int, model_name string")
    scores = [r["score"] for r in RL.stage_scores(log).orderBy("stage_idx").collect()]
    assert abs(scores[1] - (0.5 + 0.1 / (1 + math.log(2)) + 0.05)) < 1e-12
    assert round(scores[1], 2) == 0.61


def test_r2_of_constant_label_is_null_not_error(spark):
    df = spark.createDataFrame([(5.0, 4.0), (5.0, 6.0)], "y double, p double")
    row = M.regression_metrics(df, "y", "p").first()
    assert row["r2"] is None and row["rmse"] == 1.0
