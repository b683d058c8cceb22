"""End-to-end runs: structured and text pipelines, predict on unlabelled rows, routing."""

import os
import tempfile

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from tableprep.operators import encode as E
from tableprep.operators import model as M
from tableprep.operators import tune as T
from tableprep.plans.pipeline import PipelineConfig, run, run_pipeline, run_text_pipeline
from tableprep.sources.files import route
from tableprep.sources.tables import read_table

from conftest import SALARY, SF_SMALL


def test_structured_pipeline_and_predict_without_label(spark):
    df = read_table(spark, SF_SMALL, "customer").drop("c_name")
    res = run_pipeline(df, "c_mktsegment", "c_custkey", run_id="t")
    log = res.run_log.orderBy("stage_idx").collect()
    assert [r["stage"] for r in log] == ["cleaning", "engineering", "encoding", "scaling", "selection",
                                         "model_select", "tuning", "ensemble"]
    assert all(0.01 <= r["score"] <= 0.99 for r in log)
    preds = res.model.transform(df.drop("c_mktsegment"))
    assert preds.count() == df.count() and "prediction" in preds.columns
    assert {r["value"] for r in res.label_model.table.collect()} == {r[0] for r in df.select("c_mktsegment").distinct().collect()}


def test_text_pipeline_without_labels(spark):
    docs = read_table(spark, SF_SMALL, "documents").select("doc_id", "text")
    res = run_text_pipeline(docs, "text", "doc_id")
    assert res.task == "text"
    assert [r["score"] for r in res.run_log.collect()] == [0.3] * 4


def test_onehot_drop_first(spark):
    df = spark.createDataFrame([(1, "a", 0.0), (2, "b", 1.0), (3, "c", 0.0)], "id long, c string, y double")
    m = E.Encoder(E.EncodingConfig(label_col="y", passthrough=("id",), drop_first=True)).fit(df)
    rows = m.transform(df).orderBy("id").select(vector_to_array("features").alias("v")).collect()
    assert [r["v"] for r in rows] == [[0.0, 0.0], [1.0, 0.0], [0.0, 1.0]]


def test_encoder_gets_the_string_columns_and_their_slots_reach_the_model(spark):
    df = read_table(spark, SF_SMALL, "part")
    res = run_pipeline(df, "p_retailprice", "p_partkey", PipelineConfig(model_name="LinearRegression"))
    enc = next(s for s in res.model.stages if isinstance(s, E.EncoderModel))
    strings = {"p_name", "p_brand", "p_type"}
    assert set(enc.cat) | set(enc.text) == strings and enc.cat
    one_hot = enc.fitted.stages[0].sizes
    assert enc.width >= sum(one_hot) + len(enc.num)
    report = {(r["stage"], r["key"]): r["value"] for r in res.report.collect()}
    assert ("cleaning", "rows_removed") in report


def test_a_spaced_label_header_neither_leaks_nor_fails(spark):
    rows = [(i, float((i * 7919) % 1000), "AB"[(i * 31) % 7 % 2]) for i in range(600)]
    cfg = PipelineConfig(model_name="LogisticRegression")
    scores = []
    for label in ("Pay Band", "pay_band"):
        res = run_pipeline(spark.createDataFrame(rows, ["Row Id", "x", label]), label, "Row Id", cfg)
        scores.append([round(r["val_score"], 9) for r in res.run_log.orderBy("stage_idx").collect()])
    assert scores[0] == scores[1] and scores[0][-1] < 0.8


def test_salary_from_file_to_run(spark):
    d = tempfile.mkdtemp(prefix="salary-", dir="/tmp")
    path = os.path.join(d, "salary.csv")
    with open(path, "w") as f:
        f.write(",YearsExperience,Salary\n" + "".join(f"{i},{x},{y}\n" for i, x, y in SALARY))
    res = run(route(spark, path))
    last = res.run_log.orderBy("stage_idx").collect()[-1]
    assert res.task == "regression" and last["val_score"] > 0.6


def test_a_class_of_the_test_split_only_does_not_fail(spark):
    df = spark.range(400).select(F.col("id"), (F.col("id") % 17).cast("double").alias("x"),
                                 F.when(F.col("id") % 2 == 0, "even").otherwise("odd").alias("y"))
    _, test = M.hash_split(df, "id")
    rare = test.first()["id"]
    df = df.withColumn("y", F.when(F.col("id") == rare, "rare").otherwise(F.col("y")))
    res = run_pipeline(df, "y", "id", PipelineConfig(model_name="LogisticRegression"))
    assert res.label_model.sizes == [3]
    assert res.test_predictions.where(F.col("id") == rare).count() == 1


def test_r2_runs_rank_trials_and_keep_the_winner(spark, monkeypatch):
    monkeypatch.setitem(T.PARAM_SPACES, "SGD", {"alpha": [1e-4, 1e3, 1e5]})
    df = spark.range(300).select("id", F.rand(3).alias("x")).withColumn("y", 100 * F.col("x") + F.col("id") % 3)
    for metric in ("auto", "r2", "rmse"):
        res = run_pipeline(df, "y", "id", PipelineConfig(model_name="LinearRegression(sgd)", metric=metric))
        log = {r["stage"]: r["val_score"] for r in res.run_log.collect()}
        assert log["ensemble"] == log["tuning"]
        assert log["tuning"] < 2.0 if metric == "rmse" else log["tuning"] > 0.95


def test_a_failed_trial_does_not_end_the_search(spark, monkeypatch):
    monkeypatch.setitem(T.PARAM_SPACES, "SGD", {"alpha": [1e-4, -1.0]})
    df = spark.range(60).select(F.col("id").cast("double").alias("label"))
    from tableprep.operators import scale as S
    data = S.assemble(df.withColumn("x", F.col("label") * 2), ["x"])
    got = T.tune("LinearRegression(sgd)", data, data, "regression", "label", 0, 60)
    assert [t.error is None for t in got.trials].count(False) == 1 and got.best_score > 0.9


def test_interactions_of_many_columns_and_unseen_categories(spark):
    from tableprep.operators import features as FE
    wide = spark.range(3).select("id", *[(F.col("id") + i).cast("double").alias(f"c{i}") for i in range(70)])
    fe = FE.FeatureEngineer(FE.FeatureEngineeringConfig(passthrough=("id",))).fit(wide)
    out = fe.transform(wide).orderBy("id").first()
    assert len(out[FE.INTERACTIONS]) == 70 * 69 // 2 == len(fe.pair_names)
    assert out[FE.INTERACTIONS][0] == 0.0 and out[FE.INTERACTIONS][-1] == 68.0 * 69.0
    fit = spark.createDataFrame([(1, "a"), (2, "b")], "id long, c string")
    new = spark.createDataFrame([(3, "z"), (4, None), (5, "b")], "id long, c string")
    got = E.onehot_stages(["c"])[0].fit(fit).transform(new).orderBy("id")
    assert [r["c_idx"] for r in got.collect()] == [2.0, 2.0, 1.0]
    assert [r["c_ord"] for r in E.ordinal_indexer(["c"], "minus_one").fit(fit).transform(new).orderBy("id").collect()] == [
        -1.0, -1.0, 1.0]


def test_route_csv_and_text(spark):
    d = tempfile.mkdtemp(prefix="route-", dir="/tmp")
    csv = os.path.join(d, "salary.csv")
    with open(csv, "w") as f:
        f.write(",YearsExperience,Salary\n" + "".join(f"{i},{x},{y}\n" for i, x, y in SALARY))
    ds = route(spark, csv)
    assert ds.modality == "structured" and ds.label_col == "Salary" and ds.df.count() == 30
    assert ds.df.columns[0] == "_c0"
    one = os.path.join(d, "lines.csv")
    with open(one, "w") as f:
        f.write("sentence\nfirst line\nsecond line\n")
    t = route(spark, one)
    assert t.modality == "text" and t.df.columns == ["text"] and t.df.count() == 2
    txt = os.path.join(d, "log.txt")
    with open(txt, "w") as f:
        f.write("a\nb\nc\n")
    assert route(spark, txt).df.count() == 3
    assert route(spark, txt).stages == ("cleaning", "model_select", "tuning", "ensemble")
    assert F is not None


def test_a_saved_run_predicts_the_same(spark, tmp_path):
    from pyspark.ml import PipelineModel
    for table, label, key, name in (("part", "p_retailprice", "p_partkey", "LinearRegression"),
                                    ("customer", "c_mktsegment", "c_custkey", "DecisionTreeClassifier(depth=10)")):
        df = read_table(spark, SF_SMALL, table)
        res = run_pipeline(df, label, key, PipelineConfig(model_name=name))
        path = str(tmp_path / table)
        res.model.write().save(path)
        again = PipelineModel.load(path)
        a, b = (m.transform(df.drop(label)).select(key, "prediction").orderBy(key).collect() for m in (res.model, again))
        assert a == b and len(a) == df.count()


def test_tuning_takes_the_fit_of_equal_settings_and_fits_the_others(spark, monkeypatch):
    """The model choice's fit is one of the trials and is not fitted again; the threads it leaves free fit classes."""
    name, made = "LinearSVC(sgd-hinge)", []

    def fitted(e, *_):
        made.append(e)
        alpha = e.getClassifier().getRegParam()
        return M.TrainResult(f"model {alpha}", name, alpha, alpha, 0.0)

    monkeypatch.setattr(T, "train_and_score", fitted)
    est = M.build_estimator(name, 3, parallelism=4)
    res = M.TrainResult("chosen", name, 1e-4, 1e-4, 0.0)
    plain = T.tune(name, None, None, "classification", "label", 3, 120)
    assert len(made) == 3
    made.clear()
    shared = T.tune(name, None, None, "classification", "label", 3, 120, fitted=(est, res))
    assert sorted(e.getClassifier().getRegParam() for e in made) == [1e-3, 1e-2]
    assert all(e.getParallelism() == 2 for e in made)  # four threads for two trials
    assert [(t.params, t.val_score) for t in shared.ranked] == [(t.params, t.val_score) for t in plain.ranked]
    assert [t.model for t in shared.ranked] == ["model 0.01", "model 0.001", "chosen"]


def test_settings_tell_estimators_apart(spark):
    settings, forest = T.settings, "RandomForestRegressor(200)"
    assert settings(M.build_estimator(forest)) == settings(M.build_estimator(forest, n_estimators=200, max_depth=None))
    for a, b in ((M.build_estimator(forest), M.build_estimator(forest, n_estimators=50)),
                 (M.build_estimator(forest), M.build_estimator(forest, seed=1)),
                 (M.build_estimator("LinearSVC(sgd-hinge)", 3), M.build_estimator("LinearSVC(sgd-hinge)", 3, alpha=0.1)),
                 (M.build_estimator("GBTClassifier", 3), M.build_estimator("GBTClassifier", 3, learning_rate=0.5))):
        assert settings(a) != settings(b)
