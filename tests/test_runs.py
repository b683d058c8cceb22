"""Runs whose results must not depend on headers, file splits, class numbers or the direction of a metric."""

import os
import tempfile

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from tableprep.operators import clean as C
from tableprep.operators import ensemble as ENS
from tableprep.operators import model as M
from tableprep.operators import runlog as RL
from tableprep.operators import scale as S
from tableprep.operators import tune as T
from tableprep.plans.pipeline import run_text_pipeline, with_row_id
from tableprep.sources.files import in_file_order, route


def test_labelled_text_run_with_ordinary_headers(spark, monkeypatch):
    monkeypatch.setitem(T.PARAM_SPACES, "SGD", {"alpha": [0.01]})
    monkeypatch.setattr(M, "SGD_ALPHA", 0.01)
    rows = [(i, f"good fine word{i % 7}" if i % 2 else f"bad poor word{i % 5}", "pos" if i % 2 else "neg") for i in range(300)]
    res = run_text_pipeline(spark.createDataFrame(rows, ["Row Id", "My Text", "The Label"]), "My Text", "Row Id", "The Label")
    assert [r["stage"] for r in res.run_log.orderBy("stage_idx").collect()] == ["cleaning", "model_select", "tuning", "ensemble"]
    assert res.run_log.where("stage = 'ensemble'").first()["val_score"] > 0.95
    assert res.label_model.sizes == [2]


def test_smaller_errors_never_score_less(spark):
    rows = [(f"r{e}", 1, e, e, 1.0, 10, "LinearRegression", "regression") for e in (0.1, 1.0, 10.0, 100.0)]
    log = spark.createDataFrame(rows, "run_id string, stage_idx int, val_score double, train_score double, seconds double, "
                                      "n_features int, model_name string, task string")
    got = [r["score"] for r in RL.stage_scores(log, "task", "rmse").orderBy("val_score").collect()]
    assert got == sorted(got, reverse=True) and len(set(got)) == 4


def test_stacking_three_classes_is_no_worse_than_its_base(spark):
    # the middle class lies between the others in number only: order 1, 0, 2 along x
    rows = [(i, float(i % 300), [1.0, 0.0, 2.0][(i % 300) // 100]) for i in range(1500)]
    df = S.assemble(spark.createDataFrame(rows, "id long, x double, label double"), ["x"], "features")
    train, test = M.hash_split(df, "id")
    base = M.build_estimator("DecisionTreeClassifier(depth=10)", 3)
    alone = M.score(base.fit(train).transform(test), "classification", "label")
    got = ENS.build_ensemble([base], "stacking", "classification", train, "label", "id")
    assert M.score(got.transform(test), "classification", "label") >= alone - 1e-9 > 0.95


def test_a_model_without_probabilities_stacks_ones_and_zeros(spark):
    class NoProbability:
        def hasParam(self, name):
            return False

    df = spark.createDataFrame([(0.0,), (2.0,), (1.0,)], "_p0 double")
    rows = ENS.meta_features(df, [NoProbability()], 3).select(vector_to_array("_meta_x").alias("x")).collect()
    assert [r["x"] for r in rows] == [[1.0, 0.0, 0.0], [0.0, 0.0, 1.0], [0.0, 1.0, 0.0]]


def test_stacking_where_a_fold_lacks_the_last_class(spark):
    df = spark.range(200).select("id", (F.col("id") % 2).cast("double").alias("label"), (F.col("id") % 2 * 3.0).alias("x"))
    df = df.withColumn("label", F.when(F.col("id") == 7, 2.0).otherwise(F.col("label")))
    data = S.assemble(df, ["x"], "features")
    got = ENS.build_ensemble([M.build_estimator("DecisionTreeClassifier(depth=10)", 3)], "stacking", "classification", data,
                             "label", "id")
    assert M.score(got.transform(data), "classification", "label") > 0.98


def test_rows_are_numbered_in_file_order_for_any_split(spark):
    folder = tempfile.mkdtemp(prefix="order-", dir="/tmp")
    path = os.path.join(folder, "rows.csv")
    values = [(i * 7919) % 311 for i in range(4000)]
    with open(path, "w") as f:
        f.write("a,b,label\n" + "".join(f"{v % 40},x{v % 3},{i}\n" for i, v in enumerate(values)))
    seen = set()
    for size in (64 << 20, 1200):
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
        try:
            df = in_file_order(route(spark, path).df, "row_id")
            got = df.select("row_id", F.col("label").cast("long").alias("label")).collect()
            assert len(got) == 4000 and all(r["row_id"] == r["label"] for r in got)
            model = C.DataCleaner(C.CleaningConfig(row_id_col="row_id", label_col="label")).fit(df)
            kept = sorted(int(r["label"]) for r in model.transform(df).select("label").collect())
            seen.add(tuple(kept))
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")
    first = {}
    for i, v in enumerate(values):
        first.setdefault((v % 40, v % 3), i)
    assert seen == {tuple(sorted(first.values()))}


def test_several_files_follow_their_paths(spark):
    folder = tempfile.mkdtemp(prefix="order-", dir="/tmp")
    for k in range(5):
        with open(os.path.join(folder, f"part{k}.txt"), "w") as f:
            f.write("".join(f"{k * 100 + i}\n" for i in range(100)))
    rows = in_file_order(spark.read.text(folder), "n").collect()
    assert sorted((r["n"], int(r["value"])) for r in rows) == [(i, i) for i in range(500)]


def test_row_ids_of_tables_are_unique_and_repeatable(spark):
    df = spark.range(50).select((F.col("id") % 5).alias("a"), F.lit("x").alias("b"))
    ids = [sorted(r["row_id"] for r in with_row_id(d).collect()) for d in (df, df.repartition(7))]
    assert ids[0] == ids[1] and len(set(ids[0])) == 50


def test_preview_dummy_label_and_methods_that_do_nothing(spark):
    from tableprep.operators import select as SEL
    from tableprep.sources.files import preview, with_dummy_label
    df = spark.range(20).select("id", (F.col("id") % 3).cast("double").alias("x"), (F.col("id") % 2).cast("double").alias("label"))
    assert preview(df, 3).count() == 3 and preview(df.limit(2)).count() == 2
    assert {r["label"] for r in with_dummy_label(df.drop("label")).collect()} == {0.0}
    data = S.assemble(df, ["x", "id"], "features")
    model = SEL.FeatureSelector("features", "s", None, SEL.FeatureSelectionConfig(method="none")).fit(data)
    assert model.indices == [0, 1] and all(r["s"] == r["features"] for r in model.transform(data).collect())
    est = M.build_estimator("DecisionTreeClassifier(depth=10)", 2)
    one = ENS.build_ensemble([est, est], "none", "classification", data, "label").transform(data)
    assert one.select("prediction").collect() == est.fit(data).transform(data).select("prediction").collect()
