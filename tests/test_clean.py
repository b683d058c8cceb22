"""Cleaning: names, missing columns, fills, clipping, dedup, the fitted cleaner."""

from pyspark.sql import functions as F

from tableprep.operators import clean as C


def test_standardize_names_suffixes_until_unique():
    assert C.standardize_names(["A ", "a", "a_1", "b c", "x-y!"]) == ["a", "a_2", "a_1", "b_c", "xy"]


def test_drop_high_missing_is_strict(spark):
    df = spark.createDataFrame([(1, None, None), (2, 1.0, None), (3, None, None), (4, 2.0, None), (5, 3.0, None)],
                               "a int, b double, c double")
    out, dropped = C.drop_high_missing(df, 0.4)
    assert dropped == ["c"]            # b has 0.4 missing: not strictly above
    assert out.columns == ["a", "b"]


def test_infer_numeric_half_rule(spark):
    df = spark.createDataFrame([("1",), ("2",), ("x",), ("y",)], "s string")
    out, conv = C.infer_numeric(df)
    assert conv == ["s"]
    assert [r[0] for r in out.collect()] == [1.0, 2.0, None, None]


def test_iqr_clip_after_fill(spark):
    df = spark.createDataFrame([(float(v),) for v in [1, 2, 3, 4, 100]] + [(None,)], "x double")
    fills = C.numeric_fill_values(df, ["x"], "median")
    assert fills == {"x": 3.0}
    out = C.iqr_clip(C.fill_values(df, fills), ["x"])
    vals = sorted(r[0] for r in out.collect())
    # after the fill the values are 1,2,3,3,4,100: q1 = 2.25, q3 = 3.75 (interpolated)
    assert vals[-1] == 3.75 + 1.5 * (3.75 - 2.25)


def test_invalid_strategy_raises(spark):
    import pytest
    df = spark.createDataFrame([(1.0,)], "x double")
    with pytest.raises(ValueError):
        C.numeric_fill_values(df, ["x"], "max")
    with pytest.raises(ValueError):
        C.categorical_fill_values(df, ["x"], "first")


def test_dedup_keep_first_and_idempotent(spark):
    rows = [(5, "a", 1, 0), (2, "a", 1, 1), (9, "b", 1, 2), (1, "b", 2, 3), (3, "b", 1, 4)]
    df = spark.createDataFrame(rows, "rid int, f1 string, f2 int, label int").repartition(3)
    out = C.dedup_keep_first(df, ["f1", "f2"], "rid")
    assert sorted(out.collect()) == sorted([(2, "a", 1, 1), (3, "b", 1, 4), (1, "b", 2, 3)])
    again = C.dedup_keep_first(out, ["f1", "f2"], "rid")
    assert sorted(again.collect()) == sorted(out.collect())


def test_cleaner_one_row_and_constant(spark):
    df = spark.createDataFrame([(1, 7.0, "Hello!")], "id long, k double, t string")
    m = C.DataCleaner(C.CleaningConfig(row_id_col="id")).fit(df)
    assert m.transform(df).collect()[0].asDict() == {"id": 1, "k": 7.0, "t": "hello"}


def test_cleaner_is_partition_independent(spark):
    from tableprep.sources.tables import view
    df = view(spark, "/root/testdata/sf0.001", "dirty_orders")
    m = C.DataCleaner(C.CleaningConfig(row_id_col="o_orderkey")).fit(df)
    a = m.transform(df.repartition(7)).orderBy("o_orderkey").collect()
    b = m.transform(df.coalesce(1)).orderBy("o_orderkey").collect()
    assert a == b
    assert "o_note" in m.dropped
    assert m.transform(df).where(F.col("o_totalprice").isNull()).count() == 0


def test_cleaner_unseen_rows_keep_their_count(spark):
    from tableprep.sources.tables import view
    df = view(spark, "/root/testdata/sf0.001", "dup_events")
    m = C.DataCleaner(C.CleaningConfig(row_id_col="row_id", label_col="label")).fit(df)
    assert m.transform(df).count() < df.count()
    assert m.without_dedup().transform(df).count() == df.count()
