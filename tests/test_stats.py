"""Distributed statistics: exact quantiles (narrowing path forced), modes, lookup joins."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tableprep.operators import stats


def np_quantile(vals, p):
    return float(np.quantile(np.array(vals, dtype=float), p))


def test_quantiles_interpolate(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (4.0,), (10.0,)], "x double")
    q = stats.exact_quantiles(df, ["x"], [0.25, 0.5, 0.75])
    assert q["x"] == [1.75, 3.0, 5.5]


@pytest.mark.parametrize("bound", [50, 100_000])
def test_quantiles_narrowing_matches_numpy(spark, bound):
    rng = np.random.default_rng(7)
    vals = list(rng.normal(100, 30, 6000)) + [42.0] * 3000 + [None] * 100   # a value with a third of the rows
    df = spark.createDataFrame([(float(v) if v is not None else None,) for v in vals], "x double").repartition(5)
    probs = [0.0, 0.1, 0.25, 0.5, 0.75, 0.9, 1.0]
    got = stats.exact_quantiles(df, ["x"], probs, collect_bound=bound, accuracy=100)["x"]
    clean = [v for v in vals if v is not None]
    for p, g in zip(probs, got):
        assert abs(g - np_quantile(clean, p)) < 1e-9, (p, g)


def test_quantiles_all_null_column(spark):
    df = spark.createDataFrame([(None,), (None,)], "x double")
    assert stats.exact_quantiles(df, ["x"], [0.5])["x"] == [None]


def test_mode_tie_takes_smallest(spark):
    df = spark.createDataFrame([("a",), ("a",), ("b",), ("b",), (None,)], "c string")
    assert stats.modes(df, ["c"]) == {"c": "a"}


def test_mode_all_null(spark):
    df = spark.createDataFrame([(None,)], "c string")
    assert stats.modes(df, ["c"]) == {"c": None}


def test_lookup_join_salted_equals_broadcast(spark):
    big = spark.range(3000).select(F.col("id"), (F.col("id") % 3).cast("string").alias("k"))
    lookup = spark.createDataFrame([("0", 1.0), ("1", 2.0)], "k string, v double")
    a = stats.lookup_join(big, lookup, ["k"])
    b = stats.lookup_join(big, lookup, ["k"], max_broadcast_bytes=0, salts=4)
    assert sorted(a.collect()) == sorted(b.collect())
    assert b.where(F.col("v").isNull()).count() == 1000


def test_lookup_join_random_salt_same_result(spark):
    big = spark.range(2000).select(F.col("id"), (F.col("id") % 4).cast("string").alias("k"))
    lookup = spark.createDataFrame([("0", 1.0), ("1", 2.0), ("3", 4.0)], "k string, v double")
    a = stats.lookup_join(big, lookup, ["k"])
    b = stats.lookup_join(big, lookup, ["k"], max_broadcast_bytes=0, salts=7)
    assert sorted(a.collect()) == sorted(b.collect())


def test_quantiles_several_columns_narrowing(spark):
    rng = np.random.default_rng(3)
    a = rng.exponential(10, 5000)
    b = rng.integers(0, 50, 5000).astype(float)
    rows = [(float(x), float(y) if i % 3 else None) for i, (x, y) in enumerate(zip(a, b))]
    df = spark.createDataFrame(rows, "a double, b double")
    got = stats.exact_quantiles(df, ["a", "b"], [0.25, 0.5, 0.75], collect_bound=40, accuracy=50)
    bb = [y for i, y in enumerate(b) if i % 3]
    for j, p in enumerate([0.25, 0.5, 0.75]):
        assert abs(got["a"][j] - np_quantile(a, p)) < 1e-9
        assert abs(got["b"][j] - np_quantile(bb, p)) < 1e-9


@pytest.mark.parametrize("bound", [50, 100_000])
def test_quantiles_beside_a_heavy_tie(spark, bound):
    vals = [float(i) for i in range(6000)] + [6000.0] * 4000
    df = spark.createDataFrame([(v,) for v in vals], "x double").repartition(4)
    probs = [0.5999, 0.59995, 0.6, 0.6001, 0.3]
    got = stats.exact_quantiles(df, ["x"], probs, collect_bound=bound, accuracy=100)["x"]
    assert got == pytest.approx([np_quantile(vals, p) for p in probs])


def test_nan_is_missing(spark):
    from tableprep.operators import clean as C
    nan = float("nan")
    df = spark.createDataFrame([(1, nan, None), (2, 1.0, "2024-01-02 00:00:00"), (3, 3.0, "2024-01-02 00:00:00"),
                                (4, None, "2024-05-01 00:00:00"), (5, 4.0, "2024-01-01 00:00:00"), (6, 2.0, None)],
                               "id long, x double, t string").withColumn("t", F.col("t").cast("timestamp_ntz"))
    assert stats.null_ratios(df, ["x", "t"]) == pytest.approx({"x": 2 / 6, "t": 2 / 6})
    out = C.DataCleaner(C.CleaningConfig(row_id_col="id", drop_duplicates=False)).fit(df).transform(df)
    rows = {r["id"]: (r["x"], str(r["t"])) for r in out.collect()}
    assert rows[1] == (2.5, "2024-01-02 00:00:00") and rows[4][0] == 2.5 and rows[6][1] == "2024-01-02 00:00:00"


def test_dedup_without_a_row_id_is_deterministic(spark):
    from tableprep.operators import clean as C
    df = spark.createDataFrame([(1.0, 5), (1.0, 3), (1.0, 9), (2.0, 1)], "x double, y long")
    cfg = C.CleaningConfig(label_col="y", outlier_method="none")
    got = [C.DataCleaner(cfg).fit(df).transform(df.repartition(n)).orderBy("x").collect() for n in (1, 4)]
    assert got[0] == got[1] and [r["y"] for r in got[0]] == [3, 1]
