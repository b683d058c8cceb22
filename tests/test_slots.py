"""Statistics and quantiles by slot, against numpy on the dense rows."""

import random

import numpy as np
import pytest
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from tableprep.operators import slots as SL


def dense_rows(seed, n=300, width=25):
    rng = np.random.default_rng(seed)
    x = rng.normal(0, 3, (n, width)).round(1)
    x[rng.random((n, width)) < 0.6] = 0.0
    x[:, 3], x[:, 4] = 7.5, 0.0
    x[:, 5] = np.where(np.arange(n) % 2, 1e9 + np.arange(n), 1e9 - 1)
    return x


def vectors(spark, x):
    rows = [(i, Vectors.sparse(x.shape[1], {j: float(v) for j, v in enumerate(r) if v}) if i % 3 else Vectors.dense(r))
            for i, r in enumerate(x)]
    return spark.createDataFrame(rows, ["id", "v"])


def test_statistics_with_implicit_zeros(spark):
    x = dense_rows(1)
    got = {r["slot"]: r for r in SL.slot_statistics(SL.entries(vectors(spark, x), "v"), len(x)).collect()}
    assert set(got) == {j for j in range(x.shape[1]) if x[:, j].any()}
    for j, r in got.items():
        for name, want in (("mean", x[:, j].mean()), ("variance", x[:, j].var()), ("min", x[:, j].min()), ("max", x[:, j].max())):
            assert abs(r[name] - want) <= 1e-9 * max(1, abs(want)), (j, name)


@pytest.mark.parametrize("inside,grid", [(10_000, 64), (3, 4), (40, 8)])
def test_quantiles_by_slot_with_and_without_stored_zeros(spark, inside, grid):
    x = dense_rows(2)
    probs = [0.0, 0.25, 0.5, 0.9, 1.0]
    got = SL.grouped_quantiles(SL.entries(vectors(spark, x), "v"), "slot", "value", probs, len(x), inside, grid).collect()
    for r in got:
        want = np.quantile(x[:, r["slot"]], r["prob"])
        assert abs(r["quantile"] - want) <= 1e-9 * max(1, abs(want)), r
    assert len(got) == len(probs) * sum(x[:, j].any() for j in range(x.shape[1]))


def test_quantiles_of_skewed_keys_and_ties(spark):
    rng = random.Random(3)
    rows = [("hot" if rng.random() < 0.7 else f"k{rng.randint(0, 40)}", rng.choice([None, float("nan"), 0.0, 1.0, 1.0, 1.0,
             rng.gauss(0, 1), float(rng.randint(-3, 3))])) for _ in range(5000)]
    got = SL.grouped_quantiles(spark.createDataFrame(rows, "k string, x double"), "k", "x", [0.25, 0.5, 0.75], None, 50, 4)
    held = {}
    for k, v in rows:
        if v is not None and v == v:
            held.setdefault(k, []).append(v)
    out = {(r["k"], r["prob"]): r["quantile"] for r in got.collect()}
    assert out.keys() == {(k, p) for k in held for p in (0.25, 0.5, 0.75)}
    assert all(abs(q - np.quantile(held[k], p)) < 1e-12 for (k, p), q in out.items())


def test_the_plan_does_not_grow_with_the_keys(spark):
    def size(n_keys):
        df = spark.range(2000).select((F.col("id") % n_keys).alias("k"), (F.col("id") * 7919 % 1009).cast("double").alias("x"))
        plan = SL.grouped_quantiles(df, "k", "x", [0.5])._jdf.queryExecution().optimizedPlan().toString()
        return len(plan.splitlines())

    assert size(3) == size(500)


def test_scaled_and_selected_rows_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(SL, "BLOCK_ROWS", 17)
    x = dense_rows(4, 120, 9)
    rows = [(i, [j for j, v in enumerate(r) if v], [float(v) for v in r if v]) for i, r in enumerate(x)]
    df = spark.createDataFrame(rows, "id long, slots array<long>, `values` array<double>")
    model = SL.SlotScaler("id", threshold=0.5).fit(df)
    out = {r["id"]: dict(zip(r["slots"], r["values"])) for r in model.transform(df).collect()}
    var = x.var(axis=0)
    assert len(out) == len(x)
    for i, r in enumerate(x):
        want = {j: v / np.sqrt(var[j]) for j, v in enumerate(r) if v and var[j] > 0.5}
        assert out[i].keys() == want.keys() and all(abs(out[i][j] - w) <= 1e-9 * max(1, abs(w)) for j, w in want.items())
    new = spark.createDataFrame([(1, [99, 0], [2.0, 3.0]), (2, [], [])], df.schema)  # unseen slots and empty rows
    assert sorted((r["id"], r["slots"]) for r in model.transform(new).collect()) == [(1, [0]), (2, [])]


def test_vector_scaler_and_selection_through_slots(spark):
    from tableprep.operators import scale as S
    from tableprep.operators import select as SEL
    x = dense_rows(6, 90, 12)
    df = vectors(spark, x)
    robust = S.VectorScaler("v", "s", S.ScalingConfig("robust")).fit(df)
    q = np.quantile(x, [0.25, 0.5, 0.75], axis=0)
    spread = np.where(q[2] - q[0] == 0, 1.0, q[2] - q[0])
    assert np.allclose(robust.shift, q[1]) and np.allclose(robust.div, spread)
    sparse = df.where("id % 3 <> 0")
    kept = x[np.arange(len(x)) % 3 != 0]
    standard = S.VectorScaler("v", "s", S.ScalingConfig("standard")).fit(sparse)
    assert np.allclose(standard.div, np.where(kept.std(axis=0) == 0, 1.0, kept.std(axis=0)))
    assert np.allclose(SEL.population_variances(sparse, "v"), kept.var(axis=0))


def test_correlated_pairs_equal_the_matrix(spark, monkeypatch):
    from tableprep.operators import select as SEL
    x = dense_rows(8, 200, 14)
    x[:, 1], x[:, 2], x[:, 6] = 2 * x[:, 0], x[:, 0] + 0.1 * (np.arange(200) % 2), 5 + 0.01 * x[:, 7]
    x[:, 9] = np.where(x[:, 8] == 0, 3.0, 0.0)       # never meets slot 8
    x[:, 8] = np.where(x[:, 8] != 0, 3.0, 0.0)
    df = vectors(spark, x)
    with np.errstate(all="ignore"):
        want = np.corrcoef(x.T)
    pairs = {(i, j): want[i, j] for i in range(14) for j in range(i + 1, 14) if abs(want[i, j]) > 0.6}
    for held in (2_000_000, 50):
        monkeypatch.setattr(SL, "PAIRS_HELD", held)
        got = {(r["i"], r["j"]): r["r"] for r in SL.correlated_slots(df, "v", 0.6).collect()}
        assert got.keys() == pairs.keys() and all(abs(got[k] - v) < 1e-6 for k, v in pairs.items())
    assert (8, 9) in pairs and (0, 1) in pairs
    sparse = df.where("id % 3 <> 0")
    cfg = SEL.FeatureSelectionConfig(method="correlation", corr_threshold=0.6)
    kept = SEL.FeatureSelector("v", "s", None, cfg).fit(sparse).indices
    with np.errstate(all="ignore"):
        m = np.abs(np.corrcoef(x[np.arange(200) % 3 != 0].T))
    assert kept == [j for j in range(14) if not any(m[i, j] > 0.6 for i in range(j))]


def test_quantiles_deal_rows_out_by_their_number(spark, monkeypatch):
    """Each row goes once, not once a target, to one of as many tasks as there are rows for."""
    import re
    monkeypatch.setattr(SL, "INSIDE", 200)
    rows = [(i % 7, float((i * 37) % 1009)) for i in range(2000)]
    out = SL.grouped_quantiles(spark.createDataFrame(rows, "k int, x double"), "k", "x", [0.25, 0.5, 0.75])
    dealt = re.findall(r"RepartitionByExpression \[key.*\], (\d+)", out._jdf.queryExecution().optimizedPlan().toString())
    assert dealt == ["10"]
    for r in out.collect():
        assert abs(r["quantile"] - np.quantile([x for k, x in rows if k == r["k"]], r["prob"])) < 1e-9


def test_quantiles_of_many_brackets_joined_by_key(spark, monkeypatch):
    monkeypatch.setattr(SL, "BRACKETS_SENT", 2)
    rows = [(i % 50, float((i * 37) % 211)) for i in range(3000)]
    out = SL.grouped_quantiles(spark.createDataFrame(rows, "k int, x double"), "k", "x", [0.1, 0.5], None, 20, 4).collect()
    assert len(out) == 100
    for r in out:
        assert abs(r["quantile"] - np.quantile([x for k, x in rows if k == r["k"]], r["prob"])) < 1e-9


@pytest.mark.parametrize("kind,threshold", [("presence", 0.5), ("presence", 0.95), ("counts", 0.6), ("offset", 0.9)])
def test_correlation_of_values_without_negative_ones_makes_few_products(spark, monkeypatch, kind, threshold):
    rng = np.random.default_rng(5)
    n, width = 400, 40
    x = (rng.random((n, width)) < np.geomspace(0.9, 0.01, width)).astype(float)
    if kind == "counts":
        x *= rng.integers(1, 9, x.shape)
    if kind == "offset":
        x[:, :8] += 1000.0
    for k, (a, b) in enumerate([(5, 20), (9, 30), (12, 39), (3, 4), (2, 33)]):  # near copies, three scaled, one opposite
        x[:, b] = x[:, a] * (1 + k % 3)
        x[rng.integers(0, n, 3), b] = 0.0
    x[:, 1] = (x[:, 0] == 0) * 2.0
    x[:, 7] = 3.0
    rows = [(Vectors.sparse(width, {j: float(v) for j, v in enumerate(r) if v}),) for r in x]
    df = spark.createDataFrame(rows, ["v"]).repartition(2)
    with np.errstate(all="ignore"):
        want = np.corrcoef(x.T)
    pairs = {(i, j): want[i, j] for i in range(width) for j in range(i + 1, width) if abs(want[i, j]) > threshold}
    assert len(pairs) >= 2 and (kind != "presence" or any(v < 0 for v in pairs.values()))
    for held in (2_000_000, 30):
        monkeypatch.setattr(SL, "PAIRS_HELD", held)
        got = {(r["i"], r["j"]): r["r"] for r in SL.correlated_slots(df, "v", threshold).collect()}
        assert got.keys() == pairs.keys() and all(abs(got[k] - v) < 1e-6 for k, v in pairs.items())
    if kind == "presence":  # products of a few slots of like frequency, not of all pairs of a row
        stats = [{"slot": j, "mean": x[:, j].mean(), "sd": x[:, j].std(), "max": x[:, j].max()}
                 for j in range(width) if x[:, j].std()]
        of = SL._partners(stats, threshold)
        made = sum(len(i) for r in x for i, _, _ in SL._partner_pairs(np.flatnonzero(r), r[r != 0], of))
        every = sum(k * (k - 1) // 2 for k in (x != 0).sum(axis=1))
        assert made < every * (0.8 if threshold == 0.5 else 0.45)
