import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from tableprep.llm import base
from tableprep.llm.components import components


def test_batch_words_are_the_words_of_each_text():
    texts = [None, "", " \x0b", "a", "A a\tB\nb", "x\x85y  z", "É é", "w" * 300_000 + " q", "end"]
    h, bounds = base.batch_word_hashes(pa.array(["skipped", *texts]).slice(1))
    seen = {}
    for i, t in enumerate(texts):
        own = base.words(t)
        assert len(own) == bounds[i + 1] - bounds[i]
        for w, x in zip(own, h[bounds[i]:bounds[i + 1]].tolist()):
            assert seen.setdefault(w, x) == x
    assert len(set(seen.values())) == len(seen)


def test_running_total_is_exclusive_and_handles_null_groups(spark):
    df = spark.createDataFrame([("a", 0, 1, 5), ("a", 0, 2, 7), ("a", 1, 3, 1), (None, 0, 4, 2), (None, 2, 5, 3)],
                               "g string, chunk int, o int, v int")
    got = base.running_total(df, ["g"], "chunk", [F.col("o")], F.col("v"), "before")
    assert {r["o"]: r["before"] for r in got.collect()} == {1: 0, 2: 5, 3: 12, 4: 0, 5: 2}
    assert got.columns == ["g", "chunk", "o", "v", "before"]


def test_salted_lookup_equals_a_plain_join(spark):
    big = spark.range(6000).select((F.col("id") % 7).alias("k"), "id", F.lit(1).alias("salt")).union(
        spark.range(4000).select(F.lit(3), F.col("id") + 10_000, F.lit(1)))
    small = spark.createDataFrame([(3, "x"), (4, "y"), (99, "z")], "k long, v string")
    hot = base.hot_keys(big.groupBy("k").count(), ["k"], big.count(), "count")
    assert [r["k"] for r in hot.collect()] == [3]
    for how in ("inner", "left", "left_semi", "left_anti"):
        got = base.salted_lookup(big, small, ["k"], F.col("id"), how)
        want = big.join(small, "k", how)
        assert sorted(map(str, got.select(want.columns).collect())) == sorted(map(str, want.collect()))


def test_bit_map_never_misses(spark):
    ids = spark.range(5000).where("id % 3 = 0")
    bit_map = base.BitMap(base.id_hashes(ids, "id"), "hash", ids.count())
    flags = bit_map.holds()(base.mix(np.arange(5000, dtype=np.uint64)))
    assert flags[::3].all() and flags.sum() < 1800


def test_components_of_chains_stars_and_nothing(spark):
    chain = [(i, i + 1) for i in range(0, 40)]
    star = [(100, 100 + i) for i in range(1, 30)]
    rows = [(b, a) if i % 2 else (a, b) for i, (a, b) in enumerate(chain + star)] + [(7, 7), (None, 5)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(rows, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{i: 100 for i in range(100, 130)}}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
