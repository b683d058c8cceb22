"""Encoders and feature builders."""

import math

import pytest
from pyspark.ml import Pipeline
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from tableprep.operators import encode as E
from tableprep.operators import features as FE


def test_onehot_unseen_is_all_zeros(spark):
    train = spark.createDataFrame([("a",), ("b",), ("c",)], "c string")
    test = spark.createDataFrame([("b",), ("z",), (None,)], "c string")
    model = Pipeline(stages=list(E.onehot_stages(["c"]))).fit(train)
    rows = model.transform(test).select(vector_to_array("c_oh").alias("v")).collect()
    assert [r["v"] for r in rows] == [[0.0, 1.0, 0.0], [0.0, 0.0, 0.0], [0.0, 0.0, 0.0]]


def test_ordinal_unseen_raises(spark):
    train = spark.createDataFrame([("a",), ("b",)], "c string")
    model = E.ordinal_indexer(["c"]).fit(train)
    with pytest.raises(Exception):
        model.transform(spark.createDataFrame([("q",)], "c string")).collect()


def test_target_encoding_unseen_zero(spark):
    train = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("b", 5.0)], "c string, y double")
    m = E.TargetEncoder(["c"], "y").fit(train)
    out = m.transform(spark.createDataFrame([("a",), ("b",), ("z",), (None,)], "c string"))
    assert [r["c_te"] for r in out.collect()] == [2.0, 5.0, 0.0, 0.0]


def test_tfidf_vector_equals_long_form(spark):
    docs = spark.createDataFrame([(1, "the cat sat on the mat"), (2, "the dog sat"), (3, "a cat and a dog"),
                                  (4, "")], "id long, text string")
    cfg = E.TfidfConfig(max_features=7, ngrams=2)
    model = E.TfidfVectorizer("text", "v", cfg).fit(docs)
    vec = model.transform(docs).select("id", vector_to_array("v").alias("a")).collect()
    long = {(r["id"], r["term"]): r["weight"] for r in E.tfidf_long(docs, "id", "text", cfg).collect()}
    for r in vec:
        for slot, w in enumerate(r["a"]):
            assert abs(w - long.get((r["id"], model.vocabulary[slot]), 0.0)) < 1e-12


def test_tfidf_idf_formula(spark):
    docs = spark.createDataFrame([(1, "aa bb"), (2, "aa cc")], "id long, text string")
    model = E.TfidfVectorizer("text", "v", E.TfidfConfig(10, 1)).fit(docs)
    idf = dict(zip(model.vocabulary, model.idf))
    assert abs(idf["aa"] - 1.0) < 1e-12
    assert abs(idf["bb"] - (math.log(3 / 2) + 1)) < 1e-12


def test_polynomial_and_interactions_have_unique_names(spark):
    df = spark.createDataFrame([(1, 2.0, 3.0, 9.0, "u")], "id long, a double, b double, a_pow2 double, c string")
    cfg = FE.FeatureEngineeringConfig(polynomial_degree=2, passthrough=("id",))
    out = FE.FeatureEngineer(cfg).fit(df).transform(df)
    assert len(set(out.columns)) == len(out.columns)
    row = out.first()
    assert row["a_x_b"] == 6.0 and row["a_pow2"] == 9.0 and row["a_pow2_1"] == 4.0 and row["c"] == "u"


def test_interaction_array_matches_named(spark):
    df = spark.createDataFrame([(1.0, 2.0, 3.0, 4.0)], "a double, b double, c double, d double")
    got = df.select(F.array("a", "b", "c", "d").alias("x")).select(FE.interaction_array("x", 4)).first()[0]
    assert got == [2.0, 3.0, 4.0, 6.0, 8.0, 12.0]


def test_frequency_encoding_miss_zero(spark):
    train = spark.createDataFrame([("a",), ("a",), ("b",), (None,)], "c string")
    m = FE.FeatureEngineer(FE.FeatureEngineeringConfig(create_text_features=False)).fit(train)
    out = m.transform(spark.createDataFrame([("a",), ("z",)], "c string"))
    assert [r["c_freq"] for r in out.collect()] == [2 / 3, 0.0]


def test_encoder_assembles_blocks(spark):
    df = spark.createDataFrame([(1, 1.0, "x", "a long text value with many words in it", 0.0),
                                (2, 2.0, "y", "another fairly long text for the vectorizer", 1.0)],
                               "id long, n double, c string, t string, y double")
    m = E.Encoder(E.EncodingConfig(label_col="y", passthrough=("id",), max_features=10)).fit(df)
    out = m.transform(df)
    assert m.text == ["t"] and m.cat == ["c"] and m.num == ["n"]
    assert out.columns == ["id", "y", "features"]
