"""Scalar functions against plain-Python definitions of the same rules."""

import re

from pyspark.sql import functions as F

from tableprep.functions import clean_text, to_numeric, unique_words, uppercase_ratio, word_count


def py_clean(t):
    t = t.lower()
    t = re.sub(r"<.*?>", " ", t)
    t = re.sub(r"http\S+|www\S+", " ", t)
    t = re.sub(r"[^a-zA-Z0-9\s]", " ", t)
    return re.sub(r"\s+", " ", t).strip()


EDGE_TEXTS = ["", "   ", "Hello <b>World</b>!", "a<br\n>b", "x<i\r>y", "see http://a.b/c?d=1 now",
              "www.example.com end", "café naïve", "tab\there\nnew\r\nline", "<<>>",
              "UPPER lower MiXeD", "  nbsp  ", "emoji \U0001F600 text", "1,000.50 $ 20%"]


def test_clean_text_matches_python(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(EDGE_TEXTS)], "i int, t string")
    got = {r["i"]: r["c"] for r in df.select("i", clean_text("t").alias("c")).collect()}
    for i, t in enumerate(EDGE_TEXTS):
        assert got[i] == py_clean(t), (t, got[i], py_clean(t))


def test_clean_text_null_passes_through(spark):
    df = spark.createDataFrame([(None,)], "t string")
    assert df.select(clean_text("t")).first()[0] is None


def test_keep_unicode_letters_option(spark):
    df = spark.createDataFrame([("Café déjà-vu",)], "t string")
    assert df.select(clean_text("t", keep_unicode_letters=True)).first()[0] == "café déjà vu"
    assert df.select(clean_text("t")).first()[0] == "caf d j vu"


def test_to_numeric_samples(spark):
    samples = ["1", " 12 ", "-3.5", "1e3", ".5", "1d", "1_000", "inf", "-Infinity", "nan", "abc", "", None, "1.2.3"]
    expect = [1.0, 12.0, -3.5, 1000.0, 0.5, None, None, float("inf"), float("-inf"), None, None, None, None, None]
    df = spark.createDataFrame([(i, s) for i, s in enumerate(samples)], "i int, s string")
    got = {r["i"]: r["v"] for r in df.select("i", to_numeric("s").alias("v")).collect()}
    assert [got[i] for i in range(len(samples))] == expect


def test_word_features_match_python(spark):
    texts = ["", "a", "Hello  hello World", "  lead and trail  ", "Line\nbreak\tTab", "ÀB cd"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    rows = {r["i"]: r for r in df.select("i", word_count("t").alias("w"), unique_words("t").alias("u"),
                                         uppercase_ratio("t").alias("r")).collect()}
    for i, t in enumerate(texts):
        assert rows[i]["w"] == len(t.split())
        assert rows[i]["u"] == len(set(t.split()))
        assert abs(rows[i]["r"] - sum(1 for c in t if c.isupper()) / (len(t) + 1)) < 1e-12


def test_weekday_monday_is_zero(spark):
    from tableprep.functions import datetime_parts
    df = spark.createDataFrame([("2024-01-01 10:00:00",)], "t string").select(F.to_timestamp("t").alias("ts"))
    row = df.select(*datetime_parts("ts")).first()
    assert (row["ts_year"], row["ts_month"], row["ts_day"], row["ts_weekday"]) == (2024, 1, 1, 0)
