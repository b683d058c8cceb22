"""Frequent terms from summaries, and weights from sparse parts."""

import collections
import hashlib
import math
import random
import re

import pyarrow as pa
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import SparseVector
from pyspark.sql import functions as F

from tableprep.operators import encode as E
from tableprep.operators import terms as T


def counted(texts, ngrams):
    total, held = collections.Counter(), collections.Counter()
    for text in texts:
        w = re.findall(r"\w\w+", (text or "").lower())
        own = w + ([f"{a} {b}" for a, b in zip(w, w[1:])] if ngrams > 1 else [])
        total.update(own)
        held.update(set(own))
    return sorted(((t, n, held[t]) for t, n in total.items()), key=lambda r: (-r[1], r[0].encode()))


def corpus(spark, seed, n=400, parts=6):
    """Words of falling frequency; in each part other rare words come first, so that summaries differ."""
    rng = random.Random(seed)
    texts = [" ".join(f"w{int(rng.paretovariate(0.7))}" if rng.random() < 0.6 else f"é{i}x{rng.randint(0, 9)}"
                      for _ in range(rng.randint(0, 60))) for i in range(n)]
    texts[3], texts[5] = None, ""
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id long, text string").repartition(parts, "id")
    return texts, E.with_tokens(df, F.coalesce("text", F.lit("")))


@pytest.mark.parametrize("ngrams", [1, 2])
def test_top_terms_are_exact_however_small_the_summaries(spark, ngrams):
    texts, docs = corpus(spark, 1)
    want = counted(texts, ngrams)
    for k, counters in ((5, 40), (30, 200), (30, 10 ** 6), (10 ** 5, 50)):
        got = T.frequent_terms(docs, "tokens", k, ngrams, counters)
        assert got.rows == want[:k] and got.n_docs == len(texts)
        assert got.candidates <= T.SPARE * k


def test_summaries_grow_until_the_bound_decides(spark):
    texts, docs = corpus(spark, 2)
    small = T.frequent_terms(docs, "tokens", 40, 1, 4)
    assert small.rounds > 1 and small.rows == counted(texts, 1)[:40]


def test_ties_at_the_edge(spark):
    docs = spark.createDataFrame([(f"tie{i:03d} once",) for i in range(300)], "text string").repartition(5)
    got = T.frequent_terms(E.with_tokens(docs, F.col("text")), "tokens", 7, 1, 10)
    assert got.rows == [("once", 300, 300)] + [(f"tie{i:03d}", 1, 1) for i in range(6)]


def test_bounds_hold_and_are_tight():
    """Each count lies between its lower bound and that plus ``off``; both ends are met."""
    rng = random.Random(3)
    own, true = T.Summary(10), collections.Counter()
    for _ in range(200):
        words = [f"w{int(rng.paretovariate(0.5)) % 500}" for _ in range(100)]
        own.add(pa.array(words))
        true.update(words)
    own.shrink()
    low = dict(zip(own.table.column("term").to_pylist(), own.table.column("low").to_pylist()))
    assert len(low) <= 10 and own.off > 0
    assert all(low.get(t, 0) <= n <= low.get(t, 0) + own.off for t, n in true.items())
    even = T.Summary(2)
    for w in ("aa", "bb", "cc", "aa", "bb", "cc"):  # three terms in two places: all that is known is the bound
        even.add(pa.array([w] * 4))
    even.add(pa.array([f"z{i}" for i in range(9)]))
    even.shrink()
    low = dict(zip(even.table.column("term").to_pylist(), even.table.column("low").to_pylist()))
    assert {8} == {low.get(t, 0) + even.off for t in ("aa", "bb", "cc")}


def test_long_and_many_rows_in_slices(spark, monkeypatch):
    texts, docs = corpus(spark, 4)
    monkeypatch.setattr(T, "SLICE", 17)
    batch = pa.RecordBatch.from_pydict({"t": [r["tokens"] for r in docs.collect()] + [None, [], ["aa"] * 100]})
    parts = list(T.slices(batch))
    assert sum(p.num_rows for p in parts) == batch.num_rows and len(parts) > 20
    assert all(p.num_rows == 1 or len(p.column(0).flatten()) <= 17 for p in parts)


@pytest.mark.parametrize("sublinear", [False, True])
def test_vectors_equal_the_long_form(spark, sublinear):
    texts, docs = corpus(spark, 5, 60)
    df = docs.drop("tokens")
    cfg = E.TfidfConfig(25, 2, sublinear_tf=sublinear)
    model = E.TfidfVectorizer("text", "v", cfg).fit(df)
    rows = model.transform(df).select("id", "v").collect()
    assert all(isinstance(r["v"], SparseVector) and r["v"].size == 25 for r in rows)
    got = {(r["id"], model.vocabulary[i]): w for r in rows for i, w in zip(r["v"].indices, r["v"].values)}
    long = {(r["id"], r["term"]): r["weight"] for r in E.tfidf_long(df, "id", "text", cfg).collect()}
    assert got == long
    vocabulary = {t: math.log((1 + len(texts)) / (1 + d)) + 1 for t, _, d in counted(texts, 2)[:25]}
    for i, text in enumerate(texts):
        own = {t: n for t, n, _ in counted([text], 2) if t in vocabulary}
        raw = {t: (1 + math.log(n) if sublinear else n) * vocabulary[t] for t, n in own.items()}
        length = math.sqrt(sum(x * x for x in raw.values()))
        assert all(abs(got[i, t] - x / length) < 1e-12 for t, x in raw.items())
    assert len(got) == sum(len([t for t, _, _ in counted([x], 2) if t in vocabulary]) for x in texts)


def test_signed_hashing_vector_equals_the_long_form(spark):
    df = spark.createDataFrame([(1, "aa bb cc aa"), (2, ""), (3, None), (4, "dd " * 50 + "ee")], "id long, text string")
    stage = E.SignedHashing("text", "v", 7)
    got = {(r["id"], i): w for r in stage.transform(df).collect() for i, w in enumerate(r["v"].toArray()) if w}
    assert got == {(r["id"], r["bucket"]): r["weight"] for r in E.hashing_long(df, "id", "text", 7).collect()}
    want = collections.Counter()
    for t in "aa bb cc aa".split():
        d = hashlib.md5(t.encode()).hexdigest()
        want[int(d[:8], 16) % 7] += -1 if int(d[8], 16) >= 8 else 1
    length = math.sqrt(sum(x * x for x in want.values()))
    assert all(abs(got.get((1, b), 0.0) - x / length) < 1e-12 for b, x in want.items())


def test_encoder_with_hashing_and_with_sublinear_counts(spark):
    rows = [(i, f"some longer text number {i % 5} with words of {i % 3} kinds", float(i % 2)) for i in range(40)]
    df = spark.createDataFrame(rows, "id long, body string, y double")
    for options in ({"text_method": "hashing", "max_features": 16}, {"sublinear_tf": True, "max_features": 12}):
        model = E.Encoder(E.EncodingConfig(label_col="y", passthrough=("id",), **options)).fit(df)
        out = model.transform(df).select(vector_to_array("features").alias("v")).collect()
        assert model.text == ["body"] and all(len(r["v"]) == options["max_features"] for r in out)
        assert all(abs(sum(x * x for x in r["v"]) - 1) < 1e-9 for r in out)
