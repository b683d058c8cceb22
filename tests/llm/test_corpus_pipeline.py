import base64
import collections
import random

import corpus_pipeline as C
import pytest

from tableprep.llm.base import stage

from .conftest import SMALL
from .helpers import near_groups, shingle_set, words


@pytest.fixture(scope="module")
def stages(spark, small_docs):
    docs, out = small_docs, [small_docs]
    for _, function in C.STAGES:
        docs = stage(function(spark, docs, SMALL))
        out.append(docs)
    return out


def test_columns_and_names(stages, small_docs):
    assert [n for n, _ in C.STAGES] == ["language_id", "near_dedup", "decontaminate", "mix", "token_blocks"]
    for docs in stages[:-1]:
        assert docs.columns == small_docs.columns


def test_each_stage_against_brute_force(spark, stages):
    first, lang, dedup, clean, mixed, tokens = (s.collect() for s in stages)
    assert {r["doc_id"] for r in lang} >= {r["doc_id"] for r in first if any(c.isalpha() for c in r["text"])}
    groups = near_groups({r["doc_id"]: shingle_set(r["text"]) for r in lang}, C.NEAR_PERCENT)
    assert {r["doc_id"] for r in dedup} == {d for d, g in groups.items() if d == g}
    items = [b" ".join(words(r["text"])) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    exact = {r["doc_id"] for r in dedup if any(i in b" ".join(words(r["text"])) for i in items)}
    gone = {r["doc_id"] for r in dedup} - {r["doc_id"] for r in clean}
    assert exact and exact == gone
    times = collections.Counter(r["doc_id"] for r in mixed)
    assert max(times.values()) <= 3 and times.keys() <= {r["doc_id"] for r in clean}
    assert collections.Counter(r["doc_id"] for r in tokens) == times
    ordered = sorted(tokens, key=lambda r: r["start"])
    assert [r["doc_id"] for r in ordered] == sorted(times.elements())
    assert all(a["start"] + a["n_tokens"] == b["start"] for a, b in zip(ordered, ordered[1:]))


def test_odd_rows_pass_through_every_stage(spark, odd_docs, no_docs):
    for docs in (odd_docs, no_docs):
        for name, function in C.STAGES:
            got = function(spark, docs, SMALL)
            if name != "token_blocks":
                assert got.columns == odd_docs.columns
            assert got.count() <= 3 * odd_docs.count()


def test_near_dedup_drops_copies_of_four_fifths(spark):
    base = [f"w{i}" for i in range(104)]  # 100 shingles
    rows = []
    for doc, edits in enumerate(([], [40, 80], [8, 22, 40, 60, 80])):  # a word changed changes five shingles
        rows.append((doc, " ".join(f"x{doc}{i}" if i in edits else w for i, w in enumerate(base)), "en", "s"))
    sets = {r[0]: shingle_set(r[1]) for r in rows}
    alike = [len(sets[0] & sets[d]) / len(sets[0] | sets[d]) for d in (1, 2)]
    assert 0.80 <= alike[0] < 0.85 and alike[1] < 0.80
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    assert {r["doc_id"] for r in C.near_dedup(spark, docs, SMALL).collect()} == {0, 2}


def test_language_id_drops_what_is_no_learned_language(spark, small_docs):
    rng = random.Random(4)
    letters = "abcdefghijklmnopqrstuvwxyz"
    finnish = ("Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan. Heille on annettu järki ja "
               "omatunto, ja heidän on toimittava toisiaan kohtaan veljeyden hengessä. Jokainen on oikeutettu kaikkiin "
               "tässä julistuksessa esitettyihin oikeuksiin ja vapauksiin.")
    texts = [base64.b64encode(rng.randbytes(n)).decode() for n in (200, 3000)]
    texts += [" ".join("".join(rng.choices(letters, k=rng.randint(2, 9))) for _ in range(n)) for n in (40, 500)]
    texts += [finnish, finnish * 5]
    short = ["the", "Avec.", "und der", "A.\nAll rights reserved."]
    rows = [(10**6 + i, t, None, None, None) for i, t in enumerate(texts + short)]
    docs = small_docs.select("doc_id", "text", "lang", "source", "n_chars")
    both = docs.unionByName(spark.createDataFrame(rows, docs.schema))
    kept = {r["doc_id"] for r in C.language_id(spark, both, SMALL).collect()}
    assert {d for d in kept if d >= 10**6} == {10**6 + len(texts) + i for i in range(len(short))}
    assert {r["doc_id"] for r in docs.collect() if any(c.isalpha() for c in r["text"])} <= kept
