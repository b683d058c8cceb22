import random
import re

from pyspark.sql import functions as F

from tableprep.llm import licenses
from tests.llm.conftest import SMALL

WORD = re.compile(r"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def blocks(text, templates, threshold):
    """{(template, start): common words} by looking at every block of every class."""
    w, out = words(text), {}
    for t in licenses.template_sets(templates, threshold):
        for start in range(0, len(w), t["span"]):
            common = len(set(w[start:start + 2 * t["span"]]) & set(t["words"]))
            if common >= t["needed"]:
                out[t["template"], start] = common
    return out


def brute(doc_id, text, templates=licenses.TEMPLATES, threshold=licenses.THRESHOLD, phrases=licenses.PHRASES):
    w = words(text)
    places, base = [], set()
    for phrase, label in phrases:
        p = words(phrase)
        at = [i for i in range(len(w)) if w[i:i + len(p)] == p]
        places += at
        base |= {label} if at else set()
    sets = licenses.template_sets(templates, threshold)
    met = blocks(text, templates, threshold)
    more = {sets[t]["label"] for t, _ in met}
    score = 1.0 if places else max((n / sets[t]["n"] for (t, _), n in met.items()), default=0.0)
    return (doc_id, len(w), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)),
            ",".join(sorted(base | more)), score)


def found(df, **options):
    return sorted((tuple(r) for r in licenses.scan_licenses(df, **options).collect()), key=repr)


def expected(df, **options):
    return sorted((brute(r["doc_id"], r["text"], **options) for r in df.select("doc_id", "text").collect()), key=repr)


def test_given_table(small_docs):
    assert found(small_docs) == expected(small_docs)


def edited_docs(spark):
    """License statements with words changed, left out and broken over lines, inside other text of many lengths."""
    rng = random.Random(5)
    filler = "the of to and any software work this terms license under is in a rights notice above copies you may".split()
    rows = []
    for i in range(160):
        out = [rng.choice(filler) for _ in range(rng.choice([0, 3, 40, 300]))]
        for _, text in rng.sample(licenses.TEMPLATES, rng.choice([0, 1, 1, 2])):
            own = [w if rng.random() > 0.25 else rng.choice(["", "changed", w + w]) for w in text.split()]
            out += own if rng.random() < 0.8 else own[:len(own) // 2]
            out += [rng.choice(filler) for _ in range(rng.choice([0, 5, 60]))]
        if i % 9 == 0:
            out += ["MIT", "License,", "cc-by", "CC", "by", "CC-BY"]
        rows.append((i, rng.choice([" ", "\n", "--"]).join(out)))
    return spark.createDataFrame(rows, "doc_id long, text string")


def test_edited_statements(spark):
    docs = edited_docs(spark)
    got = found(docs)
    assert got == expected(docs)
    assert sum(r[2] == 0 and r[6] != "" for r in got) > 30  # labels that the phrases alone do not give


def test_every_block_is_found(spark):
    docs = edited_docs(spark)
    for threshold in (0.4, 0.8, 1.0):
        rows = licenses.license_blocks(docs, threshold=threshold).collect()
        got = {(r["doc_id"], r["template"], r["start"]): r["common"] for r in rows}
        assert len(got) == len(rows)
        want = {(d["doc_id"], *k): n for d in docs.collect()
                for k, n in blocks(d["text"], licenses.TEMPLATES, threshold).items()}
        assert got == want and want
        texts = {d["doc_id"]: words(d["text"]) for d in docs.collect()}
        assert all(r["block"].split(" ") == texts[r["doc_id"]][r["start"]:r["start"] + r["n_words"]] for r in rows)


def test_own_templates_and_phrases(spark):
    docs = spark.createDataFrame([(1, "aa bb aa bb aa cc é É kK"), (2, "aa"), (3, "x " * 50 + "É é q")],
                                 "doc_id long, text string")
    options = {"templates": [("x", "É q"), ("y", "aa"), ("none", "--")], "phrases": [("aa bb aa", "z"), ("É k", "é")],
               "threshold": 0.9}
    assert found(docs, **options) == expected(docs, **options)
    options = {"templates": [], "phrases": []}
    assert found(docs, **options) == expected(docs, **options)


def test_odd_rows(odd_docs, no_docs):
    assert found(odd_docs) == expected(odd_docs)
    assert found(no_docs) == []
    clash = odd_docs.select("*", *[F.lit("x").alias(c) for c in ("words", "places", "rank", "block", "template", "at")])
    assert found(clash) == expected(odd_docs)


def test_no_python_in_the_plan(spark):
    plan = licenses.scan_licenses(spark.read.parquet(f"{SMALL}/documents.parquet"))._jdf.queryExecution().toString()
    assert not re.search(r"Python|Pandas|Arrow|CartesianProduct", plan)
