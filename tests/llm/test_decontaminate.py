import random

import numpy as np

from tableprep.llm.decontaminate import MASKS, find_leaks, seeds

from .helpers import words

SCHEMA = "doc_id long, text string"


def _prose(rng, n):
    return ["v%04d" % rng.randrange(5000) for _ in range(n)]


def test_a_seed_ignores_substitutions_at_zeros():
    h = np.arange(1, 10, dtype=np.uint64)
    for number, mask in enumerate(MASKS):
        for i, one in enumerate(mask):
            other = h.copy()
            other[i] = 99
            assert (seeds(h, mask, number) == seeds(other, mask, number)).all() == (one == "0")


def test_whole_edited_and_clean_passages(spark):
    rng = random.Random(2)
    items = {i: _prose(rng, n) for i, n in enumerate((12, 18, 40, 300, 5, 2, 1))}
    rows, want = [], set()
    for doc in range(60):
        text = _prose(rng, rng.randrange(0, 400))
        item = rng.choice(list(items))
        kind, leak = doc % 4, list(items[item])
        if kind == 1:
            want.add((doc, item))
        elif kind == 2 and len(leak) >= 12:  # one word in ten replaced
            for at in range(5, len(leak), 10):
                leak[at] = "changed"
            want.add((doc, item))
        elif kind == 3 and len(leak) >= 12:  # a quarter of the item only, below the long run
            leak = leak[:min(len(leak) // 4, 12)]
        else:
            leak = []
        at = rng.randrange(len(text) + 1)
        rows.append((doc, " ".join(text[:at] + [w.upper() for w in leak] + text[at:])))
    bench = spark.createDataFrame([(i, " ".join(t)) for i, t in items.items()], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in find_leaks(spark.createDataFrame(rows, SCHEMA), bench).collect()}
    single = {(d, i) for d, t in rows for i in (5, 6) if b" " + b" ".join(words(" ".join(items[i]))) + b" "
              in b" " + b" ".join(words(t)) + b" "}
    assert got - single == want - single and single <= got


def test_small_table_equals_brute_force_on_exact_passages(spark, small_docs):
    from .conftest import SMALL
    bench = spark.read.parquet(f"{SMALL}/benchmark.parquet")
    texts = {r["doc_id"]: b" ".join(words(r["text"])) for r in small_docs.collect()}
    want = {(d, r["item_id"]) for r in bench.collect() for d, t in texts.items() if b" ".join(words(r["text"])) in t}
    got = {(r["doc_id"], r["item_id"]): r["likeness"] for r in find_leaks(small_docs, bench).collect()}
    assert want <= got.keys() and all(got[k] == 1.0 for k in want)


def test_odd_rows(spark, odd_docs, no_docs):
    bench = spark.createDataFrame([(1, "a MUCH shared line here"), (2, None), (3, ""), (None, "word"), (4, "word"),
                                   (4, "word")], "item_id long, text string")
    got = sorted(((r["doc_id"], r["item_id"]) for r in find_leaks(odd_docs, bench).collect()), key=str)
    assert got == sorted([(7, 4), (8, 1), (9, 1), (None, 1)], key=str)
    assert find_leaks(no_docs, bench).count() == 0 and find_leaks(odd_docs, bench.limit(0)).count() == 0


def test_no_pattern_of_substitutions_is_missed(spark):
    rng = random.Random(7)
    items = {n: _prose(rng, n) for n in range(1, 31)}
    rows, want = [], set()
    for n, item in items.items():
        for _ in range(12):
            leak = list(item)
            for at in rng.sample(range(n), n - -(-8 * n // 10)):
                leak[at] = "changed"
            want.add((len(rows), n))
            rows.append((len(rows), " ".join([f"a{i}" for i in range(20)] + leak + [f"z{i}" for i in range(20)])))
    for n in (20, 25, 30):  # thirteen equal words of sixteen, from inside a longer item
        for _ in range(30):
            leak = items[n][2:18]
            for at in rng.sample(range(16), 3):
                leak[at] = "changed"
            want.add((len(rows), n))
            rows.append((len(rows), " ".join(["before", *leak, "after"])))
    bench = spark.createDataFrame([(n, " ".join(t)) for n, t in items.items()], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in find_leaks(spark.createDataFrame(rows, SCHEMA), bench).collect()}
    assert want <= got
