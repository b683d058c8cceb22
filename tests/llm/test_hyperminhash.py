import random

import numpy as np

from tableprep.llm import hyperminhash as H

from .helpers import near_groups, shingle_set


def _random_sets(rng, n, share):
    common = int(n * share)
    ids = rng.integers(0, 1 << 62, 2 * n - common, dtype=np.int64).astype(np.uint64)
    return np.unique(ids[:n]), np.unique(ids[n - common:])


def test_estimates_follow_the_jaccard_index():
    rng = np.random.default_rng(5)
    for n, form in ((100, H.sketch_small), (2000, H.sketch_large)):
        for share in (0.0, 0.5, 0.9):
            true, got = [], []
            for _ in range(30):
                u, v = _random_sets(rng, n, share)
                both = len(np.intersect1d(u, v))
                true.append(both / (len(u) + len(v) - both))
                got.append(H.estimate(form(u)[None], form(v)[None], np.array([len(u)]), np.array([len(v)]),
                                      np.array([form is H.sketch_small]))[0])
            assert abs(np.mean(got) - np.mean(true)) < 0.03


def test_chance_agreement_is_predicted():
    rng = np.random.default_rng(7)
    agree = np.mean([(H.sketch_large(rng.integers(0, 1 << 62, 3000).astype(np.uint64)) == H.sketch_large(
        rng.integers(0, 1 << 62, 3000).astype(np.uint64))).mean() for _ in range(400)])
    want = H.collision_rate(np.array([3000.0]), np.array([3000.0]), np.array([240.0]))[0]
    assert abs(agree - want) < 4 * np.sqrt(want / (400 * 240)) + 1e-4


def _near_corpus():
    """Chains, stars, tiny sets and a family of near copies that its smallest member does not reach at once."""
    rng = random.Random(11)
    word = lambda: "w%05d" % rng.randrange(20_000)
    rows, doc = [], 0
    for size in (5, 9, 12, 30, 120, 260, 900):
        base = [word() for _ in range(size)]
        for edits in range(10):
            text = list(base)
            for _ in range(edits // 2):
                text[rng.randrange(len(text))] = word()
            if edits % 3 == 2:
                base = text  # drift: later copies resemble each other more than the first
            rows.append((doc, " ".join(text)))
            doc += 1
        rows.append((doc, " ".join([*base, word()])))
        rows.append((doc + 1, " ".join(base[:-1])))
        doc += 2
    shared = [word() for _ in range(60)]
    rows += [(doc + i, " ".join(shared + [word() for _ in range(60)])) for i in range(40)]
    rng.shuffle(rows)
    return rows


def test_components_equal_brute_force(spark):
    rows = _near_corpus()
    want = near_groups({d: shingle_set(t) for d, t in rows})
    got = H.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == want
    assert {r["doc_id"]: r["n_shingles"] for r in got} == {d: len(shingle_set(t)) for d, t in rows}
    assert len({r["component_id"] for r in got if r["kept"]}) == len(set(want.values()))


def test_odd_rows(odd_docs, no_docs):
    got = sorted(map(tuple, H.near_duplicates(odd_docs).collect()), key=str)
    by_id = {r[0]: r for r in got}
    assert len(got) == odd_docs.count()
    assert by_id[2][2:] == (1, False) and by_id[1][2:] == (1, True)
    for doc in (4, 5, 6):
        assert by_id[doc] == (doc, 0, doc, True)
    assert sum(r[0] == 9 and r[2] == 9 for r in got) == 2
    assert [r[2:] for r in got if r[0] is None] == [(None, True)] * 2
    assert H.near_duplicates(no_docs).count() == 0
