import collections

import pytest

from tableprep.llm.mixing import mix_sources, water_fill

from .helpers import words


def test_water_fill():
    assert water_fill([100, 100, 100], [1, 2, 3]) == [50, 100, 150]
    got = water_fill([1000, 10, 10], [1, 2, 3])
    assert got[1:] == [30, 30] and got[0] == pytest.approx(960)
    assert water_fill([0, 5], [1, 2]) == [0.0, 5.0] and water_fill([], []) == [] and water_fill([0], [1]) == [0.0]


def _check(docs, slack=2):
    table, schedule = mix_sources(docs)
    rows, pieces = table.collect(), schedule.collect()
    want = sorted(((r["doc_id"], r["source"], len(words(r["text"]))) for r in docs.collect()), key=str)
    assert sorted(((r["doc_id"], r["source"], r["size"]) for r in rows), key=str) == want
    sizes = collections.Counter()
    for _, source, size in want:
        sizes[source] += size
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    targets = dict(zip(order, water_fill([sizes[s] for s in order], [i % 3 + 1 for i in range(len(order))])))
    taken = collections.Counter()
    by_row = collections.Counter()
    for p in pieces:
        by_row[p["row"]] += p["n_words"]
        assert p["n_words"] > 0
    block = max(1, min(2048, sum(sizes.values()) // 50_000))
    for r in rows:
        assert r["target"] == targets[r["source"]] and r["source_size"] == sizes[r["source"]]
        assert 0 <= r["taken"] <= 3 * r["size"] and r["taken"] == by_row[r["row"]]
        taken[r["source"]] += r["taken"]
    for s in order:
        assert abs(taken[s] - targets[s]) <= slack * block + 1e-6
    assert all(r.asDict() == s.asDict() for r, s in zip(sorted(rows, key=str), sorted(mix_sources(docs)[0].collect(), key=str)))
    slots = collections.Counter()
    for p in pieces:
        slots[p["slot"]] += p["n_words"]
    assert max(slots.values(), default=0) <= block


def test_small_table(small_docs):
    _check(small_docs, slack=4)


def test_odd_rows(odd_docs):
    _check(odd_docs, slack=4)


def test_no_rows(no_docs):
    table, schedule = mix_sources(no_docs)
    assert table.count() == 0 and schedule.count() == 0
