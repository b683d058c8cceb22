import base64
import hashlib

import numpy as np
import pyarrow as pa
import pytest

from tableprep.llm import spotsigs as S


def test_signatures_are_anchors_with_the_next_content_words():
    one, two, three, none = S.signature_sets(pa.array([
        "the cat of sat " + "and so " * 20, "THE cat,\n of  sat! " + "and so " * 20, "the cat of ran " + "and so " * 20, None]))
    assert one.tolist() == two.tolist() and one.tolist() != three.tolist() and not len(none)


def test_likeness():
    u, v = np.array([1, 2, 3], np.uint32), np.array([2, 3, 4], np.uint32)
    assert S.likeness(u, v) == 0.5 and S.likeness(u[:0], u[:0]) == 1.0 and S.likeness(u, u[:0]) == 0.0
    assert S.likeness(u[:1], u, floor=0.5) == 0.0


def _brute(rows):
    rows = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), r[1] or ""))
    out = []
    for i, (doc, text) in enumerate(rows):
        text, nxt = text or "", rows[(i + 1) % len(rows)][1] or ""
        k = len(text) // 3
        edited = text[:len(text) - k] + nxt[:k]
        own, new, after = (S.signature_sets(pa.array([x]))[0] for x in (text, edited, nxt))
        out.append((doc, len(text), hashlib.sha256(edited.encode()).hexdigest(), S.fingerprint(own), S.fingerprint(new),
                    S.likeness(own, new), S.likeness(own, after)))
    return sorted(out, key=str)


def test_edited_texts_equal_brute_force(spark, small_docs):
    rows = [(r["doc_id"], r["text"]) for r in small_docs.collect()]
    got = [tuple(r) for r in S.edited_fingerprints(small_docs).collect()]
    assert sorted(got, key=str) == _brute(rows)
    assert np.mean([r[5] > r[6] for r in got]) > 0.95


def test_odd_rows(spark, odd_docs, no_docs):
    # rows that share an id are ordered by their packed texts, so only distinct ids are compared row by row
    docs = odd_docs.dropDuplicates(["doc_id"])
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    assert sorted((tuple(r) for r in S.edited_fingerprints(docs).collect()), key=str) == _brute(rows)
    assert S.edited_fingerprints(odd_docs).count() == odd_docs.count()
    assert S.edited_fingerprints(no_docs).count() == 0
    alone = spark.createDataFrame([(1, "abcdef")], "doc_id long, text string")
    assert S.edited_fingerprints(alone).first()["edited_sha256"] == hashlib.sha256(b"abcdab").hexdigest()


@pytest.mark.parametrize("threshold", [0.8, 0.5])
def test_near_pairs_equal_brute_force(small_docs, threshold):
    prints = S.fingerprints(small_docs)
    rows = [r for r in prints.collect() if r["n_signatures"]]
    sets, rep = {}, {}
    for r in sorted(rows, key=lambda r: r["doc_id"]):
        rep.setdefault(r["fingerprint"], r["doc_id"])
        sets[rep[r["fingerprint"]]] = np.frombuffer(base64.b64decode(r["fingerprint"]), "<u4")
    ids = sorted(sets)
    want = {(a, b) for i, a in enumerate(ids) for b in ids[i + 1:] if S.likeness(sets[a], sets[b]) >= threshold}
    pairs, members = S.near_pairs(prints, threshold)
    assert {(r["rep_a"], r["rep_b"]) for r in pairs.collect()} == want
    assert {(r["doc_id"], r["rep"]) for r in members.collect()} >= {(r["doc_id"], rep[r["fingerprint"]]) for r in rows}


def test_a_frequent_signature_is_joined_with_salts(spark, capsys):
    own = np.arange(1, 1301, dtype="<u4")  # each set holds the frequent signature and one of its own
    rows = [(i, 2, base64.b64encode(np.array([7_000_000, x], "<u4").tobytes()).decode()) for i, x in enumerate(own)]
    pairs, _ = S.near_pairs(spark.createDataFrame(rows, "doc_id long, n_signatures long, fingerprint string"), 0.3)
    pairs.explain()
    assert "salt" in capsys.readouterr().out
    assert pairs.count() == 1300 * 1299 // 2


def test_a_word_more_changes_little_at_any_length():
    """The rule is the same at every length: a text and itself with a word appended share nearly all signatures."""
    worst = {}
    for seed in range(20):
        for n in range(10, 101):
            words = [f"w{seed}x{i}" for i in range(n + 1)]
            if seed % 2:
                words[3::7] = ["the"] * len(words[3::7])
            a, b = S.signature_sets(pa.array([" ".join(words[:-1]), " ".join(words)]))
            got = S.likeness(a, b)
            assert len(a) and set(a.tolist()) <= set(b.tolist())
            worst[n] = min(worst.get(n, 1.0), got)
    assert min(worst.values()) >= 0.3 and min(worst[n] for n in range(40, 101)) >= 0.75
    assert np.mean([worst[n] for n in (31, 32, 33)]) > 0.6
