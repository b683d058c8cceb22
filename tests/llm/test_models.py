import zlib

import numpy as np

from tableprep.llm import langid, toxicity
from tableprep.llm.chars import letter_stream

CHECK = "/root/testdata/sf0.01"


def test_letter_stream():
    assert "".join(map(chr, letter_stream("Añb, 12C!"))) == " añb c "
    assert not len(letter_stream("12 .")) and not len(letter_stream(None))


def test_rank_order_profiles_by_hand():
    ranker = langid.Ranker({"a": langid.ranked(*langid.gram_counts("aba aba bab")).astype(np.int64).tolist(),
                            "z": langid.ranked(*langid.gram_counts("zyz zyz yzy")).astype(np.int64).tolist()})
    assert ranker("aba aba bab") == ("a", 1.0)
    assert ranker("zy")[0] == "z" and ranker("qqq") == ("a", 0.0)
    assert ranker("123") == ("und", 0.0) == ranker(None)


def test_segments_of_a_long_text_count_the_same(monkeypatch):
    text = "the quick brown fox jumps " * 50 + "x" * 300 + " tail of it"
    whole = langid.gram_counts(text)
    monkeypatch.setattr(langid, "SEGMENT", 100)
    assert [x.tolist() for x in langid.gram_counts(text)] == [x.tolist() for x in whole]


def test_language_on_held_out_rows(spark):
    docs = spark.read.parquet(f"{CHECK}/documents.parquet")
    langs = {r["doc_id"]: r["lang"] for r in docs.select("doc_id", "lang").collect()}
    got = langid.identify(docs).collect()
    assert len(got) == len(langs)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in got)
    held = [r["lang_pred"] == langs[r["doc_id"]] for r in got if r["held_out"]]
    assert np.mean(held) > 0.98 and all(0 <= r["score"] <= 1 for r in got)


def test_language_of_odd_rows(odd_docs, no_docs):
    got = langid.identify(odd_docs).collect()
    assert len(got) == odd_docs.count()
    assert {r["lang_pred"] for r in got if r["doc_id"] in (4, 5, 6)} == {"und"}
    assert langid.identify(no_docs).count() == 0


def test_kneser_ney_ratio_by_hand(spark):
    rows = [("ab ab", 1), ("ac", 0), ("ac", 0)]
    seen, _ = toxicity.learn_ratios(spark.createDataFrame(rows, "text string, toxic int"))
    got = {r["h"]: r["ratio"] for r in seen.collect()}
    h = {("ab"[:i + 1]): int(x) for i, x in enumerate(toxicity.beginnings(letter_stream("ab"))[0].view(np.int64))}
    d = toxicity.DISCOUNT
    low = (1 - d) / 2 + d * 2 / 2 / 50  # b and c each follow "space a" in one beginning
    toxic, ordinary = (2 - d) / 2 + d / 2 * low, d / 2 * low
    assert abs(got[h["ab"]] - np.log(toxic / ordinary)) < 1e-5
    assert abs(got[h["a"]]) < 1e-6


def test_toxicity_on_held_out_rows(spark):
    docs, labels = (spark.read.parquet(f"{CHECK}/{t}.parquet") for t in ("documents", "labels"))
    truth = {r["doc_id"]: r["toxic"] for r in labels.collect()}
    got = toxicity.score(docs, labels).collect()
    assert len(got) == docs.count()
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in got)
    held = [(r["score"], truth[r["doc_id"]]) for r in got if r["held_out"] and r["doc_id"] in truth]
    bad, good = [s for s, t in held if t], [s for s, t in held if not t]
    assert np.mean([(x > y) + (x == y) / 2 for x in bad for y in good]) > 0.8


def test_toxicity_of_odd_rows(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(1, 1, 5), (1, 0, 5), (2, 0, 5), (3, None, 5), (None, 1, 5), (8, 7, 5)],
                                   "doc_id long, toxic int, text int")
    got = toxicity.score(odd_docs, labels).collect()
    assert len(got) == odd_docs.count() and len({r["score"] for r in got if r["doc_id"] in (4, 5, 6)}) == 1
    assert toxicity.score(no_docs, labels).count() == 0
    assert toxicity.score(odd_docs, labels.limit(0)).count() == odd_docs.count()


def _by_hand(word, seen, unseen):
    """A word's ratio in units, from whole tables."""
    h, parent = (x.view(np.int64).tolist() for x in toxicity.all_letters(letter_stream(word))[:2])
    return sum(round(seen.get(a, unseen.get(b, 0.0)) * toxicity.UNIT) for a, b in zip(h, parent))


def test_no_beginning_displaces_another(spark):
    rng = np.random.default_rng(5)
    words = sorted({"".join(rng.choice(list("abcdefgh"), rng.integers(3, 9))) for _ in range(6000)})
    rows = [(" ".join(words[i::40]), int(i % 4 == 0)) for i in range(40)]
    seen, unseen = toxicity.learn_ratios(spark.createDataFrame(rows, "text string, toxic int"))
    tables = [{r["h"]: r["ratio"] for r in x.collect()} for x in (seen, unseen)]
    assert len({h % (1 << 22) for h in tables[0]}) < len(tables[0])  # some share a place of 22 bits
    texts = words + ["abcx", "xyz", "hgfedcbah", words[0]]
    got = toxicity.rate_words(spark.createDataFrame([(t,) for t in texts], "text string"), seen, unseen).collect()
    rated = {r["w"]: (r["n"], r["ratio"]) for r in got}
    assert len(rated) == len(set(texts))
    for t in set(texts):
        n, ratio = rated[int(toxicity.words_of(letter_stream(t))[0].view(np.int64)[0])]
        assert n == texts.count(t) and abs(ratio - _by_hand(t, *tables)) <= 1


def test_joined_words_count_like_sent_ones(spark, odd_docs, monkeypatch):
    labels = spark.createDataFrame([(i, i % 2) for i in range(-3, 12)], "doc_id long, toxic int")
    want = sorted(map(tuple, toxicity.score(odd_docs, labels).collect()), key=str)
    for head in (0, 5):
        monkeypatch.setattr(toxicity, "HEAD", head)
        assert sorted(map(tuple, toxicity.score(odd_docs, labels).collect()), key=str) == want


def test_letters_after_the_ninth_and_ends_count(spark):
    plain = ["wonderland garden", "underground station", "gardening glove", "zorkelian garden", "zorkelia station"] * 5
    rows = [("you zorkel", 1)] * 6 + [(t, 0) for t in plain]
    tables = toxicity.learn_ratios(spark.createDataFrame(rows, "text string, toxic int"))
    texts = ["wonderland", "wonderlandzorkel", "zorkel", "zorkelian", "zorkeliano"]
    got = toxicity.rate_words(spark.createDataFrame([(t,) for t in texts], "text string"), *tables).collect()
    names = {int(toxicity.words_of(letter_stream(t))[0].view(np.int64)[0]): t for t in texts}
    r = {names[x["w"]]: x["ratio"] / toxicity.UNIT for x in got}
    assert r["wonderlandzorkel"] > r["wonderland"] + 2  # was equal: only nine letters counted
    assert r["zorkel"] > r["zorkelian"] + 2
    h = [toxicity.all_letters(letter_stream(t))[0].tolist() for t in texts]
    assert [len(x) for x in h] == [len(t) + 1 for t in texts]  # each letter and the end, once


def test_languages_equal_brute_force(spark, small_docs):
    """Profiles and distances counted with plain dictionaries give every prediction and score."""
    import collections
    import re
    import zlib

    def grams(text):
        out = collections.Counter()
        for word in re.findall(r"[^\W\d_]+", text or ""):
            padded = f" {word.lower()} "
            out.update(padded[1:-1])
            out.update(padded[i:i + n] for n in (2, 3) for i in range(len(padded) - n + 1))
        return out

    def number(gram):
        value = 0
        for c in gram:
            value = value << 21 | ord(c)
        return value

    def first(counts):
        return [g for g, _ in sorted(counts.items(), key=lambda x: (-x[1], number(x[0])))[:langid.PROFILE]]

    rows = small_docs.select("doc_id", "text", "lang").collect()
    totals = collections.defaultdict(collections.Counter)
    for r in rows:
        if zlib.crc32(str(r["doc_id"]).encode()) % 5 and r["lang"] is not None:
            totals[r["lang"]].update(grams(r["text"]))
    profiles = {lang: {g: i for i, g in enumerate(first(c))} for lang, c in sorted(totals.items())}
    got = {r["doc_id"]: (r["lang_pred"], round(r["score"], 12)) for r in langid.identify(small_docs).collect()}
    for r in rows:
        own = first(grams(r["text"]))
        distances = {lang: sum(min(abs(p[g] - i), langid.PROFILE) if g in p else langid.PROFILE for i, g in enumerate(own))
                     for lang, p in profiles.items()}
        best = min(distances, key=distances.get) if own else langid.UNKNOWN
        score = 1 - distances[best] / (langid.PROFILE * len(own)) if own else 0.0
        assert got[r["doc_id"]] == (best, round(score, 12))
