import collections
import random
import re

import pytest
from pyspark.sql import functions as F

from tableprep.llm import divergence
from tests.llm.conftest import SMALL

TERM = re.compile(r"[^\x00-\x40\x5b-\x60\x7b-\x7f]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, min_docs, top=50):
    held, counts = collections.defaultdict(collections.Counter), collections.defaultdict(collections.Counter)
    for lang, source, text in rows:
        lang, source = lang or "", source or ""
        terms = [t.translate(LOWER) for t in TERM.findall(text or "")]
        held[lang].update(set(terms))
        counts[lang, source].update(terms)
    out = set()
    for lang in held.keys() | {k[0] for k in counts}:
        kept = [t for t, n in held[lang].items() if n >= min_docs]
        sources = [s for x, s in counts if x == lang]

        def share(count):
            n = sum(count[t] for t in kept)
            return {t: 1 + 1_000_000_000 * (count[t] + 5) // (n + 5 * len(kept)) for t in kept}

        p = {s: share(counts[lang, s]) for s in sources}
        q = share(sum((counts[lang, s] for s in sources), collections.Counter()))
        for s in sources:
            pair = [(-sum(abs(p[s][t] - p[o][t]) for t in kept), o.encode()) for o in sources if o != s]
            term = [(q[t] - p[s][t], t.encode()) for t in kept if counts[lang, s][t] and p[s][t] > q[t]]
            for part, items in (("pair", sorted(pair)), ("term", sorted(term)[:top])):
                out |= {(lang, s, part, item.decode(), -v, i + 1) for i, (v, item) in enumerate(items)}
    return out


def found(df, **options):
    rows = [tuple(r) for r in divergence.source_divergences(df, **options).collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def plain(df):
    return [tuple(r) for r in df.select("lang", "source", "text").collect()]


def test_given_table(small_docs):
    assert found(small_docs, min_docs=5) == brute(plain(small_docs), 5)


def test_contract_parameters(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    assert found(docs) == brute(plain(docs), 30)


@pytest.mark.parametrize("small", [False, True])
def test_spills_blocks_and_tiles(small_docs, monkeypatch, small):
    if small:
        for name, value in {"PIECE": 50, "FOLD": 500, "SPILL": 200, "BLOCK": 7, "TILE": 3, "TILES": 4, "KEEP": 20}.items():
            monkeypatch.setattr(divergence, name, value)
    rows = plain(small_docs.where("doc_id < 80"))
    batches = _batches(rows)
    stripes = [b for b in divergence.fold_documents(batches)]
    merged = collections.defaultdict(collections.Counter)
    for b in stripes:
        for lang, term, held, sources, counts in zip(*[c.to_pylist() for c in b.columns]):
            merged[lang, term].update(dict(zip(sources, counts)))
            merged[lang, term][None] += held
    expected = collections.defaultdict(collections.Counter)
    for lang, source, text in rows:
        terms = [t.translate(LOWER).encode() for t in TERM.findall(text or "")]
        for t in [*terms, b""]:
            expected[lang, t][source] += 1
        for t in {*terms, b""}:
            expected[lang, t][None] += 1
    assert merged == expected
    if small:
        assert len(stripes) > 3


def _batches(rows):
    import pyarrow as pa
    for i in range(0, len(rows), 13):
        lang, source, text = zip(*rows[i:i + 13])
        yield pa.RecordBatch.from_arrays([pa.array([x or "" for x in lang]), pa.array([x or "" for x in source]),
                                          pa.array([(x or "").encode() for x in text], pa.binary())], ["a", "b", "c"])


def test_merge_over_batch_borders(small_docs, monkeypatch):
    """Stripes of one term in many small sorted batches give the same blocks as one batch."""
    import pyarrow as pa
    rows = plain(small_docs)
    stripes = sorted((r for b in divergence.fold_documents(_batches(rows)) for r in b.to_pylist()),
                     key=lambda r: (r["lang"], r["term"]))
    doubled = [r for r in stripes for _ in range(3)]
    random.Random(1).shuffle(doubled)
    doubled.sort(key=lambda r: (r["lang"], r["term"]))
    schema = pa.schema([("lang", pa.string()), ("term", pa.binary()), ("held", pa.int64()),
                        ("sources", pa.list_(pa.string())), ("counts", pa.list_(pa.int64()))])

    def blocks(size):
        out = {}
        cut = (pa.RecordBatch.from_pylist(doubled[i:i + size], schema) for i in range(0, len(doubled), size))
        for b in divergence.merge_stripes(9)(cut):
            for r in b.to_pylist():
                i = 0
                for term, n in zip(r["terms"], r["sizes"]):
                    assert (r["lang"], term) not in out
                    out[r["lang"], term] = {r["names"][a]: c for a, c in zip(r["at"][i:i + n], r["counts"][i:i + n])}
                    i += n
        return out

    assert blocks(1) == blocks(5) == blocks(10 ** 6)
    assert len(blocks(10 ** 6)) > 50


def test_shares_are_exact():
    import numpy as np
    rng = random.Random(2)
    for _ in range(500):
        total = rng.randint(5, 9 * 10 ** 15)
        count = rng.randint(0, total - 5)
        assert divergence.shares(np.array([count]), total)[0] == 1 + 10 ** 9 * (count + 5) // total


def test_odd_rows(spark, odd_docs, no_docs):
    assert found(odd_docs, min_docs=1) == brute(plain(odd_docs), 1)
    assert found(odd_docs, min_docs=2) == brute(plain(odd_docs), 2)
    assert found(no_docs) == set()
    clash = odd_docs.select("*", *[F.lit("x").alias(c) for c in ("term", "held", "sources", "value", "rank", "v", "groups")])
    assert found(clash, min_docs=3) == brute(plain(odd_docs), 3)


def test_many_sources(spark, monkeypatch):
    rows = [("en", f"s{i % 11}", "tie Tie tie" if i % 2 else f"tie w{'abc'[i % 3]}") for i in range(60)]
    rows += [("de", None, None), ("de", "only", ""), (None, "s1", "é É 1é")]
    df = spark.createDataFrame(rows, "lang string, source string, text string")
    assert found(df, min_docs=4) == brute(rows, 4)
