import hashlib
import math
import random
import zlib

import pytest
from pyspark.sql import functions as F

from tableprep.llm import trie
from tests.llm.conftest import SMALL

SCHEMA = "conv_id long, turn long, role string, text string"


def brute(rows, rebuilt=True):
    """{(conv_id, depth): the other columns} from plain tuples of turns."""
    convs = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            convs.setdefault(conv, []).append((turn is not None, turn or 0, (role or "").encode(), (text or "").encode()))
    convs = {c: [t[2:] for t in sorted(turns)] for c, turns in convs.items()}
    if rebuilt:
        out = {}
        for c, own in convs.items():
            h, base = zlib.crc32(str(c).encode()) % 9, c - int(math.fmod(c, 5))
            out[c] = own if c == base else convs.get(base, [])[:h] + own[h:]
        convs = out
    members = {}
    for c in sorted(convs):
        for d in range(len(convs[c]) + 1):
            members.setdefault(tuple(convs[c][:d]), []).append(c)
    below = {}
    for path in members:
        for d in range(len(path) + 1):
            below.setdefault(path[:d], []).append(path)
    children = {}
    for path in members:
        if path:
            children[path[:-1]] = children.get(path[:-1], 0) + 1
    out = {}
    for path, own in members.items():
        ends = ",".join(str(c) for c in own if len(convs[c]) == len(path))
        out[own[0], len(path)] = (
            members[path[:-1]][0] if path else None, len(own), children.get(path, 0),
            sum(1 for p in below[path] if p not in children),
            sum((len(members[p]) - 1) * len(p[-1][1]) for p in below[path] if p),
            hashlib.sha256(ends.encode()).hexdigest())
    return out


def found(spark, rows, **options):
    df = rows if hasattr(rows, "columns") else spark.createDataFrame(rows, SCHEMA)
    out = trie.prefix_trie(df, **options).collect()
    got = {(r["conv_id"], r["depth"]): (r["parent_conv_id"], r["n_convs"], r["n_children"], r["n_leaves"],
                                        r["saved_tokens"], r["ends_sha256"]) for r in out}
    assert len(got) == len(out)
    return got


def random_turns(seed, n_convs, longest):
    rng = random.Random(seed)
    rows = []
    for c in range(-7, n_convs):
        if rng.random() < 0.15:
            continue
        common = rng.random() < 0.7
        for t in range(rng.randint(1, longest)):
            word = "x" * (t % 3) if common and rng.random() < 0.97 else f"é{rng.randint(0, 3)}"
            rows.append((c, None if t == 0 and rng.random() < 0.1 else t, rng.choice(["user", None]) if t % 5 == 4 else "user",
                         word or None))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("band", [3, 16])
def test_brute_force(spark, band):
    rows = random_turns(band, 60, 25)
    assert found(spark, rows, band=band) == brute(rows)


def test_conversations_as_they_are(spark):
    rows = random_turns(9, 40, 12)
    assert found(spark, rows, rebuilt=False, band=4) == brute(rows, rebuilt=False)


def test_one_long_conversation_over_all_tasks(spark):
    rows = [(3, t, "user", f"t{t % 7}") for t in range(900)] + [(5, t, "user", f"t{t % 7}") for t in range(450)]
    rows += [(4, t, None, "") for t in range(30)]
    expected = brute(rows)
    assert found(spark, rows) == expected
    assert found(spark, rows, band=5) == expected


def test_many_equal_conversations_stream_their_ids(spark, monkeypatch):
    monkeypatch.setattr(trie, "RUN", 7)
    rows = [(c, t, "user", "same") for c in range(0, 600, 5) for t in range(2)]
    assert found(spark, rows) == brute(rows)


def test_odd_rows(spark):
    rows = [(None, 0, "user", "nobody"), (1, None, None, None), (1, None, None, None), (1, 2, "user", "b"), (1, 2, "user", "a"),
            (2, 0, "user", "x" * 300_000), (0, 0, "user", "x" * 300_000), (0, 1, "", None), (5, 0, "us", "erx"), (7, 0, "user", "x")]
    expected = brute(rows)
    assert found(spark, rows) == expected
    df = spark.createDataFrame(rows, SCHEMA)
    for name in ("depth", "k0", "step", "task", "conv", "n"):
        df = df.withColumn(name, F.lit("clash"))
    assert found(spark, df) == expected
    assert trie.prefix_trie(df.limit(0)).count() == 0


def test_given_table(spark):
    df = spark.read.parquet(f"{SMALL}/conversations.parquet")
    rows = [tuple(r) for r in df.select("conv_id", "turn", "role", "text").collect()]
    assert found(spark, df) == brute(rows)
