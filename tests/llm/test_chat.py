from tableprep.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string, position int, part int, h0 int"


def _rows(convs):
    return [(c, i, r, t, 1, 2, 3) for c, turns in convs.items() for i, (r, t) in enumerate(turns)]


def brute(rows):
    convs = {}
    for c, turn, role, text in {r[:4] for r in rows if r[0] is not None}:
        convs.setdefault(c, []).append((turn is None, turn or 0, role is not None, role or "", text is not None, text or "",
                                        role, text))
    seqs = {c: tuple((x[-2], x[-1]) for x in sorted(v, key=lambda x: x[:6])) for c, v in convs.items()}
    out = {}
    for c, s in seqs.items():
        longer = any(len(o) > len(s) and o[:len(s)] == s for o in seqs.values())
        same = [d for d, o in seqs.items() if o == s]
        if not longer and c == min(same):
            out[c] = (len(s), len(same), "".join(f"<|{r or 'user'}|>\n{t or ''}<|end|>\n" for r, t in s))
    return out


def _got(df):
    rows = df.collect()
    assert all(r["n_parts"] == 1 and r["part"] == 0 for r in rows)
    return {r["conv_id"]: (r["n_turns"], r["copies"], r["rendered"]) for r in rows}


def test_snapshots_collapse(spark):
    a, b, c = ("user", "hi"), ("assistant", "hello"), ("user", "bye")
    rows = _rows({1: [a], 2: [a, b], 3: [a, b, c], 4: [a, b, c], 5: [a, c], 6: [b], 7: [("user", None)], 8: [(None, "hi")],
                  9: [("user", ""), b]})
    rows += [(None, 0, "user", "hi", 1, 2, 3), (10, None, "user", "late", 1, 2, 3), (10, 0, "user", "x", 1, 2, 3),
             (11, 3, "user", "x", 1, 2, 3), (11, 3, "user", "x", 1, 2, 3), (11, 3, "assistant", "y", 1, 2, 3)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = _got(chat.collapse_and_render(df))
    assert got == brute(rows) and got.keys() == {3, 5, 6, 7, 8, 9, 10, 11} and got[3][1] == 2
    assert chat.collapse_and_render(df.limit(0)).count() == 0


def test_small_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/conversations.parquet")
    rows = [tuple(r) for r in df.select("conv_id", "turn", "role", "text").collect()]
    assert _got(chat.collapse_and_render(df)) == brute(rows)


def test_a_long_conversation_comes_in_parts(spark):
    rows = [(1, i, "user", f"t{i}", 0, 0, 0) for i in range(2500)] + [(2, i, "user", f"t{i}", 0, 0, 0) for i in range(1500)]
    parts = sorted(chat.collapse_and_render(spark.createDataFrame(rows, SCHEMA)).collect(), key=lambda r: r["part"])
    assert [(r["conv_id"], r["part"], r["n_parts"]) for r in parts] == [(1, 0, 3), (1, 1, 3), (1, 2, 3)]
    assert "".join(r["rendered"] for r in parts) == "".join(f"<|user|>\nt{i}<|end|>\n" for i in range(2500))
