import collections
import hashlib
import string

from tableprep.llm.line_dedup import dedup_lines

from .helpers import SPACE

LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def brute(rows):
    held = collections.defaultdict(set)
    for doc, text in rows:
        for line in (text or "").split("\n"):
            if doc is not None:
                held[line.strip(SPACE).translate(LOWER)].add(doc)
    out = []
    for doc, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if not (len(k := x.strip(SPACE).translate(LOWER)) >= 10 and len(held[k]) > 1
                                         and doc is not None and min(held[k]) != doc)]
        out.append((doc, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out, key=str)


def test_equal_to_brute_force(odd_docs, small_docs):
    for docs in (odd_docs, small_docs):
        rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
        got = dedup_lines(docs, with_text=False)
        assert sorted(map(tuple, got.collect()), key=str) == brute(rows)


def test_kept_text_and_empty_table(spark, no_docs):
    df = spark.createDataFrame([(2, "x\nSame long line \ny"), (1, "same long line")], "doc_id long, text string")
    got = {r["doc_id"]: r["kept_text"] for r in dedup_lines(df).collect()}
    assert got == {1: "same long line", 2: "x\ny"}
    assert dedup_lines(no_docs).count() == 0
