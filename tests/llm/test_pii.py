import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from tableprep.llm import pii

PATTERNS = [r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
            r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"]


def plain(text):
    out = []
    for k, p in enumerate(PATTERNS):
        for m in re.finditer(p, text or ""):
            digits = re.sub(r"[^0-9]", "", m[0])
            if (k == 1 and any(int(x) > 255 for x in m[0].split("."))) or (
                    k == 2 and not (12 <= len(digits) <= 19 and pii.luhn(digits))) or (k == 3 and not 9 <= len(digits) <= 15):
                continue
            out.append((m.start(), m.end(), k))
    return sorted(out, key=lambda x: (x[0], x[2]))


@pytest.mark.parametrize("letters", ["ab@.c-_% ", "01.2 -9", "+1 ().-2a", "a1@.+ -()é٣"])
def test_base_spans_equal_the_plain_patterns(letters):
    rng = random.Random(letters)
    for _ in range(5000):
        text = "".join(rng.choice(letters) for _ in range(rng.randint(0, 40)))
        assert pii.base_spans(text) == plain(text)


def test_known_values():
    text = "mail a.b@x.org, ip 10.0.0.255 or 256.1.1.1, card 4111 1111-1111 1111, call +1 (555) 010-9999."
    assert pii.listed(pii.base_spans(text)) == "email:5:14,ip:19:29,card:49:68,phone:75:92"


def test_query_over_small_table(spark, small_docs):
    got = {r["doc_id"]: r for r in pii.find_personal_data(small_docs).collect()}
    texts = {r["doc_id"]: r["text"] for r in small_docs.collect()}
    assert got.keys() == texts.keys()
    for doc, r in got.items():
        spans = plain(texts[doc])
        assert r["base_sha256"] == hashlib.sha256(pii.listed(spans).encode()).hexdigest()
        assert (r["n_email"], r["n_ip"], r["n_card"], r["n_phone"]) == tuple(
            sum(k == i for _, _, k in spans) for i in range(4))
        assert set(pii.listed(spans).split(",")) <= set(r["spans"].split(","))


def test_contexts_of_seeds_discover_other_identifiers(spark):
    rows = [(i, f"Please note the phone extension: +1 555 010 00{i:02d} today") for i in range(20)]
    rows += [(100, "Please note the phone extension: 555-010-7788 today"), (101, "lines 555-010-7788 elsewhere"),
             (102, "version 12.5.1 of the tool")]
    got = {r["doc_id"]: r for r in pii.find_personal_data(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[100]["spans"] == "phone:33:45" and got[100]["n_found"] == 1 and got[100]["n_phone"] == 0
    assert got[101]["n_found"] == 0 and got[102]["n_found"] == 0


def test_odd_rows(odd_docs, no_docs):
    got = pii.find_personal_data(odd_docs)
    assert got.count() == odd_docs.count()
    empty = hashlib.sha256(b"").hexdigest()
    assert got.where(F.col("doc_id").isin(4, 5)).select("base_sha256", "spans").distinct().collect() == [(empty, "")]
    assert pii.find_personal_data(no_docs).count() == 0


def test_numbers_in_groups_are_one_instance(spark):
    rows = [(i, f"Please call tel: +49 30 5550 10{i:02d} today") for i in range(20)]
    rows += [(50 + i, f"Paid with card: {n} today") for i, n in enumerate(
        ["4111 1111 1111 1111", "5500 0000 0000 0004", "4012 8888 8888 1881", "6011 1111 1111 1117", "4222 2222 2222 2"])]
    rows += [(100, "Please call tel: 030 1234 5678 today"), (101, "Please call tel: (030) 1234 5678 today"),
             (102, "Paid with card: 1234 5678 9012 3456 today"), (103, "rows 030 1234 5678 elsewhere")]
    got = {r["doc_id"]: r for r in pii.find_personal_data(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[100]["spans"] == "phone:17:30" and got[101]["spans"] == "phone:17:32"
    assert got[102]["spans"] == "card:16:35" and got[102]["n_card"] == 0 and got[103]["n_found"] == 0


def test_groups_end_where_the_shapes_end():
    def found(text):
        return [(text[s:e], k) for s, e, k, *_ in pii.instances(text, pii.base_spans(text))]
    assert found("call 030 1234 5678, room 12") == [("030 1234 5678", 3), ("12", -1)]
    assert found("030  1234 5678 030\n1234 5678") == [("030", -1), ("1234 5678 030", 3), ("1234 5678", 3)]
    assert found("5550107788 5550107789") == [("5550107788", 3), ("5550107789", 3)]
    assert found("12 or 345 pieces") == [("12", -1), ("345", -1)]


def test_long_tokens_and_neighbours_are_whole():
    local = "a" * 100
    assert pii._shape(f"{local}(at)example.org") == 0 and pii._shape("1" * 100) == -1 == pii._shape("a@" * 100)
    word = "x" * 200
    text = f"one {word} 12345 {word}y"
    assert pii._context(text, 205, 210) == ("one", word, word + "y")
    assert pii._context(" " * 300 + "a b " + " " * 300 + "1", 604, 605) == ("a", "b", "")


def test_assigned_secrets_and_tokens_of_their_form(spark):
    rows = [(i, f'config token = "{hashlib.sha1(str(i).encode()).hexdigest()}" end') for i in range(8)]
    other = hashlib.sha1(b"other").hexdigest()
    rows += [(100, f"left over {other} in a line"), (101, 'password = "changeme" api_key: \'k3y-value-9\''),
             (102, "secret = none, token: 12345678 and " + "a1" * 8), (103, f'passwd="x@y.example.org1"'),
             (104, f'token = "{other}')]
    got = {r["doc_id"]: r for r in pii.find_personal_data(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(got[i]["spans"] == "secret:16:56" and got[i]["n_secret"] == 1 for i in range(8))
    assert got[100]["spans"] == "secret:10:50"      # found by the form that the named ones have
    assert got[101]["spans"] == "secret:32:43" and got[102]["spans"] == ""
    assert got[103]["spans"] == "email:8:24" and got[103]["n_spans"] == 1 and got[103]["n_secret"] == 0
    assert got[104]["n_secret"] == 1


def test_secret_seeds_are_linear_in_the_text():
    import time
    t0 = time.time()
    for text in ("token = \"" * 100_000, "token" * 200_000, "token = '" + "a" * 1_000_000, "\"" * 500_000 + "1"):
        pii.secrets(text, [])
        pii.instances(text, [])
    assert time.time() - t0 < 20
