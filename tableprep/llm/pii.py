"""Personal data by patterns and bootstrapped contexts (operator 1).

*Base.* Email, IP, card and phone spans by fixed patterns, leftmost and not overlapping within a kind (code points, end
exclusive), each in time linear in the text. Matches that fail their check (parts over 255, Luhn, number of digits) are
dropped, not tried again.

*Secrets.* A quoted value of 8 to 200 characters with a digit, assigned to a name that ends in a secret's word (``token =
"..."``, ``api_key: '...'``), is a span of the kind ``secret``. It is no base span, but a seed like one.

*Bootstrapping.* Base entities and secrets are the seeds of a pattern-instance graph. An instance is an identifier-like token (a
digit or ``@`` in it) with its shape's kind, or a card or phone number written in groups (tokens one space apart that fit
a shape together, the longest first, at most one of them an identifier by itself); a pattern is what stands around it: the two words before, the word before,
or the words on both sides (lower case, ends stripped), and for secret-like tokens their own form (alphabet and length). Spark scores the graph iteratively: a pattern's confidence for a
kind is the confidence of its instances of that kind, weighted by their number, over all identifier-like tokens in that
context, shrunk by ``PRIOR``; an instance's is the chance that one of its patterns is right. After ``ROUNDS`` rounds,
instances that are no base span, whose shape fits the kind, found by a pattern with at least ``SUPPORT`` different seeds
and a confidence of ``ACCEPT`` or more, become spans.

The graph holds one row a (pattern, kind, surface), pre-aggregated; a frequent word is one pattern whose rows are summed by
partial aggregates and joined with salts. Surfaces are hashed, so the graph holds no personal data itself.

Null and empty texts have no span. Repeated ids keep their own rows (spans found in the graph follow the row). Columns
other than id and text are not read; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tableprep.llm.base import salted_lookup, stage

KINDS = ("email", "ip", "card", "phone")
SECRET, NAMES = len(KINDS), (*KINDS, "secret")
ROUNDS, SUPPORT, ACCEPT, PRIOR = 3, 3, 0.8, 1.0

# The base patterns (fixed values), written without nested repetition that could backtrack.
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")


def emails(text: str) -> Iterator[tuple[int, int]]:
    """``[A-Za-z0-9._%+-]+@`` then a domain; the local part reaches back to its first character or the last match."""
    done, at = 0, text.find("@")
    while at >= 0:
        local = text[done:at]
        begin = at - (len(local) - len(local.rstrip(LOCAL)))
        m = DOMAIN.match(text, at + 1) if begin < at else None
        if m:
            yield begin, m.end()
        done = m.end() if m else at + 1
        at = text.find("@", done)


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        v = ord(c) - 48
        if i % 2:
            v = v * 2 - 9 if v > 4 else v * 2
        total += v
    return total % 10 == 0


def base_spans(text: str | None) -> list[tuple[int, int, int]]:
    """(start, end, number of the kind), by start, then kind."""
    if not text:
        return []
    out = [(s, e, 0) for s, e in emails(text)]
    for m in IP.finditer(text):
        parts = [p.lstrip("0") for p in m[0].split(".")]
        if all(len(p) <= 3 and int(p or 0) <= 255 for p in parts):
            out.append((m.start(), m.end(), 1))
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 12:
            digits = m[0].replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), m.end(), 2))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
                out.append((m.start(), m.end(), 3))
    out.sort(key=lambda x: (x[0], x[2]))
    return out


# Words that name a secret (fixed values), at the end of an assigned name.
ASSIGNED = re.compile(r"(?:token|secret|password|passwd|passphrase|pwd|api[_-]?key|access[_-]?key|private[_-]?key|auth[_-]?key)"
                      r"[\"']?[ \t]{0,3}(?::=|=>|=|:)[ \t]{0,3}([\"'])([!-~]{8,200}?)\1", re.IGNORECASE | re.ASCII)


def secrets(text: str | None, spans: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Assigned secrets outside the base spans."""
    out = []
    for m in ASSIGNED.finditer(text or ""):
        s, e = m.span(2)
        if any(c.isdigit() for c in m[2]) and not any(a < e and s < b for a, b, _ in spans):
            out.append((s, e, SECRET))
    return out


def listed(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{NAMES[k]}:{s}:{e}" for s, e, k in spans)


# Shapes of tokens that are no base span (fixed values): at most one kind a token.
SHAPES = (
    (0, re.compile(r"[^\s@]+@[^\s@]+|[^\s@]+(?:\(at\)|\[at\])[^\s@]+", re.ASCII | re.IGNORECASE)),
    (1, re.compile(r"[0-9]{1,3}(?:[.:][0-9]{1,3}){3,5}|[0-9a-f]{1,4}(?:::?[0-9a-f]{1,4}){3,7}", re.ASCII | re.IGNORECASE)),
    (2, re.compile(r"[0-9]{4}(?:[ .-]?[0-9]{4}){2,3}[0-9]{0,3}", re.ASCII)),
    (3, re.compile(r"\(?[0-9]{2,5}\)?(?:[ ./-]?[0-9]{2,5}){2,4}", re.ASCII)),
    (4, re.compile(r"(?=(?:\D*\d){4})(?=(?:[^A-Za-z]*[A-Za-z]){4})[A-Za-z0-9_+/=-]{24,80}", re.ASCII)),
)
EDGE = ".,;:!?\"'()[]{}<>|*&%$#=-"
MARK = re.compile(r"[0-9@]\S*", re.ASCII)
SPACES = " \t\n\r\x0b\x0c"
MOST_GROUPS, MOST_DIGITS = 5, {2: 19, 3: 15}  # what the shapes hold; digits as in the base patterns


def _tokens(text: str) -> Iterator[tuple[int, int]]:
    """Runs without ASCII white space that hold a digit or @."""
    done = 0
    for m in MARK.finditer(text):
        yield max(text.rfind(c, done, m.start()) for c in SPACES) + 1 or done, m.end()
        done = m.end()


def _shape(token: str) -> int:
    if len(token) > 80:  # longer than the numeric shapes get
        return 0 if token.count("@") < 2 and SHAPES[0][1].fullmatch(token) else -1
    for kind, pattern in SHAPES:
        if pattern.fullmatch(token):
            return kind
    return -1


def _group(text: str, run: list[tuple[int, int, int, int]]) -> tuple[int, int, int, int] | None:
    """(tokens used, start, end, kind) of the longest number that the first two or more tokens of a run write in groups.
    A run holds (raw start, raw end, start, end) of tokens one space apart."""
    lone = 0
    ends = []
    for _, _, s, e in run[:MOST_GROUPS]:
        lone += _shape(text[s:e]) >= 0
        if lone > 1 or e - s > 80:
            break
        ends.append(e)
    for n in range(len(ends), 1, -1):
        for s in {run[0][2], run[0][0]}:  # an opening bracket belongs to it where the shape says so
            for kind in (2, 3):
                if SHAPES[kind][1].fullmatch(text, s, ends[n - 1]) and (
                        sum(c.isdigit() for c in text[s:ends[n - 1]]) <= MOST_DIGITS[kind]):
                    return n, s, ends[n - 1], kind
    return None


def _context(text: str, start: int, end: int) -> tuple[str, str, str]:
    """The two words before and the word after, lower case, ends stripped."""
    width, before = 80, []
    while True:
        piece = text[max(0, start - width):start]
        before = piece.split()
        if width >= start or len(before) > 2:  # the first word may go on before the piece
            break
        width *= 2
    width = 80
    while True:
        piece = text[end:end + width]
        after = piece.split(maxsplit=1)
        if end + width >= len(text) or len(after) > 1 or (after and piece[-1].isspace()):
            break
        width *= 2
    before = [w.lower() for w in before[-2:]]
    after = [w.lower() for w in after[:1]]
    left = [""] * (2 - len(before)) + [w.strip(EDGE) or w for w in before]
    return left[0], left[1], (after[0].strip(EDGE) or after[0]) if after else ""


def _hash(*parts: str) -> int:
    return int.from_bytes(hashlib.blake2b("\x1f".join(parts).encode("utf-8", "surrogatepass"), digest_size=8).digest(),
                          "big", signed=True)


def _form(token: str) -> str:
    """Alphabet and length of a secret-like token."""
    kinds = ("0-9a-f", re.fullmatch("[0-9a-f]+", token)), ("0-9A-F", re.fullmatch("[0-9A-F]+", token)), (
        "0-9A-Z", re.fullmatch("[0-9A-Z]+", token))
    return f"{next((name for name, m in kinds if m), 'mixed')}:{len(token)}"


def instances(text: str | None, spans: list[tuple[int, int, int]]) -> list[tuple[int, int, int, bool, int, list[int]]]:
    """(start, end, kind or -1, is a seed, surface, patterns) of each seed span and each other identifier-like token."""
    if not text:
        return []
    spans = sorted(spans)
    found = [(s, e, k, True) for s, e, k in spans]
    starts = [s for s, _, _ in spans]
    reach = []
    for s, e, _ in spans:
        reach.append(max(e, reach[-1]) if reach else e)
    tokens = []
    for start, end in _tokens(text):
        raw = text[start:end]
        s = start + len(raw) - len(raw.lstrip(EDGE))
        e = start + len(raw.rstrip(EDGE))
        if e <= s:
            continue
        i = bisect_left(starts, e) - 1
        if i >= 0 and reach[i] > s:
            continue  # a part of it is a base span
        tokens.append((start, end, s, e))
    at = 0
    while at < len(tokens):
        run = tokens[at:at + 1]
        while len(run) < MOST_GROUPS and at + len(run) < len(tokens):
            after = tokens[at + len(run)]
            if after[0] != run[-1][1] + 1 or text[run[-1][1]] != " ":
                break
            run.append(after)
        group = _group(text, run) if len(run) > 1 else None
        if group:
            at += group[0]
            found.append((*group[1:], False))
        else:
            s, e = tokens[at][2:]
            at += 1
            found.append((s, e, _shape(text[s:e]), False))
    out = []
    for s, e, k, seed in found:
        two, one, after = _context(text, s, e)
        patterns = [_hash("L2", two, one), _hash("L", one), _hash("LR", one, after)] if one else []
        if k == SECRET:
            patterns.append(_hash("F", _form(text[s:e])))
        out.append((s, e, k, seed, _hash("S", text[s:e].lower()), patterns))
    return out


SCANNED = ("doc_id long, base array<struct<s:long,e:long,k:int>>, "
           "inst array<struct<s:long,e:long,k:int,seed:boolean,surface:long,patterns:array<long>>>")


def scan(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    spans_type = pa.list_(pa.struct([("s", pa.int64()), ("e", pa.int64()), ("k", pa.int32())]))
    inst_type = pa.list_(pa.struct([("s", pa.int64()), ("e", pa.int64()), ("k", pa.int32()), ("seed", pa.bool_()),
                                    ("surface", pa.int64()), ("patterns", pa.list_(pa.int64()))]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            base, inst = [], []
            for text in batch.column(1).to_pylist():
                spans = base_spans(text)
                base.append([{"s": s, "e": e, "k": k} for s, e, k in spans])
                inst.append([{"s": s, "e": e, "k": k, "seed": seed, "surface": surface, "patterns": p}
                             for s, e, k, seed, surface, p in instances(text, spans + secrets(text, spans))])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(base, spans_type), pa.array(inst, inst_type)],
                                             ["doc_id", "base", "inst"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, SCANNED)


def score_graph(graph: DataFrame, rounds: int = ROUNDS) -> tuple[DataFrame, DataFrame]:
    """(patterns: pattern, k, conf, seeds), (instances: surface, k, conf) from edges (pattern, k, surface, seed, n)."""
    totals = stage(graph.groupBy("pattern").agg(F.sum("n").alias("total")))
    own = graph.where("k >= 0")
    score = stage(own.groupBy("surface", "k").agg(F.max(F.col("seed").cast("double")).alias("conf")))
    patterns = None
    for _ in range(rounds):
        weighted = own.join(score, ["surface", "k"]).groupBy("pattern", "k").agg(
            F.sum(F.col("conf") * F.col("n")).alias("good"),
            F.sum(F.col("seed").cast("long")).alias("seeds"))
        patterns = stage(weighted.join(totals, "pattern").select(
            "pattern", "k", (F.col("good") / (F.col("total") + PRIOR)).alias("conf"), "seeds"))
        trusted = patterns.where(F.col("seeds") >= SUPPORT).select("pattern", "k", F.col("conf").alias("p"))
        found = salted_lookup(own, trusted, ["pattern", "k"], F.col("surface")).groupBy("surface", "k").agg(
            (1 - F.exp(F.sum(F.log(1 - F.least(F.col("p"), F.lit(0.999)))))).alias("conf"))
        seeds = own.where("seed").select("surface", "k", F.lit(1.0).alias("conf"))
        score = stage(found.unionByName(seeds).groupBy("surface", "k").agg(F.max("conf").alias("conf")))
    return patterns, score


def find_personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_found (spans beyond the base ones),
    n_secret (of them secrets), n_spans (all)."""
    scanned = stage(scan(docs, id_col, text_col).withColumn("row", F.monotonically_increasing_id()))
    edges = scanned.select("row", F.explode("inst").alias("i")).select(
        "row", "i.s", "i.e", "i.k", "i.seed", "i.surface", F.explode("i.patterns").alias("pattern"))
    graph = stage(edges.groupBy("pattern", "k", "surface").agg(
        F.max("seed").alias("seed"), F.count(F.lit(1)).alias("n")))
    patterns, _ = score_graph(graph)
    good = patterns.where((F.col("conf") >= ACCEPT) & (F.col("seeds") >= SUPPORT)).select("pattern", "k")
    new = salted_lookup(edges.where("k >= 0 and not seed"), good, ["pattern", "k"], F.col("row"), "left_semi")
    named = scanned.select("row", F.explode("inst").alias("i")).where((F.col("i.k") == SECRET) & F.col("i.seed"))
    new = new.select("row", "s", "e", "k").unionByName(named.select("row", "i.s", "i.e", "i.k"))
    found = new.distinct().groupBy("row").agg(F.collect_list(F.struct("s", "e", "k")).alias("found"))

    def digest(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            out = []
            for doc, base, more in zip(pdf["doc_id"], pdf["base"], pdf["found"]):
                spans = [(r["s"], r["e"], r["k"]) for r in base]
                extra = [] if more is None else [(r["s"], r["e"], r["k"]) for r in more]
                count = [sum(k == i for _, _, k in spans) for i in range(4)]
                everything = sorted(spans + extra, key=lambda x: (x[0], x[2]))
                out.append((doc, *count, hashlib.sha256(listed(spans).encode()).hexdigest(), listed(everything), len(extra),
                            sum(k == SECRET for _, _, k in extra), len(everything)))
            yield pd.DataFrame(out, columns=COLUMNS).astype({"doc_id": "Int64"})

    return scanned.select("row", "doc_id", "base").join(found, "row", "left").select(
        "doc_id", "base", "found").mapInPandas(digest, RESULT)


COLUMNS = ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_found", "n_secret", "n_spans"]
RESULT = ("doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, "
          "n_found long, n_secret long, n_spans long")
