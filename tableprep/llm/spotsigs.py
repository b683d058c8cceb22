"""Document fingerprints by spot signatures (operator 8).

A spot is an occurrence of a very common word (an anchor); its signature is the anchor with the next ``CHAIN`` content
words (words that are no anchors). A text's fingerprint is the set of its signatures, written as base64 of the sorted
32-bit signature hashes, so equal texts (up to letter case and white space) have equal fingerprints. Words are those of
``base.words``, without ASCII punctuation at their ends. So that texts poor in common words have spots too (tables,
other languages), words whose hash is a multiple of ``SPARE`` are spots as well, and so is a text's first word. The rule
is the same at every length. A chain that the end of the text cuts gives no signature, so that a word more at the end adds
signatures but changes none; only the first word's chain counts even if cut, so no text with a word has an empty
fingerprint. Null and blank texts have the empty fingerprint.

Likeness is the Jaccard index of two fingerprints: 1 for two empty ones, 0 for an empty and another.
``near_pairs`` finds all like pairs: fingerprints are partitioned by set length so that a pair that can reach the
threshold meets in one partition, and within it only signatures of a set's pruned prefix (its rarest ones) are joined.

``edited_fingerprints`` compares a text with its edited form, in which the last third is replaced by the beginning of
the next document in descending id order (after the last: the first). The documents are range-partitioned by id once;
each task streams over its sorted rows, and the last row of each partition meets the first row of the next one in a
table of two rows a partition. Null ids come last; rows that repeat an id follow each other in the order of their texts;
a table of one row is its own next; an empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tableprep.llm.base import batch_word_hashes, mix, odd_constants, part_count, salted_lookup, stage
from tableprep.llm.token_blocks import _small_batches

# Anchors: very common words of four languages (fixed values).
ANCHORS = """
the of and to a in is that it for on with as was be by this are or from at an not
der die und das den von zu mit ist des dem im nicht ein eine auf für sich auch es
de la le et les des en un une du que est pour dans par sur au pas qui il
el los las y del se por con una su al lo no si como más para ha son o
""".split()
CHAIN = 2
_MULT = odd_constants(CHAIN + 1, "spot")
_ANCHOR_SET = np.unique(batch_word_hashes(pa.array([" ".join(ANCHORS)]))[0])
SPARE = 4
PUNCTUATION = r"[!-/:-@\[-`{-~]+([\t-\r ]|$)"


def signature_sets(texts: pa.Array) -> list[np.ndarray]:
    """Sorted distinct 32-bit signatures of each text."""
    import pyarrow.compute as pc
    clean = pc.replace_substring_regex(pc.fill_null(texts, ""), PUNCTUATION, r"\1")
    h, bounds = batch_word_hashes(clean)
    common = np.isin(h, _ANCHOR_SET)
    sizes = np.diff(bounds)
    doc_of = np.repeat(np.arange(len(texts)), sizes)
    first = np.zeros(len(h), bool)
    first[bounds[:-1][sizes > 0]] = True
    spots = np.flatnonzero(common | first | (h % np.uint64(SPARE) == 0))
    content = np.flatnonzero(~common)
    at = np.searchsorted(content, spots, "right")
    total, whole = h[spots] * _MULT[0], np.full(len(spots), bool(len(content)))
    for k in range(CHAIN if len(content) else 0):
        nxt = content[np.minimum(at + k, len(content) - 1)]
        inside = (at + k < len(content)) & (doc_of[nxt] == doc_of[spots])
        total += np.where(inside, h[nxt], np.uint64(0)) * _MULT[k + 1]
        whole &= inside
    whole |= first[spots]
    spots, total = spots[whole], total[whole]
    sigs, owner = (mix(total) >> np.uint64(32)).astype(np.uint32), doc_of[spots]
    keyed = np.unique((owner.astype(np.uint64) << np.uint64(32)) | sigs.astype(np.uint64))
    cut = np.searchsorted(keyed, np.arange(len(texts) + 1, dtype=np.uint64) << np.uint64(32))
    low = keyed.astype(np.uint32)
    return [low[a:b] for a, b in zip(cut[:-1], cut[1:])]


def fingerprint(signatures: np.ndarray) -> str:
    return base64.b64encode(signatures.astype("<u4").tobytes()).decode()


def likeness(u: np.ndarray, v: np.ndarray, floor: float = 0.0) -> float:
    """Jaccard index; 0 at once where the lengths alone keep it below ``floor``."""
    if not len(u) and not len(v):
        return 1.0
    if min(len(u), len(v)) < floor * max(len(u), len(v)) or not len(u) or not len(v):
        return 0.0
    union = len(np.unique(np.concatenate((u, v))))
    return (len(u) + len(v) - union) / union


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: doc_id, n_signatures, fingerprint."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j in _small_batches(batch.column(1)):
                sets = signature_sets(batch.column(1).slice(i, j - i))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(i, j - i), pa.array([len(s) for s in sets], pa.int64()),
                     pa.array([fingerprint(s) for s in sets])], ["doc_id", "n_signatures", "fingerprint"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_signatures long, fingerprint string")


def near_pairs(prints: DataFrame, threshold: float = 0.8) -> tuple[DataFrame, DataFrame]:
    """(pairs between class representatives, membership) of fingerprints with a Jaccard index of ``threshold`` or more.

    Equal fingerprints form a class, named by its smallest doc_id (membership: doc_id, rep). Class sets of length n go
    to partition floor(log n / -log threshold) and the next one up; a like pair's lengths differ by at most one
    partition, so it meets in one of them. Signatures are ordered by how many sets hold them; two sets at the threshold
    share one among their first ``n - ceil(threshold n) + 1``. Pairs are checked on the whole sets.
    """
    classes = stage(prints.where("n_signatures > 0 and doc_id is not null").groupBy("fingerprint").agg(
        F.min("doc_id").alias("rep"), F.max("n_signatures").alias("n")))

    def explode(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            sets = [np.frombuffer(base64.b64decode(x), "<u4") for x in pdf["fingerprint"]]
            sizes = [len(s) for s in sets]
            yield pd.DataFrame({"rep": np.repeat(pdf["rep"].to_numpy(), sizes), "n": np.repeat(pdf["n"].to_numpy(), sizes),
                                "sig": np.concatenate(sets).astype(np.int64) if sets else []})

    single = stage(classes.mapInPandas(explode, "rep long, n long, sig long"))
    counts = single.groupBy("sig").agg(F.count(F.lit(1)).alias("held"))
    ranked = salted_lookup(single, stage(counts.where("held > 1")), ["sig"], F.col("rep"), "left")
    order = Window.partitionBy("rep").orderBy(F.coalesce("held", F.lit(1)), "sig")
    prefix = (F.col("n") - F.ceil(F.lit(threshold) * F.col("n") - 1e-9) + 1)
    kept = ranked.withColumn("place", F.row_number().over(order)).where(F.col("place") <= prefix).where("held > 1")
    part = F.floor(F.log(F.col("n").cast("double")) / F.lit(-np.log(threshold)) + 1e-9).cast("int")
    rows = stage(kept.select("rep", "n", "sig", F.explode(F.array(part, part + 1)).alias("part")))
    a = rows.withColumnsRenamed({"rep": "rep_a", "n": "n_a"})
    b = rows.withColumnsRenamed({"rep": "rep_b", "n": "n_b"})
    met = salted_lookup(a, b, ["sig", "part"], F.col("rep_a")).where(
        (F.col("n_a") * threshold <= F.col("n_b")) & (F.col("n_b") * threshold <= F.col("n_a"))
        & (F.col("rep_a") < F.col("rep_b"))).select("rep_a", "rep_b").distinct()
    side = classes.select("rep", "fingerprint")
    full = met.join(side.toDF("rep_a", "f_a"), "rep_a").join(side.toDF("rep_b", "f_b"), "rep_b")

    def check(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            got = [likeness(np.frombuffer(base64.b64decode(x), "<u4"), np.frombuffer(base64.b64decode(y), "<u4"), threshold)
                   for x, y in zip(pdf["f_a"], pdf["f_b"])]
            out = pdf[["rep_a", "rep_b"]].assign(likeness=np.array(got, float))
            yield out[out["likeness"] >= threshold - 1e-12]

    pairs = full.mapInPandas(check, "rep_a long, rep_b long, likeness double")
    members = salted_lookup(prints.select("doc_id", "fingerprint"), side, ["fingerprint"], F.col("doc_id")).select(
        "doc_id", "rep")
    return pairs, members


RESULT = ("doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
          "near_edited double, near_next double")


def _compare(ids: list, texts: list[str]) -> pa.RecordBatch:
    """Results for all texts but the last, each with its follower in the list."""
    edited, sizes = [], []
    for text, nxt in zip(texts[:-1], texts[1:]):
        k = len(text) // 3
        edited.append(text[:len(text) - k] + nxt[:k])
        sizes.append(len(text))
    own = signature_sets(pa.array(texts, pa.large_string()))
    new = signature_sets(pa.array(edited, pa.large_string()))
    return pa.RecordBatch.from_arrays([
        pa.array(ids[:len(edited)], pa.int64()), pa.array(sizes, pa.int64()),
        pa.array([hashlib.sha256(x.encode("utf-8", "surrogatepass")).hexdigest() for x in edited]),
        pa.array([fingerprint(x) for x in own[:-1]]), pa.array([fingerprint(x) for x in new]),
        pa.array([likeness(x, y) for x, y in zip(own, new)]),
        pa.array([likeness(x, y) for x, y in zip(own, own[1:])])],
        names=[c.split()[0] for c in RESULT.split(", ")])


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Compress the texts before they move."""
    pack = zstandard.ZstdCompressor(level=1)
    for batch in batches:
        packed = [pack.compress((x or "").encode("utf-8", "surrogatepass")) for x in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(packed, pa.binary())], ["doc_id", "packed"])


def _unpack(packed: bytes) -> str:
    return zstandard.ZstdDecompressor().decompress(packed).decode("utf-8", "surrogatepass")


def edited_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: RESULT."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    order = F.col("doc_id").desc_nulls_last()
    ranged = (rows.mapInArrow(_pack, "doc_id long, packed binary").repartitionByRange(part_count(docs), order)
              .sortWithinPartitions(order, "packed"))

    def inner(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, texts, chars = [], [], 0
        for batch in batches:
            for doc, packed in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids.append(doc)
                texts.append(_unpack(packed))
                chars += len(texts[-1])
                if chars > 4_000_000 and len(texts) > 1:
                    yield _compare(ids, texts)
                    ids, texts = ids[-1:], texts[-1:]
                    chars = len(texts[0])
        if len(texts) > 1:
            yield _compare(ids, texts)

    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = last = None
        for batch in batches:
            if batch.num_rows:
                first = first or batch.slice(0, 1).to_pylist()[0]
                last = batch.slice(batch.num_rows - 1, 1)
        if first:
            last = last.to_pylist()[0]
            yield pa.RecordBatch.from_pylist([{"part": TaskContext.get().partitionId(), "first": first["packed"],
                                              "doc_id": last["doc_id"], "last": last["packed"]}],
                                             schema=pa.schema([("part", pa.int64()), ("first", pa.binary()),
                                                               ("doc_id", pa.int64()), ("last", pa.binary())]))

    edges = ranged.mapInArrow(ends, "part long, first binary, doc_id long, last binary")
    by_part = Window.orderBy("part")  # one row a partition
    edges = edges.withColumn("nxt", F.coalesce(
        F.lead("first").over(by_part),
        F.first("first").over(by_part.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))))

    def borders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                yield _compare([r["doc_id"]], [_unpack(r["last"]), _unpack(r["nxt"])])

    return ranged.mapInArrow(inner, RESULT).unionByName(edges.mapInArrow(borders, RESULT))
