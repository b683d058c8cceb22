"""Terms of a corpus in Arrow batches: frequent terms from bounded summaries, and sparse weights a document.

**Frequent terms** (the vocabulary). Counting every distinct pair of words means shuffling nearly the whole corpus. Here
each task keeps a frequent-items summary of at most ``counters`` terms: when the table grows over that, the count of the
first term that no longer fits is taken off all counts and added to the task's ``off``. A summary's counts are lower
bounds, and no count is too low by more than ``off``, whether the term is in the summary or not. Summaries add up: with
M the sum of all ``off``, every term's true count lies between its summed count and that plus M. Hence, with theta the
k-th largest lower bound, every term of the top k has an upper bound of theta or more, and if M < theta none of them is
missing from the summaries. Only these candidates are counted exactly in a second pass. Where the bounds leave more than
``SPARE * k`` candidates or M reaches theta, the summaries are made anew four times as large; a summary that never
overflows has M = 0 and is an exact count, so the rounds end. The shuffle holds summaries and candidates, whatever the
corpus.

**Weights.** A document is one row: its terms become vocabulary slots, counted and normalised inside the row, so weights
need no shuffle at all. Vectors are built from their sparse parts (indices, values), never densified.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tableprep.session import cut_lineage, ship_package

COUNTERS, SPARE, GROWTH = 50_000, 16, 4
SLICE = 500_000  # tokens handled at once


def document_terms(tokens: pa.ListArray, ngrams: int) -> tuple[pa.Array, np.ndarray]:
    """All terms (tokens, then adjacent pairs joined by a space) of a list array and the row of each."""
    flat = tokens.flatten()
    rows = np.repeat(np.arange(len(tokens)), pc.fill_null(pc.list_value_length(tokens), 0).to_numpy(zero_copy_only=False))
    if ngrams < 2 or len(flat) < 2:
        return flat, rows
    same = rows[1:] == rows[:-1]
    keep = pa.array(same)
    pairs = pc.binary_join_element_wise(flat[:-1].filter(keep), flat[1:].filter(keep), " ")
    return pa.concat_arrays([flat, pairs]), np.concatenate((rows, rows[1:][same]))


def slices(batch: pa.RecordBatch, column: int = 0) -> Iterator[pa.RecordBatch]:
    """Runs of whole rows with at most about SLICE tokens (a longer row alone)."""
    ends = np.cumsum(pc.fill_null(pc.list_value_length(batch.column(column)), 0).to_numpy(zero_copy_only=False))
    start, used = 0, 0
    while start < batch.num_rows:
        stop = max(start + 1, int(np.searchsorted(ends, used + SLICE, "right")))
        yield batch.slice(start, stop - start)
        start, used = stop, int(ends[stop - 1])


class Summary:
    """At most ``counters`` terms with lower bounds of their counts; ``off`` bounds what any count lacks."""

    def __init__(self, counters: int):
        self.counters, self.off, self.table = counters, 0, None

    def add(self, terms: pa.Array) -> None:
        if not len(terms):
            return
        found = terms.value_counts()
        new = pa.table({"term": found.field("values"), "low": found.field("counts")})
        if self.table is not None:
            new = pa.concat_tables([self.table, new]).group_by("term").aggregate([("low", "sum")])
            new = new.rename_columns(["low" if c == "low_sum" else c for c in new.column_names]).select(["term", "low"])
        self.table = new
        if new.num_rows > 4 * self.counters:
            self.shrink()

    def shrink(self) -> None:
        if self.table is None or self.table.num_rows <= self.counters:
            return
        low = self.table.column("low").to_numpy()
        cut = int(np.partition(low, len(low) - self.counters - 1)[len(low) - self.counters - 1])
        kept = self.table.filter(pa.array(low > cut))
        self.table = pa.table({"term": kept.column("term").combine_chunks(),
                               "low": pc.subtract(kept.column("low"), cut).combine_chunks()})
        self.off += cut


def _summarize(counters: int, ngrams: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Summary(counters)
        for batch in batches:
            for part in slices(batch):
                own.add(document_terms(part.column(0), ngrams)[0])
        own.shrink()
        yield pa.RecordBatch.from_pydict({"term": pa.array([None], pa.string()), "low": pa.array([own.off], pa.int64())})
        if own.table is not None:
            yield from own.table.to_batches()

    return run


def _recount(candidates: pa.Array, ngrams: int):
    """(slot, term_count, doc_freq) of each candidate in a task; slot -1 counts the documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, docs = len(candidates), 0
        count, held = np.zeros(n, np.int64), np.zeros(n, np.int64)
        for batch in batches:
            docs += batch.num_rows
            for part in slices(batch):
                rows, slot = slots_of(part.column(0), candidates, ngrams)
                count += np.bincount(slot, minlength=n)
                held += np.bincount(np.unique(rows * n + slot) % n, minlength=n) if n else 0
        used = np.flatnonzero(count)
        yield pa.RecordBatch.from_pydict({"slot": np.append(used, -1).astype(np.int32),
                                          "term_count": np.append(count[used], 0), "doc_freq": np.append(held[used], docs)})

    return run


def slots_of(tokens: pa.ListArray, vocabulary: pa.Array, ngrams: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, slot) of each occurrence of a vocabulary term."""
    terms, rows = document_terms(tokens, ngrams)
    slot = pc.index_in(terms, value_set=vocabulary)
    known = pc.is_valid(slot).to_numpy(zero_copy_only=False)
    return rows[known].astype(np.int64), slot.drop_null().to_numpy().astype(np.int64)


@dataclass
class Vocabulary:
    rows: list[tuple[str, int, int]]   # (term, term_count, doc_freq), most frequent first, ties by term
    n_docs: int
    rounds: int                        # summaries made
    candidates: int                    # terms counted exactly


def frequent_terms(docs: DataFrame, tokens_col: str, k: int, ngrams: int = 2, counters: int | None = None) -> Vocabulary:
    """The k most frequent terms of the corpus with exact counts (see the module)."""
    ship_package(docs.sparkSession)
    tokens = docs.select(tokens_col)
    m, rounds = counters or max(COUNTERS, SPARE * k), 0
    while True:
        rounds += 1
        made = cut_lineage(tokens.mapInArrow(_summarize(m, ngrams), "term string, low long"))
        off = made.where("term is null").agg(F.sum("low")).first()[0] or 0
        lows = cut_lineage(made.where("term is not null").groupBy("term").agg(F.sum("low").alias("low")))
        order = [F.desc("low"), F.asc("term")]
        best = lows.orderBy(*order).limit(k)
        if off == 0:  # exact counts
            candidates = best
            break
        edge = best.agg(F.min("low").alias("low"), F.count(F.lit(1)).alias("n")).first()
        if edge["n"] == k and off < edge["low"]:
            candidates = lows.where(F.col("low") >= edge["low"] - off)
            if candidates.limit(SPARE * k + 1).count() <= SPARE * k:
                break
        m *= GROWTH
    names = sorted(r["term"] for r in candidates.select("term").collect())  # at most SPARE * k
    shared = pa.array(names, pa.string())
    exact = tokens.mapInArrow(_recount(shared, ngrams), "slot int, term_count long, doc_freq long").groupBy("slot").agg(
        F.sum("term_count").alias("term_count"), F.sum("doc_freq").alias("doc_freq")).collect()
    n_docs = sum(r["doc_freq"] for r in exact if r["slot"] < 0)
    found = [(names[r["slot"]], r["term_count"], r["doc_freq"]) for r in exact if r["slot"] >= 0]
    # order of UTF-8 bytes, as Spark sorts strings
    found.sort(key=lambda r: (-r[1], r[0].encode("utf-8", "surrogatepass")))
    return Vocabulary(found[:k], n_docs, rounds, len(names))


# --- weights of a document ------------------------------------------------------------------------------------

Slots = Callable[[pa.ListArray], tuple[np.ndarray, np.ndarray, np.ndarray]]  # rows, slots, values


def vocabulary_slots(vocabulary: list[str], idf: list[float], ngrams: int, sublinear: bool) -> Slots:
    """Counts of the vocabulary's terms (or 1 + ln of them) times their idf."""
    names, scale = pa.array(vocabulary, pa.string()), np.array(idf, np.float64)

    def run(tokens: pa.ListArray):
        rows, slots, n = _summed(*slots_of(tokens, names, ngrams), None, len(vocabulary))
        return rows, slots, (1.0 + np.log(n) if sublinear else n) * (scale[slots] if len(slots) else 1.0)

    return run


def hashed_slots(width: int) -> Slots:
    """Signed sums: a token's md5 picks its bucket and its sign, so tokens of one bucket tend to cancel; zeros are left out."""

    def run(tokens: pa.ListArray):
        flat, rows = document_terms(tokens, 1)
        coded = flat.dictionary_encode()
        digests = [hashlib.md5(t.encode("utf-8", "surrogatepass")).hexdigest() for t in coded.dictionary.to_pylist()]
        bucket = np.array([int(d[:8], 16) % width for d in digests], np.int64)
        sign = np.array([-1.0 if d[8] >= "8" else 1.0 for d in digests], np.float64)
        at = coded.indices.to_numpy()
        rows, slots, sums = _summed(rows, bucket[at] if len(at) else bucket, sign[at] if len(at) else sign, width)
        some = sums != 0
        return rows[some], slots[some], sums[some]

    return run


def _summed(rows: np.ndarray, slots: np.ndarray, values: np.ndarray | None, width: int):
    """Sums (or counts) of equal (row, slot), in that order."""
    key, back = np.unique(rows.astype(np.int64) * max(width, 1) + slots, return_inverse=True)
    sums = np.bincount(back, values, len(key)).astype(np.float64)
    return key // max(width, 1), key % max(width, 1), sums


def normalised(slots: Slots, tokens: pa.ListArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(offsets, slots, weights) of each row, of Euclidean length 1."""
    rows, at, values = slots(tokens)
    length = np.sqrt(np.bincount(rows, values * values, len(tokens)))
    ends = np.searchsorted(rows, np.arange(len(tokens) + 1))
    return ends.astype(np.int32), at.astype(np.int32), values / length[rows]


def sparse_vectors(offsets: np.ndarray, indices: np.ndarray, values: np.ndarray, width: int) -> pa.StructArray:
    """Sparse vectors in the form Spark stores them, from their parts."""
    n = len(offsets) - 1
    kinds = [pa.list_(pa.field("element", t, False)) for t in (pa.int32(), pa.float64())]
    columns = [pa.array(np.zeros(n, np.int8)), pa.array(np.full(n, width, np.int32)),
               *[pa.ListArray.from_arrays(offsets, pa.array(x, t.value_type), type=t)
                 for x, t in zip((indices, values), kinds)]]
    return pa.StructArray.from_arrays(columns, fields=[
        pa.field("type", pa.int8(), False), pa.field("size", pa.int32()), pa.field("indices", kinds[0]),
        pa.field("values", kinds[1])])


def weight_vector(tokens: Column, slots: Slots, width: int) -> Column:
    """The normalised weights of a token array as a sparse vector column."""

    def vectors(column: pa.Array) -> pa.Array:
        batch = pa.RecordBatch.from_arrays([column], ["tokens"])
        parts = [sparse_vectors(*normalised(slots, part.column(0)), width) for part in slices(batch)]
        return pa.concat_arrays(parts) if parts else sparse_vectors(np.zeros(1, np.int32), *[np.empty(0)] * 2, width)

    # an Arrow function is told apart by the kinds of its arguments
    vectors.__annotations__ = {"column": pa.Array, "return": pa.Array}
    return F.arrow_udf(vectors, VectorUDT())(tokens)


def count_vector(tokens: Column, vocabulary: list[str], ngrams: int = 1) -> Column:
    """The counts of the vocabulary's terms in a token array as a sparse vector column."""
    names = pa.array(vocabulary, pa.string())

    def vectors(column: pa.Array) -> pa.Array:
        batch = pa.RecordBatch.from_arrays([column], ["tokens"])
        parts = []
        for part in slices(batch):
            rows, slots, counts = _summed(*slots_of(part.column(0), names, ngrams), None, len(vocabulary))
            ends = np.searchsorted(rows, np.arange(part.num_rows + 1)).astype(np.int32)
            parts.append(sparse_vectors(ends, slots, counts, len(vocabulary)))
        return pa.concat_arrays(parts) if parts else sparse_vectors(np.zeros(1, np.int32), *[np.empty(0)] * 2, len(vocabulary))

    vectors.__annotations__ = {"column": pa.Array, "return": pa.Array}
    return F.arrow_udf(vectors, VectorUDT())(tokens)


def weight_rows(docs: DataFrame, id_col: str, tokens_col: str, slots: Slots, names: list[str] | None = None) -> DataFrame:
    """Long form (id, slot or term, weight) of the normalised weights; a document never leaves its row until the end."""
    ship_package(docs.sparkSession)
    kind = "string" if names is not None else "long"
    labels = pa.array(names, pa.string()) if names is not None else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1):
                offsets, at, weights = normalised(slots, part.column(1))
                shown = labels.take(pa.array(at)) if labels is not None else pa.array(at.astype(np.int64))
                ids = part.column(0).take(pa.array(np.repeat(np.arange(part.num_rows), np.diff(offsets))))
                yield pa.RecordBatch.from_arrays([ids, shown, pa.array(weights, pa.float64())], [id_col, "slot", "weight"])

    id_type = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, tokens_col).mapInArrow(run, f"`{id_col}` {id_type}, slot {kind}, weight double")


def smooth_idf(n_docs: int, doc_freq: int) -> float:
    return math.log((1 + n_docs) / (1 + doc_freq)) + 1
