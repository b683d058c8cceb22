"""Language identification by rank-order profiles of character n-grams (operator 6).

A language's profile is its ``PROFILE`` most frequent n-grams of one to three letters (words padded with a space) over
all training rows, in order. A text is compared by the out-of-place distance: for each of its own ``PROFILE`` most
frequent n-grams the difference of the ranks, or ``PROFILE`` where the profile lacks it. The nearest profile wins, ties
go to the first language by code point. The score is one minus the distance over the largest possible one.

Letters are Unicode letters, lower-cased; n-grams never cross a word. Texts are counted whole, ``SEGMENT`` letters at a
time. A null text, one without any letter, or any text when there are no profiles is ``und`` with score 0. Rows with a
null text or language teach nothing. Columns other than text and language are not read; an empty table gives an empty
result. The profiles are languages x ``PROFILE`` rows, all that reaches the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tableprep.llm.chars import letter_stream

PROFILE, SEGMENT, UNKNOWN = 400, 2_000_000, "und"
RESULT = "lang string, score double, letters long"


def _codes(stream: np.ndarray) -> np.ndarray:
    """All n-grams of one to three letters as numbers of 21 bits a letter."""
    c = stream.astype(np.uint64)
    one = c[c != 32]
    two = (c[:-1] << np.uint64(21)) | c[1:]
    inner = c[1:-1] != 32
    three = ((c[:-2] << np.uint64(42)) | (c[1:-1] << np.uint64(21)) | c[2:])[inner]
    return np.concatenate((one, two, three))


def gram_counts(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """(n-grams, counts) of a whole text."""
    stream = letter_stream(text)
    if len(stream) <= SEGMENT:
        return np.unique(_codes(stream), return_counts=True) if len(stream) else (np.empty(0, np.uint64), np.empty(0, int))
    cuts, at = [0], 0
    while at + SEGMENT < len(stream):  # cut at a space, so that no word is split; a longer word stays whole
        space = np.flatnonzero(stream[at + 1:at + SEGMENT] == 32)
        if not len(space):
            space = np.flatnonzero(stream[at + SEGMENT:] == 32) + SEGMENT - 1
        at += int(space[-1 if space[-1] < SEGMENT else 0]) + 1
        cuts.append(at)
    parts = [np.unique(_codes(stream[a:b + 1]), return_counts=True) for a, b in zip(cuts, [*cuts[1:], len(stream)])]
    return _merge([p[0] for p in parts], [p[1] for p in parts])


def _merge(codes: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    names, inverse = np.unique(np.concatenate(codes), return_inverse=True)
    return names, np.bincount(inverse, np.concatenate(counts)).astype(np.int64)


def ranked(codes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The most frequent n-grams first, ties by number."""
    if len(codes) > 4 * PROFILE:  # nothing below the PROFILE-th count can get in
        least = np.partition(counts, len(counts) - PROFILE)[len(counts) - PROFILE]
        keep = counts >= least
        codes, counts = codes[keep], counts[keep]
    return codes[np.lexsort((codes, -counts))][:PROFILE]


def learn_profiles(rows: DataFrame, text_col: str = "text", lang_col: str = "lang") -> dict[str, list[int]]:
    """Language -> its n-grams by rank, counted over all given rows."""

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for lang, texts in pdf.groupby("lang")["text"]:
                held: list[tuple[np.ndarray, np.ndarray]] = []
                size = 0
                for text in texts:
                    held.append(gram_counts(text))
                    size += len(held[-1][0])
                    if size > SEGMENT:
                        held, size = [_merge([h[0] for h in held], [h[1] for h in held])], 0
                names, counts = _merge([h[0] for h in held], [h[1] for h in held])
                yield pd.DataFrame({"lang": lang, "gram": names.view(np.int64), "n": counts})

    pairs = rows.select(F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"))
    grams = pairs.where("text is not null and lang is not null").mapInPandas(count, "lang string, gram long, n long")
    totals = grams.groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))
    top = totals.withColumn("rank", rank).where(F.col("rank") <= PROFILE).collect()
    out: dict[str, list[int]] = {}
    for r in sorted(top, key=lambda r: (r["lang"].encode("utf-8", "surrogatepass"), r["rank"])):
        out.setdefault(r["lang"], []).append(r["gram"])
    return out


class Ranker:
    """Scores texts against profiles."""

    def __init__(self, profiles: dict[str, list[int]]):
        self.langs = list(profiles)
        grams = [np.array(profiles[x], np.int64).view(np.uint64) for x in self.langs]
        self.names = np.unique(np.concatenate(grams)) if grams else np.empty(0, np.uint64)
        self.ranks = np.full((len(self.names) + 1, len(self.langs)), -1, np.int64)
        for i, g in enumerate(grams):
            self.ranks[np.searchsorted(self.names, g), i] = np.arange(len(g))

    def __call__(self, text: str | None) -> tuple[str, float]:
        return self.measured(text)[:2]

    def measured(self, text: str | None) -> tuple[str, float, int]:
        """Language, score and number of letters of a text."""
        codes, counts = gram_counts(text)
        letters = int(counts[codes < 1 << 21].sum())
        if not len(codes) or not self.langs:
            return UNKNOWN, 0.0, letters
        own = ranked(codes, counts)
        at = np.searchsorted(self.names, own)
        at[(at == len(self.names)) | (self.names[np.minimum(at, len(self.names) - 1)] != own)] = len(self.names)
        theirs = self.ranks[at]
        place = np.arange(len(own))[:, None]
        distance = np.where(theirs >= 0, np.minimum(np.abs(theirs - place), PROFILE), PROFILE).sum(axis=0)
        best = int(np.argmin(distance))
        return self.langs[best], float(1 - distance[best] / (PROFILE * len(own))), letters


def predict(profiles: dict[str, list[int]], text: Column) -> Column:
    """Struct (lang, score, letters) of a text column."""

    rankers: list[Ranker] = []

    def run(texts: pa.Array) -> pa.Array:
        if not rankers:  # once a worker
            rankers.append(Ranker(profiles))
        lang, score, letters = zip(*[rankers[0].measured(t.as_py()) for t in texts]) if len(texts) else ((), (), ())
        return pa.StructArray.from_arrays([pa.array(lang, pa.string()), pa.array(score, pa.float64()),
                                           pa.array(letters, pa.int64())], ["lang", "score", "letters"])

    # an Arrow function is told by the kinds of its arguments; texts become Python strings one at a time
    run.__annotations__ = {"texts": pa.Array, "return": pa.Array}
    run = F.arrow_udf(run, RESULT)
    return run(text.cast("string"))


def fold(id_col: str) -> Column:
    """crc32 of the id as text, modulo 5 (null: null)."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 5


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """One row a document: doc_id, held_out, lang_pred, score. Learns from the folds 1 to 4; null ids teach nothing."""
    profiles = learn_profiles(docs.where(fold(id_col) != 0), text_col, lang_col)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(fold(id_col) == 0, F.lit(False)).alias(
        "held_out"), predict(profiles, F.col(text_col)).alias("p"))
    return rows.select("doc_id", "held_out", F.col("p.lang").alias("lang_pred"), F.col("p.score").alias("score"))
