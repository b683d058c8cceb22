"""Benchmark decontamination by spaced seeds (operator 4).

Fixed masks ignore some positions of a window of words: a seed hash covers the word hashes at a mask's ones only, so a
substituted word at a zero does not change it. Test and training seeds are joined on their hash, and the aligned words
around each hit are compared: an item is found in a document where a stretch of the alignment has enough equal words
and at least ``similarity`` of its words equal. Substitutions are tolerated anywhere in the stretch.

* Every item also gets a solid mask, as long as the run of equal words that each stretch that counts must hold (at 0.8
  four words, fewer for items of less than 16), so no pattern of substitutions is missed. Items without words find
  nothing.
* A stretch counts when its equal words reach ``similarity`` times the item's words, or ``long_run`` words for longer
  items (a passage of that length is a leak whatever the item's length).
* A document's seeds first meet a bit map of the items' seeds (size set by their number, at most 32 MB); only
  hits become rows, with the words around them. The join decides, the map only spares rows. The items' seed table is
  broadcast when its counted rows prove it small, else joined by shuffle with hot seeds salted.
* Neighbouring hits share one region row, so a leak sends its words once, not once a seed.

Null or blank texts match nothing; null ids are carried as nulls (pipelines keep such rows unless they match).
Repeated rows give the same findings once. Empty tables give an empty result. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tableprep.llm.base import BitMap, batch_word_hashes, mix, odd_constants, salted_lookup, signed, stage
from tableprep.llm.token_blocks import _small_batches

MASKS = ("110100111", "101101011", "111010011")  # weight 6 of span 9
BROADCAST_ROWS = 200_000
_MULT = odd_constants(64, "seed")


def seeds(h: np.ndarray, mask: str, number: int) -> np.ndarray:
    """Seed hash at each start position of the mask."""
    n = len(h) - len(mask) + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    total = np.full(n, _MULT[-1] >> np.uint64(number % 61))
    for i, one in enumerate(mask):
        if one == "1":
            total += h[i:i + n] * _MULT[i]
    return mix(total)


def solid_run(n: int, similarity: float, long_run: int) -> int:
    """The run of equal words that every stretch of an item of n words that counts holds, however its others lie."""
    percent = round(100 * similarity)
    least = min(n, max(1, int(min(np.ceil(similarity * n), long_run))))
    equal = np.arange(least, n + 1)
    unequal = np.minimum(n - equal, equal * (100 - percent) // percent if percent else n)
    return min(len(_MULT) - 1, int((-(-equal // (unequal + 1))).min()))  # a part of a longer run is one too


def _item_rows(lengths_only: bool, similarity: float, long_run: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h, bounds = batch_word_hashes(batch.column(1))
            for item, s, e in zip(batch.column(0).to_pylist(), bounds[:-1], bounds[1:]):
                words = h[s:e]
                solid = solid_run(len(words), similarity, long_run) if len(words) else 0
                if lengths_only:
                    yield pa.RecordBatch.from_pydict({"item_id": pa.array([item], pa.int64()), "n_words": [len(words)],
                                                      "solid": [solid], "words": pa.array([words.tobytes()], pa.binary())})
                    continue
                for number, mask in [*enumerate(MASKS), (1000 + solid, "1" * solid)] if solid else []:
                    got = seeds(words, mask, number)
                    yield pa.RecordBatch.from_pydict({"seed": signed(got), "item_id": pa.array([item] * len(got), pa.int64()),
                                                      "item_pos": np.arange(len(got))})

    return run


def _stretch(equal: np.ndarray, similarity: float) -> tuple[int, int, int]:
    """The longest stretch of which ``similarity`` is equal, without unequal ends: start, end, equal words."""
    percent = round(100 * similarity)
    total = np.concatenate(([0], np.cumsum(np.where(equal, 100 - percent, -percent))))
    low = np.minimum.accumulate(total)
    first = np.searchsorted(-low, -total, "left")  # the earliest start from which the share holds up to each end
    end = int(np.argmax(np.arange(len(total)) - first))
    inside = np.flatnonzero(equal[int(first[end]):end]) + int(first[end])
    return (int(inside[0]), int(inside[-1]) + 1, len(inside)) if len(inside) else (0, 0, 0)


def find_leaks(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text",
               item_id_col: str = "item_id", item_text_col: str = "text", similarity: float = 0.8,
               long_run: int = 13) -> DataFrame:
    """One row a document and item found in it: doc_id, item_id, n_words of the item, n_equal, start word, similarity."""
    tests = items.select(F.col(item_id_col).cast("long").alias("item_id"),
                         F.col(item_text_col).cast("string").alias("text")).where("item_id is not null")
    item_words = stage(tests.mapInArrow(_item_rows(True, similarity, long_run),
                                        "item_id long, n_words long, solid long, words binary")
                       .where("n_words > 0").distinct())
    item_seeds = stage(tests.mapInArrow(_item_rows(False, similarity, long_run),
                                        "seed long, item_id long, item_pos long").distinct())
    facts = item_words.agg(F.max("n_words").alias("longest"), F.sort_array(F.collect_set("solid")).alias("solid")).first()
    margin, solid = int(facts["longest"] or 0), [int(x) for x in facts["solid"]]  # at most long_run lengths
    n_seeds = item_seeds.count()
    bit_map = BitMap(item_seeds, "seed", n_seeds)

    masks = [*enumerate(MASKS), *[(1000 + n, "1" * n) for n in solid]]
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def hits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        may_hold = bit_map.holds()
        for batch in batches:
            for i, j in _small_batches(batch.column(1)):
                h, bounds = batch_word_hashes(batch.column(1).slice(i, j - i))
                doc_of = np.repeat(np.arange(j - i), np.diff(bounds))
                found_pos, found_seed = [], []
                for number, mask in masks:
                    got = seeds(h, mask, number)
                    pos = np.flatnonzero(may_hold(got))
                    pos = pos[doc_of[pos] == doc_of[np.minimum(pos + len(mask) - 1, len(doc_of) - 1)]] if len(pos) else pos
                    found_pos.append(pos)
                    found_seed.append(got[pos])
                pos, seed = np.concatenate(found_pos), np.concatenate(found_seed)
                if not len(pos):
                    continue
                order = np.argsort(pos, kind="stable")
                pos, seed = pos[order], seed[order]
                doc = doc_of[pos]
                new = np.concatenate(([True], (np.diff(pos) > margin) | (np.diff(doc) > 0)))
                first = np.flatnonzero(new)
                ends = np.append(first[1:], len(pos))
                ids = batch.column(0).slice(i, j - i).to_pylist()
                out = {"doc_id": [], "start": [], "words": [], "seeds": [], "at": []}
                for a, b in zip(first.tolist(), ends.tolist()):
                    d = int(doc[a])
                    lo = max(int(bounds[d]), int(pos[a]) - margin)
                    hi = min(int(bounds[d + 1]), int(pos[b - 1]) + margin + 64)
                    out["doc_id"].append(ids[d])
                    out["start"].append(lo - int(bounds[d]))
                    out["words"].append(h[lo:hi].tobytes())
                    out["seeds"].append(signed(seed[a:b]).tolist())
                    out["at"].append((pos[a:b] - lo).tolist())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(out["doc_id"], pa.int64()), pa.array(out["start"], pa.int64()),
                     pa.array(out["words"], pa.binary()), pa.array(out["seeds"], pa.list_(pa.int64())),
                     pa.array(out["at"], pa.list_(pa.int64()))], ["doc_id", "start", "words", "seeds", "at"])

    regions = stage(rows.mapInArrow(hits, "doc_id long, start long, words binary, seeds array<long>, at array<long>")
                    .withColumn("region", F.expr("uuid()")))
    exploded = regions.select("region", F.explode(F.arrays_zip("seeds", "at")).alias("z")).select(
        "region", F.col("z.seeds").alias("seed"), F.col("z.at").alias("at"))
    if n_seeds <= BROADCAST_ROWS:  # 24 bytes a row
        met = exploded.join(F.broadcast(item_seeds), "seed")
    else:
        met = salted_lookup(exploded, item_seeds, ["seed"], F.col("region"))
    diagonals = met.select("region", "item_id", (F.col("at") - F.col("item_pos")).alias("shift")).distinct()
    by_region = diagonals.groupBy("region", "item_id").agg(F.collect_set("shift").alias("shifts"))
    full = by_region.join(regions.select("region", "doc_id", "start", "words"), "region")
    item_side = item_words.select("item_id", "n_words", F.col("words").alias("item_words"))
    if n_seeds <= BROADCAST_ROWS:  # an item's words are not many more than its seeds
        full = full.join(F.broadcast(item_side), "item_id")
    else:
        full = salted_lookup(full, item_side, ["item_id"], F.col("region"))

    def verify(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            out = []
            for r in pdf.itertuples():
                u, v = np.frombuffer(r.words, np.uint64), np.frombuffer(r.item_words, np.uint64)
                best = (0, 0, 0, 0)
                for shift in sorted(r.shifts):
                    a, b = max(0, -shift), min(len(v), len(u) - shift)
                    if b <= a:
                        continue
                    s, e, same = _stretch(u[a + shift:b + shift] == v[a:b], similarity)
                    if (same, -(r.start + shift + a + s)) > (best[0], -best[1]):
                        best = (same, r.start + shift + a + s, e - s, shift)
                if best[0] >= min(np.ceil(similarity * len(v)), long_run):
                    out.append((r.doc_id, r.item_id, len(v), best[0], best[1], best[0] / best[2]))
            yield pd.DataFrame(out, columns=["doc_id", "item_id", "n_words", "n_equal", "start_word", "likeness"]).astype(
                {"doc_id": "Int64"})

    found = full.mapInPandas(verify, "doc_id long, item_id long, n_words long, n_equal long, start_word long, "
                                     "likeness double")
    best = F.struct("n_equal", -F.col("start_word"), "likeness", "n_words")
    return found.groupBy("doc_id", "item_id").agg(F.max(best).alias("m"), F.count(F.lit(1)).alias("n_places")).select(
        "doc_id", "item_id", F.col("m.n_words").alias("n_words"), F.col("m.n_equal").alias("n_equal"),
        (-F.col("m.col2")).alias("start_word"), F.col("m.likeness").alias("likeness"), "n_places")
