"""Near-duplicate documents by HyperMinHash sketches, banding and an exact check (operator 3).

A document is the set of its distinct five-word shingles (``base.shingle_hashes``). Documents are linked when
``100 * intersection >= percent * union``; a component is everything reachable over links.

1. *Sketch.* ``REGISTERS`` registers a document, each the smallest hash of its bucket kept as a leading-zero count
   (6 bits) and the ``MANTISSA`` bits after the leading one. Sets of at most ``SMALL`` shingles use one hash function
   a register over the whole set, larger sets deal their shingles out over buckets and let empty buckets borrow from
   filled ones; sets near the border carry both forms, so any two sets that can be linked share one form.
2. *Equal sets* fall together first (128-bit digest of the set); only the smallest id of each class goes on.
3. *Banding.* ``BANDS`` keys of ``REGISTERS / BANDS`` compressed registers each. Two sets at 0.85 miss all bands with
   a chance below 1e-8, at 0.80 with 5e-6.
4. *Hubs.* Within a band's group every member is compared with one hub: the member that lies in the most and largest
   groups, which is the text that others were copied from. Pairs whose collision-corrected Jaccard estimate lies far
   (six standard errors) below the threshold are left out; the rest are checked on full sets.
5. *Rest.* Groups whose members still belong to different components are compared across components (pairs within a
   component can add nothing), and only where the link is possible. An intersection holds shared shingles alone (those
   that another set has too), and of these at most the smaller share inside the group's hub plus the smaller share
   outside it; with that bound s, ``100 s >= percent (n + m - s)`` has to hold. A family of near copies, each with edits
   of its own, so costs its size, not its square.

Texts without words (null, empty, blank) have no shingles and are linked with nothing. Rows that share a doc_id are
one document as far as links go (their sets may differ; each row is returned). Rows with a null id are linked with
nothing, ``component_id`` null, kept. An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tableprep.llm.base import (BitMap, batch_word_hashes, hot_keys, id_hashes, mix, odd_constants, salted_lookup,
                                shingle_hashes, signed, stage)
from tableprep.llm.components import components
from tableprep.llm.token_blocks import _small_batches

REGISTERS, BANDS, MANTISSA, SMALL = 240, 40, 10, 256
COMPARED = 120  # registers that a pair is compared on before its sets are
WIDTH = 5
_EMPTY = np.uint64((1 << 64) - 1)
_SEEDS = odd_constants(REGISTERS, "register")
_BAND = odd_constants(REGISTERS, "band").reshape(BANDS, -1)
_FORM = odd_constants(2 * BANDS, "form").reshape(2, BANDS)
_SPREAD = odd_constants(2, "bucket")
_PROBE = (mix(np.arange(REGISTERS * 64, dtype=np.uint64) * _SPREAD[1] + _SPREAD[0]) % np.uint64(REGISTERS)).astype(
    np.int64).reshape(64, REGISTERS)


def compress(smallest: np.ndarray) -> np.ndarray:
    """A 56-bit minimum as leading-zero count (6 bits) and mantissa: 16 bits."""
    fraction, exponent = np.frexp(smallest.astype(np.float64))
    zeros = (56 - np.clip(exponent, 0, 56)).astype(np.uint16)
    mantissa = np.clip((2 * fraction - 1) * (1 << MANTISSA), 0, (1 << MANTISSA) - 1).astype(np.uint16)
    return (zeros << np.uint16(MANTISSA)) | mantissa


def sketch_small(u: np.ndarray) -> np.ndarray:
    """One hash function a register over the whole set."""
    out = np.empty(REGISTERS, np.uint64)
    step = max(1, 16_384 // len(u))
    for i in range(0, REGISTERS, step):
        x = u[None, :] * _SEEDS[i:i + step, None]
        x ^= x >> np.uint64(32)
        x *= _SPREAD[0]
        out[i:i + step] = (x >> np.uint64(8)).min(axis=1)
    return compress(out)


def sketch_large(u: np.ndarray) -> np.ndarray:
    """The set dealt out over buckets; an empty bucket takes the value of the first filled one on its probe path."""
    x = mix(u * _SPREAD[1])
    bucket = ((x >> np.uint64(32)) * np.uint64(REGISTERS)) >> np.uint64(32)
    keyed = np.sort((bucket << np.uint64(56)) | (mix(x ^ _SPREAD[0]) >> np.uint64(8)))
    first = np.searchsorted(keyed, np.arange(REGISTERS + 1, dtype=np.uint64) << np.uint64(56))
    filled = first[1:] > first[:-1]
    out = np.full(REGISTERS, _EMPTY)
    out[filled] = keyed[first[:-1][filled]] & np.uint64((1 << 56) - 1)
    for probe in _PROBE:
        empty = np.flatnonzero(out == _EMPTY)
        if not len(empty):
            break
        source = probe[empty]
        hit = filled[source]
        out[empty[hit]] = out[source[hit]]
    out[out == _EMPTY] = out[filled][0]
    return compress(out)


def band_keys(registers: np.ndarray, form: int) -> np.ndarray:
    return mix((registers.reshape(BANDS, -1).astype(np.uint64) * _BAND).sum(axis=1) + _FORM[form])


def collision_rate(n: np.ndarray, m: np.ndarray, buckets: np.ndarray) -> np.ndarray:
    """Chance that the registers of two disjoint sets of n and m shingles agree.

    Minima over ``buckets`` buckets are about exponential with rates n/buckets and m/buckets; in each octave of
    leading zeros two of them share one of the 2^MANTISSA cells with the octave's cell width times the densities.
    """
    a, b = np.maximum(n / buckets, 1e-9), np.maximum(m / buckets, 1e-9)
    high = 2.0 ** -np.arange(0, 50)
    low = high / 2
    s = (a + b)[:, None]
    inside = np.exp(-s * low) - np.exp(-s * high)
    return (inside * (low / (1 << MANTISSA))).sum(axis=1) * a * b / (a + b)


def estimate(regs_a: np.ndarray, regs_b: np.ndarray, n: np.ndarray, m: np.ndarray, small: np.ndarray) -> np.ndarray:
    """Jaccard estimate of rows of registers, corrected for chance agreement."""
    agree = (regs_a == regs_b).mean(axis=1)
    chance = collision_rate(n.astype(float), m.astype(float), np.where(small, 1.0, float(REGISTERS)))
    return (agree - chance) / (1 - chance)


def sketches(docs: DataFrame, id_col: str, text_col: str, percent: int) -> DataFrame:
    """One row a document: id, set size, set digest, registers of one or both forms, band keys."""
    border = SMALL * percent // 100

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j in _small_batches(batch.column(1)):
                h, bounds = batch_word_hashes(batch.column(1).slice(i, j - i))
                sizes, digests, small, large, keys = [], [], [], [], []
                for s, e in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
                    u = shingle_hashes(h[s:e], WIDTH)
                    a = sketch_small(u) if 0 < len(u) <= SMALL else None
                    b = sketch_large(u) if len(u) > border else None
                    sizes.append(len(u))
                    digests.append(hashlib.blake2b(u.tobytes(), digest_size=16).digest())
                    small.append(None if a is None else a.tobytes())
                    large.append(None if b is None else b.tobytes())
                    keys.append(np.concatenate([band_keys(x, form) for form, x in enumerate((a, b)) if x is not None]
                                               or [np.empty(0, np.uint64)]))
                offsets = np.concatenate(([0], np.cumsum([len(x) for x in keys]))).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(i, j - i), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()),
                     pa.array(small, pa.binary()), pa.array(large, pa.binary()),
                     pa.ListArray.from_arrays(offsets, pa.array(signed(np.concatenate(keys))))],
                    names=["doc_id", "n_shingles", "digest", "small", "large", "keys"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_shingles long, digest binary, small binary, large binary, "
                                "keys array<long>")


def shingle_sets(docs: DataFrame, wanted: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, set) of the wanted ids: the sorted shingle hashes as bytes. No text is shuffled for it."""
    bit_map = BitMap(id_hashes(wanted, "doc_id"), "hash", wanted.count())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        may_hold = bit_map.holds()
        for batch in batches:
            batch = batch.filter(pc.is_valid(batch.column(0)))
            batch = batch.filter(pa.array(may_hold(mix(batch.column(0).to_numpy().view(np.uint64)))))
            for i, j in _small_batches(batch.column(1)):
                h, bounds = batch_word_hashes(batch.column(1).slice(i, j - i))
                sets = [shingle_hashes(h[s:e], WIDTH).tobytes()
                        for s, e in zip(bounds[:-1].tolist(), bounds[1:].tolist())]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(sets, pa.binary())],
                                                 names=["doc_id", "set"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    found = rows.mapInArrow(run, "doc_id long, set binary").join(wanted, "doc_id", "left_semi")
    return found.groupBy("doc_id").agg(F.min("set").alias("set"))


def _close(percent: int):
    """Filter for pairs with registers: drops those surely below the threshold."""
    limit = percent / 100

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            n, m = pdf["na"].to_numpy(), pdf["nb"].to_numpy()
            sized = 100 * np.minimum(n, m) >= percent * np.maximum(n, m)
            both_small = (n <= SMALL) & (m <= SMALL)
            keep = sized.copy()
            for small in (True, False):
                pick = np.flatnonzero(sized & (both_small if small else ~both_small))
                if not len(pick):
                    continue
                sides = [np.frombuffer(b"".join(pdf[c].iloc[pick]), np.uint16).reshape(-1, COMPARED)
                         for c in (("sa", "sb") if small else ("la", "lb"))]
                got = estimate(*sides, n[pick], m[pick], np.full(len(pick), small))
                # borrowed registers repeat others: count the filled ones only, and tiny sets not at all
                own = COMPARED * (1 - np.exp(-np.minimum(n, m)[pick] / REGISTERS))
                error = np.sqrt(limit * (1 - limit) / np.where(small, COMPARED, own))
                keep[pick] = got >= limit - 6 * error
            yield pdf.loc[keep, ["a", "b", "na", "nb"]]

    return run


def _overlaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs with both sets: the size of their intersection. The sets are read where Arrow holds them."""
    for batch in batches:
        common = np.zeros(batch.num_rows, np.int64)
        for i, (x, y) in enumerate(zip(batch.column("set_a"), batch.column("set_b"))):
            u, v = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
            common[i] = len(np.intersect1d(u, v, assume_unique=True))
        yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("a", "b", "na", "nb")], pa.array(common)],
                                         ["a", "b", "na", "nb", "common"])


def _checked(pairs: DataFrame, reps: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(a, b, na, nb, common) of those distinct pairs (a < b) that the sketches leave possible, staged."""
    sketch = reps.select("doc_id", "n_shingles", *[F.substring(c, 1, 2 * COMPARED).alias(c) for c in ("small", "large")])
    near = salted_lookup(pairs, sketch.toDF("a", "na", "sa", "la"), ["a"], F.col("b"))
    near = near.join(sketch.toDF("b", "nb", "sb", "lb"), "b").mapInPandas(_close(percent), "a long, b long, na long, nb long")
    near = stage(near)
    full = salted_lookup(near, sets.toDF("a", "set_a"), ["a"], F.col("b")).join(sets.toDF("b", "set_b"), "b")
    return stage(full.mapInArrow(_overlaps, "a long, b long, na long, nb long, common long"))


def _linked(checked: DataFrame, percent: int) -> DataFrame:
    return checked.where((F.col("common") > 0) & (100 * F.col("common") >= percent * (F.col("na") + F.col("nb") - F.col("common"))))


def shared_counts(sets: DataFrame) -> DataFrame:
    """(doc_id, shared): how many of a set's shingles some other set has too. Only those can be in an intersection, so
    ``shared`` bounds every overlap from above."""

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = (pc.binary_length(batch.column(1)).to_numpy() // 8).astype(np.int64)
            flat = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.int64)
            ids, at = np.repeat(batch.column(0).to_numpy(), sizes), 0
            while at < len(flat):
                yield pa.RecordBatch.from_pydict({"shingle": flat[at:at + 1_000_000], "doc_id": ids[at:at + 1_000_000]})
                at += 1_000_000

    single = sets.select("doc_id", "set").mapInArrow(explode, "shingle long, doc_id long")
    counts = stage(single.groupBy("shingle").agg(F.count(F.lit(1)).alias("n")).where("n > 1"))
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    hot = hot_keys(counts, ["shingle"], total)
    met = salted_lookup(single, counts.select("shingle"), ["shingle"], F.col("doc_id"), hot=hot)
    return met.groupBy("doc_id").agg(F.count(F.lit(1)).alias("shared"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 85) -> DataFrame:
    """One row a document: doc_id, n_shingles, component_id, kept."""
    sketched = stage(sketches(docs, id_col, text_col, percent))
    filled = sketched.where(F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0))
    classes = stage(filled.groupBy("digest", "n_shingles").agg(
        F.min("doc_id").alias("doc_id"), F.first("small").alias("small"), F.first("large").alias("large"),
        F.first("keys").alias("keys")))
    # an id that stands for several sets (repeated ids) keeps one sketch row a set; pairs name ids
    reps = classes.groupBy("doc_id").agg(*[F.min_by(c, "digest").alias(c) for c in ("n_shingles", "small", "large")])
    rows = stage(classes.select("doc_id", F.posexplode("keys").alias("band", "key"))
                 .select("key", "doc_id"))
    sizes = stage(rows.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1"))
    grouped = stage(salted_lookup(rows, sizes, ["key"], F.col("doc_id"), hot=hot_keys(sizes, ["key"], rows.count())))
    # a set that others were copied from keeps their common registers, so it sits in the most and largest groups
    weights = grouped.groupBy("doc_id").agg(F.sum("n").alias("weight"))
    members = stage(weights.join(reps.select("doc_id", "n_shingles"), "doc_id"))
    sets = stage(shingle_sets(docs, members.select("doc_id"), id_col, text_col))
    members = stage(members.join(shared_counts(sets), "doc_id").select("doc_id", "weight", "n_shingles", "shared"))
    grouped = stage(grouped.select("key", "doc_id").join(members, "doc_id"))
    hubs = stage(grouped.groupBy("key").agg(
        F.max_by("doc_id", F.struct("weight", -F.col("doc_id"))).alias("hub"), F.count(F.lit(1)).alias("n")))
    hot = hot_keys(hubs, ["key"], grouped.count())
    grouped = stage(salted_lookup(grouped, hubs.select("key", "hub"), ["key"], F.col("doc_id"), hot=hot))
    pairs = stage(grouped.where("hub <> doc_id").select(
        F.least("hub", "doc_id").alias("a"), F.greatest("hub", "doc_id").alias("b")).distinct())
    first = _checked(pairs, reps, sets, percent)
    found = stage(components(_linked(first, percent)))
    # groups that are still split: pairs of members in different components whose overlaps leave it possible
    both = first.select(F.col("a").alias("hub"), F.col("b").alias("doc_id"), "common").unionByName(
        first.select(F.col("b").alias("hub"), F.col("a").alias("doc_id"), "common"))
    may = grouped.where(100 * F.col("shared") >= percent * F.col("n_shingles")).join(both, ["hub", "doc_id"], "left").join(
        found.withColumnRenamed("node", "doc_id"), "doc_id", "left")
    with_hub = F.when(F.col("doc_id") == F.col("hub"), F.col("shared")).otherwise(F.col("common"))
    labelled = stage(may.select(
        "key", "doc_id", "n_shingles", "shared", F.coalesce(with_hub, "shared").alias("inside"),
        F.coalesce(F.col("shared") - with_hub, "shared").alias("outside"), F.coalesce("component", "doc_id").alias("label")))
    labels = labelled.groupBy("key", "label").agg(F.count(F.lit(1)).alias("n"))
    split = stage(labels.groupBy("key").agg(
        F.max_by("label", F.struct("n", "label")).alias("main"), F.count(F.lit(1)).alias("labels"), F.sum("n").alias("n"))
        .where("labels > 1"))
    open_rows = stage(salted_lookup(labelled, split.select("key", "main"), ["key"], F.col("doc_id"),
                                    hot=hot_keys(split, ["key"], labelled.count())))
    # one side of a pair lies outside the group's largest component, so that one is never compared with itself
    cols = ["doc_id", "label", "n_shingles", "shared", "inside", "outside"]
    x = open_rows.where("label <> main").select("key", *[F.col(c).alias(f"{c}_x") for c in cols])
    y = open_rows.select("key", *[F.col(c).alias(f"{c}_y") for c in cols])
    most = F.least("shared_x", "shared_y", F.least("inside_x", "inside_y") + F.least("outside_x", "outside_y"))
    possible = 100 * most >= percent * (F.col("n_shingles_x") + F.col("n_shingles_y") - most)
    rest = x.join(y, "key").where((F.col("label_x") != F.col("label_y")) & possible).select(
        F.least("doc_id_x", "doc_id_y").alias("a"), F.greatest("doc_id_x", "doc_id_y").alias("b")).distinct()
    more = _linked(_checked(stage(rest.join(pairs, ["a", "b"], "left_anti")), reps, sets, percent), percent)
    final = components(found.select(F.col("component").alias("a"), F.col("node").alias("b")).unionByName(more.select("a", "b")))
    # documents -> class -> component; one row a class, hot classes dealt out
    top = classes.select("digest", "n_shingles", F.col("doc_id").alias("rep")).join(
        final.withColumnRenamed("node", "rep"), "rep", "left").select(
        "digest", "n_shingles", F.coalesce("component", "rep").alias("component_id"))
    out = salted_lookup(sketched.select("doc_id", "n_shingles", "digest"), stage(top), ["digest", "n_shingles"],
                        F.col("doc_id"), "left")
    component = F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    component = F.when(F.col("doc_id").isNotNull(), component)
    return out.select("doc_id", "n_shingles", component.alias("component_id"),
                      F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))
