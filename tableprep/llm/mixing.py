"""Mixing sources to target weights by a low-discrepancy schedule (operator 7).

The mix is a sequence of slots of ``block_words`` words each. Slot i gets the golden-ratio point ``frac(i / phi)``,
which falls into one source's stretch of the cumulative targets, so at any length of the sequence each source is within
a few slots of its share. The r-th slot of a source takes the r-th block of that source's stream: its documents in the
order of a hash of their id, cut into blocks of equal words, up to ``max_epochs`` times over.

Targets: sources by code point (null last) weigh 1, 2, 3, repeating, and share the words of the corpus; a target stops
at ``max_epochs`` times its source's words and the excess goes to the others by weight until none is above.

Ranks of slots and places of documents are running totals in two levels (chunks of slots; hash ranges of documents),
so the largest source is spread over many tasks. Only one row a source goes to the driver. No random numbers: reruns
agree. Null and blank texts have size 0 and take nothing; null sources form one source; rows with repeated or null ids
are documents of their own; an empty table gives an empty result. Only the id, text and source columns are read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tableprep.llm.base import running_total, stage

CHUNK = 1 << 16
GOLDEN = 2654435769  # 2^32 / phi, odd
DOCS_A_RANGE = 8192


def water_fill(sizes: list[int], weights: list[int], max_epochs: int = 3) -> list[float]:
    """Shares of sum(sizes) by weight, none above max_epochs times its own size."""
    caps = [max_epochs * s for s in sizes]
    out, active, left = [0.0] * len(sizes), [i for i, c in enumerate(caps) if c > 0], float(sum(sizes))
    while active:
        total = sum(weights[i] for i in active)
        over = [i for i in active if left * weights[i] / total > caps[i]]
        if not over:
            for i in active:
                out[i] = left * weights[i] / total
            break
        for i in over:
            out[i] = float(caps[i])
        left -= sum(caps[i] for i in over)
        active = [i for i in active if i not in set(over)]
    return out


def word_count(text) -> F.Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def mix_sources(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
                block_words: int | None = None, max_epochs: int = 3) -> tuple[DataFrame, DataFrame]:
    """(per-document table, schedule).

    The first has a row a document: doc_id, source, size, source_size, target, taken and a row number ``row``. The
    schedule has a row for each piece of a document in a slot: slot, source, row, doc_id, epoch, first_word, n_words.
    """
    spark = docs.sparkSession
    sized = stage(docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"),
        word_count(F.col(text_col).cast("string")).alias("size")).withColumn("row", F.monotonically_increasing_id()))
    facts = sized.groupBy("source").agg(F.sum("size").alias("words"), F.count(F.lit(1)).alias("n")).collect()
    facts.sort(key=lambda r: (r["source"] is None, (r["source"] or "").encode("utf-8", "surrogatepass")))
    sizes = [int(r["words"]) for r in facts]
    targets = water_fill(sizes, [i % 3 + 1 for i in range(len(facts))], max_epochs)
    total, n_docs = sum(sizes), sum(r["n"] for r in facts)
    block = block_words or max(1, min(2048, total // 50_000))
    n_slots = math.ceil(total / block)
    bounds = np.cumsum(targets) / max(total, 1)
    if len(bounds):
        bounds[np.flatnonzero(np.array(targets) > 0)[-1:]] = 1.0 + 1e-9  # rounding leaves no gap at the end

    sources = spark.createDataFrame(
        [(r["source"], i, s, t) for i, (r, s, t) in enumerate(zip(facts, sizes, targets))],
        "source string, source_no int, source_size long, target double")

    def points(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            i = pdf["id"].to_numpy()
            x = ((i % (1 << 31)) * GOLDEN % (1 << 32)) / 2.0 ** 32
            yield pd.DataFrame({"slot": i, "source_no": np.searchsorted(bounds, x, "right").astype(np.int32),
                                "chunk": i // CHUNK})

    slots = spark.range(n_slots).mapInPandas(points, "slot long, source_no int, chunk long")
    ranked = running_total(slots, ["source_no"], "chunk", [F.col("slot")], F.lit(1).cast("long"), "block")
    ranked = ranked.select("slot", "source_no", "block")

    # the documents' places in their source's stream
    bits = max(0, math.ceil(math.log2(max(1, n_docs / DOCS_A_RANGE))))
    known = sized.join(F.broadcast(sources), sized["source"].eqNullSafe(sources["source"])).select(
        sized["*"], "source_no", "source_size", "target")
    shuffled = known.withColumn("order_hash", F.xxhash64(F.col("doc_id"), F.lit("mix"))).withColumn(
        "range", F.shiftright("order_hash", 64 - bits) if bits else F.lit(0).cast("long"))
    placed = running_total(shuffled, ["source_no"], "range",
                           [F.col("order_hash"), F.col("doc_id"), F.col("size"), F.col("row")], F.col("size"), "place")
    epochs = placed.where("size > 0").withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(max_epochs - 1))))
    start = F.col("epoch") * F.col("source_size") + F.col("place")
    span = epochs.select("row", "doc_id", "source", "source_no", "size", "epoch", start.alias("start"))
    span = span.where(F.col("start") < F.col("size") + n_slots * block)
    pieces = span.withColumn("block", F.explode(F.sequence(
        F.floor(F.col("start") / block).cast("long"),
        F.floor((F.col("start") + F.col("size") - 1) / block).cast("long"))))
    schedule = pieces.join(ranked, ["source_no", "block"]).select(
        "slot", "source", "row", "doc_id", "epoch",
        F.greatest(F.col("start"), F.col("block") * block).alias("from"),
        F.least(F.col("start") + F.col("size"), (F.col("block") + 1) * block).alias("to"), "start").select(
        "slot", "source", "row", "doc_id", "epoch", (F.col("from") - F.col("start")).alias("first_word"),
        (F.col("to") - F.col("from")).alias("n_words"))
    taken = schedule.groupBy("row").agg(F.sum("n_words").alias("words_taken"))
    table = known.join(taken, "row", "left").select(
        "doc_id", "source", "size", "source_size", "target", F.coalesce("words_taken", F.lit(0)).alias("taken"), "row")
    return table, schedule
