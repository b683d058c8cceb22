"""Line dedup over documents (operator 2): explode, hash, count documents a hash, drop, reassemble by position.

A text is split at ``\\n`` (null or empty: one empty line). A line's key is the line without ASCII white space
``[\\x20\\x09-\\x0D]`` at both ends and with A-Z lower-cased. A key of at least ``min_chars`` code points that occurs in
at least two documents loses all its lines except in the smallest doc_id that holds it.

Each document sends one row a distinct key (128-bit digest, no text), so a key repeated within a document counts once.
Keys are grouped by partial minima and maxima of doc_id, the few shared keys meet the rows again in a salted join, and
each document gets the list of keys it has to drop, which is no longer than its lines. Text moves once, to that list.

Repeated doc_ids count as one document. Rows with a null doc_id hold nothing and lose nothing. Only the id and text
columns are read. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tableprep.llm.base import hot_keys, salted_lookup, stage

SPACE = " \t\n\x0b\x0c\r"


def line_keys(text: str | None, min_chars: int) -> list[bytes | None]:
    """For each line the digest of its key, None where the key is too short to count."""
    out = []
    for line in (text or "").split("\n"):
        line = line.strip(SPACE)
        out.append(hashlib.blake2b(line.encode("utf-8", "surrogatepass").lower(), digest_size=16).digest()
                   if len(line) >= min_chars else None)
    return out


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 10,
                with_text: bool = True) -> DataFrame:
    """One row a document: doc_id, n_lines, n_dropped, kept_sha256 and, if asked for, the kept text."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, keys = [], []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                own = set(line_keys(text, min_chars))
                own.discard(None)
                keys.extend(own)
                ids.extend([doc] * len(own))
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(ids, pa.int64())], ["key", "doc_id"])

    held = stage(rows.where("doc_id is not null").mapInArrow(explode, "key binary, doc_id long"))
    shared = stage(held.groupBy("key").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"),
                                           F.count(F.lit(1)).alias("n")).where("first < last"))
    hot = hot_keys(shared, ["key"], held.count())
    drops = (salted_lookup(held, shared.select("key", "first"), ["key"], F.col("doc_id"), hot=hot)
             .where("doc_id <> first").distinct()
             .groupBy("doc_id").agg(F.collect_list("key").alias("drop")))

    def reassemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_lines, n_dropped, digests, texts = [], [], [], []
            for text, drop in zip(batch.column("text").to_pylist(), batch.column("drop").to_pylist()):
                lines = (text or "").split("\n")
                if drop:
                    gone = set(drop)
                    kept = [x for x, k in zip(lines, line_keys(text, min_chars)) if k not in gone]
                else:
                    kept = lines
                joined = "\n".join(kept) if len(kept) < len(lines) else (text or "")
                n_lines.append(len(lines))
                n_dropped.append(len(lines) - len(kept))
                digests.append(hashlib.sha256(joined.encode("utf-8", "surrogatepass")).hexdigest())
                texts.append(joined)
            cols = [batch.column("doc_id"), pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64()),
                    pa.array(digests, pa.string())]
            names = ["doc_id", "n_lines", "n_dropped", "kept_sha256"]
            if with_text:
                cols, names = [*cols, pa.array(texts, pa.string())], [*names, "kept_text"]
            yield pa.RecordBatch.from_arrays(cols, names)

    schema = "doc_id long, n_lines long, n_dropped long, kept_sha256 string" + (", kept_text string" if with_text else "")
    return rows.join(drops, "doc_id", "left").mapInArrow(reassemble, schema)
