"""Token ids in binary shards of patched frame-of-reference blocks (operator 9).

``write_shards`` sorts the documents by id over range partitions, encodes each text with a public tokenizer, appends
the end id and packs the ids of each partition into one shard file; ``read_shards`` decodes the files again.

Shard file (little-endian), a stream of frames, each followed by one newline byte that the file writer adds:

* frame: blocks of ``BLOCK`` ids (the shard's last block may be short). A block is a 12-byte head
  ``minimum u32, count u16, width u8, exceptions u16, pad u8, words u16``, then ``words`` 64-bit words with
  ``id - minimum`` in ``width`` bits each (the low bits where it does not fit), then the exceptions: positions ``u16``
  and full differences ``u32``. The width is the one that holds ``PERCENTILE`` % of the block's differences.
* footer, the last frame: start of each block in the file ``u64``, doc ids ``i64``, null flags ``u8``, ids a document
  ``u64``, then 40 bytes: blocks, documents, ids of the shard, shard number (``u64`` big-endian, so that a reader
  can take them with SQL functions) and the magic ``PFORBLK1``.

Empty and null texts hold the end id alone. Documents with a null id come last; rows that repeat an id keep their own
rows, ordered by text. An empty table writes no shard and reads back as no row. Only the id and text columns are
read, so extra columns with any names do no harm. A task holds one frame and one footer, never a whole table.
"""

from __future__ import annotations

import codecs
import itertools
import re
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tableprep.llm.base import part_count
from tableprep.session import ensure_checkpoint_dir

BLOCK = 512
PERCENTILE = 90
FRAME_IDS = 1 << 18
MAGIC = b"PFORBLK1"
TAIL = 40
DECODED = "doc_id long, shard long, start_in_shard long, n_tokens long, ids_crc32 long, ids binary"


# --- blocks -----------------------------------------------------------------------------------------------------

def _packed(diff: np.ndarray, width: int) -> np.ndarray:
    """The low ``width`` bits of each value, 64 values to ``width`` words, one row a block."""
    if not width:
        return np.zeros((len(diff), 0), np.uint64)
    lanes = np.ascontiguousarray(diff.reshape(-1, 64).T) & np.uint64((1 << width) - 1)
    words = np.zeros((width, lanes.shape[1]), np.uint64)
    for i in range(64):
        word, shift = divmod(i * width, 64)
        words[word] |= lanes[i] << np.uint64(shift)
        if shift + width > 64:
            words[word + 1] |= lanes[i] >> np.uint64(64 - shift)
    return np.ascontiguousarray(words.T).reshape(len(diff), -1)


def _unpacked(words: np.ndarray, width: int) -> np.ndarray:
    lanes = np.ascontiguousarray(words.reshape(-1, width).T)
    out, keep = np.empty((64, lanes.shape[1]), np.uint64), np.uint64((1 << width) - 1)
    for i in range(64):
        word, shift = divmod(i * width, 64)
        value = lanes[word] >> np.uint64(shift)
        if shift + width > 64:
            value |= lanes[word + 1] << np.uint64(64 - shift)
        out[i] = value & keep
    return np.ascontiguousarray(out.T).reshape(len(words), BLOCK)


def pack_blocks(ids: np.ndarray, percentile: int = PERCENTILE) -> list[bytes]:
    """Blocks of up to BLOCK ids as bytes, in order."""
    n = len(ids)
    if not n:
        return []
    rows = -(-n // BLOCK)
    grid = np.full(rows * BLOCK, ids[-1], np.uint32)
    grid[:n] = ids
    grid = grid.reshape(rows, BLOCK)
    counts = np.full(rows, BLOCK)
    counts[-1] = n - (rows - 1) * BLOCK
    low = grid.min(axis=1)
    diff = grid - low[:, None]
    rank = (BLOCK - 1) * percentile // 100
    width = np.frexp(np.partition(diff, rank, axis=1)[:, rank].astype(np.float64))[1]
    over = (diff.astype(np.uint64) >> width[:, None].astype(np.uint64)) != 0
    n_over = over.sum(axis=1)
    where = np.nonzero(over)[1].astype("<u2").tobytes()
    extra = diff[over].astype("<u4").tobytes()
    ends = np.cumsum(n_over)
    out: list[bytes] = [b""] * rows
    for w in np.unique(width).tolist():
        pick = np.flatnonzero(width == w)
        packed = _packed(diff[pick].astype(np.uint64), w).astype("<u8")
        n_words, body = packed.shape[1], packed.tobytes()
        for j, row in enumerate(pick.tolist()):
            k, e = int(n_over[row]), int(ends[row])
            out[row] = b"".join((HEAD.pack(low[row], counts[row], w, k, 0, n_words),
                                 body[8 * n_words * j:8 * n_words * (j + 1)],
                                 where[2 * (e - k):2 * e], extra[4 * (e - k):4 * e]))
    return out


HEAD = struct.Struct("<IHBHBH")


def unpack_blocks(buffer: memoryview, starts: np.ndarray) -> np.ndarray:
    """Ids of the blocks at ``starts``, concatenated in order."""
    if not len(starts):
        return np.empty(0, np.uint32)
    raw = np.frombuffer(buffer, np.uint8)
    heads = raw[starts[:, None] + np.arange(HEAD.size)]
    low = heads[:, 0:4].copy().view("<u4")[:, 0]
    count = heads[:, 4:6].copy().view("<u2")[:, 0].astype(np.int64)
    width = heads[:, 6]
    n_over = heads[:, 7:9].copy().view("<u2")[:, 0].astype(np.int64)
    grid = np.zeros((len(starts), BLOCK), np.uint32)
    for w in np.unique(width).tolist():
        pick = np.flatnonzero(width == w)
        if w:
            size = BLOCK * w // 8
            words = np.frombuffer(b"".join(buffer[s:s + size] for s in (starts[pick] + HEAD.size).tolist()), "<u8")
            grid[pick] = _unpacked(words.astype(np.uint64).reshape(len(pick), -1), w)
    for row in np.flatnonzero(n_over).tolist():
        k, at = int(n_over[row]), int(starts[row]) + HEAD.size + BLOCK * int(width[row]) // 8
        grid[row, np.frombuffer(buffer, "<u2", k, at)] = np.frombuffer(buffer, "<u4", k, at + 2 * k)
    grid += low[:, None]
    if count.min() == BLOCK:
        return grid.ravel()
    return grid[np.arange(BLOCK) < count[:, None]]


# --- encoding ---------------------------------------------------------------------------------------------------

class ChunkEncoder:
    """Encodes texts piece by piece, each distinct piece once.

    Exact for tokenizers that drop white space and never merge across it: a text's ids are the ids of its pieces, so
    those are remembered (up to ``limit`` pieces). Pieces are the chunks between ASCII white space, with punctuation
    that ends a chunk cut off behind a plain letter, as the tokenizer's own rule does; behind any other letter a mark may
    come out of composing or lower-casing, which the tokenizer joins with the punctuation, so such chunks stay whole. A piece of plain letters goes straight
    to the tokenizer's model, any other through the whole tokenizer. The tests compare with whole-text encoding.
    """

    #: letters below U+0250 that lower-casing and composing leave as single letters
    LETTER = "[a-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u0148\u014a-\u017f]"
    PLAIN = re.compile(LETTER + "+")
    CUT = f"({LETTER})" + r"([.,;:!?*%&#$|]+)([\t-\r ]|$)"

    def __init__(self, path: str, limit: int = 300_000):
        from tokenizers import Tokenizer
        self.tokenizer, self.limit = Tokenizer.from_file(path), limit
        self.model = self.tokenizer.model
        self._reset()
        samples = ["a", "the", "word", "\u00e9t\u00e9", "stra\u00dfe", "\u0142\u00f3d\u017a", "unbelievably"]
        self.plain = [self._core(x) for x in samples] == self._whole(samples) == [
            x[:-1] for x in self._whole([x.upper() + "." if x != "stra\u00dfe" else x + "." for x in samples])]

    def _reset(self) -> None:
        self.at: dict[str, int] = {}
        self.flat, self.starts, self.counts = np.empty(0, np.uint32), np.empty(0, np.int64), np.empty(0, np.int64)

    def _whole(self, pieces: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch(pieces, add_special_tokens=False)]

    def _core(self, letters: str) -> list[int]:
        if not letters.isascii():
            letters = codecs.charmap_decode(letters.lower().encode(), "strict", _BYTE_LEVEL)[0]
        return [t.id for t in self.model.tokenize(letters)]

    def _learn(self, new: list[str]) -> None:
        core, match = self._core, self.PLAIN.fullmatch
        lists = [core(x) if match(x) else None for x in new] if self.plain else [None] * len(new)
        hard = [i for i, x in enumerate(lists) if x is None]
        for i, ids in zip(hard, self._whole([new[i] for i in hard])):
            lists[i] = ids
        counts = np.fromiter(map(len, lists), np.int64, len(lists))
        base = len(self.flat) + np.concatenate(([0], np.cumsum(counts)[:-1]))
        flat = np.fromiter(itertools.chain.from_iterable(lists), np.uint32, int(counts.sum()))
        self.flat = np.concatenate((self.flat, flat))
        self.starts, self.counts = np.concatenate((self.starts, base)), np.concatenate((self.counts, counts))
        self.at.update(zip(new, range(len(self.at), len(self.at) + len(new))))

    def encode(self, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts (null: none) with ``end_id`` after each, and the number of ids a text."""
        texts = pc.fill_null(texts, "")
        if self.plain:  # special tokens are written in one case only, so their texts keep theirs
            texts = pc.if_else(pc.match_substring(texts, "<|"), texts, pc.ascii_lower(texts))
            texts = pc.replace_substring_regex(texts, self.CUT, r"\1 \2\3")
        lists = pc.ascii_split_whitespace(texts)
        bounds = lists.offsets.to_numpy().astype(np.int64)
        coded = lists.values.dictionary_encode()
        names = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        if len(self.at) > self.limit:
            self._reset()
        known = self.at.get
        index = np.fromiter((known(x, -1) for x in names), np.int64, len(names))
        missing = np.flatnonzero(index < 0)
        if len(missing):
            index[missing] = len(self.at) + np.arange(len(missing))
            self._learn([names[i] for i in missing.tolist()])
        index = index[coded.indices.to_numpy()]
        lens = self.counts[index]
        ends = np.concatenate(([0], np.cumsum(lens)))
        n_tokens = ends[bounds[1:]] - ends[bounds[:-1]] + 1
        total = int(ends[-1])
        source = np.repeat(self.starts[index] - ends[:-1], lens)
        source += np.arange(total)
        ids = np.empty(total + len(texts), np.uint32)
        last = np.cumsum(n_tokens) - 1
        body = np.ones(len(ids), bool)
        body[last] = False
        ids[body], ids[last] = self.flat[source], end_id
        return ids, n_tokens


def _byte_level() -> str:
    """The printable characters that byte-level vocabularies use for the 256 bytes."""
    keep = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in keep]
    names = {b: chr(b) for b in keep} | {b: chr(256 + i) for i, b in enumerate(rest)}
    return "".join(names[b] for b in range(256))


_BYTE_LEVEL = _byte_level()
_ENCODERS: dict[str, ChunkEncoder] = {}


def _encoder(path: str) -> ChunkEncoder:
    if path not in _ENCODERS:
        import os
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        _ENCODERS[path] = ChunkEncoder(path)
    return _ENCODERS[path]


def _small_batches(texts: pa.Array, chars: int = 2_000_000) -> Iterator[tuple[int, int]]:
    """Row ranges of up to ``chars`` characters (one row at least), so that a batch of long texts stays small."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False))
    i = 0
    while i < len(texts):
        j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + chars, "right")))
        yield i, min(j, len(texts))
        i = j


# --- shards -----------------------------------------------------------------------------------------------------

def write_shards(docs: DataFrame, path: str, tokenizer_path: str, end_id: int = 2, id_col: str = "doc_id",
                 text_col: str = "text", n_shards: int | None = None) -> None:
    """Write all documents in ascending id order to shard files under ``path`` (any file system Spark writes to).

    The writer commits a task's file only once, so a lost executor's task is simply run again.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    order = [F.col("doc_id").asc_nulls_last(), F.col("text").asc_nulls_first()]
    ranged = rows.repartitionByRange(n_shards or part_count(docs), F.col("doc_id").asc_nulls_last())

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(tokenizer_path)
        at, total = 0, 0
        starts, doc_ids, nulls, counts = [], [], [], []
        rest = np.empty(0, np.uint32)

        def frame(ids: np.ndarray) -> pa.RecordBatch:
            nonlocal at
            blocks = pack_blocks(ids)
            sizes = np.fromiter(map(len, blocks), np.int64, len(blocks))
            starts.append(at + np.concatenate(([0], np.cumsum(sizes)[:-1])))
            payload = b"".join(blocks)
            at += len(payload) + 1
            return pa.RecordBatch.from_pydict({"value": pa.array([payload], pa.binary())})

        for batch in batches:
            texts = batch.column(1)
            for i, j in _small_batches(texts):
                ids, n = encoder.encode(texts.slice(i, j - i), end_id)
                keys = batch.column(0).slice(i, j - i)
                doc_ids.append(keys.fill_null(0).to_numpy())
                nulls.append(keys.is_null().to_numpy(zero_copy_only=False).astype(np.uint8))
                counts.append(n)
                total += len(ids)
                rest = np.concatenate((rest, ids))
                while len(rest) >= FRAME_IDS:
                    yield frame(rest[:FRAME_IDS])
                    rest = rest[FRAME_IDS:]
        if len(rest):
            yield frame(rest)
        if counts:
            index = np.concatenate(starts)
            n_docs = sum(map(len, counts))
            tail = struct.pack(">QQQQ", len(index), n_docs, total, TaskContext.get().partitionId()) + MAGIC
            footer = (index.astype("<u8").tobytes() + np.concatenate(doc_ids).astype("<i8").tobytes()
                      + np.concatenate(nulls).tobytes() + np.concatenate(counts).astype("<u8").tobytes() + tail)
            yield pa.RecordBatch.from_pydict({"value": pa.array([footer], pa.binary())})

    frames = ranged.sortWithinPartitions(*order).mapInArrow(encode, "value binary")
    # the text writer copies a value's bytes as they are, and ends each with one newline
    frames.select(F.col("value").cast("string").alias("value")).write.text(path)


def shard_files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).where(F.col("length") > TAIL)


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """One row a shard from its footer: number, blocks, documents, ids, and the ids of all shards before it."""
    from pyspark.sql import Window

    def number(k: int):
        return F.conv(F.hex(F.expr(f"substring(content, {-TAIL - 1 + 8 * k}, 8)")), 16, 10).cast("long")

    one = shard_files(spark, path).select(number(3).alias("shard"), number(0).alias("n_blocks"),
                                          number(1).alias("n_docs"), number(2).alias("n_ids"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # one row a shard
    return one.withColumn("first_id", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))


def read_shards(spark: SparkSession, path: str, with_ids: bool = True) -> DataFrame:
    """One row a document, decoded from the files: its ids (little-endian u32), their crc32 and place in the shard."""

    def decode(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for content in pdf["content"]:
                buffer = memoryview(content)
                n_blocks, n_docs, total, shard = struct.unpack(">QQQQ", buffer[-TAIL - 1:-9])
                if bytes(buffer[-9:-1]) != MAGIC:
                    raise ValueError("not a shard file")
                at = len(buffer) - TAIL - 1 - 8 * n_blocks - 17 * n_docs
                starts = np.frombuffer(buffer, "<u8", n_blocks, at).astype(np.int64)
                keys = np.frombuffer(buffer, "<i8", n_docs, at + 8 * n_blocks)
                null = np.frombuffer(buffer, np.uint8, n_docs, at + 8 * n_blocks + 8 * n_docs).astype(bool)
                counts = np.frombuffer(buffer, "<u8", n_docs, at + 8 * n_blocks + 9 * n_docs).astype(np.int64)
                ends = np.cumsum(counts)
                done, block, held, base = 0, 0, np.empty(0, np.uint32), 0
                while done < n_docs:  # some documents at a time: their blocks, then their slices
                    upto = max(done + 1, int(np.searchsorted(ends, base + 4 * FRAME_IDS, "right")))
                    need = -(-int(ends[upto - 1]) // BLOCK)
                    fresh_ids = [held]
                    frames_at = FRAME_IDS // BLOCK
                    while block < need:
                        step = min(need, (block // frames_at + 1) * frames_at)
                        fresh_ids.append(unpack_blocks(buffer, starts[block:step]))
                        block = step
                    ids = np.concatenate(fresh_ids)
                    own = ends[done:upto] - base
                    rows = [ids[s:e].astype("<u4").tobytes() for s, e in zip(np.concatenate(([0], own[:-1])), own)]
                    yield pd.DataFrame({
                        "doc_id": pd.array(keys[done:upto], "Int64") if not null.any() else pd.arrays.IntegerArray(
                            keys[done:upto].copy(), null[done:upto].copy()),
                        "shard": shard, "start_in_shard": ends[done:upto] - counts[done:upto],
                        "n_tokens": counts[done:upto], "ids_crc32": [zlib.crc32(r) for r in rows],
                        "ids": rows if with_ids else [b""] * len(rows)})
                    held, base, done = ids[int(own[-1]):], int(ends[upto - 1]), upto

    return shard_files(spark, path).select("content").mapInPandas(decode, DECODED)


def encode_documents(docs: DataFrame, tokenizer_path: str, end_id: int = 2, id_col: str = "doc_id",
                     text_col: str = "text", path: str | None = None, with_ids: bool = False) -> DataFrame:
    """Write the shards, read them back and place each document in the whole stream (``start``)."""
    spark = docs.sparkSession
    path = path or f"{ensure_checkpoint_dir(spark)}/shards-{uuid.uuid4().hex}"
    write_shards(docs, path, tokenizer_path, end_id, id_col, text_col)
    shards = F.broadcast(manifest(spark, path).select("shard", "first_id"))  # two numbers a shard file
    rows = read_shards(spark, path, with_ids).join(shards, "shard")
    out = rows.select("doc_id", (F.col("first_id") + F.col("start_in_shard")).alias("start"), "n_tokens", "ids_crc32",
                      "shard", *(["ids"] if with_ids else []))
    return out
