"""Helpers shared by the training-data operators: words, hashes, staging tables, two-level running totals.

Words are maximal runs outside the ASCII white space ``[\\x20\\x09-\\x0D]`` with A-Z lower-cased; ``bytes.split`` and
``bytes.lower`` do exactly that on UTF-8, whatever else the text holds.
"""

from __future__ import annotations

import hashlib
import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tableprep import session
from tableprep.session import ensure_checkpoint_dir

MASK = (1 << 64) - 1
ROW_GROUP = 16 << 20       # bytes of a staged row group
ARROW_BATCH = 8 << 20      # bytes of an Arrow batch between Spark and Python


def words(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def mix(x: np.ndarray) -> np.ndarray:
    """Finalizer that spreads every input bit over the word (wraps modulo 2^64)."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x7FB5D329728EA185)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


_SHINGLE: dict[int, np.ndarray] = {}


def odd_constants(n: int, seed: str) -> np.ndarray:
    """n odd 64-bit multipliers derived from a label, so that every run and machine agrees."""
    raw = b"".join(hashlib.blake2b(f"{seed}:{i}".encode(), digest_size=8).digest() for i in range(n))
    return np.frombuffer(raw, "<u8") | np.uint64(1)


def signed(x: np.ndarray) -> np.ndarray:
    return x.astype(np.uint64).view(np.int64)


def fresh(df: DataFrame, base: str) -> str:
    """A column name that the table does not have yet (names compare without case)."""
    taken = {c.lower() for c in df.columns}
    name = base
    while name.lower() in taken:
        name = "_" + name
    return name


def stage(df: DataFrame) -> DataFrame:
    """Write a table to the shared checkpoint folder and read it back: cuts the lineage, survives lost executors.

    Row groups are small, so that neither a writer nor a reader of long texts holds much of them at once.
    """
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark)}/{uuid.uuid4().hex}"
    df.write.option("parquet.block.size", ROW_GROUP).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def part_count(df: DataFrame) -> int:
    """Number of shuffle partitions the session asks for."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def hot_keys(counts: DataFrame, keys: list[str], total: int, n_col: str = "n", share: int = 2000) -> DataFrame:
    """(keys, salts) of the keys that hold more than ``total / share`` rows: at most ``share`` rows, small enough to send."""
    limit = max(1000, total // share)
    return counts.where(F.col(n_col) > limit).select(*keys, F.ceil(F.col(n_col) / limit).cast("int").alias("salts"))


def salted_lookup(big: DataFrame, small: DataFrame, keys: list[str], spread: Column, how: str = "inner",
                  hot: DataFrame | None = None) -> DataFrame:
    """Equi-join in which the rows of a hot key are dealt out over several tasks.

    Only keys with more than their share of the big side's rows get salts (``hot_keys``); the small side's rows of such
    a key are repeated for each salt, all others stay single. ``spread`` is an expression over the big side (its row
    identity). ``how`` is inner, left, left_semi or left_anti. ``big`` should be a staged table, as it is counted first
    (unless the caller has the counts).
    """
    if hot is None:
        hot = hot_keys(big.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")), keys, big.count())
    salt, salts = fresh(big, "salt"), fresh(big, "salts")
    side = F.broadcast(stage(hot.withColumnRenamed("salts", salts)))
    n = F.coalesce(F.col(salts), F.lit(1))
    left = big.join(side, keys, "left").withColumn(salt, F.pmod(F.xxhash64(spread), n.cast("long")).cast("int")).drop(salts)
    right = small.join(side, keys, "left").withColumn(salt, F.explode(F.sequence(F.lit(0), n - 1))).drop(salts)
    return left.join(right, [*keys, salt], how).drop(salt)


MAP_BITS = 1 << 28


class BitMap:
    """Which hashes a table may hold: two bits a hash, sized by the number of rows, at most MAP_BITS bits (32 MB).

    A member is always let through; others now and then, so an exact join has to follow. It only spares rows.
    """

    def __init__(self, hashes: DataFrame, column: str, n: int):
        self.bits = min(MAP_BITS, 1 << max(22, (32 * n).bit_length()))
        low = F.lit(self.bits - 1)
        at = hashes.select(F.explode(F.array(
            F.col(column).bitwiseAND(low), F.shiftrightunsigned(column, 32).bitwiseAND(low))).alias("at"))
        words = at.groupBy(F.floor(F.col("at") / 64).cast("long").alias("w")).agg(
            F.expr("bit_or(shiftleft(1L, cast(at % 64 as int)))").alias("v")).toArrow()
        table = np.zeros(self.bits // 64, np.int64)
        table[words.column(0).to_numpy()] = words.column(1).to_numpy()
        self.shared = hashes.sparkSession.sparkContext.broadcast(table)

    def holds(self):
        """For use in tasks: a function from hashes (uint64) to flags."""
        table, bits = self.shared.value.view(np.uint64), np.uint64(self.bits - 1)

        def bit(at: np.ndarray) -> np.ndarray:
            return ((table[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1)).astype(bool)

        def test(h: np.ndarray) -> np.ndarray:
            out = bit(h & bits)
            some = np.flatnonzero(out)
            out[some] = bit((h[some] >> np.uint64(32)) & bits)
            return out

        return test

    def __getstate__(self):
        return {"bits": self.bits, "shared": self.shared}


def id_hashes(ids: DataFrame, column: str) -> DataFrame:
    """(hash) of the non-null ids of a long column, the same as ``mix`` of them."""
    import pyarrow as pa

    def run(batches):
        for batch in batches:
            ids = batch.column(0).drop_null().to_numpy()
            yield pa.RecordBatch.from_pydict({"hash": signed(mix(ids.view(np.uint64)))})

    return ids.select(column).mapInArrow(run, "hash long")


def running_total(df: DataFrame, group: list[str], chunk: str, order: list[Column], value: Column, name: str) -> DataFrame:
    """Sum of ``value`` over the rows before each row (exclusive), in ``(chunk, order)`` order within ``group``.

    Two levels: totals of (group, chunk) are summed first, then each chunk is scanned alone, so a group that holds a
    third of all rows is spread over its chunks. The chunk has to be monotone in the order wanted.
    """
    own, before = fresh(df, "own_value"), fresh(df, "chunk_start")
    valued = df.withColumn(own, value)
    totals = valued.groupBy(*group, chunk).agg(F.sum(own).alias("chunk_sum"))
    starts = totals.select(*group, chunk, F.coalesce(
        F.sum("chunk_sum").over(Window.partitionBy(*group).orderBy(chunk).rowsBetween(Window.unboundedPreceding, -1)),
        F.lit(0)).alias(before))
    right = starts.select(*[F.col(c).alias(f"{c}__r") for c in [*group, chunk]], before)
    cond = [F.col(c).eqNullSafe(F.col(f"{c}__r")) for c in [*group, chunk]]
    inside = Window.partitionBy(*group, chunk).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    local = valued.withColumn(own, F.coalesce(F.sum(own).over(inside), F.lit(0)))
    joined = local.join(right, cond, "left")
    return joined.withColumn(name, F.col(own) + F.col(before)).drop(own, before, *[f"{c}__r" for c in [*group, chunk]])


def ship_package(spark) -> None:
    """Let Python workers import this package, and bound Arrow batches by bytes for this session.

    A batch of 10,000 rows of texts or shingle sets is tens of MB, held several times over on both sides; ARROW_BATCH
    bytes keep the memory of a task independent of how long the rows are (one row longer than that is a batch alone).
    """
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.sparkContext.getConf().get(key) is None:  # the cluster's own setting stays
        spark.conf.set(key, str(ARROW_BATCH))
    session.ship_package(spark)


# --- words of a whole batch -------------------------------------------------------------------------------------

_BASE = odd_constants(2, "word")
_BYTES = np.frombuffer(hashlib.blake2b(b"bytes").digest() * 32, "<u8")[:256].copy()
_BYTES = mix(_BYTES + np.arange(256, dtype=np.uint64) * _BASE[1])
_BYTES[ord("A"):ord("Z") + 1] = _BYTES[ord("a"):ord("z") + 1]
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_POWERS = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the odd base and of its inverse modulo 2^64, n of each at least."""
    if len(_POWERS["up"]) < n:
        size = 1 << max(16, (n - 1).bit_length())
        base = int(_BASE[0])
        for key, step in (("up", base), ("down", pow(base, -1, 1 << 64))):
            table = np.ones(1, np.uint64)
            while len(table) < size:
                table = np.concatenate((table, table * np.uint64(pow(step, len(table), 1 << 64))))
            _POWERS[key] = table
    return _POWERS["up"][:n], _POWERS["down"][:n]


def batch_word_hashes(texts) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of an Arrow string array (null: none) in order, and each text's first word (one more at the end).

    A word's hash is a polynomial over its bytes, from running sums over the whole buffer, so no word becomes a
    Python object. A-Z hash as a-z, white space separates, as in :func:`words`.
    """
    import pyarrow as pa
    texts = texts.combine_chunks() if isinstance(texts, pa.ChunkedArray) else texts
    texts = texts.fill_null("").cast(pa.large_string())
    n = len(texts)
    ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + n + 1]
    data = texts.buffers()[2]
    raw = (np.frombuffer(data, np.uint8)[ends[0]:ends[-1]] if data is not None else np.empty(0, np.uint8))
    ends = ends - ends[0]
    solid = ~_SPACE[raw]
    start = solid.copy()
    start[1:] &= ~solid[:-1]
    heads = ends[:-1][ends[:-1] < len(raw)]
    start[heads] = solid[heads]
    first = np.flatnonzero(start)
    stop = solid.copy()
    stop[:-1] &= ~solid[1:] | start[1:]
    last = np.flatnonzero(stop)
    bounds = np.searchsorted(first, ends)
    out = np.empty(len(first), np.uint64)
    piece = 1 << 18  # words at a time: the running sums stay in the cache
    i = 0
    while i < len(first):
        j = min(len(first), i + piece // 4)
        lo, hi = first[i], last[j - 1] + 1
        if hi - lo > 4 * piece and j - i > 1:  # long words: fewer of them at a time
            j = max(i + 1, int(np.searchsorted(last, lo + 4 * piece)))
            hi = last[j - 1] + 1
        up, down = _powers(int(hi - lo))
        sums = np.zeros(hi - lo + 1, np.uint64)
        np.cumsum(_BYTES[raw[lo:hi]] * up, out=sums[1:])
        f, e = first[i:j] - lo, last[i:j] + 1 - lo
        out[i:j] = (sums[e] - sums[f]) * down[f] + (e - f).astype(np.uint64) * _BASE[1]
        i = j
    return mix(out), bounds


def shingle_hashes(h: np.ndarray, width: int = 5) -> np.ndarray:
    """Sorted distinct hashes of all runs of ``width`` words; a shorter text counts as one shingle, no word as none."""
    if not len(h):
        return h
    w = min(width, len(h))
    if w not in _SHINGLE:
        _SHINGLE[w] = odd_constants(w, f"shingle{w}")
    total = h[:len(h) - w + 1] * _SHINGLE[w][0]
    for i in range(1, w):
        total += h[i:len(h) - w + 1 + i] * _SHINGLE[w][i]
    return np.unique(mix(total))
