"""Statistics by slot of sparse rows, as tables keyed by slot, and their use on rows in blocks.

A wide sparse block (one-hot of a near-unique column, a large vocabulary) has as many slots as the data has values. Dense
buffers of that width in every task, or arrays of it on the driver, stop at some size. Here a row is its non-zero entries,
a statistic is a table with one row a slot that occurs, and what the missing zeros contribute is added by formula: no task
holds more than its entries, and no slot table reaches the driver.

* :func:`slot_statistics`: count, mean, variance, minimum and maximum from one partial aggregate by slot.
* :func:`grouped_quantiles`: exact quantiles by key. Brackets around the wanted order statistics are a table keyed by
  (key, target); a round narrows the wide ones by one sketch and one count, each a partial aggregate by key, until a bracket
  has no more rows than a task sorts. Then each row goes once to the bracket that holds it, in as many tasks as there are
  rows for. The plan has the same size for one key and for a million, and a key with most of the rows is narrowed first.
* :func:`slot_table` and :class:`SlotScaler`: shift-free scaling and variance selection. Rows are dealt out in blocks,
  each block meets only the slots it holds, and rows stay whole: the table is joined by slot to the blocks, never to rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml import Estimator, Model
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tableprep.operators.terms import sparse_vectors
from tableprep.persist import Saved
from tableprep.session import cut_lineage, ship_package

GRID = 64                  # a round narrows a bracket about GRID times
INSIDE = 500_000           # a bracket with at most so many rows is sorted, and a task sorts about so many
BRACKETS_SENT = 100_000    # so many brackets are sent to all tasks, more are joined by key
BLOCK_ROWS = 4096
WIDE = 4096                # vectors of more slots are handled by their entries, without a name a slot in the schema


def entries(df: DataFrame, col: str, *keep: str) -> DataFrame:
    """(keep..., slot, value) of the non-zero entries of a vector column, sparse or dense."""
    raw = df.select(*keep, F.unwrap_udt(F.col(col)).alias("_v"))
    sparse = F.zip_with("_v.indices", "_v.values", lambda i, x: F.struct(i.cast("long").alias("slot"), x.alias("value")))
    dense = F.transform("_v.values", lambda x, i: F.struct(i.cast("long").alias("slot"), x.alias("value")))
    pairs = F.when(F.col("_v.type") == 0, sparse).otherwise(dense)
    return raw.select(*keep, F.explode(pairs).alias("_e")).select(*keep, "_e.slot", "_e.value").where("value <> 0")


def vector_parts(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows, slots and values of the stored entries of unwrapped vectors, sparse or dense."""
    values = column.field("values")
    n = values.value_lengths().fill_null(0).to_numpy()
    row = np.repeat(np.arange(len(column)), n)
    slot = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
    sparse = np.repeat(column.field("type").to_numpy(zero_copy_only=False) == 0, n)
    slot[sparse] = column.field("indices").flatten().to_numpy()
    return row, slot, values.flatten().to_numpy()


def kept_slots(col: str, keep: list[int]) -> Column:
    """The slots ``keep`` (ascending) of a vector column as sparse vectors; the work of a row follows its entries, where a
    ``VectorSlicer`` looks for each kept slot in each row."""
    wanted = np.array(keep, np.int64)

    def vectors(column: pa.Array) -> pa.Array:
        row, slot, value = vector_parts(column)
        at = np.searchsorted(wanted, slot)
        inside = wanted[np.minimum(at, len(wanted) - 1)] == slot
        offsets = np.r_[0, np.cumsum(np.bincount(row[inside], minlength=len(column)))].astype(np.int32)
        return sparse_vectors(offsets, at[inside].astype(np.int32), value[inside], len(wanted))

    vectors.__annotations__ = {"column": pa.Array, "return": pa.Array}
    return F.arrow_udf(vectors, VectorUDT())(F.unwrap_udt(F.col(col)))


def is_sparse(df: DataFrame, col: str) -> bool:
    """Whether the rows of a vector column hold their non-zero entries only (told by one row)."""
    first = df.select(F.unwrap_udt(F.col(col)).alias("v")).where("v is not null").select("v.type").first()
    return first is not None and first[0] == 0


def rows_and_width(df: DataFrame, col: str) -> tuple[int, int]:
    v = F.unwrap_udt(F.col(col))
    row = df.agg(F.count(F.lit(1)), F.max(F.coalesce(v["size"], F.size(v["values"])))).first()
    return row[0], row[1] or 0


def slot_statistics(rows: DataFrame, n: int, key: str = "slot", value: str = "value") -> DataFrame:
    """(slot, n_entries, mean, variance, min, max) over ``n`` rows whose non-zero entries are given.

    With k of n entries of mean m and variance v: mean k m / n, variance k / n (v + m^2 (1 - k / n)), both free of
    cancellation; a slot with fewer than n entries also has the value 0.
    """
    some = rows.groupBy(key).agg(F.count(value).alias("n_entries"), F.avg(value).alias("_m"), F.var_pop(value).alias("_v"),
                                 F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    share = F.col("n_entries") / F.lit(float(n))
    zero = F.when(F.col("n_entries") < n, F.lit(0.0))
    return some.select(key, "n_entries", (share * F.col("_m")).alias("mean"),
                       (share * (F.col("_v") + F.col("_m") * F.col("_m") * (1 - share))).alias("variance"),
                       F.least("_lo", zero).alias("min"), F.greatest("_hi", zero).alias("max"))


# --- exact quantiles by key -------------------------------------------------------------------------------------

def grouped_quantiles(rows: DataFrame, key: str, value: str, probs: list[float], n: int | None = None,
                      inside: int = INSIDE, grid: int = GRID) -> DataFrame:
    """(key, prob, quantile): exact, linearly interpolated, for every key (null and NaN values do not count).

    With ``n`` given, each key stands for ``n`` values of which only the non-zero ones are rows: its zeros are counted,
    not stored. Rows and brackets meet in a join by key, and Spark broadcasts the brackets while they are small.
    """
    data = rows.select(F.col(key).alias("key"), F.col(value).cast("double").alias("v")).where("v is not null and not isnan(v)")
    data = data.where("v <> 0") if n is not None else data
    sizes = data.groupBy("key").agg(F.count(F.lit(1)).alias("m"), F.count_if(F.col("v") < 0).alias("negative"))
    zeros = F.lit(n) - F.col("m") if n is not None else F.lit(0).cast("long")
    at = F.explode(F.array(*[F.struct(F.lit(i).alias("t"), F.lit(float(p)).alias("prob")) for i, p in enumerate(probs)]))
    wanted = sizes.select("key", "m", "negative", zeros.alias("zeros"), at.alias("a")).select(
        "key", "m", "negative", "zeros", "a.*").withColumn("pos", F.col("prob") * (F.col("m") + F.col("zeros") - 1))
    wanted = wanted.withColumn("k", F.floor("pos").cast("long")).withColumn("frac", F.col("pos") - F.col("k"))
    wanted = wanted.select("key", "m", "negative", "zeros", "t", "prob", "frac", F.explode(
        F.when(F.col("frac") > 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("up"),
        "k").withColumn("rank", F.col("k") + F.col("up"))
    # ranks among the stored values; a rank among the zeros is answered at once
    below_zero, past_zero = F.col("rank") < F.col("negative"), F.col("rank") >= F.col("negative") + F.col("zeros")
    state = wanted.select(
        "key", "t", "up", "prob", "frac", F.when(below_zero, F.col("rank")).when(past_zero, F.col("rank") - F.col("zeros"))
        .alias("rank"), F.lit(None).cast("double").alias("lo"), F.lit(None).cast("double").alias("hi"),
        F.lit(0).cast("long").alias("below"), F.col("m").alias("inside"),
        F.when(~below_zero & ~past_zero, F.lit(0.0)).alias("found"))
    state = cut_lineage(state)
    while state.where(F.col("found").isNull() & (F.col("inside") > inside)).limit(1).count():
        state = cut_lineage(_narrowed(data, state, inside, grid))
    state = _sorted_out(data, state)
    out = state.groupBy("key", "t", "prob").agg(
        F.max(F.when(F.col("up") == 0, F.col("found"))).alias("a"), F.max(F.when(F.col("up") == 1, F.col("found"))).alias("b"),
        F.max("frac").alias("frac"))
    value_at = F.col("a") + F.when(F.col("b").isNotNull(), (F.col("b") - F.col("a")) * F.col("frac")).otherwise(0.0)
    return out.select(F.col("key").alias(key), "prob", value_at.alias("quantile"))


def _within(lo: Column, hi: Column, v: Column) -> Column:
    return (lo.isNull() | (v > lo)) & (hi.isNull() | (v < hi))


def _narrowed(data: DataFrame, state: DataFrame, inside: int, grid: int) -> DataFrame:
    """One round: two values around each wide bracket's rank, counted exactly, become an answer or the new bracket."""
    wide = F.col("found").isNull() & (F.col("inside") > inside)
    todo = state.where(wide).select("key", "t", "up", "rank", "lo", "hi", "below", "inside")
    steps = [i / grid for i in range(grid + 1)]
    once = todo.groupBy("key", "lo", "hi").agg(F.collect_list(F.struct("t", "up")).alias("of"),
                                               F.min(F.struct("t", "up")).alias("b"))
    met = data.join(once, "key").where(_within(F.col("lo"), F.col("hi"), F.col("v")))
    sketch = met.groupBy("key", "b").agg(F.percentile_approx("v", steps, 40 * grid).alias("g"))
    sketch = once.select("key", "b", F.explode("of").alias("o")).join(sketch, ["key", "b"]).select("key", "o.*", "g")
    place = (F.col("rank") - F.col("below")) / F.col("inside") * grid
    picked = todo.join(sketch, ["key", "t", "up"]).select(
        "*", F.get("g", F.greatest(F.floor(place) - 1, F.lit(0)).cast("int")).alias("x"),
        F.get("g", F.least(F.floor(place) + 2, F.lit(grid)).cast("int")).alias("y")).drop("g")
    counted = data.join(picked, "key").where(_within(F.col("lo"), F.col("hi"), F.col("v")))
    v, x, y = F.col("v"), F.col("x"), F.col("y")
    got = counted.groupBy("key", "t", "up").agg(
        F.first("x").alias("x"), F.first("y").alias("y"), F.count_if(v < x).alias("n_low"), F.count_if(v == x).alias("n_x"),
        F.count_if((v > x) & (v < y)).alias("n_mid"), F.count_if((v == y) & (y > x)).alias("n_y"))
    s = state.where(wide).join(got, ["key", "t", "up"])
    r, low = F.col("rank"), F.col("below") + F.col("n_low")
    past_x = low + F.col("n_x")
    past_mid = past_x + F.col("n_mid")
    past_y = past_mid + F.col("n_y")
    case = (F.when(r < low, 0).when(r < past_x, 1).when(r < past_mid, 2).when(r < past_y, 3).otherwise(4))
    s = s.withColumn("case", case).select(
        "key", "t", "up", "prob", "frac", "rank",
        F.when(F.col("case") == 2, x).when(F.col("case") == 4, y).otherwise(F.col("lo")).alias("lo"),
        F.when(F.col("case") == 0, x).when(F.col("case") == 2, y).otherwise(F.col("hi")).alias("hi"),
        F.when(F.col("case") == 2, past_x).when(F.col("case") == 4, past_y).otherwise(F.col("below")).alias("below"),
        F.when(F.col("case") == 0, F.col("n_low")).when(F.col("case") == 2, F.col("n_mid")).when(
            F.col("case") == 4, F.col("inside") - (past_y - F.col("below"))).otherwise(0).alias("inside"),
        F.when(F.col("case") == 1, x).when(F.col("case") == 3, y).alias("found"))
    return state.where(~wide).unionByName(s)


def _sorted_out(data: DataFrame, state: DataFrame) -> DataFrame:
    """Brackets with few rows: the rows of each in order, and the values at the wanted ranks.

    A bracket that several ranks share (all of a key that was not narrowed) gets its rows once. Rows are dealt out by
    their number, not by their bytes, so a task sorts about INSIDE of them however many there are.
    """
    few = cut_lineage(state.where("found is null").groupBy("key", "lo", "hi").agg(
        F.min(F.struct("t", "up")).alias("b"), F.first("below").alias("below"), F.first("inside").alias("inside"),
        F.collect_list(F.struct("t", "up", "rank")).alias("wanted")).select(
        "key", F.col("b.t").alias("t"), F.col("b.up").alias("up"), "lo", "hi", "below", "inside", "wanted"))
    n, total = few.agg(F.count(F.lit(1)), F.coalesce(F.sum("inside"), F.lit(0))).first()
    sent = F.broadcast if n <= BRACKETS_SENT else (lambda df: df)
    met = data.join(sent(few.select("key", "t", "up", "lo", "hi")), "key").where(_within(F.col("lo"), F.col("hi"), F.col("v")))
    dealt = met.select("key", "t", "up", "v").repartition(max(1, -(-total // INSIDE)), "key", "t", "up")
    place = F.row_number().over(Window.partitionBy("key", "t", "up").orderBy("v")).cast("long") - 1
    placed = dealt.withColumn("place", place).join(sent(few.select("key", "t", "up", "below", "wanted")), ["key", "t", "up"])
    hit = F.filter("wanted", lambda w: w["rank"] == F.col("below") + F.col("place"))
    answers = placed.select("key", (F.col("v") + F.lit(0.0)).alias("answer"), F.explode(hit).alias("w")).select(
        "key", "w.t", "w.up", "answer")
    return state.join(answers, ["key", "t", "up"], "left").withColumn("found", F.coalesce("found", "answer")).drop("answer")


# --- scaling and selection of rows in blocks ------------------------------------------------------------------------

def slot_table(stats: DataFrame, threshold: float | None = None, scale: bool = True) -> DataFrame:
    """(slot, divisor, keep) from :func:`slot_statistics`: the standard deviation (1 where there is no spread), and whether
    the variance, before scaling, exceeds ``threshold``. A slot without a row is constant: it scales nothing and goes."""
    spread = F.sqrt("variance")
    divisor = F.when(spread > 0, spread).otherwise(1.0) if scale else F.lit(1.0)
    keep = F.col("variance") > threshold if threshold is not None else F.lit(True)
    return stats.select("slot", divisor.alias("divisor"), keep.alias("keep"))


class SlotScaler(Estimator):
    """Standard scaling and variance selection of rows given as (slots array<long>, values array<double>)."""

    def __init__(self, id_col: str, slots_col: str = "slots", values_col: str = "values", threshold: float | None = None,
                 scale: bool = True):
        super().__init__()
        self.id_col, self.slots_col, self.values_col = id_col, slots_col, values_col
        self.threshold, self.scale = threshold, scale

    def _fit(self, df: DataFrame) -> "SlotScalerModel":
        pairs = df.select(F.explode(F.arrays_zip(F.col(self.slots_col).alias("slot"), F.col(self.values_col).alias("value")))
                          .alias("e")).select("e.slot", "e.value").where("value <> 0")
        table = cut_lineage(slot_table(slot_statistics(pairs, df.count()), self.threshold, self.scale))
        return SlotScalerModel(self.id_col, self.slots_col, self.values_col, table)


class SlotScalerModel(Saved, Model):
    def __init__(self, id_col, slots_col, values_col, table):
        super().__init__()
        self.id_col, self.slots_col, self.values_col, self.table = id_col, slots_col, values_col, table

    def _transform(self, df: DataFrame) -> DataFrame:
        """The rows (id, slots, values) with kept slots only and scaled values."""
        ship_package(df.sparkSession)
        rows = cut_lineage(df.select(F.col(self.id_col).alias("id"), F.col(self.slots_col).alias("slots"),
                                     F.col(self.values_col).alias("values")))
        n_blocks = max(1, -(-rows.count() // BLOCK_ROWS))
        rows = rows.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(n_blocks)))
        held = rows.select(F.col("block").alias("of_block"), F.explode("slots").alias("slot")).distinct()
        params = held.join(self.table.where("keep"), "slot").select("of_block", "slot", "divisor")
        id_type = rows.schema["id"].dataType.simpleString()
        out = rows.groupBy("block").cogroup(params.groupBy("of_block")).applyInArrow(
            _scaled_block, f"id {id_type}, slots array<bigint>, `values` array<double>")
        return out.select(F.col("id").alias(self.id_col), F.col("slots").alias(self.slots_col),
                          F.col("values").alias(self.values_col))


def _scaled_block(rows: pa.Table, params: pa.Table) -> pa.Table:
    rows = rows.combine_chunks()
    known = params.column("slot").to_numpy()
    order = np.argsort(known)
    known, divisor = known[order], params.column("divisor").to_numpy()[order]
    slots, values = (rows.column(c).chunk(0) if rows.num_rows else pa.array([], pa.list_(k)) for c, k in
                     (("slots", pa.int64()), ("values", pa.float64())))
    flat, x = slots.flatten().to_numpy(), values.flatten().to_numpy()
    sizes = np.diff(slots.offsets.to_numpy())
    at = np.minimum(np.searchsorted(known, flat), max(len(known) - 1, 0))
    kept = known[at] == flat if len(known) else np.zeros(len(flat), bool)
    row = np.repeat(np.arange(len(sizes)), sizes)[kept]
    offsets = np.concatenate(([0], np.cumsum(np.bincount(row, minlength=len(sizes))))).astype(np.int32)
    return pa.table({"id": rows.column("id"), "slots": pa.ListArray.from_arrays(offsets, pa.array(flat[kept])),
                     "values": pa.ListArray.from_arrays(offsets, pa.array(x[kept] / divisor[at[kept]] if len(known) else x[kept]))})


# --- correlation of wide sparse rows ----------------------------------------------------------------------------------

PAIRS_HELD = 2_000_000     # pair sums that a task keeps before it sends them on
SLOTS_SENT = 1_000_000     # so many slots' bounds are sent to all tasks; with more, all pairs are summed


@dataclass
class _Partners:
    """Slots in ascending order of ``place``; those a slot can correlate with are the next ones before ``end``, and for a
    slot that is ``often`` non-zero also those whose ``a`` times its own exceeds ``threshold``."""
    slots: np.ndarray          # ascending
    place: np.ndarray          # of each slot
    end: np.ndarray            # by place
    a: np.ndarray              # by place
    slot: np.ndarray           # by place
    often: np.ndarray          # by place
    threshold: float


def _partners(stats: list, threshold: float) -> _Partners:
    """Bounds for values of 0 or more, from (slot, mean m, deviation d, largest value M) of each slot.

    A sum of products is at most n m_i M_j, so r > t needs t d_j / (M_j - m_j) < m_i / d_i. As d^2 <= m (M - m), this
    holds the other way round for a j whose d / (M - m) is no smaller than i's: ordered by it, a slot's partners are a run.
    And r < -t needs a_i a_j > t with a = m / d, as in :func:`correlated_slots`.
    """
    slot, m, d, most = (np.array([r[c] for r in stats], k) for c, k in (
        ("slot", np.int64), ("mean", float), ("sd", float), ("max", float)))
    low, a = d / (np.maximum(most - m, 0.0) + 1e-9 * most), m / d  # a mean may lie on its maximum by rounding
    order = np.lexsort((slot, np.minimum(low, a)))
    low, a, slot = np.minimum(low, a)[order], a[order], slot[order]
    end = np.searchsorted(low, a / threshold * (1 + 1e-6), "right")
    by_slot = np.argsort(slot)
    return _Partners(slot[by_slot], by_slot, end, a, slot, a * a > threshold * (1 - 1e-6), threshold)


def _partner_pairs(at: np.ndarray, x: np.ndarray, of: _Partners):
    """(i, j, product), i < j, of a row's entries that can correlate, some at a time."""
    near = np.minimum(np.searchsorted(of.slots, at), max(len(of.slots) - 1, 0))
    known = of.slots[near] == at if len(of.slots) else np.zeros(len(at), bool)
    place, x = of.place[near[known]], x[known]
    order = np.argsort(place)
    place, x = place[order], x[order]
    after = np.arange(len(place)) + 1
    n = np.maximum(np.searchsorted(place, of.end[place], "left") - after, 0)
    total = np.cumsum(n)

    def products(left, right):
        i, j = of.slot[place[left]], of.slot[place[right]]
        return np.minimum(i, j), np.maximum(i, j), x[left] * x[right]

    first = 0
    while first < len(place):  # runs of entries with at most about PAIRS_HELD partners
        sent = total[first - 1] if first else 0
        stop = max(first + 1, int(np.searchsorted(total, sent + PAIRS_HELD, "right")))
        left = np.repeat(np.arange(first, stop), n[first:stop])
        start = np.repeat(total[first:stop] - n[first:stop] - sent, n[first:stop])
        right = np.arange(len(left)) - start + after[left]
        if len(left):
            yield products(left, right)
        first = stop
    for d in np.flatnonzero(of.often[place]):  # further pairs with a slot that is often non-zero
        other = np.arange(len(place))
        met = np.where(other > d, other - d <= n[d], d - other <= n)
        twice = of.often[place] & (other < d)
        right = other[~met & ~twice & (other != d) & (of.a[place] * of.a[place[d]] > of.threshold * (1 - 1e-6))]
        if len(right):
            yield products(np.full(len(right), d), right)


def _every_pair(at: np.ndarray, x: np.ndarray):
    """(i, j, product), i < j, of all of a row's entries, some at a time."""
    order = np.argsort(at)
    at, x = at[order], x[order]
    step = max(1, PAIRS_HELD // len(at))
    for a in range(0, len(at) - 1, step):  # some entries with all later ones of their row
        left, right = np.triu_indices(min(step, len(at) - a), 1, len(at) - a)
        left, right = left + a, right + a
        yield at[left], at[right], x[left] * x[right]


def _pair_products(batches, of: _Partners | None = None):
    """Partial sums (i, j, s) of the products of each row's entries, i < j; a pair is one number, i * 2^31 + j."""
    keys, sums = np.empty(0, np.int64), np.empty(0)
    held: list[tuple[np.ndarray, np.ndarray]] = []
    size = 0

    def merged() -> tuple[np.ndarray, np.ndarray]:
        pairs = np.concatenate([keys, *[k for k, _ in held]])
        values = np.concatenate([sums, *[v for _, v in held]])
        order = np.argsort(pairs, kind="stable")
        pairs, values = pairs[order], values[order]
        first = np.flatnonzero(np.append(True, pairs[1:] != pairs[:-1])) if len(pairs) else np.empty(0, np.int64)
        return pairs[first], np.add.reduceat(values, first) if len(first) else values

    def sent() -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"i": keys >> 31, "j": keys & ((1 << 31) - 1), "s": sums})

    for batch in batches:
        for slots, values in zip(batch.column(0), batch.column(1)):
            at, x = np.array(slots.values.to_numpy(), np.int64), np.array(values.values.to_numpy(), np.float64)
            for left, right, products in (_every_pair(at, x) if of is None else _partner_pairs(at, x, of)):
                held.append(((left << 31) | right, products))
                size += len(left)
                if size > PAIRS_HELD:
                    (keys, sums), held, size = merged(), [], 0
                    if len(keys) > PAIRS_HELD // 2:
                        yield sent()
                        keys, sums = keys[:0], sums[:0]
    keys, sums = merged()
    if len(keys):
        yield sent()


def correlated_slots(df: DataFrame, col: str, threshold: float) -> DataFrame:
    """(i, j, r) of all pairs of slots i < j with |Pearson correlation| above ``threshold`` (0.5 or more), without a matrix.

    Only slots that share a row have a product to sum, so the pairs are those that rows hold, summed in each task, then by
    key. For a pair that never meets, r = -a_i a_j with a = mean / deviation; that exceeds the threshold only if one of
    them has a^2 above it, so fills at least a third of the rows: there are at most three times as many such slots as a row
    has entries, and they are paired with all others by formula. A slot without spread has no correlation.

    Where no value is negative, means and maxima bound every pair's correlation (:func:`_partners`), and products are made
    only of pairs that can exceed the threshold; the bounds of up to SLOTS_SENT slots are sent to the tasks. The rows are
    checkpointed once, so that vectors are not built again for each pass.
    """
    if threshold < 0.5:
        raise ValueError("thresholds below 0.5 leave too many pairs")
    ship_package(df.sparkSession)
    df = cut_lineage(df.select(col))
    flat = entries(df, col)
    n = df.count()
    stats = cut_lineage(slot_statistics(flat, n).where("variance > 0").select(
        "slot", "mean", F.sqrt("variance").alias("sd"), (F.col("mean") / F.sqrt("variance")).alias("a"), "min", "max"))
    least, n_slots = stats.agg(F.min("min"), F.count(F.lit(1))).first()
    # finite values only: a bound means nothing next to a NaN or an infinity
    odd = stats.where(F.isnan("mean") | F.isnan("sd") | (F.abs("max") == float("inf"))).limit(1).count()
    bounded = n_slots and least >= 0 and not odd and n_slots <= SLOTS_SENT
    of = _partners(stats.select("slot", "mean", "sd", "max").collect(), threshold) if bounded else None
    raw = df.select(F.unwrap_udt(F.col(col)).alias("v"))
    every = F.sequence(F.lit(0), F.size("v.values") - 1)
    at = F.when(F.col("v.type") == 0, F.col("v.indices")).otherwise(F.when(F.size("v.values") > 0, every))
    kept = F.filter(F.arrays_zip(at.alias("slot"), F.col("v.values").alias("value")), lambda e: e["value"] != 0)
    rows = raw.select(kept.alias("e")).where(F.size("e") > 1).select(F.col("e.slot").alias("slots"), F.col("e.value").alias("x"))
    sums = rows.mapInArrow(lambda batches: _pair_products(batches, of), "i long, j long, s double").groupBy("i", "j").agg(F.sum("s").alias("s"))
    dense = [(r["slot"], r["a"]) for r in stats.where(F.col("a") * F.col("a") > threshold).collect()]
    if dense:  # their pairs with slots that they never meet
        with_dense = stats.select("slot", "a", F.explode(F.array(*[
            F.struct(F.lit(s).alias("d"), F.lit(float(a)).alias("da")) for s, a in dense])).alias("e")).where(
            (F.col("slot") != F.col("e.d")) & (F.abs(F.col("a") * F.col("e.da")) > threshold))
        sums = sums.unionByName(with_dense.select(F.least("slot", "e.d").alias("i"), F.greatest("slot", "e.d").alias("j"),
                                                  F.lit(0.0).alias("s")).distinct()).groupBy("i", "j").agg(F.sum("s").alias("s"))
    left = stats.select(F.col("slot").alias("i"), F.col("mean").alias("mi"), F.col("sd").alias("si"))
    right = stats.select(F.col("slot").alias("j"), F.col("mean").alias("mj"), F.col("sd").alias("sj"))
    r = (F.col("s") / F.lit(float(n)) - F.col("mi") * F.col("mj")) / (F.col("si") * F.col("sj"))
    return sums.join(left, "i").join(right, "j").select("i", "j", r.alias("r")).where(F.abs("r") > threshold)
