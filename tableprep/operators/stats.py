"""Column statistics shared by the fit operators, written for very large tables.

* All per-column statistics of one kind come from a single aggregate job.
* Exact quantiles never gather a column (or a value->count map of it) into one task:
  brackets around the wanted order statistics are narrowed with distributed
  ``percentile_approx`` passes until the rows inside each bracket are few, and only
  those (grouped by value) reach the driver. The driver sees at most ``collect_bound``
  distinct values per bracket, whatever the table size.
* Modes and value counts are hash aggregates with map-side partial aggregation, so a
  value holding a third of all rows is pre-combined before the shuffle.
* Lookup joins broadcast a map only when its bytes are checked below a bound, and
  salt the shuffle join otherwise.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DEFAULT_BROADCAST_BYTES = 64 << 20
DEFAULT_COLLECT_BOUND = 100_000
DEFAULT_SALTS = 32


def missing(df: DataFrame, col: str) -> Column:
    """A null, or a NaN in a fractional column: both mean a missing value."""
    c = F.col(col)
    return c.isNull() | F.isnan(c) if df.schema[col].dataType.typeName() in ("double", "float") else c.isNull()


def without_nan(df: DataFrame) -> DataFrame:
    """NaN becomes null in every fractional column."""
    cols = [f.name for f in df.schema.fields if f.dataType.typeName() in ("double", "float")]
    return df.withColumns({c: F.when(~F.isnan(F.col(c)), F.col(c)) for c in cols}) if cols else df


def null_ratios(df: DataFrame, cols: list[str]) -> dict[str, float]:
    """Share of missing values per column, all columns in one job."""
    if not cols:
        return {}
    row = df.agg(*[F.avg(missing(df, c).cast("double")).alias(f"_{i}") for i, c in enumerate(cols)]).first()
    return {c: (row[i] if row[i] is not None else 0.0) for i, c in enumerate(cols)}


def means(df: DataFrame, cols: list[str]) -> dict[str, float | None]:
    if not cols:
        return {}
    row = df.agg(*[F.avg(c).alias(f"_{i}") for i, c in enumerate(cols)]).first()
    return {c: row[i] for i, c in enumerate(cols)}


def modes(df: DataFrame, cols: list[str]) -> dict[str, str | None]:
    """Most frequent non-null value per column, smallest value on ties.

    One job for all columns: rows are unpivoted to (column, value), counted with a
    partial hash aggregate, and reduced with ``min(struct(-count, value))`` per column,
    itself a partial aggregate, so no group is ever sorted or gathered whole.
    """
    if not cols:
        return {}
    long = df.select(F.explode(F.array(*[
        F.struct(F.lit(i).alias("ci"), F.col(c).cast("string").alias("v")) for i, c in enumerate(cols)
    ])).alias("e")).select("e.ci", "e.v").where(F.col("v").isNotNull())
    counted = long.groupBy("ci", "v").agg(F.count(F.lit(1)).alias("n"))
    best = counted.groupBy("ci").agg(F.min(F.struct((-F.col("n")).alias("nn"), F.col("v"))).alias("b"))
    found = {r["ci"]: r["b"]["v"] for r in best.collect()}  # one row per column
    return {c: found.get(i) for i, c in enumerate(cols)}


# ----------------------------------------------------------------------------------------
# exact quantiles
# ----------------------------------------------------------------------------------------

@dataclass
class _Target:
    col: int          # index into the column list
    rank: int         # 0-based order statistic among non-null values
    lo: float | None = None   # open bracket (lo, hi), None = unbounded
    hi: float | None = None
    below: int = 0    # non-null values at or below lo
    inside: int = 0   # non-null values inside (lo, hi)
    value: float | None = None
    done: bool = False
    widen: float = 2.0  # sketch rank-error margin, grows after a miss


def _in_bracket(c: Column, lo, hi) -> Column:
    cond = c.isNotNull()
    if lo is not None:
        cond = cond & (c > F.lit(lo))
    if hi is not None:
        cond = cond & (c < F.lit(hi))
    return cond


def exact_quantiles(df: DataFrame, cols: list[str], probs: list[float],
                    collect_bound: int = DEFAULT_COLLECT_BOUND, accuracy: int = 10_000) -> dict[str, list[float | None]]:
    """Exact quantiles with linear interpolation (pandas default, SQL quantile_cont).

    Open brackets around the wanted order statistics are narrowed: a distributed sketch proposes two values, one exact
    aggregate counts the rows below, at and between them. A value that holds the wanted rank is the answer; else both
    values leave the bracket, so heavy ties are gone after one round and every round makes progress. When the rows left
    in all brackets together fit ``collect_bound``, they are fetched as (value, count).
    """
    if not cols:
        return {}
    data = df.select(*[F.col(c).cast("double").alias(f"c{i}") for i, c in enumerate(cols)])
    data = data.select(*[F.when(~F.isnan(F.col(f"c{i}")), F.col(f"c{i}")).alias(f"c{i}")
                         for i in range(len(cols))])
    first = data.agg(*[F.count(f"c{i}") for i in range(len(cols))]).first()
    targets: dict[tuple[int, int], _Target] = {}
    plan: dict[str, list[tuple]] = {}
    for i, c in enumerate(cols):
        n = first[i]
        plan[c] = []
        for p in probs:
            if not n:
                plan[c].append(None)
                continue
            pos = p * (n - 1)
            k = int(math.floor(pos))
            frac = pos - k
            for r in [k] + ([k + 1] if frac > 0 and k + 1 < n else []):
                targets.setdefault((i, r), _Target(col=i, rank=r, inside=n))
            plan[c].append((k, frac))
    while True:
        open_t = [t for t in targets.values() if not t.done]
        room = collect_bound // max(1, len(open_t))
        big = [t for t in open_t if t.inside > room]
        if not big:
            break
        _narrow(data, big, accuracy)
    if open_t:
        _resolve_by_collect(data, open_t)

    out: dict[str, list[float | None]] = {}
    for i, c in enumerate(cols):
        vals = []
        for entry in plan[c]:
            if entry is None:
                vals.append(None)
                continue
            k, frac = entry
            v0 = targets[(i, k)].value
            if frac > 0 and (i, k + 1) in targets:
                v1 = targets[(i, k + 1)].value
                vals.append(v0 + (v1 - v0) * frac)
            else:
                vals.append(v0)
        out[c] = vals
    return out


def _narrow(data: DataFrame, big: list[_Target], accuracy: int) -> None:
    """One round for all targets whose bracket holds too many rows: one sketch pass, one exact count pass."""
    approx_exprs = []
    for j, t in enumerate(big):
        c = F.col(f"c{t.col}")
        m, r = t.inside, t.rank - t.below
        margin = t.widen * m / accuracy + 1
        shares = F.array(F.lit(max(0.0, (r - margin) / m)), F.lit(min(1.0, (r + margin + 1) / m)))
        approx_exprs.append(F.percentile_approx(F.when(_in_bracket(c, t.lo, t.hi), c), shares, accuracy).alias(f"a{j}"))
    approx = data.agg(*approx_exprs).first()
    exprs = []
    for j, t in enumerate(big):
        c = F.when(_in_bracket(F.col(f"c{t.col}"), t.lo, t.hi), F.col(f"c{t.col}"))
        lo, hi = F.lit(approx[j][0]), F.lit(approx[j][1])
        exprs += [F.count_if(c < lo).alias(f"b{j}"), F.count_if(c == lo).alias(f"l{j}"),
                  F.count_if((c > lo) & (c < hi)).alias(f"m{j}"), F.count_if(c == hi).alias(f"h{j}")]
    row = data.agg(*exprs).first()
    for j, t in enumerate(big):
        lo, hi = approx[j][0], approx[j][1]
        below, at_lo, between = t.below + row[f"b{j}"], row[f"l{j}"], row[f"m{j}"]
        at_hi = row[f"h{j}"] if hi > lo else 0
        if t.rank < below:                                  # the sketch missed: the wanted row lies further down
            t.hi, t.inside, t.widen = lo, below - t.below, t.widen * 4
        elif t.rank < below + at_lo:
            t.value, t.done = lo, True
        elif t.rank < below + at_lo + between:
            t.lo, t.hi, t.below, t.inside = lo, hi, below + at_lo, between
        elif t.rank < below + at_lo + between + at_hi:
            t.value, t.done = hi, True
        else:                                               # or further up
            gone = below + at_lo + between + at_hi
            t.lo, t.inside, t.below, t.widen = hi, t.inside - (gone - t.below), gone, t.widen * 4


def _resolve_by_collect(data: DataFrame, open_t: list[_Target]) -> None:
    """Fetch (value, count) inside each bracket, one scan for all targets; only rows in some bracket are exploded."""
    brackets: dict[tuple, int] = {}
    for t in open_t:
        brackets.setdefault((t.col, t.lo, t.hi), len(brackets))
    parts, any_in = [], F.lit(False)
    for (ci, lo, hi), b in brackets.items():
        c = F.col(f"c{ci}")
        cond = _in_bracket(c, lo, hi)
        any_in = any_in | cond
        parts.append(F.when(cond, F.struct(F.lit(b).alias("b"), c.alias("v"))))
    grouped = (data.where(any_in).select(F.explode(F.filter(F.array(*parts), lambda x: x.isNotNull())).alias("e"))
               .select("e.b", "e.v").groupBy("b", "v").agg(F.count(F.lit(1)).alias("n")))
    per: dict[int, list] = {}
    for r in grouped.collect():                             # at most collect_bound rows in all brackets
        per.setdefault(r["b"], []).append((r["v"], r["n"]))
    for vals in per.values():
        vals.sort()
    for t in open_t:
        acc, want = 0, t.rank - t.below
        for v, n in per.get(brackets[(t.col, t.lo, t.hi)], []):
            acc += n
            if acc > want:
                t.value = v
                break
        t.done = True


# ----------------------------------------------------------------------------------------
# lookup joins
# ----------------------------------------------------------------------------------------

def table_bytes(df: DataFrame) -> int:
    """Approximate bytes of a table: string lengths plus 16 a value, one aggregate."""
    size = F.lit(16 * len(df.columns)).cast("long")
    for name, kind in df.dtypes:
        if kind == "string":
            size = size + F.coalesce(F.octet_length(name), F.lit(0)).cast("long")
    return int(df.agg(F.coalesce(F.sum(size), F.lit(0))).first()[0])


def row_hash(df: DataFrame) -> Column:
    """Hash over a row's plain columns: spreads rows without random numbers, so reruns deal them out alike."""
    plain = [c for c, t in df.dtypes if not t.startswith(("map", "struct", "array", "vector", "binary", "variant"))]
    return F.xxhash64(*plain) if plain else F.lit(0).cast("long")


def lookup_join(df: DataFrame, lookup: DataFrame, keys: list[str], map_bytes: int | None = None,
                max_broadcast_bytes: int = DEFAULT_BROADCAST_BYTES, salts: int = DEFAULT_SALTS) -> DataFrame:
    """Left join ``df`` to a per-key map whose keys are unique.

    A map of at most ``max_broadcast_bytes`` bytes (measured if not given) is broadcast. Above that the join shuffles;
    the big side gets a salt in [0, salts) from a hash of its row and the map is replicated once per salt, so one hot
    key spreads over ``salts`` tasks.
    """
    if map_bytes is None:
        map_bytes = table_bytes(lookup)
    if map_bytes <= max_broadcast_bytes:
        return df.join(F.broadcast(lookup), on=keys, how="left")
    left = df.withColumn("_salt", F.pmod(row_hash(df), F.lit(salts)).cast("int"))
    right = lookup.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return left.join(right, on=keys + ["_salt"], how="left").drop("_salt")
