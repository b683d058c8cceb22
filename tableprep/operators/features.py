"""Feature building: pairwise interactions, polynomial terms, text statistics,
frequency encoding and date parts.

All features are projections of the input row except frequency encoding, whose
per-category shares are fitted with one aggregate job and applied with a lookup
(a broadcast join under a checked byte bound, a salted shuffle join beyond it).
"""

from __future__ import annotations

import itertools
from dataclasses import dataclass

from pyspark.ml import Estimator, Model
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tableprep.functions.datetime import datetime_parts
from tableprep.functions.text import as_text, text_length, unique_words, uppercase_ratio, word_count
from tableprep.operators import stats
from tableprep.operators.profile import detect_text_columns, numeric_cols, string_cols, timestamp_cols
from tableprep.persist import Saved

def interaction_names(cols: list[str]) -> list[str]:
    return [f"{a}_x_{b}" for a, b in itertools.combinations(cols, 2)]


def interaction_columns(cols: list[str]) -> list[Column]:
    """Products of every pair i < j, named ``a_x_b``."""
    return [(F.col(a) * F.col(b)).alias(f"{a}_x_{b}") for a, b in itertools.combinations(cols, 2)]


def interaction_array(arr_col: str | Column, width: int) -> Column:
    """Pair products of an array column as one array (i < j, row-major), for wide inputs.

    A single higher-order expression: the plan does not grow with the number of pairs.
    """
    a = F.col(arr_col) if isinstance(arr_col, str) else arr_col
    if width < 2:
        return F.array().cast("array<double>")
    return F.flatten(F.transform(F.sequence(F.lit(0), F.lit(width - 2)),
                                 lambda i: F.transform(F.sequence(i + 1, F.lit(width - 1)),
                                                       lambda j: F.element_at(a, i + 1) * F.element_at(a, j + 1))))


def _monomial_name(combo: tuple[str, ...]) -> str:
    parts = []
    for c, grp in itertools.groupby(combo):
        k = len(list(grp))
        parts.append(c if k == 1 else f"{c}_pow{k}")
    return "_x_".join(parts)


def _monomials(cols: list[str], degree: int, interaction_only: bool = False) -> list[tuple[str, ...]]:
    pick = itertools.combinations if interaction_only else itertools.combinations_with_replacement
    return [combo for d in range(2, degree + 1) for combo in pick(cols, d)]


def _product(combo: tuple[str, ...]) -> Column:
    expr = F.col(combo[0])
    for c in combo[1:]:
        expr = expr * F.col(c)
    return expr


def polynomial_columns(cols: list[str], degree: int, interaction_only: bool = False) -> list[Column]:
    """Monomials of total degree 2..degree (the degree-1 terms are the inputs themselves)."""
    return [_product(c).alias(_monomial_name(c)) for c in _monomials(cols, degree, interaction_only)]


def text_feature_columns(col: str) -> list[Column]:
    s = as_text(col)
    return [text_length(s).alias(f"{col}_len"), word_count(s).alias(f"{col}_word_count"),
            unique_words(s).alias(f"{col}_unique_words"), uppercase_ratio(s).alias(f"{col}_uppercase_ratio")]


def frequency_maps(df: DataFrame, cols: list[str]) -> DataFrame:
    """Long map (ci, value, freq): share of each value among the column's non-null rows.

    One job: unpivot to (column, value), partial-aggregate counts, divide by the
    column's non-null total (one row per column, broadcast).
    """
    long = df.select(F.explode(F.array(*[
        F.struct(F.lit(i).alias("ci"), F.col(c).cast("string").alias("value")) for i, c in enumerate(cols)
    ])).alias("e")).select("e.*").where(F.col("value").isNotNull())
    counts = long.groupBy("ci", "value").agg(F.count(F.lit(1)).alias("n"))
    totals = counts.groupBy("ci").agg(F.sum("n").alias("total"))
    return counts.join(F.broadcast(totals), "ci").select("ci", "value", (F.col("n") / F.col("total")).alias("freq"))


def apply_lookup(df: DataFrame, col: str, lookup: DataFrame, out_col: str, map_bytes: int | None = None,
                 default: float = 0.0, value_col: str = "freq", max_broadcast_bytes: int | None = None) -> DataFrame:
    """Map ``col`` through a (value -> number) table by a join; misses and nulls get ``default``."""
    key = f"_k_{out_col}"
    right = lookup.select(F.col("value").alias(key), F.col(value_col).alias(out_col))
    limit = stats.DEFAULT_BROADCAST_BYTES if max_broadcast_bytes is None else max_broadcast_bytes
    joined = stats.lookup_join(df.withColumn(key, F.col(col).cast("string")), right, [key], map_bytes, limit)
    return joined.withColumn(out_col, F.coalesce(F.col(out_col), F.lit(default))).drop(key)


def map_sizes(maps: DataFrame) -> dict[int, int]:
    """Bytes of each column's lookup in a long map (ci, value, ...)."""
    size = F.coalesce(F.octet_length("value"), F.lit(0)) + F.lit(16 * (len(maps.columns) - 1))
    return {r["ci"]: int(r["n"]) for r in maps.groupBy("ci").agg(F.sum(size.cast("long")).alias("n")).collect()}


@dataclass
class FeatureEngineeringConfig:
    polynomial_degree: int = 1
    interaction_only: bool = False
    create_interactions: bool = True
    create_datetime_features: bool = True
    create_text_features: bool = True
    frequency_encoding: bool = True
    passthrough: tuple = ()       # id / label columns carried unchanged


class FeatureEngineer(Estimator):
    """Numeric columns, polynomial terms, date parts, text statistics and category shares as columns; the products of all
    pairs of numeric inputs as one vector column (``INTERACTIONS``), whatever their number. String columns are carried
    along for the encoder. Long-text columns get no share of their whole text."""

    def __init__(self, config: FeatureEngineeringConfig | None = None):
        super().__init__()
        self.config = config or FeatureEngineeringConfig()

    def _fit(self, df: DataFrame) -> "FeatureEngineerModel":
        cfg = self.config
        skip = set(cfg.passthrough)
        num = numeric_cols(df, skip)
        cat = string_cols(df, skip)
        dts = timestamp_cols(df, skip)
        long_text = set(detect_text_columns(df, cat)) if cat and cfg.frequency_encoding else set()
        shared = [c for c in cat if c not in long_text]
        maps, sizes = None, {}
        if cfg.frequency_encoding and shared:
            maps = stats_checkpoint(frequency_maps(df, shared))
            sizes = map_sizes(maps)
        return FeatureEngineerModel(cfg, num, cat, dts, maps, sizes, shared)


def stats_checkpoint(df: DataFrame) -> DataFrame:
    """Fitted lookup tables are materialised once so transforms do not recompute the fit."""
    from tableprep.session import cut_lineage
    return cut_lineage(df)


INTERACTIONS = "pair_products"


class FeatureEngineerModel(Saved, Model):
    def __init__(self, config, num, cat, dts, maps, sizes, shared):
        super().__init__()
        self.config, self.num, self.cat, self.dts = config, num, cat, dts
        self.maps, self.sizes, self.shared = maps, sizes, shared
        pairs = interaction_names(num) if config.create_interactions and len(num) > 1 else []
        polynomial = {_monomial_name(c) for c in _monomials(num, config.polynomial_degree, config.interaction_only)}
        # a product that the polynomial terms already hold is not made twice
        self.pair_names = pairs if not polynomial.issuperset(pairs) else []

    def _names(self, wanted: list[str], taken: set[str]) -> list[str]:
        """Derived names that no input column has: ``_1``, ``_2``, ... until unique."""
        out = []
        for n in wanted:
            name, k = n, 0
            while name in taken:
                k += 1
                name = f"{n}_{k}"
            taken.add(name)
            out.append(name)
        return out

    def _transform(self, df: DataFrame) -> DataFrame:
        cfg = self.config
        keep = [c for c in cfg.passthrough if c in df.columns] + self.num + self.cat
        derived: list[tuple[str, Column]] = []
        for combo in _monomials(self.num, cfg.polynomial_degree, cfg.interaction_only):
            derived.append((_monomial_name(combo), _product(combo)))
        if self.pair_names:
            arr = F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(float("nan"))) for c in self.num])
            derived.append((INTERACTIONS, array_to_vector(interaction_array(arr, len(self.num)))))
        parts = ("year", "month", "day", "weekday")
        if cfg.create_datetime_features:
            derived += [(f"{c}_{p}", e) for c in self.dts for p, e in zip(parts, datetime_parts(c))]
        texts = ("len", "word_count", "unique_words", "uppercase_ratio")
        if cfg.create_text_features:
            derived += [(f"{c}_{p}", e) for c in self.cat for p, e in zip(texts, text_feature_columns(c))]
        names = self._names([n for n, _ in derived] + [f"{c}_freq" for c in self.shared], set(keep))
        width = {"ml_attr": {"num_attrs": len(self.pair_names)}}
        out = df.select(*keep, *[e.alias(n, metadata=width) if w == INTERACTIONS else e.alias(n)
                                 for n, (w, e) in zip(names, derived)])
        if cfg.frequency_encoding and self.maps is not None:
            for i, (c, name) in enumerate(zip(self.shared, names[len(derived):])):
                m = self.maps.where(F.col("ci") == i).select("value", "freq")
                out = apply_lookup(out, c, m, name, self.sizes.get(i, 0))
        return out

    def named_pairs(self, df: DataFrame) -> DataFrame:
        """The interaction vector spread into its named columns (for narrow tables)."""
        if not self.pair_names:
            return df
        a = vector_to_array(INTERACTIONS)
        return df.withColumns({n: a[i] for i, n in enumerate(self.pair_names)}).drop(INTERACTIONS)
