"""Table cleaning: header names, high-missing columns, numeric text, fills, IQR clipping,
text cleaning and keep-first deduplication.

``DataCleaner`` is a ``pyspark.ml`` Estimator. ``fit`` runs a fixed, small number of
aggregate jobs (null ratios + numeric-text counts; fill statistics; quartiles after
filling) and the fitted model applies everything as one projection plus, when asked,
one deduplicating aggregate.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.ml import Estimator, Model
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tableprep.functions.numeric import clip, nan_to_null, to_numeric
from tableprep.functions.text import clean_text
from tableprep.operators import stats
from tableprep.operators.profile import numeric_cols, string_cols, timestamp_cols
from tableprep.persist import Saved

NUMERIC_STRATEGIES = ("mean", "median", "zero")
CATEGORICAL_STRATEGIES = ("mode", "constant")
OUTLIER_METHODS = ("iqr", "none")


# ----------------------------------------------------------------------------------------
# column names
# ----------------------------------------------------------------------------------------

def standardize_names(names: list[str]) -> list[str]:
    """strip, lower, space -> '_', drop characters other than word characters; repeated
    names get '_1', '_2', ... and the suffixing continues until every name is unique."""
    base = [re.sub(r"[^\w_]", "", n.strip().lower().replace(" ", "_")) for n in names]
    out, used, seen = [], set(base), {}
    for n in base:
        if n not in seen:
            seen[n] = 0
            out.append(n)
            continue
        k = seen[n]
        cand = n
        while cand in used:
            k += 1
            cand = f"{n}_{k}"
        seen[n] = k
        used.add(cand)
        out.append(cand)
    return out


def rename_columns(df: DataFrame) -> DataFrame:
    return df.toDF(*standardize_names(df.columns))


# ----------------------------------------------------------------------------------------
# stand-alone operators
# ----------------------------------------------------------------------------------------

def drop_high_missing(df: DataFrame, threshold: float = 0.4, exclude=()) -> tuple[DataFrame, list[str]]:
    """Drop columns whose null share is strictly above ``threshold``."""
    cols = [c for c in df.columns if c not in exclude]
    ratios = stats.null_ratios(df, cols)
    dropped = [c for c in cols if ratios[c] > threshold]
    return df.drop(*dropped), dropped


def infer_numeric(df: DataFrame, cols=None, min_share: float = 0.5) -> tuple[DataFrame, list[str]]:
    """Convert string columns to DOUBLE when at least half of the non-null values parse."""
    cols = list(cols if cols is not None else string_cols(df))
    if not cols:
        return df, []
    exprs = []
    for i, c in enumerate(cols):
        exprs += [F.count(c).alias(f"n{i}"), F.count(to_numeric(c)).alias(f"p{i}")]
    row = df.agg(*exprs).first()
    conv = [c for i, c in enumerate(cols) if row[f"p{i}"] >= row[f"n{i}"] * min_share]
    return df.withColumns({c: to_numeric(c) for c in conv}), conv


def fill_values(df: DataFrame, values: dict) -> DataFrame:
    """Replace nulls and NaNs of the given columns."""
    df = stats.without_nan(df)
    kinds = {f.name: f.dataType for f in df.schema.fields}
    return df.withColumns({c: F.coalesce(F.col(c), F.lit(v).cast(kinds[c]) if c in timestamp_cols(df) else F.lit(v))
                           for c, v in values.items() if v is not None})


def numeric_fill_values(df: DataFrame, cols: list[str], strategy: str) -> dict:
    """Fill value per column; missing values (null, NaN) take no part in it."""
    if strategy not in NUMERIC_STRATEGIES:
        raise ValueError(f"Invalid numeric strategy: {strategy}")
    if not cols:
        return {}
    if strategy == "zero":
        return {c: 0.0 for c in cols}
    if strategy == "mean":
        return stats.means(df.select(*[nan_to_null(F.col(c).cast("double")).alias(c) for c in cols]), cols)
    q = stats.exact_quantiles(df, cols, [0.5])
    return {c: q[c][0] for c in cols}


def categorical_fill_values(df: DataFrame, cols: list[str], strategy: str, constant: str = "unknown") -> dict:
    if strategy not in CATEGORICAL_STRATEGIES:
        raise ValueError(f"Invalid categorical strategy: {strategy}")
    if not cols:
        return {}
    if strategy == "constant":
        return {c: constant for c in cols}
    found = stats.modes(df, cols)
    return {c: (found[c] if found[c] is not None else "unknown") for c in cols}


def iqr_bounds(df: DataFrame, cols: list[str], factor: float = 1.5) -> dict[str, tuple]:
    q = stats.exact_quantiles(df, cols, [0.25, 0.75])
    out = {}
    for c in cols:
        q1, q3 = q[c]
        if q1 is None:
            out[c] = (None, None)
            continue
        iqr = q3 - q1
        out[c] = (q1 - factor * iqr, q3 + factor * iqr)
    return out


def iqr_clip(df: DataFrame, cols: list[str], factor: float = 1.5) -> DataFrame:
    bounds = iqr_bounds(df, cols, factor)
    df = stats.without_nan(df)
    return df.withColumns({c: clip(c, *bounds[c]) for c in cols})


def dedup_keep_first(df: DataFrame, feature_cols: list[str], order_col: str) -> DataFrame:
    """Keep, for every distinct combination of ``feature_cols``, the row with the smallest
    ``order_col``; the other columns (label included) come from that row.

    Written as a hash aggregate ``min(struct(order_col, ...))`` so the map side keeps one
    candidate per key and partition before the shuffle: a combination repeated by a third
    of all rows costs no more than any other key.
    """
    rest = [c for c in df.columns if c not in feature_cols and c != order_col]
    fixed = (T.NumericType, T.BooleanType, T.DateType, T.TimestampType, T.TimestampNTZType)
    if all(isinstance(df.schema[c].dataType, fixed) for c in rest):
        # fixed-width buffers: a plain hash aggregate (no sort) with map-side partials
        out = df.groupBy(*feature_cols).agg(F.min(order_col).alias(order_col),
                                            *[F.min_by(c, order_col).alias(c) for c in rest])
        return out.select(*df.columns)
    pick = F.min(F.struct(F.col(order_col), *[F.col(c) for c in rest])).alias("_first")
    out = df.groupBy(*feature_cols).agg(pick)
    return out.select(*[F.col(c) for c in df.columns if c in feature_cols],
                      F.col(f"_first.{order_col}").alias(order_col),
                      *[F.col(f"_first.{c}").alias(c) for c in rest]).select(*df.columns)


# ----------------------------------------------------------------------------------------
# estimator
# ----------------------------------------------------------------------------------------

@dataclass
class CleaningConfig:
    missing_threshold: float = 0.4
    numeric_strategy: str = "median"
    categorical_strategy: str = "mode"
    constant_fill_value: str = "unknown"
    outlier_method: str = "iqr"
    iqr_factor: float = 1.5
    drop_duplicates: bool = True
    # text
    lowercase: bool = True
    remove_html: bool = True
    remove_urls: bool = True
    remove_special_chars: bool = True
    remove_extra_spaces: bool = True
    normalize_unicode: bool = True
    keep_unicode_letters: bool = False
    # columns never treated as features (row ids, label)
    id_cols: tuple = ()
    label_col: str | None = None
    row_id_col: str | None = None

    def text_options(self) -> dict:
        return {k: getattr(self, k) for k in ("lowercase", "remove_html", "remove_urls", "remove_special_chars",
                                              "remove_extra_spaces", "normalize_unicode", "keep_unicode_letters")}


class DataCleaner(Estimator):
    """Fit cleaning statistics; the model replays them on any DataFrame of the same shape."""

    def __init__(self, config: CleaningConfig | None = None):
        super().__init__()
        self.config = config or CleaningConfig()

    def _fit(self, df: DataFrame) -> "DataCleanerModel":
        cfg = self.config
        if cfg.numeric_strategy not in NUMERIC_STRATEGIES:
            raise ValueError(f"Invalid numeric strategy: {cfg.numeric_strategy}")
        if cfg.categorical_strategy not in CATEGORICAL_STRATEGIES:
            raise ValueError(f"Invalid categorical strategy: {cfg.categorical_strategy}")
        if cfg.outlier_method not in OUTLIER_METHODS:
            raise ValueError(f"Invalid outlier method: {cfg.outlier_method}")
        report: dict = {"initial_columns": len(df.columns)}

        names = standardize_names(df.columns)
        renamed = stats.without_nan(df.toDF(*names))
        keep_out = set(standardize_names(list(cfg.id_cols))) if cfg.id_cols else set()
        label = standardize_names([cfg.label_col])[0] if cfg.label_col else None
        row_id = standardize_names([cfg.row_id_col])[0] if cfg.row_id_col else None
        protected = keep_out | {c for c in (label, row_id) if c}
        feats = [c for c in names if c not in protected]

        # job 1: row count, null ratio of every feature, parse counts of string features
        strs = [c for c in string_cols(renamed) if c in feats]
        exprs = [F.count(F.lit(1)).alias("_rows")]
        exprs += [F.avg(F.col(c).isNull().cast("double")).alias(f"m{i}") for i, c in enumerate(feats)]
        for i, c in enumerate(strs):
            exprs += [F.count(c).alias(f"n{i}"), F.count(to_numeric(c)).alias(f"p{i}")]
        row = renamed.agg(*exprs).first()
        n_rows = row["_rows"]
        ratio = {c: (row[f"m{i}"] or 0.0) for i, c in enumerate(feats)}
        dropped = [c for c in feats if ratio[c] > cfg.missing_threshold]
        converted = [c for i, c in enumerate(strs)
                     if c not in dropped and row[f"p{i}"] >= row[f"n{i}"] * 0.5]
        kept = [c for c in feats if c not in dropped]
        typed = renamed.drop(*dropped).withColumns({c: to_numeric(c) for c in converted})
        typed = typed.withColumns({f.name: F.col(f.name).cast("double") for f in typed.schema.fields
                                   if f.name in kept and isinstance(f.dataType, T.BooleanType)})

        # which columns still hold nulls (converted columns may have gained some)
        nulls = {c: ratio[c] * n_rows for c in kept}
        for i, c in enumerate(strs):
            if c in converted:
                nulls[c] = n_rows - row[f"p{i}"]
        num = [c for c in numeric_cols(typed) if c in kept]
        cat = [c for c in kept if c not in num and isinstance(typed.schema[c].dataType, T.StringType)]
        other = [c for c in timestamp_cols(typed) if c in kept]
        num_missing = [c for c in num if nulls[c] > 0]
        cat_missing = [c for c in cat if nulls[c] > 0]

        # job 2: fill statistics
        fills = {}
        fills.update(numeric_fill_values(typed, num_missing, cfg.numeric_strategy))
        fills.update(categorical_fill_values(typed, cat_missing, cfg.categorical_strategy,
                                             cfg.constant_fill_value))
        other_missing = [c for c in other if nulls[c] > 0]
        found = stats.modes(typed, other_missing)          # dates and times: the most frequent value
        fills.update({c: found[c] for c in other_missing if found[c] is not None})
        filled = fill_values(typed, {c: v for c, v in fills.items() if c not in other_missing})

        # job 3: quartiles after filling
        bounds = iqr_bounds(filled, num, cfg.iqr_factor) if cfg.outlier_method == "iqr" else {}

        report.update(n_rows=n_rows, dropped_columns_missing=dropped, converted_numeric=converted, fill_values=fills,
                      clip_bounds=bounds, numeric_cols=num, categorical_cols=cat)
        model = DataCleanerModel(cfg, names, dropped, converted, fills, bounds, cat, kept, row_id, report)
        return model


class DataCleanerModel(Saved, Model):
    def __init__(self, config, names, dropped, converted, fills, bounds, text_cols, features, row_id, report):
        super().__init__()
        self.config = config
        self.names = names
        self.dropped = dropped
        self.converted = converted
        self.fills = fills
        self.bounds = bounds
        self.text_cols = text_cols
        self.features = features
        self.row_id = row_id
        self.report = report
        self.apply_dedup = config.drop_duplicates

    def without_dedup(self) -> "DataCleanerModel":
        """Same cleaning without the row-dropping step (for scoring new rows)."""
        m = DataCleanerModel(self.config, self.names, self.dropped, self.converted, self.fills, self.bounds,
                             self.text_cols, self.features, self.row_id, self.report)
        m.apply_dedup = False
        return m

    def _transform(self, df: DataFrame) -> DataFrame:
        cfg = self.config
        out = stats.without_nan(df.toDF(*standardize_names(df.columns)).drop(*self.dropped))
        exprs: dict[str, Column] = {}
        for c in out.columns:
            e = F.col(c)
            if c in self.converted:
                e = to_numeric(e)
            if isinstance(out.schema[c].dataType, T.BooleanType) and c in self.features:
                e = e.cast("double")
            if c in self.fills:
                fill = F.lit(self.fills[c])
                e = F.coalesce(e, fill.cast(out.schema[c].dataType) if c in timestamp_cols(out) else fill)
            if c in self.bounds and self.bounds[c][0] is not None:
                e = clip(e, *self.bounds[c])
            if c in self.text_cols:
                e = clean_text(e, **cfg.text_options())
            exprs[c] = e
        out = out.select(*[exprs[c].alias(c) for c in out.columns])
        if self.apply_dedup:
            if self.row_id:
                out = dedup_keep_first(out, self.features, self.row_id)
            else:  # no row id: the smallest of the repeated rows stays, whatever the partitioning
                rest = [c for c in out.columns if c not in self.features]
                agg = [F.min(F.struct(*[F.col(c) for c in rest])).alias("_rest")] if rest else []
                kept = out.groupBy(*self.features).agg(*agg) if agg else out.select(*self.features).distinct()
                out = kept.select(*[F.col(f"_rest.{c}").alias(c) if c in rest else F.col(c) for c in out.columns])
        return out
