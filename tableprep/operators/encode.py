"""Encoders: one-hot, ordinal, target (plain and out-of-fold), TF-IDF, hashing, and the
combined ``Encoder`` that assembles numeric, categorical and text blocks into one vector.

Category lists and the TF-IDF vocabulary are the model: their size is bounded by the
data's cardinality or by ``max_features``. Per-category statistics come from one
partial aggregate; text vectors are built from their sparse parts in Arrow batches (``terms``),
the others by JVM stages (OneHotEncoder, VectorAssembler).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml import Estimator, Model, Pipeline
from pyspark.ml.feature import OneHotEncoder, VectorAssembler, VectorSlicer
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tableprep.functions.text import concat_text, word_tokens
from tableprep.operators import slots as SL
from tableprep.operators import stats
from tableprep.operators import terms as T
from tableprep.operators.features import apply_lookup, map_sizes, stats_checkpoint
from tableprep.operators.profile import TEXT_MEAN_LENGTH, numeric_cols, string_cols, text_columns
from tableprep.persist import Saved
from tableprep.session import ship_package

def hash_bucket(id_col: str, buckets: int) -> Column:
    """Deterministic bucket of a row id: first 8 hex digits of md5(id) modulo ``buckets``
    (independent of partitioning, and reproducible in plain SQL)."""
    h = F.conv(F.substring(F.md5(F.col(id_col).cast("string")), 1, 8), 16, 10).cast("bigint")
    return F.pmod(h, F.lit(buckets))


# ----------------------------------------------------------------------------------------
# categorical
# ----------------------------------------------------------------------------------------

class CategoryIndexer(Estimator):
    """Sorted categories -> 0..k-1 as a distributed table (column number, value, index); no list reaches the driver.

    ``unknown`` says what an unseen or null value gets: ``next`` the index k (all zeros after one-hot), ``minus_one`` -1,
    ``error`` stops at an unseen value.
    """

    def __init__(self, cols: list[str], suffix: str = "_idx", unknown: str = "next"):
        super().__init__()
        if unknown not in ("next", "minus_one", "error"):
            raise ValueError(f"unknown handling is next, minus_one or error, not {unknown}")
        self.cols, self.suffix, self.unknown = cols, suffix, unknown

    def _fit(self, df: DataFrame) -> "CategoryIndexerModel":
        long = df.select(F.explode(F.array(*[
            F.struct(F.lit(i).alias("ci"), F.col(c).cast("string").alias("value")) for i, c in enumerate(self.cols)
        ])).alias("e")).select("e.*").where(F.col("value").isNotNull()).distinct()
        # range partitions are in order: an index is the rows of earlier partitions plus the place in the own one
        parts = stats_checkpoint(long.repartitionByRange("ci", "value").withColumn("part", F.spark_partition_id()))
        per = parts.groupBy("ci", "part").agg(F.count(F.lit(1)).alias("n"))
        before = Window.partitionBy("ci").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
        starts = per.select("ci", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
        place = F.row_number().over(Window.partitionBy("ci", "part").orderBy("value")) - 1
        table = stats_checkpoint(parts.withColumn("place", place).join(F.broadcast(starts), ["ci", "part"]).select(
            "ci", "value", (F.col("start") + F.col("place")).cast("double").alias("idx")))
        sizes = {r["ci"]: r["n"] for r in per.groupBy("ci").agg(F.sum("n").alias("n")).collect()}
        return CategoryIndexerModel(self.cols, self.suffix, self.unknown, table,
                                    [int(sizes.get(i, 0)) for i in range(len(self.cols))], map_sizes(table))


class CategoryIndexerModel(Saved, Model):
    def __init__(self, cols, suffix, unknown, table, sizes, map_bytes):
        super().__init__()
        self.cols, self.suffix, self.unknown = cols, suffix, unknown
        self.table, self.sizes, self.map_bytes = table, sizes, map_bytes

    def _transform(self, df: DataFrame) -> DataFrame:
        out = df
        for i, c in enumerate(self.cols):
            name, key = f"{c}{self.suffix}", f"_v_{c}"
            right = self.table.where(F.col("ci") == i).select(F.col("value").alias(key), F.col("idx").alias(name))
            out = stats.lookup_join(out.withColumn(key, F.col(c).cast("string")), right, [key], self.map_bytes.get(i, 0))
            missing = F.lit(float(self.sizes[i]) if self.unknown == "next" else -1.0)
            if self.unknown == "error":
                text = F.concat(F.lit(f"category of {c} not seen in fitting: "), F.col(key))
                missing = F.when(F.col(key).isNotNull(), F.raise_error(text).cast("double")).otherwise(missing)
            kinds = {"ml_attr": {"type": "nominal", "name": name, "num_vals": self.sizes[i] + 1}}
            keep = [x for x in out.columns if x not in (key, name)]
            out = out.select(*keep, F.coalesce(F.col(name), missing).alias(name, metadata=kinds))
        return out


def onehot_stages(cols: list[str], drop_first: bool = False, suffix: str = "_oh"):
    """Sorted categories; an unseen or null value encodes as all zeros."""
    ohe = OneHotEncoder(inputCols=[f"{c}_idx" for c in cols], outputCols=[f"{c}{suffix}" for c in cols],
                        dropLast=True, handleInvalid="error")
    return CategoryIndexer(cols), ohe


def ordinal_indexer(cols: list[str], unknown: str = "error") -> CategoryIndexer:
    """Sorted categories -> 0..k-1; an unseen value raises unless ``unknown`` says otherwise."""
    return CategoryIndexer(cols, "_ord", unknown)


def target_means(df: DataFrame, cols: list[str], label: str, folds: int = 0, id_col: str | None = None) -> DataFrame:
    """Long table (ci, value[, fold], mean): label mean per category.

    With ``folds`` > 1 the mean of fold f excludes the rows of fold f (out-of-fold), from
    one aggregate of per-(category, fold) sums: total minus own fold.
    """
    parts = [F.struct(F.lit(i).alias("ci"), F.col(c).cast("string").alias("value")) for i, c in enumerate(cols)]
    base = df.select(F.explode(F.array(*parts)).alias("e"), F.col(label).cast("double").alias("y"),
                     *([hash_bucket(id_col, folds).alias("fold")] if folds > 1 else []))
    base = base.select("e.*", "y", *(["fold"] if folds > 1 else [])).where(F.col("value").isNotNull())
    if folds <= 1:
        return base.groupBy("ci", "value").agg(F.avg("y").alias("mean"))
    per = base.groupBy("ci", "value", "fold").agg(F.sum("y").alias("s"), F.count(F.lit(1)).alias("n"))
    tot = per.groupBy("ci", "value").agg(F.sum("s").alias("ts"), F.sum("n").alias("tn"))
    grid = tot.select("ci", "value", "ts", "tn", F.explode(F.sequence(F.lit(0), F.lit(folds - 1))).alias("fold"))
    j = grid.join(per, ["ci", "value", "fold"], "left").fillna({"s": 0.0, "n": 0})
    return j.select("ci", "value", "fold",
                    F.try_divide(F.col("ts") - F.col("s"), (F.col("tn") - F.col("n")).cast("double")).alias("mean"))


class TargetEncoder(Estimator):
    """Unsmoothed label mean per category; unseen -> 0. ``folds`` > 1 gives out-of-fold
    means for the fit rows (rows are matched by the hash fold of ``id_col``)."""

    def __init__(self, cols: list[str], label: str, folds: int = 0, id_col: str | None = None,
                 suffix: str = "_te"):
        super().__init__()
        self.cols, self.label, self.folds, self.id_col, self.suffix = cols, label, folds, id_col, suffix

    def _fit(self, df):
        full = stats_checkpoint(target_means(df, self.cols, self.label))
        oof = stats_checkpoint(target_means(df, self.cols, self.label, self.folds, self.id_col)) \
            if self.folds > 1 else None
        sizes = map_sizes(full)
        return TargetEncoderModel(self.cols, self.suffix, full, oof, self.folds, self.id_col, sizes)


class TargetEncoderModel(Saved, Model):
    def __init__(self, cols, suffix, full, oof, folds, id_col, sizes):
        super().__init__()
        self.cols, self.suffix, self.full, self.oof = cols, suffix, full, oof
        self.folds, self.id_col, self.sizes = folds, id_col, sizes

    def _transform(self, df):
        out = df
        for i, c in enumerate(self.cols):
            m = self.full.where(F.col("ci") == i).select("value", F.col("mean").alias("freq"))
            out = apply_lookup(out, c, m, f"{c}{self.suffix}", self.sizes.get(i, 0))
        return out

    def transform_oof(self, df):
        """Out-of-fold encoding of the rows the encoder was fitted on."""
        if self.oof is None:
            return self._transform(df)
        out = df.withColumn("_fold", hash_bucket(self.id_col, self.folds))
        for i, c in enumerate(self.cols):
            m = self.oof.where(F.col("ci") == i).select(F.col("value").alias("_v"), F.col("fold").alias("_fold"),
                                                         F.col("mean").alias(f"{c}{self.suffix}"))
            size = self.sizes.get(i, 0) * self.folds
            out = stats.lookup_join(out.withColumn("_v", F.col(c).cast("string")), m, ["_v", "_fold"], size)
            out = out.withColumn(f"{c}{self.suffix}", F.coalesce(F.col(f"{c}{self.suffix}"), F.lit(0.0))).drop("_v")
        return out.drop("_fold")


# ----------------------------------------------------------------------------------------
# text
# ----------------------------------------------------------------------------------------

def with_tokens(df: DataFrame, text: Column, out_col: str = "tokens", lowercase: bool = True) -> DataFrame:
    """Add ``out_col``: word tokens of 2+ word characters. Pairs of them are built where they are counted."""
    return df.withColumn(out_col, word_tokens(F.lower(text) if lowercase else text))


def top_terms(docs: DataFrame, max_features: int, tokens_col: str = "tokens", ngrams: int = 2) -> DataFrame:
    """(term, term_count, doc_freq) of the ``max_features`` most frequent terms, ties by term."""
    found = T.frequent_terms(docs, tokens_col, max_features, ngrams)
    return docs.sparkSession.createDataFrame(found.rows, "term string, term_count long, doc_freq long")


@dataclass
class TfidfConfig:
    max_features: int = 5000
    ngrams: int = 2
    sublinear_tf: bool = False
    lowercase: bool = True


class TfidfVectorizer(Estimator):
    """Vocabulary of the ``max_features`` most frequent terms (vector index = term order),
    smoothed idf = ln((1 + n) / (1 + df)) + 1, raw (or 1 + ln) term counts, L2 norm."""

    def __init__(self, input_col: str, output_col: str = "tfidf", config: TfidfConfig | None = None):
        super().__init__()
        self.input_col, self.output_col, self.config = input_col, output_col, config or TfidfConfig()

    def _fit(self, df: DataFrame) -> "TfidfModel":
        cfg = self.config
        docs = with_tokens(df.select(self.input_col), F.coalesce(F.col(self.input_col), F.lit("")), "tokens", cfg.lowercase)
        found = T.frequent_terms(docs, "tokens", cfg.max_features, cfg.ngrams)
        rows = sorted(found.rows, key=lambda r: r[0].encode("utf-8", "surrogatepass"))   # at most max_features
        return TfidfModel(self.input_col, self.output_col, cfg, [r[0] for r in rows],
                          [T.smooth_idf(found.n_docs, r[2]) for r in rows], found.n_docs)


class TfidfModel(Saved, Model):
    def __init__(self, input_col, output_col, config, vocabulary, idf, n_docs):
        super().__init__()
        self.input_col, self.output_col, self.config = input_col, output_col, config
        self.vocabulary, self.idf, self.n_docs = vocabulary, idf, n_docs

    def slots(self) -> T.Slots:
        return T.vocabulary_slots(self.vocabulary, self.idf, self.config.ngrams, self.config.sublinear_tf)

    def _transform(self, df: DataFrame) -> DataFrame:
        if not self.vocabulary:
            return df.withColumn(self.output_col, F.lit(None))
        ship_package(df.sparkSession)
        tokens = f"_{self.output_col}_tokens"
        out = with_tokens(df, F.coalesce(F.col(self.input_col), F.lit("")), tokens, self.config.lowercase)
        vector = T.weight_vector(F.col(tokens), self.slots(), len(self.vocabulary))
        return out.withColumn(self.output_col, vector.alias(self.output_col, metadata=_width(len(self.vocabulary)))).drop(
            tokens)


def _width(n: int) -> dict:
    return {"ml_attr": {"num_attrs": n}}


def tfidf_long(docs: DataFrame, id_col: str, text_col: str, config: TfidfConfig | None = None) -> DataFrame:
    """TF-IDF weights in long form (id, term, weight), fitted on ``docs`` itself; each row is a document."""
    model = TfidfVectorizer(text_col, "tfidf", config).fit(docs)
    rows = with_tokens(docs.select(id_col, text_col), F.coalesce(F.col(text_col), F.lit("")), "tokens",
                       model.config.lowercase)
    return T.weight_rows(rows, id_col, "tokens", model.slots(), model.vocabulary).withColumnRenamed("slot", "term")


def hashing_long(docs: DataFrame, id_col: str, text_col: str, num_features: int = 5000) -> DataFrame:
    """Signed hashing vectorizer in long form (id, bucket, weight); rows are L2-normalised, empty buckets left out."""
    rows = with_tokens(docs.select(id_col, text_col), F.coalesce(F.col(text_col), F.lit("")), "tokens")
    return T.weight_rows(rows, id_col, "tokens", T.hashed_slots(num_features)).withColumnRenamed("slot", "bucket")


class SignedHashing(Saved, Model):
    """The signed hashing vectorizer as a stage: nothing to fit, one sparse L2-normalised vector a text."""

    def __init__(self, input_col: str, output_col: str, num_features: int = 5000, lowercase: bool = True):
        super().__init__()
        self.input_col, self.output_col, self.num_features, self.lowercase = input_col, output_col, num_features, lowercase

    def _transform(self, df: DataFrame) -> DataFrame:
        ship_package(df.sparkSession)
        tokens = f"_{self.output_col}_tokens"
        out = with_tokens(df, F.coalesce(F.col(self.input_col), F.lit("")), tokens, self.lowercase)
        vector = T.weight_vector(F.col(tokens), T.hashed_slots(self.num_features), self.num_features)
        return out.withColumn(self.output_col, vector.alias(self.output_col, metadata=_width(self.num_features))).drop(tokens)


# ----------------------------------------------------------------------------------------
# combined encoder
# ----------------------------------------------------------------------------------------

@dataclass
class EncodingConfig:
    categorical_method: str = "onehot"     # onehot / ordinal / target
    text_method: str = "tfidf"             # tfidf / hashing
    max_features: int = 5000
    ngrams: int = 2
    sublinear_tf: bool = False             # 1 + ln(tf) instead of tf
    drop_first: bool = False
    unknown: str = "ignore"                # unseen categories: ignore (zeros, or -1 for ordinal) or error
    feature_cap: int | None = None         # keep only the first columns, if asked for
    label_col: str | None = None
    passthrough: tuple = ()


class Encoder(Estimator):
    """numeric block ++ categorical block ++ text block -> one ``features`` vector.

    Long-text columns (mean length > 20) go to the text block only, never one-hot.
    Vector columns (pair products) join the numeric block. The width is whole unless ``feature_cap`` is set.
    """

    def __init__(self, config: EncodingConfig | None = None, output_col: str = "features"):
        super().__init__()
        self.config, self.output_col = config or EncodingConfig(), output_col

    def _fit(self, df: DataFrame) -> "EncoderModel":
        cfg = self.config
        if cfg.categorical_method not in ("onehot", "ordinal", "target"):
            raise ValueError(f"categorical_method is onehot, ordinal or target, not {cfg.categorical_method}")
        if cfg.text_method not in ("tfidf", "hashing"):
            raise ValueError(f"text_method is tfidf or hashing, not {cfg.text_method}")
        skip = set(cfg.passthrough) | ({cfg.label_col} if cfg.label_col else set())
        num = numeric_cols(df, skip)
        vectors = [f.name for f in df.schema.fields if isinstance(f.dataType, VectorUDT) and f.name not in skip]
        strs = string_cols(df, skip)
        text = [r["column_name"] for r in text_columns(df, strs, TEXT_MEAN_LENGTH).collect() if r["is_text"]] \
            if strs else []
        cat = [c for c in strs if c not in text]
        stages, block = [], [f"{c}_num" for c in num] + vectors
        if cat:
            if cfg.categorical_method == "onehot":
                idx, ohe = onehot_stages(cat)
                idx.unknown = "error" if cfg.unknown == "error" else "next"
                stages += [idx, ohe]
                block += [f"{c}_oh" for c in cat]
            elif cfg.categorical_method == "ordinal":
                stages.append(ordinal_indexer(cat, "error" if cfg.unknown == "error" else "minus_one"))
                block += [f"{c}_ord" for c in cat]
            else:
                if not cfg.label_col:
                    raise ValueError("target encoding needs label_col")
                stages.append(TargetEncoder(cat, cfg.label_col))
                block += [f"{c}_te" for c in cat]
        prep = df.withColumns({f"{c}_num": F.col(c).cast("double") for c in num})
        if text:
            prep = prep.withColumn("_text", concat_text(text))
            if cfg.text_method == "tfidf":
                stages.append(TfidfVectorizer("_text", "_text_vec", TfidfConfig(cfg.max_features, cfg.ngrams,
                                                                                cfg.sublinear_tf)))
            else:
                stages.append(SignedHashing("_text", "_text_vec", cfg.max_features))
            block.append("_text_vec")
        fitted = Pipeline(stages=stages).fit(prep)
        slices = {}
        if cat and cfg.categorical_method == "onehot" and cfg.drop_first:
            slices = {f"{c}_oh": list(range(1, n)) for c, n in zip(cat, fitted.stages[0].sizes)}
        model = EncoderModel(cfg, num, cat, text, fitted, self.output_col, None, block, slices)
        # rows of vectors without size metadata (pair products) tell their width only by a row
        first = model.transform(df.limit(1)).select(self.output_col).first()
        model.width = len(first[0]) if first else 0
        return model


class EncoderModel(Saved, Model):
    def __init__(self, config, num, cat, text, fitted, output_col, width, block=None, slices=None):
        super().__init__()
        self.config, self.num, self.cat, self.text = config, num, cat, text
        self.fitted, self.output_col, self.width = fitted, output_col, width
        self.block, self.slices = block or [], slices or {}

    def _transform(self, df: DataFrame) -> DataFrame:
        prep = df.withColumns({f"{c}_num": F.col(c).cast("double") for c in self.num})
        if self.text:
            prep = prep.withColumn("_text", concat_text(self.text))
        out = self.fitted.transform(prep)
        block = list(self.block)
        for col, idx in self.slices.items():        # drop_first: remove each one-hot block's first category
            out = VectorSlicer(inputCol=col, outputCol=f"{col}_df", indices=idx).transform(out)
            block[block.index(col)] = f"{col}_df"
        out = VectorAssembler(inputCols=block, outputCol="_assembled", handleInvalid="keep").transform(out)
        if self.config.feature_cap and (self.width or 0) > self.config.feature_cap:
            out = VectorSlicer(inputCol="_assembled", outputCol=self.output_col,
                               indices=list(range(self.config.feature_cap))).transform(out)
        else:
            out = out.withColumnRenamed("_assembled", self.output_col)
            if (self.width or 0) > SL.WIDE:
                out = out.withMetadata(self.output_col, _width(self.width))
        keep = list(self.config.passthrough) + ([self.config.label_col] if self.config.label_col else [])
        return out.select(*[c for c in keep if c in df.columns], self.output_col)
