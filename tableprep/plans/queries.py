"""Named queries over the shared tables: one per operator family, each a Spark plan whose
work grows with the tables. ``tableprep.plans.oracle`` holds the matching DuckDB SQL.

Floating outputs are rounded to 6 decimals on both sides so that summation order does
not change the value hash.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tableprep.functions.text import clean_text, clean_text_array, clean_text_map
from tableprep.operators import clean as C
from tableprep.operators import profile as P
from tableprep.sources.tables import read_table, view

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
CHUNK_TURNS = 16   # string lists hold the texts of at most this many consecutive turns


def query(fn):
    QUERIES[fn.__name__.removeprefix("q_")] = fn
    return fn


def r6(c):
    return F.round(c, 6)


# ----------------------------------------------------------------------------------------
# flagship: the fitted cleaner on dirty orders, summarised per priority
# ----------------------------------------------------------------------------------------

@query
def q_clean_orders_by_priority(spark, sf):
    df = view(spark, sf, "dirty_orders")
    model = C.DataCleaner(C.CleaningConfig(row_id_col="o_orderkey")).fit(df)
    out = model.transform(df)
    return out.groupBy("o_orderpriority").agg(
        F.count(F.lit(1)).alias("n_orders"),
        r6(F.avg("o_totalprice")).alias("mean_price"),
        r6(F.max("o_totalprice")).alias("max_price"),
        r6(F.avg("o_custkey")).alias("mean_custkey"))


# ----------------------------------------------------------------------------------------
# profile
# ----------------------------------------------------------------------------------------

@query
def q_dataset_profile(spark, sf):
    return P.dataset_profile(view(spark, sf, "dirty_orders"), exclude=("o_orderkey",))


@query
def q_null_ratios(spark, sf):
    out = P.column_null_ratios(view(spark, sf, "dirty_orders"))
    return out.select("column_name", r6(F.col("null_ratio")).alias("null_ratio"))


@query
def q_task_inference(spark, sf):
    labels = read_table(spark, sf, "labels")
    line = read_table(spark, sf, "lineitem")
    events = read_table(spark, sf, "events")
    return (P.task_summary(labels, "quality", "labels")
            .unionByName(P.task_summary(line, "l_extendedprice", "lineitem"))
            .unionByName(P.task_summary(line, "l_returnflag", "lineitem"))
            .unionByName(P.task_summary(events, "user_id", "events")))


@query
def q_text_column_detect(spark, sf):
    out = P.text_columns(read_table(spark, sf, "documents"))
    return out.select("column_name", r6(F.col("mean_length")).alias("mean_length"), "is_text")


@query
def q_numeric_inference(spark, sf):
    return P.numeric_text_stats(view(spark, sf, "dirty_part"), ["size_txt", "brand_txt"])


# ----------------------------------------------------------------------------------------
# cleaning
# ----------------------------------------------------------------------------------------

def _fill_price(spark, sf, strategy):
    df = view(spark, sf, "dirty_orders")
    vals = C.numeric_fill_values(df, ["o_totalprice"], strategy)
    return C.fill_values(df, vals).select("o_orderkey", r6(F.col("o_totalprice")).alias("o_totalprice"))


@query
def q_fill_median(spark, sf):
    return _fill_price(spark, sf, "median")


@query
def q_fill_mean(spark, sf):
    return _fill_price(spark, sf, "mean")


@query
def q_fill_zero(spark, sf):
    return _fill_price(spark, sf, "zero")


def _fill_priority(spark, sf, strategy):
    df = view(spark, sf, "dirty_orders")
    vals = C.categorical_fill_values(df, ["o_orderpriority"], strategy)
    return C.fill_values(df, vals).select("o_orderkey", "o_orderpriority")


@query
def q_fill_mode(spark, sf):
    return _fill_priority(spark, sf, "mode")


@query
def q_fill_constant(spark, sf):
    return _fill_priority(spark, sf, "constant")


LINE_NUMERIC = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query
def q_iqr_clip(spark, sf):
    df = read_table(spark, sf, "lineitem")
    out = C.iqr_clip(df, LINE_NUMERIC)
    return out.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
                      *[r6(F.col(c)).alias(c) for c in LINE_NUMERIC])


@query
def q_drop_high_missing(spark, sf):
    df = view(spark, sf, "dirty_orders")
    kept, dropped = C.drop_high_missing(df, 0.4)
    return kept.withColumn("o_orderdate", F.date_format("o_orderdate", "yyyy-MM-dd")).withColumn(
        "o_totalprice", r6(F.col("o_totalprice")))


@query
def q_dedup_keep_first(spark, sf):
    df = view(spark, sf, "dup_events")
    return C.dedup_keep_first(df, ["event_type", "user_bucket", "value_bucket"], "row_id")


@query
def q_clean_documents(spark, sf):
    df = read_table(spark, sf, "documents")
    return df.select("doc_id", clean_text("text").alias("text_clean"))


@query
def q_clean_pages(spark, sf):
    df = read_table(spark, sf, "pages")
    return df.select("page_id", clean_text("html").alias("html_clean"))


def string_lists(spark, sf) -> DataFrame:
    """Texts of each conversation as arrays of at most CHUNK_TURNS consecutive turns,
    and per conversation a role -> first text map (at most one entry per role)."""
    conv = read_table(spark, sf, "conversations")
    chunked = conv.withColumn("chunk", F.floor(F.col("turn") / CHUNK_TURNS).cast("bigint"))
    arrays = (chunked.groupBy("conv_id", "chunk")
              .agg(F.sort_array(F.collect_list(F.struct("turn", "text"))).alias("items"))
              .select("conv_id", "chunk", F.transform("items", lambda s: s["text"]).alias("texts")))
    return arrays


@query
def q_clean_string_array(spark, sf):
    arrays = string_lists(spark, sf).withColumn("texts", clean_text_array("texts"))
    return arrays.select("conv_id", "chunk", F.posexplode("texts").alias("pos", "text_clean")) \
        .withColumn("pos", F.col("pos").cast("bigint"))


@query
def q_clean_string_map(spark, sf):
    """Every text of a conversation in maps keyed by turn, at most CHUNK_TURNS entries a map."""
    conv = read_table(spark, sf, "conversations").withColumn("chunk", F.floor(F.col("turn") / CHUNK_TURNS).cast("bigint"))
    maps = conv.groupBy("conv_id", "chunk").agg(
        F.map_from_entries(F.collect_list(F.struct(F.col("turn").cast("string").alias("turn"), "text"))).alias("m"))
    cleaned = maps.withColumn("m", clean_text_map("m"))
    return cleaned.select("conv_id", "chunk", F.explode("m").alias("turn", "text_clean"))


@query
def q_rename_columns(spark, sf):
    orders = read_table(spark, sf, "orders")
    messy = orders.select(F.col("o_orderkey").alias(" Order Key "), F.col("o_custkey").alias("Cust-Key"),
                          F.col("o_totalprice").alias("total price"), F.col("o_orderstatus").alias("TOTAL PRICE"),
                          F.col("o_orderpriority").alias("total_price_1"))
    return C.rename_columns(messy)


@query
def q_numeric_convert(spark, sf):
    df = view(spark, sf, "dirty_part")
    out, converted = C.infer_numeric(df, ["size_txt", "brand_txt"])
    return out.select("p_partkey", "size_txt", "brand_txt")


# ----------------------------------------------------------------------------------------
# features
# ----------------------------------------------------------------------------------------

from tableprep.functions.datetime import datetime_parts  # noqa: E402
from tableprep.operators import encode as E  # noqa: E402
from tableprep.operators import features as FE  # noqa: E402


@query
def q_text_features(spark, sf):
    df = read_table(spark, sf, "documents")
    cols = FE.text_feature_columns("text")
    return df.select("doc_id", *cols[:3], r6(cols[3]).alias("text_uppercase_ratio"))


@query
def q_datetime_features(spark, sf):
    return read_table(spark, sf, "orders").select("o_orderkey", *datetime_parts("o_orderdate"))


@query
def q_datetime_features_events(spark, sf):
    return read_table(spark, sf, "events").select("event_id", *datetime_parts("ts"))


@query
def q_frequency_encode(spark, sf):
    df = read_table(spark, sf, "orders")
    cols = ["o_orderpriority", "o_orderstatus"]
    maps = FE.frequency_maps(df, cols)
    out = df
    for i, c in enumerate(cols):
        m = maps.where(F.col("ci") == i).select("value", "freq")
        out = FE.apply_lookup(out, c, m, f"{c}_freq")
    return out.select("o_orderkey", *[r6(F.col(f"{c}_freq")).alias(f"{c}_freq") for c in cols])


@query
def q_frequency_encode_join(spark, sf):
    """Frequency of each line's part among all lines (a lookup measured and broadcast)."""
    df = read_table(spark, sf, "lineitem")
    maps = FE.frequency_maps(df, ["l_partkey"]).select("value", "freq")
    out = FE.apply_lookup(df, "l_partkey", maps, "l_partkey_freq")
    return out.select("l_orderkey", "l_linenumber", "l_partkey", r6(F.col("l_partkey_freq")).alias("l_partkey_freq"))


@query
def q_frequency_encode_salted(spark, sf):
    """Frequency of each line's order, a near-unique key, through the salted shuffle join (no broadcast allowed)."""
    df = read_table(spark, sf, "lineitem")
    maps = FE.frequency_maps(df, ["l_orderkey"]).select("value", "freq")
    out = FE.apply_lookup(df, "l_orderkey", maps, "l_orderkey_freq", max_broadcast_bytes=0)
    return out.select("l_orderkey", "l_linenumber", "l_partkey", F.round("l_orderkey_freq", 9).alias("l_orderkey_freq"))


@query
def q_interactions(spark, sf):
    df = read_table(spark, sf, "lineitem")
    cols = FE.interaction_columns(LINE_NUMERIC)
    return df.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
                     *[r6(c).alias(n) for c, n in zip(cols, [f"{a}_x_{b}" for i, a in enumerate(LINE_NUMERIC)
                                                              for b in LINE_NUMERIC[i + 1:]])])


@query
def q_interactions_array(spark, sf):
    """Pair products of a wide input held as one array column, exploded to long form."""
    df = read_table(spark, sf, "lineitem").withColumn("arr", F.array(*[F.col(c) for c in LINE_NUMERIC]))
    out = df.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
                    F.posexplode(FE.interaction_array("arr", len(LINE_NUMERIC))).alias("pair", "product"))
    return out.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.col("pair").cast("bigint"),
                      r6(F.col("product")).alias("product"))


@query
def q_polynomial2(spark, sf):
    df = read_table(spark, sf, "lineitem")
    cols = ["l_quantity", "l_discount", "l_tax"]
    poly = FE.polynomial_columns(cols, 2)
    names = [df.select(c).columns[0] for c in poly]
    return df.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
                     *[r6(c).alias(n) for c, n in zip(poly, names)])


@query
def q_feature_engineer(spark, sf):
    df = read_table(spark, sf, "orders")
    model = FE.FeatureEngineer(FE.FeatureEngineeringConfig(passthrough=("o_orderkey",))).fit(df)
    out = model.named_pairs(model.transform(df)).drop(*model.cat)
    return out.select(*[r6(F.col(c)).alias(c) if t == "double" else F.col(c) for c, t in out.dtypes])


# ----------------------------------------------------------------------------------------
# encoding
# ----------------------------------------------------------------------------------------

ORDER_CATS = ["o_orderstatus", "o_orderpriority"]


@query
def q_onehot_long(spark, sf):
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array
    df = read_table(spark, sf, "orders")
    idx, ohe = E.onehot_stages(ORDER_CATS)
    asm = VectorAssembler(inputCols=[f"{c}_oh" for c in ORDER_CATS], outputCol="v")
    out = Pipeline(stages=[idx, ohe, asm]).fit(df).transform(df)
    arr = out.select("o_orderkey", F.posexplode(vector_to_array("v")).alias("slot", "value"))
    return arr.where(F.col("value") != 0).select("o_orderkey", F.col("slot").cast("bigint"), "value")


@query
def q_ordinal_encode(spark, sf):
    df = read_table(spark, sf, "orders")
    out = E.ordinal_indexer(ORDER_CATS).fit(df).transform(df)
    return out.select("o_orderkey", *[F.col(f"{c}_ord").cast("bigint").alias(f"{c}_ord") for c in ORDER_CATS])


@query
def q_target_encode(spark, sf):
    df = read_table(spark, sf, "orders")
    out = E.TargetEncoder(ORDER_CATS, "o_totalprice").fit(df).transform(df)
    return out.select("o_orderkey", *[r6(F.col(f"{c}_te")).alias(f"{c}_te") for c in ORDER_CATS])


@query
def q_target_encode_oof(spark, sf):
    df = read_table(spark, sf, "orders")
    model = E.TargetEncoder(ORDER_CATS, "o_totalprice", folds=5, id_col="o_orderkey").fit(df)
    out = model.transform_oof(df)
    return out.select("o_orderkey", *[r6(F.col(f"{c}_te")).alias(f"{c}_te") for c in ORDER_CATS])


def _clean_docs(spark, sf):
    return read_table(spark, sf, "documents").select("doc_id", clean_text("text").alias("text"))


@query
def q_tfidf_top_terms(spark, sf):
    docs = E.with_tokens(_clean_docs(spark, sf), F.col("text")).select("tokens")
    return E.top_terms(docs, 1000)


@query
def q_tfidf_weights(spark, sf):
    out = E.tfidf_long(_clean_docs(spark, sf), "doc_id", "text", E.TfidfConfig(5000, 2))
    return out.select("doc_id", "term", r6(F.col("weight")).alias("weight"))


@query
def q_tfidf_sublinear(spark, sf):
    out = E.tfidf_long(_clean_docs(spark, sf), "doc_id", "text", E.TfidfConfig(50000, 1, sublinear_tf=True))
    return out.select("doc_id", "term", r6(F.col("weight")).alias("weight"))


@query
def q_hashing_tf(spark, sf):
    """Signed hashing vectorizer in long form: one row a document and non-zero bucket, L2-normalised."""
    out = E.hashing_long(_clean_docs(spark, sf), "doc_id", "text", 5000)
    return out.select("doc_id", "bucket", r6(F.col("weight")).alias("weight"))


# NaN prices and missing dates, cleaned

NAN_NUMERIC = ["price"]


@query
def q_nan_null_ratio(spark, sf):
    out = P.column_null_ratios(view(spark, sf, "nan_orders"))
    return out.select("column_name", r6(F.col("null_ratio")).alias("null_ratio"))


@query
def q_nan_profile(spark, sf):
    return P.dataset_profile(view(spark, sf, "nan_orders"), exclude=("o_orderkey",))


@query
def q_nan_fill(spark, sf):
    """Median for NaN and null prices, the most frequent date for missing dates, prices clipped after filling."""
    df = view(spark, sf, "nan_orders")
    model = C.DataCleaner(C.CleaningConfig(row_id_col="o_orderkey", drop_duplicates=False)).fit(df)
    out = model.transform(df)
    return out.select("o_orderkey", r6(F.col("price")).alias("price"), F.date_format("placed", "yyyy-MM-dd").alias("placed"))


# ----------------------------------------------------------------------------------------
# scaling and selection
# ----------------------------------------------------------------------------------------

from tableprep.operators import scale as S  # noqa: E402
from tableprep.operators import select as SEL  # noqa: E402
from tableprep.operators import slots as SL  # noqa: E402

CONST_COLS = ["o_totalprice", "k13", "k_const"]


def _scaled(spark, sf, method):
    df = view(spark, sf, "const_features")
    out = S.scale_columns(df, CONST_COLS, S.ScalingConfig(method=method))
    return out.select("o_orderkey", *[r6(F.col(c)).alias(c) for c in CONST_COLS])


@query
def q_scale_standard(spark, sf):
    return _scaled(spark, sf, "standard")


@query
def q_scale_minmax(spark, sf):
    return _scaled(spark, sf, "minmax")


@query
def q_scale_robust(spark, sf):
    return _scaled(spark, sf, "robust")


def _selection(spark, df, names, label, cfg):
    vec = S.assemble(df, names)
    sel = SEL.FeatureSelector("features", "selected", label, cfg)
    scores, keep = sel.statistics(vec)
    return SEL.selection_report(spark, names, scores, keep)


def _line_features(spark, sf):
    return read_table(spark, sf, "lineitem").withColumn(
        "net_price", F.col("l_extendedprice") * (1 - F.col("l_discount"))).withColumn("const_one", F.lit(1.0))


def _order_features(spark, sf):
    return read_table(spark, sf, "orders").select(
        "o_orderkey", "o_orderstatus", "o_totalprice", F.col("o_custkey").cast("double").alias("o_custkey"),
        (F.col("o_orderkey") % 13).cast("double").alias("k13"), F.lit(7.0).alias("k_const"))


ORDER_FEATURES = ["o_totalprice", "o_custkey", "k13", "k_const"]


@query
def q_select_variance(spark, sf):
    return _selection(spark, view(spark, sf, "const_features"), CONST_COLS, None,
                      SEL.FeatureSelectionConfig(method="variance"))


@query
def q_select_correlation(spark, sf):
    names = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "net_price", "const_one"]
    return _selection(spark, _line_features(spark, sf), names, None,
                      SEL.FeatureSelectionConfig(method="correlation"))


@query
def q_select_kbest_anova(spark, sf):
    return _selection(spark, _order_features(spark, sf), ORDER_FEATURES, "o_orderstatus",
                      SEL.FeatureSelectionConfig(method="kbest", k=2, task="classification"))


@query
def q_select_kbest_regression(spark, sf):
    names = ["l_quantity", "l_discount", "l_tax", "net_price"]
    return _selection(spark, _line_features(spark, sf), names, "l_extendedprice",
                      SEL.FeatureSelectionConfig(method="kbest", k=2, task="regression"))


@query
def q_select_model(spark, sf):
    return _selection(spark, _order_features(spark, sf), ORDER_FEATURES, "o_orderstatus",
                      SEL.FeatureSelectionConfig(method="model", task="classification"))


# statistics by slot

@query
def q_slot_quantiles(spark, sf):
    """Quartiles of the price in each of 5,000 groups of parts, all from one plan."""
    lines = read_table(spark, sf, "lineitem").select((F.col("l_partkey") % 5000).alias("slot"), "l_extendedprice")
    out = SL.grouped_quantiles(lines, "slot", "l_extendedprice", [0.25, 0.5, 0.75])
    return out.select("slot", "prob", r6(F.col("quantile")).alias("quantile"))


@query
def q_slot_quantiles_sparse(spark, sf):
    """Quantiles of sparse rows: an order has one non-zero entry, in the slot of its status and priority."""
    orders = read_table(spark, sf, "orders").select(
        F.concat_ws("/", "o_orderstatus", "o_orderpriority").alias("slot"), (F.col("o_totalprice") - 150000).alias("value"))
    out = SL.grouped_quantiles(orders, "slot", "value", [0.01, 0.03, 0.5, 0.97, 0.99], orders.count())
    return out.select("slot", "prob", r6(F.col("quantile")).alias("quantile"))


@query
def q_slot_scale_customer(spark, sf):
    """Customers as sparse rows (one-hot of the near-unique name and of the segment, the balance), scaled and selected by
    slot tables: no array as wide as the names in any task or on the driver."""
    df = read_table(spark, sf, "customer").select("c_custkey", "c_name", "c_mktsegment", "c_acctbal")
    index = E.CategoryIndexer(["c_name", "c_mktsegment"]).fit(df)
    n_names, n_segments = index.sizes
    rows = index.transform(df).select(
        "c_custkey", F.array(F.col("c_name_idx").cast("long"), (F.col("c_mktsegment_idx") + n_names).cast("long"),
                             F.lit(n_names + n_segments).cast("long")).alias("slots"),
        F.array(F.lit(1.0), F.lit(1.0), F.col("c_acctbal")).alias("values"))
    out = SL.SlotScaler("c_custkey", threshold=1e-4).fit(rows).transform(rows)
    long = out.select("c_custkey", F.explode(F.arrays_zip("slots", "values")).alias("e"))
    return long.select("c_custkey", F.col("e.slots").alias("slot"), r6(F.col("e.values")).alias("value"))


# ----------------------------------------------------------------------------------------
# models, metrics, ensembles
# ----------------------------------------------------------------------------------------

from tableprep.operators import ensemble as ENS  # noqa: E402
from tableprep.operators import model as M  # noqa: E402
from tableprep.operators import runlog as RL  # noqa: E402
from tableprep.operators import tune as TU  # noqa: E402
from tableprep.operators.select import significant  # noqa: E402


@query
def q_hash_split(spark, sf):
    df = read_table(spark, sf, "orders")
    b = E.hash_bucket("o_orderkey", 100)
    return df.select("o_orderkey", b.alias("bucket"),
                     F.when(b < 20, F.lit("test")).otherwise(F.lit("train")).alias("split"))


def _rule_row(df, name, label, n_features, sparse):
    is_string = dict(df.dtypes)[label] == "string"
    prof = df.agg(F.count(F.lit(1)).alias("n_samples"), F.countDistinct(label).alias("n_distinct"))
    task = F.when(F.lit(is_string) | (F.col("n_distinct") < 20), F.lit("classification")).otherwise("regression")
    prof = prof.select(F.lit(name).alias("dataset"), "n_samples", F.lit(n_features).cast("bigint").alias("n_features"),
                       F.lit(sparse).alias("is_sparse"), task.alias("task"))
    return prof.withColumn("model_name", M.model_rule_expr(F.col("n_samples"), F.col("n_features"),
                                                           F.col("is_sparse"), F.col("task")))


@query
def q_model_rule(spark, sf):
    corpus = view(spark, sf, "text_corpus")
    return (_rule_row(read_table(spark, sf, "orders"), "orders_status", "o_orderstatus", 4, False)
            .unionByName(_rule_row(read_table(spark, sf, "lineitem"), "lineitem_price", "l_extendedprice", 3, False))
            .unionByName(_rule_row(corpus, "text_quality", "quality", 1000, True))
            .unionByName(_rule_row(read_table(spark, sf, "customer"), "customer_segment", "c_mktsegment", 2, False))
            .unionByName(_rule_row(read_table(spark, sf, "embeddings"), "embeddings_label", "label", 64, False))
            .unionByName(_rule_row(read_table(spark, sf, "labels"), "labels_toxic", "toxic", 1, False)))


@query
def q_metric_accuracy_f1(spark, sf):
    out = M.classification_metrics(view(spark, sf, "baseline_pred"), "o_orderstatus", "pred_status")
    return out.select(r6(F.col("accuracy")).alias("accuracy"), r6(F.col("f1_weighted")).alias("f1_weighted"))


@query
def q_metric_r2_rmse(spark, sf):
    out = M.regression_metrics(view(spark, sf, "baseline_pred"), "o_totalprice", "pred_price")
    return out.select(r6(F.col("r2")).alias("r2"), r6(F.col("rmse")).alias("rmse"))


def group_mode_predictor(df: DataFrame, key: str, label: str, out: str) -> DataFrame:
    """Predict, per value of ``key``, its most frequent label (smallest on ties)."""
    counts = df.groupBy(key, label).agg(F.count(F.lit(1)).alias("n"))
    best = counts.groupBy(key).agg(F.min(F.struct((-F.col("n")).alias("nn"), F.col(label).alias("v"))).alias("b"))
    lookup = best.select(F.col(key).cast("string").alias("value"), F.col("b.v").cast("double").alias("pred"))
    return FE.apply_lookup(df, key, lookup, out, default=0.0, value_col="pred")


@query
def q_weighted_vote(spark, sf):
    df = view(spark, sf, "dup_events")
    for i, key in enumerate(["event_type", "user_bucket", "value_bucket"]):
        df = group_mode_predictor(df, key, "label", f"p{i}")
    pred = ENS.weighted_average([F.col("p0"), F.col("p1"), F.col("p2")], [1.0, 2.0, 1.0], classification=True)
    return df.select("row_id", "label", pred.alias("prediction"))


@query
def q_linear_fit(spark, sf):
    from pyspark.ml.regression import LinearRegression
    df = S.assemble(read_table(spark, sf, "lineitem"), ["l_quantity"])
    m = LinearRegression(featuresCol="features", labelCol="l_extendedprice", regParam=0.0, solver="normal").fit(df)
    row = spark.range(1).select(F.lit(float(m.coefficients[0])).alias("slope"),
                                F.lit(float(m.intercept)).alias("intercept"),
                                F.lit(float(m.summary.r2)).alias("r2"))
    return row.select(*[significant(F.col(c)).alias(c) for c in ("slope", "intercept", "r2")])


def _orders_model_data(spark, sf, binary=False):
    df = _order_features(spark, sf)
    if binary:
        df = df.withColumn("o_orderstatus", F.when(F.col("o_orderstatus") == "F", "F").otherwise("notF"))
    idx, df = M.index_label(df, "o_orderstatus", "label")
    df = S.assemble(df, ["o_totalprice", "o_custkey", "k13"]).select("o_orderkey", "label", "features")
    from tableprep.session import cut_lineage
    return tuple(cut_lineage(d) for d in M.hash_split(df, "o_orderkey"))


def _fit_report(spark, est, name, train, test, task="classification", label="label"):
    res = M.train_and_score(est, name, train, test, task, label)
    return spark.createDataFrame([(name, "val_score", res.val_score), (name, "train_score", res.train_score)],
                                 "model string, metric string, value double")


def _priority_model_data(spark, sf):
    """Orders with their one-hot priority; label: status is F."""
    from pyspark.ml import Pipeline
    df = read_table(spark, sf, "orders").select(
        "o_orderkey", "o_orderpriority", "o_totalprice", (F.col("o_orderstatus") == "F").cast("double").alias("label"))
    idx, ohe = E.onehot_stages(["o_orderpriority"])
    out = Pipeline(stages=[idx, ohe]).fit(df).transform(df)
    return out.withColumnRenamed("o_orderpriority_oh", "features")


def _group_rates(model, df):
    """Probability of the label by priority, as the model says it."""
    from pyspark.ml.functions import vector_to_array
    scored = model.transform(df)
    return scored.groupBy("o_orderpriority").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg(vector_to_array("probability")[1]), 4).alias("rate"))


@query
def q_logistic_fit(spark, sf):
    """Unpenalised logistic model on a one-hot category: its probabilities are the group rates."""
    from pyspark.ml.classification import LogisticRegression
    df = _priority_model_data(spark, sf)
    return _group_rates(LogisticRegression(maxIter=1000, tol=1e-12, regParam=0.0).fit(df), df)


@query
def q_svc_fit(spark, sf):
    train, test = _orders_model_data(spark, sf, binary=True)
    return _fit_report(spark, M.build_estimator("LinearSVC(sgd-hinge)", 2), "LinearSVC", train, test)


@query
def q_tree_fit(spark, sf):
    """A tree on a one-hot category that decides the label: every leaf is pure."""
    odd = F.col("o_orderpriority").substr(1, 1).cast("int") % 2
    df = _priority_model_data(spark, sf).withColumn("label", odd.cast("double"))
    return _group_rates(M.build_estimator("DecisionTreeClassifier(depth=10)").fit(df), df)


def _group_means(model, df):
    return model.transform(df).groupBy("o_orderpriority").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg("prediction"), 4).alias("mean_price"))


@query
def q_forest_fit(spark, sf):
    """A forest of one regression tree without resampling on a one-hot category: the group means."""
    df = _priority_model_data(spark, sf).withColumn("label", F.col("o_totalprice"))
    est = M.build_estimator("RandomForestRegressor", n_estimators=1, max_depth=10).setBootstrap(False)
    return _group_means(est.fit(df), df)


@query
def q_gbt_fit(spark, sf):
    """One boosting step of a regression tree at full rate on a one-hot category: the group means."""
    df = _priority_model_data(spark, sf).withColumn("label", F.col("o_totalprice"))
    est = M.build_estimator("GBTRegressor", n_estimators=1, learning_rate=1.0).setMaxDepth(6)
    return _group_means(est.fit(df), df)


def _line_model_data(spark, sf, names):
    lines = read_table(spark, sf, "lineitem").select("l_orderkey", "l_extendedprice", *names)
    return M.hash_split(S.assemble(lines, names), "l_orderkey")


@query
def q_tune_search(spark, sf):
    """Penalties of a linear model searched on one and on two features: fits and scores of all trials."""
    from tableprep.operators import ridge
    parts = []
    for names in (["l_quantity"], ["l_quantity", "l_discount"]):
        train, test = _line_model_data(spark, sf, names)
        found = ridge.search(train, test, "l_extendedprice", "features", [1e-4, 1e-2, 1.0, 100.0])
        best = max(found, key=lambda t: t.val_score)
        parts += [(len(names), t.alpha, *[float(x) for x in t.coefficients][:1], float(t.coefficients[-1]), t.intercept,
                   t.train_score, t.val_score, t is best) for t in found]
    rows = spark.createDataFrame(parts, "n_features int, alpha double, first double, last double, intercept double, "
                                        "train_r2 double, val_r2 double, chosen boolean")
    return rows.select("n_features", "alpha", *[significant(F.col(c), 6).alias(c) for c in ("first", "last", "intercept")],
                       *[r6(F.col(c)).alias(c) for c in ("train_r2", "val_r2")], "chosen")


@query
def q_tune_classes(spark, sf):
    """The random search over logistic models of three classes, trial by trial."""
    train, test = _orders_model_data(spark, sf)
    res = TU.tune("LogisticRegression", train, test, "classification", "label", 3, 12000)
    return TU.trials_frame(spark, res)


def _ensemble_report(spark, sf, method):
    train, test = _orders_model_data(spark, sf)
    ests = [M.build_estimator("LogisticRegression", 3, 1000), M.build_estimator("DecisionTreeClassifier(depth=10)")]
    ens = ENS.build_ensemble(ests, method, "classification", train, "label", "o_orderkey")
    val = M.score(ens.transform(test), "classification", "label")
    return spark.createDataFrame([(method, "val_score", val)], "model string, metric string, value double")


@query
def q_soft_voting(spark, sf):
    return _ensemble_report(spark, sf, "voting")


@query
def q_stacking(spark, sf):
    return _ensemble_report(spark, sf, "stacking")


@query
def q_text_classify(spark, sf):
    corpus = view(spark, sf, "text_corpus").withColumn("text", clean_text("text"))
    train, test = M.hash_split(corpus, "doc_id")
    tf = E.TfidfVectorizer("text", "features", E.TfidfConfig(1000, 2)).fit(train)
    from tableprep.session import cut_lineage
    train, test = (cut_lineage(tf.transform(d).select("doc_id", F.col("quality").cast("double").alias("label"),
                                                        "features")) for d in (train, test))
    est = M.build_estimator(M.model_rule(0, 1000, True, "classification"), 2)
    return _fit_report(spark, est, "LogisticRegression(sgd-log)", train, test)


def _pipeline_log(df, label, id_col, run_id, config=None):
    from tableprep.plans.pipeline import run_pipeline
    res = run_pipeline(df, label, id_col, config, run_id=run_id)
    return res.run_log.select("run_id", "stage_idx", "stage", "model_name", "n_features",
                              r6(F.col("val_score")).alias("val_score"), r6(F.col("train_score")).alias("train_score"))


@query
def q_pipeline_customer(spark, sf):
    """All eight stages on customer, its near-unique name included, predicting the market segment."""
    return _pipeline_log(read_table(spark, sf, "customer"), "c_mktsegment", "c_custkey", "customer")


@query
def q_pipeline_part(spark, sf):
    """All eight stages on part (three string columns, one of them text), predicting the retail price."""
    return _pipeline_log(read_table(spark, sf, "part"), "p_retailprice", "p_partkey", "part")


@query
def q_pipeline_text(spark, sf):
    """The four text stages on documents without labels: the test split's weights, term by term."""
    from pyspark.ml.functions import vector_to_array
    from tableprep.plans.pipeline import run_text_pipeline
    docs = read_table(spark, sf, "documents").select("doc_id", "text")
    res = run_text_pipeline(docs, "text", "doc_id", None, run_id="documents")
    slots = F.posexplode(vector_to_array("x")).alias("slot", "weight")
    return res.test_predictions.select("doc_id", slots).where(F.col("weight") != 0).select(
        "doc_id", F.col("slot").cast("bigint"), r6(F.col("weight")).alias("weight"))


@query
def q_stage_score(spark, sf):
    out = RL.stage_scores(view(spark, sf, "run_log"))
    return out.select("run_id", "stage_idx", r6(F.col("score")).alias("score"))


@query
def q_run_leaderboard(spark, sf):
    out = RL.leaderboard(RL.stage_scores(view(spark, sf, "run_log")))
    return out.select("run_id", "n_stages", r6(F.col("mean_score")).alias("mean_score"), "success",
                      r6(F.col("progress")).alias("progress"))


# ----------------------------------------------------------------------------------------
# scans, reports and combinations with a closed form
# ----------------------------------------------------------------------------------------

def _folder(spark, name: str) -> str:
    """A new folder in the checkpoint folder, for a file that a query writes and scans again."""
    import uuid

    from tableprep.session import ensure_checkpoint_dir
    return f"{ensure_checkpoint_dir(spark)}/{uuid.uuid4().hex}/{name}"


@query
def q_csv_route(spark, sf):
    """Customers written as CSV with a header, routed by name and header, with inferred types and the label named."""
    from tableprep.sources.files import route
    path = _folder(spark, "customer.csv")
    read_table(spark, sf, "customer").write.option("header", True).csv(path)
    ds = route(spark, path, "c_mktsegment", ("c_custkey",))
    return ds.df.select(F.col("c_custkey").cast("bigint"), "c_name", F.col("c_nationkey").cast("bigint"), "c_acctbal",
                        "c_mktsegment", F.lit(ds.modality).alias("modality"), F.lit(ds.label_col).alias("label_col"),
                        F.lit(len(ds.feature_cols)).cast("bigint").alias("n_features"))


@query
def q_text_lines(spark, sf):
    """Documents written as text and scanned line by line: lines by length."""
    from tableprep.sources.files import route
    path = _folder(spark, "documents.txt")
    read_table(spark, sf, "documents").select("text").write.text(path)
    lines = route(spark, path).df
    return lines.groupBy(F.length("text").cast("bigint").alias("n_chars")).agg(F.count(F.lit(1)).alias("n_lines"))


@query
def q_file_order(spark, sf):
    """Orders written as sorted CSV files and numbered in file order, however the files are split."""
    from tableprep.sources.files import in_file_order, read_csv
    path = _folder(spark, "orders.csv")
    read_table(spark, sf, "orders").select("o_orderkey", "o_totalprice").orderBy("o_orderkey").write.option(
        "header", True).csv(path)
    rows = in_file_order(read_csv(spark, path, "o_orderkey bigint, o_totalprice double"), "row_number")
    return rows.select("o_orderkey", "o_totalprice", F.col("row_number").cast("bigint"))


@query
def q_clean_report(spark, sf):
    """The cleaner's report in long form: rows seen, columns dropped, columns made numeric."""
    found = C.DataCleaner(C.CleaningConfig(row_id_col="o_orderkey")).fit(view(spark, sf, "dirty_orders")).report
    report = RL.report_frame(spark, "orders", {"cleaning": found})
    return report.where(F.col("key").isin("n_rows", "dropped_columns_missing", "converted_numeric"))


@query
def q_model_analysis(spark, sf):
    """Rows, width and density of orders' one-hot status and priority, as the model choice sees them."""
    from pyspark.ml import Pipeline
    df = read_table(spark, sf, "orders").select("o_orderstatus", "o_orderpriority")
    cols = ["o_orderstatus", "o_orderpriority"]
    rows = Pipeline(stages=list(E.onehot_stages(cols))).fit(df).transform(df)
    meta = M.analyze(S.assemble(rows, [f"{c}_oh" for c in cols], "x"), "x", True)
    return spark.createDataFrame([(meta.n_samples, meta.n_features, meta.is_sparse, meta.density)],
                                 "n_samples long, n_features long, is_sparse boolean, density double").withColumn(
        "density", r6(F.col("density")))


@query
def q_select_informative(spark, sf):
    """Selection by model where one feature decides the label and the others are constant."""
    df = read_table(spark, sf, "orders").select(
        (F.col("o_orderkey") % 13).cast("double").alias("k13"), F.lit(7.0).alias("seven"), F.lit(1.0).alias("one"),
        (F.col("o_orderkey") % 13 >= 7).cast("double").alias("label"))
    return _selection(spark, df, ["k13", "seven", "one"], "label", SEL.FeatureSelectionConfig(
        method="model", task="classification"))


@query
def q_soft_voting_rates(spark, sf):
    """Soft vote of two unpenalised logistic models, each on its own one-hot category: the mean of two group rates."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    df = read_table(spark, sf, "orders").select(
        "o_orderpriority", (F.col("o_orderkey") % 13).cast("string").alias("k13"),
        (F.col("o_orderstatus") == "F").cast("double").alias("label"))
    cols = ["o_orderpriority", "k13"]
    data = Pipeline(stages=list(E.onehot_stages(cols))).fit(df).transform(df)
    from tableprep.session import cut_lineage
    data = cut_lineage(data.select(*cols, "label", *[f"{c}_oh" for c in cols]))
    models = [LogisticRegression(featuresCol=f"{c}_oh", maxIter=1000, tol=1e-12, regParam=0.0).fit(data) for c in cols]
    out = ENS.EnsembleModel(models, "voting", "classification").transform(data)
    return out.groupBy(*cols, F.col("prediction").cast("bigint").alias("prediction")).agg(F.count(F.lit(1)).alias("n"))


@query
def q_stacking_means(spark, sf):
    """Stacking one tree on a one-hot category: the line of the label on its out-of-fold group means."""
    from tableprep.session import cut_lineage
    df = cut_lineage(_priority_model_data(spark, sf).select(
        "o_orderkey", "o_orderpriority", "features", F.col("o_totalprice").alias("label")))
    est = M.build_estimator("RandomForestRegressor", n_estimators=1, max_depth=10).setBootstrap(False)
    ens = ENS.build_ensemble([est], "stacking", "regression", df, "label", "o_orderkey")
    row = spark.createDataFrame([(float(ens.meta.coefficients[0]), float(ens.meta.intercept))],
                                "slope double, intercept double")
    return row.select(*[significant(F.col(c), 6).alias(c) for c in ("slope", "intercept")])


@query
def q_boost_classes(spark, sf):
    """One boosting step at full rate for three classes on a one-hot category: the probabilities of each group."""
    from pyspark.ml.functions import vector_to_array
    data = _priority_model_data(spark, sf).select("o_orderkey", "o_orderpriority", "features").join(
        read_table(spark, sf, "orders").select("o_orderkey", "o_orderstatus"), "o_orderkey")
    _, data = M.index_label(data, "o_orderstatus", "label")
    model = M.build_estimator("GBTClassifier", 3, n_estimators=1, learning_rate=1.0, max_depth=6).fit(data)
    rows = model.transform(data).select("o_orderpriority", F.posexplode(vector_to_array("probability")).alias("class", "p"))
    return rows.groupBy("o_orderpriority", F.col("class").cast("bigint").alias("class")).agg(
        F.count(F.lit(1)).alias("n"), r6(F.avg("p")).alias("probability"))


@query
def q_correlated_terms(spark, sf):
    """Pairs of the corpus's 5,000 most frequent terms that go together in documents (presence, |r| above 0.95)."""
    docs = E.with_tokens(_clean_docs(spark, sf), F.col("text")).select("doc_id", F.array_distinct("tokens").alias("tokens"))
    from tableprep.operators import terms as TE
    words = sorted(r[0] for r in TE.frequent_terms(docs, "tokens", 5000, 1).rows)
    vector = TE.count_vector(F.col("tokens"), words)
    pairs = SL.correlated_slots(docs.select(vector.alias("v")), "v", 0.95)
    names = spark.createDataFrame(list(enumerate(words)), "slot long, term string")  # 5,000 rows
    left, right = (F.broadcast(names.toDF(k, t)) for k, t in (("i", "term_a"), ("j", "term_b")))
    return pairs.join(left, "i").join(right, "j").select("term_a", "term_b", r6(F.col("r")).alias("r"))
