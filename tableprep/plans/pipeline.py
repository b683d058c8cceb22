"""The full run: cleaning -> engineering -> encoding -> scaling -> selection ->
model choice -> tuning -> ensemble, every stage fitted on the train split only.

Returns the fitted ``PipelineModel`` (scoring new rows, batch or streaming), the run
log (one row per stage with validation/train scores, seconds and width) and the
long-form report. The model-ready train/test tables are checkpointed once to reliable
storage so the many fits of tuning and stacking do not recompute the preparation.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import cached_property

from pyspark.ml import Model, PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tableprep.operators import clean as C
from tableprep.operators import encode as E
from tableprep.operators import ensemble as ENS
from tableprep.operators import features as FE
from tableprep.operators import model as M
from tableprep.operators import scale as S
from tableprep.operators import select as SEL
from tableprep.operators import tune as T
from tableprep.operators.profile import infer_task
from tableprep.operators.runlog import report_frame, stage_scores
from tableprep.persist import Saved
from tableprep.session import cut_lineage
from tableprep.sources.files import Dataset, in_file_order

STAGES = ("cleaning", "engineering", "encoding", "scaling", "selection", "model_select", "tuning", "ensemble")


@dataclass
class PipelineConfig:
    cleaning: C.CleaningConfig = field(default_factory=C.CleaningConfig)
    engineering: FE.FeatureEngineeringConfig = field(default_factory=FE.FeatureEngineeringConfig)
    encoding: E.EncodingConfig = field(default_factory=E.EncodingConfig)
    scaling: S.ScalingConfig = field(default_factory=S.ScalingConfig)
    selection: SEL.FeatureSelectionConfig = field(default_factory=SEL.FeatureSelectionConfig)
    tuning: T.TuningConfig = field(default_factory=T.TuningConfig)
    ensemble_method: str = "voting"
    ensemble_top: int = 1          # best trials combined by the ensemble
    ensemble_weights: list | None = None
    test_percent: int = 20
    metric: str = "auto"           # accuracy or f1 for classes, r2 (auto) or rmse for numbers; ranks trials too
    model_name: str | None = None  # a rule-table name to use instead of the rule's choice


@dataclass
class PipelineResult:
    model: PipelineModel          # scores rows without a label column
    task: str
    run_log: DataFrame
    report: DataFrame
    predict_test: Callable[[], DataFrame]
    label_model: object = None    # StringIndexerModel: class index -> label (classification)

    @cached_property
    def test_predictions(self) -> DataFrame:
        """Made when asked for, as a large forest's trees are read by the driver for it."""
        return self.predict_test()


def _renamed(names: dict[str, str], wanted) -> tuple:
    return tuple(names.get(c, c) for c in wanted)


def with_row_id(df: DataFrame, name: str = "row_id") -> DataFrame:
    """A deterministic id for tables that have none: a hash of the row and, among equal rows, their running number.

    Two different rows with the same hash share the numbers, so an id stays unique (hash and number together).
    """
    from pyspark.sql import Window

    from tableprep.operators.stats import row_hash
    h = row_hash(df)
    twin = F.row_number().over(Window.partitionBy("_h").orderBy(F.lit(0)))
    return df.withColumn("_h", h).withColumn("_n", twin).withColumn(
        name, F.concat_ws("-", F.hex("_h"), "_n")).drop("_h", "_n")


def run(dataset: Dataset, config: "PipelineConfig | None" = None, run_id: str = "run") -> "PipelineResult":
    """From a routed file to a finished run: numbers the rows in file order and takes the pipeline of the modality.

    Of repeated rows the cleaner keeps the one with the smallest number, so the first one of the file stays.
    """
    df = in_file_order(dataset.df, "row_id")
    if dataset.modality == "text":
        return run_text_pipeline(df, "text", "row_id", run_id=run_id)
    return run_pipeline(df, dataset.label_col, "row_id", config, run_id)


def run_pipeline(df: DataFrame, label_col: str, id_col: str, config: PipelineConfig | None = None,
                 run_id: str = "run") -> PipelineResult:
    cfg = config or PipelineConfig()
    spark = df.sparkSession
    # standard names once, at the start: the label, the id and the configured names follow their columns
    names = dict(zip(df.columns, C.standardize_names(df.columns)))
    df = df.toDF(*names.values())
    label_col, id_col = names[label_col], names[id_col]
    id_cols = _renamed(names, cfg.cleaning.id_cols)
    task = infer_task(df, label_col)
    if task == "text":
        raise ValueError("no label: text-only runs have nothing to score")
    df = df.where(F.col(label_col).isNotNull())
    metric = cfg.metric
    log, reports, fitted = [], {}, []

    def record(stage, val, tr, secs, width, name):
        log.append((run_id, len(log) + 1, stage, float(val), float(tr), float(secs), int(width), name))

    # classes indexed 0..k-1 (sorted) over all labels, so that one found only in the test split has a number
    work_label, n_classes, idx_model = label_col, 0, None
    if task == "classification":
        work_label = "label_idx"
        while work_label in df.columns:
            work_label = "_" + work_label
        idx_model, df = M.index_label(df, label_col, work_label)
        n_classes = idx_model.sizes[0]
    train_raw, test_raw = M.hash_split(df, id_col, cfg.test_percent)
    keep = tuple(dict.fromkeys((id_col, label_col, work_label, *id_cols)))

    t0 = time.time()
    ccfg = _replace(cfg.cleaning, row_id_col=id_col, label_col=label_col, id_cols=tuple(c for c in keep if c != id_col))
    cleaner = C.DataCleaner(ccfg).fit(train_raw)
    train, test = cut_lineage(cleaner.transform(train_raw)), cleaner.without_dedup().transform(test_raw)
    fitted.append(cleaner.without_dedup())
    rows_clean = train.count()
    reports["cleaning"] = cleaner.report | {
        "shape_before": [cleaner.report["n_rows"], len(df.columns) - len(keep)],
        "shape_after": [rows_clean, len(train.columns) - len(keep)],
        "rows_removed": cleaner.report["n_rows"] - rows_clean}
    record("cleaning", 0.5, 0.5, time.time() - t0, len(train.columns) - len(keep), "none")

    t0 = time.time()
    fe = FE.FeatureEngineer(_replace(cfg.engineering, passthrough=keep)).fit(train)
    train, test = fe.transform(train), fe.transform(test)
    fitted.append(fe)
    reports["engineering"] = {"pair_products": len(fe.pair_names), "columns": len(train.columns) - len(keep)}
    record("engineering", 0.5, 0.5, time.time() - t0, len(train.columns) - len(keep) + max(0, len(fe.pair_names) - 1), "none")

    t0 = time.time()
    enc = E.Encoder(_replace(cfg.encoding, label_col=work_label,
                             passthrough=tuple(c for c in keep if c != work_label))).fit(train)
    leaked = {label_col, work_label, id_col} & {*enc.num, *enc.cat, *enc.text}
    if leaked:
        raise AssertionError(f"label or id among the features: {sorted(leaked)}")
    train, test = cut_lineage(enc.transform(train)), enc.transform(test)
    fitted.append(enc)
    sparse = bool(enc.text)
    reports["encoding"] = {"categorical_method": cfg.encoding.categorical_method, "categorical_cols": enc.cat,
                           "text_cols": enc.text, "width": enc.width}
    record("encoding", 0.5, 0.5, time.time() - t0, enc.width or 0, "none")

    t0 = time.time()
    sc = S.VectorScaler("features", "scaled", cfg.scaling, sparse=sparse).fit(train)
    train, test = sc.transform(train), sc.transform(test)
    fitted.append(sc)
    record("scaling", 0.5, 0.5, time.time() - t0, enc.width or 0, "none")

    t0 = time.time()
    sel = SEL.FeatureSelector("scaled", "x", work_label, _replace(cfg.selection, task=task)).fit(train)
    train, test = sel.transform(train), sel.transform(test)
    fitted.append(sel)
    width = len(sel.indices)
    record("selection", 0.5, 0.5, time.time() - t0, width, "none")

    cols = [id_col, work_label, "x"]
    train = cut_lineage(train.select(*cols))
    test = cut_lineage(test.select(*cols))

    t0 = time.time()
    meta = M.analyze(train, "x", sparse)
    name = cfg.model_name or M.model_rule(meta.n_samples, meta.n_features, meta.is_sparse, task)
    est = T.announced(M.build_estimator(name, n_classes, meta.n_samples, "x", work_label, parallelism=cfg.tuning.parallelism),
                      name, cfg.tuning)
    res = M.train_and_score(est, name, train, test, task, work_label, metric)
    reports["model_select"] = {"selected_model": name, "n_samples": meta.n_samples, "n_features": meta.n_features,
                               "is_sparse": meta.is_sparse, "density": meta.density, "score": res.val_score}
    record("model_select", res.val_score, res.train_score, time.time() - t0, width, name)

    t0 = time.time()
    tuned = T.tune(name, train, test, task, work_label, n_classes, meta.n_samples, "x",
                   _replace(cfg.tuning, metric=metric), (est, res))
    reports["tuning"] = {"best_params": tuned.best_params, "best_score": tuned.best_score, "trials": len(tuned.trials),
                         "failed": [t.error for t in tuned.trials if t.error]}
    record("tuning", tuned.best_score, tuned.ranked[0].train_score, time.time() - t0, width, name)

    t0 = time.time()
    picks = tuned.ranked[:max(1, cfg.ensemble_top)]
    if cfg.ensemble_method == "stacking":
        ens = ENS.build_ensemble([M.build_estimator(name, n_classes, meta.n_samples, "x", work_label, **t.params)
                                  for t in picks], "stacking", task, train, work_label, id_col)
    else:  # the trials' models are fitted already
        ens = ENS.EnsembleModel([t.model for t in picks], cfg.ensemble_method, task, weights=cfg.ensemble_weights)
    if len(picks) == 1 and cfg.ensemble_method != "stacking":
        val, tr = picks[0].val_score, picks[0].train_score
    else:
        val = M.score(ens.transform(test), task, work_label, "prediction", metric)
        tr = M.score(ens.transform(train), task, work_label, "prediction", metric)
    reports["ensemble"] = {"method": cfg.ensemble_method, "n_models": len(picks), "score": val}
    record("ensemble", val, tr, time.time() - t0, width, name)
    fitted.append(_SelectFeatures(id_col, work_label))
    fitted.append(ens)

    log_df = spark.createDataFrame(log, LOG_SCHEMA)
    scored = stage_scores(log_df.withColumn("task", F.lit(task)), "task", metric)
    return PipelineResult(PipelineModel(stages=fitted), task, scored, report_frame(spark, run_id, reports),
                          lambda: ens.transform(test), idx_model)


LOG_SCHEMA = ("run_id string, stage_idx int, stage string, val_score double, train_score double, seconds double, "
              "n_features int, model_name string")


def run_text_pipeline(df: DataFrame, text_col: str, id_col: str, label_col: str | None = None,
                      max_features: int = 1000, run_id: str = "text",
                      cleaning: C.CleaningConfig | None = None, ensemble_top: int = 3) -> PipelineResult:
    """Four stages for a text table: cleaning -> TF-IDF model choice -> tuning -> ensemble.

    Without labels the run is unsupervised: the vectorizer is the model and every stage
    scores as a text run. With labels the sparse rule picks a logistic model. Names are
    standardised once at entry (text, id and label follow) and every stage is fitted on
    the train split only, as in :func:`run_pipeline`.
    """
    spark = df.sparkSession
    names = dict(zip(df.columns, C.standardize_names(df.columns)))
    df = df.toDF(*names.values())
    text_col, id_col = names[text_col], names[id_col]
    label_col = names[label_col] if label_col is not None else None
    task = "text" if label_col is None else infer_task(df, label_col)
    log, reports, fitted = [], {}, []

    def record(stage, val, tr, secs, width, name):
        log.append((run_id, len(log) + 1, stage, float(val), float(tr), float(secs), int(width), name))

    work_label, n_classes, idx = label_col, 0, None
    if label_col is not None:
        df = df.where(F.col(label_col).isNotNull())
        if task == "classification":
            work_label = "label_idx"
            while work_label in df.columns:
                work_label = "_" + work_label
            idx, df = M.index_label(df, label_col, work_label)
            n_classes = idx.sizes[0]
    train_raw, test_raw = M.hash_split(df, id_col)

    t0 = time.time()
    ccfg = _replace(cleaning or C.CleaningConfig(), row_id_col=id_col, label_col=label_col,
                    id_cols=tuple(c for c in df.columns if c not in (text_col, id_col)))
    cleaner = C.DataCleaner(ccfg).fit(train_raw)
    train, test = cleaner.transform(train_raw), cleaner.without_dedup().transform(test_raw)
    fitted.append(cleaner.without_dedup())
    reports["cleaning"] = cleaner.report
    record("cleaning", 0.5, 0.5, time.time() - t0, 1, "none")

    t0 = time.time()
    tf = E.TfidfVectorizer(text_col, "x", E.TfidfConfig(max_features, 1)).fit(train)
    fitted.append(tf)
    width = len(tf.vocabulary)
    if label_col is None:
        reports["model_select"] = {"selected_model": "tf-idf", "n_features": width}
        record("model_select", 0.5, 0.5, time.time() - t0, width, "TfidfVectorizer")
        record("tuning", 0.5, 0.5, 0.0, width, "TfidfVectorizer")
        record("ensemble", 0.5, 0.5, 0.0, width, "TfidfVectorizer")
        preds = tf.transform(test)
    else:
        cols = [id_col, work_label, "x"]
        train = cut_lineage(tf.transform(train).select(*cols))
        test = cut_lineage(tf.transform(test).select(*cols))
        name = M.model_rule(0, width, True, task)
        est = M.build_estimator(name, n_classes, 0, "x", work_label)
        res = M.train_and_score(est, name, train, test, task, work_label)
        record("model_select", res.val_score, res.train_score, time.time() - t0, width, name)
        t0 = time.time()
        tuned = T.tune(name, train, test, task, work_label, n_classes, 0, "x", fitted=(est, res))
        record("tuning", tuned.best_score, tuned.ranked[0].train_score, time.time() - t0, width, name)
        t0 = time.time()
        ens = ENS.EnsembleModel([t.model for t in tuned.ranked[:max(1, ensemble_top)]], "voting", task)
        preds = ens.transform(test)
        record("ensemble", M.score(preds, task, work_label), M.score(ens.transform(train), task, work_label),
               time.time() - t0, width, name)
        reports["ensemble"] = {"method": "voting", "n_models": len(ens.models)}
        fitted.append(ens)
    log_df = spark.createDataFrame(log, LOG_SCHEMA)
    scored = stage_scores(log_df.withColumn("task", F.lit(task)), "task")
    return PipelineResult(PipelineModel(stages=fitted), task, scored, report_frame(spark, run_id, reports), lambda: preds, idx)


def _replace(obj, **kw):
    from dataclasses import replace
    return replace(obj, **kw)


class _SelectFeatures(Saved, Model):
    """Projection to (id, label, x) before the final model, as in training."""

    def __init__(self, id_col, label):
        super().__init__()
        self.id_col, self.label = id_col, label

    def _transform(self, df):
        cols = [c for c in dict.fromkeys([self.id_col, self.label, "x"]) if c in df.columns]
        return df.select(*cols)
