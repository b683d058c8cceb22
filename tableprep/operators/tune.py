"""Seeded random search over fixed parameter spaces on one hash split.

The prepared split is checkpointed once (reliable storage, survives executor loss) and
every trial fits on it; trials run as concurrent Spark jobs from a small thread pool,
results are ordered by trial index so the outcome does not depend on timing. Penalties of a
linear regression are not refitted at all: one pass gives them all (``ridge``). Regression forests of fewer trees or
levels are parts of the largest one, which is grown once (``forest``). A trial with the
settings of a model that is fitted already (the model choice's) takes that fit, and threads
that the other trials leave free fit the classes of one-vs-rest models.
"""

from __future__ import annotations

import itertools
import random
import time
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.ml import Estimator
from pyspark.ml.param import Param
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tableprep.operators import ridge
from tableprep.operators.model import SGD_ALPHA, TrainResult, build_estimator, higher_is_better, train_and_score

# Fixed parameter spaces of the search (None depth = unlimited).
PARAM_SPACES = {
    "LogisticRegression": {"C": [0.01, 0.1, 1, 10]},
    "RandomForestClassifier": {"n_estimators": [50, 100, 200], "max_depth": [None, 10, 20]},
    "RandomForestRegressor": {"n_estimators": [50, 100, 200], "max_depth": [None, 10, 20]},
    "SGD": {"alpha": [1e-4, 1e-3, 1e-2]},
    "GradientBoosting": {"n_estimators": [50, 100], "learning_rate": [0.01, 0.1]},
}


def space_for(name: str) -> dict:
    if name.startswith("RandomForestClassifier"):
        return PARAM_SPACES["RandomForestClassifier"]
    if name.startswith("RandomForestRegressor"):
        return PARAM_SPACES["RandomForestRegressor"]
    if "sgd" in name:
        return PARAM_SPACES["SGD"]
    if name.startswith("GBT"):
        return PARAM_SPACES["GradientBoosting"]
    if name == "LogisticRegression":
        return PARAM_SPACES["LogisticRegression"]
    return {}


def sample_trials(space: dict, n_trials: int, seed: int = 42) -> list[dict]:
    """Distinct draws from the grid (seeded); an empty space gives one trial."""
    if not space:
        return [{}]
    keys = sorted(space)
    grid = [dict(zip(keys, vals)) for vals in itertools.product(*[space[k] for k in keys])]
    rng = random.Random(seed)
    return rng.sample(grid, min(n_trials, len(grid)))


@dataclass
class TuningConfig:
    n_trials: int = 10
    metric: str = "auto"
    seed: int = 42
    parallelism: int = 4


@dataclass
class Trial:
    number: int
    params: dict
    val_score: float | None = None
    train_score: float | None = None
    seconds: float = 0.0
    model: object = None
    error: str | None = None


@dataclass
class TuneResult:
    best: object
    best_params: dict
    best_score: float
    trials: list          # Trial, in order
    ranked: list          # the trials that did not fail, best first


def settings(est: Estimator) -> tuple:
    """All that decides an estimator's fit: its class, attributes and parameters, but not how many fits run at a time."""
    own = {k: v for k, v in vars(est).items() if not k.startswith("_") and k != "uid" and not isinstance(v, Param)}
    params = {p.name: settings(v) if isinstance(v, Estimator) else v for p, v in est.extractParamMap().items()
              if p.name != "parallelism"}
    return type(est), own, params


def tune(name: str, train: DataFrame, test: DataFrame, task: str, label: str, n_classes: int, n_train: int,
         features_col: str = "features", config: TuningConfig | None = None,
         fitted: "tuple[Estimator, TrainResult] | None" = None) -> TuneResult:
    """Fit every trial; one that fails is kept with its error, and only if all fail is the first error raised.

    ``fitted`` is an estimator with its result on the same rows and metric: a trial with equal settings takes the result.
    """
    cfg = config or TuningConfig()
    sign = 1.0 if higher_is_better(cfg.metric) else -1.0
    errors: dict[int, Exception] = {}

    def run(i_params) -> Trial:
        i, params = i_params
        try:
            est = estimator(params, classes)
            got = fitted[1] if known(est) else train_and_score(est, name, train, test, task, label, cfg.metric)
        except Exception as e:  # noqa: BLE001 - a trial may fail in any way; the others go on
            errors[i] = e
            return Trial(i, params, error=f"{type(e).__name__}: {e}"[:500])
        return Trial(i, params, got.val_score, got.train_score, got.seconds, got.model)

    draws = sample_trials(space_for(name), cfg.n_trials, cfg.seed)
    if name == "LinearRegression(sgd)" and _one_pass(train, features_col, draws):
        return _tune_ridge(train, test, label, features_col, draws, cfg)
    if name.startswith("RandomForestRegressor"):
        return _tune_forest(name, train, test, label, n_train, features_col, draws, cfg, fitted)
    spread = None
    if name == "LinearRegression(sgd)":
        spread = train.agg(F.stddev_pop(F.col(label).cast("double"))).first()[0]

    def as_mllib(params: dict) -> dict:
        """MLlib divides a linear regression's penalty by the label's deviation; here it is the penalty itself."""
        return params | {"alpha": params["alpha"] * spread} if spread and "alpha" in params else params

    def estimator(params: dict, classes: int = 1):
        return build_estimator(name, n_classes, n_train, features_col, label, cfg.seed, **as_mllib(params), parallelism=classes)

    def known(est) -> bool:
        return fitted is not None and settings(est) == settings(fitted[0])

    open_trials = sum(not known(estimator(params)) for params in draws) if fitted else len(draws)
    classes = max(1, cfg.parallelism // max(1, open_trials))
    with ThreadPoolExecutor(max_workers=max(1, cfg.parallelism)) as pool:
        trials = sorted(pool.map(run, list(enumerate(draws))), key=lambda t: t.number)
    ranked = sorted((t for t in trials if t.error is None), key=lambda t: (-sign * t.val_score, t.number))
    if not ranked:
        raise errors[min(errors)]
    return TuneResult(ranked[0].model, ranked[0].params, ranked[0].val_score, trials, ranked)


def _one_pass(train: DataFrame, features_col: str, draws: list[dict]) -> bool:
    """Whether all trials follow from one matrix of co-moments that the driver can hold."""
    if any(set(d) - {"alpha"} or d.get("alpha", 0) < 0 for d in draws):
        return False
    first = train.select(features_col).first()
    return first is not None and len(first[0]) <= ridge.MOST_WIDTH


def _tune_ridge(train: DataFrame, test: DataFrame, label: str, features_col: str, draws: list[dict],
                cfg: TuningConfig) -> TuneResult:
    t0 = time.time()
    found = ridge.search(train, test, label, features_col, [d.get("alpha", SGD_ALPHA) for d in draws], cfg.metric)
    seconds = (time.time() - t0) / len(found)
    trials = [Trial(i, d, f.val_score, f.train_score, seconds, ridge.RidgeModel(features_col, f.coefficients, f.intercept))
              for i, (d, f) in enumerate(zip(draws, found))]
    sign = 1.0 if higher_is_better(cfg.metric) else -1.0
    ranked = sorted(trials, key=lambda t: (-sign * t.val_score, t.number))
    return TuneResult(ranked[0].model, ranked[0].params, ranked[0].val_score, trials, ranked)


def announced(est: Estimator, name: str, config: TuningConfig) -> Estimator:
    """The estimator of a model choice, told which parts of it the search will score."""
    if name.startswith("RandomForestRegressor"):
        trials = [build_estimator(name, seed=config.seed, **d) for d in sample_trials(space_for(name), config.n_trials, config.seed)]
        est.scored_with([(e.n_trees, e.max_depth) for e in trials])
    return est


def _tune_forest(name: str, train: DataFrame, test: DataFrame, label: str, n_train: int, features_col: str,
                 draws: list[dict], cfg: TuningConfig, fitted: "tuple[Estimator, TrainResult] | None") -> TuneResult:
    """All trials are parts of the one forest of the most trees and levels; each table is walked once for all of them."""
    t0 = time.time()
    cuts = [(e.n_trees, e.max_depth) for e in (build_estimator(name, 0, n_train, features_col, label, cfg.seed, **d) for d in draws)]
    whole = build_estimator(name, 0, n_train, features_col, label, cfg.seed, n_estimators=max(n for n, _ in cuts),
                            max_depth=max(d for _, d in cuts))
    forest = fitted[1].model if fitted is not None and settings(whole) == settings(fitted[0]) else whole.fit(train)
    val, tr = (forest.scores(df, label, cfg.metric, cuts) for df in (test, train))
    seconds = (time.time() - t0) / len(draws)
    trials = [Trial(i, d, val[i], tr[i], seconds, forest.cut(*cuts[i])) for i, d in enumerate(draws)]
    sign = 1.0 if higher_is_better(cfg.metric) else -1.0
    ranked = sorted(trials, key=lambda t: (-sign * t.val_score, t.number))
    return TuneResult(ranked[0].model, ranked[0].params, ranked[0].val_score, trials, ranked)


def trials_frame(spark: SparkSession, result: TuneResult) -> DataFrame:
    rows = [(t.number, str(sorted(t.params.items())), t.val_score, t.train_score, t.error) for t in result.trials]
    return spark.createDataFrame(rows, "trial int, params string, val_score double, train_score double, error string")
