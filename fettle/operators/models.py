"""Candidate regressors on MLlib: fit, compare, select, deploy, version."""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from datetime import datetime, timezone
from math import ceil

import numpy as np
from pyspark import inheritable_thread_target
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.evaluation import RegressionEvaluator
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.regression import LinearRegression
from pyspark.ml.tuning import CrossValidator
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fettle import policy as P
from fettle.functions.scales import clip, hash_bucket
from fettle.operators import scoring, spread, trees as grown

FEATURES, SCALED, PREDICTION = "_features", "_scaled", "prediction"


@dataclass(frozen=True)
class Candidate:
    name: str
    display_name: str
    is_tree: bool
    stages: tuple


def _assembler(inputs: Sequence[str]) -> VectorAssembler:
    return VectorAssembler(inputCols=list(inputs), outputCol=FEATURES, handleInvalid="keep")


def _scaled(inputs: Sequence[str], regressor) -> tuple:
    scaler = StandardScaler(inputCol=FEATURES, outputCol=SCALED, withMean=True, withStd=True)
    return (_assembler(inputs), scaler, regressor)


def linear(inputs: Sequence[str] = P.MODEL_INPUTS) -> Candidate:
    """Least squares by the normal equations: one pass, a 12x12 system on the driver."""
    fit = LinearRegression(featuresCol=SCALED, labelCol="label", solver="normal", regParam=0.0)
    return Candidate("linear_regression", "Linear regression", False, _scaled(inputs, fit))


def ridge(inputs: Sequence[str] = P.MODEL_INPUTS, alpha: float = 1.0) -> Candidate:
    fit = LinearRegression(featuresCol=SCALED, labelCol="label", solver="normal", elasticNetParam=0.0, regParam=alpha)
    return Candidate("ridge_regression", "Ridge regression", False, _scaled(inputs, fit))


def lasso(inputs: Sequence[str] = P.MODEL_INPUTS, alpha: float = 0.1) -> Candidate:
    fit = LinearRegression(featuresCol=SCALED, labelCol="label", solver="normal", elasticNetParam=1.0, regParam=alpha)
    return Candidate("lasso_regression", "Lasso regression", False, _scaled(inputs, fit))


def forest(inputs: Sequence[str] = P.MODEL_INPUTS, trees: int = 300) -> Candidate:
    fit = grown.SubtreeForest(featuresCol=FEATURES, labelCol="label", numTrees=trees, maxDepth=14,
                              minInstancesPerNode=5, seed=P.SEED)
    return Candidate("random_forest", "Random forest", True, (_assembler(inputs), fit))


def boosting(inputs: Sequence[str] = P.MODEL_INPUTS, rounds: int = 400) -> Candidate:
    fit = grown.BarrierBoosting(featuresCol=FEATURES, labelCol="label", maxIter=rounds, maxDepth=3, stepSize=0.05,
                                subsamplingRate=0.8, seed=P.SEED)
    return Candidate("gradient_boosting", "Gradient boosting", True, (_assembler(inputs), fit))


def histogram_boosting(inputs: Sequence[str] = P.MODEL_INPUTS, rounds: int = 400) -> Candidate:
    """The trees bin every input already; fifteen leaves fit in depth four."""
    fit = grown.BarrierBoosting(featuresCol=FEATURES, labelCol="label", maxIter=rounds, maxDepth=4, maxBins=256,
                                stepSize=0.05, seed=P.SEED)
    return Candidate("hist_gradient_boosting", "Histogram gradient boosting", True, (_assembler(inputs), fit))


def candidates(inputs: Sequence[str] = P.MODEL_INPUTS) -> list[Candidate]:
    return [linear(inputs), ridge(inputs), lasso(inputs), forest(inputs), boosting(inputs), histogram_boosting(inputs)]


def with_fold(rows: DataFrame, person: str = "personnel_id", folds: int = P.CV_FOLDS) -> DataFrame:
    """Person-disjoint fold number from a hash."""
    return rows.withColumn("fold", hash_bucket(F.col(person), P.SEED + 2, folds))


def fold_moments(rows: DataFrame, inputs: Sequence[str] = P.MODEL_INPUTS) -> DataFrame:
    """Sums of products of (1, inputs, label) per fold: all a linear fit needs, from one pass."""
    terms = [F.lit(1.0), *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in inputs], F.col("label")]
    sums = [F.sum(terms[i] * terms[j]).alias(f"s{i}_{j}") for i in range(len(terms)) for j in range(i, len(terms))]
    return rows.groupBy("fold").agg(*sums)


def _moment_matrix(row, size: int) -> np.ndarray:
    m = np.zeros((size, size))
    for i in range(size):
        for j in range(i, size):
            m[i, j] = m[j, i] = row[f"s{i}_{j}"]
    return m


def _solve(m: np.ndarray, penalty: float, l1: bool) -> tuple[float, np.ndarray]:
    """Penalised least squares on standardised inputs from a moment matrix."""
    n, mean = m[0, 0], m[0, 1:] / m[0, 0]
    cov = m[1:, 1:] / n - np.outer(mean, mean)
    sd = np.sqrt(np.maximum(np.diag(cov)[:-1], 0.0))
    keep = sd > 1e-12
    scale = np.where(keep, sd, 1.0)
    gram, rhs = cov[:-1, :-1] / np.outer(scale, scale), cov[:-1, -1] / scale
    w = np.zeros(len(scale))
    if not l1:
        k = np.flatnonzero(keep)
        w[k] = np.linalg.solve(gram[np.ix_(k, k)] + penalty * np.eye(len(k)), rhs[k])
    else:
        for _ in range(1000):
            before = w.copy()
            for j in np.flatnonzero(keep):
                r = rhs[j] - gram[j] @ w + gram[j, j] * w[j]
                w[j] = np.sign(r) * max(abs(r) - penalty, 0.0) / gram[j, j]
            if np.abs(w - before).max() < 1e-10:
                break
    w = w / scale
    return mean[-1] - mean[:-1] @ w, w


def _cross_validated(folds: list[np.ndarray], penalty: float, l1: bool) -> float:
    """Mean squared error over held-out folds; leaving one out is a subtraction."""
    whole, squared = sum(folds), 0.0
    for held in folds:
        kept = whole - held
        # the L2 grid is stated per sum of squares, the L1 grid per mean
        intercept, w = _solve(kept, penalty if l1 else penalty / kept[0, 0], l1)
        v = np.concatenate([[-intercept], -w, [1.0]])
        squared += v @ held @ v
    return float(squared / whole[0, 0])


def lasso_grid(whole: np.ndarray, points: int = 100, ratio: float = 1e-3) -> list[float]:
    """From the smallest penalty that zeroes every weight down to a thousandth of it."""
    n, mean = whole[0, 0], whole[0, 1:] / whole[0, 0]
    cov = whole[1:, 1:] / n - np.outer(mean, mean)
    sd = np.sqrt(np.maximum(np.diag(cov)[:-1], 0.0))
    top = np.abs(np.where(sd > 1e-12, cov[:-1, -1] / np.where(sd > 1e-12, sd, 1.0), 0.0)).max()
    return list(np.geomspace(top, top * ratio, points))


def choose_penalty(rows: DataFrame, l1: bool, inputs: Sequence[str] = P.MODEL_INPUTS) -> tuple[float, list]:
    """MLlib ``regParam`` with the least person-grouped error, and the error per grid value.

    One pass over the data whatever the grid: a fold is one small moment matrix.
    """
    size = len(inputs) + 2
    folds = [_moment_matrix(r, size) for r in fold_moments(with_fold(rows), inputs).collect()]  # one row per fold
    whole = sum(folds)
    grid = lasso_grid(whole) if l1 else list(RIDGE_GRID)
    errors = [_cross_validated(folds, penalty, l1) for penalty in grid]
    best = float(grid[min(range(len(errors)), key=errors.__getitem__)])
    return (best if l1 else best / float(whole[0, 0])), list(zip(grid, errors))


# fixed values: 25 points from 1e-3 to 1e3
RIDGE_GRID = tuple(10 ** (-3 + 6 * i / 24) for i in range(25))


def fit(rows: DataFrame, candidate: Candidate) -> tuple[PipelineModel, float]:
    started = time.perf_counter()
    model = Pipeline(stages=list(candidate.stages)).fit(rows)
    return model, time.perf_counter() - started


def grouped_cv_r2(rows: DataFrame, candidate: Candidate, folds: int = P.CV_FOLDS) -> tuple[float, float]:
    """Mean and spread of R2 over person-disjoint folds."""
    cv = CrossValidator(
        estimator=Pipeline(stages=list(candidate.stages)), estimatorParamMaps=[{}], numFolds=folds, foldCol="fold",
        evaluator=RegressionEvaluator(labelCol="label", metricName="r2"), parallelism=2)
    data = with_fold(rows).persist()
    fitted = cv.fit(data)
    data.unpersist()
    return float(fitted.avgMetrics[0]), float(fitted.stdMetrics[0])


def predict(model: PipelineModel, rows: DataFrame, inputs: Sequence[str] = P.MODEL_INPUTS) -> DataFrame:
    """Score rows on 0-100; a missing input column is an error, a missing value scores as 0."""
    missing = [c for c in inputs if c not in rows.columns]
    if missing:
        raise KeyError(f"inputs missing: {missing}")
    filled = rows.fillna(0.0, subset=list(inputs))
    out = model.transform(filled)
    drop = [c for c in (FEATURES, SCALED, PREDICTION) if c in out.columns]
    return out.withColumn("predicted", clip(F.col(PREDICTION), 0.0, 100.0)).drop(*drop)


def compare(rows: DataFrame, options: Sequence[Candidate], with_cv: bool = False) -> DataFrame:
    """Fit every candidate on one person-disjoint split; one row of test metrics each."""
    return fit_all(rows, options, with_cv)[0]


def fit_all(rows: DataFrame, options: Sequence[Candidate], with_cv: bool = False) -> tuple[DataFrame, dict[str, PipelineModel]]:
    """The rows of ``compare`` and the fitted models by name."""
    made = measure_all(rows, options, with_cv)
    return measured_rows(rows.sparkSession, [row for row, _ in made]), {row[0]: model for row, model in made}


ROWS_PER_TASK = 2_000


def measure_all(rows: DataFrame, options: Sequence[Candidate], with_cv: bool = False) -> list[tuple[tuple, PipelineModel]]:
    """Per candidate its measured row and its model."""
    train, test = rows.filter(F.col("split") != "test"), rows.filter(F.col("split") == "test").persist()
    size = train.count()
    train = train.repartition(_tasks(rows, size, ROWS_PER_TASK)).persist()

    def measure(option: Candidate) -> tuple[tuple, PipelineModel]:
        model, seconds = fit(train, option)
        scored = predict(model, test)
        m = scoring.regression_metrics(scored, "label", "predicted").crossJoin(
            scoring.band_metrics(scored, "label", "predicted")).first().asDict()
        cv = grouped_cv_r2(train, option) if with_cv else (None, None)
        return (option.name, option.is_tree, float(m["r2"]), float(m["mae"]), float(m["rmse"]),
                m["band_accuracy"], m["high_recall"], m["high_precision"], m["escalation_recall"], seconds, *cv), model

    # boosting keeps few tasks busy: side by side the candidates fill the cluster
    with ThreadPoolExecutor(max_workers=max(1, len(options))) as pool:
        out = list(pool.map(inheritable_thread_target(rows.sparkSession)(measure), options))
    train.unpersist()
    test.unpersist()
    return out


def _tasks(rows: DataFrame, size: int, per_task: int) -> int:
    return max(1, min(rows.sparkSession.sparkContext.defaultParallelism, ceil(size / per_task)))


def measured_rows(spark: SparkSession, rows: Sequence[tuple]) -> DataFrame:
    return spark.createDataFrame(list(rows), (
        "model_name string, is_tree boolean, r2 double, mae double, rmse double, band_accuracy double, "
        "high_recall double, high_precision double, escalation_recall double, seconds double, cv_r2 double, "
        "cv_r2_sd double"))


def optimality_gap(rows: DataFrame, model: PipelineModel, penalty: float = 0.0, l1: bool = False,
                   inputs: Sequence[str] = P.MODEL_INPUTS) -> float:
    """How far a linear fit is from the conditions of its optimum, in standard deviations of the label.

    On scaled inputs the covariance with the residual must be penalty x weight (L2), or
    penalty x sign of the weight and nowhere above the penalty (L1). One pass over the rows.
    """
    line = model.stages[-1]
    scored = model.transform(rows.fillna(0.0, subset=list(inputs))).withColumn("_r", F.col("label") - F.col(PREDICTION))
    row = scored.agg(F.stddev_samp("label").alias("sd"), F.avg("_r").alias("bias"),
                     *[F.covar_samp(F.col(c), F.col("_r")).alias(f"c{i}") for i, c in enumerate(inputs)],
                     *[F.stddev_samp(F.col(c)).alias(f"s{i}") for i, c in enumerate(inputs)]).first()
    gaps = [abs(row["bias"])]
    for i, w in enumerate(line.coefficients.toArray().tolist()):
        if not row[f"s{i}"]:
            continue
        pull = row[f"c{i}"] / row[f"s{i}"]
        if not l1:
            gaps.append(abs(pull - penalty * w))
        else:
            gaps.append(abs(pull - penalty * np.sign(w)) if abs(w) > 1e-9 else max(0.0, abs(pull) - penalty))
    return float(max(gaps) / row["sd"])


def deploy(rows: DataFrame, candidate: Candidate) -> tuple[PipelineModel, DataFrame]:
    """Fit on the fit slice only, calibrate on the calibration slice."""
    model, _ = fit(rows.filter(F.col("split") == "fit"), candidate)
    held = predict(model, rows.filter(F.col("split") == "calibration"))
    return model, scoring.calibrate(held, "label", "predicted", "pseudonym_id")


@dataclass(frozen=True)
class Training:
    """One training run: what every candidate measured, the selected one fitted and calibrated."""

    measured: DataFrame
    selected: str
    model: PipelineModel
    calibration: DataFrame
    fitted: dict[str, PipelineModel]


def tuned(rows: DataFrame, candidate: Candidate) -> Candidate:
    """A candidate at full size, its penalty chosen on the rows outside the test split."""
    train = rows.filter(F.col("split") != "test")
    if candidate.name == "ridge_regression":
        # MLlib divides an L2 penalty by the deviation of the label, an L1 penalty it does not
        spread_ = train.agg(F.stddev_samp("label").alias("sd")).first()["sd"] or 1.0
        return ridge(alpha=choose_penalty(train, l1=False)[0] * spread_)
    if candidate.name == "lasso_regression":
        return lasso(alpha=choose_penalty(train, l1=True)[0])
    return candidate


def tuned_candidates(rows: DataFrame) -> list[Candidate]:
    """All six at full size, the penalties chosen on the rows outside the test split."""
    return [tuned(rows, c) for c in candidates()]


class Comparison:
    """Candidates of one training run over settled rows; each is fitted once, when its row is first asked for.

    Without ``options`` they are the six at full size, each tuned before its fit.
    """

    def __init__(self, rows: DataFrame, options: Sequence[Candidate] | None = None):
        self.rows, self.tune = rows, options is None
        self.options = {c.name: c for c in (candidates() if options is None else options)}
        self.made: dict[str, tuple[tuple, PipelineModel]] = {}

    def _fit(self, names: Sequence[str]) -> None:
        missing = [n for n in names if n not in self.made]
        if not missing:
            return
        if self.tune:
            self.options.update({n: tuned(self.rows, self.options[n]) for n in missing})
        self.made.update(zip(missing, measure_all(self.rows, [self.options[n] for n in missing])))

    def measured(self, names: Sequence[str] | None = None) -> DataFrame:
        names = list(names or self.options)
        self._fit(names)
        return measured_rows(self.rows.sparkSession, [self.made[n][0] for n in names])

    def fitted(self, name: str) -> PipelineModel:
        self._fit([name])
        return self.made[name][1]


def train(rows: DataFrame, options: Sequence[Candidate] | None = None) -> Training:
    """Fit every candidate, select by the measured rows, fit the selected one for deployment and calibrate it."""
    return train_compared(Comparison(spread.settle(rows), options))


def train_compared(run: Comparison) -> Training:
    """The same over candidates of which some may be fitted already."""
    measured = run.measured()
    selected = scoring.select_model(measured).first()["selected"]
    model, calibration = deploy(run.rows, run.options[selected])
    return Training(measured, selected, model, spread.settle(calibration), {n: run.fitted(n) for n in run.options})


def scorer(model: PipelineModel) -> Callable[[DataFrame], DataFrame]:
    """A fitted model as the scorer of a workload."""
    return lambda rows: predict(model, rows).withColumnRenamed("predicted", scoring.SCORE)


def refit_on_all(rows: DataFrame, candidate: Candidate) -> PipelineModel:
    return fit(rows, candidate)[0]


# --- versioned storage ----------------------------------------------------------

def save(model: PipelineModel, folder: str, meta: dict, mark_current: bool = True, version: str | None = None) -> str:
    """Model and metadata under a new version; older versions are never touched."""
    if not str(meta.get("label_provenance", "")).strip():
        raise ValueError("label_provenance is required: say what the metrics were measured against")
    spark = SparkSession.active()
    version = version or "v" + datetime.now(timezone.utc).strftime("%Y%m%dT%H%M%S%fZ")
    model.write().save(f"{folder}/{version}/model")
    record = {
        "version": version, "feature_names": list(P.MODEL_INPUTS), "moderate_min": P.MODERATE_MIN,
        "high_min": P.HIGH_MIN, "created_at": datetime.now(timezone.utc).isoformat(), **meta,
    }
    line = spark.createDataFrame([(version, json.dumps(record))], "version string, metadata string")
    line.coalesce(1).write.json(f"{folder}/{version}/metadata")
    if mark_current:
        mark(folder, version)
    return version


def mark(folder: str, version: str) -> None:
    """Make a stored version the current one; marking an older one rolls back."""
    spark = SparkSession.active()
    if version not in versions(folder):
        raise FileNotFoundError(f"no version {version} in {folder}")
    line = spark.createDataFrame([(version, datetime.now(timezone.utc).isoformat())], "version string, marked_at string")
    line.coalesce(1).write.mode("append").json(f"{folder}/CURRENT")


def versions(folder: str) -> list[str]:
    """Stored versions, newest last (one short metadata row each)."""
    spark = SparkSession.active()
    rows = spark.read.schema("version string, metadata string").json(f"{folder}/v*/metadata")
    return sorted(r.version for r in rows.select("version").collect())


def current_version(folder: str) -> str | None:
    """The version marked last, else the newest stored one."""
    spark = SparkSession.active()
    stored = versions(folder)
    marks = spark.createDataFrame([], "version string, marked_at string")
    if _exists(spark, f"{folder}/CURRENT"):
        marks = spark.read.schema(marks.schema).json(f"{folder}/CURRENT")
    marked = marks.agg(F.max_by("version", "marked_at")).first()[0]
    return marked if marked in stored else (stored[-1] if stored else None)


def _exists(spark: SparkSession, path: str) -> bool:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


def load(folder: str, version: str | None = None) -> tuple[PipelineModel, dict]:
    """Model and metadata; refused when its inputs are not the ones now supplied."""
    spark = SparkSession.active()
    version = version or current_version(folder)
    if version is None:
        raise FileNotFoundError(f"no model stored in {folder}")
    row = spark.read.schema("version string, metadata string").json(f"{folder}/{version}/metadata").first()
    meta = json.loads(row.metadata)
    if meta["feature_names"] != list(P.MODEL_INPUTS):
        raise ValueError(f"version {version} expects {meta['feature_names']}, not {list(P.MODEL_INPUTS)}")
    return PipelineModel.load(f"{folder}/{version}/model"), meta
