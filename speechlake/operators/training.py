"""Baseline detectors on pyspark.ml: fit on train, calibrate and pick a threshold on dev, score test once."""

import json
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.ml import Model, Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import StandardScaler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from speechlake.operators import metrics as M
from speechlake.sources.shared import written


def with_features(rows: DataFrame, vector: str, label: str = "label") -> DataFrame:
    """Add features (a vector) and weight (balanced); rows with a number that is not finite are refused by an error."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    checked = F.when(bad, F.raise_error(F.lit("a feature is not finite"))).otherwise(F.col(vector).cast("array<double>"))
    per = rows.groupBy(label).agg(F.count(F.lit(1)).alias("_n"))
    total = rows.agg(F.count(F.lit(1)).alias("_all"), F.countDistinct(label).alias("_k"))
    weights = per.join(F.broadcast(total)).select(label, (F.col("_all") / (F.col("_k") * F.col("_n"))).alias("weight"))
    return rows.join(F.broadcast(weights), label).withColumn("features", array_to_vector(checked))  # a row per class


def fit_logistic(train: DataFrame, strength: float = 1.0, label: str = "label") -> PipelineModel:
    """Standardise on train and fit a balanced logistic regression; strength is the inverse of the penalty, as a sum over rows."""
    n = train.count()
    scaler = StandardScaler(inputCol="features", outputCol="scaled", withMean=True)
    model = LogisticRegression(featuresCol="scaled", labelCol=label, weightCol="weight", regParam=1 / (strength * max(n, 1)), standardization=False, maxIter=200, aggregationDepth=2)
    return Pipeline(stages=[scaler, model]).fit(train)


def fit_boosted(train: DataFrame, dev: DataFrame, rounds: int = 30, depth: int = 3, label: str = "label") -> PipelineModel:
    """Boosted trees that stop early on dev."""
    both = train.withColumn("_dev", F.lit(False)).unionByName(dev.withColumn("_dev", F.lit(True)))
    model = GBTClassifier(featuresCol="features", labelCol=label, weightCol="weight", maxIter=rounds, maxDepth=depth, validationIndicatorCol="_dev", seed=7)
    return Pipeline(stages=[model]).fit(both)


def scores(model: Model, rows: DataFrame) -> DataFrame:
    """Rows with score, the probability of the positive class."""
    return model.transform(rows).withColumn("score", vector_to_array("probability")[1]).drop("probability", "rawPrediction", "prediction", "scaled")


@dataclass(frozen=True)
class Calibrator:
    """A column expression for calibrated scores, its kind and a note on why it is not a better one."""

    kind: str
    apply: Callable[[Column], Column] | None  # none where it takes a join
    note: str | None = None
    params: tuple = ()

    def calibrated(self, rows: DataFrame, score: str = "score", name: str = "score") -> DataFrame:
        """rows with the calibrated score under a name; null stays null, and is what isotonic calibration makes of nan."""
        if self.apply is None:
            return _interpolated(rows, score, name, *self.params)
        return rows.withColumn(name, self.apply(F.col(score)))


def calibrator(kind: str, params: tuple = (), note: str | None = None) -> Calibrator:
    """The calibrator of a kind from its parameters: none, (slope, intercept) or (boundaries, values)."""
    if kind == "identity":
        return Calibrator(kind, lambda s: s, note)
    if kind == "platt":
        a, b = params
        return Calibrator(kind, lambda s: 1 / (1 + F.exp(-(a * _logit(s) + b))), note, (a, b))
    if kind != "isotonic":
        raise ValueError(f"unknown calibrator {kind}")
    return Calibrator(kind, None, note, params)


def _interpolated(rows: DataFrame, score: str, name: str, xs: Sequence[float], ys: Sequence[float]) -> DataFrame:
    """rows with the score's value between the boundaries that it lies between, kept within 0 and 1; the ends' values beyond them.

    The boundaries are a table, so the plan does not grow with them. The range of scores is cut into as many cells
    as there are boundaries; a stretch between two of them lies in the cells that it crosses, a score in one,
    and an equi-join on cells brings them together.
    """
    first, last, cells = xs[0], xs[-1], max(1, len(xs))
    cell = lambda x: F.floor((x - first) / max(last - first, 1e-300) * cells)
    known = F.col(score).isNotNull() & ~F.isnan(score)
    out = F.when(F.col(score) < first, F.lit(ys[0])).when(F.col(score) >= last, F.lit(ys[-1])).otherwise(F.col("_y0") + (F.col("_y1") - F.col("_y0")) * (F.col(score) - F.col("_x0")) / (F.col("_x1") - F.col("_x0")))
    table = rows.sparkSession.createDataFrame(list(zip(xs, xs[1:], ys, ys[1:], strict=False)), "_x0 double, _x1 double, _y0 double, _y1 double").where("_x0 < _x1")
    table = written(table.withColumn("_c", F.explode(F.sequence(cell(F.col("_x0")), cell(F.col("_x1"))))), "boundaries")
    at = rows.withColumn("_cell", F.when(known & (F.col(score) >= first) & (F.col(score) < last), cell(F.col(score))))
    met = at.join(table, (F.col("_cell") == F.col("_c")) & (F.col(score) >= F.col("_x0")) & (F.col(score) < F.col("_x1")), "left")
    return met.withColumn(name, F.when(known, F.least(F.greatest(out, F.lit(0.0)), F.lit(1.0)))).drop("_cell", "_c", "_x0", "_x1", "_y0", "_y1")


def _logit(p: Column) -> Column:
    q = F.least(F.greatest(p, F.lit(1e-12)), F.lit(1 - 1e-12))
    return F.log(q) - F.log(1 - q)


def fit_calibrator(dev: DataFrame, kind: str = "platt", label: str = "label", score: str = "score", least: int = 5, isotonic_least: int = 100) -> Calibrator:
    """Fit on dev. Without `least` rows of each class the identity, with a note; isotonic needs more rows, else Platt."""
    n1, n0 = dev.agg(F.count_if(F.col(label) == 1), F.count_if(F.col(label) == 0)).first()
    if min(n1, n0) < least:
        return calibrator("identity", note=f"{n1} and {n0} rows, at least {least} of each class are needed")
    note = None
    if kind == "isotonic" and n0 + n1 < isotonic_least:
        kind, note = "platt", f"{n0 + n1} rows, isotonic needs {isotonic_least}"
    if kind == "isotonic":
        model = IsotonicRegression(featuresCol="_s", labelCol=label).fit(dev.select(F.col(score).alias("_s"), F.col(label).cast("double")))
        xs, ys = model.boundaries.toArray().tolist(), model.predictions.toArray().tolist()
        return calibrator("isotonic", (xs, ys), note)
    rows = dev.select(array_to_vector(F.array(_logit(F.col(score)))).alias("features"), F.col(label).cast("double").alias("label"))
    fit = LogisticRegression(regParam=1 / (1e6 * (n0 + n1)), standardization=False, maxIter=200).fit(rows)
    return calibrator("platt", (float(fit.coefficients[0]), float(fit.intercept)), note)


@dataclass(frozen=True)
class Artifact:
    """What scoring needs: the model, the calibrator, the threshold, and the feature spec that it was fitted with."""

    model: PipelineModel
    calibrator: Calibrator
    threshold: float
    spec: dict


def save_artifact(spark: SparkSession, artifact: Artifact, path: str) -> None:
    """Write an artefact; its card comes last, so a folder without one is not whole."""
    artifact.model.write().overwrite().save(f"{path}/model")
    card = {"kind": artifact.calibrator.kind, "params": artifact.calibrator.params, "note": artifact.calibrator.note, "threshold": artifact.threshold, "spec": artifact.spec}
    spark.createDataFrame([(json.dumps(card, sort_keys=True),)], "card string").coalesce(1).write.mode("overwrite").text(f"{path}/card")


def load_artifact(spark: SparkSession, path: str, spec: dict) -> Artifact:
    """Read an artefact back; one that was fitted with another feature spec is refused."""
    card = json.loads(spark.read.text(f"{path}/card").first().value)
    if card["spec"] != spec:
        raise ValueError(f"the artefact was fitted with {card['spec']}, not {spec}")
    return Artifact(PipelineModel.load(f"{path}/model"), calibrator(card["kind"], tuple(card["params"]), card["note"]), card["threshold"], card["spec"])


def rescore(artifact: Artifact, rows: DataFrame, vector: str) -> DataFrame:
    """Rows with score, calibrated, and flagged (score at or above the threshold); rows need no label."""
    s = scores(artifact.model, rows.withColumn("features", array_to_vector(F.col(vector).cast("array<double>")))).drop("features")
    return artifact.calibrator.calibrated(s).withColumn("flagged", F.col("score") >= artifact.threshold)


def run_baseline(rows: DataFrame, vector: str, strength: float = 1.0, policy: str = "eer") -> DataFrame:
    """(stage, ...metrics): the whole protocol over rows with split and label. Test is scored once, with what dev decided.

    A split without both classes ends the run: one row with outcome not_run and the reason.
    """
    counts = {r.split: (r.n1, r.n0) for r in rows.groupBy("split").agg(F.count_if(F.col("label") == 1).alias("n1"), F.count_if(F.col("label") == 0).alias("n0")).collect()}
    poor = [s for s in ("train", "dev", "test") if min(counts.get(s, (0, 0))) == 0]
    spark = rows.sparkSession
    if poor:
        return spark.createDataFrame([("none", "not_run", f"{poor[0]} lacks a class")], "stage string, outcome string, reason string")
    ready = with_features(rows, vector)
    train, dev, test = (ready.where(F.col("split") == s) for s in ("train", "dev", "test"))
    model = fit_logistic(train, strength)
    on_dev = scores(model, dev)
    fitted = fit_calibrator(on_dev)
    on_dev = fitted.calibrated(on_dev)
    threshold = M.select_threshold(M.operating_points(on_dev), policy).first().threshold
    on_test = written(fitted.calibrated(scores(model, test)).select("label", "score"), "test-scores")  # once
    reports = [M.detect(x.select("label", "score"), threshold).withColumn("stage", F.lit(s)) for s, x in (("dev", on_dev), ("test", on_test))]
    return reports[0].unionByName(reports[1]).withColumn("outcome", F.lit("measured")).withColumn("calibrator", F.lit(fitted.kind))


def score_with(rows: DataFrame, scorer: Callable[[pd.DataFrame], pd.Series], model_version: str, key: str) -> DataFrame:
    """(key, score, model_version) by a user's scorer, a batch at a time.

    A batch that fails, a missing value and a score outside 0 to 1 are unscored (null); no score is guessed.
    """
    kind = rows.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            try:
                found = pd.to_numeric(pd.Series(scorer(batch)).reset_index(drop=True), errors="coerce")
                if len(found) != len(batch):
                    raise ValueError("one score per row is needed")
            except Exception:
                found = pd.Series([None] * len(batch), dtype="float64")
            yield pd.DataFrame({key: batch[key].to_numpy(), "score": found.where((found >= 0) & (found <= 1)), "model_version": model_version})

    return rows.mapInPandas(run, f"{key} {kind}, score double, model_version string")
