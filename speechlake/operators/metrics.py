"""Exact detection metrics over binary scores, from running sums over the distinct scores."""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from speechlake.functions.prefix import prefix_sums
from speechlake.functions.quantiles import exact_quantiles
from speechlake.sources.shared import written

# Coefficients of Acklam's rational approximation of the inverse normal distribution: fixed values.
_A = (-3.969683028665376e1, 2.209460984245205e2, -2.759285104469687e2, 1.383577518672690e2, -3.066479806614716e1, 2.506628277459239)
_B = (-5.447609879822406e1, 1.615858368580409e2, -1.556989798598866e2, 6.680131188771972e1, -1.328068155288572e1)
_C = (-7.784894002430293e-3, -3.223964580411365e-1, -2.400758277161838, -2.549732539343734, 4.374664141464968, 2.938163982698783)
_D = (7.784695709041462e-3, 3.224671290700398e-1, 2.445134137142996, 3.754408661907416)


def _poly(x: Column, coefficients: Sequence[float]) -> Column:
    out = F.lit(coefficients[0])
    for c in coefficients[1:]:
        out = out * x + c
    return out


def probit(p: Column) -> Column:
    """The inverse of the normal distribution, for 0 < p < 1, to about 1e-9."""
    low = 0.02425

    def tail(q: Column) -> Column:
        return _poly(q, _C) / (_poly(q, _D) * q + 1)

    q = p - 0.5
    middle = _poly(q * q, _A) * q / (_poly(q * q, _B) * q * q + 1)
    return F.when(p < low, tail(F.sqrt(-2 * F.log(p)))).when(p > 1 - low, -tail(F.sqrt(-2 * F.log(1 - p)))).otherwise(middle)


def input_problem(scores: DataFrame, label: str = "label", score: str = "score") -> DataFrame:
    """One row: the first reason why scores cannot be evaluated, or null, and the class counts."""
    y, s = F.col(label), F.col(score)
    facts = scores.agg(
        F.count(F.lit(1)).alias("n"), F.count_if(y == 1).alias("positives"), F.count_if(y == 0).alias("negatives"),
        F.count_if(s.isNull() | F.isnan(s) | (F.abs(s) == float("inf"))).alias("bad_scores"), F.count_if(y.isNull() | ~y.isin(0, 1)).alias("bad_labels"),
    )
    reason = F.when(F.col("n") == 0, "no rows").when(F.col("bad_labels") > 0, "labels other than 0 and 1").when(F.col("bad_scores") > 0, "scores that are not finite")
    return facts.select("n", "positives", "negatives", reason.otherwise(F.when((F.col("positives") == 0) | (F.col("negatives") == 0), "one class only")).alias("reason"))


def rates(tp: Column, fp: Column, fn: Column, tn: Column) -> dict[str, Column]:
    """The rates of a confusion; null where there is nothing to divide by. far: bona fide called spoof; frr: spoof missed."""
    far, frr = F.try_divide(fp, fp + tn), F.try_divide(fn, tp + fn)
    recall, precision = F.try_divide(tp, tp + fn), F.try_divide(tp, tp + fp)
    return {
        "far": far, "frr": frr, "accuracy": F.try_divide(tp + tn, tp + fp + fn + tn), "balanced_accuracy": (2 - far - frr) / 2, "precision": precision,
        "recall": recall, "specificity": F.try_divide(tn, fp + tn), "f1": F.try_divide(2 * tp, 2 * tp + fp + fn), "errors": fp + fn,
    }


def confusion_at(scores: DataFrame, threshold: float, keys: Sequence[str] = (), label: str = "label", score: str = "score") -> DataFrame:
    """Counts and rates at a threshold: a row is called spoof if its score is at or above it."""
    called, y = F.col(score) >= threshold, F.col(label) == 1
    counts = scores.groupBy(*keys).agg(F.count_if(called & y).alias("tp"), F.count_if(called & ~y).alias("fp"), F.count_if(~called & y).alias("fn"), F.count_if(~called & ~y).alias("tn"))
    return counts.select("*", *[v.alias(k) for k, v in rates(*map(F.col, ("tp", "fp", "fn", "tn"))).items()])


def operating_points(scores: DataFrame, keys: Sequence[str] = (), label: str = "label", score: str = "score") -> DataFrame:
    """(keys, threshold, tp, fp, fn, tn, far, frr): one row per distinct score, exact.

    Scores are counted by value before anything is ordered; see prefix_sums. Stored, for the metrics
    that read it several times.
    """
    rows = scores.select(*keys, F.col(score).alias("threshold"), (F.col(label) == 1).cast("long").alias("p"), (F.col(label) == 0).cast("long").alias("n"))
    sums = prefix_sums(rows, keys, "threshold", ["p", "n"])
    totals = rows.groupBy(*keys).agg(F.sum("p").alias("all_p"), F.sum("n").alias("all_n"))
    if keys:
        same = None
        for i, k in enumerate(keys):
            totals = totals.withColumnRenamed(k, f"_k{i}")
            test = sums[k].eqNullSafe(totals[f"_k{i}"])
            same = test if same is None else same & test
        out = sums.join(totals, same)
    else:
        out = sums.join(F.broadcast(totals))  # one row
    tp, fp = F.col("cum_p"), F.col("cum_n")
    out = out.select(*keys, "threshold", "p", "n", tp.alias("tp"), fp.alias("fp"), (F.col("all_p") - tp).alias("fn"), (F.col("all_n") - fp).alias("tn"))
    return written(out.withColumns({"far": F.try_divide("fp", F.col("fp") + F.col("tn")), "frr": F.try_divide("fn", F.col("tp") + F.col("fn"))}), "points")


def roc(points: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, x, y): false against true positive rate with the origin."""
    curve = points.select(*keys, F.col("far").alias("x"), (1 - F.col("frr")).alias("y"))
    origin = points.select(*keys).distinct() if keys else points.sparkSession.range(1).select()
    return curve.unionByName(origin.select(*keys, F.lit(0.0).alias("x"), F.lit(0.0).alias("y")))


def precision_recall(points: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, x, y): recall against precision, starting at recall 0 and precision 1."""
    curve = points.select(*keys, (1 - F.col("frr")).alias("x"), F.try_divide("tp", F.col("tp") + F.col("fp")).alias("y"))
    origin = points.select(*keys).distinct() if keys else points.sparkSession.range(1).select()
    return curve.unionByName(origin.select(*keys, F.lit(0.0).alias("x"), F.lit(1.0).alias("y")))


def det(points: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, threshold, x, y): the error rates on normal axes, kept within 1e-6 of 0 and 1."""
    clip = lambda c: probit(F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), F.col(c))))
    return points.select(*keys, "threshold", clip("far").alias("x"), clip("frr").alias("y"))


def auc(points: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, auc) by average ranks: ties count one half. Counts are added as decimals, so nothing overflows; null for one class."""
    wide = lambda c: F.col(c).cast("decimal(19,0)")
    pairs = F.sum(wide("p") * (2 * F.col("tn") + F.col("n")).cast("decimal(19,0)"))
    return points.groupBy(*keys).agg(F.try_divide(pairs.cast("double"), 2.0 * F.sum("p") * F.sum("n")).alias("auc"))


def average_precision(points: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, average_precision): the sum of each step in recall times its precision."""
    step = F.sum(F.col("p") * F.col("tp") / (F.col("tp") + F.col("fp")))
    return points.groupBy(*keys).agg(F.try_divide(step, F.sum("p")).alias("average_precision"))


def eer(points: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, eer, eer_threshold): the first point of equal errors, else the first crossing, interpolated.

    far rises and frr falls as the threshold goes down, so the crossing is the first point with
    far >= frr, and the point before it the last with far < frr: two aggregates, no ordering.
    """
    gap = F.col("far") - F.col("frr")
    at = F.struct(F.col("far"), F.col("frr"), F.col("threshold"))
    after = F.max_by(at, F.when(gap >= -1e-12, F.col("threshold")))
    before = F.min_by(at, F.when(gap < -1e-12, F.col("threshold")))
    both = points.groupBy(*keys).agg(after.alias("b"), before.alias("a"), F.count_if(gap >= -1e-12).alias("n"))
    gap_a, gap_b = F.coalesce(F.col("a.far") - F.col("a.frr"), F.lit(-1.0)), F.col("b.far") - F.col("b.frr")
    w = F.try_divide(-gap_a, gap_b - gap_a)
    far_a, frr_a = F.coalesce("a.far", F.lit(0.0)), F.coalesce("a.frr", F.lit(1.0))
    crossing = ((far_a + w * (F.col("b.far") - far_a)) + (frr_a + w * (F.col("b.frr") - frr_a))) / 2
    tie = F.abs(gap_b) <= 1e-12
    nearer = F.when(F.col("a").isNull() | (F.abs(gap_b) <= F.abs(gap_a)), F.col("b.threshold")).otherwise(F.col("a.threshold"))
    return both.select(*keys, F.when(F.col("n") > 0, F.when(tie, F.col("b.far")).otherwise(crossing)).alias("eer"), F.when(F.col("n") > 0, F.when(tie, F.col("b.threshold")).otherwise(nearer)).alias("eer_threshold"))


def gap_eer(points: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, eer, eer_threshold) at the point of least difference, the higher threshold of equals; far is of impostors."""
    best = F.min_by(F.struct("far", "frr", "threshold"), F.struct(F.round(F.abs(F.col("far") - F.col("frr")), 12), -F.col("threshold")))
    return points.groupBy(*keys).agg(best.alias("b")).select(*keys, ((F.col("b.far") + F.col("b.frr")) / 2).alias("eer"), F.col("b.threshold").alias("eer_threshold"))


def brier(scores: DataFrame, keys: Sequence[str] = (), label: str = "label", score: str = "score") -> DataFrame:
    """(keys, brier, brier_skill). The skill's reference predicts the mean score for all rows."""
    y, p = F.col(label).cast("double"), F.col(score)
    sums = scores.groupBy(*keys).agg(F.avg((p - y) * (p - y)).alias("brier"), F.avg(p).alias("m"), F.avg(y).alias("r"), F.avg(y * y).alias("q"))
    reference = F.col("q") - 2 * F.col("m") * F.col("r") + F.col("m") * F.col("m")
    return sums.select(*keys, "brier", (1 - F.try_divide(F.col("brier"), reference)).alias("brier_skill"))


def reliability(scores: DataFrame, bins: int = 10, label: str = "label", score: str = "score") -> DataFrame:
    """(bin, low, high, n, mean_score, rate): equal widths, empty bins kept, a score on an edge goes up, 1 into the last."""
    b = F.least(F.floor(F.col(score) * bins), F.lit(bins - 1)).cast("int")
    found = scores.groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.avg(score).alias("mean_score"), F.avg(F.col(label).cast("double")).alias("rate"))
    every = scores.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    return every.join(found, "bin", "left").select("bin", (F.col("bin") / bins).alias("low"), ((F.col("bin") + 1) / bins).alias("high"), F.coalesce("n", F.lit(0)).alias("n"), "mean_score", "rate")


def expected_calibration_error(bins: DataFrame) -> DataFrame:
    """(ece,) of reliability bins."""
    return bins.agg(F.try_divide(F.sum(F.col("n") * F.abs(F.col("mean_score") - F.col("rate"))), F.sum("n")).alias("ece"))


def score_bands(scores: DataFrame, edges: tuple[float, float] = (0.5, 0.8), score: str = "score") -> DataFrame:
    """(low, medium, high): scores on an edge go up."""
    s, (a, b) = F.col(score), edges
    return scores.agg(F.count_if(s < a).alias("low"), F.count_if((s >= a) & (s < b)).alias("medium"), F.count_if(s >= b).alias("high"))


def select_threshold(points: DataFrame, policy: str, max_far: float | None = None, max_frr: float | None = None, keys: Sequence[str] = (), fixed: float | None = None) -> DataFrame:
    """(keys, threshold, far, frr) that a policy picks among the points within the ceilings; null where none is.

    eer: least |far - frr|; youden: most recall + specificity; max_recall: least frr, then far;
    min_mistakes: fewest errors; fixed: the least threshold at or above the given one. Of equals the higher threshold.
    """
    far, frr, t = F.col("far"), F.col("frr"), F.col("threshold")
    fits = F.lit(True)
    if max_far is not None:
        fits = fits & (far <= max_far)
    if max_frr is not None:
        fits = fits & (frr <= max_frr)
    rank = {
        "eer": [F.round(F.abs(far - frr), 12), -t], "youden": [F.round(far + frr, 12), -t], "max_recall": [frr, far, -t],
        "min_mistakes": [F.col("fp") + F.col("fn"), -t], "fixed": [F.when(t >= (fixed if fixed is not None else 0), t)],
    }[policy]
    if policy == "fixed":
        fits = fits & (t >= fixed)
    best = points.groupBy(*keys).agg(F.min_by(F.struct("threshold", "far", "frr"), F.when(fits, F.struct(*rank))).alias("b"))
    return best.select(*keys, "b.threshold", "b.far", "b.frr")


def detect(scores: DataFrame, threshold: float, keys: Sequence[str] = (), label: str = "label", score: str = "score") -> DataFrame:
    """The full metric row for each key: counts, rates at the threshold, auc, average precision, EER, Brier; null two-class metrics and a reason for one class."""
    points = operating_points(scores, keys, label, score)
    out = confusion_at(scores, threshold, keys, label, score)
    for part in (auc(points, keys), average_precision(points, keys), eer(points, keys), brier(scores, keys, label, score)):
        out = out.join(part, list(keys)) if keys else out.crossJoin(F.broadcast(part))  # both sides are one row
    both = (F.col("tp") + F.col("fn") > 0) & (F.col("fp") + F.col("tn") > 0)
    for c in ("auc", "average_precision", "eer", "eer_threshold", "brier_skill"):
        out = out.withColumn(c, F.when(both, F.col(c)))
    return out.withColumn("reason", F.when(~both, "one class only"))


def subgroups(scores: DataFrame, axes: Sequence[str], threshold: float, least: int = 20) -> DataFrame:
    """detect() for each known value of each axis, with reliable: `least` rows of each class at least."""
    pairs = F.array(*[F.struct(F.lit(a).alias("axis"), F.col(a).alias("value")) for a in axes])
    long = scores.select("label", "score", F.explode(pairs).alias("p")).select("label", "score", "p.axis", "p.value").where("value is not null")
    out = detect(long, threshold, ["axis", "value"])
    return out.withColumn("reliable", (F.col("tp") + F.col("fn") >= least) & (F.col("fp") + F.col("tn") >= least))


def _beside(figures: DataFrame, quantiles: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Figures with the quantiles of their keys, null where there are none."""
    other = quantiles.select(*[F.col(k).alias(f"_q{i}") for i, k in enumerate(keys)], "q")
    same = F.lit(True)
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_q{i}"))
    return figures.join(other, same, "left").drop(*[f"_q{i}" for i in range(len(keys))])


def latency(rows: DataFrame, value: str, keys: Sequence[str] = (), audio_s: str | None = None, least: int = 5) -> DataFrame:
    """(keys, n, mean, median, p95, p99, most[, audio_per_wall]): exact; null figures with fewer than `least` rows. value is in milliseconds."""
    q = exact_quantiles(rows, keys, value, [0.5, 0.95, 0.99])
    extra = [F.try_divide(F.sum(audio_s), F.sum(value) / 1000).alias("audio_per_wall")] if audio_s else []
    out = _beside(rows.groupBy(*keys).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.max(value).alias("most"), *extra), q, keys)
    enough = F.col("n") >= least
    figures = {"mean": F.col("mean"), "median": F.col("q")[0], "p95": F.col("q")[1], "p99": F.col("q")[2], "most": F.col("most")} | ({"audio_per_wall": F.col("audio_per_wall")} if audio_s else {})
    return out.select(*keys, "n", *[F.when(enough, v).alias(k) for k, v in figures.items()])


def score_distribution(scores: DataFrame, keys: Sequence[str] = ("label",), score: str = "score") -> DataFrame:
    """(keys, n, mean, sd, least, p05, median, p95, most); sd is of the population."""
    q = exact_quantiles(scores, keys, score, [0.05, 0.5, 0.95])
    out = _beside(scores.groupBy(*keys).agg(F.count(score).alias("n"), F.avg(score).alias("mean"), F.stddev_pop(score).alias("sd"), F.min(score).alias("least"), F.max(score).alias("most")), q, keys)
    return out.select(*keys, "n", "mean", "sd", "least", F.col("q")[0].alias("p05"), F.col("q")[1].alias("median"), F.col("q")[2].alias("p95"), "most")


def mean_scores(windows: DataFrame, clip: str, score: str) -> DataFrame:
    """(clip, score, windows): the mean of a clip's window scores, kept within 0 and 1; an invalid window makes it null. A clip without scores has 0."""
    s = F.col(score)
    bad = F.count_if(F.isnan(s) | (F.abs(s) == float("inf")))
    return windows.groupBy(clip).agg(F.when(bad == 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(F.avg(s), F.lit(0.0))))).alias("score"), F.count(s).alias("windows"))


def scores_match(first: DataFrame, second: DataFrame, key: str, score: str = "score", tolerance: float = 1e-9) -> DataFrame:
    """One row: rows only on one side, the largest difference, and whether both agree."""
    b = second.select(F.col(key).alias("_k"), F.col(score).alias("_s"))
    met = first.join(b, first[key] == b["_k"], "full_outer")
    out = met.agg(F.count_if(F.col(key).isNull() | F.col("_k").isNull()).alias("unmatched"), F.coalesce(F.max(F.abs(F.col(score) - F.col("_s"))), F.lit(0.0)).alias("largest"))
    return out.withColumn("match", (F.col("unmatched") == 0) & (F.col("largest") <= tolerance))
