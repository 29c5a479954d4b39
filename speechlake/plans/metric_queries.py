"""Queries over the detection metrics."""

from pyspark.sql import functions as F

from speechlake.operators import metrics as M
from speechlake.plans.registry import LINES, SCORED, lines, query, scored, table


def _rounded(df, *names, digits=6):
    return df.withColumns({n: F.round(n, digits) for n in names})


_POINTS = """, pt AS (SELECT {s} AS threshold, sum(label)::BIGINT AS p, sum(1 - label)::BIGINT AS n FROM {t} GROUP BY 1),
cu AS (SELECT threshold, p, n, (sum(p) OVER (ORDER BY threshold DESC))::BIGINT AS tp, (sum(n) OVER (ORDER BY threshold DESC))::BIGINT AS fp, (sum(p) OVER ())::BIGINT AS P, (sum(n) OVER ())::BIGINT AS N FROM pt),
op AS (SELECT threshold, p, n, tp, fp, P - tp AS fn, N - fp AS tn, fp / N AS far, (P - tp) / P AS frr FROM cu)
"""
LINE_POINTS = "WITH " + LINES + _POINTS.replace("{s}", "score").replace("{t}", "ln").replace("AS P,", "AS tot_p,").replace("AS N FROM", "AS tot_n FROM").replace("P - tp", "tot_p - tp").replace("N - fp", "tot_n - fp").replace("fp / N", "fp / tot_n").replace("/ P AS", "/ tot_p AS")
TIED_POINTS = LINE_POINTS.replace("SELECT score AS threshold", "SELECT tied AS threshold")
SCORED_POINTS = LINE_POINTS.replace(LINES, SCORED).replace("FROM ln", "FROM sc")


@query(f"WITH {SCORED} SELECT count(*) AS n, count_if(label = 1)::BIGINT AS positives, count_if(label = 0)::BIGINT AS negatives, NULL::VARCHAR AS reason FROM sc")
def metric_input(spark, sf_dir):
    return M.input_problem(scored(spark, sf_dir))


@query(f"""WITH {LINES}, c AS (SELECT count_if(score >= 0.3 AND label = 1)::BIGINT tp, count_if(score >= 0.3 AND label = 0)::BIGINT fp, count_if(score < 0.3 AND label = 1)::BIGINT fn, count_if(score < 0.3 AND label = 0)::BIGINT tn FROM ln)
  SELECT tp, fp, fn, tn, round(fp / (fp + tn), 6) AS far, round(fn / (tp + fn), 6) AS frr, round((tp + tn) / (tp + fp + fn + tn), 6) AS accuracy, round((2 - fp / (fp + tn) - fn / (tp + fn)) / 2, 6) AS balanced_accuracy, round(tp / (tp + fp), 6) AS precision,
  round(tp / (tp + fn), 6) AS recall, round(tn / (fp + tn), 6) AS specificity, round(2 * tp / (2 * tp + fp + fn), 6) AS f1, fp + fn AS errors FROM c""")
def confusion(spark, sf_dir):
    return _rounded(M.confusion_at(lines(spark, sf_dir), 0.3), "far", "frr", "accuracy", "balanced_accuracy", "precision", "recall", "specificity", "f1")


@query(f"{LINE_POINTS} SELECT threshold, tp, fp, fn, tn, round(far, 9) AS far, round(frr, 9) AS frr FROM op")
def operating_points(spark, sf_dir):
    return _rounded(M.operating_points(lines(spark, sf_dir)).drop("p", "n"), "far", "frr", digits=9)


@query(f"{TIED_POINTS} SELECT 'roc' AS curve, round(far, 9) AS x, round(1 - frr, 9) AS y FROM op UNION ALL SELECT 'roc', 0.0, 0.0 UNION ALL SELECT 'pr', round(1 - frr, 9), round(tp / (tp + fp), 9) FROM op UNION ALL SELECT 'pr', 0.0, 1.0")
def roc_and_pr(spark, sf_dir):
    p = M.operating_points(lines(spark, sf_dir), score="tied")
    both = M.roc(p).withColumn("curve", F.lit("roc")).unionByName(M.precision_recall(p).withColumn("curve", F.lit("pr")))
    return _rounded(both, "x", "y", digits=9)


@query()
def det_curve(spark, sf_dir):
    return M.det(M.operating_points(lines(spark, sf_dir)))


@query(f"""{LINE_POINTS}, f AS (SELECT *, far - frr AS gap FROM op), b AS (SELECT * FROM f WHERE gap >= -1e-12 ORDER BY threshold DESC LIMIT 1), a AS (SELECT * FROM f WHERE gap < -1e-12 ORDER BY threshold LIMIT 1)
  SELECT round((SELECT sum(p::DOUBLE * (2 * tn + n)) / (2.0 * sum(p) * sum(n)) FROM op), 8) AS auc, round((SELECT sum(p * tp / (tp + fp)) / sum(p) FROM op), 8) AS average_precision,
  round(CASE WHEN abs(b.gap) <= 1e-12 THEN b.far ELSE ((a.far + (-a.gap / (b.gap - a.gap)) * (b.far - a.far)) + (a.frr + (-a.gap / (b.gap - a.gap)) * (b.frr - a.frr))) / 2 END, 8) AS eer,
  CASE WHEN abs(b.gap) <= abs(a.gap) THEN b.threshold ELSE a.threshold END AS eer_threshold FROM a, b""")
def ranking_metrics(spark, sf_dir):
    p = M.operating_points(lines(spark, sf_dir))
    out = M.auc(p).crossJoin(F.broadcast(M.average_precision(p))).crossJoin(F.broadcast(M.eer(p)))  # one row each
    return _rounded(out, "auc", "average_precision", "eer", digits=8)


@query(f"""WITH {SCORED}, m AS (SELECT avg(score) AS m FROM sc), b AS (SELECT avg((score - label) * (score - label)) AS b, avg((m - label) * (m - label)) AS r FROM sc, m),
  bins AS (SELECT least(floor(score * 10), 9) AS bin, count(*) AS n, avg(score) AS s, avg(label) AS r FROM sc GROUP BY 1)
  SELECT round((SELECT b FROM b), 8) AS brier, round((SELECT 1 - b / r FROM b), 8) AS brier_skill, round((SELECT sum(n * abs(s - r)) / sum(n) FROM bins), 8) AS ece, count_if(score < 0.5)::BIGINT AS low, count_if(score >= 0.5 AND score < 0.8)::BIGINT AS medium, count_if(score >= 0.8)::BIGINT AS high FROM sc""")
def calibration_summary(spark, sf_dir):
    s = scored(spark, sf_dir)
    out = M.brier(s).crossJoin(F.broadcast(M.expected_calibration_error(M.reliability(s)))).crossJoin(F.broadcast(M.score_bands(s)))  # one row each
    return _rounded(out, "brier", "brier_skill", "ece", digits=8)


@query(f"""WITH {SCORED}, f AS (SELECT least(floor(score * 25), 24)::INT AS bin, count(*) AS n, round(avg(score), 8) AS mean_score, round(avg(label), 8) AS rate FROM sc WHERE score < 0.7 GROUP BY 1), e AS (SELECT unnest(range(25))::INT AS bin)
  SELECT bin, bin / 25 AS low, (bin + 1) / 25 AS high, coalesce(n, 0)::BIGINT AS n, mean_score, rate FROM e LEFT JOIN f USING (bin)""")
def reliability_bins(spark, sf_dir):
    return _rounded(M.reliability(scored(spark, sf_dir).where("score < 0.7"), bins=25), "mean_score", "rate", digits=8)


@query(f"""{TIED_POINTS} SELECT * FROM (SELECT 'eer' AS policy, threshold, round(far, 8) AS far, round(frr, 8) AS frr FROM op ORDER BY round(abs(far - frr), 12), threshold DESC LIMIT 1)
  UNION ALL SELECT * FROM (SELECT 'youden', threshold, round(far, 8), round(frr, 8) FROM op ORDER BY round(far + frr, 12), threshold DESC LIMIT 1)
  UNION ALL SELECT * FROM (SELECT 'max_recall', threshold, round(far, 8), round(frr, 8) FROM op WHERE far <= 0.2 ORDER BY op.frr, op.far, threshold DESC LIMIT 1)
  UNION ALL SELECT * FROM (SELECT 'min_mistakes', threshold, round(far, 8), round(frr, 8) FROM op ORDER BY fp + fn, threshold DESC LIMIT 1)
  UNION ALL SELECT 'infeasible', NULL, NULL, NULL""")
def threshold_policies(spark, sf_dir):
    p = M.operating_points(lines(spark, sf_dir), score="tied")
    picks = {"eer": ("eer", None), "youden": ("youden", None), "max_recall": ("max_recall", 0.2), "min_mistakes": ("min_mistakes", None), "infeasible": ("eer", -1.0)}
    parts = [M.select_threshold(p, policy, max_far=far).withColumn("policy", F.lit(name)) for name, (policy, far) in picks.items()]
    out = parts[0]
    for x in parts[1:]:
        out = out.unionByName(x)
    return _rounded(out, "far", "frr", digits=8)


@query(f"{TIED_POINTS} SELECT threshold, round(far, 8) AS far, round(frr, 8) AS frr, threshold = (SELECT threshold FROM op ORDER BY round(abs(far - frr), 12), threshold DESC LIMIT 1) AS chosen FROM op WHERE far <= 0.6")
def described_points(spark, sf_dir):
    p = M.operating_points(lines(spark, sf_dir), score="tied")
    best = M.select_threshold(p, "eer").select(F.col("threshold").alias("_t"))
    out = p.where("far <= 0.6").join(F.broadcast(best)).select("threshold", "far", "frr", (F.col("threshold") == F.col("_t")).alias("chosen"))
    return _rounded(out, "far", "frr", digits=8)


@query(f"""WITH {SCORED}, g AS (SELECT 'language' AS axis, language AS value, label, score FROM sc UNION ALL SELECT 'channel', channel, label, score FROM sc WHERE channel IS NOT NULL),
  p AS (SELECT axis, value, score AS threshold, sum(label)::BIGINT AS p, sum(1 - label)::BIGINT AS n FROM g GROUP BY 1, 2, 3), c AS (SELECT *, sum(n) OVER (PARTITION BY axis, value ORDER BY threshold) - n AS below FROM p),
  r AS (SELECT axis, value, sum(p * (2 * below + n)) / nullif(2.0 * sum(p) * sum(n), 0) AS auc FROM c GROUP BY 1, 2)
  SELECT axis, value, count_if(score >= 0.5 AND label = 1)::BIGINT AS tp, count_if(score >= 0.5 AND label = 0)::BIGINT AS fp, count_if(score < 0.5 AND label = 1)::BIGINT AS fn, count_if(score < 0.5 AND label = 0)::BIGINT AS tn,
  round(any_value(auc), 8) AS auc, count_if(label = 1) >= 20 AND count_if(label = 0) >= 20 AS reliable FROM g JOIN r USING (axis, value) GROUP BY 1, 2""")
def subgroup_metrics(spark, sf_dir):
    out = M.subgroups(scored(spark, sf_dir), ["language", "channel"], 0.5)
    return _rounded(out.select("axis", "value", "tp", "fp", "fn", "tn", "auc", "reliable"), "auc", digits=8)


@query()
def detection_report(spark, sf_dir):
    return M.detect(scored(spark, sf_dir), 0.5, ["split"])


@query("SELECT event_type, count(*) AS n, round(avg(value), 6) AS mean, round(quantile_cont(value, 0.5), 6) AS median, round(quantile_cont(value, 0.95), 6) AS p95, round(quantile_cont(value, 0.99), 6) AS p99, max(value) AS most, round(count(*) * 4.0 / (sum(value) / 1000), 6) AS audio_per_wall FROM events GROUP BY 1")
def latency_report(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("audio", F.lit(4.0))
    return _rounded(M.latency(e, "value", ["event_type"], "audio"), "mean", "median", "p95", "p99", "audio_per_wall")


@query(f"WITH {LINES} SELECT label, count(*) AS n, round(avg(score), 6) AS mean, round(stddev_pop(score), 6) AS sd, min(score) AS least, round(quantile_cont(score, 0.05), 6) AS p05, round(quantile_cont(score, 0.5), 6) AS median, round(quantile_cont(score, 0.95), 6) AS p95, max(score) AS most FROM ln GROUP BY 1")
def score_distributions(spark, sf_dir):
    return _rounded(M.score_distribution(lines(spark, sf_dir)), "mean", "sd", "p05", "median", "p95")


@query("SELECT conv_id, round(least(1.0, greatest(0.0, coalesce(avg((length(text) % 100) / 99.0), 0.0))), 8) AS score, count(text) AS windows FROM conversations GROUP BY 1")
def segment_scores(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").withColumn("score", (F.length("text") % 100) / 99.0)
    return _rounded(M.mean_scores(c, "conv_id", "score"), "score", digits=8)


@query(f"WITH {SCORED} SELECT (SELECT count(*) FROM sc WHERE substr(sample_id, -1) = '0') AS unmatched, 0.0::DOUBLE AS largest, (SELECT count(*) FROM sc WHERE substr(sample_id, -1) = '0') = 0 AS match")
def rescore_match(spark, sf_dir):
    s = scored(spark, sf_dir)
    return M.scores_match(s, s.where(F.substring("sample_id", -1, 1) != "0"), "sample_id")
