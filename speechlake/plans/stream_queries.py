"""Queries over streams, training and whole jobs."""

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from speechlake.functions import records as R
from speechlake.operators import corpus as C
from speechlake.operators import jobs as J
from speechlake.operators import metrics as M
from speechlake.operators import privacy as P
from speechlake.operators import signal as G
from speechlake.operators import splitting as S
from speechlake.operators import training as T
from speechlake.plans.registry import RECORDS, query, records, scored, table
from speechlake.plans.signal_queries import CLEAN, SEGMENTS, cleaned
from speechlake.sources.manifests import read_manifest_set
from speechlake.sources.shared import new_path, written
from speechlake.streaming import jobs, windows

SIZE, HOP = 10, 5


def _samples(spark, sf_dir):
    o = W.partitionBy("user_id").orderBy("ts", "event_id")
    e = table(spark, sf_dir, "events")
    return e.select(F.col("user_id").alias("stream"), (F.row_number().over(o) - 1).cast("long").alias("idx"), ((F.col("value") - 100) / 400).alias("x"), "ts")


_WINDOWS = """smp AS (SELECT user_id AS stream, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS idx, {x} AS x FROM events), t AS (SELECT stream, count(*) AS n, greatest(0, floor((count(*) - 10) / 5) + 1)::BIGINT AS full_n FROM smp GROUP BY 1),
w AS (SELECT stream, idx, x, unnest(range(greatest(0, ceil((idx - 9) / 5))::BIGINT, idx // 5 + 1)) AS window_index FROM smp)
SELECT w.stream, window_index, window_index * 5 AS start, count(*)::INT AS n, round(sum(x) / 10, 8) AS mean, round(max(abs(x)), 8) AS peak, window_index = any_value(full_n) AS is_final
FROM w JOIN t USING (stream) WHERE window_index <= full_n GROUP BY w.stream, window_index HAVING (count(*) = 10 AND window_index < any_value(full_n)) OR window_index = any_value(full_n)"""


def _rounded(df):
    return df.withColumns({"mean": F.round("mean", 8), "peak": F.round("peak", 8)})


@query("WITH " + _WINDOWS.replace("{x}", "(value - 100) / 400"))
def count_windows_stream(spark, sf_dir):
    """Samples in order over several micro-batches, then a flush for each stream."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", jobs.ROCKSDB)
    rows = _samples(spark, sf_dir).withColumn("control", F.lit(None).cast("string"))
    last = rows.groupBy("stream").agg((F.max("idx") + 1).alias("idx"), F.lit(0.0).alias("x"), F.max("ts").alias("ts"), F.lit("flush").alias("control"))
    stream = jobs.file_stream(spark, rows.unionByName(last), "samples", order="ts", files=3)
    return _rounded(jobs.run_available(windows.count_windows(stream, "stream", SIZE, HOP), "windows"))


@query("WITH " + _WINDOWS.replace("{x}", "(value - 100) / 400 * pow(10.0, -6.0 / 20)"))
def count_windows_batch(spark, sf_dir):
    return _rounded(windows.count_windows_batch(_samples(spark, sf_dir).drop("ts"), "stream", "idx", "x", SIZE, HOP, gain_db=-6.0))


_TIME_WINDOWS = "SELECT event_type, TIMESTAMP '1970-01-01' + INTERVAL 1 DAY * d AS start, count(*) AS n, round(avg(value), 6) AS mean FROM (SELECT *, unnest([date_diff('day', TIMESTAMP '1970-01-01', ts), date_diff('day', TIMESTAMP '1970-01-01', ts) - 1]) AS d FROM events) GROUP BY 1, 2"


@query(_TIME_WINDOWS)
def time_windows(spark, sf_dir):
    out = windows.time_windows(table(spark, sf_dir, "events"), "ts", ["event_type"], "2 days", "1 day", "value")
    return out.select("event_type", F.col("start").cast("timestamp_ntz").alias("start"), "n", F.round("mean", 6).alias("mean"))


@query(_TIME_WINDOWS)
def time_windows_stream(spark, sf_dir):
    """The same windows over a stream; a last row later than all windows closes them, and its own is never emitted."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", jobs.ROCKSDB)
    rows = table(spark, sf_dir, "events").select(F.col("ts").cast("timestamp").alias("ts"), "event_type", "value")
    last = rows.groupBy().agg((F.max("ts") + F.expr("INTERVAL 4 DAYS")).alias("ts"), F.lit(None).cast("string").alias("event_type"), F.lit(None).cast("double").alias("value")).where("ts is not null")
    stream = jobs.file_stream(spark, rows.unionByName(last), "events", order="ts", files=3)
    out = jobs.run_available(windows.time_windows(stream, "ts", ["event_type"], "2 days", "1 day", "value", late="1 day"), "time-windows")
    return out.select("event_type", F.col("start").cast("timestamp_ntz").alias("start"), "n", F.round("mean", 6).alias("mean"))


@query("""WITH g AS (SELECT event_id, least(value / 491.0, 1.0) AS score, ts FROM events) SELECT event_id, round(score, 8) AS score, CASE WHEN score < 0.5 THEN 'log_only' WHEN score < 0.8 THEN 'challenge_mfa' ELSE 'escalate_to_analyst' END AS action, ts + INTERVAL 30 DAY AS expires_at FROM g""")
def decision_stream(spark, sf_dir):
    """Scores to decisions to audit rows, appended batch by batch under the batch's number."""
    rows = table(spark, sf_dir, "events").select("event_id", "ts", F.least(F.col("value") / 491.0, F.lit(1.0)).alias("score"))

    def decide(batch):
        d = batch.withColumn("action", R.advisory_action(R.risk_band(F.col("score")), F.lit(4.0), F.lit("m1")))
        return P.with_expiry(d, "ts").select("event_id", F.round("score", 8).alias("score"), "action", "expires_at")

    return jobs.run_batches(jobs.file_stream(spark, rows, "scores", files=3), "decisions", decide, "event_id")


# ---- training


def _examples(spark, sf_dir):
    """Embeddings with a separable label: whether the first half of the vector adds up to more than 0."""
    e = table(spark, sf_dir, "embeddings")
    half = F.aggregate(F.slice("embedding", 1, 32), F.lit(0.0), lambda a, x: a + x.cast("double"))
    i = F.col("vec_id")
    return e.select("vec_id", "embedding", (half > 0).cast("int").alias("label"), F.when(i % 10 < 6, "train").when(i % 10 < 8, "dev").otherwise("test").alias("split"))


@query()
def baseline_run(spark, sf_dir):
    return T.run_baseline(_examples(spark, sf_dir), "embedding")


@query()
def boosted_scores(spark, sf_dir):
    rows = T.with_features(_examples(spark, sf_dir), "embedding")
    model = T.fit_boosted(rows.where("split = 'train'"), rows.where("split = 'dev'"), rounds=8)
    return T.scores(model, rows.where("split = 'test'")).select("vec_id", "label", F.round("score", 6).alias("score"))


@query()
def calibrated_scores(spark, sf_dir):
    s = scored(spark, sf_dir)
    dev = s.where("split = 'dev'")
    platt, isotonic = (T.fit_calibrator(dev, k) for k in ("platt", "isotonic"))
    both = isotonic.calibrated(platt.calibrated(s.where("split = 'test'"), name="platt"), name="isotonic")
    return both.select("sample_id", "platt", "isotonic")


@query("SELECT vec_id, round(least(1.0, abs(embedding[1]::DOUBLE) * 2), 6) AS score, 'v1' AS model_version FROM embeddings")
def user_scorer(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding")[0].cast("double").alias("x"))
    out = T.score_with(rows, lambda b: (b["x"].abs() * 2).clip(upper=1.0), "v1", "vec_id")
    return out.withColumn("score", F.round("score", 6))


@query("SELECT count(*) AS n, 0::BIGINT AS unmatched, 0::BIGINT AS other_flags, true AS match, true AS refused FROM embeddings WHERE vec_id % 10 >= 8")
def rescore_artifact(spark, sf_dir):
    """Fit, save, load and rescore: the loaded artefact gives the scores and flags of the fitted one, and refuses another spec."""
    rows = _examples(spark, sf_dir)
    ready = T.with_features(rows, "embedding")
    model = T.fit_logistic(ready.where("split = 'train'"))
    dev = T.scores(model, ready.where("split = 'dev'"))
    fitted = T.fit_calibrator(dev)
    points = M.operating_points(fitted.calibrated(dev))
    spec = {"vector": "embedding", "size": 64}
    made = T.Artifact(model, fitted, M.select_threshold(points, "eer").first().threshold, spec)
    path = new_path(spark, "artifact")
    T.save_artifact(spark, made, path)
    try:
        T.load_artifact(spark, path, spec | {"size": 32})
        refused = False
    except ValueError:
        refused = True
    test = rows.where("split = 'test'").select("vec_id", "embedding")
    first, second = (written(T.rescore(x, test, "embedding").select("vec_id", "score", "flagged"), "rescored") for x in (made, T.load_artifact(spark, path, spec)))
    flags = first.join(second.select("vec_id", F.col("flagged").alias("_f")), "vec_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("flagged") != F.col("_f")).alias("other_flags"))
    match = M.scores_match(first, second, "vec_id").select("unmatched", "match")
    return flags.crossJoin(F.broadcast(match)).withColumn("refused", F.lit(refused))  # one row each


# ---- jobs


_BUILT = f"""WITH {RECORDS}, v AS (SELECT *, CASE WHEN speaker IS NULL THEN 'missing_metadata' WHEN file_bytes > 20000 THEN 'file_too_large' WHEN duration_s < 2 THEN 'too_short' WHEN duration_s > 60 THEN 'too_long' END AS code FROM rec),
  a AS (SELECT *, row_number() OVER (PARTITION BY file_hash ORDER BY sample_id) AS r FROM v WHERE code IS NULL), k AS (SELECT *, 'speaker:' || speaker AS grp FROM a WHERE r = 1), g AS (SELECT grp, count(*) AS size, sha256(grp) AS o FROM k GROUP BY 1),
  n AS (SELECT sum(size) AS n FROM g), b AS (SELECT *, coalesce(sum(size) OVER (ORDER BY o, grp ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM g), t AS (SELECT *, before < (SELECT round_even(n * 0.7, 0) FROM n) AS tr FROM b),
  d AS (SELECT *, coalesce(sum(size) OVER (ORDER BY o, grp ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS bd FROM t WHERE NOT tr),
  s AS (SELECT grp, 'train' AS split FROM t WHERE tr UNION ALL SELECT grp, CASE WHEN bd < (SELECT round_even(n * 0.15, 0) FROM n) THEN 'dev' ELSE 'test' END FROM d)
  SELECT s.split, k.label, count(*) AS samples, count(DISTINCT k.speaker) AS speakers, round(sum(duration_s), 4) AS seconds FROM k JOIN s USING (grp) GROUP BY 1, 2"""


@query(_BUILT)
def build_dataset(spark, sf_dir):
    """Inventory, validation, dedup, split and statistics in one job; a split that shares a speaker would end it."""
    r = records(spark, sf_dir).withColumns({"speech_s": F.col("duration_s"), "usable": F.lit(True), "content_hash": F.col("file_hash")})
    accepted = C.dedup_accepted(C.validate(r)).where("code is null").drop("split")
    accepted = accepted.withColumn("grp", R.partition_key(F.col("speaker"), F.col("parent_id")))
    splits = S.capacity_fill(S.group_sizes(accepted).withColumn("key", F.sha2("grp", 256)), "key")
    samples = accepted.join(splits, "grp")
    if not C.leakage_failures(samples, ["speaker"]).isEmpty():
        raise ValueError("a speaker is in two splits")
    return samples.groupBy("split", "label").agg(F.count(F.lit(1)).alias("samples"), F.countDistinct("speaker").alias("speakers"), F.round(F.sum("duration_s"), 4).alias("seconds"))


def _sources(spark, sf_dir):
    return records(spark, sf_dir).withColumns({"speech_s": F.col("duration_s"), "usable": F.lit(True), "content_hash": F.col("file_hash")})


@query(_BUILT)
def publish_dataset(spark, sf_dir):
    """The same build, published with its reports and read back from the manifests of its splits."""
    path = new_path(spark, "build")
    J.publish_job(_sources(spark, sf_dir), f"{path}/manifests", f"{path}/reports", "b1", source="grp")
    rows = reduce(DataFrame.unionByName, [read_manifest_set(spark, f"{path}/manifests", s) for s in ("train", "dev", "test")])
    return rows.groupBy("split", "label").agg(F.count(F.lit(1)).alias("samples"), F.countDistinct("speaker").alias("speakers"), F.round(F.sum("duration_s"), 4).alias("seconds"))


@query(f"""WITH {RECORDS}, v AS (SELECT *, CASE WHEN speaker IS NULL THEN 'missing_metadata' WHEN file_bytes > 20000 THEN 'file_too_large' WHEN duration_s < 2 THEN 'too_short' WHEN duration_s > 60 THEN 'too_long' END AS code FROM rec),
  d AS (SELECT *, CASE WHEN code IS NULL AND sample_id > min(sample_id) FILTER (code IS NULL) OVER (PARTITION BY file_hash) THEN 'duplicate' ELSE code END AS final FROM v)
  SELECT 'validation' AS report, dataset_id || ' ' || coalesce(final, 'accepted') AS subject, count(*) AS n FROM d GROUP BY 2 UNION ALL
  SELECT 'rejected', build || ' ' || final, count(*) FROM d, (SELECT unnest(['b1', 'b2']) AS build) WHERE final IS NOT NULL GROUP BY 2 UNION ALL SELECT 'repeated_ids', '', count(*) - count(DISTINCT sample_id) FROM rec""")
def validation_reports(spark, sf_dir):
    """What two runs of the validation job leave: the last report of outcomes, and what both rejected."""
    path = new_path(spark, "reports")
    for build in ("b1", "b2"):
        J.validate_job(_sources(spark, sf_dir), path, build)
    read = lambda name, schema: spark.read.schema(schema).json(f"{path}/{name}")
    outcomes = read("validation", "dataset_id string, outcome string, n bigint").select(F.lit("validation").alias("report"), F.concat_ws(" ", "dataset_id", "outcome").alias("subject"), "n")
    rejected = read("rejected", "build_id string, code string").groupBy(F.lit("rejected").alias("report"), F.concat_ws(" ", "build_id", "code").alias("subject")).agg(F.count(F.lit(1)).alias("n"))
    ids = read("scopes", "repeated_ids bigint").select(F.lit("repeated_ids").alias("report"), F.lit("").alias("subject"), F.col("repeated_ids").alias("n"))
    return outcomes.unionByName(rejected).unionByName(ids)


@query(f"WITH {CLEAN}, s AS (SELECT signal, count(*) AS frames, count_if(speech) AS speech FROM cl GROUP BY 1) SELECT count(*) AS signals, sum(frames)::BIGINT AS frames, sum(speech)::BIGINT AS speech_frames, round(sum(speech) / sum(frames), 6) AS speech_ratio FROM s")
def processing_summary(spark, sf_dir):
    c = cleaned(spark, sf_dir)
    return c.agg(F.countDistinct("signal").alias("signals"), F.count(F.lit(1)).alias("frames"), F.count_if("speech").alias("speech_frames"), F.round(F.count_if("speech") / F.count(F.lit(1)), 6).alias("speech_ratio"))


@query()
def speaker_evaluation(spark, sf_dir):
    """The whole speaker report: every trial, scores, threshold on dev, metrics on test by session."""
    from speechlake.plans.speaker_queries import scored_trials

    s = scored_trials(spark, sf_dir, cap=None)
    dev = M.operating_points(s.where("split = 'dev'"))
    threshold = M.select_threshold(dev, "eer").first().threshold
    return M.detect(s.where("split = 'test'"), threshold, ["cross_session"])


@query(f"""WITH {SEGMENTS}, g AS (SELECT signal, least(1.0, avg(speech / 6)) AS m, sum(speech * 0.5) AS sec FROM seg GROUP BY 1), b AS (SELECT *, CASE WHEN sec < 1 THEN 'INSUFFICIENT_SPEECH' ELSE 'DECIDED' END AS outcome FROM g),
  d AS (SELECT *, CASE WHEN outcome = 'DECIDED' THEN CASE WHEN m < 0.5 THEN 'LOW' WHEN m < 0.8 THEN 'MEDIUM' ELSE 'HIGH' END END AS band FROM b)
  SELECT signal, round(CASE WHEN band IS NOT NULL THEN m END, 8) AS score, band, CASE WHEN band IS NULL THEN 'none' WHEN band = 'LOW' THEN 'log_only' WHEN band = 'MEDIUM' THEN 'challenge_mfa' ELSE 'escalate_to_analyst' END AS action, outcome FROM d""")
def window_decisions(spark, sf_dir):
    """Signals to speech windows to scores to one decision each."""
    seg = G.segments(cleaned(spark, sf_dir), "signal", "frame", "speech", 6, 3)
    out = P.decide(seg.select("signal", F.col("coverage").alias("score"), (F.col("speech") * 0.5).alias("seconds")), "signal", "score", "seconds", "m1")
    return out.withColumn("score", F.round("score", 8))
