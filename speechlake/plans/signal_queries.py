"""Queries over signals and prosody; the events of a user are one signal."""

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from speechlake.operators import baselines as B
from speechlake.operators import signal as S
from speechlake.plans.registry import query, table

SIZE, HOP = 8, 4


def samples(spark, sf_dir):
    o = W.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("signal"), (F.row_number().over(o) - 1).cast("long").alias("idx"), ((F.col("value") - 100) / 400).alias("x"))


def framed(spark, sf_dir):
    return S.frames(samples(spark, sf_dir), "signal", "idx", "x", SIZE, HOP)


def masked(spark, sf_dir):
    return S.speech_mask(framed(spark, sf_dir), "signal", floor_db=-30.0, below_db=2.5, max_zcr=0.9)


def cleaned(spark, sf_dir):
    return S.clean_mask(masked(spark, sf_dir), "signal", "frame", "speech", 2, 2)


FRAMES = """
smp AS (SELECT user_id AS signal, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS idx, (value - 100) / 400 AS x FROM events),
crs AS (SELECT *, coalesce(sign(x) <> sign(lag(x) OVER (PARTITION BY signal ORDER BY idx)), false) AS crossed FROM smp),
fr AS (SELECT signal, frame, count(*) AS n, sqrt(avg(x * x)) AS rms, 20 * log10(greatest(sqrt(avg(x * x)), 1e-12)) AS energy_db, count_if(crossed AND idx <> frame * 4) / 7 AS zcr
  FROM (SELECT *, unnest(range(greatest(0, ceil((idx - 7) / 4))::BIGINT, idx // 4 + 1)) AS frame FROM crs) GROUP BY 1, 2 HAVING count(*) = 8)
"""
MASK = FRAMES + """, seed AS (SELECT signal, quantile_cont(energy_db, 0.9) - 6 AS s FROM fr GROUP BY 1),
ref AS (SELECT fr.signal, coalesce(quantile_cont(energy_db, 0.2) FILTER (energy_db >= s), max(energy_db)) AS r FROM fr JOIN seed USING (signal) GROUP BY 1),
mk AS (SELECT fr.*, greatest(-30.0, r - 2.5) AS threshold_db, energy_db >= greatest(-30.0, r - 2.5) AND zcr <= 0.9 AS speech FROM fr JOIN ref USING (signal))
"""


def _runs(name: str, source: str) -> str:
    return f"""{name}_c AS (SELECT *, CASE WHEN speech <> lag(speech) OVER (PARTITION BY signal ORDER BY frame) THEN 1 ELSE 0 END AS c FROM {source}),
{name}_r AS (SELECT *, sum(c) OVER (PARTITION BY signal ORDER BY frame) AS run FROM {name}_c),
{name} AS (SELECT *, count(*) OVER (PARTITION BY signal, run) AS len, run = 0 AS first_run, run = max(run) OVER (PARTITION BY signal) AS last_run FROM {name}_r)
"""


CLEAN = MASK + f""", {_runs('q', 'mk')}, k AS (SELECT signal, frame, n, rms, energy_db, zcr, threshold_db, speech AND len >= 2 AS speech FROM q), {_runs('w', 'k')},
cl AS (SELECT signal, frame, energy_db, zcr, rms, speech OR (NOT first_run AND NOT last_run AND len <= 2) AS speech FROM w)
"""


def _round(df, *names, digits=6):
    return df.withColumns({n: F.round(n, digits) for n in names})


@query(f"WITH {FRAMES} SELECT signal, frame, n, round(rms, 8) AS rms, round(energy_db, 6) AS energy_db, round(zcr, 8) AS zcr FROM fr")
def signal_frames(spark, sf_dir):
    return _round(_round(framed(spark, sf_dir), "rms", "zcr", digits=8), "energy_db")


@query(f"WITH {MASK} SELECT signal, frame, round(threshold_db, 6) AS threshold_db, speech FROM mk")
def speech_mask(spark, sf_dir):
    return _round(masked(spark, sf_dir).select("signal", "frame", "threshold_db", "speech"), "threshold_db")


@query(f"WITH {CLEAN} SELECT signal, frame, speech FROM cl")
def cleaned_mask(spark, sf_dir):
    return cleaned(spark, sf_dir).select("signal", "frame", "speech")


@query(f"""WITH {CLEAN}, {_runs('z', 'cl')}, sp AS (SELECT signal, run, min(frame) * 0.5 - 0.25 AS a, (max(frame) + 1) * 0.5 + 0.25 AS b FROM z WHERE speech GROUP BY 1, 2), en AS (SELECT signal, (max(frame) + 1) * 0.5 AS e FROM cl GROUP BY 1),
  mm AS (SELECT *, CASE WHEN a - max(b) OVER (PARTITION BY signal ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) <= 0.5 THEN 0 ELSE 1 END AS new FROM sp), g AS (SELECT *, sum(new) OVER (PARTITION BY signal ORDER BY a, b) AS grp FROM mm),
  u AS (SELECT signal, greatest(min(a), 0.0)::DOUBLE AS start_s, least(max(b), any_value(e))::DOUBLE AS end_s FROM g JOIN en USING (signal) GROUP BY signal, grp) SELECT * FROM u WHERE end_s - start_s >= 1.0""")
def speech_regions(spark, sf_dir):
    return S.regions(cleaned(spark, sf_dir), "signal", "frame", "speech", 0.5, 0.25, 0.5, 1.0)


SEGMENTS = CLEAN + """, n AS (SELECT signal, max(frame) + 1 AS n FROM cl GROUP BY 1), st AS (SELECT DISTINCT signal, n, unnest(CASE WHEN n >= 6 THEN list_append(range(0, n - 5, 3), n - 6) ELSE [0] END) AS start FROM n),
  v AS (SELECT st.signal, start, least(start + 6, st.n) AS stop, count_if(speech) AS speech FROM st JOIN cl ON cl.signal = st.signal AND frame >= start AND frame < least(start + 6, st.n) GROUP BY 1, 2, 3),
  k2 AS (SELECT *, speech / 6 AS coverage, coalesce(stop <= lag(stop) OVER (PARTITION BY signal ORDER BY start), false) AS inside FROM v), f AS (SELECT * FROM k2 WHERE NOT inside AND coverage >= 0.25),
  seg AS (SELECT signal, start, stop, speech::BIGINT AS speech, round(coverage, 8) AS coverage, (row_number() OVER (PARTITION BY signal ORDER BY start) - 1)::INT AS segment FROM f)"""


@query(f"WITH {SEGMENTS} SELECT * FROM seg")
def segment_windows(spark, sf_dir):
    return _round(S.segments(cleaned(spark, sf_dir), "signal", "frame", "speech", 6, 3), "coverage", digits=8)


@query(f"""WITH {SEGMENTS} SELECT signal || '#' || printf('%04d', segment) AS sample_id, signal::VARCHAR AS parent_id, start * 0.5::DOUBLE AS start_s, stop * 0.5::DOUBLE AS end_s, speech * 0.5::DOUBLE AS speech_s, coverage, stop - start < 6 AS padded,
  sha256(sha256(signal::VARCHAR) || '|' || start || '|' || stop) AS content_hash, CASE WHEN signal % 10 < 7 THEN 'train' WHEN signal % 10 = 7 THEN 'dev' ELSE 'test' END AS split, 'spk' || (signal % 40) AS speaker, CASE WHEN signal % 3 = 0 THEN 'spoof' ELSE 'bona_fide' END AS label
  FROM seg WHERE signal % 13 <> 5""")
def window_records(spark, sf_dir):
    """The windows of each signal as records that inherit its source's fields; signals without a source have none."""
    i = F.col("signal")
    made = S.segments(cleaned(spark, sf_dir), "signal", "frame", "speech", 6, 3)
    split = F.when(i % 10 < 7, "train").when(i % 10 == 7, "dev").otherwise("test")
    sources = table(spark, sf_dir, "events").select(F.col("user_id").alias("signal")).distinct().where(i % 13 != 5)
    sources = sources.select("signal", F.sha2(i.cast("string"), 256).alias("file_hash"), split.alias("split"), F.concat(F.lit("spk"), i % 40).alias("speaker"), F.when(i % 3 == 0, "spoof").otherwise("bona_fide").alias("label"))
    return _round(S.sample_records(made, sources, "signal", 0.5, 6), "coverage", digits=8)


@query(f"""WITH {FRAMES}, a AS (SELECT signal, max(abs(x)) AS peak, sqrt(avg(x * x)) AS rms, avg(x) AS dc, count_if(abs(x) >= 0.9) / count(*) AS clipped FROM smp GROUP BY 1),
  b AS (SELECT signal, count_if(energy_db <= -12) / count(*) AS silence, count(*) FILTER (energy_db > -12) AS m, quantile_cont(energy_db, 0.95) FILTER (energy_db > -12) - quantile_cont(energy_db, 0.1) FILTER (energy_db > -12) AS snr FROM fr GROUP BY 1)
  SELECT signal, round(peak, 8) AS peak, round(rms, 8) AS rms, round(peak / rms, 6) AS crest, round(dc, 8) AS dc, round(clipped, 8) AS clipped, round(silence, 8) AS silence, round(CASE WHEN m >= 3 AND snr >= 3 THEN snr END, 6) AS snr_db,
  concat_ws(',', CASE WHEN clipped > 0.01 THEN 'clipped' END, CASE WHEN abs(dc) > 0.05 THEN 'dc_offset' END, CASE WHEN silence > 0.9 THEN 'mostly_silent' END, CASE WHEN m >= 3 AND snr >= 3 AND snr < 10 THEN 'low_snr' END) AS issues, peak >= 1e-4 AS usable FROM a LEFT JOIN b USING (signal)""")
def signal_quality(spark, sf_dir):
    q = S.quality(samples(spark, sf_dir), "signal", "x", framed(spark, sf_dir), clip=0.9, silence_db=-12.0)
    return _round(_round(q, "peak", "rms", "dc", "clipped", "silence", digits=8), "crest", "snr_db")


@query("""WITH smp AS (SELECT event_id, user_id AS signal, (value - 100) / 400 AS x FROM events), v AS (SELECT event_id, signal, x - avg(x) OVER (PARTITION BY signal) AS v FROM smp), l AS (SELECT signal, sqrt(avg(v * v)) AS r, max(abs(v)) AS p FROM v GROUP BY 1),
  g AS (SELECT signal, CASE WHEN r < 1e-6 THEN 0.0 ELSE least(greatest(-20.0, least(20.0, -20 - 20 * log10(greatest(r, 1e-12)))), 20 * log10(0.99) - 20 * log10(greatest(p, 1e-12))) END AS gain FROM l)
  SELECT event_id, round(gain, 6) AS gain_db, round(v * pow(10.0, gain / 20), 6) AS normalized FROM v JOIN g USING (signal)""")
def loudness(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("signal"), ((F.col("value") - 100) / 400).alias("x"))
    return _round(S.normalized(e, "signal", "x").select("event_id", "gain_db", "normalized"), "gain_db", "normalized")


@query("""WITH f AS (SELECT vec_id % 20 AS clip, vec_id, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) - 1 AS dim FROM embeddings), s AS (SELECT clip, dim, avg(x) AS m, stddev_pop(x) AS s FROM f GROUP BY 1, 2)
  SELECT vec_id, dim::INT AS dim, round((x - m) / s, 5) AS cmvn FROM f JOIN s USING (clip, dim)""")
def mean_variance_normalisation(spark, sf_dir):
    f = table(spark, sf_dir, "embeddings").select((F.col("vec_id") % 20).alias("clip"), "vec_id", F.posexplode("embedding").alias("dim", "x")).withColumn("x", F.col("x").cast("double"))
    return _round(S.standardized(f, ["clip", "dim"], "x").select("vec_id", "dim", "cmvn"), "cmvn", digits=5)


@query(f"""WITH {FRAMES} SELECT signal, idx, round(coalesce(regr_slope(x, idx::DOUBLE) OVER (PARTITION BY signal ORDER BY idx ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING), 0.0), 8) AS delta FROM smp""")
def delta_features(spark, sf_dir):
    return _round(S.deltas(samples(spark, sf_dir), ["signal"], "idx", "x").select("signal", "idx", "delta"), "delta", digits=8)


@query(f"""WITH {FRAMES}, c AS (SELECT * FROM smp WHERE idx < 60), l AS (SELECT signal, count(*) AS n, max_by(x, idx) AS l, sum(x) AS s FROM c GROUP BY 1), m AS (SELECT *, (s + (60 - n) * l) / 60 AS mean FROM l)
  SELECT signal, round(any_value(mean), 8) AS mean, round(sqrt((sum((x - mean) ** 2) + any_value((60 - n) * (l - mean) ** 2)) / 60), 8) AS sd FROM c JOIN m USING (signal) GROUP BY 1""")
def pooled_features(spark, sf_dir):
    return _round(S.pooled(samples(spark, sf_dir), ["signal"], "idx", "x", 60), "mean", "sd", digits=8)


def _prosody(spark, sf_dir):
    c = cleaned(spark, sf_dir).withColumn("pitch_hz", F.when((F.col("zcr") < 0.5) & F.col("speech"), 100 + 200 * F.col("rms")))
    return S.prosody(c, "signal", "frame", frame_s=0.5)


_PROSODY = f"""{CLEAN}, p AS (SELECT *, CASE WHEN zcr < 0.5 AND speech THEN 100 + 200 * rms END AS pitch FROM cl), {_runs('z', 'cl')}, ru AS (SELECT signal, run, any_value(speech) AS sp, any_value(first_run) AS fi, any_value(last_run) AS la, count(*) * 0.5 AS s FROM z GROUP BY 1, 2),
  g AS (SELECT signal, count_if(NOT sp AND NOT fi AND NOT la)::DOUBLE AS pause_count, quantile_cont(s, 0.5) FILTER (NOT sp AND NOT fi AND NOT la) AS pause_median_s, count_if(sp)::DOUBLE AS segment_count FROM ru GROUP BY 1),
  b AS (SELECT signal, count(pitch) AS voiced, quantile_cont(pitch, 0.5) AS pitch_median_hz, stddev_pop(pitch) AS pitch_std_hz, max(pitch) - min(pitch) AS pitch_range_hz, quantile_cont(energy_db, 0.5) FILTER (speech) AS energy_median_db, stddev_pop(energy_db) FILTER (speech) AS energy_std_db,
    quantile_cont(energy_db, 0.9) FILTER (speech) - quantile_cont(energy_db, 0.1) FILTER (speech) AS energy_range_db, count_if(speech) / count(*) AS speech_ratio FROM p GROUP BY 1),
  j AS (SELECT * FROM b JOIN g USING (signal)), u AS (SELECT signal, voiced, unnest([{", ".join("{'f': '" + f + "', 'v': " + f + "}" for f in S.PROSODY)}]) AS x FROM j),
  fe AS (SELECT signal, x.f AS feature, round(CASE WHEN x.f NOT LIKE 'pitch%' OR voiced >= 3 THEN x.v END, 6) AS value, CASE WHEN x.f LIKE 'pitch%' THEN voiced >= 3 ELSE x.v IS NOT NULL END AS valid FROM u)"""


@query(f"WITH {_PROSODY} SELECT * FROM fe")
def prosody_features(spark, sf_dir):
    return _round(_prosody(spark, sf_dir).select("signal", "feature", "value", "valid"), "value")


@query(f"""WITH {_PROSODY} SELECT signal, count_if(valid)::BIGINT AS valid_features, CASE WHEN count_if(valid) = count(*) THEN 'PASS' WHEN count_if(valid) >= 3 THEN 'WARN' ELSE 'INCONCLUSIVE' END AS status, count_if(valid) >= 3 AS comparable FROM fe GROUP BY 1""")
def prosody_status(spark, sf_dir):
    return S.prosody_status(_prosody(spark, sf_dir), "signal")


@query(f"""WITH {CLEAN}, {_runs('z', 'cl')} SELECT signal, (count_if(speech) * 0.5)::DOUBLE AS speech_s, (coalesce(max(len) FILTER (speech), 0) * 0.5)::DOUBLE AS longest_s,
  CASE WHEN count(*) * 0.5 < 6 THEN 'short_clip' WHEN count_if(speech) * 0.5 < 3 THEN 'insufficient_speech' WHEN coalesce(max(len) FILTER (speech), 0) * 0.5 < 2.5 THEN 'no_contiguous_speech' END AS reason FROM z GROUP BY 1""")
def abstention_reasons(spark, sf_dir):
    return S.abstention(cleaned(spark, sf_dir), "signal", "frame", "speech", 0.5, 3.0, 2.5, 6.0)


FEATURES = "fe AS (SELECT user_id % 10 AS speaker, user_id AS sample, event_type AS feature, avg(value) AS value, count(*) >= 3 AS valid FROM events GROUP BY 1, 2, 3)"
BASE = FEATURES + """, go AS (SELECT speaker, sample FROM fe WHERE valid GROUP BY 1, 2 HAVING count(*) >= 3), en AS (SELECT speaker FROM go GROUP BY 1 HAVING count(*) >= 3), ro AS (SELECT fe.* FROM fe JOIN go USING (speaker, sample) JOIN en USING (speaker) WHERE valid),
ba AS (SELECT speaker, feature, count(*) AS n, avg(value) AS mean, stddev_pop(value) AS sd, quantile_cont(value, 0.5) AS median FROM ro GROUP BY 1, 2 HAVING count(*) >= 3),
bl AS (SELECT ba.*, mad FROM ba JOIN (SELECT ro.speaker, ro.feature, quantile_cont(abs(value - median), 0.5) AS mad FROM ro JOIN ba USING (speaker, feature) GROUP BY 1, 2) USING (speaker, feature)),
dv AS (SELECT fe.*, abs(value - median) / greatest(sd, 1.4826 * mad, 1e-9) AS deviation, n FROM fe LEFT JOIN bl USING (speaker, feature) WHERE valid)
"""


def _features(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.groupBy((F.col("user_id") % 10).alias("speaker"), F.col("user_id").alias("sample"), F.col("event_type").alias("feature")).agg(F.avg("value").alias("value"), (F.count(F.lit(1)) >= 3).alias("valid"))


@query(f"WITH {BASE} SELECT speaker, feature, n, round(mean, 6) AS mean, round(sd, 6) AS sd, round(median, 6) AS median, round(mad, 6) AS mad FROM bl")
def prosody_baselines(spark, sf_dir):
    return _round(B.enroll(_features(spark, sf_dir), "speaker", "sample"), "mean", "sd", "median", "mad")


@query(f"WITH {BASE} SELECT speaker, sample, feature, round(deviation, 6) AS deviation, deviation >= 2 AS outside, CASE WHEN n >= 10 THEN 'HIGH' WHEN n IS NOT NULL THEN 'LIMITED' END AS confidence FROM dv")
def baseline_deviations(spark, sf_dir):
    f = _features(spark, sf_dir)
    return _round(B.compare(f, B.enroll(f, "speaker", "sample"), "speaker", limit=2.0).drop("value", "valid"), "deviation")


@query(f"""WITH {BASE}, g AS (SELECT speaker, sample, count(deviation) AS compared, count_if(deviation IS NULL)::BIGINT AS missing, coalesce(count_if(deviation >= 2), 0)::BIGINT AS outside, coalesce(count_if(n < 10), 0) AS lim FROM dv GROUP BY 1, 2)
  SELECT speaker, sample, compared, missing, outside, CASE WHEN compared < 3 THEN 'INCONCLUSIVE' WHEN outside > 0 THEN 'DEVIATES' ELSE 'CONSISTENT' END AS status,
  concat_ws(',', CASE WHEN missing > 0 THEN 'features_without_baseline' END, CASE WHEN lim > 0 THEN 'limited_baseline' END, CASE WHEN compared < 3 THEN 'too_few_features' END) AS warnings FROM g""")
def prosody_analysis(spark, sf_dir):
    f = _features(spark, sf_dir)
    return B.summarize(B.compare(f, B.enroll(f, "speaker", "sample"), "speaker", limit=2.0), ["speaker", "sample"])


_VERSIONS = "ve AS (SELECT o_custkey AS key, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS version, o_totalprice AS value, o_orderstatus = 'P' AS deleted, o_orderstatus <> 'F' AS active, 1 + o_orderkey % 2 AS schema_version, CASE WHEN o_orderkey % 3 = 0 THEN 'a' ELSE 'b' END AS fingerprint FROM orders)"


def _versions(spark, sf_dir):
    o = W.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    k = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("key"), F.row_number().over(o).cast("long").alias("version"), F.col("o_totalprice").alias("value"), (F.col("o_orderstatus") == "P").alias("deleted"),
        (F.col("o_orderstatus") != "F").alias("active"), (1 + k % 2).alias("schema_version"), F.when(k % 3 == 0, "a").otherwise("b").alias("fingerprint"),
    )


@query(f"WITH {_VERSIONS}, l AS (SELECT *, max(version) OVER (PARTITION BY key) AS top FROM ve) SELECT key, version, value, active AND schema_version = 1 AND fingerprint = 'b' AS compatible FROM l WHERE version = top AND NOT deleted")
def baseline_lifecycle(spark, sf_dir):
    now = B.latest(_versions(spark, sf_dir), "key")
    return B.compatible(now, 1, "b").select("key", "version", "value", "compatible")


@query(f"WITH {_VERSIONS} SELECT key, 'gap in versions' AS problem FROM ve WHERE version % 7 <> 3 GROUP BY key HAVING max(version) <> count(*)")
def version_integrity(spark, sf_dir):
    return B.version_problems(_versions(spark, sf_dir).where("version % 7 <> 3"), "key")


@query("SELECT event_type, count_if(value > 50)::BIGINT AS succeeded, count_if(value <= 50 AND value > 20)::BIGINT AS rejected, count_if(value <= 20)::BIGINT AS failed, round(avg(value) FILTER (value > 50), 6) AS mean_latency FROM events GROUP BY 1")
def extraction_reliability(spark, sf_dir):
    v = F.col("value")
    return _round(table(spark, sf_dir, "events").groupBy("event_type").agg(F.count_if(v > 50).alias("succeeded"), F.count_if((v <= 50) & (v > 20)).alias("rejected"), F.count_if(v <= 20).alias("failed"), F.avg(F.when(v > 50, v)).alias("mean_latency")), "mean_latency")
