"""Queries over speakers, privacy and policy."""

from pyspark.sql import functions as F

from speechlake.operators import metrics as M
from speechlake.operators import privacy as P
from speechlake.operators import speaker as S
from speechlake.operators.profiles import Profiles
from speechlake.functions import vectors as V
from speechlake.plans.registry import query, table
from speechlake.sources.shared import new_path, written
from speechlake.sources.versions import VersionedTable


def _round(df, *names, digits=6):
    return df.withColumns({n: F.round(n, digits) for n in names})


def recordings(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    split = F.when(F.col("label") < 5, "dev").otherwise("test")
    return e.select("vec_id", "embedding", F.col("vec_id").alias("recording_id"), F.concat(F.lit("s"), (F.col("vec_id") % 40), F.lit("-"), "label").alias("speaker_id"), (F.col("vec_id") % 3).alias("session"), split.alias("split"))


#: Trials of a split, half of each class at most, where a query's SQL has the cap.
CAP = 4000


def trials(spark, sf_dir, cap=CAP):
    r = recordings(spark, sf_dir)
    parts = [S.build_trials(r.where(F.col("split") == s), cap=cap).withColumn("split", F.lit(s)) for s in ("dev", "test")]
    return parts[0].unionByName(parts[1])


def scored_trials(spark, sf_dir, cap=CAP):
    r = recordings(spark, sf_dir)
    return written(S.score_trials(trials(spark, sf_dir, cap), r, "recording_id", "embedding"), "scored")


_GENUINE = """
re AS (SELECT vec_id AS recording_id, 's' || (vec_id % 40) || '-' || label AS speaker_id, vec_id % 3 AS session, CASE WHEN label < 5 THEN 'dev' ELSE 'test' END AS split, sha256('0|' || vec_id) AS h, embedding::DOUBLE[] AS v FROM embeddings),
fi AS (SELECT * FROM re QUALIFY row_number() OVER (PARTITION BY speaker_id ORDER BY h) = 1),
ge AS (SELECT fi.recording_id AS enrol, re.recording_id AS test, fi.speaker_id AS speaker_a, fi.speaker_id AS speaker_b, 1 AS label, re.session <> fi.session AS cross_session, fi.split
  FROM re JOIN fi USING (speaker_id) WHERE re.recording_id <> fi.recording_id QUALIFY row_number() OVER (PARTITION BY speaker_id ORDER BY re.session = fi.session, re.h) = 1)
"""
_SCORES = """,
ts AS (SELECT tr.*, list_cosine_similarity(a.v, b.v) AS score FROM tr JOIN re a ON a.recording_id = enrol JOIN re b ON b.recording_id = test)"""
#: Each two speakers of a split.
EVERY_TRIAL = _GENUINE + """,
im AS (SELECT a.recording_id AS enrol, b.recording_id AS test, a.speaker_id AS speaker_a, b.speaker_id AS speaker_b, 0 AS label, true AS cross_session, a.split FROM fi a JOIN fi b ON a.split = b.split AND a.speaker_id < b.speaker_id),
tr AS (SELECT *, substr(sha256(enrol || '|' || test), 1, 16) AS trial_id FROM (SELECT * FROM ge UNION ALL SELECT * FROM im))
"""
EVERY_SCORE = EVERY_TRIAL + _SCORES
TRIALS = _GENUINE + f""",
pl AS (SELECT *, row_number() OVER (PARTITION BY split ORDER BY sha256('0|' || speaker_id)) - 1 AS place, count(*) OVER (PARTITION BY split) AS n FROM fi),
st AS (SELECT *, unnest(range(1, least(n // 2, ({CAP // 2} + n - 1) // n) + 1)) AS step FROM pl),
im AS (SELECT CASE WHEN a.speaker_id < b.speaker_id THEN a.recording_id ELSE b.recording_id END AS enrol, CASE WHEN a.speaker_id < b.speaker_id THEN b.recording_id ELSE a.recording_id END AS test,
  least(a.speaker_id, b.speaker_id) AS speaker_a, greatest(a.speaker_id, b.speaker_id) AS speaker_b, 0 AS label, true AS cross_session, a.split FROM st a JOIN pl b ON b.split = a.split AND b.place = (a.place + a.step) % a.n WHERE 2 * a.step < a.n OR a.place < a.step),
tr AS (SELECT *, substr(sha256(enrol || '|' || test), 1, 16) AS trial_id FROM (SELECT * FROM ge UNION ALL SELECT * FROM im) QUALIFY row_number() OVER (PARTITION BY split, label ORDER BY trial_id) <= {CAP // 2}){_SCORES}
"""


@query("SELECT vec_id, round(sqrt(list_sum(list_transform(embedding::DOUBLE[], lambda x: x * x))), 6) AS norm, round(list_cosine_similarity(embedding::DOUBLE[], [1.0] || list_resize([]::DOUBLE[], 63, 0.0)), 6) AS first_axis FROM embeddings")
def vector_norms(spark, sf_dir):
    axis = F.array(*[F.lit(1.0 if i == 0 else 0.0) for i in range(64)])
    return _round(table(spark, sf_dir, "embeddings").select("vec_id", V.norm(F.col("embedding")).alias("norm"), V.cosine(V.normalized(F.col("embedding"), 64), axis).alias("first_axis")), "norm", "first_axis")


@query(f"WITH {EVERY_TRIAL} SELECT trial_id, enrol, test, speaker_a, speaker_b, label, cross_session, split FROM tr")
def speaker_trials(spark, sf_dir):
    """Every two speakers of a split; recordings() makes at most 400 of them, however many rows there are."""
    return trials(spark, sf_dir, cap=None)


@query(f"""WITH {_GENUINE}, n AS (SELECT *, row_number() OVER (ORDER BY sha256('0|' || speaker_id)) - 1 AS place, count(*) OVER () AS n FROM fi),
  st AS (SELECT *, unnest(range(1, least(n // 2, (1000 + n - 1) // n) + 1)) AS step FROM n),
  pa AS (SELECT CASE WHEN a.speaker_id < b.speaker_id THEN a.recording_id ELSE b.recording_id END AS enrol, CASE WHEN a.speaker_id < b.speaker_id THEN b.recording_id ELSE a.recording_id END AS test,
    least(a.speaker_id, b.speaker_id) AS speaker_a, greatest(a.speaker_id, b.speaker_id) AS speaker_b FROM st a JOIN n b ON b.place = (a.place + a.step) % a.n WHERE 2 * a.step < a.n OR a.place < a.step),
  c AS (SELECT enrol, test, speaker_a, speaker_b, label FROM ge UNION ALL SELECT enrol, test, speaker_a, speaker_b, 0 FROM pa), d AS (SELECT *, substr(sha256(enrol || '|' || test), 1, 16) AS trial_id FROM c)
  SELECT trial_id, enrol, test, speaker_a, speaker_b, label FROM d QUALIFY row_number() OVER (PARTITION BY label ORDER BY trial_id) <= 1000""")
def capped_trials(spark, sf_dir):
    """At most 2000 trials over all splits, half of each class; impostor pairs are sampled before they are joined."""
    return S.build_trials(recordings(spark, sf_dir), cap=2000).select("trial_id", "enrol", "test", "speaker_a", "speaker_b", "label")


@query(f"""WITH {TRIALS}, sides AS (SELECT enrol AS r, speaker_a AS s, split FROM tr UNION ALL SELECT test, speaker_b, split FROM tr)
  SELECT 'self_pair' AS rule, count_if(enrol = test)::BIGINT AS broken FROM tr UNION ALL SELECT 'wrong_label', count_if((label = 1) <> (speaker_a = speaker_b))::BIGINT FROM tr
  UNION ALL SELECT 'two_speakers', count(*) FROM (SELECT r FROM sides GROUP BY r HAVING count(DISTINCT s) > 1) UNION ALL SELECT 'shared_speaker', count(*) FROM (SELECT s FROM sides GROUP BY s HAVING count(DISTINCT split) > 1)""")
def trial_integrity(spark, sf_dir):
    return S.trial_problems(trials(spark, sf_dir))


@query(f"WITH {EVERY_SCORE} SELECT trial_id, label, round(score, 6) AS score FROM ts")
def trial_scores(spark, sf_dir):
    return _round(scored_trials(spark, sf_dir, cap=None).select("trial_id", "label", "score"), "score")


@query(f"""WITH {EVERY_SCORE}, p AS (SELECT split, round(score, 9) AS threshold, sum(label)::BIGINT AS p, sum(1 - label)::BIGINT AS n FROM ts GROUP BY 1, 2), c AS (SELECT *, sum(p) OVER (PARTITION BY split ORDER BY threshold DESC) AS tp, sum(n) OVER (PARTITION BY split ORDER BY threshold DESC) AS fp,
  sum(p) OVER (PARTITION BY split) AS ap, sum(n) OVER (PARTITION BY split) AS an FROM p), o AS (SELECT *, fp / an AS far, (ap - tp) / ap AS frr FROM c), e AS (SELECT * FROM o QUALIFY row_number() OVER (PARTITION BY split ORDER BY round(abs(far - frr), 12), threshold DESC) = 1),
  a AS (SELECT split, sum(p * (2 * (an - fp) + n)) / (2.0 * sum(p) * sum(n)) AS auc FROM o GROUP BY 1) SELECT split, round(auc, 8) AS auc, round((far + frr) / 2, 8) AS eer, threshold AS eer_threshold FROM e JOIN a USING (split)""")
def verification_metrics(spark, sf_dir):
    s = scored_trials(spark, sf_dir, cap=None).withColumn("score", F.round("score", 9))
    p = M.operating_points(s, ["split"])
    return _round(M.gap_eer(p, ["split"]).join(M.auc(p, ["split"]), "split"), "auc", "eer", digits=8)


@query(f"""WITH {EVERY_SCORE}, g AS (SELECT 'session' AS axis, cross_session::VARCHAR AS value, label, score FROM ts UNION ALL SELECT 'split', split, label, score FROM ts)
  SELECT axis, value, label, count(*) AS n, round(avg(score), 6) AS mean, round(stddev_pop(score), 6) AS sd, round(quantile_cont(score, 0.5), 6) AS median FROM g GROUP BY 1, 2, 3""")
def stratified_trials(spark, sf_dir):
    s = scored_trials(spark, sf_dir, cap=None)
    pairs = F.array(F.struct(F.lit("session").alias("axis"), F.col("cross_session").cast("string").alias("value")), F.struct(F.lit("split").alias("axis"), F.col("split").alias("value")))
    long = s.select("label", "score", F.explode(pairs).alias("p")).select("label", "score", "p.axis", "p.value")
    return _round(M.score_distribution(long, ["axis", "value", "label"]).select("axis", "value", "label", "n", "mean", "sd", "median"), "mean", "sd", "median")


@query(f"""WITH {TRIALS}, p AS (SELECT split, score AS t, sum(label) AS p, sum(1 - label) AS n FROM ts GROUP BY 1, 2), c AS (SELECT *, sum(p) OVER w AS tp, sum(n) OVER w AS fp, sum(p) OVER a AS ap, sum(n) OVER a AS an FROM p WINDOW w AS (PARTITION BY split ORDER BY t DESC), a AS (PARTITION BY split)),
  o AS (SELECT *, fp / an AS far, (ap - tp) / ap AS frr FROM c), k AS ((SELECT 'eer' AS policy, * FROM o WHERE split = 'dev' ORDER BY round(abs(far - frr), 12), t DESC LIMIT 1) UNION ALL (SELECT 'target_far', * FROM o WHERE split = 'dev' AND far <= 0.01 ORDER BY frr, far, t DESC LIMIT 1))
  SELECT policy, round(k.t, 6) AS t, round(any_value(k.far), 8) AS dev_far, round(any_value(k.frr), 8) AS dev_frr, round(max(o.far), 8) AS test_far, round(min(o.frr), 8) AS test_frr FROM k JOIN o ON o.split = 'test' AND o.t >= k.t GROUP BY policy, k.t""")
def speaker_thresholds(spark, sf_dir):
    """Thresholds picked on dev, with their error rates on test."""
    s = scored_trials(spark, sf_dir)
    dev, test = (M.operating_points(s.where(F.col("split") == x)) for x in ("dev", "test"))
    out = None
    for name, (policy, far) in {"eer": ("eer", None), "target_far": ("max_recall", 0.01)}.items():
        pick = M.select_threshold(dev, policy, max_far=far).select(F.lit(name).alias("policy"), F.col("threshold").alias("t"), F.col("far").alias("dev_far"), F.col("frr").alias("dev_frr"))
        near = test.join(F.broadcast(pick), F.col("threshold") >= F.col("t"))  # pick is one row
        part = near.groupBy("policy", "t", "dev_far", "dev_frr").agg(F.max("far").alias("test_far"), F.min("frr").alias("test_frr"))
        out = part if out is None else out.unionByName(part)
    return _round(_round(out, "t"), "dev_far", "dev_frr", "test_far", "test_frr", digits=8)


def _profiles(spark, sf_dir):
    r = recordings(spark, sf_dir).withColumn("profile_id", F.col("vec_id") % 25)
    return S.accepted_samples(r.select("profile_id", "recording_id", "embedding"), "profile_id", "recording_id", "embedding", size=64)


@query("WITH p AS (SELECT vec_id % 25 AS profile_id, count(*) AS samples FROM embeddings GROUP BY 1), f AS (SELECT vec_id % 25 AS profile_id, vec_id, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS d, sqrt(list_sum(list_transform(embedding::DOUBLE[], lambda x: x * x))) AS n FROM embeddings), m AS (SELECT profile_id, d, avg(x / n) AS m FROM f GROUP BY 1, 2) SELECT profile_id, any_value(samples) AS samples, round(max(m) / sqrt(sum(m * m)), 6) AS largest FROM m JOIN p USING (profile_id) GROUP BY 1")
def enroll_profiles(spark, sf_dir):
    return _round(S.centroids(_profiles(spark, sf_dir), "profile_id").select("profile_id", "samples", F.array_max("centroid").alias("largest")), "largest")


@query("""WITH r AS (SELECT vec_id % 25 AS p, vec_id AS i, embedding AS e, embedding::DOUBLE[] AS v FROM embeddings),
  w AS (SELECT b.p, b.i, count_if(a.e = b.e) AS equal, count_if(list_cosine_similarity(a.v, b.v) >= 0.99999) AS near FROM r b LEFT JOIN r a ON a.p = b.p AND a.i < b.i GROUP BY 1, 2)
  SELECT p AS profile_id, i AS recording_id, CASE WHEN equal > 0 THEN 'duplicate' WHEN near > 0 THEN 'near_duplicate' ELSE 'accepted' END AS outcome FROM w""")
def enrolment_outcomes(spark, sf_dir):
    return _profiles(spark, sf_dir).select("profile_id", "recording_id", "outcome")


@query("""WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings), pr AS (SELECT vec_id AS profile_id, v AS c, vec_id % 4 <> 1 AS active, vec_id % 4 = 2 AS old FROM e WHERE vec_id % 2 = 0 OR vec_id % 4 = 1)
  SELECT e.vec_id, CASE WHEN pr.profile_id IS NULL THEN 'unknown_profile' WHEN NOT active THEN 'inactive' WHEN old THEN 'expired' WHEN list_cosine_similarity(v, c) >= 0.05 THEN 'MATCH' ELSE 'NON_MATCH' END AS decision FROM e LEFT JOIN pr ON pr.profile_id = e.vec_id + 4""")
def verify_probes(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    i = F.col("vec_id")
    now = F.to_timestamp(F.lit("2024-06-01"))
    profiles = e.where((i % 2 == 0) | (i % 4 == 1)).select(i.alias("profile_id"), F.col("embedding").cast("array<double>").alias("centroid"), (i % 4 != 1).alias("active"), F.when(i % 4 == 2, F.to_timestamp(F.lit("2024-01-01"))).otherwise(F.to_timestamp(F.lit("2025-01-01"))).alias("expires_at"))
    return S.verify(e.withColumn("profile_id", i + 4), profiles, "embedding", now, threshold=0.05).select("vec_id", "decision")


_ENROLLED = """r AS (SELECT vec_id AS i, vec_id // 20 AS p, vec_id % 7 <> 3 AS quality, (vec_id // 20) % 5 <> 2 AS authorized, CASE WHEN (vec_id // 20) % 6 = 4 AND vec_id % 20 = 7 THEN ' ' ELSE 'form ' || (vec_id // 20) END AS consent,
    1 + vec_id % 9 AS duration_s, embedding::DOUBLE[] AS v, embedding AS e FROM embeddings),
  ok AS (SELECT p FROM r GROUP BY p HAVING bool_and(authorized AND trim(consent) <> '')), a AS (SELECT r.* FROM r JOIN ok USING (p) WHERE quality),
  w AS (SELECT b.p, b.i, count_if(x.e = b.e) AS equal, count_if(list_cosine_similarity(x.v, b.v) >= 0.99999) AS near FROM a b LEFT JOIN a x ON x.p = b.p AND x.i < b.i GROUP BY 1, 2),
  oc AS (SELECT r.p, r.i, r.duration_s, r.v, CASE WHEN ok.p IS NULL THEN 'consent_required' WHEN NOT quality THEN 'quality' WHEN equal > 0 THEN 'duplicate' WHEN near > 0 THEN 'near_duplicate' ELSE 'accepted' END AS outcome
    FROM r LEFT JOIN ok ON ok.p = r.p LEFT JOIN w ON w.p = r.p AND w.i = r.i)"""


_MEANS = """f AS (SELECT p, unnest(v) AS x, generate_subscripts(v, 1) AS d, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS n FROM oc WHERE outcome = 'accepted'), m AS (SELECT p, d, avg(x / n) AS m FROM f GROUP BY 1, 2)"""


def _enrolled(spark, sf_dir):
    i = F.col("vec_id")
    group = F.floor(i / 20)
    consent = F.when((group % 6 == 4) & (i % 20 == 7), " ").otherwise(F.concat(F.lit("form "), group))
    rows = table(spark, sf_dir, "embeddings").select(group.alias("profile_id"), i.alias("recording_id"), "embedding", (i % 7 != 3).alias("accepted"), (group % 5 != 2).alias("authorized"), consent.alias("consent"), (1 + i % 9).alias("duration_s"))
    return S.enroll(rows, "profile_id", "recording_id", "embedding", size=64)


@query(f"WITH {_ENROLLED} SELECT p AS profile_id, i AS recording_id, outcome FROM oc")
def enrolment_with_consent(spark, sf_dir):
    """What becomes of each sample where profiles need consent and samples a quality."""
    return _enrolled(spark, sf_dir)[1]


@query(f"""WITH {_ENROLLED}, {_MEANS}, c AS (SELECT p, list_transform(list(m ORDER BY d), lambda x: round(x / sqrt(sum(m * m)), 4) + 0.0) AS c FROM m GROUP BY p)
  SELECT p AS profile_id, count(*) AS samples, 'form ' || p AS consent, round(avg(duration_s), 6) AS mean_duration_s, array_to_string(list_transform(any_value(c), lambda x: printf('%.4f', x)), ',') AS centroid FROM oc JOIN c USING (p) WHERE outcome = 'accepted' GROUP BY p""")
def profiles_with_consent(spark, sf_dir):
    """The profiles, all dimensions, and what is summed up of their samples."""
    made = _enrolled(spark, sf_dir)[0]
    numbers = F.transform("centroid", lambda x: F.format_string("%.4f", F.round(x, 4) + 0.0))
    return _round(made.select("profile_id", "samples", "consent", "mean_duration_s", F.array_join(numbers, ",").alias("centroid")), "mean_duration_s")


@query(f"""WITH {_ENROLLED}, {_MEANS}, c AS (SELECT p, list(m ORDER BY d) AS c FROM m GROUP BY p)
  SELECT i AS recording_id, r.p AS profile_id, CASE WHEN c.p IS NULL THEN 'unknown_profile' WHEN list_cosine_similarity(v, c) >= 0.2 THEN 'MATCH' ELSE 'NON_MATCH' END AS decision, round(list_cosine_similarity(v, c), 6) AS score, CASE WHEN c.p IS NOT NULL THEN 1 END AS profile_version,
    substr(sha256(i || '|' || r.p || '|2024-06-01 00:00:00'), 1, 32) AS verification_id FROM r LEFT JOIN c USING (p)""")
def verification_audit(spark, sf_dir):
    """Every recording against the profile of its group; the events are appended to a log in two writes and read back."""
    at = F.to_timestamp(F.lit("2024-06-01 00:00:00"))
    made = _enrolled(spark, sf_dir)[0].withColumns({"active": F.lit(True), "expires_at": F.lit(None).cast("timestamp"), "version": F.lit(1)})
    probes = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("recording_id"), F.floor(F.col("vec_id") / 20).alias("profile_id"), "embedding")
    made = written(made, "profiles")
    events = S.verification_events(S.verify(probes, made, "embedding", at, threshold=0.2), "recording_id", made, 0.2, "p1", at)
    log = VersionedTable(spark, new_path(spark, "verifications"), events.schema)
    for part in (0, 1):
        log.append(events.where(F.pmod(F.xxhash64("recording_id"), F.lit(2)) == part))
    return _round(log.read().select("verification_id", "recording_id", "profile_id", "decision", "score", "profile_version"), "score")


@query("""WITH p AS (SELECT *, vec_id % 2 = 0 AS made, vec_id % 6 = 0 AS updated, vec_id % 10 = 0 AS off, vec_id % 14 = 0 AS gone, md5(vec_id::VARCHAR) AS h FROM embeddings)
  SELECT vec_id, (1 + updated::INT + off::INT)::INT AS version, (CASE WHEN updated THEN 2 ELSE 1 END)::BIGINT AS samples, NOT off AS active, NOT off AND vec_id % 4 <> 0 AS listed FROM p WHERE made AND NOT gone""")
def profile_lifecycle(spark, sf_dir):
    """Profiles are created, updated, switched off and deleted by tables of them."""
    e = table(spark, sf_dir, "embeddings")
    h, i = F.md5(F.col("vec_id").cast("string")), F.col("vec_id")
    uuid = F.concat_ws("-", *[F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])
    at = lambda day: F.to_timestamp(F.lit(day))
    new = e.where(i % 2 == 0).select(
        "vec_id", uuid.alias("profile_id"), F.lit(1).alias("version"), F.lit("e1").alias("encoder"), F.size("embedding").alias("dimension"), V.normalized(F.col("embedding")).alias("centroid"),
        F.lit(1).cast("long").alias("samples"), F.lit("form 7").alias("consent"), at("2024-01-01").alias("created_at"), F.when(i % 4 == 0, at("2024-02-01")).alias("expires_at"), F.lit(True).alias("active"),
    )
    store = Profiles(spark, new_path(spark, "profiles"))
    store.create(new)
    store.update(new.where(i % 6 == 0).withColumns({"version": F.lit(2), "samples": F.lit(2).cast("long")}))
    store.deactivate(new.where(i % 10 == 0))
    store.delete(new.where(i % 14 == 0))
    listed = store.active(at("2024-06-01")).select("profile_id", F.lit(True).alias("listed"))
    rows = store.all().join(listed, "profile_id", "left").join(new.select("vec_id", "profile_id"), "profile_id")
    return rows.select("vec_id", "version", "samples", "active", F.coalesce("listed", F.lit(False)).alias("listed"))


@query("SELECT user_id, concat_ws(',', CASE WHEN n < 60 THEN 'too_few_samples' END, CASE WHEN m > 110 THEN 'too_loud' END, CASE WHEN lo < 0.5 THEN 'drop_outs' END) AS reasons, NOT (n < 60 OR m > 110 OR lo < 0.5) AS accepted FROM (SELECT user_id, count(*) AS n, avg(value) AS m, min(value) AS lo FROM events GROUP BY 1)")
def speaker_sample_quality(spark, sf_dir):
    per = table(spark, sf_dir, "events").groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("m"), F.min("value").alias("lo"))
    return S.sample_quality(per, [("too_few_samples", F.col("n") < 60), ("too_loud", F.col("m") > 110), ("drop_outs", F.col("lo") < 0.5)]).select("user_id", "reasons", "accepted")


# ---- privacy, audit, decisions

_DETAILS = (
    '{"contact":{"customer_email":"x"}}', '{"notes":[{"text":"a.b@c.org"}]}', '{"v":{"w":"+49 170 1234567"}}', '{"audio_ms":"12","path":"see /home/u1/x.wav now"}',
    '{"v":{"series":[' + ",".join(map(str, range(40))) + "]}}", '{"sample_rate_hz":16000,"name":"mel"}',
)


def _json(spark, sf_dir):
    """The metadata of each event: its type, its props and a detail of one of six kinds, some of them nested."""
    detail = F.element_at(F.array(*map(F.lit, _DETAILS)), (F.col("event_id") % 6 + 1).cast("int"))
    j = F.concat(F.lit('{"event":"'), "event_type", F.lit('","props":'), "props", F.lit(',"detail":'), detail, F.lit("}"))
    return table(spark, sf_dir, "events").select("event_id", j.alias("j"))


@query("SELECT event_id, CASE WHEN regexp_matches(props, '\"[^\"]*(email|phone|audio)') THEN 'forbidden_key' ELSE ['forbidden_key', 'identifier_value', 'identifier_value', 'forbidden_key', 'long_sequence', NULL][event_id % 6 + 1] END AS problem FROM events")
def identifier_screen(spark, sf_dir):
    return P.screen(_json(spark, sf_dir), "j").select("event_id", "problem")


@query(r"""SELECT doc_id, regexp_matches(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}') AS email, regexp_matches(text, '\b[0-9]{3}-[0-9]{2}-[0-9]{4}\b') AS ssn FROM documents""")
def document_screen(spark, sf_dir):
    t = F.col("text")
    return table(spark, sf_dir, "documents").select("doc_id", t.rlike(P.TEXT_SHAPES["email"]).alias("email"), t.rlike(P.TEXT_SHAPES["ssn"]).alias("ssn"))


@query("""SELECT event_id, '{"event":"' || event_type || '","props":' || replace(props, ' ', '') || ',"detail":' || ['{"contact":{"customer_email":"[redacted]"}}', '{"notes":[{"text":"[redacted]"}]}', '{"v":{"w":"[redacted]"}}',
  '{"audio_ms":"12","path":"see [redacted] now"}', '{"v":{"series":"[list len=40 redacted]"}}', '{"sample_rate_hz":16000,"name":"mel"}'][event_id % 6 + 1] || '}' AS scrubbed FROM events""")
def scrubbed_metadata(spark, sf_dir):
    return _json(spark, sf_dir).select("event_id", P.scrub(F.col("j")).alias("scrubbed"))


@query("SELECT event_id, CASE WHEN event_id % 3 <> 0 THEN lower(substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-4' || substr(h, 14, 3) || '-a' || substr(h, 18, 3) || '-' || substr(h, 21, 12)) END AS session_id FROM (SELECT event_id, md5(event_id::VARCHAR) AS h FROM events)")
def session_ids(spark, sf_dir):
    h = F.md5(F.col("event_id").cast("string"))
    s = lambda a, n: F.substring(h, a, n)
    made = F.upper(F.concat(s(1, 8), F.lit("-"), s(9, 4), F.lit("-4"), s(14, 3), F.lit("-a"), s(18, 3), F.lit("-"), s(21, 12)))
    return table(spark, sf_dir, "events").select("event_id", P.session_id(F.when(F.col("event_id") % 3 == 0, h).otherwise(F.concat(F.lit(" "), made))).alias("session_id"))


@query("SELECT event_type, count_if(ts + INTERVAL 10 DAY <= TIMESTAMP '2024-01-25')::BIGINT AS expired, count_if(ts + INTERVAL 10 DAY > TIMESTAMP '2024-01-25')::BIGINT AS kept FROM events GROUP BY 1")
def audit_retention(spark, sf_dir):
    rows = P.with_expiry(table(spark, sf_dir, "events"), "ts", 10)
    kept, gone = P.purge(rows, F.lit("2024-01-25").cast("timestamp_ntz"))
    both = kept.select("event_type", F.lit(0).alias("x")).unionByName(gone.select("event_type", F.lit(1).alias("x")))
    return both.groupBy("event_type").agg(F.count_if(F.col("x") == 1).alias("expired"), F.count_if(F.col("x") == 0).alias("kept"))


@query("SELECT event_id, event_type FROM events WHERE event_id % 10 = 7 AND event_id % 3 <> 0")
def audit_lookup(spark, sf_dir):
    """Two appends, a deletion that rewrites the log, and a lookup."""
    e = table(spark, sf_dir, "events").select("event_id", "event_type")
    log = VersionedTable(spark, new_path(spark, "audit"), e.schema)
    for part in (0, 1):
        log.append(e.where(F.pmod(F.xxhash64("event_id"), F.lit(2)) == part))
    log.rewrite(log.read().join(e.where(F.col("event_id") % 3 == 0).select("event_id"), "event_id", "left_anti"))
    return log.read().where(F.col("event_id") % 10 == 7)


@query("""WITH w AS (SELECT conv_id, CASE WHEN role = 'assistant' THEN (length(text) % 100) / 99.0 END AS s FROM conversations), g AS (SELECT conv_id, count(s) AS n, least(1.0, greatest(0.0, coalesce(avg(s), 0.0))) AS m, coalesce(sum(CASE WHEN s IS NOT NULL THEN 0.5 END), 0.0) AS sec FROM w GROUP BY 1),
  o AS (SELECT *, CASE WHEN n = 0 THEN 'UNSCORED' WHEN sec < 1 THEN 'INSUFFICIENT_SPEECH' ELSE 'DECIDED' END AS outcome FROM g), b AS (SELECT *, CASE WHEN outcome = 'DECIDED' THEN CASE WHEN m < 0.5 THEN 'LOW' WHEN m < 0.8 THEN 'MEDIUM' ELSE 'HIGH' END END AS band FROM o)
  SELECT conv_id, round(CASE WHEN outcome = 'DECIDED' THEN m END, 8)::DOUBLE AS score, band, CASE WHEN band IS NULL THEN 'none' WHEN band = 'LOW' THEN 'log_only' WHEN band = 'MEDIUM' THEN 'challenge_mfa' ELSE 'escalate_to_analyst' END AS action, outcome FROM b""")
def clip_decisions(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    w = c.select("conv_id", F.when(F.col("role") == "assistant", (F.length("text") % 100) / 99.0).alias("score"), F.lit(0.5).alias("seconds"))
    return _round(P.decide(w, "conv_id", "score", "seconds", "m1"), "score", digits=8)
