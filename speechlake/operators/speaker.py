"""Speaker trials, enrolment and verification from embeddings."""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from speechlake.functions.ranking import running_sum
from speechlake.functions.vectors import cosine, dot, normalized
from speechlake.sources.shared import written


def trial_id(a: Column, b: Column) -> Column:
    return F.substring(F.sha2(F.concat_ws("|", a, b), 256), 1, 16)


def _ring_pairs(first: DataFrame, seed: str, wanted: int) -> DataFrame:
    """(speaker_a, enrol, speaker_b, test): at least `wanted` pairs of two speakers, or all there are, each once, speaker_a the smaller."""
    n = first.count()
    steps = min(n // 2, -(-wanted // n)) if n else 0  # n // 2 steps each way reach every other speaker
    h = F.sha2(F.concat_ws("|", F.lit(seed), "speaker_id"), 256)
    places = running_sum(first.select("speaker_id", "enrol", h.alias("_h")), [], F.substring("_h", 1, 3), [F.col("_h")], F.lit(1), "_place")
    places = written(places.select("speaker_id", "enrol", F.col("_place").cast("long").alias("_place")), "places")
    ahead = places.select(F.col("speaker_id").alias("_a"), F.col("enrol").alias("_e"), F.explode(F.sequence(F.lit(1), F.lit(steps))).alias("_step"), "_place") if steps else None
    if ahead is None:
        return places.limit(0).select(F.col("speaker_id").alias("speaker_a"), "enrol", F.col("speaker_id").alias("speaker_b"), F.col("enrol").alias("test"))
    ahead = ahead.where((2 * F.col("_step") < n) | (F.col("_place") < F.col("_step")))  # half way round, each pair once
    met = ahead.withColumn("_place", (F.col("_place") + F.col("_step")) % n).join(places, "_place")
    ordered = F.array_sort(F.array(F.struct(F.col("_a").alias("s"), F.col("_e").alias("r")), F.struct(F.col("speaker_id").alias("s"), F.col("enrol").alias("r"))))
    pair = met.select(ordered.alias("p"))
    side = lambda i, c: F.col("p")[i][c]
    return pair.select(side(0, "s").alias("speaker_a"), side(0, "r").alias("enrol"), side(1, "s").alias("speaker_b"), side(1, "r").alias("test"))


def build_trials(recordings: DataFrame, seed: str = "0", cap: int | None = None) -> DataFrame:
    """(trial_id, enrol, test, speaker_a, speaker_b, label, cross_session) from (recording_id, speaker_id, session).

    Genuine: one pair per speaker, across sessions where there is one, of two recordings; a speaker's
    recordings are ordered by hash and the first is paired with the first of another session, so no
    speaker is joined with itself. Impostors: each two speakers by their first recordings; that join runs
    over one row per speaker. cap halves the trials between the classes by hash. Where each two speakers
    would make more impostors than half the cap, the pairs are sampled before they are joined: speakers
    stand in a ring by hash, and each meets the next few, as many as half the cap needs, by an equi-join
    on places. So capped trials grow with speakers and the cap, never with the square of the speakers.
    """
    key = F.sha2(F.concat_ws("|", F.lit(seed), "recording_id"), 256)
    rows = recordings.where(F.col("speaker_id").isNotNull()).withColumn("_h", key)
    first = rows.groupBy("speaker_id").agg(F.min(F.struct("_h", "recording_id", "session")).alias("f")).select("speaker_id", F.col("f.recording_id").alias("enrol"), F.col("f.session").alias("_s"))
    others = rows.join(first, "speaker_id").where(F.col("recording_id") != F.col("enrol"))
    cross = ~F.col("session").eqNullSafe(F.col("_s"))
    genuine = others.groupBy("speaker_id", "enrol").agg(F.min(F.struct((~cross).alias("same"), "_h", "recording_id")).alias("t"))
    genuine = genuine.select("enrol", F.col("t.recording_id").alias("test"), F.col("speaker_id").alias("speaker_a"), F.col("speaker_id").alias("speaker_b"), F.lit(1).alias("label"), (~F.col("t.same")).alias("cross_session"))
    if cap is None:
        other = first.select(F.col("speaker_id").alias("speaker_b"), F.col("enrol").alias("test"))
        impostor = first.select(F.col("speaker_id").alias("speaker_a"), "enrol").join(other, F.col("speaker_a") < F.col("speaker_b"))
    else:
        impostor = _ring_pairs(written(first, "speakers"), seed, cap // 2)
    impostor = impostor.select("enrol", "test", "speaker_a", "speaker_b", F.lit(0).alias("label"), F.lit(True).alias("cross_session"))
    out = genuine.unionByName(impostor).withColumn("trial_id", trial_id(F.col("enrol"), F.col("test")))
    if cap is not None:
        parts = [out.where(F.col("label") == y).orderBy("trial_id").limit(cap // 2) for y in (1, 0)]
        out = parts[0].unionByName(parts[1])
    return out


def trial_problems(trials: DataFrame) -> DataFrame:
    """(rule, broken): self-pairs, labels that contradict the speakers, recordings with two speakers, speakers in dev and test. Needs split."""
    sides = trials.select(F.col("enrol").alias("r"), F.col("speaker_a").alias("s"), "split").unionByName(trials.select(F.col("test").alias("r"), F.col("speaker_b").alias("s"), "split"))
    one = trials.agg(F.count_if(F.col("enrol") == F.col("test")).alias("self_pair"), F.count_if((F.col("label") == 1) != (F.col("speaker_a") == F.col("speaker_b"))).alias("wrong_label"))
    two = sides.groupBy("r").agg(F.countDistinct("s").alias("n")).agg(F.count_if(F.col("n") > 1).alias("two_speakers"))
    shared = sides.groupBy("s").agg(F.countDistinct("split").alias("n")).agg(F.count_if(F.col("n") > 1).alias("shared_speaker"))
    all_rules = one.crossJoin(F.broadcast(two)).crossJoin(F.broadcast(shared))  # one row each
    names = ("self_pair", "wrong_label", "two_speakers", "shared_speaker")
    return all_rules.select(F.explode(F.array(*[F.struct(F.lit(n).alias("rule"), F.col(n).alias("broken")) for n in names])).alias("r")).select("r.*")


def score_trials(trials: DataFrame, embeddings: DataFrame, recording: str, vector: str) -> DataFrame:
    """Trials with score, the cosine of both sides' embeddings; a trial with a missing or invalid side goes.

    The embeddings are read once, for those of the trials' recordings; trials and these are stored.
    """
    trials = written(trials, "trials")
    sides = trials.select(F.col("enrol").alias("_r")).unionByName(trials.select(F.col("test").alias("_r"))).distinct()
    wanted = embeddings.select(F.col(recording).alias("_r"), F.col(vector).alias("_e")).join(written(sides, "sides"), "_r", "left_semi")
    wanted = written(wanted, "vectors")  # else the test of their length goes below the join, to every vector
    unit = wanted.select("_r", normalized(F.col("_e")).alias("_v")).where("_v is not null")
    a = unit.select(F.col("_r").alias("enrol"), F.col("_v").alias("_a"))
    b = unit.select(F.col("_r").alias("test"), F.col("_v").alias("_b"))
    return trials.join(a, "enrol").join(b, "test").withColumn("score", F.least(F.lit(1.0), F.greatest(F.lit(-1.0), dot(F.col("_a"), F.col("_b"))))).drop("_a", "_b")


def _near_pairs(good: DataFrame, same: float, coordinates: int = 4) -> DataFrame:
    """(_p, a, b): samples a < b of one profile whose unit vectors have an inner product of `same` at least.

    No coordinate of such vectors differs by more than their distance, so the cell of the one is among
    the cells around the other.
    """
    reach = (2 * max(0.0, 1 - same)) ** 0.5 + 1e-6
    cell = lambda i, by: F.floor((F.coalesce(F.get("_v", F.lit(i)), F.lit(0.0)) + by) / (4 * reach))
    left = good.select("_p", F.col("_s").alias("a"), F.col("_v").alias("va"), *[cell(i, 0.0).alias(f"_c{i}") for i in range(coordinates)])
    right = good.select("_p", F.col("_s").alias("b"), F.col("_v").alias("vb"), F.col("_v"))
    for i in range(coordinates):
        right = right.withColumn(f"_c{i}", F.explode(F.array_distinct(F.array(cell(i, -reach), cell(i, reach)))))
    met = left.join(right.drop("_v"), ["_p", *[f"_c{i}" for i in range(coordinates)]])
    return met.where((F.col("a") < F.col("b")) & (dot(F.col("va"), F.col("vb")) >= same)).select("_p", "a", "b")


def _near_accepted(pairs: DataFrame) -> DataFrame:
    """(_p, _s): the later samples of pairs whose earlier one is taken, in the order of samples.

    In each round those samples are taken that are no later end of a pair; what they refuse goes, with its pairs.
    """
    lost = pairs.select("_p", F.col("b").alias("_s")).limit(0)
    while not pairs.isEmpty():
        waiting = pairs.select("_p", F.col("b").alias("a")).distinct()
        gone = written(pairs.join(waiting, ["_p", "a"], "left_anti").select("_p", F.col("b").alias("_s")).distinct(), "refused")
        lost = lost.unionByName(gone)
        for end in ("a", "b"):
            pairs = pairs.join(gone.withColumnRenamed("_s", end), ["_p", end], "left_anti")
        pairs = written(pairs, "near")
    return lost


def accepted_samples(samples: DataFrame, profile: str, sample: str, vector: str, same: float = 0.99999, size: int | None = None) -> DataFrame:
    """Samples with outcome: accepted, invalid, duplicate (equal numbers) or near_duplicate (of an accepted one of its profile).

    In the order of sample ids a vector is taken unless its inner product with one taken before reaches
    `same`. Vectors as near as that meet in joins on coarse coordinates; only such pairs are put in order.
    """
    rows = samples.withColumn("_v", normalized(F.col(vector), size))
    exact = W.partitionBy(profile, F.sha2(F.to_json(F.struct(vector)), 256)).orderBy(sample)
    rows = rows.withColumn("_first", F.row_number().over(exact) == 1)
    good = rows.where(F.col("_v").isNotNull() & F.col("_first"))
    good = written(good.select(F.col(profile).alias("_p"), F.col(sample).alias("_s"), "_v"), "enrolled")
    lost = _near_accepted(written(_near_pairs(good, same), "near"))
    ids = good.join(lost, ["_p", "_s"], "left_anti").select(F.col("_p").alias(profile), F.col("_s").alias("_taken"))
    out = rows.join(ids, (rows[profile] == ids[profile]) & (rows[sample] == ids["_taken"]), "left").drop(ids[profile])
    outcome = F.when(F.col("_v").isNull(), "invalid").when(~F.col("_first"), "duplicate").when(F.col("_taken").isNull(), "near_duplicate").otherwise("accepted")
    return out.select(*samples.columns, "_v", outcome.alias("outcome"))


def centroids(accepted: DataFrame, profile: str, least: int = 1) -> DataFrame:
    """(profile, centroid, samples): the mean of unit vectors at length 1, added up per dimension."""
    rows = accepted.where("outcome = 'accepted'")
    n = rows.groupBy(profile).agg(F.count(F.lit(1)).alias("samples"))
    dims = rows.select(profile, F.posexplode("_v").alias("d", "x")).groupBy(profile, "d").agg(F.avg("x").alias("x"))
    mean = dims.groupBy(profile).agg(F.transform(F.array_sort(F.collect_list(F.struct("d", "x"))), lambda s: s["x"]).alias("m"))
    return mean.join(n, profile).where(F.col("samples") >= least).select(profile, normalized(F.col("m")).alias("centroid"), "samples")


def enroll(samples: DataFrame, profile: str, sample: str, vector: str, measures: Sequence[str] = ("duration_s",), size: int | None = None, least: int = 1) -> tuple[DataFrame, DataFrame]:
    """(profiles, outcomes) of samples with authorized, consent (a reference) and accepted (the quality gate's verdict).

    Outcomes, a row a sample: consent_required where the sample's profile lacks an authorization, or a consent reference that is
    not blank, in any of its rows; quality where the gate refused the sample; then those of accepted_samples,
    which the others never take the place of. Profiles, a row for each with `least` accepted samples: centroid, samples, consent,
    and the mean of each measure over the accepted ones. A null profile is none and needs consent.
    """
    sound = F.coalesce(F.col("authorized"), F.lit(False)) & (F.trim(F.coalesce("consent", F.lit(""))) != "")
    allowed = samples.groupBy(F.col(profile).alias("_p")).agg(F.bool_and(sound).alias("_sound"), F.min("consent").alias("_consent")).where("_p is not null and _sound")
    rows = written(samples.join(allowed, F.col(profile) == F.col("_p"), "left"), "samples")
    gate = F.when(F.col("_p").isNull(), "consent_required").when(~F.coalesce("accepted", F.lit(False)), "quality")
    rows = rows.withColumn("outcome", gate)
    good = written(accepted_samples(rows.where("outcome is null").drop("outcome"), profile, sample, vector, size=size), "outcomes")
    out = rows.where("outcome is not null").select(profile, sample, "outcome").unionByName(good.select(profile, sample, "outcome"))
    summary = good.where("outcome = 'accepted'").groupBy(profile).agg(F.min("_consent").alias("consent"), *[F.avg(m).alias(f"mean_{m}") for m in measures])
    return centroids(good, profile, least).join(summary, profile), out


def verification_events(verified: DataFrame, probe: str, profiles: DataFrame, threshold: float, policy: str, at: Column) -> DataFrame:
    """What is kept of each verification: ids, decision, score, threshold, policy and the profile's version, but no vector."""
    known = profiles.select("profile_id", F.col("version").alias("profile_version"))
    event = F.substring(F.sha2(F.concat_ws("|", F.col(probe).cast("string"), F.col("profile_id").cast("string"), at.cast("string")), 256), 1, 32)
    rows = verified.join(known, "profile_id", "left")
    return rows.select(event.alias("verification_id"), probe, "profile_id", "decision", "score", F.lit(threshold).alias("threshold"), F.lit(policy).alias("policy"), "profile_version", at.alias("created_at"))


def verify(probes: DataFrame, profiles: DataFrame, vector: str, now: Column, threshold: float = 0.75) -> DataFrame:
    """Probes with score and decision against the profile that each one names, never against others.

    In order: unknown_profile, inactive, expired, incompatible (another size), inconclusive (no valid
    vector), MATCH from the threshold on, NON_MATCH.
    """
    rows = probes.join(profiles.select("profile_id", "centroid", "active", "expires_at"), "profile_id", "left")
    score = cosine(F.col(vector), F.col("centroid"))
    decision = (
        F.when(F.col("centroid").isNull(), "unknown_profile").when(~F.col("active"), "inactive").when(F.col("expires_at") <= now, "expired")
        .when(F.size(vector) != F.size("centroid"), "incompatible").when(score.isNull() | F.isnan(score), "inconclusive").when(score >= threshold, "MATCH").otherwise("NON_MATCH")
    )
    scored = F.when(F.size(vector) == F.size("centroid"), score)
    return rows.select(*probes.columns, scored.alias("score"), decision.alias("decision")).withColumn("score", F.when(F.col("decision").isin("MATCH", "NON_MATCH"), F.col("score")))


def sample_quality(samples: DataFrame, checks: Sequence[tuple[str, Column]]) -> DataFrame:
    """Add reasons (all checks that hold, in order) and accepted."""
    reasons = F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in checks]))
    return samples.withColumn("reasons", F.array_join(reasons, ",")).withColumn("accepted", F.size(reasons) == 0)
