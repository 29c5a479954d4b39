"""Time-series operators over sample and frame tables."""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from speechlake.functions.islands import merged_intervals, with_previous, with_runs
from speechlake.functions.quantiles import exact_quantiles
from speechlake.functions.ranking import running_sum
from speechlake.functions.records import all_reasons, dbfs
from speechlake.sources.shared import written


def frames(samples: DataFrame, signal: str, idx: str, value: str, size: int, hop: int) -> DataFrame:
    """(signal, frame, n, rms, energy_db, zcr) of complete frames of `size` samples every `hop`.

    idx counts each signal's samples from 0. A sample lies in at most size / hop frames; samples are
    exploded to those and added up. A long signal is spread over tasks by frame, and by ranges where a sample
    is held against the one before.
    """
    before = with_previous(samples, [signal], idx, value, "_p")
    crossed = (F.signum(value) != F.signum("_p")) & F.col("_p").isNotNull()
    first = F.greatest(F.lit(0), F.ceil((F.col(idx) - size + 1) / hop))
    rows = before.withColumn("_x", crossed).withColumn("frame", F.explode(F.sequence(first.cast("long"), F.floor(F.col(idx) / hop).cast("long"))))
    inner = F.col("_x") & (F.col(idx) != F.col("frame") * hop)
    out = rows.groupBy(signal, "frame").agg(F.count(F.lit(1)).alias("n"), F.sqrt(F.avg(F.col(value) * F.col(value))).alias("rms"), F.count_if(inner).alias("_z"))
    return out.where(F.col("n") == size).select(signal, "frame", "n", "rms", dbfs(F.col("rms")).alias("energy_db"), (F.col("_z") / (size - 1)).alias("zcr"))


def speech_mask(frames: DataFrame, signal: str, floor_db: float = -60.0, below_db: float = 40.0, max_zcr: float = 1.0) -> DataFrame:
    """Add threshold_db and speech. The loudest frames (90th percentile less 6 dB) set a reference, their 20th percentile.

    Two exact quantiles per signal, by running counts; a frame is speech at or above max(floor, reference - below) and with few sign changes.
    """
    frames = written(frames, "frames")
    seed = exact_quantiles(frames, [signal], "energy_db", [0.9]).select(signal, (F.col("q")[0] - 6).alias("_seed"))
    loud = frames.select(signal, "energy_db").join(seed, signal).where(F.col("energy_db") >= F.col("_seed"))
    low = exact_quantiles(loud, [signal], "energy_db", [0.2]).select(signal, F.col("q")[0].alias("_q"))
    most = frames.groupBy(signal).agg(F.max("energy_db").alias("_most"))
    reference = most.join(low, signal, "left").select(signal, F.coalesce("_q", "_most").alias("_ref"))
    out = frames.join(reference, signal)
    threshold = F.greatest(F.lit(floor_db), F.col("_ref") - below_db)
    return out.withColumn("threshold_db", threshold).withColumn("speech", (F.col("energy_db") >= F.col("threshold_db")) & (F.col("zcr") <= max_zcr)).drop("_ref")


def clean_mask(frames: DataFrame, signal: str, order: str, flag: str, least_run: int, largest_gap: int) -> DataFrame:
    """Drop true runs shorter than least_run, then fill inner false runs of largest_gap or less; flag is replaced."""
    runs = with_runs(frames, [signal], order, flag)
    kept = runs.withColumn(flag, F.col(flag) & (F.col("run_length") >= least_run)).select(*frames.columns)
    runs = with_runs(kept, [signal], order, flag)
    inner = ~F.col("first_run") & ~F.col("last_run")
    return runs.withColumn(flag, F.col(flag) | (inner & (F.col("run_length") <= largest_gap))).select(*frames.columns)


def regions(frames: DataFrame, signal: str, order: str, flag: str, frame_s: float, pad_s: float, gap_s: float, least_s: float) -> DataFrame:
    """(signal, start_s, end_s): speech runs, padded, merged over gaps, short ones dropped, kept within the signal."""
    runs = with_runs(frames, [signal], order, flag)
    length = frames.groupBy(signal).agg(((F.max(order) + 1) * frame_s).alias("_end"))
    spans = runs.where(flag).groupBy(signal, "run").agg((F.min(order) * frame_s - pad_s).alias("start_s"), ((F.max(order) + 1) * frame_s + pad_s).alias("end_s"))
    merged = merged_intervals(spans, [signal], "start_s", "end_s", gap_s).join(length, signal)
    out = merged.select(signal, F.greatest("start_s", F.lit(0.0)).alias("start_s"), F.least("end_s", "_end").alias("end_s"))
    return out.where(F.col("end_s") - F.col("start_s") >= least_s)


def segments(frames: DataFrame, signal: str, order: str, flag: str, window: int, hop: int, least_coverage: float = 0.25, pad_short: bool = True) -> DataFrame:
    """(signal, segment, start, stop, speech, coverage): windows of frames every hop and one anchored at the end.

    Frames count from 0 without gaps. Speech in a window is the difference of two running counts, which come from
    ranges of frames. A signal shorter than a window gives one padded window (or none); a window of too little speech is
    dropped. As starts and stops both rise, none lies inside its predecessor.
    """
    frames = written(frames.select(signal, order, flag), "frames")
    width = 4096
    counts = running_sum(frames, [signal], F.floor(F.col(order) / width), [F.col(order)], F.col(flag).cast("long"), "_before")
    counts = written(counts.select(signal, (F.col(order) + 1).alias("at"), (F.col("_before") + F.coalesce(F.col(flag).cast("long"), F.lit(0))).alias("cum")), "counts")
    n = frames.groupBy(signal).agg((F.max(order) + 1).alias("n")).withColumn("last", F.col("n") - window)
    # windows begin at frames, so that they come from many rows, and at the last place where one fits
    regular = frames.where(F.col(order) % hop == 0).select(signal, F.col(order).cast("long").alias("start")).join(n, signal).where("start <= last")
    tail = n.where(F.col("last") % hop != 0).where("last >= 0").select(signal, F.col("last").cast("long").alias("start"), "n", "last")
    rows = regular.unionByName(tail)
    if pad_short:
        rows = rows.unionByName(n.where("last < 0").select(signal, F.lit(0).cast("long").alias("start"), "n", "last"))
    rows = rows.select(signal, "n", "start", F.least(F.col("start") + window, "n").alias("stop"))
    low = counts.select(F.col(signal).alias("_a"), F.col("at").alias("_b"), F.col("cum").alias("_low"))
    high = counts.select(F.col(signal).alias("_c"), F.col("at").alias("_d"), F.col("cum").alias("_high"))
    met = rows.join(low, (F.col(signal) == F.col("_a")) & (F.col("start") == F.col("_b")), "left").join(high, (F.col(signal) == F.col("_c")) & (F.col("stop") == F.col("_d")), "left")
    speech = F.coalesce("_high", F.lit(0)) - F.coalesce("_low", F.lit(0))
    out = met.select(signal, "start", "stop", speech.alias("speech"), (speech / window).alias("coverage"))
    out = written(out.where(F.col("coverage") >= least_coverage), "segments")
    return running_sum(out, [signal], F.floor(F.col("start") / width), [F.col("start")], F.lit(1), "segment").withColumn("segment", F.col("segment").cast("int"))


def sample_records(segments: DataFrame, sources: DataFrame, signal: str, frame_s: float, window: int) -> DataFrame:
    """A record for each segment: sample_id (<source>#0007), parent_id, start_s, end_s, speech_s, coverage, padded, content_hash, and what its source has.

    sources: signal, file_hash and any metadata, the split among it, one row a signal; all columns but file_hash are
    inherited. The content is told by the source's content and the place. Segments of a signal without a source are left out.
    """
    met = segments.join(sources, signal)
    place = [F.format_string("%d", F.col(c).cast("long")) for c in ("start", "stop")]
    kept = [c for c in sources.columns if c not in (signal, "file_hash")]
    return met.select(
        F.format_string("%s#%04d", F.col(signal).cast("string"), "segment").alias("sample_id"), F.col(signal).cast("string").alias("parent_id"), (F.col("start") * frame_s).alias("start_s"), (F.col("stop") * frame_s).alias("end_s"),
        (F.col("speech") * frame_s).alias("speech_s"), "coverage", (F.col("stop") - F.col("start") < window).alias("padded"), F.sha2(F.concat_ws("|", "file_hash", *place), 256).alias("content_hash"), *kept,
    )


def quality(samples: DataFrame, signal: str, value: str, frames: DataFrame, clip: float = 0.99, silence_db: float = -60.0) -> DataFrame:
    """(signal, peak, rms, crest, dc, clipped, silence, snr_db, issues, usable): one pass over samples, one over frames."""
    v = F.col(value)
    bad = v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))
    good = F.when(~bad, v)
    a = samples.groupBy(signal).agg(
        F.max(F.abs(good)).alias("peak"), F.sqrt(F.avg(good * good)).alias("rms"), F.avg(good).alias("dc"),
        (F.count_if(F.abs(v) >= clip) / F.count(F.lit(1))).alias("clipped"), (F.count_if(bad) / F.count(F.lit(1))).alias("not_finite"),
    )
    loud = F.when(F.col("energy_db") > silence_db, F.col("energy_db"))
    b = frames.groupBy(signal).agg((F.count_if(F.col("energy_db") <= silence_db) / F.count(F.lit(1))).alias("silence"), F.count(loud).alias("_n"), (F.percentile(loud, 0.95) - F.percentile(loud, 0.1)).alias("_snr"))
    out = a.join(b, signal, "left")
    out = out.withColumns({"crest": F.try_divide("peak", "rms"), "snr_db": F.when((F.col("_n") >= 3) & (F.col("_snr") >= 3), F.col("_snr"))})
    checks = (("silent", F.coalesce(F.col("peak"), F.lit(0.0)) < 1e-4), ("not_finite", F.col("not_finite") > 0), ("clipped", F.col("clipped") > 0.01), ("dc_offset", F.abs("dc") > 0.05), ("mostly_silent", F.col("silence") > 0.9), ("low_snr", F.col("snr_db") < 10))
    usable = ~(F.coalesce(F.col("peak"), F.lit(0.0)) < 1e-4) & (F.col("not_finite") == 0)
    return out.withColumns({"issues": all_reasons(*checks), "usable": usable}).select(signal, "peak", "rms", "crest", "dc", "clipped", "silence", "snr_db", "issues", "usable")


def normalized(samples: DataFrame, signal: str, value: str, target_db: float = -20.0, most_gain_db: float = 20.0, ceiling: float = 0.99, mode: str = "rms") -> DataFrame:
    """Add gain_db and normalized: each signal without its mean, brought to a level.

    The gain is limited either way, silence gets none, and a gain that would exceed the ceiling is lowered rather than clipped.
    """
    mean = samples.groupBy(signal).agg(F.avg(value).alias("_dc"))
    rows = samples.join(mean, signal).withColumn("_v", F.col(value) - F.col("_dc"))
    level = rows.groupBy(signal).agg(F.sqrt(F.avg(F.col("_v") * F.col("_v"))).alias("_rms"), F.max(F.abs("_v")).alias("_peak"))
    base = F.col("_rms") if mode == "rms" else F.col("_peak")
    wanted = F.greatest(F.lit(-most_gain_db), F.least(F.lit(most_gain_db), target_db - dbfs(base)))
    gain = F.when((base < 1e-6) | (F.lit(mode) == "none"), 0.0).otherwise(F.least(wanted, dbfs(F.lit(ceiling)) - dbfs(F.col("_peak"))))
    return rows.join(level.select(signal, gain.alias("gain_db")), signal).withColumn("normalized", F.col("_v") * F.pow(F.lit(10.0), F.col("gain_db") / 20)).drop("_dc", "_v")


def standardized(values: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Add cmvn: value less its mean, by its population deviation, per keys; 0 where the deviation is 0."""
    s = values.groupBy(*keys).agg(F.avg(value).alias("_m"), F.stddev_pop(value).alias("_s"))
    return values.join(s, list(keys)).withColumn("cmvn", F.coalesce(F.try_divide(F.col(value) - F.col("_m"), F.col("_s")), F.lit(0.0))).drop("_m", "_s")


def deltas(series: DataFrame, keys: Sequence[str], order: str, value: str, reach: int = 2) -> DataFrame:
    """Add delta: the least-squares slope over the frames within `reach`, fewer at the ends; 0 for a single frame."""
    w = W.partitionBy(*keys).orderBy(order).rowsBetween(-reach, reach)
    return series.withColumn("delta", F.coalesce(F.regr_slope(F.col(value), F.col(order).cast("double")).over(w), F.lit(0.0)))


def pooled(series: DataFrame, keys: Sequence[str], order: str, value: str, size: int) -> DataFrame:
    """(keys, mean, sd) over exactly `size` frames: longer series are cut, shorter ones repeat their last frame."""
    rows = series.where(F.col(order) < size)
    ends = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.max_by(value, order).alias("last"))
    sums = rows.groupBy(*keys).agg(F.sum(value).alias("s")).join(ends, list(keys))
    mean = ((F.col("s") + (size - F.col("n")) * F.col("last")) / size).alias("mean")
    means = sums.select(*keys, "n", "last", mean)
    spread = rows.join(means, list(keys)).groupBy(*keys, "n", "last", "mean").agg(F.sum(F.pow(F.col(value) - F.col("mean"), 2)).alias("q"))
    return spread.select(*keys, "mean", F.sqrt((F.col("q") + (size - F.col("n")) * F.pow(F.col("last") - F.col("mean"), 2)) / size).alias("sd"))


def abstention(frames: DataFrame, signal: str, order: str, flag: str, frame_s: float, least_total: float = 1.0, least_run: float = 0.3, least_clip: float = 1.0) -> DataFrame:
    """(signal, speech_s, longest_s, reason): why a clip gets no decision, the first of too short, too little speech, no long enough run; null if it does."""
    runs = with_runs(frames, [signal], order, flag)
    t = runs.groupBy(signal).agg((F.count(F.lit(1)) * frame_s).alias("_clip"), (F.count_if(F.col(flag)) * frame_s).alias("speech_s"), (F.coalesce(F.max(F.when(F.col(flag), F.col("run_length"))), F.lit(0)) * frame_s).alias("longest_s"))
    reason = F.when(F.col("_clip") < least_clip, "short_clip").when(F.col("speech_s") < least_total, "insufficient_speech").when(F.col("longest_s") < least_run, "no_contiguous_speech")
    return t.select(signal, "speech_s", "longest_s", reason.alias("reason"))


PROSODY = ("pitch_median_hz", "pitch_std_hz", "pitch_range_hz", "energy_median_db", "energy_std_db", "energy_range_db", "speech_ratio", "pause_count", "pause_median_s", "segment_count")


def prosody(frames: DataFrame, signal: str, order: str, speech: str = "speech", pitch: str = "pitch_hz", energy: str = "energy_db", frame_s: float = 0.02, enabled: Sequence[str] = PROSODY, least_voiced: int = 3) -> DataFrame:
    """(signal, feature, value, valid, reason) long, from frames with pitch (null where unvoiced), energy and speech."""
    voiced, loud = F.count(pitch), F.when(F.col(speech), F.col(energy))
    q = lambda c, p: F.percentile(c, p)
    base = frames.groupBy(signal).agg(
        voiced.alias("_voiced"), q(F.col(pitch), 0.5).alias("pitch_median_hz"), F.stddev_pop(pitch).alias("pitch_std_hz"), (F.max(pitch) - F.min(pitch)).alias("pitch_range_hz"),
        q(loud, 0.5).alias("energy_median_db"), F.stddev_pop(loud).alias("energy_std_db"), (q(loud, 0.9) - q(loud, 0.1)).alias("energy_range_db"), (F.count_if(F.col(speech)) / F.count(F.lit(1))).alias("speech_ratio"),
    )
    runs = with_runs(frames, [signal], order, speech).groupBy(signal, "run", speech, "first_run", "last_run").agg((F.count(F.lit(1)) * frame_s).alias("s"))
    pause = ~F.col(speech) & ~F.col("first_run") & ~F.col("last_run")
    gaps = runs.groupBy(signal).agg(F.count_if(pause).cast("double").alias("pause_count"), F.percentile(F.when(pause, F.col("s")), 0.5).alias("pause_median_s"), F.count_if(F.col(speech)).cast("double").alias("segment_count"))
    wide = base.join(gaps, signal)
    valid = {f: (F.col("_voiced") >= least_voiced) if f.startswith("pitch") else F.col(f).isNotNull() for f in enabled}
    items = F.array(*[F.struct(F.lit(f).alias("feature"), F.when(valid[f], F.col(f)).alias("value"), F.coalesce(valid[f], F.lit(False)).alias("valid")) for f in enabled])
    long = wide.select(signal, F.explode(items).alias("f")).select(signal, "f.feature", "f.value", "f.valid")
    return long.withColumn("reason", F.when(~F.col("valid"), F.when(F.col("feature").startswith("pitch"), "too few voiced frames").otherwise("no measurement")))


def prosody_status(features: DataFrame, signal: str, least: int = 3) -> DataFrame:
    """(signal, valid_features, status, comparable): PASS if all are valid, WARN if enough are, else INCONCLUSIVE."""
    out = features.groupBy(signal).agg(F.count_if("valid").alias("valid_features"), F.count(F.lit(1)).alias("_n"))
    status = F.when(F.col("valid_features") == F.col("_n"), "PASS").when(F.col("valid_features") >= least, "WARN").otherwise("INCONCLUSIVE")
    return out.select(signal, "valid_features", status.alias("status"), (F.col("valid_features") >= least).alias("comparable"))


def unit(column: Column) -> Column:
    """The unit of a prosody feature's name."""
    return F.when(column.endswith("_hz"), "hz").when(column.endswith("_db"), "db").when(column.endswith("_s"), "s").when(column.endswith("_ratio"), "ratio").otherwise("count")
