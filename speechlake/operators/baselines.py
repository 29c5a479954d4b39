"""Per-speaker prosody baselines and deviations from them."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from speechlake.functions.quantiles import exact_quantiles
from speechlake.sources.shared import written


def enroll(features: DataFrame, speaker: str, sample: str, least_features: int = 3, least_samples: int = 3) -> DataFrame:
    """(speaker, feature, n, mean, sd, median, mad) from valid values of samples with enough of them.

    A speaker needs least_samples samples with least_features valid features each, a feature as many values.
    """
    valid = features.where(F.col("valid") & F.col("value").isNotNull())
    good = valid.groupBy(speaker, sample).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least_features)
    enough = good.groupBy(speaker).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least_samples).select(speaker)
    rows = valid.join(good.select(speaker, sample), [speaker, sample], "left_semi").join(enough, speaker, "left_semi")
    rows = written(rows.select(speaker, sample, "feature", "value"), "enrolled")
    base = rows.groupBy(speaker, "feature").agg(F.count("value").alias("n"), F.avg("value").alias("mean"), F.stddev_pop("value").alias("sd")).where(F.col("n") >= least_samples)
    middle = written(exact_quantiles(rows, [speaker, "feature"], "value", [0.5]).select(speaker, "feature", F.col("q")[0].alias("median")), "medians")
    off = rows.join(middle, [speaker, "feature"]).select(speaker, "feature", F.abs(F.col("value") - F.col("median")).alias("_off"))
    mad = exact_quantiles(off, [speaker, "feature"], "_off", [0.5]).select(speaker, "feature", F.col("q")[0].alias("mad"))
    return base.join(middle, [speaker, "feature"]).join(mad, [speaker, "feature"])


def compare(features: DataFrame, baselines: DataFrame, speaker: str, limit: float = 3.5, confident: int = 10) -> DataFrame:
    """Each valid feature beside its baseline: deviation in robust deviations, outside, and confidence; null deviation where there is no baseline."""
    rows = features.where("valid").join(baselines, [speaker, "feature"], "left")
    spread = F.greatest(F.col("sd"), 1.4826 * F.col("mad"), F.lit(1e-9))
    deviation = F.abs(F.col("value") - F.col("median")) / spread
    return rows.select(*features.columns, deviation.alias("deviation"), (deviation >= limit).alias("outside"), F.when(F.col("n") >= confident, "HIGH").when(F.col("n").isNotNull(), "LIMITED").alias("confidence"))


def summarize(compared: DataFrame, keys: list[str], least: int = 3) -> DataFrame:
    """(keys, compared, missing, outside, status, warnings): INCONCLUSIVE with too few features, else DEVIATES or CONSISTENT."""
    out = compared.groupBy(*keys).agg(F.count("deviation").alias("compared"), F.count_if(F.col("deviation").isNull()).alias("missing"), F.count_if("outside").alias("outside"), F.count_if(F.col("confidence") == "LIMITED").alias("_limited"))
    status = F.when(F.col("compared") < least, "INCONCLUSIVE").when(F.col("outside") > 0, "DEVIATES").otherwise("CONSISTENT")
    warnings = F.concat_ws(",", F.when(F.col("missing") > 0, "features_without_baseline"), F.when(F.col("_limited") > 0, "limited_baseline"), F.when(F.col("compared") < least, "too_few_features"))
    return out.select(*keys, "compared", "missing", "outside", status.alias("status"), warnings.alias("warnings"))


def compatible(baselines: DataFrame, schema_version: int, fingerprint: str) -> DataFrame:
    """Add compatible: active, of this schema version and extraction fingerprint."""
    return baselines.withColumn("compatible", F.col("active") & (F.col("schema_version") == schema_version) & (F.col("fingerprint") == fingerprint))


def latest(versions: DataFrame, key: str, version: str = "version") -> DataFrame:
    """The newest version of each key; a tombstone (deleted) removes the key."""
    newest = versions.groupBy(key).agg(F.max_by(F.struct(*versions.columns), version).alias("r")).select("r.*")
    return newest.where(~F.coalesce("deleted", F.lit(False)))


def version_problems(versions: DataFrame, key: str, version: str = "version") -> DataFrame:
    """(key, problem): versions that do not count 1, 2, 3, ... without a gap or repeat."""
    per = versions.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.countDistinct(version).alias("d"), F.min(version).alias("a"), F.max(version).alias("b"))
    return per.where((F.col("n") != F.col("d")) | (F.col("a") != 1) | (F.col("b") != F.col("n"))).select(key, F.when(F.col("n") != F.col("d"), "repeated version").otherwise("gap in versions").alias("problem"))
