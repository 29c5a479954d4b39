"""Inventory, deduplication, validation and integrity checks of a labelled corpus."""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from speechlake.functions.records import any_of, known
from speechlake.sources.shared import written

METADATA = ("speaker", "channel", "generator", "language", "device", "session")
AXES = ("parent_id", "speaker", "file_hash", "session", "generator", "language", "channel", "device")


def metadata_score(columns: Sequence[str] = METADATA) -> Column:
    """How many of the optional fields are known."""
    total = F.lit(0)
    for c in columns:
        total = total + known(F.col(c)).isNotNull().cast("int")
    return total


def mark_duplicates(records: DataFrame, content: str = "file_hash") -> DataFrame:
    """Add keeper, group_size and is_kept: of equal contents the best described record stays, then the least ids.

    Records without a hash are unreadable and never grouped. Keepers come from one pre-aggregated row per
    hash, so a hash with very many copies is no large group.
    """
    rank = F.struct((-metadata_score()).alias("s"), F.col("dataset_id").alias("d"), F.col("sample_id").alias("i"))
    best = records.where(F.col(content).isNotNull()).groupBy(F.col(content).alias("_h")).agg(F.min(rank)["i"].alias("keeper"), F.count(F.lit(1)).alias("group_size"))
    out = records.join(best, records[content] == best["_h"], "left").drop("_h")
    keeper = F.coalesce("keeper", "sample_id")
    return out.withColumns({"keeper": keeper, "group_size": F.coalesce("group_size", F.lit(1)), "is_kept": F.col("sample_id") == keeper})


def validate(records: DataFrame, required: Sequence[str] = ("speaker",), max_bytes: int = 20_000, least: float = 2.0, most: float = 60.0, least_ratio: float = 0.1, reject_warnings: bool = False) -> DataFrame:
    """Add code and reason: the first check that a record fails, in a fixed order; both null if it passes.

    Needs file_bytes, duration_s, speech_s and usable (boolean); with reject_warnings also warnings, an
    array of the names of quality issues, of which any one rejects the record.
    """
    missing = any_of(*[known(F.col(c)).isNull() for c in required])
    ratio = F.col("speech_s") / F.col("duration_s")
    number = lambda c: F.format_string("%.2f", c)
    checks = (
        ("missing_metadata", missing, F.lit("a required field is unknown")),
        ("file_too_large", F.col("file_bytes") > max_bytes, F.concat(F.col("file_bytes").cast("string"), F.lit(f" bytes, at most {max_bytes}"))),
        ("too_short", F.col("duration_s") < least, F.concat(number(F.col("duration_s")), F.lit(f" s, at least {least:.2f}"))),
        ("too_long", F.col("duration_s") > most, F.concat(number(F.col("duration_s")), F.lit(f" s, at most {most:.2f}"))),
        ("unusable_signal", ~F.col("usable"), F.lit("the signal cannot be used")),
        ("no_speech", ratio < least_ratio, F.concat(number(ratio), F.lit(f" speech, at least {least_ratio:.2f}"))),
    )
    if reject_warnings:
        checks += (("quality_warning", F.size("warnings") > 0, F.concat(F.lit("quality issues: "), F.array_join("warnings", ", "))),)
    fails = [(name, F.coalesce(c, F.lit(False)), text) for name, c, text in checks]
    code = F.coalesce(*[F.when(c, F.lit(name)) for name, c, _ in fails])
    reason = F.coalesce(*[F.when(c, text) for _, c, text in fails])
    return records.withColumns({"code": code, "reason": reason})


def dedup_accepted(validated: DataFrame, scope: str = "both") -> DataFrame:
    """Give accepted rows whose file (then content) an earlier accepted row has the code duplicate.

    Rows that were rejected never take the kept place. Equal files have equal contents, so the content
    pass runs among what the file pass left.
    """
    out = validated
    for key in {"file": ("file_hash",), "content": ("content_hash",), "both": ("file_hash", "content_hash")}[scope]:
        first = out.where(F.col("code").isNull() & F.col(key).isNotNull()).groupBy(F.col(key).alias("_k")).agg(F.min("sample_id").alias("_first"))
        out = out.join(first, out[key] == first["_k"], "left")
        lost = F.col("code").isNull() & (F.col("_first") < F.col("sample_id"))
        out = out.withColumns({"reason": F.when(lost, F.concat(F.lit("same as "), "_first")).otherwise(F.col("reason")), "code": F.when(lost, "duplicate").otherwise(F.col("code"))}).drop("_k", "_first")
    return out


def axis_values(samples: DataFrame, axes: Sequence[str] = AXES, keep: Sequence[str] = ("split",)) -> DataFrame:
    """Long form: keep, axis, value; unknown values are left out."""
    pairs = F.array(*[F.struct(F.lit(a).alias("axis"), known(F.col(a)).alias("value")) for a in axes])
    return samples.select(*keep, F.explode(pairs).alias("p")).select(*keep, "p.axis", "p.value").where(F.col("value").isNotNull())


def check_leakage(samples: DataFrame, axes: Sequence[str] = AXES, examples: int = 8) -> DataFrame:
    """One row per axis: known_values, leaks (values in more than one split), available and the first examples.

    Values are pre-aggregated per axis and split; an axis without any known value is not available. Only
    the first examples of an axis are collected.
    """
    spark = samples.sparkSession
    per = axis_values(samples, axes).groupBy("axis", "value", "split").agg(F.lit(1).alias("x")).groupBy("axis", "value").agg(F.count("x").alias("n"))
    per = written(per, "axis-values")
    found = per.groupBy("axis").agg(F.count(F.lit(1)).alias("known_values"), F.count_if(F.col("n") > 1).alias("leaks"))
    first = capped(per.where((F.col("n") > 1) & (F.col("axis") != "file_hash")), "axis", "value", examples)
    shown = first.groupBy("axis").agg(F.array_join(F.array_sort(F.collect_list("value")), ",").alias("examples"))
    names = spark.createDataFrame([(a,) for a in axes], "axis string")
    out = names.join(found, "axis", "left").join(shown, "axis", "left")
    return out.select("axis", F.coalesce("known_values", F.lit(0)).alias("known_values"), F.coalesce("leaks", F.lit(0)).alias("leaks"), F.col("known_values").isNotNull().alias("available"), F.coalesce("examples", F.lit("")).alias("examples"))


def leakage_failures(samples: DataFrame, required: Sequence[str], fail_on_unavailable: bool = True) -> DataFrame:
    """The required axes that leak, or that cannot be checked."""
    bad = (F.col("leaks") > 0) | (F.lit(fail_on_unavailable) & ~F.col("available"))
    return check_leakage(samples, axes=required).where(bad).select("axis", F.when(F.col("leaks") > 0, "leak").otherwise("unavailable").alias("problem"))


def boundaries(samples: DataFrame, source: str = "parent_id") -> DataFrame:
    """(boundary, shared): the sources that train or dev share with test, by the splits that each source has."""
    per = samples.groupBy(source).agg(*[F.bool_or(F.col("split") == s).alias(s) for s in ("train", "dev", "test")])
    counts = per.agg(*[F.count_if(F.col(a) & F.col("test")).alias(a) for a in ("train", "dev")])
    return counts.select(F.explode(F.array(*[F.struct(F.lit(f"{a}->test").alias("boundary"), F.col(a).alias("shared")) for a in ("train", "dev")])).alias("b")).select("b.*")


def gate_report(samples: DataFrame, required: Sequence[str], axes: Sequence[str] = AXES, fail_on_unavailable: bool = False, least_test_sources: int = 1, source: str = "parent_id") -> DataFrame:
    """(kind, subject, detail): every failure and warning of a split corpus, and one row of kind gate, which says passed or failed.

    Failures are required axes that leak (or are unavailable, with fail_on_unavailable), sources shared with
    test, fewer sources in test than the least, and rows whose split is none of the three. Warnings are optional axes that leak
    and required ones that are unavailable where that does not fail. An empty table fails by its test sources.
    """
    needed, leak, absent = F.col("axis").isin(*required), F.col("leaks") > 0, ~F.col("available")
    unavailable = "failure" if fail_on_unavailable else "warning"
    kind = F.when(leak, F.when(needed, "failure").otherwise("warning")).when(needed & absent, unavailable)
    detail = F.when(leak, F.concat("leaks", F.lit(" values in more than one split"))).otherwise("no known values")
    asked = list(axes) + [a for a in required if a not in axes]
    by_axis = check_leakage(samples, asked).select(kind.alias("kind"), F.col("axis").alias("subject"), detail.alias("detail")).where("kind is not null")
    shared = boundaries(samples, source).where("shared > 0")
    shared = shared.select(F.lit("failure").alias("kind"), F.col("boundary").alias("subject"), F.concat("shared", F.lit(" sources on both sides")).alias("detail"))
    in_test = samples.where("split = 'test'").select(source).distinct().agg(F.count(F.lit(1)).alias("n")).where(F.col("n") < least_test_sources)
    in_test = in_test.select(F.lit("failure"), F.lit("test_sources"), F.concat("n", F.lit(f" sources, at least {least_test_sources}")))
    stray = samples.where(~F.coalesce(F.col("split").isin("train", "dev", "test"), F.lit(False))).agg(F.count(F.lit(1)).alias("n")).where("n > 0")
    stray = stray.select(F.lit("failure"), F.lit("split"), F.concat("n", F.lit(" rows outside train, dev and test")))
    found = written(by_axis.union(shared).union(in_test).union(stray), "gate")
    final = found.agg(F.count_if(F.col("kind") == "failure").alias("n"))
    return found.union(final.select(F.lit("gate"), F.when(F.col("n") == 0, "passed").otherwise("failed"), F.concat("n", F.lit(" failures"))))


def assert_gates(report: DataFrame) -> None:
    """Raise ValueError naming the failures of a gate_report, of which there is one per axis or boundary at most."""
    failed = [f"{r.subject}: {r.detail}" for r in report.where("kind = 'failure'").orderBy("subject").collect()]
    if failed:
        raise ValueError("the gate failed: " + "; ".join(failed))


def assigned(samples: DataFrame, assignments: DataFrame, key: str = "sample_id") -> DataFrame:
    """Samples with the split that assignments (key, split) give them; a sample without one is an error when the rows are read."""
    split = F.coalesce("split", F.raise_error(F.concat(F.lit("no split is assigned to "), F.coalesce(key, F.lit("a null id")))).cast("string"))
    return samples.drop("split").join(assignments.select(key, "split"), key, "left").withColumn("split", split)


def manifest_problems(samples: DataFrame) -> DataFrame:
    """(rule, rows): how many rows or groups break each rule of a manifest.

    Retired rows (removed_reason, where there is such a column) still count for every rule but all_retired; null
    build ids and null contents are unknown and contradict nothing; a null split is stray.
    """
    ids = samples.groupBy("sample_id").agg(F.count(F.lit(1)).alias("n")).agg(F.count_if(F.col("n") > 1).alias("v"))
    per = samples.where("file_hash is not null").groupBy("file_hash", "split").agg(F.lit(1).alias("x"))  # a hot content is few rows
    cross = per.groupBy("file_hash").agg(F.count("x").alias("n")).agg(F.count_if(F.col("n") > 1).alias("v"))
    active = F.col("removed_reason").isNull() if "removed_reason" in samples.columns else F.lit(True)
    build = F.col("build_id") if "build_id" in samples.columns else F.lit(None).cast("string")
    n = F.count(F.lit(1))
    plain = samples.agg(
        (n == 0).cast("long").alias("empty"), F.count_if(~F.coalesce(F.col("split").isin("train", "dev", "test"), F.lit(False))).alias("stray_split"),
        F.when((n > 0) & (F.count_if(active) == 0), n).otherwise(0).alias("all_retired"), (F.coalesce(F.min(build) != F.max(build), F.lit(False))).cast("long").alias("mixed_builds"),
    )
    rows = F.array(*[F.struct(F.lit(c).alias("rule"), F.col(c).cast("long").alias("rows")) for c in plain.columns])
    out = plain.select(F.explode(rows).alias("r")).select("r.*")
    for name, found in (("duplicate_ids", ids), ("cross_split_content", cross)):
        out = out.unionByName(found.select(F.lit(name).alias("rule"), F.col("v").alias("rows")))
    return out


def duplicate_counts(samples: DataFrame) -> DataFrame:
    """Occurrences beyond the first of each content, within one split and across splits."""
    per = samples.groupBy("file_hash", "split").agg(F.count(F.lit(1)).alias("n")).groupBy("file_hash").agg(F.sum(F.col("n") - 1).alias("w"), (F.count(F.lit(1)) - 1).alias("c"))
    return per.agg(F.coalesce(F.sum("w"), F.lit(0)).alias("within_split"), F.coalesce(F.sum("c"), F.lit(0)).alias("cross_split"))


def tallies(samples: DataFrame, axes: Sequence[str]) -> DataFrame:
    """(axis, value, rows) for each axis, unknown counted as such, from one scan."""
    pairs = F.array(*[F.struct(F.lit(a).alias("axis"), F.coalesce(known(F.col(a)), F.lit("unknown")).alias("value")) for a in axes])
    return samples.select(F.explode(pairs).alias("p")).groupBy("p.axis", "p.value").agg(F.count(F.lit(1)).alias("rows"))


def distribution(df: DataFrame, value: str, keys: Sequence[str] = ()) -> DataFrame:
    """Count, total, least, most and mean; zeros where there is nothing."""
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return df.groupBy(*keys).agg(
        F.count(value).alias("n"), F.round(zero(F.sum(value)), 6).alias("total"), zero(F.min(value)).alias("least"), zero(F.max(value)).alias("most"), F.round(zero(F.avg(value)), 6).alias("mean")
    )


def retire(samples: DataFrame, retired: DataFrame) -> DataFrame:
    """Set removed_reason of the samples in retired (sample_id, reason); a reason set earlier stays. Retired rows are never deleted."""
    if "removed_reason" not in samples.columns:
        samples = samples.withColumn("removed_reason", F.lit(None).cast("string"))
    new = retired.groupBy("sample_id").agg(F.min("reason").alias("_reason"))
    return samples.join(new, "sample_id", "left").withColumn("removed_reason", F.coalesce("removed_reason", "_reason")).drop("_reason")


def top_rows(df: DataFrame, order: Sequence[str], limit: int) -> DataFrame:
    """The first rows in an order, with truncated: whether there were more."""
    got = df.orderBy(*order).limit(limit + 1)
    n = W.orderBy(*order)
    out = got.withColumns({"_n": F.row_number().over(n), "_all": F.count(F.lit(1)).over(W.partitionBy())})
    return out.where(F.col("_n") <= limit).withColumn("truncated", F.col("_all") > limit).drop("_n", "_all")


def capped(df: DataFrame, key: str, order: str, cap: int) -> DataFrame:
    """At most `cap` rows of each key, the first in order; Spark keeps no more than that of a key in each task."""
    return df.withColumn("_n", F.row_number().over(W.partitionBy(key).orderBy(order))).where(F.col("_n") <= cap).drop("_n")
