"""Whole jobs over stored tables: validate, check for leakage, inspect, and publish with reports."""

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from speechlake.functions.records import partition_key
from speechlake.operators import corpus as C
from speechlake.operators import splitting as S
from speechlake.sources.manifests import read_manifest_set, write_manifest_set
from speechlake.sources.shared import written
from speechlake.sources.versions import Version

TALLIED = ("split", "label", "dataset_id", "language", "generator", "channel", "device")


def write_report(rows: DataFrame, reports: str, name: str) -> DataFrame:
    """Write a report as JSON lines, in place of the one before, and read it back."""
    path = f"{reports}/{name}"
    rows.coalesce(1).write.mode("overwrite").option("ignoreNullFields", "false").json(path)  # a few rows an axis, a dataset or a split
    return rows.sparkSession.read.schema(rows.schema).json(path)


def validate_job(records: DataFrame, reports: str, build_id: str, **limits) -> DataFrame:
    """Validate and deduplicate records (see corpus.validate); returns all of them with code and reason.

    Writes the reports `validation` (per dataset and outcome, rows and seconds) and `scopes` (what could not be compared), and appends
    the rejected records to `rejected`, under the build's id: what earlier builds rejected stays.
    """
    out = written(C.dedup_accepted(C.validate(records, **limits)), "validated")
    outcome = F.coalesce("code", F.lit("accepted")).alias("outcome")
    write_report(out.groupBy("dataset_id", outcome).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("duration_s"), 4).alias("seconds")), reports, "validation")
    scopes = out.agg(*[(F.count(c) == 0).alias(f"{c}_unavailable") for c in ("file_hash", "content_hash")], (F.count(F.lit(1)) - F.countDistinct("sample_id")).alias("repeated_ids"))
    write_report(scopes, reports, "scopes")
    rejected = out.where("code is not null").select("sample_id", "dataset_id", "code", "reason", F.lit(build_id).alias("build_id"))
    rejected.write.mode("append").option("ignoreNullFields", "false").json(f"{reports}/rejected")
    return out


def leakage_job(samples: DataFrame, reports: str, required: Sequence[str] = ("speaker",), **options) -> DataFrame:
    """Write the reports `leakage` (an axis a row) and `gates` of a split table; returns the second, which assert_gates takes."""
    write_report(C.check_leakage(samples), reports, "leakage")
    return write_report(C.gate_report(samples, required, **options), reports, "gates")


def inspect_job(spark: SparkSession, manifests: str, name: str = "all", ids: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """(rows, tallies) of a published manifest: the samples asked for, and how many rows each value of each axis has."""
    rows = read_manifest_set(spark, manifests, name)
    return rows.where(F.col("sample_id").isin(*ids)), C.tallies(rows, [a for a in TALLIED if a in rows.columns])


def publish_job(records: DataFrame, manifests: str, reports: str, build_id: str, required: Sequence[str] = ("speaker",), holdouts: dict[str, Sequence[str]] | None = None, source: str = "parent_id", overwrite: bool = False, **limits) -> Version:
    """Validate records, split them by groups, check the split and publish its manifests.

    All reports are written before the gate is asked, so a build that is refused leaves its evidence: `validation`, `scopes`,
    `rejected`, `splits`, `leakage`, `gates`. A failure of the gate raises ValueError and publishes nothing. Groups with a value of
    holdouts go to test whole, and each such column becomes a view. `source` is what no other split may share with
    test; grp, the group that was placed whole, is a column of the samples.
    """
    accepted = validate_job(records, reports, build_id, **limits).where("code is null").drop("code", "reason", "split")
    accepted = accepted.withColumn("grp", partition_key(F.col("speaker"), F.col("parent_id")))
    splits = S.capacity_fill(S.group_sizes(accepted, holdouts).withColumn("key", F.sha2("grp", 256)), "key")
    samples = written(accepted.join(splits, "grp"), "samples")
    write_report(samples.groupBy("split", "label").agg(F.count(F.lit(1)).alias("samples"), F.countDistinct("speaker").alias("speakers"), F.round(F.sum("duration_s"), 4).alias("seconds")), reports, "splits")
    C.assert_gates(leakage_job(samples, reports, required, source=source))
    return write_manifest_set(samples, manifests, build_id, holdouts, overwrite)
