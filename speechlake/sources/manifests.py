"""Sets of manifests: all rows of a build, those of each split and of each evaluation view, published at once."""

import json
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from speechlake.operators.corpus import duplicate_counts, manifest_problems
from speechlake.operators.splitting import evaluation_views
from speechlake.sources.files import SCHEMA_VERSION
from speechlake.sources.shared import written
from speechlake.sources.versions import Version, commit, current


def write_manifest_set(rows: DataFrame, path: str, build_id: str, holdouts: dict[str, Sequence[str]] | None = None, overwrite: bool = False) -> Version:
    """Publish the rows of a build under `path`: `all`, train, dev, test and a view for each held-out column that selects rows.

    rows: sample_id, split, file_hash and the columns of holdouts; removed_reason marks retired rows, build_id the rows' build. The
    rows get the build's id. Nothing is written where manifest_problems has something to say, or where `path` holds
    another build and overwrite is not set; a build may replace itself. The set appears by one rename (see
    versions.commit), with the numbers of rows and active rows of each manifest in its facts; until then, and after a
    crash, readers see the set before. JSON lines, by sample_id within each file; a split is a partition of `all`.
    """
    spark = rows.sparkSession
    before = current(spark, path)
    if before and before.facts["build_id"] != build_id and not overwrite:
        raise ValueError(f"{path} holds build {before.facts['build_id']}, not {build_id}; overwrite replaces it")
    if "removed_reason" not in rows.columns:
        rows = rows.withColumn("removed_reason", F.lit(None).cast("string"))
    rows = written(rows, "manifest")
    broken = [f"{r.rule}: {r.rows}" for r in manifest_problems(rows).where("rows > 0").orderBy("rule").collect()]
    if broken:
        raise ValueError("not a manifest: " + ", ".join(broken))
    rows = rows.withColumn("build_id", F.lit(build_id))

    def write(folder: str) -> dict:
        ordered = rows.repartitionByRange("split", "sample_id").sortWithinPartitions("split", "sample_id")
        ordered.write.option("ignoreNullFields", "false").partitionBy("split").json(f"{folder}/rows")
        counts = [F.count(F.lit(1)).alias("rows"), F.count_if(F.col("removed_reason").isNull()).alias("active")]
        manifests = {r.split: {"rows": r.rows, "active": r.active} for r in rows.groupBy("split").agg(*counts).collect()}
        manifests["all"] = {k: sum(m[k] for m in manifests.values()) for k in ("rows", "active")}
        if holdouts:
            views = rows.join(evaluation_views(rows, holdouts), "sample_id")
            views.repartitionByRange("view", "sample_id").sortWithinPartitions("view", "sample_id").write.option("ignoreNullFields", "false").partitionBy("view").json(f"{folder}/views")
            manifests |= {f"test_{r.view}": {"rows": r.rows, "active": r.active} for r in views.groupBy("view").agg(*counts).collect()}
        within = duplicate_counts(rows).first().within_split
        return {"schema_version": SCHEMA_VERSION, "build_id": build_id, "columns": rows.schema.json(), "manifests": manifests, "within_split_duplicates": within}

    return commit(spark, path, write, before.number if before else 0)


def read_manifest_set(spark: SparkSession, path: str, name: str = "all") -> DataFrame:
    """The rows of one manifest of the set: all, train, dev, test or a view (test_cross_<column>).

    Refuses a folder without a set, a newer schema, a malformed row, a manifest that the set does not hold and one
    with another number of rows than was published.
    """
    version = current(spark, path)
    if version is None:
        raise ValueError(f"{path} holds no manifests")
    facts = version.facts
    if facts["schema_version"] > SCHEMA_VERSION:
        raise ValueError(f"the manifests have schema {facts['schema_version']}, this engine reads {SCHEMA_VERSION}")
    if name not in facts["manifests"]:
        raise ValueError(f"no manifest {name}; there are {', '.join(sorted(facts['manifests']))}")
    schema = StructType.fromJson(json.loads(facts["columns"]))
    view = name.startswith("test_")
    read = spark.read.schema(StructType([*schema.fields, *([] if not view else StructType().add("view", "string").fields)])).option("mode", "FAILFAST")
    rows = read.json(f"{version.folder}/{'views' if view else 'rows'}")
    if view:
        rows = rows.where(F.col("view") == name.removeprefix("test_"))
    elif name != "all":
        rows = rows.where(F.col("split") == name)
    rows = rows.select(*schema.names)
    if rows.count() != facts["manifests"][name]["rows"]:
        raise ValueError(f"the manifest {name} does not have the rows that were published")
    return rows


def manifest_names(spark: SparkSession, path: str) -> dict[str, dict[str, int]]:
    """The manifests of the set with their numbers of rows and active rows."""
    version = current(spark, path)
    return version.facts["manifests"] if version else {}
