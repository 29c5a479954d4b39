"""File inventories, sidecar tables and JSON-lines manifests."""

from collections.abc import Iterator, Sequence
from functools import reduce

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from speechlake.functions.records import known
from speechlake.sources.shared import new_path, written

__all__ = ["duplicate_files", "file_inventory", "inventory", "new_path", "read_jsonl_leniently", "read_manifest", "read_seeded_jsonl", "read_sidecar", "scan_files", "sidecar_join", "write_files", "write_manifest", "write_seeded_jsonl"]

#: The version of manifests that this engine writes; newer ones are refused.
SCHEMA_VERSION = 1
EXTENSIONS = ("flac", "wav", "mp3", "ogg", "m4a", "opus")


def write_files(rows: DataFrame, path: str) -> int:
    """Write each row (name, content) as a file below path, about 1000 to a folder by a hash of the name; returns their number.

    Names tell rows apart and content is binary, null for none. A name alone decides its folder, so a task that is tried again writes the
    same files. Contents are shuffled only where a partition holds more than twice a core's share of the rows.
    """
    cores = rows.sparkSession.sparkContext.defaultParallelism
    n, most = rows.groupBy(F.spark_partition_id()).count().agg(F.coalesce(F.sum("count"), F.lit(0)), F.coalesce(F.max("count"), F.lit(0))).first()
    folders = max(1, n // 1000)
    dealt = rows.select(F.concat(F.lit("part="), F.pmod(F.xxhash64("name"), F.lit(folders))).alias("folder"), "name", F.coalesce("content", F.lit(b"")).alias("content"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(path)
        made = set()
        for batch in batches:
            for row in batch.to_pylist():
                if row["folder"] not in made:
                    store.create_dir(f"{root}/{row['folder']}", recursive=True)
                    made.add(row["folder"])
                with store.open_output_stream(f"{root}/{row['folder']}/{row['name']}", compression=None) as stream:
                    stream.write(row["content"])
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], ["n"])

    if most * cores > 2 * n:
        dealt = dealt.repartition(max(1, min(folders, 8 * cores)), "folder")
    return dealt.mapInArrow(run, "n bigint").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def _parts(spark: SparkSession, path: str) -> str:
    """A pattern for what path holds, so that Spark lists many folders in tasks, not one behind the other; path where it holds nothing."""
    context, pattern = spark.sparkContext, f"{path.rstrip('/')}/{{[^._]*,_*=*}}"
    found = context._jvm.org.apache.hadoop.fs.Path(pattern)
    return pattern if len(found.getFileSystem(context._jsc.hadoopConfiguration()).globStatus(found) or ()) else path


def _source(spark: SparkSession, path: str) -> DataFrame:
    """The files below path as Spark's source for whole files, listed here and not again by what is made of it."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("ignoreCorruptFiles", "true").option("ignoreMissingFiles", "true").load(_parts(spark, path))


def scan_files(spark: SparkSession, path: str | DataFrame, extensions: Sequence[str] = EXTENSIONS, max_bytes: int | None = None) -> DataFrame:
    """(path, modificationTime, length, content) of the files with an allowed extension; hidden folders are left out.

    Files longer than max_bytes are never opened, as the source is asked for shorter ones only. Files that cannot be read
    are left out as well; file_inventory lists both. The folders that path holds are listed by tasks, where there are more than
    spark.sql.sources.parallelPartitionDiscovery.threshold of them. A listing that was made before may stand for path.
    """
    found = _source(spark, path) if isinstance(path, str) else path
    if max_bytes is not None:
        found = found.where(F.col("length") <= max_bytes)
    return found.where(F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)).isin(*extensions) & ~F.col("path").rlike(r"/\.[^/]+/"))


def inventory(rows: DataFrame, max_bytes: int) -> DataFrame:
    """Replace content by size_bytes, file_hash ("sha256:<hex>") and quarantined (over max_bytes)."""
    n = F.length("content").cast("long")
    return rows.withColumns({"size_bytes": n, "file_hash": F.concat(F.lit("sha256:"), F.sha2("content", 256)), "quarantined": n > max_bytes}).drop("content")


def file_inventory(spark: SparkSession, path: str, extensions: Sequence[str] = EXTENSIONS, max_bytes: int = 1 << 30) -> DataFrame:
    """(path, size_bytes, file_hash, problem): every file with content, with its SHA-256, or file_too_large or unreadable.

    A listing gives all paths and lengths without opening a file; a second scan of the same listing reads those of max_bytes at
    most. What the listing has and the scan has not is unreadable, so one broken file costs its own row. Spark makes a task of a
    few small files, as it adds spark.sql.files.openCostInBytes to each; here a task takes many such parts, up to
    about 4000 files or 256 MB, so that tasks and shuffle blocks do not grow with the number of small files. Spark does not list files
    of no bytes.
    """
    source, least = _source(spark, path), 8 * spark.sparkContext.defaultParallelism
    listed = written(scan_files(spark, source, extensions).select("path", F.col("length").alias("size_bytes")).coalesce(least), "listing")
    n, size = listed.agg(F.count(F.lit(1)), F.coalesce(F.sum("size_bytes"), F.lit(0))).first()
    read = scan_files(spark, source, extensions, max_bytes).select(F.col("path").alias("_path"), F.concat(F.lit("sha256:"), F.sha2("content", 256)).alias("file_hash"))
    met = listed.join(written(read.coalesce(max(least, n // 4000, size >> 28)), "inventory"), F.col("path") == F.col("_path"), "left")
    problem = F.when(F.col("size_bytes") > max_bytes, "file_too_large").when(F.col("file_hash").isNull(), "unreadable")
    return met.select("path", "size_bytes", "file_hash", problem.alias("problem"))


def duplicate_files(found: DataFrame, examples: int = 8) -> DataFrame:
    """(file_hash, size_bytes, copies, paths): contents that several files hold, with the first paths, one of which is kept."""
    good = found.where("problem is null").withColumn("_n", F.row_number().over(W.partitionBy("file_hash").orderBy("path")))
    groups = good.groupBy("file_hash").agg(F.max("size_bytes").alias("size_bytes"), F.count(F.lit(1)).alias("copies"), F.array_sort(F.collect_list(F.when(F.col("_n") <= examples, F.col("path")))).alias("paths"))
    return groups.where("copies > 1")


def read_sidecar(spark: SparkSession, paths: Sequence[str], aliases: dict[str, Sequence[str]], sep: str = ",") -> DataFrame:
    """One column for each key of aliases from tables whose headers vary.

    Headers count in lower case and without spaces; the first alias that is known in a row gives its
    value, tokens for a missing value become null, ragged rows are padded. Later paths win where a row
    of the first column repeats.
    """
    parts = []
    for n, path in enumerate(paths):
        raw = spark.read.option("header", True).option("sep", sep).option("mode", "PERMISSIVE").option("ignoreLeadingWhiteSpace", True).option("ignoreTrailingWhiteSpace", True).csv(path)
        there = {c.strip().lower(): c for c in raw.columns}
        columns = [F.coalesce(*[known(F.col(f"`{there[a]}`")) for a in names if a in there], F.lit(None).cast("string")).alias(k) for k, names in aliases.items()]
        parts.append(raw.select(*columns, F.lit(n).alias("_order")))
    rows = reduce(DataFrame.unionByName, parts)
    if len(parts) == 1:
        return rows.drop("_order")
    key, *others = aliases
    best = rows.groupBy(key).agg(F.max(F.struct("_order", *others)).alias("b"))
    return best.select(key, *[F.col(f"b.{c}").alias(c) for c in others])


def sidecar_join(files: DataFrame, side: DataFrame, path: str, key: str, columns: Sequence[str]) -> DataFrame:
    """Attach sidecar columns by the first key that matches, in any case: the whole path, the file's name, its stem.

    Each file gives three keys; one equi-join finds the matches and the best of them is taken, so no
    sidecar table has to be small.
    """
    p = F.lower(F.col(path))
    name = F.element_at(F.split(p, "/"), -1)
    keys = F.array(p, name, F.regexp_replace(name, r"\.[^.]*$", ""))
    exploded = files.select(F.col(path).alias("_path"), F.posexplode(keys).alias("_rank", "_key"))
    table = side.select(F.lower(F.col(key)).alias("_key"), *columns)
    best = exploded.join(table, "_key").groupBy("_path").agg(F.min(F.struct("_rank", *columns)).alias("_b"))
    best = best.select("_path", *[F.col(f"_b.{c}").alias(c) for c in columns])
    return files.join(best, files[path] == best["_path"], "left").drop("_path")


def write_manifest(rows: DataFrame, path: str, build_id: str) -> None:
    """Write rows as JSON lines per split, and a header with their number.

    A header that is there goes first and the new one comes last, so a manifest without one is unfinished. A
    set that readers may use while it is replaced is written by manifests.write_manifest_set.
    """
    context = rows.sparkSession.sparkContext
    header = context._jvm.org.apache.hadoop.fs.Path(f"{path}/header")
    header.getFileSystem(context._jsc.hadoopConfiguration()).delete(header, True)
    rows.sortWithinPartitions("sample_id").write.mode("overwrite").partitionBy("split").json(f"{path}/rows")
    n = rows.sparkSession.read.schema(rows.schema).json(f"{path}/rows").count()
    header = rows.sparkSession.range(1).select(F.lit(SCHEMA_VERSION).alias("schema_version"), F.lit(build_id).alias("build_id"), F.lit(n).alias("rows"))
    header.coalesce(1).write.mode("overwrite").json(f"{path}/header")


def read_manifest(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """The rows of a manifest. Refuses a missing header, a newer schema, a malformed row or another number of rows than the header has."""
    header = spark.read.schema("schema_version int, build_id string, rows bigint").json(f"{path}/header").collect()
    if len(header) != 1 or header[0].rows is None:
        raise ValueError("the manifest has no header")
    if header[0].schema_version > SCHEMA_VERSION:
        raise ValueError(f"the manifest has schema {header[0].schema_version}, this engine reads {SCHEMA_VERSION}")
    rows = spark.read.schema(schema).option("mode", "FAILFAST").json(f"{path}/rows").select(*schema.names)
    if rows.count() != header[0].rows:
        raise ValueError("the manifest's rows are not those that its header counts")
    return rows


def write_seeded_jsonl(rows: DataFrame, path: str, seed: int, order: str) -> None:
    """JSON lines in an order, preceded by a line with the seed that made them."""
    head = rows.sparkSession.range(1).select(F.to_json(F.struct(F.lit(seed).alias("_manifest_seed"))).alias("value"))
    head.coalesce(1).write.mode("overwrite").text(f"{path}/part=0")
    rows.orderBy(order).select(F.to_json(F.struct(*rows.columns)).alias("value")).write.mode("overwrite").text(f"{path}/part=1")


def read_seeded_jsonl(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """The rows of write_seeded_jsonl(), without the seed line."""
    extended = StructType([*schema.fields]).add("_manifest_seed", "long")
    return spark.read.schema(extended).json(path).where("_manifest_seed is null").select(*schema.names)


def read_jsonl_leniently(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The well-formed lines; broken ones are left out."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)
