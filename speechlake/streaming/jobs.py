"""Streaming jobs: finite runs over files, and sinks that survive a replayed batch."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from speechlake.sources.shared import new_path, written

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def run_available(df: DataFrame, name: str) -> DataFrame:
    """Run a streaming frame over what is there, into Parquet in the shared folder; return the rows.

    The file sink's log names the files of committed batches only, so a batch that ran twice counts once.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    run = df.writeStream.format("parquet").option("path", f"{path}/rows").option("checkpointLocation", f"{path}/state").outputMode("append").trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.read.schema(df.schema).parquet(f"{path}/rows")


def run_batches(df: DataFrame, name: str, decide: Callable[[DataFrame], DataFrame], key: str) -> DataFrame:
    """Run decide() on each micro-batch and append its rows under the batch's number; a replayed batch overwrites itself."""
    spark = df.sparkSession
    path = new_path(spark, name)

    def write(batch: DataFrame, number: int) -> None:
        decide(batch).write.mode("overwrite").parquet(f"{path}/rows/batch={number}")

    run = df.writeStream.foreachBatch(write).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.read.parquet(f"{path}/rows").drop("batch").dropDuplicates([key])


def file_stream(spark: SparkSession, rows: DataFrame, name: str, per_trigger: int = 1, files: int = 4, order: str | None = None) -> DataFrame:
    """Store rows as files in the shared folder and read them as a stream, per_trigger files at a time.

    With an order the files cover ascending ranges of it, and are written one after the other.
    """
    path = new_path(spark, name)
    if order is None:
        rows.repartition(files).write.parquet(f"{path}/in")
    else:
        stored = written(rows.repartitionByRange(files, order).withColumn("_part", F.spark_partition_id()), name)
        for i in range(files):
            stored.where(F.col("_part") == i).drop("_part").coalesce(1).write.mode("append").parquet(f"{path}/in")
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", per_trigger).parquet(f"{path}/in")

