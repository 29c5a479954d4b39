"""Tables that are replaced whole: folders of data, and a pointer that moves from one to the next by an atomic rename."""

import json
import uuid
from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


class LostRace(RuntimeError):
    """Another writer has committed since the version was read on which a change was built."""


class Version(NamedTuple):
    number: int
    folder: str
    facts: dict


def _path(spark: SparkSession, path: str):
    return spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)


def _system(spark: SparkSession, path: str):
    return _path(spark, path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def current(spark: SparkSession, table: str) -> Version | None:
    """The last committed version; None where nothing was committed."""
    fs, log = _system(spark, table), _path(spark, f"{table}/_versions")
    if not fs.exists(log):
        return None
    names = [s.getPath().getName() for s in fs.listStatus(log)]
    numbers = sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and not n.startswith(("_", ".")))
    if not numbers:
        return None
    stream = fs.open(_path(spark, f"{table}/_versions/{numbers[-1]:012d}.json"))
    try:
        text = spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()
    found = json.loads(text)
    return Version(numbers[-1], f"{table}/{found['folder']}", found["facts"])


def commit(spark: SparkSession, table: str, write: Callable[[str], dict], after: int = 0) -> Version:
    """Write a new version and point to it: write(folder) fills a folder of its own and returns facts about it.

    Readers see the version before until the pointer is there, and whole versions always: the pointer is
    written under another name and renamed, which fails where the number exists. So of two writers that
    build on version `after` one raises LostRace, and what a killed writer leaves is never read. Folders of
    earlier versions stay for those who read them; purge() removes them.
    """
    folder = f"data-{uuid.uuid4().hex}"
    facts = write(f"{table}/{folder}")
    fs, number = _system(spark, table), after + 1
    staged, final = f"{table}/_versions/_{folder}", f"{table}/_versions/{number:012d}.json"
    out = fs.create(_path(spark, staged), False)
    try:
        out.write(bytearray(json.dumps({"folder": folder, "facts": facts}, sort_keys=True).encode()))
    finally:
        out.close()
    jvm, gateway = spark.sparkContext._jvm, spark.sparkContext._gateway
    files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(_path(spark, final).toUri(), spark.sparkContext._jsc.hadoopConfiguration())
    try:
        files.rename(_path(spark, staged), _path(spark, final), gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0))
    except Exception as e:
        fs.delete(_path(spark, staged), False)
        if fs.exists(_path(spark, final)):
            raise LostRace(f"version {number} of {table} was committed by another writer") from e
        raise
    return Version(number, f"{table}/{folder}", facts)


def purge(spark: SparkSession, table: str) -> int:
    """Remove the folders of data that the last version does not name, and say how many; only where no one reads or writes them."""
    fs, last = _system(spark, table), current(spark, table)
    if last is None:
        return 0
    named = {last.folder.rsplit("/", 1)[1], *last.facts.get("parts", [])}
    old = [s.getPath() for s in fs.listStatus(_path(spark, table)) if s.getPath().getName().startswith("data-") and s.getPath().getName() not in named]
    for path in old:
        fs.delete(path, True)
    return len(old)


class VersionedTable:
    """Rows in Parquet that are appended to or replaced whole, a version a change.

    A change is built on the version that the table had when read() or version() was last called, and raises LostRace where
    another writer was faster; the caller reads again and repeats it. An append adds a folder to those of the version
    before; a rewrite, as deletions need it, replaces them. What a rewrite leaves behind is removed by purge().
    """

    def __init__(self, spark: SparkSession, path: str, schema: str | StructType):
        self.spark, self.path = spark, path
        self.schema = StructType.fromDDL(schema) if isinstance(schema, str) else schema
        self.seen = 0

    def version(self) -> int:
        last = current(self.spark, self.path)
        self.seen = last.number if last else 0
        return self.seen

    def read(self) -> DataFrame:
        """The rows of the last version; none where nothing was committed."""
        last = current(self.spark, self.path)
        self.seen = last.number if last else 0
        if last is None or not last.facts["parts"]:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*[f"{self.path}/{p}" for p in last.facts["parts"]])

    def append(self, rows: DataFrame) -> int:
        """Add rows, and give the version's number."""
        return self._commit(rows, keep=True)

    def rewrite(self, rows: DataFrame) -> int:
        """Put rows in place of all that are there; rows may be read from this table."""
        return self._commit(rows, keep=False)

    def _commit(self, rows: DataFrame, keep: bool) -> int:
        last = current(self.spark, self.path)
        if (last.number if last else 0) != self.seen:
            raise LostRace(f"{self.path} has changed since it was read")
        before = last.facts["parts"] if keep and last else []

        def write(folder: str) -> dict:
            rows.select(*self.schema.names).write.option("compression", "zstd").parquet(folder)
            return {"parts": [*before, folder.rsplit("/", 1)[1]]}

        self.seen = commit(self.spark, self.path, write, self.seen).number
        return self.seen
