"""Line dedup over levelled sorted runs of line hashes, in DataFrame functions only."""

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from speechlake.functions.text import BLANK
from speechlake.sources.shared import new_path, written

#: A-Z and a-z, for lower-casing ASCII letters only.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z and leave every other letter; lower() where the text is ASCII, which is much faster."""
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def line_key(line: Column) -> Column:
    """The line without white space at its ends, in lower case."""
    return ascii_lower(F.btrim(line, F.lit(BLANK)))


def key_hash(line: Column) -> Column:
    """128 bits of the line's key."""
    return F.unhex(F.md5(line_key(line)))


@dataclass
class LineRuns:
    """Sorted runs of (h, n_docs, keep_id), in levels of the shared folder.

    A batch adds a run to level 0: a row per hash of the batch, with keep_id where the hash is new and
    null where an earlier batch has it. When a level holds `fanout` runs they are merged into one run of
    the next level, so that a hash is rewritten once per level and a lookup meets few runs.
    """

    spark: SparkSession
    fanout: int = 3
    levels: list[list[str]] = field(default_factory=list)

    SCHEMA = "h binary, n_docs bigint, keep_id bigint"

    def _read(self, paths: list[str]) -> DataFrame:
        return self.spark.read.schema(self.SCHEMA).parquet(*paths) if paths else self.spark.createDataFrame([], self.SCHEMA)

    def merged(self) -> DataFrame:
        """One row per hash: its documents over all runs, and the one that keeps its lines."""
        return _merge(self._read([p for level in self.levels for p in level]))

    def add(self, lines: DataFrame) -> None:
        """Add a batch of (h, doc_id), a row per document and hash.

        The batch's own run is merge-joined with the runs so far: a hash that they lack is new and is
        kept by its largest document in this batch, a hash that they have only adds to its count.
        """
        batch = _merge(lines.select("h", F.lit(1).cast("long").alias("n_docs"), F.col("doc_id").alias("keep_id")))
        if self.levels:
            known = self._read([p for level in self.levels for p in level]).where("keep_id is not null").select("h")
            fresh = batch.join(known.hint("merge"), "h", "left_anti")
            seen = batch.join(known.hint("merge"), "h", "left_semi").withColumn("keep_id", F.lit(None).cast("long"))
            batch = fresh.unionByName(seen)
        self._push(0, self._write(batch))

    def _write(self, rows: DataFrame) -> str:
        path = new_path(self.spark, "line-run")
        rows.sortWithinPartitions("h").write.parquet(path)
        return path

    def _push(self, level: int, path: str) -> None:
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(path)
        if len(self.levels[level]) >= self.fanout:
            full = _merge(self._read(self.levels[level]))
            self.levels[level] = []
            self._push(level + 1, self._write(full))


def _merge(rows: DataFrame) -> DataFrame:
    return rows.groupBy("h").agg(F.sum("n_docs").alias("n_docs"), F.max("keep_id").alias("keep_id"))


def long_line_hashes(docs: DataFrame, min_chars: int, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, h): the distinct keys of at least min_chars code points of each document."""
    lines = F.filter(F.split(F.col(text), "\n"), lambda x: F.length(F.btrim(x, F.lit(BLANK))) >= min_chars)
    return docs.select(F.col(doc_id).alias("doc_id"), F.explode(F.array_distinct(F.transform(lines, key_hash))).alias("h"))


def line_dedup(docs: DataFrame, min_chars: int = 40, min_docs: int = 5, batches: int = 4, fanout: int = 3, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Drop lines that many documents share, from all but the largest doc_id that holds them.

    A line's key is the line less white space at its ends, A-Z lower-cased. A key of min_chars code
    points or more that min_docs documents hold loses its lines everywhere but in the largest doc_id.
    Returns docs with text replaced by the other lines (joined by a newline) and n_lines, n_dropped;
    null text counts as one empty line and stays null unless it has lines. Each row is a document, also
    where ids repeat; a null doc_id is the smallest. A document of which no line is left gets "".

    The ids are cut into `batches` ranges and run through LineRuns from the largest down, so the batch
    in which a hash is new holds the document that keeps it. The texts are read twice and shuffled once,
    by doc_id; what meets them there is an array of the document's own dropped hashes. Columns of docs
    that are named n_lines or n_dropped give way.
    """
    lines = written(long_line_hashes(docs, min_chars, text, doc_id), "lines")
    cuts = lines.agg(F.percentile_approx("doc_id", [i / batches for i in range(1, batches)])).first()[0] or []
    runs = LineRuns(docs.sparkSession, fanout)
    edges = [None, *sorted(set(cuts)), None]
    for low, high in reversed([*zip(edges, edges[1:], strict=False)]):
        part = lines
        if low is not None:
            part = part.where(F.col("doc_id") > low)
        if high is not None:
            part = part.where((F.col("doc_id") <= high) | F.col("doc_id").isNull() if low is None else F.col("doc_id") <= high)
        runs.add(part)
    common = runs.merged().where(F.col("n_docs") >= min_docs)
    lost = lines.join(common, "h").where(~F.col("doc_id").eqNullSafe(F.col("keep_id")))
    lost = lost.groupBy(F.col("doc_id").alias("_id")).agg(F.collect_set("h").alias("_lost"))
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col(doc_id).alias("id"), F.split(F.coalesce(F.col(text), F.lit("")), "\n").alias("lines"))
    out = rows.join(lost, rows["id"].eqNullSafe(lost["_id"]), "left")
    left = F.filter("lines", lambda x: ~((F.length(F.btrim(x, F.lit(BLANK))) >= min_chars) & F.array_contains(F.col("_lost"), key_hash(x))))
    out = out.withColumn("left", F.when(F.col("_lost").isNull(), F.col("lines")).otherwise(left))
    n_dropped = F.size("lines") - F.size("left")
    kept = F.when(n_dropped > 0, F.array_join("left", "\n")).otherwise(F.col("row")[text])
    others = [kept.alias(c) if c == text else F.col("row")[c].alias(c) for c in docs.columns if c not in ("n_lines", "n_dropped")]
    return out.select(*others, F.size("lines").cast("long").alias("n_lines"), n_dropped.cast("long").alias("n_dropped"))
