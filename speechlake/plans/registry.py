"""The registered queries and their SQL, and the tables in the roles that they play."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its function's name, with the SQL that gives the same rows."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents as source records; spoof where the quality label is 0."""
    d, q = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels").select("doc_id", "quality")
    i = F.col("doc_id")
    spoof = F.col("quality") == 0
    return d.join(q, "doc_id", "left").select(
        "doc_id", F.concat_ws(":", "source", i).alias("sample_id"), F.col("source").alias("dataset_id"), F.col("lang").alias("language"),
        F.when(i % 11 != 0, F.concat(F.lit("spk"), i % 97)).alias("speaker"), F.floor(i / 3).cast("string").alias("parent_id"),
        F.when(i % 7 != 0, F.concat(F.lit("ch"), i % 5)).alias("channel"), F.when(spoof, F.col("source")).alias("generator"),
        F.concat(F.lit("d"), i % 10).alias("device"), F.lit(None).cast("string").alias("session"), F.sha2("text", 256).alias("file_hash"),
        (F.col("n_chars") / 100.0).alias("duration_s"), F.col("n_chars").alias("file_bytes"),
        F.when(i % 10 < 7, "train").when(i % 10 == 7, "dev").otherwise("test").alias("split"),
        F.when(spoof, "spoof").otherwise("bona_fide").alias("label"),
    )


RECORDS = """
rec AS (
  SELECT d.doc_id, source || ':' || d.doc_id AS sample_id, source AS dataset_id, lang AS language,
         CASE WHEN d.doc_id % 11 <> 0 THEN 'spk' || (d.doc_id % 97) END AS speaker, (d.doc_id // 3)::VARCHAR AS parent_id,
         CASE WHEN d.doc_id % 7 <> 0 THEN 'ch' || (d.doc_id % 5) END AS channel, CASE WHEN quality = 0 THEN source END AS generator,
         'd' || (d.doc_id % 10) AS device, NULL::VARCHAR AS session, sha256(text) AS file_hash,
         n_chars / 100.0 AS duration_s, n_chars AS file_bytes,
         CASE WHEN d.doc_id % 10 < 7 THEN 'train' WHEN d.doc_id % 10 = 7 THEN 'dev' ELSE 'test' END AS split,
         CASE WHEN quality = 0 THEN 'spoof' ELSE 'bona_fide' END AS label
  FROM documents d LEFT JOIN labels USING (doc_id)
)
"""


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, label, score, tied, duration_s): binary labels with a fine and a coarse score."""
    r = records(spark, sf_dir)
    score = (F.col("file_bytes") % 1000) / 999.0
    return r.select("sample_id", "dataset_id", "language", "channel", (F.col("label") == "spoof").cast("int").alias("label"), score.alias("score"), F.round(score, 1).alias("tied"), "duration_s", "split")


SCORED = RECORDS + """, sc AS (
  SELECT sample_id, dataset_id, language, channel, (label = 'spoof')::INT AS label, (file_bytes % 1000) / 999.0 AS score,
         round((file_bytes % 1000) / 999.0, 1) AS tied, duration_s, split FROM rec
)
"""


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(label, score, tied) over all line items: returned or not, by price and by discount (11 values)."""
    l = table(spark, sf_dir, "lineitem")
    return l.select((F.col("l_returnflag") == "R").cast("int").alias("label"), (F.col("l_extendedprice") / 200000.0).alias("score"), F.round(F.col("l_discount") * 100, 0).alias("tied"))


LINES = """
ln AS (SELECT (l_returnflag = 'R')::INT AS label, l_extendedprice / 200000.0 AS score, round(l_discount * 100, 0) AS tied FROM lineitem)
"""
