"""A corpus pipeline of the operators in speechlake.llm: quality, line dedup, near-dedup, mix, pack."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from speechlake.llm.line_dedup import line_dedup
from speechlake.llm.minhash_forest import near_duplicates
from speechlake.llm.mixing import mixed_documents
from speechlake.llm.packing import pack_documents
from speechlake.llm.quality_rules import quality_rules
from speechlake.sources.shared import written


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that neither fail the rules nor come from a host that is rejected."""
    rows = docs.withColumn("_row", F.struct(*docs.columns))
    return quality_rules(rows, keep=("_row",)).where("kept").select("_row.*")


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, less the lines that five or more of them share; n_chars follows the text."""
    return line_dedup(docs).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (five words, 0.8), that of the smallest id."""
    gone = near_duplicates(docs).where("not kept").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents of the mix, as often as it takes them."""
    return mixed_documents(docs)


def pack_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The sequence and the place of each piece of each document."""
    import public_tokenizers

    return pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"), with_ids=False)


STAGES = [
    ("quality rules", quality_stage),
    ("line dedup", line_stage),
    ("near dedup", near_stage),
    ("mixing", mix_stage),
    ("packing", pack_stage),
]

#: SQL cannot express the packing or the tokenizer; tests hold each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order over the documents table, each result written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
