"""A corpus pipeline of five stages over documents; each stage's result is written and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import passing, written
from tessera.llm.jaccard_join import jaccard_components
from tessera.llm.packing import pack
from tessera.llm.pii import sanitise
from tessera.llm.suffix_dedup import remove_repeats
from tessera.llm.toxicity import scored, threshold_of, train

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity is below the threshold of their language; learned from the labelled ones among them."""
    rows = docs.select(COLUMNS)
    net = train(rows, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return scored(rows, net).where(F.col("toxicity_score") < threshold_of(net, F.col("lang"))).select(COLUMNS)


def jaccard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the smallest doc_id, of each component of similar ones."""
    with passing(spark, "gone"):
        gone = written(jaccard_components(docs).where("doc_id <> component_id").select("doc_id").distinct(), "gone")
    return docs.select(COLUMNS).join(gone, "doc_id", "left_anti").select(COLUMNS)


def suffixes(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that an earlier one holds; those with nothing left go. Rows without doc_id stay as they are."""
    out = remove_repeats(docs.select(COLUMNS), carry=["lang", "source"])
    out = out.where("n_removed < n_bytes or n_bytes = 0")
    return out.select("doc_id", F.col("kept").alias("text"), "lang", "source", F.length("kept").cast("long").alias("n_chars")).select(COLUMNS)


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose personal data and revealing terms are masked."""
    out = sanitise(docs.select(COLUMNS), "lang", "source")
    return out.withColumn("n_chars", F.length("text").cast("long")).select(COLUMNS)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of token sequences."""
    return pack(docs.select(COLUMNS))


STAGES = [("toxicity", toxicity), ("jaccard", jaccard), ("suffixes", suffixes), ("pii", pii), ("packing", packing)]

#: SQL cannot express the stages; tests compare them with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, applied to the documents of sf_dir."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, name)
    return docs
