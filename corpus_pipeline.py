"""The corpus pipeline: five operators, one after the other, over whole documents.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet and read again as the
next stage's docs.  All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from cataloom.llm.decontaminate import decontaminated
from cataloom.llm.filters import KeyFilter
from cataloom.llm.line_dedup import deduplicated
from cataloom.llm.mixing import mixed, mixed_texts
from cataloom.llm.near_dedup import near_duplicates
from cataloom.llm.storage import stored
from cataloom.llm.toxicity import civil, fit

#: Word shingles and similarity of the pipeline's near-duplicate and contamination stages.
SHINGLE_WORDS, PERCENT = 5, 80


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier calls toxic go."""
    return civil(docs, fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that an earlier line makes redundant go, of every length but empty ones; n_chars follows the text.  Every document stays."""
    out = deduplicated(docs)
    shorter = F.when(F.size("dropped") > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
    return out.withColumn("n_chars", shorter).select(docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays, the one with the least doc_id."""
    copies = stored(near_duplicates(docs, SHINGLE_WORDS, PERCENT).where("not kept").select("doc_id").distinct(), "near-copies")
    held, key = KeyFilter(copies), F.col("doc_id").cast("long")
    # Most documents cannot be copies and are kept without a shuffle; the join decides about the others.
    doubtful = held.may_hold(docs, key)
    doubtful = doubtful.join(copies, doubtful["doc_id"].cast("long") == copies["doc_id"], "left_anti")
    return held.cannot_hold(docs, key).unionByName(doubtful).select(docs.columns)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain a benchmark item go."""
    return decontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), SHINGLE_WORDS, PERCENT)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Writes the mix, block by block, as table pipeline-mix; returns how many words of each document it takes."""
    stored(mixed_texts(docs), "pipeline-mix")
    return mixed(docs).drop("shard", "pieces")


STAGES = [("toxicity", toxicity), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("decontaminate", decontaminate), ("mix", mix)]

#: SQL can express neither the classifier nor the order of draws.  tests/llm/test_pipeline_stages.py compares the last four stages with plain versions, and
#: what toxicity keeps with its model's scores and the planted words.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder.  Null and empty texts go through all of them; repeated rows count each for itself."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
