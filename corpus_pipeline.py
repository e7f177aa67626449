"""A training-data pipeline over documents: quality classifier, exact dedup, near-dedup, decontamination, mixing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes each result as Parquet and reads it again for
the next. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievemill.llm import curriculum, decontaminate, exact_dedup, kneser_ney, similar
from sievemill.llm.common import documents, stash
from sievemill.sources.scratch import scope, sweep


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents whose perplexity is out of its language's range."""
    return kneser_ney.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of those that are equal but for white space."""
    return exact_dedup.drop_duplicates(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each component of near copies: 5-word shingles, Jaccard similarity of 0.8 or more."""
    return similar.keep_one(docs)


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a window of a benchmark item."""
    return decontaminate.remove_documents(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words that the mix takes of each document, in training order of the first stretch."""
    out = curriculum.mix(docs).select("doc_id", "source", "size", "source_size", "target", "taken", "position", "position_again")
    return out.orderBy(F.col("position").asc_nulls_last(), "doc_id")


STAGES = [("quality classifier", quality), ("exact dedup", exact), ("near dedup", near), ("decontamination", clean), ("mixing", mixed)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in turn. What a stage has left in the shared folder goes once its result is written, and so does the result
    of the stage before; tables of other queries stay."""
    docs, before = documents(spark, sf_dir), set()
    for name, stage in STAGES:
        with scope() as made:
            docs = stash(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        sweep(spark, made | before, docs)
        before = {docs._stash_path}
    return docs


#: The classifier and the fingerprints aren't expressible in SQL.
ORACLE_SQL = None
