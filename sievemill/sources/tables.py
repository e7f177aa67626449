"""Tables as the engine reads them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def spread(df: DataFrame) -> DataFrame:
    """df, its rows dealt over the cores where its scan has fewer partitions than there are cores.

    A small table in one row group would else be one task's work, however many cores wait. A table with enough partitions,
    as any large one has, is returned as it is: nothing is shuffled."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, *df.columns[:2]) if df.rdd.getNumPartitions() < cores else df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(spark: SparkSession, sf_dir: str, name: str = "documents") -> DataFrame:
    """A table whose rows are much work each."""
    return spread(table(spark, sf_dir, name))
