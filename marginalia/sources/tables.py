"""Parquet tables of a data folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, folder: str, name: str, *columns: str, spread: bool = False) -> DataFrame:
    """The table `name` of `folder`; with `columns`, only those are read.

    spread: for work that is heavy per row; a table in fewer pieces than there are cores is dealt out to all of them.
    Larger tables are read as they lie.
    """
    df = spark.read.parquet(f"{folder}/{name}.parquet")
    df = df.select(*columns) if columns else df
    cores = spark.sparkContext.defaultParallelism
    return df.repartition(cores) if spread and df.rdd.getNumPartitions() < cores else df
