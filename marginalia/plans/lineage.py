"""Cutting lineage so that a lost executor costs a read, not the whole job."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the cluster's shared folder (spark.checkpoint.dir); in local mode, make one where none is set, as in tests."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is not None:
        return
    folder = sc.getConf().get("spark.checkpoint.dir")
    if folder is None:
        if not sc.master.split("[")[0] == "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="spark-checkpoint-")
    sc.setCheckpointDir(folder)


def shared_folder(spark: SparkSession) -> str:
    """A folder that all executors share: that of the checkpoints."""
    ensure_checkpoint_dir(spark)
    return spark.sparkContext.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """`df`, computed once and kept in the shared checkpoint folder."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
