"""Cutting lineage: frames written to the cluster's checkpoint folder."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder that all executors share, the one in `spark.checkpoint.dir`.

    Where that is unset a temporary one is made, but only for a master in this process: on a
    cluster other machines would not see it.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = sc.getConf().get("spark.checkpoint.dir")
        if folder is None:
            if not sc.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="cairn-")
        sc.setCheckpointDir(folder)
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """df, written to the cluster's checkpoint folder, so that lost executors lose no work."""
    shared_folder(df.sparkSession)
    return df.checkpoint()
