"""The folder that driver and executors share for what is written between steps."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def scratch_folder(spark: SparkSession) -> str:
    """The session's checkpoint folder; where none is set, a temporary one, on a single machine only."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not sc.master.split("[")[0] == "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="scrubline-ckpt-"))
    return sc.getCheckpointDir()


def settle(df: DataFrame) -> DataFrame:
    """Cuts the lineage with an eager checkpoint in the shared folder."""
    scratch_folder(df.sparkSession)
    return df.checkpoint(eager=True)
