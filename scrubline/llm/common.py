"""What the operators of this subpackage share: tables, worker paths, checkpoints."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scrubline.sources.scratch import scratch_folder

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ship(spark: SparkSession) -> None:
    """Lets Python workers import this package wherever the driver was started from."""
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if ROOT not in paths:
        env["PYTHONPATH"] = os.pathsep.join([ROOT, *paths])


def settle(df: DataFrame) -> DataFrame:
    """Cuts the lineage with an eager checkpoint in the folder that the cluster shares."""
    spark = df.sparkSession
    scratch_folder(spark)
    # the shuffle files behind a checkpoint are of no more use; a lost one would be computed again
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        again = df.select("*")
        return again.checkpoint(eager=True)
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_or_empty(col: str = "text") -> F.Column:
    return F.coalesce(F.col(col), F.lit(""))
