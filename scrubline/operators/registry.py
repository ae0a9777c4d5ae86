"""The registry of project tokens: a value keeps its number for as long as the registry lives.

Append-only. Each batch of values adds at most one version: the values that no earlier version has,
numbered from the last number of their label on. A version is a folder of Parquet files, and counts
from the moment its line stands in the log; what an ended run has left without a line is never read.
Of two writers that enter the same version the one with the smaller folder name has it, and the
other starts again from there. So a value has one number, numbers have no gaps, and a batch that is
entered again, after a failure or twice, changes nothing.

Values are stored as blind indexes and sealed texts (``vault.Secret``); the secret belongs to the
registry and must be the same each time.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scrubline.functions import scalars as S
from scrubline.sources.scratch import settle
from scrubline.sources.vault import Secret

_LOG = "version long, folder string"
_DATA = "label string, blind string, bucket string, sealed binary, ordinal long"


class Registry:
    """A registry in a folder that driver and executors share, or a store's URI."""

    def __init__(self, spark: SparkSession, folder: str, key: bytes):
        self.spark, self.folder, self.secret = spark, folder.rstrip("/"), Secret(key)

    def versions(self) -> list[tuple[int, str]]:
        """(version, folder) of the versions that count: one line a batch."""
        try:
            log = self.spark.read.schema(_LOG).parquet(f"{self.folder}/log")
            rows = log.groupBy("version").agg(F.min("folder").alias("folder")).orderBy("version").collect()
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return []
        return [(r["version"], r["folder"]) for r in rows]

    def numbers(self, versions: list[tuple[int, str]] | None = None) -> DataFrame:
        """(label, blind, bucket, sealed, ordinal) of all values entered."""
        folders = [f"{self.folder}/{f}" for _, f in (self.versions() if versions is None else versions)]
        return self.spark.read.schema(_DATA).parquet(*folders) if folders else self.spark.createDataFrame([], _DATA)

    def enter(self, values: DataFrame) -> DataFrame:
        """(label, blind, ordinal) of all values entered, once distinct (label, blind, bucket, sealed) are."""
        from .rewrite import numbered

        values = settle(values)
        while True:
            versions = self.versions()
            known = self.numbers(versions)
            fresh = settle(values.join(known.select("label", "blind"), ["label", "blind"], "left_anti"))
            if fresh.isEmpty():
                return known.select("label", "blind", "ordinal")
            # one row a label
            last = known.groupBy("label").agg(F.max("ordinal").alias("last"))
            moved = numbered(fresh, self.secret).join(last, "label", "left")
            folder, version = f"values-{uuid.uuid4().hex}", (versions[-1][0] if versions else 0) + 1
            moved.select("label", "blind", "bucket", "sealed", (F.col("ordinal") + F.coalesce("last", F.lit(0))).cast("long").alias("ordinal")).write.parquet(f"{self.folder}/{folder}")
            self.spark.createDataFrame([(version, folder)], _LOG).coalesce(1).write.mode("append").parquet(f"{self.folder}/log")
            # another writer may have had the version: then what is still missing is entered after it

    def entries(self) -> DataFrame:
        """SENSITIVE: (token, original) of all values entered."""
        rows = self.numbers().withColumn("key", self.secret.key("bucket"))
        return rows.select(S.token(F.col("label"), F.col("ordinal")).alias("token"), Secret.unseal(F.col("sealed"), F.col("key")).alias("original"))
