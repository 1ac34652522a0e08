"""Key-value stores for enrichment: what changes seldom and is looked up often, as tables that are replaced or merged."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegauge.session import scratch


class Store:
    """``key, value, expires`` (epoch seconds or null) as a table of immutable versions; a reader keeps the version it began with."""

    schema = "key string, value string, expires long"

    def __init__(self, spark: SparkSession, path: str | None = None):
        self.spark, self.path, self.version = spark, path or scratch(spark, "store"), 0

    def table(self, now: int | None = None) -> DataFrame:
        """What is in the store (and hasn't expired at ``now``)."""
        df = self.spark.read.schema(self.schema).parquet(f"{self.path}/v{self.version:06d}") if self.version else self.spark.createDataFrame([], self.schema)
        return df if now is None else df.where(F.col("expires").isNull() | (F.col("expires") > now))

    def put(self, entries: DataFrame, now: int | None = None) -> None:
        """Set keys; of a key given twice the larger value counts, and expired entries are left behind."""
        new = entries.groupBy("key").agg(F.max(F.struct("value", "expires")).alias("x")).select("key", "x.*")
        old = self.table(now).join(new, "key", "left_anti")
        new.unionByName(old).write.mode("overwrite").parquet(f"{self.path}/v{self.version + 1:06d}")
        self.version += 1

    def get(self, keys: DataFrame, now: int | None = None) -> DataFrame:
        """``key, value`` of the keys (column ``key``) that are there."""
        return keys.select("key").distinct().join(self.table(now), "key").select("key", "value")

    def scan(self, prefix: str = "", now: int | None = None) -> DataFrame:
        return self.table(now).where(F.startswith("key", F.lit(prefix)))

    def delete(self, keys: DataFrame) -> None:
        self.table().join(keys.select("key"), "key", "left_anti").write.mode("overwrite").parquet(f"{self.path}/v{self.version + 1:06d}")
        self.version += 1
