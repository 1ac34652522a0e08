"""Readers and writers by storage type, for batches and streams."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegauge.operators.merge import union_common


class TableSource(Protocol):
    """What a storage gives: rows, and what it knows of its fields."""

    def rows(self) -> DataFrame: ...

    def fields(self) -> dict[str, str]: ...


class PathSource:
    """Files of a format Spark reads (parquet, orc, json, csv, text, avro where its package is there)."""

    def __init__(self, spark: SparkSession, path: str | list[str], form: str = "parquet", schema: str | None = None, **options: str):
        self.spark, self.path, self.form, self.schema, self.options = spark, path, form, schema, options

    def rows(self) -> DataFrame:
        reader = self.spark.read.format(self.form).options(**self.options)
        return (reader.schema(self.schema) if self.schema else reader).load(self.path)

    def stream(self, per_trigger: int = 1000) -> DataFrame:
        schema = self.schema or self.rows().schema
        return self.spark.readStream.format(self.form).schema(schema).option("maxFilesPerTrigger", per_trigger).options(**self.options).load(self.path)

    def fields(self) -> dict[str, str]:
        return {f.name: f.dataType.simpleString() for f in self.rows().schema.fields}


class JdbcSource(PathSource):
    """A relational table over JDBC, split by a numeric column."""

    def __init__(self, spark: SparkSession, url: str, table: str, column: str | None = None, low: int = 0, high: int = 1, parts: int = 8, **options: str):
        split = {"partitionColumn": column, "lowerBound": str(low), "upperBound": str(high), "numPartitions": str(parts)} if column else {}
        super().__init__(spark, [], "jdbc", None, url=url, dbtable=table, **split, **options)

    def rows(self) -> DataFrame:
        return self.spark.read.format("jdbc").options(**self.options).load()


class KafkaSource:
    """A topic as rows ``key, value`` (texts), ``partition, offset, timestamp``; needs Spark's Kafka package on the class path."""

    def __init__(self, spark: SparkSession, servers: str, topic: str, most_offsets: int = 1_000_000):
        self.spark = spark
        self.options = {"kafka.bootstrap.servers": servers, "subscribe": topic, "maxOffsetsPerTrigger": str(most_offsets)}

    @staticmethod
    def _texts(df: DataFrame) -> DataFrame:
        return df.select(F.col("key").cast("string"), F.col("value").cast("string"), "partition", "offset", "timestamp")

    def rows(self) -> DataFrame:
        return self._texts(self.spark.read.format("kafka").options(**self.options).load())

    def stream(self) -> DataFrame:
        return self._texts(self.spark.readStream.format("kafka").options(**self.options).load())


SOURCES: dict[str, Callable[..., TableSource]] = {"parquet": PathSource, "file": PathSource, "jdbc": JdbcSource, "kafka": KafkaSource}


def source_of(storage: str, *args, **kwargs) -> TableSource:
    """The source class of a storage type."""
    if storage not in SOURCES:
        raise KeyError(f"no storage: {storage!r}")
    return SOURCES[storage](*args, **kwargs)


def day_shards(spark: SparkSession, root: str, days: list[str], form: str = "parquet") -> DataFrame:
    """A table kept in one folder per day (``root/dt=yyyymmdd``): only the days named are listed and read."""
    return spark.read.format(form).option("basePath", root).load([f"{root}/dt={d}" for d in days])


def several(tables: list[DataFrame], order: str | None = None) -> DataFrame:
    """One scan over equal tables; one that lacks the sort field counts as empty."""
    kept = [t for t in tables if order is None or order in t.columns] or tables[:1]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), kept)


def common_fields(tables: list[DataFrame]) -> DataFrame:
    return union_common(tables)


# Sinks

def write_sharded(df: DataFrame, path: str, tags: list[str], shards: int, day: str | None = None) -> None:
    """Rows of one tag set go to one shard (a folder), within it sorted by the tags."""
    shard = F.pmod(F.xxhash64(*tags), F.lit(shards)).cast("int")
    by = [day, "shard"] if day else ["shard"]
    df.withColumn("shard", shard).repartition(shards, "shard").sortWithinPartitions(*tags).write.mode("append").partitionBy(*by).parquet(path)


def read_first_that_works(loaders: list[Callable[[], DataFrame]]) -> DataFrame:
    """Replicas in order; the next is read where one fails."""
    errors = []
    for load in loaders:
        try:
            return load()
        except Exception as e:  # noqa: BLE001 - whatever the storage raises
            errors.append(str(e))
    raise RuntimeError("no replica could be read: " + "; ".join(errors))


def bulk_sink(write: Callable[[DataFrame, int], None], retries: int = 3) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that repeats a failed batch; ``write`` must be idempotent by batch id."""

    def each(batch: DataFrame, batch_id: int) -> None:
        for attempt in range(retries):
            try:
                write(batch, batch_id)
                return
            except Exception:  # noqa: BLE001 - the last failure is raised
                if attempt == retries - 1:
                    raise

    return each


def parquet_batches(path: str) -> Callable[[DataFrame, int], None]:
    """Each micro-batch in a folder of its own, overwritten if it is repeated: exactly once for readers."""
    return lambda batch, batch_id: batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")


def nowhere(df: DataFrame) -> None:
    df.write.format("noop").mode("overwrite").save()
