"""Sessions, the shared folder, and cutting lineage."""

from __future__ import annotations

import pickle
import re
import sys
import tempfile
import uuid
from collections.abc import Callable
from typing import Any

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession


def get_spark(master: str = "local[*]", app: str = "tidegauge", **conf: str) -> SparkSession:
    """A session with the settings that the operators expect: UTC, AQE and Arrow."""
    builder = (
        SparkSession.builder.master(master)
        .appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, named by ``spark.checkpoint.dir``. On a single machine, where that is unset, a temporary folder is made and
    registered; on a cluster, whose executors don't see it, that is an error."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        master = spark.sparkContext.master
        if not re.fullmatch(r"local(\[[^\]]*\])?", master):
            raise RuntimeError(f"spark.checkpoint.dir must name a folder that all executors of {master} share")
        known = spark.sparkContext.getCheckpointDir()
        configured = known.rsplit("/", 1)[0] if known else tempfile.mkdtemp(prefix="tidegauge-")
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(configured)
    return configured.rstrip("/")


def _on(spark: SparkSession, path: str) -> tuple[Any, Any]:
    """The Hadoop file system of a path, and the path for it."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()), target


def exists(spark: SparkSession, path: str) -> bool:
    system, target = _on(spark, path)
    return system.exists(target)


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, never used before. All scratch paths of an application lie in one folder, which goes when the application ends, or by ``release``."""
    root = f"{shared_dir(spark)}/tidegauge/{spark.sparkContext.applicationId}"
    system, target = _on(spark, root)
    system.deleteOnExit(target)
    return f"{root}/{name}-{uuid.uuid4().hex}"


def release(spark: SparkSession) -> None:
    """Delete what the application's queries have written so far. For a long session, between queries: results that haven't been read yet, and indexes and stores without a path of their own, go too."""
    drop_path(spark, f"{shared_dir(spark)}/tidegauge/{spark.sparkContext.applicationId}")


def materialise(df: DataFrame, name: str, by: list[str] | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends at replicated files, so a lost
    executor costs no recomputation, and the result is computed once however often it is read. ``by``: columns whose values become folders, for reads of some of them."""
    spark = df.sparkSession
    path = scratch(spark, name)
    (df.write.partitionBy(*by) if by else df.write).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a path of the shared folder (any Hadoop file system)."""
    system, target = _on(spark, path)
    system.delete(target, True)


def ship(spark: SparkSession, thing: Any) -> Callable[[], Any]:
    """Send ``thing``, of known size, to the executors once. The function returned gives it there; a Python worker keeps the last thing
    shipped from task to task, with whatever it has learnt in between."""
    sent = spark.sparkContext.broadcast(cloudpickle.dumps(thing))
    name = uuid.uuid4().hex

    def get() -> Any:
        kept = sys.__dict__.setdefault("_tidegauge_shipped", {})
        if name not in kept:
            kept.clear()
            kept[name] = pickle.loads(sent.value)
        return kept[name]

    return get
