"""Threshold detection, N-of-M triggers, comparison of decision streams."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# The comparison methods of threshold configurations.
METHODS = {"gt": lambda v, x: v > x, "gte": lambda v, x: v >= x, "lt": lambda v, x: v < x, "lte": lambda v, x: v <= x, "eq": lambda v, x: v == x, "neq": lambda v, x: v != x}


def threshold(value: Column, config: list) -> Column:
    """OR of ANDs of {method, threshold}; a flat list is one AND-group. Null values aren't anomalous."""
    groups = [config] if config and isinstance(config[0], dict) else config
    if not groups:
        raise ValueError("a threshold needs a condition")
    for c in (c for g in groups for c in g):
        if c["method"] not in METHODS:
            raise ValueError(f"no method: {c['method']!r}")
    one = [reduce(lambda a, b: a & b, [METHODS[c["method"]](value, F.lit(float(c["threshold"]))) for c in g]) for g in groups]
    return F.coalesce(reduce(lambda a, b: a | b, one), F.lit(False))


def level_anomalous(value: Column, algorithms: list[dict], connector: str | None = None) -> Column:
    """Of a level all its algorithms must hold, or with the connector 'or' one of them. Only thresholds are known, without unit prefixes."""
    for a in algorithms:
        if a.get("type", "Threshold") != "Threshold":
            raise ValueError(f"no algorithm: {a['type']!r}")
        if a.get("unit_prefix"):
            raise ValueError("unit prefixes aren't read")
    parts = [threshold(value, a["config"]) for a in algorithms]
    return reduce((lambda a, b: a | b) if connector == "or" else (lambda a, b: a & b), parts)


def record_id(dims: list[str], at: str) -> Column:
    """md5 of the dimensions in order of name, then the time."""
    text = F.to_json(F.struct(*[F.col(d).cast("string").alias(d) for d in sorted(dims)]))
    return F.concat(F.md5(text), F.lit("."), F.col(at).cast("string"))


def detect(df: DataFrame, dims: list[str], at: str, value: str, levels: dict[int, dict]) -> DataFrame:
    """``dims, at, value, record_id, level, anomalous, outcome``: one row per record and level; ``outcome`` says whether any level is anomalous."""
    verdicts = [F.struct(F.lit(k).alias("level"), level_anomalous(F.col(value), v["algorithms"], v.get("connector")).alias("anomalous")) for k, v in sorted(levels.items())]
    every = F.array(*verdicts)
    rows = df.select(*dims, at, value, record_id(dims, at).alias("record_id"), every.alias("_v")).withColumn("outcome", F.exists("_v", lambda x: x["anomalous"]))
    return rows.select(*dims, at, value, "record_id", "outcome", F.inline("_v"))


def last_written(df: DataFrame, keys: list[str], written: Column) -> DataFrame:
    """Of records with equal keys the one written last."""
    rest = [c for c in df.columns if c not in keys]
    best = F.max_by(F.struct(*rest), written) if rest else None
    return df.groupBy(*keys).agg(best.alias("_x")).select(*keys, "_x.*")


def trigger(outcomes: DataFrame, dims: list[str], at: str, configs: dict[int, dict], unit_s: int = 60) -> DataFrame:
    """``dims, at, triggered, level, anomalies, anomaly_timestamps``: a record triggers if it is anomalous and the last ``check_window`` units up to it hold at least
    ``count`` anomalies; levels are tried by number, the first decides. Without a trigger the timestamps of the level examined last are given.

    The windows are range frames over event time, so records may come in any order."""
    per_level = []
    for level, c in sorted(configs.items()):
        span = unit_s * c["check_window"] - 1
        w = W.partitionBy(*dims, "level").orderBy(at).rangeBetween(-span, 0)
        rows = outcomes.where(F.col("level") == level)
        hits = F.count_if("anomalous").over(w)
        stamps = F.collect_list(F.when(F.col("anomalous"), F.col(at))).over(w)  # at most one per unit of the window
        per_level.append(rows.select(*dims, at, "level", "anomalous", hits.alias("anomalies"), F.array_sort(F.array_distinct(stamps)).alias("stamps"), F.lit(c["count"]).alias("needed")))
    rows = reduce(DataFrame.unionByName, per_level)
    fires = F.col("anomalous") & (F.col("anomalies") >= F.col("needed"))
    picked = F.coalesce(F.min(F.when(fires, F.struct("level", "anomalies", "stamps"))), F.max(F.when(F.col("anomalous"), F.struct("level", "anomalies", "stamps"))))
    out = rows.groupBy(*dims, at).agg(F.bool_or(fires).alias("triggered"), picked.alias("p"))
    return out.select(*dims, at, "triggered", F.when(F.col("triggered"), F.col("p.level")).alias("level"), F.coalesce("p.anomalies", F.lit(0)).cast("long").alias("anomalies"), F.coalesce("p.stamps", F.array().cast("array<bigint>")).alias("anomaly_timestamps"))


def compare_streams(source: DataFrame, first: DataFrame, second: DataFrame, key: str, fingerprint: str, epoch: int | None = None, window: int = 0, at: str = "source_time") -> DataFrame:
    """``key, status, verdict``: of each source record whether both deciders answered (complete), one or none did (pending), one gave several answers (conflict) or answered something
    that isn't in the source (invalid); complete ones match if their fingerprints do. Records before ``epoch + window - 1`` are warm-up."""

    def side(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy(key).agg(F.count_distinct(fingerprint).alias(f"n_{name}"), F.min(fingerprint).alias(f"f_{name}"))

    rows = source.select(key, at).withColumn("known", F.lit(True)).join(side(first, "a"), key, "full").join(side(second, "b"), key, "full")
    a, b = F.coalesce("n_a", F.lit(0)), F.coalesce("n_b", F.lit(0))
    status = F.when(F.col("known").isNull(), "invalid").when((a > 1) | (b > 1), "conflict").when((a == 1) & (b == 1), "complete").otherwise("pending")
    warm = F.col(at) < (epoch + window - 1) if epoch is not None else F.lit(False)
    verdict = F.when(warm, "warm_up").when(status != "complete", "not_eligible").when(F.col("f_a") == F.col("f_b"), "match").otherwise("mismatch")
    return rows.select(key, status.alias("status"), verdict.alias("verdict"))


def coverage(compared: DataFrame, at: str, barrier: int, timeout: int) -> DataFrame:
    """Adds ``closed``: pending pairs are given up once the barrier (up to which both streams are read) is past their time plus the timeout."""
    over = F.col(at) + timeout <= barrier
    return compared.withColumn("closed", (F.col("status") != "pending") | over).withColumn("status", F.when((F.col("status") == "pending") & over, "timeout").otherwise(F.col("status")))


def audit_batches(df: DataFrame, group: list[str], order: list[str], size: int) -> DataFrame:
    """Adds ``batch``: numbered chunks of at most ``size`` rows within each group."""
    place = F.row_number().over(W.partitionBy(*group).orderBy(*order)) - 1
    return df.withColumn("batch", F.floor(place / size).cast("long"))
