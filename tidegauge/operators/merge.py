"""Rows and series of several tables or storage segments as one."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

_INTS = ("tinyint", "smallint", "int", "bigint")


def common_type(a: T.DataType, b: T.DataType) -> T.DataType:
    """The safe common type of two columns of a union: texts are text, whole numbers bigint, floats double, decimals widen, dates become
    timestamps; TypeError if there is none (text with number, JSON, anything nested that differs)."""
    if a == b and not isinstance(a, (T.VariantType,)):
        return a
    x, y = a.simpleString(), b.simpleString()
    texts = (T.StringType, T.VarcharType, T.CharType)
    if isinstance(a, texts) and isinstance(b, texts):
        return T.StringType()
    if x in _INTS and y in _INTS:
        return T.LongType()
    if isinstance(a, T.DecimalType) and isinstance(b, T.DecimalType):
        scale = max(a.scale, b.scale)
        whole = max(a.precision - a.scale, b.precision - b.scale)
        if whole + scale > 38:
            raise TypeError(f"no common decimal of {x} and {y}")
        return T.DecimalType(whole + scale, scale)
    numbers = (T.FloatType, T.DoubleType)
    if isinstance(a, numbers) and (isinstance(b, numbers) or y in _INTS) or isinstance(b, numbers) and x in _INTS:
        return T.DoubleType()
    times = (T.DateType, T.TimestampType, T.TimestampNTZType)
    if isinstance(a, times) and isinstance(b, times):
        return T.TimestampNTZType() if T.TimestampNTZType() in (a, b) and T.TimestampType() not in (a, b) else T.TimestampType()
    raise TypeError(f"no common type of {x} and {y}")


def union_all(tables: list[DataFrame], columns: list[str]) -> DataFrame:
    """UNION ALL over these columns; a table without one of them has null there."""
    kinds: dict[str, T.DataType] = {}
    for t in tables:
        for f in t.schema.fields:
            if f.name in columns:
                kinds[f.name] = common_type(kinds[f.name], f.dataType) if f.name in kinds else f.dataType
    parts = [t.select(*[(F.col(c) if c in t.columns else F.lit(None)).cast(kinds.get(c, T.StringType())).alias(c) for c in columns]) for t in tables]
    return reduce(DataFrame.unionByName, parts)


def union_common(tables: list[DataFrame]) -> DataFrame:
    """SELECT * over several tables: the columns that all have (in the first one's order), each in the common type."""
    shared = [c for c in tables[0].columns if all(c in t.columns for t in tables[1:])]
    if not shared:
        raise ValueError("the tables have no column in common")
    return union_all(tables, shared)


#: Aggregates by which equal samples of several sources are merged; any other name sums.
MERGES = {"min": F.min, "max": F.max, "avg": F.avg, "mean": F.avg}


def merge_function(aggregate: str | None, sampled: str | None) -> str:
    """Which merge a query needs: min, max and avg (of either level) as they are, everything else sum."""
    for name in (aggregate, (sampled or "").removesuffix("_over_time")):
        if name and name.lower() in MERGES:
            return "avg" if name.lower() == "mean" else name.lower()
    return "sum"


def merge_series(parts: list[DataFrame], labels: list[str], how: str = "sum") -> DataFrame:
    """Samples with the same labels and time, of several sources, as one: ``labels, t, v``."""
    return reduce(DataFrame.unionByName, parts).groupBy(*labels, "t").agg(MERGES.get(how, F.sum)("v").alias("v"))


@dataclass(frozen=True)
class Route:
    """A storage segment that holds [start, end) ms of a table; ``load`` reads it."""

    name: str
    start: int
    end: int
    load: Callable[[], DataFrame] | None = None


def segments(routes: list[Route], start: int, end: int, overlap_ms: int = 3_600_000, look_back_ms: int = 0) -> list[Route]:
    """The segments that a query of [start, end) reads, each cut to what it has to give: ``overlap_ms`` more after a migration (both sides hold it), and
    the look-back before the start."""
    first = start - look_back_ms
    out = []
    for r in sorted(routes, key=lambda r: r.start):
        low, high = max(first, r.start), min(end, r.end + overlap_ms if r.end < end else r.end)
        if low < high:
            out.append(Route(r.name, low, high, r.load))
    return out


def route_filter(df: DataFrame, route: Route, window_ms: int = 0, forward: bool = True, query_end: int | None = None) -> DataFrame:
    """Samples of ``t, v`` whose bucket touches the route: forward buckets are [t, t+w), backward ones [t-w, t), points [start, end) with the end itself only at
    the query's end."""
    t = F.col("t")
    if not window_ms:
        at_end = (t == route.end) if query_end is not None and route.end == query_end else F.lit(False)
        return df.where(((t >= route.start) & (t < route.end)) | at_end)
    low, high = (t, t + window_ms) if forward else (t - window_ms, t)
    return df.where((low < route.end) & (high > route.start))


def merge_average(parts: list[tuple[DataFrame, Route | None]], labels: list[str], window_ms: int, query_end: int | None = None) -> DataFrame:
    """Averages of several routes weighted by how much of each bucket [t, t+w) the route covers. Samples without a route weigh a whole bucket; those
    whose bucket the route doesn't touch are used (as a plain mean) only where nothing else is there; the last bucket of the query weighs whole."""
    rows = []
    for df, route in parts:
        if route is None:
            weight = F.lit(float(window_ms))
        else:
            weight = F.greatest(F.least(F.col("t") + window_ms, F.lit(route.end)) - F.greatest(F.col("t"), F.lit(route.start)), F.lit(0)).cast("double")
            if query_end is not None:
                weight = F.when((F.col("t") + window_ms >= query_end) & (F.col("t") >= route.start), F.lit(float(window_ms))).otherwise(weight)
        rows.append(df.select(*labels, "t", "v", weight.alias("w")))
    merged = reduce(DataFrame.unionByName, rows).groupBy(*labels, "t")
    sums = merged.agg(F.sum("w").alias("w"), F.sum(F.col("v") * F.col("w")).alias("vw"), F.avg("v").alias("plain"))
    return sums.select(*labels, "t", F.when(F.col("w") > 0, F.col("vw") / F.col("w")).otherwise(F.col("plain")).alias("v"))


def prefer_first(parts: list[DataFrame], keys: list[str]) -> DataFrame:
    """Of rows with equal keys the one of the earliest part: later parts only fill gaps."""
    ranked = reduce(DataFrame.unionByName, [p.withColumn("_part", F.lit(i)) for i, p in enumerate(parts)])
    return ranked.withColumn("_k", F.row_number().over(W.partitionBy(*keys).orderBy("_part"))).where("_k = 1").drop("_k", "_part")


def partial(loaders: dict[str, Callable[[], DataFrame]]) -> tuple[list[DataFrame], dict[str, str]]:
    """What could be read of several sources, and the errors of those that couldn't; an error if none could."""
    done, failed = [], {}
    for name, load in loaders.items():
        try:
            done.append(load())
        except Exception as e:  # noqa: BLE001 - any source error is a partial result
            failed[name] = str(e)
    if failed and not done:
        raise RuntimeError("all sources failed: " + "; ".join(f"{k}: {v}" for k, v in failed.items()))
    return done, failed
