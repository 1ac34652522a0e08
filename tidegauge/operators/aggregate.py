"""Storage-level aggregation: buckets, terms, histograms, percentiles, collapse, nested documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidegauge.functions.timeutil import bucket_ms

# Names that mean the same aggregate.
ALIASES = {"mean": "avg", "value_count": "count", "cardinality": "count_distinct", "std": "stddev_samp", "stddev": "stddev_samp", "std_over_time": "stddev_samp"}


def aggregate_of(name: str, value: Column) -> Column:
    """An aggregate by name; '<x>_over_time' means <x> of the raw samples; other names are Spark's own."""
    n = name.lower()
    n = ALIASES.get(n, n)
    if n.endswith("_over_time"):
        n = n.removesuffix("_over_time")
        n = ALIASES.get(n, n)
    if n in ("count_distinct",):
        return F.count_distinct(value)
    if n == "approx_count_distinct":
        return F.approx_count_distinct(value)
    return F.call_function(n, value)


def grouped(df: DataFrame, dims: list[str], fn: str, value: str, window_ms: int | None = None, at: str | None = None, offset_ms: int = 0) -> DataFrame:
    """``dims [, _time], _value``: one aggregate per group and time bucket; value '*' counts rows."""
    keys: list[Column] = [F.col(d) for d in dims]
    if window_ms:
        keys.append(bucket_ms(F.col(at), window_ms, offset_ms).alias("_time"))
    v = F.lit(1) if value == "*" else F.col(value)
    return df.groupBy(*keys).agg(aggregate_of("count" if value == "*" else fn, v).alias("_value"))


#: Of a sampled function with an outer aggregate, the one aggregate over raw samples that gives the same.
PUSHED = {("min", "min_over_time"): "min", ("max", "max_over_time"): "max", ("sum", "sum_over_time"): "sum", ("sum", "count_over_time"): "count", ("count", "count_over_time"): "count", ("avg", "avg_over_time"): "avg", ("mean", "avg_over_time"): "avg"}


def pushed_down(outer: str, sampled: str) -> str | None:
    return PUSHED.get((outer, sampled))


def filled(df: DataFrame, dims: list[str], start: int, end: int, window_ms: int, fill: float | None = 0.0) -> DataFrame:
    """Every bucket in [start, end) for every group that occurs; missing ones get ``fill`` (None: stay null). The grid is generated per group, not joined across."""
    first = start - start % window_ms
    stop = end - 1 - (end - 1) % window_ms
    grid = df.select(*dims).distinct().withColumn("_time", F.explode(F.sequence(F.lit(first).cast("long"), F.lit(stop).cast("long"), F.lit(window_ms).cast("long"))))
    out = grid.join(df, [*dims, "_time"], "left")
    return out if fill is None else out.withColumn("_value", F.coalesce("_value", F.lit(fill)))


def histogram(df: DataFrame, at: str, window_ms: int, dims: list[str] | None = None, min_doc_count: int = 0, bounds: tuple[int, int] | None = None) -> DataFrame:
    """``dims, _time, doc_count`` of a date histogram; with min_doc_count 0 empty buckets between the bounds (or the data's ends) count 0."""
    dims = dims or []
    counts = df.where(F.col(at).isNotNull()).groupBy(*dims, bucket_ms(F.col(at), window_ms).alias("_time")).agg(F.count(F.lit(1)).alias("doc_count"))
    if min_doc_count > 0:
        return counts.where(F.col("doc_count") >= min_doc_count)
    if bounds:
        low, high = (F.lit(b - b % window_ms).cast("long") for b in bounds)
        ends = counts.groupBy(*dims).agg(F.least(F.min("_time"), low).alias("a"), F.greatest(F.max("_time"), high).alias("b"))
    else:
        ends = counts.groupBy(*dims).agg(F.min("_time").alias("a"), F.max("_time").alias("b"))
    grid = ends.where("a is not null").select(*dims, F.explode(F.sequence("a", "b", F.lit(window_ms).cast("long"))).alias("_time"))
    return grid.join(counts, [*dims, "_time"], "left").withColumn("doc_count", F.coalesce("doc_count", F.lit(0)).cast("long"))


def terms(df: DataFrame, columns: list[str], sizes: list[int], order: Column | None = None, missing: str | None = " ", metric: Column | None = None, include: list | None = None) -> DataFrame:
    """Nested terms: of each level the ``size`` largest groups (by document count, or by ``order`` over doc_count and metric), ties by value. ``missing``
    stands for null; with None rows without a value are left out. ``include`` keeps only these values of the first level."""
    for c in columns:
        df = df.withColumn(c, F.coalesce(F.col(c).cast("string"), F.lit(missing))) if missing is not None else df.where(F.col(c).isNotNull())
    if include:
        df = df.where(F.col(columns[0]).isin(include))
    measure = [metric.alias("metric")] if metric is not None else []
    rank = order if order is not None else F.col("doc_count").desc()
    kept: DataFrame | None = None
    for i, size in enumerate(sizes):
        path = columns[: i + 1]
        rows = df if kept is None else df.join(F.broadcast(kept), columns[:i], "left_semi") if _small(sizes[:i]) else df.join(kept, columns[:i], "left_semi")
        level = rows.groupBy(*path).agg(F.count(F.lit(1)).alias("doc_count"), *measure)
        w = W.partitionBy(*columns[:i]).orderBy(rank, F.col(columns[i])) if i else W.orderBy(rank, F.col(columns[i]))
        level = level.orderBy(rank, F.col(columns[i])).limit(size) if not i else level.withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= size).drop("_k")
        kept = level
    return kept


def _small(sizes: list[int]) -> bool:
    """A level has at most the product of the sizes above it: that bound decides whether it is broadcast."""
    product = 1
    for s in sizes:
        product *= s
    return product <= 100_000


def percentiles(df: DataFrame, dims: list[str], value: str, percents: list[float], exact: bool = True) -> DataFrame:
    """``dims, percent, _value``: one row per percent."""
    fractions = F.array(*[F.lit(p / 100.0) for p in percents])
    q = F.percentile(F.col(value), fractions) if exact else F.percentile_approx(F.col(value), fractions, 10_000)
    pairs = F.explode(F.arrays_zip(F.array(*[F.lit(float(p)) for p in percents]).alias("percent"), F.col("q").alias("_value")))
    return df.groupBy(*dims).agg(q.alias("q")).select(*dims, pairs.alias("x")).select(*dims, F.col("x.percent").alias("percent"), F.col("x._value").alias("_value"))


def collapse(df: DataFrame, by: str, order: list[Column]) -> DataFrame:
    """The first row, in the order given, of each value of ``by``; rows without a value are one group."""
    return df.withColumn("_k", F.row_number().over(W.partitionBy(by).orderBy(*order))).where("_k = 1").drop("_k")


def nested(df: DataFrame, array: str, doc_id: str, dims: list[str], inner: list[str]) -> DataFrame:
    """Group by fields of nested documents: ``doc_count`` counts nested ones, ``parent_count`` the documents that hold them."""
    flat = df.select(doc_id, *dims, F.explode(array).alias("_n")).select(doc_id, *dims, *[F.col(f"_n.{c}").alias(c) for c in inner])
    return flat.groupBy(*dims, *inner).agg(F.count(F.lit(1)).alias("doc_count"), F.count_distinct(doc_id).alias("parent_count"))
