"""Overlapping, nested and gapped intervals per entity: continuous periods and the gaps between them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def to_us(value: Column) -> Column:
    """An instant given in s, ms, us or ns since 1970, as whole microseconds; the unit follows from the
    magnitude (instants between 1973 and 5138), finer digits are cut off."""
    size = F.abs(value)
    return (
        F.when(size >= 100_000_000_000_000_000, F.floor(value / F.lit(1000).cast("decimal(4,0)")).cast("long"))
        .when(size >= 100_000_000_000_000, value)
        .when(size >= 100_000_000_000, value * 1000)
        .otherwise(value * 1_000_000)
    )


def merge_periods(df: DataFrame, key: str, start: str, end: str, bucket_us: int = 1_000_000) -> DataFrame:
    """Continuous periods per ``key``: ``key, bucket, period_start, period_end, reached, next_start, n``, all times in us.

    Each interval is a session of its own length; Spark's ``session_window`` merges those that overlap. Sessions are merged per key and start bucket, so a key with a
    third of all rows is spread over as many tasks as it has buckets. Across buckets travels one row per bucket and key (so at most one per second of a key's time): ``reached`` is the latest end of
    all earlier periods of the key (null for the first), ``next_start`` (``lead``) the start of the period after (null for the last). A period whose start is not after
    ``reached`` continues the one before it; periods that only touch count as continuous.

    Null keys, null times and intervals that do not end after their start cover nothing and are left out.
    An empty table gives an empty result. Other columns are ignored."""
    spans = df.select(F.col(key).alias("key"), F.col(start).alias("s"), F.col(end).alias("e")).where(
        F.col("key").isNotNull() & (F.col("e") > F.col("s"))
    )
    length = F.make_interval(secs=((F.col("e") - F.col("s")) / F.lit(1_000_000).cast("decimal(7,0)")).cast("decimal(18,6)"))
    sessions = (
        spans.withColumn("bucket", F.floor(F.col("s") / bucket_us).cast("long"))
        .withColumn("at", F.timestamp_micros("s"))
        .groupBy("key", "bucket", F.session_window("at", length).alias("w"))
        .agg(F.count(F.lit(1)).alias("n"))
        .select("key", "bucket", F.unix_micros("w.start").alias("s"), F.unix_micros("w.end").alias("e"), "n")
    )
    per_bucket = sessions.groupBy("key", "bucket").agg(F.min("s").alias("bucket_start"), F.max("e").alias("bucket_end"))
    along = W.partitionBy("key").orderBy("bucket")
    carried = per_bucket.select(
        "key", "bucket", F.max("bucket_end").over(along.rowsBetween(W.unboundedPreceding, -1)).alias("carry"), F.lead("bucket_start").over(along).alias("after")
    )
    inside = W.partitionBy("key", "bucket").orderBy("s")
    return (
        sessions.join(carried, ["key", "bucket"])
        .withColumn("reached", F.greatest("carry", F.lag("e").over(inside)))
        .withColumn("next_start", F.coalesce(F.lead("s").over(inside), "after"))
        .select(F.col("key").alias(key), "bucket", F.col("s").alias("period_start"), F.col("e").alias("period_end"), "reached", "next_start", "n")
    )


def gaps(periods: DataFrame, key: str) -> DataFrame:
    """Gaps of more than zero us between the periods of ``merge_periods``: ``key, gap_start, gap_end``. A gap opens where all that began before has
    ended, and closes with the next start (``lead``), if that is later."""
    covered = F.greatest("reached", "period_end")
    return periods.where(F.col("next_start") > covered).select(key, covered.alias("gap_start"), F.col("next_start").alias("gap_end"))


def busy_periods(periods: DataFrame, key: str) -> DataFrame:
    """One row per continuous period: ``key, period_start, period_end, n_intervals``.

    Pieces that bucket borders cut or that only touch are joined: each piece after a gap opens a period. Periods are numbered within their bucket, and pieces before a bucket's first
    opening go to the last period of the latest bucket that has one, so that no task holds more than a key's rows of one bucket, or one row for each of its buckets."""
    opening = (F.col("reached").isNull() | (F.col("period_start") > F.col("reached"))).cast("int")
    inside = W.partitionBy(key, "bucket").orderBy("period_start").rowsBetween(W.unboundedPreceding, 0)
    placed = periods.withColumn("place", F.sum(opening).over(inside))
    pieces = placed.groupBy(key, "bucket", "place").agg(F.min("period_start").alias("s"), F.max("period_end").alias("e"), F.sum("n").alias("n"))
    opened = pieces.groupBy(key, "bucket").agg(F.max("place").alias("last"))
    before = W.partitionBy(key).orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    mark = F.when(F.col("last") > 0, F.struct(F.col("bucket").alias("b"), F.col("last").alias("p")))
    owners = opened.select(key, "bucket", F.last(mark, ignorenulls=True).over(before).alias("owner"))
    mine = F.col("place") > 0
    owned = pieces.join(owners, [key, "bucket"]).select(key, "s", "e", "n",
        F.when(mine, F.col("bucket")).otherwise(F.col("owner.b")).alias("b"), F.when(mine, F.col("place")).otherwise(F.col("owner.p")).alias("p"))
    return owned.groupBy(key, "b", "p").agg(F.min("s").alias("period_start"), F.max("e").alias("period_end"), F.sum("n").alias("n_intervals")).drop("b", "p")
