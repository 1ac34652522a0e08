"""Equi-joins that hold when single key values carry a large share of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key value is heavy if it has more than a thousandth of all rows: fewer than a thousand values can be heavy, which bounds what is broadcast.
HEAVY_SHARE = 1000


def lookup(left: DataFrame, entries: DataFrame, keys: list[str], weight: str, total: int) -> DataFrame:
    """Inner join of ``left`` with ``entries`` (one row per key) whose column ``weight`` holds how many of the ``total`` rows
    of ``left`` have that key. Rows of heavy keys meet a broadcast of at most ``HEAVY_SHARE`` entries and are not shuffled;
    all others are joined by shuffle. Null keys match nothing."""
    bound = total / HEAVY_SHARE
    value = [c for c in entries.columns if c not in (*keys, weight)]
    heavy = F.broadcast(entries.where(F.col(weight) > bound).select(*keys, *value))
    light = entries.where(F.col(weight) <= bound).select(*keys, *value)
    tagged = left.join(heavy.select(*keys), keys, "left_anti").join(light, keys)
    return left.join(heavy, keys).unionByName(tagged)
