"""Raw rows: ordering, paging, cursors, slices, highlighting, flattening."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidegauge.session import drop_path, materialise, scratch


def ordering(df: DataFrame, keys: list[str], aliases: dict[str, str] | None = None) -> list[Column]:
    """'-f' descends; nulls last when ascending, first when descending; '_value' and '_time' stand for ``aliases``. Texts that are numbers sort as numbers."""
    out = []
    for k in keys:
        name = (aliases or {}).get(k.lstrip("-"), k.lstrip("-"))
        c = F.col(name)
        parts = [c.try_cast("double"), c] if isinstance(df.schema[name].dataType, T.StringType) else [c]
        out += [x.desc_nulls_first() if k.startswith("-") else x.asc_nulls_last() for x in parts]
    return out


def page(df: DataFrame, order: list[Column], offset: int, limit: int) -> DataFrame:
    """One page of the rows in a total order (add a unique key to it)."""
    return df.orderBy(*order).offset(offset).limit(limit)


def compose_limits(own: tuple[int | None, int], asked: tuple[int | None, int], default: int | None = 10_000) -> tuple[int | None, int]:
    """(limit, offset) of a query that has its own, within a request that has others: offsets add, the smaller limit holds, cut to what the inner one leaves. Where neither has a limit, ``default`` (None: no limit)."""
    (own_limit, own_offset), (limit, offset) = own, asked
    left = None if own_limit is None else max(own_limit - offset, 0)
    some = [x for x in (left, limit) if x is not None]
    return (min(some) if some else default), own_offset + offset


def after(df: DataFrame, keys: list[str], last: list) -> DataFrame:
    """Keyset paging: the rows behind ``last`` in ascending order of the (unique) keys; '-k' descends."""
    ways = []
    for i, (k, v) in enumerate(zip(keys, last, strict=True)):
        name = k.lstrip("-")
        step = F.col(name) < F.lit(v) if k.startswith("-") else F.col(name) > F.lit(v)
        same = [F.col(a.lstrip("-")) == F.lit(b) for a, b in zip(keys[:i], last[:i], strict=True)]
        ways.append(reduce(lambda a, b: a & b, same, step))
    return df.where(reduce(lambda a, b: a | b, ways))


def slice_of(df: DataFrame, key: str, number: int, slices: int) -> DataFrame:
    """One of ``slices`` disjoint parts of a scroll, by hash of a key."""
    return df.where(F.pmod(F.xxhash64(key), F.lit(slices)) == number)


def consumed(page_rows: DataFrame, table: str) -> DataFrame:
    """How many rows of each table a merged page has used up: what the next request passes back."""
    return page_rows.groupBy(table).agg(F.count(F.lit(1)).alias("consumed"))


def limit_series(df: DataFrame, labels: list[str], points: int | None = None, series: int | None = None) -> DataFrame:
    """At most ``points`` samples of each series (the earliest) and the first ``series`` series in order of their labels."""
    if series is not None:
        first = df.select(*labels).distinct().orderBy(*labels).limit(series)
        df = df.join(first, labels, "left_semi")
    if points is not None:
        df = df.withColumn("_k", F.row_number().over(W.partitionBy(*labels).orderBy("t"))).where(F.col("_k") <= points).drop("_k")
    return df


def order_series(df: DataFrame, labels: list[str], keys: list[str]) -> DataFrame:
    """Adds ``rank``: the place of each series by its last value ('_value') or by labels; '-' descends; ties by all labels."""
    last = df.groupBy(*labels).agg(F.max_by("v", "t").alias("_value"))
    order = [F.col(k.lstrip("-")).desc() if k.startswith("-") else F.col(k).asc() for k in keys] + [F.col(c) for c in labels]
    # Ranges of the order are numbered apart, and then moved by the sizes of the ranges before (one row each).
    parts = materialise(last.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "ranks")
    sizes = parts.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    ahead = sizes.select("_part", F.coalesce(F.sum("_n").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_ahead"))
    within = F.row_number().over(W.partitionBy("_part").orderBy(*order))
    ranked = parts.withColumn("_k", within).join(ahead, "_part").withColumn("rank", (F.col("_k") + F.col("_ahead")).cast("int"))
    return df.join(ranked.select(*labels, "rank"), labels)


def keyword_regex(keywords: list[str]) -> str:
    """One expression for all keywords, longest first; * and ? are wildcards within a word."""
    parts = [re.escape(k).replace(r"\*", r"\w*").replace(r"\?", r"\w") for k in sorted(set(keywords), key=len, reverse=True) if k]
    return "|".join(parts)


def _apart(keywords: list[str]) -> bool:
    """Whether finds of different keywords can't overlap: no wildcards, none within another, none beginning as another ends."""
    words = sorted({k.lower() for k in keywords})
    if any(c in k for k in words for c in "*?"):
        return False
    return not any(a != b and (a in b or any(a.endswith(b[:n]) for n in range(1, len(b)))) for a in words for b in words)


def highlight(df: DataFrame, columns: list[str], keywords: list[str]) -> DataFrame:
    """Adds ``__highlight``: of each column that holds keywords the whole text with <mark> around them, overlapping and adjacent finds merged. Keywords that can't overlap are marked by one
    expression in the engine; others by a vectorised function, which is given only the texts that hold one."""
    keywords = [k for k in dict.fromkeys(keywords) if k]
    any_of = "(?i)" + keyword_regex(keywords)
    if _apart(keywords):
        marked = lambda c: F.regexp_replace(c, f"(?i)((?:{keyword_regex(keywords)})+)", "<mark>$1</mark>")
    else:
        singles = [re.compile(keyword_regex([k]), re.I) for k in keywords]

        @F.pandas_udf("string")
        def by_spans(s: pd.Series) -> pd.Series:
            return s.map(lambda t: mark(t, singles), na_action="ignore").astype(object).where(s.notna(), None)

        marked = lambda c: by_spans(F.when(c.rlike(any_of), c))
    if not keywords:
        return df.withColumn("__highlight", F.create_map().cast("map<string,string>"))
    pieces = [F.when(F.col(c).rlike(any_of), F.struct(F.lit(c).alias("key"), marked(F.col(c)).alias("value"))) for c in columns]
    return df.withColumn("__highlight", F.map_from_entries(F.array_compact(F.array(*pieces))))


def mark(text: str, patterns: list[re.Pattern], longest: int | None = None) -> str:
    """``text`` with <mark> around what the patterns find, in its first ``longest`` characters if that is asked for."""
    head = text[:longest]
    spans: list[list[int]] = []
    for a, b in sorted(m.span() for p in patterns for m in p.finditer(head) if m.end() > m.start()):
        if spans and a <= spans[-1][1]:
            spans[-1][1] = max(spans[-1][1], b)
        else:
            spans.append([a, b])
    out, at = [], 0
    for a, b in spans:
        out += [text[at:a], "<mark>", text[a:b], "</mark>"]
        at = b
    return "".join([*out, text[at:]])


def flattened(df: DataFrame, sep: str = ".") -> DataFrame:
    """Nested structs as dotted columns."""

    def walk(kind: T.StructType, prefix: str, col: Column | None) -> Iterator[Column]:
        for f in kind.fields:
            c = F.col(f"`{f.name}`") if col is None else col[f.name]
            name = prefix + f.name
            if isinstance(f.dataType, T.StructType):
                yield from walk(f.dataType, name + sep, c)
            else:
                yield c.alias(name)

    return df.select(*walk(df.schema, "", None))


def lttb_points(t: np.ndarray, v: np.ndarray, threshold: int) -> np.ndarray:
    """Places of the points that largest-triangle-three-buckets keeps."""
    n = len(t)
    if threshold >= n or threshold < 3:
        return np.arange(n)
    edges = np.floor(np.arange(threshold - 1) * (n - 2) / (threshold - 2)).astype(int) + 1
    kept, at = [0], 0
    for i in range(threshold - 2):
        low, high = edges[i], edges[i + 1]
        after_low, after_high = high, edges[i + 2] if i + 2 < len(edges) else n
        tm, vm = t[after_low:after_high].mean(), v[after_low:after_high].mean()
        area = np.abs((t[at] - tm) * (v[low:high] - v[at]) - (t[at] - t[low:high]) * (vm - v[at]))
        at = low + int(np.argmax(area))
        kept.append(at)
    return np.array([*kept, n - 1])


def lttb(df: DataFrame, labels: list[str], threshold: int) -> DataFrame:
    """``labels, t, v`` with at most ``threshold`` points per series (a series of an answer, so of bounded length)."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("t")
        return pdf.iloc[lttb_points(pdf.t.to_numpy(float), pdf.v.to_numpy(float), threshold)]

    return df.select(*labels, "t", "v").groupBy(*labels).applyInPandas(one, df.select(*labels, "t", "v").schema)


def lttb_threshold(points: int, step_ms: int, range_ms: int) -> int:
    return -(-points * step_ms // range_ms) if range_ms else points


def realigned(df: DataFrame, labels: list[str], start: int, step_ms: int) -> DataFrame:
    """Points moved to an even grid by their place within the series."""
    place = F.row_number().over(W.partitionBy(*labels).orderBy("t")) - 1
    return df.withColumn("t", (F.lit(start) + place * step_ms).cast("long"))


def shaped(df: DataFrame, value: str = "v", nulls: float | None = None, keep_nan: bool = False) -> DataFrame:
    """Values as an answer gives them: null instead of NaN (unless kept), or a fixed number instead of both."""
    v = F.col(value)
    v = v if keep_nan else F.when(~F.isnan(v), v)
    return df.withColumn(value, F.coalesce(v, F.lit(nulls)) if nulls is not None else v)


class ScrollSession:
    """A scroll over a snapshot of rows: written once, parted into ``slices`` by hash of a key, each read page by page in order of the (unique) keys. One reader at a time holds a slice's lock; a session
    that nobody has asked for ``ttl_s`` is closed and its snapshot deleted. Times are given by the caller (epoch seconds)."""

    def __init__(self, df: DataFrame, keys: list[str], slices: int, ttl_s: int, now: float):
        self.spark, self.keys, self.slices, self.ttl_s = df.sparkSession, keys, slices, ttl_s
        self.path = scratch(self.spark, "scroll")
        part = F.pmod(F.xxhash64(*keys), F.lit(slices)).cast("int")
        df.withColumn("_slice", part).write.partitionBy("_slice").parquet(self.path)
        self.schema, self.last, self.done, self.locked, self.until = df.schema, {}, set(), set(), now + ttl_s

    def alive(self, now: float) -> bool:
        return now <= self.until

    def lock(self, number: int) -> bool:
        """Whether the slice was free; it is the caller's now."""
        free = number not in self.locked
        self.locked.add(number)
        return free

    def unlock(self, number: int) -> None:
        self.locked.discard(number)

    def page(self, number: int, size: int, now: float) -> DataFrame | None:
        """The next ``size`` rows of a slice; nothing once it is finished. Each call keeps the session alive."""
        if not self.alive(now):
            self.close()
            raise TimeoutError("the scroll has expired")
        if number in self.done or not 0 <= number < self.slices:
            return None
        self.until = now + self.ttl_s
        kept = self.spark.read.parquet(self.path).where(F.col("_slice") == number).drop("_slice")
        kept = kept if number not in self.last else after(kept, self.keys, self.last[number])
        rows = materialise(page(kept.select(*self.schema.names), [F.col(k) for k in self.keys], 0, size), "page")
        end = rows.orderBy(*[F.col(k).desc() for k in self.keys]).limit(1).collect()
        count = rows.count()
        if end:
            self.last[number] = [end[0][k] for k in self.keys]
        if count < size:
            self.done.add(number)
        return rows if count else None

    def close(self) -> None:
        drop_path(self.spark, self.path)


def next_page(tables: dict[str, DataFrame], keys: list[str], cursors: dict[str, list | None], size: int) -> tuple[DataFrame | None, dict[str, list | None]]:
    """Keyset paging over several tables: the next ``size`` rows of each behind its cursor (none yet: from the beginning; None: the table is finished and isn't asked), with ``__table``, and the new cursors."""
    parts, new = [], dict(cursors)
    for name, df in tables.items():
        if name in cursors and cursors[name] is None:
            continue
        rest = after(df, keys, cursors[name]) if name in cursors else df
        rows = materialise(page(rest, [F.col(k) for k in keys], 0, size), "page")
        end = rows.orderBy(*[F.col(k).desc() for k in keys]).limit(1).collect()
        new[name] = [end[0][k] for k in keys] if end and rows.count() == size else None
        parts.append(rows.withColumn("__table", F.lit(name)))
    return (reduce(DataFrame.unionByName, parts) if parts else None), new
