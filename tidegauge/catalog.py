"""Tables by name: time column, fields, aliases, tenants and storage routes."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegauge.functions.timeutil import bounded, to_ms
from tidegauge.operators.conditions import Condition, compile_dnf, dnf_and
from tidegauge.operators.merge import Route, prefer_first, segments


@dataclass
class TableMeta:
    """A result table. ``load`` reads it; ``filters`` (OR of ANDs) are what its tenant may see; ``aliases`` maps query names to columns; ``routes`` are its storage segments;
    ``rollups`` are coarser copies by window (ms)."""

    name: str
    load: Callable[[], DataFrame] | None = None
    time_column: str = "time"
    time_unit: str = "ms"
    values: list[str] = field(default_factory=list)
    tags: list[str] = field(default_factory=list)
    labels: dict[str, str] = field(default_factory=dict)
    aliases: dict[str, str] = field(default_factory=dict)
    filters: list[list[Condition]] = field(default_factory=list)
    routes: list[Route] = field(default_factory=list)
    rollups: dict[int, Callable[[], DataFrame]] = field(default_factory=dict)
    storage: str = "parquet"
    bounds: str = "[)"


class Catalog:
    """What names mean: metrics to tables, labels to tables, per space."""

    def __init__(self, tables: list[TableMeta] | None = None):
        self.tables = {t.name: t for t in tables or []}

    def add(self, table: TableMeta) -> None:
        self.tables[table.name] = table

    def __getitem__(self, name: str) -> TableMeta:
        if name not in self.tables:
            raise KeyError(f"no table: {name!r}")
        return self.tables[name]

    def resolve(self, metric: str | None = None, pattern: str | None = None, labels: dict[str, str] | None = None) -> list[TableMeta]:
        """Tables that hold a metric (by name or regular expression) and carry all the labels."""
        out = []
        for t in self.tables.values():
            by_name = metric is None or metric in t.values
            by_pattern = pattern is None or any(re.fullmatch(pattern, v) for v in t.values)
            if by_name and by_pattern and all(t.labels.get(k) == v for k, v in (labels or {}).items()):
                out.append(t)
        return out

    def scan(self, name: str, start: int, end: int, groups: list[list[Condition]] | None = None, window_ms: int = 0, look_back_ms: int = 0, null_semantics: str = "sql") -> DataFrame:
        """Rows of [start, end) ms: segments cut and united (where two hold the same row the earlier counts), the tenant's filter and the conditions applied, a ``_time`` (ms) added.
        With ``window_ms`` the coarsest rollup that divides it is read instead."""
        t = self[name]
        parts = []
        if t.routes:
            for r in segments(t.routes, start, end, look_back_ms=look_back_ms):
                part = r.load()
                at = to_ms(F.col(t.time_column), t.time_unit)
                parts.append(part.where(bounded(at, r.start, r.end, t.bounds)))
            if not parts:
                raise LookupError(f"no storage holds {name} in this range")
            df = parts[0] if len(parts) == 1 else prefer_first(parts, [t.time_column, *t.tags])
        else:
            fit = [w for w in t.rollups if window_ms and window_ms % w == 0]
            df = (t.rollups[max(fit)] if fit else t.load)()
        df = df.withColumns({a: F.col(c) for a, c in t.aliases.items() if a not in df.columns})
        df = df.withColumn("_time", to_ms(F.col(t.time_column), t.time_unit))
        df = df.where(bounded(F.col("_time"), start - look_back_ms, end, t.bounds))
        return df.where(compile_dnf(df, dnf_and(t.filters, groups or []), null_semantics))

    def physical(self, name: str, fields: list[str]) -> list[str]:
        t = self[name]
        return [t.aliases.get(f, f) for f in fields]


def series_of(df: DataFrame, metric: str, tags: list[str], at_ms: Column, value: Column) -> DataFrame:
    """A table as ``labels, t, v``: the form that PromQL reads. Null tags have no label, null values are no samples."""
    pairs = F.create_map(F.lit("__name__"), F.lit(metric), *[x for t in tags for x in (F.lit(t), F.col(t).cast("string"))])
    rows = df.select(F.map_filter(pairs, lambda _, v: v.isNotNull()).alias("labels"), at_ms.alias("t"), value.cast("double").alias("v"))
    return rows.where("t is not null and v is not null")
