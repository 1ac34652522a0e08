"""Structured queries (JSON) and the calls of the query API: plan, run, translate to PromQL and back, metadata."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegauge.catalog import Catalog, series_of
from tidegauge.functions.timeutil import align_ms, duration_ms, request_time_ms, zone_offset_ms
from tidegauge.operators.aggregate import filled, grouped
from tidegauge.operators.conditions import Condition, as_matcher, dnf
from tidegauge.operators.merge import partial, union_all
from tidegauge.operators.rawrows import compose_limits, highlight, ordering
from tidegauge.plans import lucene
from tidegauge.plans.promql import evaluate, parse
from tidegauge.plans.promql.parser import Node, folded, selectors, write


@dataclass
class Query:
    """One entry of a query list."""

    table: str
    value: str
    reference: str = "a"
    groups: list[list[Condition]] = field(default_factory=list)
    functions: list[dict] = field(default_factory=list)
    time_aggregation: dict = field(default_factory=dict)
    query_string: str = ""
    dimensions: list[str] = field(default_factory=list)
    keep: list[str] = field(default_factory=list)
    limit: int | None = None
    offset: int = 0
    order: list[str] = field(default_factory=list)
    shift: str = ""

    @classmethod
    def of(cls, raw: dict) -> Query:
        c = raw.get("conditions") or {}
        groups = dnf([Condition.of(x) for x in c.get("field_list", [])], list(c.get("condition_list", [])))
        return cls(raw["table_id"], raw.get("field_name", "*"), raw.get("reference_name", "a"), groups, list(raw.get("function", [])), dict(raw.get("time_aggregation") or {}),
                   raw.get("query_string", ""), list(raw.get("dimensions", [])), list(raw.get("keep_columns", [])), raw.get("limit"), int(raw.get("from", 0)), list(raw.get("order_by", [])), raw.get("offset", ""))


@dataclass
class Request:
    """A whole structured request; times in ms."""

    queries: list[Query]
    merge: str
    start: int
    end: int
    step: int = 60_000
    zone: str = "UTC"
    instant: bool = False
    order: list[str] = field(default_factory=list)
    limit: int | None = None
    offset: int = 0

    @classmethod
    def of(cls, raw: dict) -> Request:
        queries = [Query.of(q) for q in raw["query_list"]]
        return cls(queries, raw.get("metric_merge") or queries[0].reference, request_time_ms(raw["start_time"]), request_time_ms(raw["end_time"]), duration_ms(raw.get("step") or "1m"),
                   raw.get("timezone") or "UTC", bool(raw.get("instant")), list(raw.get("order_by", [])), raw.get("limit"), int(raw.get("from", 0)))

    @property
    def aligned_start(self) -> int:
        return align_ms(self.start, self.step, self.zone)


def metric_name(q: Query) -> str:
    """The name of a query's series inside PromQL."""
    return re.sub(r"\W", "_", f"{q.table}:{q.value}").replace("__", "_")


def to_promql(request: Request) -> str:
    """The request as PromQL: each reference is replaced by its query's expression."""
    texts = {}
    for q in request.queries:
        if len(q.groups) > 1:
            raise ValueError("alternatives of conditions can't be written as PromQL")
        matchers = [as_matcher(c) for g in q.groups for c in g]
        node = Node("selector", metric_name(q), matchers=[("__name__", "=", metric_name(q)), *matchers])
        if q.shift:
            node.offset_ms = duration_ms(q.shift)
        if q.time_aggregation:
            node.range_ms = duration_ms(q.time_aggregation["window"])
            extra = [Node("number", float(a)) for a in q.time_aggregation.get("vargs_list", [])]
            node = Node("call", q.time_aggregation["function"], [*extra, node] if q.time_aggregation["function"] == "quantile_over_time" else [node, *extra])
        for f in q.functions:
            name = {"mean": "avg"}.get(f["method"], f["method"])
            node = Node("aggregate", name, [*[Node("number", float(a)) for a in f.get("vargs_list", [])], node], labels=list(f.get("dimensions", [])), without=bool(f.get("without")))
        texts[q.reference] = node
    return write(_substituted(parse(request.merge), texts))


def _substituted(n: Node, by: dict[str, Node]) -> Node:
    if n.kind == "selector" and n.value in by and len(n.matchers) == 1:
        return by[n.value]
    n.args = [_substituted(a, by) for a in n.args]
    return n


def from_promql(text: str, table: str = "") -> dict:
    """PromQL as a structured request's query list: one query per selector, the rest as ``metric_merge``."""
    tree = folded(parse(text))
    queries = []
    ops = {"=": "eq", "!=": "ne", "=~": "req", "!~": "nreq"}
    for i, s in enumerate(selectors(tree)):
        name = next((v for a, op, v in s.matchers if a == "__name__"), "")
        fields = [{"field_name": a, "op": ops[op], "value": [v]} for a, op, v in s.matchers if a != "__name__"]
        q = {"table_id": table, "field_name": name, "reference_name": chr(97 + i), "conditions": {"field_list": fields, "condition_list": ["and"] * max(len(fields) - 1, 0)}}
        if s.offset_ms:
            q["offset"] = f"{s.offset_ms}ms"
        s.value, s.matchers, s.offset_ms = q["reference_name"], [("__name__", "=", q["reference_name"])], 0
        queries.append(q)
    return {"query_list": queries, "metric_merge": write(tree)}


def run_series(catalog: Catalog, request: Request) -> DataFrame:
    """``labels, t, v``: range or instant evaluation of the request over the catalog's tables."""
    text = to_promql(request)
    reach = max([0, *[s.range_ms or 0 for s in selectors(parse(text))]]) + 300_000
    parts = []
    for q in request.queries:
        t = catalog[q.table]
        shift = duration_ms(q.shift) if q.shift else 0
        df = catalog.scan(q.table, request.aligned_start - reach - shift, request.end + 1, q.groups)
        if q.query_string:
            df = df.where(lucene.compile_query(df, q.query_string))
        parts.append(series_of(df, metric_name(q), t.tags, F.col("_time"), F.col(q.value)))
    series = reduce(DataFrame.unionByName, parts)
    at = request.end if request.instant else request.aligned_start
    return evaluate(series, text, at, request.end, request.step)


def run_reference(catalog: Catalog, request: Request, fill: bool = False) -> DataFrame:
    """Reference mode: every function is done by the storage. ``dims, _time, _value`` of the first query."""
    q = request.queries[0]
    df = catalog.scan(q.table, request.start, request.end, q.groups)
    if q.query_string:
        df = df.where(lucene.compile_query(df, q.query_string))
    f = q.functions[0] if q.functions else {"method": "count"}
    window = duration_ms(f["window"]) if f.get("window") else (duration_ms(q.time_aggregation["window"]) if q.time_aggregation else None)
    offset = zone_offset_ms(request.zone, request.start) if window else 0
    dims = list(f.get("dimensions", []))
    out = grouped(df, dims, f["method"], q.value, window, "_time", offset)
    return filled(out, dims, request.start, request.end, window) if fill and window else out


def run_raw(catalog: Catalog, request: Request, highlight_fields: list[str] | None = None, keywords: list[str] | None = None) -> tuple[DataFrame, dict[str, str]]:
    """Raw rows of all queries, merged, ordered, and cut where the request has a limit; and the errors of sources that failed."""

    def load(q: Query) -> DataFrame:
        df = catalog.scan(q.table, request.start, request.end, q.groups)
        if q.query_string:
            df = df.where(lucene.compile_query(df, q.query_string))
        df = df.select(*(q.keep or df.columns))
        return df.withColumn("__table", F.lit(q.table))

    done, errors = partial({q.table: (lambda q=q: load(q)) for q in request.queries})
    columns = list(dict.fromkeys(c for d in done for c in d.columns))
    rows = union_all(done, columns) if len(done) > 1 else done[0]
    limit, offset = compose_limits((request.queries[0].limit, request.queries[0].offset), (request.limit, request.offset), None)
    order = ordering(rows, request.order, {"_time": "_time"}) if request.order else []
    out = rows.orderBy(*order) if order else rows
    out = out.offset(offset) if offset else out
    out = out if limit is None else out.limit(limit)
    return (highlight(out, highlight_fields, keywords or []) if highlight_fields else out), errors


def check(catalog: Catalog, request: Request) -> dict:
    """What would run, without running it: PromQL, tables and the optimised plan's text."""
    out = run_series(catalog, request)
    return {"promql": to_promql(request), "tables": [q.table for q in request.queries], "plan": out._jdf.queryExecution().optimizedPlan().toString()}


# Metadata calls

def field_keys(catalog: Catalog, table: str) -> list[str]:
    return sorted(catalog[table].values)


def tag_keys(catalog: Catalog, table: str) -> list[str]:
    return sorted(catalog[table].tags)


def tag_values(catalog: Catalog, table: str, tag: str, start: int, end: int, limit: int | None = None) -> DataFrame:
    """Distinct values of a tag, all of them unless a ``limit`` is asked for (then the first in order)."""
    values = catalog.scan(table, start, end).select(F.col(tag).cast("string").alias("value")).where("value is not null").distinct()
    return values if limit is None else values.orderBy("value").limit(limit)


def series_list(catalog: Catalog, table: str, start: int, end: int) -> DataFrame:
    return catalog.scan(table, start, end).select(*catalog[table].tags).distinct()


def label_values(series: DataFrame, name: str, matchers: list[tuple[str, str, str]] | None = None) -> DataFrame:
    from tidegauge.operators.conditions import matcher

    hit: Column = reduce(lambda a, b: a & b, [matcher(F.col("labels"), *m) for m in matchers or []], F.lit(True))
    return series.where(hit).select(F.try_element_at("labels", F.lit(name)).alias("value")).where("value is not null").distinct()


def field_map(df: DataFrame) -> dict[str, str]:
    return {f.name: f.dataType.simpleString() for f in df.schema.fields}


def exemplars(df: DataFrame, at: str, value: str, trace: str, window_ms: int, dims: list[str]) -> DataFrame:
    """Per bucket and group the trace of the largest value."""
    bucket = F.col(at) - F.pmod(F.col(at), F.lit(window_ms))
    return df.where(F.col(trace).isNotNull() & (F.col(trace) != "")).groupBy(*dims, bucket.alias("_time")).agg(F.max(value).alias("_value"), F.max_by(trace, F.struct(value, trace)).alias("exemplar"))
