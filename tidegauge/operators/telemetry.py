"""Processors for spans, metric points and logs on their way to storage."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Buckets of the sampler's hash, and its seed: all instances decide alike.
SAMPLE_BUCKETS, SAMPLE_SEED = 0x4000, 12345
ERROR = 2


def _get(m: Column, key: str) -> Column:
    return F.try_element_at(m, F.lit(key))


def _put(m: Column, values: dict[str, Column]) -> Column:
    """A map with keys set; a null value leaves the key as it was."""
    new = F.map_filter(F.create_map(*[x for k, v in values.items() for x in (F.lit(k), v.cast("string"))]), lambda _, v: v.isNotNull())
    return F.map_concat(F.map_filter(m, lambda k, _: ~F.map_contains_key(new, k)), new)


# Attribute and resource filters

def assemble(m: Column, target: str, keys: list[str], separator: str = ":", placeholder: str = "") -> Column:
    """A key made of others; missing ones leave the placeholder."""
    return _put(m, {target: F.concat_ws(separator, *[F.coalesce(_get(m, k), F.lit(placeholder)) for k in keys])})


def cut(m: Column, keys: list[str], longest: int) -> Column:
    return F.transform_values(m, lambda k, v: F.when(k.isin(keys), F.substring(v, 1, longest)).otherwise(v))


def drop(m: Column, keys: list[str]) -> Column:
    return F.map_filter(m, lambda k, _: ~k.isin(keys))


def as_int(m: Column, keys: list[str]) -> Column:
    """Values of these keys as whole numbers (texts again in the map); what is none stays."""
    return F.transform_values(m, lambda k, v: F.when(k.isin(keys), F.coalesce(F.floor(v.try_cast("double")).cast("string"), v)).otherwise(v))


def replace_key(m: Column, source: str, target: str) -> Column:
    """A key under another name."""
    return F.when(_get(m, source).isNotNull(), _put(drop(m, [source]), {target: _get(m, source)})).otherwise(m)


def default_value(m: Column, defaults: dict[str, str]) -> Column:
    return _put(m, {k: F.when(F.coalesce(_get(m, k), F.lit("")) == "", F.lit(v)) for k, v in defaults.items()})


def from_cache(df: DataFrame, m: str, key: str, cache: DataFrame, cache_key: str, take: list[str]) -> DataFrame:
    """Keys of a lookup table whose ``cache_key`` equals the attribute ``key``."""
    side = cache.select(F.col(cache_key).alias("_key"), *[F.col(c).alias(f"_c_{c}") for c in take]).dropDuplicates(["_key"])
    out = df.withColumn("_key", _get(F.col(m), key)).join(side, "_key", "left")
    return out.withColumn(m, _put(F.col(m), {c: F.col(f"_c_{c}") for c in take})).drop("_key", *[f"_c_{c}" for c in take])


def normalise_field(m: Column, target: str, keys: list[str], how: str = "or", separator: str = ":") -> Column:
    """Only where the target is absent: 'or' takes the first key that is there, 'concat' joins two that both are."""
    values = [_get(m, k) for k in keys]
    if how == "concat":
        if len(values) != 2:
            raise ValueError("concat takes two keys")
        made = F.when(values[0].isNotNull() & values[1].isNotNull(), F.concat(values[0], F.lit(separator), values[1]))
    else:
        made = F.coalesce(*values)
    return _put(m, {target: F.when(_get(m, target).isNull(), made)})


# The comparison operators of filter rules.
TESTS = {
    "eq": lambda v, x: v == x, "nq": lambda v, x: v != x, "reg": lambda v, x: v.rlike(x), "startswith": lambda v, x: F.startswith(v, F.lit(x)),
    "nstartswith": lambda v, x: ~F.startswith(v, F.lit(x)), "endswith": lambda v, x: F.endswith(v, F.lit(x)), "nendswith": lambda v, x: ~F.endswith(v, F.lit(x)),
    "contains": lambda v, x: F.contains(v, F.lit(x)), "ncontains": lambda v, x: ~F.contains(v, F.lit(x)),
}


def dropped_spans(df: DataFrame, rules: list[dict]) -> DataFrame:
    """Without the spans that a rule {kind, rules: [{op, value}]} names by kind and span name."""
    hits = [(F.col("kind") == r["kind"]) & reduce(lambda a, b: a | b, [TESTS[x["op"]](F.col("span_name"), x["value"]) for x in r["rules"]]) for r in rules]
    return df.where(~F.coalesce(reduce(lambda a, b: a | b, hits), F.lit(False))) if hits else df


def probe(m: Column, rules: list[dict]) -> Column:
    """Attributes set where a condition on others holds: {field, op, value, set}."""
    for r in rules:
        hit = F.coalesce(TESTS[r["op"]](_get(m, r["field"]), r["value"]), F.lit(False))
        m = _put(m, {k: F.when(hit, F.lit(v)) for k, v in r["set"].items()})
    return m


def discover_service(m: Column, rules: list[dict], url_key: str = "http.url", target: str = "peer.service") -> Column:
    """The called service by URL: rules {type: manual, host, path, params: {k: v}, service} or {type: auto, regex with the groups peer_service and span_name}. The first rule that matches
    sets the target, if it isn't there."""
    url = _get(m, url_key)
    made: Column = F.lit(None).cast("string")
    for r in reversed(rules):
        if r.get("type") == "auto":
            plain = r["regex"].replace("(?P<peer_service>", "(").replace("(?<peer_service>", "(")
            made = F.when(url.rlike(plain), F.regexp_extract(url, plain, 1)).otherwise(made)
            continue
        hit = F.lit(True)
        for part, value in (("HOST", r.get("host")), ("PATH", r.get("path"))):
            if value:
                hit = hit & TESTS[value.get("op", "eq")](F.try_parse_url(url, F.lit(part)), value["value"])
        for k, v in r.get("params", {}).items():
            hit = hit & (F.try_parse_url(url, F.lit("QUERY"), F.lit(k)) == v)
        made = F.when(F.coalesce(hit, F.lit(False)), F.lit(r["service"])).otherwise(made)
    return _put(m, {target: F.when(_get(m, target).isNull(), made)})


def slow_query(system: Column, elapsed_us: Column, limits_ms: dict[str, float], default_ms: float) -> Column:
    """Whether a database span is slower than its system allows; null for other spans."""
    limit = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for k, v in limits_ms.items() for x in (k, float(v))]), F.lower(system)), F.lit(float(default_ms))) if limits_ms else F.lit(float(default_ms))
    return F.when(F.coalesce(system, F.lit("")) != "", elapsed_us > limit * 1000)


def apdex(duration_ms: Column, threshold_ms: float, error: Column | None = None) -> Column:
    """satisfied up to the threshold, tolerating up to four times it, else (and on errors) frustrated."""
    kind = F.when(duration_ms <= threshold_ms, "satisfied").when(duration_ms <= 4 * threshold_ms, "tolerating").otherwise("frustrated")
    return kind if error is None else F.when(error, "frustrated").otherwise(kind)


def apdex_score(df: DataFrame, dims: list[str], kind: str = "apdex_type") -> DataFrame:
    n = F.count(F.lit(1))
    score = (F.count_if(F.col(kind) == "satisfied") + F.count_if(F.col(kind) == "tolerating") / 2) / n
    return df.groupBy(*dims).agg(n.alias("n"), score.alias("apdex"))


# Metrics from traces

def derive(df: DataFrame, dims: list[str], duration_us: str, buckets_us: list[int]) -> DataFrame:
    """Per dimension set: count, sum, min, max of the durations and cumulative buckets (``le``, ``bucket_count``), as one row per bucket, +Inf last."""
    bounds = sorted(buckets_us)
    counts = [F.count_if(F.col(duration_us) <= b).alias(f"_b{i}") for i, b in enumerate(bounds)]
    sums = df.groupBy(*dims).agg(F.count(F.lit(1)).alias("n"), F.sum(duration_us).alias("sum"), F.min(duration_us).alias("min"), F.max(duration_us).alias("max"), *counts)
    pairs = [F.struct(F.lit(str(b)).alias("le"), F.col(f"_b{i}").alias("bucket_count")) for i, b in enumerate(bounds)] + [F.struct(F.lit("+Inf").alias("le"), F.col("n").alias("bucket_count"))]
    return sums.select(*dims, "n", "sum", "min", "max", F.inline(F.array(*pairs)))


def delta_per_interval(df: DataFrame, dims: list[str], at: str, interval_ms: int) -> DataFrame:
    """Spans per publishing interval and dimension set, and their total since the start."""
    start = F.col(at) - F.pmod(F.col(at), F.lit(interval_ms))
    per = df.groupBy(*dims, start.alias("interval")).agg(F.count(F.lit(1)).alias("delta"))
    return per.withColumn("total", F.sum("delta").over(W.partitionBy(*dims).orderBy("interval")))


def matched_dimensions(kind: Column, attributes: Column, types: list[dict]) -> Column:
    """The dimensions of the first type {kind, predicate, dimensions} whose kind fits and whose predicate key is there (or is empty)."""
    made: Column = F.lit(None).cast("map<string,string>")
    for t in reversed(types):
        hit = kind == t["kind"]
        if t.get("predicate"):
            hit = hit & F.map_contains_key(attributes, t["predicate"])
        dims = F.create_map(*[x for d in t["dimensions"] for x in (F.lit(d), F.coalesce(_get(attributes, d), F.lit("")))])
        made = F.when(hit, dims).otherwise(made)
    return made


# Samplers and limits

@F.pandas_udf(T.IntegerType())
def trace_bucket(ids: pd.Series) -> pd.Series:
    """Hash bucket of trace ids (32-bit murmur of the bytes that the hex text stands for), computed for a whole batch at once."""
    raw = ids.fillna("").map(lambda t: bytes.fromhex(t) if len(t) % 2 == 0 and all(c in "0123456789abcdefABCDEF" for c in t) else t.encode())
    out = np.zeros(len(raw), np.int64)
    for size in set(map(len, raw)):  # ids of one length are hashed together
        rows = np.flatnonzero(raw.map(len).to_numpy() == size)
        data = np.frombuffer(b"".join(raw.iloc[rows]), np.uint8).reshape(len(rows), size).astype(np.uint64) if size else np.zeros((len(rows), 0), np.uint64)
        mask = np.uint64(0xFFFFFFFF)
        turn = lambda x, r: ((x << np.uint64(r)) | (x >> np.uint64(32 - r))) & mask
        mix = lambda k: (turn((k * np.uint64(0xCC9E2D51)) & mask, 15) * np.uint64(0x1B873593)) & mask
        h = np.full(len(rows), SAMPLE_SEED, np.uint64)
        whole = size // 4 * 4
        for i in range(0, whole, 4):
            k = data[:, i] | data[:, i + 1] << np.uint64(8) | data[:, i + 2] << np.uint64(16) | data[:, i + 3] << np.uint64(24)
            h = (turn(h ^ mix(k), 13) * np.uint64(5) + np.uint64(0xE6546B64)) & mask
        if size > whole:
            k = np.zeros(len(rows), np.uint64)
            for j in range(size - 1, whole - 1, -1):
                k = (k << np.uint64(8)) | data[:, j]
            h ^= mix(k)
        h ^= np.uint64(size)
        for shift, factor in ((16, 0x85EBCA6B), (13, 0xC2B2AE35)):
            h = ((h ^ (h >> np.uint64(shift))) * np.uint64(factor)) & mask
        h ^= h >> np.uint64(16)
        out[rows] = (h & np.uint64(SAMPLE_BUCKETS - 1)).astype(np.int64)
    return pd.Series(out.astype("int32"))


def sampled_random(df: DataFrame, percent: float, trace_id: str = "trace_id", status: str = "status.code", attributes: str = "attributes") -> DataFrame:
    """A share of the traces by hash of the id. Errors always stay; ``sampling.priority`` 0 drops a span, above 0 keeps it."""
    priority = _get(F.col(attributes), "sampling.priority").try_cast("double")
    error = F.coalesce(F.col(status) == ERROR, F.lit(False))
    keep = F.lit(True) if percent >= 100 else trace_bucket(F.col(trace_id)) < int(percent * SAMPLE_BUCKETS / 100.0)
    return df.where(error | F.when(priority == 0, False).when(priority > 0, True).otherwise(keep))


def sampled_by_status(df: DataFrame, codes: list[int], trace_id: str = "trace_id", status: str = "status.code") -> DataFrame:
    """Whole traces in which some span has one of the status codes."""
    hit = df.where(F.col(status).isin(codes)).select(trace_id).distinct()
    return df.join(hit, trace_id, "left_semi")


def rate_limited(df: DataFrame, at_ms: str, per_second: int, key: str | None = None, order: list[str] | None = None) -> DataFrame:
    """At most ``per_second`` rows of each second (and key), the first in order: a token bucket that fills each second."""
    second = F.floor(F.col(at_ms) / 1000)
    w = W.partitionBy(*([key] if key else []), second).orderBy(at_ms, *(order or []))
    return df.withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= per_second).drop("_k")


def token_bucket(df: DataFrame, key: str, at_ms: str, rate: float, burst: float, order: list[str] | None = None) -> DataFrame:
    """The rows a token bucket lets through: per key it starts with ``burst`` tokens and gains ``rate`` a second up to ``burst``; a row takes one, and is dropped if there is none. Rows of one time go by ``order``.

    Whether a row passes depends on all rows of its key before it, so a key is one stream of sorted rows, of which the task holds a batch and the bucket's state. Null keys are a key; null times are dropped."""
    names = df.columns
    rows = df.where(F.col(at_ms).isNotNull()).withColumn("_k", F.coalesce(F.col(key).cast("string"), F.lit("")))
    at, last = names.index(at_ms), len(names)

    def scan(batches):
        now, tokens, seen = None, 0.0, 0
        for batch in batches:
            keep = []
            for k, t in zip(batch.column(last).to_pylist(), batch.column(at).to_pylist(), strict=True):
                if k != now:
                    now, tokens, seen = k, burst, t
                tokens = min(burst, tokens + (t - seen) / 1000.0 * rate)
                seen = t
                keep.append(tokens >= 1.0)
                tokens -= keep[-1]
            yield batch.select(names).filter(pa.array(keep, pa.bool_()))

    return rows.repartition("_k").sortWithinPartitions("_k", at_ms, *(order or [])).mapInArrow(scan, df.schema)


def split_text(df: DataFrame, column: str, separator: str = "\n") -> DataFrame:
    """A batch of lines as one row per line that isn't empty."""
    return df.select(*[c for c in df.columns if c != column], F.explode(F.split(F.col(column), separator)).alias(column)).where(F.col(column) != "")


def valid_proxy_record(at_ms: Column, now_ms: int, most_ahead_ms: int = 3_600_000, name: Column | None = None) -> Column:
    ok = at_ms.isNotNull() & (at_ms > 0) & (at_ms <= now_ms + most_ahead_ms)
    return ok if name is None else ok & name.rlike(r"^[a-zA-Z_][a-zA-Z0-9_]*$")


def checked_token(df: DataFrame, tokens: DataFrame, token: str = "token") -> DataFrame:
    """Rows whose token is known, with what it stands for."""
    return df.join(tokens, token)


# Metric filters

def filter_metrics(df: DataFrame, name: str, drop_in: list[str] | None = None, keep_in: list[str] | None = None, rename: dict[str, str] | None = None) -> DataFrame:
    if drop_in:
        df = df.where(~F.col(name).isin(drop_in))
    if keep_in:
        df = df.where(F.col(name).isin(keep_in))
    if rename:
        df = df.withColumn(name, F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in rename.items() for x in kv]), F.col(name)), F.col(name)))
    return df


def relabel_by_rules(labels: Column, rules: list[dict]) -> Column:
    """Labels set where all conditions {label, op: in|range, values} hold; the first rule wins."""
    out = labels
    for r in reversed(rules):
        def test(c: dict) -> Column:
            v = _get(labels, c["label"])
            if c["op"] == "in":
                return v.isin(c["values"])
            return reduce(lambda a, b: a | b, [v.try_cast("double").between(x["min"], x["max"]) for x in c["values"]])

        hit = F.coalesce(reduce(lambda a, b: a & b, [test(c) for c in r["rules"]]), F.lit(False))
        out = F.when(hit, _put(labels, {r["target"]: F.lit(r["value"])})).otherwise(out)
    return out


# Converters

def spans_of_otlp(df: DataFrame, payload: str = "value") -> DataFrame:
    """OTLP JSON (resourceSpans / scopeSpans / spans) as span rows, times in us."""
    kv = "array<struct<key:string,value:struct<stringValue:string,intValue:string,doubleValue:double,boolValue:boolean>>>"
    event = f"struct<name:string,timeUnixNano:string,attributes:{kv}>"
    span = f"struct<traceId:string,spanId:string,parentSpanId:string,traceState:string,name:string,kind:int,startTimeUnixNano:string,endTimeUnixNano:string,attributes:{kv},events:array<{event}>,links:array<struct<traceId:string,spanId:string>>,status:struct<code:int,message:string>>"
    schema = f"struct<resourceSpans:array<struct<resource:struct<attributes:{kv}>,scopeSpans:array<struct<spans:array<{span}>>>>>>"
    rows = df.select(F.explode(F.from_json(payload, schema)["resourceSpans"]).alias("r")).select(F.col("r.resource.attributes").alias("res"), F.explode("r.scopeSpans").alias("s")).select("res", F.explode("s.spans").alias("s"))
    start, end = (F.floor(F.col(f"s.{c}").cast("decimal(20,0)") / 1000).cast("long") for c in ("startTimeUnixNano", "endTimeUnixNano"))
    return rows.select(
        F.col("s.traceId").alias("trace_id"), F.col("s.spanId").alias("span_id"), F.coalesce("s.parentSpanId", F.lit("")).alias("parent_span_id"), F.col("s.name").alias("span_name"), F.col("s.kind").alias("kind"),
        start.alias("start_time"), end.alias("end_time"), (end - start).alias("elapsed_time"), F.struct(F.coalesce("s.status.code", F.lit(0)).alias("code"), F.coalesce("s.status.message", F.lit("")).alias("message")).alias("status"),
        _pairs(F.col("res")).alias("resource"), _pairs(F.col("s.attributes")).alias("attributes"),
        F.transform("s.events", lambda e: F.struct(e["name"].alias("name"), F.floor(e["timeUnixNano"].cast("decimal(20,0)") / 1000).cast("long").alias("timestamp"))).alias("events"), F.col("s.links").alias("links"))


def _pairs(kv: Column) -> Column:
    value = lambda v: F.coalesce(v["stringValue"], v["intValue"], v["doubleValue"].cast("string"), v["boolValue"].cast("string"))
    return F.map_from_entries(F.transform(F.coalesce(kv, F.array().cast("array<struct<key:string,value:struct<stringValue:string,intValue:string,doubleValue:double,boolValue:boolean>>>")), lambda p: F.struct(p["key"], value(p["value"]))))


def histogram_rows(df: DataFrame, labels: str = "labels") -> DataFrame:
    """Histogram points {metric, labels, t, sum, min, max, count, bounds[], counts[]} as samples: _sum, _count, _min and _max (if present), cumulative _bucket with ``le``, +Inf equal to the count."""
    metric = F.col("metric")
    plain = [F.when(F.col(c).isNotNull(), F.struct(F.concat(metric, F.lit(f"_{c}")).alias("metric"), F.col(labels).alias("labels"), F.col(c).cast("double").alias("v"))) for c in ("sum", "count", "min", "max")]
    upto = lambda i: F.aggregate(F.slice("counts", F.lit(1), i + 1), F.lit(0).cast("bigint"), lambda a, x: a + x.cast("bigint")).cast("double")
    with_le = lambda le: F.map_concat(F.map_filter(F.col(labels), lambda k, _: k != "le"), F.create_map(F.lit("le"), le))
    inner = F.transform("bounds", lambda b, i: F.struct(F.concat(metric, F.lit("_bucket")).alias("metric"), with_le(b.cast("string")).alias("labels"), upto(i).alias("v")))
    last = F.array(F.struct(F.concat(metric, F.lit("_bucket")).alias("metric"), with_le(F.lit("+Inf")).alias("labels"), F.col("count").cast("double").alias("v")))
    return df.select("t", F.inline(F.concat(F.array_compact(F.array(*plain)), inner, last))).select("metric", "labels", "t", "v")


def summary_rows(df: DataFrame, labels: str = "labels") -> DataFrame:
    """Summary points {metric, labels, t, sum, count, quantiles[{quantile, value}]} as samples: _sum, _count and one per quantile."""
    metric = F.col("metric")
    plain = F.array(*[F.struct(F.concat(metric, F.lit(f"_{c}")).alias("metric"), F.col(labels).alias("labels"), F.col(c).cast("double").alias("v")) for c in ("sum", "count")])
    q = F.transform("quantiles", lambda x: F.struct(metric.alias("metric"), F.map_concat(F.col(labels), F.create_map(F.lit("quantile"), x["quantile"].cast("string"))).alias("labels"), x["value"].cast("double").alias("v")))
    return df.select("t", F.inline(F.concat(plain, q))).select("metric", "labels", "t", "v")


def exposition_rows(df: DataFrame, line: str = "value") -> DataFrame:
    """Prometheus text lines as samples ``metric, labels, v, t``; comments and blank lines are left out."""
    pattern = r"^([a-zA-Z_:][\w:]*)(?:\{(.*)\})?\s+(\S+)(?:\s+(-?\d+))?\s*$"
    rows = df.where(F.col(line).rlike(pattern))
    part = lambda i: F.regexp_extract(F.col(line), pattern, i)
    text = F.regexp_extract_all(part(2), F.lit(r'(\w+)="((?:[^"\\]|\\.)*)"'), 0)
    entry = lambda x: F.struct(F.regexp_extract(x, r'^(\w+)="', 1).alias("k"), F.regexp_replace(F.regexp_extract(x, r'="(.*)"$', 1), r'\\(["\\])', "$1").alias("v"))
    value = F.when(F.lower(part(3)).isin("+inf", "inf"), F.lit(float("inf"))).when(F.lower(part(3)) == "-inf", F.lit(float("-inf"))).when(F.lower(part(3)) == "nan", F.lit(float("nan"))).otherwise(part(3).try_cast("double"))
    return rows.select(part(1).alias("metric"), F.map_from_entries(F.transform(text, entry)).alias("labels"), value.alias("v"), part(4).try_cast("long").alias("t")).where("v is not null")


def merge_stats(df: DataFrame, keys: list[str], ignored: list[str], at: str, interval_ms: int) -> DataFrame:
    """Call statistics per key (without the ignored tags) and interval: counters summed, bucket maps merged bucket by bucket."""
    keys = [k for k in keys if k not in ignored]
    start = F.col(at) - F.pmod(F.col(at), F.lit(interval_ms))
    rows = df.withColumn("interval", start)
    sums = rows.groupBy(*keys, "interval").agg(F.sum("count").alias("count"), F.sum("total_us").alias("total_us"), F.max("max_us").alias("max_us"), F.min("min_us").alias("min_us"))
    buckets = rows.select(*keys, "interval", F.explode("buckets").alias("b", "n")).groupBy(*keys, "interval", "b").agg(F.sum("n").alias("n"))
    merged = buckets.groupBy(*keys, "interval").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("b", "n")))).alias("buckets"))
    return sums.join(merged, [*keys, "interval"], "left")


def capped_series(df: DataFrame, keys: list[str], at: str, most: int, idle_ms: int | None = None) -> DataFrame:
    """Series caps: only the first ``most`` series (by first appearance, then key) are let in; those let in always stay. With ``idle_ms`` a series that was silent so long
    counts as new at its return, so each of its stretches competes for a place."""
    if idle_ms is not None:
        w = W.partitionBy(*keys).orderBy(at)
        new = F.when(F.col(at) - F.lag(at).over(w) <= idle_ms, 0).otherwise(1)
        df = df.withColumn("_new", new).withColumn("_life", F.sum("_new").over(w.rowsBetween(W.unboundedPreceding, 0))).drop("_new")
        keys = [*keys, "_life"]
    first = df.groupBy(*keys).agg(F.min(at).alias("_first")).orderBy("_first", *keys).limit(most).drop("_first")
    return df.join(first, keys, "left_semi").drop("_life")


def span_rows(df: DataFrame) -> DataFrame:
    """Spans flattened for storage: elapsed time, flags for errors and roots, counts of events and links, the status as text."""
    names = F.create_map(F.lit(0), F.lit("UNSET"), F.lit(1), F.lit("OK"), F.lit(2), F.lit("ERROR"))
    return df.select("trace_id", "span_id", "parent_span_id", "span_name", "kind", "start_time", "end_time", (F.col("end_time") - F.col("start_time")).alias("elapsed_time"),
        F.try_element_at(names, F.coalesce("status.code", F.lit(0))).alias("status"), F.coalesce(F.size("events"), F.lit(0)).alias("n_events"), F.coalesce(F.size("links"), F.lit(0)).alias("n_links"),
        F.try_element_at("resource", F.lit("service.name")).alias("service"))


def span_events(df: DataFrame) -> DataFrame:
    """One row per event of a span, with its place: the nested iteration of span batches."""
    return df.select("trace_id", "span_id", F.posexplode("events").alias("place", "e")).select("trace_id", "span_id", "place", "e.name", "e.timestamp")


def log_rows(df: DataFrame, line: str, keys: list[str]) -> DataFrame:
    """Log lines with what they say in key=value form: one column per key, null where it isn't there."""
    value = lambda k: F.regexp_extract(F.col(line), rf'(?:^|\s){k}=(?:"([^"]*)"|(\S+))', 1)
    bare = lambda k: F.regexp_extract(F.col(line), rf'(?:^|\s){k}=(?:"([^"]*)"|(\S+))', 2)
    return df.withColumns({k: F.nullif(F.concat(value(k), bare(k)), F.lit("")) for k in keys})


def scaler_rows(df: DataFrame, metrics: str = "metrics") -> DataFrame:
    """Autoscaler status {name, metrics[{type, name, current, target}]} as one sample per metric and figure."""
    rows = df.select("name", F.explode(metrics).alias("m"))
    figures = F.array(F.struct(F.lit("current").alias("figure"), F.col("m.current").cast("double").alias("v")), F.struct(F.lit("target").alias("figure"), F.col("m.target").cast("double").alias("v")))
    return rows.select("name", F.col("m.type").alias("type"), F.col("m.name").alias("metric"), F.inline(figures)).where("v is not null")


def profile_samples(payload: bytes) -> list[tuple[list[str], list[int]]]:
    """The samples of a pprof profile (gzip or plain protobuf): stack of function names, leaf first, and values."""
    import gzip

    data = gzip.decompress(payload) if payload[:2] == b"\x1f\x8b" else payload

    def varint(b: bytes, i: int) -> tuple[int, int]:
        n = shift = 0
        while True:
            n |= (b[i] & 0x7F) << shift
            shift += 7
            i += 1
            if not b[i - 1] & 0x80:
                return n, i

    def fields(b: bytes):
        i = 0
        while i < len(b):
            tag, i = varint(b, i)
            kind = tag & 7
            if kind == 0:
                v, i = varint(b, i)
            elif kind == 2:
                size, i = varint(b, i)
                v, i = b[i : i + size], i + size
            else:
                size = 8 if kind == 1 else 4
                v, i = b[i : i + size], i + size
            yield tag >> 3, v

    def numbers(v) -> list[int]:
        if isinstance(v, int):
            return [v]
        out, i = [], 0
        while i < len(v):
            n, i = varint(v, i)
            out.append(n)
        return out

    texts, samples, places, functions = [], [], {}, {}
    for number, v in fields(data):
        if number == 6:
            texts.append(v.decode("utf-8", "replace"))
        elif number == 2:
            stack, values = [], []
            for n, x in fields(v):
                (stack if n == 1 else values if n == 2 else []).extend(numbers(x) if n in (1, 2) else [])
            samples.append((stack, values))
        elif number == 4:
            own, lines = 0, []
            for n, x in fields(v):
                if n == 1:
                    own = x
                elif n == 4:
                    lines += [y for m, y in fields(x) if m == 1]
            places[own] = lines
        elif number == 5:
            f = dict((n, x) for n, x in fields(v) if isinstance(x, int))
            functions[f.get(1, 0)] = f.get(2, 0)
    return [([texts[functions[f]] for place in stack for f in places.get(place, [])], values) for stack, values in samples]


def profile_rows(df: DataFrame, payload: str = "value") -> DataFrame:
    """Profiles (binary) as ``stack, values``: a row per sample."""
    keys = [c for c in df.columns if c != payload]

    def scan(batches):
        for pdf in batches:
            out = [(*[getattr(r, k) for k in keys], *s) for r in pdf.itertuples(index=False) for s in profile_samples(bytes(getattr(r, payload)))]
            yield pd.DataFrame(out, columns=[*keys, "stack", "values"])

    schema = T.StructType([*[df.schema[k] for k in keys], T.StructField("stack", T.ArrayType(T.StringType())), T.StructField("values", T.ArrayType(T.LongType()))])
    return df.select(*keys, payload).mapInPandas(scan, schema)
