"""Payloads of the receivers as rows: spans of Zipkin and Jaeger, metric points, remote-write series with exemplars, logs, beats, pings. All as JSON texts, parsed by declared schemas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPAN = ["trace_id", "span_id", "parent_span_id", "span_name", "kind", "start_time", "end_time", "service", "attributes"]
# Span kinds by the names that other protocols have for them.
KINDS = {"INTERNAL": 1, "SERVER": 2, "CLIENT": 3, "PRODUCER": 4, "CONSUMER": 5}
#: The value a sample has when its series ended: the stale marker of the text and remote-write formats is a NaN.
STALE = float("nan")

_ZIPKIN = "array<struct<traceId string, id string, parentId string, name string, kind string, timestamp bigint, duration bigint, localEndpoint struct<serviceName string>, tags map<string,string>>>"
_JAEGER = "struct<process struct<serviceName string>, spans array<struct<traceID string, spanID string, operationName string, references array<struct<refType string, spanID string>>, startTime bigint, duration bigint, tags array<struct<key string, value string>>>>>"
_SERIES = "array<struct<labels array<struct<name string, value string>>, samples array<struct<value double, timestamp bigint>>, exemplars array<struct<labels array<struct<name string, value string>>, value double, timestamp bigint>>>>"


def _kind(name: Column) -> Column:
    known = F.create_map(*[F.lit(x) for kv in KINDS.items() for x in kv])
    return F.coalesce(F.try_element_at(known, F.upper(name)), F.lit(0))


def spans_of_zipkin(df: DataFrame, payload: str = "value") -> DataFrame:
    """Zipkin v2 lists of spans (times in us) as span rows; payloads that are no such list give none."""
    rows = df.select(F.inline(F.from_json(F.col(payload), _ZIPKIN)))
    return rows.where("traceId is not null and id is not null").select(
        F.col("traceId").alias("trace_id"), F.col("id").alias("span_id"), F.coalesce("parentId", F.lit("")).alias("parent_span_id"), F.col("name").alias("span_name"), _kind(F.col("kind")).alias("kind"),
        F.col("timestamp").alias("start_time"), (F.col("timestamp") + F.coalesce("duration", F.lit(0))).alias("end_time"), F.col("localEndpoint.serviceName").alias("service"),
        F.coalesce("tags", F.create_map().cast("map<string,string>")).alias("attributes"))


def spans_of_jaeger(df: DataFrame, payload: str = "value") -> DataFrame:
    """Jaeger batches {process, spans} as span rows: the parent is the first CHILD_OF reference, the kind the tag span.kind (which stays)."""
    batch = df.select(F.from_json(F.col(payload), _JAEGER).alias("b")).select(F.col("b.process.serviceName").alias("service"), F.explode("b.spans").alias("s"))
    parent = F.get(F.filter("s.references", lambda r: r["refType"] == "CHILD_OF"), 0)["spanID"]
    tags = F.map_from_entries(F.transform(F.coalesce("s.tags", F.array().cast("array<struct<key:string,value:string>>")), lambda t: F.struct(t["key"].alias("key"), t["value"].alias("value"))))
    rows = batch.select("service", "s", F.coalesce(parent, F.lit("")).alias("parent_span_id"), tags.alias("attributes")).where("s.traceID is not null and s.spanID is not null")
    return rows.select(
        F.col("s.traceID").alias("trace_id"), F.col("s.spanID").alias("span_id"), "parent_span_id", F.col("s.operationName").alias("span_name"), _kind(F.try_element_at("attributes", F.lit("span.kind"))).alias("kind"),
        F.col("s.startTime").alias("start_time"), (F.col("s.startTime") + F.coalesce("s.duration", F.lit(0))).alias("end_time"), "service", "attributes")


def _named(pairs: Column) -> Column:
    return F.map_from_entries(F.transform(pairs, lambda p: F.struct(p["name"].alias("key"), p["value"].alias("value"))))


def remote_write_rows(df: DataFrame, payload: str = "value") -> DataFrame:
    """Remote-write series as samples ``metric, labels, t, v, exemplar`` (the label map of the last exemplar not after the sample, null without one); series without a name give none."""
    rows = df.select(F.inline(F.from_json(F.col(payload), _SERIES))).withColumn("all", _named(F.col("labels")))
    rows = rows.select(F.try_element_at("all", F.lit("__name__")).alias("metric"), F.map_filter("all", lambda k, _: k != "__name__").alias("labels"), F.explode("samples").alias("s"), "exemplars")
    earlier = F.filter("exemplars", lambda e: e["timestamp"] <= F.col("s.timestamp"))
    last = F.element_at(F.array_sort(F.transform(earlier, lambda e: F.struct(e["timestamp"].alias("t"), e["labels"].alias("l")))), -1)
    exemplar = F.when(F.size(earlier) > 0, _named(last["l"]))
    return rows.where("metric is not null and metric != ''").select("metric", "labels", F.col("s.timestamp").alias("t"), F.col("s.value").alias("v"), exemplar.alias("exemplar"))


def number_points(df: DataFrame, labels: str = "labels") -> DataFrame:
    """Sum and gauge points ``name, labels, t, as_double, as_int, no_value`` as samples: the double if there is one, else the integer; points that recorded no value are stale markers, others without a value are left out."""
    v = F.when(F.coalesce("no_value", F.lit(False)), F.lit(STALE)).otherwise(F.coalesce("as_double", F.col("as_int").cast("double")))
    return df.select(F.col("name").alias("metric"), F.col(labels).alias("labels"), "t", v.alias("v")).where("v is not null")


def log_records(df: DataFrame, payload: str = "value") -> DataFrame:
    """OTLP log payloads (JSON) as rows ``service, t, severity, body, trace_id, span_id, attributes``: resource, scope and record nested three deep. Time is the record's, else when it was observed, in ms."""
    pairs = "array<struct<key string, value struct<stringValue string>>>"
    record = f"struct<timeUnixNano string, observedTimeUnixNano string, severityText string, body struct<stringValue string>, traceId string, spanId string, attributes {pairs}>"
    schema = f"struct<resourceLogs array<struct<resource struct<attributes {pairs}>, scopeLogs array<struct<logRecords array<{record}>>>>>>"
    flat = lambda c: F.map_from_entries(F.transform(F.coalesce(c, F.array().cast("array<struct<key:string,value:struct<stringValue:string>>>")), lambda p: F.struct(p["key"].alias("key"), p["value"]["stringValue"].alias("value"))))
    rows = df.select(F.explode(F.from_json(F.col(payload), schema)["resourceLogs"]).alias("r"))
    rows = rows.select(flat(F.col("r.resource.attributes")).alias("resource"), F.explode("r.scopeLogs").alias("s")).select("resource", F.explode("s.logRecords").alias("l"))
    nanos = F.coalesce(F.nullif(F.col("l.timeUnixNano").try_cast("long"), F.lit(0)), F.col("l.observedTimeUnixNano").try_cast("long"))
    return rows.select(F.try_element_at("resource", F.lit("service.name")).alias("service"), F.floor(nanos / F.lit(1_000_000).cast("decimal(7,0)")).cast("long").alias("t"), F.col("l.severityText").alias("severity"),
        F.col("l.body.stringValue").alias("body"), F.col("l.traceId").alias("trace_id"), F.col("l.spanId").alias("span_id"), flat(F.col("l.attributes")).alias("attributes"))


def pushed_logs(df: DataFrame, lines: str, labels: str) -> DataFrame:
    """A pushed batch (an array of lines with labels for all) as one row per line, with its place; empty lines are left out."""
    return df.select(*[c for c in df.columns if c not in (lines, labels)], labels, F.posexplode(lines).alias("place", "line")).where("line != ''")


def ping_rows(df: DataFrame, results: str = "results") -> DataFrame:
    """Results of a ping server: per target the share of packets lost and the times (ms), which are null where all were lost."""
    rows = df.select(*[c for c in df.columns if c != results], F.explode(results).alias("r"))
    sent, got = F.col("r.sent").cast("double"), F.size(F.col("r.times")).cast("double")
    some = lambda fn: F.when(got > 0, fn(F.col("r.times")))
    mean = F.aggregate("r.times", F.lit(0.0), lambda a, x: a + x) / F.nullif(got, F.lit(0.0))
    return rows.select(*[c for c in df.columns if c != results], F.col("r.target").alias("target"), F.when(sent > 0, (sent - got) / sent).alias("loss_percent"),
        some(F.array_min).alias("min_rtt"), mean.alias("avg_rtt"), some(F.array_max).alias("max_rtt"))


def beat_rows(df: DataFrame, payload: str = "value", fields: dict[str, str] | None = None) -> DataFrame:
    """Beat messages (JSON): ``dataid, t`` (ms) and the given dotted fields as texts; messages without a dataid are left out."""
    c = F.col(payload)
    out = df.select(F.get_json_object(c, "$.dataid").try_cast("long").alias("dataid"), F.unix_millis(F.get_json_object(c, "$['@timestamp']").try_cast("timestamp")).alias("t"),
        *[F.get_json_object(c, f"$.{p}").alias(n) for n, p in (fields or {}).items()])
    return out.where("dataid is not null")


def flat_series(df: DataFrame, tree: str, levels: list[str], keep: list[str] | None = None, value: str = "value") -> DataFrame:
    """A tree of nested aggregation buckets (JSON: {level: {buckets: [{key, doc_count, next level..., value}]}}) as flat rows: ``keep..., one column per level, doc_count, value``.
    A bucket without the next level, or with an empty list of it, has no rows; the value is that of the innermost bucket (null if it has none)."""
    rows = df.select(*(keep or []), F.col(tree).alias("_tree"))
    for i, level in enumerate(levels):
        done = [*(keep or []), *levels[:i]]
        buckets = F.from_json(F.get_json_object("_tree", f"$.{level}.buckets"), "array<string>")
        rows = rows.select(*done, F.explode(buckets).alias("_tree")).withColumn(level, F.coalesce(F.get_json_object("_tree", "$.key_as_string"), F.get_json_object("_tree", "$.key"))).select(*done, level, "_tree")
    count = F.get_json_object("_tree", "$.doc_count").try_cast("long")
    return rows.select(*(keep or []), *levels, count.alias("doc_count"), F.get_json_object("_tree", f"$.{value}.value").try_cast("double").alias("value"))
