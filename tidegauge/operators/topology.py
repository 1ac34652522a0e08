"""Traces as graphs, what they say about services, and paths through a topology of resources."""

from __future__ import annotations

from collections import deque
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidegauge.operators.hierarchy import descendants, hierarchy

# Span kinds, their classes, and by which attributes a span's category is told (first match counts; of ``with_any`` one key must be there too).
SERVER, CLIENT, PRODUCER, CONSUMER = 2, 3, 4, 5
KIND_CLASSES = {0: "unspecified", 1: "interval", 2: "sync", 3: "sync", 4: "async", 5: "async"}
CATEGORIES = (
    ("messaging", ("messaging.destination", "messaging.system", "messaging.destination_kind"), ("messaging.rabbitmq.routing_key", "messaging.kafka.message_key", "messaging.rocketmq.message_keys")),
    ("async_backend", ("messaging.destination", "messaging.destination_kind", "messaging.system", "celery.task_name", "celery.action"), ()),
    ("db", ("db.name", "db.operation", "db.system", "db.statement", "db.type", "db.instance"), ()),
    ("rpc", ("rpc.method", "rpc.service", "rpc.system", "rpc.grpc.status_code"), ()),
    ("http", ("http.host", "http.url", "net.peer.name", "peer.service", "http.scheme", "http.flavor", "http.method", "http.status_code"), ()),
)


def category(attributes: Column) -> Column:
    """The span's category; null where no attribute tells it."""
    there = lambda keys: reduce(lambda a, b: a | b, [F.map_contains_key(attributes, k) for k in keys])
    made: Column = F.lit(None).cast("string")
    for name, keys, with_any in reversed(CATEGORIES):
        made = F.when(there(keys) & there(with_any) if with_any else there(keys), name).otherwise(made)
    return made


def session_windows(df: DataFrame, key: str, at: str, gap_s: int) -> DataFrame:
    """``key, start, end, n``: rows of a key less than ``gap_s`` apart are one session, which ends ``gap_s`` after its last row (a batch or a stream)."""
    w = F.session_window(F.col(at), f"{gap_s} seconds").alias("w")
    return df.groupBy(key, w).agg(F.count(F.lit(1)).alias("n")).select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def once(spans: DataFrame) -> DataFrame:
    """One row per span: ids in lower case without outer blanks, of a span received repeatedly the first (by time of receipt, start, end and parent). Rows without an id are left out."""
    rows = spans.withColumn("span_id", F.lower(F.trim("span_id"))).where("trace_id is not null and span_id is not null")
    order = [F.col(c).asc_nulls_last() for c in ("time", "start_time", "end_time", "parent_span_id") if c in spans.columns]
    return rows.withColumn("_k", F.row_number().over(W.partitionBy("trace_id", "span_id").orderBy(*order))).where("_k = 1").drop("_k")


def with_depth(spans: DataFrame) -> DataFrame:
    """Distinct spans with depth (from true roots; orphans are roots) and preorder range. Spans on circles have depth -1."""
    tree = hierarchy(spans, "trace_id", "span_id", "parent_span_id")
    tree = tree.select(F.col("grp").alias("trace_id"), F.col("node").alias("span_id"), F.col("parent").alias("parent_id"), "root", "depth", "first", "last")
    return once(spans).drop("parent_span_id").join(tree, ["trace_id", "span_id"])


def trace_info(spans: DataFrame) -> DataFrame:
    """One row per trace: counts, times, durations, errors, root span (smallest depth, then earliest start), root service span (the same among called spans), category and kind counts."""
    rows = with_depth(spans).withColumns({"service": F.try_element_at("resource", F.lit("service.name")), "category": category(F.col("attributes")), "duration": F.col("end_time") - F.col("start_time")})
    order = F.struct(F.when(F.col("depth") < 0, 1 << 30).otherwise(F.col("depth")).alias("d"), "start_time", "span_id")
    called = F.col("kind").isin(SERVER, CONSUMER)
    root = lambda c: F.min_by(c, order)
    entry = lambda c: F.min_by(c, F.when(called, order))
    classes = {k: [n for n, c in KIND_CLASSES.items() if c == k] for k in dict.fromkeys(KIND_CLASSES.values())}
    return rows.groupBy("trace_id").agg(
        (F.max("depth") + 1).alias("hierarchy_count"), F.count_distinct("service").alias("service_count"), F.count(F.lit(1)).alias("span_count"),
        F.min("start_time").alias("min_start_time"), F.max("end_time").alias("max_end_time"), (F.max("end_time") - F.min("start_time")).alias("trace_duration"),
        F.max("duration").alias("span_max_duration"), F.min("duration").alias("span_min_duration"), root("span_id").alias("root_span_id"), root("span_name").alias("root_span_name"),
        root("service").alias("root_span_service"), entry("span_id").alias("root_service_span_id"), entry("service").alias("root_service"), entry("category").alias("root_service_category"),
        F.count_if(F.col("status.code") == 2).alias("error_count"),
        *[F.count_if(F.col("category") == c).alias(f"category_{c}") for c, *_ in CATEGORIES],
        *[F.count_if(F.col("kind").isin(n)).alias(f"kind_{k}") for k, n in classes.items()],
    )


def collected_values(spans: DataFrame, keys: list[str]) -> DataFrame:
    """``trace_id, key, values``: the distinct values of attributes within each trace."""
    rows = spans.select("trace_id", F.explode("attributes").alias("key", "value")).where(F.col("key").isin(keys))
    return rows.groupBy("trace_id", "key").agg(F.array_sort(F.collect_set("value")).alias("values"))


def ancestor_pairs(spans: DataFrame) -> DataFrame:
    """All (ancestor, descendant) pairs of each trace, by preorder ranges."""
    pairs = descendants(hierarchy(spans, "trace_id", "span_id", "parent_span_id"))
    return pairs.select(F.col("grp").alias("trace_id"), F.col("node").alias("ancestor"), "descendant", "distance")


def call_pairs(spans: DataFrame) -> DataFrame:
    """Direct caller-callee pairs: a client span and its server child, or a producer and its consumer child, with their services and the callee's time and outcome."""
    rows = with_depth(spans).withColumn("service", F.try_element_at("resource", F.lit("service.name")))
    up = rows.select("trace_id", F.col("span_id").alias("parent_id"), F.col("kind").alias("from_kind"), F.col("service").alias("from_service"))
    both = rows.join(up, ["trace_id", "parent_id"])
    fits = ((F.col("from_kind") == CLIENT) & (F.col("kind") == SERVER)) | ((F.col("from_kind") == PRODUCER) & (F.col("kind") == CONSUMER))
    return both.where(fits).select("trace_id", F.col("parent_id").alias("caller"), F.col("span_id").alias("callee"), "from_service", F.col("service").alias("to_service"),
        (F.col("end_time") - F.col("start_time")).alias("duration"), (F.col("status.code") == 2).alias("error"))


def alone_spans(spans: DataFrame) -> DataFrame:
    """Called spans without a caller above them, and calling spans without a called span below. In preorder a span has a caller above if the farthest reach of the callers
    before it includes it, and a called span below if the next called one lies within its range: two running extremes per trace."""
    rows = with_depth(spans).where("depth >= 0").select("trace_id", "span_id", "kind", "first", "last")
    calling, called = F.col("kind").isin(CLIENT, PRODUCER), F.col("kind").isin(SERVER, CONSUMER)
    before = W.partitionBy("trace_id").orderBy("first").rowsBetween(W.unboundedPreceding, -1)
    behind = W.partitionBy("trace_id").orderBy(F.col("first").desc()).rowsBetween(W.unboundedPreceding, -1)
    reach, next_called = F.max(F.when(calling, F.col("last"))).over(before), F.min(F.when(called, F.col("first"))).over(behind)
    rows = rows.withColumns({"reach": F.coalesce(reach, F.lit(-1)), "next_called": next_called})
    why = F.when(called & (F.col("reach") < F.col("first")), "no_caller").when(calling & (F.col("next_called").isNull() | (F.col("next_called") > F.col("last"))), "no_callee")
    return rows.select("trace_id", "span_id", "kind", why.alias("why")).where("why is not null")


def relation_metrics(spans: DataFrame) -> DataFrame:
    """Distinct relations that spans prove: service with instance, instance with system (its address)."""
    r = lambda k: F.try_element_at("resource", F.lit(k))
    rows = spans.select(r("service.name").alias("service"), r("bk.instance.id").alias("instance"), r("net.host.ip").alias("ip")).distinct()
    one = rows.where("service is not null and instance is not null").select(F.lit("service_with_instance_relation").alias("metric"), F.col("service").alias("source"), F.col("instance").alias("target"))
    two = rows.where("instance is not null and ip is not null").select(F.lit("instance_with_system_relation").alias("metric"), F.col("instance").alias("source"), F.col("ip").alias("target"))
    return one.unionByName(two).distinct()


def flow_stats(pairs: DataFrame, dims: list[str], buckets_us: list[int]) -> DataFrame:
    """Per flow: count, errors, sum, min, max of the durations and cumulative buckets with ``le``."""
    from tidegauge.operators.telemetry import derive

    errors = pairs.groupBy(*dims).agg(F.count_if("error").alias("errors"))
    return derive(pairs, dims, "duration", buckets_us).join(errors, dims)


def component_flows(spans: DataFrame) -> DataFrame:
    """Flows from a service to what it calls without a span of its own: databases and queues by system."""
    a = lambda k: F.try_element_at("attributes", F.lit(k))
    target = F.coalesce(a("db.system"), a("messaging.system"))
    rows = once(spans).where(F.col("kind").isin(CLIENT, PRODUCER) & target.isNotNull())
    return rows.select("trace_id", F.try_element_at("resource", F.lit("service.name")).alias("from_service"), target.alias("to_component"),
        (F.col("end_time") - F.col("start_time")).alias("duration"), (F.col("status.code") == 2).alias("error"))


def merged_traces(history: DataFrame, late: DataFrame) -> DataFrame:
    """Spans of the traces that late spans touch, old and new: what has to be summed up anew."""
    touched = late.select("trace_id").distinct()
    return history.join(touched, "trace_id", "left_semi").unionByName(late)


def membership(df: DataFrame, column: str, expected: int, fpp: float = 0.01) -> tuple[DataFrame, int]:
    """A hash bitmap of a column's values, built map-side and merged: the filter that tells which traces may have history."""
    bits = max(64, int(expected / fpp))
    b = df.select(F.pmod(F.xxhash64(column), F.lit(bits)).alias("b")).distinct()
    words = b.select(F.bitmap_bucket_number("b").alias("k"), F.bitmap_bit_position("b").alias("p"))
    return words.groupBy("k").agg(F.bitmap_construct_agg("p").alias("bits")), bits


def maybe_members(df: DataFrame, column: str, filter_: tuple[DataFrame, int]) -> DataFrame:
    """The rows whose hash is in the filter of ``membership``: all members, and few others."""
    words, bits = filter_
    b = F.pmod(F.xxhash64(column), F.lit(bits))
    rows = df.withColumn("_k", F.bitmap_bucket_number(b)).withColumn("_p", F.bitmap_bit_position(b))
    byte = F.conv(F.hex(F.substring("bits", F.floor(F.col("_p") / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    hit = byte.bitwiseAND(F.pow(F.lit(2), F.col("_p") % 8).cast("int")) > 0
    return rows.join(words, rows["_k"] == words["k"]).where(hit).select(*df.columns)


# Topology of resources

def resource_paths(edges: list[tuple[str, str]], source: str, target: str, longest: int | None = None) -> list[list[str]]:
    """All simple paths between two resource types, shorter ones first; with ``longest`` those of at most so many links."""
    near: dict[str, set[str]] = {}
    for a, b in edges:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    out, queue = [], deque([[source]])
    while queue:
        path = queue.popleft()
        if path[-1] == target:
            out.append(path)
            continue
        if longest is None or len(path) <= longest:
            queue.extend(path + [n] for n in sorted(near.get(path[-1], ())) if n not in path)
    return out


def follow_path(start: DataFrame, path: list[str], relations: dict[tuple[str, str], DataFrame], keys: dict[str, list[str]]) -> DataFrame:
    """Resources at the end of ``path`` that those of ``start`` reach: a chain of joins along the relations, distinct after each; rows with an empty key lead nowhere."""
    rows = start
    for a, b in zip(path[:-1], path[1:], strict=True):
        relation = relations.get((a, b), relations.get((b, a)))
        if relation is None:
            raise KeyError(f"no relation of {a} and {b}")
        full = reduce(lambda x, y: x & y, [F.col(k).isNotNull() & (F.col(k).cast("string") != "") for k in (*keys[a], *keys[b])])
        rows = rows.join(relation.where(full).select(*dict.fromkeys([*keys[a], *keys[b]])), keys[a]).select(*keys[b]).distinct()
    return rows


def first_path_with_data(start: DataFrame, paths: list[list[str]], relations: dict, keys: dict[str, list[str]]) -> tuple[list[str], DataFrame] | None:
    """The first of the paths, in their order, that leads somewhere; paths without a relation are passed over."""
    for path in paths:
        try:
            rows = follow_path(start, path, relations, keys)
        except KeyError:
            continue
        if not rows.isEmpty():
            return path, rows
    return None


def inventory_relations(hosts: DataFrame, host: str, links: dict[str, str]) -> DataFrame:
    """``relation, source, target`` of an inventory: the host with each thing (module, set, business) that a column names."""
    parts = [hosts.where(F.col(c).isNotNull()).select(F.lit(f"host_with_{name}_relation").alias("relation"), F.col(host).cast("string").alias("source"), F.col(c).cast("string").alias("target")) for name, c in links.items()]
    return reduce(DataFrame.unionByName, parts).distinct()
