"""Queries of record cleaning, telemetry processors, traces, topology, detection and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidegauge.functions.timeutil import event_ms
from tidegauge.operators import detect, etl, telemetry, topology
from tidegauge.queries import Registry, table
from tidegauge.session import scratch
from tidegauge.sources.readers import bulk_sink
from tidegauge.streaming import pipelines

registry = Registry()
q = registry.add
HOUR, DAY = 3_600_000, 86_400_000


def events(spark, folder):
    return table(spark, folder, "events").withColumn("t", event_ms(F.col("ts")))


# Record cleaning

@q("e01_json_map", "SELECT event_id, json_extract_string(props, '$.k') AS k FROM events")
def _(spark, folder):
    return events(spark, folder).select("event_id", F.try_element_at(etl.parse_json(F.col("props")), F.lit("k")).alias("k"))


@q("e02_json_rest", "SELECT doc_id, starts_with(ltrim(text), '{') AND json_valid(text) AS is_json FROM documents WHERE text IS NOT NULL AND length(text) < 400")
def _(spark, folder):
    df = table(spark, folder, "documents").where("text is not null and length(text) < 400")
    return etl.json_with_rest(df, "text", ["ts", "level"]).select("doc_id", (~F.col("clean_failed")).alias("is_json"))


@q("e02_json_rest_all")
def _(spark, folder):
    """All documents; those without a text are no JSON. DuckDB takes trailing commas and NaN for JSON, so there is no SQL."""
    return etl.json_with_rest(table(spark, folder, "documents"), "text", ["ts", "level"]).select("doc_id", (~F.col("clean_failed")).alias("is_json"))


@q("e03_separator", "SELECT doc_id, trim(split_part(source, '/', 1)) AS kind, nullif(trim(split_part(source, '/', 2)), '') AS area FROM documents")
def _(spark, folder):
    return etl.separated(table(spark, folder, "documents"), "source", "/", ["kind", "area"]).select("doc_id", "kind", "area")


@q("e04_regex_groups", "SELECT s_suppkey, regexp_extract(s_name, '^(\\w+)#0*(\\d+)$', 2) AS num FROM supplier")
def _(spark, folder):
    return etl.by_regex(table(spark, folder, "supplier"), "s_name", r"^(?P<word_>\w+)#0*(?P<num>\d+)$").select("s_suppkey", "num")


@q("e05_jmespath", "SELECT event_id, json_extract_string(props, '$.k') AS k FROM events")
def _(spark, folder):
    return events(spark, folder).select("event_id", etl.jmes("missing || k")(F.col("props")).alias("k"))


@q("e06_paths", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def _(spark, folder):
    return events(spark, folder).select("event_id", etl.coerce(etl.first_path(F.col("props"), ["nothing", "k"]), "int").alias("k"))


@q("e07_coercion", "SELECT rec_id, TRY_CAST(regexp_replace(trim(timezone), '\\.\\d*$', '') AS BIGINT) AS tz FROM proc_test_data WHERE NOT regexp_matches(coalesce(timezone, ''), '[A-Za-z:]|^[+-]0')")
def _(spark, folder):
    df = table(spark, folder, "proc_test_data").where(~F.coalesce("timezone", F.lit("")).rlike("[A-Za-z:]|^[+-]0"))
    return df.select("rec_id", etl.coerce(F.col("timezone"), "int").alias("tz"))


@q("e10_fields", "SELECT event_id, 'web' AS origin, coalesce(TRY_CAST(json_extract_string(props, '$.k') AS BIGINT), -1) AS k, coalesce(TRY_CAST(json_extract_string(props, '$.k') AS BIGINT), -1) * 2 AS twice FROM events")
def _(spark, folder):
    df = events(spark, folder).withColumn("raw_k", etl.json_path(F.col("props"), "k"))
    return etl.with_fields(df, [{"name": "origin", "constant": "web"}, {"name": "k", "type": "int", "from": "raw_k", "default": -1}, {"name": "twice", "type": "int", "expr": "k * 2"}]).select("event_id", "origin", "k", "twice")


@q("e12_fission", "SELECT rec_id, dev.name AS name, u FROM (SELECT rec_id, unnest(data.net.dev) AS dev, data.cpu.per_usage AS us FROM net_test_data), LATERAL (SELECT unnest(us) AS u)")
def _(spark, folder):
    df = table(spark, folder, "net_test_data").select("rec_id", F.col("data.net.dev").alias("dev"), F.col("data.cpu.per_usage").alias("u"))
    return etl.fission(df, ["dev", "u"]).where("dev is not null and u is not null").select("rec_id", "dev.name", "u")


@q("e13_payload_items", "SELECT rec_id, CAST(i - 1 AS INT) AS index, perf[i].name AS name FROM (SELECT rec_id, data.perf AS perf, unnest(range(1, len(data.perf) + 1)) AS i FROM proc_test_data)")
def _(spark, folder):
    df = table(spark, folder, "proc_test_data").select("rec_id", F.col("data.perf").alias("perf"))
    return etl.payload_items(df, "perf").where("item is not null").select("rec_id", "index", "item.name")


@q("e14_time_series_record", "SELECT rec_id, CAST(epoch_us(recv_time) // 1000000 AS BIGINT) AS time, ip, data.cpu.total_usage AS usage FROM net_test_data WHERE data.cpu.total_usage IS NOT NULL AND NOT isnan(data.cpu.total_usage) AND ip IS NOT NULL")
def _(spark, folder):
    df = table(spark, folder, "net_test_data").where("data.cpu.total_usage is not null and not isnan(data.cpu.total_usage) and ip is not null")
    rec = etl.time_series_record(F.unix_seconds(F.col("recv_time").cast("timestamp")), {"usage": F.col("data.cpu.total_usage")}, {"ip": F.col("ip")})
    out = df.select("rec_id", rec.alias("r")).where(etl.valid_record(F.col("r.time"), F.col("r.metrics"), F.col("r.dimensions")))
    return out.select("rec_id", "r.time", F.try_element_at("r.dimensions", F.lit("ip")).alias("ip"), F.try_element_at("r.metrics", F.lit("usage")).alias("usage"))


@q("e15_flat_batch", "SELECT ip, dataid, dev.name AS name, dev.errors AS errors FROM (SELECT ip, dataid, unnest(data.net.dev) AS dev FROM net_test_data)")
def _(spark, folder):
    df = table(spark, folder, "net_test_data").select("ip", "dataid", F.col("data.net.dev").alias("items"))
    return etl.flat_batch(df, "items", ["ip", "dataid"]).select("ip", "dataid", "name", "errors")


@q("e17_exporter_filter", "SELECT p_partkey FROM part WHERE regexp_full_match(p_name, 'hot.*|large.*') AND NOT regexp_full_match(p_name, '.*bolt')")
def _(spark, folder):
    return etl.exporter_samples(table(spark, folder, "part"), "p_name", ["hot.*", "large.*"], [".*bolt"]).select("p_partkey")


@q("e21_texts_and_numbers", "SELECT event_id, TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k FROM events")
def _(spark, folder):
    m = etl.as_numbers(etl.without_empty(etl.parse_json(F.col("props"))))
    return events(spark, folder).select("event_id", F.try_element_at(m, F.lit("k")).alias("k"))


@q("e22_fill_by_lookup", "SELECT c_custkey, s_suppkey FROM customer LEFT JOIN supplier ON s_nationkey = c_nationkey")
def _(spark, folder):
    hosts = table(spark, folder, "supplier").groupBy(F.col("s_nationkey").alias("c_nationkey")).agg(F.collect_list("s_suppkey").alias("ids"))
    return etl.fill_by_lookup(table(spark, folder, "customer"), hosts, ["c_nationkey"], "ids", "s_suppkey").select("c_custkey", "s_suppkey")


@q("e24_cut_by_level", "SELECT n_nationkey, 'region' AS level_name, CAST(n_regionkey AS VARCHAR) AS level_id FROM nation UNION ALL SELECT n_nationkey, 'nation', CAST(n_nationkey AS VARCHAR) FROM nation")
def _(spark, folder):
    levels = F.create_map(F.lit("region"), F.col("n_regionkey").cast("string"), F.lit("nation"), F.col("n_nationkey").cast("string"))
    return etl.cut_by_level(table(spark, folder, "nation").select("n_nationkey", levels.alias("l")), "l")


@q("e25_cut_by_meta", "SELECT n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey")
def _(spark, folder):
    meta = table(spark, folder, "region").withColumnRenamed("r_regionkey", "n_regionkey")
    return etl.cut_by_meta(table(spark, folder, "nation"), meta, ["n_regionkey"]).select("n_name", "r_name")


@q("e26_wide_to_long", "SELECT rec_id, metric, value FROM (SELECT rec_id, data.load.load_avg.load1 AS load1, data.load.load_avg.load5 AS load5, data.load.load_avg.load15 AS load15 FROM net_test_data) UNPIVOT INCLUDE NULLS (value FOR metric IN (load1, load5, load15))")
def _(spark, folder):
    df = table(spark, folder, "net_test_data").select("rec_id", *[F.col(f"data.load.load_avg.{c}").alias(c) for c in ("load1", "load5", "load15")])
    return etl.unpivot_columns(df, ["rec_id"], ["load1", "load5", "load15"])


@q("e27_rounded_time", "SELECT event_id, CAST((epoch_us(ts) // 1000 + 30000) // 60000 * 60000 AS BIGINT) AS t FROM events")
def _(spark, folder):
    return events(spark, folder).select("event_id", etl.rounded_time(F.col("t"), 60_000).alias("t"))


@q("e28_time_units", "SELECT event_id, epoch_us(ts) // 1000000 AS s, epoch_us(ts) // 1000 * 1000000 AS ns FROM events")
def _(spark, folder):
    return events(spark, folder).select("event_id", etl.time_unit(F.col("t"), "ms", "s").alias("s"), etl.time_unit(F.col("t"), "ms", "ns").alias("ns"))


@q("e36_discovery", "SELECT 'usage' AS metric, 'ip' AS dimension, count(DISTINCT ip) AS n_values FROM net_test_data WHERE ip IS NOT NULL")
def _(spark, folder):
    df = table(spark, folder, "net_test_data").where("ip is not null").select(F.create_map(F.lit("usage"), F.lit(1.0)).alias("m"), F.create_map(F.lit("ip"), F.col("ip")).alias("d"))
    return etl.discovered(df, "m", "d").select("metric", "dimension", "n_values")


@q("e37_host_cpu", "SELECT rec_id, bkmonitorbeat.hostname AS hostname, ip, CASE WHEN NOT isnan(data.cpu.total_usage) THEN data.cpu.total_usage END AS usage FROM net_test_data")
def _(spark, folder):
    df = table(spark, folder, "net_test_data").select("rec_id", F.col("bkmonitorbeat.hostname").alias("hostname"), "ip", F.col("data.cpu.total_usage").alias("usage"))
    return etl.declared_only(df, {"rec_id": "int", "hostname": "string", "ip": "string", "usage": "float"})


@q("e38_process_perf", "SELECT p.name AS name, count(*) AS n, max(p.fd_open) AS most FROM (SELECT unnest(data.perf) AS p FROM proc_test_data) GROUP BY 1")
def _(spark, folder):
    rows = table(spark, folder, "proc_test_data").select(F.explode("data.perf").alias("p"))
    return rows.groupBy("p.name").agg(F.count(F.lit(1)).alias("n"), F.max("p.fd_open").alias("most"))


@q("e39_alert_names", "SELECT event_id, CASE WHEN TRY_CAST(json_extract_string(props, '$.k') AS INT) IN (1, 2) THEN 'low' WHEN regexp_matches(json_extract_string(props, '$.k'), '^9') THEN 'high' ELSE 'other' END AS alert_name FROM events")
def _(spark, folder):
    rules = [{"name": "low", "conditions": [{"key": "k", "method": "eq", "value": ["1", "2"]}]}, {"name": "high", "conditions": [{"key": "k", "method": "reg", "value": ["^9"]}]}]
    return etl.match_alerts(events(spark, folder).withColumnRenamed("props", "raw"), rules, "other").select("event_id", "alert_name")


@q("e40_keyword_events", "SELECT doc_id, 'retry' AS rule, regexp_extract(text, 'retry (\\d+) of (\\d+)', 1) AS attempt FROM documents WHERE regexp_matches(text, 'WARN|ERROR|INFO') AND regexp_matches(text, 'retry (\\d+) of (\\d+)')")
def _(spark, folder):
    out = etl.keyword_events(table(spark, folder, "documents"), "text", ["WARN", "ERROR", "INFO"], {"retry": r"retry (?P<attempt_no>\d+) of (?P<most>\d+)"})
    return out.select("doc_id", "rule", F.try_element_at("dimensions", F.lit("attempt_no")).alias("attempt"))


@q("e45_relabel", "SELECT span_id, trace_id, time, resource['service.name'] || '/' || span_name AS target FROM complex WHERE regexp_full_match(resource['service.name'], 'q.*')")
def _(spark, folder):
    labels = F.map_concat(F.create_map(F.lit("__name__"), F.col("span_name"), F.lit("svc"), F.try_element_at("resource", F.lit("service.name"))))
    df = table(spark, folder, "complex").select("span_id", "trace_id", "time", labels.alias("labels"))
    out = etl.relabel(df, [{"source_labels": ["svc"], "regex": "q.*", "action": "keep"}, {"source_labels": ["svc", "__name__"], "separator": "/", "target_label": "target"}])
    return out.select("span_id", "trace_id", "time", F.try_element_at("labels", F.lit("target")).alias("target"))


@q("e46_delta_rate", "SELECT user_id, t, round((value - pv) / ((t - pt) / 1000.0), 6) + 0.0 AS delta FROM (SELECT user_id, epoch_us(ts) // 1000 AS t, value, lag(value) OVER w AS pv, lag(epoch_us(ts) // 1000) OVER w AS pt FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)) WHERE pv IS NOT NULL AND t > pt")
def _(spark, folder):
    out = etl.series_delta(events(spark, folder), ["user_id"], "t", "value", "value_rate")
    return out.select("user_id", "t", (F.round(F.col("delta") * 1000, 6) + 0.0).alias("delta"))


@q("e47_keyword_counts", f"SELECT 'purchase' AS rule, t AS period, count(*) AS n FROM (SELECT epoch_us(ts) // 1000 // {DAY} * {DAY} AS t FROM events WHERE event_type = 'purchase') GROUP BY 2")
def _(spark, folder):
    found = etl.keyword_events(events(spark, folder), "event_type", [], {"purchase": "^purchase$"})
    return etl.count_keywords(found, "t", "props", DAY).select("rule", "period", "n")


@q("e48_cardinality_guard", "SELECT event_id FROM events WHERE user_id IN (SELECT user_id FROM events GROUP BY 1 ORDER BY min(epoch_us(ts) // 1000), user_id LIMIT 20)")
def _(spark, folder):
    return etl.guard_cardinality(events(spark, folder), ["user_id"], "t", 20).select("event_id")


# Telemetry processors

def spans(spark, folder):
    return table(spark, folder, "complex")


@q("c01_assemble", "SELECT span_id, trace_id, time, concat_ws(':', coalesce(attributes['http.method'], '-'), coalesce(attributes['db.system'], '-')) AS v FROM complex")
def _(spark, folder):
    m = telemetry.assemble(F.col("attributes"), "x", ["http.method", "db.system"], ":", "-")
    return spans(spark, folder).select("span_id", "trace_id", "time", F.try_element_at(m, F.lit("x")).alias("v"))


@q("c02_resource_filter", "SELECT span_id, trace_id, time, resource['net.host.ip'] AS host, coalesce(resource['zone'], 'none') AS zone FROM complex")
def _(spark, folder):
    m = telemetry.default_value(telemetry.replace_key(F.col("resource"), "net.host.ip", "host"), {"zone": "none"})
    return spans(spark, folder).select("span_id", "trace_id", "time", F.try_element_at(m, F.lit("host")).alias("host"), F.try_element_at(m, F.lit("zone")).alias("zone"))


@q("c04_method_filter", "SELECT span_id, trace_id, time FROM complex WHERE NOT (kind = 3 AND starts_with(span_name, 'UPDATE'))")
def _(spark, folder):
    return telemetry.dropped_spans(spans(spark, folder), [{"kind": 3, "rules": [{"op": "startswith", "value": "UPDATE"}]}]).select("span_id", "trace_id", "time")


@q("c06_field_normaliser", "SELECT span_id, trace_id, time, coalesce(attributes['peer'], attributes['http.method'], attributes['db.system']) AS peer FROM complex")
def _(spark, folder):
    m = telemetry.normalise_field(F.col("attributes"), "peer", ["http.method", "db.system"])
    return spans(spark, folder).select("span_id", "trace_id", "time", F.try_element_at(m, F.lit("peer")).alias("peer"))


@q("c08_slow_queries", "SELECT span_id, trace_id, time, CASE WHEN coalesce(attributes['db.system'], '') <> '' THEN elapsed_time > (CASE lower(attributes['db.system']) WHEN 'redis' THEN 5000 ELSE 20000 END) END AS slow FROM complex")
def _(spark, folder):
    slow = telemetry.slow_query(F.try_element_at("attributes", F.lit("db.system")), F.col("elapsed_time"), {"redis": 5}, 20)
    return spans(spark, folder).select("span_id", "trace_id", "time", slow.alias("slow"))


@q("c09_apdex", "SELECT event_type, CASE WHEN value <= 30 THEN 'satisfied' WHEN value <= 120 THEN 'tolerating' ELSE 'frustrated' END AS apdex_type, count(*) AS n FROM events GROUP BY 1, 2")
def _(spark, folder):
    return events(spark, folder).groupBy("event_type", telemetry.apdex(F.col("value"), 30).alias("apdex_type")).agg(F.count(F.lit(1)).alias("n"))


@q("c10_derived_buckets", "SELECT service, unnest(['1000', '10000', '100000', '+Inf']) AS le, unnest([a, b, c, n]) AS bucket_count, n, sum, min, max FROM (SELECT resource['service.name'] AS service, count(*) AS n, CAST(sum(elapsed_time) AS BIGINT) AS sum, min(elapsed_time) AS min, max(elapsed_time) AS max, count(*) FILTER (elapsed_time <= 1000) AS a, count(*) FILTER (elapsed_time <= 10000) AS b, count(*) FILTER (elapsed_time <= 100000) AS c FROM complex GROUP BY 1)")
def _(spark, folder):
    df = spans(spark, folder).withColumn("service", F.try_element_at("resource", F.lit("service.name")))
    return telemetry.derive(df, ["service"], "elapsed_time", [1000, 10_000, 100_000])


@q("c10_interval_deltas", f"SELECT event_type, t AS interval, count(*) AS delta, CAST(sum(count(*)) OVER (PARTITION BY event_type ORDER BY t) AS BIGINT) AS total FROM (SELECT event_type, epoch_us(ts) // 1000 // {DAY} * {DAY} AS t FROM events) GROUP BY 1, 2")
def _(spark, folder):
    return telemetry.delta_per_interval(events(spark, folder), ["event_type"], "t", DAY)


@q("c13_random_sampler")
def _(spark, folder):
    return telemetry.sampled_random(spans(spark, folder), 25).select("trace_id", "span_id", "time")


@q("c13_status_sampler", "SELECT trace_id, span_id, time FROM complex WHERE trace_id IN (SELECT trace_id FROM complex WHERE status.code = 2)")
def _(spark, folder):
    return telemetry.sampled_by_status(spans(spark, folder), [2]).select("trace_id", "span_id", "time")


@q("c14_rate_limit", "SELECT rec_id FROM (SELECT rec_id, row_number() OVER (PARTITION BY epoch_us(recv_time) // 1000000 ORDER BY epoch_us(recv_time) // 1000, rec_id) AS k FROM net_test_data) WHERE k <= 1")
def _(spark, folder):
    df = table(spark, folder, "net_test_data").withColumn("ms", event_ms(F.col("recv_time")))
    return telemetry.rate_limited(df, "ms", 1, order=["rec_id"]).select("rec_id")


@q("c15_text_splitter", "SELECT doc_id, line FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents) WHERE line <> ''")
def _(spark, folder):
    return telemetry.split_text(table(spark, folder, "documents").select("doc_id", F.col("text").alias("line")), "line")


@q("c19_histogram_points", "SELECT event_type, le, v FROM (SELECT event_type, unnest(['50', '100', '+Inf']) AS le, unnest([a, b, n]) AS v FROM (SELECT event_type, CAST(count(*) FILTER (value <= 50) AS DOUBLE) AS a, CAST(count(*) FILTER (value <= 100) AS DOUBLE) AS b, CAST(count(*) AS DOUBLE) AS n FROM events GROUP BY 1))")
def _(spark, folder):
    v = F.col("value")
    points = events(spark, folder).groupBy("event_type").agg(
        F.count(F.lit(1)).alias("count"), F.sum(v).alias("sum"), F.min(v).alias("min"), F.lit(None).cast("double").alias("max"),
        F.array(F.count_if(v <= 50), F.count_if((v > 50) & (v <= 100)), F.count_if(v > 100)).alias("counts"))
    points = points.select(F.lit("h").alias("metric"), F.create_map(F.lit("event_type"), F.col("event_type")).alias("labels"), F.lit(0).alias("t"), "count", "sum", "min", "max", F.array(F.lit(50), F.lit(100)).alias("bounds"), "counts")
    out = telemetry.histogram_rows(points).where("metric = 'h_bucket'")
    return out.select(F.try_element_at("labels", F.lit("event_type")).alias("event_type"), F.try_element_at("labels", F.lit("le")).alias("le"), "v")


@q("c21_text_exposition", "SELECT 'ev' AS metric, event_type AS kind, value AS v, epoch_us(ts) // 1000 AS t FROM events")
def _(spark, folder):
    line = F.concat(F.lit('ev{kind="'), F.col("event_type"), F.lit('",x="a\\"b"} '), F.col("value").cast("string"), F.lit(" "), F.col("t").cast("string"))
    out = telemetry.exposition_rows(events(spark, folder).select(line.alias("value")))
    return out.select("metric", F.try_element_at("labels", F.lit("kind")).alias("kind"), "v", "t")


# Traces and topology

@q("g01_sessions", """SELECT user_id, min(ts) AS "start", max(ts) + INTERVAL 6 HOUR AS "end", count(*) AS n FROM (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS s FROM (
    SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) <= INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM events)) GROUP BY user_id, s""".replace('min(ts) AS "start", max(ts) + INTERVAL 6 HOUR AS "end"', "epoch_us(min(ts)) AS start_us, epoch_us(max(ts)) + 21600000000 AS end_us"))
def _(spark, folder):
    df = topology.session_windows(table(spark, folder, "events").withColumn("ts", F.col("ts").cast("timestamp")), "user_id", "ts", 21_600)
    return df.select("user_id", F.unix_micros("start").alias("start_us"), F.unix_micros("end").alias("end_us"), "n")


_ONCE = "(SELECT DISTINCT ON (trace_id, lower(span_id)) trace_id, lower(span_id) AS span_id, kind, start_time, end_time, status, resource, attributes, CASE WHEN regexp_matches(lower(trim(parent_span_id)), '[^0]') THEN lower(trim(parent_span_id)) END AS parent FROM complex)"


@q("g03_trace_info", f"SELECT trace_id, count(*) AS span_count, count(DISTINCT resource['service.name']) AS service_count, min(start_time) AS min_start_time, max(end_time) AS max_end_time, count(*) FILTER (status.code = 2) AS error_count, count(*) FILTER (kind IN (2, 3)) AS kind_sync FROM {_ONCE} GROUP BY 1")
def _(spark, folder):
    return topology.trace_info(spans(spark, folder)).select("trace_id", "span_count", "service_count", "min_start_time", "max_end_time", "error_count", "kind_sync")


@q("g04_tree_depth", f"""WITH RECURSIVE n AS {_ONCE}, r AS (SELECT n.trace_id, n.span_id, n.parent, p.span_id IS NULL AS is_root FROM n LEFT JOIN n p ON p.trace_id = n.trace_id AND p.span_id = n.parent),
    d AS (SELECT trace_id, span_id, 0 AS depth FROM r WHERE is_root UNION ALL SELECT r.trace_id, r.span_id, d.depth + 1 FROM r JOIN d ON d.trace_id = r.trace_id AND d.span_id = r.parent WHERE NOT r.is_root)
    SELECT trace_id, CAST(max(depth) + 1 AS BIGINT) AS levels FROM d GROUP BY 1""")  # fmt: skip
def _(spark, folder):
    return topology.with_depth(spans(spark, folder)).where("depth >= 0").groupBy("trace_id").agg((F.max("depth") + 1).alias("levels"))


@q("g06_ancestor_pairs", f"""WITH RECURSIVE n AS {_ONCE}, r AS (SELECT n.trace_id, n.span_id, n.parent, p.span_id IS NULL AS is_root FROM n LEFT JOIN n p ON p.trace_id = n.trace_id AND p.span_id = n.parent),
    ok AS (SELECT trace_id, span_id FROM r WHERE is_root UNION ALL SELECT r.trace_id, r.span_id FROM r JOIN ok ON ok.trace_id = r.trace_id AND ok.span_id = r.parent WHERE NOT r.is_root),
    e AS (SELECT r.trace_id, r.parent AS a, r.span_id AS d FROM r JOIN ok ON ok.trace_id = r.trace_id AND ok.span_id = r.span_id WHERE NOT r.is_root),
    p AS (SELECT trace_id, a, d, 1 AS distance FROM e UNION ALL SELECT p.trace_id, e.a, p.d, p.distance + 1 FROM p JOIN e ON e.trace_id = p.trace_id AND e.d = p.a)
    SELECT trace_id, a AS ancestor, d AS descendant, CAST(distance AS BIGINT) AS distance FROM p""")  # fmt: skip
def _(spark, folder):
    return topology.ancestor_pairs(spans(spark, folder))


@q("g07_call_pairs", f"WITH n AS {_ONCE} SELECT c.trace_id, p.span_id AS caller, c.span_id AS callee FROM n c JOIN n p ON p.trace_id = c.trace_id AND p.span_id = c.parent WHERE (p.kind = 3 AND c.kind = 2) OR (p.kind = 4 AND c.kind = 5)")
def _(spark, folder):
    return topology.call_pairs(spans(spark, folder)).select("trace_id", "caller", "callee")


@q("g08_categories", """SELECT span_id, trace_id, time, CASE WHEN (attributes['messaging.destination'] IS NOT NULL OR attributes['messaging.system'] IS NOT NULL OR attributes['messaging.destination_kind'] IS NOT NULL) AND (attributes['messaging.kafka.message_key'] IS NOT NULL OR attributes['messaging.rabbitmq.routing_key'] IS NOT NULL OR attributes['messaging.rocketmq.message_keys'] IS NOT NULL) THEN 'messaging'
    WHEN attributes['messaging.destination'] IS NOT NULL OR attributes['messaging.system'] IS NOT NULL OR attributes['messaging.destination_kind'] IS NOT NULL OR attributes['celery.task_name'] IS NOT NULL OR attributes['celery.action'] IS NOT NULL THEN 'async_backend'
    WHEN attributes['db.system'] IS NOT NULL OR attributes['db.name'] IS NOT NULL OR attributes['db.operation'] IS NOT NULL OR attributes['db.statement'] IS NOT NULL THEN 'db'
    WHEN attributes['rpc.method'] IS NOT NULL OR attributes['rpc.service'] IS NOT NULL OR attributes['rpc.system'] IS NOT NULL THEN 'rpc'
    WHEN attributes['http.method'] IS NOT NULL OR attributes['http.url'] IS NOT NULL OR attributes['http.host'] IS NOT NULL OR attributes['http.status_code'] IS NOT NULL OR attributes['net.peer.name'] IS NOT NULL OR attributes['peer.service'] IS NOT NULL THEN 'http' END AS category FROM complex""")  # fmt: skip
def _(spark, folder):
    return spans(spark, folder).select("span_id", "trace_id", "time", topology.category(F.col("attributes")).alias("category"))


@q("g09_late_spans", "SELECT count(*) AS n FROM complex WHERE trace_id IN (SELECT trace_id FROM complex WHERE status.code = 2)")
def _(spark, folder):
    df = spans(spark, folder)
    late = df.where("status.code = 2")
    return topology.merged_traces(df.where("status.code != 2 or status.code is null"), late).agg(F.count(F.lit(1)).alias("n"))


@q("g10_membership", "SELECT count(DISTINCT trace_id) AS n FROM complex WHERE status.code = 2")
def _(spark, folder):
    """The filter passes all members; an exact check behind it takes out the few others."""
    df = spans(spark, folder)
    errors = df.where("status.code = 2")
    near = topology.maybe_members(df, "trace_id", topology.membership(errors, "trace_id", 100_000))
    return near.join(errors.select("trace_id").distinct(), "trace_id", "left_semi").agg(F.count_distinct("trace_id").alias("n"))


@q("g11_relations", "SELECT DISTINCT 'service_with_instance_relation' AS metric, resource['service.name'] AS source, resource['bk.instance.id'] AS target FROM complex WHERE resource['service.name'] IS NOT NULL AND resource['bk.instance.id'] IS NOT NULL UNION SELECT DISTINCT 'instance_with_system_relation', resource['bk.instance.id'], resource['net.host.ip'] FROM complex WHERE resource['bk.instance.id'] IS NOT NULL AND resource['net.host.ip'] IS NOT NULL")
def _(spark, folder):
    return topology.relation_metrics(spans(spark, folder))


@q("g12_service_flows", f"WITH n AS {_ONCE} SELECT p.resource['service.name'] AS from_service, c.resource['service.name'] AS to_service, count(*) AS n, count(*) FILTER (c.status.code = 2) AS errors FROM n c JOIN n p ON p.trace_id = c.trace_id AND p.span_id = c.parent WHERE (p.kind = 3 AND c.kind = 2) OR (p.kind = 4 AND c.kind = 5) GROUP BY 1, 2")
def _(spark, folder):
    out = topology.flow_stats(topology.call_pairs(spans(spark, folder)), ["from_service", "to_service"], [1000, 100_000])
    return out.where("le = '+Inf'").select("from_service", "to_service", "n", "errors")


@q("g14_topology_path", "SELECT DISTINCT o_orderkey FROM region JOIN nation ON n_regionkey = r_regionkey JOIN customer ON c_nationkey = n_nationkey JOIN orders ON o_custkey = c_custkey WHERE r_name = 'ASIA'")
def _(spark, folder):
    t = lambda n: table(spark, folder, n)
    relations = {("region", "nation"): t("nation").select(F.col("n_regionkey").alias("r_regionkey"), "n_nationkey"), ("nation", "customer"): t("customer").select(F.col("c_nationkey").alias("n_nationkey"), "c_custkey"), ("customer", "order"): t("orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderkey")}
    keys = {"region": ["r_regionkey"], "nation": ["n_nationkey"], "customer": ["c_custkey"], "order": ["o_orderkey"]}
    path = topology.resource_paths(list(relations), "region", "order")[0]
    return topology.follow_path(t("region").where("r_name = 'ASIA'"), path, relations, keys)


@q("g16_inventory_relations", "SELECT DISTINCT 'host_with_nation_relation' AS relation, CAST(s_suppkey AS VARCHAR) AS source, CAST(s_nationkey AS VARCHAR) AS target FROM supplier")
def _(spark, folder):
    return topology.inventory_relations(table(spark, folder, "supplier"), "s_suppkey", {"nation": "s_nationkey"})


# Detection

LEVELS = {1: {"algorithms": [{"config": [[{"method": "gte", "threshold": 150}], [{"method": "lt", "threshold": 1}]]}]}, 2: {"algorithms": [{"config": [{"method": "gt", "threshold": 40}]}, {"config": [{"method": "lt", "threshold": 100}]}], "connector": "and"}}


def _minutes(spark, folder):
    return events(spark, folder).groupBy("event_type", (F.floor(F.col("t") / HOUR) * 3600).cast("long").alias("at")).agg(F.max("value").alias("value"))


_M = f'SELECT event_type, (epoch_us(ts) // 1000) // {HOUR} * 3600 AS "at", max(value) AS value FROM events GROUP BY 1, 2'


@q("d01_thresholds", f"SELECT event_type, \"at\", l.level, CASE l.level WHEN 1 THEN value >= 150 OR value < 1 ELSE value > 40 AND value < 100 END AS anomalous FROM ({_M}), (SELECT unnest([1, 2]) AS level) l")
def _(spark, folder):
    return detect.detect(_minutes(spark, folder), ["event_type"], "at", "value", LEVELS).select("event_type", "at", "level", "anomalous")


@q("d03_record_ids", f"SELECT md5('{{\"event_type\":\"' || event_type || '\"}}') || '.' || \"at\" AS record_id FROM ({_M})")
def _(spark, folder):
    return _minutes(spark, folder).select(detect.record_id(["event_type"], "at").alias("record_id"))


@q("d04_n_of_m", f"""WITH m AS ({_M}), a AS (SELECT event_type, "at", value >= 150 OR value < 1 AS a1, value > 40 AND value < 100 AS a2 FROM m),
    w AS (SELECT *, count(*) FILTER (a1) OVER (PARTITION BY event_type ORDER BY "at" RANGE BETWEEN 17999 PRECEDING AND CURRENT ROW) AS n1, count(*) FILTER (a2) OVER (PARTITION BY event_type ORDER BY "at" RANGE BETWEEN 10799 PRECEDING AND CURRENT ROW) AS n2 FROM a)
    SELECT event_type, "at", (a1 AND n1 >= 3) OR (a2 AND n2 >= 2) AS triggered, CASE WHEN a1 AND n1 >= 3 THEN 1 WHEN a2 AND n2 >= 2 THEN 2 END AS level FROM w""")  # fmt: skip
def _(spark, folder):
    outcomes = detect.detect(_minutes(spark, folder), ["event_type"], "at", "value", LEVELS)
    return detect.trigger(outcomes, ["event_type"], "at", {1: {"check_window": 5, "count": 3}, 2: {"check_window": 3, "count": 2}}, 3600).select("event_type", "at", "triggered", "level")


@q("d06_last_written", "SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS k FROM orders) WHERE k = 1")
def _(spark, folder):
    df = table(spark, folder, "orders").select("o_custkey", "o_orderkey", "o_orderdate")
    return detect.last_written(df, ["o_custkey"], F.struct("o_orderdate", "o_orderkey")).select("o_custkey", "o_orderkey")


@q("d07_stream_comparison", "SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN 'pending' ELSE 'complete' END AS status, CASE WHEN o_orderkey % 5 = 0 THEN 'not_eligible' WHEN o_orderkey % 3 = 0 THEN 'mismatch' ELSE 'match' END AS verdict FROM orders")
def _(spark, folder):
    o = table(spark, folder, "orders").withColumn("source_time", F.unix_seconds(F.col("o_orderdate").cast("timestamp")))
    a = o.select("o_orderkey", F.lit("x").alias("fp"))
    b = o.where("o_orderkey % 5 != 0").select("o_orderkey", F.when(F.col("o_orderkey") % 3 == 0, "y").otherwise("x").alias("fp"))
    return detect.compare_streams(o, a, b, "o_orderkey", "fp")


@q("d10_audit_batches", "SELECT o_orderstatus, CAST((row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey) - 1) // 100 AS BIGINT) AS batch, o_orderkey FROM orders")
def _(spark, folder):
    return detect.audit_batches(table(spark, folder, "orders"), ["o_orderstatus"], ["o_orderkey"], 100).select("o_orderstatus", "batch", "o_orderkey")


# Streams, driven to their end over the table's file

def _stream(spark, folder, name="events"):
    schema = table(spark, folder, name).schema
    return spark.readStream.schema(schema).format("parquet").option("pathGlobFilter", f"{name}.parquet").load(folder)


def _drained(spark, out, mode="append"):
    """Run a stream until its input is used up; its rows as a table."""
    path = scratch(spark, "stream")
    if mode == "append":
        pipelines.start(out, f"{path}/out", f"{path}/checkpoint").awaitTermination()
        return spark.read.schema(out.schema).parquet(f"{path}/out")
    batches = bulk_sink(lambda df, _id: df.write.mode("overwrite").parquet(f"{path}/out"))
    pipelines.start(out, batches, f"{path}/checkpoint", mode).awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{path}/out")


@q("stream_windows", f"SELECT event_type, (epoch_us(ts) // 1000) // {DAY} * {DAY} AS t, count(*) AS n FROM events GROUP BY 1, 2")
def _(spark, folder):
    s = _stream(spark, folder).withColumn("ts", F.col("ts").cast("timestamp"))
    out = pipelines.windowed(s, "ts", ["event_type"], [F.count(F.lit(1)).alias("n")], "1 day", lateness="40 days")
    return _drained(spark, out, "complete").select("event_type", F.unix_millis("start").alias("t"), "n")


@q("stream_deltas", "SELECT user_id, event_id AS \"at\", round(value - pv, 6) + 0.0 AS delta FROM (SELECT user_id, event_id, value, lag(value) OVER (PARTITION BY user_id ORDER BY event_id) AS pv FROM events) WHERE pv IS NOT NULL")
def _(spark, folder):
    s = _stream(spark, folder).select("user_id", F.col("event_id").alias("at"), "value")
    return _drained(spark, pipelines.deltas(s, "user_id", "at", "value")).withColumn("delta", F.round("delta", 6) + 0.0)


@q("stream_triggers", f"""WITH a AS (SELECT event_id, epoch_us(ts) // 1000000 AS "at", value > 60 AS anomalous FROM events WHERE event_type = 'error' AND user_id < 40)
    SELECT "at", anomalous AND n >= 3 AS triggered, n AS anomalies FROM (SELECT "at", anomalous, count(*) FILTER (anomalous) OVER (ORDER BY "at" RANGE BETWEEN 86399 PRECEDING AND CURRENT ROW) AS n FROM a)""")  # fmt: skip
def _(spark, folder):
    s = _stream(spark, folder).where("event_type = 'error' and user_id < 40")
    s = s.select("event_type", F.unix_seconds(F.col("ts").cast("timestamp")).alias("at"), (F.col("value") > 60).alias("anomalous"))
    return _drained(spark, pipelines.triggers(s, "event_type", "at", {"check_window": 24, "count": 3}, 3600)).select("at", "triggered", "anomalies")


@q("stream_triggers_all", """WITH a AS (SELECT event_id, epoch_us(ts) // 1000000 AS "at", value > 60 AS anomalous FROM events WHERE event_type = 'error')
    SELECT "at", anomalous AND n >= 3 AS triggered, n AS anomalies FROM (SELECT "at", anomalous, count(*) FILTER (anomalous) OVER (ORDER BY "at" RANGE BETWEEN 86399 PRECEDING AND CURRENT ROW) AS n FROM a)""")  # fmt: skip
def _(spark, folder):
    """Of all users; events of one second count each."""
    s = _stream(spark, folder).where("event_type = 'error'")
    s = s.select("event_type", "event_id", F.unix_seconds(F.col("ts").cast("timestamp")).alias("at"), (F.col("value") > 60).alias("anomalous"))
    return _drained(spark, pipelines.triggers(s, "event_type", "at", {"check_window": 24, "count": 3}, 3600, "event_id", DAY // 1000)).select("at", "triggered", "anomalies")
