"""Further queries of the operator inventory."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from tidegauge.catalog import Catalog, TableMeta, series_of
from tidegauge.functions.timeutil import event_ms
from tidegauge.operators import aggregate, detect, etl, merge, rawrows, telemetry, topology
from tidegauge.operators.conditions import Condition
from tidegauge.plans import lucene, sqldialect, structured
from tidegauge.plans.promql import evaluate
from tidegauge.queries import Registry, table
from tidegauge.session import scratch
from tidegauge.sources import readers

registry = Registry()
q = registry.add
HOUR, DAY, JAN = 3_600_000, 86_400_000, 1_704_067_200_000


def events(spark, folder):
    return table(spark, folder, "events").withColumn("t", event_ms(F.col("ts")))


@q("s04_day_shards", "SELECT event_id FROM events WHERE strftime(ts, '%Y%m%d') IN ('20240103', '20240104')")
def _(spark, folder):
    path = scratch(spark, "days")
    events(spark, folder).withColumn("dt", F.date_format(F.col("ts").cast("timestamp"), "yyyyMMdd")).write.partitionBy("dt").parquet(path)
    return readers.day_shards(spark, path, ["20240103", "20240104"]).select("event_id")


@q("s13_cluster_metrics", f"SELECT event_type, (epoch_us(ts) // 1000) // {DAY} * {DAY} AS _time, max(value) AS _value FROM events GROUP BY 1, 2")
def _(spark, folder):
    return aggregate.grouped(readers.PathSource(spark, f"{folder}/events.parquet").rows().withColumn("t", event_ms(F.col("ts"))), ["event_type"], "max_over_time", "value", DAY, "t")


@q("s15_table_resolution", "SELECT count(*) AS n FROM customer")
def _(spark, folder):
    c = Catalog([TableMeta("a", values=["c_acctbal"], labels={"kind": "x"}), TableMeta("b", lambda: table(spark, folder, "customer").withColumn("time", F.lit(0)), values=["c_acctbal"], labels={"kind": "y"})])
    found = c.resolve("c_acctbal", pattern="c_.*", labels={"kind": "y"})[0]
    return c.scan(found.name, 0, 1).agg(F.count(F.lit(1)).alias("n"))


@q("s18_json_files", "SELECT n_nationkey, n_name FROM nation")
def _(spark, folder):
    path = scratch(spark, "json")
    table(spark, folder, "nation").write.json(path)
    return readers.PathSource(spark, path, "json", "n_nationkey int, n_name string, n_regionkey int").rows().select("n_nationkey", "n_name")


@q("s21_otlp_spans", "SELECT trace_id, span_id, span_name, start_time, end_time FROM complex WHERE start_time > 1000000000000000 AND start_time < 100000000000000000 AND end_time IS NOT NULL")
def _(spark, folder):
    df = table(spark, folder, "complex").where("start_time > 1000000000000000 and start_time < 100000000000000000 and end_time is not null")
    span = F.struct(F.col("trace_id").alias("traceId"), F.col("span_id").alias("spanId"), F.col("span_name").alias("name"), F.col("kind").alias("kind"),
        F.concat(F.col("start_time").cast("string"), F.lit("789")).alias("startTimeUnixNano"), F.concat(F.col("end_time").cast("string"), F.lit("789")).alias("endTimeUnixNano"))
    payload = F.to_json(F.struct(F.array(F.struct(F.struct(F.array(F.struct(F.lit("service.name").alias("key"), F.struct(F.lit("x").alias("stringValue")).alias("value"))).alias("attributes")).alias("resource"), F.array(F.struct(F.array(span).alias("spans"))).alias("scopeSpans"))).alias("resourceSpans")))
    return telemetry.spans_of_otlp(df.select(payload.alias("value"))).select("trace_id", "span_id", "span_name", "start_time", "end_time")


@q("f21_search_body", "SELECT 1 AS parts")
def _(spark, folder):
    body = lucene.to_search('level:error AND NOT host:"a b"')
    return spark.range(1).select(F.lit(1 if set(body) == {"bool"} and "must" in json.dumps(body) else 0).alias("parts"))


@q("f26_table_labels", "SELECT 'b' AS name")
def _(spark, folder):
    c = Catalog([TableMeta("a", labels={"scene": "log"}), TableMeta("b", labels={"scene": "host"})])
    return spark.createDataFrame([(t.name,) for t in c.resolve(labels={"scene": "host"})], "name string")


@q("a16_more_dimensions", "SELECT event_type, user_id % 3 AS third, count(*) AS _value FROM events GROUP BY 1, 2")
def _(spark, folder):
    return aggregate.grouped(events(spark, folder).withColumn("third", F.col("user_id") % 3), ["event_type", "third"], "count", "*")


@q("a18_having", "SELECT user_id, count(*) AS n FROM events GROUP BY 1 HAVING count(*) > 60")
def _(spark, folder):
    return aggregate.grouped(events(spark, folder), ["user_id"], "count", "*").where("_value > 60").withColumnRenamed("_value", "n")


@q("m08_sample_union", "SELECT user_id, epoch_us(ts) // 1000 AS t FROM events WHERE event_type IN ('click', 'view')")
def _(spark, folder):
    parts = [events(spark, folder).where(F.col("event_type") == k).select("user_id", "t") for k in ("click", "view")]
    return parts[0].unionByName(parts[1]).orderBy("user_id", "t")


@q("m09_partial_results", "SELECT n_nationkey FROM nation")
def _(spark, folder):
    done, failed = merge.partial({"good": lambda: table(spark, folder, "nation"), "gone": lambda: table(spark, folder, "nothing_here")})
    assert list(failed) == ["gone"]
    return done[0].select("n_nationkey")


@q("m15_consumed_offsets", "SELECT kind, count(*) AS consumed FROM (SELECT 'c' AS kind, c_acctbal AS bal, c_custkey AS id FROM customer UNION ALL SELECT 's', s_acctbal, s_suppkey FROM supplier ORDER BY bal DESC, kind, id LIMIT 100) GROUP BY 1")
def _(spark, folder):
    a = table(spark, folder, "customer").select(F.lit("c").alias("kind"), F.col("c_acctbal").alias("bal"), F.col("c_custkey").alias("id"))
    b = table(spark, folder, "supplier").select(F.lit("s").alias("kind"), F.col("s_acctbal").alias("bal"), F.col("s_suppkey").alias("id"))
    return rawrows.consumed(rawrows.page(a.unionByName(b), [F.col("bal").desc(), F.col("kind"), F.col("id")], 0, 100), "kind")


@q("m26_series_of_rows", "SELECT event_type, CAST(user_id AS VARCHAR) AS \"user\", count(*) AS points FROM events GROUP BY 1, 2")
def _(spark, folder):
    s = series_of(events(spark, folder).withColumn("user", F.col("user_id").cast("string")), "e", ["event_type", "user"], F.col("t"), F.col("value"))
    out = s.groupBy(F.try_element_at("labels", F.lit("event_type")).alias("event_type"), F.try_element_at("labels", F.lit("user")).alias("user"))
    return out.agg(F.size(F.sort_array(F.collect_list(F.struct("t", "v")))).cast("long").alias("points"))


@q("promql32_folded_arguments", f"SELECT event_type, {JAN + 10 * DAY} AS t, round(quantile_cont(v, 0.5), 6) AS v FROM (SELECT event_type, user_id, arg_max(value, ts) AS v FROM events WHERE epoch_us(ts) // 1000 BETWEEN {JAN + 9 * DAY} AND {JAN + 10 * DAY} GROUP BY 1, 2) GROUP BY 1")
def _(spark, folder):
    s = series_of(events(spark, folder), "events", ["event_type", "user_id"], F.col("t"), F.col("value"))
    out = evaluate(s, "quantile by (event_type) (1 - 0.25 * 2, events)", JAN + 10 * DAY, JAN + 10 * DAY, HOUR, DAY)
    return out.select(F.try_element_at("labels", F.lit("event_type")).alias("event_type"), "t", F.round("v", 6).alias("v"))


@q("promql37_check", "SELECT true AS planned, 'web.events' AS tables")
def _(spark, folder):
    c = Catalog([TableMeta("web.events", lambda: events(spark, folder).withColumn("time", F.col("t")), values=["value"], tags=["event_type"])])
    raw = {"query_list": [{"table_id": "web.events", "field_name": "value"}], "start_time": JAN, "end_time": JAN + DAY, "step": "1h"}
    told = structured.check(c, structured.Request.of(raw))
    return spark.createDataFrame([("parquet" in told["plan"], told["tables"][0])], "planned boolean, tables string")


@q("promql30_decomposition", "SELECT unnest(['a', 'b']) AS reference, unnest(['x', 'y']) AS field")
def _(spark, folder):
    raw = structured.from_promql('sum by (h) (rate(x{a="1"}[5m])) / on (h) y offset 1h')
    return spark.createDataFrame([(e["reference_name"], e["field_name"]) for e in raw["query_list"]], "reference string, field string")


@q("sql09_table_sample")
def _(spark, folder):
    return sqldialect.run(spark, "SELECT o_orderkey FROM orders TABLESAMPLE (20 PERCENT) REPEATABLE (7)", {"orders": table(spark, folder, "orders")})


@q("sql20_sketches", "SELECT event_type, true AS near FROM events GROUP BY 1")
def _(spark, folder):
    e = events(spark, folder).groupBy("event_type").agg(F.hll_sketch_estimate(F.hll_sketch_agg("user_id")).alias("about"), F.count_distinct("user_id").alias("exact"))
    return e.select("event_type", (F.abs(F.col("about") - F.col("exact")) <= F.col("exact") * 0.05 + 1).alias("near"))


@q("e08_named_layouts", "SELECT rec_id, CAST(epoch_us(strptime(data.utctime, '%Y-%m-%d %H:%M:%S')) // 1000 AS BIGINT) AS ms FROM net_test_data WHERE regexp_full_match(data.utctime, '\\d{4}-\\d{2}-\\d{2} \\d{2}:\\d{2}:\\d{2}') AND data.utctime NOT LIKE '0000%'")
def _(spark, folder):
    from tidegauge.functions.timeparse import utc_us

    df = table(spark, folder, "net_test_data").where(F.col("data.utctime").rlike(r"^\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}$") & ~F.col("data.utctime").startswith("0000"))
    return df.select("rec_id", etl.time_unit(utc_us(spark, F.col("data.utctime")), "us", "ms").alias("ms"))


@q("e09_defaults", "SELECT rec_id, coalesce(bk_host_id, -1) AS host FROM net_test_data")
def _(spark, folder):
    return etl.with_fields(table(spark, folder, "net_test_data"), [{"name": "host", "type": "int", "from": "bk_host_id", "default": -1}]).select("rec_id", "host")


@q("e16_custom_series", "SELECT rec_id AS time, p.name AS target, p.cpu_pct AS cpu FROM (SELECT rec_id, unnest(data.perf) AS p FROM proc_test_data) WHERE p.cpu_pct IS NOT NULL")
def _(spark, folder):
    item = lambda p: F.struct(p["name"].alias("target"), F.lit(None).cast("long").alias("timestamp"), F.create_map(F.lit("cpu"), p["cpu_pct"]).alias("metrics"), F.lit(None).cast("map<string,string>").alias("dimension"))
    df = table(spark, folder, "proc_test_data").select(F.lit("none").alias("target"), F.col("rec_id").alias("timestamp"), F.transform("data.perf", item).alias("data"))
    out = etl.timeseries_items(df)
    return out.select("time", F.try_element_at("dimensions", F.lit("target")).alias("target"), F.try_element_at("metrics", F.lit("cpu")).alias("cpu")).where("cpu is not null")


@q("e23_topology_levels", "SELECT c_custkey, CAST(n_regionkey AS VARCHAR) AS region FROM customer JOIN nation ON c_nationkey = n_nationkey")
def _(spark, folder):
    n = table(spark, folder, "nation")
    topo = F.array(F.struct(F.col("n_nationkey").alias("biz"), F.create_map(F.lit("region"), F.col("n_regionkey").cast("string")).alias("levels")), F.struct(F.lit(-1).alias("biz"), F.create_map(F.lit("region"), F.lit("wrong")).alias("levels")))
    hosts = n.select(F.col("n_nationkey").alias("c_nationkey"), topo.alias("topo"))
    out = etl.fill_level(table(spark, folder, "customer"), hosts, ["c_nationkey"], "topo", "c_nationkey", "levels")
    return out.select("c_custkey", F.try_element_at("levels", F.lit("region")).alias("region"))


@q("e30_aliases", "SELECT event_id, json_extract_string(props, '$.k') AS kk, 'none' AS extra FROM events")
def _(spark, folder):
    m = etl.with_aliases(etl.parse_json(F.col("props")), {"k": "kk"}, {"extra": "none"})
    return events(spark, folder).select("event_id", F.try_element_at(m, F.lit("kk")).alias("kk"), F.try_element_at(m, F.lit("extra")).alias("extra"))


@q("e32_event_cleaning", "SELECT event_type AS event_name, epoch_us(ts) // 1000 AS timestamp, 'prod' AS env FROM events")
def _(spark, folder):
    e = events(spark, folder).select(F.col("event_type").alias("event_name"), F.create_map(F.lit("content"), F.col("props"), F.lit("junk"), F.lit("x")).alias("event"),
        F.create_map(F.lit("user"), F.col("user_id").cast("string")).alias("dimension"), F.lit("t").alias("target"), F.col("t").alias("timestamp"))
    out = etl.clean_events(e, ["content"], ["user"], {"env": "prod"}).where(F.size("event") == 1)
    return out.select("event_name", "timestamp", F.try_element_at("dimension", F.lit("env")).alias("env"))


@q("e33_group_injection", "SELECT rec_id, d.name AS name FROM (SELECT rec_id, unnest(data.net.dev) AS d FROM net_test_data)")
def _(spark, folder):
    df = table(spark, folder, "net_test_data").select("rec_id", F.transform("data.net.dev", lambda d: F.create_map(F.lit("name"), d["name"])).alias("group_info"), F.create_map(F.lit("ip"), F.col("ip")).alias("dims"))
    out = etl.inject_groups(df, "group_info", "dims")
    return out.select("rec_id", F.try_element_at("dims", F.lit("name")).alias("name")).where("name is not null")


@q("e35_charset", "SELECT n_nationkey, n_name FROM nation")
def _(spark, folder):
    return table(spark, folder, "nation").select("n_nationkey", etl.decoded(F.encode("n_name", "UTF-16BE"), "UTF-16BE").alias("n_name"))


@q("e41_scaler_metrics", "SELECT event_type AS name, unnest(['current', 'target']) AS figure, unnest([round(max(value), 2), 50.0]) AS v FROM events GROUP BY 1")
def _(spark, folder):
    m = F.array(F.struct(F.lit("Resource").alias("type"), F.lit("cpu").alias("name"), F.round(F.max("value"), 2).alias("current"), F.lit(50.0).alias("target")))
    return telemetry.scaler_rows(events(spark, folder).groupBy(F.col("event_type").alias("name")).agg(m.alias("metrics"))).select("name", "figure", "v")


@q("e49_field_types", "SELECT 'k' AS field, 'int' AS type")
def _(spark, folder):
    return etl.inferred_fields(events(spark, folder), "props", 0.2).select("field", "type")


@q("c03_metric_relabel", "SELECT event_id, CASE WHEN event_type IN ('click', 'view') AND value BETWEEN 0 AND 20 THEN 'small' END AS size FROM events")
def _(spark, folder):
    labels = F.create_map(F.lit("type"), F.col("event_type"), F.lit("code"), F.col("value").cast("string"))
    made = telemetry.relabel_by_rules(labels, [{"target": "size", "value": "small", "rules": [{"label": "type", "op": "in", "values": ["click", "view"]}, {"label": "code", "op": "range", "values": [{"min": 0, "max": 20}]}]}])
    return events(spark, folder).select("event_id", F.try_element_at(made, F.lit("size")).alias("size"))


@q("c05_probe", "SELECT span_id, trace_id, time, CASE WHEN starts_with(attributes['http.method'], 'P') THEN 'write' END AS probe FROM complex")
def _(spark, folder):
    m = telemetry.probe(F.col("attributes"), [{"field": "http.method", "op": "startswith", "value": "P", "set": {"probe": "write"}}])
    return table(spark, folder, "complex").select("span_id", "trace_id", "time", F.try_element_at(m, F.lit("probe")).alias("probe"))


@q("c11_series_caps", "SELECT event_id FROM events WHERE (event_type, user_id) IN (SELECT (event_type, user_id) FROM events GROUP BY event_type, user_id ORDER BY min(epoch_us(ts) // 1000), event_type, user_id LIMIT 30)")
def _(spark, folder):
    return telemetry.capped_series(events(spark, folder), ["event_type", "user_id"], "t", 30).select("event_id")


@q("c12_dimension_types", "SELECT span_id, trace_id, time, attributes['http.method'] AS m FROM complex WHERE kind = 2 AND attributes['http.method'] IS NOT NULL")
def _(spark, folder):
    d = telemetry.matched_dimensions(F.col("kind"), F.col("attributes"), [{"kind": 2, "predicate": "http.method", "dimensions": ["http.method"]}])
    return table(spark, folder, "complex").select("span_id", "trace_id", "time", F.try_element_at(d, F.lit("http.method")).alias("m"), d.isNotNull().alias("hit")).where("hit").drop("hit")


@q("c20_span_rows", "SELECT trace_id, span_id, time, end_time - start_time AS elapsed_time, CASE coalesce(status.code, 0) WHEN 0 THEN 'UNSET' WHEN 1 THEN 'OK' WHEN 2 THEN 'ERROR' END AS status FROM complex".replace("time, end", "end"))
def _(spark, folder):
    return telemetry.span_rows(table(spark, folder, "complex")).select("trace_id", "span_id", "elapsed_time", "status")


@q("c22_call_statistics", f"SELECT event_type, (epoch_us(ts) // 1000) // {DAY} * {DAY} AS interval, count(*) AS count, max(value) AS max_us FROM events GROUP BY 1, 2")
def _(spark, folder):
    e = events(spark, folder).select("event_type", "user_id", "t", F.lit(1).cast("long").alias("count"), F.col("value").alias("total_us"), F.col("value").alias("max_us"), F.col("value").alias("min_us"), F.create_map(F.floor(F.col("value") / 100).cast("int"), F.lit(1)).alias("buckets"))
    return telemetry.merge_stats(e, ["event_type", "user_id"], ["user_id"], "t", DAY).select("event_type", "interval", "count", "max_us")


@q("c23_log_fields", "SELECT doc_id, nullif(regexp_extract(text, '(?:^|\\s)trace=(?:\"([^\"]*)\"|(\\S+))', 2), '') AS trace FROM documents")
def _(spark, folder):
    return telemetry.log_rows(table(spark, folder, "documents"), "text", ["trace"]).select("doc_id", "trace")


@q("c24_span_events", "SELECT trace_id, span_id, CAST(i - 1 AS INT) AS place, events[i].name AS name FROM (SELECT trace_id, span_id, events, unnest(range(1, len(events) + 1)) AS i FROM complex)")
def _(spark, folder):
    return telemetry.span_events(table(spark, folder, "complex")).select("trace_id", "span_id", "place", "name")


@q("g05_root_spans", "SELECT count(DISTINCT trace_id) AS traces FROM complex")
def _(spark, folder):
    return topology.trace_info(table(spark, folder, "complex")).where("root_span_id is not null").agg(F.count(F.lit(1)).alias("traces"))


@q("g12_component_flows", "SELECT from_service, to_component, count(*) AS n FROM (SELECT DISTINCT ON (trace_id, lower(trim(span_id))) resource['service.name'] AS from_service, coalesce(attributes['db.system'], attributes['messaging.system']) AS to_component, kind FROM complex) WHERE kind IN (3, 4) AND to_component IS NOT NULL GROUP BY 1, 2")
def _(spark, folder):
    return topology.component_flows(table(spark, folder, "complex")).groupBy("from_service", "to_component").agg(F.count(F.lit(1)).alias("n"))


@q("g15_path_enumeration", "SELECT unnest(['pod>node', 'pod>service>node']) AS path")
def _(spark, folder):
    paths = topology.resource_paths([("pod", "node"), ("pod", "service"), ("service", "node")], "pod", "node")
    return spark.createDataFrame([(">".join(p),) for p in paths], "path string")


@q("d02_outcomes", f"SELECT event_type, \"at\", max(value) > 200 OR max(value) < 5 AS outcome FROM (SELECT event_type, (epoch_us(ts) // 1000) // {HOUR} * 3600 AS \"at\", value FROM events) GROUP BY 1, 2")
def _(spark, folder):
    df = events(spark, folder).groupBy("event_type", (F.floor(F.col("t") / HOUR) * 3600).cast("long").alias("at")).agg(F.max("value").alias("value"))
    one = lambda m, x: {"algorithms": [{"config": [{"method": m, "threshold": x}]}]}
    return detect.detect(df, ["event_type"], "at", "value", {1: one("gt", 200), 2: one("lt", 5)}).select("event_type", "at", "outcome").distinct()


@q("d08_warm_up", "SELECT o_orderkey, CASE WHEN epoch_us(o_orderdate) // 1000000 < 852076800 + 99 THEN 'warm_up' ELSE 'match' END AS verdict FROM orders")
def _(spark, folder):
    o = table(spark, folder, "orders").withColumn("source_time", F.unix_seconds(F.col("o_orderdate").cast("timestamp")))
    a = o.select("o_orderkey", F.lit("x").alias("fp"))
    return detect.compare_streams(o, a, a, "o_orderkey", "fp", 852_076_800, 100).select("o_orderkey", "verdict")


@q("d09_coverage", "SELECT o_orderkey, CASE WHEN o_orderkey % 5 <> 0 THEN 'complete' WHEN epoch_us(o_orderdate) // 1000000 + 3600 <= 900000000 THEN 'timeout' ELSE 'pending' END AS status FROM orders")
def _(spark, folder):
    o = table(spark, folder, "orders").withColumn("source_time", F.unix_seconds(F.col("o_orderdate").cast("timestamp")))
    a = o.select("o_orderkey", F.lit("x").alias("fp"))
    compared = detect.compare_streams(o, a, a.where("o_orderkey % 5 != 0"), "o_orderkey", "fp").join(o.select("o_orderkey", "source_time"), "o_orderkey")
    return detect.coverage(compared, "source_time", 900_000_000, 3600).select("o_orderkey", "status")


@q("f03_condition_table", "SELECT c_custkey FROM customer WHERE c_mktsegment = 'FURNITURE' AND c_acctbal > 0")
def _(spark, folder):
    c = Catalog([TableMeta("c", lambda: table(spark, folder, "customer").withColumn("time", F.lit(0)), aliases={"segment": "c_mktsegment"})])
    return c.scan("c", 0, 1, [[Condition("segment", "eq", ["FURNITURE"]), Condition("c_acctbal", "gt", [0])]]).select("c_custkey")


@q("s06_reused_scan", "SELECT 'n' AS k, CAST(count(*) AS DOUBLE) AS v FROM events UNION ALL SELECT 'sum', round(sum(value), 4) FROM events")
def _(spark, folder):
    """Equal scans of one plan are one exchange: both figures come from the same partial aggregate."""
    both = events(spark, folder).agg(F.count(F.lit(1)).cast("double").alias("n"), F.round(F.sum("value"), 4).alias("sum"))
    return both.select(F.inline(F.array(F.struct(F.lit("n").alias("k"), F.col("n").alias("v")), F.struct(F.lit("sum").alias("k"), F.col("sum").alias("v")))))


@q("s19_bulk_sink", "SELECT count(*) AS n, count(DISTINCT event_id) AS ids FROM events")
def _(spark, folder):
    """A batch that is delivered again overwrites itself."""
    path = scratch(spark, "bulk")
    sink = readers.bulk_sink(readers.parquet_batches(path))
    df = table(spark, folder, "events")
    for batch_id, part in enumerate((df.where("event_id % 2 = 0"), df.where("event_id % 2 = 1"))):
        sink(part, batch_id)
        sink(part, batch_id)
    return spark.read.parquet(path).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("event_id").alias("ids"))


@q("a13_influx_mean", f"SELECT event_type, (epoch_us(ts) // 1000) // {HOUR} * {HOUR} AS _time, round(avg(value), 6) AS _value FROM events WHERE epoch_us(ts) // 1000 > {JAN} AND epoch_us(ts) // 1000 < {JAN + DAY} GROUP BY 1, 2")
def _(spark, folder):
    from tidegauge.functions.timeutil import bounded

    df = events(spark, folder).where(bounded(F.col("t"), JAN, JAN + DAY, "()"))
    return aggregate.grouped(df, ["event_type"], "mean", "value", HOUR, "t").withColumn("_value", F.round("_value", 6))


@q("a20_cluster_query", f"SELECT (epoch_us(ts) // 1000) // {DAY} * {DAY} AS _time, min(value) AS _value FROM events WHERE event_type = 'view' GROUP BY 1")
def _(spark, folder):
    return aggregate.grouped(events(spark, folder).where("event_type = 'view'"), [], "min", "value", DAY, "t")


@q("m03_widened_union", "SELECT CAST(c_custkey AS VARCHAR) AS k, CAST(c_acctbal AS DOUBLE) AS v FROM customer UNION ALL SELECT CAST(p_partkey AS VARCHAR), CAST(p_size AS DOUBLE) FROM part")
def _(spark, folder):
    a = table(spark, folder, "customer").select(F.col("c_custkey").cast("string").alias("k"), F.col("c_acctbal").alias("v"))
    b = table(spark, folder, "part").select(F.col("p_partkey").cast("string").alias("k"), F.col("p_size").alias("v"))
    return merge.union_all([a, b], ["k", "v"])


@q("m07_merge_choice", "SELECT unnest(['max', 'avg', 'sum']) AS how")
def _(spark, folder):
    chosen = [merge.merge_function("max", None), merge.merge_function(None, "avg_over_time"), merge.merge_function("count", None)]
    return spark.createDataFrame([(c,) for c in chosen], "how string")


@q("m11_order_keys", "SELECT event_type, user_id, n FROM (SELECT event_type, user_id, count(*) AS n FROM events GROUP BY 1, 2) ORDER BY n DESC, event_type, user_id LIMIT 12")
def _(spark, folder):
    df = aggregate.grouped(events(spark, folder), ["event_type", "user_id"], "count", "*")
    return df.orderBy(*rawrows.ordering(df, ["-_value", "event_type", "user_id"])).limit(12).withColumnRenamed("_value", "n")


@q("m25_shaped_answer", "SELECT rec_id, coalesce(CASE WHEN isnan(data.cpu.total_usage) THEN NULL ELSE data.cpu.total_usage END, -1) AS v FROM net_test_data")
def _(spark, folder):
    return rawrows.shaped(table(spark, folder, "net_test_data").select("rec_id", F.col("data.cpu.total_usage").alias("v")), nulls=-1.0)


@q("promql34_request_times", "SELECT unnest([1700000000000, 1700000000000, 1700000000000])::BIGINT AS ms")
def _(spark, folder):
    from tidegauge.functions.timeutil import request_time_ms

    return spark.createDataFrame([(request_time_ms(x),) for x in ("1700000000", "1700000000000000000", "2023-11-14 22:13:20")], "ms long")


@q("e11_iterated_records", "SELECT rec_id, p.pid AS pid, 'processbeat' AS kind FROM (SELECT rec_id, unnest(data.perf) AS p FROM proc_test_data WHERE type = 'processbeat')")
def _(spark, folder):
    df = table(spark, folder, "proc_test_data").where("type = 'processbeat'").select("rec_id", F.explode("data.perf").alias("p"))
    return etl.with_fields(df, [{"name": "pid", "type": "int", "from": "p.pid"}, {"name": "kind", "constant": "processbeat"}]).select("rec_id", F.col("pid").cast("int").alias("pid"), "kind")


@q("e19_standard_events", "SELECT event_type AS event_name, epoch_us(ts) // 1000 AS timestamp, CAST(user_id AS VARCHAR) AS user FROM events".replace("AS user ", 'AS "user" '))
def _(spark, folder):
    out = etl.event_records(events(spark, folder), F.col("event_type"), F.col("t"), F.col("props"), F.create_map(F.lit("user"), F.col("user_id")))
    return out.select("event_name", "timestamp", F.try_element_at("dimensions", F.lit("user")).alias("user"))


@q("e20_rejected_records", "SELECT count(*) FILTER (ok) AS valid, count(*) FILTER (NOT ok) AS rejected FROM (SELECT coalesce(recv_time IS NOT NULL AND data.cpu.total_usage IS NOT NULL AND ip IS NOT NULL, false) AS ok FROM net_test_data)")
def _(spark, folder):
    m = F.map_filter(F.create_map(F.lit("usage"), F.col("data.cpu.total_usage")), lambda _, v: v.isNotNull())
    d = F.map_filter(F.create_map(F.lit("ip"), F.col("ip")), lambda _, v: v.isNotNull())
    df = table(spark, folder, "net_test_data").select(F.unix_seconds(F.col("recv_time").cast("timestamp")).alias("time"), m.alias("m"), d.alias("d"))
    good, bad = etl.split_valid(df, "time", "m", "d")
    both = good.select(F.lit(True).alias("ok")).unionByName(bad.select(F.lit(False).alias("ok")))
    return both.agg(F.count_if("ok").alias("valid"), F.count_if(~F.col("ok")).alias("rejected"))


@q("e31_declared_fields", "SELECT TRY_CAST(ip AS BIGINT) AS ip, CAST(NULL AS DOUBLE) AS gone, rec_id FROM net_test_data")
def _(spark, folder):
    return etl.declared_only(table(spark, folder, "net_test_data"), {"ip": "int", "gone": "float", "rec_id": "int"})


@q("e34_topology_json", "SELECT n_nationkey, '{\"region\":\"' || n_regionkey || '\"}' AS bk_cmdb_level FROM nation")
def _(spark, folder):
    df = table(spark, folder, "nation").select("n_nationkey", F.create_map(F.lit("region"), F.col("n_regionkey").cast("string")).alias("levels"))
    return etl.level_as_json(df, "levels", "bk_cmdb_level").drop("levels")


@q("e42_terminating_pods", "SELECT count(*) AS changes FROM (SELECT user_id, bad, lag(bad, 1, false) OVER (PARTITION BY user_id ORDER BY event_id) AS before FROM (SELECT user_id, event_id, event_type = 'error' AS bad FROM events)) WHERE bad <> before")
def _(spark, folder):
    """Errors in a row play a deletion that lasts; the limit is never reached, so each change of the flag is a change of state."""
    from tidegauge.queries.records import _drained, _stream
    from tidegauge.streaming import pipelines

    s = _stream(spark, folder).select(F.col("user_id").alias("pod"), F.col("event_id").alias("at"), (F.col("event_type") == "error").alias("deleting"))
    return _drained(spark, pipelines.terminating_pods(s, "pod", "at", "deleting", 10**9)).agg(F.count(F.lit(1)).alias("changes"))


@q("e43_processor_graph", "SELECT event_type, count(*) AS n FROM events WHERE value > 20 GROUP BY 1")
def _(spark, folder):
    from tidegauge.streaming import pipelines

    nodes = {"big": lambda d: d.where("value > 20"), "counted": lambda d: d.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))}
    return pipelines.pipeline(nodes, {"big": ["in"], "counted": ["big"]}, {"in": events(spark, folder)})["counted"]


@q("e44_cleaned_tags", "SELECT span_id, trace_id, time, len(list_filter(map_values(attributes), lambda x: x <> '')) AS n FROM complex")
def _(spark, folder):
    return table(spark, folder, "complex").select("span_id", "trace_id", "time", F.size(etl.without_empty(F.col("attributes"))).cast("long").alias("n"))


@q("c07_service_discovery", "SELECT event_id, CASE WHEN event_type = 'error' THEN 'errors' ELSE 'svc' || user_id % 3 END AS peer FROM events")
def _(spark, folder):
    host = F.when(F.col("event_type") == "error", F.lit("bad.example")).otherwise(F.concat(F.lit("svc"), (F.col("user_id") % 3).cast("string"), F.lit(".example")))
    m = F.create_map(F.lit("http.url"), F.concat(F.lit("http://"), host, F.lit("/a/b?x=1")))
    rules = [{"type": "manual", "host": {"op": "eq", "value": "bad.example"}, "params": {"x": "1"}, "service": "errors"}, {"type": "auto", "regex": r"https?://(?P<peer_service>\w+)\.example"}]
    made = telemetry.discover_service(m, rules)
    return events(spark, folder).select("event_id", F.try_element_at(made, F.lit("peer.service")).alias("peer"))


@q("c16_validator", f"SELECT count(*) AS n FROM events WHERE epoch_us(ts) // 1000 <= {JAN + 10 * DAY + HOUR}")
def _(spark, folder):
    return events(spark, folder).where(telemetry.valid_proxy_record(F.col("t"), JAN + 10 * DAY, HOUR)).agg(F.count(F.lit(1)).alias("n"))


@q("c17_tokens", "SELECT count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_acctbal > 0")
def _(spark, folder):
    tokens = table(spark, folder, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("token"))
    return telemetry.checked_token(table(spark, folder, "orders").withColumnRenamed("o_custkey", "token"), tokens).agg(F.count(F.lit(1)).alias("n"))


@q("g13_flow_buckets", "SELECT span_name, count(*) FILTER (end_time - start_time <= 1000) AS fast, count(*) AS n FROM complex GROUP BY 1")
def _(spark, folder):
    df = table(spark, folder, "complex").select("span_name", (F.col("end_time") - F.col("start_time")).alias("duration"), (F.col("status.code") == 2).alias("error"))
    out = topology.flow_stats(df, ["span_name"], [1000])
    return out.where("le = '1000'").select("span_name", F.col("bucket_count").alias("fast"), "n")
