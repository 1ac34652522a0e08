"""Queries of operators that the other modules leave out: host reports, payloads, built SQL, batches, scrolls, log pipelines, and further functions of the languages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegauge.catalog import Catalog, TableMeta
from tidegauge.functions.timeutil import event_ms
from tidegauge.operators import conditions, etl, hostreports, merge, payloads, rawrows, telemetry, topology
from tidegauge.plans import batch, lucene, sqlbuild, sqldialect, structured
from tidegauge.queries import Registry, table
from tidegauge.queries.languages import D1, DAY, END, G, I, S, START, STEP, X, run, w

registry = Registry()
q = registry.add


def events(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "events").withColumn("t", event_ms(F.col("ts")))


# Host reports

def _figures(name: str, source: str, columns: dict[str, str], sql: str, place: str | None = None) -> None:
    def query(spark: SparkSession, folder: str) -> DataFrame:
        rows = hostreports.host_rows(table(spark, folder, source), name, ("rec_id",))
        told = [F.try_element_at("dimensions", F.lit(place)).alias(place)] if place else []
        return rows.select("rec_id", *told, *[F.try_element_at("metrics", F.lit(c)).alias(c) for c in columns])

    q(f"e37_{name}" if name not in ("proc",) else "e38_proc", sql)(query)


def _clean(path: str) -> str:
    return f"CASE WHEN NOT isnan({path}) THEN {path} END"


def _plain(name: str, source: str, columns: dict[str, str]) -> None:
    told = ", ".join(f"{_clean(f'CAST({p} AS DOUBLE)')} AS {c}" for c, p in columns.items())
    _figures(name, source, columns, f"SELECT * FROM (SELECT rec_id, {told} FROM {source}) WHERE {' OR '.join(f'{c} IS NOT NULL' for c in columns)}")


_plain("cpu_summary", "net_test_data", {"usage": "data.cpu.total_usage"})
_plain("load", "net_test_data", {f"load{n}": f"data.load.load_avg.load{n}" for n in (1, 5, 15)})
_plain("swap", "swap_test_data", {"swap_in": "data.mem.swap_in", "swap_out": "data.mem.swap_out"})
_figures("mem", "swap_test_data", {"free": "", "total": "", "used": "", "pct_used": ""}, """SELECT * FROM (SELECT rec_id, CAST(data.mem.meminfo.free AS DOUBLE) AS free, CAST(data.mem.meminfo.total AS DOUBLE) AS total, CAST(data.mem.meminfo.used AS DOUBLE) AS used,
    CASE WHEN data.mem.meminfo.total > 0 THEN data.mem.meminfo.used * 100.0 / data.mem.meminfo.total END AS pct_used FROM swap_test_data) WHERE free IS NOT NULL OR total IS NOT NULL OR used IS NOT NULL""")
_figures("net", "net_test_data", {"errors": "", "dropped": "", "carrier": "", "collisions": "", "overruns": ""}, """SELECT * FROM (SELECT rec_id, d.name AS device_name, CAST(d.errors AS DOUBLE) AS errors, CAST(d.dropped AS DOUBLE) AS dropped, CAST(d.carrier AS DOUBLE) AS carrier, CAST(d.collisions AS DOUBLE) AS collisions, CAST(d.overruns AS DOUBLE) AS overruns
    FROM (SELECT rec_id, unnest(data.net.dev) AS d FROM net_test_data)) WHERE coalesce(errors, dropped, carrier, collisions, overruns) IS NOT NULL""", "device_name")
_figures("cpu_usage", "net_test_data", {"usage": ""}, f"""SELECT rec_id, device_name, usage FROM (SELECT rec_id, 'cpu' || (unnest(range(1, len(data.cpu.per_usage) + 1)) - 1) AS device_name, unnest(data.cpu.per_usage) AS u FROM net_test_data), LATERAL (SELECT {_clean('u')} AS usage) WHERE usage IS NOT NULL""", "device_name")
_figures("env", "net_test_data", {"timezone": ""}, "SELECT rec_id, data.city AS city, CAST(data.timezone AS DOUBLE) AS timezone FROM net_test_data WHERE data.timezone IS NOT NULL", "city")
_figures("proc", "proc_test_data", {"cpu_pct": "", "fd_open": ""}, f"SELECT * FROM (SELECT rec_id, p.name AS name, {_clean('p.cpu_pct')} AS cpu_pct, CAST(p.fd_open AS DOUBLE) AS fd_open FROM (SELECT rec_id, unnest(data.perf) AS p FROM proc_test_data)) WHERE cpu_pct IS NOT NULL OR fd_open IS NOT NULL", "name")


# Payloads: made from the spans, parsed back

_SPANS = "SELECT trace_id, span_id, span_name, kind, start_time, end_time, resource['service.name'] AS service FROM complex WHERE trace_id IS NOT NULL AND span_id IS NOT NULL AND start_time IS NOT NULL AND end_time IS NOT NULL"


def _whole(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "complex").where("trace_id is not null and span_id is not null and start_time is not null and end_time is not null")
    kind = F.element_at(F.create_map(*[F.lit(x) for k, v in payloads.KINDS.items() for x in (v, k)]), F.col("kind"))
    return rows.withColumn("kind_name", F.when(F.col("kind").between(1, 5), kind)).withColumn("service", F.try_element_at("resource", F.lit("service.name")))


_SPAN_SQL = _SPANS.replace("kind,", "CASE WHEN kind BETWEEN 1 AND 5 THEN kind ELSE 0 END AS kind,")


@q("s21_zipkin_spans", _SPAN_SQL)
def _(spark, folder):
    s = F.struct(F.col("trace_id").alias("traceId"), F.col("span_id").alias("id"), F.col("parent_span_id").alias("parentId"), F.col("span_name").alias("name"), F.col("kind_name").alias("kind"),
        F.col("start_time").alias("timestamp"), (F.col("end_time") - F.col("start_time")).alias("duration"), F.struct(F.col("service").alias("serviceName")).alias("localEndpoint"), F.col("attributes").alias("tags"))
    out = payloads.spans_of_zipkin(_whole(spark, folder).select(F.to_json(F.array(s)).alias("value")))
    return out.select("trace_id", "span_id", "span_name", "kind", "start_time", "end_time", "service")


@q("s21_jaeger_spans", _SPAN_SQL)
def _(spark, folder):
    tags = F.array(F.struct(F.lit("span.kind").alias("key"), F.coalesce(F.lower("kind_name"), F.lit("unspecified")).alias("value")))
    refs = F.array(F.struct(F.lit("CHILD_OF").alias("refType"), F.coalesce("parent_span_id", F.lit("")).alias("spanID")))
    s = F.struct(F.col("trace_id").alias("traceID"), F.col("span_id").alias("spanID"), F.col("span_name").alias("operationName"), refs.alias("references"), F.col("start_time").alias("startTime"),
        (F.col("end_time") - F.col("start_time")).alias("duration"), tags.alias("tags"))
    value = F.to_json(F.struct(F.struct(F.col("service").alias("serviceName")).alias("process"), F.array(s).alias("spans")))
    return payloads.spans_of_jaeger(_whole(spark, folder).select(value.alias("value"))).select("trace_id", "span_id", "span_name", "kind", "start_time", "end_time", "service")


@q("c21_remote_write", "SELECT event_type AS kind, epoch_us(ts) // 1000 AS t, value AS v, CASE WHEN value > 100 THEN CAST(event_id AS VARCHAR) END AS trace FROM events")
def _(spark, folder):
    pair = lambda k, v: F.struct(F.lit(k).alias("name"), v.cast("string").alias("value"))
    e = events(spark, folder)
    exemplar = F.struct(F.array(pair("trace_id", F.col("event_id"))).alias("labels"), F.col("value"), F.col("t").alias("timestamp"))
    s = F.struct(F.array(pair("__name__", F.lit("events")), pair("kind", F.col("event_type"))).alias("labels"), F.array(F.struct("value", F.col("t").alias("timestamp"))).alias("samples"),
        F.when(F.col("value") > 100, F.array(exemplar)).otherwise(F.filter(F.array(exemplar), lambda _: F.lit(False))).alias("exemplars"))
    out = payloads.remote_write_rows(e.select(F.to_json(F.array(s)).alias("value")))
    return out.select(F.try_element_at("labels", F.lit("kind")).alias("kind"), "t", "v", F.try_element_at("exemplar", F.lit("trace_id")).alias("trace"))


@q("c19_number_points", "SELECT CASE WHEN event_id % 2 = 0 THEN 'whole' ELSE 'real' END AS metric, event_id, CASE WHEN event_id % 10 = 0 THEN 'nan'::DOUBLE WHEN event_id % 2 = 0 THEN CAST(user_id AS DOUBLE) ELSE value END AS v FROM events")
def _(spark, folder):
    e, even = events(spark, folder), F.col("event_id") % 2 == 0
    points = e.select(F.when(even, "whole").otherwise("real").alias("name"), F.create_map(F.lit("id"), F.col("event_id").cast("string")).alias("labels"), "t",
        F.when(~even, F.col("value")).alias("as_double"), F.when(even, F.col("user_id")).alias("as_int"), (F.col("event_id") % 10 == 0).alias("no_value"))
    return payloads.number_points(points).select("metric", F.element_at("labels", "id").cast("long").alias("event_id"), "v")


@q("c23_otlp_logs", "SELECT source AS service, epoch_us(created_at) // 1000 AS t, 'INFO' AS severity, coalesce(text, '') AS body, CAST(doc_id AS VARCHAR) AS doc FROM documents WHERE source IS NOT NULL AND created_at IS NOT NULL")
def _(spark, folder):
    d = table(spark, folder, "documents").where("source is not null and created_at is not null")
    pair = lambda k, v: F.struct(F.lit(k).alias("key"), F.struct(v.cast("string").alias("stringValue")).alias("value"))
    nanos = F.concat(event_ms(F.col("created_at").cast("timestamp_ntz")).cast("string"), F.lit("000000"))
    record = F.struct(nanos.alias("timeUnixNano"), F.lit("INFO").alias("severityText"), F.struct(F.coalesce("text", F.lit("")).alias("stringValue")).alias("body"), F.array(pair("doc", F.col("doc_id"))).alias("attributes"))
    value = F.to_json(F.struct(F.array(F.struct(F.struct(F.array(pair("service.name", F.col("source"))).alias("attributes")).alias("resource"), F.array(F.struct(F.array(record).alias("logRecords"))).alias("scopeLogs"))).alias("resourceLogs")))
    return payloads.log_records(d.select(value.alias("value"))).select("service", "t", "severity", "body", F.try_element_at("attributes", F.lit("doc")).alias("doc"))


@q("c23_ping", "SELECT s_suppkey, CAST(CASE WHEN s_suppkey % 4 = 0 THEN 1.0 ELSE 0.5 END AS DOUBLE) AS loss_percent, CASE WHEN s_suppkey % 4 > 0 THEN CAST(s_suppkey AS DOUBLE) END AS min_rtt, CASE WHEN s_suppkey % 4 > 0 THEN CAST(s_suppkey + 1.0 AS DOUBLE) END AS avg_rtt FROM supplier")
def _(spark, folder):
    k = F.col("s_suppkey").cast("double")
    times = F.filter(F.array(k, k + 2), lambda _: F.col("s_suppkey") % 4 > 0)
    r = F.struct(F.col("s_name").alias("target"), F.lit(4).alias("sent"), times.alias("times"))
    return payloads.ping_rows(table(spark, folder, "supplier").select("s_suppkey", F.array(r).alias("results"))).select("s_suppkey", "loss_percent", "min_rtt", "avg_rtt")


@q("c23_beats", "SELECT dataid, epoch_us(recv_time) // 1000 AS t, bkmonitorbeat.hostname AS host FROM net_test_data WHERE dataid IS NOT NULL")
def _(spark, folder):
    stamp = F.concat(F.date_format(F.col("recv_time").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss.SSS"), F.lit("Z"))
    value = F.to_json(F.struct("dataid", stamp.alias("@timestamp"), F.struct(F.struct("bkmonitorbeat.hostname").alias("host")).alias("beat")))
    return payloads.beat_rows(table(spark, folder, "net_test_data").select(value.alias("value")), fields={"host": "beat.host.hostname"})


@q("a10_flat_series", f"SELECT event_type, CAST((epoch_us(ts) // 1000) // {DAY} * {DAY} AS VARCHAR) AS day, count(*) AS doc_count, round(sum(value), 4) AS value FROM events GROUP BY 1, 2")
def _(spark, folder):
    """An answer as nested buckets, made from the events, and flattened again."""
    inner = events(spark, folder).groupBy("event_type", (F.floor(F.col("t") / DAY) * DAY).alias("key")).agg(F.count(F.lit(1)).alias("doc_count"), F.round(F.sum("value"), 4).alias("v"))
    bucket = F.struct("key", "doc_count", F.struct(F.col("v").alias("value")).alias("value"))
    outer = inner.groupBy("event_type").agg(F.sum("doc_count").alias("n"), F.collect_list(bucket).alias("days"))
    tree = F.to_json(F.struct(F.struct(F.array(F.struct(F.col("event_type").alias("key"), F.col("n").alias("doc_count"), F.struct(F.col("days").alias("buckets")).alias("day"))).alias("buckets")).alias("event_type")))
    return payloads.flat_series(outer.select(tree.alias("tree")), "tree", ["event_type", "day"])


# Built SQL, batches, conditions

def _query(**more) -> structured.Query:
    return structured.Query.of({"table_id": "events", "field_name": "value", "conditions": {"field_list": [
        {"field_name": "event_type", "op": "ne", "value": ["view", "error"]}, {"field_name": "user_id", "op": "gt", "value": [3]}, {"field_name": "props", "op": "contains", "value": ["7"]}],
        "condition_list": ["and", "or"]}, **more})


def _built(spark: SparkSession, folder: str, dialect: str) -> DataFrame:
    query = _query(function=[{"method": "mean", "dimensions": ["event_type"], "window": "1d"}], order_by=["-_value", "event_type", "_value", "props"])
    text = sqlbuild.build(query, "events_ms", "t", START, END, dialect)
    return sqldialect.run(spark, text, {"events_ms": events(spark, folder)}).withColumn("_value_", F.round("_value_", 6))


_BUILT = f"SELECT event_type, (epoch_us(ts) // 1000) // {DAY} * {DAY} AS _timestamp_, round(avg(value), 6) AS _value_ FROM events WHERE epoch_us(ts) // 1000 >= {START} AND epoch_us(ts) // 1000 < {END} AND ((event_type NOT IN ('view', 'error') AND user_id > 3) OR props LIKE '%7%') GROUP BY 1, 2"
q("s08_built_sql", _BUILT)(lambda spark, folder: _built(spark, folder, "doris"))
q("s09_tspider_sql", _BUILT)(lambda spark, folder: _built(spark, folder, "tspider"))


@q("m12_sort_keys", "SELECT event_type, round(max(value), 6) AS _value_ FROM events GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 3")
def _(spark, folder):
    """Keys that an aggregate doesn't have, or has been given before, are passed over."""
    query = structured.Query.of({"table_id": "events", "field_name": "value", "function": [{"method": "max", "dimensions": ["event_type"]}], "order_by": ["-_value", "props", "event_type", "_value"], "limit": 3})
    return sqldialect.run(spark, sqlbuild.build(query, "events_ms", "t", 0, 1 << 60), {"events_ms": events(spark, folder)}).withColumn("_value_", F.round("_value_", 6))


@q("m13_capped", "SELECT c_custkey FROM customer ORDER BY c_custkey LIMIT 30 OFFSET 5")
def _(spark, folder):
    return sqldialect.run(spark, "SELECT c_custkey FROM customer ORDER BY c_custkey LIMIT 5, 1000000 -- all of them", {"customer": table(spark, folder, "customer")}, most=30)


def _tables(spark: SparkSession, folder: str) -> Catalog:
    e = events(spark, folder)
    half = lambda i: (lambda: e.where(F.col("user_id") % 2 == i).withColumn("time", F.col("t")))
    return Catalog([TableMeta(n, half(i), values=["value"], tags=["event_type"], labels={"side": n, "kind": "web"}) for i, n in enumerate(("even", "odd"))])


@q("s06_batch_plan", """SELECT event_id, n AS "__query" FROM (SELECT event_id, user_id % 2 AS side, value, event_type FROM events) e JOIN (VALUES (0, 0), (1, 1), (0, 3), (1, 2)) v(s, n) ON s = side WHERE CASE WHEN n < 2 THEN value > 150 WHEN n = 3 THEN event_type = 'click' ELSE value > 150 END""")
def _(spark, folder):
    """Four queries of two bodies over two tables: each table is scanned once, and a row comes out once per query that it answers."""
    big = {"conditions": {"field_list": [{"field_name": "value", "op": "gt", "value": [150]}], "condition_list": []}, "keep_columns": ["event_id"]}
    clicks = {"conditions": {"field_list": [{"field_name": "event_type", "op": "eq", "value": ["click"]}], "condition_list": []}, "keep_columns": ["event_id"]}
    queries = [structured.Query.of({"table_id": t, **b}) for t, b in (("even", big), ("odd", big), ("odd", big), ("even", clicks))]
    return batch.run_batches(_tables(spark, folder), queries, 0, 1 << 60).select("event_id", "__query")


@q("f14_look_ahead", "SELECT p_partkey FROM part WHERE NOT starts_with(p_name, 'hot') AND p_name LIKE '%bolt'")
def _(spark, folder):
    return table(spark, folder, "part").where(conditions.whole_term(F.col("p_name"), "^(?!hot).*bolt$")).select("p_partkey")


@q("f21_search_bodies", "SELECT event_id FROM events WHERE ((event_type = 'click' OR event_type = 'error') AND value >= 20 AND value <= 90 AND NOT (user_id = 5)) OR event_type LIKE 'v%w'")
def _(spark, folder):
    e = events(spark, folder)
    body = lucene.to_search("((event_type:click OR event_type:error) AND value:[20 TO 90] AND NOT user_id:5) OR event_type:v*w")
    return e.where(lucene.search_condition(e, body)).select("event_id")


@q("f26_routed_tables", "SELECT 'odd' AS side, event_id FROM events WHERE user_id % 2 = 1")
def _(spark, folder):
    """The rows of the tables whose labels match."""
    catalog = _tables(spark, folder)
    parts = [catalog.scan(t.name, 0, 1 << 60).select(F.lit(t.name).alias("side"), "event_id") for t in catalog.resolve(metric="value", labels={"side": "odd", "kind": "web"})]
    return merge.union_all(parts, ["side", "event_id"]) if len(parts) > 1 else parts[0]


def _half_sums(i: int) -> str:
    return f"SELECT event_type, (epoch_us(ts) // 1000) // {DAY} * {DAY} AS t, sum(value) AS v FROM events WHERE user_id % 2 = {i} GROUP BY 1, 2"


@q("m07_chosen_merge", f"WITH x AS ({_half_sums(0)} UNION ALL {_half_sums(1)}) SELECT 'max' AS how, event_type, t, round(max(v), 4) AS v FROM x GROUP BY 2, 3 UNION ALL SELECT 'avg', event_type, t, round(avg(v), 4) FROM x GROUP BY 2, 3 UNION ALL SELECT 'sum', event_type, t, round(sum(v), 4) FROM x GROUP BY 2, 3")
def _(spark, folder):
    """The merge that a query's functions ask for, applied to two storages' series."""
    e = events(spark, folder)
    halves = [e.where(F.col("user_id") % 2 == i).groupBy("event_type", (F.floor(F.col("t") / DAY) * DAY).alias("t")).agg(F.sum("value").alias("v")) for i in (0, 1)]
    asked = [merge.merge_function("max", None), merge.merge_function(None, "avg_over_time"), merge.merge_function("count", None)]
    parts = [merge.merge_series(halves, ["event_type"], how).select(F.lit(how).alias("how"), "event_type", "t", F.round("v", 4).alias("v")) for how in asked]
    return merge.union_all(parts, ["how", "event_type", "t", "v"])


@q("m16_pages", "SELECT 'customer' AS name, c_custkey AS id FROM customer UNION ALL SELECT 'supplier', s_suppkey FROM supplier")
def _(spark, folder):
    """All pages of two tables, one of which is finished long before the other and isn't asked again: each row once."""
    tables = {"customer": table(spark, folder, "customer").select(F.col("c_custkey").alias("id")), "supplier": table(spark, folder, "supplier").select(F.col("s_suppkey").alias("id"))}
    size = max(1, tables["customer"].count() // 3)
    pages, cursors = [], {}
    while True:
        rows, cursors = rawrows.next_page(tables, ["id"], cursors, size)
        if rows is None:
            break
        pages.append(rows.select(F.col("__table").alias("name"), "id"))
    return merge.union_all(pages, ["name", "id"])


@q("m17_scroll_pages", "SELECT c_custkey, c_name FROM customer")
def _(spark, folder):
    """The pages of all slices of a scroll, put together, are the table."""
    df = table(spark, folder, "customer").select("c_custkey", "c_name")
    session, pages = rawrows.ScrollSession(df, ["c_custkey"], 2, 60, 0.0), []
    size = max(1, df.count() // 3)
    for number in range(session.slices):
        if session.lock(number):
            while (rows := session.page(number, size, 1.0)) is not None:
                pages.append(rows)
            session.unlock(number)
    session.close()
    return merge.union_all(pages, ["c_custkey", "c_name"])


_SQL = {
    "f02_distinct_list": "SELECT DISTINCT event_type, user_id FROM events",
    "m23_dialect_set_operations": "SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier EXCEPT SELECT n_nationkey FROM nation WHERE n_nationkey < 5 UNION ALL SELECT r_regionkey FROM region",
}
for _name, _text in _SQL.items():
    q(_name, _text)(lambda spark, folder, text=_text: sqldialect.run(spark, text, {t: table(spark, folder, t) for t in ("events", "customer", "supplier", "nation", "region") if t in text}))


@q("m08_ordered_samples", f"SELECT event_type, t, round(v, 4) AS v FROM ({_half_sums(0)} UNION ALL {_half_sums(1)}) ORDER BY event_type, t, v DESC LIMIT 40")
def _(spark, folder):
    e = events(spark, folder)
    halves = [e.where(F.col("user_id") % 2 == i).groupBy("event_type", (F.floor(F.col("t") / DAY) * DAY).alias("t")).agg(F.round(F.sum("value"), 4).alias("v")) for i in (0, 1)]
    both = merge.union_all(halves, ["event_type", "t", "v"])
    return rawrows.page(both, rawrows.ordering(both, ["event_type", "t", "-v"]), 0, 40)


@q("m27_replica_metadata", "SELECT DISTINCT event_type FROM events")
def _(spark, folder):
    """Series that two replicas list, once each."""
    catalog = _tables(spark, folder)
    return merge.union_all([structured.series_list(catalog, n, 0, 1 << 60) for n in ("even", "odd")], ["event_type"]).distinct()


for _n, _cond in {"comma": "FROM nation, orders AS o WHERE o.o_orderkey % 25 = n_nationkey", "qualified": "FROM db.orders o WHERE true".replace("db.", ""), "bracket": "FROM (orders) WHERE true", "cte": "FROM kept WHERE true"}.items():
    _body = f"SELECT o_orderkey {_cond}"
    _head = "WITH kept AS (SELECT o_orderkey FROM orders) " if _n == "cte" else ""
    _want = "SELECT o_orderkey FROM orders WHERE o_totalprice > 200000"
    q(f"sql23_injected_{_n}", _want)(lambda spark, folder, text=_head + _body: sqldialect.run(spark, text, {t: table(spark, folder, t) for t in ("orders", "nation")}, filters={"orders": "o_totalprice > 200000"}))


# Records

@q("e18_json_pipeline", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, epoch_us(ts) // 1000 AS time FROM events WHERE props IS NOT NULL")
def _(spark, folder):
    good, _ = etl.log_pipeline(events(spark, folder), "props", "json", {"k": "int"}, at=F.col("t"))
    return good.select("event_id", "k", "time")


@q("e18_separator_pipeline", "SELECT s_suppkey, split_part(line, '|', 1) AS name, CAST(split_part(line, '|', 2) AS DOUBLE) AS balance, false AS rejected FROM (SELECT s_suppkey, s_name || '|' || s_acctbal AS line FROM supplier WHERE s_suppkey % 5 > 0) UNION ALL SELECT s_suppkey, NULL, NULL, true FROM supplier WHERE s_suppkey % 5 = 0")
def _(spark, folder):
    line = F.when(F.col("s_suppkey") % 5 > 0, F.concat_ws("|", "s_name", F.col("s_acctbal").cast("string"))).otherwise(F.col("s_name"))
    good, bad = etl.log_pipeline(table(spark, folder, "supplier").select("s_suppkey", line.alias("line")), "line", "separator", {"name": "string", "balance": "float"})
    both = good.select("s_suppkey", "name", "balance", F.lit(False).alias("rejected"))
    return both.unionByName(bad.select("s_suppkey", F.lit(None).cast("string").alias("name"), F.lit(None).cast("double").alias("balance"), F.lit(True).alias("rejected")))


@q("e18_regexp_pipeline", r"SELECT p_partkey, regexp_extract(p_brand, '^Brand#(\d)(\d)$', 1)::BIGINT AS maker, regexp_extract(p_brand, '^Brand#(\d)(\d)$', 2)::BIGINT AS line FROM part WHERE regexp_matches(p_brand, '^Brand#(\d)(\d)$')")
def _(spark, folder):
    good, _ = etl.log_pipeline(table(spark, folder, "part").select("p_partkey", "p_brand"), "p_brand", "regexp", {"maker": "int", "line": "int"}, pattern=r"^Brand#(?P<maker>\d)(?P<line>\d)$")
    return good.select("p_partkey", "maker", "line")


@q("e18_text_pipeline", "SELECT doc_id, text AS log FROM documents WHERE text IS NOT NULL AND trim(text) <> ''")
def _(spark, folder):
    good, _ = etl.log_pipeline(table(spark, folder, "documents").select("doc_id", "text"), "text", "text", {"log": "string"})
    return good.select("doc_id", "log")


@q("e12_zip", "SELECT rec_id, unnest(data.cpu.per_usage) AS a, unnest(list_reverse(data.cpu.per_usage)) AS b FROM net_test_data WHERE len(data.cpu.per_usage) > 0")
def _(spark, folder):
    df = table(spark, folder, "net_test_data").where(F.size("data.cpu.per_usage") > 0).select("rec_id", F.col("data.cpu.per_usage").alias("a"), F.reverse("data.cpu.per_usage").alias("b"))
    return etl.fission(df, ["a", "b"], "zip")


@q("e49_field_types_all", "SELECT 'k' AS field, 'int' AS type, count(*) AS n FROM events WHERE json_extract_string(props, '$.k') IS NOT NULL")
def _(spark, folder):
    return etl.inferred_fields(events(spark, folder), "props", 1.0)


@q("c03_filtered_metrics", "SELECT event_id, CASE WHEN event_type = 'click' THEN 'tap' ELSE event_type END AS event_type FROM events WHERE event_type <> 'view'")
def _(spark, folder):
    return telemetry.filter_metrics(events(spark, folder), "event_type", drop_in=["view"], rename={"click": "tap"}).select("event_id", "event_type")


@q("c14_token_bucket")
def _(spark, folder):
    """One event a minute and user, five at once: what a bucket lets through."""
    return telemetry.token_bucket(events(spark, folder), "user_id", "t", 1 / 60, 5, ["event_id"]).select("event_id")


@q("g05_roots", """WITH n AS (SELECT DISTINCT ON (trace_id, lower(trim(span_id))) trace_id, lower(trim(span_id)) AS span_id, start_time, CASE WHEN regexp_matches(lower(trim(parent_span_id)), '[^0]') THEN lower(trim(parent_span_id)) END AS parent FROM complex WHERE trace_id IS NOT NULL AND span_id IS NOT NULL ORDER BY trace_id, lower(trim(span_id)), time NULLS LAST, start_time NULLS LAST, end_time NULLS LAST, parent_span_id NULLS LAST),
    p AS (SELECT trace_id, lower(trim(span_id)) AS span_id, min(CASE WHEN regexp_matches(lower(trim(parent_span_id)), '[^0]') THEN lower(trim(parent_span_id)) END) AS parent FROM complex WHERE trace_id IS NOT NULL AND span_id IS NOT NULL GROUP BY 1, 2),
    r AS (SELECT p.trace_id, p.span_id FROM p LEFT JOIN p u ON u.trace_id = p.trace_id AND u.span_id = p.parent WHERE u.span_id IS NULL)
    SELECT DISTINCT ON (trace_id) trace_id, span_id AS root_span_id FROM n JOIN r USING (trace_id, span_id) ORDER BY trace_id, start_time NULLS FIRST, span_id""")
def _(spark, folder):
    """The root of each trace that has one: among spans of least depth the one that starts first."""
    spans = table(spark, folder, "complex")
    rows = topology.with_depth(spans).where("depth = 0")
    return topology.trace_info(spans).join(rows.select("trace_id").distinct(), "trace_id").select("trace_id", "root_span_id")


@q("g15_first_path", "SELECT DISTINCT o_orderkey FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey = 2")
def _(spark, folder):
    """All simple paths from region to order are tried, shortest first; the direct one has no data."""
    t = lambda n: table(spark, folder, n)
    relations = {
        ("region", "nation"): t("nation").select(F.col("n_regionkey").alias("r"), F.col("n_nationkey").alias("n")), ("nation", "customer"): t("customer").select(F.col("c_nationkey").alias("n"), F.col("c_custkey").alias("c")),
        ("customer", "order"): t("orders").select(F.col("o_custkey").alias("c"), F.col("o_orderkey").alias("o")), ("region", "order"): t("orders").where(F.lit(False)).select(F.lit(0).alias("r"), F.col("o_orderkey").alias("o")),
    }
    paths = topology.resource_paths(list(relations), "region", "order")
    start = t("region").where("r_regionkey = 2").select(F.col("r_regionkey").alias("r"))
    _, rows = topology.first_path_with_data(start, paths, relations, {"region": ["r"], "nation": ["n"], "customer": ["c"], "order": ["o"]})
    return rows.select(F.col("o").alias("o_orderkey"))


# PromQL

def promql(name: str, text: str, sql: str, labels: tuple[str, ...] = ("event_type",)) -> None:
    q(name, sql)(lambda spark, folder: run(spark, folder, text, list(labels)))


_T = f"(SELECT CAST(unnest(range({START}, {END + 1}, {STEP})) AS BIGINT) AS t)"
_PAIR = 'event_type, usr AS "user", t'
for _fn, _made in {"sum": "sum(v)", "min": "min(v)", "max": "max(v)", "count": "CAST(count(*) AS DOUBLE)", "group": "1.0::DOUBLE", "stdvar": "var_pop(v)"}.items():
    promql(f"promql06_{_fn}", f"{_fn} by (event_type) (events)", I + f" SELECT event_type, t, round({_made}, 6) AS v FROM i GROUP BY 1, 2")
promql("promql15_irate", "irate(events[1d])", S + G + w(D1) + f" i AS (SELECT event_type, usr, t, max(ts) AS l, arg_max(CASE WHEN v < pv THEN v ELSE v - pv END, ts) AS d, arg_max(pt, ts) AS p FROM w GROUP BY 1, 2, 3) SELECT {_PAIR}, round(d / ((l - p) / 1000.0), 6) AS v FROM i WHERE p >= t - {D1}", ("event_type", "user"))
promql("promql19_present", "present_over_time(events[1d])", S + G + w(D1) + f" i AS (SELECT DISTINCT event_type, usr, t FROM w) SELECT {_PAIR}, 1.0::DOUBLE AS v FROM i", ("event_type", "user"))
promql("promql19_absent", 'absent_over_time(events{event_type="none"}[1d])', f"SELECT 'none' AS event_type, t, 1.0::DOUBLE AS v FROM {_T}")
promql("promql23_scalar", "events * 0 + scalar(count(events))", I + f", c AS (SELECT t, count(*) AS n FROM i GROUP BY 1) SELECT event_type, usr AS \"user\", i.t, CAST(n AS DOUBLE) AS v FROM i JOIN c ON c.t = i.t", ("event_type", "user"))
promql("promql23_vector_time", "vector(time()) + pi() * 0", f"SELECT t, t / 1000.0 AS v FROM {_T}", ())
for _fn, _made in {"exp": "exp(v / 1000)", "log2": "log2(v + 1)", "log10": "log10(v + 1)", "sgn": "CAST(sign(v) AS DOUBLE)", "deg": "degrees(v)", "rad": "radians(v)", "sin": "sin(v)", "cos": "cos(v)", "atan": "atan(v)", "tanh": "(exp(v / 50) - exp(-v / 50)) / (exp(v / 50) + exp(-v / 50))"}.items():
    _arg = {"exp": "events / 1000", "log2": "events + 1", "log10": "events + 1", "tanh": "events / 50"}.get(_fn, "events")
    promql(f"promql26_{_fn}", f"{_fn}({_arg})", I + f" SELECT {_PAIR}, round({_made}, 6) AS v FROM i", ("event_type", "user"))
for _fn, _made in {"minute": "extract(minute FROM x)", "day_of_month": "extract(day FROM x)", "day_of_week": "extract(dow FROM x)", "days_in_month": "extract(day FROM last_day(x))", "month": "extract(month FROM x)", "year": "extract(year FROM x)"}.items():
    promql(f"promql27_{_fn}", f"{_fn}()", f"SELECT t, CAST({_made} AS DOUBLE) AS v FROM (SELECT t, make_timestamp(t * 1000) AS x FROM {_T})", ())
promql("promql24_round", "round(events, 5) - ceil(events) + floor(events)", I + f" SELECT {_PAIR}, round(floor(v / 5 + 0.5) * 5 - ceil(v) + floor(v), 6) AS v FROM i", ("event_type", "user"))
promql("promql17_window_functions", "sum_over_time(events[1d]) - min_over_time(events[1d]) + max_over_time(events[1d])", S + G + w(D1) + f" i AS (SELECT event_type, usr, t, sum(v) - min(v) + max(v) AS v FROM w GROUP BY 1, 2, 3) SELECT {_PAIR}, round(v, 6) AS v FROM i", ("event_type", "user"))
promql("promql14_delta", "delta(events[1d])", S + G + w(D1) + X.format(w=D1).replace("lv - fv + lost AS d", "lv - fv AS d").replace("CASE WHEN d > 0 AND fv >= 0 AND sampled * fv / d < before THEN sampled * fv / d ELSE before END AS b", "before AS b") + f" SELECT {_PAIR}, round(inc, 6) AS v FROM r", ("event_type", "user"))


@q("promql29_sorted", I + f" SELECT CAST(row_number() OVER (ORDER BY v DESC, event_type, usr) AS INT) AS place, event_type, usr AS \"user\", round(v, 6) AS v FROM i WHERE t = {START}")
def _(spark, folder):
    """sort_desc keeps the values; the order is that of an instant answer, ties by labels."""
    out = run(spark, folder, "sort_desc(events)", ["event_type", "user"], START, START)
    return rawrows.order_series(out, ["event_type", "user"], ["-_value"]).select(F.col("rank").alias("place"), "event_type", "user", "v")


def _meta(spark: SparkSession, folder: str) -> Catalog:
    load = lambda: events(spark, folder).withColumn("user", F.col("user_id").cast("string")).withColumn("time", F.col("t"))
    return Catalog([TableMeta("web.events", load, values=["value"], tags=["event_type", "user"])])


@q("promql35_series", "SELECT DISTINCT event_type, CAST(user_id AS VARCHAR) AS \"user\" FROM events")
def _(spark, folder):
    return structured.series_list(_meta(spark, folder), "web.events", 0, 1 << 60)


@q("promql35_keys", "SELECT 'field' AS kind, 'value' AS name, 'double' AS type UNION ALL SELECT 'tag', column_name, 'string' FROM (DESCRIBE SELECT event_type, CAST(user_id AS VARCHAR) AS \"user\" FROM events)")
def _(spark, folder):
    """Field and tag keys with the types that the table has them in."""
    catalog = _meta(spark, folder)
    types = structured.field_map(catalog.scan("web.events", 0, 1 << 60))
    rows = [("field", n, types[n]) for n in structured.field_keys(catalog, "web.events")] + [("tag", n, types[n]) for n in structured.tag_keys(catalog, "web.events")]
    return spark.createDataFrame(rows, "kind string, name string, type string")


@q("promql36_samples_with_exemplars", f"SELECT e.event_type, e._time, round(e.v, 6) AS v, x.exemplar FROM (SELECT event_type, (epoch_us(ts) // 1000) // {DAY} * {DAY} AS _time, sum(value) AS v FROM events GROUP BY 1, 2) e JOIN (SELECT event_type, (epoch_us(ts) // 1000) // {DAY} * {DAY} AS _time, arg_max(CAST(event_id AS VARCHAR), (value, CAST(event_id AS VARCHAR))) AS exemplar FROM events WHERE value IS NOT NULL GROUP BY 1, 2) x USING (event_type, _time)")
def _(spark, folder):
    """The samples of a series, each with the trace of its largest value."""
    e = events(spark, folder).withColumn("id", F.col("event_id").cast("string"))
    sums = e.groupBy("event_type", (F.floor(F.col("t") / DAY) * DAY).alias("_time")).agg(F.round(F.sum("value"), 6).alias("v"))
    return sums.join(structured.exemplars(e.where("value is not null"), "t", "value", "id", DAY, ["event_type"]).drop("_value"), ["event_type", "_time"])


