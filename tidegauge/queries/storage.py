"""Queries of sources, filters, storage-level aggregation and merging. Names start with the row of the operator inventory."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegauge.catalog import Catalog, TableMeta
from tidegauge.functions.timeutil import bounded, bucket_ms, day_partition, event_ms, zone_offset_ms
from tidegauge.operators import aggregate, merge, rawrows
from tidegauge.operators.conditions import Condition, compile_dnf, dnf, dnf_and, factored, matcher, phrase
from tidegauge.operators.merge import Route
from tidegauge.plans import lucene
from tidegauge.queries import Registry, table
from tidegauge.sources import lines, readers, stores

registry = Registry()
q = registry.add
HOUR, DAY = 3_600_000, 86_400_000
JAN = 1_704_067_200_000  # 2024-01-01


def events(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "events").withColumn("t", event_ms(F.col("ts")))


# Sources

@q("s02_source_by_storage", "SELECT event_type, count(*) AS n FROM events GROUP BY 1")
def _(spark, folder):
    return readers.source_of("parquet", spark, f"{folder}/events.parquet").rows().groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


@q("s03_search_scan", "SELECT event_id, event_type, value FROM events WHERE event_type = 'error' AND value > 100 ORDER BY value DESC, event_id LIMIT 20 OFFSET 5")
def _(spark, folder):
    df = events(spark, folder).where((F.col("event_type") == "error") & (F.col("value") > 100)).select("event_id", "event_type", "value")
    return rawrows.page(df, [F.col("value").desc(), F.col("event_id")], 5, 20)


@q("s05_batched_scans", "SELECT 'a' AS part, event_id FROM events WHERE value > 200 UNION ALL SELECT 'b', event_id FROM events WHERE event_type = 'click' AND value > 100")
def _(spark, folder):
    df = events(spark, folder)
    return df.where("value > 200").select(F.lit("a").alias("part"), "event_id").unionByName(df.where("event_type = 'click' and value > 100").select(F.lit("b").alias("part"), "event_id"))


@q("s07_missing_sort_field", "SELECT c_custkey AS id FROM customer")
def _(spark, folder):
    a = table(spark, folder, "customer").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("sort_by"))
    return readers.several([a, table(spark, folder, "supplier").select(F.col("s_suppkey").alias("id"))], "sort_by").select("id")


@q("s10_influx_bounds", f"SELECT event_type, (epoch_us(ts) // 1000) // {DAY} * {DAY} AS t, round(avg(value), 6) AS v FROM events WHERE (epoch_us(ts) // 1000) > {JAN} AND (epoch_us(ts) // 1000) < {JAN + 3 * DAY} GROUP BY 1, 2")
def _(spark, folder):
    df = events(spark, folder).where(bounded(F.col("t"), JAN, JAN + 3 * DAY, "()"))
    return df.groupBy("event_type", bucket_ms(F.col("t"), DAY).alias("t")).agg(F.round(F.avg("value"), 6).alias("v"))


@q("s14_storage_routes", f"SELECT event_id, value FROM events WHERE (epoch_us(ts) // 1000) >= {JAN + DAY} AND (epoch_us(ts) // 1000) < {JAN + 20 * DAY}")
def _(spark, folder):
    """Two segments that overlap by an hour after the migration: rows that both hold come out once."""
    load = lambda: table(spark, folder, "events").withColumn("time", event_ms(F.col("ts")))
    border = JAN + 10 * DAY
    meta = TableMeta("events", time_column="time", tags=["event_id"], routes=[Route("old", 0, border, load), Route("new", border, 1 << 60, load)])
    return Catalog([meta]).scan("events", JAN + DAY, JAN + 20 * DAY).select("event_id", "value")


@q("s16_tenant_filter", "SELECT event_id FROM events WHERE user_id < 50 AND event_type IN ('click', 'view')")
def _(spark, folder):
    load = lambda: table(spark, folder, "events").withColumn("time", event_ms(F.col("ts")))
    meta = TableMeta("events", load, filters=[[Condition("user_id", "lt", [50])]])
    return Catalog([meta]).scan("events", 0, 1 << 60, [[Condition("event_type", "eq", ["click", "view"])]]).select("event_id")


@q("s23_line_protocol", "SELECT event_type AS measurement, CAST(user_id AS VARCHAR) AS user_id, value AS v, CAST((epoch_us(ts) // 1000) * 1000000 AS BIGINT) AS time_ns FROM events")
def _(spark, folder):
    line = F.concat(F.col("event_type"), F.lit(",user="), F.col("user_id").cast("string"), F.lit(" value="), F.col("value").cast("string"), F.lit(" "), (F.col("t") * 1_000_000).cast("string"))
    parsed = lines.influx_lines(events(spark, folder).select(line.alias("value")))
    return parsed.select("measurement", F.try_element_at("tags", F.lit("user")).alias("user_id"), F.try_element_at("fields", F.lit("value")).try_cast("double").alias("v"), "time_ns")


@q("s24_tag_shards", "SELECT count(*) AS n, count(DISTINCT event_type) AS kinds FROM events")
def _(spark, folder):
    from tidegauge.session import scratch

    path = scratch(spark, "sharded")
    readers.write_sharded(table(spark, folder, "events"), path, ["event_type"], 4)
    back = readers.read_first_that_works([lambda: spark.read.parquet(path + "-gone"), lambda: spark.read.parquet(path)])
    per = back.groupBy("event_type").agg(F.count_distinct("shard").alias("shards"), F.count(F.lit(1)).alias("n")).where("shards = 1")
    return per.agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("kinds"))


@q("s25_store", "SELECT CAST(n_nationkey AS VARCHAR) AS key, n_name AS value FROM nation WHERE n_nationkey < 10")
def _(spark, folder):
    store = stores.Store(spark)
    rows = table(spark, folder, "nation").select(F.col("n_nationkey").cast("string").alias("key"), F.col("n_name").alias("value"), F.lit(None).cast("long").alias("expires"))
    store.put(rows.withColumn("value", F.lit("old")))
    store.put(rows)
    return store.get(rows.where(F.col("key").cast("int") < 10))


# Filters

@q("f01_keep_columns", "SELECT event_id, user_id FROM events")
def _(spark, folder):
    return events(spark, folder).select("event_id", "user_id")


@q("f02_distinct", "SELECT DISTINCT user_id, event_type FROM events")
def _(spark, folder):
    return events(spark, folder).select("user_id", "event_type").distinct()


def _where(spark, folder, fields, connectors, name="events", columns=("event_id",), **kw):
    df = table(spark, folder, name)
    return df.where(compile_dnf(df, dnf(fields, connectors), **kw)).select(*columns)


@q("f03_dnf", "SELECT event_id FROM events WHERE (event_type = 'click' AND value > 50) OR (event_type = 'view' AND user_id <= 20)")
def _(spark, folder):
    c = [Condition("event_type", "eq", ["click"]), Condition("value", "gt", [50]), Condition("event_type", "eq", ["view"]), Condition("user_id", "lte", [20])]
    return _where(spark, folder, c, ["and", "or", "and"])


@q("f04_nested_documents", "SELECT trace_id, span_id, rec FROM (SELECT trace_id, span_id, time AS rec, list_filter(events, lambda x: x.name = 'exception') AS hit FROM complex) WHERE len(hit) > 0")
def _(spark, folder):
    df = table(spark, folder, "complex")
    return df.where(compile_dnf(df, [[Condition("events.name", "eq", ["exception"], nested="events")]])).select("trace_id", "span_id", F.col("time").alias("rec"))


@q("f05_eq_in_like", "SELECT p_partkey FROM part WHERE p_brand IN ('Brand#7', 'Brand#16') AND contains(p_name, 'ing')")
def _(spark, folder):
    return _where(spark, folder, [Condition("p_brand", "eq", ["Brand#7", "Brand#16"]), Condition("p_name", "contains", ["ing"])], ["and"], "part", ("p_partkey",))


@q("f06_negatives", "SELECT p_partkey FROM part WHERE p_brand NOT IN ('Brand#7', 'Brand#16') AND NOT contains(p_name, 'ing') AND NOT contains(p_name, 'bolt')")
def _(spark, folder):
    return _where(spark, folder, [Condition("p_brand", "ne", ["Brand#7", "Brand#16"]), Condition("p_name", "ncontains", ["ing", "bolt"])], ["and"], "part", ("p_partkey",))


@q("f07_empty_is_null", "SELECT rec_id FROM net_test_data WHERE bk_agent_id IS NULL")
def _(spark, folder):
    return _where(spark, folder, [Condition("bk_agent_id", "eq", [""])], [], "net_test_data", ("rec_id",), null_as_empty=True)


@q("f08_existence", "SELECT rec_id FROM net_test_data WHERE gseindex IS NOT NULL AND bk_host_id IS NULL")
def _(spark, folder):
    return _where(spark, folder, [Condition("gseindex", "existed"), Condition("bk_host_id", "nexisted")], ["and"], "net_test_data", ("rec_id",))


@q("f09_regex", "SELECT p_partkey FROM part WHERE regexp_matches(p_name, 'hot|bolt$') AND NOT regexp_matches(p_type, '^ECO')")
def _(spark, folder):
    return _where(spark, folder, [Condition("p_name", "req", ["hot", "bolt$"]), Condition("p_type", "nreq", ["^ECO"])], ["and"], "part", ("p_partkey",))


@q("f10_ranges", "SELECT o_orderkey FROM orders WHERE o_totalprice >= 100000 AND o_totalprice < 200000")
def _(spark, folder):
    return _where(spark, folder, [Condition("o_totalprice", "gte", [100000]), Condition("o_totalprice", "lt", [200000])], ["and"], "orders", ("o_orderkey",))


@q("f11_wildcards", "SELECT p_partkey FROM part WHERE p_name LIKE 'l%g b_l%'")
def _(spark, folder):
    return _where(spark, folder, [Condition("p_name", "eq", ["l*g b?l*"], wildcard=True)], [], "part", ("p_partkey",))


@q("f12_phrase", r"SELECT doc_id FROM documents WHERE regexp_matches(lower(text), '(^|[^\p{L}\p{N}_])on[^\p{L}\p{N}_]+its[^\p{L}\p{N}_]+own($|[^\p{L}\p{N}_])')".replace("$|", "$|"))
def _(spark, folder):
    return table(spark, folder, "documents").where(phrase(F.col("text"), "on its own")).select("doc_id")


@q("f13_array_predicates", "SELECT rec_id FROM net_test_data WHERE len(list_filter(data.cpu.per_usage, lambda x: x > 60)) > 0")
def _(spark, folder):
    df = table(spark, folder, "net_test_data")
    return df.where(compile_dnf(df, [[Condition("data.cpu.per_usage", "gt", [60])]])).select("rec_id")


@q("f14_regexp_whole", "SELECT c_custkey FROM customer WHERE regexp_full_match(c_mktsegment, 'F.*|MACH[A-Z]+')")
def _(spark, folder):
    return table(spark, folder, "customer").where(F.col("c_mktsegment").rlike("^(?:F.*|MACH[A-Z]+)$")).select("c_custkey")


@q("f15_factored", "SELECT event_id FROM events WHERE event_type = 'error' AND (value > 200 OR user_id = 3)")
def _(spark, folder):
    a = Condition("event_type", "eq", ["error"])
    shared, rest = factored([[a, Condition("value", "gt", [200])], [a, Condition("user_id", "eq", [3])]])
    df = table(spark, folder, "events")
    return df.where(compile_dnf(df, dnf_and([shared], rest))).select("event_id")


@q("f16_closed_range", f"SELECT event_id FROM events WHERE (epoch_us(ts) // 1000) BETWEEN {JAN + DAY} AND {JAN + 2 * DAY}")
def _(spark, folder):
    return events(spark, folder).where(bounded(F.col("t"), JAN + DAY, JAN + 2 * DAY, "[]")).select("event_id")


@q("f17_day_partition", "SELECT event_id FROM events WHERE CAST(strftime(ts, '%Y%m%d') AS INT) BETWEEN 20240103 AND 20240104")
def _(spark, folder):
    day = F.date_format(F.col("ts").cast("timestamp"), "yyyyMMdd").cast("int")
    return events(spark, folder).where(day_partition(day, JAN + 2 * DAY, JAN + 4 * DAY - 2000, "UTC")).select("event_id")


LUCENE = 'source:runbook* AND (lang:en OR lang:"zh") AND NOT n_chars:[0 TO 500]'


@q("f18_query_string", "SELECT doc_id FROM documents WHERE source LIKE 'runbook%' AND lang IN ('en', 'zh') AND NOT coalesce(n_chars BETWEEN 0 AND 500, false)")
def _(spark, folder):
    df = table(spark, folder, "documents")
    return df.where(lucene.compile_query(df, LUCENE, default="text")).select("doc_id")


@q("f19_required_terms", "SELECT p_partkey FROM part WHERE p_brand = 'Brand#7' AND NOT coalesce(p_size >= 20, false)")
def _(spark, folder):
    df = table(spark, folder, "part")
    return df.where(lucene.compile_query(df, "+p_brand:Brand#7 -p_size:>=20 p_type:ECONOMY", default="p_name")).select("p_partkey")


@q("f20_field_conditions", "SELECT rec_id FROM net_test_data WHERE bk_host_id IS NOT NULL AND data.cpu.total_usage > 90 AND regexp_matches(ip, '^10\\.8\\.')")
def _(spark, folder):
    df = table(spark, folder, "net_test_data")
    return df.where(lucene.compile_query(df, r"_exists_:bk_host_id AND data.cpu.total_usage:>90 AND ip:/^10\.8\./")).select("rec_id")


@q("f22_slips", "SELECT p_partkey FROM part WHERE p_brand = 'Brand#7' AND p_type = 'LARGE'")
def _(spark, folder):
    df = table(spark, folder, "part")
    return df.where(lucene.compile_query(df, "p_brand:'Brand#7' and p_type:LARGE AND ", default="p_name")).select("p_partkey")


@q("f23_all_fields", "SELECT n_nationkey FROM nation WHERE n_name LIKE '%TION_1%'")
def _(spark, folder):
    df = table(spark, folder, "nation")
    return df.where(lucene.compile_query(df, "*:*TION_1*")).select("n_nationkey")


@q("f24_matchers", "SELECT span_id, trace_id, time FROM complex WHERE coalesce(resource['service.name'], '') <> 'quillgate' AND regexp_full_match(coalesce(attributes['db.system'], ''), 'my.*|redis')")
def _(spark, folder):
    df = table(spark, folder, "complex")
    return df.where(matcher(F.col("resource"), "service.name", "!=", "quillgate") & matcher(F.col("attributes"), "db.system", "=~", "my.*|redis")).select("span_id", "trace_id", "time")


@q("f25_insensitive", "SELECT doc_id FROM documents WHERE lower(lang) = 'en'")
def _(spark, folder):
    df = table(spark, folder, "documents")
    return df.where(lucene.compile_query(df, "lang:EN", default="text", insensitive=("lang",))).select("doc_id")


# Aggregation

@q("a01_group_by", "SELECT event_type, round(sum(value), 4) AS _value FROM events GROUP BY 1")
def _(spark, folder):
    return aggregate.grouped(events(spark, folder), ["event_type"], "SUM", "value").withColumn("_value", F.round("_value", 4))


@q("a02_date_histogram", f"SELECT event_type, ((epoch_us(ts) // 1000) + 28800000) // {DAY} * {DAY} - 28800000 AS _time, round(sum(value), 4) AS _value FROM events GROUP BY 1, 2")
def _(spark, folder):
    out = aggregate.grouped(events(spark, folder), ["event_type"], "sum", "value", DAY, "t", zone_offset_ms("Asia/Shanghai"))
    return out.withColumn("_value", F.round("_value", 4))


@q("a04_cardinality", "SELECT event_type, count(DISTINCT user_id) AS _value FROM events GROUP BY 1")
def _(spark, folder):
    return aggregate.grouped(events(spark, folder), ["event_type"], "cardinality", "user_id")


@q("a05_metrics", "SELECT event_type, min(value) AS lo, max(value) AS hi, round(avg(value), 6) AS mean, count(value) AS n FROM events GROUP BY 1")
def _(spark, folder):
    a = aggregate.aggregate_of
    v = F.col("value")
    return events(spark, folder).groupBy("event_type").agg(a("min", v).alias("lo"), a("max", v).alias("hi"), F.round(a("mean", v), 6).alias("mean"), a("value_count", v).alias("n"))


@q("a06_percentiles", "SELECT event_type, p.percent, round(quantile_cont(value, p.percent / 100), 6) AS _value FROM events, (SELECT unnest([50.0::DOUBLE, 95.0::DOUBLE, 99.0::DOUBLE]) AS percent) p GROUP BY 1, 2".replace("quantile_cont(value, p.percent / 100)", "CASE p.percent WHEN 50 THEN quantile_cont(value, 0.5) WHEN 95 THEN quantile_cont(value, 0.95) ELSE quantile_cont(value, 0.99) END"))
def _(spark, folder):
    return aggregate.percentiles(events(spark, folder), ["event_type"], "value", [50, 95, 99]).withColumn("_value", F.round("_value", 6))


@q("a07_terms", "WITH a AS (SELECT event_type, count(*) AS n FROM events GROUP BY 1 ORDER BY n DESC, event_type LIMIT 3), b AS (SELECT event_type, CAST(user_id AS VARCHAR) AS user_id, count(*) AS doc_count FROM events WHERE event_type IN (SELECT event_type FROM a) GROUP BY 1, 2) SELECT event_type, user_id, doc_count FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY doc_count DESC, user_id) AS k FROM b) WHERE k <= 5")
def _(spark, folder):
    return aggregate.terms(events(spark, folder), ["event_type", "user_id"], [3, 5])


@q("a08_zero_buckets", f"WITH c AS (SELECT (epoch_us(ts) // 1000) // {HOUR} * {HOUR} AS t, count(*) AS n FROM events WHERE event_type = 'error' AND value > 150 GROUP BY 1) SELECT CAST(g.t AS BIGINT) AS _time, coalesce(c.n, 0) AS doc_count FROM (SELECT unnest(range((SELECT min(t) FROM c), (SELECT max(t) FROM c) + 1, {HOUR})) AS t) g LEFT JOIN c ON c.t = g.t")
def _(spark, folder):
    return aggregate.histogram(events(spark, folder).where("event_type = 'error' and value > 150"), "t", HOUR)


@q("a09_nested_aggregate", "SELECT n.name AS name, count(*) AS doc_count, count(DISTINCT rec_id) AS parent_count FROM (SELECT rec_id, unnest(data.net.dev) AS n FROM net_test_data) GROUP BY 1")
def _(spark, folder):
    return aggregate.nested(table(spark, folder, "net_test_data").select("rec_id", F.col("data.net.dev").alias("dev")), "dev", "rec_id", [], ["name"])


@q("a11_count_rows", f"SELECT (epoch_us(ts) // 1000) // {DAY} * {DAY} AS _time, count(*) AS _value FROM events GROUP BY 1")
def _(spark, folder):
    return aggregate.grouped(events(spark, folder), [], "count", "*", DAY, "t")


@q("a12_zero_fill", f"WITH c AS (SELECT event_type, (epoch_us(ts) // 1000) // {HOUR} * {HOUR} AS t, sum(value) AS v FROM events WHERE (epoch_us(ts) // 1000) >= {JAN} AND (epoch_us(ts) // 1000) < {JAN + 2 * DAY} GROUP BY 1, 2) SELECT e.event_type, CAST(g.t AS BIGINT) AS _time, round(coalesce(c.v, 0), 4) AS _value FROM (SELECT DISTINCT event_type FROM c) e CROSS JOIN (SELECT unnest(range({JAN}, {JAN + 2 * DAY}, {HOUR})) AS t) g LEFT JOIN c ON c.event_type = e.event_type AND c.t = g.t")
def _(spark, folder):
    df = events(spark, folder).where(bounded(F.col("t"), JAN, JAN + 2 * DAY))
    out = aggregate.filled(aggregate.grouped(df, ["event_type"], "sum", "value", HOUR, "t"), ["event_type"], JAN, JAN + 2 * DAY, HOUR)
    return out.withColumn("_value", F.round("_value", 4))


@q("a14_frame_stddev", f"SELECT event_type, (epoch_us(ts) // 1000) // {DAY} * {DAY} AS _time, round(stddev_samp(value), 6) AS _value FROM events GROUP BY 1, 2")
def _(spark, folder):
    return aggregate.grouped(events(spark, folder), ["event_type"], "std", "value", DAY, "t").withColumn("_value", F.round("_value", 6))


@q("a15_pushed_down", f"SELECT event_type, (epoch_us(ts) // 1000) // {HOUR} * {HOUR} AS _time, max(value) AS _value FROM events GROUP BY 1, 2")
def _(spark, folder):
    return aggregate.grouped(events(spark, folder), ["event_type"], aggregate.pushed_down("max", "max_over_time"), "value", HOUR, "t")


@q("a17_rollup", "SELECT l_returnflag, l_linestatus, count(*) AS n, CAST(sum(l_quantity) AS BIGINT) AS qty FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)")
def _(spark, folder):
    return table(spark, folder, "lineitem").rollup("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("n"), F.sum("l_quantity").cast("long").alias("qty"))


@q("a19_collapse", "SELECT user_id, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS k FROM events) WHERE k = 1")
def _(spark, folder):
    return aggregate.collapse(events(spark, folder), "user_id", [F.col("value").desc(), F.col("event_id")]).select("user_id", "event_id", "value")


@q("a21_rollup_tables", f"SELECT event_type, (epoch_us(ts) // 1000) // {DAY} * {DAY} AS _time, round(sum(value), 4) AS v FROM events WHERE (epoch_us(ts) // 1000) < {JAN + 30 * DAY} GROUP BY 1, 2")
def _(spark, folder):
    """A day's sums from the hourly rollup, which divides the window."""
    hourly = lambda: events(spark, folder).groupBy("event_type", bucket_ms(F.col("t"), HOUR).alias("time")).agg(F.sum("value").alias("value"))
    raw = lambda: events(spark, folder).withColumn("time", F.col("t"))
    df = Catalog([TableMeta("e", raw, rollups={HOUR: hourly})]).scan("e", 0, JAN + 30 * DAY, window_ms=DAY)
    return df.groupBy("event_type", bucket_ms(F.col("_time"), DAY).alias("_time")).agg(F.round(F.sum("value"), 4).alias("v"))


# Merging

@q("m01_union_all", "SELECT c_custkey AS id, c_name AS name, c_acctbal AS bal FROM customer WHERE c_acctbal < 0 UNION ALL SELECT s_suppkey, s_name, s_acctbal FROM supplier WHERE s_acctbal < 0")
def _(spark, folder):
    a = table(spark, folder, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("bal"))
    b = table(spark, folder, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("bal"))
    return merge.union_all([a.where("bal < 0"), b.where("bal < 0")], ["id", "name", "bal"])


@q("m02_union_common", "SELECT rec_id, dataid, CAST(timezone AS VARCHAR) AS ip FROM (SELECT rec_id, dataid, ip AS timezone FROM net_test_data UNION ALL SELECT rec_id, dataid, ip FROM swap_test_data)")
def _(spark, folder):
    a, b = (table(spark, folder, t).select("rec_id", "dataid", "ip", *extra) for t, extra in (("net_test_data", ["batch_id"]), ("swap_test_data", ["bizid"])))
    return merge.union_common([a, b])


_SERIES = f"SELECT event_type, (epoch_us(ts) // 1000) // {DAY} * {DAY} AS t, sum(value) AS v FROM events WHERE user_id % 2 = {{}} GROUP BY 1, 2"


def _halves(spark, folder):
    e = events(spark, folder)
    day = bucket_ms(F.col("t"), DAY).alias("t")
    return [e.where(F.col("user_id") % 2 == i).groupBy("event_type", day).agg(F.sum("value").alias("v")) for i in (0, 1)]


@q("m04_merge_series", f"SELECT event_type, t, round(avg(v), 4) AS v FROM ({_SERIES.format(0)} UNION ALL {_SERIES.format(1)}) GROUP BY 1, 2")
def _(spark, folder):
    return merge.merge_series(_halves(spark, folder), ["event_type"], merge.merge_function("mean", None)).withColumn("v", F.round("v", 4))


@q("m05_route_filter", f"SELECT event_type, t FROM ({_SERIES.format(0)}) WHERE t < {JAN + 10 * DAY + HOUR} AND t + {DAY} > {JAN + 5 * DAY}")
def _(spark, folder):
    return merge.route_filter(_halves(spark, folder)[0], Route("r", JAN + 5 * DAY, JAN + 10 * DAY + HOUR), DAY).select("event_type", "t")


@q("m06_weighted_average", f"""WITH a AS ({_SERIES.format(0)}), b AS ({_SERIES.format(1)}), x AS (
    SELECT event_type, t, v, greatest(least(t + {DAY}, {JAN + 10 * DAY + 6 * HOUR}) - greatest(t, {JAN}), 0) AS w FROM a
    UNION ALL SELECT event_type, t, v, greatest(least(t + {DAY}, {JAN + 40 * DAY}) - greatest(t, {JAN + 10 * DAY + 6 * HOUR}), 0) FROM b)
    SELECT event_type, t, round(CASE WHEN sum(w) > 0 THEN sum(v * w) / sum(w) ELSE avg(v) END, 4) AS v FROM x GROUP BY 1, 2""")  # fmt: skip
def _(spark, folder):
    a, b = _halves(spark, folder)
    border = JAN + 10 * DAY + 6 * HOUR
    return merge.merge_average([(a, Route("a", JAN, border)), (b, Route("b", border, JAN + 40 * DAY))], ["event_type"], DAY).withColumn("v", F.round("v", 4))


@q("m10_merge_sort", "SELECT rec_id, gseindex FROM (SELECT rec_id, gseindex FROM net_test_data ORDER BY gseindex DESC NULLS FIRST, rec_id LIMIT 50)")
def _(spark, folder):
    df = table(spark, folder, "net_test_data").select("rec_id", "gseindex")
    return df.orderBy(*rawrows.ordering(df, ["-gseindex", "rec_id"])).limit(50)


@q("m14_merged_page", "SELECT id, kind FROM (SELECT c_custkey AS id, 'c' AS kind, c_acctbal AS bal FROM customer UNION ALL SELECT s_suppkey, 's', s_acctbal FROM supplier) ORDER BY bal DESC, kind, id LIMIT 20 OFFSET 30")
def _(spark, folder):
    a = table(spark, folder, "customer").select(F.col("c_custkey").alias("id"), F.lit("c").alias("kind"), F.col("c_acctbal").alias("bal"))
    b = table(spark, folder, "supplier").select(F.col("s_suppkey").alias("id"), F.lit("s").alias("kind"), F.col("s_acctbal").alias("bal"))
    return rawrows.page(a.unionByName(b), [F.col("bal").desc(), F.col("kind"), F.col("id")], 30, 20).select("id", "kind")


@q("m16_keyset_page", "SELECT o_orderkey, o_totalprice FROM orders WHERE (o_totalprice, o_orderkey) > (300000, 100) ORDER BY o_totalprice, o_orderkey LIMIT 25")
def _(spark, folder):
    df = rawrows.after(table(spark, folder, "orders").select("o_orderkey", "o_totalprice"), ["o_totalprice", "o_orderkey"], [300000.0, 100])
    return df.orderBy("o_totalprice", "o_orderkey").limit(25)


@q("m17_scroll_slices", "SELECT count(*) AS n, count(DISTINCT event_id) AS ids FROM events")
def _(spark, folder):
    parts = [rawrows.slice_of(events(spark, folder), "event_id", i, 3).select("event_id") for i in range(3)]
    return parts[0].union(parts[1]).union(parts[2]).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("event_id").alias("ids"))


@q("m18_series_limits", f"WITH s AS ({_SERIES.format(0)}), f AS (SELECT DISTINCT event_type FROM s ORDER BY 1 LIMIT 2) SELECT event_type, t FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY t) AS k FROM s WHERE event_type IN (SELECT event_type FROM f)) WHERE k <= 4")
def _(spark, folder):
    return rawrows.limit_series(_halves(spark, folder)[0], ["event_type"], 4, 2).select("event_type", "t")


@q("m19_order_series", f"WITH s AS ({_SERIES.format(0)}) SELECT event_type, CAST(row_number() OVER (ORDER BY arg_max(v, t) DESC, event_type) AS INT) AS rank FROM s GROUP BY 1")
def _(spark, folder):
    return rawrows.order_series(_halves(spark, folder)[0], ["event_type"], ["-_value"]).select("event_type", "rank").distinct()


@q("m20_highlight", "SELECT p_partkey, regexp_replace(p_name, '(?i)(hot|bolt)', '<mark>\\1</mark>', 'g') AS marked FROM part WHERE regexp_matches(p_name, '(?i)hot|bolt')")
def _(spark, folder):
    df = rawrows.highlight(table(spark, folder, "part"), ["p_name"], ["hot", "bolt"]).where(F.size("__highlight") > 0)
    return df.select("p_partkey", F.try_element_at("__highlight", F.lit("p_name")).alias("marked"))


@q("m21_lttb")
def _(spark, folder):
    return rawrows.lttb(_halves(spark, folder)[0], ["event_type"], 10)


@q("m22_realign", f"SELECT event_type, {JAN} + (row_number() OVER (PARTITION BY event_type ORDER BY t) - 1) * {HOUR} AS t FROM ({_SERIES.format(1)})")
def _(spark, folder):
    return rawrows.realigned(_halves(spark, folder)[1], ["event_type"], JAN, HOUR).select("event_type", "t")


@q("m23_set_operations", "(SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier) EXCEPT SELECT n_nationkey FROM nation WHERE n_regionkey = 0")
def _(spark, folder):
    c, s = table(spark, folder, "customer").select(F.col("c_nationkey").alias("k")), table(spark, folder, "supplier").select("s_nationkey")
    return c.intersect(s).subtract(table(spark, folder, "nation").where("n_regionkey = 0").select("n_nationkey"))


@q("m24_composed_limits", "SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 8 OFFSET 12")
def _(spark, folder):
    limit, offset = rawrows.compose_limits((10, 10), (50, 2))
    return table(spark, folder, "orders").orderBy("o_orderkey").offset(offset).limit(limit).select("o_orderkey")


@q("m27_distinct_union", "SELECT lang FROM documents UNION SELECT lang FROM documents")
def _(spark, folder):
    d = table(spark, folder, "documents").select("lang")
    return d.unionByName(d).distinct()


# The queries above on one half of the events, here on all of them.

_ALL = f"SELECT event_type, (epoch_us(ts) // 1000) // {DAY} * {DAY} AS t, sum(value) AS v FROM events GROUP BY 1, 2"


def _daily(spark, folder):
    return events(spark, folder).groupBy("event_type", bucket_ms(F.col("t"), DAY).alias("t")).agg(F.sum("value").alias("v"))


@q("m05_route_filter_all", f"SELECT event_type, t FROM ({_ALL}) WHERE t < {JAN + 10 * DAY + HOUR} AND t + {DAY} > {JAN + 5 * DAY}")
def _(spark, folder):
    return merge.route_filter(_daily(spark, folder), Route("r", JAN + 5 * DAY, JAN + 10 * DAY + HOUR), DAY).select("event_type", "t")


@q("m18_series_limits_all", f"WITH s AS ({_ALL}), f AS (SELECT DISTINCT event_type FROM s ORDER BY 1 LIMIT 2) SELECT event_type, t FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY t) AS k FROM s WHERE event_type IN (SELECT event_type FROM f)) WHERE k <= 4")
def _(spark, folder):
    return rawrows.limit_series(_daily(spark, folder), ["event_type"], 4, 2).select("event_type", "t")


@q("m19_order_series_all", f"WITH s AS ({_ALL}) SELECT event_type, CAST(row_number() OVER (ORDER BY arg_max(v, t) DESC, event_type) AS INT) AS rank FROM s GROUP BY 1")
def _(spark, folder):
    return rawrows.order_series(_daily(spark, folder), ["event_type"], ["-_value"]).select("event_type", "rank").distinct()


@q("m21_lttb_all")
def _(spark, folder):
    return rawrows.lttb(_daily(spark, folder), ["event_type"], 10)


@q("m22_realign_all", f"SELECT event_type, {JAN} + (row_number() OVER (PARTITION BY event_type ORDER BY t) - 1) * {HOUR} AS t FROM ({_ALL})")
def _(spark, folder):
    return rawrows.realigned(_daily(spark, folder), ["event_type"], JAN, HOUR).select("event_type", "t")
