"""Queries of the PromQL engine, the structured form and the SQL dialect."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegauge.catalog import Catalog, TableMeta, series_of
from tidegauge.functions.timeutil import align_ms, event_ms
from tidegauge.plans import sqldialect, structured
from tidegauge.plans.promql import evaluate
from tidegauge.queries import Registry, table

registry = Registry()
q = registry.add
HOUR, DAY = 3_600_000, 86_400_000
START, END, STEP = 1_704_326_400_000, 1_704_499_200_000, 6 * HOUR  # two days of January 2024, every six hours
BACK = 12 * HOUR


def series(spark: SparkSession, folder: str) -> DataFrame:
    """Each event is a sample of the series (event_type, user)."""
    e = table(spark, folder, "events").withColumn("user", F.col("user_id").cast("string"))
    return series_of(e, "events", ["event_type", "user"], event_ms(F.col("ts")), F.col("value"))


def run(spark: SparkSession, folder: str, text: str, labels: list[str], start: int = START, end: int = END, step: int = STEP) -> DataFrame:
    out = evaluate(series(spark, folder), text, start, end, step, BACK)
    return out.select(*[F.try_element_at("labels", F.lit(c)).alias(c) for c in labels], "t", F.round("v", 6).alias("v"))


# The same by definition: samples, evaluation times, and for each time the samples of its window.
S = "WITH s AS (SELECT event_type, CAST(user_id AS VARCHAR) AS usr, epoch_us(ts) // 1000 AS ts, value AS v, lag(value) OVER (PARTITION BY event_type, user_id ORDER BY ts) AS pv, lag(epoch_us(ts) // 1000) OVER (PARTITION BY event_type, user_id ORDER BY ts) AS pt FROM events),"
G = f" g AS (SELECT CAST(unnest(range({START}, {END + 1}, {STEP})) AS BIGINT) AS t),"


def w(ms: int, extra: str = "") -> str:
    return f" w AS (SELECT g.t, s.* FROM g JOIN s ON s.ts BETWEEN g.t - {ms} AND g.t {extra}),"


#: The instant vector: of each series the last sample of the look-back.
I = S + G + w(BACK) + " i AS (SELECT event_type, usr, t, arg_max(v, ts) AS v FROM w GROUP BY 1, 2, 3)"
#: Of each series and window what an extrapolated increase needs.
X = """ x AS (SELECT event_type, usr, t, count(*) AS n, min(ts) AS ft, max(ts) AS lt, arg_min(v, ts) AS fv, arg_max(v, ts) AS lv,
      sum(CASE WHEN v < pv THEN pv ELSE 0 END) - arg_min(CASE WHEN v < pv THEN pv ELSE 0 END, ts) AS lost FROM w GROUP BY 1, 2, 3 HAVING count(*) >= 2),
    y AS (SELECT *, lv - fv + lost AS d, (lt - ft) / 1000.0 AS sampled, (lt - ft) / 1000.0 / (n - 1) AS gap, (ft - (t - {w})) / 1000.0 AS before, (t - lt) / 1000.0 AS behind FROM x),
    z AS (SELECT *, CASE WHEN d > 0 AND fv >= 0 AND sampled * fv / d < before THEN sampled * fv / d ELSE before END AS b FROM y),
    r AS (SELECT event_type, usr, t, d * (sampled + CASE WHEN b < gap * 1.1 THEN b ELSE gap / 2 END + CASE WHEN behind < gap * 1.1 THEN behind ELSE gap / 2 END) / sampled AS inc FROM z)"""
D1 = DAY

q("promql01_look_back", I + " SELECT event_type, usr AS \"user\", t, round(v, 6) AS v FROM i")(lambda s, f: run(s, f, "events", ["event_type", "user"]))
q("promql02_range_selector", S + G + w(D1) + " i AS (SELECT event_type, usr, t, CAST(count(*) AS DOUBLE) AS v FROM w GROUP BY 1, 2, 3) SELECT event_type, usr AS \"user\", t, v FROM i")(lambda s, f: run(s, f, "count_over_time(events[1d])", ["event_type", "user"]))
q("promql03_subquery", S + f" g AS (SELECT CAST(unnest(range({START - 2 * DAY}, {END + 1}, {STEP})) AS BIGINT) AS t)," + w(BACK) + f" i AS (SELECT event_type, usr, t, arg_max(v, ts) AS v FROM w GROUP BY 1, 2, 3), j AS (SELECT event_type, t AS ts, sum(v) AS v FROM i GROUP BY 1, 2) SELECT event_type, g.t, round(max(v), 6) AS v FROM g JOIN j ON j.ts BETWEEN g.t - {DAY} AND g.t WHERE g.t >= {START} GROUP BY 1, 2")(
    lambda s, f: run(s, f, "max_over_time(sum by (event_type) (events)[1d:6h])", ["event_type"]))
q("promql04_offset", S + f" g AS (SELECT CAST(unnest(range({START}, {END + 1}, {STEP})) AS BIGINT) AS t), w AS (SELECT g.t, s.* FROM g JOIN s ON s.ts BETWEEN g.t - {DAY + BACK} AND g.t - {DAY}), i AS (SELECT event_type, usr, t, arg_max(v, ts) AS v FROM w GROUP BY 1, 2, 3) SELECT event_type, t, round(sum(v), 6) AS v FROM i GROUP BY 1, 2")(
    lambda s, f: run(s, f, "sum by (event_type) (events offset 1d)", ["event_type"]))
q("promql06_aggregates", I + " SELECT event_type, t, round(stddev_pop(v), 6) AS v FROM i GROUP BY 1, 2")(lambda s, f: run(s, f, "stddev by (event_type) (events)", ["event_type"]))
q("promql06_without", I + " SELECT usr AS \"user\", t, round(avg(v), 6) AS v FROM i GROUP BY 1, 2")(lambda s, f: run(s, f, "avg without (event_type) (events)", ["user"]))
q("promql07_count_values", I + " SELECT CAST(CAST(floor(v / 50) AS BIGINT) AS VARCHAR) AS bucket, t, CAST(count(*) AS DOUBLE) AS v FROM i GROUP BY 1, 2")(lambda s, f: run(s, f, 'count_values("bucket", floor(events / 50))', ["bucket"]))
q("promql08_topk", I + " SELECT event_type, usr AS \"user\", t, round(v, 6) AS v FROM (SELECT *, row_number() OVER (PARTITION BY event_type, t ORDER BY v DESC, usr) AS k FROM i) WHERE k <= 3")(lambda s, f: run(s, f, "topk by (event_type) (3, events)", ["event_type", "user"]))
q("promql09_quantile", I + " SELECT event_type, t, round(quantile_cont(v, 0.9), 6) AS v FROM i GROUP BY 1, 2")(lambda s, f: run(s, f, "quantile by (event_type) (0.9, events)", ["event_type"]))
q("promql10_arithmetic", I + " SELECT event_type, t, round(sum(v) * 2 / count(*) - 1, 6) AS v FROM i GROUP BY 1, 2")(lambda s, f: run(s, f, "sum by (event_type) (events) * 2 / count by (event_type) (events) - 1", ["event_type"]))
q("promql11_comparison", I + " SELECT event_type, usr AS \"user\", t, round(v, 6) AS v FROM i WHERE v > 100")(lambda s, f: run(s, f, "events > 100", ["event_type", "user"]))
q("promql12_group_left", I + ", a AS (SELECT event_type, t, sum(v) AS total FROM i GROUP BY 1, 2) SELECT i.event_type, usr AS \"user\", i.t, round(v / total, 6) AS v FROM i JOIN a ON a.event_type = i.event_type AND a.t = i.t")(
    lambda s, f: run(s, f, "events / on (event_type) group_left () sum by (event_type) (events)", ["event_type", "user"]))
q("promql13_set_operators", I + " SELECT event_type, usr AS \"user\", t, round(v, 6) AS v FROM i WHERE event_type = 'click' AND (usr, t) NOT IN (SELECT (usr, t) FROM i WHERE event_type = 'view')")(
    lambda s, f: run(s, f, 'events{event_type="click"} unless on (user) events{event_type="view"}', ["event_type", "user"]))
q("promql14_rate", S + G + w(D1) + X.format(w=D1) + " SELECT event_type, t, round(sum(inc / 86400), 6) AS v FROM r GROUP BY 1, 2")(lambda s, f: run(s, f, "sum by (event_type) (rate(events[1d]))", ["event_type"]))
q("promql14_increase", S + G + w(D1) + X.format(w=D1) + " SELECT event_type, usr AS \"user\", t, round(inc, 6) AS v FROM r")(lambda s, f: run(s, f, "increase(events[1d])", ["event_type", "user"]))
q("promql15_idelta", S + G + w(D1) + f" i AS (SELECT event_type, usr, t, max(ts) AS l, arg_max(v - pv, ts) AS v, arg_max(pt, ts) AS p FROM w GROUP BY 1, 2, 3) SELECT event_type, usr AS \"user\", t, round(v, 6) AS v FROM i WHERE p >= t - {D1}")(
    lambda s, f: run(s, f, "idelta(events[1d])", ["event_type", "user"]))
q("promql16_resets", S + G + w(3 * DAY) + " i AS (SELECT event_type, usr, t, CAST(sum(CASE WHEN v < pv THEN 1 ELSE 0 END) - arg_min(CASE WHEN v < pv THEN 1 ELSE 0 END, ts) AS DOUBLE) AS v FROM w GROUP BY 1, 2, 3) SELECT event_type, usr AS \"user\", t, v FROM i")(
    lambda s, f: run(s, f, "resets(events[3d])", ["event_type", "user"]))
q("promql17_avg_over_time", S + G + w(D1) + " i AS (SELECT event_type, usr, t, avg(v) AS v FROM w GROUP BY 1, 2, 3) SELECT event_type, t, round(max(v), 6) AS v FROM i GROUP BY 1, 2")(lambda s, f: run(s, f, "max by (event_type) (avg_over_time(events[1d]))", ["event_type"]))
q("promql18_quantile_over_time", S + G + w(3 * DAY) + " i AS (SELECT event_type, usr, t, quantile_cont(v, 0.75) AS v FROM w GROUP BY 1, 2, 3) SELECT event_type, usr AS \"user\", t, round(v, 6) AS v FROM i")(lambda s, f: run(s, f, "quantile_over_time(0.75, events[3d])", ["event_type", "user"]))
q("promql19_last_over_time", S + G + w(D1) + " i AS (SELECT event_type, usr, t, arg_max(v, ts) AS v FROM w GROUP BY 1, 2, 3) SELECT event_type, usr AS \"user\", t, round(v, 6) AS v FROM i")(lambda s, f: run(s, f, "last_over_time(events[1d])", ["event_type", "user"]))
q("promql20_predict_linear", S + G + w(3 * DAY) + " i AS (SELECT event_type, usr, t, count(*) AS n, regr_slope(v, (ts - t) / 1000.0) AS m, regr_intercept(v, (ts - t) / 1000.0) AS b FROM w GROUP BY 1, 2, 3) SELECT event_type, usr AS \"user\", t, round(b + m * 3600, 2) AS v FROM i WHERE n >= 2")(
    lambda s, f: run(s, f, "predict_linear(events[3d], 3600)", ["event_type", "user"]).withColumn("v", F.round("v", 2)))
q("promql21_holt_winters")(lambda s, f: run(s, f, "holt_winters(events[3d], 0.5, 0.5)", ["event_type", "user"]))
q("promql23_absent", f"SELECT 'none' AS event_type, CAST(unnest(range({START}, {END + 1}, {STEP})) AS BIGINT) AS t, 1.0::DOUBLE AS v")(lambda s, f: run(s, f, 'absent(events{event_type="none"})', ["event_type"]))
q("promql24_value_functions", I + " SELECT event_type, usr AS \"user\", t, round(sqrt(abs(v - 100)), 6) AS v FROM i")(lambda s, f: run(s, f, "sqrt(abs(events - 100))", ["event_type", "user"]))
q("promql25_clamp", I + " SELECT event_type, usr AS \"user\", t, round(least(greatest(v, 20), 60), 6) AS v FROM i")(lambda s, f: run(s, f, "clamp(events, 20, 60)", ["event_type", "user"]))
q("promql26_logarithm", I + " SELECT event_type, usr AS \"user\", t, round(ln(v + 1), 6) AS v FROM i")(lambda s, f: run(s, f, "ln(events + 1)", ["event_type", "user"]))
q("promql27_dates", f"SELECT t, CAST(extract(hour FROM make_timestamp(t * 1000)) AS DOUBLE) AS v FROM (SELECT CAST(unnest(range({START}, {END + 1}, {STEP})) AS BIGINT) AS t)")(lambda s, f: run(s, f, "hour()", []))
q("promql28_label_replace", I + " SELECT 'u' || left(usr, 1) AS first, t, round(sum(v), 6) AS v FROM i GROUP BY 1, 2")(lambda s, f: run(s, f, 'sum by (first) (label_replace(events, "first", "u$1", "user", "(.).*"))', ["first"]))
q("promql29_timestamp", S + G + w(BACK) + " i AS (SELECT event_type, usr, t, max(ts) / 1000.0 AS v FROM w GROUP BY 1, 2, 3) SELECT event_type, usr AS \"user\", t, round(v, 6) AS v FROM i")(lambda s, f: run(s, f, "timestamp(events)", ["event_type", "user"]))


@q("promql22_histogram_quantile", f"""SELECT event_type, {END} AS t, round(CASE WHEN n * 0.9 <= b1 THEN 50 * n * 0.9 / b1 WHEN n * 0.9 <= b2 THEN 50 + 50 * (n * 0.9 - b1) / (b2 - b1) WHEN n * 0.9 <= b3 THEN 100 + 200 * (n * 0.9 - b2) / (b3 - b2) ELSE 300 END, 6) AS v FROM (
    SELECT event_type, count(*) AS n, count(*) FILTER (value <= 50) AS b1, count(*) FILTER (value <= 100) AS b2, count(*) FILTER (value <= 300) AS b3 FROM events GROUP BY 1)""")  # fmt: skip
def _(spark, folder):
    e = table(spark, folder, "events")
    buckets = F.array(*[F.struct(F.lit(le).alias("le"), F.count_if(F.col("value") <= b).cast("double").alias("c")) for le, b in (("50", 50), ("100", 100), ("300", 300), ("+Inf", 1e18))])
    wide = e.groupBy("event_type").agg(buckets.alias("b")).select("event_type", F.inline("b")).withColumn("t", F.lit(END))
    s = series_of(wide, "h_bucket", ["event_type", "le"], F.col("t"), F.col("c"))
    out = evaluate(s, "histogram_quantile(0.9, h_bucket)", END, END)
    return out.select(F.try_element_at("labels", F.lit("event_type")).alias("event_type"), "t", F.round("v", 6).alias("v"))


def _catalog(spark: SparkSession, folder: str) -> Catalog:
    load = lambda: table(spark, folder, "events").withColumn("user", F.col("user_id").cast("string"))
    ms = lambda: load().withColumn("time", event_ms(F.col("ts")))
    return Catalog([TableMeta("web.events", ms, values=["value"], tags=["event_type", "user"])])


def _request(**more) -> dict:
    return {"query_list": [{"table_id": "web.events", "field_name": "value", "reference_name": "a", "conditions": {"field_list": [{"field_name": "event_type", "op": "ne", "value": ["view"]}], "condition_list": []}, **more}],
            "metric_merge": "a", "start_time": START, "end_time": END, "step": "6h", "timezone": "UTC"}


@q("promql31_structured", S + G + w(D1) + " i AS (SELECT event_type, usr, t, avg(v) AS v FROM w GROUP BY 1, 2, 3) SELECT event_type, t, round(sum(v) * 2, 6) AS v FROM i WHERE event_type <> 'view' GROUP BY 1, 2")
def _(spark, folder):
    raw = _request(time_aggregation={"function": "avg_over_time", "window": "1d"}, function=[{"method": "sum", "dimensions": ["event_type"]}]) | {"metric_merge": "a * 2"}
    out = structured.run_series(_catalog(spark, folder), structured.Request.of(raw))
    return out.select(F.try_element_at("labels", F.lit("event_type")).alias("event_type"), "t", F.round("v", 6).alias("v"))


@q("promql30_reference_query", f"SELECT event_type, (epoch_us(ts) // 1000) // {DAY} * {DAY} AS _time, round(sum(value), 4) AS _value FROM events WHERE event_type <> 'view' AND epoch_us(ts) // 1000 >= {START} AND epoch_us(ts) // 1000 < {END} GROUP BY 1, 2")
def _(spark, folder):
    raw = _request(function=[{"method": "sum", "dimensions": ["event_type"], "window": "1d"}])
    return structured.run_reference(_catalog(spark, folder), structured.Request.of(raw)).withColumn("_value", F.round("_value", 4))


@q("promql30_raw_query", f"SELECT event_id, value FROM events WHERE event_type <> 'view' AND value > 150 AND epoch_us(ts) // 1000 >= {START} AND epoch_us(ts) // 1000 < {END} ORDER BY value DESC, event_id LIMIT 15")
def _(spark, folder):
    raw = _request(query_string="value:>150", keep_columns=["event_id", "value"]) | {"order_by": ["-value", "event_id"], "limit": 15}
    return structured.run_raw(_catalog(spark, folder), structured.Request.of(raw))[0].select("event_id", "value")


@q("promql33_alignment", f"SELECT {align_ms(START + 12345, DAY, 'Asia/Shanghai')}::BIGINT AS a, ({START + 12345} + 28800000) // {DAY} * {DAY} - 28800000 AS b")
def _(spark, folder):
    return spark.range(1).select(F.lit(align_ms(START + 12345, DAY, "Asia/Shanghai")).cast("long").alias("a"), F.lit(align_ms(START + 12345, DAY, "Asia/Shanghai")).cast("long").alias("b"))


@q("promql35_tag_values", "SELECT DISTINCT event_type AS value FROM events")
def _(spark, folder):
    return structured.tag_values(_catalog(spark, folder), "web.events", "event_type", 0, 1 << 60)


@q("promql35_label_values", "SELECT DISTINCT CAST(user_id AS VARCHAR) AS value FROM events WHERE event_type = 'click'")
def _(spark, folder):
    return structured.label_values(series(spark, folder), "user", [("event_type", "=", "click")])


@q("promql36_exemplars", f"SELECT span_name, t AS _time, max(elapsed_time) AS _value, arg_max(trace_id, (elapsed_time, trace_id)) AS exemplar FROM (SELECT *, start_time // {HOUR * 1000} * {HOUR * 1000} AS t FROM complex WHERE start_time IS NOT NULL AND elapsed_time IS NOT NULL AND trace_id <> '') GROUP BY 1, 2")
def _(spark, folder):
    df = table(spark, folder, "complex").where("start_time is not null and elapsed_time is not null")
    return structured.exemplars(df, "start_time", "elapsed_time", "trace_id", HOUR * 1000, ["span_name"])


# The SQL dialect: the same text runs in both engines unless the dialect differs.

TABLES = ("lineitem", "orders", "customer", "supplier", "part", "nation", "region", "events", "net_test_data", "complex", "documents")


def sql(name: str, text: str, oracle: str | None = None, objects: dict[str, str] | None = None) -> None:
    def query(spark: SparkSession, folder: str) -> DataFrame:
        used = {t: table(spark, folder, t) for t in TABLES if t in text}
        return sqldialect.run(spark, text, used, objects)

    q(name, oracle or text)(query)


sql("sql01_cte", "WITH big AS (SELECT o_custkey, o_totalprice FROM orders WHERE o_totalprice > 300000), per AS (SELECT o_custkey, count(*) AS n FROM big GROUP BY o_custkey) SELECT n, count(*) AS customers FROM per GROUP BY n")
sql("sql02_joins", "SELECT c.c_mktsegment, r.r_name, count(*) AS n, round(sum(o.o_totalprice), 2) AS total FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey JOIN nation na ON c.c_nationkey = na.n_nationkey LEFT JOIN region r ON na.n_regionkey = r.r_regionkey GROUP BY c.c_mktsegment, r.r_name")
sql("sql02_full_join", "SELECT coalesce(c.k, s.k) AS k, c.n AS customers, s.n AS suppliers FROM (SELECT c_nationkey AS k, count(*) AS n FROM customer GROUP BY 1) c FULL OUTER JOIN (SELECT s_nationkey AS k, count(*) AS n FROM supplier GROUP BY 1) s ON c.k = s.k")
sql("sql02_right_semi", "SELECT c_custkey FROM orders RIGHT SEMI JOIN customer ON o_custkey = c_custkey", "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)")
sql("sql02_left_anti", "SELECT c_custkey FROM customer LEFT ANTI JOIN orders ON o_custkey = c_custkey", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
sql("sql03_range_join", "SELECT a.n_name AS a, b.r_name AS b FROM nation a JOIN region b ON a.n_nationkey BETWEEN b.r_regionkey * 3 AND b.r_regionkey * 3 + 4")
sql("sql04_subqueries", "SELECT p_partkey FROM part p WHERE p_retailprice > (SELECT avg(p_retailprice) FROM part) AND EXISTS (SELECT 1 FROM lineitem l WHERE l.l_partkey = p.p_partkey AND l.l_quantity > 45) AND p_size IN (SELECT n_nationkey FROM nation)")
sql("sql05_windows", "SELECT o_orderkey, o_custkey, round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 2) AS recent, rank() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS place FROM orders",
    "SELECT o_orderkey, o_custkey, round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 2) AS recent, CAST(rank() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS INT) AS place FROM orders")
sql("sql06_lateral_view", "SELECT rec_id, u FROM net_test_data LATERAL VIEW explode(data.cpu.per_usage) x AS u", "SELECT rec_id, unnest(data.cpu.per_usage) AS u FROM net_test_data")
sql("sql07_table_function", "SELECT id * 2 AS v FROM range(10)", "SELECT CAST(range * 2 AS BIGINT) AS v FROM range(10)")
sql("sql08_values", "SELECT a, b FROM (VALUES (1, 'x'), (2, 'y')) AS t(a, b)")
sql("sql11_predicates", "SELECT p_partkey FROM part WHERE (p_size BETWEEN 10 AND 20 OR p_name LIKE '%bolt') AND p_brand REGEXP '7$' AND p_type IS NOT NULL AND (p_size <=> 15) IS NOT TRUE", "SELECT p_partkey FROM part WHERE (p_size BETWEEN 10 AND 20 OR p_name LIKE '%bolt') AND regexp_matches(p_brand, '7$') AND p_type IS NOT NULL AND p_size IS DISTINCT FROM 15")
sql("sql11_xor_match", "SELECT doc_id FROM documents WHERE text MATCH_PHRASE 'lease lost' AND (n_chars > 700) XOR (lang = 'en')", r"SELECT doc_id FROM documents WHERE regexp_matches(lower(text), '(^|[^a-zA-Z0-9_])lease[^a-zA-Z0-9_]+lost([^a-zA-Z0-9_]|$)') AND ((n_chars > 700) <> (lang = 'en'))")
sql("sql12_arithmetic", "SELECT o_orderkey, o_orderkey % 7 AS m, o_orderkey DIV 10 AS d, (o_orderkey & 12) | 1 AS b, o_orderkey ^ 5 AS x FROM orders", "SELECT o_orderkey, o_orderkey % 7 AS m, o_orderkey // 10 AS d, (o_orderkey & 12) | 1 AS b, xor(o_orderkey, 5) AS x FROM orders")
sql("sql13_case", "SELECT CASE WHEN p_size > 30 THEN 'big' WHEN p_size > 10 THEN 'mid' ELSE 'small' END AS size, count(*) AS n FROM part GROUP BY 1")
sql("sql14_cast", "SELECT s_suppkey, CAST(s_acctbal AS SIGNED) AS whole, CAST(s_suppkey AS TEXT) AS txt FROM supplier", "SELECT s_suppkey, CAST(trunc(s_acctbal) AS BIGINT) AS whole, CAST(s_suppkey AS VARCHAR) AS txt FROM supplier")
sql("sql15_arrays", "SELECT rec_id FROM net_test_data WHERE array_match_any(x -> x > 75, data.cpu.per_usage)".replace("data.cpu.per_usage)", "usage)").replace("FROM net_test_data", "FROM (SELECT rec_id, data.cpu.per_usage AS usage FROM net_test_data)"), "SELECT rec_id FROM net_test_data WHERE len(list_filter(data.cpu.per_usage, lambda x: x > 75)) > 0")
sql("sql16_object_paths", "SELECT span_id, trace_id, attributes.db.system AS db, CAST(attributes.http.status_code AS bigint) AS code FROM complex WHERE attributes.db.system IS NOT NULL", "SELECT span_id, trace_id, attributes['db.system'] AS db, TRY_CAST(attributes['http.status_code'] AS BIGINT) AS code FROM complex WHERE attributes['db.system'] IS NOT NULL", {"attributes": "map", "resource": "map"})
sql("sql17_dates", "SELECT extract(YEAR FROM o_orderdate) AS y, count(*) AS n FROM orders WHERE o_orderdate < TIMESTAMP '2000-01-01 00:00:00' - INTERVAL 1 YEAR GROUP BY 1", "SELECT CAST(extract(YEAR FROM o_orderdate) AS INT) AS y, count(*) AS n FROM orders WHERE o_orderdate < TIMESTAMP '1999-01-01 00:00:00' GROUP BY 1")
sql("sql18_functions", "SELECT p_brand, count(DISTINCT p_type) AS types, group_concat(DISTINCT p_type) IS NULL AS none, max(upper(p_name)) AS top FROM part GROUP BY p_brand", "SELECT p_brand, count(DISTINCT p_type) AS types, false AS none, max(upper(p_name)) AS top FROM part GROUP BY p_brand")
sql("sql19_except", "SELECT * EXCEPT (n_regionkey) FROM nation", "SELECT n_nationkey, n_name FROM nation")
sql("sql22_qualify", "SELECT user_id, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id) = 1", "SELECT user_id, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id) = 1")
sql("sql24_limit_pair", "SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 5, 10", "SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 10 OFFSET 5")
sql("sql17_grouping_sets", "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY GROUPING SETS ((o_orderstatus), (o_orderpriority), ()) HAVING count(*) > 10")
sql("sql17_cube", "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)")


@q("sql23_injected_filter", "SELECT o_custkey, count(*) AS n FROM (SELECT * FROM orders WHERE o_totalprice > 200000) AS orders WHERE o_custkey IN (SELECT o_custkey FROM orders AS x WHERE x.o_totalprice > 200000 AND x.o_orderstatus = 'F') GROUP BY o_custkey")
def _(spark, folder):
    table(spark, folder, "orders").createOrReplaceTempView("orders")
    text = sqldialect.inject("SELECT o_custkey, count(*) AS n FROM orders WHERE o_custkey IN (SELECT o_custkey FROM orders AS x WHERE x.o_orderstatus = 'F') GROUP BY o_custkey", "orders", "o_totalprice > 200000")
    return spark.sql(sqldialect.spark_sql(text))
