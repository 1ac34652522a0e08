"""Conditions, query strings, the SQL dialect and structured queries."""

import pytest
from pyspark.sql import functions as F

from tidegauge.catalog import Catalog, TableMeta
from tidegauge.functions import timeutil
from tidegauge.operators.conditions import Condition, as_matcher, compile_dnf, dnf, dnf_and, factored, like_pattern, phrase
from tidegauge.plans import lucene, sqldialect, structured


@pytest.fixture(scope="module")
def logs(spark):
    rows = [
        (1, "Error: disk full on node-1", "error", 5, ["a", "b"], {"k.x": "1"}),
        (2, "disk is fine", "info", 10, [], {"k.x": "2"}),
        (3, None, None, None, None, None),
        (4, "DISK FULL again; node-2", "ERROR", 20, ["c"], {}),
        (5, "100% done_ok", "info", 7, ["b"], {"k.x": "1"}),
    ]
    return spark.createDataFrame(rows, "id int, log string, level string, n int, tags array<string>, m map<string,string>")


def ids(df, column):
    return sorted(r.id for r in df.where(column).collect())


def test_dnf():
    a, b, c = (Condition(x, "eq", [1]) for x in "abc")
    assert dnf([a, b, c], ["and", "or"]) == [[a, b], [c]]
    assert dnf([a, Condition("x", "eq", []), c], ["or", "and"]) == [[a], [c]]
    assert dnf([Condition("x", "existed")], []) == [[Condition("x", "existed")]]
    with pytest.raises(ValueError, match="connectors"):
        dnf([a, b], [])
    assert dnf_and([[a], [b]], [[c]]) == [[a, c], [b, c]] and dnf_and([], [[c]]) == [[c]]
    assert factored([[a, b], [a, c]]) == ([a], [[b], [c]])
    with pytest.raises(ValueError, match="operator"):
        Condition.of({"field_name": "x", "op": "nope"})


@pytest.mark.parametrize(
    ("condition", "want"),
    [
        (Condition("level", "eq", ["error", "info"]), [1, 2, 5]), (Condition("level", "ne", ["info"]), [1, 4]), (Condition("log", "contains", ["disk", "done"]), [1, 2, 5]),
        (Condition("log", "ncontains", ["disk"]), [4, 5]), (Condition("level", "existed"), [1, 2, 4, 5]), (Condition("level", "nexisted"), [3]), (Condition("n", "gte", [10]), [2, 4]),
        (Condition("log", "req", ["^disk", "full$"]), [2]), (Condition("log", "nreq", ["[dD]isk"]), [4, 5]), (Condition("log", "eq", ["*full?on*"], wildcard=True), [1]),
        (Condition("log", "eq", ["100% d"], prefix=True), [5]), (Condition("log", "eq", ["done_ok"], suffix=True), [5]), (Condition("tags", "eq", ["b"]), [1, 5]), (Condition("tags", "existed"), [1, 4, 5]),
        (Condition("m.k.x", "eq", ["1"]), [1, 5]), (Condition("nothing", "eq", ["1"]), []), (Condition("nothing", "nexisted"), [1, 2, 3, 4, 5]), (Condition("LEVEL", "eq", ["info"]), [2, 5]),
    ],
)
def test_conditions(logs, condition, want):
    assert ids(logs, compile_dnf(logs, [[condition]])) == want


def test_null_semantics_and_empty(logs):
    c = [[Condition("level", "ne", ["info"])]]
    assert ids(logs, compile_dnf(logs, c, "search")) == [1, 3, 4]
    assert ids(logs, compile_dnf(logs, [[Condition("level", "eq", [""])]], null_as_empty=True)) == [3]
    assert ids(logs, compile_dnf(logs, [])) == [1, 2, 3, 4, 5]
    with pytest.raises(ValueError, match="one value"):
        compile_dnf(logs, [[Condition("n", "gt", [1, 2])]])
    assert like_pattern("a*b?c%", wildcard=True) == "a%b_c\\%" and like_pattern(r"a\*b", wildcard=True) == "a*b"
    assert as_matcher(Condition("a", "ne", ["x", "y.z"])) == ("a", "!~", r"^(x|y\.z)$")
    assert ids(logs, phrase(F.col("log"), "disk full")) == [1, 4] and ids(logs, phrase(F.col("log"), "disk fu")) == [] and ids(logs, phrase(F.col("log"), "disk fu", prefix=True)) == [1, 4]


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("disk", [1, 2, 4]), ('"disk full"', [1, 4]), ("disk AND full", [1, 4]), ("disk full", [1, 2, 4]), ("+disk -full", [2]), ("NOT disk", [3, 5]), ("level:error OR n:>=20", [1, 4]),
        ("n:[5 TO 7]", [1, 5]), ("n:{5 TO 10]", [2, 5]), ("n:<7", [1]), ("level:(info OR ERROR)", [2, 4, 5]), ("level:e*", [1]), ("log:/no?de-[12]$/", [1, 4]), ("_exists_:level", [1, 2, 4, 5]), ("-_exists_:level", [3]), ('level:""', [1, 2, 4, 5]),
        ("tags:b", [1, 5]), ("m.k.x:2", [2]), ("*", [1, 2, 3, 4, 5]), ("", [1, 2, 3, 4, 5]), ("'disk full' and", [1, 4]), ("(disk OR done_ok) AND NOT level:ERROR", [1, 2, 5]), ("disk -full", [2, 3, 5]), ("full OR NOT disk", [1, 3, 4, 5]), ("disk~1 AND full^2", [1, 4]), ("*:*done*", [5]), ("level:in?o", [2, 5]), (r"log:node\-1", [1]),
    ],
)
def test_query_strings(logs, text, want):
    assert ids(logs, lucene.compile_query(logs, text)) == want


def test_bad_query_strings_and_bodies():
    for bad in ("(a", "a)", "a:[1 TO", 'x:"open'):
        with pytest.raises(lucene.LuceneError):
            lucene.parse(bad)
    assert lucene.to_search("a:1 OR NOT b:[2 TO 3}") == {"bool": {"should": [{"match_phrase": {"a": {"query": "1"}}}, {"bool": {"must_not": [{"range": {"b": {"gte": "2", "lt": "3"}}}]}}]}}


def test_dialect(spark, logs):
    run = lambda text, **kw: sorted(tuple(r) for r in sqldialect.run(spark, text, {"logs": logs}, **kw).collect())
    assert run("SELECT id FROM logs WHERE log MATCH_PHRASE 'disk full' ORDER BY id LIMIT 1, 5") == [(4,)]
    assert run("SELECT id FROM logs WHERE log MATCH_ANY 'fine done'") == [(2,)] and run("SELECT id FROM logs WHERE log MATCH_ALL 'node disk'") == [(1,), (4,)]
    assert run("SELECT id FROM logs QUALIFY row_number() OVER (PARTITION BY level ORDER BY id) = 1") == [(1,), (2,), (3,), (4,)]
    assert run("SELECT id, n * 2 AS d FROM logs QUALIFY d > 20") == [(4, 40)]
    assert run("SELECT id FROM logs WHERE array_match_any(x -> x = 'b', tags)") == [(1,), (5,)]
    assert run("SELECT m.k.x AS v FROM logs WHERE id = 2", objects={"m": "map"}) == [("2",)]
    assert run("SELECT CAST(j.attributes.exception.type AS string) AS v FROM (SELECT parse_json('{\"attributes\": {\"exception.type\": \"E\"}}') AS j)", objects={"j": "variant"}) == [("E",)]
    assert run("SELECT id FROM logs WHERE (n > 6) XOR (level = 'info')") == [(4,)]
    assert run("SELECT id FROM logs", most=2).__len__() == 2
    assert sqldialect.clamp_limit("SELECT 1 LIMIT 5 OFFSET 2", 3) == "SELECT 1 LIMIT 3 OFFSET 2"
    with pytest.raises(PermissionError):
        sqldialect.run(spark, "DROP TABLE logs")
    assert "WHERE id > 1) AS x" in sqldialect.inject("SELECT * FROM logs AS x JOIN other ON 1 = 1", "logs", "id > 1")


def test_times():
    assert timeutil.duration_ms("1h30m") == 5_400_000 and timeutil.duration_ms("-5m") == -300_000
    with pytest.raises(ValueError, match="duration"):
        timeutil.duration_ms("5")
    assert timeutil.request_time_ms("1700000000") == timeutil.request_time_ms(1700000000000) == timeutil.request_time_ms("1700000000000000") == timeutil.request_time_ms("2023-11-14 22:13:20") == 1700000000000
    assert timeutil.align_ms(1700000000000, 86_400_000, "Asia/Shanghai") == 1699977600000
    assert timeutil.days_between(1700000000000, 1700086400000) == ["20231114", "20231115"]


def test_structured_and_back(spark):
    rows = [(t * 60_000, h, float(t)) for t in range(10) for h in ("x", "y")]
    df = spark.createDataFrame(rows, "time long, host string, usage double")
    catalog = Catalog([TableMeta("sys.cpu", lambda: df, values=["usage"], tags=["host"])])
    raw = {"query_list": [{"table_id": "sys.cpu", "field_name": "usage", "reference_name": "a", "function": [{"method": "mean", "dimensions": ["host"]}], "time_aggregation": {"function": "max_over_time", "window": "2m"},
        "conditions": {"field_list": [{"field_name": "host", "op": "eq", "value": ["x"]}], "condition_list": []}}], "metric_merge": "a + 1", "start_time": "300", "end_time": "420", "step": "1m"}
    request = structured.Request.of({**raw, "start_time": 1_000_000_000_300, "end_time": 1_000_000_000_420})
    assert structured.to_promql(request) == 'avg by (host) (max_over_time(sys_cpu_usage{host="x"}[2m])) + 1'
    request.start, request.end = 300_000, 420_000
    got = sorted((r.labels["host"], r.t, r.v) for r in structured.run_series(catalog, request).collect())
    assert got == [("x", 300_000, 6.0), ("x", 360_000, 7.0), ("x", 420_000, 8.0)]
    back = structured.from_promql('sum(rate(a{b="c"}[5m])) / d')
    assert [e["field_name"] for e in back["query_list"]] == ["a", "d"] and back["metric_merge"] == "sum (rate(a[5m])) / b"
    assert structured.field_keys(catalog, "sys.cpu") == ["usage"] and structured.tag_keys(catalog, "sys.cpu") == ["host"]
    assert [r.value for r in structured.tag_values(catalog, "sys.cpu", "host", 0, 10**9).collect()] == ["x", "y"]
    with pytest.raises(KeyError):
        catalog["none"]


INJECTED = [
    ("SELECT * FROM customer, orders", 1), ("SELECT * FROM orders, customer AS o", 1), ("SELECT * FROM db.orders", 1), ("SELECT * FROM `db`.`orders` o", 1), ("SELECT * FROM (orders)", 1),
    ("SELECT * FROM (customer JOIN orders ON a = b) WHERE x IN (SELECT y FROM orders)", 2), ("SELECT 'from orders ' AS orders, 1 -- from orders", 0), ("SELECT orders.x FROM customer orders", 0),
    ("WITH orders AS (SELECT * FROM orders WHERE a = 1) SELECT * FROM orders", 1), ("WITH a AS (SELECT 1), b AS (SELECT * FROM orders) SELECT * FROM a, b, orders", 2),
    ("SELECT extract(YEAR FROM orders) FROM t", 0), ("SELECT a IS DISTINCT FROM orders FROM t", 0), ("SELECT f(a, orders) FROM t GROUP BY x, orders", 0), ("TABLE orders", 1), ("FROM orders SELECT x", 1),
    ("SELECT * FROM t LATERAL VIEW explode(orders) x AS orders", 0), ("SELECT * FROM orders UNION ALL SELECT * FROM /* c */ orders ORDER BY x, orders", 2), ("SELECT * FROM orders(3)", 0),
    ("SELECT * FROM t WHERE EXISTS (SELECT 1 FROM (SELECT * FROM x, ORDERS) y)", 1), ("SELECT * FROM a JOIN b ON a.x = b.x, orders", 1),
]


@pytest.mark.parametrize(("text", "times"), INJECTED)
def test_every_use_of_a_table_is_filtered(text, times):
    assert sqldialect.inject(text, "orders", "tenant = 1").count("WHERE tenant = 1)") == times


def test_other_tenants_rows_stay_out(spark):
    orders = spark.createDataFrame([(1, 1), (2, 2), (3, 1)], "id int, tenant int")
    other = spark.createDataFrame([(1,), (2,)], "k int")
    seen = lambda text: sorted(r[0] for r in sqldialect.run(spark, text, {"orders": orders, "other": other}, filters={"orders": "tenant = 1"}).collect())
    assert seen("SELECT id FROM other, orders WHERE k = 1") == [1, 3]
    assert seen("SELECT id FROM (orders)") == [1, 3]
    assert seen("WITH orders AS (SELECT id, id AS x FROM orders) SELECT x FROM orders") == [1, 3]
    assert seen("SELECT orders.id FROM orders JOIN other ON orders.id = k") == [1]
    assert seen("SELECT count(*) FROM orders WHERE 'from orders ' = 'from orders '") == [2]
    assert sqldialect.run(spark, "SELECT id FROM orders LIMIT 1000000 -- x", {"orders": orders}, most=2).count() == 2



def test_literals_are_left_alone():
    assert sqldialect.spark_sql("SELECT 'a XOR b' AS t") == "SELECT 'a XOR b' AS t"
    assert sqldialect.spark_sql("SELECT 'limit 1, 2' LIMIT 3, 4") == "SELECT 'limit 1, 2' LIMIT 4 OFFSET 3"
    assert sqldialect.clamp_limit("SELECT 1 LIMIT 1000000 -- x", 5) == "SELECT 1 LIMIT 5"


def test_nothing_is_cut_unless_asked(spark):
    from tidegauge.operators import rawrows

    df = spark.range(12_000).select(F.col("id").alias("v"), F.concat(F.lit("t"), F.col("id")).alias("tag"))
    assert rawrows.compose_limits((None, 0), (None, 0), None) == (None, 0)
    marked = rawrows.highlight(spark.createDataFrame([("x" * 2_000_000 + "hotbolt hot", 1)], "t string, k int"), ["t"], ["hot", "bolt"]).first()["__highlight"]["t"]
    assert marked.endswith("<mark>hotbolt</mark> <mark>hot</mark>")
    both = rawrows.highlight(spark.createDataFrame([("abcdx", 1), ("zz", 2)], "t string, k int"), ["t"], ["abc", "bcd"])
    assert [r["__highlight"] for r in both.orderBy("k").collect()] == [{"t": "<mark>abcd</mark>x"}, {}]
    from tidegauge.operators import etl

    found = etl.discovered(df.select(F.create_map(F.lit("m"), F.lit(1.0)).alias("m"), F.create_map(F.lit("tag"), F.col("tag")).alias("d")), "m", "d").first()
    assert found.n_values == 12_000 == len(found["values"])
    ranked = rawrows.order_series(df.select("tag", "v", F.lit(1).alias("t")), ["tag"], ["-_value"])
    assert ranked.where("rank != 12000 - v").count() == 0
