"""The other operators on small tables: borders, nulls, ties, empty tables, streams."""

import gzip
import json
import math

import pytest
from pyspark.sql import functions as F

from tidegauge.operators import aggregate, detect, etl, merge, rawrows, telemetry, topology
from tidegauge.operators.merge import Route
from tidegauge.session import scratch
from tidegauge.sources import lines, readers, stores
from tidegauge.streaming import pipelines


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_common_types():
    from pyspark.sql import types as T

    t = merge.common_type
    assert t(T.IntegerType(), T.LongType()) == T.LongType() and t(T.FloatType(), T.IntegerType()) == T.DoubleType()
    assert t(T.DecimalType(10, 2), T.DecimalType(8, 4)) == T.DecimalType(12, 4)
    for a, b in ((T.StringType(), T.IntegerType()), (T.DecimalType(38, 0), T.DecimalType(38, 10)), (T.ArrayType(T.StringType()), T.StringType())):
        with pytest.raises(TypeError):
            t(a, b)


def test_weighted_average_and_routes(spark):
    a = spark.createDataFrame([("x", 0, 10.0), ("x", 60, 20.0)], "k string, t long, v double")
    b = spark.createDataFrame([("x", 60, 40.0), ("x", 120, 50.0)], "k string, t long, v double")
    got = rows(merge.merge_average([(a, Route("a", 0, 75)), (b, Route("b", 75, 200))], ["k"], 60))
    assert got == [("x", 0, 10.0), ("x", 120, 50.0), ("x", 60, (20 * 15 + 40 * 45) / 60)]
    only_outside = rows(merge.merge_average([(a, Route("a", 500, 600))], ["k"], 60))
    assert [r[2] for r in only_outside] == [10.0, 20.0]
    assert merge.merge_function(None, "max_over_time") == "max" and merge.merge_function("topk", None) == "sum"
    cut = merge.segments([Route("a", 0, 100), Route("b", 100, 300)], 50, 250, overlap_ms=10, look_back_ms=20)
    assert [(r.name, r.start, r.end) for r in cut] == [("a", 30, 110), ("b", 100, 250)]
    with pytest.raises(RuntimeError, match="all sources failed"):
        merge.partial({"a": lambda: 1 / 0})


def test_aggregates_at_borders(spark):
    df = spark.createDataFrame([("a", 0, 1.0), ("a", 59, 2.0), ("a", 60, None), ("b", -1, 4.0), (None, 5, 5.0)], "k string, t long, v double")
    assert rows(aggregate.grouped(df, ["k"], "sum", "v", 60, "t")) == sorted([("a", 0, 3.0), ("a", 60, None), ("b", -60, 4.0), (None, 0, 5.0)], key=repr)
    assert rows(aggregate.filled(aggregate.grouped(df.where("k = 'a'"), ["k"], "sum", "v", 60, "t"), ["k"], 0, 181, 60)) == sorted([("a", 0, 3.0), ("a", 60, 0.0), ("a", 120, 0.0), ("a", 180, 0.0)], key=repr)
    assert rows(aggregate.terms(df, ["k"], [2])) == [(" ", 1), ("a", 3)]
    assert rows(aggregate.terms(df, ["k"], [5], missing=None)) == [("a", 3), ("b", 1)]
    assert aggregate.histogram(df.limit(0), "t", 60).count() == 0
    assert rows(aggregate.histogram(df.where("t = 0"), "t", 60, bounds=(0, 130))) == [(0, 1), (120, 0), (60, 0)]


def test_marks_pages_and_curves(spark):
    import re

    import numpy as np

    pats = [re.compile("abc", re.I), re.compile("cde", re.I), re.compile("fg")]
    assert rawrows.mark("xABCDEfgabc", pats, 100) == "x<mark>ABCDEfg</mark><mark>abc</mark>".replace("</mark><mark>", "")
    assert rawrows.mark("abc abc", pats, 4) == "<mark>abc</mark> abc"
    assert rawrows.compose_limits((10, 5), (20, 3)) == (7, 8) and rawrows.compose_limits((10, 5), (20, 30)) == (0, 35) and rawrows.compose_limits((None, 0), (None, 0)) == (10_000, 0)
    t = np.arange(100.0)
    v = np.where(t == 37, 50.0, np.sin(t))
    kept = rawrows.lttb_points(t, v, 10)
    assert len(kept) == 10 and kept[0] == 0 and kept[-1] == 99 and 37 in kept
    df = spark.createDataFrame([(1, "9"), (2, "10"), (3, None), (4, "x")], "id int, s string")
    assert [r.id for r in df.orderBy(*rawrows.ordering(df, ["s", "id"])).collect()] == [1, 2, 4, 3]
    assert [r.id for r in df.orderBy(*rawrows.ordering(df, ["-s"])).collect()][0] in (3, 4)
    nested = spark.createDataFrame([((1, ("x",)),)], "a struct<b:int,c:struct<d:string>>")
    assert rawrows.flattened(nested).columns == ["a.b", "a.c.d"]


def test_cleaning(spark):
    df = spark.createDataFrame([(1, '{"a": 1, "b": "x"}'), (2, "no json"), (3, ""), (4, None), (5, "[1]")], "id int, t string")
    got = {r.id: r for r in etl.json_with_rest(df, "t", ["a"]).collect()}
    assert got[1].a == "1" and json.loads(got[1].ext_json) == {"b": "x"} and got[1].raw is None and not got[1].clean_failed
    assert all(got[i].clean_failed and got[i].a is None for i in (2, 3, 4, 5)) and got[2].raw == "no json"
    s = spark.createDataFrame([("a| b |c|d",), ("a",), (None,)], "t string")
    assert [tuple(r) for r in etl.separated(s, "t", "|", ["x", "y", "z"]).select("x", "y", "z", "clean_failed").collect()] == [("a", "b", "c|d", False), ("a", None, None, True), (None, None, None, True)]
    v = spark.createDataFrame([("1.0",), ("yes",), (" 7 ",), ("x",), (None,)], "t string")
    assert [r[0] for r in v.select(etl.coerce(F.col("t"), "int")).collect()] == [1, None, 7, None, None]
    assert [r[0] for r in v.select(etl.coerce(F.col("t"), "bool")).collect()] == [None, True, None, None, None]
    j = spark.createDataFrame([('{"a": [{"b": 1}, {"b": 2}], "c": "z"}',), ("bad",), (None,)], "t string")
    assert [r[0] for r in j.select(etl.jmes("a[*].b")(F.col("t"))).collect()] == ["[1, 2]", None, None]
    assert [r[0] for r in j.select(etl.jmes("x || a[1].b")(F.col("t"))).collect()][0] == "2" and [r[0] for r in j.select(etl.jmes("a[*].b | length(@)")(F.col("t"))).collect()][0] == "2"
    e = spark.createDataFrame([([], [1]), ([1, 2], [3, 4]), (None, None)], "a array<int>, b array<int>")
    assert rows(etl.fission(e, ["a", "b"])) == sorted([(None, 1), (1, 3), (1, 4), (2, 3), (2, 4), (None, None)], key=repr)
    assert rows(etl.fission(e, ["a", "b"], "zip")) == sorted([(None, 1), (1, 3), (2, 4), (None, None)], key=repr)
    with pytest.raises(Exception, match="without meta"):
        etl.cut_by_meta(spark.createDataFrame([(1,)], "k int"), spark.createDataFrame([(2, "x")], "k int, m string"), ["k"]).collect()


def test_relabel(spark):
    df = spark.createDataFrame([({"__name__": "m", "a": "x1", "b": "y"},), ({"__name__": "m", "a": "z"},), ({"a": "x2"},)], "labels map<string,string>")
    out = etl.relabel(df, [{"source_labels": ["a"], "regex": "x(.*)", "action": "keep"}, {"source_labels": ["a", "b"], "separator": "-", "regex": "x(.*)-(.*)", "target_label": "c", "replacement": "$2/$1"}, {"regex": "b", "action": "labeldrop"}, {"source_labels": ["a"], "modulus": 4, "target_label": "h", "action": "hashmod"}])
    got = [r.labels for r in out.collect()]
    assert len(got) == 1 and got[0]["c"] == "y/1" and "b" not in got[0] and got[0]["h"] in "0123"


def test_triggers_in_any_order(spark):
    rows_ = [("a", t, t in (60, 120, 300, 360, 420)) for t in range(0, 481, 60)]
    out = spark.createDataFrame(rows_[::-1], "k string, at long, anomalous boolean").withColumn("level", F.lit(1))
    got = {r.at: (r.triggered, r.anomalies, r.anomaly_timestamps) for r in detect.trigger(out, ["k"], "at", {1: {"check_window": 3, "count": 2}}).collect()}
    assert {t for t, g in got.items() if g[0]} == {120, 360, 420} and got[420][2] == [300, 360, 420] and got[60] == (False, 1, [60]) and got[0] == (False, 0, [])
    with pytest.raises(ValueError, match="algorithm"):
        detect.level_anomalous(F.col("v"), [{"type": "Other", "config": []}])
    with pytest.raises(ValueError, match="method"):
        detect.threshold(F.col("v"), [{"method": "near", "threshold": 1}])
    written = spark.createDataFrame([(1, 5, "a"), (1, 6, "b"), (2, 1, "c")], "k int, seq int, v string")
    assert rows(detect.last_written(written, ["k"], F.col("seq")).select("k", "v")) == [(1, "b"), (2, "c")]


def spans_of(spark):
    r = lambda s: {"service.name": s, "bk.instance.id": s + "-0", "net.host.ip": "10.0.0.1"}
    raw = [
        ("t", "a1", "", 2, 0, 100, 0, r("web"), {"http.method": "GET"}), ("t", "a2", "a1", 3, 10, 90, 0, r("web"), {}), ("t", "a3", "A2", 2, 20, 80, 2, r("shop"), {}),
        ("t", "a4", "a3", 3, 30, 40, 0, r("shop"), {"db.system": "redis"}), ("t", "a4", "a3", 3, 30, 40, 0, r("shop"), {"db.system": "redis"}), ("u", "b1", "gone", 5, 0, 10, 0, r("bus"), {"messaging.system": "kafka"}),
    ]
    df = spark.createDataFrame([(*x[:4], "op", *x[4:6], x[6], x[7], x[8]) for x in raw], "trace_id string, span_id string, parent_span_id string, kind int, span_name string, start_time long, end_time long, code int, resource map<string,string>, attributes map<string,string>")
    return df.withColumn("status", F.struct("code", F.lit("").alias("message")))


def test_traces(spark):
    df = spans_of(spark)
    info = {r.trace_id: r for r in topology.trace_info(df).collect()}
    t = info["t"]
    assert (t.hierarchy_count, t.service_count, t.span_count, t.error_count, t.root_span_id, t.root_service, t.trace_duration) == (4, 2, 4, 1, "a1", "web", 100)
    assert (t.category_http, t.category_db, t.kind_sync) == (1, 1, 4) and info["u"].category_async_backend == 1 and info["u"].root_service == "bus"
    assert rows(topology.call_pairs(df).select("caller", "callee", "from_service", "to_service", "error")) == [("a2", "a3", "web", "shop", True)]
    assert rows(topology.alone_spans(df).select("span_id", "why")) == [("a1", "no_caller"), ("a4", "no_callee"), ("b1", "no_caller")]
    assert len(rows(topology.ancestor_pairs(df))) == 6
    assert rows(topology.component_flows(df).select("from_service", "to_component")) == [("shop", "redis")]
    assert topology.trace_info(df.limit(0)).count() == 0
    m = topology.membership(df, "trace_id", 1000)
    assert topology.maybe_members(df, "trace_id", m).count() == df.count()
    assert topology.maybe_members(df.withColumn("trace_id", F.concat("trace_id", F.lit("x"))), "trace_id", m).count() <= 2


def test_samplers(spark):
    ids = [f"{i * 2654435761 % 2**32:08x}" + "0" * 24 for i in range(2000)]
    df = spark.createDataFrame([(i, 2 if k % 500 == 0 else 0, {"sampling.priority": "0"} if k % 7 == 0 else {}) for k, i in enumerate(ids)], "trace_id string, code int, attributes map<string,string>").withColumn("status", F.struct("code"))
    kept = telemetry.sampled_random(df, 25).collect()
    assert sum(r.code == 2 for r in kept) == 4 and not any(r.attributes and r.code != 2 for r in kept)
    assert 0.15 < len(kept) / 2000 < 0.30 and rows(telemetry.sampled_random(df, 25).select("trace_id")) == sorted((r.trace_id,) for r in kept)
    # Fixed values of the hash, worked out by hand with the public algorithm.
    import numpy as np

    def murmur(key, seed):
        h = seed
        for i in range(0, len(key) // 4 * 4, 4):
            k = int.from_bytes(key[i : i + 4], "little") * 0xCC9E2D51 & 0xFFFFFFFF
            k = (k << 15 | k >> 17) & 0xFFFFFFFF
            h ^= k * 0x1B873593 & 0xFFFFFFFF
            h = ((h << 13 | h >> 19) & 0xFFFFFFFF) * 5 + 0xE6546B64 & 0xFFFFFFFF
        if tail := key[len(key) // 4 * 4 :]:
            k = int.from_bytes(tail, "little") * 0xCC9E2D51 & 0xFFFFFFFF
            h ^= (k << 15 | k >> 17) % 2**32 * 0x1B873593 & 0xFFFFFFFF
        h ^= len(key)
        h = (h ^ h >> 16) * 0x85EBCA6B & 0xFFFFFFFF
        h = (h ^ h >> 13) * 0xC2B2AE35 & 0xFFFFFFFF
        return h ^ h >> 16

    some = [*ids[:20], "abcdef", "00", ""]
    got = [r[0] for r in spark.createDataFrame([(i,) for i in some], "i string").coalesce(1).select(telemetry.trace_bucket(F.col("i"))).collect()]
    assert got == [murmur(bytes.fromhex(i), 12345) & 0x3FFF for i in some] and np.std(got) > 0


def test_points_lines_and_profiles(spark):
    h = spark.createDataFrame([("m", {"a": "b"}, 1, 5.0, None, 3.0, 3, [1.0, 2.0], [1, 1, 1])], "metric string, labels map<string,string>, t long, sum double, min double, max double, count long, bounds array<double>, counts array<long>")
    got = {(r.metric, r.labels.get("le")): r.v for r in telemetry.histogram_rows(h).collect()}
    assert got == {("m_sum", None): 5.0, ("m_count", None): 3.0, ("m_max", None): 3.0, ("m_bucket", "1.0"): 1.0, ("m_bucket", "2.0"): 2.0, ("m_bucket", "+Inf"): 3.0}
    text = spark.createDataFrame([("# HELP x",), ('x{a="b,\\"c\\"",d="e"} 1.5 1000',), ("y NaN",), ("z +Inf",), ("bad line here x",), ("",)], "value string")
    got = {r.metric: (r.labels, r.v, r.t) for r in telemetry.exposition_rows(text).collect()}
    assert got["x"] == ({"a": 'b,"c"', "d": "e"}, 1.5, 1000) and math.isnan(got["y"][1]) and got["z"][1] == math.inf and len(got) == 3
    influx = spark.createDataFrame([(r'cpu\ x,host=a\,b,r=c u=1i,s="q, w",v=2.5 17',), ("m f=1",), ("broken",)], "value string")
    got = {r.measurement: r for r in lines.influx_lines(influx).collect()}
    assert got["cpu x"].tags == {"host": "a,b", "r": "c"} and got["cpu x"].fields == {"u": "1", "s": "q, w", "v": "2.5"} and got["cpu x"].time_ns == 17 and got["m"].time_ns is None and len(got) == 2

    def field(n, body):
        return bytes([n << 3 | 2, len(body)]) + body

    profile = b"".join(field(6, s) for s in (b"", b"main", b"work")) + field(2, field(1, bytes([1, 2])) + field(2, bytes([7]))) + field(4, bytes([8, 1]) + field(4, bytes([8, 1]))) + field(4, bytes([8, 2]) + field(4, bytes([8, 2]))) + field(5, bytes([8, 1, 16, 2])) + field(5, bytes([8, 2, 16, 1]))
    assert telemetry.profile_samples(gzip.compress(profile)) == [(["work", "main"], [7])]
    df = spark.createDataFrame([(1, bytearray(profile))], "id int, value binary")
    assert rows(telemetry.profile_rows(df)) == [(1, ["work", "main"], [7])]


def test_store_and_polled_source(spark, tmp_path):
    s = stores.Store(spark, str(tmp_path / "store"))
    assert s.table().count() == 0
    s.put(spark.createDataFrame([("a", "1", None), ("b", "2", 10), ("a", "0", None)], "key string, value string, expires long"))
    s.put(spark.createDataFrame([("c", "3", None)], "key string, value string, expires long"), now=5)
    assert rows(s.table(now=20).select("key", "value")) == [("a", "1"), ("c", "3")] and rows(s.scan("b").select("value")) == [("2",)]
    s.delete(spark.createDataFrame([("a",)], "key string"))
    assert rows(s.table().select("key")) == [("b",), ("c",)]
    pages = {1: {"data": {"list": [{"x": 1}]}}, 2: {"data": {"list": [{"x": 2}, {"x": 3}]}}}
    reader = lines._PolledReader({"url": "http://h/{page}/{size}", "pages": "2", "events": "data.list"}, lambda url: pages[int(url.split("/")[3])])
    assert [json.loads(e)["x"] for p in reader.partitions() for _, e in reader.read(p)] == [1, 2, 3]
    assert lines.dig({"a": [{"b": 5}]}, "$.a.0.b") == 5 and lines.dig({}, "a.b") is None


def run_stream(spark, out, mode="append"):
    path = scratch(spark, "stream-test")
    got = []
    sink = readers.bulk_sink(lambda df, _id: got.extend(tuple(r) for r in df.collect()))
    pipelines.start(out, sink, f"{path}/checkpoint", mode).awaitTermination()
    return sorted(got, key=repr)


def test_streams(spark, tmp_path):
    path = str(tmp_path / "in")
    data = [("p", 0, False), ("p", 10, True), ("p", 700, True), ("p", 800, False), ("q", 5, True)]
    spark.createDataFrame(data, "pod string, at long, del boolean").coalesce(1).write.parquet(path)
    stream = spark.readStream.schema("pod string, at long, del boolean").parquet(path)
    assert run_stream(spark, pipelines.terminating_pods(stream, "pod", "at", "del")) == [("p", 10, "terminating"), ("p", 700, "stuck"), ("p", 800, "recovered"), ("q", 5, "terminating")]
    timed = stream.withColumn("ts", F.timestamp_seconds("at"))
    assert run_stream(spark, pipelines.sessions(timed, "ts", "pod", "100 seconds", "1 hour").select("pod", "n"), "complete") == [("p", 2), ("p", 2), ("q", 1)]
    assert len(run_stream(spark, pipelines.deduplicated(timed, "ts", ["pod"], "1 hour"))) == 2


def test_first_deliveries_over_micro_batches(spark, tmp_path):
    from tidegauge.operators.dedup import IdentifierIndex, message_key

    path = str(tmp_path / "in")
    for k in range(3):
        spark.createDataFrame([(k * 10 + i, i % 4 + k, k * 100 + i) for i in range(8)] + [(k * 10 + 9, None, 0)], "rec_id long, msg int, at long").coalesce(1).write.mode("append").parquet(path)
    stream = spark.readStream.schema("rec_id long, msg int, at long").option("maxFilesPerTrigger", 1).parquet(path)
    got = []
    index = IdentifierIndex(spark, 100)
    each = pipelines.deduplicating_batches(index, message_key(F.col("msg")), "at", "rec_id", lambda df, _id: got.extend(r.msg for r in df.collect()), compact_every=2)
    stream = stream.withColumn("at", F.timestamp_seconds("at").cast("timestamp_ntz"))
    pipelines.start(stream, each, str(tmp_path / "checkpoint")).awaitTermination()
    assert sorted(x for x in got if x is not None) == [0, 1, 2, 3, 4, 5] and got.count(None) == 3


def test_graph_of_processors():
    done = pipelines.pipeline({"b": lambda a: a + 1, "c": lambda a, b: a * b}, {"b": ["a"], "c": ["a", "b"]}, {"a": 2})
    assert done["c"] == 6
    with pytest.raises(ValueError, match="circle"):
        pipelines.pipeline({"x": lambda y: y, "y": lambda x: x}, {"x": ["y"], "y": ["x"]}, {})
    assert topology.resource_paths([("a", "b"), ("b", "c"), ("a", "c")], "a", "c") == [["a", "c"], ["a", "b", "c"]]


def test_stream_triggers_of_all_records_and_across_buckets(spark, tmp_path):
    kept = [(k, t, i, (t * 7 + i) % 3 == 0) for k in ("a", "b") for i, t in enumerate([0, 0, 5, 99, 100, 101, 101, 199, 200, 350, 399, 400])]
    rows_ = [*kept, ("a", 101, 99, True), ("a", 101, 99, True)]  # the last one is delivered twice
    schema = "k string, at long, id long, anomalous boolean"
    spark.createDataFrame(rows_, schema).write.parquet(f"{tmp_path}/in")
    once = {r[:3]: r for r in rows_}.values()
    want = []
    for k, t, _, a in once:
        n = sum(x[3] for x in once if x[0] == k and t - 99 <= x[1] <= t)
        want.append((k, t, bool(a and n >= 2), n))
    for name, spread in (("one", None), ("spread", 100), ("narrow", 1)):
        s = spark.readStream.schema(schema).parquet(f"{tmp_path}/in")
        out = pipelines.triggers(s, "k", "at", {"check_window": 100, "count": 2}, 1, "id", spread)
        pipelines.start(out, f"{tmp_path}/{name}", f"{tmp_path}/{name}_state").awaitTermination()
        assert rows(spark.read.parquet(f"{tmp_path}/{name}")) == sorted(want, key=repr)


def test_json_rest_of_all_texts(spark, tmp_path):
    from tidegauge.queries import records

    long = "x } {\n" * 200
    texts = [
        json.dumps({"ts": 1, "a": long}), json.dumps({"a": {"b": long}}, indent=2) + "\n\n", json.dumps({"a": long}) + " tail\nof text", json.dumps({"a": long}) + "\n" + json.dumps({"b": 1}),
        '{"a":"} {"}', '{"a":"\\"} {"}', '{"a":1} x', '{"a":1},{"b":2}', '{"a":1},"b":2', '{"a":1}]', '{"a":1}}', '{"a":1}] [', '{"a":1}} {', '{"a":1} "x"', '{"a":1,}', "{", "{}", "[{}]", "", long, None,
    ]

    def is_object(t):
        try:
            return isinstance(json.loads(t), dict)
        except (TypeError, ValueError):
            return False

    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r.is_json for r in records.registry.queries["e02_json_rest_all"](spark, str(tmp_path)).collect()}
    assert got == {i: is_object(t) for i, t in enumerate(texts)} and sum(got.values()) == 5
    first = etl.json_with_rest(df, "text", ["ts"]).where("doc_id = 0").first()
    assert first.ts == "1" and json.loads(first.ext_json) == {"a": long} and first.raw is None


def test_series_queries_take_both_halves(spark, tmp_path):
    from tidegauge.queries import storage

    rows_ = [(i, i % 2, "a" if i % 2 else "b", float(i)) for i in range(8)]  # each kind has users of one half alone
    df = spark.createDataFrame(rows_, "event_id long, user_id long, event_type string, value double")
    df.withColumn("ts", F.lit("2024-01-07 00:00:00").cast("timestamp_ntz")).write.parquet(f"{tmp_path}/events.parquet")
    for name in ("m18_series_limits_all", "m19_order_series_all", "m21_lttb_all", "m22_realign_all"):
        assert {r.event_type for r in storage.registry.queries[name](spark, str(tmp_path)).collect()} == {"a", "b"}, name
