"""Host reports, payloads, built SQL, batches, scrolls, buckets: what the test tables don't hold, and what must not break."""

import random

import pytest
from pyspark.sql import functions as F

from tidegauge.operators import conditions, dedup, etl, hostreports, latedata, payloads, rawrows, telemetry, topology
from tidegauge.operators.conditions import Condition
from tidegauge.plans import batch, sqlbuild, structured
from tidegauge.session import release, scratch, shared_dir


def test_reports_of_disks_inodes_states_and_ports(spark):
    row = """{"ip": "1.2.3.4", "bizid": 2, "data": {"utctime": "2021-03-04 05:06:07", "disk": {"usage": [{"device": "sda1", "fstype": "ext4", "mountpoint": "/", "free": 25, "total": 100, "used": 75, "inodesFree": 1, "inodesTotal": 4, "inodesUsed": 3}],
        "diskstat": [{"name": "sda", "util": 0.5, "speedIORead": 3}]}, "net": {"netstat": {"established": 7, "listen": null}}, "env": {"maxfiles": 10, "uname": "linux"}, "cpu": {"per_stat": [{"cpu": "cpu0", "user": 1.5, "irq": 2}]},
        "processes": [{"name": "nginx", "exists": 1, "porthealth": 0, "protocol": "tcp", "bindip": "0.0.0.0"}]}}"""
    df = spark.read.json(spark.createDataFrame([(row,)], "value string").rdd.map(lambda r: r.value))
    of = lambda name: [(r.time, r.dimensions, r.metrics) for r in hostreports.host_rows(df, name).collect()]
    (time, dims, metrics), = of("disk")
    assert time == 1614834367 and dims["device_name"] == "sda1" and dims["bk_target_ip"] == "1.2.3.4" and metrics == {"free": 25.0, "total": 100.0, "used": 75.0, "in_use": 75.0}
    assert of("inode")[0][2] == {"free": 1.0, "total": 4.0, "used": 3.0, "in_use": 75.0}
    assert of("io")[0][2] == {"util": 0.5, "r_s": 3.0} and of("netstat")[0][2] == {"cur_tcp_estab": 7.0}
    assert of("env")[0][1]["uname"] == "linux" and of("cpu_detail")[0][2] == {"user": 1.5, "interrupt": 2.0}
    assert of("proc_port")[0][2] == {"proc_exists": 1.0, "port_health": 0.0} and of("mem") == [] == of("swap")
    assert hostreports.host_rows(df.limit(0), "disk").count() == 0


def test_payloads_that_are_none(spark):
    junk = spark.createDataFrame([(None,), ("",), ("[]",), ("{}",), ("no json",), ('[{"traceId": null}]',)], "value string")
    for parse in (payloads.spans_of_zipkin, payloads.spans_of_jaeger, payloads.remote_write_rows, payloads.log_records, payloads.beat_rows):
        assert parse(junk).count() == 0
    lines = spark.createDataFrame([(1, ["a", "", "b"], {"k": "v"})], "id int, lines array<string>, labels map<string,string>")
    assert [(r.place, r.line) for r in payloads.pushed_logs(lines, "lines", "labels").collect()] == [(0, "a"), (2, "b")]
    tree = spark.createDataFrame([(1, '{"a": {"buckets": [{"key": "x", "doc_count": 2, "b": {"buckets": []}}, {"key": "y", "doc_count": 1, "b": {"buckets": [{"key": 5, "doc_count": 1}]}}]}}'), (2, None)], "id int, tree string")
    assert [tuple(r) for r in payloads.flat_series(tree, "tree", ["a", "b"], ["id"]).collect()] == [(1, "y", "5", 1, None)]


def test_token_bucket_against_brute_force(spark):
    rng = random.Random(1)
    rows = [(rng.choice(["a", "b", None]), rng.randrange(0, 60_000), i) for i in range(400)] + [("a", None, 999)]
    df = spark.createDataFrame(rows, "k string, at long, id long").withColumn("_x", F.lit("extra"))
    want = set()
    for key in ("a", "b", None):
        tokens, seen = 3.0, None
        for _, at, i in sorted((r for r in rows if r[0] == key and r[1] is not None), key=lambda r: (r[1], r[2])):
            tokens = min(3.0, tokens + ((at - seen) / 1000 * 0.5 if seen is not None else 0))
            seen = at
            if tokens >= 1:
                want.add(i)
                tokens -= 1
    assert {r.id for r in telemetry.token_bucket(df, "k", "at", 0.5, 3, ["id"]).collect()} == want
    assert telemetry.token_bucket(df.limit(0), "k", "at", 0.5, 3).count() == 0


def test_built_sql():
    c = lambda op, *v, **k: sqlbuild.condition(Condition("f", op, list(v), **k))
    assert c("eq", "a'b") == "`f` = 'a''b'" and c("ne", 1, 2) == "`f` NOT IN (1, 2)" and c("eq", "") == "`f` IS NULL" and c("ne", "") == "`f` IS NOT NULL"
    assert c("eq", "", "x") == "(`f` IS NULL OR `f` = 'x')" and c("ne", "", "x") == "`f` IS NOT NULL AND `f` != 'x'"
    assert c("contains", "x", "y") == "(`f` LIKE '%x%' OR `f` LIKE '%y%')" and c("nreq", "a", "b") == "`f` NOT REGEXP 'a|b'" and c("gte", 3) == "`f` >= 3" and c("existed") == "`f` IS NOT NULL"
    with pytest.raises(ValueError, match="one value"):
        c("gt", 1, 2)
    q = structured.Query.of({"table_id": "t", "field_name": "v", "function": [{"method": "sum", "dimensions": ["d"], "window": "1m"}], "limit": 5, "from": 2})
    doris, tspider = (sqlbuild.build(q, "t", "ms", 0, 10, d) for d in ("doris", "tspider"))
    assert "CAST(FLOOR" in doris and doris.endswith("GROUP BY `d`, `_timestamp_` LIMIT 5 OFFSET 2") and "CAST" not in tspider and "GROUP BY `d`, FLOOR(" in tspider
    assert sqlbuild.order_keys(["-_value", "x", "d", "_value", "_time"], ["d"]) == ["`_value_` DESC", "`d` ASC", "`_timestamp_` ASC"]


def test_batches_are_equal_bodies():
    body = {"keep_columns": ["a"], "limit": 3}
    of = lambda t, **k: structured.Query.of({"table_id": t, **body, **k})
    batches, alone = batch.planned([of("x"), of("y", reference_name="b"), of("x", limit=4), of("x", function=[{"method": "sum"}]), of("z", **{"from": 5})])
    assert [(b.members, b.tables) for b in batches] == [([0, 1], ["x", "y"]), ([2], ["x"])] and alone == [3, 4]


def test_whole_terms(spark):
    df = spark.createDataFrame([("foobar",), ("barfoo",), ("bar\nx",), (None,), ("a)b",)], "s string")
    hits = lambda p: [r.s for r in df.where(conditions.whole_term(F.col("s"), p)).collect()]
    assert hits("foo") == [] and hits("foo.*") == ["foobar"] and hits("^(?!foo).*$") == ["barfoo", "bar\nx", "a)b"] and hits("(?!foo)(?!a\\)).*") == ["barfoo", "bar\nx"] and hits("a[)]b$") == ["a)b"]
    with pytest.raises(ValueError, match="closed"):
        conditions.whole_term(F.col("s"), "(?!foo")


def test_rejected_log_lines(spark):
    df = spark.createDataFrame([(1, '{"a": 1, "b": "x"}', 5), (2, "no", 5), (3, None, 5), (4, " ", 5), (5, '{"a": "q"}', None)], "id int, line string, a long")
    good, bad = etl.log_pipeline(df, "line", "json", {"a": "int", "bb": "string"}, at=F.col("_row.a"), sources={"bb": "b"})
    assert [tuple(r) for r in good.select("id", "time", "a", "bb").collect()] == [(1, 5, 1, "x")]
    assert sorted((r.id, r.reason) for r in bad.collect()) == [(2, "unparsed"), (3, "blank"), (4, "blank"), (5, "no time")]
    assert etl.log_pipeline(df.limit(0), "line", "separator", {"x": "string"})[0].count() == 0
    with pytest.raises(ValueError, match="no way"):
        etl.log_pipeline(df, "line", "yaml", {})


def test_scroll_sessions_lock_and_expire(spark):
    df = spark.range(50).select("id", F.lit("x").alias("_slice_"))
    s = rawrows.ScrollSession(df, ["id"], 3, 10, 100.0)
    assert s.lock(0) and not s.lock(0)
    s.unlock(0)
    seen = []
    for n in range(3):
        while (rows := s.page(n, 7, 105.0)) is not None:
            seen += [r.id for r in rows.collect()]
    assert sorted(seen) == list(range(50)) and s.page(7, 1, 105.0) is None
    with pytest.raises(TimeoutError):
        s.page(0, 7, 200.0)


def test_spans_once(spark):
    df = spark.createDataFrame([("t", " AB ", "2", 5, 6, ""), ("t", "ab", "1", 7, 8, "0"), ("t", None, "1", 7, 8, "0")], "trace_id string, span_id string, time string, start_time long, end_time long, parent_span_id string")
    assert [(r.span_id, r.start_time) for r in topology.once(df).collect()] == [("ab", 7)]


def test_an_index_is_reopened_and_grows(spark, monkeypatch):
    monkeypatch.setattr(dedup, "ARRAY_IDS", 64)
    ids = spark.range(3000).select(F.xxhash64("id").alias("hi"), F.xxhash64(F.lit(1), "id").alias("lo"), "id")
    path = scratch(spark, "kept-index")
    first = dedup.IdentifierIndex(spark, 10, path)
    first.add(ids.where("id < 1000"))
    again = dedup.IdentifierIndex(spark, 10, path)
    assert again.runs == first.runs and again.prefixes == 8
    again.add(again.novel(ids.where("id < 2000")))
    again.compact()
    third = dedup.IdentifierIndex(spark, 10, path)
    assert third.prefixes > 100 and len(third.runs) == 1 and third.size() == 2000
    assert sorted(r.id for r in third.novel(ids).collect()) == list(range(2000, 3000))


def test_fast_and_batch_layers_agree(spark):
    rng = random.Random(3)
    rows = [(rng.randrange(3), e := rng.randrange(0, 200_000) * 1_000_000, e + rng.randrange(0, 90_000) * 1_000_000) for _ in range(300)]
    log = spark.createDataFrame(rows, "source long, event_us long, received_us long")
    view = latedata.LambdaView(spark)
    view.add(log.where("received_us < 100000000000"))
    view.add(log.where("received_us >= 100000000000"))
    assert len(view.increments) == 2 and view.differing(latedata.figures(log, view.rule)).count() == 0
    assert view.differing(latedata.figures(log.limit(299), view.rule)).count() == 1
    before = sorted(map(tuple, view.view().collect()))
    view.recompute(log, None, None)
    assert sorted(map(tuple, view.view().collect())) == before and not view.increments


def test_a_cluster_needs_a_shared_folder():
    class Conf:
        def get(self, *_):
            return None

    class Context:
        master = "spark://host:7077"

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(RuntimeError, match="checkpoint"):
        shared_dir(Session())


def test_scratch_files_go(spark, tmp_path):
    import os

    path = scratch(spark, "gone").removeprefix("file:")
    spark.range(3).write.parquet(path)
    assert os.path.isdir(path)
    release(spark)
    assert not os.path.isdir(path)
