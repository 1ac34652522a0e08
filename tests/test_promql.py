"""PromQL on small literal series against a plain Python evaluation of the same definitions."""

import math

import numpy as np
import pytest

from tidegauge.plans.promql import evaluate, instant, parse
from tidegauge.plans.promql.parser import PromQLError, folded

ROWS = []
for name, values in {
    "a": [(0, 1.0), (30_000, 3.0), (60_000, 7.0), (90_000, 2.0), (150_000, 5.0), (240_000, 9.0)],
    "b": [(15_000, 10.0), (60_000, 12.0), (120_000, 11.0), (120_500, 11.5), (600_000, 1.0)],
}.items():
    ROWS += [({"__name__": "m", "job": name, "zone": "z1" if name == "a" else "z2"}, t, v) for t, v in values]
ROWS += [({"__name__": "info", "job": "a", "owner": "o1"}, 60_000, 1.0), ({"__name__": "info", "job": "b", "owner": "o2"}, 60_000, 2.0)]
for le, c in (("0.1", 2.0), ("0.5", 6.0), ("1", 9.0), ("+Inf", 10.0)):
    ROWS.append(({"__name__": "h_bucket", "job": "a", "le": le}, 60_000, c))
START, END, STEP = 0, 300_000, 60_000


@pytest.fixture(scope="module")
def series(spark):
    return spark.createDataFrame(ROWS, "labels map<string,string>, t long, v double")


def run(series, text, **kw):
    rows = evaluate(series, text, kw.get("start", START), kw.get("end", END), kw.get("step", STEP)).collect()
    return {(tuple(sorted((r.labels if "labels" in r else {}).items())), r.t): r.v for r in rows}


def by_job(got):
    return {(dict(k).get("job"), t): v for (k, t), v in got.items()}


def samples(job):
    return [(t, v) for labels, t, v in ROWS if labels["__name__"] == "m" and labels["job"] == job]


def window(job, t, w):
    return [(a, v) for a, v in samples(job) if t - w <= a <= t]


def extrapolated(points, t, w, counter, per_second):
    if len(points) < 2:
        return None
    growth = points[-1][1] - points[0][1]
    if counter:
        growth += sum(p[1] for p, q in zip(points, points[1:], strict=False) if q[1] < p[1])
    sampled = (points[-1][0] - points[0][0]) / 1000
    between = sampled / (len(points) - 1)
    before, behind = (points[0][0] - (t - w)) / 1000, (t - points[-1][0]) / 1000
    if counter and growth > 0 and points[0][1] >= 0:
        before = min(before, sampled * points[0][1] / growth)
    reach = sampled + (before if before < between * 1.1 else between / 2) + (behind if behind < between * 1.1 else between / 2)
    return growth * reach / sampled / (w / 1000 if per_second else 1)


def line(points, at):
    x = np.array([(t - at) / 1000 for t, _ in points])
    y = np.array([v for _, v in points])
    slope = 0.0 if (y == y[0]).all() else np.polyfit(x, y, 1)[0]
    return slope, y.mean() - slope * x.mean()


def smoothed(points, sf, tf):
    s0, s1, b = 0.0, points[0][1], points[1][1] - points[0][1]
    for i in range(1, len(points)):
        b = b if i == 1 else tf * (s1 - s0) + (1 - tf) * b
        s0, s1 = s1, sf * points[i][1] + (1 - sf) * (s1 + b)
    return s1


W = 120_000
RANGES = {
    "rate(m[2m])": lambda p, t: extrapolated(p, t, W, True, True),
    "increase(m[2m])": lambda p, t: extrapolated(p, t, W, True, False),
    "delta(m[2m])": lambda p, t: extrapolated(p, t, W, False, False),
    "irate(m[2m])": lambda p, t: (p[-1][1] if p[-1][1] < p[-2][1] else p[-1][1] - p[-2][1]) / ((p[-1][0] - p[-2][0]) / 1000) if len(p) > 1 else None,
    "idelta(m[2m])": lambda p, t: p[-1][1] - p[-2][1] if len(p) > 1 else None,
    "changes(m[2m])": lambda p, t: float(sum(a[1] != b[1] for a, b in zip(p, p[1:], strict=False))),
    "resets(m[2m])": lambda p, t: float(sum(b[1] < a[1] for a, b in zip(p, p[1:], strict=False))),
    "avg_over_time(m[2m])": lambda p, t: float(np.mean([v for _, v in p])),
    "sum_over_time(m[2m])": lambda p, t: sum(v for _, v in p),
    "min_over_time(m[2m])": lambda p, t: min(v for _, v in p),
    "max_over_time(m[2m])": lambda p, t: max(v for _, v in p),
    "count_over_time(m[2m])": lambda p, t: float(len(p)),
    "stddev_over_time(m[2m])": lambda p, t: float(np.std([v for _, v in p])),
    "stdvar_over_time(m[2m])": lambda p, t: float(np.var([v for _, v in p])),
    "last_over_time(m[2m])": lambda p, t: p[-1][1],
    "present_over_time(m[2m])": lambda p, t: 1.0,
    "quantile_over_time(0.3, m[2m])": lambda p, t: float(np.quantile([v for _, v in p], 0.3)),
    "deriv(m[2m])": lambda p, t: line(p, t)[0] if len(p) > 1 else None,
    "predict_linear(m[2m], 60)": lambda p, t: line(p, t)[1] + 60 * line(p, t)[0] if len(p) > 1 else None,
    "holt_winters(m[2m], 0.5, 0.3)": lambda p, t: smoothed(p, 0.5, 0.3) if len(p) > 1 else None,
}


@pytest.mark.parametrize("text", RANGES)
def test_range_functions(series, text):
    got = by_job(run(series, text))
    want = {}
    for job in "ab":
        for t in range(START, END + 1, STEP):
            p = window(job, t, W)
            if p and (v := RANGES[text](p, t)) is not None:
                want[(job, t)] = v
    assert got.keys() == want.keys()
    for k, v in want.items():
        assert math.isclose(got[k], v, rel_tol=1e-9, abs_tol=1e-9), (k, got[k], v)


def latest(job, t, back=300_000):
    p = [v for a, v in samples(job) if t - back <= a <= t]
    return p[-1] if p else None


def test_instant_selector_with_look_back_offset_and_pin(series):
    at = range(0, 1_200_001, STEP)
    want = {(j, t): v for j in "ab" for t in at if (v := latest(j, t)) is not None}
    assert by_job(run(series, "m", end=1_200_000)) == want
    assert by_job(run(series, "m offset 1m", end=1_200_000)) == {(j, t): v for j in "ab" for t in at if (v := latest(j, t - 60_000)) is not None}
    assert by_job(run(series, "m @ 60")) == {(j, t): latest(j, 60_000) for j in "ab" for t in range(0, END + 1, STEP)}
    assert by_job(run(series, "m @ end()")) == {(j, t): latest(j, END) for j in "ab" for t in range(0, END + 1, STEP)}


def test_aggregates(series):
    v = {j: latest(j, 60_000) for j in "ab"}
    one = lambda text: {tuple(sorted(r.labels.items())): r.v for r in instant(series, text, 60_000).collect()}
    assert one("sum(m)") == {(): v["a"] + v["b"]}
    assert one("sum by (job) (m)") == {(("job", "a"),): v["a"], (("job", "b"),): v["b"]}
    assert one("avg without (job, zone) (m)") == {(): (v["a"] + v["b"]) / 2}
    assert one("quantile(0.5, m)") == {(): (v["a"] + v["b"]) / 2}
    assert one("stddev(m)") == {(): abs(v["a"] - v["b"]) / 2} and one("count(m)") == {(): 2.0} and one("group(m)") == {(): 1.0}
    assert [dict(k)["job"] for k in one("topk(1, m)")] == ["b"] and [dict(k)["job"] for k in one("bottomk(1, m)")] == ["a"]
    assert one('count_values("x", m > bool 8)') == {(("x", "0"),): 1.0, (("x", "1"),): 1.0}
    assert one("max(m) - min(m)") == {(): v["b"] - v["a"]}


def test_binary_operators_and_matching(series):
    one = lambda text: {tuple(sorted(r.labels.items())): r.v for r in instant(series, text, 60_000).collect()}
    a, b = latest("a", 60_000), latest("b", 60_000)
    assert {dict(k)["job"]: v for k, v in one("m * 2 + 1").items()} == {"a": a * 2 + 1, "b": b * 2 + 1}
    assert {dict(k)["job"]: v for k, v in one("m > 8").items()} == {"b": b}
    assert {dict(k)["job"]: v for k, v in one("m > bool 8").items()} == {"a": 0.0, "b": 1.0}
    got = one("m * on (job) group_left (owner) info")
    assert {(dict(k)["job"], dict(k)["owner"], dict(k)["zone"]): v for k, v in got.items()} == {("a", "o1", "z1"): a, ("b", "o2", "z2"): b * 2}
    assert {dict(k)["job"]: v for k, v in one("m / on (job) info").items()} == {"a": a, "b": b / 2}
    assert {dict(k)["job"] for k in one('m and on (job) info{owner="o1"}')} == {"a"} and {dict(k)["job"] for k in one('m unless on (job) info{owner="o1"}')} == {"b"}
    assert len(one("m or info")) == 4 and len(one('m{job="a"} or m')) == 2
    with pytest.raises(Exception, match="several series match"):
        one("m / on () info")
    assert len(one("m / 0 == Inf")) == 2
    assert {k: v for k, v in one("-m").items()} == {k: -v for k, v in one("m + 0").items()}


def test_other_functions(series):
    one = lambda text: {tuple(sorted(r.labels.items())): r.v for r in instant(series, text, 60_000).collect()}
    assert math.isclose(one("histogram_quantile(0.5, h_bucket)")[(("job", "a"),)], 0.1 + 0.4 * (5 - 2) / 4)
    assert one("histogram_quantile(0.95, h_bucket)")[(("job", "a"),)] == 1.0
    assert one('absent(nothing{x="y"})') == {(("x", "y"),): 1.0} and one("absent(m)") == {}
    assert instant(series, "scalar(sum(m)) + time()", 60_000).collect()[0].v == latest("a", 60_000) + latest("b", 60_000) + 60
    assert one("vector(3)") == {(): 3.0}
    got = one('label_replace(m, "w", "$1-x", "zone", "z(.*)")')
    assert {dict(k)["w"] for k in got} == {"1-x", "2-x"}
    assert {dict(k)["w"] for k in one('label_join(m, "w", "/", "job", "zone")')} == {"a/z1", "b/z2"}
    assert {dict(k)["job"]: v for k, v in one("timestamp(m)").items()} == {"a": 60.0, "b": 60.0}
    assert one("minute(vector(3725))") == {(): 2.0} and one("day_of_week(vector(0))") == {(): 4.0} and one("days_in_month(vector(0))") == {(): 31.0}
    assert {dict(k)["job"]: v for k, v in one("clamp(m, 8, 10)").items()} == {"a": 8.0, "b": 10.0}
    assert one("round(vector(2.5))") == {(): 3.0} and one("round(vector(7), 5)") == {(): 5.0} and one("sqrt(vector(9))") == {(): 3.0}
    assert math.isnan(one("sqrt(vector(-1))")[()]) and one("ln(vector(0))")[()] == -math.inf and one("sgn(vector(-4))") == {(): -1.0}
    assert [r.v for r in instant(series, "sort_desc(m)", 60_000).collect()] == sorted((latest(j, 60_000) for j in "ab"), reverse=True)
    sub = by_job(run(series, "max_over_time(sum by (job) (m)[2m:30s])"))
    for (j, t), v in sub.items():
        assert v == max(x for s in range(max(0, t - 120_000), t + 1, 30_000) if (x := latest(j, s)) is not None)


def test_parser():
    for text in ("a + b * c ^ 2 ^ 3 - -d", "topk(3, sum without (x) (y)) > bool 5", "quantile_over_time(0.9, (a+b)[1h:5m] @ end())", 'a{b!~"c|d"}[5m] offset -1h', "2 - 1 - 1"):
        tree = folded(parse(text)) if "[5m]" not in text else parse(text)
        assert parse(str(tree)) == tree
    assert folded(parse("2 - 1 - 1")).value == 0 and folded(parse("2 ^ 3 ^ 2")).value == 512 and folded(parse("-2 ^ 2")).value == -4
    for bad in ("sum(", "a{b}", "a[5m", "{}", "topk(m)", "a b", "1 < 2 <", "a + [5m]"):
        with pytest.raises(PromQLError):
            parse(bad)


def test_dense_samples_are_spread_as_panes(spark):
    """Samples between two borders of windows are one row before they are copied into the windows."""
    from pyspark.sql import functions as F

    from tidegauge.plans.promql.planner import Evaluation

    df = spark.range(6000).select(F.create_map(F.lit("__name__"), F.lit("m")).alias("labels"), (F.col("id") * 100).alias("t"), (F.col("id") % 700).cast("double").alias("v"))
    e = Evaluation(df, 60_000, 600_000, 60_000, 300_000)
    node = parse("sum_over_time(m[2m])").args[0]
    assert e.windows(node, True).count() <= 6 * 10 < e.windows(node).count() / 100
    got = {r.t: r.v for r in evaluate(df, "sum_over_time(m[2m])", 60_000, 600_000, 60_000).collect()}
    assert got == {t: float(sum(i % 700 for i in range(6000) if t - 120_000 <= i * 100 <= t)) for t in range(60_000, 600_001, 60_000)}
