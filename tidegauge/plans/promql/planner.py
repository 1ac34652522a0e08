"""PromQL trees as DataFrames.

A vector is a DataFrame ``labels, key, t, v``: label map, its canonical text, evaluation time (ms) and value; a scalar is a number or a
DataFrame ``t, v``. Every evaluation time of a query is in the one plan. Samples are spread over the times whose windows hold them; all that a window function needs of a sample's
predecessor (resets, changes, last but one) is computed by ``lag`` before, so that windows are plain aggregates, combined map-side."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidegauge.operators.conditions import java_regex, matcher, whole_regex
from tidegauge.plans.promql.parser import Node, PromQLError, folded, parse

Scalar = float | DataFrame
NAN = float("nan")
LOOK_BACK_MS, STEP_MS = 300_000, 60_000


def canonical(labels: Column) -> Column:
    """A text that is equal for equal label maps (maps can't be joined)."""
    return F.to_json(F.array_sort(F.map_entries(labels)))


def without_name(labels: Column) -> Column:
    return F.map_filter(labels, lambda k, _: k != "__name__")


def divided(a: Column, b: Column) -> Column:
    """a / b by IEEE 754."""
    by_zero = F.when((a == 0) | F.isnan(a), F.lit(NAN)).when(a > 0, F.lit(math.inf)).otherwise(F.lit(-math.inf))
    return F.when(b != 0, a / F.when(b != 0, b)).otherwise(by_zero)


def _remainder(a: Column, b: Column) -> Column:
    return F.when((b == 0) | F.isnan(b) | F.isnan(a), F.lit(NAN)).otherwise(a % F.when(b != 0, b))


ARITHMETIC: dict[str, Callable[[Column, Column], Column]] = {
    "+": lambda a, b: a + b, "-": lambda a, b: a - b, "*": lambda a, b: a * b, "/": divided, "%": _remainder, "^": lambda a, b: F.pow(a, b), "atan2": lambda a, b: F.atan2(a, b),
}


def _compare(op: str, a: Column, b: Column) -> Column:
    """Comparison where NaN equals nothing."""
    known = ~F.isnan(a) & ~F.isnan(b)
    return {"==": known & (a == b), "!=": ~known | (a != b), ">": known & (a > b), "<": known & (a < b), ">=": known & (a >= b), "<=": known & (a <= b)}[op]


def _least(v: Column, fn: Callable[[Column], Column]) -> Column:
    """min or max that passes over NaN unless there is nothing else."""
    return F.coalesce(fn(F.when(~F.isnan(v), v)), F.lit(NAN))


@dataclass
class Evaluation:
    """``series``: labels (map), t (ms), v. Times from ``start`` to ``end`` by ``step`` (ms)."""

    series: DataFrame
    start: int
    end: int
    step: int = STEP_MS
    look_back: int = LOOK_BACK_MS

    @property
    def spark(self):
        return self.series.sparkSession

    @property
    def _last(self) -> int:
        return self.start + (self.end - self.start) // self.step * self.step

    def times(self) -> DataFrame:
        return self.spark.range(self.start, self._last + 1, self.step).withColumnRenamed("id", "t")

    def _all_times(self) -> Column:
        return F.explode(F.sequence(F.lit(self.start).cast("long"), F.lit(self._last).cast("long"), F.lit(self.step).cast("long")))

    def _reach(self, low: Column, high: Column) -> tuple[Column, Column]:
        """The first and last evaluation time in [low, high]; none if the first is later."""
        first = F.greatest(F.lit(0), F.ceil((low - self.start) / F.lit(self.step))).cast("long") * self.step + self.start
        return first, (F.floor((F.least(high, F.lit(self._last)) - self.start) / F.lit(self.step))).cast("long") * self.step + self.start

    def _spread(self, low: Column, high: Column) -> Column:
        """The evaluation times in [low, high]."""
        first, last = self._reach(low, high)
        return F.explode(F.when(first <= last, F.sequence(first, last, F.lit(self.step).cast("long"))).otherwise(F.array().cast("array<long>")))

    # Selectors

    def _pinned(self, n: Node) -> Evaluation | None:
        """With @, the evaluation at that one time."""
        if n.at is None:
            return None
        at = {"start": self.start, "end": self._last}.get(n.at, n.at)
        return Evaluation(self.series, at, at, self.step, self.look_back)

    def _samples(self, n: Node, reach: int) -> DataFrame:
        found = self.series
        for name, op, value in n.matchers:
            found = found.where(matcher(F.col("labels"), name, op, value))
        low, high = self.start - n.offset_ms - reach, self.end - n.offset_ms
        found = found.where(F.col("t").between(low, high))
        return found.select("labels", canonical(F.col("labels")).alias("key"), (F.col("t") + n.offset_ms).alias("t"), "v")

    def instant_vector(self, n: Node, stamps: bool = False) -> DataFrame:
        """Of each series the latest sample not older than the look-back."""
        if (pinned := self._pinned(n)) is not None:
            free = Node("selector", n.value, matchers=n.matchers, offset_ms=n.offset_ms)
            return pinned.instant_vector(free, stamps).drop("t").select("*", self._all_times().alias("t"))
        s = self._samples(n, self.look_back)
        until = F.lead("t").over(W.partitionBy("key").orderBy("t")) - 1
        s = s.withColumn("until", F.least(F.coalesce(until, F.col("t") + self.look_back), F.col("t") + self.look_back))
        value = (F.col("t") - n.offset_ms) / 1000.0 if stamps else F.col("v")
        return s.select("labels", "key", value.alias("v"), self._spread(F.col("t"), F.col("until")).alias("at")).withColumnRenamed("at", "t")

    def windows(self, n: Node, panes: bool = False) -> DataFrame:
        """Samples of a range selector or subquery, each with its predecessor, once per window that holds it: ``labels, key, t, ts, v, pt, pv``.

        With ``panes``, samples that lie in the same windows are one row (see ``_pane``), which is copied instead of them: a series' rows are then bounded by its evaluation times, however densely it is sampled.
        Neither needs a further shuffle: rows lie by series already."""
        if (pinned := self._pinned(n)) is not None:
            free = Node(n.kind, n.value, n.args, n.matchers, n.range_ms, n.step_ms, n.offset_ms)
            return pinned.windows(free, panes).drop("t").select("*", self._all_times().alias("t"))
        if n.kind == "subquery":
            step = n.step_ms or self.step
            low = self.start - n.offset_ms - n.range_ms
            inner = Evaluation(self.series, -(-low // step) * step, self.end - n.offset_ms, step, self.look_back)
            s = inner.vector(n.args[0]).select("labels", "key", (F.col("t") + n.offset_ms).alias("t"), "v")
        elif n.kind == "selector" and n.range_ms:
            s = self._samples(n, n.range_ms)
        else:
            raise PromQLError("a range is needed here")
        order = W.partitionBy("key").orderBy("t")
        s = s.withColumns({"pt": F.lag("t").over(order), "pv": F.lag("v").over(order)})
        if panes:
            low, high = self._reach(F.col("t"), F.col("t") + n.range_ms)
            held = s.select("labels", "key", F.col("t").alias("ts"), "v", "pv", low.alias("low_t"), high.alias("high_t")).where("low_t <= high_t")
            held = held.groupBy("key", "low_t", "high_t").agg(F.first("labels").alias("labels"), *[c.alias(name) for name, c in _pane().items()])
            return held.select("*", F.explode(F.sequence("low_t", "high_t", F.lit(self.step).cast("long"))).alias("t"))
        return s.select("labels", "key", F.col("t").alias("ts"), "v", "pt", "pv", self._spread(F.col("t"), F.col("t") + n.range_ms).alias("t"))

    # Values

    def value(self, n: Node) -> DataFrame | Scalar:
        handler = {"number": lambda: n.value, "selector": lambda: self._selector(n), "call": lambda: self._call(n), "aggregate": lambda: self._aggregate(n),
                   "binary": lambda: self._binary(n), "negative": lambda: self._negative(n)}.get(n.kind)
        if handler is None:
            raise PromQLError(f"{n.kind} can't stand here")
        return handler()

    def vector(self, n: Node) -> DataFrame:
        v = self.value(n)
        if not isinstance(v, DataFrame) or "labels" not in v.columns:
            raise PromQLError("a vector is needed here")
        return v

    def scalar(self, n: Node) -> Scalar:
        v = self.value(n)
        if isinstance(v, DataFrame) and "labels" in v.columns:
            raise PromQLError("a scalar is needed here")
        return v

    def _number(self, n: Node) -> float:
        v = self.scalar(n)
        if isinstance(v, DataFrame):
            raise PromQLError("a constant is needed here")
        return float(v)

    def _selector(self, n: Node) -> DataFrame:
        if n.range_ms:
            raise PromQLError("a range vector can't be a result")
        return self.instant_vector(n)

    def _negative(self, n: Node) -> DataFrame | Scalar:
        v = self.value(n.args[0])
        if not isinstance(v, DataFrame):
            return -v
        return self._mapped(v, -F.col("v")) if "labels" in v.columns else v.withColumn("v", -F.col("v"))

    def _mapped(self, df: DataFrame, v: Column) -> DataFrame:
        """New values; the metric's name is dropped."""
        labels = without_name(F.col("labels"))
        return df.select(labels.alias("labels"), canonical(labels).alias("key"), "t", v.alias("v"))

    # Aggregation

    def _groups(self, n: Node, df: DataFrame) -> DataFrame:
        names = n.labels
        if n.without:
            keep = F.map_filter("labels", lambda k, _: ~k.isin([*names, "__name__"]))
        elif names:
            keep = F.map_filter("labels", lambda k, _: k.isin(names))
        else:
            keep = F.map_filter("labels", lambda k, _: F.lit(False))
        return df.withColumn("group", keep).withColumn("gkey", canonical(F.col("group")))

    def _aggregate(self, n: Node) -> DataFrame:
        name = n.value
        df = self._groups(n, self.vector(n.args[-1]))
        v = F.col("v")
        if name in ("topk", "bottomk"):
            k = int(self._number(n.args[0]))
            first = F.isnan(v).cast("int")
            w = W.partitionBy("gkey", "t").orderBy(first, v.desc() if name == "topk" else v.asc(), "key")
            return df.withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= k).select("labels", "key", "t", "v")
        if name == "count_values":
            label = n.args[0].value
            text = F.when((v == F.floor(v)) & (F.abs(v) < 1e15), v.cast("long").cast("string")).otherwise(v.cast("string"))
            df = df.withColumn("group", F.map_concat(F.map_filter("group", lambda k, _: k != label), F.create_map(F.lit(label), text)))
            df = df.withColumn("gkey", canonical(F.col("group")))
            made = F.count(F.lit(1)).cast("double")
        elif name == "quantile":
            made = quantile_of(F.col("v"), self._number(n.args[0]))
        else:
            made = {"sum": F.sum(v), "avg": F.avg(v), "min": _least(v, F.min), "max": _least(v, F.max), "count": F.count(F.lit(1)).cast("double"), "group": F.lit(1.0),
                    "stddev": F.stddev_pop(v), "stdvar": F.var_pop(v)}[name]
        out = df.groupBy("gkey", "t").agg(F.first("group").alias("labels"), made.alias("v"))
        return out.select("labels", F.col("gkey").alias("key"), "t", "v")

    # Binary operators

    def _binary(self, n: Node) -> DataFrame | Scalar:
        a, b = (self.value(x) for x in n.args)
        op, m = n.value.lower(), n.matching
        vectors = [isinstance(x, DataFrame) and "labels" in x.columns for x in (a, b)]
        if all(vectors):
            return self._sets(op, a, b, m) if op in ("and", "or", "unless") else self._matched(op, a, b, m)
        if op in ("and", "or", "unless"):
            raise PromQLError("set operators take vectors")
        if not any(vectors):
            if op not in ARITHMETIC and not m.get("bool"):
                raise PromQLError("a comparison of scalars needs bool")
            frame = self._scalar_frame(a).join(self._scalar_frame(b).withColumnRenamed("v", "w"), "t")
            made = ARITHMETIC[op](F.col("v"), F.col("w")) if op in ARITHMETIC else _compare(op, F.col("v"), F.col("w")).cast("double")
            return frame.select("t", made.alias("v"))
        vec, other = (a, b) if vectors[0] else (b, a)
        if isinstance(other, DataFrame):
            vec = vec.join(F.broadcast(other.withColumnRenamed("v", "w")), "t")  # one row per evaluation time
            w = F.col("w")
        else:
            w = F.lit(float(other))
        x, y = (F.col("v"), w) if vectors[0] else (w, F.col("v"))
        if op in ARITHMETIC:
            return self._mapped(vec, ARITHMETIC[op](x, y))
        if m.get("bool"):
            return self._mapped(vec, _compare(op, x, y).cast("double"))
        return vec.where(_compare(op, x, y)).select("labels", "key", "t", "v")

    def _scalar_frame(self, s: Scalar) -> DataFrame:
        return s if isinstance(s, DataFrame) else self.times().withColumn("v", F.lit(float(s)))

    @staticmethod
    def _match_labels(m: dict) -> Callable[[Column], Column]:
        names, on = m.get("labels", []), m.get("on", False)
        if on:
            return lambda labels: F.map_filter(labels, lambda k, _: k.isin(names) if names else F.lit(False))
        return lambda labels: F.map_filter(labels, lambda k, _: ~k.isin([*names, "__name__"]))

    def _sets(self, op: str, a: DataFrame, b: DataFrame, m: dict) -> DataFrame:
        match = self._match_labels(m)
        a, b = (x.withColumn("mkey", canonical(match(F.col("labels")))) for x in (a, b))
        columns = ["labels", "key", "t", "v"]
        if op == "or":
            rest = b.join(a.select("mkey", "t").distinct(), ["mkey", "t"], "left_anti")
            return a.select(*columns).unionByName(rest.select(*columns))
        return a.join(b.select("mkey", "t").distinct(), ["mkey", "t"], "left_semi" if op == "and" else "left_anti").select(*columns)

    def _matched(self, op: str, a: DataFrame, b: DataFrame, m: dict) -> DataFrame:
        match, group = self._match_labels(m), m.get("group")
        many, one = (b, a) if group == "right" else (a, b)
        many = many.withColumn("mkey", canonical(match(F.col("labels"))))
        one = one.withColumn("mkey", canonical(match(F.col("labels"))))

        def single(df: DataFrame, side: str) -> DataFrame:
            n = F.count(F.lit(1)).over(W.partitionBy("mkey", "t"))
            checked = F.when(n > 1, F.raise_error(F.concat(F.lit(f"several series match on the {side} side: "), F.col("mkey"))).cast("double")).otherwise(F.col("v"))
            return df.withColumn("v", checked)

        one = single(one, "one").select("mkey", "t", F.col("v").alias("ov"), F.col("labels").alias("ol"))
        if not group:
            many = single(many, "other")
        both = many.join(one, ["mkey", "t"])
        x, y = (F.col("ov"), F.col("v")) if group == "right" else (F.col("v"), F.col("ov"))
        drops_name = op in ARITHMETIC or m.get("bool")
        labels = without_name(F.col("labels")) if drops_name else F.col("labels")
        if not group:
            if m.get("on"):
                labels = F.map_filter(labels, lambda k, _: k.isin(m["labels"]) if m["labels"] else F.lit(False))
            elif m.get("labels"):
                labels = F.map_filter(labels, lambda k, _: ~k.isin(m["labels"]))
        elif m.get("include"):
            taken = F.map_filter("ol", lambda k, _: k.isin(m["include"]))
            labels = F.map_concat(F.map_filter(labels, lambda k, _: ~k.isin(m["include"])), taken)
        if op in ARITHMETIC:
            made = ARITHMETIC[op](x, y)
        elif m.get("bool"):
            made = _compare(op, x, y).cast("double")
        else:
            both = both.where(_compare(op, x, y))
            made = x
        return both.select(labels.alias("labels"), canonical(labels).alias("key"), "t", made.alias("v"))

    # Functions

    def _call(self, n: Node) -> DataFrame | Scalar:
        name, args = n.value, n.args
        if name in RANGE_FUNCTIONS or name in ("quantile_over_time", "predict_linear", "holt_winters", "absent_over_time"):
            return self._range_call(name, args)
        if name == "time":
            return self.times().withColumn("v", F.col("t") / 1000.0)
        if name == "pi":
            return math.pi
        if name == "vector":
            none = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))
            return self._scalar_frame(self.scalar(args[0])).select(none.alias("labels"), canonical(none).alias("key"), "t", "v")
        if name == "scalar":
            counted = self.vector(args[0]).groupBy("t").agg(F.count(F.lit(1)).alias("n"), F.first("v").alias("v"))
            return self.times().join(counted, "t", "left").select("t", F.when(F.col("n") == 1, F.col("v")).otherwise(F.lit(NAN)).alias("v"))
        if name == "absent":
            return self._absent(args[0], self.vector(args[0]))
        if name == "timestamp":
            if args[0].kind == "selector":
                df = self.instant_vector(args[0], stamps=True)
                return self._mapped(df, F.col("v"))
            return self._mapped(self.vector(args[0]), F.col("t") / 1000.0)
        if name in ("sort", "sort_desc"):
            return self.vector(args[0])
        if name == "histogram_quantile":
            return self._histogram_quantile(self._number(args[0]), self.vector(args[1]))
        if name == "label_replace":
            return self._label_replace(self.vector(args[0]), *[a.value for a in args[1:]])
        if name == "label_join":
            return self._label_join(self.vector(args[0]), args[1].value, args[2].value, [a.value for a in args[3:]])
        if name in DATE_FUNCTIONS:
            df = self.vector(args[0]) if args else self._call(Node("call", "vector", [Node("call", "time")]))
            moment = F.timestamp_micros((F.floor(F.col("v")) * 1_000_000).cast("long"))
            return self._mapped(df, DATE_FUNCTIONS[name](moment).cast("double"))
        if name in VALUE_FUNCTIONS:
            extra = [self._number(a) for a in args[1:]]
            return self._mapped(self.vector(args[0]), VALUE_FUNCTIONS[name](F.col("v"), *extra).cast("double"))
        raise PromQLError(f"no function: {name!r}")

    def _range_call(self, name: str, args: list[Node]) -> DataFrame:
        at = {"quantile_over_time": 1}.get(name, 0)
        n = args[at]
        df = self.windows(n, name in PANE_FUNCTIONS)
        if name == "absent_over_time":
            return self._absent(n, df)
        grouped = df.groupBy("key", "t")
        labels = F.first("labels").alias("labels")
        if name == "quantile_over_time":
            out = grouped.agg(labels, quantile_of(F.col("v"), self._number(args[0])).alias("v"))
        elif name == "predict_linear":
            slope, intercept, points = _regression(F.col("t"))
            out = grouped.agg(labels, points.alias("n"), (intercept + slope * self._number(args[1])).alias("v")).where("n >= 2")
        elif name == "holt_winters":
            out = grouped.agg(labels, F.array_sort(F.collect_list(F.struct("ts", "v"))).alias("x")).where(F.size("x") >= 2)
            out = out.withColumn("v", _holt_winters(F.col("x"), *[self._number(a) for a in args[1:3]]))
        else:
            made, condition = (PANE_FUNCTIONS.get(name) or RANGE_FUNCTIONS[name])(n.range_ms)
            out = grouped.agg(labels, made.alias("v"), condition.alias("ok")).where("ok")
        if name == "last_over_time":
            return out.select("labels", "key", "t", "v")
        return self._mapped(out, F.col("v"))

    def _absent(self, n: Node, df: DataFrame) -> DataFrame:
        equal: dict[str, str | None] = {}
        for a, op, v in n.matchers if n.kind == "selector" else []:
            if a != "__name__":
                equal[a] = v if op == "=" and a not in equal else None
        pairs = [F.lit(x) for k, v in equal.items() if v is not None for x in (k, v)]
        labels = F.create_map(*pairs) if pairs else F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))
        gone = self.times().join(df.select("t").distinct(), "t", "left_anti")
        return gone.select(labels.alias("labels"), canonical(labels).alias("key"), "t", F.lit(1.0).alias("v"))

    def _histogram_quantile(self, q: float, df: DataFrame) -> DataFrame:
        le = F.try_element_at("labels", F.lit("le"))
        bound = F.when(F.upper(le).isin("+INF", "INF"), F.lit(math.inf)).otherwise(le.try_cast("double"))
        keep = F.map_filter("labels", lambda k, _: ~k.isin("le", "__name__"))
        b = df.where(bound.isNotNull()).select(keep.alias("labels"), canonical(keep).alias("key"), "t", bound.alias("le"), "v")
        b = b.groupBy("key", "t", "le").agg(F.first("labels").alias("labels"), F.sum("v").alias("v"))
        order = W.partitionBy("key", "t").orderBy("le")
        b = b.withColumn("v", F.max("v").over(order.rowsBetween(W.unboundedPreceding, 0)))
        b = b.withColumns({"ple": F.lag("le").over(order), "pv": F.lag("v").over(order)})
        total = W.partitionBy("key", "t")
        b = b.withColumns({"n": F.count(F.lit(1)).over(total), "all": F.max("v").over(total), "top": F.max("le").over(total)})
        hit = b.where((F.col("v") >= F.col("all") * q) | (F.col("all") == 0)).groupBy("key", "t").agg(
            F.first("labels").alias("labels"), F.min(F.struct("le", "v", "ple", "pv", "n", "all", "top")).alias("x"))
        x = F.col("x")
        below, count = F.coalesce(x["pv"], F.lit(0.0)), x["v"] - F.coalesce(x["pv"], F.lit(0.0))
        low = F.coalesce(x["ple"], F.lit(0.0))
        inside = low + (x["le"] - low) * divided(x["all"] * q - below, count)
        made = (
            F.when((x["n"] < 2) | (x["top"] != math.inf) | (x["all"] == 0), F.lit(NAN))
            .when(F.lit(q < 0), F.lit(-math.inf)).when(F.lit(q > 1), F.lit(math.inf))
            .when(x["le"] == math.inf, x["ple"])
            .when(x["ple"].isNull() & (x["le"] <= 0), x["le"])
            .otherwise(inside)
        )
        return hit.select("labels", "key", "t", made.alias("v"))

    def _label_replace(self, df: DataFrame, dst: str, template: str, src: str, pattern: str) -> DataFrame:
        value = F.coalesce(F.try_element_at("labels", F.lit(src)), F.lit(""))
        hit = value.rlike(whole_regex(pattern))
        made = F.regexp_replace(value, whole_regex(pattern), java_regex(template).replace("${", "$").replace("}", "") if "${" in template else template)
        rest = F.map_filter("labels", lambda k, _: k != dst)
        labels = F.when(hit & (made != ""), F.map_concat(rest, F.create_map(F.lit(dst), made))).when(hit, rest).otherwise(F.col("labels"))
        return df.select(labels.alias("labels"), canonical(labels).alias("key"), "t", "v")

    def _label_join(self, df: DataFrame, dst: str, sep: str, sources: list[str]) -> DataFrame:
        made = F.concat_ws(sep, *[F.coalesce(F.try_element_at("labels", F.lit(s)), F.lit("")) for s in sources])
        rest = F.map_filter("labels", lambda k, _: k != dst)
        labels = F.when(made != "", F.map_concat(rest, F.create_map(F.lit(dst), made))).otherwise(rest)
        return df.select(labels.alias("labels"), canonical(labels).alias("key"), "t", "v")


def quantile_of(v: Column, q: float) -> Column:
    if q < 0 or q > 1:
        return F.first(F.lit(math.copysign(math.inf, q - 0.5)))
    return F.percentile(v, F.lit(q))


def _regression(at: Column) -> tuple[Column, Column, Column]:
    """Slope per second, value at ``at``, and number of points of a window's least-squares line."""
    x, y = (F.col("ts") - at) / 1000.0, F.col("v")
    slope = F.when(F.min(y) == F.max(y), F.lit(0.0)).otherwise(F.regr_slope(y, x))
    return slope, F.when(F.min(y) == F.max(y), F.min(y)).otherwise(F.regr_intercept(y, x)), F.count(F.lit(1))


def _holt_winters(x: Column, sf: float, tf: float) -> Column:
    first = F.element_at(x, 1)["v"]
    state = F.struct(F.lit(0.0).alias("s0"), first.alias("s1"), (F.element_at(x, 2)["v"] - first).alias("b"), F.lit(0).alias("i"))

    def step(s: Column, p: Column) -> Column:
        trend = F.when(s["i"] == 0, s["b"]).otherwise(tf * (s["s1"] - s["s0"]) + (1 - tf) * s["b"])
        return F.struct(s["s1"].alias("s0"), (sf * p["v"] + (1 - sf) * (s["s1"] + trend)).alias("s1"), trend.alias("b"), (s["i"] + 1).alias("i"))

    return F.aggregate(F.slice(x, 2, F.size(x)), state, step)["s1"]


def _pane() -> dict[str, Column]:
    """What the samples of a pane (or a single one) come to, so that panes add up to windows: count, sum, extremes, first and last, and what happened between neighbours, with the share of the first sample apart."""
    ts, v, pv = F.col("ts"), F.col("v"), F.col("pv")
    real = F.when(~F.isnan(v), v)
    happened = {"lost": F.when(v < pv, pv).otherwise(0.0), "resets": F.when(v < pv, 1).otherwise(0), "changes": F.when(v != pv, 1).otherwise(0)}
    out = {"n": F.count(F.lit(1)), "total": F.sum(v), "least": F.min(real), "most": F.max(real), "first_t": F.min(ts), "last_t": F.max(ts), "first": F.min_by(v, ts), "last": F.max_by(v, ts)}
    for name, c in happened.items():
        out |= {name: F.sum(c), f"{name}_first": F.min_by(c, ts)}
    return out


def _ends() -> dict[str, Column]:
    return {"n": F.sum("n"), "first_t": F.min("first_t"), "last_t": F.max("last_t"), "first": F.min_by("first", "first_t"), "last": F.max_by("last", "last_t")}


def _between(name: str) -> Column:
    """What happened between neighbours inside a window: all of it, but for the share of the window's first sample."""
    return F.sum(name) - F.min_by(f"{name}_first", "first_t")


def _extrapolated(counter: bool, per_second: bool) -> Callable[[int], tuple[Column, Column]]:
    """Increase between a window's first and last sample, carried on to its borders."""

    def made(range_ms: int) -> tuple[Column, Column]:
        e, t = _ends(), F.first("t")
        growth = e["last"] - e["first"]
        if counter:  # what was lost by resets, but for the one before the window's first sample
            growth = growth + _between("lost")
        sampled = (e["last_t"] - e["first_t"]) / 1000.0
        between = sampled / (e["n"] - 1)
        before, behind = (e["first_t"] - (t - range_ms)) / 1000.0, (t - e["last_t"]) / 1000.0
        if counter:
            to_zero = F.when((growth > 0) & (e["first"] >= 0), sampled * divided(e["first"], growth))
            before = F.least(before, F.coalesce(to_zero, before))
        reach = sampled + F.when(before < between * 1.1, before).otherwise(between / 2) + F.when(behind < between * 1.1, behind).otherwise(between / 2)
        v = F.when(e["n"] >= 2, growth * divided(reach, sampled) / (range_ms / 1000.0 if per_second else 1.0))
        return v, e["n"] >= 2

    return made


def _last_two(per_second: bool) -> Callable[[int], tuple[Column, Column]]:
    def made(range_ms: int) -> tuple[Column, Column]:
        last = F.max(F.struct("ts", "v", "pt", "pv"))
        diff = last["v"] - last["pv"]
        inside = last["pt"].isNotNull() & (last["pt"] >= F.first("t") - range_ms)
        if per_second:
            diff = F.when(last["v"] < last["pv"], last["v"]).otherwise(diff) / ((last["ts"] - last["pt"]) / 1000.0)
        return F.when(inside, diff), inside

    return made


def _simple(fn: Callable[[Column], Column]) -> Callable[[int], tuple[Column, Column]]:
    return lambda _: (fn(F.col("v")).cast("double"), F.lit(True))


def _deriv(_: int) -> tuple[Column, Column]:
    slope, _intercept, n = _regression(F.col("t"))
    return slope, n >= 2


# Functions that are put together from panes.
PANE_FUNCTIONS: dict[str, Callable[[int], tuple[Column, Column]]] = {
    "rate": _extrapolated(True, True), "increase": _extrapolated(True, False), "delta": _extrapolated(False, False),
    "changes": lambda _: (_between("changes").cast("double"), F.lit(True)), "resets": lambda _: (_between("resets").cast("double"), F.lit(True)),
    "avg_over_time": lambda _: (F.sum("total") / F.sum("n"), F.lit(True)), "sum_over_time": lambda _: (F.sum("total"), F.lit(True)), "count_over_time": lambda _: (F.sum("n").cast("double"), F.lit(True)),
    "min_over_time": lambda _: (F.coalesce(F.min("least"), F.lit(NAN)), F.lit(True)), "max_over_time": lambda _: (F.coalesce(F.max("most"), F.lit(NAN)), F.lit(True)),
    "last_over_time": lambda _: (F.max_by("last", "last_t"), F.lit(True)), "present_over_time": lambda _: (F.lit(1.0), F.lit(True)),
}
# Functions that need the samples of each window.
RANGE_FUNCTIONS: dict[str, Callable[[int], tuple[Column, Column]]] = {
    **PANE_FUNCTIONS, "irate": _last_two(True), "idelta": _last_two(False), "deriv": _deriv, "stddev_over_time": _simple(F.stddev_pop), "stdvar_over_time": _simple(F.var_pop),
}


def _rounded(v: Column, to: float = 1.0) -> Column:
    inverse = 1.0 / to
    return F.floor(v * inverse + 0.5) / inverse


def _domain(ok: Column, v: Column) -> Column:
    return F.when(ok, v).otherwise(F.lit(NAN))


def _log(v: Column, fn: Callable[[Column], Column]) -> Column:
    return F.when(v > 0, fn(v)).when(v == 0, F.lit(-math.inf)).otherwise(F.lit(NAN))


VALUE_FUNCTIONS: dict[str, Callable[..., Column]] = {
    "abs": F.abs, "ceil": lambda v: F.ceil(v), "floor": lambda v: F.floor(v), "round": _rounded, "sqrt": lambda v: _domain(v >= 0, F.sqrt(v)), "exp": F.exp,
    "ln": lambda v: _log(v, F.log), "log2": lambda v: _log(v, F.log2), "log10": lambda v: _log(v, F.log10), "sgn": F.signum, "deg": F.degrees, "rad": F.radians,
    "sin": F.sin, "cos": F.cos, "tan": F.tan, "asin": F.asin, "acos": F.acos, "atan": F.atan, "sinh": F.sinh, "cosh": F.cosh, "tanh": F.tanh, "asinh": F.asinh, "acosh": F.acosh, "atanh": F.atanh,
    "clamp": lambda v, low, high: F.greatest(F.least(v, F.lit(high)), F.lit(low)), "clamp_max": lambda v, high: F.least(v, F.lit(high)), "clamp_min": lambda v, low: F.greatest(v, F.lit(low)),
}

DATE_FUNCTIONS: dict[str, Callable[[Column], Column]] = {
    "day_of_month": F.dayofmonth, "day_of_week": lambda d: F.dayofweek(d) - 1, "day_of_year": F.dayofyear, "days_in_month": lambda d: F.dayofmonth(F.last_day(d)),
    "hour": F.hour, "minute": F.minute, "month": F.month, "year": F.year,
}


def evaluate(series: DataFrame, text: str | Node, start: int, end: int, step: int = STEP_MS, look_back: int = LOOK_BACK_MS) -> DataFrame:
    """``labels, t, v`` of a PromQL expression at every time from ``start`` to ``end``; a scalar has no labels column."""
    node = folded(parse(text) if isinstance(text, str) else text)
    if node.kind == "string":
        raise PromQLError("a text is no series")
    run = Evaluation(series, start, end, step, look_back)
    out = run.value(node)
    if not isinstance(out, DataFrame):
        out = run._scalar_frame(out)
    return out.drop("key").select(*[c for c in ("labels", "t", "v") if c in out.columns])


def range_query(series: DataFrame, text: str, start: int, end: int, step: int = STEP_MS, look_back: int = LOOK_BACK_MS) -> DataFrame:
    return evaluate(series, text, start, end, step, look_back)


def instant(series: DataFrame, text: str, at: int, look_back: int = LOOK_BACK_MS) -> DataFrame:
    """One evaluation; ``sort`` and ``sort_desc`` at the top order the rows."""
    node = folded(parse(text))
    out = evaluate(series, node, at, at, STEP_MS, look_back)
    if node.kind == "call" and node.value in ("sort", "sort_desc"):
        out = out.orderBy(F.col("v").desc() if node.value == "sort_desc" else F.col("v").asc())
    return out
