"""Cleaning and enrichment of records: parse, coerce, cut, join, relabel, count."""

from __future__ import annotations

import re
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidegauge.functions.timeutil import round_ms

# Declared field types and what they are in Spark.
TYPES = {"int": "bigint", "uint": "decimal(20,0)", "float": "double", "string": "string", "bool": "boolean", "timestamp": "timestamp", "object": "string", "nested": "string"}


# Parsing

def parse_json(c: Column) -> Column:
    """JSON object as a map of texts; null for anything else."""
    return F.from_json(F.when(F.trim(c) != "", c), "map<string,string>")


def json_with_rest(df: DataFrame, column: str, known: list[str]) -> DataFrame:
    """Adds the known keys as columns, ``ext_json`` (the other keys as JSON), ``raw`` (the text, kept if it is no object) and ``clean_failed``.

    The parser ignores what follows a value, so the text is parsed as an array's element and as a key's value: only an object alone is good for both. Objects that name a key twice fail."""
    t = F.col(column)
    m = F.from_json(F.col(column), "map<string,string>")
    alone = [F.try_parse_json(F.concat(F.lit(a), t, F.lit(z))).isNotNull() for a, z in (("[", "]"), ('{"v":', "}"))]
    is_object = t.rlike(r"^\s*\{") & alone[0] & alone[1]
    df = df.withColumn("_m", F.when(is_object, m))
    rest = F.map_filter("_m", lambda k, _: ~k.isin(known))
    df = df.withColumns({k: F.try_element_at("_m", F.lit(k)) for k in known})
    df = df.withColumns({"ext_json": F.when(F.size(rest) > 0, F.to_json(rest)), "raw": F.when(~F.coalesce(is_object, F.lit(False)), F.col(column)), "clean_failed": ~F.coalesce(is_object, F.lit(False))})
    return df.drop("_m")


def separated(df: DataFrame, column: str, sep: str, names: list[str]) -> DataFrame:
    """Parts by separator (the last name takes the rest), trimmed; missing parts are null and set ``clean_failed``."""
    quoted = re.sub(r"([\\.^$|?*+()\[\]{}])", r"\\\1", sep)
    parts = F.split(F.col(column), quoted, len(names))
    df = df.withColumns({n: F.trim(F.get(parts, i)) for i, n in enumerate(names)})
    return df.withColumn("clean_failed", F.coalesce(F.size(parts) < len(names), F.lit(True)))


def by_regex(df: DataFrame, column: str, pattern: str) -> DataFrame:
    """Named groups as columns (null where the pattern doesn't match, and then ``clean_failed``)."""
    names = list(re.compile(pattern.replace("(?<", "(?P<").replace("(?P<=", "(?<=").replace("(?P<!", "(?<!")).groupindex.items())
    plain = re.sub(r"\(\?P?<[A-Za-z_]\w*>", "(", pattern)
    hit = F.col(column).rlike(plain)
    df = df.withColumns({n: F.when(hit, F.regexp_extract(F.col(column), plain, i)) for n, i in names})
    return df.withColumn("clean_failed", ~F.coalesce(hit, F.lit(False)))


def json_path(c: Column, path: str) -> Column:
    """A dotted path or JSONPath of a JSON text."""
    return F.get_json_object(c, path if path.startswith("$") else "$." + path)


def first_path(c: Column, paths: list[str]) -> Column:
    return F.coalesce(*[json_path(c, p) for p in paths])


def jmes(expression: str):
    """A small JMESPath as a vectorised function over JSON texts: fields, [n], [*] projections, | and || alternatives, length(@) and join('s', @)."""
    import json

    steps = [[s for s in re.findall(r"[\w\-]+|\[\*\]|\[-?\d+\]", alt)] for alt in re.split(r"\s*\|\|\s*", re.sub(r"\s*\|\s*(length\(@\)|join\('[^']*', *@\))\s*$", "", expression))]
    found = re.search(r"\|\s*(length\(@\)|join\('([^']*)', *@\))\s*$", expression)
    after, glue = (found[1], found[2]) if found else ("", "")

    def walk(v, path):
        for i, s in enumerate(path):
            if s == "[*]":
                return [x for x in (walk(e, path[i + 1 :]) for e in v) if x is not None] if isinstance(v, list) else None
            if s.startswith("["):
                k = int(s[1:-1])
                v = v[k] if isinstance(v, list) and -len(v) <= k < len(v) else None
            else:
                v = v.get(s) if isinstance(v, dict) else None
            if v is None:
                return None
        return v

    def one(text: str | None) -> str | None:
        try:
            doc = json.loads(text) if text else None
        except ValueError:
            return None
        v = next((x for x in (walk(doc, p) for p in steps) if x is not None), None)
        if v is not None and after:
            v = len(v) if after.startswith("length") else glue.join(map(str, v))
        return None if v is None else v if isinstance(v, str) else json.dumps(v, ensure_ascii=False)

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(one)

    return run


def coerce(c: Column, declared: str, strict: bool = False) -> Column:
    """A value as its declared type: null where it can't be (``strict``: an error). Booleans read 1/0, true/false, yes/no."""
    if declared not in TYPES:
        raise ValueError(f"no type: {declared!r}")
    if declared == "bool":
        t = F.lower(F.trim(c.cast("string")))
        return F.when(t.isin("1", "true", "t", "yes", "y"), True).when(t.isin("0", "false", "f", "no", "n"), False)
    if declared in ("int", "uint"):
        c = F.regexp_replace(F.trim(c.cast("string")), r"\.\d*$", "")
    made = c.cast(TYPES[declared]) if strict else c.try_cast(TYPES[declared])
    return F.when(~F.isnan(made), made) if declared == "float" else made  # what is no number is no figure


# Records

def with_fields(df: DataFrame, fields: list[dict]) -> DataFrame:
    """Declared fields in order: {name, type, from | constant | expr, default}. Later ones may use earlier ones."""
    for f in fields:
        if "constant" in f:
            c = F.lit(f["constant"])
        elif "expr" in f:
            c = F.expr(f["expr"])
        else:
            c = F.col(f["from"]) if f["from"].split(".")[0] in df.columns else F.lit(None)
        c = coerce(c, f.get("type", "string"))
        df = df.withColumn(f["name"], F.coalesce(c, F.lit(f["default"])) if "default" in f else c)
    return df


def declared_only(df: DataFrame, fields: dict[str, str], allow_missing: bool = True) -> DataFrame:
    """Only declared fields, coerced; undeclared ones are dropped, missing ones are null (or an error)."""
    if not allow_missing and (gone := [f for f in fields if f not in df.columns]):
        raise KeyError(f"missing: {gone}")
    return df.select(*[coerce(F.col(n) if n in df.columns else F.lit(None), t).alias(n) for n, t in fields.items()])


def time_series_record(at: Column, metrics: dict[str, Column], dimensions: dict[str, Column]) -> Column:
    """time (s), dimensions (texts), metrics (doubles; null ones left out)."""
    m = F.create_map(*[x for k, v in metrics.items() for x in (F.lit(k), v.try_cast("double"))])
    d = F.create_map(*[x for k, v in dimensions.items() for x in (F.lit(k), v.cast("string"))])
    return F.struct(at.cast("long").alias("time"), d.alias("dimensions"), F.map_filter(m, lambda _, v: v.isNotNull()).alias("metrics"))


def valid_record(time: Column, metrics: Column, dimensions: Column, lenient: bool = False) -> Column:
    """Whether a record has a time, metrics and dimensions; logs (``lenient``) need the time alone."""
    full = time.isNotNull() & (time > 0)
    return full if lenient else full & F.coalesce(F.size(metrics) > 0, F.lit(False)) & F.coalesce(F.size(dimensions) > 0, F.lit(False))


def as_texts(m: Column) -> Column:
    return F.transform_values(m, lambda _, v: v.cast("string"))


def as_numbers(m: Column) -> Column:
    """Metric texts as doubles; true and false are 1 and 0, what is no number is dropped."""
    n = F.transform_values(m, lambda _, v: F.when(F.lower(v.cast("string")) == "true", 1.0).when(F.lower(v.cast("string")) == "false", 0.0).otherwise(v.try_cast("double")))
    return F.map_filter(n, lambda _, v: v.isNotNull())


def without_empty(m: Column) -> Column:
    return F.map_filter(m, lambda _, v: v.isNotNull() & (v.cast("string") != ""))


def fission(df: DataFrame, arrays: list[str], how: str = "product") -> DataFrame:
    """One row per combination of the arrays' elements, or ('zip') per place; empty arrays leave the row with nulls."""
    if how == "zip":
        return df.withColumn("_z", F.explode_outer(F.arrays_zip(*arrays))).withColumns({a: F.col(f"_z.{a}") for a in arrays}).drop("_z")
    return reduce(lambda d, a: d.withColumn(a, F.explode_outer(a)), arrays, df)


def payload_items(df: DataFrame, items: str, index: str = "index") -> DataFrame:
    """A list payload as rows, each with its place."""
    return df.select("*", F.posexplode_outer(items).alias(index, "item")).drop(items)


def flat_batch(df: DataFrame, items: str, envelope: list[str]) -> DataFrame:
    """items[] under an envelope: one row per item with the item's fields and those of the envelope (the item's win)."""
    rows = df.select(*envelope, F.explode(items).alias("_i"))
    inner = rows.schema["_i"].dataType.fieldNames()
    return rows.select(*[c for c in envelope if c not in inner], "_i.*")


def timeseries_items(df: DataFrame, items: str = "data") -> DataFrame:
    """Custom time series: data[] of {metrics, dimension, target, timestamp}, target and timestamp inherited from the record."""
    rows = df.select(F.col("target").alias("_t"), F.col("timestamp").alias("_ts"), F.explode(items).alias("i"))
    dims = F.map_concat(F.coalesce("i.dimension", F.create_map().cast("map<string,string>")), F.create_map(F.lit("target"), F.coalesce("i.target", "_t")))
    return rows.select(F.coalesce("i.timestamp", "_ts").alias("time"), dims.alias("dimensions"), F.col("i.metrics").alias("metrics"))


def inject_groups(df: DataFrame, groups: str, dimensions: str) -> DataFrame:
    """One row per group with its fields among the dimensions (the group's win); no group leaves the row as it is."""
    g = F.coalesce(F.col("_g"), F.create_map().cast("map<string,string>"))
    rest = F.map_filter(F.col(dimensions), lambda k, _: ~F.map_contains_key(g, k))
    return df.withColumn("_g", F.explode_outer(groups)).withColumn(dimensions, F.map_concat(rest, g)).drop("_g", groups)


def cut_metrics(df: DataFrame, metrics: str) -> DataFrame:
    """Wide to long: one row per metric."""
    return df.select(*[c for c in df.columns if c != metrics], F.explode(metrics).alias("metric", "value"))


def unpivot_columns(df: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    return df.unpivot(keys, columns, "metric", "value")


def rounded_time(c: Column, precision_ms: int) -> Column:
    return round_ms(c, precision_ms)


def time_unit(c: Column, source: str, target: str) -> Column:
    """Between s, ms, us and ns; coarser units cut off."""
    size = {"s": 1, "ms": 1000, "us": 1_000_000, "ns": 1_000_000_000}
    a, b = size[source], size[target]
    return c * (b // a) if b >= a else F.floor(c / (a // b)).cast("long")


def with_aliases(m: Column, aliases: dict[str, str], defaults: dict[str, str] | None = None) -> Column:
    """Aliases beside the original names (which stay); then defaults for what is missing."""
    more = F.map_filter(F.create_map(*[x for k, v in aliases.items() for x in (F.lit(v), F.try_element_at(m, F.lit(k)))]), lambda _, v: v.isNotNull())
    out = F.map_concat(F.map_filter(m, lambda k, _: ~F.map_contains_key(more, k)), more)
    if not defaults:
        return out
    base = F.create_map(*[F.lit(x) for k, v in defaults.items() for x in (k, v)])
    return F.map_concat(F.map_filter(base, lambda k, _: ~F.map_contains_key(out, k)), out)


# Enrichment

def fill_by_lookup(df: DataFrame, hosts: DataFrame, on: list[str], values: str, out: str) -> DataFrame:
    """One row per value of the host's list (records of unknown hosts stay, with null). Whether the host table is broadcast is left to the optimiser, which goes by its size in bytes."""
    side = hosts.select(*on, F.col(values).alias("_values"))
    return df.join(side, on, "left").withColumn(out, F.explode_outer("_values")).drop("_values")


def fill_level(df: DataFrame, hosts: DataFrame, on: list[str], topology: str, biz: str, out: str) -> DataFrame:
    """Levels of the host's topology that belong to the record's business; of a level given twice the first counts."""
    side = hosts.select(*on, F.col(topology).alias("_t"))
    mine = F.filter("_t", lambda x: x["biz"] == F.col(biz))
    merged = F.aggregate(mine, F.create_map().cast("map<string,string>"), lambda acc, x: F.map_concat(acc, F.map_filter(x["levels"], lambda k, _: ~F.map_contains_key(acc, k))))
    return df.join(side, on, "left").withColumn(out, merged).drop("_t")


def cut_by_level(df: DataFrame, levels: str) -> DataFrame:
    """One row per level of a topology map."""
    return df.select(*[c for c in df.columns if c != levels], F.explode(levels).alias("level_name", "level_id"))


def cut_by_meta(df: DataFrame, meta: DataFrame, on: list[str]) -> DataFrame:
    """One row per entry of a lookup; records without any are an error."""
    out = df.join(meta.withColumn("_hit", F.lit(True)), on, "left")
    checked = F.when(F.col("_hit").isNull(), F.raise_error(F.lit("a record without meta data"))).otherwise(F.lit(True))
    return out.withColumn("_hit", checked).where("_hit").drop("_hit")


def exporter_samples(df: DataFrame, name: str, white: list[str] | None = None, black: list[str] | None = None) -> DataFrame:
    """Scraped samples by regular expressions over their names."""
    if white:
        df = df.where(F.col(name).rlike("^(?:" + "|".join(white) + ")$"))
    return df.where(~F.col(name).rlike("^(?:" + "|".join(black) + ")$")) if black else df


# Events, rules, relabelling

def clean_events(df: DataFrame, content: list[str], dimensions: list[str], common: dict[str, str]) -> DataFrame:
    """Events of {event_name, event{...}, dimension{...}, target, timestamp}: fields outside the white lists are dropped, common dimensions added, timestamps must be in ms."""
    keep = lambda c, names: F.map_filter(c, lambda k, _: k.isin(names))
    fixed = F.create_map(*[F.lit(x) for k, v in common.items() for x in (k, v)]) if common else F.create_map().cast("map<string,string>")
    dims = F.map_concat(F.map_filter(keep(F.col("dimension"), dimensions), lambda k, _: ~k.isin(list(common))), fixed)
    return df.where(F.length(F.col("timestamp").cast("string")) == 13).select("event_name", keep(F.col("event"), content).alias("event"), dims.alias("dimension"), "target", "timestamp")


def match_alerts(df: DataFrame, rules: list[dict], default: str | None = None) -> DataFrame:
    """Adds ``alert_name``: that of the first rule whose conditions {key, method eq|neq|reg, value} on the JSON column all hold."""
    test = {"eq": lambda c, v: c.isin(v), "neq": lambda c, v: ~F.coalesce(c.isin(v), F.lit(False)), "reg": lambda c, v: c.rlike("|".join(v))}
    name: Column = F.lit(default)
    for r in reversed(rules):
        hit = reduce(lambda a, b: a & b, [F.coalesce(test[c["method"]](json_path(F.col("raw"), c["key"]), c["value"]), F.lit(False)) for c in r["conditions"]], F.lit(True))
        name = F.when(hit, r["name"]).otherwise(name)
    return df.withColumn("alert_name", name)


def keyword_events(df: DataFrame, column: str, filters: list[str], rules: dict[str, str]) -> DataFrame:
    """Log lines that match one of the filters, once per rule that matches: ``rule`` and ``dimensions`` (its named groups)."""
    for_any = F.col(column).rlike("|".join(filters)) if filters else F.lit(True)
    found = []
    for name, pattern in rules.items():
        plain = re.sub(r"\(\?P?<[A-Za-z_]\w*>", "(", pattern)
        groups = re.compile(re.sub(r"\(\?<([A-Za-z_]\w*)>", r"(?P<\1>", pattern)).groupindex
        dims = F.create_map(*[x for g, i in groups.items() for x in (F.lit(g), F.regexp_extract(F.col(column), plain, i))]) if groups else F.create_map().cast("map<string,string>")
        found.append(F.when(F.col(column).rlike(plain), F.struct(F.lit(name).alias("rule"), dims.alias("dimensions"))))
    return df.where(for_any).select("*", F.inline(F.array_compact(F.array(*found))))


def count_keywords(events: DataFrame, at: str, log: str, period_ms: int) -> DataFrame:
    """Per period, rule and dimensions: how many events, and the last log."""
    key = F.to_json(F.array_sort(F.map_entries("dimensions")))
    start = F.col(at) - F.pmod(F.col(at), F.lit(period_ms))
    return events.groupBy("rule", key.alias("dims"), start.alias("period")).agg(F.count(F.lit(1)).alias("n"), F.max_by(log, at).alias("last_log"))


def relabel(df: DataFrame, configs: list[dict], labels: str = "labels") -> DataFrame:
    """Scrape relabelling in order: {source_labels, separator, regex, modulus, target_label, replacement, action}. Samples left without labels or without a name are dropped."""
    for c in configs:
        m = F.col(labels)
        pattern = "^(?:" + c.get("regex", "(.*)") + ")$"
        source = F.concat_ws(c.get("separator", ";"), *[F.coalesce(F.try_element_at(m, F.lit(s)), F.lit("")) for s in c.get("source_labels", [])])
        target, action = c.get("target_label", ""), c.get("action", "replace")
        put = lambda v, t=target, m=m: F.map_concat(F.map_filter(m, lambda k, _: k != t), F.create_map(F.lit(t), v))
        if action in ("keep", "drop"):
            df = df.where(source.rlike(pattern) if action == "keep" else ~source.rlike(pattern))
        elif action in ("labeldrop", "labelkeep"):
            df = df.withColumn(labels, F.map_filter(m, lambda k, _: k.rlike(pattern) if action == "labelkeep" else ~k.rlike(pattern)))  # noqa: B023
        elif action == "labelmap":
            to = c.get("replacement", "$1")
            hit = F.map_filter(m, lambda k, _: k.rlike(pattern))  # noqa: B023
            df = df.withColumn(labels, F.map_concat(F.map_filter(m, lambda k, _: ~k.rlike(pattern)), F.transform_keys(hit, lambda k, _: F.regexp_replace(k, pattern, to)), hit))  # noqa: B023
        elif action == "hashmod":
            df = df.withColumn(labels, put(F.pmod(F.conv(F.substring(F.md5(source), 17, 16), 16, 10).cast("decimal(20,0)"), F.lit(c["modulus"]).cast("decimal(20,0)")).cast("long").cast("string")))
        elif action in ("lowercase", "uppercase"):
            df = df.withColumn(labels, put(F.lower(source) if action == "lowercase" else F.upper(source)))
        else:
            made = F.regexp_replace(source, pattern, c.get("replacement", "$1"))
            df = df.withColumn(labels, F.when(source.rlike(pattern), F.when(made != "", put(made)).otherwise(F.map_filter(m, lambda k, _: k != target))).otherwise(m))  # noqa: B023
    return df.where((F.size(labels) > 0) & F.try_element_at(labels, F.lit("__name__")).isNotNull())


def series_delta(df: DataFrame, keys: list[str], at: str, value: str, rate_name: str | None = None) -> DataFrame:
    """Difference to the series' previous sample (the first has none and is dropped; resets show as negative); with ``rate_name`` per second, under that metric name."""
    w = W.partitionBy(*keys).orderBy(at)
    d, t = F.col(value) - F.lag(value).over(w), F.col(at) - F.lag(at).over(w)
    out = df.withColumn("delta", d if rate_name is None else F.when(t > 0, d / t)).where("delta is not null")
    return out.withColumn("metric", F.lit(rate_name)) if rate_name else out


def discovered(df: DataFrame, metrics: str, dimensions: str, most_values: int | None = None) -> DataFrame:
    """``metric, dimension, n_values, values``: which dimensions metrics come with and their distinct values, in order (the first ``most_values``, if given; ``n_values`` counts all)."""
    rows = df.select(F.explode(F.map_keys(metrics)).alias("metric"), dimensions).select("metric", F.explode(dimensions).alias("dimension", "value")).distinct()
    told = F.array_sort(F.collect_list("value"))
    return rows.groupBy("metric", "dimension").agg(F.count(F.lit(1)).alias("n_values"), (told if most_values is None else F.slice(told, 1, most_values)).alias("values"))


def guard_cardinality(df: DataFrame, keys: list[str], at: str, most: int) -> DataFrame:
    """Records of the first ``most`` keys (by first appearance, then key); records of later keys are dropped, known keys never are."""
    first = df.groupBy(*keys).agg(F.min(at).alias("_first")).orderBy("_first", *keys).limit(most)
    return df.join(first.drop("_first"), keys, "left_semi")


def inferred_fields(df: DataFrame, column: str, fraction: float = 0.01, seed: int = 1) -> DataFrame:
    """``field, type, n`` of a sample of JSON records: the sampling reporter."""
    m = df.sample(fraction=fraction, seed=seed).select(F.explode(F.from_json(F.col(column), "map<string,string>")).alias("field", "v"))
    kind = F.when(F.col("v").try_cast("bigint").isNotNull(), "int").when(F.col("v").try_cast("double").isNotNull(), "float").when(F.lower("v").isin("true", "false"), "bool").otherwise("string")
    return m.groupBy("field", kind.alias("type")).agg(F.count(F.lit(1)).alias("n"))


def decoded(c: Column, charset: str) -> Column:
    return F.decode(c, charset)


def event_records(df: DataFrame, name: Column, at: Column, content: Column, dimensions: Column) -> DataFrame:
    """Standard events: name, time (ms), content and dimensions as texts; events without a name or time are left out."""
    rows = df.select(name.alias("event_name"), at.cast("long").alias("timestamp"), content.cast("string").alias("content"), without_empty(as_texts(dimensions)).alias("dimensions"))
    return rows.where("event_name is not null and event_name != '' and timestamp is not null")


def level_as_json(df: DataFrame, levels: str, out: str) -> DataFrame:
    """A topology map as one JSON column."""
    return df.withColumn(out, F.to_json(levels))


def split_valid(df: DataFrame, time: str, metrics: str, dimensions: str, lenient: bool = False) -> tuple[DataFrame, DataFrame]:
    """Valid records, and the rejected ones."""
    ok = F.coalesce(valid_record(F.col(time), F.col(metrics), F.col(dimensions), lenient), F.lit(False))
    return df.where(ok), df.where(~ok)


# Whole pipelines of logs

def log_pipeline(df: DataFrame, line: str, how: str, fields: dict[str, str], at: Column | None = None, separator: str = "|", pattern: str = "", sources: dict[str, str] | None = None) -> tuple[DataFrame, DataFrame]:
    """Log lines as clean records, and the rejected ones. ``how``: 'text' (the line is the field ``log``), 'json' (keys of the object), 'separator' (parts in the order of ``fields``), 'regexp' (named groups of ``pattern``).
    ``fields`` declares each field's type; ``sources`` names the key or group it comes from where that isn't its own name.

    A record is rejected if its line is null or blank, can't be parsed in that way, or (with ``at``) has no time; rejected rows are the input rows with ``reason``. Declared fields that can't be coerced are null. Columns of ``df`` with a declared field's name are replaced."""
    names = list(fields)
    parsed = df.withColumn("_row", F.struct(*[F.col(c) for c in df.columns]))
    blank = F.col(line).isNull() | (F.trim(F.col(line)) == "")
    come = {n: (sources or {}).get(n, n) for n in names}
    if how == "text":
        parsed = parsed.withColumns({"_p_log": F.col(line), "_failed": F.lit(False)})
        come = {n: "log" for n in names}
    elif how == "json":
        parsed = json_with_rest(parsed.withColumn("_l", F.col(line)), "_l", [])
        m = F.from_json(F.col("_l"), "map<string,string>")
        parsed = parsed.withColumns({f"_p_{k}": F.try_element_at(m, F.lit(k)) for k in set(come.values())}).withColumn("_failed", F.col("clean_failed"))
    elif how == "separator":
        parts = F.split(F.col(line), re.escape(separator), len(names))
        parsed = parsed.withColumns({f"_p_{come[n]}": F.nullif(F.trim(F.get(parts, i)), F.lit("")) for i, n in enumerate(names)}).withColumn("_failed", F.size(parts) < len(names))
    elif how == "regexp":
        groups = {m: i + 1 for i, m in enumerate(re.findall(r"\(\?P?<(\w+)>", pattern))}
        java = re.sub(r"\(\?P?<\w+>", "(", pattern)
        parsed = parsed.withColumns({f"_p_{k}": F.regexp_extract(F.col(line), java, groups[k]) for k in set(come.values())}).withColumn("_failed", ~F.col(line).rlike(java))
    else:
        raise ValueError(f"no way of parsing: {how!r}")
    if at is not None:
        parsed = parsed.withColumn("time", at)
    reason = F.when(blank, "blank").when(F.col("_failed"), "unparsed")
    reason = reason.when(F.col("time").isNull(), "no time") if at is not None else reason
    parsed = parsed.withColumn("_reason", reason)
    kept = [F.col(f"_row.{c}").alias(c) for c in df.columns if c not in names and not (at is not None and c == "time")]
    good = parsed.where("_reason is null").select(*kept, *([F.col("time")] if at is not None else []), *[coerce(F.col(f"_p_{come[n]}"), t).alias(n) for n, t in fields.items()])
    return good, parsed.where("_reason is not null").select("_row.*", F.col("_reason").alias("reason"))


def with_local_time(df: DataFrame, at: str, out: str = "local_time") -> DataFrame:
    """The time injector: adds when a record was cleaned (ms) where it has no time of its own."""
    return df.withColumn(out, F.coalesce(F.col(at).cast("long"), F.unix_millis(F.current_timestamp())))
