"""Queries of the data-processing problems 1 to 7, with their production parameters, over whole tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegauge.functions.timeparse import instant_us, ntz_us, utc_us
from tidegauge.operators import dedup, hierarchy, intervals, latedata, outliers, regrid, timestamps
from tidegauge.queries import Registry, table
from tidegauge.session import materialise

registry = Registry()

_SPANS_US = """
    WITH t AS (
      SELECT trace_id, start_time AS s, end_time AS e FROM complex WHERE trace_id IS NOT NULL AND start_time IS NOT NULL AND end_time IS NOT NULL
    ), u AS (
      SELECT trace_id,
        CASE WHEN abs(s) >= 100000000000000000 THEN s // 1000 WHEN abs(s) >= 100000000000000 THEN s WHEN abs(s) >= 100000000000 THEN s * 1000 ELSE s * 1000000 END AS s,
        CASE WHEN abs(e) >= 100000000000000000 THEN e // 1000 WHEN abs(e) >= 100000000000000 THEN e WHEN abs(e) >= 100000000000 THEN e * 1000 ELSE e * 1000000 END AS e
      FROM t
    ), v AS (SELECT * FROM u WHERE e > s),
    w AS (SELECT *, max(e) OVER (PARTITION BY trace_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reached FROM v)
"""


def _periods(spark: SparkSession, folder: str) -> DataFrame:
    spans = table(spark, folder, "complex").select(
        "trace_id", intervals.to_us(F.col("start_time")).alias("s"), intervals.to_us(F.col("end_time")).alias("e")
    )
    return intervals.merge_periods(spans, "trace_id", "s", "e")


@registry.add("p1_found", _SPANS_US + "SELECT trace_id, reached AS gap_start, s AS gap_end FROM w WHERE s > reached")
def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    return intervals.gaps(_periods(spark, folder), "trace_id")


@registry.add(
    "p1_periods",
    _SPANS_US
    + """, x AS (SELECT *, sum(CASE WHEN reached IS NULL OR s > reached THEN 1 ELSE 0 END) OVER (PARTITION BY trace_id ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS p FROM w)
    SELECT trace_id, min(s) AS period_start, max(e) AS period_end, count(*) AS n_intervals FROM x GROUP BY trace_id, p""",
)
def p1_periods(spark: SparkSession, folder: str) -> DataFrame:
    return intervals.busy_periods(_periods(spark, folder), "trace_id")


_TREE = """
    WITH RECURSIVE n AS (
      SELECT trace_id AS grp, lower(trim(span_id)) AS node, min(CASE WHEN regexp_matches(lower(trim(parent_span_id)), '[^0]') THEN lower(trim(parent_span_id)) END) AS parent
      FROM complex WHERE trace_id IS NOT NULL AND span_id IS NOT NULL GROUP BY 1, 2
    ), r AS (
      SELECT n.*, (n.parent IS NULL OR p.node IS NULL) AS is_root FROM n LEFT JOIN n p ON p.grp = n.grp AND p.node = n.parent
    ), d AS (
      SELECT grp, node, parent, node AS root, 0 AS depth FROM r WHERE is_root
      UNION ALL
      SELECT r.grp, r.node, r.parent, d.root, d.depth + 1 FROM r JOIN d ON r.grp = d.grp AND r.parent = d.node WHERE NOT r.is_root
    )
"""


def _tree(spark: SparkSession, folder: str) -> DataFrame:
    return hierarchy.hierarchy(table(spark, folder, "complex"), "trace_id", "span_id", "parent_span_id")


@registry.add(
    "p2_found",
    _TREE
    + """SELECT r.grp AS trace_id, r.node AS span_id, coalesce(d.root, '') AS root_span_id, CAST(coalesce(d.depth, -1) AS BIGINT) AS depth
    FROM r LEFT JOIN d ON r.grp = d.grp AND r.node = d.node WHERE r.parent IS NOT NULL""",
)
def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    return _tree(spark, folder).where("parent is not null").select(
        F.col("grp").alias("trace_id"), F.col("node").alias("span_id"), F.coalesce("root", F.lit("")).alias("root_span_id"), "depth"
    )


@registry.add(
    "p2_paths",
    _TREE.replace("node AS root, 0 AS depth FROM", "node AS root, 0 AS depth, node AS path FROM").replace("d.depth + 1 FROM", "d.depth + 1, d.path || '/' || r.node FROM")
    + """, a AS (SELECT x.grp, x.node, count(y.node) AS n FROM d x LEFT JOIN d y ON y.grp = x.grp AND y.root = x.root AND starts_with(y.path, x.path || '/') GROUP BY 1, 2)
    SELECT r.grp AS trace_id, r.node AS span_id, coalesce(d.path, '') AS path, CAST(coalesce(a.n, -1) AS BIGINT) AS n_descendants
    FROM r LEFT JOIN d ON r.grp = d.grp AND r.node = d.node LEFT JOIN a ON r.grp = a.grp AND r.node = a.node""",
)
def p2_paths(spark: SparkSession, folder: str) -> DataFrame:
    """Full path and number of descendants (last - first) of each span; '' and -1 on circles."""
    count = F.when(F.col("depth") >= 0, F.col("last") - F.col("first")).otherwise(F.lit(-1)).cast("long")
    return hierarchy.paths(_tree(spark, folder)).select(
        F.col("grp").alias("trace_id"), F.col("node").alias("span_id"), F.concat_ws("/", "path").alias("path"), count.alias("n_descendants")
    )


@registry.add("p3_found")
def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    """With the dictionary that is kept in the shared folder: a later run parses only what no earlier one has met."""
    return timestamps.normalise(table(spark, folder, "proc_test_data"), "rec_id", "utctime", "datetime", "timezone", timestamps.InstantDictionary.kept(spark))


def message_key() -> Column:
    return dedup.message_key(F.col("dataid"), dedup.folded(F.col("bk_agent_id")), F.col("gseindex"))


_MESSAGE = "dataid, lower(trim(bk_agent_id)), gseindex"
_KEYED = "dataid IS NOT NULL AND bk_agent_id IS NOT NULL AND gseindex IS NOT NULL"
_UTC = """coalesce(try_strptime(trim(data.utctime), ['%Y-%m-%d %H:%M:%S', '%Y-%m-%d %H:%M:%S.%g', '%Y-%m-%dT%H:%M:%SZ']),
      CASE WHEN trim(data.utctime) LIKE '____-__-__T__:__:__+00:00' THEN try_strptime(left(trim(data.utctime), 19), '%Y-%m-%dT%H:%M:%S') END)"""


@registry.add(
    "p5_found",
    f"""SELECT rec_id FROM (SELECT rec_id, row_number() OVER (PARTITION BY {_MESSAGE} ORDER BY recv_time, rec_id) AS k FROM net_test_data WHERE {_KEYED}) WHERE k > 1""",
)
def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return dedup.repeated_deliveries(table(spark, folder, "net_test_data"), message_key(), "recv_time", "rec_id")


def usable(event_us: Column, received_us: Column) -> Column:
    """``event_us`` if it is at most 10 minutes after and less than 72 hours before the time of receipt, else null."""
    ahead = event_us - received_us
    return F.when((ahead <= 600_000_000) & (ahead > -72 * 3_600_000_000), event_us)


def _cpu(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "net_test_data").select(
        "bk_host_id", ntz_us(F.col("recv_time")).alias("received_us"), F.col("data.utctime").alias("utctime"), F.col("data.cpu.total_usage").alias("total_usage")
    )
    at = usable(F.col("utc_us"), F.col("received_us"))
    return rows.withColumn("utc_us", utc_us(spark, F.col("utctime"))).select("bk_host_id", at.alias("at_us"), "total_usage")


_P6 = f"""
    WITH t AS (SELECT bk_host_id, data.cpu.total_usage AS v, recv_time AS r, {_UTC} AS u FROM net_test_data),
    s AS (SELECT DISTINCT bk_host_id, epoch_us(u) // 300000000 AS slot FROM t
      WHERE bk_host_id IS NOT NULL AND v IS NOT NULL AND NOT isnan(v) AND u <= r + INTERVAL 10 MINUTE AND u > r - INTERVAL 72 HOUR),
    g AS (SELECT *, lag(slot) OVER (PARTITION BY bk_host_id ORDER BY slot) AS before FROM s)
"""


@registry.add(
    "p6_found",
    _P6 + "SELECT bk_host_id, CAST(unnest(range(before + 1, slot)) * 300 AS BIGINT) AS slot_start FROM g WHERE slot - before BETWEEN 2 AND 288",
)
def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    series = regrid.regular_series(_cpu(spark, folder), "bk_host_id", "at_us", "total_usage")
    return series.where("filled").select(F.col("source").alias("bk_host_id"), F.col("slot").alias("slot_start"))


@registry.add("p6_series")
def p6_series(spark: SparkSession, folder: str) -> DataFrame:
    return regrid.regular_series(_cpu(spark, folder), "bk_host_id", "at_us", "total_usage").select(
        F.col("source").alias("bk_host_id"), F.col("slot").alias("slot_start"), "value", "filled"
    )


@registry.add(
    "p7_found",
    f"""
    WITH t AS (SELECT bk_host_id, recv_time AS r, {_UTC} AS u, CASE WHEN {_KEYED} THEN row_number() OVER (PARTITION BY {_MESSAGE} ORDER BY recv_time, rec_id) ELSE 1 END AS k FROM net_test_data),
    l AS (SELECT bk_host_id, epoch_us(u) // 3600000000 * 3600 AS period_start, epoch_us(r) AS r FROM t
      WHERE k = 1 AND bk_host_id IS NOT NULL AND u <= r + INTERVAL 10 MINUTE AND u > r - INTERVAL 72 HOUR)
    SELECT bk_host_id, period_start, count(*) FILTER (r <= (period_start + 3600 + 120) * 1000000) AS n_first,
      count(*) FILTER (r <= (period_start + 3600 + 21600) * 1000000) AS n_final, count(*) FILTER (r > (period_start + 3600 + 21600) * 1000000) AS n_dropped
    FROM l GROUP BY ALL HAVING n_final > n_first OR n_dropped > 0""",
)
def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    messages = table(spark, folder, "net_test_data")
    rows = messages.select(
        message_key().alias("key"), "rec_id", F.col("bk_host_id").cast("long").alias("source"), ntz_us(F.col("recv_time")).alias("received_us"),
        F.col("data.utctime").alias("utctime"))
    rows = rows.withColumn("utc_us", utc_us(spark, F.col("utctime"))).withColumn("event_us", usable(F.col("utc_us"), F.col("received_us")))
    rows = rows.withColumn("arrival", dedup.arrival(F.col("received_us"), F.col("rec_id")))
    # The identifier alone is shuffled as 128 bits; of a message's deliveries one is left map-side, by a hash aggregate.
    of_first = [F.min_by(c, "arrival").alias(c) for c in ("source", "event_us", "received_us")]
    once = rows.where("key is not null").groupBy(F.xxhash64("key"), F.xxhash64(F.lit("second"), F.reverse("key"), "key")).agg(*of_first)
    own = rows.where("key is null")
    log = once.select("source", "event_us", "received_us").unionByName(own.select("source", "event_us", "received_us"))
    changed = latedata.corrected_periods(log).where("n_final > n_first or n_dropped > 0")
    return changed.withColumnRenamed("source", "bk_host_id")


#: Of each table: the letter its sources start with, its measurement, the largest possible value, and the least width of a fence unit.
MEASURED = {"net_test_data": ("n", "data.cpu.total_usage", 100.0, 0.1), "swap_test_data": ("s", "data.mem.swap_in", 1e9, 1.0)}


def _readings(spark: SparkSession, folder: str, name: str) -> DataFrame:
    letter, value, most, least = MEASURED[name]
    v = F.col("value")
    rows = table(spark, folder, name).select(
        "rec_id", F.concat(F.lit(letter), dedup.folded(F.col("bk_agent_id"))).alias("source"), "dataid", "gseindex",
        ntz_us(F.col("recv_time")).alias("received"), F.col(value).cast("double").alias("value"),
        F.col("data.utctime").alias("utctime"), F.col("data.datetime").alias("local"), F.col("data.timezone").cast("string").alias("zone"),
    ).where(v.isNotNull())
    received = F.col("received")
    rows = rows.withColumn("utc_us", utc_us(spark, F.col("utctime"))).withColumn("told", usable(F.col("utc_us"), received))
    # Only where the UTC text is of no use is the local one read, and the time of receipt where neither is.
    local = F.when(F.col("told").isNull(), instant_us(spark, F.col("local"), F.col("zone"), named_zones=False))
    at = F.coalesce("told", usable(local, received), "received")
    # Within a source a message is told by the rest of its key; a row with a null key part is a message of its own.
    message = F.coalesce(F.concat_ws(":", F.col("dataid").cast("string"), F.col("gseindex").cast("string")), F.lit(""))
    whole = F.col("dataid").isNotNull() & F.col("gseindex").isNotNull()
    message = F.when(whole, message).otherwise(F.concat(F.lit("#"), F.col("rec_id").cast("string")))
    possible = ~F.isnan(v) & v.between(0.0, most)
    return rows.select("source", F.col("rec_id").alias("id"), message.alias("message"), "received", at.alias("at"), "value",
        possible.alias("possible"), F.lit(least).alias("least"), F.lit(name).alias("source_table"))


@registry.add("p4_found")
def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    """A message's deliveries are one reading (the earliest counts); what is found of it is reported for all of them."""
    both = _readings(spark, folder, "net_test_data").unionByName(_readings(spark, folder, "swap_test_data"))
    impossible = both.where(~F.col("possible")).select("source_table", F.col("id").alias("rec_id"))
    found = outliers.implausible(both.drop("source_table")).where("reason is not null")
    names = F.create_map(*[F.lit(x) for name, (letter, *_) in MEASURED.items() for x in (letter, name)])
    found = found.select(F.element_at(names, F.substring("source", 1, 1)).alias("source_table"), F.col("id").alias("rec_id"))
    return impossible.unionByName(found)
