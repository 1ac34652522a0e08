"""Impossible, stuck and spiking measurements, judged per source against what that source normally shows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidegauge.operators.dedup import arrival, arrived_id, arrived_us
from tidegauge.session import materialise

#: Fences lie this many interquartile ranges outside the quartiles.
FENCE = 3.0
#: A run of as many equal readings is stuck; an excursion of more than BURST readings is a level, not a spike.
STUCK, BURST = 8, 6
#: Excursions that make up more than this share of a source's readings are a level it returns to (BURST readings are always few).
FEW = 0.10
#: An hour of the day counts as a context of its own from as many readings on.
HOUR_READINGS = 24
#: Rank error of the sketches: about 1 / SKETCH.
SKETCH = 400
#: Width of the time buckets that part a source's readings into tasks.
BUCKET_US = 6 * 3600 * 1_000_000
#: A change between neighbouring readings is implausible this many interquartile ranges above the upper quartile of the source's own changes per minute.
RATE_FENCE = 1.5
#: Readings nearer than this count as so far apart.
LEAST_STEP_US = 60_000_000


def _stitched(pieces: DataFrame, token: str) -> DataFrame:
    """``source, _b, _r`` of the first and last runs of the time buckets, with ``whole`` (readings) and ``jump`` (largest) of the run that they are
    part of across buckets. A window over at most two rows per bucket and source."""
    along = W.partitionBy("source").orderBy("_b", "_r")
    edge = pieces.where("is_first or is_last")
    goes_on = F.coalesce(F.lag(token).over(along) == F.col(token), F.lit(False)) & F.col("is_first")
    island = edge.withColumn("_i", F.sum(F.when(goes_on, 0).otherwise(1)).over(along.rowsBetween(W.unboundedPreceding, 0)))
    of = W.partitionBy("source", "_i")
    return island.select("source", "_b", "_r", F.sum("n").over(of).alias("whole"), F.max("jump").over(of).alias("whole_jump"))


def _with_whole(pieces: DataFrame, token: str) -> DataFrame:
    joined = pieces.join(_stitched(pieces, token), ["source", "_b", "_r"], "left")
    return joined.withColumn("n", F.coalesce("whole", "n")).withColumn("jump", F.coalesce("whole_jump", "jump")).drop("whole", "whole_jump")


def _quartiles(sketch: Column) -> list[Column]:
    return [F.kll_sketch_get_quantile_double(sketch, F.lit(q)) for q in (0.25, 0.5, 0.75)]


def _fences(q1: Column, q2: Column, q3: Column, least: Column) -> tuple[Column, Column]:
    width = F.greatest(q3 - q1, F.abs(q2) * 0.02, least)
    return q1 - FENCE * width, q3 + FENCE * width


def normal_ranges(readings: DataFrame) -> DataFrame:
    """One row per source with its fences and those of its hours of day (a map), from quantile sketches of the plausible values: sketches of the
    hours are built map-side and merged across partitions, the source's own is merged from those of its hours."""
    hours = readings.where("possible").groupBy("source", "hour", "least").agg(
        F.kll_sketch_agg_double("value", F.lit(SKETCH)).alias("sketch"), F.count(F.lit(1)).alias("n"))
    h_low, h_high = _fences(*_quartiles(F.col("sketch")), F.col("least"))
    context = F.when(F.col("n") >= HOUR_READINGS, F.struct("hour", F.struct(h_low.alias("low"), h_high.alias("high"))))
    merged = hours.withColumn("context", context).groupBy("source", "least").agg(
        F.kll_merge_agg_double("sketch", F.lit(SKETCH)).alias("sketch"), F.sum("n").alias("n_source"), F.collect_list("context").alias("hours"))
    q = _quartiles(F.col("sketch"))
    low, high = _fences(*q, F.col("least"))
    width = (high - q[2]) / FENCE
    return merged.select(
        "source", "least", "n_source", q[0].alias("q1"), q[1].alias("q2"), q[2].alias("q3"), low.alias("low"), high.alias("high"), width.alias("width"),
        F.map_from_entries("hours").alias("hours"))


def _hour(at: Column) -> Column:
    return F.pmod(F.floor(at / 3_600_000_000), F.lit(24)).cast("int")


def _per_minute(value: Column, at: Column, other: Column) -> Column:
    """Change from or to another reading (a struct of value and at), per minute."""
    return F.abs(value - other["value"]) * 60e6 / F.greatest(F.abs(at - other["at"]), F.lit(LEAST_STEP_US))


def _steps(once: DataFrame, ranges: DataFrame) -> DataFrame:
    """Each reading beside its neighbours in the same source and time bucket: ``far`` (outside the fences both of the source and of the hour, if that is a context), the numbers of its runs of
    equal values (``r_value``) and of equal farness (``r_far``), whether a neighbour is equal, and the change per minute from the possible reading before. One sort serves all windows."""
    outside = lambda low, high: (F.col("value") < low) | (F.col("value") > high)
    context = F.try_element_at("hours", F.col("hour"))
    far = F.col("possible") & outside(F.col("low"), F.col("high")) & F.coalesce(outside(context["low"], context["high"]), F.lit(True))
    rows = once.join(ranges, "source").withColumn("far", far).withColumn("_b", F.floor(F.col("at") / BUCKET_US).cast("long"))
    rows = rows.select("source", "_b", "id", "message", "at", "received", "value", "possible", "far", (F.col("possible") & (F.col("value") != F.col("q2"))).alias("off"), "least")
    inside = W.partitionBy("source", "_b").orderBy("at", "received", "id")
    so_far, earlier = inside.rowsBetween(W.unboundedPreceding, 0), inside.rowsBetween(W.unboundedPreceding, -1)
    rows = rows.withColumns({
        "same": F.lag("value").over(inside) == F.col("value"), "same_next": F.coalesce(F.lead("value").over(inside) == F.col("value"), F.lit(False)),
        "same_far": F.lag("far").over(inside) == F.col("far"), "ends": F.lead("id").over(inside).isNull(),
        "before": F.last(F.when(F.col("possible"), F.struct("value", "at")), ignorenulls=True).over(earlier)})
    rows = rows.withColumns({
        "r_value": F.sum(F.when(F.col("same"), 0).otherwise(1)).over(so_far), "r_far": F.sum(F.when(F.col("same_far"), 0).otherwise(1)).over(so_far),
        "rate": F.when(F.col("possible"), _per_minute(F.col("value"), F.col("at"), F.col("before")))})
    rows = rows.withColumns({"n_value": F.max("r_value").over(W.partitionBy("source", "_b")), "n_far": F.max("r_far").over(W.partitionBy("source", "_b")), "rate_next": F.lead("rate").over(inside)})
    return rows.select("source", "_b", "id", "message", "at", "value", "possible", "far", "off", "least", "r_value", "r_far", "n_value", "n_far", "rate", "rate_next",
        F.coalesce("same", F.lit(False)).alias("same"), "same_next", F.col("same").isNull().alias("begins"), "ends")


def _pieces(steps: DataFrame, token: str, run: str, runs: str, picked: Column) -> DataFrame:
    """Runs within their buckets: those that ``picked`` rows are part of, and the first and last of each bucket."""
    some = steps.where(picked | F.col("begins") | F.col("ends"))
    return some.groupBy("source", "_b", F.col(run).alias("_r")).agg(
        F.first(token).alias(token), F.count(F.lit(1)).alias("n"), F.max(F.greatest("rate", "rate_next")).alias("jump"),
        F.first(F.col(run) == 1).alias("is_first"), F.first(F.col(run) == F.col(runs)).alias("is_last"))


def _border_jumps(steps: DataFrame) -> DataFrame:
    """``source, _b, enter, leave``: changes per minute over the borders of a bucket, between its first and last possible reading and the nearest in other buckets."""
    told = F.when(F.col("possible"), F.struct("value", "at"))
    ends = steps.groupBy("source", "_b").agg(F.min_by(told, F.when(F.col("possible"), F.col("at"))).alias("first"), F.max_by(told, F.when(F.col("possible"), F.col("at"))).alias("last"))
    along = W.partitionBy("source").orderBy("_b")
    before = F.last("last", ignorenulls=True).over(along.rowsBetween(W.unboundedPreceding, -1))
    borders = ends.withColumn("enter", _per_minute(F.col("first.value"), F.col("first.at"), before))
    return borders.select("source", "_b", "enter", F.lead("enter").over(along).alias("leave"))


def _changes(steps: DataFrame, borders: DataFrame) -> DataFrame:
    """``source, fastest, n_off``: the largest plausible change per minute, from a sketch of all the source's changes, within buckets and over their borders; readings beside the median."""
    q = _quartiles(F.col("sketch"))
    width = F.greatest(q[2] - q[0], q[1] * 0.02, F.col("least") * 0.01)
    # A source with a single reading has no change, and none is implausible.
    across = borders.select("source", F.lit(None).cast("double").alias("least"), F.col("enter").alias("rate"), F.lit(False).alias("off"))
    told = steps.select("source", "least", "rate", "off").unionByName(across).groupBy("source").agg(
        F.max("least").alias("least"), F.kll_sketch_agg_double("rate", F.lit(SKETCH)).alias("sketch"), F.count("rate").alias("n"), F.count_if("off").alias("n_off"))
    return told.select("source", F.when(F.col("n") > 0, q[2] + RATE_FENCE * width).alias("fastest"), "n_off")


def _reasons(steps: DataFrame, ranges: DataFrame) -> DataFrame:
    """``source, id, message, reason`` of the readings that are stuck or spikes. What lies outside the fences for longer than a burst (and
    isn't stuck) is a level of the source; a burst up to such a level, or down to it, returns to it and is no spike."""
    v = _with_whole(_pieces(steps, "value", "r_value", "n_value", F.col("same") | F.col("same_next")), "value").select("source", "_b", F.col("_r").alias("r_value"), F.col("n").alias("run_value"))
    borders = materialise(_border_jumps(steps), "borders")
    f = _pieces(steps, "far", "r_far", "n_far", F.col("far")).join(borders, ["source", "_b"], "left")
    over = lambda flag, c: F.when(F.col(flag), F.col(c))
    f = f.withColumn("jump", F.greatest("jump", over("is_first", "enter"), over("is_last", "leave")))
    f = _with_whole(f.drop("enter", "leave"), "far").where("far").select("source", "_b", F.col("_r").alias("r_far"), F.col("n").alias("run_far"), "jump")
    some = steps.where("far or same or same_next or begins or ends").select("source", "_b", "id", "message", "value", "possible", "far", "off", "r_value", "r_far")
    marked = some.join(v, ["source", "_b", "r_value"], "left").join(f, ["source", "_b", "r_far"], "left").where("far or run_value >= " + str(STUCK))
    marked = materialise(marked.withColumn("run_value", F.coalesce("run_value", F.lit(1))).withColumn("burst", F.col("far") & (F.col("run_far") <= BURST)), "marked")
    marked = marked.join(ranges.select("source", "n_source", "q1", "q2", "q3", "width"), "source")
    level = F.col("far") & ~F.col("burst") & (F.col("run_value") < STUCK)
    about = marked.groupBy("source").agg(
        F.count_if(F.col("burst") & F.col("off")).alias("n_off_burst"),
        F.max(F.when(level & (F.col("value") > F.col("q3")), F.col("value"))).alias("top"),
        F.min(F.when(level & (F.col("value") < F.col("q1")), F.col("value"))).alias("bottom"),
    ).join(_changes(steps, borders), "source")
    told = marked.where((F.col("run_value") >= STUCK) | F.col("burst")).join(about, "source")
    beyond = F.when(F.col("value") > F.col("q3"), F.col("top").isNull() | (F.col("value") > F.col("top") + F.col("width"))).otherwise(
        F.col("bottom").isNull() | (F.col("value") < F.col("bottom") - F.col("width")))
    told = told.withColumn("burst", F.col("burst") & beyond & F.coalesce(F.col("jump") > F.col("fastest"), F.lit(False)))
    bursts = told.groupBy("source").agg(F.count_if("burst").alias("n_burst"))
    few = F.col("n_burst") <= F.greatest(F.lit(BURST), F.col("n_source") * FEW)
    varies = (F.col("q3") > F.col("q1")) | (F.col("n_off") - F.col("n_off_burst") >= 3)
    reason = F.when((F.col("run_value") >= STUCK) & varies & F.col("possible"), "stuck").when(F.col("burst") & few, "spike")
    return told.join(bursts, "source").select("source", "id", "message", reason.alias("reason")).where("reason is not null")


def implausible(readings: DataFrame) -> DataFrame:
    """``source, id, reason`` ('stuck' or 'spike') of the deliveries whose reading doesn't fit its source.

    ``readings``: ``source`` (string), ``id`` (unique), ``message`` (binary or string; deliveries with the same one are one reading, of which the earliest
    ``received`` counts; must not be null), ``at`` and ``received`` (us), ``value`` (double, not null), ``possible`` (boolean: impossible values interrupt runs
    but don't count towards what is normal), ``least`` (the least width of a fence unit, one per source).

    Stuck: a run of STUCK or more equal values, if the source has other values beside single excursions. Spike: outside the fences both of the source and
    of its hour of day (where that has HOUR_READINGS), in an excursion of at most BURST readings that comes or goes at an implausible rate of change (beyond RATE_FENCE by the source's own sketch of
    changes per minute); such excursions must be at most FEW of the source's readings. Sources without a name aren't judged. An empty table gives an empty result.

    Readings are written once and then worked off in time buckets per source, whatever the source's share of the rows; across buckets travel one or two rows of each."""
    columns = ["source", "id", "message", "at", "received", "value", "possible", "least"]
    rows = materialise(readings.where("source is not null and message is not null and value is not null").select(*columns, _hour(F.col("at")).alias("hour")), "readings")
    ranges = materialise(normal_ranges(rows), "ranges")
    # Of a delivery travel its arrival, its value, and its time with whether it is possible in one number; what follows from these is computed behind the shuffle.
    packed = F.col("at") * 2 + F.col("possible").cast("int")
    number = rows.select("source", "message", "value", packed.alias("packed"), arrival(F.col("received"), F.col("id")).alias("arrival"))
    once = number.groupBy("source", "message").agg(F.min("arrival").alias("arrival"), *[F.min_by(c, "arrival").alias(c) for c in ("value", "packed")])
    at = F.shiftright("packed", 1)
    once = once.select("source", "message", "value", arrived_id(F.col("arrival")).alias("id"), arrived_us(F.col("arrival")).alias("received"),
        at.alias("at"), (F.col("packed") % 2 != 0).alias("possible"), _hour(at).alias("hour"))
    steps = materialise(_steps(once, ranges), "steps")
    found = _reasons(steps, ranges).select("source", "message", "reason")
    return rows.select("source", "id", "message").join(found, ["source", "message"]).select("source", "id", "reason")
