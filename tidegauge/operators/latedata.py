"""Per-period aggregates by event time that late records correct, with a cut-off: a lambda view of two layers.

The fast layer adds each batch's records to the provisional figures of their periods. The scheduled batch layer recomputes the periods that are still open
from the full log of first deliveries, replaces the provisional figures by its own, and freezes what lies past the cut-off."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegauge.session import materialise, scratch

KEYS = ["source", "period_start"]
FIGURES = ["n_first", "n_final", "n_dropped"]
_FIGURES = "source long, period_start long, " + ", ".join(f"{c} long" for c in FIGURES)
DAY_US = 86_400_000_000


@dataclass(frozen=True)
class Lateness:
    """Seconds: length of a period; how long after its end records count as in time, and as corrections; beyond, they are dropped.
    ``memory``: how long after the period's end a record can come at all (a later one isn't usable)."""

    period: int = 3600
    prompt: int = 120
    cut_off: int = 6 * 3600
    memory: int = 72 * 3600


def figures(log: DataFrame, rule: Lateness) -> DataFrame:
    """The three counts per source and period, from ``log`` (source, event_us, received_us)."""
    period = F.floor(F.col("event_us") / (rule.period * 1_000_000)).cast("long") * rule.period
    late = F.col("received_us") - (F.col("period_start") + rule.period) * 1_000_000
    return (
        log.withColumn("period_start", period).withColumn("late", late).groupBy(*KEYS).agg(
            F.count_if(F.col("late") <= rule.prompt * 1_000_000).alias("n_first"),
            F.count_if(F.col("late") <= rule.cut_off * 1_000_000).alias("n_final"),
            F.count_if(F.col("late") > rule.cut_off * 1_000_000).alias("n_dropped"),
        )
    )


@dataclass
class LambdaView:
    """``frozen``: written figures of periods no record can change any more; ``open``: those that the batch layer last made of the others;
    ``increments``: what the fast layer has written since. All are files, so a view survives the loss of an executor and costs no recomputation."""

    spark: SparkSession
    rule: Lateness = field(default_factory=Lateness)
    frozen: list[str] = field(default_factory=list)
    open: str | None = None
    increments: list[str] = field(default_factory=list)

    def _read(self, paths: list[str]) -> DataFrame:
        return self.spark.read.schema(_FIGURES).parquet(*paths) if paths else self.spark.createDataFrame([], _FIGURES)

    def add(self, batch: DataFrame) -> None:
        """Fast layer: write the figures of a batch of first deliveries as an increment."""
        path = scratch(self.spark, "increment")
        figures(batch, self.rule).write.parquet(path)
        self.increments.append(path)

    def provisional(self) -> DataFrame:
        """Figures of the open periods: those of the last batch run and the increments since."""
        parts = self._read(([self.open] if self.open else []) + self.increments)
        return parts.groupBy(*KEYS).agg(*[F.sum(c).alias(c) for c in FIGURES])

    def recompute(self, log: DataFrame, now_us: int | None, since_us: int | None) -> None:
        """Batch layer, at ``now_us``: figures of the open periods anew from the full log, which replace the provisional ones; periods past
        ``memory`` are frozen. ``since_us``: all periods that ended ``memory`` or more before it are frozen already (prunes the scan, by day if ``log`` has a column ``day``)."""
        rule, end = self.rule, F.col("period_start") + self.rule.period + self.rule.memory
        known = log
        if since_us is not None:  # an open period's records have event times after its start
            first = since_us - (rule.period + rule.memory) * 1_000_000
            known = known.where(F.col("event_us") >= first)
            if "day" in log.columns:
                known = known.where(F.col("day") >= first // DAY_US)
        anew = figures(known, rule)
        if since_us is not None:
            anew = anew.where(end * 1_000_000 >= since_us)
        anew = materialise(anew, "recomputed")
        past = F.lit(True) if now_us is None else end * 1_000_000 < now_us
        frozen, still_open = scratch(self.spark, "frozen"), scratch(self.spark, "open")
        anew.where(past).write.parquet(frozen)
        anew.where(~past).write.parquet(still_open)
        self.frozen.append(frozen)
        self.open, self.increments = still_open, []

    def view(self) -> DataFrame:
        """All periods as known so far: frozen, recomputed, and incremented since the last batch run."""
        return self._read(self.frozen).unionByName(self.provisional())

    def differing(self, other: DataFrame) -> DataFrame:
        """Periods whose provisional figures aren't those of ``other`` (figures of the same records): ``source, period_start``. None, as long as no record was counted twice or lost."""
        told = F.struct(*FIGURES)
        mine, theirs = (d.select(*KEYS, told.alias(n)) for d, n in ((self.provisional(), "mine"), (other, "theirs")))
        return mine.join(theirs, KEYS, "full").where(~F.col("mine").eqNullSafe(F.col("theirs"))).select(*KEYS)


def corrected_periods(log: DataFrame, rule: Lateness | None = None, runs: int = 3) -> DataFrame:
    """``source, period_start, n_first, n_final, n_dropped`` after all of ``log`` (source, event_us, received_us: first deliveries only) has been
    worked off: the fast layer adds ``runs`` batches by time of receipt, and after each but the last the batch layer runs. Any number of runs gives the same result.

    Rows with a null in any of the three columns belong to no period. An empty table gives an empty result. A source may have any share of the
    rows: counts are aggregated before the shuffle. The log is kept by day of event (a day in as many files as its size asks for), so a batch run reads only the days that are open."""
    spark = log.sparkSession
    rule = rule or Lateness()
    log = log.where("source is not null and event_us is not null and received_us is not null").select("source", "event_us", "received_us")
    log = log.withColumn("day", F.floor(F.col("event_us") / DAY_US).cast("int"))
    log = materialise(log.hint("rebalance", "day"), "log", by=["day"])
    cuts = log.select(F.col("received_us").cast("double").alias("r")).approxQuantile("r", [i / runs for i in range(1, runs)], 0.02) if runs > 1 else []
    view, since = LambdaView(spark, rule), None
    for now in sorted({int(c) for c in cuts}):
        view.add(_between(log, since, now))
        view.recompute(log.where(F.col("received_us") < now), now, since)
        since = now
    view.add(_between(log, since, None))
    return view.view()


def _between(log: DataFrame, since: int | None, now: int | None) -> DataFrame:
    at, new = F.col("received_us"), F.lit(True)
    if since is not None:
        new = new & (at >= since)
    return log.where(new if now is None else new & (at < now))
