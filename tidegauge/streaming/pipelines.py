"""The operators on streams: windows, sessions, triggers, deduplication, enrichment, sinks with checkpoints."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidegauge.operators.dedup import IdentifierIndex, first_deliveries
from tidegauge.operators.latedata import LambdaView
from tidegauge.session import exists, scratch


def windowed(stream: DataFrame, at: str, dims: list[str], aggregates: list[Column], window: str, slide: str | None = None, lateness: str = "10 minutes") -> DataFrame:
    """Aggregates per event-time window; records later than the watermark are dropped and their state is freed."""
    w = F.window(at, window, slide) if slide else F.window(at, window)
    out = stream.withWatermark(at, lateness).groupBy(*dims, w.alias("w")).agg(*aggregates)
    return out.select(*dims, F.col("w.start").alias("start"), F.col("w.end").alias("end"), *[c for c in out.columns if c not in (*dims, "w")])


def sessions(stream: DataFrame, at: str, key: str, gap: str, lateness: str = "10 minutes") -> DataFrame:
    """Session windows per key, extended by each arrival."""
    out = stream.withWatermark(at, lateness).groupBy(key, F.session_window(at, gap).alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return out.select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def traces(stream: DataFrame, at: str, no_data: str = "1 minute", lateness: str = "10 minutes", most_spans: int = 100_000) -> DataFrame:
    """Per trace and session: spans, errors and time range; ``overflow`` marks traces of more than ``most_spans`` spans (all are counted)."""
    out = stream.withWatermark(at, lateness).groupBy("trace_id", F.session_window(at, no_data).alias("w")).agg(
        F.count(F.lit(1)).alias("span_count"), F.count_if(F.col("status.code") == 2).alias("error_count"), F.min("start_time").alias("min_start_time"), F.max("end_time").alias("max_end_time"))
    return out.select("trace_id", "span_count", "error_count", "min_start_time", "max_end_time", (F.col("span_count") > most_spans).alias("overflow"))


def deduplicated(stream: DataFrame, at: str, keys: list[str], lateness: str = "10 minutes") -> DataFrame:
    """One copy of each key within the watermark."""
    return stream.withWatermark(at, lateness).dropDuplicatesWithinWatermark(keys)


def deduplicating_batches(index: IdentifierIndex, key: Column, received: str, row_id: str, sink: Callable[[DataFrame, int], None], compact_every: int = 16) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that passes on, of each micro-batch, the first deliveries that no earlier batch had (an index without time limit)."""

    def each(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        path = scratch(spark, "novel")
        index.novel(first_deliveries(batch, key, received, row_id)).write.parquet(path)
        novel = spark.read.parquet(path)
        keyless = batch.where(key.isNull())
        kept = batch.join(novel.select(F.col("kept").alias(row_id)), row_id, "left_semi")
        sink(kept.unionByName(keyless), batch_id)
        index.add(novel)
        if len(index.runs) >= compact_every:
            index.compact()

    return each


def lambda_batches(view: LambdaView, log_path: str, recompute_every: int = 10) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function for the lambda view: the batch (source, event_us, received_us) goes to the log and, as increments, to the provisional figures; every so many batches the
    open periods are recomputed from the log."""

    def each(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{log_path}/batch={batch_id}")
        spark = batch.sparkSession
        view.add(spark.read.parquet(f"{log_path}/batch={batch_id}").select("source", "event_us", "received_us"))
        if (batch_id + 1) % recompute_every == 0:
            log = spark.read.parquet(log_path).select("source", "event_us", "received_us")
            now = log.agg(F.max("received_us")).first()[0]
            since = getattr(each, "since", None)
            view.recompute(log, now, since)
            each.since = now

    return each


def triggers(outcomes: DataFrame, key: str, at: str, config: dict, unit_s: int = 60, record: str | None = None, spread_s: int | None = None) -> DataFrame:
    """N-of-M on a stream of ``key, at (s), anomalous``: ``key, at, triggered, anomalies``. Of a micro-batch all records are entered first and then judged by event time, so their order doesn't
    matter; a time given twice counts as last written; times that no window reaches any more are forgotten.

    ``record`` names a column that tells records of one time apart: each is counted and judged, and only one given twice counts as last written. ``spread_s`` spreads a key over tasks by buckets of
    that many seconds (a window at least), into which records go whose windows reach there; a bucket's records stay in the checkpoint, so it is for streams that end."""
    span = unit_s * config["check_window"] - 1
    width = max(spread_s, span + 1) if spread_s else 0
    told = [at, record] if record else [at]

    def judge(name: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        known: dict[tuple, bool] = {}
        if state.exists:
            *what, flags = state.get
            known = dict(zip(zip(*what, strict=True), flags, strict=True))
        new: set[tuple] = set()
        for pdf in batches:
            for t, *rest, a in zip(*(pdf[c].tolist() for c in told), pdf["anomalous"], strict=True):
                x = (int(t), *rest)
                known[x] = bool(a)
                if not width or x[0] // width == name[1]:
                    new.add(x)
        judged = sorted(new)
        times = np.array([x[0] for x in judged], np.int64)
        bad = np.sort(np.array([x[0] for x, a in known.items() if a], np.int64))
        n = np.searchsorted(bad, times, "right") - np.searchsorted(bad, times - span, "left")
        rows = [(name[0], x[0], bool(known[x] and k >= config["count"]), k) for x, k in zip(judged, n.tolist(), strict=True)]
        newest = max(x[0] for x in known)
        kept = {x: a for x, a in known.items() if width or x[0] >= newest - 2 * span}
        state.update((*map(list, zip(*kept, strict=True)), list(kept.values())))
        yield pd.DataFrame(rows, columns=[key, at, "triggered", "anomalies"])

    kinds = {c: outcomes.schema[c].dataType.simpleString() for c in (key, *told)}
    parts = [key]
    if width:
        reached = [F.floor((F.col(at) + s) / width).cast("long") for s in (0, span)]
        outcomes, parts = outcomes.withColumn("_bucket", F.explode(F.array_distinct(F.array(*reached)))), [key, "_bucket"]
    kept_as = "times array<bigint>, " + (f"records array<{kinds[record]}>, " if record else "") + "flags array<boolean>"
    return outcomes.groupBy(*parts).applyInPandasWithState(judge, f"{key} {kinds[key]}, {at} long, triggered boolean, anomalies long", kept_as, "append", GroupStateTimeout.NoTimeout)


def deltas(stream: DataFrame, key: str, at: str, value: str) -> DataFrame:
    """Difference of each sample to the one before it in its series, across micro-batches; the first has none."""

    def step(name: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last: Any = state.get[0] if state.exists else None
        rows = []
        for t, v in sorted((t, v) for pdf in batches for t, v in zip(pdf[at], pdf[value], strict=True)):
            if last is not None:
                rows.append((name[0], t, v - last))
            last = float(v)
        state.update((last,))
        yield pd.DataFrame(rows, columns=[key, at, "delta"])

    kind, time = (stream.schema[c].dataType.simpleString() for c in (key, at))
    return stream.groupBy(key).applyInPandasWithState(step, f"{key} {kind}, {at} {time}, delta double", "last double", "append", GroupStateTimeout.NoTimeout)


def start(out: DataFrame, sink: Callable[[DataFrame, int], None] | str, checkpoint: str, mode: str = "append", trigger: str | None = None) -> StreamingQuery:
    """Start a stream into a foreachBatch function, a table of parquet files, or 'memory:<name>'."""
    writer = out.writeStream.outputMode(mode).option("checkpointLocation", checkpoint)
    writer = writer.trigger(processingTime=trigger) if trigger else writer.trigger(availableNow=True)
    if callable(sink):
        return writer.foreachBatch(sink).start()
    if sink.startswith("memory:"):
        return writer.format("memory").queryName(sink.removeprefix("memory:")).start()
    return writer.format("parquet").option("path", sink).start()


def fan_out(*sinks: Callable[[DataFrame, int], None]) -> Callable[[DataFrame, int], None]:
    """Several sinks for one stream: the batch is kept while all of them take it."""

    def each(batch: DataFrame, batch_id: int) -> None:
        batch.persist()
        try:
            for s in sinks:
                s(batch, batch_id)
        finally:
            batch.unpersist()

    return each


def chain(*steps: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame], DataFrame]:
    """Processors one after the other."""

    def run(df: DataFrame) -> DataFrame:
        for s in steps:
            df = s(df)
        return df

    return run


def pipeline(nodes: dict[str, Callable[..., DataFrame]], edges: dict[str, list[str]], inputs: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """A graph of processors: ``edges`` names the inputs of each node. A circle is an error."""
    done = dict(inputs)
    left = [n for n in nodes if n not in done]
    while left:
        ready = [n for n in left if all(i in done for i in edges.get(n, []))]
        if not ready:
            raise ValueError(f"a circle or a missing input among {left}")
        for n in ready:
            done[n] = nodes[n](*[done[i] for i in edges.get(n, [])])
        left = [n for n in left if n not in done]
    return done


def terminating_pods(stream: DataFrame, pod: str, at: str, deleting: str, limit_s: int = 600) -> DataFrame:
    """``pod, at, state`` whenever it changes: 'terminating' while a pod is being deleted, 'stuck' once that takes longer than ``limit_s``, 'recovered' if the deletion is withdrawn. What is known
    of a pod lives in the stream's checkpoint, so a restart goes on where it was; only pods being deleted have state."""

    def step(name: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        since, last = state.get if state.exists else (None, "running")
        rows = []
        for t, d in sorted((int(t), bool(d)) for pdf in batches for t, d in zip(pdf[at], pdf[deleting], strict=True)):
            since = (t if since is None else since) if d else None
            now = ("stuck" if t - since >= limit_s else "terminating") if d else ("recovered" if last in ("terminating", "stuck") else "running")
            if now != last and now != "running":
                rows.append((name[0], t, now))
            last = now
        if since is None:
            if state.exists:
                state.remove()
        else:
            state.update((since, last))
        yield pd.DataFrame(rows, columns=[pod, at, "state"])

    kind = stream.schema[pod].dataType.simpleString()
    return stream.groupBy(pod).applyInPandasWithState(step, f"{pod} {kind}, {at} long, state string", "since long, last string", "append", GroupStateTimeout.NoTimeout)


def _ddl(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)


def late_spans(history_path: str, sink: Callable[[DataFrame, int], None]) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function for traces: of each batch, all spans known of the traces it touches go to ``sink`` (which sums them up anew), then the batch joins the history."""
    from tidegauge.operators.topology import merged_traces

    def each(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        earlier = exists(spark, history_path)  # a batch that is repeated may find its own rows there
        history = spark.read.schema(f"{_ddl(batch)}, batch int").parquet(history_path).where(F.col("batch") < batch_id).drop("batch") if earlier else spark.createDataFrame([], batch.schema)
        sink(merged_traces(history, batch), batch_id)
        batch.write.mode("overwrite").parquet(f"{history_path}/batch={batch_id}")

    return each
