"""Exactly one copy of messages that were delivered at least once, by an index of identifiers that outlives the batch."""

from __future__ import annotations

import json
from collections.abc import Iterator
from decimal import Decimal
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegauge.functions.timeparse import ntz_us
from tidegauge.session import drop_path, exists, materialise, scratch

#: Identifiers of one array; the number of hash prefixes follows from it.
ARRAY_IDS = 250_000
_RUN = "prefix int, hi binary, lo binary, n long"


def message_key(*parts: Column) -> Column:
    """A message's identifier; null if any part is null. Texts are compared without case and outer blanks."""
    return F.when(reduce(lambda a, b: a & b, [p.isNotNull() for p in parts]), F.concat_ws("\x1f", *[p.cast("string") for p in parts]))


def folded(text: Column) -> Column:
    return F.lower(F.trim(text))


def _halves(key: Column) -> tuple[Column, Column]:
    """The identifier as 128 bits: two hashes of 64 bits, independent of one another by the prefix of the second."""
    return F.xxhash64(key), F.xxhash64(F.lit("second"), F.reverse(key), key)


#: What a row id is moved by, and the room it has in ``arrival``.
_ID_SHIFT, _ID_ROOM = Decimal(2**63), Decimal(10**20)


def arrival(received_us: Column, row_id: Column) -> Column:
    """Time of receipt (us; null counts as latest) and row id as one number, whose least is the earliest delivery: unlike a struct, a number can be
    aggregated by hash. ``arrived_id`` takes it apart."""
    at = F.coalesce(received_us.cast("decimal(18,0)"), F.lit(10**17).cast("decimal(18,0)"))
    return (at * F.lit(_ID_ROOM) + (row_id.cast("decimal(20,0)") + F.lit(_ID_SHIFT))).cast("decimal(38,0)")


def arrived_id(number: Column) -> Column:
    room = F.lit(_ID_ROOM)
    return (F.pmod(number, room) - F.lit(_ID_SHIFT)).cast("long")


def arrived_us(number: Column) -> Column:
    return F.floor(number / F.lit(_ID_ROOM)).cast("long")


def identified(df: DataFrame, key: Column, received: str, row_id: str) -> DataFrame:
    """``hi, lo, arrival, second``: identifier and arrival of each delivery that has a key. ``row_id`` must be a whole number."""
    hi, lo = _halves(key)
    us = ntz_us(F.col(received))
    second = F.coalesce(F.floor(us / 1_000_000).cast("long"), F.lit(2**62))
    return df.where(key.isNotNull()).select(hi.alias("hi"), lo.alias("lo"), arrival(us, F.col(row_id)).alias("arrival"), second.alias("second"))


def first_deliveries(df: DataFrame, key: Column, received: str, row_id: str) -> DataFrame:
    """The earliest delivery of each message (ties by ``row_id``): ``hi, lo, kept``. Pre-aggregated before the shuffle."""
    first = identified(df, key, received, row_id).groupBy("hi", "lo").agg(F.min("arrival").alias("arrival"))
    return first.select("hi", "lo", arrived_id(F.col("arrival")).alias("kept"))


def _find(hi: np.ndarray, lo: np.ndarray, run_hi: np.ndarray, run_lo: np.ndarray) -> np.ndarray:
    """Which of (hi, lo) are in the sorted run, by binary search."""
    found = np.zeros(len(hi), bool)
    if not len(run_hi):
        return found
    at = np.searchsorted(run_hi, hi)
    todo = np.flatnonzero(at < len(run_hi))
    while len(todo):  # one round, but for equal first halves
        same = run_hi[at[todo]] == hi[todo]
        todo = todo[same]
        found[todo] |= run_lo[at[todo]] == lo[todo]
        at[todo] += 1
        todo = todo[~found[todo] & (at[todo] < len(run_hi))]
    return found


def _search(key, batch: pa.Table, index: pa.Table) -> pa.Table:
    """Of one prefix: the rows of the batch whose identifiers are in none of the index's arrays."""
    hi, lo = (batch.column(c).to_numpy() for c in ("hi", "lo"))
    known = np.zeros(len(hi), bool)
    for a, b in zip(index.column("hi").to_pylist(), index.column("lo").to_pylist(), strict=True):
        known |= _find(hi, lo, np.frombuffer(a, np.int64), np.frombuffer(b, np.int64))
    return batch.filter(pa.array(~known))


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (prefix, hi, lo) to one pair of arrays per prefix (or more, of at most ARRAY_IDS)."""

    def arrays(prefix: int, hi: list[np.ndarray], lo: list[np.ndarray]) -> pa.RecordBatch:
        h, low = np.concatenate(hi), np.concatenate(lo)
        return pa.RecordBatch.from_arrays(
            [pa.array([prefix], pa.int32()), pa.array([h.tobytes()], pa.binary()), pa.array([low.tobytes()], pa.binary()), pa.array([len(h)], pa.int64())],
            names=["prefix", "hi", "lo", "n"],
        )

    now, hi, lo, held = None, [], [], 0
    for batch in batches:
        p, h, low = (batch.column(i).to_numpy() for i in range(3))
        edges = np.r_[0, np.flatnonzero(p[1:] != p[:-1]) + 1, len(p)] if len(p) else [0]
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            if hi and (p[a] != now or held + b - a > ARRAY_IDS):
                yield arrays(now, hi, lo)
                hi, lo, held = [], [], 0
            now = int(p[a])
            hi.append(h[a:b])
            lo.append(low[a:b])
            held += b - a
    if hi:
        yield arrays(now, hi, lo)


class IdentifierIndex:
    """Identifiers seen so far: immutable runs of sorted arrays, one pair of arrays (the halves of 128 bits) per hash prefix.

    ``novel`` searches a batch's identifiers in the arrays of their prefix by binary search; ``add`` writes the novel ones as a
    new run; ``compact`` merges the runs into one, with more prefixes if they have grown beyond what was expected. Runs are never changed, so a batch that fails half way can be repeated.
    What runs there are stands in a manifest beside them, written anew with each change, so that another session opens the index by its path and goes on."""

    def __init__(self, spark: SparkSession, expected: int, path: str | None = None):
        self.spark, self.path = spark, path or scratch(spark, "identifiers")
        self.prefixes = self._enough(expected)
        self.runs: list[str] = []
        self.version = 0
        found = [r.n for r in self._manifests().select(F.regexp_extract("path", r"manifest-(\d+)", 1).cast("int").alias("n")).collect()] if exists(spark, self.path) else []
        if found:
            self.version = max(found)
            state = json.loads(spark.read.text(f"{self.path}/manifest-{self.version:06d}").first().value)
            self.prefixes, self.runs = state["prefixes"], [f"{self.path}/{r}" for r in state["runs"]]

    @staticmethod
    def _enough(ids: int) -> int:
        return max(8, -(-ids // (ARRAY_IDS // 4)))

    def _manifests(self) -> DataFrame:
        files = self.spark.read.format("binaryFile").option("pathGlobFilter", "*.txt").option("recursiveFileLookup", "true").load(self.path)
        return files.where(F.col("path").contains("/manifest-"))

    def _settle(self, runs: list[str]) -> None:
        """A new manifest; the ones before stay until the next merge, should a reader still hold them."""
        self.runs, self.version = runs, self.version + 1
        state = json.dumps({"prefixes": self.prefixes, "runs": [r.rsplit("/", 1)[1] for r in runs]})
        self.spark.createDataFrame([(state,)], "value string").coalesce(1).write.mode("overwrite").text(f"{self.path}/manifest-{self.version:06d}")

    def _prefix(self) -> Column:
        return F.pmod(F.col("hi"), F.lit(self.prefixes)).cast("int")

    def index(self) -> DataFrame:
        return self.spark.read.schema(_RUN).parquet(*self.runs)

    def size(self) -> int:
        return self.index().agg(F.sum("n")).first()[0] or 0 if self.runs else 0

    def novel(self, batch: DataFrame) -> DataFrame:
        """The rows of ``batch`` (hi, lo, ...; one per identifier) that no run holds."""
        if not self.runs:
            return batch
        tagged = batch.withColumn("prefix", self._prefix())
        near = tagged.groupBy("prefix").cogroup(self.index().groupBy("prefix"))
        return near.applyInArrow(_search, tagged.schema).drop("prefix")

    def _write(self, ids: DataFrame, run: str) -> str:
        rows = ids.select(self._prefix().alias("prefix"), "hi", "lo")
        rows.repartition("prefix").sortWithinPartitions("prefix", "hi", "lo").mapInArrow(_pack, _RUN).write.mode("overwrite").parquet(run)
        return run

    def add(self, novel: DataFrame) -> None:
        self._settle([*self.runs, self._write(novel, f"{self.path}/run-{self.version:06d}")])

    def compact(self) -> None:
        """Merge all runs into one (linear in the index: unpack, sort within prefixes, pack); the number of prefixes follows the number of identifiers."""
        more = self._enough(self.size())
        if len(self.runs) < 2 and more <= self.prefixes:
            return
        flat = self.index().mapInArrow(_unpack, "prefix int, hi long, lo long")
        old, self.prefixes = self.runs, max(self.prefixes, more)
        self._settle([self._write(flat, f"{self.path}/merged-{self.version:06d}")])
        for run in old:
            drop_path(self.spark, run)


def _unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for p, a, b in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            hi, lo = np.frombuffer(a, np.int64), np.frombuffer(b, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(hi), p, np.int32)), pa.array(hi), pa.array(lo)], names=["prefix", "hi", "lo"])


def kept_deliveries(df: DataFrame, key: Column, received: str, row_id: str, batches: int = 3, compact_every: int = 2, index: IdentifierIndex | None = None) -> DataFrame:
    """``hi, lo, kept``: of each message the delivery to keep, found batch by batch in order of receipt through an
    ``IdentifierIndex`` (a new one without ``index``; one from earlier batches knows their messages). Borders are in whole seconds of receipt, so all deliveries of one instant are in one batch.

    Deliveries are hashed and reduced to one per message and batch in one pass, which is written by batch; all that follows reads only that."""
    spark = df.sparkSession
    seconds = F.unix_seconds(F.col(received).cast("timestamp"))
    share = F.percentile_approx(seconds, F.array(*[F.lit(i / batches) for i in range(1, batches)]), F.lit(100)) if batches > 1 else F.lit(None)
    total, cuts = df.agg(F.count(F.lit(1)), share).first()
    borders = sorted({int(c) for c in cuts or []})
    told = identified(df, key, received, row_id)
    number = sum(((F.col("second") >= b).cast("int") for b in borders), F.lit(0))
    first = told.withColumn("batch", number).groupBy("hi", "lo", "batch").agg(F.min("arrival").alias("arrival"))
    first = materialise(first.select("hi", "lo", arrived_id(F.col("arrival")).alias("kept"), "batch"), "arrivals", by=["batch"])
    goes_on = index is not None
    index = index or IdentifierIndex(spark, total)
    out = scratch(spark, "kept")
    for i in range(len(borders) + 1):
        index.novel(first.where(F.col("batch") == i).drop("batch")).write.mode("overwrite").parquet(f"{out}/batch-{i}")
        if i < len(borders) or goes_on:  # nothing is searched in a new index after the last batch
            index.add(spark.read.parquet(f"{out}/batch-{i}"))
            if (i + 1) % compact_every == 0:
                index.compact()
    return spark.read.parquet(*[f"{out}/batch-{i}" for i in range(len(borders) + 1)])


def repeated_deliveries(df: DataFrame, key: Column, received: str, row_id: str, batches: int = 3) -> DataFrame:
    """``row_id`` of each delivery that is not the earliest of its message (ties: the smallest ``row_id`` is kept).

    Rows with a null in the key are never copies. A null time of receipt counts as latest. An empty table gives an empty result. One message may
    have any share of the deliveries: identifiers are aggregated before the shuffle, and deliveries meet the kept ones by ``row_id``."""
    kept = kept_deliveries(df, key, received, row_id, batches).select(F.col("kept").alias(row_id))
    return df.where(key.isNotNull()).select(row_id).join(kept, row_id, "left_anti")


def deduplicated(df: DataFrame, key: Column, received: str, row_id: str, batches: int = 3) -> DataFrame:
    """The rows of ``df`` without repeated deliveries."""
    return df.join(repeated_deliveries(df, key, received, row_id, batches), row_id, "left_anti")
