"""Streaming forms: session lines as they arrive, usage by day or week, and active time with state."""

from __future__ import annotations

import sys
from collections.abc import Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import IntegerType, StructType
from pyspark.sql.window import Window as W

from runloom.sources import readers
from runloom.sources.scratch import shared_folder


# The processor is unpickled by workers of the driver too, which may have no path to this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Slices that a session's state keeps together, at most; some 24 bytes each.
SLICES = 512
#: Events that are packed at once, about.
PACK_ROWS = 500_000

Sums = tuple[int, int, int, int]


def session_events(spark: SparkSession, folder: str, archived: bool = False) -> DataFrame:
    """The session events of files that appear in a folder, as a stream. Streams number no lines, so ``at`` orders the events of a file by their time."""
    read = spark.readStream.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.[jJ][sS][oO][nN][lL]").text(folder)
    lines = read.select(F.col("_metadata.file_path").alias("file"), F.lit(archived).alias("archived"), F.col("_metadata.file_block_start").alias("at"), F.col("value").alias("line"))
    return readers.session_events(lines).withColumn("at", F.struct(F.col("at").alias("block"), F.unix_micros(F.get("times", F.lit(0))).alias("row")))


def usage_buckets(events: DataFrame, time: str, late: str, sums: dict[str, str], weekly: bool = False) -> DataFrame:
    """Events and sums per day, or per week from Monday; a bucket is final when the watermark has passed it."""
    window = F.window(time, "7 days", "7 days", "4 days") if weekly else F.window(time, "1 day")
    held = events.withWatermark(time, late).groupBy(window)
    out = held.agg(F.count("*").alias("events"), *(F.sum(c).alias(name) for name, c in sums.items()))
    return out.select(F.date_format("window.start", "yyyy-MM-dd").alias("key"), "events", *sums)


class ActiveTime(StatefulProcessor):
    """Folds a session's times into slices as long as the idle cap, in any order.

    No gap within a slice reaches the cap, so a slice is its first and last time and its number of
    events. Each access to state is a message to the JVM and back, so slices are kept in blocks of
    SLICES: a batch reads and writes a block that it has events of once, whatever their number, and
    the sums of the session's blocks once. Blocks that the watermark has passed are settled: their
    slices leave the map, and their sums become one.
    """

    def __init__(self, session: str, cap_ms: int) -> None:
        self.session, self.cap_ms = session, max(1, cap_ms)
        self.block_ms = self.cap_ms * SLICES

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.blocks = handle.getMapState("blocks", "block long", "slices binary")
        self.sums = handle.getValueState("sums", "settled array<long>, open array<array<long>>")

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        mark, found = timerValues.getCurrentWatermarkInMs(), np.empty((3, 0), np.int64)
        for _, times in rows:
            ms = np.frombuffer(times, np.int64)
            ms = ms[ms >= mark]
            found = _folded(found, np.stack([ms, ms, np.ones_like(ms)]), self.cap_ms)
        settled, open_ = self._sums()
        numbers = found[0] // self.block_ms
        for number in np.unique(numbers).tolist():
            slices = found[:, numbers == number]
            if number in open_:
                slices = _folded(np.frombuffer(self.blocks.getValue((number,))[0], np.int64).reshape(3, -1), slices, self.cap_ms)
            else:
                self.handle.registerTimer((number + 1) * self.block_ms)
            self.blocks.updateValue((number,), (slices.tobytes(),))
            open_[number] = _summed(slices, self.cap_ms)
        if found.size:
            self._keep(settled, open_)
        for _, sums in sorted(open_.items()):
            settled = self._joined(settled, sums)
        _, _, active, events = settled or (None, None, 0, 0)
        yield Row(**{self.session: key[0], "events": events, "active_ms": active})

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:
        """Settles the blocks that end by the time of the timer, in order; nothing new is to be said of them."""
        settled, open_ = self._sums()
        for number in sorted(n for n in open_ if (n + 1) * self.block_ms <= expiredTimerInfo.getExpiryTimeInMs()):
            settled = self._joined(settled, open_.pop(number))
            self.blocks.removeKey((number,))
        self._keep(settled, open_)
        return iter(())

    def close(self) -> None:
        pass

    def _sums(self) -> tuple[Sums | None, dict[int, Sums]]:
        """What is settled, and the open blocks by number."""
        settled, open_ = self.sums.get() or (None, ())
        return settled and tuple(settled), {number: tuple(sums) for number, *sums in open_}

    def _keep(self, settled: Sums | None, open_: dict[int, Sums]) -> None:
        self.sums.update((settled and list(settled), [[number, *sums] for number, sums in open_.items()]))

    def _joined(self, a: Sums | None, b: Sums) -> Sums:
        return b if a is None else (a[0], b[1], a[2] + min(b[0] - a[1], self.cap_ms) + b[2], a[3] + b[3])


def _folded(a: np.ndarray, b: np.ndarray, cap_ms: int) -> np.ndarray:
    """The slices (columns of first, last, events) of two such arrays, or of single times, in order; what is of one slice is put together."""
    held = np.concatenate([a, b], axis=1)
    held = held[:, np.argsort(held[0])]
    numbers = held[0] // cap_ms
    at = np.flatnonzero(np.diff(numbers, prepend=numbers[:1] - 1))
    return np.stack([held[0][at], np.maximum.reduceat(held[1], at), np.add.reduceat(held[2], at)]) if at.size else held


def _summed(slices: np.ndarray, cap_ms: int) -> Sums:
    """Of slices in order: first time, last time, active milliseconds, events."""
    first, last, events = slices
    active = (last - first).sum() + np.minimum(first[1:] - last[:-1], cap_ms).sum()
    return int(first[0]), int(last[-1]), int(active), int(events.sum())


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each session of up to PACK_ROWS events: its times in milliseconds, one after the other."""
    held, rows = [], 0
    for batch in batches:
        held.append(batch)
        rows += batch.num_rows
        if rows >= PACK_ROWS:
            yield _by_session(held)
            held, rows = [], 0
    if held:
        yield _by_session(held)


def _by_session(held: list[pa.RecordBatch]) -> pa.RecordBatch:
    keys = pa.concat_arrays([b.column(0) for b in held]).dictionary_encode("encode")
    codes, ms = keys.indices.to_numpy(), np.concatenate([b.column(1).to_numpy() for b in held])
    ends = np.concatenate([[0], np.bincount(codes, minlength=len(keys.dictionary)).cumsum()]) * ms.itemsize
    times = pa.Array.from_buffers(pa.binary(), len(keys.dictionary), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(ms[np.argsort(codes)])])
    return pa.RecordBatch.from_arrays([keys.dictionary, times], names=[held[0].schema.names[0], "times"])


def active_time(events: DataFrame, session: str, time: str, cap_ms: int, late: str) -> DataFrame:
    """Events and capped-gap active time of each session, renewed with each batch that has events of it.

    A session's state grows with the slices of time between the watermark and now in which it has
    events (and those of a block before), not with their number, and events out of order count as in
    a batch run. Events that come after the watermark has passed them are dropped. A batch's events
    are packed by session first, as a row costs the processor far more than the times in it. Needs
    the RocksDB state store, which the session is set to use.
    """
    kind = dict(events.dtypes)[session]
    events.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    ms = F.coalesce(F.unix_millis(F.col(time)), F.lit(-1)).alias("ms")  # no watermark is below 0
    held = events.withWatermark(time, late).select(session, ms).repartition(session).mapInArrow(_packed, f"{session} {kind}, times binary")
    return held.groupBy(session).transformWithState(ActiveTime(session, cap_ms), f"{session} {kind}, events long, active_ms long", "Update", "EventTime")


def drained(stream: DataFrame, key: str, mode: str) -> DataFrame:
    """Runs a stream over all that is there and returns the last row of each key. Batches are written to a shared folder."""
    spark, folder = stream.sparkSession, shared_folder(stream.sparkSession)

    def keep(batch: DataFrame, number: int) -> None:
        batch.withColumn("_batch", F.lit(number)).write.mode("overwrite").parquet(f"{folder}/rows/batch={number}")

    query = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/checkpoint").foreachBatch(keep).trigger(availableNow=True).start()
    query.awaitTermination()
    rows = spark.read.option("recursiveFileLookup", "true").schema(_with_batch(stream)).parquet(f"{folder}/rows")
    last = F.row_number().over(W.partitionBy(key).orderBy(F.desc("_batch")))
    return rows.withColumn("_n", last).where("_n = 1").drop("_n", "_batch")


def _with_batch(stream: DataFrame) -> StructType:
    return StructType([*stream.schema.fields]).add("_batch", IntegerType())
