"""The copy operators on streams: incremental copy, quarantine, deduplication, tracking, progress, stalls."""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, TimerValues

from carbonproof.functions.scratch import setting
from carbonproof.operators.chunks import chunk_ok


#: Years from Spark's least timestamp to 1970, at least.
LEAST_YEARS = 1970


def stream_copy(src: DataFrame, sink: str, checkpoint: str) -> StreamingQuery:
    """Copy what has arrived since the last run, each row once over restarts, then stop."""
    return src.writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stream_verify_chunks(src: DataFrame, ok: str, bad: str, checkpoint: str, chunk_bytes: int) -> StreamingQuery:
    """Good chunks to one folder, others to quarantine. Each batch overwrites its own subfolder, so a repeat is harmless."""

    def write(batch: DataFrame, number: int) -> None:
        marked = batch.withColumn("ok", chunk_ok(chunk_bytes)).persist()
        for path, wanted in ((ok, "ok"), (bad, "not ok")):
            marked.where(wanted).drop("ok").write.mode("overwrite").parquet(f"{path}/batch={number}")
        marked.unpersist()

    return src.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stream_dedup_chunks(src: DataFrame, ts: str, delay: str) -> DataFrame:
    """The stream without chunks delivered again within ``delay``.

    Spark's watermark begins at 1970, and what is no later than the watermark is dropped as late. So it is held against times
    LEAST_YEARS later, which no timestamp brings below its beginning.
    """
    clock = F.timestamp_micros(F.unix_micros(ts) + LEAST_YEARS * 366 * 86_400_000_000)
    return src.withColumn("_clock", clock).withWatermark("_clock", delay).dropDuplicatesWithinWatermark(["item_id", "chunk_index"]).drop("_clock")


TRACKED = "item_id bigint, received_bytes bigint, chunks bigint, total bigint, complete boolean"
#: What the state holds of an item; ``others`` counts its ranges after the first, ``due`` is when it will have been idle for too long.
SUMS = ("item_id", "received", "chunks", "total", "start", "stop", "others", "due")
#: Items that share a key of the state: those that differ in so many last bits of the id.
BLOCK_BITS = 6
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def keyed_state(spark: SparkSession):
    """Streams that start inside this block keep their state in a store that reads and writes single keys."""
    return setting(spark, "spark.sql.streaming.stateStore.providerClass", ROCKSDB)


class Ranges:
    """A set of whole numbers as half-open ranges."""

    def __init__(self, ranges: Iterable[tuple[int, int]]) -> None:
        found = sorted(ranges)
        self.starts, self.stops = [a for a, _ in found], [b for _, b in found]

    def add(self, x: int) -> bool:
        """Whether ``x`` is new; it extends or joins its neighbours."""
        at = bisect_right(self.starts, x)
        if at and x < self.stops[at - 1]:
            return False
        left, right = at > 0 and self.stops[at - 1] == x, at < len(self.starts) and self.starts[at] == x + 1
        if left and right:
            self.stops[at - 1] = self.stops.pop(at)
            del self.starts[at]
        elif left:
            self.stops[at - 1] = x + 1
        elif right:
            self.starts[at] = x
        else:
            self.starts.insert(at, x)
            self.stops.insert(at, x + 1)
        return True

    def changes(self, stored: dict[int, int]) -> tuple[dict[int, int], list[int]]:
        """How a map of all ranges but the first differs from them: ranges that are new or longer, and starts that are gone."""
        now = dict(zip(self.starts[1:], self.stops[1:], strict=True))
        return {a: b for a, b in now.items() if stored.get(a) != b}, [a for a in stored if a not in now]


class ItemTracker(StatefulProcessor):
    """Per item the ranges of chunks that came, beside bytes, number of chunks and total.

    A key of the state is a block of neighbouring items, whose sums are read and written at once: most of the time of a key goes
    into its calls of the state, whatever they carry. Chunks that come in order are one range however many they are. An item's
    first range stands with its sums; further ones are a map of item and start to stop, which is read only if an item that got rows has any, and
    of which a batch writes only what it changed.
    """

    def __init__(self, idle_ms: int | None) -> None:
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.ranges = handle.getMapState("ranges", "item_id bigint, start bigint", "stop bigint")
        self.sums = handle.getValueState("sums", f"items array<struct<{', '.join(f'{x}: bigint' for x in SUMS)}>>")

    def _items(self) -> dict[int | None, list]:
        """What is known of each item of the block: the fields of SUMS without the id."""
        held = self.sums.get()
        return {item: rest for item, *rest in held[0]} if held else {}

    def _ranges(self) -> dict[int | None, dict[int, int]]:
        """All ranges of the block's items but their first ones."""
        found: dict[int | None, dict[int, int]] = {}
        for (item, start), (stop,) in self.ranges.iterator():
            found.setdefault(item, {})[start] = stop
        return found

    def _keep(self, items: dict[int | None, list]) -> None:
        self.sums.update(([(item, *rest) for item, rest in items.items()],))

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        items, touched, stored = self._items(), {}, None
        for part in rows:
            for item, kind, index, size, end in part[["item_id", "kind", "chunk_index", "len", "total"]].itertuples(index=False):
                item = None if key[0] is None else int(item)
                if item not in touched:
                    _, _, _, start, stop, others, _ = items.setdefault(item, [0, 0, None, None, None, 0, None])
                    if others and stored is None:
                        stored = self._ranges()
                    more = stored[item] if others else {}
                    touched[item] = Ranges([*more.items(), *([] if start is None else [(start, stop)])]), more
                if kind == "end":
                    items[item][2] = int(end)
                elif touched[item][0].add(int(index)):
                    items[item][0] += int(size)
                    items[item][1] += 1
        due = timerValues.getCurrentProcessingTimeInMs() + self.idle_ms if self.idle_ms else None
        for item, (ranges, more) in touched.items():
            written, gone = ranges.changes(more)
            for at in gone:
                self.ranges.removeKey((item, at))
            for at, until in written.items():
                self.ranges.updateValue((item, at), (until,))
            received, chunks, total = items[item][:3]
            first = (ranges.starts[0], ranges.stops[0]) if ranges.starts else (None, None)
            items[item] = [received, chunks, total, *first, max(0, len(ranges.starts) - 1), due if received != total else None]
        self._keep(items)
        if due is not None and any(items[item][-1] == due for item in touched):
            self.handle.registerTimer(due)
        yield _tracked((item, *items[item][:3]) for item in touched)

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        """Items that got rows after this timer was set have a later one of their own."""
        items, now = self._items(), expiredTimerInfo.getExpiryTimeInMs()
        idle = {item: rest for item, rest in items.items() if rest[-1] is not None and rest[-1] <= now}
        if any(rest[5] for rest in idle.values()):
            for item, more in self._ranges().items():
                for start in more if item in idle else ():
                    self.ranges.removeKey((item, start))
        left = {item: rest for item, rest in items.items() if item not in idle}
        if idle and left:
            self._keep(left)
        elif idle:
            self.sums.clear()
        if idle:
            yield _tracked((item, *rest[:3]) for item, rest in idle.items())

    def close(self) -> None:
        pass


def _tracked(found: Iterable[tuple]) -> pd.DataFrame:
    """Rows of TRACKED from items, their bytes, chunks and totals."""
    rows = [(item, received, chunks, total, total is not None and received == total) for item, received, chunks, total in found]
    return pd.DataFrame(rows, columns=[c.split()[0] for c in TRACKED.split(", ")]).astype({"item_id": "Int64", "total": "Int64"})


def stream_item_tracker(src: DataFrame, idle_ms: int | None = None, block_bits: int = BLOCK_BITS) -> DataFrame:
    """Per item: bytes, chunks, the end record's total, and whether it is complete, in any order of arrival.

    ``src`` has ``item_id, kind ('chunk' or 'end'), chunk_index, len, total``. A chunk that comes again
    counts once. With ``idle_ms``, an incomplete item that is idle for so long leaves the state with a
    last row; a stream with such timeouts goes on until it is stopped. Start it inside ``keyed_state``.
    Items whose ids differ in the last ``block_bits`` bits only are held together; 0 holds each by itself, for few items with many ranges each.
    """
    block = F.shiftright(F.col("item_id").cast("bigint"), block_bits).alias("block")
    columns = src.select(block, "item_id", "kind", "chunk_index", "len", "total")
    return columns.groupBy("block").transformWithStateInPandas(ItemTracker(idle_ms), TRACKED, "Update", "ProcessingTime" if idle_ms else "None")


def stream_progress(src: DataFrame, width: str, slide: str | None = None, delay: str = "0 seconds") -> DataFrame:
    """Bytes, items and bytes a second per window over ``ts``; rows later than the watermark drop out."""
    window = F.window("ts", width, slide) if slide else F.window("ts", width)
    per = src.withWatermark("ts", delay).groupBy(window.alias("w")).agg(
        F.sum("bytes").alias("bytes"), F.count_if("item_done").alias("items")
    )
    seconds = (F.unix_micros("w.end") - F.unix_micros("w.start")) / 1e6
    return per.select(F.col("w.start").alias("start"), F.col("w.end").alias("stop"), "bytes", "items", F.round(F.col("bytes") / seconds, 4).alias("rate"))


def stall_sessions(src: DataFrame, idle: str = "30 seconds", by: str = "transfer", delay: str | None = None) -> DataFrame:
    """``by, start, last, events``: stretches of activity, split where nothing came for ``idle``.

    A slow sender within the gap is no stall. Works on tables and, with a watermark ``delay``, on streams.
    """
    rows = src.withWatermark("ts", delay) if delay else src
    per = rows.groupBy(by, F.session_window("ts", idle).alias("w")).agg(F.max("ts").alias("last"), F.count("*").alias("events"))
    return per.select(by, F.col("w.start").alias("start"), "last", "events")


def paced_source(spark, path: str, schema: str, max_files: int | None = None, max_bytes: int | None = None) -> DataFrame:
    """A stream of Parquet files with at most so many files, or so many bytes, in a batch."""
    if (max_files is None) == (max_bytes is None):
        raise ValueError("give either max_files or max_bytes")
    reader = spark.readStream.schema(schema)
    return (reader.option("maxFilesPerTrigger", max_files) if max_files else reader.option("maxBytesPerTrigger", max_bytes)).parquet(path)


def paced_copy(spark, path: str, schema: str, sink: str, checkpoint: str, max_files: int | None = None, max_bytes: int | None = None) -> StreamingQuery:
    """``stream_copy`` with bounded batches."""
    return stream_copy(paced_source(spark, path, schema, max_files, max_bytes), sink, checkpoint)
