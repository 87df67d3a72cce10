"""Queries on streams and reports; each stream runs over all that is there, then stops."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from carbonproof.functions.scratch import scratch_path
from carbonproof.operators import report
from carbonproof.queries import fixtures as fx
from carbonproof.streaming import streams

R = fx.Registry()
T = fx.table
#: Micro-batches of a stream, at most.
BATCHES = 4


def _files(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def _landed(df: DataFrame, order: str, label: str) -> tuple[str, str]:
    """``df`` written as files, one a shuffle partition, each of a range of a column; the path, and the schema as text."""
    path, files = scratch_path(df.sparkSession, label), _files(df.sparkSession)
    df.repartitionByRange(files, order).sortWithinPartitions(order).write.parquet(path)
    return path, df.schema.simpleString()[7:-1]


def _stream(df: DataFrame, order: str, label: str) -> DataFrame:
    path, _ = _landed(df, order, label)
    return df.sparkSession.readStream.schema(df.schema).option("maxFilesPerTrigger", -(-_files(df.sparkSession) // BATCHES)).parquet(path)


def _result(query_frame: DataFrame, label: str, mode: str = "append") -> DataFrame:
    """Run a stream to its end into a folder and read the rows back."""
    spark = query_frame.sparkSession
    out, checkpoint = scratch_path(spark, label), scratch_path(spark, "checkpoint")

    def write(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{out}/number={number}")

    query_frame.writeStream.foreachBatch(write).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(out)


@R.add("SELECT event_id, user_id, event_type, value FROM events")
def stream_copy(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = T(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value")
    src, sink, checkpoint = (scratch_path(spark, x) for x in ("src", "sink", "checkpoint"))
    halves = (events.where("event_id % 2 = 0"), events.where("event_id % 2 = 1"))
    for half in halves:  # the second run goes on where the first one stopped
        half.write.mode("append").parquet(src)
        streams.stream_copy(spark.readStream.schema(events.schema).parquet(src), sink, checkpoint).awaitTermination()
    return spark.read.schema(events.schema).parquet(sink)


@R.add("SELECT event_id, user_id, event_type, value FROM events")
def paced_copy(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = T(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value")
    path, _ = _landed(events, "event_id", "paced")
    sink = scratch_path(spark, "sink")
    schema = "event_id bigint, user_id bigint, event_type string, value double"
    streams.paced_copy(spark, path, schema, sink, scratch_path(spark, "checkpoint"), max_files=1).awaitTermination()
    return spark.read.schema(events.schema).parquet(sink)


@R.add(f'WITH {fx.BAD_CHUNKS} SELECT item_id, chunk_index, "offset", arrival, sha256(data) = digest AS ok FROM bad_chunks')
def stream_verify_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    ok, bad = scratch_path(spark, "ok"), scratch_path(spark, "bad")
    src = _stream(fx.bad_chunks(spark, sf_dir), "arrival", "chunks")
    streams.stream_verify_chunks(src, ok, bad, scratch_path(spark, "checkpoint"), fx.C).awaitTermination()
    columns = ["item_id", "chunk_index", "offset", "arrival"]
    return spark.read.parquet(ok).select(*columns, F.lit(True).alias("ok")).unionByName(spark.read.parquet(bad).select(*columns, F.lit(False).alias("ok")))


@R.add(f"WITH {fx.BAD_CHUNKS} SELECT DISTINCT item_id, chunk_index FROM bad_chunks")
def stream_dedup_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    ts = F.timestamp_micros(F.col("arrival") * 1000)
    src = _stream(fx.bad_chunks(spark, sf_dir).select("item_id", "chunk_index", "arrival").withColumn("ts", ts), "arrival", "arrivals")
    return _result(streams.stream_dedup_chunks(src, "ts", "1 hour"), "distinct").select("item_id", "chunk_index")


@R.add(
    f"WITH {fx.BAD_CHUNKS}, c AS (SELECT item_id, count(DISTINCT chunk_index) AS chunks, CAST(sum(len) AS BIGINT) AS received_bytes FROM "
    "(SELECT DISTINCT item_id, chunk_index, len FROM bad_chunks) GROUP BY 1), i AS (SELECT item_id, CASE WHEN item_id % 31 <> 0 THEN size END AS total FROM items) "
    "SELECT item_id, coalesce(received_bytes, 0) AS received_bytes, coalesce(chunks, 0) AS chunks, total, coalesce(total = coalesce(received_bytes, 0), false) AS complete "
    "FROM i LEFT JOIN c USING (item_id) WHERE total IS NOT NULL OR chunks IS NOT NULL"
)
def stream_item_tracker(spark: SparkSession, sf_dir: str) -> DataFrame:
    none = F.lit(None).cast("bigint")
    got = fx.bad_chunks(spark, sf_dir).select("item_id", F.lit("chunk").alias("kind"), "chunk_index", "len", none.alias("total"), "arrival")
    ends = fx.items(spark, sf_dir).where("item_id % 31 <> 0").select("item_id", F.lit("end").alias("kind"), none.alias("chunk_index"), none.alias("len"), F.col("size").alias("total"), F.pmod(F.col("item_id") * 104729, F.lit(1000003)).alias("arrival"))
    with streams.keyed_state(spark):
        out = _result(streams.stream_item_tracker(_stream(got.unionByName(ends), "arrival", "records")), "tracked", "update")
    newest = F.max_by(F.struct("received_bytes", "chunks", "total", "complete"), "batch").alias("last")
    return out.groupBy("item_id").agg(newest).select("item_id", "last.*")


@R.add(
    f"WITH {fx.TRANSFER_EVENTS} SELECT time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '2024-01-01') AS start, time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '2024-01-01') + INTERVAL 6 HOUR AS stop, "
    "CAST(sum(bytes) AS BIGINT) AS bytes, count(*) FILTER (item_done) AS items, round(CAST(sum(bytes) AS DOUBLE) / 21600, 4) AS rate FROM t GROUP BY 1, 2"
)
def stream_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    return progress_windows(fx.transfer_events(spark, sf_dir))


def progress_windows(events: DataFrame) -> DataFrame:
    """Each window's last state; files may come in any order, so the watermark waits for the whole span of the events."""
    span = events.agg(F.unix_seconds(F.max("ts").cast("timestamp")) - F.unix_seconds(F.min("ts").cast("timestamp"))).first()[0] or 0
    src = _stream(events, "ts", "progress")
    out = _result(streams.stream_progress(src, "6 hours", delay=f"{span + 1} seconds"), "windows", "update")
    last = F.max_by(F.struct("bytes", "items", "rate"), "batch").alias("last")
    per = out.groupBy("start", "stop").agg(last)
    return per.select(F.col("start").cast("timestamp_ntz").alias("start"), F.col("stop").cast("timestamp_ntz").alias("stop"), "last.*")


#: Parts of the events by time, and how many batches later one in ten of them comes.
PARTS, LATE = 6, {3: 2, 7: 1}


def _batched(df: DataFrame, batch: Column, label: str) -> DataFrame:
    """A stream of ``df`` whose batches are known: each is written on its own, after the one before it, and read as a whole."""
    spark, path = df.sparkSession, scratch_path(df.sparkSession, label)
    rows = df.withColumn("_batch", batch)
    sizes = dict(rows.groupBy("_batch").count().collect())
    files = min([_files(spark), *sizes.values()])
    for number in sorted(sizes):
        rows.where(F.col("_batch") == number).drop("_batch").repartition(files).write.mode("append").parquet(path)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", files).parquet(path)


def _delivery(last: int) -> Column:
    """The batch in which an event comes: that of its time, or a later one."""
    part = F.floor(F.col("id") * PARTS / (last + 1)).cast("int")
    for digit, later in LATE.items():
        part = part + F.when(F.col("id") % 10 == digit, later).otherwise(0)
    return part


_DELIVERED = (
    f"{fx.TRANSFER_EVENTS}, d AS (SELECT *, CAST(id * {PARTS} // ((SELECT max(id) FROM t) + 1) AS INTEGER) + "
    + " + ".join(f"CASE WHEN id % 10 = {digit} THEN {later} ELSE 0 END" for digit, later in LATE.items())
    + " AS batch FROM t), "
    # A batch is held against the watermark with which the one before it ran: the latest event of the batches before that one, less the delay.
    "mark AS (SELECT batch, max(max(ts)) OVER (ORDER BY batch ROWS BETWEEN UNBOUNDED PRECEDING AND 2 PRECEDING) - INTERVAL 1 DAY AS mark FROM d GROUP BY batch)"
)


def _windows_sql(width: int, slide: int) -> str:
    """Progress windows of the rows that are in time for their window, for each window that a row falls into."""
    return (
        f"WITH {_DELIVERED}, w AS (SELECT d.*, time_bucket(INTERVAL {slide} HOUR, ts, TIMESTAMP '2024-01-01') - INTERVAL {slide} HOUR * unnest(range({width // slide})) AS start FROM d), "
        f"kept AS (SELECT w.*, start + INTERVAL {width} HOUR AS stop FROM w JOIN mark USING (batch) WHERE mark IS NULL OR start + INTERVAL {width} HOUR > mark) "
        f"SELECT start, stop, CAST(sum(bytes) AS BIGINT) AS bytes, count(*) FILTER (item_done) AS items, round(CAST(sum(bytes) AS DOUBLE) / {width * 3600}, 4) AS rate FROM kept GROUP BY 1, 2"
    )


def _late_progress(spark: SparkSession, sf_dir: str, width: str, slide: str | None) -> DataFrame:
    events = fx.transfer_events(spark, sf_dir)
    last = events.agg(F.max("id")).first()[0] or 0
    out = _result(streams.stream_progress(_batched(events, _delivery(last), "late"), width, slide, "1 day"), "windows", "update")
    per = out.groupBy("start", "stop").agg(F.max_by(F.struct("bytes", "items", "rate"), "batch").alias("last"))
    return per.select(F.col("start").cast("timestamp_ntz").alias("start"), F.col("stop").cast("timestamp_ntz").alias("stop"), "last.*")


@R.add(_windows_sql(6, 6))
def stream_progress_late(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Some events come days late; those whose window the watermark has passed are dropped, and no others."""
    return _late_progress(spark, sf_dir, "6 hours", None)


@R.add(_windows_sql(6, 2))
def stream_progress_sliding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same over windows that overlap: a late event counts in those of its windows that are still open."""
    return _late_progress(spark, sf_dir, "6 hours", "2 hours")


@R.add(
    "WITH e AS (SELECT user_id AS transfer, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) >= INTERVAL 30 MINUTE THEN 1 ELSE 0 END AS cut FROM events), "
    "s AS (SELECT *, sum(cut) OVER (PARTITION BY transfer ORDER BY ts ROWS UNBOUNDED PRECEDING) AS n FROM e) "
    'SELECT transfer, min(ts) AS start, max(ts) AS "last", count(*) AS events FROM s GROUP BY transfer, n'
)
def stall_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = streams.stall_sessions(fx.transfer_events(spark, sf_dir), "30 minutes")
    return out.select("transfer", F.col("start").cast("timestamp_ntz").alias("start"), F.col("last").cast("timestamp_ntz").alias("last"), "events")


@R.add(
    "WITH e AS (SELECT user_id AS transfer, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) >= INTERVAL 30 MINUTE THEN 1 ELSE 0 END AS cut FROM events), "
    "s AS (SELECT *, sum(cut) OVER (PARTITION BY transfer ORDER BY ts ROWS UNBOUNDED PRECEDING) AS n FROM e) "
    'SELECT transfer, min(ts) AS start, max(ts) AS "last", count(*) AS events FROM s GROUP BY transfer, n'
)
def stream_stall_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions of a stream: they grow over batches and come out when the watermark passes them; a last event of no transfer, a week on, passes all."""
    events = fx.transfer_events(spark, sf_dir).select("transfer", "id", "ts")
    last = events.agg(F.max("id")).first()[0] or 0
    end = events.agg((F.max("ts") + F.expr("INTERVAL 7 DAYS")).alias("ts")).select(F.lit(None).cast("bigint").alias("transfer"), F.lit(None).cast("bigint").alias("id"), "ts").where("ts is not null")
    batch = F.coalesce(F.floor(F.col("id") * PARTS / (last + 1)).cast("int"), F.lit(PARTS))
    out = _result(streams.stall_sessions(_batched(events.unionByName(end), batch, "activity"), "30 minutes", delay="1 hour"), "sessions")
    return out.select("transfer", F.col("start").cast("timestamp_ntz").alias("start"), F.col("last").cast("timestamp_ntz").alias("last"), "events")


@R.add("SELECT event_id, user_id, event_type, value FROM events")
def paced_copy_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A copy in batches of a number of bytes each."""
    events = T(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value")
    path, _ = _landed(events, "event_id", "paced")
    sink = scratch_path(spark, "sink")
    schema = "event_id bigint, user_id bigint, event_type string, value double"
    streams.paced_copy(spark, path, schema, sink, scratch_path(spark, "checkpoint"), max_bytes=16_384).awaitTermination()
    return spark.read.schema(events.schema).parquet(sink)


@R.add(
    f"WITH {fx.TRANSFER_EVENTS}, s AS (SELECT transfer, CASE WHEN transfer % 5 <> 0 THEN CAST(sum(bytes) AS BIGINT) // 2 END AS total_bytes FROM t GROUP BY 1), "
    "r AS (SELECT t.transfer, id, ts, total_bytes, CAST(sum(bytes) OVER w AS BIGINT) AS bytes_done, CAST(sum(item_done::INT) OVER w AS BIGINT) AS items_done, "
    "first(ts) OVER w AS began FROM t JOIN s USING (transfer) WINDOW w AS (PARTITION BY t.transfer ORDER BY ts, id ROWS UNBOUNDED PRECEDING)) "
    "SELECT transfer, id, bytes_done, items_done, round(CASE WHEN coalesce(total_bytes, 0) > 0 THEN least(100.0, CAST(bytes_done AS DOUBLE) * 100.0 / total_bytes) ELSE 0.0 END, 4) AS pct, "
    "round(CASE WHEN ts > began THEN CAST(bytes_done AS DOUBLE) / ((epoch_us(ts) - epoch_us(began)) / 1e6) ELSE 0.0 END, 4) AS rate FROM r"
)
def progress_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = fx.transfer_events(spark, sf_dir)
    totals = events.groupBy("transfer").agg(F.floor(F.sum("bytes") / 2).cast("bigint").alias("total_bytes"))
    totals = totals.withColumn("total_bytes", F.when(F.col("transfer") % 5 != 0, F.col("total_bytes")))
    return report.progress_report(events, totals, "transfer")


@R.add(
    f"WITH {fx.TRANSFER_EVENTS}, p AS (SELECT transfer, CAST(sum(bytes) AS BIGINT) AS total_bytes, greatest((epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6, 0.001) AS elapsed FROM t GROUP BY 1) "
    "SELECT *, round(CAST(total_bytes AS DOUBLE) / elapsed, 4) AS mean_rate FROM p"
)
def completion_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.completion_report(fx.transfer_events(spark, sf_dir), "transfer")


_VARIANTS = ("source changed", "plan rejected", "preflight", "integrity", "configuration", "phase", "other")


@R.add(
    "WITH l AS (SELECT " + f"({list(report.PHASES)})[1 + event_id % 7] AS phase, ({list(_VARIANTS)})[1 + user_id % 7] AS variant FROM events WHERE event_type = 'error') SELECT variant, "
    + ", ".join(f"count(*) FILTER (phase = '{p}' AND variant <> 'source changed') AS {p}" for p in report.PHASES)
    + ", count(*) FILTER (variant = 'source changed') AS source_changed FROM l GROUP BY 1"
)
def error_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    def pick(values: tuple[str, ...], column: str) -> Column:
        return F.element_at(F.array(*map(F.lit, values)), (F.col(column) % 7 + 1).cast("int"))

    log = T(spark, sf_dir, "events").where("event_type = 'error'").select(pick(report.PHASES, "event_id").alias("phase"), pick(_VARIANTS, "user_id").alias("variant"))
    return report.error_report(log)
