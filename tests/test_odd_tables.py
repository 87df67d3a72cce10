"""Queries on small tables of odd rows, held against their SQL."""

from __future__ import annotations

import time

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from carbonproof.streaming import streams
from tests_support import normal


@pytest.fixture
def equal_rows(spark, tmp_path):
    """Writes a table, runs a query on it and gives its rows, once they are those of its SQL."""

    def run(name, table, rows, schema):
        df = spark.createDataFrame(rows, schema)
        df.coalesce(1).write.parquet(f"file://{tmp_path}/{table}.parquet")
        ours = entry.queries()[name](spark, f"file://{tmp_path}")
        columns = sorted(ours.columns)
        ours = sorted((tuple(normal(r[c]) for c in columns) for r in ours.collect()), key=repr)
        con = duckdb.connect()
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{tmp_path}/{table}.parquet/*.parquet'")
        done = con.execute(entry.oracle_sql()[name])
        theirs = [d[0] for d in done.description]
        assert ours == sorted((tuple(normal(r[theirs.index(c)]) for c in columns) for r in done.fetchall()), key=repr)
        return ours

    return run


def test_plan_header_beyond_a_tebibyte(equal_rows):
    rows = [(k, "b", 1_500_000) for k in range(2)]
    lines = equal_rows("plan_header", "part", rows, "p_partkey bigint, p_brand string, p_size int")
    assert any("2793.98 GiB" in line for (line,) in lines)


def test_chunk_at_the_epoch_is_not_late(spark, tmp_path):
    """The first instant of Spark's watermark, and times before it, in a later batch than later ones."""
    schema = "item_id bigint, chunk_index bigint, ms bigint"
    for part in ([(1, 0, 500), (2, 0, 700)], [(3, 0, 0), (4, 0, -86_400_000 * 365), (1, 0, 501)]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/in")
    src = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"file://{tmp_path}/in")
    out = streams.stream_dedup_chunks(src.withColumn("ts", F.timestamp_millis("ms")), "ts", "1 hour")
    out.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start().awaitTermination()
    assert sorted(r["item_id"] for r in spark.read.parquet(f"file://{tmp_path}/out").collect()) == [1, 2, 3, 4]


def test_item_of_no_bytes_and_no_end_is_incomplete(equal_rows):
    rows = [(31, ""), (62, None), (5, ""), (37, ""), (41, None), (6, "six"), (93, "x" * 5000)]
    status = equal_rows("verify_chunked_items", "documents", rows, "doc_id bigint, text string")
    assert (31, "incomplete") in status and (62, "incomplete") in status and (41, "ok") in status and len(status) == 7


TRACKED_SCHEMA = "item_id bigint, kind string, chunk_index bigint, len bigint, total bigint"


def test_tracker_reads_neighbouring_items_at_once(spark, tmp_path):
    """Items with gaps, repeats and negative ids over three batches: the last rows are right, and 130 items take few calls of the state."""
    ids = [-65, -1, *range(128)]
    parts = [
        [(i, "chunk", c, 5, None) for i in ids for c in (2, 0, 1)],
        [(i, "chunk", c, 5, None) for i in ids if i % 2 for c in (7, 1, 5)] + [(i, "end", None, None, 15) for i in ids if i % 3 == 0],
        [(i, "chunk", c, 5, None) for i in ids if i % 5 == 0 for c in (0, 1, 6)],
    ]
    for part in parts:
        spark.createDataFrame(part, TRACKED_SCHEMA).coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/in")
    src = spark.readStream.schema(TRACKED_SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"file://{tmp_path}/in")
    batches = []
    with streams.keyed_state(spark):
        query = streams.stream_item_tracker(src).writeStream.foreachBatch(lambda df, _: batches.append(df.collect())).outputMode("update").option("checkpointLocation", f"file://{tmp_path}/c").trigger(availableNow=True).start()
        query.awaitTermination()
    last = {r["item_id"]: (r["received_bytes"], r["chunks"], r["total"], r["complete"]) for batch in batches for r in batch}
    for i in ids:
        held = {0, 1, 2} | ({7, 5} if i % 2 else set()) | ({6} if i % 5 == 0 else set())
        total = 15 if i % 3 == 0 else None
        assert last[i] == (5 * len(held), len(held), total, total == 5 * len(held))
    states = query.recentProgress[0]["stateOperators"][0]["customMetrics"]
    assert len(batches) == 3 and states["rocksdbPutCount"] < len(ids) / 2


def test_tracker_lets_idle_items_go_alone(spark, tmp_path):
    """Of two items of a block the incomplete one leaves with its last row, the complete one stays; when it comes again, it begins anew."""
    put = lambda rows: spark.createDataFrame(rows, TRACKED_SCHEMA).coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/in")
    put([(1, "chunk", 0, 5, None), (1, "chunk", 3, 5, None), (2, "chunk", 0, 5, None), (2, "end", None, None, 5)])
    src = spark.readStream.schema(TRACKED_SCHEMA).parquet(f"file://{tmp_path}/in")
    batches = []
    until = time.time() + 90

    def wait(n):
        while len([r for b in batches for r in b if r["item_id"] == 1]) < n and time.time() < until:
            time.sleep(0.2)

    with streams.keyed_state(spark):
        query = streams.stream_item_tracker(src, idle_ms=3000).writeStream.foreachBatch(lambda df, _: batches.append(df.collect())).outputMode("update").option("checkpointLocation", f"file://{tmp_path}/c").start()
    try:
        wait(2)
        put([(1, "chunk", 3, 5, None), (2, "chunk", 0, 5, None)])
        wait(3)
    finally:
        query.stop()
    rows = [tuple(r) for b in batches for r in b]
    assert [r for r in rows if r[0] == 1][:3] == [(1, 10, 2, None, False)] * 2 + [(1, 5, 1, None, False)]
    assert [r for r in rows if r[0] == 2] == [(2, 5, 1, 5, True)] * 2
