"""Reports on transfers: cumulative progress, completion, errors."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The phases in which a run can fail, in order.
PHASES = ("connect", "analyze", "validate", "transfer", "apply", "verify", "teardown")


def _seconds(start: Column, stop: Column) -> Column:
    return (F.unix_micros(stop) - F.unix_micros(start)) / 1e6


def progress_report(events: DataFrame, totals: DataFrame, by: str) -> DataFrame:
    """Events with cumulative ``bytes_done, items_done``, ``pct`` (0 to 100) and ``rate`` in bytes a second.

    ``events`` has ``by, id, ts, bytes, item_done``; ``totals`` has ``by, total_bytes``. pct is 0 without a
    total and at most 100; the rate is 0 before any time has passed.
    """
    order = Window.partitionBy(by).orderBy("ts", "id").rowsBetween(Window.unboundedPreceding, 0)
    run = events.join(totals, by, "left").select(
        by, "id", "ts", F.sum("bytes").over(order).alias("bytes_done"), F.sum(F.col("item_done").cast("bigint")).over(order).alias("items_done"),
        F.first("ts").over(order).alias("began"), "total_bytes",
    )
    pct = F.when(F.coalesce("total_bytes", F.lit(0)) > 0, F.least(F.lit(100.0), F.col("bytes_done") * 100.0 / F.col("total_bytes"))).otherwise(0.0)
    elapsed = _seconds(F.col("began"), F.col("ts"))
    rate = F.when(elapsed > 0, F.col("bytes_done") / elapsed).otherwise(0.0)
    return run.select(by, "id", "bytes_done", "items_done", F.round(pct, 4).alias("pct"), F.round(rate, 4).alias("rate"))


def completion_report(events: DataFrame, by: str) -> DataFrame:
    """``by, total_bytes, elapsed, mean_rate``; elapsed is at least a millisecond."""
    per = events.groupBy(by).agg(F.sum("bytes").alias("total_bytes"), F.min("ts").alias("began"), F.max("ts").alias("ended"))
    elapsed = F.greatest(_seconds(F.col("began"), F.col("ended")), F.lit(0.001))
    return per.select(by, "total_bytes", elapsed.alias("elapsed"), F.round(F.col("total_bytes") / elapsed, 4).alias("mean_rate"))


def error_report(log: DataFrame, phases: Sequence[str] = PHASES) -> DataFrame:
    """Failures by ``variant`` (rows) and phase (columns); a changed source is counted apart, in ``source_changed``."""
    counts = log.groupBy("variant").agg(
        *[F.count_if((F.col("phase") == p) & (F.col("variant") != "source changed")).alias(p) for p in phases],
        F.count_if(F.col("variant") == "source changed").alias("source_changed"),
    )
    return counts
