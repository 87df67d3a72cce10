"""Resuming a copy: what is done, what is pending, what to read again, how to deal items to lanes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from carbonproof.functions.canon import dense_ids
from carbonproof.operators.chunks import chunk_count


def resume_state(received: DataFrame) -> DataFrame:
    """``item_id, completed_chunks``: sorted indices of the chunks received."""
    return received.groupBy("item_id").agg(F.array_sort(F.collect_set("chunk_index")).alias("completed_chunks"))


def validate_resume(state: DataFrame, manifest: DataFrame, expected: dict[str, str], chunk_bytes: int) -> DataFrame:
    """``item_id, reason`` of state rows that cannot be used.

    ``state`` has ``item_id, n_chunks, transfer_id, protocol, manifest_hash``; ``expected`` the last three
    of the present run.
    """
    m = manifest.select(F.col("id").alias("item_id"), "kind", F.when(F.col("kind") == "file", chunk_count(F.col("size"), chunk_bytes)).otherwise(0).alias("planned"))
    reason = F.when(F.col("transfer_id") != expected["transfer_id"], "other transfer")
    reason = reason.when(F.col("protocol") != expected["protocol"], "other protocol").when(F.col("manifest_hash") != expected["manifest_hash"], "other manifest")
    reason = reason.when(F.col("kind").isNull(), "unknown item").when(F.col("n_chunks") != F.col("planned"), "layout differs")
    return state.join(m, "item_id", "left").withColumn("reason", reason).where("reason is not null").select("item_id", "reason")


def pending_chunks(layout: DataFrame, done: DataFrame) -> DataFrame:
    """The chunks of a layout that are not done."""
    return layout.join(done.select("item_id", "chunk_index"), ["item_id", "chunk_index"], "left_anti")


def resume_progress(items: DataFrame, layout: DataFrame, done: DataFrame) -> DataFrame:
    """``item_id, total_chunks, resumed_chunks, resumed_bytes, complete``; an item without chunks is complete."""
    marked = layout.join(done.select("item_id", "chunk_index").distinct().withColumn("done", F.lit(True)), ["item_id", "chunk_index"], "left")
    per_item = marked.groupBy("item_id").agg(
        F.count("*").alias("total_chunks"), F.count_if("done").alias("resumed_chunks"), F.sum(F.when(F.col("done"), F.col("len")).otherwise(0)).alias("resumed_bytes")
    )
    zero = F.lit(0).cast("bigint")
    return items.select("item_id").join(per_item, "item_id", "left").select(
        "item_id", *[F.coalesce(c, zero).alias(c) for c in ("total_chunks", "resumed_chunks", "resumed_bytes")],
        (F.coalesce("resumed_chunks", zero) == F.coalesce("total_chunks", zero)).alias("complete"),
    )


def rehash_candidates(layout: DataFrame, done: DataFrame) -> DataFrame:
    """``item_id`` of complete items with a chunk that this run has not verified (``fresh`` false)."""
    planned = layout.groupBy("item_id").agg(F.count("*").alias("planned"))
    have = done.groupBy("item_id").agg(F.count("*").alias("have"), F.count_if("fresh").alias("verified"))
    return planned.join(have, "item_id").where("have = planned and verified < have").select("item_id")


def reset_items(done: DataFrame, bad: DataFrame) -> DataFrame:
    """Completed chunks without those of items whose final digest failed."""
    return done.join(bad.select("item_id"), "item_id", "left_anti")


def with_lanes(items: DataFrame, lanes: int) -> DataFrame:
    """``items`` with ``lane``: each whole item in one lane, round robin in order of ids."""
    return dense_ids(items, ["item_id"], "rank").withColumn("lane", F.pmod("rank", F.lit(lanes))).drop("rank")


def assign_lanes(items: DataFrame, lanes: int) -> DataFrame:
    """``lane, items, bytes, skew``: skew is the lane's bytes over the mean of all lanes, to 4 places."""
    per_lane = with_lanes(items, lanes).groupBy("lane").agg(F.count("*").alias("items"), F.sum("size").cast("bigint").alias("bytes"))
    total = per_lane.agg(F.sum("bytes").alias("all"))
    return per_lane.join(total, F.lit(True)).select("lane", "items", "bytes", skew(F.col("bytes"), F.col("all"), lanes).alias("skew"))


def skew(part: Column, total: Column, lanes: int) -> Column:
    return F.round(part.cast("decimal(38,0)") * lanes / total.cast("decimal(38,0)"), 4).cast("decimal(18,4)")
