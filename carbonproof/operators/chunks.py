"""Chunks of items: layout, split, verification, routing, gaps, reassembly, digests of whole items.

An item may be larger than any row can be, so whole items are proved from their chunks: small ones by
the digest of their joined bytes, larger ones by a tree over the digests of their chunks.

Items have ``item_id`` and ``payload`` (binary) or ``size``; chunks have ``item_id, chunk_index, offset,
len, digest, data``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from carbonproof.sources.readers import CHUNK_BYTES

#: Items of more bytes are digested by a tree over their chunks' digests; the others have room in one row.
WHOLE_BYTES = 64 << 20
#: Digests under one node of such a tree.
TREE_GROUP = 128


def chunk_count(size: Column, chunk_bytes: int) -> Column:
    return F.ceil(size / chunk_bytes).cast("bigint")


def chunk_layout(items: DataFrame, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """``item_id, chunk_index, offset, len`` of all chunks; an item of no bytes has none, the last may be short."""
    n = chunk_count(F.col("size"), chunk_bytes)
    laid = items.where("size > 0").select("item_id", "size", F.explode(F.sequence(F.lit(0).cast("bigint"), n - 1)).alias("chunk_index"))
    offset = F.col("chunk_index") * chunk_bytes
    return laid.select("item_id", "chunk_index", offset.alias("offset"), F.least(F.lit(chunk_bytes).cast("bigint"), F.col("size") - offset).alias("len"))


def split_chunks(items: DataFrame, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """The layout with each chunk's bytes and digest; rows stay where their item is, nothing is shuffled."""
    size = F.octet_length("payload")
    n = chunk_count(size, chunk_bytes)
    laid = items.where(size > 0).select("item_id", "payload", F.explode(F.sequence(F.lit(0).cast("bigint"), n - 1)).alias("chunk_index"))
    data = F.substring("payload", (F.col("chunk_index") * chunk_bytes + 1).cast("int"), F.lit(chunk_bytes))
    cut = laid.select("item_id", "chunk_index", (F.col("chunk_index") * chunk_bytes).alias("offset"), data.alias("data"))
    return cut.select("item_id", "chunk_index", "offset", F.octet_length("data").cast("bigint").alias("len"), F.sha2("data", 256).alias("digest"), "data")


def item_digests(items: DataFrame) -> DataFrame:
    """``item_id, total, digest`` of whole items."""
    return items.select("item_id", F.octet_length("payload").cast("bigint").alias("total"), F.sha2("payload", 256).alias("digest"))


def chunk_ok(chunk_bytes: int) -> Column:
    right = (F.sha2("data", 256) == F.col("digest")) & (F.col("len") <= chunk_bytes) & (F.col("len") == F.octet_length("data"))
    return F.coalesce(right, F.lit(False))


def verify_chunks(chunks: DataFrame, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """Chunks with ``ok``: digest recomputed, length as declared and not over the chunk size."""
    return chunks.withColumn("ok", chunk_ok(chunk_bytes))


def validate_geometry(chunks: DataFrame, manifest: DataFrame, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """Chunks with ``fault``: the first reason why a chunk cannot belong to the manifest, or null."""
    m = manifest.select(F.col("id").alias("item_id"), "kind", "size", F.lit(True).alias("known"))
    offset = F.col("chunk_index") * chunk_bytes
    fault = (
        F.when(F.col("known").isNull(), "unknown item")
        .when(F.col("kind") != "file", "not a file")
        .when((F.col("chunk_index") < 0) | (F.col("chunk_index") >= chunk_count(F.col("size"), chunk_bytes)), "index out of range")
        .when(F.col("offset") != offset, "wrong offset")
        .when(F.col("len") != F.least(F.lit(chunk_bytes).cast("bigint"), F.col("size") - offset), "wrong length")
    )
    return chunks.join(m, "item_id", "left").withColumn("fault", fault).drop("kind", "size", "known")


def dedup_chunks(chunks: DataFrame, arrival: str = "arrival") -> DataFrame:
    """The first arrival of each chunk. One aggregate, so repeats shrink before the shuffle."""
    rest = [c for c in chunks.columns if c not in ("item_id", "chunk_index")]
    first = F.min_by(F.struct(*rest), F.col(arrival)).alias("first")
    return chunks.groupBy("item_id", "chunk_index").agg(first).select("item_id", "chunk_index", "first.*")


def route_stray(chunks: DataFrame, transfer_id: str) -> tuple[DataFrame, DataFrame]:
    """Chunks of the active transfer, and all others."""
    active = F.coalesce(F.col("transfer_id") == transfer_id, F.lit(False))
    return chunks.where(active), chunks.where(~active)


def chunk_gaps(chunks: DataFrame, manifest: DataFrame) -> DataFrame:
    """``item_id, kind, start, stop``: byte ranges that are missing or covered twice, head and tail too."""
    per_item = Window.partitionBy("item_id").orderBy("offset", "len")
    reach = F.max(F.col("offset") + F.col("len")).over(per_item.rowsBetween(Window.unboundedPreceding, -1))
    seen = chunks.withColumn("reach", F.coalesce(reach, F.lit(0)))
    holes = seen.where("offset > reach").select("item_id", F.lit("gap").alias("kind"), F.col("reach").alias("start"), F.col("offset").alias("stop"))
    twice = seen.where("offset < reach").select("item_id", F.lit("overlap").alias("kind"), F.col("offset").alias("start"), F.least("reach", F.col("offset") + F.col("len")).alias("stop"))
    ends = chunks.groupBy("item_id").agg(F.max(F.col("offset") + F.col("len")).alias("reach"))
    files = manifest.where("kind = 'file'").select(F.col("id").alias("item_id"), "size")
    tails = files.join(ends, "item_id", "left").withColumn("reach", F.coalesce("reach", F.lit(0))).where("reach < size")
    return holes.unionByName(twice).unionByName(tails.select("item_id", F.lit("gap").alias("kind"), F.col("reach").alias("start"), F.col("size").alias("stop")))


def reassemble_items(chunks: DataFrame) -> DataFrame:
    """``item_id, payload``: chunks joined by offset, for items that have room in a row; ``write_items`` is for larger ones."""
    return chunks.groupBy("item_id").agg(_joined("data", "offset").alias("payload"))


def _joined(value: str, order: str) -> Column:
    """Bytes or texts of a group, joined in order."""
    return F.expr(f"listagg({value}) WITHIN GROUP (ORDER BY {order})")


def chunk_item_digests(chunks: DataFrame, whole_bytes: int = WHOLE_BYTES, group: int = TREE_GROUP) -> DataFrame:
    """``item_id, total, digest`` of whole items from their chunks, each chunk once and in any order of rows.

    Up to ``whole_bytes`` the digest is that of the item's bytes. Beyond, every ``group`` neighbouring
    chunks' digests make a node, every ``group`` nodes one above, until there is one: no group holds more,
    so an item of any size is spread over all tasks. Digests are taken from ``data``, not as declared.
    """
    sizes = chunks.groupBy("item_id").agg(F.sum("len").cast("bigint").alias("total"), F.count("*").alias("n"))
    small = chunks.join(sizes.where(F.col("total") <= whole_bytes), "item_id").groupBy("item_id", "total")
    whole = small.agg(F.sha2(_joined("data", "offset"), 256).alias("digest"))
    large = sizes.where(F.col("total") > whole_bytes)
    most = large.agg(F.max("n")).first()[0]
    if most is None:
        return whole
    level = chunks.select("item_id", F.col("chunk_index").alias("at"), F.sha2("data", 256).alias("d")).join(large, "item_id")
    level = level.withColumn("done", F.lit(False))
    while True:
        node = F.when(F.col("done"), F.any_value("d")).otherwise(F.sha2(_joined("d", "at"), 256))
        level = level.groupBy("item_id", "total", "n", "done", F.floor(F.col("at") / group).alias("at")).agg(node.alias("d"))
        level = level.withColumn("n", F.ceil(F.col("n") / group)).withColumn("done", F.col("n") == 1)
        most = -(-most // group)
        if most <= 1:
            break
    return whole.unionByName(level.select("item_id", "total", F.col("d").alias("digest")))


def _item_status(found: DataFrame, item_ends: DataFrame, how: str) -> DataFrame:
    ends = item_ends.select("item_id", F.col("total").alias("end_total"), F.col("digest").alias("end_digest"))
    total = F.coalesce("total", F.lit(0))
    status = (
        F.when(F.col("end_total").isNull() | (total < F.col("end_total")), "incomplete")
        .when(total != F.col("end_total"), "wrong size")
        .when(F.coalesce("digest", F.sha2(F.lit(""), 256)) != F.col("end_digest"), "wrong digest")
        .otherwise("ok")
    )
    return found.join(ends, "item_id", how).select("item_id", status.alias("status"))


def verify_items(items: DataFrame, item_ends: DataFrame) -> DataFrame:
    """``item_id, status``: ok, incomplete (no end record or bytes missing), wrong size or wrong digest."""
    return _item_status(item_digests(items), item_ends, "left")


def verify_chunked_items(
    chunks: DataFrame, item_ends: DataFrame, whole_bytes: int = WHOLE_BYTES, group: int = TREE_GROUP, expected: DataFrame | None = None
) -> DataFrame:
    """The same from chunks alone, for items of any size. An item without chunks has no bytes.

    ``expected`` has the ``item_id`` of all items that should come: one of which neither a chunk nor an end record came is incomplete.
    """
    found = chunk_item_digests(chunks, whole_bytes, group)
    if expected is not None:
        found = found.join(expected.select("item_id").distinct(), "item_id", "full_outer")
    return _item_status(found, item_ends, "full_outer")
