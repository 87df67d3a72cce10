"""Canonical row encodings, order-free checksums and the ordered digest tree."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from carbonproof.functions.scratch import materialise

#: Entries under one node of the digest tree.
TREE_GROUP = 128


def canonical_value(df: DataFrame, name: str) -> Column:
    """A column as text that other engines produce alike: 4 decimal places, microseconds."""
    kind, value = df.schema[name].dataType, F.col(f"`{name}`")
    if isinstance(kind, T.StringType):
        return value
    if isinstance(kind, T.FloatType | T.DoubleType):
        return value.cast("decimal(18,4)").cast("string")
    if isinstance(kind, T.TimestampType | T.TimestampNTZType):
        return F.date_format(value, "yyyy-MM-dd HH:mm:ss.SSSSSS")
    if isinstance(kind, T.ArrayType | T.MapType | T.StructType):
        return F.to_json(F.struct(value.alias("v")))
    if isinstance(kind, T.BinaryType):
        return F.hex(value)
    return value.cast("string")


def framed(value: Column) -> Column:
    """Length-prefixed field, so that neighbouring fields cannot run together; a fixed mark for NULL."""
    return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("N;"))


def canonical_row(df: DataFrame, columns: Sequence[str] | None = None) -> Column:
    """All fields of a row, framed and joined in the order given."""
    return F.concat(*[framed(canonical_value(df, c)) for c in (columns or df.columns)])


def exact_row_hash(df: DataFrame, columns: Sequence[str] | None = None) -> Column:
    """64-bit hash of a row without any rounding; null flags keep (NULL, 1) and (1, NULL) apart."""
    columns = columns or df.columns
    return F.xxhash64(*[F.col(f"`{c}`") for c in columns], *[F.col(f"`{c}`").isNull() for c in columns])


def hash60(text: Column) -> Column:
    """The first 60 bits of the MD5 of a text, as a long."""
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("bigint")


def row_hashes(df: DataFrame, columns: Sequence[str] | None = None, keep: Sequence[str] = ()) -> DataFrame:
    """``keep`` and ``_hash``, the 60-bit hash of the canonical row; each field is formatted once."""
    columns = list(columns or df.columns)
    fields = df.select(*keep, *[canonical_value(df, c).alias(f"_field{k}") for k, c in enumerate(columns)])
    return fields.select(*keep, hash60(F.concat(*[framed(F.col(f"_field{k}")) for k in range(len(columns))])).alias("_hash"))


def checksum(hashed: str) -> Column:
    """Order-free checksum of a group of 60-bit hashes: their sum, so that a doubled row does not cancel out.

    Three parts of 20 bits are summed as longs, which 2^43 rows cannot overflow, and put together once a group.
    """
    total = F.lit(0).cast("decimal(38,0)")
    for shift in (0, 20, 40):
        part = F.coalesce(F.sum(F.shiftright(hashed, shift).bitwiseAND((1 << 20) - 1)), F.lit(0)).cast("decimal(38,0)")
        total = total + (part * F.lit(1 << shift).cast("decimal(20,0)")).cast("decimal(38,0)")
    return total.cast("decimal(38,0)")


def dense_ids(df: DataFrame, order: Sequence[str], name: str, start: int = 0, partitions: int | None = None) -> DataFrame:
    """Number rows from ``start`` in the order of ``order`` without a single-task window.

    Rows are range-partitioned, sorted and written, since borders are sampled anew each time; a row's
    number is its place in its partition plus the sizes of the partitions before, one row each.
    """
    parts = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = df.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    placed = materialise(placed.withColumn("_part", F.shiftright("_at", 33)), "ordered")
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = placed.groupBy("_part").agg(F.count("*").alias("_n")).select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    place = F.col("_at").bitwiseAND((1 << 33) - 1) + F.col("_offset") + start
    return placed.join(F.broadcast(offsets), "_part").withColumn(name, place).drop("_at", "_part", "_offset")


def digest_tree(entries: DataFrame, group: int = TREE_GROUP) -> DataFrame:
    """One row ``root``: order-sensitive digest of rows ``(id, d)`` with dense ids from 0.

    Each level hashes the joined digests of ``group`` neighbours, so no task sees more than that;
    at least one level is built, and no entries give the digest of the empty text.
    """
    n, level = entries.count(), entries.select("id", "d")
    while True:
        level = level.groupBy(F.floor(F.col("id") / group).alias("id")).agg(
            F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("id", "d"))), lambda x: x["d"]), ""), 256).alias("d")
        )
        n = -(-n // group)
        if n <= 1:
            break
    return level.agg(F.coalesce(F.max("d"), F.sha2(F.lit(""), 256)).alias("root"))
