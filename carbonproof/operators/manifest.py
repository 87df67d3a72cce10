"""Manifests: what is wrong with one, its ordered hash, its summary.

A manifest has ``id, rel_path, kind, size, full_hash, chunk_count, symlink_target, mode``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from carbonproof.functions.canon import dense_ids, digest_tree, framed
from carbonproof.functions.scratch import materialise

# The kinds of entries of a manifest.
KINDS = ("file", "directory", "symlink", "char_device", "block_device")


def ancestors(path: Column) -> Column:
    """All proper prefixes of a path at component borders, the root's empty path first; none for the root."""
    parts = F.split(path, "/")
    prefixes = F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "/"))
    below = F.when(F.size(parts) > 1, F.concat(F.array(F.lit("")), prefixes)).otherwise(F.array(F.lit("")))
    return F.when(path == "", F.expr("cast(array() as array<string>)")).otherwise(below)


def validate_manifest(manifest: DataFrame, declared: int, chunk_bytes: int) -> DataFrame:
    """One row ``(violation, id, rel_path)`` per fault; the order of entries does not matter.

    The manifest is read twice. First every entry marks its id, its path and its ancestors' paths, and the
    marks are counted by key, before the shuffle too, so a root above a million entries is one small
    row. Then entries whose marks meet a faulty count are put out, beside those with a fault of their own.
    """
    m = manifest.select(F.col("id").cast("bigint").alias("id"), "rel_path", "kind", "size", "full_hash", "chunk_count")
    no_marks = F.array().cast("array<struct<what:string,key:string,violation:string>>")

    def text(x: str | None) -> Column:
        return F.lit(x).cast("string")

    def mark(what: str, key: Column, violation: str) -> Column:
        return F.struct(text(what).alias("what"), key.alias("key"), text(violation).alias("violation"))

    keys = F.array(mark("id", F.col("id").cast("string"), "duplicate id"), mark("path", F.col("rel_path"), "duplicate path"))
    above = F.coalesce(F.transform(ancestors(F.col("rel_path")), lambda a: mark("above", a, "ancestor not a directory")), no_marks)
    other = F.when(F.col("kind") != "directory", F.array(mark("solid", F.col("rel_path"), ""))).otherwise(no_marks)
    marks = F.explode(F.concat(keys, above, other, F.array(mark("all", F.lit(""), "")))).alias("k")
    solid, what = F.col("what") == "solid", F.when(F.col("what") == "solid", "above").otherwise(F.col("what"))
    counts = m.select(marks).select("k.*").groupBy(what.alias("what"), "key").agg(F.count("*").alias("n"), F.count_if(solid).alias("solid"))
    faulty = (F.col("what").isin("id", "path") & (F.col("n") > 1) & F.col("key").isNotNull()) | ((F.col("what") == "above") & (F.col("solid") > 0) & (F.col("n") > F.col("solid")))
    root = (F.col("what") == "path") & (F.col("key") == "")
    counts = materialise(counts.where(faulty | root | (F.col("what") == "all")).withColumn("faulty", faulty), "marks")

    is_file = F.col("kind") == "file"
    expected = F.when(is_file, F.ceil(F.col("size") / chunk_bytes)).otherwise(0)
    alone = {
        "path component": (F.col("rel_path") != "") & F.exists(F.split("rel_path", "/"), lambda p: p.isin("", ".", "..")),
        "unknown kind": ~F.col("kind").isin(*KINDS),
        "missing size": is_file & F.col("size").isNull(),
        "missing digest": is_file & F.col("full_hash").isNull(),
        "chunk count": F.coalesce(F.col("chunk_count"), F.lit(-1)) != F.coalesce(expected, F.lit(-1)),
    }
    own = F.array_compact(F.array(*[F.when(fault, mark("own", text(None), name)) for name, fault in alone.items()]))
    bad = counts.where("faulty").select("what", "key", F.lit(True).alias("bad"))
    met = m.select("id", "rel_path", F.explode(F.concat(keys, above, own)).alias("k")).select("id", "rel_path", "k.*")
    found = met.join(bad, ["what", "key"], "left").where((F.col("what") == "own") | F.col("bad"))
    times = F.when(F.col("violation") == "ancestor not a directory", 1).otherwise(F.col("n")).cast("int")  # however many such ancestors
    each = found.groupBy("violation", "id", "rel_path").agg(F.count("*").alias("n")).select("violation", "id", "rel_path", F.explode(F.array_repeat(F.lit(0), times)).alias("_")).drop("_")

    n = F.coalesce(F.max(F.when(F.col("what") == "all", F.col("n"))), F.lit(0))
    roots = F.coalesce(F.max(F.when(root, F.col("n"))), F.lit(0))
    of_all = {"entry count": n != declared, "empty manifest": n == 0, "root path not empty": (n > 0) & (roots == 0)}
    whole = counts.agg(F.array_compact(F.array(*[F.when(fault, F.lit(name)) for name, fault in of_all.items()])).alias("v"))
    return each.unionByName(whole.select(F.explode("v").alias("violation"), F.lit(None).cast("bigint").alias("id"), text(None).alias("rel_path")))


def _entry(*columns: str) -> Column:
    return F.sha2(F.concat(*[framed(F.col(c).cast("string")) for c in columns]), 256)


def manifest_hash(manifest: DataFrame) -> DataFrame:
    """One row ``manifest_hash``: order-sensitive digest of all entries by ascending id."""
    d = _entry("id", "rel_path", "kind", "size", "full_hash", "chunk_count")
    ranked = dense_ids(manifest.select(F.col("id").alias("key"), d.alias("d")), ["key"], "id")
    return digest_tree(ranked).select(F.col("root").alias("manifest_hash"))


def transfer_summary(manifest: DataFrame) -> DataFrame:
    """Counts by kind, total bytes, and the ordered hash without id, mode and chunk count; one row."""
    counts = manifest.agg(
        F.count_if(F.col("kind") == "file").alias("files"),
        F.count_if(F.col("kind") == "directory").alias("directories"),
        F.count_if(F.col("kind") == "symlink").alias("symlinks"),
        F.count_if(F.col("kind").isin("char_device", "block_device")).alias("devices"),
        F.coalesce(F.sum(F.when(F.col("kind") == "file", F.col("size"))), F.lit(0)).cast("bigint").alias("total_bytes"),
    )
    d = _entry("rel_path", "kind", "size", "full_hash")
    ranked = dense_ids(manifest.select(F.col("id").alias("key"), d.alias("d")), ["key"], "id")
    root = digest_tree(ranked).select(F.col("root").alias("transfer_hash"))
    return counts.join(root, F.lit(True))


SUMMARY_FIELDS = ("files", "directories", "symlinks", "devices", "total_bytes", "transfer_hash")


def compare_summaries(a: DataFrame, b: DataFrame) -> DataFrame:
    """``field, a, b, equal`` for every field of two one-row summaries."""

    def long(df: DataFrame, name: str) -> DataFrame:
        return df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).cast("string").alias(name)) for c in SUMMARY_FIELDS])).alias("x")).select("x.*")

    return long(a, "a").join(long(b, "b"), "field").withColumn("equal", F.col("a").eqNullSafe(F.col("b")))
