"""Fingerprints, immutability audit, restore verification and constraint checks."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from carbonproof.functions.canon import canonical_row, checksum, dense_ids, digest_tree, hash60, row_hashes
from carbonproof.functions.scratch import materialise


class SourceChanged(RuntimeError):
    """The source is not what it was when the run began."""


def row_digests(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """``df`` with ``row_digest``, the SHA-256 of the canonical row."""
    return df.withColumn("row_digest", F.sha2(canonical_row(df, columns), 256))


def table_fingerprint(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """One row ``n_rows, checksum`` that does not depend on the order of rows or on partitions."""
    return row_hashes(df, columns).agg(F.count("*").alias("n_rows"), checksum("_hash").alias("checksum"))


def schema_text(df: DataFrame) -> str:
    return ",".join(f"{f.name}:{f.dataType.simpleString()}" for f in df.schema)


def _per_table(tables: Mapping[str, DataFrame]) -> DataFrame:
    parts = [
        table_fingerprint(df).select(
            F.lit(name).alias("table"), "n_rows", "checksum", F.sha2(F.lit(schema_text(df)), 256).alias("schema_digest")
        )
        for name, df in sorted(tables.items())
    ]
    return reduce(DataFrame.unionByName, parts)


def database_fingerprint(tables: Mapping[str, DataFrame]) -> DataFrame:
    """A row per table, and one with the overall digest of the tables in order of their names as ``database_digest``."""
    each = materialise(_per_table(tables), "fingerprints")
    d = F.sha2(F.concat_ws("|", "table", F.col("n_rows").cast("string"), F.col("checksum").cast("string"), "schema_digest"), 256)
    root = digest_tree(dense_ids(each.select("table", d.alias("d")), ["table"], "id", partitions=1))
    return each.join(root.select(F.col("root").alias("database_digest")), F.lit(True))


def sampled_fingerprint(df: DataFrame, key: str, modulus: int) -> DataFrame:
    """``n_rows`` of the whole table, and count and checksum of the rows whose key hashes to 0 of ``modulus``.

    The sample depends on key values only, never on how rows are laid out.
    """
    key_hash = hash60(F.col(f"`{key}`").cast("string"))
    rows = row_hashes(df.withColumn("_chosen", F.coalesce(key_hash % modulus == 0, F.lit(False))), df.columns, keep=["_chosen"])
    sampled = rows.withColumn("_hash", F.when(F.col("_chosen"), F.col("_hash")))
    return sampled.agg(F.count("*").alias("n_rows"), F.count_if("_chosen").alias("n_sampled"), checksum("_hash").alias("checksum"))


def partition_fingerprints(df: DataFrame, by: Sequence[str]) -> DataFrame:
    """The fingerprint of each group, to find where a table changed."""
    return row_hashes(df, keep=by).groupBy(*by).agg(F.count("*").alias("n_rows"), checksum("_hash").alias("checksum"))


def listing_fingerprint(inventory: DataFrame, columns: Sequence[str] = ("rel_path", "kind", "size", "full_hash")) -> DataFrame:
    """Fingerprint of an inventory over paths and metadata (or keys and tags)."""
    return table_fingerprint(inventory, list(columns))


def audit_immutability(before: DataFrame, after: DataFrame, by: Sequence[str]) -> DataFrame:
    """``by`` and ``change`` (added, removed, changed) of the groups whose fingerprints differ."""
    a = before.select(*by, F.col("n_rows").alias("a_rows"), F.col("checksum").alias("a_sum"))
    b = after.select(*by, F.col("n_rows").alias("b_rows"), F.col("checksum").alias("b_sum"))
    change = F.when(F.col("a_rows").isNull(), "added").when(F.col("b_rows").isNull(), "removed").otherwise("changed")
    same = F.col("a_rows").eqNullSafe(F.col("b_rows")) & F.col("a_sum").eqNullSafe(F.col("b_sum"))
    keys = _same_keys(by)
    a, b = _aliased(a, "a", by), _aliased(b, "b", by)
    return a.join(b, keys, "full_outer").where(~same).select(*[F.coalesce(f"a_{c}", f"b_{c}").alias(c) for c in by], change.alias("change"))


def _aliased(df: DataFrame, side: str, by: Sequence[str]) -> DataFrame:
    return df.select(*[F.col(c).alias(f"{side}_{c}") for c in by], *[c for c in df.columns if c not in by])


def _same_keys(by: Sequence[str]) -> Column:
    return reduce(lambda x, y: x & y, [F.col(f"a_{c}").eqNullSafe(F.col(f"b_{c}")) for c in by])


def require_unchanged(changes: DataFrame) -> None:
    """Raise if an audit found anything."""
    if first := changes.limit(1).collect():
        raise SourceChanged(f"the source changed during the run, for one in {first[0].asDict()}")


def reconcile(src: Mapping[str, DataFrame], dst: Mapping[str, DataFrame]) -> DataFrame:
    """Rows and checksums of each table on both sides, and whether they match; absent tables are null."""
    a = _per_table(src).select("table", F.col("n_rows").alias("src_rows"), F.col("checksum").alias("src_checksum"))
    b = _per_table(dst).select("table", F.col("n_rows").alias("dst_rows"), F.col("checksum").alias("dst_checksum"))
    match = F.col("src_rows").eqNullSafe(F.col("dst_rows")) & F.col("src_checksum").eqNullSafe(F.col("dst_checksum"))
    return a.join(b, "table", "full_outer").withColumn("match", match)


def row_diff(src: DataFrame, dst: DataFrame, keys: Sequence[str], columns: Sequence[str] | None = None) -> DataFrame:
    """``keys`` and ``status`` (added, removed, changed, same) of every key; a row travels as its MD5, not whole.

    Keys are taken to be unique on each side and not null.
    """
    columns = list(columns or src.columns)
    a = src.select(*keys, F.md5(canonical_row(src, columns)).alias("a_row"))
    b = dst.select(*keys, F.md5(canonical_row(dst, columns)).alias("b_row"))
    status = (
        F.when(F.col("a_row").isNull(), "added").when(F.col("b_row").isNull(), "removed").when(F.col("a_row") != F.col("b_row"), "changed").otherwise("same")
    )
    return a.join(b, list(keys), "full_outer").select(*keys, status.alias("status"))


def column_diff(src: DataFrame, dst: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``column_name, mismatches`` over the keys that both sides have."""
    rest = [c for c in src.columns if c not in keys]
    a = src.select(*keys, *[F.col(c).alias(f"a_{c}") for c in rest])
    b = dst.select(*keys, *[F.col(c).alias(f"b_{c}") for c in rest])
    counts = a.join(b, list(keys)).agg(*[F.count_if(~F.col(f"a_{c}").eqNullSafe(F.col(f"b_{c}"))).alias(c) for c in rest])
    pairs = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).alias("mismatches")) for c in rest])
    return counts.select(F.explode(pairs).alias("x")).select("x.*")


def bag_diff(src: DataFrame, dst: DataFrame) -> DataFrame:
    """Rows that one side has more often: ``only_in``, the columns, and ``surplus``.

    Rows of one side count up, of the other down; equal rows meet in one aggregation, the only shuffle.
    """
    columns = src.columns
    count = fresh_name(columns, "surplus_")
    both = src.withColumn(count, F.lit(1)).unionByName(dst.select(*columns).withColumn(count, F.lit(-1)))
    net = both.groupBy(*[F.col(f"`{c}`") for c in columns]).agg(F.sum(count).alias(count)).where(F.col(count) != 0)
    side = F.when(F.col(count) > 0, "src").otherwise("dst")
    return net.select(side.alias("only_in"), *[F.col(f"`{c}`") for c in columns], F.abs(count).alias("surplus"))


def fresh_name(taken: Sequence[str], base: str) -> str:
    """A column name that is not taken in any case."""
    while base.lower() in {c.lower() for c in taken}:
        base += "_"
    return base


def destination_satisfies(manifest: DataFrame, inventory: DataFrame) -> DataFrame:
    """``id, rel_path, reason`` of the entries that a target does not provably hold; none means nothing to copy."""
    there = inventory.select("rel_path", F.col("kind").alias("has_kind"), F.col("size").alias("has_size"), F.col("full_hash").alias("has_hash"))
    reason = (
        F.when(F.col("has_kind").isNull(), "missing")
        .when(F.col("has_kind") != F.col("kind"), "wrong kind")
        .when(~F.col("kind").isin("file", "directory"), "unproven")
        .when((F.col("kind") == "file") & ~F.col("size").eqNullSafe(F.col("has_size")), "wrong size")
        .when((F.col("kind") == "file") & ~F.col("full_hash").eqNullSafe(F.col("has_hash")), "wrong digest")
    )
    return manifest.join(there, "rel_path", "left").withColumn("reason", reason).where("reason is not null").select("id", "rel_path", "reason")


def check_unique(df: DataFrame, keys: Sequence[str], primary: bool = False) -> DataFrame:
    """``keys`` and ``n`` of keys that occur twice; a primary key must also not be null, a plain one ignores nulls."""
    has_null = reduce(lambda x, y: x | y, [F.col(c).isNull() for c in keys])
    rows = df if primary else df.where(~has_null)
    bad = F.col("n") > 1
    return rows.groupBy(*keys).agg(F.count("*").alias("n")).where((bad | has_null) if primary else bad)


def check_foreign_key(child: DataFrame, fk: str, parent: DataFrame, pk: str) -> DataFrame:
    """``fk, n``: values without a parent and the rows that have them; NULL is allowed.

    The child is counted by value first, so a value that many rows share is joined once.
    """
    values = child.where(F.col(fk).isNotNull()).groupBy(fk).agg(F.count("*").alias("n"))
    return values.join(parent.select(F.col(pk).alias("_pk")), F.col(fk) == F.col("_pk"), "left_anti")


def check_not_null(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``column_name, nulls`` in one pass."""
    counts = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in columns])
    pairs = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).alias("nulls")) for c in columns])
    return counts.select(F.explode(pairs).alias("x")).select("x.*")


def check_predicate(df: DataFrame, rules: Mapping[str, str]) -> DataFrame:
    """``rule, failing`` of each condition; a NULL result passes."""
    counts = df.agg(*[F.count_if(~F.coalesce(F.expr(e), F.lit(True))).alias(name) for name, e in rules.items()])
    pairs = F.array(*[F.struct(F.lit(name).alias("rule"), F.col(f"`{name}`").alias("failing")) for name in rules])
    return counts.select(F.explode(pairs).alias("x")).select("x.*")


def sequence_restart(tables: Mapping[str, tuple[DataFrame, str]], recorded: Mapping[str, int] | None = None) -> DataFrame:
    """``table, next_value, recorded, behind``: where each sequence must go on, and whether a recorded value is too low."""
    parts = []
    for name, (df, key) in sorted(tables.items()):
        value = (recorded or {}).get(name)
        following = F.coalesce(F.max(key), F.lit(0)).cast("bigint") + 1
        parts.append(df.agg(following.alias("next_value")).select(F.lit(name).alias("table"), "next_value", F.lit(value).cast("bigint").alias("recorded")))
    return reduce(DataFrame.unionByName, parts).withColumn("behind", F.coalesce(F.col("recorded") < F.col("next_value"), F.lit(False)))


