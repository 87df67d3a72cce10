"""Copy plans: size estimates, items, totals, order, rendering."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from carbonproof.functions.canon import canonical_row, dense_ids
from carbonproof.operators.manifest import ancestors
from carbonproof.plans.preflight import FORMAT_VERSION

# The kinds of restored objects in the order in which they are restored.
RESTORE_ORDER = ("role", "database", "schema", "table", "data", "constraint", "index", "sequence", "grant")
# Binary units.
UNITS = ("B", "KiB", "MiB", "GiB", "TiB")


def size_estimates(df: DataFrame, by: Sequence[str]) -> DataFrame:
    """Rows and bytes of the canonical form per group."""
    return df.groupBy(*by).agg(F.count("*").alias("n_rows"), F.sum(F.octet_length(canonical_row(df))).cast("bigint").alias("estimated_bytes"))


def build_plan_items(estimates: DataFrame, kind: str, name: str) -> DataFrame:
    """``id, ordinal, kind, name, estimated_bytes, meta``: one item per estimate, numbered from 1 by name."""
    numbered = dense_ids(estimates.withColumn("name", F.col(name).cast("string")), ["name"], "id", start=1)
    return numbered.select(
        "id", F.lit(_ordinal(kind)).alias("ordinal"), F.lit(kind).alias("kind"), "name", "estimated_bytes",
        F.to_json(F.struct(F.col("n_rows").alias("rows"))).alias("meta"),
    )


def _ordinal(kind: str) -> int:
    return RESTORE_ORDER.index(kind) if kind in RESTORE_ORDER else len(RESTORE_ORDER)


def plan_totals(items: DataFrame) -> DataFrame:
    """Items and bytes per kind; the grand total has the kind NULL and ``is_total``."""
    return items.rollup("kind").agg(
        F.count("*").alias("items"), F.coalesce(F.sum("estimated_bytes"), F.lit(0)).cast("bigint").alias("bytes"), (F.grouping("kind") == 1).alias("is_total")
    )


def order_plan_items(items: DataFrame) -> DataFrame:
    """Items with ``position`` from 0 in restore order, ties by id; unknown kinds come last."""
    rank = F.lit(len(RESTORE_ORDER))
    for k, kind in enumerate(RESTORE_ORDER):
        rank = F.when(F.col("kind") == kind, k).otherwise(rank)
    return dense_ids(items.withColumn("ordinal", rank.cast("int")), ["ordinal", "id"], "position")


def human_size(size: Column, largest: str = UNITS[-1]) -> Column:
    """A byte count in the largest binary unit that fits, up to ``largest``; two decimals, none for bytes."""
    out = F.concat(size.cast("string"), F.lit(" B"))
    for k, unit in enumerate(UNITS[1 : UNITS.index(largest) + 1], start=1):
        scaled = F.bround(size.cast("decimal(38,10)") / F.lit(1024**k).cast("decimal(20,0)"), 2).cast("decimal(20,2)").cast("string")
        out = F.when(size >= 1024**k, F.concat(scaled, F.lit(f" {unit}"))).otherwise(out)
    return out


def plan_header(items: DataFrame, module: str, mode: str, created_at: str, summary: str, algorithm: str = "sha256") -> DataFrame:
    """One row that describes a plan: version, module, mode, creation, summary, number and bytes of items, integrity."""
    fixed = {"format_version": FORMAT_VERSION, "module": module, "mode": mode, "created_at": created_at, "source_summary": summary, "integrity": algorithm}
    totals = items.agg(F.count("*").alias("n_items"), F.coalesce(F.sum("estimated_bytes"), F.lit(0)).cast("bigint").alias("estimated_bytes"))
    return totals.select(*[F.lit(v).alias(k) for k, v in fixed.items()], "n_items", "estimated_bytes")


def render_header(header: DataFrame, largest: str = UNITS[-1]) -> DataFrame:
    """``line_no, line``: the display lines above the items of a plan, their bytes in units up to ``largest``."""
    lines = [
        F.format_string("%s plan for %s, made at %s", "mode", "module", "created_at"),
        F.concat(F.lit("source: "), "source_summary"),
        F.concat(F.col("n_items").cast("string"), F.lit(" items of about "), human_size(F.col("estimated_bytes"), largest), F.lit(", digests by "), "integrity"),
    ]
    return header.select(F.posexplode_outer(F.array(*lines)).alias("line_no", "line"))


def render_plan(items: DataFrame) -> DataFrame:
    """``id, line``: one display line per item."""
    return items.select("id", F.concat_ws(" ", F.concat(F.lit("["), "kind", F.lit("]")), "name", F.concat(F.lit("("), human_size(F.col("estimated_bytes")), F.lit(")"))).alias("line"))


def directory_rollup(inventory: DataFrame) -> DataFrame:
    """``directory, files, bytes`` of every directory's subtree; ancestors are exploded, so the join is a grouping."""
    files = inventory.where("kind = 'file'").select(F.explode(ancestors(F.col("rel_path"))).alias("directory"), "size")
    return files.groupBy("directory").agg(F.count("*").alias("files"), F.coalesce(F.sum("size"), F.lit(0)).cast("bigint").alias("bytes"))


def estimate_accuracy(items: DataFrame, actual: DataFrame, tolerance: float) -> DataFrame:
    """``name, estimated_bytes, actual_bytes, outside``: whether the size leaves the estimate by more than the tolerance."""
    outside = F.abs(F.col("actual_bytes") - F.col("estimated_bytes")) > F.col("estimated_bytes") * F.lit(tolerance)
    return items.select("name", "estimated_bytes").join(actual.select("name", "actual_bytes"), "name").withColumn("outside", outside)
