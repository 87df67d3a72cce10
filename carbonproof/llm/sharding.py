"""Size-tiered compaction of immutable shards under a versioned manifest.

Arrivals are appended as small shards. A compaction puts the shards in tiers by size, takes runs of
neighbours of one tier and merges each run into shards below twice the target size; the shards it
replaces stay on disk for readers of older versions. A version of the manifest becomes visible in one
step: its rows are written first, then a whole pointer file is renamed to the number of the version, which
fails if another writer already has that version.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from carbonproof.functions.canon import dense_ids
from carbonproof.llm.common import dropping_shuffles, materialise

#: Rows of a table of shards that are broadcast, at most; beyond, the planner decides how to join.
MAX_BROADCAST = 200_000
#: Columns that the store adds to the rows.
RESERVED = ("_shard", "_sequence", "_part", "_folder", "_target", "_first")
MANIFEST_SCHEMA = "shard_id string, folder string, sequence bigint, tier int, n_rows bigint, n_bytes bigint"


@dataclass(frozen=True)
class Policy:
    """Sizes in bytes of the sized column; ``fanout`` is the ratio of neighbouring tiers."""

    target_bytes: int = 64 << 20
    smallest_bytes: int = 1 << 20
    fanout: int = 4
    min_run: int = 2

    def tier(self, n_bytes: Column) -> Column:
        """0 below ``smallest_bytes * fanout``, then one more for each factor ``fanout``; exact in integers."""
        bound, out, tier = self.smallest_bytes * self.fanout, F.lit(0), 1
        while bound < self.target_bytes:
            out = F.when(n_bytes >= bound, tier).otherwise(out)
            bound, tier = bound * self.fanout, tier + 1
        return F.when(n_bytes >= self.target_bytes, tier).otherwise(out).cast("int")


def shard_name(sequence: Column) -> Column:
    """Shards are named after their first arrival; with the folder of the write the name is unique."""
    return F.format_string("s%015d", sequence)


class ShardStore:
    """A folder of shards of one table and the versions of its manifest.

    All columns of the appended rows are kept, nulls and repeated rows too; a null arrival or size
    counts as 0; a negative arrival and columns named as in RESERVED are refused. An empty append commits a version
    without new shards, and reading a store without rows raises ``ValueError``.
    """

    def __init__(self, spark: SparkSession, root: str, policy: Policy | None = None) -> None:
        self.spark, self.root, self.policy = spark, root.rstrip("/"), policy or Policy()

    def _fs(self, path: str):
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def version(self) -> int:
        """The newest committed version; 0 for a store without any."""
        fs, p = self._fs(f"{self.root}/versions")
        if not fs.exists(p):
            return 0
        return max((int(x.getPath().getName()) for x in fs.listStatus(p) if x.getPath().getName().isdigit()), default=0)

    def manifest(self, version: int | None = None) -> DataFrame:
        """One row per live shard of a version."""
        version = self.version() if version is None else version
        if version == 0:
            return self.spark.createDataFrame([], MANIFEST_SCHEMA)
        fs, p = self._fs(f"{self.root}/versions/{version:08d}")
        stream = fs.open(p)
        name = bytes(stream.readAllBytes()).decode()
        stream.close()
        return self.spark.read.schema(MANIFEST_SCHEMA).parquet(f"{self.root}/manifests/{name}")

    def _commit(self, rows: DataFrame, base: int) -> int:
        """Make ``rows`` version ``base + 1``, or fail if that version exists."""
        name = f"{base + 1:08d}-{uuid.uuid4().hex}"
        rows.select("shard_id", "folder", "sequence", "tier", "n_rows", "n_bytes").coalesce(1).write.parquet(f"{self.root}/manifests/{name}")
        fs, draft = self._fs(f"{self.root}/drafts/{name}")
        out = fs.create(draft, False)
        out.write(bytearray(name.encode()))
        out.close()
        _, p = self._fs(f"{self.root}/versions/{base + 1:08d}")
        fs.mkdirs(p.getParent())
        if fs.exists(p) or not fs.rename(draft, p):
            fs.delete(draft, False)
            raise FileExistsError(f"version {base + 1} exists already")
        return base + 1

    def _place(self, folder: str) -> str:
        return f"{self.root}/data/_folder={folder}"

    def _live(self, shards: DataFrame, *extra: str) -> DataFrame:
        """The rows of shards ``(shard_id, folder, ...)`` with ``_shard``, ``_folder`` and the extra columns.

        One scan however many writes there were: folders and shards are partitions of one table, and the join prunes them.
        """
        folders = [r[0] for r in shards.select("folder").distinct().collect()]
        if not folders:
            raise ValueError(f"{self.root} holds no rows")
        held = self.spark.read.option("basePath", f"{self.root}/data").parquet(*map(self._place, sorted(folders)))
        held = held.withColumn("_shard", F.col("_shard").cast("string")).withColumn("_folder", F.col("_folder").cast("string"))
        wanted = shards.select(F.col("shard_id").alias("_shard"), F.col("folder").alias("_folder"), *extra)
        return held.join(self._small(wanted), ["_shard", "_folder"])

    def _small(self, shards: DataFrame) -> DataFrame:
        """Broadcast a table of shards if it has so few rows."""
        return F.broadcast(shards) if shards.limit(MAX_BROADCAST + 1).count() <= MAX_BROADCAST else shards

    def _write(self, rows: DataFrame, n_shards: int, size: Column) -> DataFrame:
        """Write rows that have ``_part`` (0 to n_shards-1), ``_shard``, ``_sequence``; return their manifest rows.

        Every shard is one file, written by one task; the shard's statistics are read back from it.
        """
        folder = f"f{uuid.uuid4().hex}"
        placed = rows.repartitionById(max(n_shards, 1), F.col("_part").cast("int")).drop("_part")
        with dropping_shuffles(self.spark):
            placed.write.partitionBy("_shard").option("compression", "zstd").parquet(self._place(folder))
        written = self.spark.read.schema(placed.schema).parquet(self._place(folder))
        return written.groupBy(F.col("_shard").cast("string").alias("shard_id")).agg(
            F.lit(folder).alias("folder"), F.min("_sequence").alias("sequence"), F.count("*").alias("n_rows"), F.sum(size).cast("bigint").alias("n_bytes")
        ).withColumn("tier", self.policy.tier(F.col("n_bytes")))

    def append(self, rows: DataFrame, arrival: Column, size: Column) -> int:
        """Append rows as small shards, one per value of ``arrival`` (a long), and commit a version.

        Arrivals are small by contract; values are dealt to tasks by rank, so no task gets two unless
        there are more arrivals than tasks. The order of arrivals is the order of shards.
        """
        if taken := {c.lower() for c in rows.columns} & set(RESERVED):
            raise ValueError(f"reserved column names: {sorted(taken)}")
        if not rows.where(arrival.cast("bigint") < 0).isEmpty():
            raise ValueError("negative arrivals")
        base, old = self.version(), self.manifest()
        start = old.agg(F.coalesce(F.max("sequence"), F.lit(-1))).first()[0] + 1
        dealt = rows.withColumn("_sequence", F.coalesce(arrival.cast("bigint"), F.lit(0)) + start)
        ids = dealt.select("_sequence").distinct()
        n = min(ids.count(), int(self.spark.conf.get("spark.sql.shuffle.partitions")))
        placed = dealt.withColumn("_part", F.pmod("_sequence", F.lit(max(n, 1)))).withColumn("_shard", shard_name(F.col("_sequence")))
        new = self._write(placed, n, size)
        return self._commit(old.unionByName(new, allowMissingColumns=True), base)

    def plan(self) -> DataFrame:
        """Shards to merge: manifest rows with ``run`` and ``piece``; each (run, piece) becomes one shard.

        A run is a row of neighbours (by sequence) of one tier below the target. Sizes are summed
        along the run and cut at every multiple of the target. Runs that would leave as many shards
        as they have stay for a later compaction. The table has a row per shard, not per record; it is
        gone through by ranges of the sequence, and what leads from one range into the next is a row for each.
        """
        target, parts = self.policy.target_bytes, int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        shards = self.manifest().repartitionByRange(parts, "sequence").sortWithinPartitions("sequence")
        shards = materialise(shards.withColumn("part", F.spark_partition_id()), "plan")
        order = Window.partitionBy("part").orderBy("sequence")
        shards = shards.withColumn("change", (F.lag("tier").over(order) != F.col("tier")).cast("int"))
        ends = shards.groupBy("part").agg(F.min_by("tier", "sequence").alias("first_tier"), F.max_by("tier", "sequence").alias("last_tier"), F.coalesce(F.sum("change"), F.lit(0)).alias("changes"))
        ranges = Window.orderBy("part")  # a row for each range
        ends = ends.withColumn("opens", F.coalesce((F.lag("last_tier").over(ranges) != F.col("first_tier")).cast("int"), F.lit(0)))
        ends = ends.select("part", "opens", (F.sum(F.col("opens") + F.col("changes")).over(ranges) - F.col("changes")).alias("first_run"))
        run = F.col("first_run") + F.sum(F.coalesce("change", F.lit(0))).over(order)
        runs = shards.join(F.broadcast(ends), "part").withColumn("run", run).where(F.col("n_bytes") < target)
        inside = Window.partitionBy("run", "part").orderBy("sequence")
        over = Window.partitionBy("run").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
        carried = runs.groupBy("run", "part").agg(F.sum("n_bytes").alias("bytes")).select("run", "part", F.coalesce(F.sum("bytes").over(over), F.lit(0)).alias("carried"))
        before = F.col("carried") + F.sum("n_bytes").over(inside) - F.col("n_bytes")
        pieces = runs.join(carried, ["run", "part"]).withColumn("piece", F.floor(before / target).cast("bigint"))
        groups = pieces.groupBy("run", "piece").agg(F.count("*").alias("members"), F.min("sequence").alias("first"))
        merged = groups.where(F.col("members") >= self.policy.min_run)
        return pieces.join(merged, ["run", "piece"]).select("shard_id", "folder", "sequence", "tier", "n_rows", "n_bytes", "run", "piece", "members", "first")

    def compact(self, size: Column) -> bool:
        """Merge what ``plan`` names and commit; False if there is nothing to merge."""
        base, old = self.version(), self.manifest()
        merges = materialise(self.plan().select("shard_id", "folder", F.col("first").alias("_first")), "merges")
        targets = dense_ids(merges.select("_first").distinct(), ["_first"], "_target")
        n = targets.count()
        if not n:
            return False
        merges = materialise(merges.join(targets, "_first"), "merges")
        moved = self._live(merges, "_target", "_first").withColumnRenamed("_target", "_part").withColumn("_sequence", F.col("_first"))
        new = self._write(moved.withColumn("_shard", shard_name(F.col("_first"))).drop("_first", "_folder"), n, size)
        kept = old.join(self._small(merges.select("shard_id", "folder")), ["shard_id", "folder"], "left_anti")
        self._commit(kept.unionByName(new, allowMissingColumns=True), base)
        return True

    def compact_all(self, size: Column) -> int:
        """Compact until nothing is left to merge; returns the version."""
        while self.compact(size):
            pass
        return self.version()

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version with the columns ``_shard`` and ``_sequence``."""
        return self._live(self.manifest(version)).drop("_folder")
