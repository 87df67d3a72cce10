"""Readers: inventories of files, their payloads, relational tables, document collections."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from carbonproof.functions.canon import dense_ids
from carbonproof.sources.tree import file_contents, scan_tree

#: Bytes of a chunk unless said otherwise.
CHUNK_BYTES = 1 << 20


def _relative(uri: str):
    """The path below the root: what follows the first place of the root's own path, whatever scheme either is written with."""
    scheme = r"^[a-zA-Z][a-zA-Z0-9+.-]*:(//[^/]*)?"
    root = "/" + re.sub(scheme, "", uri).strip("/") + "/"
    place = F.regexp_replace("path", scheme, "")
    return F.substring(place, F.locate(root, place) + len(root), F.length(place))


def _pattern(glob: str) -> str:
    """A shell pattern as a regular expression that both Python and Java read."""
    parts = re.split(r"(\*|\?|\[[^\]]+\])", glob)
    forms = {"*": ".*", "?": "."}
    return "(?s)^" + "".join(forms.get(p) or (p.replace("[!", "[^") if p.startswith("[") and len(p) > 2 else re.escape(p)) for p in parts) + "$"


def read_inventory(spark: SparkSession, uri: str, prefix: str | None = None, glob: str | None = None) -> DataFrame:
    """``rel_path, size, mtime`` of every file below ``uri``, empty and hidden ones too; contents are not read.

    ``glob`` is for the last component of the path, as in a shell: ``*``, ``?`` and ``[..]``.
    """
    found = scan_tree(spark, uri, prefix).where("kind = 'file'").select("rel_path", "size", "mtime")
    return found.where(F.substring_index("rel_path", "/", -1).rlike(_pattern(glob))) if glob else found


def read_payloads(spark: SparkSession, uri: str, chunk_bytes: int = CHUNK_BYTES, glob: str | None = None) -> DataFrame:
    """The inventory with ``content``, its digest and its number of chunks.

    Tasks read the files of the complete inventory one by one, dealt out anew so that a large folder is spread. A file has to
    have room in a row: larger ones are split where they lie. ``read_inventory`` is for those who do not need the contents.
    """
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    files = read_inventory(spark, uri, glob=glob).repartition(parts)
    found = files.mapInArrow(file_contents(uri), "rel_path string, size bigint, mtime timestamp, content binary")
    return found.select("*", F.sha2("content", 256).alias("full_hash"), F.ceil(F.col("size") / chunk_bytes).cast("bigint").alias("chunk_count"))


def read_table(spark: SparkSession, url: str, table: str, key: str, partitions: int, driver: str | None = None) -> DataFrame:
    """A relational table, read in ``partitions`` ranges of an integer key whose bounds are asked for first."""
    options = {"url": url} | ({"driver": driver} if driver else {})
    low, high = spark.read.format("jdbc").options(**options, query=f'SELECT MIN("{key}") AS lo, MAX("{key}") AS hi FROM {table}').load().first()
    if low is None:
        return spark.read.format("jdbc").options(**options, dbtable=table).load()
    return (
        spark.read.format("jdbc")
        .options(**options, dbtable=table, partitionColumn=f'"{key}"', lowerBound=low, upperBound=high + 1, numPartitions=partitions)
        .load()
    )


def read_collection(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A collection of JSON documents, one on a line, under a schema that is not inferred."""
    return spark.read.schema(schema).json(path)


def select_kinds(inventory: DataFrame, symlinks: str = "exclude", devices: str = "exclude") -> DataFrame:
    """Drop symbolic links and devices where they are to be excluded; excluding the root is an error. A NULL kind stays."""
    excluded = (["symlink"] if symlinks == "exclude" else []) + (["char_device", "block_device"] if devices == "exclude" else [])
    if excluded and inventory.where((F.col("rel_path") == "") & F.col("kind").isin(excluded)).limit(1).count():
        raise ValueError("the root itself is of an excluded kind")
    return inventory.where(~F.coalesce(F.col("kind").isin(excluded), F.lit(False))) if excluded else inventory


def merge_sources(inventories: list[DataFrame], names: list[str]) -> DataFrame:
    """Inventories side by side, each below a directory of its name, under one root; ids dense in path order.

    Rows are ``(id, source, rel_path, kind, size)``; the root has id 0 and the empty path.
    """
    out = None
    for inventory, name in zip(inventories, names, strict=True):
        path = F.when(F.col("rel_path") == "", F.lit(name)).otherwise(F.concat(F.lit(f"{name}/"), F.col("rel_path")))
        part = inventory.select(F.lit(name).alias("source"), path.alias("rel_path"), "kind", F.col("size").cast("bigint").alias("size"))
        out = part if out is None else out.unionByName(part)
    root = out.sparkSession.range(1).select(F.lit(0).cast("bigint").alias("id"), F.lit("").alias("source"), F.lit("").alias("rel_path"), F.lit("directory").alias("kind"), F.lit(None).cast("bigint").alias("size"))
    return root.unionByName(dense_ids(out, ["source", "rel_path"], "id", start=1))
