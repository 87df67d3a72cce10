"""Complete listings of folders: every kind of entry, empty files and hidden names too.

Spark's own file sources leave out empty files and names that begin with ``_`` or ``.``. Here the folders
of one level are listed by tasks, and the folders found are the next level; a job for each level, however
many folders it has.
"""

from __future__ import annotations

import os
import stat
from collections.abc import Iterator
from datetime import UTC, datetime
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from carbonproof.functions.scratch import materialise

ENTRIES = "rel_path string, kind string, size bigint, mtime timestamp, mode int, target string"
#: Entries of a batch on the way from a listing task.
LISTED = 4096
_KINDS = ((stat.S_ISLNK, "symlink"), (stat.S_ISDIR, "directory"), (stat.S_ISREG, "file"), (stat.S_ISCHR, "char_device"), (stat.S_ISBLK, "block_device"))

Entry = tuple[str, str, int | None, datetime | None, int | None, str | None]


def _local(folder: str, below: str) -> Iterator[Entry]:
    """Entries of a folder of this machine or a mount; links are not followed."""
    with os.scandir(folder) as found:
        for entry in found:
            try:
                s = entry.stat(follow_symlinks=False)
                kind = next((name for test, name in _KINDS if test(s.st_mode)), "other")
                target = os.readlink(entry.path) if kind == "symlink" else None
            except FileNotFoundError:  # it went while the folder was read
                continue
            size = s.st_size if kind == "file" else None
            yield below + entry.name, kind, size, datetime.fromtimestamp(s.st_mtime, UTC), stat.S_IMODE(s.st_mode), target


def _remote(uri: str, below: str) -> Iterator[Entry]:
    """Entries of a folder of a store that Arrow knows."""
    from pyarrow import fs

    store, folder = fs.FileSystem.from_uri(uri)
    for info in store.get_file_info(fs.FileSelector(folder)):
        kind = "directory" if info.type == fs.FileType.Directory else "file"
        yield below + info.base_name, kind, info.size if kind == "file" else None, info.mtime, None, None


def _root(uri: str) -> tuple[bool, str]:
    """Whether a folder is a local one, and its path or address."""
    scheme, _, rest = uri.rpartition(":")
    local = scheme in ("", "file")
    return local, f"/{rest.strip('/')}" if local else uri.rstrip("/")


def file_contents(uri: str):
    """Adds the bytes of each listed file, one row a batch, to rows ``(rel_path, size, mtime)``."""
    local, root = _root(uri)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, below in enumerate(batch.column(0).to_pylist()):
                if local:
                    content = Path(f"{root}/{below}").read_bytes()
                else:
                    from pyarrow import fs

                    store, place = fs.FileSystem.from_uri(f"{root}/{below}")
                    with store.open_input_stream(place) as stream:
                        content = stream.read()
                yield pa.RecordBatch.from_arrays([*[c.slice(at, 1) for c in batch.columns], pa.array([content], pa.binary())], ["rel_path", "size", "mtime", "content"])

    return run


def _listing(uri: str):
    local, root = _root(uri)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, rows = [x.split()[0] for x in ENTRIES.split(", ")], []

        def batch() -> pa.RecordBatch:
            kinds = (pa.string(), pa.string(), pa.int64(), pa.timestamp("us", "UTC"), pa.int32(), pa.string())
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

        for folders in batches:
            for below in folders.column(0).to_pylist():
                place, prefix = f"{root}/{below}".rstrip("/"), f"{below}/" if below else ""
                for entry in (_local if local else _remote)(place or "/", prefix):
                    rows.append(entry)
                    if len(rows) == LISTED:
                        yield batch()
                        rows.clear()
        if rows:
            yield batch()

    return run


def scan_tree(spark: SparkSession, uri: str, prefix: str | None = None) -> DataFrame:
    """``rel_path, kind, size, mtime, mode, target`` of everything below a folder; the folder itself is not listed.

    Kinds are file, directory, symlink (not followed), char_device, block_device and other; ``size`` is of
    files, ``mode`` and ``target`` are null on stores without them. With ``prefix``, only paths that begin with
    it, and only folders that can hold such are listed. An empty folder gives no row.
    """
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    level, out = spark.range(1).select(F.lit("").alias("rel_path")), None
    while True:
        found = materialise(level.repartition(parts).mapInArrow(_listing(uri), ENTRIES), "listing")
        out = found if out is None else out.unionByName(found)
        level = found.where("kind = 'directory'").select("rel_path")
        if prefix:
            level = level.where(F.lit(prefix).startswith(F.concat("rel_path", F.lit("/"))) | F.col("rel_path").startswith(prefix))
        if level.isEmpty():
            break
    return out.where(F.col("rel_path").startswith(prefix)) if prefix else out
