"""Reassembly of items of any size into files.

Chunks are range-partitioned by item and offset, and each task writes the chunks it has to their places
in the items' files; an item that spans several partitions is written by several tasks at once, each at its own offsets. A
chunk is the most that a row or a worker holds. A repeated task writes the same bytes to the same places.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from carbonproof.functions.scratch import small_batches
from carbonproof.sources.sinks import HadoopPaths

#: Chunks in an Arrow batch; of a mebibyte each, unless they are cut otherwise.
BATCH = 16


@dataclass
class Written(WriterCommitMessage):
    chunks: int
    bytes: int


class ItemFilesWriter(DataSourceArrowWriter):
    def __init__(self, folder: str) -> None:
        self.folder = folder

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        """Rows come by name and offset, so one file is open at a time."""
        name, file, done = None, -1, Written(0, 0)
        try:
            for batch in iterator:
                for at in range(len(batch)):
                    if (own := batch.column(0)[at].as_py()) != name:
                        if file >= 0:
                            os.close(file)
                        name, path = own, os.path.join(self.folder, own)
                        os.makedirs(os.path.dirname(path), exist_ok=True)
                        file = os.open(path, os.O_WRONLY | os.O_CREAT, 0o644)
                    rest, offset = memoryview(batch.column(2)[at].as_buffer() or b""), batch.column(1)[at].as_py()
                    done.chunks, done.bytes = done.chunks + 1, done.bytes + len(rest)
                    while rest:
                        n = os.pwrite(file, rest, offset)
                        rest, offset = rest[n:], offset + n
        finally:
            if file >= 0:
                os.close(file)
        return done


class ItemFiles(DataSource):
    """Sink of rows ``(name, offset, data)``; option ``folder``."""

    @classmethod
    def name(cls) -> str:
        return "item_files"

    def schema(self) -> str:
        return "name string, offset bigint, data binary"

    def writer(self, schema, overwrite: bool) -> ItemFilesWriter:
        return ItemFilesWriter(self.options["folder"])


def write_items(chunks: DataFrame, path: str, name: Column | None = None, partitions: int | None = None) -> str:
    """Write every item's chunks ``(item_id, offset, data)`` into one file; returns the folder.

    ``name`` is the file's path below the folder, the item's id unless given; one with a ``..`` or an empty
    component, or null, is an error. Each chunk is written once, at its offset, and the
    folder appears under its name only when all are. What is missing between chunks reads as zeros: ask ``chunk_gaps`` first.
    The folder must be one that executors can write at any offset (``file:``, a shared mount).
    """
    spark = chunks.sparkSession
    scheme, _, rest = path.rpartition(":")
    if scheme not in ("", "file"):
        raise ValueError(f"{scheme} files cannot be written at an offset")
    paths, staging = HadoopPaths(spark), f"/{rest.strip('/')}._staging-{uuid.uuid4().hex}"
    if paths.exists(path):
        raise FileExistsError(path)
    label = name if name is not None else F.col("item_id").cast("string")
    bad = label.isNull() | F.exists(F.split(label, "/"), lambda p: p.isin("", ".", ".."))
    safe = F.when(bad, F.raise_error(F.concat(F.lit("no file name: "), F.coalesce(label, F.lit("null"))))).otherwise(label)
    rows = chunks.select(safe.alias("name"), F.col("offset").cast("bigint").alias("offset"), F.col("data").cast("binary").alias("data"))
    parts = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    spark.dataSource.register(ItemFiles)
    with small_batches(spark, BATCH):
        rows.repartitionByRange(parts, "name", "offset").sortWithinPartitions("name", "offset").write.format("item_files").option("folder", staging).mode("append").save()
    if paths.exists(f"file://{staging}"):
        paths.rename(f"file://{staging}", path)
    else:
        paths.make(path)  # there were no chunks
    return path
