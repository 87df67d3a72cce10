"""Tables whose versions appear by a pointer, for stores on which renaming a folder copies it.

``<table>/data/<name>`` holds rows; ``<table>/versions/<number>.json`` names the data of a version. A
version exists once its pointer file does, and creating that file without overwriting decides between
writers. Readers look up the newest pointer and never see data that no pointer names.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from carbonproof.sources.sinks import HadoopPaths


class CommitConflict(RuntimeError):
    """Another writer has committed the version that this one was to be."""


def _pointer(path: str, version: int) -> str:
    return f"{path}/versions/{version:012d}.json"


def versions(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the committed versions, rising."""
    found = HadoopPaths(spark).names(f"{path.rstrip('/')}/versions")
    return sorted(int(x.removesuffix(".json")) for x in found if x.endswith(".json"))


def read_version(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """The rows of a version, the newest unless given; FileNotFoundError if there is none."""
    path, paths = path.rstrip("/"), HadoopPaths(spark)
    for number in reversed(versions(spark, path)):
        if version in (None, number) and (pointer := paths.text(_pointer(path, number))):  # an empty one is still being written
            return spark.read.parquet(f"{path}/data/{json.loads(pointer)['data']}")
    raise FileNotFoundError(f"{path} has no version {'' if version is None else version}")


def commit_version(df: DataFrame, path: str, verify: Callable[[DataFrame], bool], after: int | None = None) -> int:
    """Write, verify, and commit as the version that follows ``after``; returns its number.

    ``after`` is the version that the writer has seen, the newest unless given, 0 for an empty table. If another writer
    has gone on from there meanwhile, CommitConflict; a failed verification is a ValueError. In either
    case the data written are removed and the table is as it was.
    """
    spark, path = df.sparkSession, path.rstrip("/")
    paths, seen = HadoopPaths(spark), after if after is not None else max(versions(spark, path), default=0)
    data = uuid.uuid4().hex
    df.write.parquet(f"{path}/data/{data}")
    if not verify(spark.read.parquet(f"{path}/data/{data}")):
        paths.delete(f"{path}/data/{data}")
        raise ValueError(f"the new version of {path} failed verification")
    if max(versions(spark, path), default=0) != seen or not paths.create(_pointer(path, seen + 1), json.dumps({"data": data})):
        paths.delete(f"{path}/data/{data}")
        raise CommitConflict(f"{path} has a version {seen + 1} already")
    return seen + 1


def remove_unnamed(spark: SparkSession, path: str, keep: int = 1) -> list[str]:
    """Delete the data of all but the newest ``keep`` versions, and what crashed writers left; returns the names deleted.

    Pointers stay, so version numbers go on. No writer may be at work meanwhile.
    """
    path, paths = path.rstrip("/"), HadoopPaths(spark)
    kept = {json.loads(paths.text(_pointer(path, v)))["data"] for v in versions(spark, path)[-keep:]}
    gone = [x for x in paths.names(f"{path}/data") if x not in kept]
    for name in gone:
        paths.delete(f"{path}/data/{name}")
    return gone
