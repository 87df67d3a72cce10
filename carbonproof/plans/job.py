"""Whole copies: one dataset from fingerprint to audit, and lists of datasets."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from decimal import Decimal
from threading import Event

from pyspark import inheritable_thread_target
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from carbonproof.functions.canon import canonical_row, checksum, hash60
from carbonproof.functions.scratch import materialise
from carbonproof.operators.audit import SourceChanged, audit_immutability, fresh_name, partition_fingerprints, require_unchanged
from carbonproof.plans.plan import build_plan_items
from carbonproof.plans.preflight import FORMAT_VERSION, preflight_checks, preflight_decision
from carbonproof.sources.sinks import HadoopPaths, staged_commit


class CopyRefused(RuntimeError):
    """The preflight failed, or the plan was rejected."""


@dataclass(frozen=True)
class CopyOptions:
    """``group`` is the column whose groups are planned and audited one by one.

    ``expects`` has the columns and types that the destination takes; without it they are those of the
    rows that the target holds, if it is there and not to be replaced.
    """

    group: str
    accept: bool = True
    overwrite: bool = True
    available_bytes: int = 1 << 62
    src_version: int = 1
    dst_version: int = 1
    expects: Mapping[str, str] | None = None
    recheck: bool = False


def _types(df: DataFrame) -> dict[str, str]:
    return {f.name: f.dataType.simpleString() for f in df.schema}


def _held(spark: SparkSession, path: str) -> DataFrame | None:
    """What a target holds; None if it is not there, or a folder without rows to read."""
    if not HadoopPaths(spark).exists(path):
        return None
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() == "UNABLE_TO_INFER_SCHEMA":
            return None
        raise


def planned(source: DataFrame, by: str) -> DataFrame:
    """The fingerprint of each group and its bytes, for audit and plan at once."""
    texts = source.select(F.col(f"`{by}`").alias("_by"), canonical_row(source).alias("_text"))
    rows = texts.select("_by", hash60(F.col("_text")).alias("_hash"), F.octet_length("_text").alias("_bytes"))
    groups = rows.groupBy("_by").agg(F.count("*").alias("n_rows"), checksum("_hash").alias("checksum"), F.sum("_bytes").cast("bigint").alias("estimated_bytes"))
    return groups.withColumnRenamed("_by", by)


def _totals(groups: DataFrame) -> tuple[int, Decimal]:
    row = groups.agg(F.coalesce(F.sum("n_rows"), F.lit(0)).alias("n"), F.coalesce(F.sum("checksum"), F.lit(0)).cast("decimal(38,0)").alias("c")).first()
    return row["n"], row["c"]


def copy_dataset(read: Callable[[], DataFrame], path: str, options: CopyOptions, name: str = "data") -> DataFrame:
    """Copy what ``read`` returns to Parquet at ``path``; one row per table with the reconciliation.

    The source is read twice, with a fresh reader each: for the plan and the fingerprints before, and to
    write the copy, where rows and checksum are observed on the way. The copy is read once, before it is
    promoted. A source that was another when it was copied than when it was planned is an error of its own, as is a
    refusal; nothing is written if the preflight, which looks at what the target holds, fails. With
    ``options.recheck`` the source is read again at the end, to find changes made after the copy.
    """
    source = read()
    spark, by = source.sparkSession, options.group
    before = materialise(planned(source, by), "before")
    items = build_plan_items(before, "data", by)
    held = _held(spark, path)
    there = _types(source) if held is None or options.overwrite else _types(held)
    checks = preflight_checks(
        items, _types(source), options.expects or there, source.limit(0) if held is None else held,
        {"available_bytes": options.available_bytes, "overwrite": options.overwrite, "src_version": options.src_version,
         "dst_version": options.dst_version, "format_version": FORMAT_VERSION},
    )
    decision = preflight_decision(checks, options.accept).first()
    if not decision["accepted"]:
        raise CopyRefused(decision["reason"])
    seen, observed = Observation(), read()
    mark = fresh_name(observed.columns, "hash_")
    observed = observed.withColumn(mark, hash60(canonical_row(observed))).observe(seen, F.count("*").alias("n_rows"), checksum(mark).alias("checksum")).drop(mark)
    groups: list[DataFrame] = []

    def verify(copy: DataFrame) -> bool:
        groups.append(materialise(partition_fingerprints(copy, [by]), "copied"))
        return _totals(groups[0]) == (seen.get["n_rows"], seen.get["checksum"])

    def unchanged() -> None:
        if _totals(before) != (seen.get["n_rows"], seen.get["checksum"]):
            require_unchanged(audit_immutability(before, groups[0], [by]))
            raise SourceChanged("the source changed during the run")

    staged_commit(observed, path, verify, options.overwrite, allowed=unchanged, held=held is not None)
    if options.recheck:
        require_unchanged(audit_immutability(before, partition_fingerprints(read(), [by]), [by]))
    (src_rows, src_sum), (dst_rows, dst_sum) = _totals(before), _totals(groups[0])
    row = (name, src_rows, src_sum, dst_rows, dst_sum, (src_rows, src_sum) == (dst_rows, dst_sum))
    return spark.createDataFrame([row], '`table` string, src_rows bigint, src_checksum decimal(38,0), dst_rows bigint, dst_checksum decimal(38,0), `match` boolean')


OUTCOME = "target string, outcome string, detail string, n_rows bigint"


def copy_many(spark: SparkSession, targets: Sequence[Mapping[str, object]], fail_fast: bool = False, lanes: int = 1) -> DataFrame:
    """One outcome row per target, in their order: copied, refused, source changed, failed, cancelled or skipped.

    A target has ``name``, ``read``, ``path`` and ``options``. ``lanes`` targets are copied at a time, each as jobs
    of its own tag and, where the fair scheduler is on, of its own pool. A failure does not stop the others unless
    ``fail_fast``: then jobs that run are cancelled and targets that have not begun are skipped.
    """
    run, stop = uuid.uuid4().hex, Event()
    context = spark.sparkContext

    def copy(at: int) -> tuple:
        target = targets[at]
        if stop.is_set():
            return target["name"], "skipped", "", None
        context.addJobTag(f"copy-{run}-{at}")
        context.setLocalProperty("spark.scheduler.pool", f"copy-{at}")
        try:
            done = copy_dataset(target["read"], target["path"], target["options"], target["name"]).first()
            return target["name"], "copied", "", done["dst_rows"]
        except CopyRefused as e:
            row = (target["name"], "refused", str(e), None)
        except SourceChanged as e:
            row = (target["name"], "source changed", str(e), None)
        except Exception as e:
            row = (target["name"], "cancelled" if stop.is_set() else "failed", type(e).__name__, None)
        finally:
            context.removeJobTag(f"copy-{run}-{at}")
            context.setLocalProperty("spark.scheduler.pool", None)
        if fail_fast and not stop.is_set():
            stop.set()
            for other in range(len(targets)):
                if other != at:
                    context.cancelJobsWithTag(f"copy-{run}-{other}")
        return row

    with ThreadPoolExecutor(lanes) as pool:
        rows = [x.result() for x in [pool.submit(inheritable_thread_target(spark)(copy), at) for at in range(len(targets))]]
    return spark.createDataFrame(rows, OUTCOME)
