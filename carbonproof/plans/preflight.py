"""Preflight checks on a plan, and the decision that follows from them."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FORMAT_VERSION = 1


def _row(df: DataFrame, name: str, passed: Column, detail: Column) -> DataFrame:
    return df.select(F.lit(name).alias("name"), passed.alias("passed"), detail.alias("detail"))


def preflight_checks(items: DataFrame, src: Mapping[str, str], dst: Mapping[str, str], target: DataFrame, options: Mapping[str, object]) -> DataFrame:
    """``name, passed, detail``: space, emptiness, versions, plan format, columns and their types.

    ``src`` and ``dst`` map columns to types; ``options`` has available_bytes, overwrite, src_version,
    dst_version and format_version.
    """
    need = items.agg(F.coalesce(F.sum("estimated_bytes"), F.lit(0)).cast("bigint").alias("need"))
    held = target.agg(F.count("*").alias("held"))
    one = items.sparkSession.range(1)
    available, overwrite = int(options["available_bytes"]), bool(options["overwrite"])
    missing = sorted(set(src) - set(dst))
    differing = sorted(c for c in src if c in dst and src[c] != dst[c])
    rows = [
        _row(need, "space", F.col("need") <= available, F.concat(F.lit("needs "), F.col("need").cast("string"), F.lit(f" of {available}"))),
        _row(held, "target empty", (F.col("held") == 0) | F.lit(overwrite), F.concat(F.col("held").cast("string"), F.lit(" rows present"))),
        _row(one, "version", F.lit(int(options["dst_version"]) >= int(options["src_version"])), F.lit(f"{options['src_version']} to {options['dst_version']}")),
        _row(one, "plan format", F.lit(options["format_version"] == FORMAT_VERSION), F.lit(f"format {options['format_version']}")),
        _row(one, "columns", F.lit(not missing), F.lit("missing: " + ",".join(missing))),
        _row(one, "types", F.lit(not differing), F.lit("differing: " + ",".join(differing))),
    ]
    return reduce(DataFrame.unionByName, rows)


def preflight_decision(checks: DataFrame, accept: bool) -> DataFrame:
    """One row ``ok, accepted, reason``; the operator's answer counts only if all checks passed, and no checks pass."""
    ok = F.coalesce(F.bool_and("passed"), F.lit(True))
    decided = checks.agg(ok.alias("ok")).withColumn("accepted", F.col("ok") & F.lit(accept))
    reason = F.when(~F.col("ok"), "preflight failed").when(~F.col("accepted"), "rejected by operator").otherwise("accepted")
    return decided.withColumn("reason", reason)
