"""Queries on fingerprints, audits, diffs and constraints."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from carbonproof.operators import audit as au
from carbonproof.queries import fixtures as fx

R = fx.Registry()
T = fx.table
_ORDERS, _COPY = fx.canonical_sql("orders"), f"WITH {fx.ORDERS_COPY}"
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem")
_TYPES = {"i": "bigint", "s": "string", "d": "double", "t": "timestamp_ntz"}
_INTS = ("r_regionkey", "n_nationkey", "n_regionkey", "c_nationkey", "s_nationkey", "p_size", "l_linenumber")


def _schema_sql(name: str) -> str:
    parts = [x.split(":") for x in fx._KINDS[name].split()]
    return ",".join(f"{c}:{'int' if c in _INTS else _TYPES[k]}" for k, c in parts)


def _fingerprint_sql(name: str) -> str:
    return f"SELECT '{name}' AS \"table\", count(*) AS n_rows, {fx.checksum_sql(fx.canonical_sql(name))} AS checksum, sha256('{_schema_sql(name)}') AS schema_digest FROM {name}"


@R.add(f"SELECT o_orderkey, sha256({_ORDERS}) AS row_digest FROM orders")
def row_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return au.row_digests(T(spark, sf_dir, "orders")).select("o_orderkey", "row_digest")


@R.add(f"SELECT count(*) AS n_rows, {fx.checksum_sql(fx.canonical_sql('lineitem'))} AS checksum FROM lineitem")
def table_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return au.table_fingerprint(T(spark, sf_dir, "lineitem"))


_DATABASE = (
    "WITH t AS (" + " UNION ALL ".join(map(_fingerprint_sql, TABLES)) + "), e AS (SELECT row_number() OVER (ORDER BY \"table\") - 1 AS id, "
    "sha256(\"table\" || '|' || n_rows || '|' || checksum || '|' || schema_digest) AS d FROM t) SELECT t.*, (SELECT sha256(string_agg(d, '' ORDER BY id)) FROM e) AS database_digest FROM t"
)


@R.add(_DATABASE)
def database_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return au.database_fingerprint({n: T(spark, sf_dir, n) for n in TABLES})


@R.add(
    "WITH x AS (SELECT *, CAST(concat('0x', substr(md5(CAST(o_orderkey AS VARCHAR)), 1, 15)) AS BIGINT) % 16 = 0 AS chosen FROM orders) "
    f"SELECT count(*) AS n_rows, count(*) FILTER (chosen) AS n_sampled, (SELECT {fx.checksum_sql(_ORDERS)} FROM x WHERE chosen) AS checksum FROM x"
)
def sampled_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return au.sampled_fingerprint(T(spark, sf_dir, "orders"), "o_orderkey", 16)


@R.add(f"SELECT l_returnflag, l_linestatus, count(*) AS n_rows, {fx.checksum_sql(fx.canonical_sql('lineitem'))} AS checksum FROM lineitem GROUP BY 1, 2")
def partition_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return au.partition_fingerprints(T(spark, sf_dir, "lineitem"), ["l_returnflag", "l_linestatus"])


_LISTING = " || ".join(fx.framed_sql(f"CAST({c} AS VARCHAR)") for c in ("rel_path", "kind", "size", "full_hash"))


@R.add(f"WITH {fx.MANIFEST} SELECT count(*) AS n_rows, {fx.checksum_sql(_LISTING)} AS checksum FROM manifest")
def listing_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return au.listing_fingerprint(fx.manifest(spark, sf_dir))


def _groups_sql(name: str) -> str:
    return f"(SELECT o_custkey, count(*) AS n, {fx.checksum_sql(_ORDERS)} AS c FROM {name} GROUP BY 1)"


@R.add(
    f"{_COPY} SELECT coalesce(a.o_custkey, b.o_custkey) AS o_custkey, CASE WHEN a.n IS NULL THEN 'added' WHEN b.n IS NULL THEN 'removed' ELSE 'changed' END AS change "
    f"FROM {_groups_sql('orders')} a FULL JOIN {_groups_sql('orders_copy')} b ON a.o_custkey = b.o_custkey WHERE a.n IS DISTINCT FROM b.n OR a.c IS DISTINCT FROM b.c"
)
def audit_immutability(spark: SparkSession, sf_dir: str) -> DataFrame:
    sides = (T(spark, sf_dir, "orders"), fx.orders_copy(spark, sf_dir))
    return au.audit_immutability(*[au.partition_fingerprints(x, ["o_custkey"]) for x in sides], ["o_custkey"])


def _counted(name: str, source: str, side: str) -> str:
    return f"SELECT '{name}' AS \"table\", count(*) AS {side}_rows, {fx.checksum_sql(fx.canonical_sql(name))} AS {side}_checksum FROM {source}"


@R.add(
    f"{_COPY}, a AS ({_counted('orders', 'orders', 'src')} UNION ALL {_counted('nation', 'nation', 'src')} UNION ALL {_counted('region', 'region', 'src')}), "
    f"b AS ({_counted('orders', 'orders_copy', 'dst')} UNION ALL {_counted('nation', 'nation', 'dst')}) "
    'SELECT "table", src_rows, src_checksum, dst_rows, dst_checksum, src_rows IS NOT DISTINCT FROM dst_rows AND src_checksum IS NOT DISTINCT FROM dst_checksum AS "match" FROM a FULL JOIN b USING ("table")'
)
def reconcile(spark: SparkSession, sf_dir: str) -> DataFrame:
    src = {n: T(spark, sf_dir, n) for n in ("orders", "nation", "region")}
    return au.reconcile(src, {"orders": fx.orders_copy(spark, sf_dir), "nation": src["nation"]})


@R.add(
    f"{_COPY} SELECT coalesce(a.o_orderkey, b.o_orderkey) AS o_orderkey, CASE WHEN a.r IS NULL THEN 'added' WHEN b.r IS NULL THEN 'removed' WHEN a.r <> b.r THEN 'changed' ELSE 'same' END AS status "
    f"FROM (SELECT o_orderkey, md5({_ORDERS}) AS r FROM orders) a FULL JOIN (SELECT o_orderkey, md5({_ORDERS}) AS r FROM orders_copy) b ON a.o_orderkey = b.o_orderkey"
)
def row_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return au.row_diff(T(spark, sf_dir, "orders"), fx.orders_copy(spark, sf_dir), ["o_orderkey"])


@R.add(
    f"{_COPY}, j AS (SELECT a.*, b.o_custkey AS b1, b.o_orderstatus AS b2, b.o_totalprice AS b3, b.o_orderdate AS b4, b.o_orderpriority AS b5 FROM orders a JOIN orders_copy b ON a.o_orderkey = b.o_orderkey) "
    + " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, count(*) FILTER ({c} IS DISTINCT FROM b{k}) AS mismatches FROM j"
        for k, c in enumerate(("o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"), 1)
    )
)
def column_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return au.column_diff(T(spark, sf_dir, "orders"), fx.orders_copy(spark, sf_dir), ["o_orderkey"])


@R.add(
    "WITH s AS (SELECT l_orderkey, l_linenumber, l_returnflag FROM lineitem), d AS (SELECT * FROM s WHERE l_orderkey % 97 <> 0 UNION ALL SELECT * FROM s WHERE l_orderkey % 101 = 0), "
    "a AS (SELECT *, count(*) AS n FROM s GROUP BY ALL), b AS (SELECT *, count(*) AS n FROM d GROUP BY ALL), "
    "j AS (SELECT l_orderkey, l_linenumber, l_returnflag, coalesce(a.n, 0) - coalesce(b.n, 0) AS k FROM a FULL JOIN b USING (l_orderkey, l_linenumber, l_returnflag)) "
    "SELECT CASE WHEN k > 0 THEN 'src' ELSE 'dst' END AS only_in, l_orderkey, l_linenumber, l_returnflag, abs(k) AS surplus FROM j WHERE k <> 0"
)
def bag_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = T(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag")
    return au.bag_diff(s, s.where("l_orderkey % 97 <> 0").unionByName(s.where("l_orderkey % 101 = 0")))


@R.add(
    f"WITH {fx.MANIFEST}, m AS (SELECT * REPLACE (CASE WHEN id % 17 = 0 AND kind = 'file' THEN 'symlink' ELSE kind END AS kind) FROM manifest), "
    "i AS (SELECT rel_path, kind, CASE WHEN id % 13 = 0 THEN size + 1 ELSE size END AS size, CASE WHEN id % 11 = 0 THEN 'x' ELSE full_hash END AS full_hash FROM m WHERE id % 7 <> 0), "
    "r AS (SELECT id, rel_path, CASE WHEN i.kind IS NULL THEN 'missing' WHEN i.kind <> m.kind THEN 'wrong kind' WHEN m.kind NOT IN ('file', 'directory') THEN 'unproven' "
    "WHEN m.kind = 'file' AND m.size IS DISTINCT FROM i.size THEN 'wrong size' WHEN m.kind = 'file' AND m.full_hash IS DISTINCT FROM i.full_hash THEN 'wrong digest' END AS reason "
    "FROM m LEFT JOIN i USING (rel_path)) SELECT id, rel_path, reason FROM r WHERE reason IS NOT NULL"
)
def destination_satisfies(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("id")
    m = fx.manifest(spark, sf_dir)
    m = m.withColumn("kind", F.when((n % 17 == 0) & (F.col("kind") == "file"), "symlink").otherwise(F.col("kind")))
    held = m.where(n % 7 != 0).withColumn("size", F.when(n % 13 == 0, F.col("size") + 1).otherwise(F.col("size")))
    return au.destination_satisfies(m, held.withColumn("full_hash", F.when(n % 11 == 0, "x").otherwise(F.col("full_hash"))))


@R.add("SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def check_unique(spark: SparkSession, sf_dir: str) -> DataFrame:
    return au.check_unique(T(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"])


@R.add(f"WITH {fx.ORDERS_NULLS} SELECT o_custkey, count(*) AS n FROM orders_nulls GROUP BY 1 HAVING count(*) > 1 OR o_custkey IS NULL")
def check_primary_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return au.check_unique(fx.orders_nulls(spark, sf_dir), ["o_custkey"], primary=True)


@R.add("SELECT doc_id, count(*) AS n FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) GROUP BY 1")
def check_foreign_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return au.check_foreign_key(T(spark, sf_dir, "documents"), "doc_id", T(spark, sf_dir, "labels"), "doc_id")


@R.add(f"WITH {fx.ORDERS_NULLS} SELECT 'o_custkey' AS column_name, count(*) - count(o_custkey) AS nulls FROM orders_nulls UNION ALL SELECT 'o_orderdate', count(*) - count(o_orderdate) FROM orders_nulls")
def check_not_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    return au.check_not_null(fx.orders_nulls(spark, sf_dir), ["o_custkey", "o_orderdate"])


@R.add(
    "SELECT 'discount' AS rule, count(*) FILTER (NOT coalesce(l_discount <= 0.05, true)) AS failing FROM lineitem "
    "UNION ALL SELECT 'quantity', count(*) FILTER (NOT coalesce(CASE WHEN l_linenumber = 1 THEN NULL ELSE l_quantity > 10 END, true)) FROM lineitem"
)
def check_predicate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return au.check_predicate(T(spark, sf_dir, "lineitem"), {"discount": "l_discount <= 0.05", "quantity": "CASE WHEN l_linenumber = 1 THEN NULL ELSE l_quantity > 10 END"})


@R.add(
    'SELECT \'customer\' AS "table", max(c_custkey) + 1 AS next_value, CAST(5 AS BIGINT) AS recorded, 5 < max(c_custkey) + 1 AS behind FROM customer '
    "UNION ALL SELECT 'orders', max(o_orderkey) + 1, CAST(NULL AS BIGINT), false FROM orders"
)
def sequence_restart(spark: SparkSession, sf_dir: str) -> DataFrame:
    return au.sequence_restart({"orders": (T(spark, sf_dir, "orders"), "o_orderkey"), "customer": (T(spark, sf_dir, "customer"), "c_custkey")}, {"customer": 5})
