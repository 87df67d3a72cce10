"""Inputs that the registered queries derive from the given tables, each as a DataFrame and as SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from carbonproof.functions.canon import dense_ids
from carbonproof.operators.chunks import split_chunks

Query = Callable[[SparkSession, str], DataFrame]

#: Bytes of a chunk in the queries; documents are short.
C = 512


class Registry:
    """Queries by name, with their SQL where there is one."""

    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.sql: dict[str, str] = {}

    def add(self, sql: str | None = None) -> Callable[[Query], Query]:
        def keep(f: Query) -> Query:
            self.queries[f.__name__] = f
            if sql:
                self.sql[f.__name__] = sql
            return f

        return keep


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as items: ``item_id, payload, size``."""
    payload = F.encode("text", "UTF-8")
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("item_id"), payload.alias("payload"), F.octet_length(payload).cast("bigint").alias("size"))


ITEMS = "items AS (SELECT doc_id AS item_id, encode(text) AS payload, CAST(strlen(text) AS BIGINT) AS size FROM documents)"
LAYOUT = (
    f"layout AS (SELECT item_id, payload, i AS chunk_index, i * {C} AS \"offset\", least({C}, size - i * {C}) AS len FROM "
    f"(SELECT *, unnest(range(0, CAST(ceil(size / {C}.0) AS BIGINT))) AS i FROM items))"
)
CHUNKS = (
    f"{ITEMS}, {LAYOUT}, raw AS (SELECT item_id, chunk_index, \"offset\", CAST(len AS BIGINT) AS len, payload[\"offset\" + 1 : \"offset\" + len] AS data, "
    "(item_id * 7919 + chunk_index) % 1000003 AS arrival FROM layout), "
    "chunks AS (SELECT *, sha256(data) AS digest FROM raw)"
)


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All chunks of all documents, with their order of arrival."""
    return split_chunks(items(spark, sf_dir), C).withColumn("arrival", F.pmod(F.col("item_id") * 7919 + F.col("chunk_index"), F.lit(1000003)))


def _every(n: int) -> Column:
    return (F.col("item_id") + F.col("chunk_index")) % n == 0


def bad_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks with faults: wrong digests, missing rows, repeats, shifted offsets."""
    whole = chunks(spark, sf_dir)
    spoiled = (
        whole.where(~_every(89))
        .withColumn("digest", F.when(_every(97), "deadbeef").otherwise(F.col("digest")))
        .withColumn("offset", F.when(_every(79), F.col("offset") + 1).otherwise(F.col("offset")))
    )
    return spoiled.unionByName(spoiled.where(_every(83)).withColumn("arrival", F.col("arrival") + 1))


_K = "(item_id + chunk_index)"
BAD_CHUNKS = (
    f"{CHUNKS}, spoiled AS (SELECT item_id, chunk_index, CASE WHEN {_K} % 79 = 0 THEN \"offset\" + 1 ELSE \"offset\" END AS \"offset\", len, data, arrival, "
    f"CASE WHEN {_K} % 97 = 0 THEN 'deadbeef' ELSE digest END AS digest FROM chunks WHERE {_K} % 89 <> 0), "
    f"bad_chunks AS (SELECT * FROM spoiled UNION ALL SELECT * REPLACE (arrival + 1 AS arrival) FROM spoiled WHERE {_K} % 83 = 0)"
)


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A manifest with the documents' own ids: ``id, kind, size``; some entries are directories, some unknown."""
    docs = items(spark, sf_dir).where("item_id % 61 <> 0")
    return docs.select(F.col("item_id").alias("id"), F.when(F.col("item_id") % 53 == 0, "directory").otherwise("file").alias("kind"), "size")


FILES = "files AS (SELECT item_id AS id, CASE WHEN item_id % 53 = 0 THEN 'directory' ELSE 'file' END AS kind, size FROM items WHERE item_id % 61 <> 0)"


def manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents as a tree source/lang/doc_id with its directories, ids dense in path order."""
    docs = table(spark, sf_dir, "documents")
    size = F.octet_length("text").cast("bigint")
    none, text = F.lit(None).cast("bigint"), F.lit(None).cast("string")

    def directories(path: Column) -> DataFrame:
        return docs.select(path.alias("rel_path")).distinct().select("rel_path", F.lit("directory").alias("kind"), none.alias("size"), text.alias("full_hash"), F.lit(0).cast("bigint").alias("chunk_count"))

    leaves = docs.select(
        F.concat_ws("/", "source", "lang", F.col("doc_id").cast("string")).alias("rel_path"), F.lit("file").alias("kind"), size.alias("size"),
        F.sha2("text", 256).alias("full_hash"), F.ceil(size / C).cast("bigint").alias("chunk_count"),
    )
    tree = leaves.unionByName(directories(F.concat_ws("/", "source", "lang"))).unionByName(directories(F.col("source")))
    root = spark.range(1).select(F.lit("").alias("rel_path"), F.lit("directory").alias("kind"), none.alias("size"), text.alias("full_hash"), F.lit(0).cast("bigint").alias("chunk_count"))
    return dense_ids(tree.unionByName(root), ["rel_path"], "id")


MANIFEST = (
    f"tree AS (SELECT source || '/' || lang || '/' || doc_id AS rel_path, 'file' AS kind, CAST(strlen(text) AS BIGINT) AS size, sha256(text) AS full_hash, "
    f"CAST(ceil(strlen(text) / {C}.0) AS BIGINT) AS chunk_count FROM documents "
    "UNION ALL SELECT DISTINCT source || '/' || lang, 'directory', NULL, NULL, 0 FROM documents "
    "UNION ALL SELECT DISTINCT source, 'directory', NULL, NULL, 0 FROM documents UNION ALL SELECT '', 'directory', NULL, NULL, 0), "
    "manifest AS (SELECT row_number() OVER (ORDER BY rel_path) - 1 AS id, * FROM tree)"
)


def bad_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The manifest with faults in every rule, spread over the documents."""
    m = manifest(spark, sf_dir)
    n, path = F.col("id"), F.col("rel_path")
    file = F.col("kind") == "file"
    return (
        m.withColumn("size", F.when(file & (n % 41 == 0), None).otherwise(F.col("size")))
        .withColumn("full_hash", F.when(file & (n % 43 == 0), None).otherwise(F.col("full_hash")))
        .withColumn("chunk_count", F.when(file & (n % 47 == 0), F.col("chunk_count") + 1).otherwise(F.col("chunk_count")))
        .withColumn(
            "rel_path",
            F.when(file & (n % 59 == 0), F.concat(path, F.lit("/../x"))).when(file & (n % 67 == 0), F.concat(path, F.lit("//x"))).when(file & (n % 71 == 0), "src1/en").otherwise(path),
        )
        .withColumn("kind", F.when(path == "src2", "file").when(file & (n % 73 == 0), "socket").otherwise(F.col("kind")))
        .withColumn("id", F.when(n % 79 == 0, F.lit(0)).otherwise(n).cast("bigint"))
    )


BAD_MANIFEST = (
    MANIFEST + ", bad_manifest AS (SELECT CAST(CASE WHEN id % 79 = 0 THEN 0 ELSE id END AS BIGINT) AS id, "
    "CASE WHEN kind = 'file' AND id % 59 = 0 THEN rel_path || '/../x' WHEN kind = 'file' AND id % 67 = 0 THEN rel_path || '//x' "
    "WHEN kind = 'file' AND id % 71 = 0 THEN 'src1/en' ELSE rel_path END AS rel_path, "
    "CASE WHEN NOT (kind = 'file' AND id % 59 = 0) AND NOT (kind = 'file' AND id % 67 = 0) AND NOT (kind = 'file' AND id % 71 = 0) AND rel_path = 'src2' THEN 'file' "
    "WHEN kind = 'file' AND id % 73 = 0 THEN 'socket' ELSE kind END AS kind, "
    "CASE WHEN kind = 'file' AND id % 41 = 0 THEN NULL ELSE size END AS size, CASE WHEN kind = 'file' AND id % 43 = 0 THEN NULL ELSE full_hash END AS full_hash, "
    "CASE WHEN kind = 'file' AND id % 47 = 0 THEN chunk_count + 1 ELSE chunk_count END AS chunk_count FROM manifest)"
)


def done_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks that an interrupted run had completed, some of them verified (``fresh``)."""
    whole = chunks(spark, sf_dir).drop("data")
    kept = (F.col("item_id") % 3 == 0) | ((F.col("item_id") + F.col("chunk_index")) % 3 != 0)
    return whole.where(kept).select("item_id", "chunk_index", (F.col("chunk_index") % 2 == 0).alias("fresh"))


DONE = f"{CHUNKS}, done AS (SELECT item_id, chunk_index, chunk_index % 2 = 0 AS fresh FROM chunks WHERE item_id % 3 = 0 OR (item_id + chunk_index) % 3 <> 0)"


def orders_copy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A copy of orders with missing, changed and re-keyed rows."""
    o = table(spark, sf_dir, "orders").where("o_orderkey % 97 <> 0")
    price = F.when(F.col("o_orderkey") % 101 == 0, F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice"))
    changed = o.withColumn("o_totalprice", price)
    return changed.unionByName(o.where("o_orderkey % 103 = 0").withColumn("o_orderkey", F.col("o_orderkey") + 10_000_000))


ORDERS_COPY = (
    "orders_copy AS (SELECT * REPLACE (CASE WHEN o_orderkey % 101 = 0 THEN o_totalprice + 1 ELSE o_totalprice END AS o_totalprice) FROM orders WHERE o_orderkey % 97 <> 0 "
    "UNION ALL SELECT * REPLACE (o_orderkey + 10000000 AS o_orderkey) FROM orders WHERE o_orderkey % 97 <> 0 AND o_orderkey % 103 = 0)"
)


def orders_nulls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with NULL customers."""
    return table(spark, sf_dir, "orders").withColumn("o_custkey", F.when(F.col("o_orderkey") % 50 != 0, F.col("o_custkey")))


ORDERS_NULLS = "orders_nulls AS (SELECT * REPLACE (CASE WHEN o_orderkey % 50 <> 0 THEN o_custkey END AS o_custkey) FROM orders)"


def transfer_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as transfer progress: ``transfer, id, ts, bytes, item_done``."""
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("transfer"), F.col("event_id").alias("id"), F.col("ts").cast("timestamp").alias("ts"),
        F.floor(F.col("value") * 100).cast("bigint").alias("bytes"), (F.col("event_type") == "purchase").alias("item_done"),
    )


TRANSFER_EVENTS = "t AS (SELECT user_id AS transfer, event_id AS id, ts, CAST(floor(value * 100) AS BIGINT) AS bytes, event_type = 'purchase' AS item_done FROM events)"


def framed_sql(expression: str) -> str:
    return f"CASE WHEN {expression} IS NULL THEN 'N;' ELSE strlen({expression}) || ':' || {expression} END"


# The canonical text of each column of the tables that the queries fingerprint.
_KINDS = {
    "region": "i:r_regionkey s:r_name",
    "nation": "i:n_nationkey s:n_name i:n_regionkey",
    "customer": "i:c_custkey s:c_name i:c_nationkey d:c_acctbal s:c_mktsegment",
    "supplier": "i:s_suppkey s:s_name i:s_nationkey d:s_acctbal",
    "part": "i:p_partkey s:p_name s:p_brand s:p_type i:p_size d:p_retailprice",
    "orders": "i:o_orderkey i:o_custkey s:o_orderstatus d:o_totalprice t:o_orderdate s:o_orderpriority",
    "lineitem": "i:l_orderkey i:l_partkey i:l_suppkey i:l_linenumber d:l_quantity d:l_extendedprice d:l_discount d:l_tax s:l_returnflag s:l_linestatus t:l_shipdate",
}


def canonical_sql(name: str) -> str:
    """The canonical row of a table as SQL."""

    def text(spec: str) -> str:
        kind, column = spec.split(":")
        forms = {
            "s": column, "i": f"CAST({column} AS VARCHAR)", "d": f"CAST(CAST({column} AS DECIMAL(18,4)) AS VARCHAR)",
            "t": f"strftime({column}, '%Y-%m-%d %H:%M:%S.%f')",
        }
        return framed_sql(forms[kind])

    return " || ".join(text(x) for x in _KINDS[name].split())


def checksum_sql(text: str) -> str:
    return f"CAST(coalesce(sum(CAST(CAST(concat('0x', substr(md5({text}), 1, 15)) AS BIGINT) AS DECIMAL(38,0))), 0) AS DECIMAL(38,0))"


def tree_sql(entries: str, levels: int = 3, group: int = 128) -> str:
    """CTEs ``l0`` .. of the digest tree over a relation ``(id, d)`` with dense ids; the root is ``max(d)`` of the last.

    Levels above the root would hash it again, so they pass a single row through.
    """
    out = [f"l0 AS (SELECT id // {group} AS id, sha256(string_agg(d, '' ORDER BY id)) AS d FROM {entries} GROUP BY 1)"]
    for k in range(1, levels):
        out.append(
            f"l{k} AS (SELECT id // {group} AS id, CASE WHEN (SELECT count(*) FROM l{k - 1}) > 1 THEN sha256(string_agg(d, '' ORDER BY id)) ELSE max(d) END AS d FROM l{k - 1} GROUP BY 1)"
        )
    return ", ".join(out)
