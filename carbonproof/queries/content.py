"""Queries on manifests, chunks and resumption."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from carbonproof.functions.scratch import scratch_path
from carbonproof.operators import chunks as ck
from carbonproof.operators import manifest as mf
from carbonproof.operators import resume as rs
from carbonproof.queries import fixtures as fx
from carbonproof.sources import item_files, readers

R = fx.Registry()
C = fx.C
_ENTRY_ALL = " || ".join(fx.framed_sql(f"CAST({c} AS VARCHAR)") for c in ("id", "rel_path", "kind", "size", "full_hash", "chunk_count"))
_ENTRY_SHORT = " || ".join(fx.framed_sql(f"CAST({c} AS VARCHAR)") for c in ("rel_path", "kind", "size", "full_hash"))


@R.add(
    f"WITH {fx.BAD_MANIFEST}, m AS (SELECT * FROM bad_manifest), "
    "up AS (SELECT id, rel_path, unnest(list_concat([''], list_transform(range(1, len(string_split(rel_path, '/'))), lambda k: array_to_string(list_slice(string_split(rel_path, '/'), 1, k), '/')))) AS above "
    "FROM m WHERE rel_path <> ''), nd AS (SELECT DISTINCT rel_path AS above FROM m WHERE kind <> 'directory') "
    "SELECT 'entry count' AS violation, CAST(NULL AS BIGINT) AS id, CAST(NULL AS VARCHAR) AS rel_path FROM (SELECT count(*) AS n FROM m) WHERE n <> 7 "
    "UNION ALL SELECT 'duplicate id', id, rel_path FROM m WHERE id IN (SELECT id FROM m GROUP BY 1 HAVING count(*) > 1) "
    "UNION ALL SELECT 'duplicate path', id, rel_path FROM m WHERE rel_path IN (SELECT rel_path FROM m GROUP BY 1 HAVING count(*) > 1) "
    "UNION ALL SELECT 'path component', id, rel_path FROM m WHERE rel_path <> '' AND len(list_filter(string_split(rel_path, '/'), lambda p: p IN ('', '.', '..'))) > 0 "
    "UNION ALL SELECT DISTINCT 'ancestor not a directory', id, rel_path FROM up WHERE above IN (SELECT above FROM nd) "
    "UNION ALL SELECT 'unknown kind', id, rel_path FROM m WHERE kind NOT IN ('file', 'directory', 'symlink', 'char_device', 'block_device') "
    "UNION ALL SELECT 'missing size', id, rel_path FROM m WHERE kind = 'file' AND size IS NULL "
    "UNION ALL SELECT 'missing digest', id, rel_path FROM m WHERE kind = 'file' AND full_hash IS NULL "
    f"UNION ALL SELECT 'chunk count', id, rel_path FROM m WHERE coalesce(chunk_count, -1) <> coalesce(CASE WHEN kind = 'file' THEN CAST(ceil(size / {C}.0) AS BIGINT) ELSE 0 END, -1)"
)
def validate_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mf.validate_manifest(fx.bad_manifest(spark, sf_dir), 7, C)


@R.add(f"WITH {fx.MANIFEST}, e AS (SELECT id, sha256({_ENTRY_ALL}) AS d FROM manifest), {fx.tree_sql('e')} SELECT max(d) AS manifest_hash FROM l2")
def manifest_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mf.manifest_hash(fx.manifest(spark, sf_dir))


_SUMMARY = (
    f"WITH {fx.MANIFEST}, e AS (SELECT id, sha256({_ENTRY_SHORT}) AS d FROM manifest), {fx.tree_sql('e')}, s AS (SELECT count(*) FILTER (kind = 'file') AS files, "
    "count(*) FILTER (kind = 'directory') AS directories, count(*) FILTER (kind = 'symlink') AS symlinks, count(*) FILTER (kind IN ('char_device', 'block_device')) AS devices, "
    "CAST(sum(size) FILTER (kind = 'file') AS BIGINT) AS total_bytes FROM manifest), a AS (SELECT s.*, (SELECT max(d) FROM l2) AS transfer_hash FROM s)"
)


@R.add(_SUMMARY + " SELECT * FROM a")
def transfer_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mf.transfer_summary(fx.manifest(spark, sf_dir))


@R.add(
    _SUMMARY + ", b AS (SELECT (SELECT count(*) FROM manifest WHERE kind = 'directory') AS directories), f AS ("
    + " UNION ALL ".join(
        f"SELECT '{c}' AS field, CAST({c} AS VARCHAR) AS a, " + ("CAST(directories AS VARCHAR)" if c == "directories" else "'0'" if c != "transfer_hash" else "NULL") + " AS b FROM a"
        for c in mf.SUMMARY_FIELDS
    )
    + ") SELECT field, a, CASE WHEN field = 'transfer_hash' THEN h ELSE b END AS b, a IS NOT DISTINCT FROM (CASE WHEN field = 'transfer_hash' THEN h ELSE b END) AS equal FROM f, "
    "(SELECT sha256(string_agg(d, '' ORDER BY id)) AS h FROM (SELECT row_number() OVER (ORDER BY id) - 1 AS id, sha256(" + _ENTRY_SHORT + ") AS d FROM manifest WHERE kind = 'directory'))"
)
def compare_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = fx.manifest(spark, sf_dir)
    return mf.compare_summaries(mf.transfer_summary(m), mf.transfer_summary(m.where("kind = 'directory'")))


@R.add(f'WITH {fx.ITEMS}, {fx.LAYOUT} SELECT item_id, chunk_index, "offset", CAST(len AS BIGINT) AS len FROM layout')
def chunk_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ck.chunk_layout(fx.items(spark, sf_dir), C)


@R.add(f'WITH {fx.CHUNKS} SELECT item_id, chunk_index, "offset", len, digest, data FROM chunks')
def split_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ck.split_chunks(fx.items(spark, sf_dir), C)


@R.add(f"WITH {fx.ITEMS} SELECT item_id, size AS total, sha256(payload) AS digest FROM items")
def item_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ck.item_digests(fx.items(spark, sf_dir))


@R.add(f'WITH {fx.BAD_CHUNKS} SELECT item_id, chunk_index, "offset", arrival, sha256(data) = digest AND len <= {C} AND len = octet_length(data) AS ok FROM bad_chunks')
def verify_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ck.verify_chunks(fx.bad_chunks(spark, sf_dir), C).select("item_id", "chunk_index", "offset", "arrival", "ok")


@R.add(
    f"WITH {fx.BAD_CHUNKS}, {fx.FILES} SELECT c.item_id, c.chunk_index, arrival, CASE WHEN f.id IS NULL THEN 'unknown item' WHEN kind <> 'file' THEN 'not a file' "
    f"WHEN chunk_index >= ceil(size / {C}.0) THEN 'index out of range' WHEN \"offset\" <> chunk_index * {C} THEN 'wrong offset' "
    f"WHEN len <> least({C}, size - chunk_index * {C}) THEN 'wrong length' END AS fault FROM bad_chunks c LEFT JOIN files f ON c.item_id = f.id"
)
def validate_geometry(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = ck.validate_geometry(fx.bad_chunks(spark, sf_dir), fx.files(spark, sf_dir), C)
    return out.select("item_id", "chunk_index", "arrival", "fault")


@R.add(f'WITH {fx.BAD_CHUNKS} SELECT item_id, chunk_index, "offset", digest, arrival FROM bad_chunks QUALIFY row_number() OVER (PARTITION BY item_id, chunk_index ORDER BY arrival) = 1')
def dedup_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ck.dedup_chunks(fx.bad_chunks(spark, sf_dir).drop("data")).select("item_id", "chunk_index", "offset", "digest", "arrival")


@R.add(
    f"WITH {fx.CHUNKS}, s AS (SELECT item_id, chunk_index, CASE WHEN item_id % 7 = 0 THEN NULL WHEN item_id % 5 = 0 THEN 'old' ELSE 'now' END AS transfer_id FROM chunks) "
    "SELECT item_id, chunk_index, coalesce(transfer_id = 'now', false) AS active FROM s"
)
def route_stray(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.when(F.col("item_id") % 7 == 0, None).when(F.col("item_id") % 5 == 0, "old").otherwise("now")
    active, stray = ck.route_stray(fx.chunks(spark, sf_dir).select("item_id", "chunk_index", name.alias("transfer_id")), "now")
    marked = active.withColumn("active", F.lit(True)).unionByName(stray.withColumn("active", F.lit(False)))
    return marked.select("item_id", "chunk_index", "active")


@R.add(
    f"WITH {fx.BAD_CHUNKS}, {fx.FILES}, s AS (SELECT *, coalesce(max(\"offset\" + len) OVER (PARTITION BY item_id ORDER BY \"offset\", len ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS reach "
    "FROM bad_chunks) SELECT item_id, 'gap' AS kind, reach AS start, \"offset\" AS stop FROM s WHERE \"offset\" > reach "
    "UNION ALL SELECT item_id, 'overlap', \"offset\", least(reach, \"offset\" + len) FROM s WHERE \"offset\" < reach "
    "UNION ALL SELECT f.id, 'gap', coalesce(r, 0), size FROM files f LEFT JOIN (SELECT item_id, max(\"offset\" + len) AS r FROM bad_chunks GROUP BY 1) x ON f.id = x.item_id "
    "WHERE kind = 'file' AND coalesce(r, 0) < size"
)
def chunk_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ck.chunk_gaps(fx.bad_chunks(spark, sf_dir).drop("data"), fx.files(spark, sf_dir))


@R.add(f"WITH {fx.ITEMS} SELECT item_id, payload FROM items WHERE size > 0")
def reassemble_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ck.reassemble_items(fx.chunks(spark, sf_dir))


@R.add(
    f"WITH {fx.ITEMS} SELECT item_id, CASE WHEN item_id % 31 = 0 OR item_id % 41 = 0 THEN 'incomplete' WHEN item_id % 43 = 0 AND size > 0 THEN 'wrong size' "
    "WHEN item_id % 37 = 0 THEN 'wrong digest' ELSE 'ok' END AS status FROM items"
)
def verify_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    whole = fx.items(spark, sf_dir)
    ends = ck.item_digests(whole).where("item_id % 31 <> 0")
    total = F.when(F.col("item_id") % 41 == 0, F.col("total") + 1).when((F.col("item_id") % 43 == 0) & (F.col("total") > 0), F.col("total") - 1).otherwise(F.col("total"))
    ends = ends.withColumn("digest", F.when(F.col("item_id") % 37 == 0, "deadbeef").otherwise(F.col("digest"))).withColumn("total", total)
    return ck.verify_items(whole, ends)


@R.add(f"WITH {fx.DONE} SELECT item_id, list_sort(list(chunk_index)) AS completed_chunks FROM done GROUP BY 1")
def resume_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rs.resume_state(fx.done_chunks(spark, sf_dir))


@R.add(
    f"WITH {fx.ITEMS}, {fx.FILES}, s AS (SELECT item_id, CAST(ceil(size / {C}.0) AS BIGINT) + (item_id % 19 = 0)::INT AS n, CASE WHEN item_id % 23 = 0 THEN 'other' ELSE 'this' END AS t, "
    "CASE WHEN item_id % 29 = 0 THEN '1' ELSE '2' END AS p, CASE WHEN item_id % 31 = 0 THEN 'x' ELSE 'm' END AS h FROM items) "
    "SELECT item_id, reason FROM (SELECT item_id, CASE WHEN t <> 'this' THEN 'other transfer' WHEN p <> '2' THEN 'other protocol' WHEN h <> 'm' THEN 'other manifest' "
    f"WHEN f.id IS NULL THEN 'unknown item' WHEN n <> CASE WHEN kind = 'file' THEN CAST(ceil(size / {C}.0) AS BIGINT) ELSE 0 END THEN 'layout differs' END AS reason "
    "FROM s LEFT JOIN files f ON s.item_id = f.id) WHERE reason IS NOT NULL"
)
def validate_resume(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("item_id")
    state = fx.items(spark, sf_dir).select(
        "item_id", (F.ceil(F.col("size") / C) + (n % 19 == 0).cast("int")).cast("bigint").alias("n_chunks"), F.when(n % 23 == 0, "other").otherwise("this").alias("transfer_id"),
        F.when(n % 29 == 0, "1").otherwise("2").alias("protocol"), F.when(n % 31 == 0, "x").otherwise("m").alias("manifest_hash"),
    )
    return rs.validate_resume(state, fx.files(spark, sf_dir), {"transfer_id": "this", "protocol": "2", "manifest_hash": "m"}, C)


@R.add(f'WITH {fx.DONE} SELECT item_id, chunk_index, "offset", len FROM chunks ANTI JOIN done USING (item_id, chunk_index)')
def pending_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rs.pending_chunks(ck.chunk_layout(fx.items(spark, sf_dir), C), fx.done_chunks(spark, sf_dir))


@R.add(
    f"WITH {fx.DONE}, p AS (SELECT item_id, count(*) AS total_chunks, count(d.fresh) AS resumed_chunks, CAST(coalesce(sum(len) FILTER (d.fresh IS NOT NULL), 0) AS BIGINT) AS resumed_bytes "
    "FROM chunks LEFT JOIN done d USING (item_id, chunk_index) GROUP BY 1) SELECT item_id, coalesce(total_chunks, 0) AS total_chunks, coalesce(resumed_chunks, 0) AS resumed_chunks, "
    "coalesce(resumed_bytes, 0) AS resumed_bytes, coalesce(total_chunks, 0) = coalesce(resumed_chunks, 0) AS complete FROM items LEFT JOIN p USING (item_id)"
)
def resume_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    whole = fx.items(spark, sf_dir)
    return rs.resume_progress(whole, ck.chunk_layout(whole, C), fx.done_chunks(spark, sf_dir))


@R.add(
    f"WITH {fx.DONE} SELECT item_id FROM (SELECT item_id, count(*) AS n FROM chunks GROUP BY 1) JOIN (SELECT item_id, count(*) AS h, count(*) FILTER (fresh) AS v FROM done GROUP BY 1) USING (item_id) "
    "WHERE h = n AND v < h"
)
def rehash_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rs.rehash_candidates(ck.chunk_layout(fx.items(spark, sf_dir), C), fx.done_chunks(spark, sf_dir))


@R.add(f"WITH {fx.DONE} SELECT item_id, chunk_index, fresh FROM done WHERE item_id % 37 <> 0")
def reset_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rs.reset_items(fx.done_chunks(spark, sf_dir), fx.items(spark, sf_dir).where("item_id % 37 = 0"))


@R.add(
    f"WITH {fx.ITEMS}, r AS (SELECT (row_number() OVER (ORDER BY item_id) - 1) % 6 AS lane, size FROM items), p AS (SELECT lane, count(*) AS items, CAST(sum(size) AS BIGINT) AS bytes FROM r GROUP BY 1) "
    "SELECT lane, items, bytes, CAST(round(CAST(bytes AS DECIMAL(38,10)) * 6 / (SELECT CAST(sum(bytes) AS BIGINT) FROM p), 4) AS DECIMAL(18,4)) AS skew FROM p"
)
def assign_lanes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rs.assign_lanes(fx.items(spark, sf_dir).select("item_id", "size"), 6)


#: Bytes up to which the queries digest items whole, and digests under a node.
WHOLE, GROUP = 4096, 8


def _item_tree_sql(chunks: str, levels: int = 6) -> str:
    """CTEs ``dig`` (item_id, total, digest) over chunks ``(item_id, chunk_index, offset, len, data)``: six levels are enough for 8^6 chunks."""
    steps = [
        f"sz AS (SELECT item_id, CAST(sum(len) AS BIGINT) AS total, count(*) AS n FROM {chunks} GROUP BY 1)",
        f"lv0 AS (SELECT item_id, total, chunk_index AS place, sha256(data) AS d, n FROM {chunks} JOIN sz USING (item_id) WHERE total > {WHOLE})",
    ]
    for k in range(1, levels + 1):
        node = "sha256(string_agg(d, '' ORDER BY place))" if k == 1 else "CASE WHEN n = 1 THEN max(d) ELSE sha256(string_agg(d, '' ORDER BY place)) END"
        steps.append(f"lv{k} AS (SELECT item_id, total, place // {GROUP} AS place, {node} AS d, CAST(ceil(n / {GROUP}.0) AS BIGINT) AS n FROM lv{k - 1} GROUP BY item_id, total, place // {GROUP}, n)")
    small = f"SELECT item_id, total, sha256(payload) AS digest FROM {chunks} JOIN sz USING (item_id) JOIN items USING (item_id) WHERE total <= {WHOLE} AND chunk_index = 0"
    return ", ".join([*steps, f"dig AS (SELECT item_id, total, d AS digest FROM lv{levels} UNION ALL {small})"])


@R.add(f"WITH {fx.CHUNKS}, {_item_tree_sql('chunks')} SELECT item_id, total, digest FROM dig")
def chunk_item_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ck.chunk_item_digests(fx.chunks(spark, sf_dir), WHOLE, GROUP)


@R.add(
    f"WITH {fx.CHUNKS}, {_item_tree_sql('chunks')} SELECT item_id, CASE WHEN item_id % 31 = 0 OR (item_id % 29 = 0 AND size > 0) THEN 'incomplete' WHEN item_id % 41 = 0 AND total > 1 THEN 'wrong size' "
    "WHEN item_id % 37 = 0 THEN 'wrong digest' ELSE 'ok' END AS status FROM items LEFT JOIN dig USING (item_id)"
)
def verify_chunked_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    whole, n = fx.chunks(spark, sf_dir), F.col("item_id")
    expected = fx.items(spark, sf_dir)
    empty = expected.where("coalesce(size, 0) = 0").select("item_id", F.lit(0).cast("bigint").alias("total"), F.sha2(F.lit(""), 256).alias("digest"))
    ends = ck.chunk_item_digests(whole, WHOLE, GROUP).unionByName(empty).where(n % 31 != 0)
    ends = ends.withColumn("digest", F.when(n % 37 == 0, "deadbeef").otherwise(F.col("digest")))
    ends = ends.withColumn("total", F.when((n % 41 == 0) & (F.col("total") > 1), F.col("total") - 1).otherwise(F.col("total")))
    last = F.col("chunk_index") == F.max("chunk_index").over(Window.partitionBy("item_id"))
    arrived = whole.where(n % 29 != 0).unionByName(whole.where(n % 29 == 0).withColumn("last", last).where("not last").drop("last"))
    return ck.verify_chunked_items(arrived, ends, WHOLE, GROUP, expected)


@R.add(f"WITH {fx.ITEMS} SELECT CAST(item_id AS VARCHAR) AS rel_path, size, sha256(payload) AS full_hash FROM items WHERE size > 0")
def write_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = item_files.write_items(fx.chunks(spark, sf_dir).orderBy("arrival"), scratch_path(spark, "items"))
    return readers.read_payloads(spark, path).select("rel_path", "size", "full_hash")
