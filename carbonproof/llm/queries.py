"""One registered query for each corpus operator, over whole tables with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import public_tokenizers
from carbonproof.llm.byte_bpe import encode_texts, with_digests
from carbonproof.llm.common import scratch_path
from carbonproof.llm.decontaminate import contaminated
from carbonproof.llm.html_extract import extract_text
from carbonproof.llm.lexical import ranked_search
from carbonproof.llm.license_scan import license_scan
from carbonproof.llm.line_dedup import dedup_lines
from carbonproof.llm.packing import pack
from carbonproof.llm.quality_classifier import quality_scores
from carbonproof.llm.quality_rules import BASE, quality_rules
from carbonproof.llm.sharding import Policy, ShardStore
from carbonproof.llm.simhash import simhash_groups
from carbonproof.llm.token_counts import token_counts
from carbonproof.llm.whitening import whiten

#: Documents of one arrival in op1.
ARRIVAL = 512


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each document lies once all arrivals are appended and compacted."""
    store = ShardStore(spark, scratch_path(spark, "shards"), Policy())
    size = F.coalesce(F.octet_length("text"), F.lit(0))
    docs = _table(spark, sf_dir, "documents")
    store.append(docs, F.floor(F.col("doc_id") / ARRIVAL), size)
    store.compact_all(size)
    where = store.manifest().select(F.col("shard_id").alias("_shard"), "shard_id", "tier", "n_rows", "n_bytes")
    placed = store.read().select("doc_id", "_shard", size.cast("bigint").alias("text_bytes"))
    return placed.join(where, "_shard").drop("_shard")


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """n-grams, importance and verdict of every document."""
    out = quality_scores(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))
    return out.select("doc_id", "n_grams", "log_importance", "kept")


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The text that each document has left, and how many lines it had and lost."""
    out = dedup_lines(_table(spark, sf_dir, "documents").select("doc_id", "text"), keep_count=True)
    return out.select("doc_id", "n_lines", "n_dropped", "text")


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document and benchmark item found in it, with the least distance and its place."""
    return contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base statistics and the learned rules' verdict of every document."""
    out = quality_rules(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))
    return out.select("doc_id", *BASE, "base_failed", "kept", "rule")


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Number of ids of every document, and digests of the ids and of what they decode to."""
    ranks = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return with_digests(encode_texts(_table(spark, sf_dir, "documents"), ranks, decoded=True))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and group of every document."""
    return simhash_groups(_table(spark, sf_dir, "documents"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes and tokens of every document."""
    out = token_counts(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return out.select("doc_id", "n_bytes", "n_tokens", "over_limit")


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base phrases and licences of every document."""
    return license_scan(_table(spark, sf_dir, "documents")).drop("detections")


def op10_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return extract_text(_table(spark, sf_dir, "pages"))


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector on the first 32 components, with its exact deviation."""
    return whiten(_table(spark, sf_dir, "embeddings"))


def op12_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every piece of every document with its sequence and place there."""
    return pack(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents of every benchmark item."""
    return ranked_search(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def _compaction_sql(passes: int = 4, policy: Policy | None = None) -> str:
    """The plan of op1 as SQL: passes of the same rule; further passes change nothing at these sizes."""
    p = policy or Policy()
    tiers, bound, tier = [], p.smallest_bytes * p.fanout, 1
    while bound < p.target_bytes:
        tiers.append((bound, tier))
        bound, tier = bound * p.fanout, tier + 1
    cases = f"WHEN n_bytes >= {p.target_bytes} THEN {tier} " + " ".join(f"WHEN n_bytes >= {b} THEN {t}" for b, t in reversed(tiers))
    tier_of = f"CAST(CASE {cases} ELSE 0 END AS INTEGER)"
    steps = [
        f"d AS (SELECT doc_id, coalesce(doc_id // {ARRIVAL}, 0) AS a0, CAST(coalesce(strlen(text), 0) AS BIGINT) AS text_bytes FROM documents)",
        "s0 AS (SELECT a0 AS sequence, count(*) AS n_rows, CAST(sum(text_bytes) AS BIGINT) AS n_bytes FROM d GROUP BY 1)",
        "m0 AS (SELECT doc_id, text_bytes, a0 AS sequence FROM d)",
    ]
    for k in range(1, passes + 1):
        steps += [
            f"t{k} AS (SELECT *, {tier_of} AS tier FROM s{k - 1})",
            f"c{k} AS (SELECT *, CASE WHEN lag(tier) OVER (ORDER BY sequence) <> tier THEN 1 ELSE 0 END AS change FROM t{k})",
            f"r{k} AS (SELECT *, sum(change) OVER (ORDER BY sequence) AS run FROM c{k})",
            f"u{k} AS (SELECT *, (sum(n_bytes) OVER (PARTITION BY run ORDER BY sequence) - n_bytes) // {p.target_bytes} AS piece FROM r{k} WHERE n_bytes < {p.target_bytes})",
            f"v{k} AS (SELECT sequence, count(*) OVER (PARTITION BY run, piece) AS members, min(sequence) OVER (PARTITION BY run, piece) AS first FROM u{k})",
            f"w{k} AS (SELECT s.sequence, CASE WHEN v.members >= {p.min_run} THEN v.first ELSE s.sequence END AS into_ FROM s{k - 1} s LEFT JOIN v{k} v ON s.sequence = v.sequence)",
            f"m{k} AS (SELECT m.doc_id, m.text_bytes, w.into_ AS sequence FROM m{k - 1} m JOIN w{k} w ON m.sequence = w.sequence)",
            f"s{k} AS (SELECT sequence, count(*) AS n_rows, CAST(sum(text_bytes) AS BIGINT) AS n_bytes FROM m{k} GROUP BY 1)",
        ]
    return (
        "WITH " + ", ".join(steps) + f" SELECT m.doc_id, m.text_bytes, printf('s%015d', m.sequence) AS shard_id, {tier_of} AS tier, s.n_rows, s.n_bytes "
        f"FROM m{passes} m JOIN s{passes} s ON m.sequence = s.sequence"
    )


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_TERMS = f"unnest(regexp_extract_all(translate(text, '{_UPPER}', '{_LOWER}'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+'))"
#: op13 in full: every document that shares a term with an item is scored.
_SEARCH_SQL = f"""
    WITH d AS (SELECT row_number() OVER () AS r, doc_id, text FROM documents),
    i AS (SELECT row_number() OVER () AS item, item_id, text FROM benchmark),
    tf AS (SELECT r, t, count(*) AS tf FROM (SELECT r, {_TERMS} AS t FROM d) GROUP BY r, t),
    n AS (SELECT r, CAST(sum(tf) AS BIGINT) AS n FROM tf GROUP BY r),
    s AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS total FROM n),
    m AS (SELECT r, 100 - 75 + ((75 * n * docs) // total) AS m FROM n, s),
    w AS (SELECT t, CAST(floor(1000 * ln((2 * docs + 2) / (2 * df + 1))) AS BIGINT) AS w FROM (SELECT t, count(*) AS df FROM tf GROUP BY t), s),
    q AS (SELECT item, t, count(*) AS times FROM (SELECT item, {_TERMS} AS t FROM i) GROUP BY item, t),
    scored AS (
        SELECT q.item, tf.r, CAST(sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * m))) AS BIGINT) AS score
        FROM q JOIN w USING (t) JOIN tf USING (t) JOIN m ON m.r = tf.r GROUP BY q.item, tf.r
    ),
    ranked AS (
        SELECT item, doc_id, score, row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id) AS rank
        FROM scored JOIN d USING (r) WHERE score > 0
    )
    SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM ranked JOIN i USING (item) WHERE rank <= 10
"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_sharding": op1_sharding,
    "op2_quality_classifier": op2_quality_classifier,
    "op3_line_dedup": op3_line_dedup,
    "op4_decontamination": op4_decontamination,
    "op5_quality_rules": op5_quality_rules,
    "op6_byte_bpe": op6_byte_bpe,
    "op7_simhash": op7_simhash,
    "op8_token_counts": op8_token_counts,
    "op9_license_scan": op9_license_scan,
    "op10_html_extraction": op10_html_extraction,
    "op11_whitening": op11_whitening,
    "op12_packing": op12_packing,
    "op13_lexical_search": op13_lexical_search,
}

ORACLE_SQL: dict[str, str] = {"op1_sharding": _compaction_sql(), "op13_lexical_search": _SEARCH_SQL}
