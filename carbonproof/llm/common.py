"""Helpers that several corpus operators share: scratch tables, labelled samples, components."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from carbonproof.functions.scratch import discard, dropping_shuffles, materialise, scratch_path, scratch_root, setting, small_batches

__all__ = ["discard", "dropping_shuffles", "materialise", "scratch_path", "scratch_root", "setting", "small_batches"]


def fresh_name(df: DataFrame, base: str) -> str:
    """A column name that ``df`` does not have in any case."""
    taken = {c.lower() for c in df.columns}
    while base.lower() in taken:
        base += "_"
    return base


def computed(df: DataFrame, **columns: Column) -> DataFrame:
    """``df`` with columns that are computed once: they come out of a generator of one row, through which no later filter is pushed."""
    held = fresh_name(df, "_held")
    one = F.array(F.struct(*[c.alias(name) for name, c in columns.items()]))
    return df.select("*", F.explode_outer(one).alias(held)).select("*", *[F.col(held)[name].alias(name) for name in columns]).drop(held)


def without_ids(docs: DataFrame, ids: DataFrame, how: str = "left_anti") -> DataFrame:
    """``docs`` without (``left_anti``) or with only (``left_semi``) the ids in the one column of ``ids``, all columns kept."""
    key = fresh_name(docs, "_id")
    return docs.join(ids.toDF(key), docs["doc_id"] == F.col(key), how)


def whole_text(column: str = "text") -> Column:
    """The text, null as the empty string."""
    return F.coalesce(F.col(column), F.lit(""))


def labelled_sample(labels: DataFrame, max_rows: int, seed: int = 7) -> DataFrame:
    """At most ``max_rows`` labelled documents, the ones with the smallest hash of their id.

    Rows with a null are left out; of a document with several labels the lowest quality and the
    highest toxicity count. The bound makes the sample safe to broadcast.
    """
    one = (
        labels.where("doc_id is not null and quality is not null and toxic is not null")
        .groupBy("doc_id")
        .agg(F.min("quality").cast("int").alias("quality"), F.max("toxic").cast("int").alias("toxic"))
    )
    return one.orderBy(F.xxhash64("doc_id", F.lit(seed)), "doc_id").limit(max_rows)


def connected_components(edges: DataFrame, label: str = "components") -> DataFrame:
    """Components of an undirected graph as rows ``(node, component)``; component is the smallest node.

    ``edges`` has two long columns ``src`` and ``dst``; self loops and repeats are harmless, nodes
    without an edge do not appear. Large-star and small-star steps alternate until nothing changes,
    which takes a number of rounds logarithmic in the longest path. Minima are aggregated before the
    shuffle and joined back, so a node with very many neighbours never sits in one task, and each
    round is written to the shared folder.
    """
    links = materialise(
        edges.where("src <> dst")
        .select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v"))
        .distinct(),
        label,
    )
    state = None
    while True:
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(least, "u")
            .where("v <> m")
            .select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionByName(least.select("u", F.col("m").alias("v")))
            .distinct()
        )
        seen = Observation()  # while the round is written, which saves a job that reads it
        hashes = F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("hashes")
        before, links = links, materialise(small.observe(seen, F.count(F.lit(1)).alias("n"), hashes), label)
        discard(before)
        now = seen.get
        if now == state:
            break
        state = now
    roots = links.select(F.col("v").alias("node")).distinct().withColumn("component", F.col("node"))
    out = materialise(links.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots), label)
    discard(links)
    return out


def digest(column: Column) -> Column:
    """SHA-256 of a string or binary column, lowercase hex."""
    return F.sha2(column, 256)


def word_pieces(text: Column) -> Column:
    """The matches of the public tokenizers' PATTERN in ``text``, in order; together they are the text.

    The flag gives white space its Unicode meaning, as in the libraries that define the pattern.
    """
    from public_tokenizers import PATTERN

    return F.regexp_extract_all(text, F.lit("(?U)" + PATTERN), F.lit(0))
