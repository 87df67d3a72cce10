"""Token counts through a digest cache.

A count depends on the content and on the tokenizer, so the cache is keyed by the digests of both.
Texts are looked up first; only the distinct texts that miss are encoded, and their counts are
appended to the cache. Copies of a text are therefore encoded once, and a second run over the same
corpus encodes nothing.
"""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from carbonproof.llm.common import digest, dropping_shuffles, scratch_path, whole_text, word_pieces

CACHE_SCHEMA = "content_digest string, tokenizer_digest string, n_tokens bigint"
#: Pieces whose counts a worker remembers, at most; it forgets all of them beyond that.
MAX_REMEMBERED = 500_000
#: Longer pieces are not remembered.
MAX_PIECE = 64


def _counter(path: str) -> Callable[[list[str]], list[int]]:
    """Counts tokens with the library that the file belongs to."""
    if path.endswith(".model"):
        import sentencepiece

        pieces = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda texts: [len(x) for x in pieces.encode(texts, num_threads=1)]
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return lambda texts: [len(x) for x in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]


class _Remembering:
    """Counts of pieces, each distinct piece encoded once while it is remembered."""

    def __init__(self, path: str) -> None:
        self.count, self.known = _counter(path), {}

    def __call__(self, pieces: list[str]) -> list[int]:
        if len(self.known) > MAX_REMEMBERED:
            self.known.clear()
        known = self.known
        new = [x for x in pieces if x not in known]
        for at in range(0, len(new), 1000):
            part = new[at : at + 1000]
            known.update(zip(part, self.count(part), strict=True))
        out = [known[x] for x in pieces]
        for x in new:
            if len(x) > MAX_PIECE:
                del known[x]
        return out


_LOADED: dict[str, _Remembering] = {}


def _encode(path: str, version: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path not in _LOADED:
            _LOADED[path] = _Remembering(path)
        for batch in batches:
            lists = batch.column(1)
            distinct = lists.flatten().dictionary_encode()
            counts = np.array(_LOADED[path](distinct.dictionary.to_pylist()), dtype=np.int64)
            ends = np.concatenate([[0], np.cumsum(counts[distinct.indices.to_numpy()])]) if len(distinct) else np.zeros(1, np.int64)
            at = lists.offsets.to_numpy() - lists.offsets[0].as_py()
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([version] * len(batch)), pa.array(ends[at[1:]] - ends[at[:-1]])],
                ["content_digest", "tokenizer_digest", "n_tokens"],
            )

    return run


def _pieces(tokenizer: str, content: Column) -> Column:
    """What the library encodes one by one: pieces that no token crosses, or else the whole text.

    A byte-level tokenizer without a normaliser splits texts by PATTERN first, so its pieces can be
    counted apart. A text that holds one of its added tokens stays whole, as do all texts of others.
    """
    if not tokenizer.endswith(".json"):
        return F.array(content)
    spec = json.loads(Path(tokenizer).read_text(encoding="utf-8"))
    split = spec["pre_tokenizer"] or {}
    if spec["normalizer"] or split.get("type") != "ByteLevel" or split.get("add_prefix_space") or not split.get("use_regex"):
        return F.array(content)
    pieces = word_pieces(content)
    for token in spec["added_tokens"]:
        pieces = F.when(F.contains(content, F.lit(token["content"])), F.array(content)).otherwise(pieces)
    return pieces


def open_cache(spark: SparkSession, path: str) -> DataFrame:
    """The cache's rows; an empty cache is created where none is."""
    spark.createDataFrame([], CACHE_SCHEMA).write.mode("append").parquet(path)
    return spark.read.schema(CACHE_SCHEMA).parquet(path)


def token_counts(
    docs: DataFrame, tokenizer: str, cache: str | None = None, limit: int = 512, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Token count of every whole text: ``(id_col, content_digest, n_bytes, n_tokens, over_limit)``.

    ``tokenizer`` is a ``.json`` file of the tokenizers library or a ``.model`` file of sentencepiece,
    present at that path on every worker. ``cache`` is a folder that all executors share; without one
    a new folder of the shared scratch space is taken. No begin, end or padding tokens are added and
    nothing is cut.

    A null text counts as empty (0 bytes, 0 tokens); null ids and repeated rows give a row each; an
    empty table gives an empty table; other columns are ignored.
    """
    spark = docs.sparkSession
    cache = cache or scratch_path(spark, "token-cache")
    version = hashlib.sha256(Path(tokenizer).read_bytes()).hexdigest()
    texts = docs.select(F.col(id_col), whole_text(text_col).alias("content")).withColumn("content_digest", digest(F.col("content")))
    known = open_cache(spark, cache).where(F.col("tokenizer_digest") == version)
    misses = (
        texts.join(known.select("content_digest"), "content_digest", "left_anti")
        .groupBy("content_digest")
        .agg(F.any_value("content").alias("content"))
        .select("content_digest", _pieces(tokenizer, F.col("content")).alias("pieces"))
    )
    with dropping_shuffles(spark):
        misses.mapInArrow(_encode(tokenizer, version), CACHE_SCHEMA).write.mode("append").parquet(cache)
    counts = (
        spark.read.schema(CACHE_SCHEMA)
        .parquet(cache)
        .where(F.col("tokenizer_digest") == version)
        .groupBy("content_digest")
        .agg(F.max("n_tokens").alias("n_tokens"))
    )
    return (
        texts.select(id_col, "content_digest", F.octet_length("content").cast("bigint").alias("n_bytes"))
        .join(counts, "content_digest")
        .select(id_col, "content_digest", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
    )
