"""Byte-level BPE encoding and decoding.

Words are counted over the whole corpus; the frequent ones, up to a fixed number, are encoded once
each by Spark higher-order functions: a fold starts from the ranks of the single bytes and merges the
lowest-ranked neighbours, with a literal map from pairs of ranks to the rank of their union. This
dictionary has a bounded size and goes to the workers, which put the documents together from it; the
few occurrences of rarer words are merged in the worker by the same rule. Decoding concatenates the
binary pieces of the ids.
"""

from __future__ import annotations

import base64
import heapq
import json
import uuid
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from carbonproof.llm.common import materialise, whole_text, word_pieces

#: Words in the dictionary, at most; longer words than MAX_BYTES are merged in the workers.
MAX_WORDS, MAX_BYTES = 1 << 18, 48
#: Buckets of the literal pair map.
BUCKETS = 1 << 17
#: Pieces put together at once, and rare words that a worker remembers.
PART_PIECES, MAX_REMEMBERED = 1 << 19, 200_000
#: Ranks stay below this, so a pair is one long that is no rank.
BASE = 1 << 20


def load_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and their ranks, from lines of base64 and number."""
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, Path(path).read_bytes().splitlines())}


def pair_table(ranks: dict[bytes, int], buckets: int = BUCKETS) -> list[list[int]]:
    """Buckets of ``pair, rank, pair, rank, ...``: every way in which a token is the union of two others."""
    table: list[list[int]] = [[] for _ in range(buckets)]
    for token, rank in ranks.items():
        for cut in range(1, len(token)):
            a, b = ranks.get(token[:cut]), ranks.get(token[cut:])
            if a is not None and b is not None:
                key = (a + 1) * BASE + b
                table[key % buckets] += [key, rank]
    return table


def _let(value: Column, body) -> Column:
    return F.element_at(F.transform(F.array(value), body), 1)


def fold_merges(word: Column, ranks: dict[bytes, int]) -> Column:
    """The ids of the bytes of ``word``, an array of longs, by ranked merges."""
    table = F.from_json(F.lit(json.dumps(pair_table(ranks), separators=(",", ":"))), "array<array<bigint>>")
    singles = F.from_json(F.lit(json.dumps([ranks[bytes([b])] for b in range(256)])), "array<bigint>")
    data = F.encode(word, "UTF-8")

    def start(single: Column) -> Column:
        at = F.sequence(F.lit(1), F.octet_length(data))
        return F.transform(at, lambda i: F.get(single, F.conv(F.hex(F.substring(data, i, F.lit(1))), 16, 10).cast("int")))

    def rank(t: Column, a: Column, b: Column) -> Column:
        key = (a + 1) * BASE + b
        bucket = F.get(t, F.pmod(key, F.lit(BUCKETS)).cast("int"))
        return F.get(bucket, F.array_position(bucket, key).cast("int"))

    def step(t: Column, ids: Column) -> Column:
        pairs = F.transform(F.slice(ids, F.lit(1), F.size(ids) - 1), lambda a, i: rank(t, a, F.get(ids, i + 1)))

        def merged(found: Column) -> Column:
            least = F.array_min(found)
            at = F.array_position(found, least).cast("int")
            joined = F.concat(F.slice(ids, F.lit(1), at - 1), F.array(least), F.slice(ids, at + 2, F.size(ids)))
            return F.when(least < BASE, joined).otherwise(ids)

        return F.when(F.size(ids) < 2, ids).otherwise(_let(pairs, merged))

    def fold(t: Column, ids: Column) -> Column:
        rounds = F.sequence(F.lit(2), F.greatest(F.lit(2), F.size(ids)))
        return F.aggregate(rounds, ids, lambda acc, _: step(t, acc))

    return _let(table, lambda t: _let(_let(singles, start), lambda ids: fold(t, ids)))


def pair_ranks(ranks: dict[bytes, int]) -> dict[int, int]:
    """The pair table as one map, for the workers."""
    return {key: rank for bucket in pair_table(ranks, 1) for key, rank in zip(bucket[::2], bucket[1::2], strict=True)}


def merge_word(word: bytes, singles: list[int], pairs: dict[int, int]) -> list[int]:
    """The ids of one word by the same merges; only the neighbours of a merge are looked up anew."""
    ids = [singles[b] for b in word]
    if len(ids) > 500:
        return _merge_long(ids, pairs)
    find = pairs.get
    found = [find((a + 1) * BASE + b, BASE) for a, b in zip(ids, ids[1:], strict=False)]
    while found and (least := min(found)) < BASE:
        i = found.index(least)
        ids[i] = least
        del ids[i + 1], found[i]
        if i < len(found):
            found[i] = find((least + 1) * BASE + ids[i + 1], BASE)
        if i:
            found[i - 1] = find((ids[i - 1] + 1) * BASE + least, BASE)
    return ids


def _merge_long(ids: list[int], pairs: dict[int, int]) -> list[int]:
    """``merge_word`` for long words, with a heap of the pairs that may merge next."""
    n = len(ids)
    parts, after, before = list(ids), list(range(1, n + 1)), list(range(-1, n - 1))

    def rank(i: int) -> int | None:
        return pairs.get((parts[i] + 1) * BASE + parts[after[i]])

    heap = [(r, i) for i in range(n - 1) if (r := rank(i)) is not None]
    heapq.heapify(heap)
    while heap:
        r, i = heapq.heappop(heap)
        j = after[i]
        if parts[i] < 0 or j >= n or rank(i) != r:
            continue
        parts[i], parts[j], after[i] = r, -1, after[j]
        if after[i] < n:
            before[after[i]] = i
        for a in (before[i], i):
            if a >= 0 and after[a] < n and (r := rank(a)) is not None:
                heapq.heappush(heap, (r, a))
    return [p for p in parts if p >= 0]


def frequent_words(pieces: DataFrame, max_words: int) -> DataFrame:
    """``piece``: the most frequent pieces, fewer than ``max_words``, cut at a count found from a histogram."""
    counts = materialise(
        pieces.select(F.explode_outer("pieces").alias("piece")).where(F.octet_length("piece") <= MAX_BYTES).groupBy("piece").agg(F.count("*").alias("n")), "words"
    )
    bins = counts.groupBy(F.floor(F.log2("n") * 8).cast("int").alias("bin")).agg(F.count("*").alias("words")).orderBy(F.desc("bin")).collect()
    total, least = 0, None
    for b in bins:
        total += b["words"]
        if total > max_words:
            break
        least = b["bin"]
    return counts.where(F.floor(F.log2("n") * 8) >= (least if least is not None else 1 << 20)).select("piece")


class _Assembler:
    """Puts documents together from the dictionary; one for each worker and dictionary."""

    def __init__(self, words: bytes, ranks: dict[bytes, int]) -> None:
        table = pa.ipc.open_stream(words).read_all().combine_chunks()
        self.words, self.ids = table.column("piece").combine_chunks(), table.column("ids").combine_chunks().cast(pa.list_(pa.int32()))
        self.singles, self.pairs, self.rare = [ranks[bytes([b])] for b in range(256)], pair_ranks(ranks), {}
        tokens = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            tokens[rank] = token
        self.tokens = pa.array(tokens, pa.large_binary())

    def _merged(self, words: list[str]) -> list[list[int]]:
        if len(self.rare) > MAX_REMEMBERED:
            self.rare.clear()
        out = []
        for w in words:
            ids = self.rare.get(w)
            if ids is None:
                ids = merge_word(w.encode(), self.singles, self.pairs)
                if len(w) <= MAX_BYTES:
                    self.rare[w] = ids
            out.append(ids)
        return out

    def encode(self, lists: pa.ListArray) -> tuple[pa.Array, np.ndarray]:
        """All ids of some documents, and where each document's begin and end."""
        pieces = lists.flatten()
        at = pc.index_in(pieces, value_set=self.words)
        missing = at.is_null()
        ids = self.ids
        if missing.true_count:
            rare = pieces.filter(missing).dictionary_encode()
            extra = pa.array(self._merged(rare.dictionary.to_pylist()), pa.list_(pa.int32()))
            at = pc.replace_with_mask(at, missing, pc.add(rare.indices.cast(pa.int32()), len(ids)).cast(pa.int32()))
            ids = pa.concat_arrays([ids, extra])
        taken = ids.take(at)
        ends = np.concatenate([[0], np.cumsum(taken.value_lengths().to_numpy().astype(np.int64))])
        return taken.flatten(), ends[lists.offsets.to_numpy() - lists.offsets[0].as_py()]

    def decode(self, ids: pa.Array) -> pa.Array:
        return self.tokens.take(ids)


_READY: dict[str, _Assembler] = {}
ENCODED_SCHEMA = "doc_id bigint, n_tokens bigint, ids binary, decoded binary"


def _cuts(lists: pa.ListArray) -> Iterator[tuple[int, int]]:
    """Stretches of rows with about PART_PIECES pieces."""
    offsets, start = lists.offsets.to_numpy(), 0
    while start < len(lists):
        stop = max(start + 1, int(np.searchsorted(offsets, offsets[start] + PART_PIECES, "right")) - 1)
        yield start, min(stop, len(lists))
        start = min(stop, len(lists))


def _assembled(pieces: DataFrame, dictionary: DataFrame, ranks: dict[bytes, int], decoded: bool) -> DataFrame:
    table = dictionary.toArrow()
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as writer:
        writer.write_table(table)
    held, name = pieces.sparkSession.sparkContext.broadcast((sink.getvalue().to_pybytes(), ranks)), uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if name not in _READY:
            _READY.clear()
            _READY[name] = _Assembler(*held.value)
        bpe = _READY[name]
        for batch in batches:
            for start, stop in _cuts(batch.column(1)):
                part = batch.slice(start, stop - start)
                ids, ends = bpe.encode(part.column(1))
                packed = ids.to_numpy().astype("<u4").tobytes()
                columns = [part.column(0), pa.array(np.diff(ends)), pa.array([packed[4 * a : 4 * b] for a, b in zip(ends, ends[1:], strict=False)], pa.binary())]
                if decoded:
                    text = bpe.decode(ids)
                    at = np.frombuffer(text.buffers()[1], np.int64)[text.offset : text.offset + len(text) + 1] if len(text) else np.zeros(1, np.int64)
                    data = memoryview(text.buffers()[2] or b"")
                    columns.append(pa.array([bytes(data[at[a] : at[b]]) for a, b in zip(ends, ends[1:], strict=False)], pa.binary()))
                else:
                    columns.append(pa.nulls(len(part), pa.binary()))
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_tokens", "ids", "decoded"])

    return pieces.mapInArrow(run, ENCODED_SCHEMA)


def encode_texts(docs: DataFrame, rank_file: str, max_words: int = MAX_WORDS, decoded: bool = False) -> DataFrame:
    """Ids of every whole text: ``(doc_id, n_tokens, ids, decoded)``.

    ``ids`` are little-endian unsigned 32-bit integers; ``decoded`` has the bytes that the ids stand for
    if asked for, else null. ``rank_file`` is read on the driver. Null texts count as empty (no ids);
    null ids and repeated rows give a row each; an empty table gives an empty table; other columns are
    ignored. Each match of the pattern is encoded separately, whatever its length.
    """
    ranks = load_ranks(rank_file)
    pieces = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), word_pieces(whole_text()).alias("pieces"))
    words = frequent_words(pieces.select("pieces"), max_words)
    dictionary = materialise(words.select("piece", fold_merges(F.col("piece"), ranks).cast("array<int>").alias("ids")), "bpe-dictionary")
    return _assembled(pieces, dictionary, ranks, decoded)


def decode_ids(encoded: DataFrame, rank_file: str) -> DataFrame:
    """``doc_id`` and ``decoded`` of rows ``(doc_id, ids)``: the binary pieces of the ids, concatenated; null ids stay null."""
    held = encoded.sparkSession.sparkContext.broadcast({rank: token for token, rank in load_ranks(rank_file).items()})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [None if x is None else b"".join(map(held.value.__getitem__, np.frombuffer(x, "<u4").tolist())) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], ["doc_id", "decoded"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id bigint, decoded binary")


def with_digests(encoded: DataFrame) -> DataFrame:
    """``encoded`` with the SHA-256 digests of ids and decoded bytes, without the bytes."""
    return encoded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
