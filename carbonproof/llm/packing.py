"""Packing of documents into sequences by a grouping genetic algorithm.

Documents of equal length are interchangeable, and there are at most as many lengths as a sequence
has tokens. So an individual of the algorithm is a table of bins by what they hold: a pattern
(lengths in falling order) and the number of bins that have it. A run over any number of documents
works on the counts of their lengths, and the best individual is dealt out to the documents at the end.

Crossover injects whole well-filled bins of one parent into the other, takes out the other's bins that
hold the same documents, and puts what these held besides back by best fit. Islands are groups of a Spark job, each with its
own population; after each epoch the best individual of an island goes to the next one too.
"""

from __future__ import annotations

import json
import random
import zlib
from bisect import bisect_left, insort
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache
from pathlib import Path

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from carbonproof.llm.common import discard, materialise, small_batches, whole_text

#: Tokens of a sequence.
WINDOW = 2048

Pattern = tuple[int, ...]
Bins = dict[Pattern, int]
Batches = Iterator[pa.RecordBatch]


@dataclass(frozen=True)
class Evolution:
    """Islands, individuals on each, epochs and crossovers of each island in an epoch."""

    islands: int = 4
    population: int = 6
    epochs: int = 3
    crossovers: int = 12
    #: Share of the other parent's bins that a crossover injects, at most.
    injected: float = 0.3
    #: Patterns of an individual in multiples of the window; a child of more is not born.
    most_patterns: int = 16
    seed: int = 11


# Tokens


@lru_cache(maxsize=2)
def encoder(path: str) -> Callable[[str], np.ndarray]:
    """Ids of a text as the tokenizers library gives them for this file, added tokens inside the text included.

    A byte-level BPE whose ids follow its merges is the same as ranks of byte strings, which tiktoken
    encodes several times faster; any other file goes to the tokenizers library itself.
    """
    from tokenizers import Tokenizer

    spec = json.loads(Path(path).read_text(encoding="utf-8"))
    model, split, added = spec["model"], spec["pre_tokenizer"] or {}, spec["added_tokens"]
    merges = ["".join(m) if isinstance(m, list) else m.replace(" ", "", 1) for m in model.get("merges", ())]
    plain = split.get("type") == "ByteLevel" and split.get("use_regex") and not split.get("add_prefix_space") and not spec["normalizer"]
    plain &= not any(t[k] for t in added for k in ("single_word", "lstrip", "rstrip", "normalized"))
    plain &= model.get("type") == "BPE" and [model["vocab"].get(m) for m in merges] == list(range(256, 256 + len(merges)))
    if plain:
        import tiktoken
        from public_tokenizers import PATTERN

        special = {t["content"]: t["id"] for t in added}
        shown = {c: c for c in (*range(33, 127), *range(161, 173), *range(174, 256))}  # a byte-level vocabulary writes these bytes as themselves
        hidden = (c for c in range(256) if c not in shown)
        byte_of = {chr(c): c for c in shown} | {chr(256 + i): c for i, c in enumerate(hidden)}
        ranks = {bytes(byte_of[c] for c in token): i for token, i in model["vocab"].items() if token not in special}
        fast = tiktoken.Encoding("ids", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special)
        return lambda text: fast.encode_to_numpy(text, allowed_special="all")
    slow = Tokenizer.from_file(path)
    slow.no_truncation()
    slow.no_padding()
    return lambda text: np.array(slow.encode(text, add_special_tokens=False).ids, np.uint32)


def cut(n: int, window: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of ``n`` ids: only the first may be shorter than the window."""
    first = (n - 1) % window + 1
    return [(0, first)] + [(at, window) for at in range(first, n, window)]


def _pieces(tokenizer: str, window: int, end_id: int, id_col: str) -> Callable[[Batches], Batches]:
    names = [id_col, "piece", "start", "length", "ids_crc32", "part", "nth"]

    def run(batches: Batches) -> Batches:
        encode, part, count = encoder(tokenizer), TaskContext.get().partitionId(), Counter()
        for batch in batches:
            owner, rows = [], []
            for at, text in enumerate(batch.column(1).to_pylist()):
                ids = np.append(encode(text), end_id).astype("<u4")
                for piece, (start, length) in enumerate(cut(len(ids), window)):
                    owner.append(at)
                    rows.append((piece, start, length, zlib.crc32(ids[start : start + length].tobytes()), part, count[length]))
                    count[length] += 1
            columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), *[pa.int64()] * 3, pa.int32(), pa.int64()), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(owner)), *columns], names)

    return run


def token_pieces(docs: DataFrame, tokenizer: str, window: int, end_id: int, id_col: str, text_col: str) -> DataFrame:
    """Pieces of all documents, written to the shared folder. ``nth`` counts the earlier pieces of the same length and ``part``."""
    schema = f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, piece int, start bigint, length bigint, ids_crc32 bigint, part int, nth bigint"
    with small_batches(docs.sparkSession):
        return materialise(docs.select(F.col(id_col), whole_text(text_col)).mapInArrow(_pieces(tokenizer, window, end_id, id_col), schema), "pieces")


# The genetic algorithm


def least_bins(sizes: dict[int, int], window: int) -> int:
    """No packing has fewer bins: pieces over half a window share none, small pieces must fill what these leave."""
    counts = np.zeros(window + 1, np.int64)
    for length, n in sizes.items():
        counts[length] = n
    number, tokens = np.cumsum(counts), np.cumsum(counts * np.arange(window + 1))
    best = -(-int(tokens[-1]) // window)
    for k in range(window // 2 + 1):
        alone = int(number[-1] - number[window - k])
        large, large_tokens = int(number[window - k] - number[window // 2]), int(tokens[window - k] - tokens[window // 2])
        small_tokens = int(tokens[window // 2] - (tokens[k - 1] if k else 0))
        best = max(best, alone + large + max(0, -(-(small_tokens - (large * window - large_tokens)) // window)))
    return best


def best_fit(bins: Bins, lengths: list[tuple[int, int]], window: int) -> Bins:
    """``bins`` with (length, number) of further pieces, one after the other, each into the fullest bin that has room."""
    by_room: dict[int, Bins] = {}
    rooms: list[int] = []

    def put(pattern: Pattern, n: int) -> None:
        room = window - sum(pattern)
        if room not in by_room:
            by_room[room] = {}
            insort(rooms, room)
        by_room[room][pattern] = by_room[room].get(pattern, 0) + n

    for pattern, n in bins.items():
        put(pattern, n)
    for length, left in lengths:
        while left:
            at = bisect_left(rooms, length)
            if at == len(rooms):
                pattern, n, most = (), left, window // length
            else:
                group = by_room[rooms[at]]
                pattern, n = group.popitem()
                most = rooms[at] // length
                if not group:
                    del by_room[rooms.pop(at)]
            taken = min(n, left // most) if left >= most else 1  # bins that get as many as have room, or one that gets the rest
            each = min(most, left)
            put(tuple(sorted(pattern + (length,) * each, reverse=True)), taken)
            if pattern and n > taken:
                put(pattern, n - taken)
            left -= taken * each
    return {p: n for group in by_room.values() for p, n in group.items()}


def filled(bins: Bins, window: int) -> tuple[int, float]:
    """Number of bins, and minus the mean square of their fill: the smaller, the better."""
    n = sum(bins.values())
    return n, -sum(m * (sum(p) / window) ** 2 for p, m in bins.items()) / max(n, 1)


def crossover(donor: Bins, other: Bins, share: float, window: int, rng: random.Random) -> Bins:
    """``other`` with whole well-filled bins of ``donor`` in place of what holds the same pieces."""
    ranked = sorted(donor.items(), key=lambda x: (window - sum(x[0])) * (0.5 + rng.random()))
    quota = max(1, int(sum(donor.values()) * share * rng.random()))
    injected: Bins = {}
    for pattern, n in ranked:
        if (more := n - other.get(pattern, 0)) > 0:  # bins that both have stay as they are
            injected[pattern] = min(more, quota)
            quota -= injected[pattern]
        if not quota:
            break
    owed: Counter[int] = Counter()
    for pattern, n in injected.items():
        for length in pattern:
            owed[length] += n
    rest, displaced = {}, Counter({k: -n for k, n in owed.items()})
    for pattern, n in sorted(other.items(), key=lambda x: sum(x[0])):
        holds = Counter(pattern)
        while n and (wanted := [-(-owed[k] // c) for k, c in holds.items() if owed[k] > 0]):
            gone = min(n, *wanted)
            n -= gone
            for k, c in holds.items():
                owed[k] -= gone * c
                displaced[k] += gone * c
        if n:
            rest[pattern] = n
    for pattern, n in injected.items():
        rest[pattern] = rest.get(pattern, 0) + n
    return best_fit(rest, sorted((x for x in displaced.items() if x[1]), reverse=True), window)


def first_bins(sizes: dict[int, int], window: int, rng: random.Random, noise: float) -> Bins:
    """Best fit of all pieces from long to short; with noise, roughly so."""
    return best_fit({}, sorted(sizes.items(), key=lambda x: -x[0] * (1 + noise * rng.random())), window)


COLUMNS = "island int, n_bins bigint, fill double, counts array<bigint>, widths array<int>, lengths array<int>"


def _row(island: int, bins: Bins, window: int) -> dict:
    n, fill = filled(bins, window)
    lengths = np.array([x for p in bins for x in p], np.int32)
    return {"island": island, "n_bins": n, "fill": fill, "counts": np.array(list(bins.values()), np.int64), "widths": np.array([len(p) for p in bins], np.int32), "lengths": lengths}


def _bins(counts: np.ndarray, widths: np.ndarray, lengths: np.ndarray) -> Bins:
    cuts = np.cumsum(widths)[:-1]
    return {tuple(p.tolist()): int(n) for p, n in zip(np.split(lengths, cuts), counts, strict=True)}


def _epoch(how: Evolution, least: int, window: int, epoch: int) -> Callable[[tuple, pd.DataFrame], pd.DataFrame]:
    def run(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        rng = random.Random(f"{how.seed} {epoch} {key[0]}")
        people = sorted(((filled(b, window), b) for b in (_bins(r.counts, r.widths, r.lengths) for r in group.itertuples())), key=lambda x: (x[0], sorted(x[1])))
        for _ in range(how.crossovers):
            if people[0][0][0] <= least or len(people) < 2:
                break
            one, two = rng.sample(range(len(people)), 2)
            child = crossover(people[min(one, two)][1], people[max(one, two)][1], how.injected, window, rng)
            if len(child) <= how.most_patterns * window and all(child != b for _, b in people):
                people = sorted([*people, (filled(child, window), child)], key=lambda x: x[0])[: how.population]
        return pd.DataFrame([_row(key[0], b, window) for _, b in people[: how.population]])

    return run


def evolve(spark: SparkSession, sizes: dict[int, int], window: int = WINDOW, how: Evolution | None = None) -> Bins:
    """Few bins that hold the pieces of these lengths, by the islands' best individual."""
    how = how or Evolution()
    least = least_bins(sizes, window)

    def founders(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for i in batch["id"].tolist():
                rng = random.Random(f"{how.seed} {i}")
                rows.append(_row(i % how.islands, first_bins(sizes, window, rng, 0.05 * (i // how.islands)), window))
            yield pd.DataFrame(rows)

    state = materialise(spark.range(how.islands * how.population, numPartitions=how.islands).mapInPandas(founders, COLUMNS), "islands")
    for epoch in range(how.epochs):
        if state.agg(F.min("n_bins")).first()[0] <= least:
            break
        place = Window.partitionBy("island").orderBy("n_bins", "fill")
        elite = state.withColumn("place", F.row_number().over(place)).where("place = 1").drop("place")
        guests = elite.withColumn("island", F.pmod(F.col("island") + 1, F.lit(how.islands)).cast("int"))
        before, state = state, materialise(state.unionByName(guests).groupBy("island").applyInPandas(_epoch(how, least, window, epoch), COLUMNS), "islands")
        discard(before)
    best = state.orderBy("n_bins", "fill", "island").select("counts", "widths", "lengths").first()
    discard(state)
    return _bins(*(np.array(x) for x in best))


# Places


def _places(bins: Bins) -> tuple[np.ndarray, ...]:
    """Runs of places sorted by (length, first): pieces ``first`` and on of a length go to sequences ``sequence`` and on, at ``offset``."""
    runs, used, sequence = [], Counter(), 0
    for pattern, n in sorted(bins.items(), reverse=True):
        offset = 0
        for length in pattern:
            runs.append((length, used[length], sequence, offset))
            used[length] += n
            offset += length
        sequence += n
    return tuple(np.array(c, np.int64) for c in zip(*sorted(runs), strict=True))


def _placed(places: tuple[np.ndarray, ...]) -> Callable[[Batches], Batches]:
    lengths, firsts, sequences, offsets = places
    keys = lengths << 48 | firsts

    def run(batches: Batches) -> Batches:
        for batch in batches:
            rank = batch.column("rank").to_numpy()
            at = np.searchsorted(keys, batch.column("length").to_numpy() << 48 | rank, side="right") - 1
            columns = batch.columns[:-1] + [pa.array(sequences[at] + rank - firsts[at]), pa.array(offsets[at])]
            yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names[:-1], "sequence_id", "offset"])

    return run


def pack(
    docs: DataFrame, tokenizer: str, window: int = WINDOW, end_id: int = 0, how: Evolution | None = None, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Every document's tokens, ``end_id`` appended, in as few sequences of ``window`` tokens as are found.

    Returns a row for each piece: ``(id_col, piece, start, length, ids_crc32, sequence_id, offset)``.
    Documents longer than the window are cut, into full windows but for the first piece. Sequences
    have gapless offsets and numbers from 0. ``tokenizer`` is a ``.json`` file of the tokenizers library, present on every worker.

    A null or empty text has ``end_id`` only. Null and repeated ids are documents of their own; an empty
    table gives an empty table; other columns are ignored.
    """
    spark = docs.sparkSession
    pieces = token_pieces(docs, tokenizer, window, end_id, id_col, text_col)
    counts = materialise(pieces.groupBy("length", "part").count(), "lengths")
    sizes = {int(r["length"]): int(r["n"]) for r in counts.groupBy("length").agg(F.sum("count").alias("n")).collect()}
    columns = [F.col(f"`{id_col}`"), "piece", "start", "length", "ids_crc32"]
    schema = f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint"
    if not sizes:
        return spark.createDataFrame([], schema)
    bins = evolve(spark, sizes, window, how)
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    firsts = counts.select("length", "part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("first"))
    ranked = pieces.join(firsts, ["length", "part"]).select(*columns, (F.col("first") + F.col("nth")).alias("rank"))
    return ranked.mapInArrow(_placed(_places(bins)), schema)
