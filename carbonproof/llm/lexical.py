"""Ranked lexical search with the Best Position Algorithm.

A query item's terms each have an impact list: the documents that hold the term by falling impact.
Lists are read from the top, side by side; each document met is completed by direct accesses to its
other lists, and these accesses too mark positions as seen. Up to its best position, the last of
those seen without a gap, a list holds no unseen document, so no unseen document scores more than the
impacts at the best positions sum to. Once that is strictly below the k-th score so far, all is found.

Documents are split over tasks, and each task searches blocks of a bounded number of postings with
the k-th score that it has already. No list, however frequent its term, is ever in one place.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from carbonproof.llm.common import materialise, small_batches

#: Bytes of items whose terms are broadcast at once; more items take several passes.
MAX_ITEM_BYTES = 8 << 20
#: Postings after which a block of documents is searched.
BLOCK_POSTINGS = 1 << 20
#: Positions read from each list in the first round, and in any.
FIRST_READ, MOST_READ = 16, 4096
#: Parts in which the best documents of an item are ranked before they meet.
PARTS = 64

#: A-Z become a-z, what is not part of a term becomes a blank.
_TERM_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))

Batches = Iterator[pa.RecordBatch]


def terms_of(text: str | None) -> list[bytes]:
    """Terms of a text: runs of ASCII letters, digits and characters beyond ASCII, in UTF-8."""
    return (text or "").encode().translate(_TERM_BYTES).split()


@dataclass
class Items:
    """A block of query items: the number of each distinct term, and each item's terms with their repeats."""

    ids: list[int | None]
    numbers: dict[bytes, int]
    terms: list[tuple[np.ndarray, np.ndarray]]


def item_blocks(items: DataFrame, id_col: str, text_col: str) -> Iterator[Items]:
    """The items in blocks of at most ``MAX_ITEM_BYTES`` bytes and one item."""
    block, size = Items([], {}, []), 0
    for item, text in items.select(F.col(id_col).cast("bigint"), text_col).toLocalIterator():
        words = Counter(terms_of(text))
        numbers = [block.numbers.setdefault(w, len(block.numbers)) for w in words]
        block.ids.append(item)
        block.terms.append((np.array(numbers, np.int64), np.array(list(words.values()), np.int64)))
        size += len((text or "").encode()) + 1
        if size >= MAX_ITEM_BYTES:
            yield block
            block, size = Items([], {}, []), 0
    if block.ids:
        yield block


def _postings(held: Broadcast) -> Callable[[Batches], Batches]:
    def run(batches: Batches) -> Batches:
        numbers = held.value.numbers
        for batch in batches:
            sizes, ends, terms, tfs = [], [0], [], []
            for text in batch.column(1).to_pylist():
                words = terms_of(text)
                sizes.append(len(words))
                found = [(numbers[w], n) for w, n in Counter(words).items() if w in numbers]
                terms += [t for t, _ in found]
                tfs += [n for _, n in found]
                ends.append(len(terms))
            lists = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(x, pa.int32())) for x in (terms, tfs)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), *lists], ["doc", "n", "terms", "tfs"])

    return run


def _tallies(n_terms: int) -> Callable[[Batches], Batches]:
    """Documents of each term; at -1 all documents with a term, at -2 all terms."""

    def run(batches: Batches) -> Batches:
        held, docs, terms = np.zeros(n_terms, np.int64), 0, 0
        for batch in batches:
            held += np.bincount(batch.column("terms").flatten().to_numpy(), minlength=n_terms)
            n = batch.column("n").to_numpy()
            docs, terms = docs + int(np.count_nonzero(n)), terms + int(n.sum())
        some = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array([-1, -2, *some.tolist()], pa.int64()), pa.array([docs, terms, *held[some].tolist()], pa.int64())], ["term", "n"])

    return run


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


class Best:
    """The k best documents of one item so far: falling score, then rising id, null ids last."""

    def __init__(self, k: int) -> None:
        self.k, self.scores, self.docs, self.void = k, np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)

    def kth(self) -> int:
        return int(self.scores[-1]) if len(self.scores) == self.k else 0

    def add(self, scores: np.ndarray, docs: np.ndarray, void: np.ndarray) -> None:
        good = scores >= max(self.kth(), 1)
        if good.any():
            s, d, v = (np.concatenate(x) for x in ((self.scores, scores[good]), (self.docs, docs[good]), (self.void, void[good])))
            first = np.lexsort((d, v, -s))[: self.k]
            self.scores, self.docs, self.void = s[first], d[first], v[first]


class Block:
    """Impact lists of some documents. Postings lie by document for direct access; ``place`` is their position in the lists."""

    def __init__(self, docs: np.ndarray, void: np.ndarray, ends: np.ndarray, terms: np.ndarray, impacts: np.ndarray, n_terms: int) -> None:
        self.docs, self.void, self.ends, self.terms, self.impacts = docs, void, ends, terms, impacts
        owner = np.repeat(np.arange(len(docs)), np.diff(ends))
        order = np.lexsort((-impacts, terms))
        self.listed_docs, self.listed = owner[order], impacts[order]
        self.place = np.empty(len(order), np.int64)
        self.place[order] = np.arange(len(order))
        self.starts = np.searchsorted(terms[order], np.arange(n_terms + 1))
        self.repeats = np.zeros(n_terms, np.int64)

    def _direct(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Scores of these documents, and the list positions of what was read for them."""
        first, size = self.ends[rows], self.ends[rows + 1] - self.ends[rows]
        heads = np.cumsum(size) - size
        at = np.arange(size.sum()) + np.repeat(first - heads, size)
        times = self.repeats[self.terms[at]]
        return np.add.reduceat(times * self.impacts[at], heads), self.place[at[times > 0]]

    def search(self, terms: np.ndarray, repeats: np.ndarray, best: Best) -> None:
        starts, stops = self.starts[terms], self.starts[terms + 1]
        there = stops > starts
        lists = list(zip(starts[there].tolist(), stops[there].tolist(), repeats[there].tolist(), strict=True))
        self.repeats[terms] = repeats
        unseen, met = np.ones(len(self.listed), bool), np.zeros(len(self.docs), bool)
        good = [a for a, _, _ in lists]  # the first position of each list that was not seen
        depth, step = 0, FIRST_READ
        while any(g < b for g, (_, b, _) in zip(good, lists, strict=True)):
            for a, b, _ in lists:
                unseen[a + depth : min(a + depth + step, b)] = False
            read = np.unique(np.concatenate([self.listed_docs[a + depth : min(a + depth + step, b)] for a, b, _ in lists]))
            new = read[~met[read]]
            if len(new):
                met[new] = True
                scores, places = self._direct(new)
                unseen[places] = False
                best.add(scores, self.docs[new], self.void[new])
            depth, step = depth + step, min(2 * step, MOST_READ)
            bound = 0
            for i, (_, b, times) in enumerate(lists):
                rest = unseen[good[i] : b]
                gap = int(rest.argmax()) if len(rest) else 0
                good[i] = good[i] + gap if len(rest) and rest[gap] else b
                bound += times * int(self.listed[good[i] - 1]) if good[i] < b else 0
            if bound < best.kth():
                break
        self.repeats[terms] = 0


def _search(held: Broadcast, weights: np.ndarray, n_docs: int, n_all: int, k: int) -> Callable[[Batches], Batches]:
    def block_of(parts: list[pa.RecordBatch]) -> Block:
        table = pa.Table.from_batches(parts).combine_chunks()
        lists = table.column("terms").combine_chunks()
        terms, tfs = lists.flatten().to_numpy(), table.column("tfs").combine_chunks().flatten().to_numpy().astype(np.int64)
        n = table.column("n").to_numpy()
        share = n.astype(object) if int(n.max(initial=0)) * n_docs >= 1 << 56 else n
        m = (100 - 75 + (75 * share * n_docs) // n_all).astype(np.int64)
        size = np.diff(lists.offsets.to_numpy())
        impacts = weights[terms] * ((1_000_000_000 * tfs) // (1000 * tfs + 8 * np.repeat(m, size)))
        some = impacts > 0
        ends = np.concatenate([[0], np.cumsum(some)])[np.concatenate([[0], np.cumsum(size)])]
        ids = table.column("doc").combine_chunks()
        void = ids.is_null().to_numpy(zero_copy_only=False)
        return Block(ids.fill_null(0).to_numpy(zero_copy_only=False), void, ends, terms[some], impacts[some], len(weights))

    def run(batches: Batches) -> Batches:
        items = held.value
        found = [Best(k) for _ in items.ids]
        parts, size = [], 0

        def flush() -> None:
            block = block_of(parts)
            for (terms, repeats), best in zip(items.terms, found, strict=True):
                block.search(terms, repeats, best)

        for batch in batches:
            parts.append(batch)
            size += len(batch.column("terms").flatten())
            if size >= BLOCK_POSTINGS:
                flush()
                parts, size = [], 0
        if size:
            flush()
        for at, (item, best) in enumerate(zip(items.ids, found, strict=True)):
            if r := len(best.scores):
                columns = [pa.array([at] * r, pa.int32()), pa.array([item] * r, pa.int64()), pa.array(best.docs, mask=best.void), pa.array(best.scores)]
                yield pa.RecordBatch.from_arrays(columns, ["item", "item_id", "doc_id", "score"])

    return run


def _ranked(found: DataFrame, k: int, *parts: str) -> DataFrame:
    order = Window.partitionBy("item", *parts).orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def ranked_search(docs: DataFrame, items: DataFrame, k: int = 10, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The ``k`` documents of highest score for every item: ``(item_id, rank, doc_id, score)``.

    ``items`` has ``item_id`` and ``text``; ids are whole numbers. Every row of either table is an item
    or a document of its own, also with a repeated or null id. Equal scores come in rising order of id, null ids last. A null or
    empty text has no terms; an item without a document of a score above 0 gives no row, nor do empty
    tables. Other columns are ignored.
    """
    spark = docs.sparkSession
    out = spark.createDataFrame([], "item_id bigint, rank int, doc_id bigint, score bigint")
    for block in item_blocks(items, "item_id", "text"):
        held, n_terms = spark.sparkContext.broadcast(block), len(block.numbers)
        with small_batches(spark):
            texts = docs.select(F.col(id_col).cast("bigint"), F.col(text_col))
            postings = materialise(texts.mapInArrow(_postings(held), "doc bigint, n bigint, terms array<int>, tfs array<int>"), "postings")
        tallies = dict(postings.select("n", "terms").mapInArrow(_tallies(n_terms), "term bigint, n bigint").groupBy("term").agg(F.sum("n")).collect())
        n_docs, n_all = tallies.get(-1, 0), tallies.get(-2, 0)
        if n_all:
            weights = np.array([weight(n_docs, tallies.get(t, 0)) for t in range(n_terms)], np.int64)
            hits = postings.mapInArrow(_search(held, weights, n_docs, n_all, k), "item int, item_id bigint, doc_id bigint, score bigint")
            first = _ranked(hits.withColumn("part", F.pmod(F.spark_partition_id(), F.lit(PARTS))), k, "part")
            best = materialise(_ranked(first, k).select("item_id", "rank", "doc_id", "score"), "ranked")
            out = out.unionByName(best)
    return out
