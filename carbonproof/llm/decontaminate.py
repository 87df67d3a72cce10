"""Benchmark decontamination by pigeonhole edit matching.

A test item of m words may differ from a passage by k = floor(rate * m) word edits. Cut into k + 1
pieces, at least one piece must then stand in the passage unchanged, so every passage within the
budget is found from an exact piece hit; the words around the hit are verified with Myers'
bit-parallel distance. Pieces are matched by an automaton over the whole text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from carbonproof.llm.common import without_ids

#: Word edits allowed for each word of an item.
RATE = 0.2
#: Bytes of items that one automaton holds; more items are matched in several passes.
MAX_ITEM_BYTES = 16 << 20
MATCH_SCHEMA = "doc_id bigint, item_id bigint, n_item_words int, distance int, start_word int, stop_word int"

_NOT_WORDS = str.maketrans({c: " " for c in map(chr, range(128)) if not c.isalnum()})


def words_of(text: str | None) -> list[str]:
    """Lower-cased words; ASCII punctuation and white space separate them."""
    return (text or "").lower().translate(_NOT_WORDS).split()


def pieces_of(words: list[str], budget: int) -> list[tuple[int, list[str]]]:
    """``budget + 1`` consecutive pieces of nearly equal length, as (offset, words)."""
    n, parts = len(words), budget + 1
    cuts = [n * i // parts for i in range(parts + 1)]
    return [(a, words[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


def best_match(pattern: list[str], text: list[str]) -> tuple[int, int]:
    """Least edit distance between ``pattern`` and a stretch of ``text``, and that stretch's last position + 1."""
    m = len(pattern)
    full, top = (1 << m) - 1, 1 << (m - 1)
    masks: dict[str, int] = {}
    for i, w in enumerate(pattern):
        masks[w] = masks.get(w, 0) | 1 << i
    plus, minus, score, best, stop = full, 0, m, m, 0
    for j, w in enumerate(text):
        eq = masks.get(w, 0)
        d0 = (((eq & plus) + plus) ^ plus) | eq | minus
        hp, hn = minus | ~(d0 | plus) & full, plus & d0
        score += bool(hp & top) - bool(hn & top)
        hp, hn = hp << 1 & full, hn << 1 & full
        plus, minus = hn | ~(d0 | hp) & full, hp & d0
        if score < best:
            best, stop = score, j + 1
    return best, stop


class Matcher:
    """Items ready to be searched for in texts."""

    def __init__(self, items: list[tuple[int, str]], rate: float) -> None:
        self.items = {}
        automaton = ahocorasick.Automaton()
        hits: dict[str, list[tuple[int, int, int]]] = {}
        for item_id, text in items:
            words = words_of(text)
            if not words:
                continue
            budget = int(rate * len(words))
            self.items[item_id] = (words, budget)
            for offset, piece in pieces_of(words, budget):
                hits.setdefault(" " + " ".join(piece) + " ", []).append((item_id, offset, len(piece)))
        for key, value in hits.items():
            automaton.add_word(key, value)
        self.automaton = automaton if hits else None
        if hits:
            automaton.make_automaton()

    def matches(self, text: str | None) -> list[tuple[int, int, int, int, int]]:
        """(item, words of the item, least distance, first word, last word + 1) of each item within its budget."""
        words = words_of(text)
        if not words or self.automaton is None:
            return []
        flat = " " + " ".join(words) + " "
        windows: dict[int, set[tuple[int, int]]] = {}
        counted, at = 0, 0
        for end, found in self.automaton.iter(flat):
            counted += flat.count(" ", at, end)
            at = end
            for item_id, offset, size in found:
                pattern, budget = self.items[item_id]
                start = counted - size - offset
                windows.setdefault(item_id, set()).add((max(0, start - budget), min(len(words), start + len(pattern) + budget)))
        out = []
        for item_id, spans in windows.items():
            pattern, budget = self.items[item_id]
            best = min((*self._at(pattern, budget, words, a, b),) for a, b in sorted(spans))
            if best[0] <= budget:
                out.append((item_id, len(pattern), *best))
        return out

    @staticmethod
    def _at(pattern: list[str], budget: int, words: list[str], a: int, b: int) -> tuple[int, int, int]:
        distance, stop = best_match(pattern, words[a:b])
        if distance > budget:
            return distance, a, b
        back, length = best_match(pattern[::-1], words[a : a + stop][::-1])
        return distance, a + stop - length, a + stop


@lru_cache(maxsize=4)
def _matcher(items: tuple[tuple[int, str], ...], rate: float) -> Matcher:
    return Matcher(list(items), rate)


def contaminated(docs: DataFrame, benchmark: DataFrame, rate: float = RATE, max_item_bytes: int = MAX_ITEM_BYTES) -> DataFrame:
    """Pairs of documents and test items found in them, MATCH_SCHEMA; the best place of each item.

    An item matches where the word edit distance is at most floor(rate * its words). Case, ASCII
    punctuation and white space do not count. Items go to the workers in groups whose total size is
    checked against ``max_item_bytes``; each group is one pass over the texts. Items and documents
    with null ids, null or wordless texts match nothing; repeated documents give their rows again,
    repeated items count once; empty tables give an empty table; other columns are ignored.
    """
    items = benchmark.where("item_id is not null and text is not null").select(F.col("item_id").cast("bigint"), "text").dropDuplicates()
    total = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    groups = max(1, -(-int(total) // max_item_bytes))
    source = docs.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("bigint"), "text")
    out = None
    for group in range(groups):
        rows = items.where(F.pmod(F.xxhash64("item_id"), F.lit(groups)) == group).orderBy("item_id").collect()
        held = docs.sparkSession.sparkContext.broadcast(tuple((r["item_id"], r["text"]) for r in rows))

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            matcher = _matcher(held.value, rate)
            for batch in batches:
                rows = [(d, *m) for d, t in zip(batch.column(0).to_pylist(), batch.column(1), strict=True) for m in matcher.matches(t.as_py())]
                columns = list(zip(*rows, strict=True)) if rows else [()] * 6
                kinds = [pa.int64(), pa.int64(), *[pa.int32()] * 4]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], re.findall(r"(\w+) \w+", MATCH_SCHEMA)
                )

        part = source.mapInArrow(run, MATCH_SCHEMA)
        out = part if out is None else out.unionByName(part)
    return out


def decontaminate(docs: DataFrame, benchmark: DataFrame, rate: float = RATE) -> DataFrame:
    """The documents that hold no test item, with all their columns; those with a null id or text stay."""
    return without_ids(docs, contaminated(docs, benchmark, rate).select("doc_id").distinct())
