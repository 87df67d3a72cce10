"""Quality classifier by importance resampling.

Hashed counts of words, word beginnings and word pairs give a generative model of target text (labelled as good) and one of
the raw corpus. A document's importance is the mean log ratio of the two over its n-grams, where only
n-grams whose counts differ significantly have a ratio other than 1. As many
documents are drawn as look like the target, without replacement and in proportion to their
importance: each adds Gumbel noise to its scaled log importance and the k largest stay. The k-th
largest is found by counting, digit by digit, so nothing is sorted in one place.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from carbonproof.llm.common import labelled_sample, materialise, small_batches, whole_text, without_ids

#: Rows of labels that are used, at most.
MAX_LABELLED = 20_000
#: Pseudo-counts per n-gram that the target holds more than once, spread like the raw corpus, that are added to its counts.
PRIOR = 0.25
#: Standard deviations by which an n-gram's target count must leave its expectation to have a ratio.
SIGNIFICANT = 3.0
#: Leading characters of a word that are an n-gram of their own; shorter words have none.
STEM = 5
#: Lost good documents weigh so many times passed bad ones when the cut is set.
GOOD_WEIGHT = 6.0
#: N-grams of evidence that a document's mean log ratio stands for when noise of scale 1 is added.
EVIDENCE = 2000.0

#: Bytes of text that a worker takes apart at once, and n-grams that it sorts at once.
STRETCH, PART_GRAMS = 1 << 18, 1 << 19
#: Part of the least share of a frequent n-gram by which a task may overrate its counts.
SLACK = 1 / 2
#: Bits of the filter that frequent n-grams pass; others that pass cost time only.
FILTER_BITS = 1 << 24

_PAIR = np.uint64(0x9E3779B97F4A7C15)
_POWER = 0x5851F42D4C957F2D
#: What a byte is part of: 0 white space, 1 a word, 2 a run of other characters. Characters beyond ASCII are letters but for blocks of punctuation.
_KIND = np.array([0 if 9 <= b <= 13 or 28 <= b <= 32 else 1 if b >= 128 or chr(b).isalnum() else 2 for b in range(256)], np.uint8)


@lru_cache(maxsize=2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of an odd number and of its inverse, modulo 2^64."""
    both = (_POWER, pow(_POWER, -1, 1 << 64))
    return tuple(np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n - 1, base, np.uint64)])) for base in both)


def _mixed(values: np.ndarray, kind: int) -> np.ndarray:
    """64-bit numbers scattered over all bits, otherwise for each kind."""
    values = values ^ np.uint64(0xA0761D6478BD642F * (kind + 1) & (1 << 64) - 1)
    for _ in range(2):
        values = (values ^ (values >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    return values ^ (values >> np.uint64(33))


def _stretches(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of about STRETCH bytes that together are the data, cut at white space or between rows only."""
    start, end = int(offsets[0]), int(offsets[-1])
    while start < end:
        stop = min(start + STRETCH, end)
        if stop < end:
            blanks = np.flatnonzero(_KIND[data[start:stop]] == 0)
            cut = max(int(offsets[np.searchsorted(offsets, stop, "right") - 1]), start + int(blanks[-1]) + 1 if len(blanks) else start)
            if cut <= start:  # a word that is longer stays whole
                row_end = int(offsets[np.searchsorted(offsets, stop, "left")])
                blanks = np.flatnonzero(_KIND[data[stop:row_end]] == 0)
                cut = stop + int(blanks[0]) if len(blanks) else row_end
            stop = cut
        yield start, stop
        start = stop


def _grams(texts: pa.BinaryArray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """64-bit hashes of all words, beginnings and neighbouring pairs of a batch of texts, and the row of each, in stretches.

    A word that follows itself is one n-gram, whatever the word. Words, beginnings and pairs are hashed
    apart. No n-gram has the hash 0, which stands for all of them. Hashes of words are differences of
    running sums of bytes times powers, so no step works word by word.
    """
    offsets = np.frombuffer(texts.buffers()[1], np.int32, len(texts) + 1, 4 * texts.offset).astype(np.int64)
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    last_word, last_row = np.zeros(1, np.uint64), np.full(1, -1)
    for start, stop in _stretches(data, offsets):
        piece, n = data[start:stop], stop - start
        kind = _KIND[piece]
        two = np.flatnonzero(piece[:-1] == 0xC2)
        three = np.flatnonzero(((piece[:-2] == 0xE2) & (piece[1:-1] >> 1 == 0x40)) | ((piece[:-2] == 0xE3) & (piece[1:-1] == 0x80)))
        for at in (two, two + 1, three, three + 1, three + 2):
            kind[at] = 2
        edge = np.zeros(n + 1, bool)
        edge[offsets[np.searchsorted(offsets, start) : np.searchsorted(offsets, stop, "right")] - start] = True
        edge[[0, n]] = True
        edge[1:n] |= kind[1:] != kind[:-1]
        bounds = np.flatnonzero(edge)
        solid = kind[bounds[:-1]] != 0
        first, after = bounds[:-1][solid], bounds[1:][solid]
        if not len(first):
            continue
        rows = np.searchsorted(offsets, start + first, "right") - 1
        powers, inverses = _powers(1 << max(n - 1, STRETCH - 1).bit_length())
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((piece.astype(np.uint64) + np.uint64(1)) * powers[:n])])
        words = _mixed((sums[after] - sums[first]) * inverses[first], 0)
        leads = (piece & 0xC0) != 0x80
        number, places = np.cumsum(leads), np.append(np.flatnonzero(leads), n)
        stemmed = number[after - 1] - number[first] + 1 >= STEM
        begin = first[stemmed]
        stems = _mixed((sums[places[number[begin] - 1 + STEM]] - sums[begin]) * inverses[begin], 1)
        before = np.concatenate([last_word, words[:-1]])
        pair = np.concatenate([last_row, rows[:-1]]) == rows
        pairs = np.where(before == words, _PAIR, (before * _PAIR) ^ (words >> np.uint64(7)) ^ words)[pair]
        last_word, last_row = words[-1:], rows[-1:]
        grams = np.concatenate([words, stems, pairs])
        yield np.where(grams == 0, np.uint64(1), grams), np.concatenate([rows, rows[stemmed], rows[pair]])


def _collected(batches: Iterator[pa.RecordBatch], passing: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, int]]:
    """The n-grams of the batches' last columns, those that pass the filter, PART_GRAMS or so at a time, and how many there were."""
    held, size, seen = [], 0, 0
    for batch in batches:
        for grams, _ in _grams(batch.column(batch.num_columns - 1)):
            seen += len(grams)
            if passing is not None:
                bit = grams & np.uint64(FILTER_BITS - 1)
                grams = grams[(passing[bit >> np.uint64(3)] >> (bit & np.uint64(7)).astype(np.uint8)) & 1 == 1]
            held.append(grams)
            size += len(grams)
            if size >= PART_GRAMS:
                yield np.concatenate(held), seen
                held, size, seen = [], 0, 0
    if seen:
        yield np.concatenate(held), seen


def _added(grams: np.ndarray, numbers: list[np.ndarray]) -> tuple[np.ndarray, list[np.ndarray]]:
    """Distinct n-grams, sorted, and the sums of each of the numbers."""
    order = np.argsort(grams, kind="stable")
    grams = grams[order]
    starts = np.flatnonzero(np.concatenate([[True], grams[1:] != grams[:-1]])) if len(grams) else np.zeros(0, np.int64)
    return grams[starts], [np.add.reduceat(n[order], starts) if len(starts) else n for n in numbers]


def _counts(texts: DataFrame, passing: np.ndarray | None = None) -> DataFrame:
    """``gram, n``: occurrences of each n-gram that passes the filter; those of all n-grams under 0."""
    held = texts.sparkSession.sparkContext.broadcast(passing)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows(grams: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(grams.view(np.int64)), pa.array(n)], ["gram", "n"])

        grams, n, total = np.zeros(0, np.uint64), np.zeros(0, np.int64), 0
        for part, seen in _collected(batches, held.value):
            total += seen
            fresh, count = np.unique(part, return_counts=True)
            grams, (n,) = _added(np.concatenate([grams, fresh]), [np.concatenate([n, count])])
            if len(grams) > 2 * PART_GRAMS:
                yield rows(grams, n)
                grams, n = grams[:0], n[:0]
        yield rows(grams, n)
        yield rows(np.zeros(1, np.uint64), np.array([total]))

    return texts.mapInArrow(run, "gram bigint, n bigint").groupBy("gram").agg(F.sum("n").alias("n"))


def _frequent_filter(texts: DataFrame, share: float) -> np.ndarray:
    """A bit filter that every n-gram passes which makes up more than ``share`` of all.

    Such an n-gram makes up as much of some task's text. A task keeps bounds of its counts from above:
    what falls behind a part of the share is forgotten, and what comes again starts at what it may have
    had. So no frequent one is missed, and a task holds a number of n-grams that ``share`` bounds.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams, most, total = np.zeros(0, np.uint64), np.zeros(0, np.int64), 0
        for part, seen in _collected(batches):
            forgotten = int(SLACK * share * total)
            total += seen
            fresh, n = np.unique(part, return_counts=True)
            old = np.repeat(np.array([1, 0], np.int8), [len(grams), len(fresh)])
            grams, (most, old) = _added(np.concatenate([grams, fresh]), [np.concatenate([most, n]), old])
            most = most + (old == 0) * forgotten
            stays = most > int(SLACK * share * total)
            grams, most = grams[stays], most[stays]
        yield pa.RecordBatch.from_arrays([pa.array(grams[most >= share * total].view(np.int64))], ["gram"])

    bit = f"(gram & {FILTER_BITS - 1})"
    found = texts.mapInArrow(run, "gram bigint").groupBy(F.expr(f"{bit} div 64").alias("word"))
    found = found.agg(F.expr(f"bit_or(shiftleft(1L, cast({bit} % 64 as int)))").alias("bits")).toPandas()
    words = np.zeros(FILTER_BITS // 64, np.int64)
    words[found["word"].to_numpy(np.int64)] = found["bits"].to_numpy(np.int64)
    return words.view(np.uint8)


def _model_counts(texts: DataFrame, target_texts: DataFrame, prior: float = PRIOR) -> tuple[np.ndarray, np.ndarray]:
    """Hashes, sorted, of the n-grams with a log ratio below 0, and the ratios.

    All occurrences count, each n-gram by itself. A ratio below 0 needs an expected target count over
    SIGNIFICANT squared, and expected counts add up to the size of the target, so the labelled sample
    bounds what is returned. Rarer n-grams of the corpus are left out of the shuffle for that reason.
    """
    none = np.zeros(0, np.uint64), np.zeros(0)
    target = materialise(_counts(target_texts), "target-counts")
    whole = target.where("gram = 0").first()
    if whole is None or not whole["n"]:
        return none
    all_target = whole["n"]
    counts = materialise(_counts(texts, _frequent_filter(texts, SIGNIFICANT**2 / all_target)), "gram-counts")
    all_raw = counts.where("gram = 0").first()["n"]
    if not all_raw:
        return none
    expected = F.col("raw") * (all_target / all_raw)
    counts = counts.where("gram <> 0").withColumnRenamed("n", "raw").where(expected > SIGNIFICANT**2)
    counts = counts.join(target.withColumnRenamed("n", "target"), "gram", "left").fillna(0, ["target"])
    low = counts.where(expected - F.col("target") > SIGNIFICANT * F.sqrt(expected)).toPandas()
    known = target.where("gram <> 0 and n > 1").count()
    ratio = log_ratio(low["raw"].to_numpy(float), low["target"].to_numpy(float), all_raw, all_target, prior * known)
    grams = low["gram"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(grams)
    return grams[order], ratio[order]


def log_ratio(raw: np.ndarray, target: np.ndarray, all_raw: float, all_target: float, weight: float) -> np.ndarray:
    """Log of target over raw probability of n-grams, capped at 0; ``weight`` pseudo-counts are spread like the raw corpus.

    The raw corpus holds the target, so the ratio is bounded above by the inverse of the target's share
    and gains no evidence there; the cap keeps long documents from making up for what they hold.
    """
    p_raw = raw / all_raw
    return np.minimum(np.log((target + weight * p_raw) / (all_target + weight) / p_raw), 0.0)


def _scores(texts: DataFrame, known: np.ndarray, ratio: np.ndarray) -> DataFrame:
    """``doc_id, n_grams, log_importance`` (the mean over the n-grams; 0 without any) of rows ``doc_id, text``."""
    marked = np.zeros(1 << 20, bool)  # most n-grams have no ratio and are passed over without a search
    marked[known & np.uint64(len(marked) - 1)] = True
    held = texts.sparkSession.sparkContext.broadcast((known, ratio, marked))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, ratio, marked = held.value
        for batch in batches:
            n, total = np.zeros(len(batch), np.int64), np.zeros(len(batch))
            for grams, rows in _grams(batch.column(1)):
                n += np.bincount(rows, minlength=len(batch))
                likely = marked[grams & np.uint64(len(marked) - 1)]
                grams, rows = grams[likely], rows[likely]
                at = np.minimum(np.searchsorted(known, grams), max(len(known) - 1, 0))
                found = known[at] == grams if len(known) else np.zeros(0, bool)
                total += np.bincount(rows[found], weights=ratio[at[found]], minlength=len(batch))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n), pa.array(total / np.maximum(n, 1))], ["doc_id", "n_grams", "log_importance"])

    return texts.select("doc_id", "text").mapInArrow(run, "doc_id bigint, n_grams bigint, log_importance double")


def best_cut(scores: np.ndarray, good: np.ndarray) -> float:
    """The score above which the share of lost good rows, times GOOD_WEIGHT, and of passed bad ones is least."""
    if not good.any() or good.all():
        return -np.inf
    order = np.argsort(scores)
    scores, good = scores[order], good[order]
    lost = np.concatenate([[0], np.cumsum(good)]) / good.sum()
    passed = 1 - np.concatenate([[0], np.cumsum(~good)]) / (~good).sum()
    middle = np.concatenate([[scores[0] - 1], (scores[1:] + scores[:-1]) / 2, [scores[-1] + 1]])
    return float(middle[np.argmin(GOOD_WEIGHT * lost + passed)])


def gumbel(key: Column, seed: int) -> Column:
    """Standard Gumbel noise that depends on ``key`` and ``seed`` only."""
    uniform = (F.shiftrightunsigned(F.xxhash64(key, F.lit(seed)), 11) + 0.5) / float(1 << 53)
    return -F.log(-F.log(uniform))


def _ordered_bits(value: Column) -> Column:
    """A double as a long of the same order: fixed point with 30 binary places, cut at 2^32 either way."""
    return F.floor(F.greatest(F.least(value, F.lit(float(1 << 32))), F.lit(-float(1 << 32))) * float(1 << 30)).cast("bigint")


def top_k(rows: DataFrame, key: str, k: int, tie: str) -> Column:
    """A condition for the k rows with the largest ``key`` (a long); rows with equal keys follow ``tie``.

    The k-th key is narrowed down by histograms of 2^12 bins, each one aggregation, so at most 2^12
    rows reach the driver at a time. Needs ``rows`` to be cheap to read again.
    """
    low, high = rows.agg(F.min(key), F.max(key)).first()
    if low is None or k <= 0:
        return F.lit(False)
    left = k
    while low < high:
        width = -(-(high - low + 1) // 4096)
        inside = rows.where(F.col(key).between(low, high)).groupBy(F.floor((F.col(key) - F.lit(low)) / F.lit(width)).cast("bigint").alias("bin"))
        counts = sorted(((r["bin"], r["n"]) for r in inside.agg(F.count("*").alias("n")).collect()), reverse=True)
        if sum(n for _, n in counts) <= left:
            return F.col(key) >= low
        for b, n in counts:
            if n >= left:
                low, high = low + b * width, min(high, low + (b + 1) * width - 1)
                break
            left -= n
    at = rows.where(F.col(key) == low).orderBy(tie).limit(left).agg(F.max(tie)).first()[0]
    return (F.col(key) > low) | ((F.col(key) == low) & (F.col(tie) <= F.lit(at)))


def quality_scores(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED, seed: int = 3) -> DataFrame:
    """Importance and verdict of every document: ``(doc_id, n_grams, log_importance, sample_key, kept)``.

    ``labels`` has ``doc_id, quality, toxic``; quality 1 and not toxic is the target. The sample of
    labels is bounded by ``max_labelled``; a quarter of it is held out of the target model and fixes
    how large an importance looks like the target. Both models count whole texts, the raw one all of
    them. Null texts count as empty (importance 0); without labels of both kinds every document stays;
    repeated rows share key and verdict; rows with a null id are kept; an empty table gives an empty
    table; other columns are ignored.
    """
    sample = materialise(labelled_sample(labels, max_labelled), "labelled")
    held_out = F.pmod(F.xxhash64("doc_id", F.lit(seed + 1)), F.lit(4)) == 0
    target = sample.where((F.col("quality") == 1) & (F.col("toxic") == 0) & ~held_out).select(F.col("doc_id").alias("_target"))
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.lower(whole_text()).cast("binary").alias("text"))
    target_texts = texts.join(F.broadcast(target), F.col("doc_id") == F.col("_target"), "left_semi")
    with small_batches(docs.sparkSession):
        scored = _scores(texts, *_model_counts(texts, target_texts))
        scored = scored.withColumn("sample_key", _ordered_bits(F.col("log_importance") * EVIDENCE + gumbel(F.col("doc_id"), seed)))
        scored = materialise(scored, "importance")
    judged = scored.join(F.broadcast(sample.where(held_out)), "doc_id").select("log_importance", "quality", "toxic").toPandas()
    cut = best_cut(judged["log_importance"].to_numpy(), ((judged["quality"] == 1) & (judged["toxic"] == 0)).to_numpy()) if len(judged) else -np.inf
    if np.isinf(cut):
        return scored.withColumn("kept", F.lit(True))
    k = scored.where(F.col("log_importance") > cut).count()
    return scored.withColumn("kept", F.col("doc_id").isNull() | top_k(scored, "sample_key", k, "doc_id"))


def keep_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that the sample keeps, with all their columns; those with a null id stay."""
    return without_ids(docs, quality_scores(docs, labels).where(~F.col("kept")).select("doc_id").distinct())
