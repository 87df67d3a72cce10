"""Quality rules: a decision list learned by sequential covering from labelled statistics.

Every whole text is reduced to a row of statistics. On a bounded labelled sample, rules that reject
are grown one at a time: conditions on a statistic are added by FOIL gain on two thirds of the rows
and cut back from the end on the other third; a rule is taken while it stays precise there, the rows
that it covers go, and the next is grown. The list becomes one ordered Spark conditional expression.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from carbonproof.llm.common import labelled_sample, materialise

#: Rows of labels that the rules are learned from, at most.
MAX_LABELLED = 20_000
#: Entries of the learned word list, at most.
MAX_LEXICON = 4_000
#: Leading characters of a word that count as a feature of their own.
STEM = 6

BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
RATES = ("mean_word", "symbol_rate", "dup_line_rate", "repeat_rate", "upper_rate", "same_next_rate", "bang_rate", "digit_rate", "flagged_rate", "n_flagged")
STATS_SCHEMA = "doc_id bigint, " + ", ".join(f"{c} bigint" for c in BASE) + ", " + ", ".join(f"{c} double" for c in RATES)

_PUNCTUATION = str.maketrans({c: " " for c in map(chr, range(128)) if not c.isalnum()})
_SYMBOLS = b"#*$%&|<>"
_SPACE = b" \t\n\x0b\x0c\r"
_CAPITALS = bytes(range(65, 91))
_DIGITS = bytes(range(48, 58))


def repeated_window_words(words: list[bytes], width: int = 8) -> int:
    """Words that lie in a ``width``-word window found twice or more in ``words``."""
    n = len(words) - width + 1
    if n < 2:
        return 0
    seen: dict[bytes, int] = {}
    ids = np.array([seen.setdefault(w, len(seen)) for w in words], dtype=np.int64)
    if len(seen) == len(words):
        return 0
    span = 1
    while span < width:  # ranks of windows twice as wide, from pairs of ranks; exact, since ranks are dense
        if (len(ids) - span) <= 0:
            return 0
        pair = ids[: len(ids) - span] * (int(ids.max()) + 1) + ids[span:]
        ids = np.unique(pair, return_inverse=True)[1].astype(np.int64)
        span *= 2
    counts = np.bincount(ids)
    if counts.max() < 2:
        return 0
    starts = np.flatnonzero(counts[ids] > 1)
    edge = np.zeros(len(words) + 1, dtype=np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + width, -1)
    return int((np.cumsum(edge[:-1]) > 0).sum())


def text_statistics(text: str | None, flagged: frozenset[str] = frozenset()) -> tuple:
    """The statistics of one whole text, in the order of BASE and RATES; null counts as empty."""
    raw = (text or "").encode()
    words = raw.split()
    n = len(words)
    chars = len(text or "") - (len(raw) - len(raw.translate(None, _SPACE)))
    symbols = len(raw) - len(raw.translate(None, _SYMBOLS))
    lines = [x for x in raw.split(b"\n") if x.strip(_SPACE)]
    dup_lines = len(lines) - len(set(lines))
    repeated = repeated_window_words(words)
    same = sum(map(bytes.__eq__, words, words[1:]))
    plain = (text or "").lower().translate(_PUNCTUATION).split()
    hits = sum(w in flagged or w[:STEM] + "~" in flagged for w in plain) if flagged else 0
    one, all_chars = max(n, 1), max(chars, 1)
    return (
        n, chars, symbols, dup_lines, repeated,
        chars / one, symbols / one, dup_lines / max(len(lines), 1), repeated / one,
        (len(raw) - len(raw.translate(None, _CAPITALS))) / all_chars, same / one, raw.count(b"!!") / one,
        (len(raw) - len(raw.translate(None, _DIGITS))) / all_chars, hits / one, float(hits),
    )


def statistics(docs: DataFrame, flagged: frozenset[str] = frozenset()) -> DataFrame:
    """``doc_id`` and the statistics of every whole text."""
    names = ["doc_id", *BASE, *RATES]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [text_statistics(x.as_py(), flagged) for x in batch.column(1)]
            columns = list(zip(*rows, strict=True)) if rows else [[] for _ in names[1:]]
            kinds = [pa.int64()] * len(BASE) + [pa.float64()] * len(RATES)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names)

    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(run, STATS_SCHEMA)


def learn_word_list(docs: DataFrame, sample: DataFrame, min_documents: int = 3, odds: float = 20.0) -> frozenset[str]:
    """Words, and word beginnings marked by ``~``, far more frequent in toxic than in other labelled texts.

    ``sample`` is bounded, so it is broadcast; counts are per document and only the words above both
    thresholds come to the driver, MAX_LEXICON of them at most.
    """
    words = F.array_distinct(F.split(F.lower("text"), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"))
    stems = F.transform(F.filter(words, lambda w: F.length(w) >= STEM), lambda w: F.concat(F.substring(w, 1, STEM), F.lit("~")))
    counted = (
        docs.join(F.broadcast(sample), "doc_id")
        .select("toxic", F.explode_outer(F.array_distinct(F.concat(F.filter(words, lambda w: F.length(w) > 2), stems))).alias("word"))
        .where("word is not null")
        .groupBy("word")
        .agg(F.count_if(F.col("toxic") == 1).alias("bad"), F.count_if(F.col("toxic") == 0).alias("good"))
    )
    total = sample.agg(F.count_if(F.col("toxic") == 1), F.count_if(F.col("toxic") == 0)).first()
    if not total[0] or not total[1]:
        return frozenset()
    lift = (F.col("bad") / total[0]) / ((F.col("good") + 0.5) / total[1])
    rows = counted.where((F.col("bad") >= min_documents) & (lift >= odds)).orderBy(F.desc("bad"), "word").limit(MAX_LEXICON).collect()
    return frozenset(r["word"] for r in rows)


@dataclass(frozen=True)
class Condition:
    """A threshold on one statistic."""

    statistic: str
    at_least: bool
    threshold: float

    def column(self) -> Column:
        value = F.col(self.statistic)
        return value >= self.threshold if self.at_least else value <= self.threshold

    def holds(self, table: dict[str, np.ndarray]) -> np.ndarray:
        value = table[self.statistic]
        return value >= self.threshold if self.at_least else value <= self.threshold


Rule = tuple[Condition, ...]


def covered(rule: Rule, table: dict[str, np.ndarray]) -> np.ndarray:
    out = np.ones(len(next(iter(table.values()))), dtype=bool)
    for condition in rule:
        out &= condition.holds(table)
    return out


def _best_condition(table: dict[str, np.ndarray], bad: np.ndarray, n_cuts: int) -> tuple[float, Condition | None]:
    p, n = bad.sum(), (~bad).sum()
    if not p or not n:
        return 0.0, None
    before, best, choice = np.log2(p / (p + n)), 1e-9, None
    for name, values in table.items():
        cuts = np.unique(np.concatenate([np.quantile(values, np.linspace(0, 1, n_cuts)), np.quantile(values[bad], np.linspace(0, 1, n_cuts))]))
        for at_least in (True, False):
            order = np.sort(values[bad]), np.sort(values[~bad])
            if at_least:
                ps, ns = (len(x) - np.searchsorted(x, cuts, "left") for x in order)
            else:
                ps, ns = (np.searchsorted(x, cuts, "right") for x in order)
            with np.errstate(divide="ignore", invalid="ignore"):
                gain = np.where(ps > 0, ps * (np.log2(ps / (ps + ns)) - before), 0.0)
            k = int(np.argmax(gain))
            if gain[k] > best:
                best, choice = float(gain[k]), Condition(name, at_least, float(cuts[k]))
    return best, choice


def learn_rules(
    table: dict[str, np.ndarray], bad: np.ndarray, max_rules: int = 16, max_conditions: int = 4, precision: float = 0.95, min_cover: int = 5, n_cuts: int = 65, seed: int = 11
) -> list[Rule]:
    """Ordered rules whose rows are to be rejected, by sequential covering with growing and pruning."""
    rules: list[Rule] = []
    rng = np.random.default_rng(seed)
    rest = np.arange(len(bad))
    while len(rules) < max_rules and bad[rest].sum() >= min_cover:
        grow = rng.random(len(rest)) < 2 / 3
        parts = [({k: v[rest[m]] for k, v in table.items()}, bad[rest[m]]) for m in (grow, ~grow)]
        (grown, grown_bad), (held, held_bad) = parts
        rule: Rule = ()
        inside = np.ones(len(grown_bad), dtype=bool)
        while len(rule) < max_conditions:
            gain, condition = _best_condition({k: v[inside] for k, v in grown.items()}, grown_bad[inside], n_cuts)
            if condition is None or gain <= 0:
                break
            rule = (*rule, condition)
            inside &= condition.holds(grown)
            if not (~grown_bad[inside]).any():
                break
        worth = []
        for k in range(1, len(rule) + 1):
            hit = covered(rule[:k], held)
            p, n = int(held_bad[hit].sum()), int((~held_bad[hit]).sum())
            worth.append(((p - n) / max(p + n, 1), -k, p, n))
        if not worth:
            break
        score, k, p, n = max(worth)
        if p < min_cover or p < precision * (p + n):
            break
        rule = rule[:-k]
        rules.append(rule)
        rest = rest[~covered(rule, {name: v[rest] for name, v in table.items()})]
    return rules


def rules_column(rules: list[Rule]) -> Column:
    """Number of the first rule that applies, from 1; 0 where none does."""
    if not rules:
        return F.lit(0)
    first, *others = range(len(rules))

    def all_of(rule: Rule) -> Column:
        out = rule[0].column()
        for condition in rule[1:]:
            out = out & condition.column()
        return out

    column = F.when(all_of(rules[first]), first + 1)
    for k in others:
        column = column.when(all_of(rules[k]), k + 1)
    return column.otherwise(0)


def quality_rules(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> DataFrame:
    """Statistics and verdict of every document: ``(doc_id, *BASE, *RATES, base_failed, rule, kept)``.

    ``labels`` has ``doc_id, quality, toxic``; a row is bad if its quality is 0 or it is toxic.
    ``max_labelled`` bounds the rows that the rules are learned from; the statistics and the verdict
    cover every whole text. ``base_failed`` holds for under 20 words or over 30 % of words in repeated
    8-word windows. Null texts count as empty; repeated rows and null ids give a row each; without
    labels of both classes there are no rules and only ``base_failed`` rejects. Other columns are ignored.
    """
    sample = materialise(labelled_sample(labels, max_labelled), "labelled")
    flagged = learn_word_list(docs.select("doc_id", "text"), sample)
    stats = materialise(statistics(docs, flagged), "statistics")
    rows = stats.dropDuplicates(["doc_id"]).join(F.broadcast(sample), "doc_id").orderBy("doc_id").toPandas()
    names = [*BASE, *RATES]
    rules = learn_rules({c: rows[c].to_numpy(float) for c in names}, ((rows["quality"] == 0) | (rows["toxic"] == 1)).to_numpy(bool)) if len(rows) else []
    base_failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    return (
        stats.withColumn("base_failed", base_failed)
        .withColumn("rule", rules_column(rules).cast("int"))
        .withColumn("kept", ~F.col("base_failed") & (F.col("rule") == 0))
    )
