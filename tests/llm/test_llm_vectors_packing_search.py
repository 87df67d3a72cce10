"""Whitening, packing and ranked search against brute force and their libraries."""

from __future__ import annotations

import math
import random
import re
import struct
import zlib
from collections import Counter
from functools import lru_cache

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

import public_tokenizers
from carbonproof.llm import lexical, packing, queries
from carbonproof.llm.lexical import Best, Block, ranked_search, terms_of
from carbonproof.llm.packing import Evolution, best_fit, crossover, evolve, first_bins, least_bins, pack
from carbonproof.llm.whitening import jacobi, pivoted_cholesky, whiten

JSON = public_tokenizers.path("byte_bpe_50k.json")

# Whitening


def _whitening_by_hand(vectors):
    x = [[math.floor(64 * float(np.float64(c))) + 1_000_000 for c in v] for v in vectors]
    n, d = len(x), len(x[0])
    s = [sum(r[j] for r in x) for j in range(d)]
    z = np.array([[(n * r[j] - s[j]) / n for j in range(d)] for r in x])
    values, units = np.linalg.eigh(z.T @ z / n)
    return n, [sum((n * r[j] - s[j]) ** 2 for j in range(d)) for r in x], z, values[::-1], units[:, ::-1]


def test_op11_equals_numpy(spark, sf_dir):
    rows = queries.op11_whitening(spark, sf_dir).collect()
    given_ = spark.read.parquet(f"{sf_dir}/embeddings.parquet").orderBy("vec_id").collect()
    n, deviations, z, values, units = _whitening_by_hand([r["embedding"] for r in given_])
    place = {r["vec_id"]: i for i, r in enumerate(given_)}
    assert len(rows) == 32 * n
    white, signs = z @ units[:, :32] / np.sqrt(values[:32]), {}
    for r in rows:
        i, k = place[r["vec_id"]], r["component"] - 1
        assert (r["n"], r["deviation"]) == (n, deviations[i])
        assert r["explained"] == pytest.approx(values[k] / values.sum(), rel=1e-9)
        assert abs(abs(r["whitened"]) - abs(white[i, k])) < 1e-6
        if abs(white[i, k]) > 1e-3:
            signs.setdefault(k, set()).add(np.sign(r["whitened"] * white[i, k]))
    assert all(len(x) == 1 for x in signs.values())
    assert len({r["identity_error"] for r in rows}) == 1 and rows[0]["identity_error"] < 1e-9


def test_factor_and_rotations():
    rng = np.random.default_rng(3)
    a = rng.normal(size=(12, 7)) * 10.0 ** -np.arange(7)
    v = a @ a.T
    factor = pivoted_cholesky(v)
    assert np.allclose(factor @ factor.T, v, atol=1e-12)
    values, units = jacobi(factor)
    assert np.allclose(units.T @ units, np.eye(len(values)), atol=1e-12)
    assert np.allclose(values, np.linalg.eigvalsh(v)[::-1][: len(values)], rtol=1e-9, atol=1e-14)
    assert pivoted_cholesky(np.zeros((4, 4))).shape == (4, 0)


def test_whitening_edges(spark):
    schema = "vec_id bigint, embedding array<float>, n bigint, component string"
    rows = [(1, [1.0, 2.0], 5, "x"), (1, [1.0, 2.0], 5, "x"), (None, [3.0, -1.0], None, None), (4, [0.5, 9.0], 1, "")]
    bad = [(5, None, 1, ""), (6, [1.0, None], 1, ""), (7, [float("nan"), 1.0], 1, ""), (8, [float("inf"), 1.0], 1, ""), (9, [1.0], 1, ""), (10, [], 1, "")]
    got = whiten(spark.createDataFrame(rows + bad, schema)).collect()
    n, deviations, _, values, _ = _whitening_by_hand([r[1] for r in rows])
    assert Counter(r["vec_id"] for r in got) == {1: 4, None: 2, 4: 2}
    assert {(r["vec_id"], r["deviation"]) for r in got} == {(r[0], d) for r, d in zip(rows, deviations, strict=True)}
    assert whiten(spark.createDataFrame([], schema)).count() == 0
    assert whiten(spark.createDataFrame(bad, schema)).count() == 0
    assert whiten(spark.createDataFrame([rows[0]] * 3, schema)).count() == 0  # nothing varies
    assert len(whiten(spark.createDataFrame(rows, schema), components=1).collect()) == n


def test_whitening_of_very_large_entries(spark):
    rows = [(i, [float(i) * 2.0**50, float(i * i), 3.0]) for i in range(5)]
    got = whiten(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")).collect()
    assert {r["vec_id"] for r in got} == set(range(5)) and all(math.isfinite(r["whitened"]) for r in got)
    _, deviations, _, _, _ = _whitening_by_hand([r[1] for r in rows])
    assert {r["vec_id"]: r["deviation"] for r in got} == {i: d if d < 2**63 else None for i, d in enumerate(deviations)}


# Packing

ODD = [None, "", " ", "a<|endoftext|>b", "<|endoftext|>", "x" * 30_000, " " * 5000, "mañana 😀 ", "word " * 9000, "lines\n\n\nof it's text 123" * 400]


@lru_cache
def _tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(JSON)


def _ids(text):
    return _tokenizer().encode(text or "", add_special_tokens=False).ids + [0]


def _packed_well(rows, texts, window):
    """Rows are whole, right and without overlap; gives the number of sequences."""
    for at, text in texts.items():
        ids, own = _ids(text), sorted((r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows if r["doc_id"] == at)
        assert [p for p, *_ in own] == list(range(len(own)))
        stops = [0]
        for _, start, length, crc in own:
            assert start == stops[-1] and crc == zlib.crc32(struct.pack(f"<{length}I", *ids[start : start + length]))
            stops.append(start + length)
        assert stops[-1] == len(ids) and all(length == window for _, _, length, _ in own[1:])
    sequences = {}
    for r in rows:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in sequences.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= window
    assert set(sequences) == set(range(len(sequences)))
    return len(sequences)


def test_op12_packs_every_token_once(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = queries.op12_packing(spark, sf_dir).collect()
    n = _packed_well(rows, {r["doc_id"]: r["text"] for r in docs.collect()}, 2048)
    assert n <= least_bins(Counter(r["length"] for r in rows), 2048) + 1


def test_packing_of_odd_texts(spark):
    texts = dict(enumerate(ODD))
    docs = spark.createDataFrame([(i, t, i, "x") for i, t in texts.items()], "doc_id bigint, text string, part int, length string").repartition(3)
    rows = pack(docs, JSON).collect()
    _packed_well(rows, texts, 2048)
    again = pack(spark.createDataFrame([(7, "same"), (7, "same"), (None, "same")], "doc_id bigint, text string"), JSON, window=2).collect()
    assert Counter((r["doc_id"], r["piece"]) for r in again) == {(7, 0): 2, (None, 0): 1}
    assert pack(docs.limit(0), JSON).collect() == []


def _contents(bins):
    out = Counter()
    for pattern, n in bins.items():
        for length in pattern:
            out[length] += n
    return out


def _one_by_one(lengths, window):
    bins = []
    for x in lengths:
        room = [b for b in bins if sum(b) + x <= window]
        if room:
            max(room, key=sum).append(x)
        else:
            bins.append([x])
    return Counter(tuple(sorted(b, reverse=True)) for b in bins)


@settings(max_examples=150, deadline=None)
@given(st.dictionaries(st.integers(1, 20), st.integers(1, 30), min_size=1), st.integers(0, 99))
def test_bins_hold_what_they_should(sizes, seed):
    rng = random.Random(seed)
    one, two = first_bins(sizes, 20, rng, 0), first_bins(sizes, 20, rng, 1)
    lengths = [x for x, n in sorted(sizes.items(), reverse=True) for _ in range(n)]
    assert sorted(map(sum, _one_by_one(lengths, 20).elements())) == sorted(sum(p) for p, n in one.items() for _ in range(n))
    child = crossover(one, two, 0.5, 20, rng)
    for bins in (one, two, child):
        assert _contents(bins) == sizes and all(sum(p) <= 20 for p in bins)
        assert sum(bins.values()) >= least_bins(sizes, 20)


def test_best_fit_takes_the_fullest_bin():
    assert best_fit({(5,): 1, (7,): 2, (9,): 1}, [(3, 2), (1, 1)], 10) == {(7, 3): 2, (9, 1): 1, (5,): 1}


def test_islands_find_what_best_fit_misses(spark):
    rng = random.Random(5)
    sizes = Counter()
    for _ in range(60):  # bins of three pieces that fill them, which best fit from long to short does not find again
        a = rng.randint(30, 45)
        b = rng.randint(25, 35)
        sizes.update([a, b, 100 - a - b])
    plain = sum(first_bins(sizes, 100, rng, 0).values())
    found = evolve(spark, dict(sizes), 100, Evolution(epochs=4, crossovers=150))
    assert _contents(found) == sizes and least_bins(sizes, 100) <= sum(found.values()) < plain


# Ranked search


def _search_by_hand(docs, items, k=10):
    words = lambda t: [re.sub("[A-Z]", lambda m: m[0].lower(), x) for x in re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", t or "")]
    bags = [(i, Counter(words(t))) for i, t in docs]
    n_docs, total = sum(bool(b) for _, b in bags), sum(sum(b.values()) for _, b in bags)
    df = Counter(t for _, b in bags for t in b)
    out = []
    for item, text in items:
        scored = []
        for doc, bag in bags:
            m = 25 + 75 * sum(bag.values()) * n_docs // max(total, 1)
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * bag[t] // (1000 * bag[t] + 8 * m)) for t in words(text) if t in bag)
            if score > 0:
                scored.append((-score, doc is None, doc or 0, doc))
        out += [(item, i + 1, doc, -s) for i, (s, _, _, doc) in enumerate(sorted(scored, key=lambda x: x[:3])[:k])]
    return sorted(out, key=repr)


def test_op13_equals_brute_force(spark, sf_dir):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    assert sorted(map(tuple, queries.op13_lexical_search(spark, sf_dir).collect()), key=repr) == _search_by_hand(docs, items)


def test_search_edges(spark):
    docs = [(1, "The cat"), (1, "The cat"), (None, "the CAT sat"), (2, None), (3, ""), (4, "Ünï 😀 cat " * 300), (5, "dog_dog-dog"), (6, "É é"), *((100 + i, "tie tie") for i in range(15))]
    items = [(1, "cat CAT dog"), (1, "the"), (None, "é 😀"), (2, None), (3, "none of these words"), (4, "tie")]
    schema, clash = "doc_id bigint, text string, n string, doc int", "item_id bigint, text string, doc_id string, rank string"
    many = spark.createDataFrame([(*d, "x", 1) for d in docs], schema).repartition(4)
    asked = spark.createDataFrame([(*i, "x", "y") for i in items], clash)
    assert sorted(map(tuple, ranked_search(many, asked).collect()), key=repr) == _search_by_hand(docs, items)
    assert ranked_search(many.limit(0), asked).collect() == [] == ranked_search(many, asked.limit(0)).collect()
    assert ranked_search(spark.createDataFrame([(1, None)], "doc_id bigint, text string"), asked).collect() == []


def test_items_in_several_passes(spark, monkeypatch):
    monkeypatch.setattr(lexical, "MAX_ITEM_BYTES", 20)
    docs = [(i, f"w{i % 3} w{i % 5} common") for i in range(30)]
    items = [(i, f"w{i % 5} common w{i % 3}") for i in range(7)]
    got = ranked_search(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string"))
    assert sorted(map(tuple, got.collect()), key=repr) == _search_by_hand(docs, items)


@settings(max_examples=100, deadline=None)
@given(st.integers(0, 10**6))
def test_best_positions_find_the_best(seed):
    """Blocks of random lists, long enough for several rounds, with the k-th score carried from block to block."""
    rng = np.random.default_rng(seed)
    n_terms, best, brute = 8, Best(5), []
    terms, repeats = np.array([0, 2, 5]), np.array([1, 3, 1])
    for block in range(2):
        n = int(rng.integers(1, 400))
        table = rng.integers(1, 50, (n, n_terms)) * (rng.random((n, n_terms)) < rng.random(n_terms))
        rows, columns = np.nonzero(table)
        ends = np.concatenate([[0], np.cumsum((table > 0).sum(axis=1))])
        docs = rng.permutation(n) + 1000 * block
        Block(docs, np.zeros(n, bool), ends, columns, table[rows, columns], n_terms).search(terms, repeats, best)
        brute += [(-int(s), int(d)) for s, d in zip(table[:, terms] @ repeats, docs, strict=True) if s]
    assert list(zip(best.scores.tolist(), best.docs.tolist(), strict=True)) == [(-s, d) for s, d in sorted(brute)[:5]]


def test_search_stops_before_the_end():
    """With one document far ahead on all lists, the rest of long lists is not read."""
    n = 20_000
    impacts = np.concatenate([np.full(20, 1000), np.ones(2 * n - 20, np.int64)])
    block = Block(np.arange(n), np.zeros(n, bool), np.arange(0, 2 * n + 1, 2), np.tile([0, 1], n), impacts, 2)
    read, direct = [], block._direct
    block._direct = lambda rows: (read.append(len(rows)), direct(rows))[1]
    best = Best(10)
    block.search(np.array([0, 1]), np.array([1, 1]), best)
    assert best.docs.tolist() == list(range(10)) and sum(read) < 100


def test_terms_are_cut_and_lowered():
    assert terms_of("Ab-c_1 É\u00a0Z") == [b"ab", b"c", b"1", "É\u00a0z".encode()]
    assert packing.cut(1, 4) == [(0, 1)] and packing.cut(4, 4) == [(0, 4)] and packing.cut(9, 4) == [(0, 1), (1, 4), (5, 4)]
