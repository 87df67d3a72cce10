"""Every corpus operator and pipeline stage on nulls, empty texts, repeated rows, empty tables and odd columns."""

from __future__ import annotations

import public_tokenizers
import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from carbonproof.llm import byte_bpe, decontaminate, html_extract, license_scan, line_dedup, quality_classifier, quality_rules, sharding, simhash, token_counts
from carbonproof.llm.common import scratch_path

RANKS, JSON = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.path("byte_bpe_50k.json")
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, kept boolean, _dropped string, label string"
LONG = "wort " * 20_000
ROWS = [
    (1, None, "en", "a", None, True, "x", "l"),
    (2, "", "en", "a", 0, None, None, None),
    (3, "The quick brown fox.\nThe quick brown fox.\n\n", None, None, 43, None, None, None),
    (3, "The quick brown fox.\nThe quick brown fox.\n\n", None, None, 43, None, None, None),
    (None, "no id here", "en", "a", 10, None, None, None),
    (None, None, None, None, None, None, None, None),
    (4, LONG, "de", "b", len(LONG), None, None, None),
    (5, " \t\n ", "en", "a", 4, None, None, None),
    (6, "MIT License and été \U0001f600 x y <|endoftext|> it's", "fr", "b", 40, None, None, None),
]
LABELS = "doc_id bigint, quality int, toxic int"
BENCH = "item_id bigint, text string"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(3, 1, 0), (4, 0, 0), (4, 0, 1), (None, 1, 0), (6, None, 0), (99, 1, 0)], LABELS)


@pytest.fixture(scope="module")
def bench(spark):
    return spark.createDataFrame([(1, "the quick brown fox"), (1, "the quick brown fox"), (2, None), (3, ""), (None, "no id here")], BENCH)


def operators(labels, bench):
    return {
        "quality_classifier": lambda d: quality_classifier.quality_scores(d, labels),
        "line_dedup": lambda d: line_dedup.dedup_lines(d),
        "decontaminate": lambda d: decontaminate.contaminated(d, bench),
        "quality_rules": lambda d: quality_rules.quality_rules(d, labels),
        "byte_bpe": lambda d: byte_bpe.encode_texts(d, RANKS, decoded=True),
        "simhash": lambda d: simhash.simhash_groups(d),
        "token_counts": lambda d: token_counts.token_counts(d, JSON),
        "license_scan": lambda d: license_scan.license_scan(d),
    }


@pytest.mark.parametrize("name", ["quality_classifier", "line_dedup", "decontaminate", "quality_rules", "byte_bpe", "simhash", "token_counts", "license_scan"])
def test_odd_rows_and_empty_table(spark, docs, labels, bench, name):
    run = operators(labels, bench)[name]
    got = run(docs).collect()
    if name == "decontaminate":
        assert {(r["doc_id"], r["item_id"]) for r in got} == {(3, 1)}
    else:
        assert len(got) == len(ROWS)
    assert run(docs.limit(0)).count() == 0


def test_stages_keep_columns_and_take_an_empty_table(spark, docs, labels, bench, tmp_path):
    folder = f"file://{tmp_path}"
    docs.write.parquet(f"{folder}/documents.parquet")
    labels.write.parquet(f"{folder}/labels.parquet")
    bench.write.parquet(f"{folder}/benchmark.parquet")
    read = spark.read.parquet(f"{folder}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, read, folder).columns == docs.columns
        assert stage(spark, read.limit(0), folder).count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, read, folder).count() == len(ROWS)


def test_shards_of_odd_rows(spark, docs):
    size = F.coalesce(F.octet_length("text"), F.lit(0))
    store = sharding.ShardStore(spark, scratch_path(spark, "odd"), sharding.Policy(1000, 100, 2))
    with pytest.raises(ValueError):
        store.read()
    assert store.append(docs.limit(0), F.col("doc_id"), size) == 1
    store.append(docs, F.col("doc_id"), size)
    store.compact_all(size)
    assert sorted(map(str, store.read().select(docs.columns).collect())) == sorted(map(str, docs.collect()))


def test_shards_of_columns_with_clashing_names(spark):
    rows = spark.range(60).select("id", F.lit("x").alias("target"), F.col("id").alias("first"), F.lit("t").alias("text"), F.lit(1).alias("n_bytes"))
    store, size = sharding.ShardStore(spark, scratch_path(spark, "clash"), sharding.Policy(12, 2, 2)), F.octet_length("text")
    store.append(rows, F.floor(F.col("id") / 3), size)
    store.compact_all(size)
    assert sorted(map(tuple, store.read().select(rows.columns).collect())) == sorted(map(tuple, rows.collect()))
    assert store.manifest().agg(F.max("n_bytes")).first()[0] < 2 * 12
    for bad, arrival in ((rows.withColumn("_Shard", F.lit(1)), F.col("id")), (rows, F.col("id") - 5)):
        with pytest.raises(ValueError):
            store.append(bad, arrival, size)
    before = store.version()
    fs, p = store._fs(f"{store.root}/drafts/crashed")  # a writer that stopped before it renamed its pointer
    fs.create(p, False).close()
    assert store.version() == before and store.manifest().count() > 0


def test_shards_of_many_appends_are_one_scan(spark):
    store, size = sharding.ShardStore(spark, scratch_path(spark, "many"), sharding.Policy(1 << 20, 1 << 8, 4)), F.octet_length("text")
    scans = []
    for k in range(8):
        store.append(spark.range(20 * k, 20 * k + 20).select("id", F.lit("some text").alias("text")), F.floor(F.col("id") / 5), size)
        scans.append(store.read()._jdf.queryExecution().sparkPlan().toString().count("FileScan"))
    assert set(scans) == {2}  # the manifest and the shards
    store.compact_all(size)
    assert store.manifest().count() == 1 and sorted(r["id"] for r in store.read().collect()) == list(range(160))


@pytest.mark.parametrize("seed", range(3))
def test_plan_of_shards_equals_a_walk_along_them(spark, seed):
    """Runs and their cuts, also where a run goes over the borders of the ranges in which they are planned."""
    rng = random.Random(seed)
    policy = sharding.Policy(1000, 20, 4)
    sizes = [rng.choice([5, 30, 90, 90, 400, 1500]) if rng.random() < 0.3 else 30 for _ in range(300)]
    places = sorted(rng.sample(range(10_000), len(sizes)))
    tier = lambda n: sum(n >= b for b in (80, 320)) + (n >= 1000)
    want, run, total, last = {}, 0, 0, None
    for place, n in zip(places, sizes, strict=True):
        if tier(n) != last:
            run, total, last = run + 1, 0, tier(n)
        if n < 1000:
            want.setdefault((run, total // 1000), []).append(place)
            total += n
    rows = [(f"s{p}", "f", p, tier(n), 1, n) for p, n in zip(places, sizes, strict=True)]
    store = sharding.ShardStore(spark, scratch_path(spark, "walk"), policy)
    store.manifest = lambda version=None: spark.createDataFrame(rows, sharding.MANIFEST_SCHEMA)
    got = {}
    for r in store.plan().collect():
        got.setdefault(r["first"], set()).add(r["sequence"])
    assert got == {min(x): set(x) for x in want.values() if len(x) >= 2}


def test_pages_of_odd_rows(spark):
    rows = [(1, "http://h/a", None), (2, None, "<p>x</p>"), (None, "http://h/b", "<p>y</p>"), (3, "http://h/c", ""), (3, "http://h/c", ""), (4, "::", "<p>z" + " w" * 50_000)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    got = html_extract.extract_text(pages)
    assert got.count() == len(rows)
    assert {r["text"][:1] for r in got.collect()} == {"", "x", "y", "z"}
    assert html_extract.extract_text(pages.limit(0)).count() == 0


def test_null_ids_stay_in_the_filters(spark, docs, labels, bench):
    nameless = sum(r[0] is None for r in ROWS)
    for kept in (quality_classifier.keep_quality(docs, labels), simhash.keep_one(docs), decontaminate.decontaminate(docs, bench)):
        assert kept.where("doc_id is null").count() == nameless


def test_guard_takes_a_missing_subpackage(monkeypatch):
    import importlib.util

    import __spark_entry__ as entry

    monkeypatch.setattr(importlib.util, "find_spec", lambda name: None)
    assert "op1_sharding" not in entry.queries() and "row_diff" in entry.queries()
