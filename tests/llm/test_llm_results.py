"""Corpus operators against brute force, their libraries and planted cases."""

from __future__ import annotations

import hashlib
import random
import re

import duckdb
import numpy as np
import public_tokenizers
import pytest
import tiktoken
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from carbonproof.llm import byte_bpe, decontaminate, html_extract, license_scan, line_dedup, quality_classifier, quality_rules, queries, sharding, simhash
from carbonproof.llm.common import connected_components, scratch_path
from carbonproof.llm.token_counts import token_counts


@pytest.fixture(scope="module")
def texts(spark, sf_dir):
    return {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()}


def roots(n, links):
    parent = list(range(n))

    def root(x):
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return [root(x) for x in range(n)]


@pytest.mark.parametrize("links", [[(k, k + 1) for k in range(60)], [(0, k) for k in range(1, 60)], [(a, a) for a in range(9)], []])
def test_components(spark, links):
    df = spark.createDataFrame(links, "src bigint, dst bigint")
    want = roots(61, links)
    got = {r["node"]: r["component"] for r in connected_components(df).collect()}
    assert all(got.get(n, n) == want[n] for n in range(61))


def test_op1_equals_sql_and_keeps_versions(spark, sf_dir):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet'")
    done = con.execute(queries.ORACLE_SQL["op1_sharding"])
    names = [d[0] for d in done.description]
    got = queries.op1_sharding(spark, sf_dir).select(*names).collect()
    assert sorted(map(tuple, got)) == sorted(done.fetchall())
    docs, size = spark.read.parquet(f"{sf_dir}/documents.parquet"), F.octet_length("text")
    store = sharding.ShardStore(spark, scratch_path(spark, "store"), sharding.Policy(1 << 18, 1 << 12, 4))
    store.append(docs.where("doc_id < 100"), F.floor(F.col("doc_id") / 5), size)
    store.append(docs.where("doc_id >= 100"), F.floor(F.col("doc_id") / 5), size)
    last = store.compact_all(size)
    assert store.manifest(2).count() > store.manifest(last).count()
    for version in (2, last):
        assert store.read(version).count() == docs.count()
    with pytest.raises(Exception, match="(?i)exist"):
        store._commit(store.manifest(), last - 1)


def test_op2_separates_labelled_documents(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    hidden = F.pmod(F.xxhash64("doc_id"), F.lit(3)) == 0
    got = quality_classifier.quality_scores(docs, labels.where(~hidden)).join(labels.where(hidden), "doc_id").toPandas()
    good = (got["quality"] == 1) & (got["toxic"] == 0)
    assert got[good]["kept"].mean() > 0.9
    assert got[got["quality"] == 0]["kept"].mean() < 0.5


def test_top_k_takes_exactly_k(spark):
    df = spark.createDataFrame([(k, (k * 37) % 11) for k in range(200)], "id bigint, key bigint")
    for k in (0, 1, 37, 199, 200):
        want = {i for i, _ in sorted(((i, (i * 37) % 11) for i in range(200)), key=lambda x: (-x[1], x[0]))[:k]}
        assert {r["id"] for r in df.where(quality_classifier.top_k(df, "key", k, "id")).collect()} == want


def _near_groups_of_all_pairs(spark, norms):
    """Smallest line of each group by edit distance of all pairs, whole lines, without any keys."""
    rows = spark.createDataFrame(list(enumerate(norms)), "i int, x string")
    other = rows.toDF("j", "y")
    most = F.floor(F.greatest(F.length("x"), F.length("y")) * 0.2 + 1e-9).cast("int")
    close = rows.join(other, F.col("i") < F.col("j")).withColumn("k", most).where(F.abs(F.length("x") - F.length("y")) <= F.col("k"))
    links = close.where(F.expr("levenshtein(x, y, k) >= 0")).select("i", "j").collect()
    return roots(len(norms), links), {(r["i"], r["j"]) for r in links}


def test_op3_equals_edit_distance_of_all_pairs(spark):
    """What ``dedup_lines`` drops, by length of line: nothing that is not near, and of what is near, nine in ten at least in each class and all tiny ones."""
    rng = random.Random(5)
    words = ["".join(rng.choices("abcdefghijklmnop", k=rng.randrange(2, 9))) for _ in range(900)]
    lines, classes = [], {}
    for size, low, high in ((2, 5, 11), (5, 20, 39), (12, 40, 120), (40, 150, 400), (150, 600, 1200)):
        for _ in range(30):
            base = " ".join(rng.choices(words, k=size))[:high]
            base = base + "x" * (low - len(base))
            parts = base.split(" ")
            at = rng.randrange(len(parts))
            letter = rng.randrange(len(base))
            near = base[:letter] + "z" + base[letter + 1 :] if size < 12 else " ".join([*parts[:at], rng.choice(words), *parts[at + 1 :]])
            half = len(parts) // 2
            lines += [base, near, " ".join(parts[half:] + parts[:half])]
            classes |= {x: size for x in lines[-3:]}
    lines = [re.sub(" +", " ", x).strip() for x in dict.fromkeys(lines)]
    rng.shuffle(lines)
    lines = list(dict.fromkeys(lines))
    first, links = _near_groups_of_all_pairs(spark, lines)
    docs = spark.createDataFrame(list(enumerate(lines)), "doc_id bigint, text string").repartition(5)
    dropped = {r["doc_id"] for r in line_dedup.dedup_lines(docs, keep_count=True).where("n_dropped > 0").collect()}
    want = {i for i, f in enumerate(first) if f != i}
    assert dropped <= want
    for size in set(classes.values()):
        own = {i for i in want if classes.get(lines[i]) == size}
        assert len(own) >= 20 and len(own & dropped) >= (1 if size == 2 else 0.9) * len(own), (size, len(own), len(own & dropped))


def test_op3_tiny_lines_share_a_key(spark):
    """Every near pair of which one line has fewer than TINY characters has a common key, with edits of any kind."""
    rng = random.Random(6)
    lines = {"".join(rng.choices("abc", k=rng.randrange(1, 15))).strip() or "a" for _ in range(900)}
    lines = sorted(re.sub(" +", " ", x) for x in lines)
    _, links = _near_groups_of_all_pairs(spark, lines)
    tiny = {(i, j) for i, j in links if min(len(lines[i]), len(lines[j])) < line_dedup.TINY}
    keys = {}
    for r in line_dedup.tiny_keys(spark.createDataFrame(list(enumerate(lines)), "line_id bigint, norm string"), 0.8).collect():
        keys.setdefault(r["id"], set()).add(r["key"])
    assert len(tiny) > 200 and all(keys[i] & keys[j] for i, j in tiny)


def test_op3_long_lines_are_compared_in_order(spark):
    rng = random.Random(7)
    words = [f"word{k}" for k in range(5000)]
    base = rng.choices(words, k=1500)
    copies = [base, base[750:] + base[:750], base[:700] + ["other"] * 9 + base[709:], rng.choices(words, k=1500), base[:1000]]
    copies += [base[:100], base[50:100] + base[:50]]
    docs = spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(copies)], "doc_id bigint, text string")
    assert {r["doc_id"] for r in line_dedup.dedup_lines(docs, keep_count=True).where("n_dropped > 0").collect()} == {2}


def test_op4_distance_and_planted_passages(spark, sf_dir, texts):
    rng = random.Random(2)
    for _ in range(300):
        a, b = ([rng.choice("abcd") for _ in range(rng.randrange(1, 9))] for _ in range(2))
        row = [0] * (len(b) + 1)
        for i, x in enumerate(a, 1):
            new = [i]
            for j, y in enumerate(b, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
            row = new
        assert decontaminate.best_match(a, b)[0] == min(row)
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()
    rows, want = [], set()
    for k, item in enumerate(items):
        w = item["text"].upper().split()
        for at in range(0, len(w), 9):  # fewer edits than the budget
            w[at] = "changed"
        want |= {(k, item["item_id"])} if -(-len(w) // 9) <= int(0.2 * len(decontaminate.words_of(item["text"]))) else set()
        rows.append((k, "some words before; " + " ".join(w) + ", and after"))
    bench = spark.createDataFrame([(r["item_id"], r["text"]) for r in items], "item_id bigint, text string")
    got = decontaminate.contaminated(spark.createDataFrame(rows, "doc_id bigint, text string"), bench, max_item_bytes=4000).collect()
    assert want and want <= {(r["doc_id"], r["item_id"]) for r in got}
    assert all(r["start_word"] < r["stop_word"] and r["distance"] <= 0.2 * r["n_item_words"] for r in got)


def test_op4_equals_the_distance_over_whole_texts(spark, sf_dir, texts):
    """All pairs, without pieces: the least distance of an item to any stretch of a text, for every item and text."""
    rng = random.Random(3)
    items = {r["item_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").limit(12).collect()} | {900: "one", 901: "of the", 902: None, 903: "!!"}
    rows = {k: t for k, t in list(texts.items())[:60] if len(t) < 6000}
    for k, text in items.items():
        w = decontaminate.words_of(text)
        for share in (0.05, 0.18, 0.25):
            near = [x for y in w for x in ([] if rng.random() < share / 3 else [y, "more"] if rng.random() < share / 3 else ["other"] if rng.random() < share / 3 else [y])]
            rows[1000 * k + int(100 * share)] = " ".join(["before", *near, "after"] * 2)
    got = decontaminate.contaminated(spark.createDataFrame(list(rows.items()), "doc_id bigint, text string"), spark.createDataFrame(list(items.items()), "item_id bigint, text string")).collect()
    want = set()
    for d, t in rows.items():
        words = decontaminate.words_of(t)
        for i, text in items.items():
            w = decontaminate.words_of(text)
            if w and words and (best := decontaminate.best_match(w, words)[0]) <= int(0.2 * len(w)):
                want.add((d, i, best))
    assert {(r["doc_id"], r["item_id"], r["distance"]) for r in got} == want and len(want) > 20
    for r in got:
        stretch = decontaminate.words_of(rows[r["doc_id"]])[r["start_word"] : r["stop_word"]]
        assert decontaminate.best_match(decontaminate.words_of(items[r["item_id"]]), stretch)[0] == r["distance"]


def test_op5_base_columns_equal_brute_force(texts):
    for text in [*texts.values(), "a b c d e f g h " * 3, "x\n x\nx\n\n\n", "", None]:
        t = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
        many = {w for w in windows if windows.count(w) > 1} if len(windows) < 3000 else None
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        got = quality_rules.text_statistics(text)[:5]
        assert got[:4] == (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)))
        if many is not None:
            assert got[4] == len({i + k for i, w in enumerate(windows) if w in many for k in range(8)})


def test_op5_rules_reject_and_keep(spark):
    rng = np.random.default_rng(1)
    table = {"a": rng.random(3000), "b": rng.random(3000)}
    bad = (table["a"] > 0.8) & (table["b"] < 0.5)
    rules = quality_rules.learn_rules(table, bad)
    hit = np.any([quality_rules.covered(r, table) for r in rules], axis=0)
    assert (hit == bad).mean() > 0.98
    df = spark.createDataFrame(list(zip(*(c.tolist() for c in table.values()), strict=True)), "a double, b double")
    assert df.where(quality_rules.rules_column(rules) > 0).count() == hit.sum()


def test_op5_verdicts_on_labels_held_out(spark):
    """Rules learned on two thirds of the labels: what they say of the others."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    held = F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(3)) == 0
    out = quality_rules.quality_rules(docs, labels.where(~held)).join(labels.where(held), "doc_id").collect()
    bad, good = ([r for r in out if (r["quality"] == 0 or r["toxic"] == 1) == b] for b in (True, False))
    assert len(bad) > 20 and sum(not r["kept"] for r in bad) >= 0.9 * len(bad)
    assert len(good) > 50 and sum(not r["kept"] and not r["base_failed"] for r in good) <= 0.05 * len(good)
    assert all(r["kept"] == (not r["base_failed"] and r["rule"] == 0) for r in out)


def test_op6_equals_the_library(spark, sf_dir, texts):
    ranks = byte_bpe.load_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    odd = {10**6 + k: t for k, t in enumerate(["x" * 3000, "    a  b\r\n\n c", "it's we'll 123,456 \U0001f600́", "\x1c\x85 ​"])}
    docs = spark.createDataFrame([*texts.items(), *odd.items()], "doc_id bigint, text string")
    for words in (byte_bpe.MAX_WORDS, 50):  # most words from the dictionary, and hardly any
        got = byte_bpe.encode_texts(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), max_words=words, decoded=True).collect()
        for r in got:
            text = (texts | odd)[r["doc_id"]]
            assert np.frombuffer(r["ids"], "<u4").tolist() == library.encode_ordinary(text) and bytes(r["decoded"]) == text.encode()
    pieces = spark.createDataFrame([(w,) for t in list(texts.values())[:20] for w in t.split()[:20]], "w string")
    for r in pieces.select("w", byte_bpe.fold_merges(F.col("w"), ranks).alias("ids")).collect():
        assert r["ids"] == library.encode_ordinary(r["w"]) or len(re.findall(r"\w+|\W+", r["w"])) > 1
    digests = byte_bpe.with_digests(spark.createDataFrame([(1, 1, bytearray(b"\1\0\0\0"), bytearray(b"a"))], byte_bpe.ENCODED_SCHEMA)).first()
    assert digests["ids_sha256"] == hashlib.sha256(b"\1\0\0\0").hexdigest()


def test_op7_equals_brute_force(spark, texts):
    rows = dict(texts) | {10**6 + k: t[: len(t) - 3] for k, t in list(texts.items())[:60]} | {10**7: "", 10**7 + 1: " \n"}
    got = simhash.simhash_groups(spark.createDataFrame(list(rows.items()), "doc_id bigint, text string")).collect()
    ids, fps = [r["doc_id"] for r in got], [int(r["fingerprint"], 16) for r in got]
    for i, fp in list(zip(ids, fps, strict=True))[:80]:
        w = rows[i].encode().lower().split()
        hashes = [xxhash.xxh64_intdigest(b" ".join(w[k : k + 3]), 42) for k in range(max(1, len(w) - 2))] if w else []
        assert fp == sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
    order = sorted(range(len(ids)), key=lambda k: ids[k])
    links = [(a, b) for a in range(len(order)) for b in range(a) if (fps[order[a]] ^ fps[order[b]]).bit_count() <= 2]
    want = roots(len(order), links)
    assert all(ids[order[want[a]]] == got[order[a]]["component_id"] for a in range(len(order)))


def test_op7_index_on_dense_fingerprints(spark):
    rng = np.random.default_rng(4)
    centre = rng.integers(0, 1 << 64, 30, dtype=np.uint64)
    fps = sorted({int(c) ^ (1 << int(a)) ^ (1 << int(b)) for c in centre for a, b in rng.integers(0, 64, (40, 2))})
    df = spark.createDataFrame([(k, int(np.uint64(fp).view(np.int64))) for k, fp in enumerate(fps)], "id bigint, fp bigint")
    got = {r["node"]: r["component"] for r in connected_components(simhash.near_links(df, leaf=16, fanout=3)).collect()}
    want = roots(len(fps), [(a, b) for a in range(len(fps)) for b in range(a) if (fps[a] ^ fps[b]).bit_count() <= 2])
    assert all(got.get(k, k) == want[k] for k in range(len(fps)))


def test_op8_equals_the_library_and_reuses_the_cache(spark, texts):
    path = public_tokenizers.path("byte_bpe_50k.json")
    rows = dict(list(texts.items())[:60]) | {10**6: "a <|endoftext|> b", 10**6 + 1: "a <|endoftext|> b", 10**6 + 2: "  x\n\n y"}
    docs, library = spark.createDataFrame(list(rows.items()), "doc_id bigint, text string"), Tokenizer.from_file(path)
    cache = scratch_path(spark, "cache")
    for _ in range(2):
        got = {r["doc_id"]: r["n_tokens"] for r in token_counts(docs, path, cache).collect()}
        assert got == {k: len(library.encode(t, add_special_tokens=False)) for k, t in rows.items()}
        assert spark.read.parquet(cache).count() == len(set(rows.values()))
    for name in ("piece_bpe_32k.model", "word_bpe_49k.json"):
        assert token_counts(docs.limit(3), public_tokenizers.path(name), cache).where("n_tokens > 0").count() == 3


def test_op9_base_equals_brute_force(spark, texts):
    rows = dict(texts) | {10**6: "CC-BY cc by; (MIT)\nLicense, xmit license. GNU General  Public License", 10**6 + 1: "mit licenses accby"}
    got = {r["doc_id"]: r for r in license_scan.license_scan(spark.createDataFrame(list(rows.items()), "doc_id bigint, text string")).collect()}
    for k, text in rows.items():
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text))
        at = [(i, label) for p, label in license_scan.BASE_PHRASES.items() for i in range(len(words)) if words[i : i + len(p.split())] == p.split()]
        r = got[k]
        assert (r["n_words"], r["n_base"]) == (len(words), len(at))
        assert (r["first_word"], r["last_word"]) == ((min(at)[0], max(at)[0]) if at else (None, None))
        assert r["base_labels"] == ",".join(sorted({x for _, x in at})) and set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(","))
    assert len(license_scan.rules()) > 300


def test_op9_suppresses_what_lies_inside(spark):
    docs = spark.createDataFrame([(1, "Licensed under CC BY-SA 4.0, or the GNU Lesser General Public License version 2.1")], "doc_id bigint, text string")
    labels = license_scan.license_scan(docs).first()["labels"].split(",")
    assert "cc-by-sa-4.0" in labels and "lgpl-2.1" in labels and "cc-by-sa" not in labels and "gpl" not in labels


def test_op10_longest_common_subsequence():
    rng = random.Random(1)
    for _ in range(500):
        a, b = ([rng.randrange(4) for _ in range(rng.randrange(10))] for _ in range(2))
        row = [0] * (len(b) + 1)
        for x in a:
            new = [0]
            for j, y in enumerate(b):
                new.append(row[j] + 1 if x == y else max(row[j + 1], new[-1]))
            row = new
        kept = html_extract.common_lines(a, b)
        rest = iter(b)
        assert len(kept) == row[-1] and all(any(y == a[k] for y in rest) for k in kept)


def test_op10_articles_and_differencing(spark, sf_dir):
    page = '<html><head><title>t</title><script>var a="</p>";</script></head><body><nav>menu</nav><div class="ad">buy</div><article><h1>T &amp; x</h1><p>one\n two<br><p>three<b>!</b></article><div id="comments">me too</div><footer>f</footer>'
    plain = "<body><div>Site name</div><p>own {}</p><p>shared end</p></body>"
    rows = [(1, "http://a/x", page), (2, "http://b/p/1", plain.format("one")), (3, "http://b/p/2", plain.format("two")), (4, "http://c/z", plain.format("alone"))]
    got = {r["page_id"]: r["text"] for r in html_extract.extract_text(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()}
    assert got == {1: "T & x\none two\nthree!", 2: "own one", 3: "own two", 4: "Site name\nown alone\nshared end"}
    assert spark.read.parquet(f"{sf_dir}/pages.parquet").count() == html_extract.extract_text(spark.read.parquet(f"{sf_dir}/pages.parquet")).where("n_chars > 0").count()
