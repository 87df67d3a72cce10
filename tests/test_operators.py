"""Cases of single operators: borders, faults, collisions, restarts."""

from __future__ import annotations

import time
from collections import Counter
from concurrent.futures import ThreadPoolExecutor
from threading import Barrier, Event

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from carbonproof.functions import canon, scratch
from carbonproof.functions.canon import dense_ids, digest_tree, exact_row_hash
from carbonproof.operators import audit, chunks, manifest, resume
from carbonproof.plans import job, plan, preflight
from carbonproof.queries import flow
from carbonproof.sources import item_files, readers, sinks, tree, versions
from carbonproof.streaming import streams

C = 8


def items(spark, payloads):
    rows = [(k, bytearray(p), len(p)) for k, p in enumerate(payloads)]
    return spark.createDataFrame(rows, "item_id bigint, payload binary, size bigint")


def test_layout_borders(spark):
    sizes = {0: 0, 1: 1, C - 1: 1, C: 1, C + 1: 2, 3 * C: 3}
    rows = chunks.chunk_layout(items(spark, [b"x" * n for n in sizes]), C).collect()
    for k, (size, n) in enumerate(sizes.items()):
        own = sorted(r["len"] for r in rows if r["item_id"] == k)
        assert len(own) == n and sum(own) == size


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.binary(min_size=1, max_size=40), min_size=1, max_size=5))
def test_split_shuffle_reassemble_is_identity(spark, payloads):
    source = items(spark, payloads)
    back = chunks.reassemble_items(chunks.split_chunks(source, C).orderBy(F.rand(3))).collect()
    assert {r["item_id"]: bytes(r["payload"]) for r in back} == dict(enumerate(payloads))


def test_corrupt_chunk_is_bad(spark):
    rows = spark.createDataFrame([(1, 0, 0, 3, "deadbeef", bytearray(b"\1\2\3"))], "item_id bigint, chunk_index bigint, offset bigint, len bigint, digest string, data binary")
    assert not chunks.verify_chunks(rows, C).first()["ok"]


def test_geometry(spark):
    m = spark.createDataFrame([(1, "file", 20), (2, "directory", None)], "id bigint, kind string, size bigint")
    cases = [(1, 0, 0, 8, None), (1, 2, 16, 4, None), (1, 3, 24, 4, "index out of range"), (1, 2, 16, 8, "wrong length"), (1, 1, 9, 8, "wrong offset"), (2, 0, 0, 8, "not a file"), (9, 0, 0, 8, "unknown item")]
    rows = spark.createDataFrame([c[:4] for c in cases], "item_id bigint, chunk_index bigint, offset bigint, len bigint")
    found = {tuple(r[:4]): r["fault"] for r in chunks.validate_geometry(rows, m, C).collect()}
    assert found == {c[:4]: c[4] for c in cases}


def test_item_without_end_record_is_incomplete(spark):
    ends = spark.createDataFrame([(1, 3, "x")], "item_id bigint, total bigint, digest string")
    got = {r["item_id"]: r["status"] for r in chunks.verify_items(items(spark, [b"abc", b"abc"]), ends).collect()}
    assert got == {0: "incomplete", 1: "wrong digest"}


def test_resume_leaves_the_middle(spark):
    layout = chunks.chunk_layout(items(spark, [b"x" * 3 * C]), C)
    done = spark.createDataFrame([(0, 0, True), (0, 2, False)], "item_id bigint, chunk_index bigint, fresh boolean")
    assert [r["chunk_index"] for r in resume.pending_chunks(layout, done).collect()] == [1]
    assert resume.rehash_candidates(layout, done).count() == 0


MANIFEST = "id bigint, rel_path string, kind string, size bigint, full_hash string, chunk_count bigint"


@pytest.mark.parametrize(
    "rows, declared, violations",
    [
        ([(0, "", "file", 3, "h", 1)], 1, set()),
        ([(1, "a/b", "file", 3, "h", 1), (0, "", "directory", None, None, 0), (2, "a", "directory", None, None, 0)], 3, set()),
        ([], 0, {"empty manifest"}),
        ([], 2, {"entry count", "empty manifest"}),
        ([(0, "a", "file", 3, "h", 1)], 1, {"root path not empty"}),
        ([(0, "", "directory", None, None, 0), (0, "a", "file", 3, "h", 1)], 2, {"duplicate id"}),
        ([(0, "", "directory", None, None, 0), (1, "a/b", "file", 3, "h", 1), (2, "a", "file", 1, "h", 1)], 3, {"ancestor not a directory"}),
        ([(0, "", "directory", None, None, 0), (1, "a/../b", "file", 3, "h", 1)], 2, {"path component"}),
        ([(0, "", "file", None, "h", None)], 1, {"missing size"}),
        ([(0, "", "file", 3, None, 2)], 1, {"missing digest", "chunk count"}),
    ],
)
def test_manifest_rules(spark, rows, declared, violations):
    found = manifest.validate_manifest(spark.createDataFrame(rows, MANIFEST), declared, C).collect()
    assert {r["violation"] for r in found} == violations


def test_manifest_hash_depends_on_names_and_order_of_ids_only(spark):
    rows = [(k, f"f{k}", "file", k, "h", 1) for k in range(300)]
    a = manifest.manifest_hash(spark.createDataFrame(rows, MANIFEST)).first()[0]
    b = manifest.manifest_hash(spark.createDataFrame(rows[::-1], MANIFEST).repartition(3)).first()[0]
    c = manifest.manifest_hash(spark.createDataFrame([(0, "x", "file", 0, "h", 1), *rows[1:]], MANIFEST)).first()[0]
    assert a == b != c


def test_dense_ids_and_empty_tree(spark):
    got = sorted((r["x"], r["id"]) for r in dense_ids(spark.range(1000).select((F.col("id") * 7919 % 1009).alias("x")), ["x"], "id").collect())
    assert [i for _, i in got] == list(range(1000))
    assert digest_tree(spark.createDataFrame([], "id bigint, d string")).first()[0].startswith("e3b0c44298fc")


def test_fingerprint_changes_with_any_edit_and_not_with_layout(spark, sf_dir):
    t = spark.read.parquet(f"{sf_dir}/nation.parquet")
    base = audit.table_fingerprint(t).first()
    assert audit.table_fingerprint(t.repartition(7).orderBy("n_name")).first() == base
    assert audit.table_fingerprint(t.unionByName(t.limit(1))).first() != base
    assert audit.table_fingerprint(t.withColumn("n_name", F.when(F.col("n_nationkey") == 3, "x").otherwise(F.col("n_name")))).first() != base


def test_exact_hash_keeps_null_positions_apart(spark):
    rows = spark.createDataFrame([(None, 1), (1, None)], "a int, b int")
    assert rows.select(exact_row_hash(rows).alias("h")).distinct().count() == 2


def test_audit_raises_on_change(spark, sf_dir):
    t = spark.read.parquet(f"{sf_dir}/nation.parquet")
    a, b = (audit.partition_fingerprints(x, ["n_regionkey"]) for x in (t, t.where("n_nationkey <> 3")))
    audit.require_unchanged(audit.audit_immutability(a, a, ["n_regionkey"]))
    with pytest.raises(audit.SourceChanged):
        audit.require_unchanged(audit.audit_immutability(a, b, ["n_regionkey"]))


def test_human_sizes(spark):
    sizes = {512: "512 B", 1536: "1.50 KiB", 1048576: "1.00 MiB", 1 << 30: "1.00 GiB", 5 << 40: "5.00 TiB"}
    rows = spark.createDataFrame([(s,) for s in sizes], "s bigint").select("s", plan.human_size(F.col("s")).alias("t")).collect()
    assert {r["s"]: r["t"] for r in rows} == sizes


def test_no_checks_means_ok(spark):
    none = spark.createDataFrame([], "name string, passed boolean, detail string")
    assert preflight.preflight_decision(none, True).first()["reason"] == "accepted"
    assert preflight.preflight_decision(none, False).first()["reason"] == "rejected by operator"


def test_collisions_and_staged_commit(spark, sf_dir, tmp_path):
    t, path = spark.read.parquet(f"{sf_dir}/region.parquet"), f"file://{tmp_path}/r.out"
    assert sinks.write_copy(t, path) == path
    with pytest.raises(Exception, match="(?i)exist"):
        sinks.write_copy(t, path)
    assert sinks.write_copy(t, path, "rename").endswith("r (1).out")
    with pytest.raises(ValueError):
        sinks.staged_commit(t.limit(1), path, lambda copy: False)
    assert spark.read.parquet(path).count() == 5
    sinks.staged_commit(t.limit(2), path, lambda copy: copy.count() == 2)
    assert spark.read.parquet(path).count() == 2
    assert not [p for p in tmp_path.iterdir() if "_staging" in p.name or "_backup" in p.name]


def test_relational_round_trip(spark, sf_dir, tmp_path):
    url, driver = f"jdbc:derby:{tmp_path}/db;create=true", "org.apache.derby.iapi.jdbc.AutoloadedDriver"
    t = spark.read.parquet(f"{sf_dir}/nation.parquet")
    sinks.write_table(t, url, "nation", 10, driver=driver)
    back = readers.read_table(spark, url, "nation", "n_nationkey", 3, driver)
    assert back.rdd.getNumPartitions() == 3
    assert audit.bag_diff(t, back.select(*t.columns)).count() == 0


def test_excluded_root_is_an_error(spark):
    inv = spark.createDataFrame([("", "symlink")], "rel_path string, kind string")
    with pytest.raises(ValueError):
        readers.select_kinds(inv)
    assert readers.select_kinds(inv, symlinks="keep").count() == 1


def test_inventory_and_payloads(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a/x.txt").write_bytes(b"hello")
    (tmp_path / "y.bin").write_bytes(b"abc")
    (tmp_path / "empty").write_bytes(b"")
    inv = readers.read_inventory(spark, f"file://{tmp_path}")
    assert {(r["rel_path"], r["size"]) for r in inv.collect()} == {("a/x.txt", 5), ("y.bin", 3), ("empty", 0)}
    assert {r["rel_path"]: r["chunk_count"] for r in readers.read_payloads(spark, f"file://{tmp_path}", 2).collect()} == {"a/x.txt": 3, "y.bin": 2, "empty": 0}


def test_inventory_of_nested_equal_names(spark, tmp_path):
    root = tmp_path / "data"
    for at in ("y.bin", "data/y.bin", f"{str(root).strip('/')}/y.bin"):
        (root / at).parent.mkdir(parents=True, exist_ok=True)
        (root / at).write_bytes(b"abc")
    got = {r["rel_path"] for r in readers.read_inventory(spark, f"file://{root}").collect()}
    assert got == {"y.bin", "data/y.bin", f"{str(root).strip('/')}/y.bin"}
    kinds = spark.createDataFrame([("a", None), ("b", "symlink")], "rel_path string, kind string")
    assert [r["rel_path"] for r in readers.select_kinds(kinds).collect()] == ["a"]


def test_preflight_refuses_before_writing(spark, sf_dir, tmp_path):
    t, path = spark.read.parquet(f"{sf_dir}/nation.parquet"), f"file://{tmp_path}/n"
    t.limit(2).write.parquet(path)
    with pytest.raises(job.CopyRefused):
        job.copy_dataset(lambda: t, path, job.CopyOptions("n_regionkey", overwrite=False))
    with pytest.raises(job.CopyRefused):
        job.copy_dataset(lambda: t, f"{path}2", job.CopyOptions("n_regionkey", expects={"n_nationkey": "string"}))
    with pytest.raises(FileExistsError):
        sinks.staged_commit(t, path, lambda copy: True, overwrite=False)
    assert [p.name for p in tmp_path.iterdir()] == ["n"] and spark.read.parquet(path).count() == 2


def test_checksum_is_the_sum_of_the_hashes(spark, sf_dir):
    t = spark.read.parquet(f"{sf_dir}/customer.parquet")
    rows = canon.row_hashes(t)
    assert audit.table_fingerprint(t).first()["checksum"] == sum(r["_hash"] for r in rows.collect())


def test_changing_source_is_caught(spark, sf_dir, tmp_path):
    t = spark.read.parquet(f"{sf_dir}/nation.parquet")
    reads = iter([t, t.where("n_nationkey <> 3")])
    with pytest.raises(audit.SourceChanged):
        job.copy_dataset(lambda: next(reads), f"file://{tmp_path}/n", job.CopyOptions("n_regionkey"))


def test_copy_many_fail_fast(spark, sf_dir, tmp_path):
    def target(name, **options):
        return {"name": name, "read": lambda: spark.read.parquet(f"{sf_dir}/{name}.parquet"), "path": f"file://{tmp_path}/{name}", "options": job.CopyOptions("n_regionkey", **options)}

    rows = job.copy_many(spark, [target("nation", accept=False), target("nation")], fail_fast=True).collect()
    assert [r["outcome"] for r in rows] == ["refused", "skipped"]


def test_slow_sender_is_no_stall(spark):
    rows = [("a", 0), ("a", 20), ("a", 40), ("b", 0), ("b", 90)]
    df = spark.createDataFrame(rows, "transfer string, s bigint").select("transfer", F.timestamp_seconds("s").alias("ts"))
    per = {r["transfer"]: r["count"] for r in streams.stall_sessions(df, "30 seconds").groupBy("transfer").count().collect()}
    assert per == {"a": 1, "b": 2}


def test_pacing_needs_one_bound(spark):
    with pytest.raises(ValueError):
        streams.paced_source(spark, "x", "a int")


def test_tracker_takes_the_end_first(spark, tmp_path):
    schema = "item_id bigint, kind string, chunk_index bigint, len bigint, total bigint"
    parts = [[(1, "end", None, None, 10)], [(1, "chunk", 0, 8, None), (2, "chunk", 0, 8, None)], [(1, "chunk", 1, 2, None), (1, "chunk", 1, 2, None)]]
    for part in parts:
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/in")
    src = spark.readStream.schema(schema).parquet(f"file://{tmp_path}/in")
    with streams.keyed_state(spark):
        query = streams.stream_item_tracker(src).writeStream.format("memory").queryName("tracked").outputMode("update").trigger(availableNow=True).start()
        query.awaitTermination()
    last = {r["item_id"]: (r["received_bytes"], r["chunks"], r["complete"]) for r in spark.table("tracked").collect()}
    assert last == {1: (10, 2, True), 2: (8, 1, False)}


def cut(spark, items_):
    return chunks.split_chunks(items_, C)


def test_digest_of_large_items_from_chunks(spark):
    """Up to the limit the digest is that of the bytes; beyond, any change, swap or lack of a chunk changes it, the layout of rows does not."""
    payloads = [b"a" * 5, bytes(range(200)), bytes(range(200))[::-1], b"z" * 16]
    whole = cut(spark, items(spark, payloads))
    get = lambda rows: {r["item_id"]: r["digest"] for r in chunks.chunk_item_digests(rows, 16, 3).collect()}
    base, plain = get(whole), {r["item_id"]: r["digest"] for r in chunks.item_digests(items(spark, payloads)).collect()}
    assert (base[0], base[3]) == (plain[0], plain[3]) and base[1] not in (plain[1], base[2])
    assert get(whole.repartition(5)) == base
    swapped = whole.withColumn("data", F.when((F.col("item_id") == 1) & (F.col("chunk_index") == 7), F.lit(b"\0" * C)).otherwise(F.col("data")))
    assert get(swapped)[1] != base[1] and get(whole.where("chunk_index <> 3 or item_id <> 2"))[2] != base[2]
    ends = spark.createDataFrame([(0, 5, base[0]), (1, 200, base[1]), (2, 200, base[1]), (7, 9, "x"), (8, 0, "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855")], "item_id bigint, total bigint, digest string")
    status = {r["item_id"]: r["status"] for r in chunks.verify_chunked_items(whole, ends, 16, 3).collect()}
    assert status == {0: "ok", 1: "ok", 2: "wrong digest", 3: "incomplete", 7: "incomplete", 8: "ok"}


def test_items_written_by_several_tasks(spark, tmp_path):
    """One item over all partitions, beside small ones; a name outside of the folder is refused and leaves nothing."""
    payloads = [bytes(i % 251 for i in range(20_000)), b"xy", b"q" * C]
    parts = chunks.split_chunks(items(spark, payloads), C)
    out = item_files.write_items(parts.orderBy(F.rand(1)), f"file://{tmp_path}/out", F.concat(F.lit("d/"), F.col("item_id").cast("string")), partitions=5)
    assert {p.name: p.read_bytes() for p in (tmp_path / "out/d").iterdir()} == {str(i): p for i, p in enumerate(payloads)}
    with pytest.raises(FileExistsError):
        item_files.write_items(parts, out)
    with pytest.raises(Exception, match="no file name"):
        item_files.write_items(parts, f"file://{tmp_path}/bad", F.lit("../x"))
    with pytest.raises(ValueError):
        item_files.write_items(parts, "s3://bucket/x")
    item_files.write_items(parts.limit(0), f"file://{tmp_path}/none")
    assert sorted(p.name for p in tmp_path.iterdir() if "_staging" not in p.name) == ["none", "out"]


def test_tree_has_every_kind_of_entry(spark, tmp_path):
    root = tmp_path / "root dir"
    for at in ("a/b/c/deep", "a/empty", ".hidden/x", "_under/y", "a b/ä"):
        (root / at).parent.mkdir(parents=True, exist_ok=True)
        (root / at).write_bytes(b"" if at.endswith("empty") else at.encode())
    (root / "void").mkdir()
    (root / "link").symlink_to("a/empty")
    (root / "loop").symlink_to(root)
    got = {r["rel_path"]: (r["kind"], r["size"], r["target"]) for r in tree.scan_tree(spark, f"file://{root}").collect()}
    assert {p for p, v in got.items() if v[0] == "directory"} == {"a", "a/b", "a/b/c", ".hidden", "_under", "a b", "void"}
    assert got["a/empty"] == ("file", 0, None) and got["a b/ä"] == ("file", 6, None)
    assert got["link"] == ("symlink", None, "a/empty") and got["loop"][0] == "symlink" and len(got) == 14
    assert {r["rel_path"] for r in tree.scan_tree(spark, f"file://{root}", prefix="a/b/c").collect()} == {"a/b/c", "a/b/c/deep"}
    assert {r["rel_path"] for r in readers.read_inventory(spark, f"file://{root}", glob="[!d]*y").collect()} == {"a/empty"}
    payloads = {r["rel_path"]: bytes(r["content"]) for r in readers.read_payloads(spark, f"file://{root}").collect()}
    assert payloads == {p: (b"" if p.endswith("empty") else p.encode()) for p, v in got.items() if v[0] == "file"}


def test_of_racing_writers_one_commits(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    assert versions.commit_version(spark.range(1), path, lambda x: True) == 1

    def commit(n):
        try:
            return versions.commit_version(spark.range(n), path, lambda x: x.count() == n, after=1)
        except versions.CommitConflict:
            return None

    with ThreadPoolExecutor(4) as pool:
        done = list(pool.map(commit, range(2, 6)))
    winner = next(n for n, v in zip(range(2, 6), done, strict=True) if v == 2)
    assert sorted(done, key=str) == [2, None, None, None]
    assert versions.read_version(spark, path).count() == winner and versions.read_version(spark, path, 1).count() == 1
    with pytest.raises(ValueError):
        versions.commit_version(spark.range(9), path, lambda x: False)
    with pytest.raises(versions.CommitConflict):
        versions.commit_version(spark.range(9), path, lambda x: True, after=1)
    assert versions.versions(spark, path) == [1, 2] and len(list((tmp_path / "t/data").iterdir())) == 2
    assert len(versions.remove_unnamed(spark, path)) == 1 and versions.read_version(spark, path).count() == winner
    with pytest.raises(FileNotFoundError):
        versions.read_version(spark, path, 7)
    assert not [p for p in (tmp_path / "t/versions").iterdir() if "draft" in p.name]


def test_a_copy_reads_its_source_twice(spark, sf_dir, tmp_path):
    read, rows = spark.sparkContext.accumulator(0), spark.read.parquet(f"{sf_dir}/customer.parquet")

    def counted(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    done = job.copy_dataset(lambda: rows.mapInArrow(counted, rows.schema), f"file://{tmp_path}/c", job.CopyOptions("c_mktsegment"), "customer").first()
    assert done["match"] and done["dst_rows"] == rows.count() and read.value == 2 * rows.count()
    assert audit.bag_diff(rows, spark.read.parquet(f"file://{tmp_path}/c")).count() == 0


def test_copy_into_an_empty_folder(spark, sf_dir, tmp_path):
    (tmp_path / "n").mkdir()
    t = spark.read.parquet(f"{sf_dir}/nation.parquet")
    assert job.copy_dataset(lambda: t, f"file://{tmp_path}/n", job.CopyOptions("n_regionkey", overwrite=False)).first()["match"]
    assert spark.read.parquet(f"file://{tmp_path}/n").count() == t.count()
    seen = iter([t, t, t.where("n_nationkey <> 3")])
    with pytest.raises(audit.SourceChanged):
        job.copy_dataset(lambda: next(seen), f"file://{tmp_path}/m", job.CopyOptions("n_regionkey", recheck=True))


def test_copies_overlap_and_the_rest_is_cancelled(spark, sf_dir, tmp_path):
    begun, met = [], Barrier(2, timeout=60)

    def target(name, read):
        return {"name": name, "read": read, "path": f"file://{tmp_path}/{name}", "options": job.CopyOptions("id")}

    def meeting():
        met.wait()  # passes only if two copies are under way at once
        return spark.range(3)

    rows = job.copy_many(spark, [target("a", lambda: (begun.append("a"), meeting())[1] if "a" not in begun else spark.range(3)), target("b", lambda: (begun.append("b"), meeting())[1] if "b" not in begun else spark.range(3))], lanes=2).collect()
    assert [(r["target"], r["outcome"], r["n_rows"]) for r in rows] == [("a", "copied", 3), ("b", "copied", 3)]

    started = Event()

    def slow():
        started.set()
        return spark.range(0, 1 << 42, 1, 2).where("id % 7 = 8")

    def broken():
        started.wait(60)
        time.sleep(2)
        raise KeyError("gone")

    rows = job.copy_many(spark, [target("slow", slow), target("broken", broken), target("later", lambda: spark.range(1))], fail_fast=True, lanes=2).collect()
    assert [(r["target"], r["outcome"]) for r in rows] == [("slow", "cancelled"), ("broken", "failed"), ("later", "skipped")]


def test_ranges_hold_few_runs():
    held = streams.Ranges([])
    assert all(held.add(x) for x in range(1000)) and (held.starts, held.stops) == ([0], [1000])
    again = streams.Ranges([(0, 1000), (1001, 1003)])
    assert not again.add(999) and again.add(1000) and (again.starts, again.stops) == ([0], [1003])
    assert again.changes({1001: 1003}) == ({}, [1001])


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 30)), st.lists(st.integers(0, 30)))
def test_ranges_are_a_set(first, second):
    one = streams.Ranges([])
    assert sum(one.add(x) for x in first) == len(set(first))
    stored = one.changes({})[0]
    two = streams.Ranges([*stored.items(), *zip(one.starts[:1], one.stops[:1], strict=True)])
    for x in second:
        two.add(x)
    written, gone = two.changes(stored)
    now = {k: v for k, v in stored.items() if k not in gone} | written | dict(zip(two.starts[:1], two.stops[:1], strict=True))
    assert sorted(x for a, b in now.items() for x in range(a, b)) == sorted({*first, *second})
    assert all(b < c for (_, b), (c, _) in zip(sorted(now.items()), sorted(now.items())[1:]))


def test_bytes_bound_the_batches(spark, tmp_path):
    spark.range(4000).repartition(8).write.parquet(f"file://{tmp_path}/in")
    most = max(p.stat().st_size for p in (tmp_path / "in").iterdir() if p.suffix == ".parquet")
    query = streams.paced_copy(spark, f"file://{tmp_path}/in", "id bigint", f"file://{tmp_path}/out", f"file://{tmp_path}/check", max_bytes=2 * most + 1)
    query.awaitTermination()
    batches = [p["numInputRows"] for p in query.recentProgress if p["numInputRows"]]
    assert sum(batches) == 4000 and len(batches) >= 4


def test_settings_of_overlapping_blocks(spark):
    key, get = "spark.sql.execution.arrow.maxRecordsPerBatch", lambda: spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    before = get()
    one, two = scratch.setting(spark, key, "5"), scratch.setting(spark, key, "6")
    one.__enter__()
    two.__enter__()
    one.__exit__(None, None, None)
    assert get() == "6"
    two.__exit__(None, None, None)
    assert get() == before


def test_manifest_is_read_twice(spark):
    rows = [(0, "", "directory", None, None, 0), (1, "a", "file", 3, None, 1), (1, "a/b/c", "file", 3, "h", 1), (1, "a/b/c", "file", 3, "h", 1), (4, "a/b", "symlink", None, None, 0)]
    source, read = spark.createDataFrame(rows, MANIFEST), spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    found = Counter((r["violation"], r["id"]) for r in manifest.validate_manifest(source.mapInArrow(counted, source.schema), 5, C).collect())
    assert found == {("missing digest", 1): 1, ("duplicate id", 1): 3, ("duplicate path", 1): 2, ("ancestor not a directory", 1): 1, ("ancestor not a directory", 4): 1}
    assert read.value == 2 * len(rows)


def test_bag_diff_shuffles_once(spark):
    a, b = spark.createDataFrame([(1, None), (1, None), (2, "x")], "a int, surplus_ string"), spark.createDataFrame([(1, None), (3, "y"), (3, "y")], "a int, surplus_ string")
    out = audit.bag_diff(a, b)
    assert {tuple(r) for r in out.collect()} == {("src", 1, None, 1), ("src", 2, "x", 1), ("dst", 3, "y", 2)}
    assert out._jdf.queryExecution().executedPlan().initialPlan().toString().count("Exchange") == 1


def test_stream_progress_waits_for_the_span_of_the_events(spark):
    ids = spark.range(400).withColumn("at", F.pmod(F.col("id") * 37, F.lit(400)))
    columns = [F.timestamp_seconds(1704067200 + F.col("at") * 86400).alias("ts"), F.lit(1).cast("bigint").alias("bytes"), F.lit(True).alias("item_done")]
    events = ids.select("id", *columns)
    got = flow.progress_windows(events).agg(F.count("*"), F.sum("bytes")).first()
    assert tuple(got) == (400, 400)
