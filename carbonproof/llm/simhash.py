"""SimHash near-duplicates through a hierarchical index in Gray order.

Distinct fingerprints are sorted by Gray rank, in which neighbours differ in few bits. Stretches of
the order become leaves; a node above holds what all fingerprints below it share, as the AND and the
OR of their bits. Two nodes differ at least in the bits that one has in all and the other in none of
its fingerprints; where these are more than the radius, the whole pair of groups is pruned. The walk
goes down from the root by joins on node numbers, all pairs of a level at once, and compares
fingerprints only in the pairs of leaves that are left.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from carbonproof.llm.common import connected_components, materialise, without_ids
from carbonproof.llm.near_buckets import near_groups, shared_buckets

#: Distinct fingerprints in a leaf, nodes under a node, fingerprints in the smallest group of a leaf.
LEAF, FANOUT, GROUP = 1024, 16, 16
LINK_SCHEMA = "src bigint, dst bigint"
#: The pipeline's near-duplicate stage: words in a shingle, and similarity of two sets of shingles at least.
STAGE_SHINGLE, STAGE_SIMILARITY = 5, 0.8
#: Its SimHash: words in a feature, and bits in which the fingerprints of candidates differ at most.
STAGE_FEATURE, STAGE_RADIUS = 1, 3
#: Its further candidates: bands, and minwise hashes in a band.
BANDS, BAND_ROWS = 10, 4
#: Cells of a sketch of a set of shingles, at least and at most; powers of two.
LEAST_CELLS, MOST_CELLS = 64, 1 << 15

_ODD = np.uint64(0xBF58476D1CE4E5B9)


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """64-bit SimHash of the word shingles of a whole text, repeats included; 0 without a word.

    A-Z are lower-cased; words are what stands between ASCII white space; a text of fewer words than
    ``shingle`` has one shingle, all its words. A bit is 1 if it is set in over half of the hashes.
    """
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    n = max(1, len(words) - shingle + 1)
    hashes = np.fromiter((xxhash.xxh64_intdigest(b" ".join(words[i : i + shingle]), 42) for i in range(n)), np.uint64, n)
    votes = np.zeros(64, dtype=np.int64)
    for at in range(0, n, 1 << 16):
        part = hashes[at : at + (1 << 16)]
        votes += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(votes * 2 > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """``doc_id`` and ``fp``, the fingerprint's 64 bits as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.fromiter((fingerprint(x.as_py(), shingle) for x in batch.column(1)), np.uint64, len(batch))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(run, "doc_id bigint, fp bigint")


def gray_rank(fp: Column) -> Column:
    """Place of a code word in the reflected Gray order, shifted to sort as a signed long."""
    out = fp
    for shift in (1, 2, 4, 8, 16, 32):
        out = out.bitwiseXOR(F.shiftrightunsigned(out, shift))
    return out.bitwiseXOR(F.lit(-(1 << 63)))


def least_difference(a: str, b: str) -> Column:
    """Bits in which every fingerprint under node ``a`` differs from every one under node ``b``."""
    one = F.col(f"{a}_all").bitwiseAND(F.bitwise_not(F.col(f"{b}_any")))
    other = F.col(f"{b}_all").bitwiseAND(F.bitwise_not(F.col(f"{a}_any")))
    return F.bit_count(one.bitwiseOR(other))


def _leaves(distinct: DataFrame, leaf: int) -> DataFrame:
    """Leaves in Gray order: ``node``, ``node_all``, ``node_any``, ``fps`` and ``ids`` (of the fingerprints)."""
    ordered = distinct.withColumn("rank", gray_rank(F.col("fp")))
    parts = max(1, int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ordered = ordered.repartitionByRange(parts, "rank").sortWithinPartitions("rank").drop("rank")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def cut(fps: np.ndarray, ids: np.ndarray) -> pa.RecordBatch:
            names = ["node_all", "node_any", "fps", "ids"]
            both = [pa.array([int(f.reduce(fps))], pa.int64()) for f in (np.bitwise_and, np.bitwise_or)]
            return pa.RecordBatch.from_arrays([*both, pa.array([fps], pa.list_(pa.int64())), pa.array([ids], pa.list_(pa.int64()))], names)

        fps, ids = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for batch in batches:
            fps = np.concatenate([fps, batch.column(0).to_numpy()])
            ids = np.concatenate([ids, batch.column(1).to_numpy()])
            while len(fps) >= leaf:
                yield cut(fps[:leaf], ids[:leaf])
                fps, ids = fps[leaf:], ids[leaf:]
        if len(fps):
            yield cut(fps, ids)

    out = ordered.mapInArrow(run, "node_all bigint, node_any bigint, fps array<bigint>, ids array<bigint>")
    return out.withColumn("at", F.monotonically_increasing_id())


def _numbered(leaves: DataFrame) -> DataFrame:
    """Leaves with dense numbers in order: place in the partition plus the leaves before it."""
    part = F.shiftright("at", 33)
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts = leaves.groupBy(part.alias("part")).agg(F.count("*").alias("n"))
    offsets = counts.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    place = F.col("at").bitwiseAND((1 << 33) - 1)
    return leaves.withColumn("part", part).join(F.broadcast(offsets), "part").withColumn("node", place + F.col("offset")).drop("part", "offset", "at")


def _leaf_pairs(nodes: DataFrame, radius: int, fanout: int) -> DataFrame:
    """Pairs ``a <= b`` of leaves that no level of the index prunes."""
    levels = [nodes]
    n = nodes.count()
    while n > 1:
        up = levels[-1].groupBy(F.floor(F.col("node") / fanout).alias("node")).agg(
            F.bit_and("node_all").alias("node_all"), F.bit_or("node_any").alias("node_any")
        )
        levels.append(materialise(up, "gray-nodes"))
        n = -(-n // fanout)
    pairs = levels[-1].select(F.col("node").alias("a"), F.col("node").alias("b"))
    for below in reversed(levels[:-1]):
        side = below.withColumn("up", F.floor(F.col("node") / fanout))
        a, b = (
            side.select(F.col("up").alias(f"{x}_up"), F.col("node").alias(f"{x}_node"), F.col("node_all").alias(f"{x}_all"), F.col("node_any").alias(f"{x}_any"))
            for x in "ab"
        )
        pairs = (
            pairs.join(a, F.col("a") == F.col("a_up"))
            .join(b, F.col("b") == F.col("b_up"))
            .where((F.col("a_node") <= F.col("b_node")) & (least_difference("a", "b") <= radius))
            .select(F.col("a_node").alias("a"), F.col("b_node").alias("b"))
        )
        pairs = materialise(pairs, "gray-pairs")
    return pairs


def _shared(fps: np.ndarray, group: int) -> tuple[np.ndarray, np.ndarray]:
    starts = np.arange(0, len(fps), group)
    return np.bitwise_and.reduceat(fps, starts), np.bitwise_or.reduceat(fps, starts)


def close_pairs(a: np.ndarray, b: np.ndarray, radius: int, group: int = GROUP) -> tuple[np.ndarray, np.ndarray]:
    """Places (i, j) with at most ``radius`` bits between ``a[i]`` and ``b[j]``; groups are pruned first."""
    a, b = a.view(np.uint64), b.view(np.uint64)  # bitwise_count counts the bits of a signed number's absolute value
    (a_all, a_any), (b_all, b_any) = _shared(a, group), _shared(b, group)
    least = np.bitwise_count((a_all[:, None] & ~b_any[None, :]) | (b_all[None, :] & ~a_any[:, None]))
    left, right = [], []
    for g, h in zip(*np.nonzero(least <= radius), strict=True):
        x, y = a[g * group : (g + 1) * group], b[h * group : (h + 1) * group]
        i, j = np.nonzero(np.bitwise_count(x[:, None] ^ y[None, :]) <= radius)
        left.append(i + g * group)
        right.append(j + h * group)
    empty = np.zeros(0, np.int64)
    return (np.concatenate(left), np.concatenate(right)) if left else (empty, empty)


def spanning_links(src: np.ndarray, dst: np.ndarray) -> list[tuple[int, int]]:
    """Links that hold the same nodes together, one for each node but one of a group at most."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (up := parent.setdefault(x, x)) != x:
            parent[x] = x = parent[up]
        return x

    out = []
    for s, d in zip(src.tolist(), dst.tolist(), strict=True):
        p, q = root(s), root(d)
        if p != q:
            parent[max(p, q)] = min(p, q)
            out.append((s, d))
    return out


def near_links(distinct: DataFrame, radius: int = 2, leaf: int = LEAF, fanout: int = FANOUT) -> DataFrame:
    """Links between near fingerprints: ``src, dst`` are ids of rows of ``distinct`` (``fp``, ``id``).

    Every two fingerprints within ``radius`` bits end up joined by a chain of links; each task returns
    a spanning set of the links that it finds, so dense groups do not multiply the output.
    """
    leaves = materialise(_leaves(distinct.select("fp", "id"), leaf), "gray-leaves")
    leaves = materialise(_numbered(leaves), "gray-leaves")
    pairs = _leaf_pairs(leaves.select("node", "node_all", "node_any"), radius, fanout)
    a, b = (leaves.select(F.col("node").alias(x), F.col("fps").alias(f"{x}_fps"), F.col("ids").alias(f"{x}_ids")) for x in "ab")
    work = pairs.join(a, "a").join(b, "b").select("a_fps", "a_ids", "b_fps", "b_ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for k in range(len(batch)):
                a_fps, a_ids, b_fps, b_ids = (c[k].values.to_numpy() for c in batch.columns)
                i, j = close_pairs(a_fps, b_fps, radius)
                found += spanning_links(a_ids[i], b_ids[j])
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.int64()) for k in (0, 1)], ["src", "dst"])

    return work.mapInArrow(run, LINK_SCHEMA)


def simhash_groups(docs: DataFrame, shingle: int = 3, radius: int = 2) -> DataFrame:
    """Near-duplicate groups: ``(doc_id, fingerprint, component_id)`` for every document.

    ``fingerprint`` is 16 hex digits, ``component_id`` the smallest id that chains of fingerprints at
    most ``radius`` bits apart reach. Equal fingerprints are one node of the index, whatever their
    number. Null texts count as empty; all texts without a word have fingerprint 0 and are linked like
    any other; repeated rows give a row each; rows with a null id get their fingerprint and a null
    component; an empty table gives an empty table; other columns are ignored.
    """
    fps = materialise(fingerprints(docs, shingle), "fingerprints")
    distinct = materialise(fps.where("doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("id")), "distinct-fingerprints")
    links = materialise(near_links(distinct, radius), "near-links")
    groups = connected_components(links)
    merged = distinct.join(groups, F.col("id") == F.col("node"), "left").select("fp", F.coalesce("component", "id").alias("component_id"))
    return fps.join(merged, "fp", "left").select(
        "doc_id",
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"),
    )


def shingle_set(text: str | None, shingle: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles of a whole text; words as in ``fingerprint``."""
    words = (text or "").encode().lower().split()
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    size = min(shingle, len(words))
    mixed = np.zeros(len(words) - size + 1 if words else 0, np.uint64)
    for k in range(size):
        mixed = (mixed ^ hashes[k : k + len(mixed)]) * _ODD
        mixed ^= mixed >> np.uint64(29)
    return np.unique(mixed)


def min_hashes(features: np.ndarray, n: int) -> np.ndarray:
    """``n`` minwise hashes of a set that is not empty."""
    rng = np.random.default_rng(11)
    salts, odds = (rng.integers(0, 1 << 63, n).astype(np.uint64) * np.uint64(2) + np.uint64(1) for _ in range(2))
    out = np.full(n, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(features), 1 << 12):
        mixed = (features[None, at : at + (1 << 12)] ^ salts[:, None]) * odds[:, None]
        mixed ^= mixed >> np.uint64(32)
        out = np.minimum(out, (mixed * _ODD).min(axis=1))
    return out


def set_sketch(features: np.ndarray) -> bytes:
    """A bit for each of as many cells as a set has members, rounded up: whether their number in the cell is odd."""
    cells = min(MOST_CELLS, max(LEAST_CELLS, 1 << max(0, len(features) - 1).bit_length()))
    counts = np.bincount((features & np.uint64(cells - 1)).astype(np.int64), minlength=cells)
    return np.packbits((counts & 1).astype(np.uint8), bitorder="little").tobytes()


def least_apart(a: bytes, b: bytes) -> int:
    """Members that two sets do not have in common, at least: each changes one bit of a sketch. The longer sketch is folded to the other's cells."""
    x, y = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    while len(x) != len(y):
        if len(x) < len(y):
            x, y = y, x
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    return int(np.bitwise_count(x ^ y).sum())


def possibly_similar(pairs: DataFrame, nodes: DataFrame, similarity: float) -> DataFrame:
    """The ``pairs`` (``src``, ``dst``) that the sizes and sketches of ``nodes`` do not rule out, all columns kept.

    Sets of a Jaccard similarity s differ in (1 - s) / (1 + s) of their two sizes' sum at most, so no similar pair is ruled out.
    """
    a, b = (nodes.select(F.col("node").alias(x), F.col("size").alias(f"{x}_size"), F.col("sketch").alias(f"{x}_sketch")) for x in ("src", "dst"))
    alike = (F.col("src_size") >= F.col("dst_size") * similarity - 1e-6) & (F.col("dst_size") >= F.col("src_size") * similarity - 1e-6)
    both = pairs.join(a, "src").join(b, "dst").where(alike).select(*pairs.columns, "src_size", "dst_size", "src_sketch", "dst_sketch")
    share, n = (1 - similarity) / (1 + similarity), len(pairs.columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = batch.column(n).to_numpy() + batch.column(n + 1).to_numpy()
            sketches = zip(batch.column(n + 2), batch.column(n + 3), strict=True)
            apart = np.fromiter((least_apart(x.as_py(), y.as_py()) for x, y in sketches), np.int64, len(batch))
            yield batch.select(range(n)).filter(pa.array(apart <= sizes * share + 1e-6))

    return both.mapInArrow(run, pairs.schema)


def shingle_keys(docs: DataFrame, shingle: int, bands: int = BANDS, rows: int = BAND_ROWS) -> DataFrame:
    """``doc_id, node, size, keys, fp, sketch``: a hash and the size of the set of shingles, a key for each band of minwise hashes, the SimHash of the words, and the set's sketch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes, sizes, keys, sketches = np.zeros(len(batch), np.uint64), np.zeros(len(batch), np.int64), [], []
            fps = np.fromiter((fingerprint(x.as_py(), STAGE_FEATURE) for x in batch.column(1)), np.uint64, len(batch))
            for k, x in enumerate(batch.column(1)):
                features = shingle_set(x.as_py(), shingle)
                nodes[k], sizes[k] = xxhash.xxh64_intdigest(features.tobytes()), len(features)
                least = min_hashes(features, bands * rows) if len(features) else np.zeros(0, np.uint64)
                keys.append([xxhash.xxh64_intdigest(least[i : i + rows].tobytes(), i) - (1 << 63) for i in range(0, len(least), rows)])
                sketches.append(set_sketch(features))
            arrays = [batch.column(0), pa.array(nodes.view(np.int64)), pa.array(sizes), pa.array(keys, pa.list_(pa.int64())), pa.array(fps.view(np.int64)), pa.array(sketches, pa.binary())]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "node", "size", "keys", "fp", "sketch"])

    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(run, "doc_id bigint, node bigint, size bigint, keys array<bigint>, fp bigint, sketch binary")


def index_candidates(nodes: DataFrame, radius: int = STAGE_RADIUS) -> DataFrame:
    """Pairs ``src < dst`` of the rows ``(node, fp)`` by the index: nodes of one fingerprint with the first of them, these along the index's links."""
    distinct = materialise(nodes.groupBy("fp").agg(F.min("node").alias("id")), "distinct-fingerprints")
    close = near_links(distinct, radius).where("src <> dst").select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"))
    equal = nodes.join(distinct, "fp").where("node <> id").select(F.col("id").alias("src"), F.col("node").alias("dst"))
    return materialise(close.unionByName(equal).distinct(), "index-candidates")


def _shingle_sets(docs: DataFrame, shingle: int) -> DataFrame:
    """``node, features``: the sets of shingles themselves."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x in batch.column(0):
                features = shingle_set(x.as_py(), shingle)
                node = np.uint64(xxhash.xxh64_intdigest(features.tobytes())).view(np.int64)
                arrays = [pa.array([node], pa.int64()), pa.array([features.view(np.int64)], pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(arrays, ["node", "features"])

    return docs.select("text").mapInArrow(run, "node bigint, features array<bigint>")


def shingle_groups(docs: DataFrame, shingle: int = STAGE_SHINGLE, similarity: float = STAGE_SIMILARITY) -> DataFrame:
    """``(doc_id, component_id)`` of documents with an id: chains of texts whose sets of shingles are similar.

    Similarity is the exact Jaccard similarity of the sets. Candidates come from the index over SimHash fingerprints of the words,
    and, for near texts that it leaves apart, from equal bands of BAND_ROWS minwise hashes; equal sets are one node,
    whatever their number, texts without a word too. Sketches of the sets rule out candidates first, none that are similar,
    since most of the index's differ in their shingles and the sets themselves are as large as the texts.
    """
    named = docs.where("doc_id is not null")
    keyed = materialise(shingle_keys(named, shingle), "shingle-keys")
    same = [F.any_value(name).alias(name) for name in ("size", "keys", "sketch")]
    nodes = materialise(keyed.groupBy("node").agg(F.min("doc_id").alias("id"), *same, F.min("fp").alias("fp")), "shingle-nodes")
    candidates = materialise(possibly_similar(index_candidates(nodes.select("node", "fp")), nodes, similarity), "index-candidates")
    seen = shared_buckets(nodes.select(F.explode_outer("keys").alias("key"), F.col("node").alias("id"), "size").where("key is not null"))
    compared = seen.select(F.col("id").alias("node")).unionByName(candidates.select(F.explode(F.array("src", "dst")).alias("node"))).distinct()
    wanted = nodes.join(compared, "node", "left_semi").select("id").distinct()
    sets = _shingle_sets(without_ids(named, wanted, "left_semi"), shingle).groupBy("node").agg(F.any_value("features").alias("features"))
    sets = materialise(sets, "shingle-sets")

    def verified(pairs: DataFrame) -> DataFrame:
        a, b = (sets.toDF(name, f"{name}_set") for name in ("src", "dst"))
        pairs = possibly_similar(pairs, nodes, similarity)
        both = pairs.join(a, "src").join(b, "dst").withColumn("common", F.size(F.array_intersect("src_set", "dst_set")))
        union = F.size("src_set") + F.size("dst_set") - F.col("common")
        return both.where(F.col("common") >= union * similarity - 1e-9).select(*pairs.columns)

    links = near_groups(seen, verified, similarity).select(F.col("node").alias("src"), F.col("component").alias("dst"))
    groups = connected_components(links.unionByName(verified(candidates)))
    merged = nodes.select("node", "id").join(groups.withColumnRenamed("node", "member"), F.col("node") == F.col("member"), "left")
    merged = merged.select("node", "id", F.coalesce("component", "node").alias("component"))
    heads = merged.groupBy("component").agg(F.min("id").alias("component_id"))
    return keyed.select("doc_id", "node").join(merged.join(heads, "component").select("node", "component_id"), "node").select("doc_id", "component_id")


def keep_one(docs: DataFrame, shingle: int = STAGE_SHINGLE, similarity: float = STAGE_SIMILARITY) -> DataFrame:
    """The documents left when one of each near-duplicate group stays, the one with the smallest id, with all columns.

    Groups are those of ``shingle_groups``, not of op7's contract. Of rows that repeat an id one stays;
    rows with a null id all stay.
    """
    groups = materialise(shingle_groups(docs, shingle, similarity), "shingle-groups")
    heads = groups.where("doc_id = component_id").select("doc_id").distinct()
    named = docs.where("doc_id is not null")
    rows, ids = groups.agg(F.count("doc_id"), F.count_distinct("doc_id")).first()
    if rows > ids:  # only then are whole rows compared by id, which shuffles the texts once more
        named = named.dropDuplicates(["doc_id"])
    stay = without_ids(named, heads, "left_semi")
    return stay.unionByName(docs.where("doc_id is null"))
