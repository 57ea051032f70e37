"""SimHash near-duplicates linked exactly through vantage-point trees.

A text's fingerprint is the majority of the bits of its shingles' hashes. Equal fingerprints are one
point. The points are dealt out by the top of a vantage-point tree: a node holds a vantage point and
a radius, points within it go left, the others right. Each point lives in one shard; as a query it
visits every shard that can hold a point within the radius of search, by the triangle inequality
(``|d(q, v) - d(x, v)| <= d(q, x)``), so no pair is missed. Those that ask at a shard come in blocks of
bounded size, each with the shard's points. There the tree goes on and compares at its leaves. A task
emits a spanning star of what it linked, never the pairs; stars are joined by hooking and pointer
jumping until each points at its smallest member.

``similar`` serves the pipeline, where near duplicates are texts whose sets of five-word shingles have
a Jaccard similarity of 0.8 or more. At that similarity fingerprints differ by about 9 of 64 bits, and
a tree prunes nothing at such a radius; so there the tree's components are buckets of candidates beside
those of a second sketch, minimum hashes in bands. Both sketches only find candidates: a link is a pair
whose whole sets were compared, and every pair of a bucket is compared unless it is linked already.

The top of the tree is fitted on at most ``SAMPLE`` fingerprints (its shape only: every point is
dealt and searched exactly). Components never pass through the driver.

Defined results: a null text is empty; texts without words have the fingerprint zero and are linked
like any other; rows with a null doc_id take no part and give no row; rows that repeat a doc_id
each give a row and share its component; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm import common

RADIUS, SHINGLE, SEED = 4, 4, 42
#: Fingerprints the top of the tree is fitted on, its depth at most, the points a shard is meant to
#: have, and the points that ask at a shard in one task.
SAMPLE, MOST_DEPTH = 32_768, 12
SHARD_POINTS, ASKING = 100_000, 4_000_000
#: Points of a shard that are compared without further branching.
LEAF = 256
#: The pipeline's shingles; the ranges that hashes' minimums are taken over, bands and minimums in one.
PIPELINE_SHINGLE, BINS, BANDS, BAND_ROWS = 5, 128, 20, 6
#: What is compared at once of a bucket: texts, those of them outside its largest component, shingles of either.
MEMBERS, OUTSIDERS, HELD = 1024, 256, 2_000_000
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def bit_counts(hashes: np.ndarray) -> np.ndarray:
    """How many of the hashes have each of the 64 bits (the highest first)."""
    total = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 1 << 16):
        raw = hashes[i : i + (1 << 16)].astype(">u8").view(np.uint8).reshape(-1, 8)
        bits = np.unpackbits(raw, axis=1)
        for j in range(0, len(bits), 255):  # sums of 255 bits fit a byte
            total += np.add.reduce(bits[j : j + 255], axis=0, dtype=np.uint8)
    return total


def shingles(text: bytes, n: int) -> tuple[bytes, list[int], list[int]]:
    """Words of the lower-cased text joined by spaces, and where each shingle of n words starts and ends."""
    words = text.translate(LOWER).split()
    if not words:
        return b"", [], []
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    n = min(n, len(words))
    return b" ".join(words), starts[: len(words) - n + 1].tolist(), ends[n - 1 :].tolist()


def shingle_hashes(text: bytes, n: int) -> np.ndarray:
    joined, starts, ends = shingles(text, n)
    h, view = xxhash.xxh64_intdigest, memoryview(joined)
    return np.fromiter((h(view[a:b], SEED) for a, b in zip(starts, ends, strict=True)), np.uint64, len(starts))


def majority(hashes: np.ndarray) -> int:
    """The fingerprint of shingles' hashes; zero for none."""
    return int.from_bytes(np.packbits(2 * bit_counts(hashes) > len(hashes)).tobytes(), "big")


def fingerprint(text: bytes, n: int = SHINGLE) -> int:
    return majority(shingle_hashes(text, n))


def minimums(hashes: np.ndarray) -> np.ndarray:
    """The smallest hash in each of ``BINS`` ranges; an empty range borrows from the next that isn't."""
    out = np.zeros(BINS, np.uint32)
    if not len(hashes):
        return out
    h = np.sort(hashes)
    bins = (h >> np.uint64(64 - BINS.bit_length() + 1)).astype(np.int64)
    first = np.flatnonzero(np.diff(bins, prepend=-1))
    at = bins[first]
    value = (h[first] >> np.uint64(20)).astype(np.uint32)
    near = np.searchsorted(at, np.arange(BINS)) % len(at)
    gap = (at[near] - np.arange(BINS)) % BINS
    return value[near] + gap.astype(np.uint32) * np.uint32(0x9E3779B1)


def bands(minimum: np.ndarray) -> np.ndarray:
    """One key for each band of minimums."""
    key = np.arange(BANDS, dtype=np.uint64) + np.uint64(1)
    for column in minimum[: BANDS * BAND_ROWS].reshape(BANDS, BAND_ROWS).T:
        key = (key ^ column) * np.uint64(0x9FB21C651E98DF25)
        key ^= key >> np.uint64(29)
    return key


def fingerprints(docs: DataFrame, n: int = SHINGLE, sketched: bool = False) -> DataFrame:
    """``doc_id, fp`` (the 64 bits as a long); also ``kind, n, keys`` if ``sketched``: the shingles' digest and number, bands."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps, sets = [], []
            for t in batch.column(1):
                hashes = shingle_hashes(t.as_buffer().to_pybytes() if t.is_valid else b"", n)
                fps.append(majority(hashes))
                if sketched:
                    sets.append(np.unique(hashes))
            out = {"doc_id": batch.column(0), "fp": pa.array(np.array(fps, np.uint64).view(np.int64))}
            if sketched:
                out["kind"] = pa.array([xxhash.xxh3_128_digest(x) for x in sets], pa.binary())
                out["n"] = pa.array([len(x) for x in sets], pa.int64())
                out["keys"] = pa.array([bands(minimums(x)).view(np.int64) for x in sets], pa.list_(pa.int64()))
            yield pa.record_batch(out)

    common.tune(docs.sparkSession)
    schema = "doc_id long, fp long" + ", kind binary, n long, keys array<long>" * sketched
    return common.documents(docs).where(F.col("doc_id").isNotNull()).mapInArrow(run, schema)


def apart(points: np.ndarray, v: np.uint64) -> np.ndarray:
    return np.bitwise_count(points ^ v).astype(np.int16)


class Node:
    """Of the top tree. A leaf has a shard's number, a branch a vantage point and a radius."""

    def __init__(self, sample: np.ndarray, depth: int, count: list[int]):
        self.shard = -1
        if depth:
            self.vantage = sample[0] if len(sample) else np.uint64(0)
            d = apart(sample[1:], self.vantage)
            self.radius = int(np.median(d)) if len(d) else 31
            near = d <= self.radius
            self.near, self.far = Node(sample[1:][near], depth - 1, count), Node(sample[1:][~near], depth - 1, count)
        else:
            self.shard = count[0]
            count[0] += 1

    def deal(self, points: np.ndarray, home: np.ndarray, within: int, out: list) -> None:
        """Appends (shard, points at home there, points that must ask there)."""
        if not len(points):
            return
        if self.shard >= 0:
            out.append((self.shard, points[home], points))
            return
        d = apart(points, self.vantage)
        for node, mine, asks in ((self.near, d <= self.radius, d <= self.radius + within), (self.far, d > self.radius, d > self.radius - within)):
            node.deal(points[asks], (home & mine)[asks], within, out)


def rooted(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest index reachable from each of n, over edges a-b."""
    root = np.arange(n)
    while len(a):
        low = np.minimum(root[a], root[b])
        np.minimum.at(root, root[a], low)
        np.minimum.at(root, root[b], low)
        while not np.array_equal(up := root[root], root):
            root = up
        apart_still = root[a] != root[b]
        a, b = a[apart_still], b[apart_still]
    return root


def linked(homes: np.ndarray, asks: np.ndarray, within: int) -> tuple[np.ndarray, np.ndarray]:
    """A star (point, smallest point linked with it) over all links of a shard.

    ``asks`` holds the homes and the points of other shards that may have a partner here.
    """
    points = np.unique(np.concatenate([homes, asks]))
    h_at, q_at = (np.searchsorted(points, np.unique(x)) for x in (homes, asks))
    edges_a: list[np.ndarray] = []
    edges_b: list[np.ndarray] = []
    root = np.arange(len(points))
    held = 0

    def settle() -> None:
        nonlocal root, held
        if edges_a:
            root = rooted(len(points), np.concatenate([*edges_a, np.arange(len(points))]), np.concatenate([*edges_b, root]))
        edges_a.clear()
        edges_b.clear()
        held = 0

    stack = [(h_at, q_at)]
    while stack:
        h, q = stack.pop()
        if not len(h) or not len(q):
            continue
        d_h = None
        if len(h) > LEAF:
            vantage = points[h[0]]
            d_h, d_q = apart(points[h], vantage), apart(points[q], vantage)
            radius = int(np.median(d_h))
            near = d_h <= radius
            if near.all():
                near = d_h < radius
                radius -= 1
            if near.any() and not near.all():
                stack += [(h[near], q[d_q <= radius + within]), (h[~near], q[d_q > radius - within])]
                continue
        for i in range(0, len(h), LEAF):
            for j in range(0, len(q), 4096):
                x, y = h[i : i + LEAF], q[j : j + 4096]
                hit = np.flatnonzero(np.bitwise_count(points[y][:, None] ^ points[x][None, :]) <= within)
                if len(hit):
                    a, b = y[hit // len(x)], x[hit % len(x)]
                    other = root[a] != root[b]
                    if other.any():
                        edges_a.append(a[other])
                        edges_b.append(b[other])
                        held += int(other.sum())
                        if held > 100_000:
                            settle()
    settle()
    moved = root != np.arange(len(points))
    return points[moved], points[root[moved]]


def components(edges: DataFrame) -> DataFrame:
    """``u, root`` of every u that isn't its component's smallest. ``edges``: u, v with v < u, connected as a whole.

    A turn points each u at its smallest v, hooks its other ones there too, and lets what points at
    a pointing node jump ahead. Each turn is written and read again, and what it shuffled is dropped:
    turns are many, and their shuffles have a file or two for each task however few rows are left.
    """
    e = common.reread(edges.distinct())
    while True:
        low = e.groupBy("u").agg(F.min("v").alias("m"))
        hooked = e.join(low, "u").where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        jumped = low.join(low.select(F.col("u").alias("m"), F.col("m").alias("up")), "m", "left").select("u", F.coalesce("up", "m").alias("v"), F.col("up").isNotNull().alias("moved"))
        nxt = common.reread(jumped.unionByName(hooked.withColumn("moved", F.lit(True))).groupBy("u", "v").agg(F.max("moved").alias("moved")))
        e = nxt.drop("moved")
        if nxt.where("moved").isEmpty():
            return e.select("u", F.col("v").alias("root"))


def signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def links(points: DataFrame, within: int = RADIUS, shards_per_core: int = 2) -> DataFrame:
    """``u, v``: stars over all links between the distinct values of ``fp``."""
    spark = points.sparkSession
    n = points.count()
    sample = np.array([r[0] for r in points.select("fp").orderBy(F.xxhash64("fp")).limit(SAMPLE).collect()], np.int64).view(np.uint64)
    want = max(n / SHARD_POINTS, min(shards_per_core * spark.sparkContext.defaultParallelism, n / 1000))
    depth = min(MOST_DEPTH, max(0, math.ceil(math.log2(max(1.0, want)))))
    top = Node(sample, depth, [0])
    # about 0.86 of the points that reach a node go on to either side; a shard's points meet each block of them
    blocks = math.ceil(n * 0.86**depth / ASKING)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            found: list = []
            top.deal(fp, np.ones(len(fp), bool), within, found)
            out = [(shard, b, homes, asks[asks % np.uint64(blocks) == b] if blocks > 1 else asks) for shard, homes, asks in found for b in range(blocks)]
            yield pa.record_batch({"shard": pa.array([x[0] for x in out], pa.int64()), "block": pa.array([x[1] for x in out], pa.int64()), "homes": pa.array([x[2].tobytes() for x in out], pa.binary()), "asks": pa.array([x[3].tobytes() for x in out], pa.binary())})

    def search(t: pa.Table) -> pa.Table:
        homes, asks = (np.frombuffer(b"".join(t.column(c).to_pylist()), np.uint64) for c in ("homes", "asks"))
        a, b = linked(homes, asks, within)
        a, b = a.view(np.int64), b.view(np.int64)
        return pa.table({"u": np.maximum(a, b), "v": np.minimum(a, b)})

    dealt = points.select("fp").mapInArrow(deal, "shard long, block long, homes binary, asks binary")
    return dealt.groupBy("shard", "block").applyInArrow(search, "u long, v long")


def near_duplicates(docs: DataFrame, within: int = RADIUS, n: int = SHINGLE) -> DataFrame:
    """``doc_id, fingerprint, component_id`` of every document."""
    fps = common.reread(fingerprints(docs, n))
    points = common.reread(fps.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count("*").alias("copies")))
    root = components(links(points, within))
    rooted_ = common.reread(points.join(root, F.col("fp") == F.col("u"), "left").select("fp", "first", "copies", F.coalesce("root", "fp").alias("root")))
    named = rooted_.groupBy("root").agg(F.min("first").alias("component_id"), F.count("*").alias("points"), F.sum("copies").alias("rows"))
    n = named.agg(F.coalesce(F.sum("points"), F.lit(0)), F.coalesce(F.sum("rows"), F.lit(0))).first()
    # a component, or copies of one text, may be a third of everything
    by_fp = common.join_hot(rooted_, named.drop("rows"), "root", "points", n[0]).select("fp", "component_id", "copies")
    return common.join_hot(fps, by_fp, "fp", "copies", n[1]).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def alike(common_: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether sets of a and b shingles with so many in common have a Jaccard similarity of 0.8 or more."""
    return 9 * common_ >= 4 * (a + b)


def checked(pairs: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pairs (u, v, sets of both) that are alike."""
    for batch in pairs:
        ok = np.zeros(batch.num_rows, bool)
        for i, (x, y) in enumerate(zip(batch.column(2), batch.column(3), strict=True)):
            x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
            if 5 * min(len(x), len(y)) >= 4 * max(len(x), len(y)):
                both = np.sort(np.concatenate([x, y]), kind="stable")
                ok[i] = alike(np.count_nonzero(both[1:] == both[:-1]), len(x), len(y))
        keep = pa.array(ok)
        yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], ["u", "v"])


def compared(t: pa.Table) -> pa.Table:
    """Stars over the links of a block's outsiders with its members, of rows ``first, root, outsider, words``."""
    first, root, outside = (t.column(c).to_numpy() for c in ("first", "root", "outsider"))
    sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in t.column("words")]
    size = np.array([len(x) for x in sets], np.int64)
    mine, asks = np.flatnonzero(~outside), np.flatnonzero(outside)
    edges_a, edges_b = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    if len(mine) and len(asks):
        known, at = np.unique(np.concatenate([sets[i] for i in mine]), return_inverse=True)
        starts = np.concatenate([[0], np.cumsum(size[mine])[:-1]])
        for i in asks:
            x = sets[i]
            place = np.minimum(np.searchsorted(known, x), len(known) - 1)
            has = np.zeros(len(known), np.int32)
            has[place[known[place] == x]] = 1
            hit = mine[alike(np.add.reduceat(has[at], starts), size[mine], size[i]) & (root[mine] != root[i])]
            edges_a.append(np.full(len(hit), first[i]))
            edges_b.append(first[hit])
    a, b = np.concatenate(edges_a), np.concatenate(edges_b)
    nodes = np.unique(np.concatenate([a, b]))
    low = rooted(len(nodes), np.searchsorted(nodes, a), np.searchsorted(nodes, b))
    moved = low != np.arange(len(nodes))
    return pa.table({"u": nodes[moved], "v": nodes[low[moved]]})


def shingle_sets(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """``first, words``: the sorted set of shingles' hashes of the documents that ``ids`` names, each once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = [np.unique(shingle_hashes(t.as_buffer().to_pybytes(), PIPELINE_SHINGLE)).tobytes() for t in batch.column(1)]
            yield pa.record_batch({"first": batch.column(0), "words": pa.array(words, pa.binary())})

    asked = common.documents(docs).join(ids.withColumnRenamed("first", "doc_id"), "doc_id", "left_semi")
    sets = asked.mapInArrow(run, "first long, words binary").where(F.length("words") > 0)
    return common.reread(sets.groupBy("first").agg(F.collect_set("words").alias("words")).select("first", F.explode("words").alias("words")))


def mixed_links(shared: DataFrame, root: DataFrame, sets: DataFrame) -> DataFrame:
    """``u, v``: stars over all links between different components within the buckets ``shared`` (key, first, n).

    A bucket's texts outside its largest component are compared with all of its texts, in blocks.
    Buckets of the same texts are one.
    """
    placed = common.reread(shared.join(root, F.col("first") == F.col("u"), "left").select("key", "first", "n", F.coalesce("root", "first").alias("root")))
    sign = [F.bit_xor(F.xxhash64("first", F.lit(k))).alias(f"x{k}") for k in (0, 1)]
    parts = placed.groupBy("key", "root").agg(F.count("*").alias("c"), F.sum("n").alias("n"), *sign)
    all_ = [F.sum("c").alias("texts"), F.sum("n").alias("words"), F.max(F.struct("c", "n", "root")).alias("home"), F.count("*").alias("roots"), F.bit_xor("x0").alias("x0"), F.bit_xor("x1").alias("x1")]
    # the two texts of a pair have been compared
    mixed = parts.groupBy("key").agg(*all_).where("roots > 1 and texts > 2")
    mixed = mixed.groupBy("texts", "words", "x0", "x1").agg(F.min(F.struct("key", "home")).alias("one")).select("one.*", "texts", "words")
    most = lambda texts, n, words: F.ceil(F.greatest(texts / n, words / HELD))
    blocks = mixed.select("key", F.col("home.root").alias("home"), most(F.col("texts"), MEMBERS, F.col("words")).alias("nm"), most(F.col("texts") - F.col("home.c"), OUTSIDERS, F.col("words") - F.col("home.n")).alias("no"))
    rows = common.reread(placed.join(blocks, "key"))
    part = lambda n, seed: F.pmod(F.xxhash64("first", F.lit(seed)), n)
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), n - 1))
    members = rows.select("key", "first", "root", F.lit(False).alias("outsider"), part("nm", 2).alias("m"), every(F.col("no")).alias("o"))
    outsiders = rows.where("root <> home").select("key", "first", "root", F.lit(True).alias("outsider"), part("no", 3).alias("o"), every(F.col("nm")).alias("m"))
    dealt = members.unionByName(outsiders).join(sets, "first")
    return dealt.groupBy("key", "m", "o").applyInArrow(compared, "u long, v long")


def similar(docs: DataFrame) -> DataFrame:
    """``doc_id, component_id`` of documents linked by similar sets of five-word shingles.

    Documents of equal sets are one before anything is compared, so a group of copies leaves each
    task as one row. Each member of a bucket (of a band, or a component of the tree) is compared with
    the bucket's smallest member; what that leaves in different components is compared within the
    bucket, all with all (``mixed_links``).
    """
    sketched = common.reread(fingerprints(docs, PIPELINE_SHINGLE, sketched=True))
    kinds = common.reread(sketched.groupBy("kind").agg(F.min("doc_id").alias("first"), F.first("n").alias("n"), F.first("keys").alias("keys")))
    tree = components(links(common.reread(sketched.where("n > 0").select("fp").distinct())))
    near = sketched.where("n > 0").select("kind", "fp").distinct().join(tree, F.col("fp") == F.col("u"), "left").select("kind", F.coalesce("root", "fp").alias("root")).distinct()
    # fingerprints of one text alone are no bucket
    near = near.join(near.groupBy("root").agg(F.count("*").alias("c")).where("c > 1"), "root").select("kind", F.xxhash64(F.lit("tree"), "root").alias("key"))
    by_tree = near.join(kinds, "kind").select("first", "n", "key")
    bucketed = kinds.where("n > 0").select("first", "n", F.explode("keys").alias("key")).unionByName(by_tree)
    ends = bucketed.groupBy("key").agg(F.min("first").alias("low"), F.max("first").alias("high")).where("low <> high")
    shared = common.reread(bucketed.join(ends, "key").select("key", "first", "n", "low"))
    sets = shingle_sets(docs, shared.select("first").distinct())

    pairs = shared.where("first <> low").select(F.col("first").alias("u"), F.col("low").alias("v")).distinct()
    named = lambda c: sets.select(F.col("first").alias(c), F.col("words").alias(f"{c}_words"))
    to_low = pairs.join(named("u"), "u").join(named("v"), "v").select("u", "v", "u_words", "v_words").mapInArrow(checked, "u long, v long")
    copies = sketched.select("doc_id", "kind").join(kinds.select("kind", "first"), "kind").select(F.col("doc_id").alias("u"), F.col("first").alias("v")).where("u <> v")
    root = common.reread(components(to_low.unionByName(copies)))

    ordered = lambda e: e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    root = components(ordered(mixed_links(shared, root, sets)).unionByName(root.select("u", F.col("root").alias("v"))))
    return sketched.select("doc_id").join(root, F.col("doc_id") == F.col("u"), "left").select("doc_id", F.coalesce("root", "doc_id").alias("component_id"))


def keep_first(docs: DataFrame) -> DataFrame:
    """One document of each group of similar texts, the one with the smallest doc_id; rows with a null one stay."""
    key = common.unused(docs, "_other")
    others = similar(docs).where(F.col("component_id") != F.col("doc_id")).select(F.col("doc_id").alias(key)).distinct()
    return docs.join(others, docs["doc_id"] == F.col(key), "left_anti")
