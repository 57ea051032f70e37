"""Exact dedup with an extendible-hash index on shared files, with DataFrame functions.

A text's key is the 64-bit hash of its normal form. The index is two tables under a folder that all
executors see:

- the *directory*, one row for each of its 2^g slots (the first g bits of a key), with the slot's bucket and
  how many bits the bucket has. It begins as one bucket; a bucket with more than ``CAPACITY`` keys is split
  by one more bit of the key, and the directory doubles when that is more bits than it has;
- the *buckets*, an entry for each different text: its key and its place in the chain of texts that have
  that key, its SHA-256 and length, the smallest doc_id and the number of copies. Files are sorted by
  bucket, so a reader of some buckets skips the others by their statistics.

Owner tasks have a range of keys each. An owner groups what it has by key and by the text itself, which
compares bytes: texts that differ but share a key go one behind the other in the chain. Keys that hold very
many rows don't go to an owner before their copies are one row for each task. Texts travel once, and not
at all in the look-up, which finds a document's entry by its SHA-256.

Defined results: a null text is empty; rows with a null doc_id are compared as others and count as larger
than any id; rows that repeat a doc_id and a text share the answer, so all of those with the smallest id
stay; other columns are left behind (by ``dedup`` kept); an empty table gives an index of one empty bucket.
"""

from __future__ import annotations

import math
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.llm import common

#: Keys of a bucket before it is split; bits of a key, beyond those that an even spread needs, that may split one.
CAPACITY, SPARE_BITS = 1 << 16, 8
#: Ranges of keys for each partition of a shuffle.
RANGES = 16
SPACE = r"[\x20\x09-\x0D]+"


def normal(text: Column) -> Column:
    """The text with each stretch of white space as one space."""
    return F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), SPACE, " ")


def first_bits(key: Column, n: int) -> Column:
    return F.shiftrightunsigned(key, 64 - n) if n else F.lit(0).cast("long")


def directory(keys: DataFrame, capacity: int = CAPACITY) -> tuple[DataFrame, int]:
    """``slot, bucket, depth`` for different ``key``s, and the bits of a slot. A bucket is named by its bits."""
    n = keys.count()
    most = min(48, max(0, math.ceil(math.log2(max(1, n / capacity)))) + SPARE_BITS)
    counts = common.cut(keys.groupBy(first_bits(F.col("key"), most).alias("bits")).agg(F.count("*").alias("n")))
    # a level at a time: what is overfull becomes two buckets by one bit more, also where one of them is empty
    level, left, done = keys.sparkSession.range(1).select(F.col("id").alias("prefix")), counts, None
    for depth in range(most + 1):
        prefix = F.shiftright("bits", most - depth)
        sizes = common.cut(level.join(left.groupBy(prefix.alias("prefix")).agg(F.sum("n").alias("n")), "prefix", "left"))
        over = F.coalesce(F.col("n") > capacity, F.lit(False)) & F.lit(depth < most)
        fits = sizes.where(~over).select("prefix", F.lit(depth).alias("depth"))
        done = fits if done is None else done.unionByName(fits)
        full = sizes.where(over).select("prefix")
        if full.isEmpty():
            break
        level = full.select(F.explode(F.array(F.col("prefix") * 2, F.col("prefix") * 2 + 1)).alias("prefix"))
        left = common.cut(left.join(full, prefix == full["prefix"], "left_semi"))
    done = common.cut(done)
    bits = done.agg(F.coalesce(F.max("depth"), F.lit(0))).first()[0]
    start = F.expr(f"shiftleft(prefix, {bits} - depth)")
    slots = F.explode(F.sequence(start, start + F.expr(f"shiftleft(1L, {bits} - depth)") - 1))
    name = F.when(F.col("depth") == 0, "").otherwise(F.lpad(F.bin("prefix"), F.col("depth"), F.lit("0")))
    return done.select(slots.alias("slot"), name.alias("bucket"), "depth"), bits


@dataclass(frozen=True)
class Index:
    folder: str

    def directory(self, spark: SparkSession) -> DataFrame:
        """``slot, bucket, depth``."""
        return spark.read.parquet(f"{self.folder}/directory")

    def entries(self, spark: SparkSession) -> DataFrame:
        """``bucket, key, chain, sha, n_bytes, keep_id, copies``."""
        return spark.read.parquet(f"{self.folder}/buckets")


def keyed(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), normal(F.col("text")).alias("normal")).withColumn("key", F.xxhash64("normal"))


def prints(docs: DataFrame) -> DataFrame:
    """``doc_id, key, sha`` of every document, written once: texts are read for it, and not again for counts and look-ups."""
    return common.cut(keyed(docs).select("doc_id", "key", F.sha2("normal", 256).alias("sha")))


def grouped(rows: DataFrame, keys: DataFrame, total: int) -> DataFrame:
    """``key, normal, keep_id, copies``: one row for each different text, by its bytes."""
    spark = rows.sparkSession
    agg = [F.min("doc_id").alias("keep_id"), F.count("*").alias("copies")]
    ranges = RANGES * common.shuffle_partitions(spark)
    owner = first_bits(F.col("key"), max(1, math.ceil(math.log2(ranges))))
    least = max(common.HOT_ROWS, -(-total // common.HOT_KEYS))
    hot = F.broadcast(common.cut(keys.where(F.col("n") >= least).select("key")))  # HOT_KEYS of them at most
    cold = rows.join(hot, "key", "left_anti").withColumn("owner", owner).repartition("owner").groupBy("owner", "key", "normal").agg(*agg).drop("owner")
    # copies of a hot text leave a task as one row
    return cold.unionByName(rows.join(hot, "key", "left_semi").groupBy("key", "normal").agg(*agg))


def build(docs: DataFrame, folder: str | None = None, capacity: int = CAPACITY, printed: DataFrame | None = None) -> Index:
    """The index of all documents, written to ``folder`` (a new one in the shared folder, if not given). ``printed``: their ``prints``, where they are known."""
    spark = docs.sparkSession
    folder = folder or f"{common.shared_folder(spark)}/exact-{uuid.uuid4().hex}"
    rows = keyed(docs)
    keys = common.cut((rows if printed is None else printed).groupBy("key").agg(F.count("*").alias("n")))
    total = keys.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    slots, bits = directory(keys, capacity)
    slots.write.parquet(f"{folder}/directory")
    slots = spark.read.parquet(f"{folder}/directory")
    slots = F.broadcast(slots) if common.fits_broadcast(slots) else slots
    entries = grouped(rows, keys, total).select("key", F.sha2("normal", 256).alias("sha"), F.octet_length("normal").cast("long").alias("n_bytes"), "keep_id", "copies")
    entries = common.cut(entries.withColumn("slot", first_bits(F.col("key"), bits)).join(slots.select("slot", "bucket"), "slot").drop("slot"))
    # keys that several texts share are rare; the others are a chain of one
    shared = entries.groupBy("key").agg(F.count("*").alias("texts"), F.sort_array(F.collect_list("sha")).alias("chain")).where("texts > 1").select("key", "chain")
    shared = common.cut(shared)
    shared = F.broadcast(shared) if common.fits_broadcast(shared) else shared
    placed = entries.join(shared, "key", "left").withColumn("chain", F.coalesce(F.array_position("chain", F.col("sha")) - 1, F.lit(0)).cast("int"))
    placed = placed.select("bucket", "key", "chain", "sha", "n_bytes", "keep_id", "copies")
    placed.repartitionByRange("bucket", "key").sortWithinPartitions("bucket", "key", "chain").write.parquet(f"{folder}/buckets")
    return Index(folder)


def look_up(printed: DataFrame, index: Index) -> DataFrame:
    """``doc_id, keep_id, group_size, kept, text_sha256`` of every document of the index, from their ``prints``."""
    rows = printed.select("doc_id", "sha")
    entries = index.entries(printed.sparkSession).select("sha", "keep_id", "copies", F.col("copies").alias("rows"))
    total = entries.agg(F.coalesce(F.sum("rows"), F.lit(0))).first()[0]
    found = common.join_hot(rows, entries, "sha", "rows", total)
    return found.select("doc_id", "keep_id", F.col("copies").alias("group_size"), F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.col("sha").alias("text_sha256"))


def groups(docs: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Index and look-up of the same documents."""
    printed = prints(docs)
    return look_up(printed, build(docs, capacity=capacity, printed=printed))


def dedup(docs: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``docs`` without the rows whose text another row with a smaller doc_id has."""
    entries = build(docs, capacity=capacity).entries(docs.sparkSession)
    sha, keep, rows = (common.unused(docs, c) for c in ("_sha", "_keep", "_rows"))
    kept = entries.where("copies > 1").select(F.col("sha").alias(sha), F.struct(F.col("keep_id").alias("id")).alias(keep), F.col("copies").alias(rows))
    total = kept.agg(F.coalesce(F.sum(rows), F.lit(0))).first()[0]
    x = common.join_hot(docs.withColumn(sha, F.sha2(normal(F.col("text")), 256)), kept, sha, rows, total, "left")
    stays = F.col(keep).isNull() | F.col("doc_id").cast("long").eqNullSafe(F.col(keep)["id"])
    return x.where(stays).select(*docs.columns)
