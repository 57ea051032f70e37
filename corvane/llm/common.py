"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.operators.lineage import cut, reread, shared_folder

__all__ = ["buckets", "cut", "documents", "fits_broadcast", "join_hot", "let", "reread", "shared_folder", "shuffle_partitions", "table", "tune", "unused"]

#: Rows and bytes of an Arrow batch handed to Python. Texts vary from nothing to megabytes, so the
#: byte bound is the one that keeps a worker small; the row bound covers short rows.
BATCH_ROWS = 2_000
BATCH_BYTES = 8 << 20
MOST_BUCKETS = 1_000_000
#: Short rows (some numbers) up to which a frame may be broadcast.
BROADCAST_ROWS = 100_000
#: Keys that are sent to every task at most, and rows from which one is worth it.
HOT_KEYS, HOT_ROWS = 50_000, 256


def tune(spark: SparkSession) -> None:
    """Bound the Arrow batches of a session that doesn't say how large they may be, and let Python workers find this package where the driver has it.

    What the session sets itself stays. Where workers don't have the package (a cluster), it is sent with ``--py-files``.
    """
    root, env = str(Path(__file__).resolve().parents[2]), spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in paths:
        env["PYTHONPATH"] = os.pathsep.join([root, *paths])
    said = spark.conf.getAll
    for k, v in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        if k not in said:
            spark.conf.set(k, v)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fits_broadcast(df: DataFrame, rows: int = BROADCAST_ROWS) -> bool:
    """Whether a frame of short rows is small enough to be sent to every task, by its count."""
    return df.limit(rows + 1).count() <= rows


def join_hot(left: DataFrame, right: DataFrame, key: str, weight: str, total: int, how: str = "inner") -> DataFrame:
    """``left`` with the columns of ``right`` by ``key``, where few keys may hold most of the rows of ``left``.

    ``right`` has a row for each key; its column ``weight`` (left out of the result) says how many rows
    of ``left`` have it, ``total`` in all. Keys of at least ``total / HOT_KEYS`` rows can't be more than
    ``HOT_KEYS``, so they are sent to every task; the others meet in a shuffle.
    """
    least = max(HOT_ROWS, -(-total // HOT_KEYS))
    hot, rest = (right.where(c).drop(weight) for c in (F.col(weight) >= least, F.col(weight) < least))
    return left.join(F.broadcast(hot), key).unionByName(left.join(F.broadcast(hot.select(key)), key, "left_anti").join(rest, key, how))


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def buckets(df: DataFrame, size: int) -> int:
    """Buckets of about ``size`` bytes of the files that are read; as many as shuffle partitions at least, also where the size isn't known."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    known = sum(x for x in (int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size())) if x < 1 << 60)
    return max(shuffle_partitions(df.sparkSession), min(known // size, MOST_BUCKETS))


def documents(df: DataFrame) -> DataFrame:
    """``doc_id``, ``text`` with a null text as the empty one; other columns are left behind."""
    return df.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


def let(value: Column, body) -> Column:
    """``body(value)``, with the value computed once however often the body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def unused(df: DataFrame, name: str) -> str:
    """``name``, or one like it that no column of ``df`` has."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name
