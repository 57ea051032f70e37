"""Rows written once and read again, where recomputing them would cost or change them."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in ``spark.checkpoint.dir``.

    Only on one machine (tests) is a local one made where none is set; on a cluster that raises, for
    executors would write where no other one reads.
    """
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named is None and sc.getCheckpointDir() is None:
        if not re.fullmatch(r"local(\[.*\])?", sc.master):  # local-cluster has executors of its own
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="shared"))
    return named or sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the reliable checkpoint folder and go on from there."""
    folder = shared_folder(df.sparkSession)
    if df.sparkSession.sparkContext.getCheckpointDir() is None:
        df.sparkSession.sparkContext.setCheckpointDir(folder)
    return df.checkpoint(eager=True)


def written(df: DataFrame, **options: str) -> str:
    """A new folder in the shared one with the rows of ``df``, as Parquet."""
    out = f"{shared_folder(df.sparkSession)}/rows-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(out)
    return out


@contextmanager
def passing_shuffles(spark: SparkSession) -> Iterator[None]:
    """What frames that are made and written in here shuffle leaves the disks when the write has ended."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    was = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.unset(key) if was is None else spark.conf.set(key, was)


def reread(df: DataFrame) -> DataFrame:
    """The rows of ``df`` from Parquet in the shared folder, compressed; what was shuffled for them is dropped."""
    spark = df.sparkSession
    with passing_shuffles(spark):
        return spark.read.schema(df.schema).parquet(written(df, compression="zstd"))


def bucketed(turns: Iterable[DataFrame], buckets: int, *keys: str) -> DataFrame:
    """The rows of all frames as ``reread`` gives them, in buckets by hash of ``keys``: a join on just these moves only its other side.

    The frames are written one after the other, so what one shuffled is dropped before the next. Each should be dealt out in the same way.
    """
    name = f"rows_{uuid.uuid4().hex}"
    for df in turns:
        spark = df.sparkSession
        with passing_shuffles(spark):
            out = df.write.mode("append").bucketBy(buckets, *keys).options(compression="zstd", path=f"{shared_folder(spark)}/{name}")
            out.saveAsTable(name)
    rows = spark.table(name)
    spark.sql(f"DROP TABLE {name}")  # the name only; the files stay
    return rows


def shared_path(spark: SparkSession, kind: str) -> str:
    """A new folder in the shared one as a path of the file system, for what needs links or a library's own files; raises where it is in another store."""
    folder = re.sub(r"^file:/+", "/", shared_folder(spark))
    if not folder.startswith("/"):
        raise ValueError(f"{folder} is no path of the file system")
    out = os.path.join(folder, f"{kind}-{uuid.uuid4().hex}")
    os.makedirs(out)
    return out
