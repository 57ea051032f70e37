"""An append-only event store: planned appends with version checks, and a streaming sink.

Streams are ``tenant_id, stream_id, version, archived``; events are in the order ``data, type, id,
stream_id, version, timestamp, tenant_id, seq_id`` and optional metadata.
"""

from __future__ import annotations

from enum import Enum

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from corvane.operators.ordering import dense_index

KEY = ["tenant_id", "stream_id"]
EXISTS, WRONG_VERSION, ZERO_VERSION = "stream exists", "wrong version", "version 0"


class Append(Enum):
    """RICH: every value is bound by the caller. QUICK: versions and sequence come from the store. SERVER_TIME: the timestamp too."""

    RICH, QUICK, SERVER_TIME = range(3)


def plan_append(streams: DataFrame, events: DataFrame, mode: Append = Append.QUICK, first_seq: int = 1, order: str = "op_seq", now: Column | None = None) -> DataFrame:
    """Events as they are stored. Versions follow a stream's current one in the order of ``op_seq``; sequence numbers are dense.

    Versions come from places in the order of all streams, less the place of a stream's first event: a stream
    that holds a third of the events is spread over tasks like the rest.
    """
    if mode is Append.RICH:
        return events
    now = F.current_timestamp() if now is None else now
    placed = dense_index(events, KEY[0], KEY[1], order, name="_g")
    held = streams.select(*KEY, F.col("version").alias("_v"))
    first = placed.groupBy(*KEY).agg(F.min("_g").alias("_first")).join(held, KEY, "left")
    first = first.select(*(F.col(k).alias(f"_{k}") for k in KEY), (F.coalesce("_v", F.lit(0)) - F.col("_first")).alias("_base"))
    x = placed.join(first, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in KEY])
    x = x.withColumn("version", (F.col("_base") + F.col("_g") + 1).cast("long")).select(*events.columns, "version")
    if mode is Append.SERVER_TIME:
        x = x.withColumn("timestamp", now)
    x = dense_index(x, order, name="seq_id")
    return x.withColumn("seq_id", F.col("seq_id") + first_seq)


#: Optional columns of an event, after those that every event has.
OPTIONAL = {"causation_id": "string", "correlation_id": "string", "headers": "string", "user_name": "string", "seq_id": "bigint"}
FIXED = {"data": "string", "type": "string", "id": "string", "stream_id": "string", "version": "bigint", "timestamp": "timestamp", "tenant_id": "string"}


def laid_out(events: DataFrame, optional: tuple[str, ...] = ()) -> DataFrame:
    """Columns in the order they are stored in; what an event doesn't have is null."""
    kinds = FIXED | {c: OPTIONAL[c] for c in OPTIONAL if c in optional}
    return events.select(*((F.col(c) if c in events.columns else F.lit(None)).cast(k).alias(c) for c, k in kinds.items()))


def refused_zero(events: DataFrame) -> DataFrame:
    """Bound events whose version is 0 or null; they can't be appended."""
    return events.where(F.coalesce("version", F.lit(0)) == 0).withColumn("reason", F.lit(ZERO_VERSION))


def advanced(streams: DataFrame, stored: DataFrame) -> DataFrame:
    """The streams after an append."""
    top = stored.groupBy(*KEY).agg(F.max("version").alias("_top"))
    x = streams.join(top, KEY, "full_outer")
    return x.select(*KEY, F.coalesce("_top", "version").alias("version"), F.coalesce("archived", F.lit(False)).alias("archived"))


def start_streams(streams: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """New streams that are accepted, and those that exist."""
    return new.join(streams, KEY, "left_anti"), new.join(streams, KEY, "left_semi").withColumn("reason", F.lit(EXISTS))


def wrong_versions(streams: DataFrame, expected: DataFrame) -> DataFrame:
    """``KEY, expected, actual`` where a stream isn't at the version expected of it. A stream that isn't there fails whatever is expected; its version is 0."""
    x = expected.join(streams.select(*KEY, "version"), KEY, "left")
    return x.where(F.col("version").isNull() | (F.col("version") != F.col("expected"))).select(*KEY, "expected", F.coalesce("version", F.lit(0)).alias("actual"))


def update_versions(streams: DataFrame, changes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Streams with ``changes`` (``KEY, expected, new``) applied where the version is as expected, and the changes that weren't."""
    x = streams.join(changes, KEY, "left")
    hit = F.col("version") == F.col("expected")
    after = x.select(*KEY, F.when(hit, F.col("new")).otherwise(F.col("version")).alias("version"), "archived")
    return after, wrong_versions(streams, changes)


def archive(streams: DataFrame, ids: DataFrame) -> DataFrame:
    hit = ids.select(*KEY).distinct().withColumn("_hit", F.lit(True))
    return streams.join(hit, KEY, "left").withColumn("archived", F.coalesce("_hit", "archived", F.lit(False))).drop("_hit")


def tombstone(streams: DataFrame, events: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Streams and events without the ones named."""
    return tuple(x.join(ids.select(*KEY), KEY, "left_anti") for x in (streams, events))


def progress(marks: DataFrame, seen: DataFrame) -> DataFrame:
    """``shard, last_seq`` after events with ``shard, seq_id`` were handled; marks never go back."""
    new = seen.groupBy("shard").agg(F.max("seq_id").alias("last_seq"))
    return marks.select("shard", "last_seq").unionByName(new).groupBy("shard").agg(F.max("last_seq").alias("last_seq"))


#: Batches between two tables of all streams.
COMPACTED = 32


def sink(stream: DataFrame, path: str, checkpoint: str, order: str = "op_seq") -> DataStreamWriter:
    """Append a stream of events to a store at ``path``; each micro-batch is a folder of its own, so a replayed batch replaces itself.

    Versions continue from what earlier batches stored. What they stored is one table of all streams,
    written anew every ``COMPACTED`` batches, and the streams of each batch since: a batch reads as
    much after a million others as after a few. Batches count from 0 on, as those of one checkpoint do.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        whole = max(0, batch_id - 1) // COMPACTED * COMPACTED  # the last batch before this one that wrote the table of all streams
        kept = [f"{path}/all_streams/batch={whole}"] * bool(whole) + [f"{path}/streams/batch={i}" for i in range(whole + bool(whole), batch_id)]
        streams = spark.createDataFrame([], "tenant_id string, stream_id string, version long")
        last = 0
        if batch_id:
            streams = spark.read.parquet(*kept).groupBy(*KEY).agg(F.max("version").alias("version"))
            last = spark.read.parquet(f"{path}/marks/batch={batch_id - 1}").first()[0]
        out = f"batch={batch_id}"
        plan_append(streams, batch, Append.QUICK, last + 1, order).write.mode("overwrite").parquet(f"{path}/events/{out}")
        stored = spark.read.parquet(f"{path}/events/{out}")
        tops = stored.groupBy(*KEY).agg(F.max("version").alias("version"))
        tops.write.mode("overwrite").parquet(f"{path}/streams/{out}")
        if batch_id and batch_id % COMPACTED == 0:
            streams.unionByName(tops).groupBy(*KEY).agg(F.max("version").alias("version")).write.mode("overwrite").parquet(f"{path}/all_streams/{out}")
        stored.agg(F.coalesce(F.max("seq_id"), F.lit(last)).alias("last_seq")).write.mode("overwrite").parquet(f"{path}/marks/{out}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
