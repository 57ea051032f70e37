"""Appends to event streams as a stateful stream: each stream's version is a value of the state store.

Appends come as rows ``tenant_id, stream_id, op_seq`` with what an event holds, and optionally ``expected``: the
version that its stream must have for it (0: a stream that isn't there; null: whatever it is). A stream's
appends are judged in the order of ``op_seq`` within a micro-batch, batch after batch; what is accepted gets
the next version, what isn't a reason. State begins from a table of streams (``tenant_id, stream_id,
version``), and what it holds is one number a stream, however long the stream is.

A task takes the appends of one stream in one micro-batch together, to order them: bound micro-batches by
the source's own settings (files or bytes a trigger).

Defined results: a refused append changes nothing; later ones of its batch are judged as if it hadn't come;
appends of equal ``op_seq`` go by their event ``id``; a null tenant or stream is a stream of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from corvane.streaming.events import EXISTS, KEY, WRONG_VERSION

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Versions(StatefulProcessor):
    def init(self, handle: StatefulProcessorHandle) -> None:
        self.version = handle.getValueState("version", T.StructType([T.StructField("version", T.LongType())]))

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:  # noqa: N802, N803 (names of the interface)
        self.version.update((int(initialState["version"].max()),))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        now = self.version.get()[0] if self.version.exists() else 0
        was = now
        batch = pd.concat(list(rows)).sort_values(["op_seq", "id"], kind="stable")
        versions, reasons = [], []
        for expected in batch["expected"]:
            if pd.isna(expected) or int(expected) == now:
                now += 1
                versions.append(now)
                reasons.append(None)
            else:
                versions.append(None)
                reasons.append(EXISTS if int(expected) == 0 else WRONG_VERSION)
        if now != was:
            self.version.update((now,))
        yield batch.assign(version=pd.array(versions, dtype="Int64"), reason=pd.array(reasons, dtype=object), expected=batch["expected"].astype("Int64"))

    def close(self) -> None:
        pass


def judged(appends: DataFrame, streams: DataFrame | None = None) -> DataFrame:
    """The appends (a stream) with ``version`` and ``reason``, of which one is null. ``streams``: where versions begin."""
    appends.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    x = appends if "expected" in appends.columns else appends.withColumn("expected", F.lit(None).cast("long"))
    x = x.withColumn("expected", F.col("expected").cast("long"))
    schema = T.StructType([*x.schema.fields, T.StructField("version", T.LongType()), T.StructField("reason", T.StringType())])
    initial = None if streams is None else streams.select(*KEY, F.col("version").cast("long").alias("version")).groupBy(*KEY)
    return x.groupBy(*KEY).transformWithStateInPandas(Versions(), schema, "append", "none", initialState=initial)


def accepted(df: DataFrame) -> DataFrame:
    return df.where("reason IS NULL").drop("expected", "reason")


def refused(df: DataFrame) -> DataFrame:
    return df.where("reason IS NOT NULL").drop("version")
