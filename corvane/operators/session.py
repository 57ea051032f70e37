"""A session over a document table: what it has read, what it is to write."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.operators import writes
from corvane.operators.reader import Reader
from corvane.operators.writes import Mode, Op, Role


@dataclass
class Session:
    """Reads through ``reader`` (tracking ``dirty``); writes are queued and applied at once by ``save``.

    The version a document had when the session read it is the one a write expects it to have still.
    A document that the session hasn't read has no expected version, and so matches none. With
    ``checks`` off, versioned upserts become overwrites.
    """

    reader: Reader
    mode: Mode = Mode.OFF
    checks: bool = True
    _read: list[DataFrame] = field(default_factory=list)
    _queued: list[tuple[Role, Op | None, DataFrame]] = field(default_factory=list)

    def load_many(self, ids: list[Any] | DataFrame) -> DataFrame:
        got = self.reader.load_many(ids)
        self._read.append(got)
        return got

    def known(self) -> DataFrame | None:
        """``id, expected``: of each document the version read first."""
        if not self._read or self.mode is not Mode.OPTIMISTIC:
            return None
        turns = [df.select("id", F.struct(F.lit(n).alias("n"), F.col("version")).alias("v")) for n, df in enumerate(self._read)]
        every = turns[0]
        for t in turns[1:]:
            every = every.unionByName(t)
        return every.groupBy("id").agg(F.min("v").alias("v")).select("id", F.col("v.version").alias("expected"))

    def queue(self, op: Op, rows: DataFrame) -> None:
        """``id, data``, with ``new_version`` where optimistic and ``revision`` where numeric."""
        op = Op.OVERWRITE if op is Op.UPSERT and self.mode is not Mode.OFF and not self.checks else op
        self._queued.append((op.role, op, rows))

    def queue_changes(self, after: DataFrame) -> None:
        """What differs from the JSON as it was read."""
        for df in self._read:
            self.queue(Op.UPSERT, after.join(writes.changes(df.select("id", F.col("as_read").alias("data")), after).select("id"), "id", "left_semi"))

    def delete(self, ids: DataFrame) -> None:
        self._queued.append((Role.DELETION, None, ids.select("id")))

    def pending(self) -> list[Role]:
        """What is queued, in the order in which ``save`` carries it out: deletions after all writes."""
        return [role for role, *_ in self._ordered()]

    def _ordered(self) -> list[tuple[Role, Op | None, DataFrame]]:
        return sorted(self._queued, key=lambda q: q[0] is Role.DELETION)

    def save(self, current: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
        """The next table, and the rejections of each queued batch in turn. The queue is empty then."""
        refused, known = [], self.known()
        for role, op, rows in self._ordered():
            if role is Role.DELETION:
                current = writes.hard_delete(current, rows)
                continue
            if self.mode is Mode.OPTIMISTIC:
                rows = rows.join(known, "id", "left") if known is not None else rows.withColumn("expected", F.lit(None).cast("string"))
            plan = writes.plan_write(current, rows.withColumn("op_seq", F.lit(0).cast("long")), op, self.mode)
            current, refused = writes.next_state(plan), [*refused, writes.rejections(plan)]
        self._queued = []
        return current, refused
