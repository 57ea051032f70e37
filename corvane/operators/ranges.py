"""A stored table in ranges of a column whose bounds can be split and merged.

Bounds cut the values into half-open ranges, and a partition of the table holds each; nulls lie with the
lowest. Splitting at a value, or merging at a bound, rewrites the partitions it touches and no other:
the new partitions are written beside the old ones, under names that follow from their bounds, then the
bounds change in one step (a property of the table), then the old partitions go. Readers take only
partitions of the present bounds, so they see the rows before or after, never both. What a driver that
died left is dropped by ``recover``, which every change runs first; a change run again does the same.

Defined results: a split at a bound there is, or a merge at one there isn't, raises; a range without rows
has no partition; bounds compare as the column's type does.
"""

from __future__ import annotations

import base64
import hashlib
import json
import uuid
from collections.abc import Iterable
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.operators.lineage import cut
from corvane.operators.predicate import literal

PROPERTY, PART = "corvane.ranges", "_part"


@dataclass(frozen=True)
class Range:
    """SQL literals; None: no bound."""

    low: str | None
    high: str | None

    @property
    def name(self) -> str:
        return "r" + hashlib.sha256(f"{self.low}\x1f{self.high}".encode()).hexdigest()[:16]

    def holds(self, value: Column) -> Column:
        out = F.lit(True)
        if self.low is not None:
            out &= F.coalesce(value >= F.expr(self.low), F.lit(False))
        if self.high is not None:
            inside = value < F.expr(self.high)
            out &= F.coalesce(inside, F.lit(self.low is None))
        return out


@dataclass(frozen=True)
class RangeTable:
    spark: SparkSession
    table: str
    column: str

    @classmethod
    def create(cls, spark: SparkSession, table: str, columns: str, column: str, bounds: Iterable[Any] = ()) -> RangeTable:
        """``columns`` as in DDL."""
        out = cls(spark, table, column)
        spark.sql(f"CREATE TABLE {table} ({columns}, {PART} STRING) USING parquet PARTITIONED BY ({PART})")
        out._keep(out._sorted([literal(b) for b in bounds]))
        return out

    def _sorted(self, bounds: list[str]) -> list[str]:
        if not bounds:
            return []
        x = self.spark.range(1).select(F.array_sort(F.array(*(F.struct(F.expr(b).alias("v"), F.lit(b).alias("b")) for b in bounds))).alias("x"))
        out = [(r["v"], r["b"]) for r in x.first()["x"]]
        if len({v for v, _ in out}) < len(out):
            raise ValueError("a bound is there")
        return [b for _, b in out]

    def _keep(self, bounds: list[str]) -> None:
        # text of any kind stays out of the parser's reach
        self.spark.sql(f"ALTER TABLE {self.table} SET TBLPROPERTIES ('{PROPERTY}' = '{base64.b64encode(json.dumps(bounds).encode()).decode()}')")

    def bounds(self) -> list[str]:
        said = {r["key"]: r["value"] for r in self.spark.sql(f"SHOW TBLPROPERTIES {self.table}").collect()}
        return json.loads(base64.b64decode(said[PROPERTY]))

    def ranges(self) -> list[Range]:
        b = [None, *self.bounds(), None]
        return [Range(x, y) for x, y in zip(b, b[1:])]

    def insert(self, df: DataFrame) -> None:
        """Append rows, to the partitions of their ranges."""
        part = F.lit(None).cast("string")
        for r in self.ranges():
            part = F.when(r.holds(F.col(self.column)), r.name).otherwise(part)
        df.select(*self._columns()).withColumn(PART, part).write.insertInto(self.table)

    def _columns(self) -> list[str]:
        return [c for c in self.spark.table(self.table).columns if c != PART]

    def rows(self, ranges: list[Range] | None = None) -> DataFrame:
        """All rows, or those of some ranges: only their partitions are read."""
        names = [r.name for r in (self.ranges() if ranges is None else ranges)]
        return self.spark.table(self.table).where(F.col(PART).isin(*names)).drop(PART)

    def partitions(self) -> list[str]:
        return sorted(r[0].split("=", 1)[1] for r in self.spark.sql(f"SHOW PARTITIONS {self.table}").collect())

    def recover(self) -> list[str]:
        """Drop the partitions of no range; their names."""
        left = sorted(set(self.partitions()) - {r.name for r in self.ranges()})
        for p in left:
            self.spark.sql(f"ALTER TABLE {self.table} DROP IF EXISTS PARTITION ({PART} = '{p}')")
        return left

    def _change(self, old: list[Range], new: list[Range], bounds: list[str]) -> None:
        rows, view = cut(self.rows(old)), f"_ranges_{uuid.uuid4().hex}"
        for r in new:
            rows.where(r.holds(F.col(self.column))).createOrReplaceTempView(view)
            columns = ", ".join(f"`{c}`" for c in self._columns())
            self.spark.sql(f"INSERT OVERWRITE TABLE {self.table} PARTITION ({PART} = '{r.name}') SELECT {columns} FROM {view}")
        self.spark.catalog.dropTempView(view)
        self._keep(bounds)
        self.recover()

    def split(self, at: Any) -> None:
        """A new bound; the range that holds it becomes two."""
        self.recover()
        before, now = self.ranges(), self._sorted([*self.bounds(), literal(at)])
        b = [None, *now, None]
        after = [Range(x, y) for x, y in zip(b, b[1:])]
        self._change([r for r in before if r not in after], [r for r in after if r not in before], now)

    def merge(self, at: Any) -> None:
        """A bound less; the ranges on either side become one."""
        self.recover()
        bounds, gone = self.bounds(), literal(at)
        same = [r[0] for r in self.spark.range(1).select(F.explode(F.array(*(F.when(F.expr(b) == F.expr(gone), b) for b in bounds)))).collect() if r[0] is not None] if bounds else []
        if not same:
            raise ValueError(f"{gone} is no bound")
        i = bounds.index(same[0])
        b = [None, *bounds, None]
        self._change([Range(b[i], b[i + 1]), Range(b[i + 1], b[i + 2])], [Range(b[i], b[i + 2])], bounds[:i] + bounds[i + 1 :])
