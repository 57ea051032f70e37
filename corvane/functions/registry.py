"""User functions: registration of scalar and aggregate ones, and the calls of both."""

from __future__ import annotations

import inspect
import pickle
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from corvane.operators.lineage import cut

MOST_ARGUMENTS = 4
#: Values of a group that one task folds, and partial results that one task merges.
PART_ROWS = 100_000
#: States of a Python fold that a task holds, and that one task merges of a group.
HELD_STATES, MERGED_STATES = 100_000, 1_000


@dataclass(frozen=True)
class Scalar:
    """A function of up to four values. Where SQL can say it, ``sql`` does (with the parameters' names) and no Python runs."""

    name: str
    returns: str
    body: Callable[..., Any] | None = None
    sql: str | None = None
    parameters: tuple[tuple[str, str], ...] = ()
    deterministic: bool = True

    def register(self, spark: SparkSession) -> None:
        if self.sql is not None:
            args = ", ".join(f"{n} {t}" for n, t in self.parameters)
            sure = "" if self.deterministic else "NOT DETERMINISTIC "
            spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {self.name}({args}) RETURNS {self.returns} {sure}RETURN {self.sql}")
            return
        if len(inspect.signature(self.body).parameters) > MOST_ARGUMENTS:
            raise ValueError(f"{self.name} takes more than {MOST_ARGUMENTS} arguments")
        f = F.udf(self.body, self.returns, useArrow=True)
        spark.udf.register(self.name, f if self.deterministic else f.asNondeterministic())


@dataclass(frozen=True)
class Fold:
    """An aggregate: a seed, a step and an optional finish, all over columns, so that it runs in the JVM.

    Called, it folds a group's values in the order given, which gathers the group. With a ``merge`` of
    two partial results (for folds whose order doesn't matter), ``over`` folds parts of a group of
    ``PART_ROWS`` values by themselves and then the parts, as many as it takes, level by level.
    """

    name: str
    seed: Column
    step: Callable[[Column, Column], Column]
    finish: Callable[[Column], Column] | None = None
    merge: Callable[[Column, Column], Column] | None = None

    def __call__(self, value: str, *order: str) -> Column:
        xs = F.transform(F.array_sort(F.collect_list(F.struct(*order, F.col(value).alias("_x")))), lambda s: s["_x"])
        return F.aggregate(xs, self.seed, self.step, self.finish) if self.finish else F.aggregate(xs, self.seed, self.step)

    def over(self, df: DataFrame, keys: list[str], value: str, rows: list[str], name: str) -> DataFrame:
        """``keys, name`` by groups of any size. ``rows``: columns that tell rows apart, which deal them out."""
        if self.merge is None:
            raise ValueError(f"{self.name} has no merge, so a group can't be folded in parts")
        n = df.groupBy(*keys).count().agg(F.max("count")).first()[0] or 0
        parts = -(-n // PART_ROWS)
        deal = lambda m: F.pmod(F.xxhash64(*rows), F.lit(m)) if m > 1 else F.lit(0).cast("long")
        x = df.withColumn("_part", deal(parts)).groupBy(*keys, "_part").agg(F.aggregate(F.collect_list(value), self.seed, self.step).alias("_got"))
        while parts > 1:
            parts = -(-parts // PART_ROWS)
            x = x.groupBy(*keys, F.pmod("_part", F.lit(parts)).alias("_part")).agg(F.collect_list("_got").alias("_all"))
            some = F.aggregate(F.slice("_all", F.lit(2), F.size("_all")), F.element_at("_all", 1), self.merge)
            x = x.select(*keys, "_part", some.alias("_got"))
        return x.select(*keys, (self.finish(F.col("_got")) if self.finish else F.col("_got")).alias(name))


@dataclass(frozen=True)
class PythonFold:
    """An aggregate whose step only Python can do.

    With a ``merge`` of two states, ``over`` takes groups of any size: each task folds what it has of a
    group into one state, and states, pickled, are shuffled and merged, as many levels as it takes; so a
    group that holds a third of the rows leaves each task as one row. The order of values must not
    matter, and a merge may change its first state. Registered for SQL, it is a grouped Pandas UDF, which
    gathers a group's values.
    """

    name: str
    returns: str
    seed: Any
    step: Callable[[Any, Any], Any]
    finish: Callable[[Any], Any] | None = None
    merge: Callable[[Any, Any], Any] | None = None

    def over(self, df: DataFrame, keys: list[str], value: str, name: str) -> DataFrame:
        """``keys, name``. Nulls reach the step as None; a group's result is null where ``finish`` gives None."""
        if self.merge is None:
            raise ValueError(f"{self.name} has no merge, so a group can't be folded in parts")
        seed, step, merge, finish = pickle.dumps(self.seed), self.step, self.merge, self.finish
        fields = {k: df.schema[k].dataType.simpleString() for k in keys}
        schema = ", ".join(f"`{k}` {t}" for k, t in fields.items())

        def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: dict[tuple, Any] = {}
            kinds: list[pa.DataType] = []

            def out() -> pa.RecordBatch:
                columns = [pa.array([k[i] for k in held], t) for i, t in enumerate(kinds)]
                states = pa.array([pickle.dumps(s) for s in held.values()], pa.binary())
                held.clear()
                return pa.RecordBatch.from_arrays([*columns, states], [*keys, "_state"])

            for batch in batches:
                kinds = [f.type for f in batch.schema][:-1]
                columns = [c.to_pylist() for c in batch.columns]
                for *key, x in zip(*columns, strict=True):
                    k = tuple(key)
                    held[k] = step(held[k] if k in held else pickle.loads(seed), x)
                if len(held) > HELD_STATES:
                    yield out()
            if held:
                yield out()

        def merged(t: pa.Table) -> pa.Table:
            state = None
            for i, blob in enumerate(t.column("_state")):
                other = pickle.loads(blob.as_py())
                state = merge(state, other) if i else other
            return pa.Table.from_arrays([*(t.column(k).slice(0, 1) for k in keys), pa.array([pickle.dumps(state)], pa.binary())], [*keys, "_state"])

        def finished(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                states = [pickle.loads(s.as_py()) for s in batch.column(len(keys))]
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array([finish(s) if finish else s for s in states], kind)], [*keys, name])

        kind = to_arrow_type(returning(self.returns))
        states = cut(df.select(*keys, value).mapInArrow(fold, f"{schema}, _state binary"))
        n = states.groupBy(*keys).count().agg(F.max("count")).first()[0] or 0
        while n > 1:
            parts = -(-n // MERGED_STATES)
            part = F.pmod(F.monotonically_increasing_id(), F.lit(parts)) if parts > 1 else F.lit(0)
            states = cut(states.withColumn("_part", part)) if parts > 1 else states.withColumn("_part", part)
            states = states.groupBy(*keys, "_part").applyInArrow(merged, f"{schema}, _state binary")
            n = parts if parts > 1 else 0
        return states.mapInArrow(finished, f"{schema}, `{name}` {self.returns}")

    def register(self, spark: SparkSession) -> None:
        import pandas as pd

        seed, step, finish = self.seed, self.step, self.finish

        def fold(xs: pd.Series):
            out = seed
            for x in xs:
                out = step(out, None if pd.isna(x) else x)
            return finish(out) if finish else out

        fold.__annotations__ = {"xs": pd.Series, "return": {"string": str}.get(self.returns, float if self.returns in ("double", "float") else int)}
        spark.udf.register(self.name, F.pandas_udf(fold, self.returns))


class Registry:
    """Functions to register with sessions; a name is held once, whatever its case."""

    def __init__(self) -> None:
        self._held: dict[str, Scalar | PythonFold | Fold] = {}

    def add(self, f: Scalar | PythonFold | Fold) -> Registry:
        if f.name.lower() in self._held:
            raise ValueError(f"{f.name} is registered")
        self._held[f.name.lower()] = f
        return self

    def __len__(self) -> int:
        return len(self._held)

    def __getitem__(self, name: str) -> Scalar | PythonFold | Fold:
        return self._held[name.lower()]

    def clear(self) -> None:
        self._held.clear()

    def register_all(self, spark: SparkSession) -> None:
        for f in self._held.values():
            if not isinstance(f, Fold):
                f.register(spark)


def call(name: str, *args: Column) -> Column:
    return F.call_function(name, *args)


def stored(spark: SparkSession, name: str, parameters: str, returns: str, body: str) -> None:
    """A stored SQL function of the catalog; replaced only where its text differs is up to the caller (see sources.schema.text_differs)."""
    spark.sql(f"CREATE OR REPLACE FUNCTION {name}({parameters}) RETURNS {returns} RETURN {body}")


def returning(t: str) -> T.DataType:
    return T._parse_datatype_string(t)
