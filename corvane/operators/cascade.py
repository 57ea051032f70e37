"""Deletes and changes of keys that follow foreign keys, as a fixpoint of semi joins.

``delete`` takes rows to delete by table and the keys between the tables. Rows that refer to a deleted one
through a CASCADE key are deleted too, and so on, through references of a table to itself and through
cycles, until nothing is added. In each turn only the keys deleted in the turn before travel, so a turn
costs a semi join for each key that they meet; the number of turns is the longest chain of references.
Every turn's keys are written once, and later turns read the files: a checkpoint would carry what is known of
its rows' values on into the plans of all later turns, and that doubles with each. References may crowd on few keys: the
joins' left sides are the rows that refer, whose crowded parts adaptive execution splits, and the right sides hold a key once.
Keys of a large table are made distinct in as many tasks as it has ``PART`` bytes, so that no task's table of keys grows with it.

Of rows that aren't deleted, SET NULL and SET DEFAULT keys lose their reference. RESTRICT refuses a
delete that any row refers to, even one that goes too; NO ACTION refuses what still dangles in the end.
A default that isn't there in the table referred to is refused like NO ACTION. ``refused`` holds what was;
``result`` raises if there is any, since the statement fails as a whole.

``update`` changes keys: CASCADE writes the new key into the rows that refer, whose own key may be part
of it and travels on; the other actions are those of ``delete``.

Defined results: a null in a reference refers to nothing; a table's key must be unique and not null (rows
where it isn't are deleted together); a reference whose target never was stays; an empty set of rows to
delete leaves all as it is.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.operators.lineage import cut, written
from corvane.sources.schema import Cascade, ForeignKey

#: Bytes of a table's files whose keys a task makes distinct.
PART = 16 << 20


class Refused(RuntimeError):
    """A delete or change of keys that a foreign key doesn't allow."""


@dataclass(frozen=True)
class Entity:
    """Rows, their key and the keys by which they refer to others. ``defaults``: SQL by column, NULL where not given."""

    rows: DataFrame
    key: tuple[str, ...]
    refers: tuple[ForeignKey, ...] = ()
    defaults: dict[str, str] = field(default_factory=dict)


@dataclass(frozen=True)
class Outcome:
    """``deleted``: keys by table; ``refused``: ``constraint, child, key`` (the key of the row that refers, as JSON)."""

    entities: dict[str, Entity]
    deleted: dict[str, DataFrame]
    refused: DataFrame
    remaining: dict[str, DataFrame]

    def result(self) -> dict[str, DataFrame]:
        """The tables after the statement; raises if a key refuses it."""
        if some := self.refused.limit(5).collect():
            raise Refused("; ".join(f"{r['constraint']}: {r['child']} {r['key']}" for r in some))
        return self.remaining


def _linked(e: Entity, keys: DataFrame, k: ForeignKey) -> DataFrame:
    """What rows with these keys are referred to by, under the names of the columns that refer."""
    if set(k.linked) <= set(e.key):
        x = keys
    else:
        x = e.rows.join(keys, list(e.key), "left_semi")
    return x.select(*(F.col(p).alias(c) for c, p in zip(k.columns, k.linked, strict=True))).dropna().distinct()


def once(keys: DataFrame, rows: DataFrame) -> DataFrame:
    """Different ``keys``, which come from ``rows``; from a large table dealt out first, since nearly all are different and a task would gather those of its whole split."""
    leaves = rows._jdf.queryExecution().optimizedPlan().collectLeaves()
    size = sum(x for x in (int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size())) if x < 1 << 60)
    return keys.distinct() if size < 4 * PART else keys.repartition(size // PART, *keys.columns).distinct()


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def _named(e: Entity, name: str, k: ForeignKey, rows: DataFrame) -> DataFrame:
    return rows.select(F.lit(k.name).alias("constraint"), F.lit(name).alias("child"), F.to_json(F.struct(*e.key)).alias("key"))


def reached(entities: dict[str, Entity], start: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """By table, the keys of the rows that a delete of ``start`` (keys by table) takes along."""
    spark = next(iter(entities.values())).rows.sparkSession
    folders: dict[str, list[str]] = {}

    def kept(t: str, keys: DataFrame) -> DataFrame:
        folder = written(keys)
        folders.setdefault(t, []).append(folder)
        return spark.read.schema(keys.schema).parquet(folder)

    all_of = lambda t: spark.read.schema(entities[t].rows.select(*entities[t].key).schema).parquet(*folders[t])
    new = {t: kept(t, once(entities[t].rows.select(*entities[t].key).join(keys.select(*entities[t].key), list(entities[t].key), "left_semi"), entities[t].rows)) for t, keys in start.items()}
    while new:
        met: dict[str, list[DataFrame]] = {}
        for child, e in entities.items():
            for k in e.refers:
                if k.on_delete == Cascade.CASCADE.name and k.table in new:
                    hit = e.rows.join(_linked(entities[k.table], new[k.table], k), list(k.columns), "left_semi")
                    met.setdefault(child, []).append(hit.select(*e.key))
        new = {}
        for child, parts in met.items():
            key = list(entities[child].key)
            x = _union(parts)
            x = kept(child, once(x.join(all_of(child), key, "left_anti") if child in folders else x, entities[child].rows))
            if not x.isEmpty():
                new[child] = x
    return {t: all_of(t) for t in folders}


def _without(e: Entity, gone: DataFrame | None) -> DataFrame:
    return e.rows if gone is None else e.rows.join(gone, list(e.key), "left_anti")


def delete(entities: dict[str, Entity], start: dict[str, DataFrame]) -> Outcome:
    """``start``: the rows to delete, by table (their keys at least)."""
    gone = reached(entities, start)
    none = next(iter(entities.values())).rows.sparkSession.createDataFrame([], "constraint string, child string, key string")
    refused = [none]
    left = {}
    for name, e in entities.items():
        rows = _without(e, gone.get(name))
        for k in e.refers:
            if k.table not in gone:
                continue
            dead, cols = _linked(entities[k.table], gone[k.table], k), list(k.columns)
            if k.on_delete == Cascade.RESTRICT.name:
                refused.append(_named(e, name, k, e.rows.join(dead, cols, "left_semi")))
            elif k.on_delete == Cascade.NO_ACTION.name:
                refused.append(_named(e, name, k, rows.join(dead, cols, "left_semi")))
            elif k.on_delete in (Cascade.SET_NULL.name, Cascade.SET_DEFAULT.name):
                rows, bad = _reset(entities, name, k, rows, dead, k.on_delete, gone)
                refused += bad
        left[name] = rows
    return Outcome(entities, gone, _union(refused), left)


def _reset(entities: dict[str, Entity], name: str, k: ForeignKey, rows: DataFrame, dead: DataFrame, action: str, gone: dict[str, DataFrame]) -> tuple[DataFrame, list[DataFrame]]:
    """``rows`` with the reference taken from those that refer to ``dead``, and what a default that isn't there refuses."""
    e, columns = entities[name], rows.columns
    default = lambda c: F.expr(e.defaults.get(c, "NULL") if action == Cascade.SET_DEFAULT.name else "NULL")
    x = rows.join(dead.withColumn("_dead", F.lit(True)), list(k.columns), "left")
    x = x.withColumns({c: F.when(F.col("_dead"), default(c)).otherwise(F.col(c)).cast(rows.schema[c].dataType) for c in k.columns})
    bad = []
    if action == Cascade.SET_DEFAULT.name:
        parent = _without(entities[k.table], gone.get(k.table)).select(*(F.col(p).alias(c) for c, p in zip(k.columns, k.linked, strict=True))).distinct()
        bad.append(_named(e, name, k, x.where("_dead").dropna(subset=list(k.columns)).join(parent, list(k.columns), "left_anti")))
    return x.select(*columns), bad


def update(entities: dict[str, Entity], changes: dict[str, DataFrame]) -> Outcome:
    """``changes``: by table, its key and under ``new_<column>`` the key's new value. A table changes its key at most once on each way."""
    none = next(iter(entities.values())).rows.sparkSession.createDataFrame([], "constraint string, child string, key string")
    refused, left = [none], {n: e.rows for n, e in entities.items()}
    moved = {t: cut(x) for t, x in changes.items()}
    turn, seen = dict(moved), 0
    while turn:
        if (seen := seen + 1) > len(entities) + 1:
            raise Refused("a changed key comes back to a table that it left")
        nxt: dict[str, list[DataFrame]] = {}
        for child, e in entities.items():
            for k in e.refers:
                # a key that holds other columns of its table doesn't change
                if k.table not in turn or not set(k.linked) <= set(entities[k.table].key):
                    continue
                pairs = zip(k.columns, k.linked, strict=True)
                new = turn[k.table].select(*(F.col(p).alias(c) for c, p in pairs), *(F.col(f"new_{p}").alias(f"new_{c}") for c, p in zip(k.columns, k.linked, strict=True))).distinct()
                cols = list(k.columns)
                if k.on_update in (Cascade.RESTRICT.name, Cascade.NO_ACTION.name):
                    refused.append(_named(e, child, k, e.rows.join(new, cols, "left_semi")))
                elif k.on_update == Cascade.CASCADE.name:
                    # the way to a row goes by its old reference; what else of it changes is left
                    if own := [c for c in e.key if c in cols]:
                        x = e.rows.join(new, cols).select(*e.key, *((F.col(f"new_{c}") if c in own else F.col(c)).alias(f"new_{c}") for c in e.key))
                        nxt.setdefault(child, []).append(x)
                    columns = left[child].columns
                    x = left[child].join(new.withColumn("_hit", F.lit(True)), cols, "left")
                    left[child] = cut(x.withColumns({c: F.when(F.col("_hit"), F.col(f"new_{c}")).otherwise(F.col(c)) for c in cols}).select(*columns))
                else:
                    left[child], bad = _reset(entities, child, k, left[child], new.select(*cols), k.on_update, {})
                    refused += bad
        turn = {c: x for c, parts in nxt.items() if not (x := cut(_union(parts).distinct())).isEmpty()}
    for t, x in moved.items():
        key, columns = list(entities[t].key), left[t].columns
        y = left[t].join(x.withColumn("_hit", F.lit(True)), key, "left")
        left[t] = y.withColumns({c: F.when(F.col("_hit"), F.col(f"new_{c}")).otherwise(F.col(c)) for c in key}).select(*columns)
    return Outcome(entities, {}, _union(refused), left)
