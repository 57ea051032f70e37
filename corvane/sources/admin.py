"""Databases, settings, locks and commands around the stores of a catalog."""

from __future__ import annotations

import argparse
import importlib
import json
from collections import defaultdict
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from corvane.sources import schema as S
from corvane.sources.locks import HiLo, Locked, Lost, Sequence, lock
from corvane.sources.names import delimited, quoted

__all__ = ["Database", "Databases", "HiLo", "Locked", "Lost", "MultiReader", "Sequence", "Settings", "Specification", "by_server", "lock", "main"]


@dataclass(frozen=True)
class Settings:
    """Session settings, applied together and read back."""

    values: dict[str, str] = field(default_factory=dict)

    def apply(self, spark: SparkSession) -> None:
        for k, v in self.values.items():
            spark.conf.set(k, v)

    def read(self, spark: SparkSession) -> dict[str, str | None]:
        return {k: spark.conf.get(k, None) for k in self.values}


@dataclass(frozen=True)
class Database:
    """A database by name, with where its tables lie and what is said of it."""

    name: str
    location: str | None = None
    comment: str | None = None

    def create(self) -> str:
        tail = (f" COMMENT {quoted(self.comment)}" if self.comment else "") + (f" LOCATION {quoted(self.location)}" if self.location else "")
        return f"CREATE DATABASE IF NOT EXISTS {delimited(self.name)}{tail}"


class Databases:
    """The databases of one catalog; each is made when it is first asked for."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self._known: dict[str, Database] = {}

    def exists(self, name: str) -> bool:
        return self.spark.catalog.databaseExists(name)

    def names(self) -> list[str]:
        return [d.name for d in self.spark.catalog.listDatabases()]

    def find_or_create(self, db: Database) -> Database:
        if db.name not in self._known:
            self.spark.sql(db.create())
            self._known[db.name] = db
        return self._known[db.name]

    def drop(self, name: str) -> None:
        self._known.pop(name, None)
        S.drop_schema(self.spark, name)


@dataclass(frozen=True)
class Specification:
    """What a database is to be: itself, its stores of tables, and the server (a catalog's name) it lies on."""

    database: Database
    stores: tuple[S.Store, ...] = ()
    server: str = "spark_catalog"

    def ensure(self, databases: Databases) -> list[S.Difference]:
        """The database and all its tables; what each store had to change."""
        databases.find_or_create(self.database)
        return [s.apply() for s in self.stores]


def by_server(specifications: list[Specification]) -> dict[str, list[Specification]]:
    """Specifications by the server they lie on; two of one name on one server are refused."""
    out: dict[str, list[Specification]] = defaultdict(list)
    for s in specifications:
        if any(x.database.name.lower() == s.database.name.lower() for x in out[s.server]):
            raise ValueError(f"{s.database.name} is on {s.server} already")
        out[s.server].append(s)
    return dict(out)


class MultiReader:
    """Several results read one after the other, each by a command of its own; none runs before it is reached."""

    def __init__(self, frames: list[DataFrame]):
        self._frames, self._at = frames, 0

    def next_result(self) -> bool:
        self._at += 1
        return self._at < len(self._frames)

    def rows(self) -> Iterator:
        """Rows of the current result, by partition."""
        return self._frames[self._at].toLocalIterator()


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    """``apply``, ``assert``, ``dump``, ``patch`` or ``list`` the stores of ``module:function``.

    The function takes a session and returns stores by name. ``--parallel`` works on up to so many
    databases at once; stores of one database follow one another.
    """
    p = argparse.ArgumentParser(prog="corvane")
    p.add_argument("command", choices=["apply", "assert", "dump", "patch", "list"])
    p.add_argument("source", help="module:function")
    p.add_argument("--store", action="append", help="only these")
    p.add_argument("--out", type=Path, default=Path("."))
    p.add_argument("--parallel", type=int, default=1)
    a = p.parse_args(argv)
    module, _, function = a.source.partition(":")
    spark = spark or SparkSession.builder.getOrCreate()
    stores: dict[str, S.Store] = {k: v for k, v in getattr(importlib.import_module(module), function)(spark).items() if not a.store or k in a.store}
    by_database = defaultdict(list)
    for name, store in stores.items():
        by_database[min((t.schema for t in store.tables.values()), default="")].append((name, store))

    def work(group: list[tuple[str, S.Store]]) -> list[tuple[str, str, bool]]:
        out = []
        for name, store in group:
            try:
                out.append((name, one(name, store), True))
            except Exception as e:  # the others go on; the command fails
                out.append((name, f"{type(e).__name__}: {e}", False))
        return out

    def one(name: str, store: S.Store) -> str:
        if a.command == "apply":
            return store.apply().name
        if a.command == "assert":
            store.assert_matches()
            return "matches"
        if a.command == "dump":
            (a.out / f"{name}.sql").write_text(store.script())
            (a.out / f"{name}.json").write_text(S.snapshot(store.tables.values()))
            return str(a.out / f"{name}.sql")
        if a.command == "patch":
            S.determine(spark, store.order()).write(a.out / f"{name}.patch.sql")
            return str(a.out / f"{name}.patch.sql")
        return json.dumps(sorted(t.identifier for t in store.tables.values()))

    with ThreadPoolExecutor(max(1, a.parallel)) as pool:
        found = [x for xs in pool.map(work, by_database.values()) for x in xs]
    for name, said, _ in found:
        print(f"{name}: {said}")
    return int(not all(ok for *_, ok in found))


if __name__ == "__main__":
    raise SystemExit(main())
