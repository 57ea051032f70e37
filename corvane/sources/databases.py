"""Many databases as one source: a table that each tenant has in a database file of its own.

A registry says which tenant has which SQLite file; the files lie in a folder that all executors see. Read
as ``spark.read.format("tenant_databases")``, a partition is one database. ``rows`` takes a predicate: the tenants
that it names are known while planning, so other tenants' files aren't opened; comparisons with numbers run
in the databases, as parameters of the statement; then Spark applies the whole. (Filters reach the source as
options of one load. Spark's own push-down into Python sources keeps what one query pushed for the next
query over the same frame, which then lacks rows, so it isn't used.)

Options: ``folder`` (every ``<tenant>.db`` in it) or ``registry`` (JSON of files by tenant); ``table``; ``tenants`` (a
JSON list, all if not given); ``where`` (a JSON list of column, operator, number); ``assign``: ``unknown`` raises for a
tenant asked for that isn't registered, otherwise it is found empty.

Defined results: a file without the table gives no rows; columns are those of the schema given, or of the
first tenant's table, by name, and null where a database lacks one; values come in the type declared
there; a tenant's name is its file's, unescaped.
"""

from __future__ import annotations

import contextlib
import json
import os
import sqlite3
import tempfile
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import datasource as ds
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from corvane.operators import predicate as P

TENANT = "tenant_id"
#: Rows of a batch.
BATCH = 5_000
#: Declared types, by what they contain.
KINDS = (("INT", T.LongType()), ("CHAR", T.StringType()), ("TEXT", T.StringType()), ("CLOB", T.StringType()), ("REAL", T.DoubleType()), ("DOUB", T.DoubleType()), ("FLOA", T.DoubleType()), ("BLOB", T.BinaryType()))
OPERATORS = ("=", ">", ">=", "<", "<=")


def named(identifier: str) -> str:
    return '"' + identifier.replace('"', '""') + '"'


@contextlib.contextmanager
def opened(path: str, write: bool = False) -> Iterator[sqlite3.Connection]:
    db = sqlite3.connect(path) if write else sqlite3.connect(f"file:{quote(path)}?mode=ro", uri=True)
    try:
        yield db
    finally:
        db.close()


def tenants(options: dict[str, str]) -> dict[str, str]:
    if "registry" in options:
        return json.loads(options["registry"])
    folder = options["folder"].removeprefix("file://").removeprefix("file:")
    return {unquote(f[:-3]): os.path.join(folder, f) for f in sorted(os.listdir(folder)) if f.endswith(".db")}


def columns(path: str, table: str) -> list[tuple[str, str]]:
    with opened(path) as db:
        return [(r[1], r[2]) for r in db.execute(f"PRAGMA table_info({named(table)})")]


class Database(ds.InputPartition):
    def __init__(self, tenant: str, path: str):
        super().__init__(tenant)
        self.tenant, self.path = tenant, path


class Reader(ds.DataSourceReader):
    def __init__(self, options: dict[str, str], schema: T.StructType):
        self.options, self.kind = options, schema
        self.table = options["table"]
        self.wanted: set[str] | None = set(json.loads(options["tenants"])) if "tenants" in options else None
        self.where = [(c, op, v) for c, op, v in json.loads(options.get("where", "[]")) if op in OPERATORS and c in schema.names and c != TENANT]

    def partitions(self):
        have = tenants(self.options)
        if self.wanted is not None and self.options.get("assign") == "unknown" and (unknown := self.wanted - set(have)):
            raise ValueError(f"unknown tenants: {', '.join(sorted(map(str, unknown)))}")
        return [Database(t, p) for t, p in have.items() if self.wanted is None or t in self.wanted] or [Database("", "")]

    def read(self, partition: Database) -> Iterator[pa.RecordBatch]:
        if not partition.path:
            return
        shape = to_arrow_schema(self.kind)
        there = {c for c, _ in columns(partition.path, self.table)}
        if not there:
            return
        picked = [named(c) if c in there else "NULL" for c in self.kind.names if c != TENANT]
        usable = [w for w in self.where if w[0] in there]
        where = " AND ".join(f"{named(c)} {op} ?" for c, op, _ in usable)
        sql = f"SELECT {', '.join(picked) or '1'} FROM {named(self.table)}" + (f" WHERE {where}" if where else "")
        with opened(partition.path) as db:
            cursor = db.execute(sql, [v for *_, v in usable])
            while rows := cursor.fetchmany(BATCH):
                values = iter(zip(*rows, strict=True))
                out = [pa.array([partition.tenant] * len(rows), pa.string()) if c == TENANT else pa.array(next(values), shape.field(c).type) for c in self.kind.names]
                yield pa.RecordBatch.from_arrays(out, schema=shape)


class TenantDatabases(ds.DataSource):
    @classmethod
    def name(cls) -> str:
        return "tenant_databases"

    def schema(self) -> T.StructType:
        for path in tenants(self.options).values():
            if found := columns(path, self.options["table"]):
                kind = lambda d: next((t for part, t in KINDS if part in d.upper()), T.StringType())
                return T.StructType([T.StructField(TENANT, T.StringType()), *(T.StructField(c, kind(d)) for c, d in found)])
        raise ValueError(f"no database has a table {self.options['table']}")

    def reader(self, schema: T.StructType) -> Reader:
        return Reader(dict(self.options), schema)


def rows(spark: SparkSession, table: str, where: P.Predicate | None = None, schema: str | T.StructType | None = None, **options: str) -> DataFrame:
    """The rows for which ``where`` is true; ``options``: ``folder`` or ``registry``, ``assign``."""
    spark.dataSource.register(TenantDatabases)
    wanted: set[str] | None = None
    said = []
    for p in P.flatten(where) if not isinstance(where, P.Compound) or where.separator == "and" else ():
        if isinstance(p, P.Comparison) and isinstance(p.left, P.Ref) and isinstance(p.right, P.Parameter):
            if p.left.name == TENANT and p.op == "=":
                wanted = {p.right.value} if wanted is None else wanted & {p.right.value}
            elif type(p.right.value) in (int, float):
                said.append((p.left.name, p.op, p.right.value))
        elif isinstance(p, P.InArray) and p.locator == TENANT:
            wanted = set(p.values) if wanted is None else wanted & set(p.values)
    x = spark.read.format(TenantDatabases.name()).options(table=table, where=json.dumps(said), **options)
    if wanted is not None:
        x = x.option("tenants", json.dumps(sorted(map(str, wanted))))
    return P.apply((x.schema(schema) if schema is not None else x).load(), where)


def write(df: DataFrame, folder: str, table: str, tenant: str) -> int:
    """A database for each value of ``tenant`` under ``folder``, which all executors must see; how many there are.

    A tenant's rows stream into its file in one task, a batch at a time, and the file takes its name when
    it is whole, so a task that is run again leaves the same.
    """
    names = [c for c in df.columns if c != tenant]
    sqlite = lambda t: "REAL" if isinstance(t, (T.DoubleType, T.FloatType)) else "INTEGER" if isinstance(t, T.IntegralType) else "BLOB" if isinstance(t, T.BinaryType) else "TEXT"
    made = ", ".join(f"{named(c)} {sqlite(df.schema[c].dataType)}" for c in names)
    folder = folder.removeprefix("file://").removeprefix("file:")
    os.makedirs(folder, exist_ok=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, db, beside = None, None, ""

        def end() -> None:
            if db is not None:
                db.commit()
                db.close()
                os.replace(beside, os.path.join(folder, quote(current, safe="") + ".db"))

        for batch in batches:
            done = []
            for t, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if db is None or t != current:
                    end()
                    handle, beside = tempfile.mkstemp(dir=folder, suffix=".part")
                    os.close(handle)
                    current, db = t, sqlite3.connect(beside)
                    db.execute(f"CREATE TABLE {named(table)} ({made})")
                    done.append(t)
                db.execute(f"INSERT INTO {named(table)} VALUES ({', '.join('?' * len(row))})", row)
            yield pa.record_batch({"tenant": pa.array(done, pa.string())})
        end()

    as_stored = [df[c] if isinstance(df.schema[c].dataType, (T.DoubleType, T.FloatType, T.IntegralType, T.BinaryType)) else df[c].cast("string").alias(c) for c in names]
    x = df.where(df[tenant].isNotNull()).select(df[tenant].cast("string").alias("_tenant"), *as_stored)
    return x.repartition("_tenant").sortWithinPartitions("_tenant").mapInArrow(run, "tenant string").count()
