"""Declared tables, what the catalog has, and the changes between them.

Spark's catalog keeps columns, comments and partitions of a table but no keys, checks or indexes, so
those stand in a metadata property of the table, as JSON in Base64 (which no parser takes apart). A
migration is a list of actions in order, each with an inverse that runs; lines that begin with dashes
say what a change of the property means. Parquet tables can't drop, rename or retype a column in
place, so such a change is a rebuild of the table: a new copy, then a swap of names, which ``recover``
ends or undoes if its driver died.
"""

from __future__ import annotations

import base64
import contextlib
import datetime as dt
import decimal
import hashlib
import json
import re
import uuid
from collections.abc import Callable, Iterable
from dataclasses import asdict, dataclass, field, fields, replace
from enum import Enum, IntEnum
from pathlib import Path
from types import UnionType
from typing import Any, get_args, get_origin, get_type_hints

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.operators.batch import run_script
from corvane.operators.ordering import topological
from corvane.sources.locks import lock
from corvane.sources.names import checked, delimited, qualified

PROPERTY, FINGERPRINT = "corvane.model", "corvane.fingerprint"


class Difference(IntEnum):
    """The worst of several is the smallest."""

    INVALID, UPDATE, CREATE, NONE = range(4)


class AutoCreate(Enum):
    NONE, CREATE_ONLY, CREATE_OR_UPDATE, ALL = range(4)


class Cascade(Enum):
    NO_ACTION, RESTRICT, CASCADE, SET_NULL, SET_DEFAULT = range(5)


class NotAllowed(RuntimeError):
    pass


class Unsupported(NotImplementedError):
    pass


#: Logical types and Spark's for them.
TYPES = {
    "bool": "boolean", "byte": "smallint", "short": "smallint", "int": "int", "long": "bigint", "float": "float", "double": "double", "decimal": "decimal(38,18)",
    "string": "string", "binary": "binary", "guid": "string", "timestamp": "timestamp", "timestamp_ntz": "timestamp_ntz", "date": "date", "interval": "interval day to second",
    "enum": "int", "enum_text": "string", "json": "string", "uint": "bigint",
}


def spark_type(name: str) -> str:
    """Of a logical name; ``elem[]`` is an array, others pass through."""
    if name.endswith("[]"):
        return f"array<{spark_type(name[:-2])}>"
    return TYPES.get(name.lower(), name.lower())


def canonical(expression: str) -> str:
    """An expression for comparing declarations: without CHECK, casts, quotes, parentheses and spaces, in lower case.

    Coarse on purpose: expressions that differ in parentheses alone are taken as equal.
    """
    s = re.sub(r"^\s*check\b", "", expression, flags=re.I)
    s = re.sub(r"::[a-zA-Z_ ]+(\[\])?", "", s)
    return re.sub(r"[\s()\"`\[\]]", "", s).lower()


@dataclass(frozen=True)
class Column:
    name: str
    type: str
    nullable: bool = True
    default: str | None = None
    computed: str | None = None

    def same(self, other: Column) -> bool:
        if (self.computed is None) != (other.computed is None):
            return False
        if self.computed is not None and canonical(self.computed) != canonical(other.computed):
            return False
        return spark_type(self.type) == spark_type(other.type)

    def ddl(self) -> str:
        end = ("" if self.nullable else " NOT NULL") + (f" DEFAULT {self.default}" if self.default is not None else "")
        return f"{delimited(self.name)} {spark_type(self.type)}{end}"


@dataclass(frozen=True)
class ForeignKey:
    name: str
    columns: tuple[str, ...]
    table: str
    linked: tuple[str, ...]
    on_delete: str = Cascade.NO_ACTION.name
    on_update: str = Cascade.NO_ACTION.name


@dataclass(frozen=True)
class Index:
    name: str
    columns: tuple[str, ...]
    unique: bool = False
    descending: bool = False
    nulls_first: bool | None = None
    predicate: str | None = None
    method: str = "btree"
    include: tuple[str, ...] = ()


@dataclass(frozen=True)
class Check:
    name: str
    expression: str


@dataclass(frozen=True)
class Table:
    schema: str
    name: str
    columns: tuple[Column, ...] = ()
    key: tuple[str, ...] = ()
    foreign_keys: tuple[ForeignKey, ...] = ()
    indexes: tuple[Index, ...] = ()
    checks: tuple[Check, ...] = ()
    partitioned_by: tuple[str, ...] = ()

    @property
    def identifier(self) -> str:
        return qualified(self.schema, self.name)

    def column(self, name: str) -> Column | None:
        return next((c for c in self.columns if c.name.lower() == name.lower()), None)

    def model(self) -> str:
        """What the catalog can't hold, as JSON."""
        parts = {k: v for k, v in asdict(self).items() if k in ("key", "foreign_keys", "indexes", "checks")}
        parts["computed"] = {c.name: c.computed for c in self.columns if c.computed is not None}
        return json.dumps(parts, sort_keys=True)

    def property(self) -> str:
        return f"('{PROPERTY}' = '{base64.b64encode(self.model().encode()).decode()}')"

    def create(self) -> str:
        by = f" PARTITIONED BY ({', '.join(map(delimited, self.partitioned_by))})" if self.partitioned_by else ""
        return f"CREATE TABLE IF NOT EXISTS {self.identifier} ({', '.join(c.ddl() for c in self.columns)}) USING parquet{by} TBLPROPERTIES {self.property()}"

    def drop(self) -> str:
        return f"DROP TABLE IF EXISTS {self.identifier}"


def read_table(spark: SparkSession, schema: str, name: str) -> Table | None:
    """A table as the catalog has it."""
    ident = qualified(schema, name)
    if not spark.catalog.tableExists(ident):
        return None
    props = {r["key"]: r["value"] for r in spark.sql(f"SHOW TBLPROPERTIES {ident}").collect()}
    model = json.loads(base64.b64decode(props[PROPERTY])) if PROPERTY in props else {}
    computed = model.get("computed", {})
    info = spark.catalog.listColumns(ident)
    tuples = lambda d: {k: tuple(v) if isinstance(v, list) else v for k, v in d.items()}
    return Table(
        schema,
        name,
        tuple(Column(c.name, c.dataType, c.nullable, None, computed.get(c.name)) for c in info),
        tuple(model.get("key", ())),
        tuple(ForeignKey(**tuples(x)) for x in model.get("foreign_keys", ())),
        tuple(Index(**tuples(x)) for x in model.get("indexes", ())),
        tuple(Check(**x) for x in model.get("checks", ())),
        tuple(c.name for c in info if c.isPartition),
    )


def objects(spark: SparkSession, schema: str | None = None) -> dict[str, list[str]]:
    """Names of schemas, tables and functions."""
    schema = schema or spark.catalog.currentDatabase()
    return {"schemas": [d.name for d in spark.catalog.listDatabases()], "tables": [t.name for t in spark.catalog.listTables(schema) if not t.isTemporary], "functions": [f.name for f in spark.catalog.listFunctions(schema) if f.namespace == [schema]]}


@dataclass(frozen=True)
class Items:
    """Two named collections compared, whatever the case of the names."""

    missing: tuple = ()
    extra: tuple = ()
    different: tuple = ()
    matched: tuple = ()


def compare(expected: Iterable, actual: Iterable, same: Callable = lambda a, b: a == b, name: Callable = lambda x: x.name.lower()) -> Items:
    e, a = {name(x): x for x in expected}, {name(x): x for x in actual}
    both = [(e[k], a[k]) for k in e if k in a]
    return Items(tuple(e[k] for k in e if k not in a), tuple(a[k] for k in a if k not in e), tuple(p for p in both if not same(*p)), tuple(p for p in both if same(*p)))


@dataclass(frozen=True)
class Action:
    """A step of a migration. ``kind`` fixes its place in the order."""

    kind: str
    text: str
    undo: str = ""


#: The order of a table's changes.
STEPS = ("drop index", "add column", "alter column", "foreign key", "check", "index", "key", "drop column", "partition")


@dataclass(frozen=True)
class TableDelta:
    expected: Table
    actual: Table | None
    columns: Items = field(default_factory=Items)
    indexes: Items = field(default_factory=Items)
    foreign_keys: Items = field(default_factory=Items)
    checks: Items = field(default_factory=Items)
    key_differs: bool = False
    partitions_differ: bool = False

    @property
    def difference(self) -> Difference:
        if self.actual is None:
            return Difference.CREATE
        if self.partitions_differ:
            return Difference.INVALID
        # checks that only the catalog knows are left alone
        changed = [self.columns.missing, self.columns.extra, self.columns.different, self.indexes.missing, self.indexes.extra, self.indexes.different, self.foreign_keys.missing, self.foreign_keys.extra, self.foreign_keys.different, self.checks.missing, self.checks.different]
        return Difference.UPDATE if any(changed) or self.key_differs else Difference.NONE

    @property
    def needs_rebuild(self) -> bool:
        """What parquet tables can't do in place."""
        return bool(self.columns.extra or self.columns.different or self.partitions_differ)

    def actions(self) -> list[Action]:
        t = self.expected
        if self.actual is None:
            return [Action("create", t.create(), t.drop())]
        names = renames(self)
        rebuilt = Action("", rebuild_script(t, self.actual, names), rebuild_script(self.actual, t, {new: old for old, new in names.items()}))
        out = [Action("drop index", f"-- drop index {i.name}", f"-- add index {i.name}") for i in (*self.indexes.extra, *(a for _, a in self.indexes.different))]
        for i, c in enumerate(self.columns.missing):
            if self.needs_rebuild:
                out.append(Action("add column", f"-- add column {c.name}", f"-- drop column {c.name}"))
                continue
            # an added column can have no default for rows that are there, and so no NOT NULL; added ones go together
            undo = rebuilt.undo if i == 0 else f"-- drop column {c.name}"
            out.append(Action("add column", f"ALTER TABLE {t.identifier} ADD COLUMNS ({replace(c, nullable=True, default=None).ddl()})", undo))
        for e, a in self.columns.different:
            out.append(Action("alter column", f"-- {e.name} from {spark_type(a.type)} to {spark_type(e.type)}", f"-- {e.name} to {spark_type(a.type)}"))
        for kind, items in (("foreign key", self.foreign_keys), ("check", self.checks), ("index", self.indexes)):
            out += [Action(kind, f"-- add {kind} {x.name}", f"-- drop {kind} {x.name}") for x in (*items.missing, *(e for e, _ in items.different))]
        out += [Action("foreign key", f"-- drop foreign key {x.name}", f"-- add foreign key {x.name}") for x in self.foreign_keys.extra]
        if self.key_differs:
            out.append(Action("key", f"-- key ({', '.join(t.key)})", f"-- key ({', '.join(self.actual.key)})"))
        out += [Action("drop column", f"-- drop column {c.name}", f"-- add column {c.name}") for c in self.columns.extra]
        if self.partitions_differ:
            out.append(Action("partition", f"-- by ({', '.join(t.partitioned_by)})", f"-- by ({', '.join(self.actual.partitioned_by)})"))
        out.sort(key=lambda a: STEPS.index(a.kind))
        if self.needs_rebuild:
            # one rebuild carries all of them out, or back
            last = max(i for i, a in enumerate(out) if a.kind in ("alter column", "drop column", "partition"))
            out[last] = replace(out[last], text=f"{out[last].text}\n{rebuilt.text}", undo=f"{out[last].undo}\n{rebuilt.undo}")
        old, new = self.actual.property(), t.property()
        return [*out, Action("model", f"ALTER TABLE {t.identifier} SET TBLPROPERTIES {new}", f"ALTER TABLE {t.identifier} SET TBLPROPERTIES {old}")] if out else []

    def rollback(self) -> list[Action]:
        return [Action(a.kind, a.undo, a.text) for a in reversed(self.actions())]


def diff(expected: Table, actual: Table | None) -> TableDelta:
    if actual is None:
        return TableDelta(expected, None)
    checks = compare(expected.checks, actual.checks, lambda a, b: canonical(a.expression) == canonical(b.expression))
    return TableDelta(
        expected,
        actual,
        compare(expected.columns, actual.columns, Column.same),
        compare(expected.indexes, actual.indexes),
        compare(expected.foreign_keys, actual.foreign_keys),
        checks,
        [k.lower() for k in expected.key] != [k.lower() for k in actual.key],
        [p.lower() for p in expected.partitioned_by] != [p.lower() for p in actual.partitioned_by],
    )


@dataclass(frozen=True)
class Migration:
    deltas: tuple[TableDelta, ...]

    @property
    def difference(self) -> Difference:
        return min((d.difference for d in self.deltas), default=Difference.NONE)

    @property
    def schemas(self) -> list[str]:
        return sorted({d.expected.schema for d in self.deltas} - {"default", "public"})

    def check(self, gate: AutoCreate) -> None:
        worst = self.difference
        if worst is Difference.NONE:
            return
        allowed = {AutoCreate.NONE: (), AutoCreate.CREATE_ONLY: (Difference.CREATE,), AutoCreate.CREATE_OR_UPDATE: (Difference.CREATE, Difference.UPDATE), AutoCreate.ALL: tuple(Difference)}[gate]
        bad = [d.expected.identifier for d in self.deltas if d.difference is not Difference.NONE and d.difference not in allowed]
        if bad:
            raise NotAllowed(f"{gate.name} forbids the changes of {', '.join(bad)}")

    def script(self) -> str:
        return "".join(a.text + ";\n" for d in self.deltas for a in d.actions())

    def rollback_script(self) -> str:
        return "".join(a.text + ";\n" for d in reversed(self.deltas) for a in d.rollback())

    def run(self, spark: SparkSession) -> None:
        run_script(spark, self.script())

    def roll_back(self, spark: SparkSession) -> None:
        """Undo what ``run`` did. Rows stay; what a dropped column held doesn't come back."""
        run_script(spark, self.rollback_script())

    def write(self, path: str | Path) -> None:
        """The script, and its reverse beside it."""
        path = Path(path)
        path.write_text(self.script())
        path.with_suffix(".drop" + path.suffix).write_text(self.rollback_script())


def determine(spark: SparkSession, tables: Iterable[Table]) -> Migration:
    return Migration(tuple(diff(t, read_table(spark, t.schema, t.name)) for t in tables))


def fingerprint(tables: Iterable[Table]) -> str:
    return hashlib.sha256("\n".join(sorted(t.create() for t in tables)).encode()).hexdigest().upper()


def check_names(tables: Iterable[Table]) -> None:
    """Raises for names that can't be, or that meet another of their kind, before anything is changed."""
    tables = list(tables)
    for s in {t.schema.lower() for t in tables}:
        checked((t.name for t in tables if t.schema.lower() == s), "table")
    for t in tables:
        checked((c.name for c in t.columns), f"column of {t.name}")
        for kind in ("indexes", "foreign_keys", "checks"):
            checked((x.name for x in getattr(t, kind)), f"{kind} of {t.name}")


class Store:
    """Tables of one catalog, applied on demand.

    With a ``folder`` that all drivers see, one driver changes the tables at a time, and the fingerprint
    of what was applied is kept with the database: a driver that finds its own there has nothing to do.
    """

    def __init__(self, spark: SparkSession, tables: Iterable[Table], gate: AutoCreate = AutoCreate.CREATE_OR_UPDATE, folder: str | Path | None = None, name: str = "store", wait: float = 60.0):
        tables = list(tables)
        check_names(tables)
        self.spark, self.tables, self.gate = spark, {t.name: t for t in tables}, gate
        self.folder, self.name, self.wait = folder, name, wait
        self._checked: set[str] = set()
        self._fingerprint = ""

    def order(self) -> list[Table]:
        refers = {t.name: {f.table for f in t.foreign_keys} for t in self.tables.values()}
        return [self.tables[n] for n in topological(list(self.tables), refers)]

    def applied(self) -> str:
        """The fingerprint kept with the database, if any."""
        schema = min(t.schema for t in self.tables.values())
        if not self.spark.catalog.databaseExists(schema):
            return ""
        said = " ".join(r["info_value"] for r in self.spark.sql(f"DESCRIBE DATABASE EXTENDED {delimited(schema)}").collect() if r["info_name"] == "Properties")
        found = re.search(rf"\({re.escape(FINGERPRINT)}\.{re.escape(self.name)},([0-9A-F]{{64}})\)", said)
        return found[1] if found else ""

    def apply(self) -> Difference:
        """All changes; nothing where the fingerprint is the one applied last."""
        now = fingerprint(self.tables.values())
        if not self.tables or now in (self._fingerprint, self.folder and self.applied()):
            self._fingerprint = now
            return Difference.NONE
        alone = lock(Path(self.folder) / f"{self.name}.lock", self.wait) if self.folder else contextlib.nullcontext()
        with alone:
            if self.folder and self.applied() == now:  # another driver did it meanwhile
                self._fingerprint = now
                return Difference.NONE
            found = self._apply()
            if self.folder:
                schema = min(t.schema for t in self.tables.values())
                self.spark.sql(f"ALTER DATABASE {delimited(schema)} SET DBPROPERTIES ('{FINGERPRINT}.{self.name}' = '{now}')")
        self._fingerprint = now
        return found

    def _apply(self) -> Difference:
        for t in self.tables.values():
            recover(self.spark, t)
        migration = determine(self.spark, self.order())
        migration.check(self.gate)
        for s in {d.expected.schema for d in migration.deltas}:
            ensure_schema(self.spark, s)
        migration.run(self.spark)
        return migration.difference

    def ensure(self, name: str, seen: tuple[str, ...] = ()) -> None:
        """A table and those it refers to, each looked at once."""
        if name in self._checked or name in seen:
            return
        for f in self.tables[name].foreign_keys:
            if f.table in self.tables:
                self.ensure(f.table, (*seen, name))
        recover(self.spark, self.tables[name])
        migration = determine(self.spark, [self.tables[name]])
        migration.check(self.gate)
        ensure_schema(self.spark, self.tables[name].schema)
        migration.run(self.spark)
        self._checked.add(name)

    def assert_matches(self) -> None:
        migration = determine(self.spark, self.order())
        if migration.difference is not Difference.NONE:
            raise AssertionError(migration.script())

    def delete_all(self) -> None:
        """Rows of all tables, children first."""
        for t in reversed(self.order()):
            if self.spark.catalog.tableExists(t.identifier):
                self.spark.sql(f"TRUNCATE TABLE {t.identifier}")

    def reset(self, *seeders: Callable[[SparkSession], None]) -> None:
        self.delete_all()
        for s in seeders:
            s(self.spark)

    def script(self) -> str:
        return "".join(t.create() + ";\n" for t in self.order())


def rebuild_script(new: Table, old: Table, renamed: dict[str, str]) -> str:
    """Copy into the new layout under another name, then swap names. Values that can't be cast to a new type raise."""
    beside, aside = (qualified(new.schema, f"{new.name}__{x}") for x in ("new", "old"))
    have = {c.name.lower(): c.name for c in old.columns} | {b.lower(): a for a, b in renamed.items()}
    source = lambda c: delimited(have[c.name.lower()]) if c.name.lower() in have else c.computed or c.default or "NULL"
    pick = ", ".join(f"CAST({source(c)} AS {spark_type(c.type)}) AS {delimited(c.name)}" for c in new.columns)
    steps = [
        f"DROP TABLE IF EXISTS {beside}",
        replace(new, name=f"{new.name}__new").create(),
        f"INSERT INTO {beside} BY NAME SELECT {pick} FROM {new.identifier}",
        f"ALTER TABLE {new.identifier} RENAME TO {aside}",
        f"ALTER TABLE {beside} RENAME TO {new.identifier}",
        f"DROP TABLE {aside}",
    ]
    return ";\n".join(steps)


def recover(spark: SparkSession, t: Table) -> None:
    """After a driver died within a rebuild: a finished copy takes the table's place, an unfinished one goes."""
    beside, aside = (qualified(t.schema, f"{t.name}__{x}") for x in ("new", "old"))
    if not spark.catalog.databaseExists(t.schema):
        return
    there = {x: spark.catalog.tableExists(x) for x in (t.identifier, beside, aside)}
    if there[aside] and not there[t.identifier]:
        spark.sql(f"ALTER TABLE {beside if there[beside] else aside} RENAME TO {t.identifier}")
        spark.sql(f"DROP TABLE IF EXISTS {aside}")
    else:  # a copy without a table beside it was never ended
        for x in (beside, aside):
            spark.sql(f"DROP TABLE IF EXISTS {x}")


def ensure_schema(spark: SparkSession, name: str) -> None:
    spark.sql(f"CREATE DATABASE IF NOT EXISTS {delimited(name)}")


def drop_schema(spark: SparkSession, name: str) -> None:
    spark.sql(f"DROP DATABASE IF EXISTS {delimited(name)} CASCADE")


def reset_schema(spark: SparkSession, name: str) -> None:
    drop_schema(spark, name)
    ensure_schema(spark, name)


def text_differs(expected: str, actual: str) -> bool:
    """View and function bodies: whatever the case, spaces at the ends and last semicolon."""
    plain = lambda s: s.strip().rstrip(";").strip().lower()
    return plain(expected) != plain(actual)


def create_view(spark: SparkSession, name: str, body: str) -> None:
    spark.sql(f"CREATE OR REPLACE VIEW {name} AS {body}")


def refresh_materialized(spark: SparkSession, schema: str, name: str, body: str) -> None:
    """A stored result of a query, computed anew beside the old one and swapped in by name.

    What a driver that died left behind is ended or undone first (``recover``), so there is always a table to read.
    """
    t = Table(schema, name)
    beside, aside = (qualified(schema, f"{name}__{x}") for x in ("new", "old"))
    recover(spark, t)
    spark.sql(f"CREATE TABLE {beside} USING parquet AS {body}")
    if spark.catalog.tableExists(t.identifier):
        spark.sql(f"ALTER TABLE {t.identifier} RENAME TO {aside}")
    spark.sql(f"ALTER TABLE {beside} RENAME TO {t.identifier}")
    spark.sql(f"DROP TABLE IF EXISTS {aside}")


def refuse(kind: str) -> None:
    """Triggers, packages, extensions, stored procedures: Spark has nothing of the kind, and dropping them silently would be worse."""
    raise Unsupported(f"{kind} can't be expressed in Spark's catalog")


def follow(df: DataFrame, parents: dict[str, DataFrame], *keys: ForeignKey) -> DataFrame:
    """``df`` joined to the table each key refers to, one after the other; a key may be one of a table that joined before."""
    for k in keys:
        parent = parents[k.table]
        df = df.join(parent, [df[c] == parent[p] for c, p in zip(k.columns, k.linked, strict=True)])
    return df


def orphans(child: DataFrame, parent: DataFrame, key: ForeignKey) -> DataFrame:
    """Rows whose reference has no target; a null in it refers to nothing."""
    on = [child[c] == parent[p] for c, p in zip(key.columns, key.linked, strict=True)]
    return child.dropna(subset=list(key.columns)).join(parent, on, "left_anti")


def violations(df: DataFrame, check: Check) -> DataFrame:
    """Rows for which a check is false; null passes."""
    return df.where(~F.expr(check.expression))


def repeated_keys(df: DataFrame, key: list[str]) -> DataFrame:
    return df.groupBy(*key).count().where("count > 1")


def renames(d: TableDelta) -> dict[str, str]:
    """New names of columns by their old ones: a missing and an extra column of one type, default and place are one renamed.

    A type that several of them share is ambiguous, and then nothing is taken as renamed.
    """
    if d.actual is None:
        return {}
    sort = lambda c: (spark_type(c.type), c.nullable, c.computed and canonical(c.computed))
    out = {}
    for e in d.columns.missing:
        like = [a for a in d.columns.extra if sort(a) == sort(e)]
        rivals = [x for x in d.columns.missing if sort(x) == sort(e)]
        if len(like) == len(rivals) == 1 and d.expected.columns.index(e) == d.actual.columns.index(like[0]):
            out[like[0].name] = e.name
    return out


@dataclass(frozen=True)
class UserType:
    """A named type: a struct of fields, a set of texts or a checked base type."""

    name: str
    fields: tuple[Column, ...] = ()
    values: tuple[str, ...] = ()
    base: str = "string"
    check: str | None = None

    def spark(self) -> str:
        if self.fields:
            return f"struct<{','.join(f'{c.name}:{spark_type(c.type)}' for c in self.fields)}>"
        return "string" if self.values else spark_type(self.base)

    def violations(self, df: DataFrame, column: str) -> DataFrame:
        if self.values:
            return df.where(~F.col(column).isin(*self.values))
        return df.where(~F.expr(self.check.replace("VALUE", f"`{column}`"))) if self.check else df.limit(0)


def create_synonym(spark: SparkSession, name: str, target: str) -> None:
    """A name for a table; it can be read, not written."""
    create_view(spark, name, f"SELECT * FROM {target}")


#: Logical types of Python's.
PYTHON_TYPES = {bool: "bool", int: "long", float: "double", str: "string", bytes: "binary", dt.datetime: "timestamp", dt.date: "date", dt.timedelta: "interval", decimal.Decimal: "decimal", uuid.UUID: "guid", dict: "json"}


def logical_type(kind: Any) -> tuple[str, bool]:
    """Of a Python type, and whether None is among its values. A list is an array, an enum its number (its name, if its values are texts)."""
    some = [x for x in get_args(kind) if x is not type(None)] if isinstance(kind, UnionType) else []
    if some:
        return logical_type(some[0])[0], len(some) < len(get_args(kind))
    if get_origin(kind) is list:
        return f"{logical_type(get_args(kind)[0])[0]}[]", False
    if isinstance(kind, type) and issubclass(kind, Enum):
        return ("enum_text" if issubclass(kind, str) or all(isinstance(x.value, str) for x in kind) else "enum"), False
    return PYTHON_TYPES[get_origin(kind) or kind], False


def from_models(schema: str, *models: type) -> list[Table]:
    """Tables of dataclasses, parents first.

    A field's metadata may say ``name``, ``type``, ``key``, ``unique``, ``index``, ``check``, ``default``, ``computed`` and
    ``refers`` (a model, with ``on_delete`` and ``on_update``); a model may have a name for its table in ``table``.
    A base class that is a dataclass without a ``table`` of its own shares its fields.
    """
    names = {m: m.__dict__.get("table") or m.__name__.lower() for m in models}
    keys = {m: tuple(f.metadata.get("name", f.name) for f in fields(m) if f.metadata.get("key")) for m in models}
    out = {}
    for m in models:
        t, kinds = names[m], get_type_hints(m)
        columns, refers, indexes, checks = [], [], [], []
        for f in fields(m):
            said, name = f.metadata, f.metadata.get("name", f.name)
            kind, none = logical_type(kinds[f.name])
            columns.append(Column(name, said.get("type", kind), none, said.get("default"), said.get("computed")))
            if up := said.get("refers"):
                if len(keys[up]) != 1:
                    raise ValueError(f"{t}.{name} refers to {names[up]}, whose key isn't one column")
                refers.append(ForeignKey(f"fk_{t}_{name}", (name,), names[up], keys[up], said.get("on_delete", Cascade.NO_ACTION.name), said.get("on_update", Cascade.NO_ACTION.name)))
            if said.get("unique") or said.get("index"):
                indexes.append(Index(f"idx_{t}_{name}", (name,), unique=bool(said.get("unique"))))
            if said.get("check"):
                checks.append(Check(f"ck_{t}_{name}", said["check"]))
        out[t] = Table(schema, t, tuple(columns), keys[m], tuple(refers), tuple(indexes), tuple(checks))
    return [out[n] for n in topological(list(out), {t: {f.table for f in x.foreign_keys} for t, x in out.items()})]


def snapshot(tables: Iterable[Table]) -> str:
    return json.dumps([asdict(t) for t in tables], indent=1, sort_keys=True)


def from_snapshot(text: str) -> list[Table]:
    tuples = lambda d: {k: tuple(v) if isinstance(v, list) else v for k, v in d.items()}
    nested = {"columns": Column, "foreign_keys": ForeignKey, "indexes": Index, "checks": Check}
    return [Table(**{k: tuple(nested[k](**tuples(x)) for x in v) if k in nested else tuple(v) if isinstance(v, list) else v for k, v in t.items()}) for t in json.loads(text)]


def snapshot_changes(before: Iterable[Table], after: Iterable[Table]) -> tuple[list[Action], list[Action]]:
    """Up and down operations between two snapshots."""
    name = lambda t: (t.schema.lower(), t.name.lower())
    found = compare(after, before, name=name)
    up = [Action("create", t.create(), t.drop()) for t in found.missing]
    for new, old in found.different:
        up += diff(new, old).actions()
    up += [Action("drop", t.drop(), t.create()) for t in found.extra]
    return up, [Action(a.kind, a.undo, a.text) for a in reversed(up)]


def templates(folder: str | Path) -> dict[str, str]:
    """``*.function`` and ``*.table`` files by name."""
    return {p.name: p.read_text() for p in sorted(Path(folder).iterdir()) if p.suffix in (".function", ".table")}
