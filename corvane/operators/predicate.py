"""A composable predicate algebra that compiles to Spark columns.

Nodes are immutable. ``column()`` gives the condition, ``negate()`` its reverse, ``to_sql()`` the same
condition as text. Catalyst splits and pushes the conjuncts; the only nodes that aren't plain
expressions are memberships in another frame (and in long lists), which ``apply`` turns into joins.
"""

from __future__ import annotations

import datetime as dt
import decimal
import math
import re
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass, field, replace
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Each operator's negation, and its form with the operands swapped.
NEGATED = {"=": "!=", "!=": "=", ">": "<=", "<=": ">", "<": ">=", ">=": "<"}
SWAPPED = {"=": "=", "!=": "!=", ">": "<", "<": ">", ">=": "<=", "<=": ">="}
#: Longer lists become a join against a frame of their values.
LONG_LIST = 1_000
SPECIAL = "'\\$"
#: Parts that the rows whose key is null are dealt over.
NULL_PARTS = 1_000


def literal(value: Any) -> str:
    """A value as a SQL literal that Spark and DuckDB both read."""
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, float) and not math.isfinite(value):
        return f"CAST('{value}' AS DOUBLE)"
    if isinstance(value, (int, float, decimal.Decimal)):
        return str(value)
    if isinstance(value, dt.datetime):
        return f"TIMESTAMP '{value.isoformat(sep=' ')}'"
    if isinstance(value, dt.date):
        return f"DATE '{value.isoformat()}'"
    if isinstance(value, (bytes, bytearray)):
        return f"unhex('{value.hex()}')"
    # parsers differ in what they escape, and Spark replaces ${...}: such characters never stand in quotes
    parts = [f"chr({ord(x)})" if x in SPECIAL else f"'{x}'" for x in re.split(r"(['\\$])", str(value)) if x]
    return "(" + " || ".join(parts) + ")" if len(parts) > 1 else parts[0] if parts else "''"


def quoted(text: str) -> str:
    """A text in quotes for those of Spark's statements that take no expression."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'").replace("${", "\\u0024{") + "'"


@dataclass(frozen=True)
class Parameter:
    """A bound value, optionally with a type; ``None`` is SQL's NULL."""

    value: Any
    type: str | None = None

    def column(self) -> Column:
        return F.lit(self.value).cast(self.type) if self.type else F.lit(self.value)

    def to_sql(self) -> str:
        return f"CAST({literal(self.value)} AS {self.type})" if self.type else literal(self.value)


@dataclass(frozen=True)
class Ref:
    """A column (or an expression over columns)."""

    name: str

    def column(self) -> Column:
        return F.expr(self.name)

    def to_sql(self) -> str:
        return self.name


def operand(x: Any) -> Parameter | Ref:
    return x if isinstance(x, (Parameter, Ref)) else Parameter(x)


class Predicate:
    def column(self) -> Column | None:
        raise NotImplementedError

    def to_sql(self) -> str:
        raise NotImplementedError

    def negate(self) -> Predicate:
        return Not(self)

    def children(self) -> tuple[Predicate, ...]:
        return ()

    def walk(self) -> Iterator[Predicate]:
        yield self
        for c in self.children():
            yield from c.walk()

    def contains(self, kind: type) -> bool:
        return any(isinstance(x, kind) for x in self.walk())

    def __and__(self, other: Predicate) -> Predicate:
        return combine_and(self, other)

    def __or__(self, other: Predicate) -> Predicate:
        return Or(self, other)

    def __invert__(self) -> Predicate:
        return self.negate()


@dataclass(frozen=True)
class Comparison(Predicate):
    left: Parameter | Ref
    right: Parameter | Ref
    op: str

    def column(self) -> Column:
        a, b = self.left.column(), self.right.column()
        plain = {"=": a.__eq__, "!=": a.__ne__, ">": a.__gt__, ">=": a.__ge__, "<": a.__lt__, "<=": a.__le__}
        return plain[self.op](b) if self.op in plain else F.expr(self.to_sql())

    def to_sql(self) -> str:
        return f"{self.left.to_sql()} {self.op} {self.right.to_sql()}"

    def negate(self) -> Comparison:
        """KeyError for an operator without a negation."""
        return replace(self, op=NEGATED[self.op])

    def swap(self) -> Comparison:
        return Comparison(self.right, self.left, SWAPPED[self.op])


def compare(left: str | Ref, op: str, right: Any) -> Comparison:
    return Comparison(Ref(left) if isinstance(left, str) else left, operand(right), op)


@dataclass(frozen=True)
class Compound(Predicate):
    """Children joined by one separator; nested compounds of the same separator are flattened."""

    separator: str
    items: tuple[Predicate, ...] = ()

    def children(self) -> tuple[Predicate, ...]:
        return self.items

    def add(self, child: Predicate) -> Compound:
        same = isinstance(child, Compound) and child.separator == self.separator
        return replace(self, items=self.items + (child.items if same else (child,)))

    def column(self) -> Column | None:
        """None for an empty compound, which filters nothing."""
        parts = [c for c in (x.column() for x in self.items) if c is not None]
        join = (lambda a, b: a & b) if self.separator == "and" else (lambda a, b: a | b)
        return reduce(join, parts) if parts else None

    def to_sql(self) -> str:
        parts = [s for s in (x.to_sql() for x in self.items) if s]
        return "(" + f" {self.separator} ".join(parts) + ")" if parts else ""


def compound(separator: str, *children: Predicate) -> Compound:
    return reduce(Compound.add, children, Compound(separator))


def And(*children: Predicate) -> Compound:  # noqa: N802
    return compound("and", *children)


def Or(*children: Predicate) -> Compound:  # noqa: N802
    return compound("or", *children)


@dataclass(frozen=True)
class Not(Predicate):
    child: Predicate

    def children(self) -> tuple[Predicate, ...]:
        return (self.child,)

    def column(self) -> Column | None:
        c = self.child.column()
        return None if c is None else ~c

    def to_sql(self) -> str:
        s = self.child.to_sql()
        return f"NOT({s})" if s else ""

    def negate(self) -> Predicate:
        return self.child


def negated(child: Predicate) -> Predicate:
    """The reverse where the child has one of its own, else NOT of it."""
    return child.negate()


@dataclass(frozen=True)
class InArray(Predicate):
    locator: str
    values: tuple[Any, ...]

    def column(self) -> Column:
        return F.expr(self.locator).isin(*self.values) if self.values else F.lit(False)

    def to_sql(self) -> str:
        return f"{self.locator} IN ({', '.join(map(literal, self.values))})" if self.values else "false"


@dataclass(frozen=True)
class InSubQuery(Predicate):
    """``locator in (select key from frame)``."""

    locator: str
    frame: DataFrame = field(compare=False)
    key: str = "id"
    text: str = ""

    def column(self) -> Column:
        raise ValueError("a membership in a frame is applied as a join")

    def to_sql(self) -> str:
        return f"{self.locator} IN (SELECT {self.key} FROM {self.text})"


@dataclass(frozen=True)
class EnumIsOneOf(Predicate):
    """Null among the values admits null columns; without it they are rejected."""

    values: tuple[Any, ...]
    locator: str
    as_text: bool = False

    def stored(self) -> tuple[Any, ...]:
        return tuple(getattr(v, "name", str(v)) if self.as_text else getattr(v, "value", v) for v in self.values if v is not None)

    def column(self) -> Column:
        c, v = F.expr(self.locator), self.stored()
        found = c.isin(*v) if v else F.lit(False)
        return found | c.isNull() if None in self.values else found & c.isNotNull()

    def to_sql(self) -> str:
        found = InArray(self.locator, self.stored()).to_sql()
        return f"({found} OR {self.locator} IS NULL)" if None in self.values else f"({found} AND {self.locator} IS NOT NULL)"


@dataclass(frozen=True)
class EnumIsNotOneOf(EnumIsOneOf):
    """Rejects null columns."""

    def column(self) -> Column:
        return ~F.expr(self.locator).isin(*self.stored())

    def to_sql(self) -> str:
        return f"NOT({InArray(self.locator, self.stored()).to_sql()})"


@dataclass(frozen=True)
class Raw(Predicate):
    """SQL text; each ``token`` takes the next value, or ``:name`` the value of that name."""

    sql: str
    values: tuple[Any, ...] | Mapping[str, Any] = ()
    token: str = "?"

    def to_sql(self) -> str:
        if isinstance(self.values, Mapping):
            return named(self.sql, self.values)
        parts = self.sql.split(self.token)
        if len(parts) - 1 != len(self.values):
            raise ValueError(f"{len(parts) - 1} places for {len(self.values)} values")
        return parts[0] + "".join(literal(v) + p for v, p in zip(self.values, parts[1:], strict=True))

    def column(self) -> Column:
        return F.expr(self.to_sql())


def named(sql: str, values: Mapping[str, Any]) -> str:
    """Each ``:name`` outside quotes becomes its value, in one pass: what a value holds isn't looked at again."""

    def one(m: re.Match) -> str:
        return literal(values[m["name"]]) if m["name"] in values else m[0]

    return re.sub(r"'(?:[^'\\]|\\.|'')*'|`[^`]*`|::|:(?P<name>\w+)", one, sql)


@dataclass(frozen=True)
class Always(Predicate):
    value: bool

    def column(self) -> Column:
        return F.lit(self.value)

    def to_sql(self) -> str:
        return "true" if self.value else "false"

    def negate(self) -> Always:
        return Always(not self.value)


TRUE, FALSE = Always(True), Always(False)


def by_id(value: Any, column: str = "id") -> Comparison:
    return compare(column, "=", value)


def combine_and(first: Predicate, *others: Predicate) -> Predicate:
    """Onto an existing conjunction, or a new one; nothing to add leaves it as it is."""
    if not others:
        return first
    return reduce(Compound.add, others, first) if isinstance(first, Compound) and first.separator == "and" else And(first, *others)


def flatten(p: Predicate) -> tuple[Predicate, ...]:
    return p.items if isinstance(p, Compound) else (p,)


def _joins(p: Predicate) -> bool:
    return any(isinstance(x, InSubQuery) or isinstance(x, InArray) and len(x.values) > LONG_LIST for x in p.walk())


def _members(df: DataFrame, p: InSubQuery | InArray) -> DataFrame:
    if isinstance(p, InSubQuery):
        return p.frame.select(F.expr(p.key).alias("_member"))
    return df.sparkSession.createDataFrame([(v,) for v in p.values], ["_member"])


def apply(df: DataFrame, p: Predicate | None) -> DataFrame:
    """The rows for which ``p`` is true. Memberships that stand alone in the conjunction are semi joins."""
    if p is None:
        return df
    for c in p.items if isinstance(p, Compound) and p.separator == "and" else (p,):
        if not _joins(c):
            if (cond := c.column()) is not None:
                df = df.where(cond)
        elif isinstance(c, (InSubQuery, InArray)):
            members = _members(df, c)
            df = df.withColumn("_key", F.expr(c.locator)).join(members, F.col("_key") == F.col("_member"), "left_semi").drop("_key")
        else:
            df = _nested(df, c)
    return df


def _nested(df: DataFrame, p: Predicate) -> DataFrame:
    """A membership below OR or NOT becomes a column of its own, three-valued as IN is."""
    columns, marks = df.columns, {}
    for x in p.walk():
        if isinstance(x, InSubQuery) or isinstance(x, InArray) and len(x.values) > LONG_LIST:
            n = len(marks)
            members = _members(df, x)
            has_null, some = (members.agg(F.max(F.col("_member").isNull()), F.count("*")).first() or (None, 0))[:2]
            hit = members.where("_member is not null").distinct().select(F.col("_member").alias(f"_m{n}"), F.lit(True).alias(f"_hit{n}"))
            # a null key finds nothing; its rows are dealt out rather than sent to one task
            flat = [c for c, t in df.dtypes if not t.startswith(("map", "variant", "array", "struct"))]
            part = F.when(F.expr(x.locator).isNull(), F.pmod(F.xxhash64(*flat), F.lit(NULL_PARTS))).otherwise(0)
            hit = hit.withColumn(f"_n{n}", F.lit(0).cast("long"))
            df = df.withColumns({f"_k{n}": F.expr(x.locator), f"_p{n}": part.cast("long")})
            df = df.join(hit, (F.col(f"_k{n}") == F.col(f"_m{n}")) & (F.col(f"_p{n}") == F.col(f"_n{n}")), "left")
            unknown = F.when(F.col(f"_k{n}").isNull() & F.lit(some > 0) | F.lit(bool(has_null)), F.lit(None)).otherwise(F.lit(False))
            marks[id(x)] = F.coalesce(F.col(f"_hit{n}"), unknown)

    def build(x: Predicate) -> Column:
        if id(x) in marks:
            return marks[id(x)]
        if isinstance(x, Not):
            return ~build(x.child)
        if isinstance(x, Compound):
            return reduce((lambda a, b: a & b) if x.separator == "and" else (lambda a, b: a | b), map(build, x.items))
        return x.column()

    return df.where(build(p)).select(*columns)


def in_array(locator: str, values: Sequence[Any]) -> InArray:
    return InArray(locator, tuple(values))
