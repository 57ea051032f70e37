"""Partition policies: rolling windows, range, list and hash routing, and changes of partition sets."""

from __future__ import annotations

import datetime as dt
import re
from dataclasses import dataclass
from enum import Enum

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.operators.ordering import dense_index


class Period(Enum):
    HOUR, DAY, WEEK, MONTH, YEAR = "hour", "day", "week", "month", "year"

    @property
    def prefix(self) -> str:
        return self.value[0]


#: How a period's start is written in a suffix.
SPARK_FORMAT = {Period.HOUR: "yyyyMMddHH", Period.DAY: "yyyyMMdd", Period.WEEK: "yyyyMMdd", Period.MONTH: "yyyyMM", Period.YEAR: "yyyy"}
PYTHON_FORMAT = {Period.HOUR: "%Y%m%d%H", Period.DAY: "%Y%m%d", Period.WEEK: "%Y%m%d", Period.MONTH: "%Y%m", Period.YEAR: "%Y"}


def period_start(ts: Column, period: Period, week_start: int = 0) -> Column:
    """Start of the period (UTC). ``week_start``: 0 is Monday."""
    if period is Period.WEEK and week_start:
        back = F.make_dt_interval(F.lit(week_start))
        return F.date_trunc("week", ts - back) + back
    return F.date_trunc(period.value, ts)


def period_add(ts: Column, period: Period, n: Column | int) -> Column:
    n = F.lit(n) if isinstance(n, int) else n
    zero = F.lit(0)
    args = {Period.HOUR: (zero, zero, zero, zero, n), Period.DAY: (zero, zero, zero, n), Period.WEEK: (zero, zero, n), Period.MONTH: (zero, n), Period.YEAR: (n,)}[period]
    return ts + F.make_interval(*args)


def suffix(start: Column, period: Period) -> Column:
    return F.concat(F.lit(period.prefix), F.date_format(start, SPARK_FORMAT[period]))


def parse_suffix(s: Column, period: Period, week_start: int = 0) -> Column:
    """Start that a suffix names; null if its prefix, length or alignment is wrong."""
    fmt = SPARK_FORMAT[period]
    digits = F.substring(s, F.lit(2), F.length(s))
    start = F.try_to_timestamp(digits, F.lit(fmt)).cast("timestamp_ntz")
    fits = (F.substring(s, F.lit(1), F.lit(1)) == period.prefix) & (F.length(s) == len(fmt) + 1) & digits.rlike("^[0-9]+$")
    return F.when(fits & (period_start(start, period, week_start) == start), start)


@dataclass(frozen=True)
class Window:
    """Half open: [start, end)."""

    suffix: str
    start: dt.datetime
    end: dt.datetime


@dataclass(frozen=True)
class RollingWindow:
    """The current period, ``behind`` before and ``ahead`` after it."""

    period: Period
    behind: int
    ahead: int
    week_start: int = 0

    def __post_init__(self):
        if self.behind < 0 or self.ahead < 0:
            raise ValueError("behind and ahead can't be negative")

    def start(self, at: dt.datetime) -> dt.datetime:
        """Start of the period of a moment, in UTC."""
        if at.tzinfo is not None:
            at = at.astimezone(dt.UTC).replace(tzinfo=None)
        hour = at.replace(minute=0, second=0, microsecond=0)
        day = hour.replace(hour=0)
        return {
            Period.HOUR: hour,
            Period.DAY: day,
            Period.WEEK: day - dt.timedelta(days=(day.weekday() - self.week_start) % 7),
            Period.MONTH: day.replace(day=1),
            Period.YEAR: day.replace(month=1, day=1),
        }[self.period]

    def add(self, start: dt.datetime, n: int) -> dt.datetime:
        if self.period in (Period.MONTH, Period.YEAR):
            months = start.year * 12 + start.month - 1 + n * (12 if self.period is Period.YEAR else 1)
            return start.replace(year=months // 12, month=months % 12 + 1)
        return start + n * {Period.HOUR: dt.timedelta(hours=1), Period.DAY: dt.timedelta(days=1), Period.WEEK: dt.timedelta(days=7)}[self.period]

    def name(self, start: dt.datetime) -> str:
        return self.period.prefix + start.strftime(PYTHON_FORMAT[self.period])

    def parse(self, name: str) -> dt.datetime | None:
        """Start that a suffix names; None if it names none of this period's."""
        try:
            start = dt.datetime.strptime(name[1:], PYTHON_FORMAT[self.period])
        except ValueError:
            return None
        return start if self.start(start) == start and self.name(start) == name else None

    def windows(self, now: dt.datetime) -> list[Window]:
        first = self.start(now)
        starts = [self.add(first, n) for n in range(-self.behind, self.ahead + 2)]
        return [Window(self.name(a), a, b) for a, b in zip(starts, starts[1:], strict=False)]

    def floor(self, now: dt.datetime) -> dt.datetime:
        """What starts earlier has aged out."""
        return self.add(self.start(now), -self.behind)

    def frame(self, now: Column, spark) -> DataFrame:
        """The windows as rows ``suffix, start, end``, by expressions over ``now``."""
        n = spark.range(-self.behind, self.ahead + 1).select(F.col("id").cast("int").alias("n"))
        first = period_start(now, self.period, self.week_start)
        at = n.select(period_add(first, self.period, F.col("n")).alias("start"), period_add(first, self.period, F.col("n") + 1).alias("end"))
        return at.select(suffix(F.col("start"), self.period).alias("suffix"), "start", "end")


@dataclass(frozen=True)
class Roll:
    """What a roll does; ``kept`` are suffixes that this policy can't read."""

    add: tuple[Window, ...]
    drop: tuple[str, ...]
    kept: tuple[str, ...]


def roll(policy: RollingWindow, existing: list[str], now: dt.datetime, forward: bool = True, aged: bool = True) -> Roll:
    """Windows to add and aged ones to drop, with the clock read once. What can't be parsed is never dropped."""
    have, floor = set(existing), policy.floor(now)
    parsed = {s: policy.parse(s) for s in existing}
    add = tuple(w for w in policy.windows(now) if w.suffix not in have) if forward else ()
    return Roll(add, tuple(s for s, at in parsed.items() if aged and at is not None and at < floor), tuple(s for s, at in parsed.items() if at is None))


def roll_table(spark, name: str, column: str, plan: Roll) -> None:
    """Carry a roll out on a partitioned table of the catalog."""
    for w in plan.add:
        spark.sql(f"ALTER TABLE {name} ADD IF NOT EXISTS PARTITION ({column} = '{w.suffix}')")
    for s in plan.drop:
        spark.sql(f"ALTER TABLE {name} DROP IF EXISTS PARTITION ({column} = '{s}')")


def sanitised(value: str | Column):
    """A value as a suffix: lower case, what isn't a letter, digit or underscore replaced by one."""
    if isinstance(value, Column):
        return F.regexp_replace(F.lower(value), "[^a-z0-9_]", "_")
    return re.sub("[^a-z0-9_]", "_", value.lower())


def by_range(value: Column, ranges: list[tuple[str, object, object]], default: str | None = "default") -> Column:
    """Suffix of the half-open range that holds a value; nulls and the rest go to the default."""
    out: Column = F.lit(default).cast("string")
    for name, low, high in reversed(ranges):
        out = F.when((value >= F.lit(low)) & (value < F.lit(high)), name).otherwise(out)
    return out


#: Ranges up to which their starts are a literal in the plan.
FEW_RANGES = 1_000


def by_ranges(df: DataFrame, column: str, ranges: DataFrame, default: str = "default") -> DataFrame:
    """As ``by_range`` for ranges in a frame ``suffix, start, end`` that don't overlap.

    A value belongs to the last start that isn't above it. The starts of a few ranges are a literal
    that each row searches; those of many are cut into that many blocks first, so that a row searches
    the literal of the blocks' first starts and then joins its block alone.
    """
    starts = ranges.where("start is not null").select("start").distinct()
    n = starts.count()
    if not n:
        return df.withColumn("suffix", F.lit(default))
    last = lambda at: F.array_max(F.filter(at, lambda s: s <= F.col(column)))
    if n <= FEW_RANGES:
        x = df.withColumn("_at", last(F.array(*(F.lit(r[0]) for r in starts.collect()))))
        return _ended(x, df, column, ranges, default)
    numbered = dense_index(starts, "start", name="_i").withColumn("_block", F.floor(F.col("_i") / max(1, -(-n // FEW_RANGES))))
    heads = [r[0] for r in numbered.groupBy("_block").agg(F.min("start").alias("s")).orderBy("s").select("s").collect()]
    firsts = numbered.groupBy("_block").agg(F.array_sort(F.collect_list("start")).alias("_starts"), F.min("start").alias("_head")).drop("_block")
    x = df.withColumn("_h", last(F.array(*map(F.lit, heads)))).join(firsts, F.col("_h") == F.col("_head"), "left").withColumn("_at", last(F.col("_starts")))
    return _ended(x, df, column, ranges, default)


def _ended(x: DataFrame, df: DataFrame, column: str, ranges: DataFrame, default: str) -> DataFrame:
    x = x.join(ranges.select(F.col("start").alias("_s"), F.col("end").alias("_e"), F.col("suffix").alias("_suffix")), F.col("_at") == F.col("_s"), "left")
    return x.select(*df.columns, F.when(F.col(column) < F.col("_e"), F.col("_suffix")).otherwise(default).alias("suffix"))


def by_list(value: Column, lists: dict[str, list], default: str | None = "default") -> Column:
    pairs = [x for name, values in lists.items() for v in values for x in (F.lit(v), F.lit(name))]
    return F.coalesce(F.create_map(*pairs)[value], F.lit(default)) if pairs else F.lit(default)


def by_hash(value: Column, suffixes: list[str]) -> Column:
    """The modulus is the number of suffixes, the remainder a suffix's position. The hash is the first 32 bits of the text's MD5."""
    n = F.conv(F.substring(F.md5(F.coalesce(value.cast("string"), F.lit("")).cast("binary")), 1, 8), 16, 10).cast("long") % len(suffixes)
    return F.element_at(F.array(*map(F.lit, suffixes)), n.cast("int") + 1)


class Delta(Enum):
    NONE, ADDITIVE, REBUILD = range(3)


def range_delta(expected: list[tuple], actual: list[tuple], managed: bool = False) -> tuple[Delta, list[tuple]]:
    """How a set of ranges changes, and what to add. A managed window matches by suffix and only ever adds."""
    if managed:
        names = {x[0] for x in actual}
        add = [x for x in expected if x[0] not in names]
        return (Delta.ADDITIVE if add else Delta.NONE), add
    add = [x for x in expected if x not in actual]
    if any(x not in expected for x in actual):
        return Delta.REBUILD, expected
    return (Delta.ADDITIVE if add else Delta.NONE), add


def hash_delta(expected: list[str], actual: list[str]) -> Delta:
    return Delta.NONE if expected == actual else Delta.REBUILD


def list_registry(registry: DataFrame) -> DataFrame:
    """``suffix, values`` from ``value, suffix`` rows: one bucket for all values that share a suffix."""
    return registry.select(sanitised(F.col("suffix")).alias("suffix"), "value").groupBy("suffix").agg(F.array_sort(F.collect_set("value")).alias("values"))


def drop_value(registry: DataFrame, value: str) -> tuple[DataFrame, DataFrame]:
    """The registry without a value, and the suffixes whose partition goes: those it alone was in."""
    rest = registry.where(F.col("value") != value)
    was = registry.where(F.col("value") == value).select(sanitised(F.col("suffix")).alias("suffix")).distinct()
    return rest, was.join(rest.select(sanitised(F.col("suffix")).alias("suffix")), "suffix", "left_anti")


def add_values(registry: DataFrame, values: DataFrame) -> DataFrame:
    """``value, suffix`` rows that the registry doesn't have, to append; a value without a suffix takes its own text."""
    new = values.select("value", F.coalesce("suffix", sanitised(F.col("value"))).alias("suffix")).dropDuplicates(["value"])
    return new.join(registry.select("value"), "value", "left_anti")


def list_changes(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """``suffix, state`` between two registries: partitions missing, extra, matched or with different values."""
    key = lambda df, c: list_registry(df).select("suffix", F.array_join("values", "\x1f").alias(c))
    both = key(expected, "e").join(key(actual, "a"), "suffix", "full_outer")
    return both.select("suffix", F.when(F.col("a").isNull(), "missing").when(F.col("e").isNull(), "extra").when(F.col("e") == F.col("a"), "matched").otherwise("different").alias("state"))


def rebuild(df: DataFrame, renamed: dict[str, str], columns: list[str], generated: set[str] = frozenset()) -> DataFrame:
    """The rows of a table for its new layout: shared and renamed columns are copied, generated ones are left to be computed, new ones are null."""
    source = {new: old for old, new in renamed.items()}
    have = {c.lower(): c for c in df.columns}
    pick = lambda c: have.get(source.get(c, c).lower())
    return df.select(*((F.col(pick(c)) if pick(c) else F.lit(None)).alias(c) for c in columns if c not in generated))
