"""Overlap of intervals through grids of several sizes.

An interval ``[start, end)`` of length L has the level k with 2^(k-1) < L <= 2^k, so in a grid of cells of 2^k it
lies in two cells at most. A pair meets in the grid of the longer of the two: each interval is put into the
cells of its own level and of the levels above that any interval has, never of those below, so a long one
isn't cut into many cells and a short one isn't compared with short ones elsewhere. A pair is taken in the
cell that holds the later start, so once. Meetings are equi-joins; a coarse grid's crowded cells are
crowded by short intervals, which there meet only intervals of that level, and adaptive execution splits
them.

Where columns must be equal too, most of their values have few rows, and those are compared with each other as they
are: rows travel once and in no grid. Values of over ``FEW`` rows, counted in both sides, go through the grids.

Defined results: bounds are numbers or times; an interval with a null bound, or that doesn't end after it starts,
overlaps nothing; intervals that only touch don't overlap; repeated rows each pair.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corvane.operators.lineage import written

#: Rows of one value of the columns that must be equal, up to which all are compared with all.
FEW = 256


def _number(df: DataFrame, column: str) -> Column:
    """A bound as a whole number; fractions are kept to a millionth, times to a microsecond."""
    kind, c = df.schema[column].dataType, F.col(column)
    if isinstance(kind, T.TimestampType):
        return F.unix_micros(c)
    if isinstance(kind, T.TimestampNTZType):
        return F.unix_micros(c.cast("timestamp"))
    if isinstance(kind, T.DateType):
        return F.unix_date(c).cast("long")
    return c if isinstance(kind, T.IntegralType) else F.floor(c * 1_000_000)


def level(length: Column) -> Column:
    """The smallest k with length <= 2^k."""
    return F.when(length <= 1, 0).otherwise(F.length(F.bin(length - 1))).cast("int")


def _placed(df: DataFrame, start: str, end: str, side: str, levels: list[int]) -> DataFrame:
    """A row for each cell: ``k, cell, own`` and the interval as ``<side>_s``, ``<side>_e``, the rest as a struct."""
    x = df.select(F.struct(*df.columns).alias(side), _number(df, start).cast("long").alias("s"), _number(df, end).cast("long").alias("e")).where("e > s")
    x = x.withColumn("mine", level(F.col("e") - F.col("s")))
    x = x.withColumn("k", F.explode(F.filter(F.array(*(F.lit(k) for k in levels)), lambda k: k >= F.col("mine"))))
    cells = F.sequence(F.expr("shiftright(s, k)"), F.expr("shiftright(e - 1, k)"))
    return x.select(side, F.col("s").alias(f"{side}_s"), F.col("e").alias(f"{side}_e"), "k", (F.col("k") == F.col("mine")).alias(f"{side}_own"), F.explode(cells).alias("cell"))


def _levels(df: DataFrame, start: str, end: str) -> set[int]:
    length = _number(df, end).cast("long") - _number(df, start).cast("long")
    return {r[0] for r in df.where(length > 0).select(level(length).alias("k")).distinct().collect()}  # 63 at most


def _crowded(left: DataFrame, right: DataFrame, on: tuple[str, ...], few: int) -> DataFrame | None:
    """The values of ``on`` that over ``few`` rows have, stored; None where there are none."""
    spark = left.sparkSession
    n = left.select(*on).unionByName(right.select(*on)).groupBy(*on).count().where(F.col("count") > few).select(*on)
    out = spark.read.schema(n.schema).parquet(written(n))
    return None if out.isEmpty() else out


def _compared(left: DataFrame, right: DataFrame, left_bounds: tuple[str, str], right_bounds: tuple[str, str], on: tuple[str, ...]) -> DataFrame:
    """All rows of equal ``on`` with each other."""

    def side(df: DataFrame, bounds: tuple[str, str], name: str) -> DataFrame:
        x = df.select(F.struct(*df.columns).alias(name), *(_number(df, c).cast("long").alias(f"{name}_{k}") for c, k in zip(bounds, "se", strict=True)))
        return x.where(f"{name}_e > {name}_s")

    a, b = side(left, left_bounds, "l"), side(right, right_bounds, "r")
    meets = (F.col("l_s") < F.col("r_e")) & (F.col("r_s") < F.col("l_e"))
    return a.join(b, [*(a["l"][c] == b["r"][c] for c in on), meets]).select("l", "r")


def overlaps(left: DataFrame, right: DataFrame, left_bounds: tuple[str, str], right_bounds: tuple[str, str], on: tuple[str, ...] = (), few: int = FEW) -> DataFrame:
    """``l`` and ``r``, structs of the rows of both sides whose intervals overlap (and whose columns ``on`` are equal)."""
    if not on:
        return _in_grids(left, right, left_bounds, right_bounds, on)
    hot = _crowded(left, right, on, few)
    if hot is None:
        return _compared(left, right, left_bounds, right_bounds, on)
    of = lambda how: (x.join(hot, list(on), how).select(*x.columns) for x in (left, right))
    return _compared(*of("left_anti"), left_bounds, right_bounds, on).unionByName(_in_grids(*of("left_semi"), left_bounds, right_bounds, on))


def _in_grids(left: DataFrame, right: DataFrame, left_bounds: tuple[str, str], right_bounds: tuple[str, str], on: tuple[str, ...]) -> DataFrame:
    levels = sorted(_levels(left, *left_bounds) | _levels(right, *right_bounds)) or [0]
    a, b = _placed(left, *left_bounds, "l", levels), _placed(right, *right_bounds, "r", levels)
    key = [a["k"] == b["k"], a["cell"] == b["cell"], *(a["l"][c] == b["r"][c] for c in on)]
    meets = (F.col("l_s") < F.col("r_e")) & (F.col("r_s") < F.col("l_e")) & (F.expr("shiftright(greatest(l_s, r_s), k)") == F.col("cell"))
    # those of a level meet all that is there, and those from below only them
    one = a.where("l_own").join(b, key).drop(b["k"]).drop(b["cell"]).where(meets)
    two = a.where("NOT l_own").join(b.where("r_own"), key).drop(b["k"]).drop(b["cell"]).where(meets)
    return one.select("l", "r").unionByName(two.select("l", "r"))


def self_overlaps(df: DataFrame, bounds: tuple[str, str], id_: str, on: tuple[str, ...] = ()) -> DataFrame:
    """Each pair of different ids once, the smaller as ``l``."""
    return overlaps(df, df, bounds, bounds, on).where(F.col("l")[id_] < F.col("r")[id_])
