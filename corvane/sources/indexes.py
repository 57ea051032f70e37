"""Indexes as layout: what a reader can skip, because of how files are written or what is known of each.

``write_ordered`` is the lookup index (btree, hash): a table in ranges of its key, sorted within files, with
bloom filters on the key. A reader of some keys opens the files whose ranges hold them and, within those,
the row groups whose statistics and filters do.

``Summaries`` is the block-range index (brin): the smallest and largest value, the nulls and the rows of
each file, in a small table beside the data. A predicate is turned into one over that table; files
that can't hold a row for which it is true never get into the plan. Files written since are read whole
until ``refresh`` looks at them, and at nothing else; files that are gone are left out.

Defined results: rows are those of a scan with the same predicate, whatever is known of the files; values
that are null are held by no range (a file of nulls alone is skipped by comparisons); NaN is the largest; a
predicate on a column without a summary, or of a kind that says nothing of ranges, skips no file.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.operators import predicate as P
from corvane.sources.schema import Index

#: Rows of a file of a table in order, and bytes of its row groups.
FILE_ROWS, GROUP_BYTES = 4_000_000, 32 << 20


class NotUnique(ValueError):
    pass


def plain(path: str) -> str:
    """A path in one form: listings and scans differ in slashes after the scheme, and in escapes."""
    return re.sub(r"^(\w+):/+", r"\1:/", unquote(path))


def repeated(df: DataFrame, index: Index) -> DataFrame:
    """Keys that a unique index would refuse, with their number: of the rows that its predicate admits, and without nulls."""
    x = df.where(index.predicate) if index.predicate else df
    return x.dropna(subset=list(index.columns)).groupBy(*index.columns).count().where("count > 1")


def write_ordered(df: DataFrame, folder: str, index: Index, file_rows: int = FILE_ROWS, group_bytes: int = GROUP_BYTES, options: dict[str, str] | None = None) -> None:
    """Write ``df`` as the table that ``index`` describes; raises, before anything is written, if it is unique and keys repeat.

    An index with ``include`` or a ``predicate`` is a table of its own, of those columns and rows.
    """
    if index.unique and (some := repeated(df, index).limit(5).collect()):
        raise NotUnique(f"{index.name}: {', '.join(str(tuple(r)[:-1]) for r in some)}")
    if index.predicate:
        df = df.where(index.predicate)
    if index.include:
        df = df.select(*index.columns, *index.include)
    order = _order(index)
    n = max(1, -(-df.count() // file_rows))
    write_sorted(df.repartitionByRange(n, *order), folder, index, group_bytes, options)


def _order(index: Index) -> list[Column]:
    return [F.col(c).desc() if index.descending else F.col(c).asc() for c in index.columns]


def write_sorted(df: DataFrame, folder: str, index: Index, group_bytes: int = GROUP_BYTES, options: dict[str, str] | None = None) -> None:
    """Write rows that lie in ranges of the index's key, sorted within each."""
    out = df.sortWithinPartitions(*_order(index)).write.options(**(options or {})).option("parquet.block.size", group_bytes)
    for c in index.columns:
        out = out.option(f"parquet.bloom.filter.enabled#{c}", "true").option(f"parquet.bloom.filter.adaptive.enabled#{c}", "true")
    out.parquet(folder)


def may_hold(p: P.Predicate | None, columns: set[str]) -> Column:
    """Whether a file with the summary in this row may hold a row for which ``p`` is true."""
    yes = F.lit(True)
    bounds = lambda c: (F.col(f"low_{c}"), F.col(f"high_{c}"))
    sure = lambda c: F.coalesce(c, F.lit(False))  # noqa: E731 (null: the file has no value at all)

    def one_of(c: str, values: tuple) -> Column:
        low, high = bounds(c)
        held = F.array(*map(F.lit, values)) if values else None
        return sure(F.exists(held, lambda v: (low <= v) & (v <= high))) if values else F.lit(False)

    if isinstance(p, P.Compound) and p.items:
        parts = [may_hold(x, columns) for x in p.items]
        return reduce((lambda a, b: a & b) if p.separator == "and" else (lambda a, b: a | b), parts)
    if isinstance(p, P.Always):
        return F.lit(p.value)
    if isinstance(p, P.Comparison):
        if isinstance(p.left, P.Parameter) and isinstance(p.right, P.Ref) and p.op in P.SWAPPED:
            p = p.swap()
        if not (isinstance(p.left, P.Ref) and p.left.name in columns and isinstance(p.right, P.Parameter) and p.right.value is not None):
            return yes
        (low, high), v = bounds(p.left.name), p.right.column()
        rule = {"=": (low <= v) & (v <= high), "!=": (low != v) | (high != v), "<": low < v, "<=": low <= v, ">": high > v, ">=": high >= v}.get(p.op)
        return yes if rule is None else sure(rule)
    if isinstance(p, P.InArray):
        return one_of(p.locator, tuple(v for v in p.values if v is not None)) if p.locator in columns else yes
    if type(p) is P.EnumIsOneOf and p.locator in columns:
        found = one_of(p.locator, p.stored())
        return found | (F.col(f"nulls_{p.locator}") > 0) if None in p.values else found
    return yes


@dataclass(frozen=True)
class Summaries:
    """Of the Parquet files of ``folder``, by column; kept in ``<folder>.summaries``, a part for each refresh."""

    spark: SparkSession
    folder: str
    columns: tuple[str, ...]

    @property
    def place(self) -> str:
        return f"{self.folder.rstrip('/')}.summaries"

    def files(self) -> dict[str, str]:
        """Each file as readers take it, by its one form."""
        return {plain(f): unquote(f) for f in self.spark.read.parquet(self.folder).inputFiles()}

    def _summarised(self, files: list[str] | None = None) -> DataFrame:
        x = self.spark.read.schema(self.spark.read.parquet(self.folder).schema).parquet(*(files or [self.folder]))
        aggs = [a for c in self.columns for a in (F.min(c).alias(f"low_{c}"), F.max(c).alias(f"high_{c}"), F.count_if(F.col(c).isNull()).alias(f"nulls_{c}"))]
        return x.groupBy(F.col("_metadata.file_path").alias("path")).agg(F.count("*").alias("n"), *aggs)

    def create(self) -> Summaries:
        self._summarised().coalesce(1).write.mode("overwrite").parquet(self.place)
        return self

    def table(self) -> DataFrame:
        return self.spark.read.parquet(self.place)

    def refresh(self) -> int:
        """Look at the files written since; how many there were."""
        have = {plain(r["path"]) for r in self.table().select("path").collect()}
        if new := [path for f, path in sorted(self.files().items()) if f not in have]:
            self._summarised(new).coalesce(1).write.mode("append").parquet(self.place)
        return len(new)

    def kept(self, p: P.Predicate | None) -> list[str]:
        """The files that may hold rows for ``p``. Names and verdicts reach the driver, as any listing of files does."""
        there = self.files()
        said = {plain(r["path"]): r["may"] for r in self.table().select("path", may_hold(p, set(self.columns)).alias("may")).collect()}
        return sorted(path for f, path in there.items() if said.get(f, True))

    def rows(self, p: P.Predicate | None = None) -> DataFrame:
        """The rows for ``p``, of the files that may hold any."""
        kind = self.spark.read.parquet(self.folder).schema
        files = self.kept(p)
        x = self.spark.read.schema(kind).parquet(*files) if files else self.spark.createDataFrame([], kind)
        return P.apply(x, p)
