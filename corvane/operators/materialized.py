"""Stored aggregates that are refreshed by what changed.

A view is ``keys`` with counts, sums, means and extremes, kept in ``buckets`` of a hash of the keys. A refresh takes
the rows that were inserted and those that were deleted (an update is both), adds them up by key, and reads
and writes only the buckets that they touch: its cost is that of the change. Counts and sums are
added and taken off; extremes take what was inserted, and only where a deleted row had the extreme
itself is the group recounted, from the base rows of such groups alone.

Changes come in numbered batches. A row keeps the batch that wrote it and buckets are replaced whole, one by
one, so a refresh that died in between is run again: buckets that have the batch already are passed over.

Sums are decimals, so that what is taken off is what was added. Defined results: nulls are left out of sums
and extremes and are a key of their own; a group whose last row is deleted is gone (its row stays, with a
count of 0, and isn't read); a mean of no value, like any aggregate of none, is null; deleting
rows that were never there leaves counts that are wrong, and raises where one falls below 0.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.operators.lineage import cut

SUM = "decimal(38,6)"


@dataclass(frozen=True)
class Stored:
    """``sums`` and ``extremes`` name columns of the base; the view has ``n``, ``sum_<c>``, ``mean_<c>``, ``min_<c>``, ``max_<c>``."""

    spark: SparkSession
    folder: str
    keys: tuple[str, ...]
    sums: tuple[str, ...] = ()
    extremes: tuple[str, ...] = ()
    buckets: int = 64

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int").alias("bucket")

    def _added(self, rows: DataFrame) -> DataFrame:
        """Keys and parts of the aggregates of some rows; combined in the task before anything is shuffled."""
        aggs = [F.count("*").alias("n")]
        for c in self.sums:
            aggs += [F.sum(F.col(c).cast(SUM)).cast(SUM).alias(f"sum_{c}"), F.count(c).alias(f"values_{c}")]
        for c in self.extremes:
            aggs += [F.min(c).alias(f"min_{c}"), F.max(c).alias(f"max_{c}")]
        return rows.groupBy(*self.keys).agg(*aggs)

    def _write(self, df: DataFrame, mode: str) -> None:
        df.repartition("bucket").write.option("partitionOverwriteMode", "dynamic").mode(mode).partitionBy("bucket").parquet(self.folder)

    def create(self, base: DataFrame) -> Stored:
        x = self._added(base).withColumn("batch", F.lit(0).cast("long"))
        self._write(x.select("*", self._bucket()), "errorifexists")
        return self

    def _rows(self) -> DataFrame:
        return self.spark.read.parquet(self.folder)

    def read(self) -> DataFrame:
        """The view."""
        mean = [F.try_divide(F.col(f"sum_{c}"), F.col(f"values_{c}")).cast("double").alias(f"mean_{c}") for c in self.sums]
        sums = [F.when(F.col(f"values_{c}") > 0, F.col(f"sum_{c}")).alias(f"sum_{c}") for c in self.sums]
        ends = [f"{m}_{c}" for c in self.extremes for m in ("min", "max")]
        return self._rows().where("n > 0").select(*self.keys, "n", *sums, *mean, *ends)

    def refresh(self, batch: int, inserted: DataFrame | None, deleted: DataFrame | None, base: DataFrame) -> list[int]:
        """Apply a batch of changes; ``base`` has them already. The buckets that were written."""
        sides = {}
        for name, rows in (("i", inserted), ("d", deleted)):
            x = self._added(rows if rows is not None else base.limit(0))
            sides[name] = x.select(*(F.col(k).alias(f"{name}_{k}") for k in self.keys), F.struct(*(c for c in x.columns if c not in self.keys)).alias(name))
        on = [F.col(f"i_{k}").eqNullSafe(F.col(f"d_{k}")) for k in self.keys]
        delta = sides["i"].join(sides["d"], on, "full_outer")
        delta = delta.select(*(F.when(F.col("i").isNotNull(), F.col(f"i_{k}")).otherwise(F.col(f"d_{k}")).alias(k) for k in self.keys), "i", "d")
        delta = cut(delta.select("*", self._bucket()))
        touched = [r[0] for r in delta.select("bucket").distinct().collect()]  # as many as there are buckets at most
        if not touched:
            return []
        held = self._rows().where(F.col("bucket").isin(*touched))
        done = {r["bucket"] for r in held.where(F.col("batch") >= batch).select("bucket").distinct().collect()}
        todo = sorted(set(touched) - done)
        if not todo:
            return []
        held, delta = held.where(F.col("bucket").isin(*todo)), delta.where(F.col("bucket").isin(*todo))
        merged = cut(self._merged(held, delta, batch))
        if not merged.where("n < 0").isEmpty():
            raise ValueError("more rows were deleted than there were")
        self._write(self._recounted(merged, base).select(*held.columns), "overwrite")
        return todo

    def _merged(self, held: DataFrame, delta: DataFrame, batch: int) -> DataFrame:
        """The new rows of the buckets; ``stale`` where an extreme was deleted."""
        kept = [c for c in held.columns if c not in ("bucket", "batch", *self.keys)]
        h = held.select(*(F.col(k).alias(f"h_{k}") for k in self.keys), F.struct(*kept).alias("h"), F.col("batch").alias("was"), F.col("bucket").alias("h_bucket"))
        x = h.join(delta, [F.col(f"h_{k}").eqNullSafe(F.col(k)) for k in self.keys], "full_outer")
        zero = lambda c, kind="long": F.coalesce(c, F.lit(0).cast(kind)).cast(kind)
        net = lambda c, kind="long": (zero(F.col(f"h.{c}"), kind) + zero(F.col(f"i.{c}"), kind) - zero(F.col(f"d.{c}"), kind)).cast(kind).alias(c)
        out = [F.when(F.col("h").isNotNull(), F.col(f"h_{k}")).otherwise(F.col(k)).alias(k) for k in self.keys] + [net("n")]
        for c in self.sums:
            out += [net(f"sum_{c}", SUM), net(f"values_{c}")]
        stale = F.lit(False)
        for c in self.extremes:
            for m, pick, beats in ((f"min_{c}", F.least, "<="), (f"max_{c}", F.greatest, ">=")):
                best = pick(F.col(f"h.{m}"), F.col(f"i.{m}"))
                out.append(best.alias(m))
                stale |= F.coalesce(F.col(f"d.{m}") <= best if beats == "<=" else F.col(f"d.{m}") >= best, F.lit(False))
        changed = F.when(F.col("i").isNotNull() | F.col("d").isNotNull(), F.lit(batch)).otherwise(F.col("was"))
        out += [changed.cast("long").alias("batch"), F.coalesce("h_bucket", "bucket").alias("bucket"), stale.alias("stale")]
        return x.select(*out)

    def _recounted(self, merged: DataFrame, base: DataFrame) -> DataFrame:
        """Extremes of the stale groups from their base rows."""
        if not self.extremes:
            return merged
        stale = merged.where("stale and n > 0").select(*self.keys).distinct()
        same = lambda a, b: [a[k].eqNullSafe(b[k]) for k in self.keys]
        ends = [a for c in self.extremes for a in (F.min(c).alias(f"new_min_{c}"), F.max(c).alias(f"new_max_{c}"))]
        fresh = base.join(stale, same(base, stale), "left_semi").groupBy(*self.keys).agg(*ends, F.lit(True).alias("_fresh"))
        fresh = fresh.select(*(F.col(k).alias(f"f_{k}") for k in self.keys), *(c for c in fresh.columns if c not in self.keys))
        x = merged.join(fresh, [F.col(k).eqNullSafe(F.col(f"f_{k}")) for k in self.keys], "left")
        names = [f"{m}_{c}" for c in self.extremes for m in ("min", "max")]
        return x.withColumns({c: F.when(F.col("stale"), F.col(f"new_{c}")).otherwise(F.col(c)) for c in names})
