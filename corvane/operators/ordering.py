"""Order without a task that sees all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.operators.lineage import cut


def dense_index(df: DataFrame, by: str, *then: str, name: str = "index") -> DataFrame:
    """Adds each row's position (from 0) in the order of ``by`` (nulls first), then ``then``.

    Rows are dealt to tasks by ranges of the whole key, so rows of one ``by`` are told apart by
    ``then``, sorted there, numbered where they lie and written once; a task's numbers are then shifted
    by the rows of the tasks before it. Only a count per task reaches the driver.
    """
    order = [F.col(by).asc_nulls_first(), *(F.col(c).asc_nulls_first() for c in then)]
    return numbered(df.repartitionByRange(*order).sortWithinPartitions(*order), name)


def numbered(df: DataFrame, name: str = "index") -> DataFrame:
    """Adds each row's position (from 0) in a frame that is sorted over its tasks."""
    # the number of a row within its task stands in the low 33 bits, the task's in those above
    x = cut(df.withColumn("_at", F.monotonically_increasing_id()))
    task = F.shiftright("_at", 33)
    base, start = [], 0
    for r in sorted(x.groupBy(task.alias("t")).count().collect()):
        base.append((r["t"], start))
        start += r["count"]
    shift = F.broadcast(df.sparkSession.createDataFrame(base, "_task long, _base long"))
    placed = x.withColumn("_task", task).join(shift, "_task")
    return placed.select(*df.columns, (F.col("_base") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))).alias(name))


def write_numbered(df: DataFrame, folder: str) -> None:
    """Write ``df`` where its rows lie, for ``read_numbered``; nothing is shuffled, and only a count per task reaches the driver."""
    spark = df.sparkSession
    df.withColumn("_at", F.monotonically_increasing_id()).write.parquet(f"{folder}/rows")
    base, start = [], 0
    for r in sorted(spark.read.parquet(f"{folder}/rows").groupBy(F.shiftright("_at", 33).alias("t")).count().collect()):
        base.append((r["t"], start))
        start += r["count"]
    spark.createDataFrame(base, "_task long, _base long").coalesce(1).write.parquet(f"{folder}/tasks")


def read_numbered(spark: SparkSession, folder: str, name: str = "n") -> DataFrame:
    """The rows written, with a dense number (from 0) in no order that is said."""
    x, tasks = spark.read.parquet(f"{folder}/rows"), spark.read.parquet(f"{folder}/tasks")
    placed = x.join(F.broadcast(tasks), F.shiftright("_at", 33) == F.col("_task"))
    number = (F.col("_base") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))).alias(name)
    return placed.select(number, *(c for c in x.columns if c != "_at"))


def ordered(df: DataFrame, *keys: tuple[str, bool, bool | None]) -> DataFrame:
    """Sort by (column, descending, nulls first). ``None`` follows a server's default: nulls are the largest."""

    def one(c: str, desc: bool, first: bool | None) -> Column:
        first = desc if first is None else first
        x = F.col(c)
        return (x.desc_nulls_first() if first else x.desc_nulls_last()) if desc else (x.asc_nulls_first() if first else x.asc_nulls_last())

    return df.orderBy(*(one(*k) for k in keys))


def newest(df: DataFrame, at: str, n: int) -> DataFrame:
    """The n newest rows; all that tie with the n-th stay.

    The cut-off is found by a top-n of each task, so the rest is a pushed-down filter.
    """
    low, found = df.where(F.col(at).isNotNull()).orderBy(F.col(at).desc()).limit(n).agg(F.min(at), F.count("*")).first()
    return df if found < n else df.where(F.col(at) >= F.lit(low))


def ordered_array(x: str, *by: str) -> Column:
    """Aggregate: the values of a group in order."""
    return F.transform(F.array_sort(F.collect_list(F.struct(*by, x))), lambda s: s[x])


def ordered_string(x: str, sep: str, *by: str) -> Column:
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*by, x))), lambda s: s[x].cast("string")), sep)


def topological(names: list[str], refers_to: dict[str, set[str]]) -> list[str]:
    """Parents before children; references to itself don't count; with a cycle the order given."""
    waiting = {n: {m for m in refers_to.get(n, ()) if m != n and m in names} for n in names}
    out: list[str] = []
    while ready := [n for n in names if n in waiting and not waiting[n]]:
        for n in ready:
            out.append(n)
            del waiting[n]
        for w in waiting.values():
            w.difference_update(ready)
    return list(names) if waiting else out


def matched(expected: DataFrame, actual: DataFrame, key: str, value: str) -> DataFrame:
    """``key, state``: missing, extra, matched or different, by a full outer join on the name whatever its case."""
    e = expected.select(F.lower(key).alias("k"), F.col(key).alias("e_key"), F.col(value).alias("e"))
    a = actual.select(F.lower(key).alias("k"), F.col(key).alias("a_key"), F.col(value).alias("a"))
    state = F.when(F.col("a_key").isNull(), "missing").when(F.col("e_key").isNull(), "extra").when(F.col("e").eqNullSafe(F.col("a")), "matched").otherwise("different")
    return e.join(a, "k", "full_outer").select(F.coalesce("e_key", "a_key").alias(key), state.alias("state"))
