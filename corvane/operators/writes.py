"""Document writes as plans: a current table and a batch of operations give the next table and the rejections.

Every operation (insert, update, upsert, overwrite) in every concurrency mode (off, optimistic,
numeric) is one fold. A batch may hold several operations for an id; they see each other in the order
of ``op_seq``, as statements run one by one would. The fold runs in the JVM, over one full outer join
on the id; nothing but the operations of one id is gathered.

Columns: current ``id, data, version`` (a string where optimistic, a long where numeric, absent where
off); incoming ``id, data, op_seq``, with ``expected, new_version`` where optimistic and ``revision``
where numeric (0: the next one).
"""

from __future__ import annotations

from enum import Enum

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class Role(Enum):
    """What an operation does to a store."""

    UPSERT, INSERT, UPDATE, DELETION, PATCH, OTHER, EVENTS = range(7)


class Op(Enum):
    INSERT, UPDATE, UPSERT, OVERWRITE = "insert", "update", "upsert", "overwrite"

    @property
    def role(self) -> Role:
        return {Op.INSERT: Role.INSERT, Op.UPDATE: Role.UPDATE}.get(self, Role.UPSERT)


class Mode(Enum):
    OFF, OPTIMISTIC, NUMERIC = "off", "optimistic", "numeric"


class BulkMode(Enum):
    INSERTS_ONLY, IGNORE_DUPLICATES, OVERWRITE_EXISTING, OVERWRITE_IF_VERSION_MATCHES = range(4)


EXISTS, MISSING, CONFLICT = "exists", "missing", "conflict"


def _rules(op: Op, mode: Mode, s: Column, x: Column, first_revision: Column) -> tuple[Column, Column]:
    """Why an operation ``x`` on the state ``s`` is refused (null if it isn't), and its new version."""
    there, none = s["there"], F.lit(None).cast("string")
    guard = F.lit(True)
    version: Column = F.lit(None).cast("string")
    if mode is Mode.OPTIMISTIC:
        # an unknown expected version is null and matches nothing
        guard, version = F.coalesce(s["version"] == x["expected"], F.lit(False)), x["new_version"]
    elif mode is Mode.NUMERIC:
        auto = x["revision"] == 0
        guard = auto | (s["version"] < x["revision"])
        version = F.when(~auto, x["revision"]).when(there, s["version"] + 1).otherwise(first_revision)
    if op is Op.INSERT:
        why = F.when(there, F.lit(EXISTS))
    elif op is Op.UPDATE:
        absent = CONFLICT if mode is Mode.OPTIMISTIC else MISSING
        why = F.when(~there, F.lit(absent)).when(~guard, F.lit(CONFLICT))
    elif op is Op.UPSERT:
        why = F.when(there & ~guard, F.lit(CONFLICT))
    else:
        why = none
    return why, version


def plan_write(current: DataFrame, incoming: DataFrame, op: Op, mode: Mode, first_revision: str | None = None) -> DataFrame:
    """One row per id: ``id, there, data, version, rejected`` (an array of ``op_seq, reason``).

    ``first_revision``: a column of incoming with the revision of a new document whose own is 0 (the
    version of its stream); 1 where it is null or not given.
    """
    kind = "long" if mode is Mode.NUMERIC else "string"
    extra = {Mode.OFF: [], Mode.OPTIMISTIC: ["expected", "new_version"], Mode.NUMERIC: ["revision"]}[mode]
    first = F.coalesce(F.col(first_revision), F.lit(1)) if first_revision else F.lit(1)
    steps = incoming.select("id", F.struct("op_seq", "data", *extra, first.cast("long").alias("first")).alias("x"))
    steps = steps.groupBy("id").agg(F.sort_array(F.collect_list("x")).alias("ops"))
    version = F.col("version").cast(kind) if mode is not Mode.OFF else F.lit(None).cast(kind)
    state = current.select("id", F.lit(True).alias("was"), "data", version.alias("version"))
    both = state.join(steps, "id", "full_outer")
    refused = "array<struct<op_seq:bigint,reason:string>>"
    start = F.struct(F.coalesce("was", F.lit(False)).alias("there"), F.col("data").alias("data"), F.col("version").alias("version"), F.array().cast(refused).alias("rejected"))

    def step(s: Column, x: Column) -> Column:
        why, new = _rules(op, mode, s, x, x["first"])
        entry = F.array(F.struct(x["op_seq"].cast("bigint").alias("op_seq"), why.alias("reason")))
        ok = why.isNull()
        return F.struct(
            (s["there"] | ok).alias("there"),
            F.when(ok, x["data"]).otherwise(s["data"]).alias("data"),
            F.when(ok, new.cast(kind)).otherwise(s["version"]).alias("version"),
            F.when(ok, s["rejected"]).otherwise(F.concat(s["rejected"], entry)).cast(refused).alias("rejected"),
        )

    # most ids have no operation; they skip the fold
    folded = F.when(F.col("ops").isNull(), start).otherwise(F.aggregate("ops", start, step))
    return both.select("id", folded.alias("s")).select("id", "s.*")


def next_state(plan: DataFrame) -> DataFrame:
    return plan.where("there").select("id", "data", "version")


def rejections(plan: DataFrame) -> DataFrame:
    return plan.select("id", F.explode("rejected").alias("r")).select("id", "r.op_seq", "r.reason")


def bulk(current: DataFrame, incoming: DataFrame, mode: BulkMode, key: str = "id") -> DataFrame:
    """The next table of a bulk load whose keys are distinct. InsertsOnly raises on a known key."""
    if mode is BulkMode.INSERTS_ONLY:
        if not incoming.join(current.select(key), key, "left_semi").isEmpty():
            raise ValueError("a document of the batch exists")
        return current.unionByName(incoming.select(*current.columns))
    if mode is BulkMode.IGNORE_DUPLICATES:
        return current.unionByName(incoming.select(*current.columns).join(current.select(key), key, "left_anti"))
    new, n = [c for c in current.columns if c != key], F.struct(*(F.col(c) for c in incoming.columns if c != key))
    both = current.withColumn("_old", F.lit(True)).join(incoming.select(key, n.alias("_new")), key, "full_outer")
    wins = F.col("_new").isNotNull()
    if mode is BulkMode.OVERWRITE_IF_VERSION_MATCHES:
        wins &= F.col("_old").isNull() | (F.col("version") == F.col("_new.expected"))
    wins = F.coalesce(wins, F.lit(False))
    return both.select(key, *(F.when(wins, F.col(f"_new.{c}")).otherwise(F.col(c)).alias(c) for c in new))


def upsert_columns(current: DataFrame, incoming: DataFrame, key: list[str], updated: list[str]) -> DataFrame:
    """Insert or update by primary key; columns that aren't listed keep their old values."""
    rest = [c for c in current.columns if c not in key]
    fresh = incoming.select(*key, F.struct(*(F.col(c) for c in rest)).alias("_new"))
    both = current.withColumn("_old", F.lit(True)).join(fresh, key, "full_outer")
    take = lambda c: F.col("_new").isNotNull() & (F.lit(c in updated) | F.col("_old").isNull())
    return both.select(*key, *(F.when(take(c), F.col(f"_new.{c}")).otherwise(F.col(c)).alias(c) for c in rest)).select(*current.columns)


def soft_delete(current: DataFrame, ids: DataFrame, at: Column, key: str = "id") -> DataFrame:
    """Flags documents as deleted; those deleted before keep their time."""
    hit = ids.select(key).distinct().withColumn("_hit", F.lit(True))
    x = current.join(hit, key, "left").withColumn("_now", F.coalesce("_hit", F.lit(False)) & ~F.coalesce("deleted", F.lit(False)))
    x = x.withColumn("deleted_at", F.when(F.col("_now"), at).otherwise(F.col("deleted_at")))
    return x.withColumn("deleted", F.coalesce("deleted", F.lit(False)) | F.col("_now")).drop("_hit", "_now")


def hard_delete(current: DataFrame, ids: DataFrame, key: str = "id") -> DataFrame:
    return current.join(ids.select(key), key, "left_anti")


def canonical_json(c: Column) -> Column:
    """JSON text with its keys in order; text that is no JSON stays."""
    return F.coalesce(F.try_parse_json(c).cast("string"), c)


def json_changed(a: Column, b: Column) -> Column:
    """Whether two JSON texts differ other than by the order of keys. Equal texts are not parsed."""
    return F.when(a.eqNullSafe(b), F.lit(False)).otherwise(~canonical_json(a).eqNullSafe(canonical_json(b)))


def changes(before: DataFrame, after: DataFrame, versioned: bool = False, checks: bool = True, key: str = "id") -> DataFrame:
    """``id, data, op`` of the documents that changed in a session."""
    op = Op.OVERWRITE if versioned and not checks else Op.UPSERT
    both = before.select(key, F.col("data").alias("_was")).join(after.select(key, "data"), key)
    return both.where(json_changed(F.col("_was"), F.col("data"))).select(key, "data", F.lit(op.value).alias("op"))


def insert_absent(registry: DataFrame, rows: DataFrame, key: list[str]) -> DataFrame:
    """Rows whose keys the registry doesn't have, one for each key, to append."""
    return rows.dropDuplicates(key).join(registry.select(*key), key, "left_anti")
