"""Tenants: assignment to databases, and identities."""

from __future__ import annotations

import uuid
from enum import Enum

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.operators.ordering import dense_index

#: The offset and prime of the 32-bit FNV-1a hash.
FNV_OFFSET, FNV_PRIME = 2166136261, 16777619


class UnknownTenant(LookupError):
    pass


class EmptyPool(ValueError):
    pass


def fnv1a(text: Column) -> Column:
    """32-bit FNV-1a over UTF-16 code units, as an expression."""
    raw = F.encode(text, "UTF-16BE")
    unit = lambda i: F.conv(F.hex(F.substring(raw, i * 2 + 1, F.lit(2))), 16, 10).cast("bigint")
    units = F.transform(F.sequence(F.lit(0), (F.length(raw) / 2).cast("int") - 1), unit)
    step = lambda h, u: (h.bitwiseXOR(u) * FNV_PRIME).bitwiseAND(F.lit(0xFFFFFFFF))
    return F.when(text == "", F.lit(FNV_OFFSET)).otherwise(F.aggregate(units, F.lit(FNV_OFFSET).cast("bigint"), step))


def fnv1a_of(text: str) -> int:
    h, raw = FNV_OFFSET, text.encode("utf-16-le")
    for i in range(0, len(raw), 2):
        h = (h ^ int.from_bytes(raw[i : i + 2], "little")) * FNV_PRIME & 0xFFFFFFFF
    return h


def by_hash(tenant: Column, databases: list[str]) -> Column:
    """The database at ``hash % n`` of the list."""
    if not databases:
        raise EmptyPool("no database to assign a tenant to")
    return F.element_at(F.array(*map(F.lit, databases)), (fnv1a(tenant) % len(databases)).cast("int") + 1)


def smallest(pool: DataFrame) -> DataFrame:
    """The open database with the fewest tenants; of equal ones the first by position. ``database_id, tenant_count, is_full, position``."""
    return pool.where(~F.col("is_full")).orderBy("tenant_count", "position").limit(1)


def smallest_in(pool: DataFrame, *keys: str) -> DataFrame:
    """``keys, database_id``: the smallest open database of each group."""
    first = F.min_by("database_id", F.struct("tenant_count", "position"))
    return pool.where(~F.col("is_full")).groupBy(*keys).agg(first.alias("database_id"))


def smallest_of(pool: DataFrame) -> str:
    row = smallest(pool).first()
    if row is None:
        raise EmptyPool("no database with room")
    return row["database_id"]


def explicit(tenant: str, assigned: dict[str, str]) -> str:
    try:
        return assigned[tenant]
    except KeyError:
        raise UnknownTenant(tenant) from None


def assigned(rows: DataFrame, assignment: DataFrame) -> DataFrame:
    """Rows with the database of their tenant; a tenant without one has null."""
    return rows.join(assignment.select("tenant_id", "database_id"), "tenant_id", "left")


def ordinals(registry: DataFrame, tenants: DataFrame) -> DataFrame:
    """``tenant_id, bucket, ordinal`` for new tenants: those of one bucket (whatever its case) share an ordinal, new buckets follow the highest.

    New buckets are numbered in the order of their names.
    """
    known = registry.select(F.lower("bucket").alias("b"), F.col("ordinal").alias("known")).distinct()
    new = tenants.join(registry.select("tenant_id"), "tenant_id", "left_anti").withColumn("b", F.lower("bucket"))
    fresh = new.join(known, "b", "left_anti").select("b").distinct()
    top = registry.agg(F.max("ordinal")).first()[0] or 0
    fresh = dense_index(fresh, "b", name="i").select("b", (F.lit(top) + F.col("i") + 1).alias("fresh"))
    return new.join(known, "b", "left").join(fresh, "b", "left").select("tenant_id", "bucket", F.coalesce("known", "fresh").alias("ordinal"))


class DropTenant(Enum):
    RETAIN_DATA, DELETE_DATA = range(2)


def drop_tenant(registry: DataFrame, data: DataFrame, tenant: str, how: DropTenant) -> tuple[DataFrame, DataFrame]:
    """Registry and data afterwards."""
    rest = registry.where(F.col("tenant_id") != tenant)
    return rest, data.where(~F.col("tenant_id").eqNullSafe(tenant)) if how is DropTenant.DELETE_DATA else data


def hilo(df: DataFrame, by: str, *then: str, first_hi: int = 0, max_lo: int = 1000, name: str = "id") -> DataFrame:
    """Block-allocated identities ``hi * max_lo + lo`` (lo from 1), in the order of ``by``; the driver allots blocks from ``first_hi`` on."""
    x = dense_index(df, by, *then, name="_i")
    hi = F.lit(first_hi) + F.floor(F.col("_i") / max_lo)
    return x.withColumn(name, (hi * max_lo + 1 + F.col("_i") % max_lo).cast("long")).drop("_i")


def blocks_needed(rows: int, max_lo: int = 1000) -> int:
    return -(-rows // max_lo)


def time_ordered_uuid(at: Column, seed: Column) -> Column:
    """A version 7 identifier: milliseconds of ``at``, then bits of a hash of ``seed``."""
    ms = F.lpad(F.lower(F.hex(F.unix_millis(at))), 12, "0")
    rest = F.md5(seed.cast("string").cast("binary"))
    variant = F.element_at(F.array(*map(F.lit, "89ab")), F.pmod(F.xxhash64(seed), F.lit(4)).cast("int") + 1)
    s = lambda c, a, n: F.substring(c, a, n)
    return F.concat(s(ms, 1, 8), F.lit("-"), s(ms, 9, 4), F.lit("-7"), s(rest, 1, 3), F.lit("-"), variant, s(rest, 4, 3), F.lit("-"), s(rest, 7, 12))


def assign_missing(df: DataFrame, column: str, new: Column, empty=None) -> DataFrame:
    """Identities where there are none: null, or the type's empty value (0, the nil identifier)."""
    c = F.col(column)
    missing = c.isNull() | (c == F.lit(empty)) if empty is not None else c.isNull()
    return df.withColumn(column, F.when(missing, new).otherwise(c))


NIL_UUID = str(uuid.UUID(int=0))


def keyed(alias: str, number: Column) -> Column:
    """Identities like ``alias/7``."""
    return F.concat(F.lit(alias + "/"), number.cast("string"))
