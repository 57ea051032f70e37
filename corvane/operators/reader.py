"""Document reads: one reader with parameters for concurrency, tracking and hierarchy."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corvane.operators import predicate as P


@dataclass(frozen=True)
class Reader:
    """Over a frame with ``id, data`` and metadata columns.

    ``tenant`` and ``hide_deleted`` are filters that every read has. ``tracking``: ``query`` reads
    data alone, ``light`` the version too, ``identity`` keeps the first row of each id (by ``order``),
    ``dirty`` also keeps the JSON as read. ``index``: summaries of the table's files (``sources/indexes.py``);
    with them, every read opens only the files that may hold its rows.
    """

    frame: DataFrame
    tenant: str | None = None
    hide_deleted: bool = True
    tracking: str = "light"
    order: tuple[str, ...] = ()
    subtypes: dict[str, T.StructType] = field(default_factory=dict)
    index: Any = None

    @classmethod
    def over(cls, index: Any, **settings: Any) -> Reader:
        """Over the files that ``index`` summarises."""
        return cls(index.rows(P.FALSE), index=index, **settings)

    def _rows(self, where: P.Predicate) -> DataFrame:
        return P.apply(self.frame, where) if self.index is None else self.index.rows(where)

    def default_filter(self) -> P.Predicate:
        parts = []
        if self.tenant is not None:
            parts.append(P.compare("tenant_id", "=", self.tenant))
        if self.hide_deleted and "deleted" in self.frame.columns:
            parts.append(P.Raw("coalesce(deleted, false) = false"))
        return P.And(*parts)

    def query(self, where: P.Predicate | None = None) -> DataFrame:
        x = self._rows(P.combine_and(self.default_filter(), *([where] if where is not None else [])))
        if self.tracking in ("identity", "dirty"):
            if not self.order:
                raise ValueError("the first row of an id needs an order")
            first = Window.partitionBy("id").orderBy(*self.order)
            x = x.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")
        if self.tracking == "dirty":
            x = x.withColumn("as_read", F.col("data"))
        keep = {"query": ["data"], "light": ["id", "data", *(c for c in ("version",) if c in x.columns)]}.get(self.tracking)
        return x.select(*keep) if keep else x

    def load(self, id_: Any) -> DataFrame:
        return self.query(P.by_id(id_)).limit(1)

    def load_many(self, ids: list | DataFrame) -> DataFrame:
        """Ids without a document are left out."""
        return self.query(P.InSubQuery("id", ids) if isinstance(ids, DataFrame) else P.in_array("id", ids))

    def of_type(self, alias: str) -> DataFrame:
        """One subtype of a hierarchy, its data parsed by that type's schema."""
        x = self.query(P.compare("doc_type", "=", alias)) if self.tracking != "query" else self._rows(P.combine_and(self.default_filter(), P.compare("doc_type", "=", alias)))
        return x.withColumn("data", F.from_json("data", self.subtypes[alias]))


def json_path(data: str | Column, path: str) -> Column:
    return F.get_json_object(data, path)


def project(df: DataFrame, declared: T.StructType) -> DataFrame:
    """The declared columns that the frame has, by name whatever the case, cast to their types; others are skipped."""
    have = {c.lower(): c for c in df.columns}
    return df.select(*(F.col(have[f.name.lower()]).cast(f.dataType).alias(f.name) for f in declared if f.name.lower() in have))


def metadata(df: DataFrame, *, tenant: str | None = None, doc_type: str | None = None, by: str | None = None, causation: str | None = None, correlation: str | None = None, headers: dict | None = None, at: Column | None = None) -> DataFrame:
    """Adds the metadata columns of a write; what isn't given stays null."""
    at = F.current_timestamp() if at is None else at
    text = lambda v: F.lit(v).cast("string")
    heads = F.to_json(F.create_map(*(F.lit(str(x)) for kv in headers.items() for x in kv))) if headers else text(None)
    values = {"tenant_id": text(tenant or "*DEFAULT*"), "doc_type": text(doc_type), "last_modified": at, "created_at": at, "last_modified_by": text(by), "causation_id": text(causation), "correlation_id": text(correlation), "headers": heads, "deleted": F.lit(False), "deleted_at": F.lit(None).cast("timestamp")}
    return df.withColumns({k: v for k, v in values.items() if k not in df.columns})
