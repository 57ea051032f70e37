"""Containment of JSON (``@>``) through an index of its leaves.

A document contains another if it has all of its keys with values that contain the other's, an element for
each of its elements (whatever their order and number), and equal scalars; an array also contains a
scalar that is one of its elements, at the top alone. Whatever contains ``q`` has the leaves of ``q``: the index
keeps, for the hash of each leaf (the keys that lead to it and its value; places in arrays don't count),
the sorted documents that have it, cut into blocks of ``BLOCK`` documents. A search intersects the lists
of the leaves of ``q`` block by block and looks at what is left with ``contains``, over VARIANT, which
decides. A ``q`` without leaves (``{}``, ``{"a": []}``) says nothing to the index: all documents are looked at.

Defined results: text that is no JSON, or null, is no document and is never found; numbers are equal by value
(1, 1.0); of repeated keys the last counts, as the parser says; ids may repeat.
"""

from __future__ import annotations

import json
from dataclasses import dataclass
from decimal import Decimal
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.operators.lineage import cut, written
from corvane.operators.ordering import read_numbered, write_numbered
from corvane.sources.indexes import write_ordered
from corvane.sources.schema import Index

#: Documents of a block.
BLOCK = 65_536
#: Levels of nesting that are opened in one go.
LEVELS = 5
_NUMBERS = ("BIGINT", "INT", "SMALLINT", "TINYINT", "DECIMAL", "DOUBLE", "FLOAT")


def _is_number(kind: Column) -> Column:
    return reduce(lambda a, b: a | b, (kind.startswith(n) for n in _NUMBERS))


def _valued(v: Column, path: Column) -> Column:
    """The hash of a scalar and the keys that lead to it."""
    kind = F.schema_of_variant(v)
    return (
        F.when(_is_number(kind), F.xxhash64(path, F.lit("n"), F.try_variant_get(v, "$", "double") + F.lit(0.0)))
        .when(kind == "STRING", F.xxhash64(path, F.lit("s"), F.try_variant_get(v, "$", "string")))
        .when(kind == "BOOLEAN", F.xxhash64(path, F.lit("b"), F.try_variant_get(v, "$", "boolean")))
        .otherwise(F.xxhash64(path, F.lit("z")))
    )


def leaves(rows: DataFrame) -> DataFrame:
    """The other columns and ``leaf``, the hash of each leaf of the variant ``v``; ``LEVELS`` of nesting are opened at a time, and what is deeper is written and opened further."""
    rest = [c for c in rows.columns if c != "v"]
    level = rows.where("v IS NOT NULL").withColumn("path", F.xxhash64(F.lit("")))
    out: list[DataFrame] = []
    while True:
        opened = _opened(level)
        out.append(opened.where("NOT nested").select(*rest, _valued(F.col("v"), F.col("path")).alias("leaf")))
        level = cut(opened.where("nested").select(*rest, "v", "path"))
        if level.isEmpty():
            return reduce(DataFrame.unionByName, out)


def _nested(v: Column) -> Column:
    kind = F.schema_of_variant(v)
    return kind.startswith("OBJECT") | kind.startswith("ARRAY")


def _opened(level: DataFrame) -> DataFrame:
    """``v, path, nested`` after ``LEVELS`` of nesting; a row that is a leaf stays as it is, an empty array or object goes."""
    rest = [c for c in level.columns if c not in ("v", "path")]
    x = level.withColumn("nested", _nested(F.col("v")))
    for _ in range(LEVELS):
        inside = F.when(F.col("nested").outer(), F.col("v").outer())
        made = x.lateralJoin(x.sparkSession.tvf.variant_explode_outer(inside).toDF("_pos", "_key", "_value")).where("NOT nested OR _pos IS NOT NULL")
        v = F.when(F.col("nested"), F.coalesce("_value", F.parse_json(F.lit("null")))).otherwise(F.col("v"))
        path = F.when(F.col("_key").isNull(), F.col("path")).otherwise(F.xxhash64("path", "_key"))
        x = made.select(*rest, v.alias("v"), path.alias("path"), "nested").withColumn("nested", F.col("nested") & _nested(F.col("v")))
    return x


def contains(v: Column, q: Any, top: bool = True) -> Column:
    """Whether the variant ``v`` contains the JSON value ``q`` (as ``parsed`` gives it)."""
    kind = F.schema_of_variant(v)
    sure = lambda c: F.coalesce(c, F.lit(False))

    def inside(x: Any):
        return lambda e: contains(e, x, False)

    if isinstance(q, dict):
        held = F.try_variant_get(v, "$", "map<string,variant>")
        one = lambda k, x: F.map_contains_key(held, F.lit(k)) & contains(F.coalesce(F.try_element_at(held, F.lit(k)), F.parse_json(F.lit("null"))), x, False)
        return sure(reduce(lambda a, b: a & b, (one(k, x) for k, x in q.items()), kind.startswith("OBJECT")))
    items = F.transform(F.try_variant_get(v, "$", "array<variant>"), lambda e: F.coalesce(e, F.parse_json(F.lit("null"))))
    if isinstance(q, list):
        return sure(reduce(lambda a, b: a & b, (F.exists(items, inside(x)) for x in q), kind.startswith("ARRAY")))
    if q is None:
        same = F.is_variant_null(v)
    elif isinstance(q, bool):
        same = (kind == "BOOLEAN") & (F.try_variant_get(v, "$", "boolean") == F.lit(q))
    elif isinstance(q, str):
        same = (kind == "STRING") & (F.try_variant_get(v, "$", "string") == F.lit(q))
    else:
        same = _is_number(kind) & (F.try_variant_get(v, "$", "double") == F.lit(float(q)))
        if abs(q) < 10**20 and q.as_tuple().exponent >= -18:  # doubles of large numbers are equal where the numbers aren't
            same &= F.try_variant_get(v, "$", "decimal(38,18)") == F.lit(f"{q:f}").cast("decimal(38,18)")
    found = sure(same)
    return found | sure(kind.startswith("ARRAY") & F.exists(items, inside(q))) if top else found


def parsed(text: str) -> Any:
    return json.loads(text, parse_float=Decimal, parse_int=Decimal)


@dataclass(frozen=True)
class JsonIndex:
    spark: SparkSession
    folder: str

    @classmethod
    def build(cls, docs: DataFrame, id_: str, data: str, folder: str, file_rows: int = 1_000_000) -> JsonIndex:
        """An index over the JSON texts ``data`` of all rows, written under ``folder``."""
        write_numbered(docs.select(F.col(id_).alias("id"), F.col(data).cast("string").alias("data")), f"{folder}/documents")
        rows = read_numbered(docs.sparkSession, f"{folder}/documents").select("n", F.try_parse_json("data").alias("v"))
        block, doc = F.floor(F.col("n") / BLOCK), (F.col("n") % BLOCK).cast("int")
        lists = leaves(rows).groupBy("leaf", block.alias("block")).agg(F.sort_array(F.collect_set(doc)).alias("docs"))
        options = {"parquet.writer.version": "PARQUET_2_0", "compression": "zstd"}
        lists = docs.sparkSession.read.schema(lists.schema).parquet(written(lists, **options))
        write_ordered(lists, f"{folder}/lists", Index("leaves", ("leaf", "block")), file_rows, options=options)
        return cls(docs.sparkSession, folder)

    def documents(self) -> DataFrame:
        return read_numbered(self.spark, f"{self.folder}/documents")

    def candidates(self, text: str) -> DataFrame | None:
        """``n`` of the documents that have all leaves of a JSON text; None if it has none."""
        asked = self.spark.createDataFrame([(text,)], "t string").select(F.parse_json("t").alias("v"))
        wanted = sorted({r["leaf"] for r in leaves(asked).collect()})
        if not wanted:
            return None
        rows = self.spark.read.parquet(f"{self.folder}/lists").where(F.col("leaf").isin(*wanted))
        # a leaf has one row in a block
        have = rows.groupBy("block").agg(F.collect_list("docs").alias("all")).where(F.size("all") == len(wanted))
        both = F.aggregate(F.slice("all", F.lit(2), F.size("all")), F.element_at("all", 1), lambda a, b: F.array_intersect(a, b))
        return have.select("block", F.explode(both).alias("doc")).select((F.col("block") * BLOCK + F.col("doc")).alias("n"))

    def search(self, text: str) -> DataFrame:
        """``id, data`` of the documents that contain the JSON ``text``."""
        near = self.candidates(text)
        # written: the optimiser would look into all documents before it joins
        x = self.documents() if near is None else cut(self.documents().join(near, "n"))
        return x.where(contains(F.try_parse_json("data"), parsed(text))).select("id", "data")
