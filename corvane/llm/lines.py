"""Cross-site line dedup with HyperLogLog spread, with DataFrame functions.

A line's sites are sketched per line hash; sketches merge map-side and again after the shuffle, so a
line that a third of the documents hold costs each task one row. A line whose estimate is near the
threshold is counted exactly; lines with at least the threshold of sites are boilerplate and are
removed everywhere but at their first place (the smallest doc_id, then the first line).

A document is its doc_id with a hash of its text, so that rows which share an id keep their own lines.

Defined results: a line is what lies between line feeds, compared without surrounding spaces; blank
lines are never boilerplate; a null text is empty, a null site is a site of its own, rows with a null
doc_id take no part in counts and keep their texts; rows of one doc_id and text are one document,
rows of one doc_id and different texts are several, in the order of a hash of the text; an empty
table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.llm import common

#: Distinct sites from which a line is boilerplate.
MIN_SITES = 10
#: log2 of a sketch's registers; its standard error; how many of them an estimate may lie from the
#: threshold before it is taken as it is.
LG_K = 10
ERROR = 1.04 / 2 ** (LG_K / 2)
SIGMAS = 6


def text_hash() -> Column:
    return F.xxhash64(F.coalesce("text", F.lit("")))


def _lines(docs: DataFrame) -> DataFrame:
    x = docs.where(F.col("doc_id").isNotNull()).select("doc_id", text_hash().alias("version"), F.coalesce("source", F.lit("")).alias("site"), F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n", -1)).alias("at", "line"))
    x = x.withColumn("line", F.trim("line")).where(F.col("line") != "")
    # two hashes with different seeds make 128 bits
    return x.select("doc_id", "version", "at", F.xxhash64("site").alias("site"), F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(1), "line").alias("h2"))


def boilerplate(docs: DataFrame, min_sites: int = MIN_SITES) -> DataFrame:
    """``h1, h2, doc_id, at``: boilerplate lines and the place where each stays."""
    key = ["h1", "h2"]
    lines = _lines(docs)
    sketched = lines.groupBy(*key).agg(F.hll_sketch_agg("site", LG_K).alias("sketch"))
    spread = common.cut(sketched.select(*key, F.hll_sketch_estimate("sketch").alias("n")).where(F.col("n") >= min_sites * (1 - SIGMAS * ERROR) - 1))
    near = spread.where(F.col("n") <= min_sites * (1 + SIGMAS * ERROR) + 1).select(*key)
    # either way a line leaves a task once for each site, however often it stands there
    if common.fits_broadcast(near):
        pairs = lines.join(F.broadcast(near), key, "left_semi").select(*key, "site").distinct()
    else:
        pairs = lines.select(*key, "site").distinct().join(near, key, "left_semi")
    exact = pairs.groupBy(*key).count().where(F.col("count") >= min_sites).select(*key)
    sure = spread.where(F.col("n") > min_sites * (1 + SIGMAS * ERROR) + 1).select(*key)
    return common.cut(sure.unionByName(exact))


def removed(docs: DataFrame, min_sites: int = MIN_SITES) -> DataFrame:
    """``doc_id, version, gone``: the numbers of the lines to remove, for documents that have any."""
    key, place = ["h1", "h2"], ["doc_id", "version", "at"]
    found = boilerplate(docs, min_sites)
    found = F.broadcast(found) if common.fits_broadcast(found) else found
    hits = common.cut(_lines(docs).join(found, key).select(*place, *key))
    first = hits.groupBy(*key).agg(F.min(F.struct("doc_id", "at", "version")).alias("first")).select("first.*")
    return hits.select(*place).join(first, place, "left_anti").groupBy("doc_id", "version").agg(F.sort_array(F.collect_set("at")).alias("gone"))


def without(text: Column, gone: Column) -> Column:
    """The text without those lines."""
    kept = lambda n: F.array_except(F.sequence(F.lit(0), n - 1), gone)
    return common.let(F.split(text, "\n", -1), lambda x: F.array_join(F.transform(kept(F.size(x)), lambda i: F.get(x, i)), "\n"))


def dedup(docs: DataFrame, min_sites: int = MIN_SITES) -> DataFrame:
    """``docs`` with ``text`` cleaned, plus ``n_lines`` and ``n_removed`` (with underscores before them if ``docs`` has such columns)."""
    key, version, at, lines_, out = (common.unused(docs, c) for c in ("_key", "_version", "_gone", "n_lines", "n_removed"))
    gone = removed(docs, min_sites).select(F.col("doc_id").alias(key), F.col("version").alias(version), F.col("gone").alias(at))
    x = docs.join(gone, (docs["doc_id"] == F.col(key)) & (text_hash() == F.col(version)), "left").drop(version)
    n = F.when(F.col("text").isNull(), 0).otherwise(F.size(F.split("text", "\n", -1)))
    x = x.withColumn(lines_, n.cast("long")).withColumn(out, F.coalesce(F.size(at), F.lit(0)).cast("long"))
    return x.withColumn("text", F.when(F.col(at).isNull(), F.col("text")).otherwise(without(F.col("text"), F.col(at)))).drop(key, at)


def clean(docs: DataFrame, min_sites: int = MIN_SITES) -> DataFrame:
    """``docs`` with ``text`` cleaned, without the documents of which only blank lines are left."""
    n = common.unused(docs, "n_removed")
    emptied = (F.col(n) > 0) & (F.trim(F.translate("text", "\n\t\r", "")) == "")
    return dedup(docs, min_sites).where(~F.coalesce(emptied, F.lit(False))).select(*docs.columns)
