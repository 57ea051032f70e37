"""URL filter: rules first, then the log-likelihood ratio of two character models.

A variable-order Markov model is fitted for accepted and for rejected URLs: counts of bytes after their
contexts of 0 to ``ORDER`` bytes, over the whole URL, each order smoothed by the one below with the
number of kinds of bytes seen after a context (Witten and Bell). Counts are whole numbers by the context
and byte themselves (both fit 51 bits) and stay in a table that grows with the input. URLs are scored
in blocks: a block asks the table for the contexts it holds, each once, and no task and no driver
needs the others.

The models are fitted on what the rules say alone: URLs that a rule allows against those that one
blocks, so no URL that has to be judged has taught the model what it is. On a fold of ruled URLs that is
left out of the counts, the threshold of the length-normalised difference is set where it divides the
two classes best. Then URLs without a rule count too, for both classes, by how sure the first models are of
them (a step of expectation maximisation): one near the threshold counts half for either, one far below it
for the rejected alone. Models and threshold are fitted again, the latter still on ruled URLs, and that is
the verdict.

Defined results: a null URL or one without ``://`` has an empty host and path, fits no rule, has a
difference of 0 and is allowed; repeated URLs count as often as they occur; a null id falls into the fold
of 0; where a class has no ruled URL in the fold, or none outside it, what has no rule is allowed.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.llm import common

#: What happens to a host (with its subdomains) and a path's beginning.
RULES = (("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/"))
ORDER = 5
#: One of so many folds of ids is kept for the threshold, which is sought among multiples of ``BIN``.
FOLDS, BIN = 10, 0.002
#: A URL counts in so many parts, of which each class gets its share.
PARTS = 16
#: URLs of a block, those that make one worth it, and bytes of URLs worked on at a time.
BLOCK, SMALL_BLOCK, AT_ONCE = 50_000, 2_000, 256 << 10
START = b"\x02" * ORDER


def host_path(url: Column) -> tuple[Column, Column]:
    url = F.coalesce(url, F.lit(""))
    has = F.contains(url, F.lit("://"))
    rest = F.regexp_extract(url, r"(?s)://(.*)", 1)
    host = F.translate(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return F.when(has, host).otherwise(""), F.when(has, path).otherwise("")


def ruled(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """Rule and verdict; null where none fits. Of those that fit the longest wins, of equal ones the first."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, h, p in sorted(rules, key=lambda r: len(r[1]) + len(r[2])):  # the longest is asked first
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, verdict = F.when(fits, h + p).otherwise(rule), F.when(fits, what).otherwise(verdict)
    return rule, verdict


def keys(urls: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """For each byte of the URLs, by order: the context with it (order, context, byte in one number); whose it is."""
    data = np.frombuffer(b"".join(START + u for u in urls), np.uint8).astype(np.int64)
    size = np.array([len(u) for u in urls], np.int64)
    starts = np.concatenate([[0], np.cumsum(size + ORDER)[:-1]]) if len(urls) else np.empty(0, np.int64)
    real = np.ones(len(data), bool)
    for i in range(ORDER):
        real[starts + i] = False
    at = np.flatnonzero(real)
    out = np.empty((ORDER + 1, len(at)), np.int64)
    h = np.zeros(len(at), np.int64)
    for k in range(ORDER + 1):
        if k:
            h |= data[at - k] << (8 * (k - 1))
        out[k] = (k << 48) | (h << 8) | data[at]
    return out, np.repeat(np.arange(len(urls)), size)


def summed(key: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys in order, and the sum of n of each."""
    at = np.argsort(key, kind="stable")
    key, n = key[at], n[at]
    first = np.flatnonzero(np.diff(key, prepend=-1))
    return key[first], np.add.reduceat(n, first) if len(first) else n


class Model:
    """Counts of one class, of contexts with a byte, from parts; ``key`` ascending."""

    def __init__(self, key: np.ndarray, n: np.ndarray):
        has = n > 0
        self.key, self.n = key[has], n[has] / PARTS
        self.ctx, self.n_ctx = summed(self.key >> 8, self.n)
        _, self.kinds = np.unique(self.key >> 8, return_counts=True)

    def probability(self, key: np.ndarray) -> np.ndarray:
        """Log probability of each byte: each order backs off to the one below."""
        p = np.full(key.shape[1], 1 / 256)
        for of_order in key if len(self.key) else ():
            one, back = np.unique(of_order, return_inverse=True)
            n_sym, n, t = found(self.key, self.n, one), found(self.ctx, self.n_ctx, one >> 8), found(self.ctx, self.kinds, one >> 8)
            p = np.where((n > 0)[back], (n_sym[back] + t[back] * p) / np.maximum(n + t, 1)[back], p)
        return np.log(p)


def found(key: np.ndarray, value: np.ndarray, asked: np.ndarray) -> np.ndarray:
    """The value of each key asked for, 0 for those not there."""
    at = np.minimum(np.searchsorted(key, asked), len(key) - 1)
    return np.where(key[at] == asked, value[at], 0)


def portions(urls: list[bytes]) -> Iterator[list[bytes]]:
    """The URLs in turn, some of ``AT_ONCE`` bytes at a time."""
    some, size = [], 0
    for u in urls:
        if some and size + len(u) > AT_ONCE:
            yield some
            some, size = [], 0
        some.append(u)
        size += len(u)
    if some:
        yield some


def differences(urls: list[bytes], models: tuple[Model, Model]) -> np.ndarray:
    """Mean per byte of log P(accepted) - log P(rejected)."""
    out = [np.empty(0)]
    for some in portions(urls):
        key, who = keys(some)
        d = models[0].probability(key) - models[1].probability(key)
        out.append(np.bincount(who, d, len(some)) / np.maximum(np.bincount(who, minlength=len(some)), 1))
    return np.concatenate(out)


def raw(column: pa.Array | pa.ChunkedArray) -> list[bytes]:
    return [x.as_buffer().to_pybytes() for x in column]


def fit(known: DataFrame) -> DataFrame:
    """``ctx, key, accepted, rejected``: the counts of both classes, in parts, from ``body, share`` (the parts that are rejected)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            share = batch.column(1).to_numpy().astype(np.int64)
            urls, done = raw(batch.column(0)), 0
            for some in portions(urls):
                key, who = keys(some)
                mine = share[done : done + len(some)][who]
                done += len(some)
                one, back = np.unique(key, return_inverse=True)
                bad = np.bincount(back.ravel(), np.tile(mine, len(key)), len(one)).astype(np.int64)
                yield pa.record_batch({"key": one, "accepted": PARTS * np.bincount(back.ravel(), minlength=len(one)) - bad, "rejected": bad})

    counted = known.select("body", "share").mapInArrow(count, "key long, accepted long, rejected long")
    summed_ = counted.groupBy("key").agg(F.sum("accepted").alias("accepted"), F.sum("rejected").alias("rejected"))
    return summed_.select(F.shiftright("key", 8).alias("ctx"), "key", "accepted", "rejected")


def scored(rows: DataFrame, counts: DataFrame, blocks: int) -> DataFrame:
    """``rows`` (with a ``body``) and their difference, as ``score``."""
    dealt = rows.withColumn("block", F.pmod(F.xxhash64(*rows.columns), F.lit(blocks)))

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            block, urls = batch.column(1).to_numpy(), raw(batch.column(0))
            for b in np.unique(block):
                ctx = np.unique(np.concatenate([np.empty(0, np.int64), *(np.unique(keys(some)[0] >> 8) for some in portions([urls[i] for i in np.flatnonzero(block == b)]))]))
                yield pa.record_batch({"block": np.full(len(ctx), b, np.int64), "ctx": ctx})

    def score(t: pa.Table, answer: pa.Table) -> pa.Table:
        key = answer.column("key").to_numpy()
        by = np.argsort(key)
        models = tuple(Model(key[by], answer.column(c).to_numpy()[by]) for c in ("accepted", "rejected"))
        return t.append_column("score", pa.array(differences(raw(t.column("body")), models))).drop_columns(["block"])

    asked = dealt.select("body", "block").mapInArrow(ask, "block long, ctx long").distinct()
    answers = asked.join(counts, "ctx").select("block", "key", "accepted", "rejected")
    schema = rows.schema.add("score", "double")
    return dealt.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(score, schema)


def threshold(rows: DataFrame) -> tuple[float, float]:
    """Of the ruled URLs of the fold that was left out: where the shares of accepted ones at or above and of rejected ones below are the highest; how far the classes' means lie apart."""
    ruled_ = rows.where("fold AND said IS NOT NULL AND body <> ''")
    seen = ruled_.groupBy(F.floor(F.col("score") / BIN).alias("bin")).agg(F.count_if(F.col("said") != "block"), F.count_if(F.col("said") == "block"))
    got = np.array(sorted(map(tuple, seen.collect())), float).reshape(-1, 3)  # as many rows as there are bins
    good, bad = got[:, 1], got[:, 2]
    if not good.sum() or not bad.sum():
        return -math.inf, 0.0
    right = np.concatenate([[good.sum()], good.sum() - np.cumsum(good)]) / good.sum() + np.concatenate([[0], np.cumsum(bad)]) / bad.sum()
    edge = np.concatenate([got[:, 0], [got[-1, 0] + 1]])
    best = int(np.argmax(right))
    # the middle of the gap between the bins on either side
    below = edge[best - 1] + 1 if best else edge[best]
    apart = (got[:, 0] @ good / good.sum() - got[:, 0] @ bad / bad.sum()) * BIN
    return float((below + edge[best]) / 2 * BIN), float(apart)


def judge(pages: DataFrame, rules=RULES, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """``id, host, path, rule, verdict, score`` of every page."""
    spark = pages.sparkSession
    common.tune(spark)
    url = F.col(url_col).cast("string")
    host, path = host_path(url)
    rows = pages.select(F.col(id_col), host.alias("host"), path.alias("path"), F.encode(F.when(host != "", url).otherwise(""), "UTF-8").alias("body"))
    rule, verdict = ruled(F.col("host"), F.col("path"), rules)
    fold = F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")), F.lit(FOLDS)) == 0
    rows = rows.withColumns({"rule": rule, "said": verdict, "fold": fold})
    rows = rows.withColumn("share", F.when(F.col("said") == "block", PARTS).otherwise(0).cast("int"))
    n = rows.count()
    blocks = max(1, math.ceil(min(2 * spark.sparkContext.defaultParallelism, n / SMALL_BLOCK)), math.ceil(n / BLOCK))

    def judged(rows: DataFrame, known: Column) -> tuple[DataFrame, float, float]:
        out = common.cut(scored(rows, fit(rows.where((F.col("body") != "") & known)), blocks))
        return out, *threshold(out)

    ruled_ = F.col("said").isNotNull() & ~F.col("fold")
    out, low, apart = judged(rows, ruled_)
    if low > -math.inf and apart > 0:
        # the classes' means lie at odds of e^2 on either side
        sure = PARTS / (1 + F.exp((F.col("score") - low) * (4 / apart)))
        again = out.withColumn("share", F.when(F.col("said").isNull(), F.round(sure).cast("int")).otherwise(F.col("share"))).drop("score")
        out, low, apart = judged(again, ruled_ | F.col("said").isNull())
    method = F.when((F.col("score") < low) & (F.col("host") != ""), "block").otherwise("allow")
    return out.select(id_col, "host", "path", "rule", F.coalesce("said", method).alias("verdict"), "score")
