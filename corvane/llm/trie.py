"""Prefix trie of conversations, from sorted sequences and their common prefixes.

A conversation is its sequence of turns, each by the MD5 of its role and text. Sequences are sorted over
all tasks (ties by conv_id), so the members of a prefix stand in a row, and the common prefix of each with
the one before is known. A prefix of ``d`` turns reaches as far left and right as the smallest common
prefix in between is at least ``d``: over a sparse table of range minimums, every candidate prefix (each one
at the first row that has it) searches its right end by halving steps, and its parent its left end, each by
itself; there is no stack and no tree to walk. All numbers of a node are sums over its interval:

- children: the nodes whose parent it is; leaves: rows that are no prefix of the next;
- tokens saved: with ``W(i, d)`` the words of row i's first d turns, the sum of ``W(i, common prefix)`` over
  all members but the first, less ``W(d - 1)`` for each of them.

Rows are worked on in blocks of about ``BLOCK`` turns, however many a task has. A prefix that goes on in
the next block or comes from the one before is *open*: a block gives its part of it, and the parts (for a
block twice the depth at most) are added up by the digest of the prefix. So a first turn, or a whole
conversation, that a third of all rows share is a part from each block. The list of a node's own ids is
hashed from its parts in order, one part at a time.

What is gathered is one conversation's turns, 28 bytes each, because a row of the sort is one sequence.

Defined results: turns go by number (null first), those of one number by the MD5 of role and text; repeated
rows are turns; null roles and texts are empty; rows with a null conv_id take no part; an empty table gives
no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.llm import common

#: Turns (and rows, which may have none) of a block.
BLOCK = 200_000
#: Bytes of a turn's digest.
TURN = 16
EMPTY = hashlib.sha256().hexdigest()
PARTS = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved long, before long, ends_sha256 string, node binary, parent binary, place long, ids binary"


def sequences(turns: DataFrame) -> DataFrame:
    """``conv_id, turns``: of every conversation its turns in order, each a struct of ``turn, id`` (a digest), ``words``."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    one = F.struct(
        F.col("turn").cast("long").alias("turn"),
        F.unhex(F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary"))).alias("id"),
        F.size(F.filter(F.split(text, r"[\x20\x09-\x0D]+", -1), lambda w: w != "")).alias("words"),
    )
    x = turns.where(F.col("conv_id").isNotNull()).select(F.col("conv_id").cast("long").alias("conv_id"), one.alias("t"))
    return x.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))


def grafted(seqs: DataFrame, base: Column, most: Column, longest: int) -> DataFrame:
    """Each conversation with its first ``most`` turns (``longest`` at most) replaced by as many of the conversation ``base``, none if there is no such."""
    heads = seqs.select(F.col("conv_id").alias("_base"), F.slice("turns", 1, longest).alias("_head"))
    own = seqs.select("conv_id", "turns", base.alias("_base"), most.cast("int").alias("_most"))
    none = F.array().cast(seqs.schema["turns"].dataType)
    first = F.slice(F.coalesce("_head", none), F.lit(1), F.col("_most"))
    rest = F.slice("turns", F.col("_most") + 1, F.greatest(F.size("turns") - F.col("_most"), F.lit(0)))
    return own.join(heads, "_base", "left").select("conv_id", F.concat(first, rest).alias("turns"))


def common_turns(a: bytes, b: bytes) -> int:
    """Turns that two sequences begin with both."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n // TURN
    differs = np.frombuffer(a, np.uint8, n) != np.frombuffer(b, np.uint8, n)
    return int(np.argmax(differs)) // TURN


def sparse_table(x: np.ndarray) -> list[np.ndarray]:
    """Smallest of 1, 2, 4, .. values from each place on."""
    out = [x]
    while 2 * (m := 2 ** (len(out) - 1)) <= len(x):
        out.append(np.minimum(out[-1][:-m], out[-1][m:]))
    return out


def right_end(table: list[np.ndarray], at: np.ndarray, least: np.ndarray) -> np.ndarray:
    """The last row that each row ``at`` reaches over common prefixes of at least ``least``; ``table[0][i]`` lies between rows i and i + 1."""
    at, n = at.copy(), len(table[0])
    for k in range(len(table) - 1, -1, -1):
        go = np.flatnonzero(at + 2**k <= n)
        go = go[table[k][at[go]] >= least[go]]
        at[go] += 2**k
    return at


def left_end(table: list[np.ndarray], at: np.ndarray, least: np.ndarray) -> np.ndarray:
    at = at.copy()
    for k in range(len(table) - 1, -1, -1):
        go = np.flatnonzero(at - 2**k >= 0)
        go = go[table[k][at[go] - 2**k] >= least[go]]
        at[go] -= 2**k
    return at


def nodes(conv: np.ndarray, keys: list[bytes], words: list[list[int]], before: int, after: int, place: int) -> pa.RecordBatch:
    """The nodes of a block of sorted rows. ``before``, ``after``: turns that its first row has in common with the row before the block, its last with the one after; -1 without such."""
    n = len(keys)
    size = np.array([len(k) // TURN for k in keys], np.int64)
    between = np.fromiter((common_turns(a, b) for a, b in zip(keys, keys[1:])), np.int64, n - 1)
    shared = np.concatenate([[before], between])  # with the row before, and in the next line with the row after
    next_ = np.append(between, after)
    total = np.concatenate([np.zeros(1, np.int64), *(np.concatenate([[0], np.cumsum(np.asarray(w, np.int64))]) for w in words)])[1:]
    o = np.cumsum(size + 1) - (size + 1)
    w_of = lambda i, d: total[o[i] + d]

    # candidates: each prefix at the first row of the block that has it
    low = shared + 1
    low[0] = 0
    i = np.repeat(np.arange(n), size - low + 1)
    first = np.cumsum(size - low + 1) - (size - low + 1)
    d = np.arange(len(i)) - first[i] + low[i]
    number = lambda i, d: first[i] + d - low[i]
    table = sparse_table(between)
    end = right_end(table, i, d)
    up = np.maximum(d - 1, 0)
    parent = np.where(d > 0, number(left_end(table, i, up), up), -1)
    open_ = ((i == 0) & (d <= before)) | ((end == n - 1) & (d <= after))

    new = (i > 0) | (d > before)  # in the whole table, not only here
    has = new & (parent >= 0)
    children = np.bincount(parent[has], minlength=len(i))
    leaf = np.concatenate([[0], np.cumsum(next_ < size)])
    added = np.where(shared >= 0, w_of(np.arange(n), np.maximum(shared, 0)), 0)
    sums = np.concatenate([[0], np.cumsum(added)])
    # the first member of all has nobody to share with
    saved = sums[end + 1] - np.where(new, sums[i + 1], sums[i])
    base = np.where(d > 0, w_of(i, up), 0)
    least = sparse_table(conv)
    k = np.frexp((end - i + 1).astype(float))[1] - 1
    smallest = np.empty(len(i), np.int64)
    for level in np.unique(k):
        x = np.flatnonzero(k == level)
        smallest[x] = np.minimum(least[level][i[x]], least[level][end[x] + 1 - 2**level])
    members = end - i + 1

    # rows that a node ends at: equal sequences stand in a row, and begin what the node reaches
    copies = np.append(np.flatnonzero(~((between == size[1:]) & (between == size[:-1]))) + 1, n)
    last = copies[np.searchsorted(copies, i, side="right")]
    ids: list[bytes | None] = [None] * len(i)
    sha = [EMPTY] * len(i)
    for x in np.flatnonzero(size[i] == d).tolist():
        joined = ",".join(map(str, conv[i[x] : last[x]].tolist())).encode()
        if open_[x]:
            ids[x] = joined
        else:
            sha[x] = hashlib.sha256(joined).hexdigest()
    name: dict[int, bytes] = {}
    digest, seen = hashlib.md5(), (-1, 0)
    for x in np.flatnonzero(open_).tolist():  # by row, then depth: a prefix is hashed on from the one before
        row, depth = int(i[x]), int(d[x])
        if seen[0] != row:
            digest, seen = hashlib.md5(), (row, 0)
        digest.update(keys[row][seen[1] * TURN : depth * TURN])
        seen = (row, depth)
        name[x] = digest.copy().digest()
    of_parent = np.where(parent >= 0, parent, 0)
    known = (parent >= 0) & ~open_[of_parent]
    return pa.record_batch(
        {
            "conv_id": smallest, "depth": d, "parent_conv_id": pa.array(smallest[of_parent], mask=~known), "n_convs": members, "n_children": children,
            "n_leaves": leaf[end + 1] - leaf[i], "saved": saved, "before": base, "ends_sha256": pa.array([None if u else s for s, u in zip(sha, open_.tolist(), strict=True)], pa.string()),
            "node": pa.array([name.get(x) for x in range(len(i))], pa.binary()), "parent": pa.array([name.get(x) for x in parent.tolist()], pa.binary()),
            "place": np.full(len(i), place), "ids": pa.array(ids, pa.binary()),
        }
    )


def edges(ordered: DataFrame) -> dict[int, tuple[int, int]]:
    """For each task with rows: the turns its first row has in common with the row before it, and its last with the one after. Two numbers a task reach the driver."""
    task = F.shiftright("at", 33)
    rows = {r["task"]: r["count"] for r in ordered.groupBy(task.alias("task")).count().collect()}
    tasks = sorted(rows)
    meets = [((t << 33) + rows[t] - 1, u << 33, t, u) for t, u in zip(tasks, tasks[1:])]
    out = {t: [-1, -1] for t in tasks}
    if meets:
        pairs = F.broadcast(ordered.sparkSession.createDataFrame(meets, "a long, b long, t long, u long"))
        left, right = (ordered.join(pairs, F.col("at") == F.col(c)).select("t", "u", F.col("key").alias(f"key_{c}")) for c in ("a", "b"))

        def shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                n = [common_turns(x.as_py(), y.as_py()) for x, y in zip(b.column(2), b.column(3), strict=True)]
                yield pa.record_batch({"t": b.column(0), "u": b.column(1), "n": pa.array(n, pa.int64())})

        for r in left.join(right, ["t", "u"]).mapInArrow(shared, "t long, u long, n long").collect():
            out[r["t"]][1] = out[r["u"]][0] = r["n"]
    return {t: tuple(x) for t, x in out.items()}


def parts(seqs: DataFrame, block: int = BLOCK) -> DataFrame:
    """``PARTS``: closed nodes, and of open ones (with a ``node``) the parts."""
    x = seqs.select("conv_id", F.unhex(F.array_join(F.transform("turns", lambda t: F.hex(t["id"])), "")).alias("key"), F.transform("turns", lambda t: t["words"]).alias("words"))
    ordered = common.cut(x.repartitionByRange("key", "conv_id").sortWithinPartitions("key", "conv_id").withColumn("at", F.monotonically_increasing_id()))
    meets = edges(ordered)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv: list[int] = []
        keys: list[bytes] = []
        words: list[list[int]] = []
        held, at, before, ends = 0, 0, -1, -1
        for batch in batches:
            for c, key, w, here in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                if not conv and not here & ((1 << 33) - 1):
                    before, ends = meets[here >> 33]
                if held >= block:
                    after = common_turns(keys[-1], key)
                    yield nodes(np.array(conv, np.int64), keys, words, before, after, at)
                    conv, keys, words, held, before = [], [], [], 0, after
                if not conv:
                    at = here
                conv.append(c)
                keys.append(key)
                words.append(w)
                held += len(w) + 1
        if conv:
            yield nodes(np.array(conv, np.int64), keys, words, before, ends, at)

    return common.cut(ordered.select("conv_id", "key", "words", "at").mapInArrow(run, PARTS))


def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``node, sha`` from the sorted rows ``node, place, ids`` of a task; one part is held at a time."""
    node, digest = None, None
    for batch in batches:
        done: list[tuple[bytes, str]] = []
        for x, ids in zip(batch.column(0).to_pylist(), batch.column(2), strict=True):
            if x != node:
                if digest is not None:
                    done.append((node, digest.hexdigest()))
                node, digest = x, hashlib.sha256()
            else:
                digest.update(b",")
            digest.update(ids.as_buffer())
        yield pa.record_batch({"node": pa.array([a for a, _ in done], pa.binary()), "sha": pa.array([b for _, b in done], pa.string())})
    if digest is not None:
        yield pa.record_batch({"node": pa.array([node], pa.binary()), "sha": pa.array([digest.hexdigest()], pa.string())})


def trie(seqs: DataFrame, block: int = BLOCK) -> DataFrame:
    """A row for each node: ``conv_id`` (its smallest member), ``depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256``."""
    common.tune(seqs.sparkSession)
    x = parts(seqs, block)
    total = lambda c: F.sum(c).alias(c)
    open_ = x.where(F.col("node").isNotNull())
    added = open_.groupBy("node").agg(F.min("conv_id").alias("conv_id"), F.min("depth").alias("depth"), F.min("parent").alias("parent"), *map(total, ("n_convs", "n_children", "n_leaves", "saved")), F.min("before").alias("before"))
    ids = open_.where(F.col("ids").isNotNull()).select("node", "place", "ids").repartition("node").sortWithinPartitions("node", "place")
    merged = common.cut(added.join(ids.mapInArrow(hashed, "node binary, sha string"), "node", "left").withColumn("ends_sha256", F.coalesce("sha", F.lit(EMPTY))))
    columns = ["conv_id", "depth", "n_convs", "n_children", "n_leaves", "saved", "before", "ends_sha256", "parent"]
    closed = x.where(F.col("node").isNull())
    inner = closed.where(F.col("parent").isNull()).select(*columns, "parent_conv_id")
    outer = closed.where(F.col("parent").isNotNull()).select(*columns).unionByName(merged.where(F.col("parent").isNotNull()).select(*columns))
    # the root, or a first turn that all begin with, is the parent of very many
    above = merged.select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"), F.col("n_children").alias("_n"))
    n = above.agg(F.coalesce(F.sum("_n"), F.lit(0))).first()[0]
    found = common.join_hot(outer, above, "parent", "_n", n)
    root = merged.where(F.col("parent").isNull()).select(*columns, F.lit(None).cast("long").alias("parent_conv_id"))
    out = inner.unionByName(found.select(*columns, "parent_conv_id")).unionByName(root)
    saved = F.col("saved") - (F.col("n_convs") - 1) * F.col("before")
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", saved.alias("saved_tokens"), "ends_sha256")
