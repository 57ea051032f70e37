"""Periodic runs of words, found on a grammar of each text.

A run is a stretch of at least ``LEAST`` words and two periods that repeats with its smallest period and
can't be extended. All that a run covers lies in windows of ``WINDOW`` words that the text holds again,
so windows that occur once (told by a hash; a collision only lets a stretch through) cut a text into
stretches, and what lies between them is no part of any run. Then, for each text:

1. *Re-Pair*: the most frequent pair of neighbouring symbols of the stretches becomes a nonterminal, until
   none occurs twice (of equally frequent ones the shortest goes first, which keeps the tree shallow). What
   is left of a stretch is paired level by level, so that every nonterminal has two halves.
2. *Boundaries*: runs that cross the boundary between the halves of a nonterminal are computed once for
   it, wherever it occurs. A period ``q`` that crosses matches the words ``q`` apart on one side of the
   boundary; how far they go on matching either way is told by ranks of blocks of 1, 2, 4, .. words (equal
   ranks are equal words, so this is exact).
3. *Positions*: a nonterminal's runs are translated to all its places in the derivation. Each run of the
   text crosses the boundary of the smallest nonterminal that holds it, and comes out whole there; what
   came out cut short elsewhere lies within it, so of one period the maximal intervals stay.

Nothing is shuffled; some texts are worked on at a time, a very long one by itself.

Defined results: a null text is empty; words are what white space (ASCII) parts; rows with a null or
repeated doc_id each give a row; other columns are left behind; an empty table gives no rows.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from heapq import heapify, heappop, heappush
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.llm import common

#: Words of the shortest run. Words of the windows, which must be at most half of it.
LEAST, WINDOW = 12, 6
#: Bytes of texts worked on at a time, and pairs of places compared at a time.
AT_ONCE, PAIRS = 2 << 20, 2_000_000
SCHEMA = "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string"


def repeated(ids: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Whether each word lies in a window that its text holds again. ``ends``: where each text ends."""
    covered = np.zeros(len(ids) + 1, np.int32)
    n = len(ids) - WINDOW + 1
    if n <= 0:
        return covered[:-1] > 0
    whose = np.repeat(np.arange(len(ends)), np.diff(ends, prepend=0))
    h = whose[:n].astype(np.uint64)
    for k in range(WINDOW):
        h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15) + ids[k : k + n].astype(np.uint64)
    at = np.flatnonzero(whose[:n] == whose[WINDOW - 1 :])
    by = at[np.argsort(h[at])]
    same = h[by][1:] == h[by][:-1]
    twice = np.zeros(len(by), bool)
    twice[1:] |= same
    twice[:-1] |= same
    covered[by[twice]] += 1
    covered[by[twice] + WINDOW] -= 1
    return np.cumsum(covered[:-1]) > 0


def repair(stretches: list[list[int]]) -> tuple[list[tuple[int, int]], list[list[int]]]:
    """Re-Pair over stretches of symbols 0, 1, ..: nonterminals -1, -2, .. as pairs, and what is left of each stretch."""
    symbol: list[int] = []
    after: list[int] = []
    before: list[int] = []
    places: dict[tuple[int, int], list[int]] = defaultdict(list)
    for s in stretches:
        o = len(symbol)
        symbol += s
        before += range(o - 1, o + len(s) - 1)
        after += range(o + 1, o + len(s) + 1)
        before[o] = after[-1] = -1
        for i, pair in enumerate(zip(s, s[1:]), o):
            places[pair].append(i)
    n = {p: len(x) for p, x in places.items()}
    size: dict[int, int] = defaultdict(lambda: 1)
    turn = count()
    heap = [(-c, 2, next(turn), p) for p, c in n.items() if c > 1]
    heapify(heap)
    rules: list[tuple[int, int]] = []
    while heap:
        c, length, _, pair = heappop(heap)
        if n[pair] < 2:
            continue
        if n[pair] != -c:  # stale
            heappush(heap, (-n[pair], length, next(turn), pair))
            continue
        x, y = pair
        valid, last = [], -1
        for i in sorted(set(places.pop(pair))):
            if i > last and symbol[i] == x and (j := after[i]) >= 0 and symbol[j] == y:
                valid.append(i)
                last = j
        n[pair] = 0
        if len(valid) < 2:
            continue
        rules.append(pair)
        z = -len(rules)
        size[z] = size[x] + size[y]
        fresh: set[tuple[int, int]] = set()
        for i in valid:
            j = after[i]
            h, k = before[i], after[j]
            symbol[i], symbol[j], after[i] = z, None, k
            if k >= 0:
                before[k] = i
                if (old := (y, symbol[k])) in n:
                    n[old] -= 1
                new = (z, symbol[k])
                places[new].append(i)
                n[new] = n.get(new, 0) + 1
                fresh.add(new)
            if h >= 0:
                if (old := (symbol[h], x)) in n:
                    n[old] -= 1
                new = (symbol[h], z)
                places[new].append(h)
                n[new] = n.get(new, 0) + 1
                fresh.add(new)
        for new in fresh:
            if n[new] > 1:
                heappush(heap, (-n[new], size[new[0]] + size[new[1]], next(turn), new))
    left, o = [], 0
    for s in stretches:
        left.append([x for x in symbol[o : o + len(s)] if x is not None])
        o += len(s)
    return rules, left


class Grammar:
    """Nonterminals -1, -2, .. of two halves each, and one symbol for each stretch."""

    def __init__(self, stretches: list[list[int]], starts: list[int]):
        self.rules, left = repair(stretches)
        self.roots = []
        for s in left:
            while len(s) > 1:
                paired = []
                for pair in zip(s[::2], s[1::2]):
                    self.rules.append(pair)
                    paired.append(-len(self.rules))
                s = paired + s[len(paired) * 2 :]
            self.roots.append(s[0])
        self.starts = starts
        self.size = np.ones(len(self.rules) + 1, np.int64)  # [0] is any word's
        of = lambda x: self.size[-x] if x < 0 else 1
        for i, (x, y) in enumerate(self.rules, 1):
            self.size[i] = of(x) + of(y)
        #: Where each nonterminal begins first, and where its second half does.
        self.first = np.full(len(self.rules) + 1, np.iinfo(np.int64).max)
        self.middle = np.zeros(len(self.rules) + 1, np.int64)
        for r, s in zip(self.roots, starts, strict=True):
            if r < 0:
                self.first[-r] = min(self.first[-r], s)
        for i in range(len(self.rules), 0, -1):
            x, y = self.rules[i - 1]
            p = self.first[i]
            self.middle[i] = p + of(x)
            if x < 0:
                self.first[-x] = min(self.first[-x], p)
            if y < 0:
                self.first[-y] = min(self.first[-y], self.middle[i])

    def places(self, wanted: set[int]) -> dict[int, np.ndarray]:
        """All places of the derivation where the nonterminals wanted begin."""
        below = np.zeros(len(self.rules) + 1, bool)
        below[list(wanted)] = True
        for i, (x, y) in enumerate(self.rules, 1):
            below[i] |= (x < 0 and below[-x]) or (y < 0 and below[-y])
        held: dict[int, list[np.ndarray]] = defaultdict(list)
        for r, s in zip(self.roots, self.starts, strict=True):
            if r < 0 and below[-r]:
                held[-r].append(np.array([s]))
        out = {}
        for i in range(len(self.rules), 0, -1):
            if i not in held:
                continue
            at = np.concatenate(held.pop(i))
            if i in wanted:
                out[i] = at
            x, y = self.rules[i - 1]
            if x < 0 and below[-x]:
                held[-x].append(at)
            if y < 0 and below[-y]:
                held[-y].append(at + (self.middle[i] - self.first[i]))
        return out


def ranks(ids: np.ndarray, longest: int) -> list[np.ndarray]:
    """For 1, 2, 4, .. words up to ``longest``: numbers of the blocks that begin at each word, equal where the words are."""
    out = [ids.astype(np.int64)]
    while 2 ** len(out) <= longest and len(out[-1]) > (m := 2 ** (len(out) - 1)):
        r = out[-1]
        key = r[:-m] * (int(r.max(initial=0)) + 1) + r[m:]
        out.append(np.unique(key, return_inverse=True)[1].astype(np.int32))
    return out


def crossing(ids: np.ndarray, first: np.ndarray, middle: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(which, start, end, period) of the runs within each [first, end) that cross its middle."""
    table = ranks(ids, int((end - first).max(initial=0)))
    found: list[np.ndarray] = []
    most = (end - first) // 2
    load = np.cumsum(2 * most)
    for which in np.split(np.arange(len(first)), np.flatnonzero(np.diff(load // PAIRS)) + 1) if len(first) else []:
        for side in (0, 1):
            n = np.minimum(most, (end - middle, middle - first)[side])[which]
            w = np.repeat(which, n)
            q = np.arange(len(w)) - np.repeat(np.cumsum(n) - n, n) + 1
            # the word before the boundary with the one a period on; the word after it with the one a period back
            i = middle[w] - 1 if side == 0 else middle[w] - q
            live = ids[i] == ids[i + q]
            w, q, i = w[live], q[live], i[live]
            j, on, back = i + q, np.zeros(len(i), np.int64), np.zeros(len(i), np.int64)
            for k in range(len(table) - 1, -1, -1):
                m, r = 2**k, table[k]
                fits = np.flatnonzero(j + on + m <= end[w])
                fits = fits[r[i[fits] + on[fits]] == r[j[fits] + on[fits]]]
                on[fits] += m
                fits = np.flatnonzero(i - back - m >= first[w])
                fits = fits[r[i[fits] - back[fits] - m] == r[j[fits] - back[fits] - m]]
                back[fits] += m
            length = on + back + q
            keep = length >= np.maximum(LEAST, 2 * q)
            found.append(np.stack([w[keep], (i - back)[keep], (j + on)[keep], q[keep]]))
    x = np.concatenate(found, axis=1) if found else np.empty((4, 0), np.int64)
    x = x[:, np.lexsort((x[3], x[2], x[1], x[0]))]
    smallest = np.ones(x.shape[1], bool)  # of one interval of a nonterminal
    smallest[1:] = (x[:3, 1:] != x[:3, :-1]).any(axis=0)
    w, s, e, q = x[:, smallest]
    return w, s, e, q


def maximal(s: np.ndarray, e: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Rows (start, end, period), of one period those that lie in no other, by start, then period."""
    by = np.lexsort((-e, s, q))
    s, e, q = s[by], e[by], q[by]
    reach = e + (top := int(e.max(initial=0)) + 1) * np.unique(q, return_inverse=True)[1]
    keep = np.ones(len(s), bool)
    keep[1:] = reach[1:] > np.maximum.accumulate(reach)[:-1]
    out = np.stack([s[keep], e[keep], q[keep]], axis=1)
    return out[np.lexsort((out[:, 2], out[:, 0]))]


def runs_of(texts: list[list[bytes]]) -> list[np.ndarray]:
    """For each list of words its runs, as rows (start, end, period)."""
    none = np.empty((0, 3), np.int64)
    number: dict[bytes, int] = defaultdict(count().__next__)
    of = number.__getitem__
    ends = np.cumsum([len(t) for t in texts], dtype=np.int64)
    ids = np.fromiter((i for t in texts for i in map(of, t)), np.int64, int(ends[-1]) if len(ends) else 0)
    cover = repeated(ids, ends)
    edge = cover.copy()  # where a stretch begins, in any text
    edge[1:] &= ~cover[:-1]
    edge[ends[:-1][ends[:-1] < len(ids)]] |= cover[ends[:-1][ends[:-1] < len(ids)]]
    begin = np.flatnonzero(edge)
    if not len(begin):
        return [none] * len(texts)
    stop = np.flatnonzero(cover & ~np.append(cover[1:] & ~edge[1:], False)) + 1
    long = stop - begin >= LEAST
    begin, stop = begin[long], stop[long]
    whose = np.searchsorted(ends, begin, side="right")
    grammars: dict[int, Grammar] = {}
    nodes = []
    for d in np.unique(whose):
        mine = whose == d
        g = Grammar([ids[a:b].tolist() for a, b in zip(begin[mine], stop[mine], strict=True)], begin[mine].tolist())
        grammars[int(d)] = g
        big = np.flatnonzero(g.size >= LEAST)
        nodes.append(np.stack([np.full(len(big), d), big, g.first[big], g.middle[big], g.first[big] + g.size[big]]))
    doc, node, first, middle, end = np.concatenate(nodes, axis=1) if nodes else np.empty((5, 0), np.int64)
    w, s, e, q = crossing(ids, first, middle, end)
    out = [none] * len(texts)
    for d in np.unique(doc[w]):
        mine = doc[w] == d
        at = grammars[int(d)].places(set(node[w[mine]].tolist()))
        parts = [(o + s[x] - first[w[x]], o + e[x] - first[w[x]], np.full(len(o), q[x])) for x in np.flatnonzero(mine) for o in (at[int(node[w[x]])],)]
        start = int(ends[d - 1]) if d else 0
        a, b, c = (np.concatenate(z) for z in zip(*parts, strict=True))
        out[d] = maximal(a - start, b - start, c)
    return out


def kept(words: list[bytes], runs: np.ndarray) -> list[bytes]:
    """The words that no run contains after its first period."""
    edge = np.zeros(len(words) + 1, np.int64)
    np.add.at(edge, runs[:, 0] + runs[:, 2], 1)
    np.add.at(edge, runs[:, 1], -1)
    return [words[i] for i in np.flatnonzero(np.cumsum(edge[:-1]) == 0)]


def _searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    shape = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def done(ids: list, texts: list[list[bytes]]) -> pa.RecordBatch:
        found = runs_of(texts)
        runs = [[{"start": s, "length": e - s, "period": q} for s, e, q in r.tolist()] for r in found]
        text = [b" ".join(kept(t, r) if len(r) else t) for t, r in zip(texts, found, strict=True)]
        return pa.record_batch({"doc_id": pa.array(ids, pa.int64()), "n_words": pa.array(map(len, texts), pa.int64()), "runs": pa.array(runs, shape), "collapsed": pa.array(text, pa.binary()).cast(pa.string())})

    for batch in batches:
        ids, texts, size = [], [], 0
        for i, x in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            raw = x.as_buffer().to_pybytes() if x.is_valid else b""
            if texts and size + len(raw) > AT_ONCE:
                yield done(ids, texts)
                ids, texts, size = [], [], 0
            ids.append(i)
            texts.append(raw.split())
            size += len(raw)
        if texts:
            yield done(ids, texts)


def find(docs: DataFrame) -> DataFrame:
    """``doc_id, n_words, runs, collapsed`` of every document: runs by start, then period; the words left when each run keeps its first period, joined by a space."""
    common.tune(docs.sparkSession)
    return common.documents(docs).mapInArrow(_searched, SCHEMA)


def longest(runs: Column) -> Column:
    """The run with the greatest length (of equal ones the first, then that of the smallest period); null if there is none."""
    keyed = F.array_min(F.transform(runs, lambda r: F.struct((-r["length"]).alias("l"), r["start"].alias("start"), r["period"].alias("period"))))
    return F.when(F.size(runs) > 0, F.struct(keyed["start"].alias("start"), (-keyed["l"]).alias("length"), keyed["period"].alias("period")))


def digests(found: DataFrame) -> DataFrame:
    """One row a document: numbers of its longest run, and hashes of all runs and of the collapsed text."""
    best = longest(F.col("runs"))
    line = lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n"))
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), best["start"].alias("start"), best["length"].alias("length"), best["period"].alias("period"),
        F.floor(F.lit(1000) * best["length"] / best["period"]).cast("long").alias("exponent_milli"),
        F.sha2(F.array_join(F.transform("runs", line), ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"), "n_words",
    )


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """The documents with, in a tenth of them (told by a checksum of the id), the end of the text made to repeat.

    Rows with a null doc_id stay as they are.
    """
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g = F.floor(h / 10)

    def repeated_end(words: Column) -> Column:
        n = F.size(words)
        a = (g % n).cast("int")
        p = (F.lit(1) + F.floor((n - a) / (F.lit(3) + g % 8))).cast("int")
        again = lambda a_p: F.transform(words, lambda w, i: F.when(i >= a_p["a"], F.get(words, a_p["a"] + (i - a_p["a"]) % a_p["p"])).otherwise(w))
        return F.when(n > 0, F.array_join(common.let(F.struct(a.alias("a"), p.alias("p")), again), " ")).otherwise("")

    words = F.filter(F.split("text", r"[\x20\x09-\x0D]+", -1), lambda w: w != "")
    return common.documents(docs).withColumn("text", F.when(F.coalesce(h % 10 == 0, F.lit(False)), common.let(words, repeated_end)).otherwise(F.col("text")))
