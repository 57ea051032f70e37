"""Removal of repeated 100-byte strings with suffix arrays.

Every window of ``SPAN`` bytes picks the smallest hash among its ``GRAM``-byte strings, so equal
windows pick the same string at the same place in them. Neighbouring windows that picked one
occurrence form a *stretch*; equal windows always lie in stretches with the same pick. That makes
the pick a routing key: all that can match lands in one bucket, and no bucket needs a whole text.

Whole copies (texts of at least ``SPAN`` bytes that an earlier row holds, by SHA-256) are removed as a whole and
aren't cut: all their windows start earlier, and what they could show others the first of them shows. The other texts
are written once in buckets of their id, so that later only what is asked or found of them travels.

A large table is gone through in up to ``TURNS`` turns: texts are dealt out a share of the buckets at a time, and steps 1 to 4
take a share of the picks at a time. What a turn shuffled is dropped before the next, so the disks hold one share of it beside
the texts and what was found. Equal windows have one pick, so no turn needs to know of another.

1. *Cut*: texts are cut into stretches; a task sends (pick, digest, place) only, packed, and keeps
   one of equal stretches of a block (copies of hot passages don't leave the task).
2. *Meet*: per bucket, of equal stretches the earliest stays as representative, the others are
   repeats of it as a whole. A pick with several different representatives must be compared.
3. *Compare*: the representatives' bytes are fetched and the suffixes of a bucket sorted by
   two-stage sorting: suffixes smaller than their successors are sorted directly, the others
   induced by a scan over the buckets of first bytes. Adjacent common prefixes of at least ``SPAN``
   bytes join equal windows; all but the earliest are removed. Strings are sorted by their picks, so
   many that fit together are taken at a time, however large the bucket.
4. *Hot picks*: the strings of a pick with over ``MOST_STRINGS`` different ones (the variants of a passage
   that very many documents hold) don't go to one task. They are cut into windows; of windows with equal
   bytes a task keeps one, and each goes by its own hash to a bucket. There they are sorted by their bytes:
   of a string of ``SPAN`` bytes no suffix but itself is long enough to count.

Stretches are told apart by a digest of 128 bits beside the pick; what is compared further is compared by
its bytes.

Defined results: a null text is empty; texts are UTF-8 bytes; rows with a null doc_id take no part
and give no row; rows of one doc_id and text are the same document seen again (an occurrence at its own
place is no earlier one), rows of one doc_id and different texts are several documents, in the order of
a hash of the text; texts shorter than ``SPAN`` bytes stay; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm import common
from corvane.operators.lineage import bucketed, reread

SPAN, GRAM = 100, 32
#: Bytes of text hashed at a time, and stretches packed at a time.
CHUNK = 1 << 17
BLOCK = 500_000
#: A place of a pick takes 24 bits; longer texts are cut with overlap.
LONGEST = 1 << 24
#: Bytes of input whose stretches a bucket is meant to gather.
BUCKET_BYTES = 48 << 20
#: Bytes of texts from which another turn is taken, and turns at most.
TURN_BYTES, TURNS = 128 << 20, 3
#: Bytes of strings that are sorted at once; different strings from which a pick is dealt out by windows; windows a task holds.
AT_ONCE, MOST_STRINGS, WINDOWS = 4 << 20, 1000, 200_000
#: ``digest`` and ``more`` are halves of one digest.
RECORD = np.dtype([("pick", "<u8"), ("digest", "<u8"), ("more", "<u8"), ("doc", "<i8"), ("mark", "<i8"), ("at", "<i4"), ("n", "i1")])


def _table() -> np.ndarray:
    return np.random.Generator(np.random.PCG64(20240229)).integers(0, 2**64, 256, np.uint64)


def gram_hashes(data: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Hash of the GRAM bytes from each place on (by doubling), mixed."""
    h, m = table[data], 1
    while m < GRAM:
        mult = np.uint64(pow(0x9E3779B97F4A7C15, m, 2**64))
        h = h[:-m] * mult + h[m:]
        m *= 2
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    return h


def stretches(data: np.ndarray, ends: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First windows, window counts and picks of the stretches of texts laid end to end.

    ``ends``: where each text ends. A stretch never crosses a text's end.
    """
    none = np.empty(0, np.int64)
    if len(data) < SPAN:
        return none, none, none.astype(np.uint64)
    h = gram_hashes(data, table)
    low = np.uint64((1 << 24) - 1)
    key = (h & ~low) | np.arange(len(h), dtype=np.uint64)  # of equal hashes the leftmost
    w, m = SPAN - GRAM + 1, 1
    while 2 * m <= w:
        key = np.minimum(key[:-m], key[m:])
        m *= 2
    key = np.minimum(key[: len(key) - (w - m)], key[w - m :])
    at = (key & low).astype(np.int64)  # for each window, the place of its pick
    starts = np.concatenate([[0], ends[:-1]])
    valid = np.zeros(len(data) + 1, np.int32)
    long = ends - starts >= SPAN
    np.add.at(valid, starts[long], 1)
    np.add.at(valid, ends[long] - SPAN + 1, -1)
    valid = np.cumsum(valid)[: len(at)] > 0
    new = valid.copy()
    new[1:] &= (at[1:] != at[:-1]) | ~valid[:-1]
    first = np.flatnonzero(new)
    stop = ~valid
    stop[1:] |= new[1:]
    last = np.append(np.flatnonzero(stop), len(at))
    after = last[np.searchsorted(last, first, side="right")]
    return first, after - first, h[at[first]]


def typed(t: np.ndarray) -> np.ndarray:
    """Whether each suffix is smaller than its successor."""
    n = len(t)
    change = np.flatnonzero(t[:-1] != t[1:])
    where = np.searchsorted(change, np.arange(n))
    small = np.zeros(n, bool)
    has = where < len(change)
    at = change[where[has]]
    small[has] = t[at] < t[at + 1]
    return small


def direct_sort(t: np.ndarray, at: np.ndarray, depth: int) -> np.ndarray:
    """Suffix starts sorted by their first ``depth`` symbols (at most 9 bits each)."""
    pad = np.concatenate([t, np.zeros(depth + 8, t.dtype)]).astype(np.uint64)
    seven = np.zeros(len(pad) - 6, np.uint64)
    for i in range(7):
        seven = (seven << np.uint64(9)) | pad[i : len(pad) - 6 + i]
    order = at[np.argsort(seven[at], kind="stable")]
    group = np.concatenate([[0], np.cumsum(seven[order[1:]] != seven[order[:-1]])]) if len(at) else np.empty(0, np.int64)
    for d in range(7, depth, 7):
        size = np.bincount(group) if len(group) else np.empty(0, np.int64)
        open_ = np.flatnonzero(size[group] > 1)
        if not len(open_):
            break
        key = seven[np.minimum(order[open_] + d, len(seven) - 1)]
        by = np.lexsort((key, group[open_]))
        order[open_] = order[open_][by]
        key, whose = key[by], group[open_]
        differs = np.zeros(len(order), np.int64)
        differs[open_[1:]] = (key[1:] != key[:-1]) & (whose[1:] == whose[:-1])
        group = group + np.cumsum(differs)
    return order


def suffix_array(t: np.ndarray, depth: int) -> np.ndarray:
    """All suffixes of ``t``, in order of at least their first ``depth`` symbols, by two-stage sorting."""
    small = typed(t)
    direct = direct_sort(t, np.flatnonzero(small), depth)
    top = int(t.max(initial=0)) + 1
    bounds = np.searchsorted(t[direct], np.arange(top + 1))
    induced: list[list[np.ndarray]] = [[] for _ in range(top)]

    def place(block: np.ndarray) -> None:
        """Put the predecessors that are larger than their successors into their buckets."""
        before = block[block > 0] - 1
        before = before[~small[before]]
        if len(before):
            sym = t[before]
            by = np.argsort(sym, kind="stable")
            before, sym = before[by], sym[by]
            cuts = np.flatnonzero(np.diff(sym)) + 1
            for part in np.split(before, cuts):
                induced[int(t[part[0]])].append(part)

    out = []
    if len(t) and not small[-1]:
        induced[int(t[-1])].append(np.array([len(t) - 1]))
    for c in range(top):
        done = 0
        while done < len(induced[c]):  # a run of one symbol feeds its own bucket
            block = induced[c][done]
            done += 1
            place(block)
        out += induced[c]
        smaller = direct[bounds[c] : bounds[c + 1]]
        place(smaller)
        out.append(smaller)
        induced[c] = []
    return np.concatenate(out) if out else np.empty(0, np.int64)


def common_prefixes(t: np.ndarray, sa: np.ndarray, most: int) -> np.ndarray:
    """Length of the common prefix of neighbours in ``sa``, up to ``most``."""
    pad = np.concatenate([t, np.full(most + 1, 300, t.dtype)])
    a, b = sa[:-1], sa[1:]
    lcp = np.zeros(len(a), np.int64)
    live = np.arange(len(a))
    for d in range(most):
        live = live[pad[a[live] + d] == pad[b[live] + d]]
        if not len(live):
            break
        lcp[live] = d + 1
    return lcp


def repeated_windows(parts: list[bytes], doc: np.ndarray, mark: np.ndarray, at: np.ndarray) -> list[tuple[int, int, int]]:
    """(part, first window, windows) to remove, for parts of texts of which each is at a place of its own."""
    size = np.array([len(p) for p in parts], np.int64)
    t = np.zeros(int(size.sum()) + len(parts), np.int16)  # 0 ends a part
    start = np.concatenate([[0], np.cumsum(size + 1)[:-1]])
    for s, p in zip(start, parts, strict=True):
        t[s : s + len(p)] = np.frombuffer(p, np.uint8)
        t[s : s + len(p)] += 1
    sa = suffix_array(t, SPAN + 5)
    part = np.searchsorted(start, sa, side="right") - 1
    fits = start[part] + size[part] - sa >= SPAN
    sa, part = sa[fits], part[fits]
    if not len(sa):
        return []
    same = common_prefixes(t, sa, SPAN) >= SPAN
    group = np.concatenate([[0], np.cumsum(~same)])
    place = at[part] + sa - start[part]
    by = np.lexsort((place, mark[part], doc[part], group))
    first = np.concatenate([[True], np.diff(group[by]) > 0])
    head = by[np.flatnonzero(first)[group[by]]]
    earlier = (doc[part[head]] != doc[part[by]]) | (mark[part[head]] != mark[part[by]]) | (place[head] != place[by])
    gone = by[earlier]
    where = np.sort(sa[gone])
    if not len(where):
        return []
    whose = np.searchsorted(start, where, side="right") - 1
    breaks = np.flatnonzero((np.diff(where) != 1) | (np.diff(whose) != 0)) + 1
    return [(int(whose[x[0]]), int(where[x[0]] - start[whose[x[0]]]), len(x)) for x in np.split(np.arange(len(where)), breaks)]


def _packed(rec: np.ndarray) -> bytes:
    """Columns one after the other, compressed."""
    return zstandard.ZstdCompressor(1).compress(b"".join(np.ascontiguousarray(rec[f]).tobytes() for f in RECORD.names))


def _unpacked(blob: bytes) -> np.ndarray:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    n, o = len(raw) // RECORD.itemsize, 0
    rec = np.empty(n, RECORD)
    for f in RECORD.names:
        rec[f] = np.frombuffer(raw, RECORD[f], n, o)
        o += n * RECORD[f].itemsize
    return rec


def starts(rec: np.ndarray) -> np.ndarray:
    """Whether each record, in order, is the first of its stretch."""
    new = np.ones(len(rec), bool)
    new[1:] = False
    for f in ("pick", "digest", "more"):
        new[1:] |= rec[f][1:] != rec[f][:-1]
    return new


def repeats_of_first(rec: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Records in order, and whether each repeats an earlier place of the same stretch."""
    keys = (rec["at"], rec["mark"], rec["doc"], rec["digest"], rec["pick"]) if rec["mark"].any() else (rec["at"], rec["doc"], rec["digest"], rec["pick"])
    rec = rec[np.lexsort(keys)]
    new = starts(rec)
    halves = (rec["pick"][1:] == rec["pick"][:-1]) & (rec["digest"][1:] == rec["digest"][:-1])
    if (new[1:] & halves).any():  # one half of the digest agrees, the other doesn't
        rec = rec[np.lexsort((rec["at"], rec["mark"], rec["doc"], rec["more"], rec["digest"], rec["pick"]))]
        new = starts(rec)
    head = np.flatnonzero(new)[np.cumsum(new) - 1] if len(rec) else np.empty(0, np.int64)
    return rec, (rec["doc"] != rec["doc"][head]) | (rec["mark"] != rec["mark"][head]) | (rec["at"] != rec["at"][head])


def in_buckets(rec: np.ndarray, to: np.ndarray) -> Iterator[tuple[int, bytes]]:
    """Packed records by bucket."""
    by = np.argsort(to, kind="stable")
    for part in np.split(by, np.flatnonzero(np.diff(to[by])) + 1) if len(by) else []:
        yield int(to[part[0]]), _packed(rec[part])


def dealt(rec: np.ndarray, buckets: int) -> tuple[list[int], list[bool], list[bytes]]:
    """Bucket, sureness and packed records: one representative leaves by its pick; repeats leave by document, as they only need to reach it."""
    rec, repeat = repeats_of_first(rec)
    keys, sure, blobs = [], [], []
    for flag, mine in ((False, rec[starts(rec) & ~repeat]), (True, in_runs(rec[repeat]))):
        to = (mine["doc"].astype(np.uint64) if flag else mine["pick"] >> np.uint64(20)) % np.uint64(buckets)
        for k, blob in in_buckets(mine, to):
            keys.append(k)
            sure.append(flag)
            blobs.append(blob)
    return keys, sure, blobs


def in_runs(rec: np.ndarray) -> np.ndarray:
    """Records of single windows, those in a row as one of up to 64; others as they are."""
    single, rest = rec[rec["n"] == 1], rec[rec["n"] != 1]
    if not len(single):
        return rest
    single = single[np.lexsort((single["at"], single["mark"], single["doc"]))]
    new = np.ones(len(single), bool)
    new[1:] = (single["doc"][1:] != single["doc"][:-1]) | (single["mark"][1:] != single["mark"][:-1]) | (single["at"][1:] != single["at"][:-1] + 1)
    at = np.arange(len(single))
    new |= (at - np.maximum.accumulate(np.where(new, at, 0))) % 64 == 0
    first = np.flatnonzero(new)
    out = single[first]
    out["n"] = np.diff(np.append(first, len(single)))
    return np.concatenate([rest, out])


def cut_texts(buckets: int, turns: int = 1, turn: int = 0):
    """Arrow batches of (doc_id, text, mark) to packed stretches by bucket; those whose picks have this turn."""

    def flush(recs: list[np.ndarray]) -> pa.RecordBatch:
        keys, sure, blobs = dealt(np.concatenate(recs), buckets)
        return pa.record_batch({"bucket": pa.array(keys, pa.int64()), "sure": pa.array(sure, pa.bool_()), "blob": pa.array(blobs, pa.binary())})

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, digest = _table(), xxhash.xxh3_128_digest
        held: list[np.ndarray] = []
        n_held = 0

        def chunk(ids: list[tuple[int, int]], texts: list[bytes]) -> None:
            nonlocal n_held
            data = b"".join(texts)
            ends = np.cumsum([len(x) for x in texts])
            first, n, pick = stretches(np.frombuffer(data, np.uint8), ends, table)
            mine = (pick >> np.uint64(8)) % np.uint64(turns) == turn  # other bits than those that name the bucket
            first, n, pick = first[mine], n[mine], pick[mine]
            rec = np.empty(len(first), RECORD)
            view = memoryview(data)
            halves = np.frombuffer(b"".join([digest(view[a:b]) for a, b in zip(first.tolist(), (first + n + SPAN - 1).tolist(), strict=True)]), "<u8").reshape(-1, 2)
            rec["digest"], rec["more"] = halves.T
            who = np.searchsorted(ends, first, side="right")
            rec["pick"], rec["n"] = pick, n
            rec["doc"], rec["mark"] = np.asarray(ids, np.int64)[who].T
            rec["at"] = first - np.concatenate([[0], ends])[who]
            held.append(rec)
            n_held += len(rec)

        for batch in batches:
            ids, texts, size = [], [], 0
            for i, x in zip(zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True), batch.column(1), strict=True):
                raw = x.as_buffer().to_pybytes() if x.is_valid else b""
                if len(raw) < SPAN:
                    continue
                if size and size + len(raw) > CHUNK:
                    chunk(ids, texts)
                    ids, texts, size = [], [], 0
                step = LONGEST - SPAN
                if len(raw) > step:
                    for o in range(0, len(raw) - SPAN + 1, step):
                        before = len(held)
                        chunk([i], [raw[o : o + step + SPAN - 1]])
                        held[before]["at"] += o
                    continue
                ids.append(i)
                texts.append(raw)
                size += len(raw)
            if texts:
                chunk(ids, texts)
            if n_held >= BLOCK:
                yield flush(held)
                held, n_held = [], 0
        if n_held:
            yield flush(held)

    return cut


def gathered(blobs: list[bytes]) -> np.ndarray:
    """The records of packed blobs; each is let go of as soon as it is unpacked."""
    recs = []
    while blobs:
        recs.append(_unpacked(blobs.pop()))
    return np.concatenate(recs) if recs else np.empty(0, RECORD)


def meet(t: pa.Table, most_strings: int = MOST_STRINGS) -> pa.Table:
    """Per bucket: repeats as (doc_id, mark, code, null route), strings to compare with the pick as route, ``hot`` where it has many."""
    sure = t.column("sure").to_numpy()
    blobs = t.column("blob").to_pylist()
    found = []
    for flag in (True, False):
        rec = gathered([b for b, s in zip(blobs, sure, strict=True) if s == flag])
        if flag:
            gone, ask, hot = rec, rec[:0], np.empty(0, bool)
        else:
            del blobs
            rec, repeat = repeats_of_first(rec)
            gone, reps = in_runs(rec[repeat]), rec[~repeat]
            reps = reps[starts(reps)]
            head = np.concatenate([[True], reps["pick"][1:] != reps["pick"][:-1]]) if len(reps) else np.empty(0, bool)
            which = np.cumsum(head) - 1
            strings = np.bincount(which)[which] if len(reps) else which
            ask, hot = reps[strings > 1], strings[strings > 1] > most_strings
        for part, route, many in ((gone, False, np.zeros(len(gone), bool)), (ask, True, hot)):
            found.append((part["doc"], part["mark"], part["at"].astype(np.int64) * 1024 + part["n"], pa.array(np.ascontiguousarray(part["pick"]).view(np.int64), mask=np.full(len(part), not route)), many))
    doc, mark, code, route, many = zip(*found, strict=True)
    return pa.table({"doc_id": np.concatenate(doc), "mark": np.concatenate(mark), "code": np.concatenate(code), "route": pa.concat_arrays(route), "hot": np.concatenate(many)})


def earliest(same: np.ndarray, doc: np.ndarray, mark: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of places by number of what stands there: the first of each kind, and the others."""
    by = np.lexsort((at, mark, doc, same))
    first = np.ones(len(by), bool)
    first[1:] = same[by][1:] != same[by][:-1]
    head = by[np.flatnonzero(first)[np.cumsum(first) - 1]]
    elsewhere = (doc[by] != doc[head]) | (mark[by] != mark[head]) | (at[by] != at[head])
    return by[first], by[elsewhere]


def fetch(buckets: int):
    """The bytes of the stretches to compare, with their pick as ``route``; of hot picks windows, with their hash, ``sure`` false. What a task finds to be repeated there is packed, ``sure`` set, with a bucket as ``route``."""
    kind = {"doc_id": pa.int64(), "mark": pa.int64(), "at": pa.int64(), "route": pa.int64(), "sure": pa.bool_(), "part": pa.binary()}

    def strings(doc, mark, at, route, part, sure=None) -> pa.RecordBatch:
        return pa.record_batch({k: pa.array(v, t) for (k, t), v in zip(kind.items(), (doc, mark, at, route, [sure] * len(part), part), strict=True)})

    def windows(held: list[tuple[int, int, int, bytes]]) -> Iterator[pa.RecordBatch]:
        w = np.concatenate([np.lib.stride_tricks.sliding_window_view(np.frombuffer(p, np.uint8), SPAN) for *_, p in held])
        n = [len(p) - SPAN + 1 for *_, p in held]
        doc, mark = (np.repeat(np.array([h[i] for h in held], np.int64), n) for i in (0, 1))
        at = np.concatenate([np.arange(a, a + k) for (_, _, a, _), k in zip(held, n, strict=True)])
        _, same = np.unique(np.ascontiguousarray(w).view(f"S{SPAN}").ravel(), return_inverse=True)
        first, others = earliest(same, doc, mark, at)
        rec = np.zeros(len(others), RECORD)
        rec["doc"], rec["mark"], rec["at"], rec["n"] = doc[others], mark[others], at[others], 1
        rec = in_runs(rec)
        gone = list(in_buckets(rec, rec["doc"].astype(np.uint64) % np.uint64(buckets)))
        none = [None] * len(gone)
        yield pa.record_batch({k: pa.array(v, t) for (k, t), v in zip(kind.items(), (none, none, none, [k for k, _ in gone], [True] * len(gone), [b for _, b in gone]), strict=True)})
        for i in range(0, len(first), 50_000):
            x = first[i : i + 50_000]
            part = [r.tobytes() for r in w[x]]
            route = np.array([xxhash.xxh3_64_intdigest(p) for p in part], np.uint64).view(np.int64)
            yield strings(doc[x], mark[x], at[x], route, part, False)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, int, int, bytes]] = []
        n_held = 0
        for batch in batches:
            rows = []
            for i, text, m, asks in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), batch.column(3), strict=True):
                raw = text.as_buffer()
                for x in asks.as_py():
                    a, n = divmod(x["code"], 1024)
                    part = raw[a : a + n + SPAN - 1].to_pybytes()
                    if x["hot"]:
                        held.append((i, m, a, part))
                        n_held += n
                        if n_held >= WINDOWS:
                            yield from windows(held)
                            held, n_held = [], 0
                    else:
                        rows.append((i, m, a, x["route"], part))
            yield strings(*(list(c) for c in zip(*rows, strict=True)) if rows else ([],) * 5)
        if held:
            yield from windows(held)

    return run


def repeated_whole(t: pa.Table) -> np.ndarray:
    """Rows (doc, mark, code) of the windows, of ``SPAN`` bytes each, that stand earlier elsewhere."""
    doc, mark, at = (t.column(c).to_numpy() for c in ("doc_id", "mark", "at"))
    windows = np.frombuffer(b"".join(x.as_buffer() for x in t.column("part")), f"S{SPAN}")
    others = earliest(np.unique(windows, return_inverse=True)[1], doc, mark, at)[1]
    rec = np.zeros(len(others), RECORD)
    rec["doc"], rec["mark"], rec["at"], rec["n"] = doc[others], mark[others], at[others], 1
    rec = in_runs(rec)
    return np.stack([rec["doc"], rec["mark"], rec["at"].astype(np.int64) * 1024 + rec["n"]], axis=1)


def compare(t: pa.Table, at_once: int = AT_ONCE) -> pa.Table:
    """Two-stage suffix sorting over the strings of a bucket, those of some routes at a time; in buckets of sure repeats nothing is left to compare."""
    if pc.any(t.column("sure")).as_py():
        met = meet(t.select(["sure", "part"]).rename_columns(["sure", "blob"]))
        return met.filter(pc.is_null(met.column("route"))).select(["doc_id", "mark", "code"])
    is_window = pc.equal(t.column("sure"), False).fill_null(False)
    rows = [repeated_whole(t.filter(is_window))]
    t = t.filter(pc.invert(is_window))
    doc, mark, at, route = (t.column(c).to_numpy() for c in ("doc_id", "mark", "at", "route"))
    by = np.argsort(route, kind="stable")
    size = np.cumsum(pc.binary_length(t.column("part")).to_numpy()[by])
    head = np.flatnonzero(np.diff(route[by], prepend=route[by[0]] - 1)) if len(by) else by
    which = size[head] // at_once
    found: list[tuple] = []
    for x in np.split(by, head[1:][which[1:] != which[:-1]]):
        parts = t.column("part").take(pa.array(x)).to_pylist()
        found += [(doc[x[p]], mark[x[p]], (int(at[x[p]]) + f) * 1024 + n) for p, f, n in repeated_windows(parts, doc[x], mark[x], at[x])]
    out = np.concatenate([*rows, np.array(found, np.int64).reshape(-1, 3)])
    return pa.table({"doc_id": out[:, 0], "mark": out[:, 1], "code": out[:, 2]})


def _runs(codes: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of bytes that the windows cover."""
    a, w = codes >> 10, codes & 1023
    a, b = np.minimum(a, n), np.minimum(a + w + SPAN - 1, n)
    edge = np.zeros(n + 2, np.int32)
    np.add.at(edge, a, 1)
    np.add.at(edge, b, -1)
    gone = np.concatenate([[False], np.cumsum(edge)[:n] > 0, [False]])
    change = np.flatnonzero(gone[1:] != gone[:-1])
    return change[::2], change[1::2]


def apply_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out: dict[str, list] = {k: [] for k in ("doc_id", "n_bytes", "n_removed", "n_spans", "kept")}
        for i, text, codes in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True):
            raw = text.as_buffer().to_pybytes()
            starts, ends, kept = (), (), raw
            if codes.is_valid and len(codes.values):
                starts, ends = _runs(codes.values.to_numpy(), len(raw))
                cuts = [0, *(x for ab in zip(starts.tolist(), ends.tolist(), strict=True) for x in ab), len(raw)]
                kept = b"".join(raw[a:b] for a, b in zip(cuts[::2], cuts[1::2], strict=True))
            for k, v in zip(out, (i, len(raw), len(raw) - len(kept), len(starts), kept), strict=True):
                out[k].append(v)
        yield pa.record_batch({k: pa.array(v, pa.binary() if k == "kept" else pa.int64()) for k, v in out.items()})


def marked(docs: DataFrame) -> DataFrame:
    """``doc_id, text, mark``: 0, or for rows of a doc_id with several texts a hash of the text."""
    version = F.xxhash64("text")
    mixed = common.cut(docs.groupBy("doc_id").agg(F.min(version).alias("a"), F.max(version).alias("b")).where("a <> b").select("doc_id", F.lit(True).alias("mixed")))
    mixed = F.broadcast(mixed) if common.fits_broadcast(mixed) else mixed
    return docs.join(mixed, "doc_id", "left").select("doc_id", "text", F.when(F.col("mixed"), version).otherwise(0).cast("long").alias("mark"))


def whole_copies(docs: DataFrame) -> tuple[DataFrame, int]:
    """``doc_id, mark, n_bytes`` of the rows whose text, of ``SPAN`` bytes at least, an earlier row holds; bytes of all such texts."""
    x = reread(docs.select("doc_id", "mark", F.octet_length("text").cast("long").alias("n_bytes"), F.unhex(F.sha2("text", 256)).alias("key")).where(F.col("n_bytes") >= SPAN))
    same = reread(x.groupBy("key").agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "mark")).alias("first")).where("n > 1"))
    rows, size = x.agg(F.count("*"), F.coalesce(F.sum("n_bytes"), F.lit(0))).first()
    x = common.join_hot(x, same, "key", "n", rows)
    return reread(x.where("doc_id <> first.doc_id OR mark <> first.mark").select("doc_id", "mark", "n_bytes")), size


def dedup(docs: DataFrame, buckets: int | None = None, most_strings: int = MOST_STRINGS, at_once: int = AT_ONCE) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept`` (the remaining bytes) of every document."""
    spark = docs.sparkSession
    common.tune(spark)
    buckets = buckets or common.buckets(docs, BUCKET_BYTES)
    docs = marked(common.documents(docs).where(F.col("doc_id").isNotNull()))
    row = ["doc_id", "mark"]
    later, size = whole_copies(docs)
    turns = min(TURNS, 1 + size // TURN_BYTES)

    def dealt_out(turn: int) -> DataFrame:
        mine = F.pmod(F.hash(*row), F.lit(buckets)) % turns == turn
        copies = later.where(mine).hint("shuffle_hash")
        return docs.where(mine).repartition(buckets, *row).join(copies, row, "left_anti").select("doc_id", "text", "mark")

    stored = bucketed((dealt_out(turn) for turn in range(turns)), buckets, *row)
    found = []
    for turn in range(turns):
        packed = stored.mapInArrow(cut_texts(buckets, turns, turn), "bucket long, sure boolean, blob binary")
        met = reread(packed.groupBy("bucket").applyInArrow(lambda t: meet(t, most_strings), "doc_id long, mark long, code long, route long, hot boolean"))

        ask = met.where(F.col("route").isNotNull()).groupBy(*row).agg(F.collect_list(F.struct("code", "route", "hot")).alias("asks"))
        parts = stored.join(ask.hint("shuffle_hash"), row).select("doc_id", "text", "mark", "asks")
        parts = parts.mapInArrow(fetch(buckets), "doc_id long, mark long, at long, route long, sure boolean, part binary")
        parts = parts.withColumn("bucket", F.when(F.coalesce("sure", F.lit(False)), F.col("route") + buckets).otherwise(F.pmod(F.xxhash64("route"), F.lit(buckets))))
        compared = parts.groupBy("bucket").applyInArrow(lambda t: compare(t, at_once), "doc_id long, mark long, code long")
        found += [met.where(F.col("route").isNull()).select(*row, "code"), reread(compared)]

    gone = reduce(DataFrame.unionByName, found).groupBy(*row).agg(F.collect_list("code").alias("codes"))
    first = stored.join(gone.hint("shuffle_hash"), row, "left").select("doc_id", "text", "codes").mapInArrow(apply_runs, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")
    return first.unionByName(later.select("doc_id", "n_bytes", F.col("n_bytes").alias("n_removed"), F.lit(1).cast("long").alias("n_spans"), F.lit(b"").alias("kept")))
