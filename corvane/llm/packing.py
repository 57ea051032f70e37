"""Hierarchical multi-length packing of documents into training sequences.

A document's tokens first fill whole windows of the longest tier. Its rest is routed to the shortest
context-size tier that holds it. Tiers are packed from the longest down: each rest opens a window of
its tier, the gap takes the longest rests of shorter tiers that fit, and what is left of the gap is
filled by cutting one more. Windows of the shorter tiers are themselves full, a power of two, and
need no padding; what is left at the end of a block is cut into powers of two. Sequences are dealt into
step groups of about equal tokens, the longest first to the lightest group.

Packing is local to a block of a task's documents (a few million tokens, some hundred thousand documents),
so nothing is shuffled and a lost task is simply run again, with the same ids. All that is padded is gaps of less than ``SLIVER``
tokens in windows of the longest tier, however the input is cut into tasks.

Defined results: a null text is empty, a document of the end id alone; documents with a null or
repeated doc_id are packed like any other row; an empty table gives no pieces.
"""

from __future__ import annotations

import base64
import bisect
import heapq
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame

from corvane.llm import bpe, common

TIERS = (2048, 1024, 512, 256, 128, 64)
#: Tokens and documents of a block, and rows given on at a time; a longest window's gap shorter than this stays padding rather than take a sliver of a document.
BLOCK_TOKENS, BLOCK_DOCS, OUT_ROWS = 4_000_000, 200_000, 20_000
SLIVER = 8
#: Fixed value: the text of the vocabulary's special token.
SPECIAL = "<|endoftext|>"
#: Characters of white space in a row from which a text is cut there before it is encoded: the tokenizer's
#: expression can't take about a million.
LONG_SPACE = 10_000
#: Fixed value: Unicode's white space.
SPACES = re.compile(f"[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{{{LONG_SPACE},}}")
#: Tokens of a step group.
STEP_TOKENS = 64 * 2048
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, tier int, step_group long"


@lru_cache(4)
def encoder(path: str, pattern: str = bpe.PATTERN) -> tiktoken.Encoding:
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("packing", pat_str=pattern, mergeable_ranks=ranks, special_tokens={SPECIAL: len(ranks)})


def stretches(text: str) -> Iterator[tuple[str, bool]]:
    """The text in parts, and whether a part is a long stretch of white space, which is a piece by itself.

    Of white space before something else the last character goes with that, or is a piece of its own; at the
    end of a text or before a special token all of it is one piece. These are borders of pieces in any case.
    """
    at = 0
    for m in SPACES.finditer(text):
        end = m.end() if m.end() == len(text) or text.startswith(SPECIAL, m.end()) else m.end() - 1
        yield text[at : m.start()], False
        yield text[m.start() : end], True
        at = end
    yield text[at:], False


def token_ids(path: str, text: str, end: int) -> np.ndarray:
    whole = encoder(path, "(?s:.+)")
    parts = [(whole if space else encoder(path)).encode_to_numpy(p, allowed_special="all") for p, space in stretches(text) if p]
    return np.append(np.concatenate(parts) if parts else [], end).astype("<u4")


def powers(window: list[tuple[int, int, int]]) -> list[list[tuple[int, int, int]]]:
    """The pieces (document, start, length) of a window, cut into sequences of powers of two, the longest first."""
    left = sum(n for _, _, n in window)
    out, rest = [], window[::-1]
    while left:
        room = 1 << (left.bit_length() - 1)
        left -= room
        sequence = []
        while room:
            doc, at, n = rest.pop()
            if n > room:
                rest.append((doc, at + room, n - room))
                n = room
            sequence.append((doc, at, n))
            room -= n
        out.append(sequence)
    return out


def plan(lengths: list[int], tiers: tuple[int, ...] = TIERS) -> list[tuple[int, int, int, int, int]]:
    """(document, start, length, sequence, offset) of every piece; sequences count from 0."""
    pieces: list[tuple[int, int, int, int, int]] = []
    sequence = 0
    top = tiers[0]
    rests: list[list[tuple[int, int, int]]] = [[] for _ in tiers]  # (length, document, start) by tier, ascending
    caps = tiers[::-1]
    for doc, n in enumerate(lengths):
        at = 0
        while n - at >= top:
            pieces.append((doc, at, top, sequence, 0))
            sequence, at = sequence + 1, at + top
        if n > at:
            rests[len(tiers) - 1 - bisect.bisect_left(caps, n - at)].append((n - at, doc, at))
    for r in rests:
        r.sort()
    for k, cap in enumerate(tiers):
        while rests[k]:
            n, doc, at = rests[k].pop()
            window, fill = [(doc, at, n)], n
            while (gap := cap - fill) > 0:
                got = None
                for r in rests[k:]:
                    if r and (i := bisect.bisect_left(r, (gap + 1,))):
                        got = r.pop(i - 1)  # the longest that fits
                        break
                if got is None:
                    if gap < SLIVER and cap == top:  # shorter windows must be full
                        break
                    source = next((r for r in reversed(rests[k:]) if r), None)
                    if source is None:
                        break
                    n, doc, at = source.pop()  # cut: none fits, so it is longer than the gap
                    bisect.insort(rests[len(tiers) - 1 - bisect.bisect_left(caps, n - gap)], (n - gap, doc, at + gap))
                    got = (gap, doc, at)
                n, doc, at = got
                window.append((doc, at, n))
                fill += n
            for part in [window] if cap == top and cap - fill < SLIVER else powers(window):
                offset = 0
                for doc, at, n in part:
                    pieces.append((doc, at, n, sequence, offset))
                    offset += n
                sequence += 1
    return pieces


def step_groups(fill: list[int], step_tokens: int = STEP_TOKENS) -> list[int]:
    """Group of each sequence: the longest first to the group with the fewest tokens."""
    groups = [(0, g) for g in range(max(1, -(-sum(fill) // step_tokens)))]
    out = [0] * len(fill)
    for s in sorted(range(len(fill)), key=lambda s: -fill[s]):
        n, g = groups[0]
        heapq.heapreplace(groups, (n + fill[s], g))
        out[s] = g
    return out


def pack(docs: DataFrame, path: str, end: int = 1, tiers: tuple[int, ...] = TIERS) -> DataFrame:
    """Pieces of all documents. ``path``: a rank file that every worker has; ``end``: the id after each document."""
    common.tune(docs.sparkSession)
    names = [x.split()[0] for x in SCHEMA.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = TaskContext.get().partitionId() << 33
        ids: list = []
        sizes: list[int] = []
        rests: list[np.ndarray] = []  # ids after the whole windows
        whole: list[list[int]] = []  # checksums of the whole windows
        held, n_seq, n_group = 0, 0, 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal n_seq, n_group
            found = plan(sizes, tiers)
            fill = [0] * (1 + max(p[3] for p in found))
            for _, _, n, s, _ in found:
                fill[s] += n
            group = step_groups(fill)
            for k in range(0, len(found), OUT_ROWS):
                rows = []
                for doc, at, n, s, o in found[k : k + OUT_ROWS]:
                    skip = len(whole[doc]) * tiers[0]
                    crc = whole[doc][at // tiers[0]] if at < skip else zlib.crc32(rests[doc][at - skip : at - skip + n].tobytes())
                    rows.append((ids[doc], at, n, crc, sizes[doc], base + n_seq + s, o, next(t for t in reversed(tiers) if t >= fill[s]), base + n_group + group[s]))
                yield pa.record_batch({k: pa.array(c, pa.int32() if k == "tier" else pa.int64()) for k, c in zip(names, zip(*rows, strict=True), strict=True)})
            n_seq, n_group = n_seq + len(fill), n_group + max(group) + 1

        for batch in batches:
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                tokens = token_ids(path, text.as_py() or "", end)
                n_whole = len(tokens) // tiers[0]
                ids.append(i)
                sizes.append(len(tokens))
                whole.append([zlib.crc32(tokens[k * tiers[0] : (k + 1) * tiers[0]].tobytes()) for k in range(n_whole)])
                rests.append(tokens[n_whole * tiers[0] :].copy())
                held += len(rests[-1])
                if held >= BLOCK_TOKENS or len(ids) >= BLOCK_DOCS:
                    yield from flush()
                    ids, sizes, rests, whole, held = [], [], [], [], 0
        if ids:
            yield from flush()

    return common.documents(docs).mapInArrow(run, SCHEMA)
