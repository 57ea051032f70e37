"""Byte-level BPE: encoding with a priority queue of merge ranks, decoding from the vocabulary.

A text is split by the tokenizer's pattern; each distinct piece is a doubly linked list of symbols
whose neighbouring pairs wait in a heap by merge rank. A popped entry whose symbols have changed
since is stale and skipped. Pieces repeat, so a worker keeps a bounded table of encoded pieces.

Defined results: a null text is empty and gives no ids; an added token's string in a text becomes
its id, as the tokenizers library does; ids outside the vocabulary can't be decoded and raise
KeyError; bytes that are no UTF-8 decode to U+FFFD.
"""

from __future__ import annotations

import hashlib
import json
import re
import struct
from collections.abc import Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from corvane.llm import common

#: The split pattern of byte-level BPE vocabularies.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Letters beyond ASCII that both expressions below class alike; a text of these and ASCII alone is
#: split by the faster of the two.
LATIN = "À-ÖØ-öø-ʯ"
SPACE = r"\t\n\x0b\x0c\r "
PLAIN = re.compile(f"[\\x00-\\x7f{LATIN}]*")
FAST = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z{LATIN}]+| ?[0-9]+| ?[^{SPACE}A-Za-z0-9{LATIN}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+")
FULL = regex.compile(PATTERN)
#: Encoded pieces in each of the two generations a worker keeps, and the length up to which one is kept.
KEPT_PIECES = 300_000
KEPT_LENGTH = 64
#: Halves of a packed merge: its rank; its symbol, or in the heap a place.
PLACE = (1 << 32) - 1
RANK = ~PLACE


def split(text: str) -> list[str]:
    return (FAST if PLAIN.fullmatch(text) else FULL).findall(text)


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in such vocabularies."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = iter(range(0x100, 0x200))
    return [chr(b) if b in shown else chr(next(rest)) for b in range(256)]


class Bpe:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        symbols = byte_symbols()
        value = {c: b for b, c in enumerate(symbols)}
        vocab = spec["model"]["vocab"]
        self.single = [vocab[c] for c in symbols]
        self.merges: dict[int, int] = {}  # left << 32 | right to rank << 32 | whole
        for rank, pair in enumerate(spec["model"]["merges"]):
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            self.merges[vocab[left] << 32 | vocab[right]] = rank << 32 | vocab[left + right]
        self.strings = {i: bytes(value[c] for c in s) for s, i in vocab.items()}
        self.added = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.strings |= {i: s.encode() for s, i in self.added.items()}
        self.at_added = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def merge(self, piece: bytes) -> list[int]:
        """Ids of one piece."""
        single, merges = self.single, self.merges.get
        symbol = [single[b] for b in piece]
        n = len(symbol)
        heap = []
        for i in range(n - 1):
            if (m := merges(symbol[i] << 32 | symbol[i + 1])) is not None:
                heap.append(m & RANK | i)
        if not heap:
            return symbol
        heapify(heap)
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        while heap:
            e = heappop(heap)
            i = e & PLACE
            j = after[i]
            if j >= n or (left := symbol[i]) < 0:
                continue  # stale
            m = merges(left << 32 | symbol[j])
            if m is None or m & RANK != e & RANK:
                continue  # stale: one of the two has been merged since
            symbol[i], symbol[j] = whole, _ = m & PLACE, -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (m := merges(whole << 32 | symbol[k])) is not None:
                    heappush(heap, m & RANK | i)
            if (h := before[i]) >= 0 and (m := merges(symbol[h] << 32 | whole)) is not None:
                heappush(heap, m & RANK | h)
        return [s for s in symbol if s >= 0]

    def _new(self, piece: str) -> bytes:
        ids = self.older.get(piece)
        if ids is None:
            symbols = self.merge(piece.encode())
            ids = struct.pack(f"<{len(symbols)}I", *symbols)
        if len(piece) <= KEPT_LENGTH:
            if len(self.known) >= KEPT_PIECES:  # what was used since the last turn stays
                self.known, self.older = {}, self.known
            self.known[piece] = ids
        return ids

    def _ordinary(self, text: str) -> bytes:
        pieces = split(text)
        found = list(map(self.known.get, pieces))
        if None in found:
            found = [x or self._new(p) for x, p in zip(found, pieces, strict=True)]
        return b"".join(found)

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        if self.at_added is None or not self.at_added.search(text):
            return self._ordinary(text)
        out = [np.array([self.added[p]], "<u4").tobytes() if p in self.added else self._ordinary(p) for p in self.at_added.split(text)]
        return b"".join(out)

    def decode(self, ids: bytes) -> str:
        strings = self.strings
        return b"".join([strings[i] for i in np.frombuffer(ids, "<u4").tolist()]).decode("utf-8", "replace")


@lru_cache(2)
def loaded(path: str) -> Bpe:
    """One table per worker."""
    return Bpe(path)


def digests(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(path)
        for batch in batches:
            n, a, b = [], [], []
            for text in batch.column(1):
                ids = bpe.encode(text.as_py() or "")
                n.append(len(ids) // 4)
                a.append(hashlib.sha256(ids).hexdigest())
                b.append(hashlib.sha256(bpe.decode(ids).encode()).hexdigest())
            yield pa.record_batch({"doc_id": batch.column(0), "n_tokens": pa.array(n, pa.int64()), "ids_sha256": pa.array(a, pa.string()), "decoded_sha256": pa.array(b, pa.string())})

    return run


def encode(docs: DataFrame, path: str) -> DataFrame:
    """``doc_id, ids`` (array of int) of every document; ``path`` is a tokenizer file that every worker has."""
    common.tune(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(path)
        for batch in batches:
            ids = [np.frombuffer(bpe.encode(t.as_py() or ""), "<u4").astype(np.int32) for t in batch.column(1)]
            yield pa.record_batch({"doc_id": batch.column(0), "ids": pa.array(ids, pa.list_(pa.int32()))})

    return common.documents(docs).mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """``doc_id, text`` of rows with ``ids``; null ids give an empty text."""
    common.tune(encoded.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(path)
        for batch in batches:
            text = [bpe.decode(np.asarray(i.as_py() or [], "<u4").tobytes()) for i in batch.column(1)]
            yield pa.record_batch({"doc_id": batch.column(0), "text": pa.array(text, pa.string())})

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def encoded_digests(docs: DataFrame, path: str) -> DataFrame:
    common.tune(docs.sparkSession)
    return common.documents(docs).mapInArrow(digests(path), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
