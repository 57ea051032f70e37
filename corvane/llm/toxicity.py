"""Toxicity of texts: a bidirectional GRU with attention pooling, in numpy.

A word enters as two vectors: one of the word and the mean of those of its character 3- and 4-grams.
Words and n-grams of at least ``MIN_DOCS`` documents of the training sample have vectors, which start
with their smoothed log-odds and are trained on with the network; others are zero. A text is covered by
overlapping windows of ``WINDOW`` words, each ``STRIDE`` on from the last, and all are scored; the text's
score is that of its highest window, and training follows the same rule (the highest window of a text
carries its label). On a part of the sample the scores are shifted so that the best division of the
two classes lies at ``AT``.

The model is fitted on at most ``SAMPLE`` labelled documents of each class, those whose ids hash
lowest, and of those on as many, in that order, as have ``SAMPLE_CHARS`` characters in all; it has a fixed
size. What it is fitted on are whole texts: a document that no longer fits is left out as a row. One task
trains on it, so of the texts nothing reaches the driver, only the model does. Scoring
covers every word of every text and needs no shuffle.

Defined results: a null or wordless text has the score of an empty window; without labelled
documents of both classes every score is 0; a null label is none; repeated labels of a document are
one (the highest), of several texts of one id the first in order is learnt from; a null doc_id is scored and counts as not held out; an empty table gives no rows.
"""

from __future__ import annotations

import pickle
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corvane.llm import common

#: Bounds of what is learnt from: documents of a class, and characters of all documents of a class.
SAMPLE, SAMPLE_CHARS = 2_000, 8_000_000
WINDOW, STRIDE = 48, 24
MIN_DOCS, DIM, HIDDEN = 3, 6, 8
EPOCHS, BATCH, RATE = 6, 64, 0.01
#: The score that divides the classes.
AT = 0.3
#: Windows scored at a time; words whose inputs a worker keeps.
BLOCK, KEPT_WORDS = 1024, 150_000
#: Words whose n-grams are hashed at a time.
HASHED = 20_000
WORD = re.compile(r"\w+")


def words(text: str) -> list[str]:
    return WORD.findall(text.lower())


def features(new: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of words; of all their character n-grams, and the word each belongs to."""
    data = np.frombuffer("".join(f"\x02{w}\x03" for w in new).encode("utf-32-le"), "<u4").astype(np.uint64)
    size = np.array([len(w) + 2 for w in new], np.int64)
    start = np.cumsum(size) - size
    who = np.repeat(np.arange(len(new)), size)

    def mix(h: np.ndarray) -> np.ndarray:
        h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        return h ^ (h >> np.uint64(32))

    power = np.cumprod(np.full(int(size.max(initial=1)), 0x100000001B3, np.uint64))
    place = np.arange(len(data)) - start[who]
    whole = np.add.reduceat(data * power[place], start) if len(new) else np.empty(0, np.uint64)
    grams, whose = [], []
    for n in (3, 4):
        h = np.zeros(max(0, len(data) - n + 1), np.uint64)
        for i in range(n):
            h = h * np.uint64(0x9E3779B97F4A7C15) + data[i : len(data) - n + 1 + i]
        ok = who[: len(h)] == who[n - 1 :]
        grams.append(mix(h[ok] + np.uint64(n)))
        whose.append(who[: len(h)][ok])
    return mix(whole), np.concatenate(grams), np.concatenate(whose)


def by_word(new: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of words; of all their character n-grams, word by word; how many of these each word has."""
    parts = []
    for i in range(0, len(new), HASHED):
        some = new[i : i + HASHED]
        w, g, whose = features(some)
        parts.append((w, g[np.argsort(whose, kind="stable")], np.bincount(whose, minlength=len(some))))
    if not parts:
        return np.empty(0, np.uint64), np.empty(0, np.uint64), np.empty(0, np.int64)
    w, g, n = (np.concatenate(x) for x in zip(*parts, strict=True))
    return w, g, n


def place(hashes: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Rows of a table whose keys (but the first row's, which is for what isn't known) are sorted."""
    at = np.searchsorted(keys, hashes)
    known = keys[np.minimum(at, len(keys) - 1)] == hashes if len(keys) else np.zeros(len(hashes), bool)
    return np.where(known, at + 1, 0)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


@dataclass
class Model:
    p: dict[str, np.ndarray]
    shift: float = 0.0
    fitted: bool = True
    index: dict[str, int] = field(default_factory=dict)
    inputs: np.ndarray | None = None
    count: int = 1

    def vectors(self, new: list[str]) -> np.ndarray:
        w, g, who = features(new)
        w, g = place(w, self.p["word_keys"]), place(g, self.p["gram_keys"])
        n = np.bincount(who, minlength=len(new))
        by = np.argsort(who, kind="stable")
        chars = np.zeros((len(new), DIM), np.float32)
        if len(g):
            has = np.flatnonzero(n)
            chars[has] = np.add.reduceat(self.p["chars"][g[by]], (np.cumsum(n) - n)[has]) / n[has, None]
        return np.concatenate([self.p["words"][w], chars], axis=1)

    def rows(self, text: list[str]) -> np.ndarray:
        """Rows of ``inputs`` for words; row 0 is no word."""
        if self.inputs is None:
            self.inputs = np.zeros((KEPT_WORDS + 1, 6 * HIDDEN), np.float32)
        if self.count + len(text) > KEPT_WORDS:
            unknown = len({w for w in text if w not in self.index})
            if self.count + unknown > KEPT_WORDS:
                self.index.clear()
                self.count = 1
                if len(text) >= KEPT_WORDS:
                    self.inputs = np.zeros((len(text) + KEPT_WORDS, 6 * HIDDEN), np.float32)
        at = list(map(self.index.get, text))
        if None in at:
            new = list(dict.fromkeys(w for w, i in zip(text, at, strict=True) if i is None))
            x = self.vectors(new) @ self.p["W"] + self.p["b"]
            self.inputs[self.count : self.count + len(new)] = x
            self.index.update(zip(new, range(self.count, self.count + len(new)), strict=True))
            self.count += len(new)
            at = list(map(self.index.__getitem__, text))
        return np.array(at, np.int32)


def fresh(rng: np.random.Generator, n_words: int = 0, n_grams: int = 0) -> dict[str, np.ndarray]:
    normal = lambda *s, scale: (rng.standard_normal(s) * scale).astype(np.float32)
    p = {"words": normal(n_words + 1, DIM, scale=0.05), "chars": normal(n_grams + 1, DIM, scale=0.05), "W": normal(2 * DIM, 6 * HIDDEN, scale=0.3), "b": np.zeros(6 * HIDDEN, np.float32)}
    p |= {"U0": normal(HIDDEN, 3 * HIDDEN, scale=0.3), "U1": normal(HIDDEN, 3 * HIDDEN, scale=0.3), "a": normal(2 * HIDDEN, scale=0.3), "v": normal(2 * HIDDEN, scale=0.3), "c": np.zeros(1, np.float32)}
    return p


def run_gru(x: np.ndarray, mask: np.ndarray, u: np.ndarray, keep: list) -> np.ndarray:
    """States (time, batch, hidden) over inputs (time, batch, 3 * hidden); each step's parts go to ``keep``."""
    steps, n, _ = x.shape
    h = np.zeros((n, HIDDEN), np.float32)
    out = np.empty((steps, n, HIDDEN), np.float32)
    for t in range(steps):
        s = h @ u
        g = sigmoid(x[t, :, : 2 * HIDDEN] + s[:, : 2 * HIDDEN])
        z, r = g[:, :HIDDEN], g[:, HIDDEN:]
        c = np.tanh(x[t, :, 2 * HIDDEN :] + r * s[:, 2 * HIDDEN :])
        new = c + z * (h - c)
        keep.append((h, s, z, r, c))
        h = np.where(mask[t], new, h)
        out[t] = h
    return out


def last_states(x: np.ndarray, mask: np.ndarray | None, u: np.ndarray) -> np.ndarray:
    """As ``run_gru``, for scoring: inputs and states are (time, numbers, batch), and steps work in place."""
    steps, _, n = x.shape
    ut, out = np.ascontiguousarray(u.T), np.empty((steps, HIDDEN, n), x.dtype)
    s, g, c = (np.empty((k * HIDDEN, n), x.dtype) for k in (3, 2, 1))
    h = np.zeros((HIDDEN, n), x.dtype)
    for t in range(steps):
        np.matmul(ut, h, out=s)
        np.add(x[t, : 2 * HIDDEN], s[: 2 * HIDDEN], out=g)
        squash(g)
        np.multiply(g[HIDDEN:], s[2 * HIDDEN :], out=c)
        c += x[t, 2 * HIDDEN :]
        c *= 2
        squash(c)  # tanh(x) is 2 * sigmoid(2 * x) - 1
        c *= 2
        c -= 1
        new = out[t]
        np.subtract(h, c, out=new)
        new *= g[:HIDDEN]
        new += c
        if mask is not None:
            np.copyto(new, h, where=~mask[t])
        h = new
    return out


def squash(x: np.ndarray) -> None:
    """The sigmoid, in place."""
    np.negative(x, out=x)
    with np.errstate(over="ignore"):
        np.exp(x, out=x)
    x += 1
    np.reciprocal(x, out=x)


def fast_logits(p: dict[str, np.ndarray], inputs: np.ndarray, at: np.ndarray) -> np.ndarray:
    at = at.T
    x, real = np.ascontiguousarray(inputs[at].transpose(0, 2, 1)), at > 0
    mask = None if real.all() else real[:, None, :]
    one = last_states(x[:, : 3 * HIDDEN], mask, p["U0"])
    two = last_states(x[::-1, 3 * HIDDEN :], None if mask is None else mask[::-1], p["U1"])[::-1]
    a, v = (p[k].reshape(2, HIDDEN) for k in "av")
    e = np.einsum("h,thb->tb", a[0], one) + np.einsum("h,thb->tb", a[1], two)
    e = np.where(real, e, -1e9)
    w = np.exp(e - e.max(axis=0))
    w /= w.sum(axis=0)
    return v[0] @ np.einsum("tb,thb->hb", w, one) + v[1] @ np.einsum("tb,thb->hb", w, two) + p["c"][0]


def gru_back(dh_out: np.ndarray, mask: np.ndarray, u: np.ndarray, kept: list) -> tuple[np.ndarray, np.ndarray]:
    """Gradients of inputs and of ``u``."""
    steps, n, _ = dh_out.shape
    dx, du, dh = np.zeros((steps, n, 3 * HIDDEN), np.float32), np.zeros_like(u), np.zeros((n, HIDDEN), np.float32)
    for t in reversed(range(steps)):
        h, s, z, r, c = kept[t]
        dh = dh + dh_out[t]
        d = np.where(mask[t], dh, 0)
        dc = d * (1 - z) * (1 - c * c)
        dz = d * (h - c) * z * (1 - z)
        dr = dc * s[:, 2 * HIDDEN :] * r * (1 - r)
        dx[t] = np.concatenate([dz, dr, dc], axis=1)
        ds = np.concatenate([dz, dr, dc * r], axis=1)
        du += h.T @ ds
        dh = np.where(mask[t], d * z + ds @ u.T, dh)
    return dx, du


def logits(p: dict[str, np.ndarray], inputs: np.ndarray, at: np.ndarray, keep: dict | None = None) -> np.ndarray:
    """Of windows ``at`` (batch, time) of rows of ``inputs``; what gradients need goes to ``keep``."""
    if keep is None:
        return fast_logits(p, inputs, at)
    at = at.T
    x, mask = inputs[at], (at > 0)[:, :, None]
    kept: tuple[list, list] = ([], [])
    one = run_gru(x[:, :, : 3 * HIDDEN], mask, p["U0"], kept[0])
    two = run_gru(x[::-1, :, 3 * HIDDEN :], mask[::-1], p["U1"], kept[1])[::-1]
    h = np.concatenate([one, two], axis=2)
    e = np.where(mask[:, :, 0], h @ p["a"], -1e9)
    w = np.exp(e - e.max(axis=0))
    w /= w.sum(axis=0)
    pooled = np.einsum("tb,tbh->bh", w, h)
    keep |= {"mask": mask, "kept": kept, "h": h, "w": w, "pooled": pooled}
    return pooled @ p["v"] + p["c"][0]


def gradients(p: dict[str, np.ndarray], k: dict, d: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """Of the parameters above the inputs, and of the inputs (time, batch, 6 * hidden)."""
    g = {"v": d @ k["pooled"], "c": np.array([d.sum()], np.float32)}
    dp = d[:, None] * p["v"]
    dw = np.einsum("bh,tbh->tb", dp, k["h"])
    de = np.where(k["mask"][:, :, 0], k["w"] * (dw - (k["w"] * dw).sum(axis=0)), 0)
    g["a"] = np.einsum("tb,tbh->h", de, k["h"])
    dh = k["w"][:, :, None] * dp + de[:, :, None] * p["a"]
    x0, g["U0"] = gru_back(dh[:, :, :HIDDEN], k["mask"], p["U0"], k["kept"][0])
    x1, g["U1"] = gru_back(dh[::-1, :, HIDDEN:], k["mask"][::-1], p["U1"], k["kept"][1])
    return g, np.concatenate([x0, x1[::-1]], axis=2)


def windows(rows: np.ndarray) -> np.ndarray:
    """All windows (one at least), padded with 0."""
    n = 1 + max(0, -(-(len(rows) - WINDOW) // STRIDE))
    padded = np.zeros((n - 1) * STRIDE + WINDOW, np.int32)
    padded[: len(rows)] = rows
    return padded[np.arange(n)[:, None] * STRIDE + np.arange(WINDOW)]


class Adam:
    def __init__(self, p: dict[str, np.ndarray]):
        self.m = {k: np.zeros_like(x) for k, x in p.items()}
        self.s = {k: np.zeros_like(x) for k, x in p.items()}
        self.t = 0

    def step(self, p: dict[str, np.ndarray], g: dict[str, np.ndarray], rows: dict[str, np.ndarray]) -> None:
        """``rows``: of tables, the rows that have a gradient."""
        self.t += 1
        rate = RATE * np.sqrt(1 - 0.999**self.t) / (1 - 0.9**self.t)
        for k, x in g.items():
            at = rows.get(k, slice(None))
            if k in rows:
                x = np.where((at > 0)[:, None], x, 0)  # what isn't known stays zero
            self.m[k][at] = m = 0.9 * self.m[k][at] + 0.1 * x
            self.s[k][at] = s = 0.999 * self.s[k][at] + 0.001 * x * x
            p[k][at] -= (rate * m / (np.sqrt(s) + 1e-7)).astype(np.float32)


def vocabulary(keys: np.ndarray, docs: Iterable[np.ndarray]) -> np.ndarray:
    """Those of the sorted hashes ``keys`` that at least MIN_DOCS documents (numbers of keys) hold."""
    n = np.zeros(len(keys), np.int64)
    for d in docs:
        n[np.unique(d)] += 1
    return keys[n >= MIN_DOCS]


def log_odds(docs: Iterable[np.ndarray], toxic: np.ndarray, rows: int) -> np.ndarray:
    """By row, from the documents that hold it; rows of few documents stay near 0."""
    n = np.zeros((2, rows))
    for d, t in zip(docs, toxic, strict=True):
        n[int(t), np.unique(d)] += 1
    share = toxic.mean()  # two documents' worth of doubt
    odds = np.log((n[1] + 2 * share) / toxic.sum()) - np.log((n[0] + 2 * (1 - share)) / (~toxic).sum())
    odds *= n.sum(axis=0) / (n.sum(axis=0) + 4)
    odds[0] = 0
    return odds


def train(texts: list[str], toxic: np.ndarray, seed: int = 7) -> Model:
    rng = np.random.default_rng(seed)
    toxic = np.asarray(toxic, bool)
    if not len(texts) or toxic.all() or not toxic.any():
        return Model(fresh(rng) | {k: np.empty(0, np.uint64) for k in ("word_keys", "gram_keys")}, fitted=False)
    vocab: dict[str, int] = {}
    rows = [np.array([vocab.setdefault(w, len(vocab) + 1) for w in words(t)], np.int32) for t in texts]
    word_hash, gram_hash, n_grams = by_word(list(vocab))
    g_start = np.concatenate([[0], np.cumsum(n_grams)])
    held = rng.random(len(texts)) < 0.2  # for the division of the classes
    if not (toxic[~held].any() and (~toxic[~held]).any() and toxic[held].any() and (~toxic[held]).any()):
        held[:] = False
    fit = np.flatnonzero(~held)
    own = [np.unique(rows[i]) - 1 for i in fit]
    grams_of = lambda h: (np.concatenate([h[:0], *(h[g_start[w] : g_start[w + 1]] for w in o)]) for o in own)
    words_, word_at = np.unique(word_hash, return_inverse=True)
    grams, gram_at = np.unique(gram_hash, return_inverse=True)
    del gram_hash
    keys = {"word_keys": vocabulary(words_, (word_at[o] for o in own)), "gram_keys": vocabulary(grams, grams_of(gram_at))}
    word_slot, gram = place(words_, keys["word_keys"])[word_at], place(grams, keys["gram_keys"]).astype(np.int32)[gram_at]
    del gram_at
    p = fresh(rng, len(keys["word_keys"]), len(keys["gram_keys"]))
    p["words"][:, 0] = log_odds([word_slot[o] for o in own], toxic[fit], len(p["words"]))
    p["chars"][:, 0] = log_odds(grams_of(gram), toxic[fit], len(p["chars"]))
    p["words"][0] = p["chars"][0] = 0

    def inputs() -> np.ndarray:
        chars = np.zeros((len(vocab), DIM), np.float32)
        for i in range(0, len(vocab), HASHED):
            has = i + np.flatnonzero(n_grams[i : i + HASHED])
            if len(has):
                some = p["chars"][gram[g_start[has[0]] : g_start[has[-1] + 1]]]
                chars[has] = np.add.reduceat(some, g_start[has] - g_start[has[0]]) / n_grams[has, None]
        return np.concatenate([np.zeros((1, 2 * DIM), np.float32), np.concatenate([p["words"][word_slot], chars], axis=1)])

    cuts = [windows(r) for r in rows]
    at = np.concatenate(cuts)
    first = np.cumsum([0, *map(len, cuts)])

    def scores(x: np.ndarray) -> np.ndarray:
        proj = x @ p["W"] + p["b"]
        return np.concatenate([logits(p, proj, at[i : i + BLOCK]) for i in range(0, len(at), BLOCK)])

    weight = np.where(toxic, 0.5 / toxic[fit].mean(), 0.5 / (1 - toxic[fit].mean())).astype(np.float32)
    adam = Adam(p)
    epochs = max(EPOCHS, min(40, 12_000 // len(fit)))
    for epoch in range(epochs):
        if epoch % max(1, epochs // EPOCHS) == 0:
            s = scores(inputs())
            best = np.array([first[i] + int(np.argmax(s[first[i] : first[i + 1]])) for i in range(len(rows))])
        for ids in np.array_split(rng.permutation(fit), max(1, len(fit) // BATCH)):
            w = at[best[ids]]
            used, local = np.unique(w, return_inverse=True)
            local = local.reshape(w.shape)
            if used[0] != 0:
                used, local = np.concatenate([[0], used]), local + 1
            real = used[1:] - 1
            spans = [np.arange(g_start[r], g_start[r + 1]) for r in real]
            flat = np.concatenate(spans).astype(np.int64) if spans else np.empty(0, np.int64)
            counts = n_grams[real]
            owner = np.repeat(np.arange(len(real)), counts)
            x = np.zeros((len(used), 2 * DIM), np.float32)
            x[1:, :DIM] = p["words"][word_slot[real]]
            np.add.at(x[1:, DIM:], owner, p["chars"][gram[flat]] / counts[owner, None])
            keep: dict = {}
            out = logits(p, x @ p["W"] + p["b"], local, keep)
            d = ((sigmoid(out) - toxic[ids]) * weight[ids] / len(ids)).astype(np.float32)
            g, dx = gradients(p, keep, d)
            per = np.zeros((len(used), 6 * HIDDEN), np.float32)
            np.add.at(per, local.T.ravel(), dx.reshape(-1, 6 * HIDDEN))
            per[0] = 0
            g["W"], g["b"] = x.T @ per, per.sum(axis=0)
            back = (per @ p["W"].T)[1:]
            tables = {}
            for name, slot, grad in (("words", word_slot[real], back[:, :DIM]), ("chars", gram[flat], back[owner, DIM:] / counts[owner, None])):
                tables[name], where = np.unique(slot, return_inverse=True)
                g[name] = np.zeros((len(tables[name]), DIM), np.float32)
                np.add.at(g[name], where, grad)
            adam.step(p, g, tables)
    s = scores(inputs())
    top = np.array([s[first[i] : first[i + 1]].max() for i in range(len(rows))])
    judged = held if held.any() else ~held
    return Model(p | keys, shift=division(top[judged], toxic[judged]))


def division(score: np.ndarray, toxic: np.ndarray) -> float:
    """The middle of the gap between scores that divides the classes with the highest F1."""
    by = np.argsort(-score)
    s, t = score[by], toxic[by]
    f1 = 2 * np.cumsum(t) / (np.arange(1, len(t) + 1) + t.sum())
    f1[:-1][s[:-1] == s[1:]] = -1  # no division between equal scores
    k = int(np.argmax(f1))
    return float((s[k] + s[k + 1]) / 2 if k + 1 < len(s) else s[k] - 1)


def drawn(docs: DataFrame, labels: DataFrame, bound: int = SAMPLE, chars: int = SAMPLE_CHARS) -> DataFrame:
    """``doc_id, text, toxic`` of at most ``bound`` documents of each class with ``chars`` characters, those whose ids hash lowest; none that is held out."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out("doc_id")).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    picked = [known.where(F.col("toxic") == c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(bound) for c in (0, 1)]
    ids = picked[0].unionByName(picked[1])
    text = F.coalesce("text", F.lit(""))
    # at most 2 * bound short ids, and as many rows
    sizes = docs.select("doc_id", F.length(text).alias("n")).join(F.broadcast(ids), "doc_id").groupBy("toxic", F.xxhash64("doc_id").alias("h"), "doc_id").agg(F.max("n").alias("n")).collect()
    left, taken = {}, []
    for toxic, _, i, n in sorted(sizes):
        if n <= left.setdefault(toxic, chars):
            left[toxic] -= n
            taken.append((i, toxic))
    ids = docs.sparkSession.createDataFrame(taken, "doc_id long, toxic int")
    return docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id").groupBy("doc_id", "toxic").agg(F.min(text).alias("text")).select("doc_id", "text", "toxic")


def sample(docs: DataFrame, labels: DataFrame, bound: int = SAMPLE, chars: int = SAMPLE_CHARS) -> tuple[list[str], np.ndarray]:
    """What is drawn, in the order of the ids: texts, and whether they are toxic."""
    got = sorted(drawn(docs, labels, bound, chars).collect())
    return [r[1] for r in got], np.array([r[2] == 1 for r in got], bool)


def trained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The model of rows ``doc_id, text, toxic``, as a row."""
    got = sorted(row for b in batches for row in zip(*(c.to_pylist() for c in b.columns), strict=True))
    texts, toxic = [r[1] for r in got], np.array([r[2] == 1 for r in got], bool)
    del got
    m = train(texts, toxic)
    yield pa.record_batch({"model": pa.array([pickle.dumps((m.p, m.shift, m.fitted))], pa.binary())})


def fit(docs: DataFrame, labels: DataFrame) -> tuple[dict[str, np.ndarray], float, bool]:
    """A model's parameters, its shift, and whether it is fitted. The sample is bounded, so one task holds it."""
    # no row where Spark sees beforehand that nothing is drawn
    for row in drawn(docs, labels).repartition(1).mapInArrow(trained, "model binary").collect():
        return pickle.loads(row["model"])
    m = train([], np.empty(0, bool))
    return m.p, m.shift, m.fitted


def held_out(doc_id: str):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def scored(docs: DataFrame, labels: DataFrame, with_text: bool = True, name: str = "score") -> DataFrame:
    """``docs`` with a score; its columns stay, the text too if asked."""
    spark = docs.sparkSession
    common.tune(spark)
    place = docs.columns.index("text")
    sent = spark.sparkContext.broadcast(fit(docs, labels))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p, shift, fitted = sent.value
        m = Model(p, shift, fitted)
        for batch in batches:
            best = np.full(batch.num_rows, -np.inf)
            texts, whose, n = [], [], 0

            def settle() -> None:
                """Score the windows of the texts held."""
                rows = m.rows([w for t in texts for w in t])
                ends = np.cumsum([len(t) for t in texts])
                cuts = [windows(r) for r in np.split(rows, ends[:-1])]
                at, who = np.concatenate(cuts), np.repeat(whose, [len(c) for c in cuts])
                for j in range(0, len(at), BLOCK):
                    np.maximum.at(best, who[j : j + BLOCK], logits(p, m.inputs, at[j : j + BLOCK]))

            for i, text in enumerate(batch.column(place) if fitted else ()):
                texts.append(words(text.as_py() or ""))
                whose.append(i)
                n += max(1, len(texts[-1]))
                if n >= BLOCK * STRIDE:
                    settle()
                    texts, whose, n = [], [], 0
            if texts:
                settle()
            s = sigmoid(np.clip(best - shift + np.log(AT / (1 - AT)), -60, 60)) if fitted else np.zeros(len(best))
            keep = [i for i, n in enumerate(batch.schema.names) if n != "text" or with_text]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in keep), pa.array(s.astype(np.float64))], [*(batch.schema.names[i] for i in keep), name])

    schema = T.StructType([f for f in docs.schema if f.name != "text" or with_text]).add(name, "double")
    return docs.mapInArrow(run, schema)


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every document."""
    found = scored(common.documents(docs), labels, with_text=False)
    return found.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= AT).cast("int").alias("predicted"))


def without_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that aren't predicted toxic; all columns stay.

    The text rides along with its score, so nothing is joined or shuffled.
    """
    name = common.unused(docs, "score")
    return scored(docs, labels, name=name).where(F.col(name) < AT).drop(name)
