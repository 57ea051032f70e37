"""Runs of words, conversation tries and exact dedup, against brute force over awkward rows."""

from __future__ import annotations

import hashlib
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from corvane.llm import exact, queries, runs, trie

SCHEMA = "doc_id long, text string, lang string, key string, sha string, runs string"


def frame(spark, rows):
    """Documents with columns whose names the operators use too."""
    return spark.createDataFrame([(i, t, "en", "k", "s", "r") for i, t in rows], SCHEMA)


def runs_by_hand(words):
    found = {}
    for q in range(1, len(words) // 2 + 1):
        i = 0
        while i + q < len(words):
            s = i
            while i + q < len(words) and words[i] == words[i + q]:
                i += 1
            if i + q - s >= max(12, 2 * q):
                found.setdefault((s, i + q), q)
            i += i == s
    return sorted((s, q, e) for (s, e), q in found.items())


def test_runs(spark):
    r = random.Random(5)
    texts = [None, "", "  ", "a", "a " * 11, "a\t\na " * 6, "x " + "b c " * 9 + "y", "a b c d e f g h " * 2, "é 😀 " * 8, "a b a b a b a b a b a b c " * 3]
    for _ in range(150):
        n = r.choice([12, 13, 24, 40, 90])
        w = [r.choice("abc"[: r.randint(1, 3)] if r.random() < 0.5 else "abcdefghijklmn") for _ in range(n)]
        a, p = r.randrange(n), r.randint(1, 20)
        w = [w[a + (i - a) % p] if i >= a and a + (i - a) % p < n else w[i] for i in range(n)]
        texts.append(" ".join(w + w[: r.choice([0, 0, n // 3])]))
    texts += texts[6:8]
    rows = [(None if i == 3 else i % 150, t) for i, t in enumerate(texts)]
    got = runs.find(frame(spark, rows)).collect()
    want = []
    for i, t in rows:
        words = (t or "").encode().split()
        x = runs_by_hand(words)
        gone = {k for s, q, e in x for k in range(s + q, e)}
        want.append((i, len(words), [(s, e - s, q) for s, q, e in x], b" ".join(w for k, w in enumerate(words) if k not in gone).decode()))
    assert sorted(((g["doc_id"], g["n_words"], [tuple(x) for x in g["runs"]], g["collapsed"]) for g in got), key=repr) == sorted(want, key=repr)
    assert runs.find(frame(spark, [])).collect() == []


def test_very_long_text_of_runs():
    words = [b"w%d" % (i % 1500) for i in range(150_000)]
    assert runs.runs_of([words])[0].tolist() == [[0, 150_000, 1500]]
    assert runs.runs_of([[b"a"] * 300_000])[0].tolist() == [[0, 300_000, 1]]
    mixed = [b"%d" % i for i in range(50_000)]
    assert runs.runs_of([mixed + mixed + [b"x"] + mixed])[0].tolist() == [[0, 100_000, 50_000]]
    # Re-Pair halves what a pair repeats: a passage that stands twice is one tree, not a chain
    g = runs.Grammar([list(range(4096)) + [9999] + list(range(4096))], [0])
    assert int(g.size[g.size <= 4096].sum()) < 4096 * 16


def test_query_of_runs(spark):
    rows = {r["doc_id"]: r for r in queries.op11_periodic_runs(spark, "/root/testdata/sf0.001").collect()}
    some = 0
    for d in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect():
        w = (d["text"] or "").encode().split()
        h, n = zlib.crc32(str(d["doc_id"]).encode()), len(w)
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
        if n > 600 and h % 10:
            continue  # by hand only what is short, or was made to repeat
        x = runs_by_hand(w)
        some += len(x)
        r = rows[d["doc_id"]]
        best = min(((s - e, s, q) for s, q, e in x), default=None)
        assert (r["n_runs"], r["start"], r["length"], r["period"]) == (len(x), *((best[1], -best[0], best[2]) if best else (None,) * 3))
        assert r["exponent_milli"] == (1000 * -best[0] // best[2] if best else None)
        assert r["runs_sha256"] == hashlib.sha256("".join(f"{s},{e - s},{q}\n" for s, q, e in x).encode()).hexdigest()
        gone = {k for s, q, e in x for k in range(s + q, e)}
        assert r["collapsed_sha256"] == hashlib.sha256(b" ".join(v for k, v in enumerate(w) if k not in gone)).hexdigest()
    assert some > 10


def trie_by_hand(turns):
    """Nodes of the trie of ``{conv_id: [(role, text)]}``."""
    members = {}
    for c, t in turns.items():
        for d in range(len(t) + 1):
            members.setdefault(tuple(t[:d]), []).append(c)
    words = lambda n: len(re.findall(r"[^\x20\x09-\x0D]+", n[-1][1])) if n else 0
    out = []
    for n, m in members.items():
        below = [x for x in members if x[: len(n)] == n]
        kids = [x for x in below if len(x) == len(n) + 1]
        leaves = [x for x in below if not any(len(y) == len(x) + 1 and y[: len(x)] == x for y in below)]
        ends = ",".join(str(c) for c in sorted(c for c in m if len(turns[c]) == len(n)))
        saved = sum((len(members[x]) - 1) * words(x) for x in below)
        out.append((min(m), len(n), min(members[n[:-1]]) if n else None, len(m), len(kids), len(leaves), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("block", [1, 6, 1000])
def test_trie(spark, block):
    r = random.Random(block)
    said = [(r.choice(["user", None]), r.choice(["a b", "c", None, "", "d\te f"])) for _ in range(5)]
    rows, turns = [], {}
    for c in [*range(-3, 40), 1001, 77777777777]:
        # a third of them is one conversation; others share beginnings
        t = said[:3] if c % 3 == 0 else [r.choice(said) for _ in range(r.randint(0, 6))]
        turns[c] = [(a or "", b or "") for a, b in t]
        rows += [(c, None if k == 0 else k * 2, a, b, 1, "k") for k, (a, b) in enumerate(t)]
    rows += [(None, 1, "user", "x", 1, "k")]
    r.shuffle(rows)
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, words int, node string")
    turns = {c: t for c, t in turns.items() if t}
    got = sorted((tuple(x) for x in trie.trie(trie.sequences(df), block).collect()), key=repr)
    assert got == trie_by_hand(turns)
    h = lambda c: zlib.crc32(str(c).encode()) % 4
    built = {c: turns.get(c - (c % 20 if c >= 0 else -(-c % 20)), [])[: h(c)] + t[h(c) :] for c, t in turns.items()}
    c = F.col("conv_id")
    graft = trie.grafted(trie.sequences(df), c - c % 20, F.crc32(c.cast("string").cast("binary")) % 4, 3)
    assert sorted((tuple(x) for x in trie.trie(graft, block).collect()), key=repr) == trie_by_hand(built)


def test_trie_of_ties_and_nothing(spark):
    kind = "conv_id long, turn long, role string, text string"
    tied = spark.createDataFrame([(1, 0, "u", "b"), (1, 0, "u", "a"), (2, 0, "u", "a"), (2, 0, "u", "b"), (3, 0, "u", "a"), (3, 0, "u", "a")], kind)
    nodes = trie.trie(trie.sequences(tied)).collect()
    assert max(n["n_convs"] for n in nodes if n["depth"] == 2) == 2  # turns of one number have one order, repeated ones are two
    assert trie.trie(trie.sequences(spark.createDataFrame([], kind))).collect() == []


def normal(t):
    return re.sub(r"[\x20\x09-\x0D]+", " ", t or "")


@pytest.mark.parametrize("capacity", [1, 5, 1000])
def test_exact(spark, capacity):
    r = random.Random(capacity)
    texts = [r.choice(["a b", "a  b", "a\tb", "a b ", "", None, " ", "x"]) if r.random() < 0.5 else f"text {r.randrange(60)}" for _ in range(150)]
    rows = [(r.choice([i, i, i % 9, None]), t) for i, t in enumerate(texts)] + [(i + 1000, "hot copy") for i in range(400)]
    docs = frame(spark, rows)
    groups = {}
    for i, t in rows:
        groups.setdefault(normal(t), []).append(i)
    least = {t: min((i for i in ids if i is not None), default=None) for t, ids in groups.items()}
    want = [(i, least[normal(t)], len(groups[normal(t)]), i == least[normal(t)], hashlib.sha256(normal(t).encode()).hexdigest()) for i, t in rows]
    assert sorted(map(repr, map(tuple, exact.groups(docs, capacity).collect()))) == sorted(map(repr, want))
    kept = exact.dedup(docs, capacity)
    assert kept.columns == docs.columns
    assert sorted(map(repr, ((x["doc_id"], x["text"]) for x in kept.collect()))) == sorted(map(repr, ((i, t) for i, t in rows if i == least[normal(t)])))
    index = exact.build(docs, capacity=capacity)
    slots, entries = index.directory(spark).collect(), index.entries(spark).collect()
    depth = max(s["depth"] for s in slots)
    assert sorted(s["slot"] for s in slots) == list(range(2**depth))
    # a bucket of d bits has 2 ** (depth - d) slots, and holds what its bits say, no more than it may
    for s in slots:
        assert f"{s['slot']:0{depth}b}"[: s["depth"]] == s["bucket"] if depth else s["bucket"] == ""
    for e in entries:
        assert f"{e['key'] % 2**64:064b}".startswith(e["bucket"])
    sizes = {}
    for e in entries:
        sizes[e["bucket"]] = sizes.get(e["bucket"], 0) + 1
    assert max(sizes.values()) <= capacity
    assert len(entries) == len(groups)


def test_exact_chains_collisions(spark, monkeypatch):
    # every text has one of two keys: only the bytes tell them apart
    monkeypatch.setattr(exact, "keyed", lambda docs: docs.select("doc_id", exact.normal(F.col("text")).alias("normal")).withColumn("key", F.length("normal").cast("long") % 2))
    rows = [(i, f"t{i % 7}" + "x" * (i % 7)) for i in range(30)]
    index = exact.build(frame(spark, rows), capacity=1)
    chains = {}
    for e in index.entries(spark).collect():
        chains.setdefault(e["key"], []).append(e["chain"])
    assert {k: sorted(c) for k, c in chains.items()} == {0: [0, 1, 2, 3], 1: [0, 1, 2]}
    assert sorted((x["doc_id"], x["keep_id"]) for x in exact.look_up(exact.prints(frame(spark, rows)), index).collect()) == [(i, i % 7) for i in range(30)]


def test_exact_of_nothing(spark):
    assert exact.groups(frame(spark, [])).collect() == []
    assert exact.dedup(frame(spark, [])).collect() == []
    assert [tuple(r) for r in exact.build(frame(spark, [])).directory(spark).collect()] == [(0, "", 0)]
