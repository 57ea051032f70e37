"""Merkle fingerprints of documents, with DataFrame functions only.

A fingerprint is a tree in one string. Its leaves are pieces of some ten to forty characters, cut where
the content says so (after a mark, after certain letters before a space, after some of the characters
of scripts without spaces), so an edit moves no border elsewhere. Paragraphs are lines; a section ends
after a paragraph whose SHA-256 ends in 0, 4, 8 or c. A section's node is the hash of its paragraphs'
nodes, the root the hash of the sections'. Roots test equality. Where they differ, the sections that
differ are opened, then their paragraphs that differ, then their pieces: what has no partner on the
other side is the edit, and the characters of the rest are the likeness, by Dice's coefficient. All of
it takes two fingerprints and no text.

    root (64 hex digits) ; characters without line feeds ; paragraphs, joined by commas
    paragraph: pieces (12 hex digits each) joined by dashes, a colon, the last digit of its SHA-256
    piece: 40 bits of its hash, 8 bits of its length less one

Defined results: a null text is empty, one empty paragraph; equal texts have equal fingerprints and a
likeness of 1; texts without a character in common have 0; what repeats is paired as often as both
have it. In ``with_next`` null ids come last, in the order of a hash of their texts, as do the rows of
one id; a single document is followed by itself; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.llm.common import let

#: Characters of a piece at most. What has no such border for as long is cut after one of ``RARE`` that follows at
#: least ``LEAST`` characters, so there too an edit moves no border elsewhere; without any it is cut evenly.
PIECE, LEAST, RARE = 256, 16, "7cQqZ+"


def ranges(first: int, end: int, step: int, width: int) -> str:
    return "".join(f"\\u{c:04x}-\\u{c + width - 1:04x}" for c in range(first, end, step))


#: Before a space: letters of Latin, and an eighth of those of other scripts with spaces. Anywhere: marks,
#: a sixteenth of Han and Hangul, some Kana and Thai vowels. What is asked first spares the long classes.
BEFORE_SPACE = "gnGN" + ranges(0x380, 0xE00, 64, 8)
MARKS = "\u061b\u061f\u06d4\u0964\u3001\u3002\uff01\uff0c\uff1a\uff1b\uff1f"
ANYWHERE = MARKS + "\u0e40-\u0e44" + ranges(0x3040, 0x3100, 16, 1) + ranges(0x4E00, 0xA000, 256, 16) + ranges(0xAC00, 0xD7A0, 256, 16)
PIECE_END = rf"(?<=[.;:!?])|(?<= )(?<=[{BEFORE_SPACE}] )|(?<=[\u0600-\uffff])(?<=[{ANYWHERE}])"
SECTION_END = "(?<=[048c]),"
#: Quantiles of the ids that order is split by, and documents of a bucket within one.
QUANTILES, BUCKET_ROWS = 200, 512


def pieces(paragraph: Column) -> Column:
    """A paragraph's pieces, as digits."""
    # Spark keeps this expression compiled from row to row, which it doesn't for split
    one = rf"(?s).{{1,{PIECE}}}?(?:{PIECE_END}|\z)|.{{{LEAST},{PIECE}}}?(?<=[{RARE}])|.{{{PIECE}}}"
    parts = F.when(paragraph == "", F.array().cast("array<string>")).otherwise(F.regexp_extract_all(paragraph, F.lit(one), F.lit(0)))
    bits = ((1 << 48) - 1) & ~(PIECE - 1)
    code = lambda p: F.lpad(F.hex(F.xxhash64(p).bitwiseAND(F.lit(bits)).bitwiseOR((F.length(p) - 1).cast("long"))), 12, "0")
    return F.array_join(F.transform(parts, code), "-")


def fingerprint(text: Column) -> Column:
    """The tree of a text, in a string."""
    paragraph = lambda p: F.concat(pieces(p), F.lit(":"), F.sha2(p, 256))

    def whole(nodes: Column) -> Column:
        root = F.sha2(F.array_join(F.transform(F.split(nodes, SECTION_END, -1), lambda s: F.sha2(s, 256)), ","), 256)
        n = F.length(F.translate(text, "\n", "")).cast("string")
        return F.concat_ws(";", root, n, F.regexp_replace(nodes, ":[0-9a-f]{63}", ":"))

    return let(F.array_join(F.transform(F.split(text, "\n", -1), paragraph), ","), whole)


def root(tree: Column) -> Column:
    return F.substring_index(tree, ";", 1)


def characters(tree: Column) -> Column:
    return F.substring_index(F.substring_index(tree, ";", 2), ";", -1).cast("long")


def sections(tree: Column) -> Column:
    return F.split(F.substring_index(tree, ";", -1), SECTION_END, -1)


def numbered(x: Column) -> Column:
    """The strings of an array made distinct: the second of a kind gets #2, and so on."""
    runs = F.regexp_extract_all(F.array_join(F.array_sort(x), "|"), F.lit(r"([^|]++)(?:\|\1(?=\||$))*+"), F.lit(0))

    def each(run: Column) -> Column:
        one = F.substring_index(run, "|", 1)
        n = ((F.length(run) + 1) / (F.length(one) + 1)).cast("int")
        return F.transform(F.sequence(F.lit(1), n), lambda k: F.when(k == 1, one).otherwise(F.concat(one, F.lit("#"), k.cast("string"))))

    return F.when(F.size(F.array_distinct(x)) == F.size(x), x).otherwise(F.flatten(F.transform(runs, each)))


def unpaired(df: DataFrame, a: str, b: str) -> DataFrame:
    """Replaces both arrays of strings by what has no partner in the other."""
    df = df.withColumns({a: numbered(F.col(a)), b: numbered(F.col(b))})
    plain = lambda x, y: F.transform(F.array_except(x, y), lambda s: F.substring_index(s, "#", 1))
    return df.withColumns({a: plain(a, b), b: plain(b, a)})


def differing(df: DataFrame, a: str, b: str, left: str, right: str) -> DataFrame:
    """Adds ``left`` and ``right``: the paragraphs of two fingerprints without a partner. Sections that are equal aren't opened."""
    same = root(F.col(a)) == root(F.col(b))
    none = F.array().cast("array<string>")
    df = unpaired(df.withColumns({left: F.when(same, none).otherwise(sections(F.col(a))), right: F.when(same, none).otherwise(sections(F.col(b)))}), left, right)
    opened = lambda x: F.flatten(F.transform(x, lambda s: F.split(s, ",")))
    return unpaired(df.withColumns({left: opened(left), right: opened(right)}), left, right)


def likeness(df: DataFrame, a: str, b: str, name: str) -> DataFrame:
    """Adds the likeness (0 to 1) of two columns of fingerprints."""
    left, right = f"{name}_left", f"{name}_right"
    inside = lambda x: F.filter(F.flatten(F.transform(x, lambda p: F.split(F.substring_index(p, ":", 1), "-"))), lambda p: p != "")
    df = differing(df, a, b, left, right)
    df = unpaired(df.withColumns({left: inside(left), right: inside(right)}), left, right)
    lost = F.aggregate(left, F.lit(0).cast("long"), lambda s, p: s + F.conv(F.substring(p, 11, 2), 16, 10).cast("long") + 1)
    total = characters(F.col(a)) + characters(F.col(b))
    like = F.when(root(F.col(a)) == root(F.col(b)), 1.0).when(total == 0, 0.0).otherwise(2.0 * (characters(F.col(a)) - lost) / total)
    return df.withColumn(name, like).drop(left, right)


def trees(docs: DataFrame, text: str = "text", name: str = "tree") -> DataFrame:
    """Adds the fingerprint of a text."""
    return docs.withColumn(name, fingerprint(F.coalesce(F.col(text), F.lit(""))))


def edits(a: DataFrame, b: DataFrame, key: str, tree: str = "tree") -> DataFrame:
    """Two versions of documents by their fingerprints: ``key, same, gone, new``, the numbers (from 0) of the paragraphs that one version alone has."""
    both = a.select(key, F.col(tree).alias("a")).join(b.select(key, F.col(tree).alias("b")), key)
    both = differing(both, "a", "b", "gone", "new")
    # of one kind, some of which have a partner, the last ones are taken as the odd ones
    at = lambda t, odd: F.filter(F.transform(F.split(F.substring_index(t, ";", -1), ","), lambda p, i: F.when(F.array_contains(odd, p), i)), lambda i: i.isNotNull())
    return both.select(key, (root(F.col("a")) == root(F.col("b"))).alias("same"), at("a", F.col("gone")).alias("gone"), at("b", F.col("new")).alias("new"))


def with_next(docs: DataFrame) -> DataFrame:
    """``doc_id, text, tree, next, next_tree`` of ``doc_id, text``: with fingerprints and the next document by descending id; the first follows the last.

    Order is kept without a task that sees all rows: ids fall into buckets of some hundred rows (by
    quantiles, evenly within one), each row looks ahead in its bucket, and a bucket's last row takes
    the head of the next occupied one. Only a figure or two per quantile reaches the driver.
    """
    got = docs.agg(F.count("*"), F.min("doc_id"), F.max("doc_id"), F.percentile_approx("doc_id", [i / QUANTILES for i in range(1, QUANTILES)], 10_000)).first()
    n, low, high, cuts = got[0], got[1] or 0, got[2] or 0, sorted(set(got[3] or []))
    lows = [low, *cuts]
    per = max(1, round(n / max(1, len(lows)) / BUCKET_ROWS))
    widths = [max(1, -(-(b - a) // per)) for a, b in zip(lows, [*cuts, high + 1], strict=True)]
    array = lambda xs: F.array(*(F.lit(x).cast("long") for x in xs)) if xs else F.array().cast("array<long>")
    q = F.when(F.col("doc_id").isNull(), -1).otherwise(F.size(F.filter(array(cuts), lambda c: c <= F.col("doc_id"))))
    keyed = docs.withColumn("q", q)
    at = F.col("q") + 1
    sub = F.when(F.col("q") < 0, F.pmod(F.xxhash64("text"), F.lit(64))).otherwise(F.floor((F.col("doc_id") - F.element_at(array([low, *lows]), at)) / F.element_at(array([1, *widths]), at)))
    keyed = keyed.withColumn("sub", F.coalesce(sub, F.lit(0)).cast("long"))

    ordered = Window.partitionBy("q", "sub").orderBy(F.col("doc_id").desc_nulls_last(), F.xxhash64("text"))
    # the trees are made behind the shuffle, once for each text and again for the heads
    rows = trees(keyed.select("doc_id", "text", "q", "sub").repartition("q", "sub"))
    rows = rows.select("doc_id", "text", "q", "sub", "tree", F.lead(F.struct("text", "tree")).over(ordered).alias("ahead"))
    first = trees(keyed.select("q", "sub", "text", F.row_number().over(ordered).alias("rn")).where("rn = 1"))

    # the occupied buckets, and for each the one whose last row its head follows
    taken = keyed.groupBy("q", "sub").agg(F.count("*").alias("size"))
    by_q = {r["q"]: (r["lo"], r["hi"]) for r in taken.groupBy("q").agg(F.min("sub").alias("lo"), F.max("sub").alias("hi")).collect()}
    order = sorted(by_q)
    above = {k: order[(i + 1) % len(order)] for i, k in enumerate(order)}  # the lowest quantile follows no other than the highest's turn
    links = [F.struct(F.lit(k).alias("q"), F.lit(above[k]).alias("pq"), F.lit(by_q[above[k]][0]).cast("long").alias("psub")) for k in order]
    turn = F.array(*links) if links else F.array().cast("array<struct<q:int,pq:int,psub:bigint>>")
    before = F.lag("sub").over(Window.partitionBy("q").orderBy(F.col("sub").desc()))
    here = F.element_at(F.filter(turn, lambda x: x["q"] == F.col("q")), 1)
    chain = taken.withColumn("before", before).select("q", "sub", F.when(F.col("before").isNull(), here["pq"]).otherwise(F.col("q")).alias("pq"), F.when(F.col("before").isNull(), here["psub"]).otherwise(F.col("before")).alias("psub"))
    heads = first.select("q", "sub", F.struct("text", "tree").alias("head")).join(chain, ["q", "sub"]).select(F.col("pq").alias("q"), F.col("psub").alias("sub"), "head")
    last = F.col("l.ahead").isNull()
    joined = rows.alias("l").join(heads.alias("h"), (F.col("l.q") == F.col("h.q")) & (F.col("l.sub") == F.col("h.sub")) & last, "left")
    found = joined.select("l.doc_id", "l.text", "l.tree", F.coalesce("l.ahead", "h.head").alias("n"))
    return found.select("doc_id", "text", "tree", F.col("n.text").alias("next"), F.col("n.tree").alias("next_tree"))


def edited(text: Column, follower: Column) -> Column:
    half = F.floor(F.length(text) / 2).cast("int")
    return F.concat(F.substring(text, F.lit(1), F.length(text) - half), F.substring(follower, F.lit(1), half))


def fingerprints(docs: DataFrame) -> DataFrame:
    """Of ``doc_id, text``: fingerprints of the text and its edited form, and the likenesses to that and to the next document."""
    x = with_next(docs.select("doc_id", "text")).withColumn("edited", edited(F.col("text"), F.col("next")))
    x = x.select("doc_id", F.length("text").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"), F.col("tree").alias("fingerprint"), fingerprint(F.col("edited")).alias("edited_fingerprint"), "next_tree")
    x = likeness(likeness(x, "fingerprint", "edited_fingerprint", "near_edited"), "fingerprint", "next_tree", "near_next")
    return x.drop("next_tree")
