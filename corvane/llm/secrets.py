"""Secret scans with corpus-wide ownership frequency, with DataFrame functions only.

Each text yields the base spans (assignments, access keys, hex strings) and wider candidates (long
mixed tokens). Every value's hash is counted over the corpus by distinct repositories and owners: a
value is a widely copied example if more than a few owners and more than a few repositories hold it. What
stays with an owner or two (in however many of their repositories), or within a repository or two (whoever
shares those), looks live. A wider candidate becomes a span only where it looks live; base spans always stay.

Positions come from two aligned lists, the matches and the pieces between them; ends are prefix sums
of their lengths. Only spans leave the scan, so no text is shuffled.

Defined results: a null text is empty and has no spans; a null owner or repository is one of its own;
rows of one doc_id are told apart by a hash of their text, those of the same text share its spans and
their owners all count; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.llm import common
from corvane.llm.common import let

#: Kind, pattern, the group whose length counts, its least length.
BASE = (
    ("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    ("access", r"AKIA[A-Z0-9]+", 0, 18),
    ("hex", r"[0-9a-f]{16,}", 0, 16),
)
#: What else may be a credential: tokens with an issuer's prefix, and long runs of token characters
#: with a digit and letters of both cases.
WIDER = (
    "token",
    r"(?<![A-Za-z0-9+/_-])(?:(?:gh[pousr]_|glpat-|xox[abprs]-|sk_live_|npm_|sk-)[A-Za-z0-9_-]{17,}|(?=[A-Za-z+/_-]*[0-9])(?=[A-Z0-9+/_-]*[a-z])(?=[a-z0-9+/_-]*[A-Z])[A-Za-z0-9+/_-]{20,})",
    0,
    20,
)
#: A cheap test that every text with a match passes.
HINTS = {"assign": r"(?i)(?:pass|secret|token|api_?key)", "access": "AKIA", "hex": r"[0-9a-f]{16}", "token": r"[A-Za-z0-9+/_-]{20}"}
ORDER = {"assign": 0, "access": 1, "hex": 2, "token": 3}
#: Owners up to which a value looks like its owners' own, and repositories up to which it isn't spread.
LIVE_OWNERS, LIVE_REPOS = 2, 2
BLOCK = 128
SPAN = "struct<start:int,end:int,kind:int,value:string>"


def prefix_sums(x: Column) -> Column:
    """Running sums of an array of ints, by blocks: a long array costs little more than its length."""
    total = lambda a: F.aggregate(a, F.lit(0), lambda s, v: s + v)

    def by_blocks(blocks: Column) -> Column:
        sums = F.transform(blocks, total)

        def run(s: Column) -> Column:
            within = lambda b, i: let(total(F.slice(s, F.lit(1), i)), lambda base: F.transform(b, lambda _, j: base + total(F.slice(b, F.lit(1), j + 1))))
            return F.flatten(F.transform(blocks, within))

        return let(sums, run)

    def cut(x: Column) -> Column:
        starts = F.sequence(F.lit(0), F.floor((F.size(x) - 1) / BLOCK).cast("int"))
        return F.when(F.size(x) > 0, let(F.transform(starts, lambda b: F.slice(x, b * BLOCK + 1, F.lit(BLOCK))), by_blocks)).otherwise(F.array().cast("array<int>"))

    return let(x, cut)


def hinted(text: Column, kind: str) -> Column:
    return F.contains(text, F.lit(HINTS[kind])) if kind == "access" else text.rlike(HINTS[kind])


def found(text: Column, kind: str, pattern: str, group: int, least: int) -> Column:
    """Spans of one kind; leftmost matches that don't overlap, the short ones dropped."""
    re = F.lit(pattern)

    def spans(m: Column) -> Column:
        lengths = F.zip_with(F.slice(F.split(text, pattern, -1), F.lit(1), F.size(m)), m, lambda p, v: F.length(p) + F.length(v))
        value = F.regexp_extract_all(text, re, F.lit(group)) if group else m
        rows = F.zip_with(F.arrays_zip(m.alias("m"), value.alias("v")), prefix_sums(lengths), lambda z, e: F.struct((e - F.length(z["m"])).alias("start"), e.alias("end"), F.lit(ORDER[kind]).alias("kind"), z["v"].alias("value")))
        return F.filter(rows, lambda r: F.length(r["value"]) >= least)

    return F.when(hinted(text, kind), let(F.regexp_extract_all(text, re, F.lit(0)), spans)).otherwise(F.array().cast(f"array<{SPAN}>")).cast(f"array<{SPAN}>")


def scanned(docs: DataFrame, owner: Column, repo: Column) -> DataFrame:
    """``doc_id, version, owner, repo, base, wider``: spans by document, without texts."""
    text = F.coalesce(F.col("text"), F.lit(""))
    base = F.concat(*(found(F.col("t"), *b) for b in BASE))
    x = docs.select("doc_id", F.coalesce(owner.cast("string"), F.lit("")).alias("owner"), F.coalesce(repo.cast("string"), F.lit("")).alias("repo"), text.alias("t"))
    return x.select("doc_id", F.xxhash64("t").alias("version"), "owner", "repo", base.alias("base"), found(F.col("t"), *WIDER).alias("wider"))


def judged(scan: DataFrame) -> DataFrame:
    """Each span with ``live``, and ``owners, repos`` of its value (null where it is rare and its owners' own)."""
    spans = scan.select("doc_id", "version", "owner", "repo", F.explode(F.concat("base", "wider")).alias("s")).select("doc_id", "version", "owner", "repo", "s", F.sha2("s.value", 256).alias("hash"))
    held = spans.groupBy("hash", "owner", "repo").agg(F.count("*").alias("n"))  # however often an owner repeats a value
    spread = held.groupBy("hash").agg(F.countDistinct("owner").alias("owners"), F.countDistinct("repo").alias("repos"), F.sum("n").alias("n"))
    shared = common.cut(spread.where((F.col("owners") > LIVE_OWNERS) & (F.col("repos") > LIVE_REPOS) | (F.col("n") >= common.HOT_ROWS)))
    total = shared.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    # an example that everyone copied is one value: it goes to the tasks, its spans don't all go to one
    marked = common.join_hot(spans, shared, "hash", "n", total, "left")
    few = lambda c, most: F.coalesce(c, F.lit(0)) <= most
    return marked.select("doc_id", "version", "s", "hash", "owners", "repos", (few("owners", LIVE_OWNERS) | few("repos", LIVE_REPOS)).alias("live"))


def label(kind: Column) -> Column:
    return F.element_at(F.array(*(F.lit(k) for k in ORDER)), kind + 1)


def joined(spans: Column) -> Column:
    """kind:start:end by start, then kind, joined by commas."""
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", label(s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def scan(docs: DataFrame, owner: Column | None = None, repo: Column | None = None) -> DataFrame:
    """``doc_id, version, base, added, n_live, n_example`` (arrays of spans; a hash of the text) of every document."""
    owner, repo = (F.col("source") if owner is None else owner), (F.col("doc_id") if repo is None else repo)
    scan_ = common.cut(scanned(docs, owner, repo))
    flagged = judged(scan_).groupBy("doc_id", "version").agg(
        F.collect_set(F.when((F.col("s.kind") == ORDER["token"]) & F.col("live"), F.struct("s.start", "s.kind", "s.end", "s.value"))).alias("added"),
        F.collect_set(F.struct("s", "live")).alias("spans"),
    )
    ordered = lambda a: F.transform(a, lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"), s["value"].alias("value")))
    base = scan_.select("doc_id", "version", ordered(F.col("base")).alias("base"))
    out = base.join(flagged, base["doc_id"].eqNullSafe(flagged["doc_id"]) & (base["version"] == flagged["version"]), "left")
    apart = lambda s: ~F.exists(F.col("base"), lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"]))
    none = F.array().cast("array<struct<start:int,kind:int,end:int,value:string>>")
    n = lambda live: F.coalesce(F.size(F.filter("spans", lambda x: x["live"] == live)), F.lit(0)).cast("long")
    return out.select(base["doc_id"], base["version"], "base", F.filter(F.coalesce("added", none), apart).alias("added"), n(True).alias("n_live"), n(False).alias("n_example"))


def digests(found_: DataFrame) -> DataFrame:
    n = lambda k: F.size(F.filter("base", lambda s: s["kind"] == ORDER[k])).cast("long").alias(f"n_{k}")
    return found_.select("doc_id", n("assign"), n("access"), n("hex"), F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(F.concat("base", "added")).alias("spans"), "n_live", "n_example")


def redacted(text: Column, live: Column, kind: str, pattern: str, group: int, least: int) -> Column:
    """The text with the values of one kind replaced; of tokens only those among ``live``."""

    def mark(m: Column, v: Column) -> Column:
        goes = F.length(v) >= least
        if kind == "token":
            goes &= F.array_contains(live, v)
        # a value ends its match
        return F.when(goes, F.concat(F.substring(m, F.lit(1), F.length(m) - F.length(v)), F.lit("[SECRET]"))).otherwise(m)

    def rebuilt(pieces: Column) -> Column:
        m = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
        v = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else m
        return F.array_join(F.zip_with(pieces, F.zip_with(m, v, mark), lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")

    return F.when(hinted(text, kind), let(F.split(text, pattern, -1), rebuilt)).otherwise(text)


def redact(docs: DataFrame, owner: Column | None = None) -> DataFrame:
    """``docs`` with secrets replaced in ``text``; other columns stay. Null texts stay null."""
    key, version, tokens, n = (common.unused(docs, c) for c in ("_key", "_version", "_tokens", "_n"))
    live = scan(docs, owner).select(F.col("doc_id").alias(key), F.col("version").alias(version), F.transform("added", lambda s: s["value"]).alias(tokens), (F.size("base") + F.size("added")).alias(n))
    live = live.where(F.col(n) > 0).groupBy(key, version).agg(F.flatten(F.collect_set(tokens)).alias(tokens))
    same = F.xxhash64(F.coalesce("text", F.lit(""))) == F.col(version)
    x = docs.join(live, docs["doc_id"].eqNullSafe(F.col(key)) & same, "left")
    for kind in (*BASE, WIDER):  # each over the column the last one made
        x = x.withColumn("text", F.when(F.col(tokens).isNotNull(), redacted(F.col("text"), F.col(tokens), *kind)).otherwise(F.col("text")))
    return x.select(*docs.columns)
