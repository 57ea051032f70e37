"""Full-text index: stems, where they stand, and searches that read the lists of their own words only.

Texts are written once, where they lie, and numbered densely; a task gathers the places of each stem in its batches of
texts, and only these lists travel, once, to the range of their stem and block. A list of a stem is cut into blocks of ``BLOCK`` documents, so that a
word which all documents hold is many rows, none of them large. A row has the stem's places in its block,
sorted: the document within the block and the word's position. Rows are written in ranges of (stem,
block) with bloom filters, in Parquet's delta encoding, which is what compresses sorted numbers.

A search reads the rows of its stems (a pushed-down filter), brings a block's rows together and works on
sorted lists there: conjunctions intersect documents, phrases intersect places shifted by a word's
place in the phrase. ``hits``, the number of places of the search's stems, ranks what was found.

Defined results: a text is split where neither letters nor digits stand; stop words are dropped but keep
their places, in texts as in phrases, so a phrase matches whatever stop word stands between; a null text
has no words; documents are rows with an id of their own (rows that repeat an id are one by one found); a
search of stop words alone finds nothing.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.functions.stemmer import stem, stem_word
from corvane.operators.lineage import written
from corvane.operators.ordering import read_numbered, write_numbered
from corvane.sources.indexes import write_sorted
from corvane.sources.schema import Index

#: Documents of a block.
BLOCK = 4096
#: Places of a range of lists, which a task sorts.
RANGE_PLACES = 4_000_000
LISTS = "term string, block long, doc array<int>, at array<int>"
SPLIT = r"[^\p{L}\p{N}]+"
#: Words that English texts aren't searched for.
STOPS = (
    "i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself it its itself they them their theirs themselves what which who whom this that "
    "these those am is are was were be been being have has had having do does did doing a an the and but if or because as until while of at by for with about against between into through during "
    "before after above below to from up down in out on off over under again further then once here there when where why how all any both each few more most other some such no nor not only own "
    "same so than too very s t can will just don should now"
).split()


@dataclass(frozen=True)
class Search:
    """What a search asks for. ``terms`` are stems; ``found`` is the sorted array of a block's documents, given each stem's places."""

    kind: str
    words: tuple[str, ...] = ()
    parts: tuple[Search, ...] = ()

    def __and__(self, other: Search) -> Search:
        return Search("all", parts=(self, other))

    def __or__(self, other: Search) -> Search:
        return Search("any", parts=(self, other))

    def __sub__(self, other: Search) -> Search:
        """What this finds and the other doesn't."""
        return Search("without", parts=(self, other))

    def text(self) -> list[str]:
        return [*self.words, *(w for p in self.parts for w in p.text())]


def every(*words: str) -> Search:
    return Search("words", words)


def phrase(text: str) -> Search:
    return Search("phrase", tuple(text.split()))


def lists_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``term, block, doc, at``: by stem and block the places in a batch of ``block, doc, words``; stop words are left out."""
    for batch in batches:
        column = batch.column(2)
        size = pc.list_value_length(column).to_numpy(zero_copy_only=False).astype(np.int64)
        encoded = column.flatten().dictionary_encode()
        said = encoded.dictionary.to_pylist()
        numbers: dict[str, int] = {}
        stops = {"", *STOPS}
        of = np.array([-1 if w in stops else numbers.setdefault(stem_word(w), len(numbers)) for w in said], np.int64)
        row = np.repeat(np.arange(len(size)), size)
        at = np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)
        term = of[encoded.indices.to_numpy()] if len(said) else np.empty(0, np.int64)
        keep = np.flatnonzero(term >= 0)
        blocks, block = np.unique(batch.column(0).to_numpy(), return_inverse=True)
        key = term[keep] * len(blocks) + block[row[keep]]
        by = np.argsort(key, kind="stable")
        key, keep = key[by], keep[by]
        first = np.flatnonzero(np.diff(key, prepend=-1))
        ends = pa.array(np.append(first, len(key)).astype(np.int32))
        terms = pa.array(list(numbers), pa.string())
        listed = lambda x: pa.ListArray.from_arrays(ends, pa.array(x[keep].astype(np.int32)))  # noqa: B023, E731
        doc = batch.column(1).to_numpy()[row]
        yield pa.record_batch({"term": terms.take(pa.array(key[first] // max(1, len(blocks)))), "block": pa.array(blocks[key[first] % max(1, len(blocks))], pa.int64()), "doc": listed(doc), "at": listed(at)})


@dataclass(frozen=True)
class FullText:
    spark: SparkSession
    folder: str

    @classmethod
    def build(cls, docs: DataFrame, id_: str, text: str, folder: str, file_rows: int = 200_000) -> FullText:
        """An index over ``text`` of all rows, written under ``folder``."""
        spark = docs.sparkSession
        write_numbered(docs.select(F.col(id_).alias("id"), F.col(text).cast("string").alias("text")), f"{folder}/documents")
        words = F.split(F.lower(F.coalesce("text", F.lit(""))), SPLIT, -1)
        block, doc = F.floor(F.col("n") / BLOCK), (F.col("n") % BLOCK).cast("int")
        parts = read_numbered(spark, f"{folder}/documents").select(block.alias("block"), doc.alias("doc"), words.alias("words"))
        # written once: counted, sampled and sorted
        options = {"parquet.writer.version": "PARQUET_2_0", "compression": "zstd"}
        parts = spark.read.schema(LISTS).parquet(written(parts.mapInArrow(lists_of, LISTS), **options))
        n, places = parts.agg(F.count("*"), F.coalesce(F.sum(F.size("doc")), F.lit(0))).first()
        ranges = max(1, -(-n // file_rows), -(-places // RANGE_PLACES))
        place = F.zip_with("doc", "at", lambda d, a: F.shiftleft(d.cast("long"), 32) + a)
        # ranges of the key are what the grouping needs: nothing is dealt again
        lists = parts.select("term", "block", place.alias("places")).repartitionByRange(ranges, "term", "block")
        lists = lists.groupBy("term", "block").agg(F.sort_array(F.flatten(F.collect_list("places"))).alias("places"))
        part = lambda f, c: F.transform("places", lambda p: f(p).cast("int")).alias(c)
        lists = lists.select("term", "block", part(lambda p: F.shiftright(p, 32), "doc"), part(lambda p: p.bitwiseAND(F.lit((1 << 32) - 1)), "at"))
        write_sorted(lists, f"{folder}/lists", Index("terms", ("term", "block")), options=options)
        return cls(spark, folder)

    def stems(self, words: list[str]) -> dict[str, str | None]:
        """Of a search's words; None for a stop word."""
        x = self.spark.createDataFrame([(w, w.lower()) for w in dict.fromkeys(words)], "said string, word string")
        return {r["said"]: None if r["word"] in STOPS else r["stem"] for r in x.withColumn("stem", stem(F.col("word"))).collect()}

    def lists(self, terms: list[str]) -> DataFrame:
        x = self.spark.read.parquet(f"{self.folder}/lists")
        return x.where(F.col("term").isin(*terms)) if terms else x.limit(0)

    def search(self, ask: Search) -> DataFrame:
        """``id, hits`` of the documents found."""
        stems = self.stems(ask.text())
        terms = sorted({s for s in stems.values() if s is not None})
        held = lambda t: F.max(F.when(F.col("term") == t, F.col("places")))  # noqa: E731 (a term has one row in a block)
        rows = self.lists(terms).select("term", "block", F.arrays_zip("doc", "at").alias("places"))
        none = F.array().cast("array<struct<doc:int,at:int>>")
        blocks = rows.groupBy("block").agg(*(F.coalesce(held(t), none).alias(f"p{i}") for i, t in enumerate(terms))) if terms else rows.select("block")
        places = lambda w: F.col(f"p{terms.index(stems[w])}")
        docs = lambda p: F.array_distinct(F.transform(p, lambda x: x["doc"]))

        def back(n: int) -> Callable[[Column], Column]:
            return lambda x: F.struct(x["doc"].alias("doc"), (x["at"] - n).alias("at"))

        def found(s: Search) -> Column:
            nothing = F.array().cast("array<int>")
            known = [(i, w) for i, w in enumerate(s.words) if stems[w] is not None]
            if s.kind == "words":
                return reduce(F.array_intersect, (docs(places(w)) for _, w in known)) if known else nothing
            if s.kind == "phrase":
                shifted = [F.transform(places(w), back(i)) for i, w in known]
                return docs(reduce(F.array_intersect, shifted)) if shifted else nothing
            return reduce({"all": F.array_intersect, "any": F.array_union, "without": F.array_except}[s.kind], map(found, s.parts))

        if not terms:
            return read_numbered(self.spark, f"{self.folder}/documents").select("id", F.lit(0).cast("long").alias("hits")).limit(0)
        got = blocks.withColumn("found", found(ask)).where(F.size("found") > 0)
        hit = got.select("block", F.explode("found").alias("doc"))
        said = F.flatten(F.array(*(F.transform(f"p{i}", lambda x: x["doc"]) for i in range(len(terms)))))
        hits = got.select("block", F.explode(said).alias("doc")).groupBy("block", "doc").agg(F.count("*").alias("hits"))
        n = (F.col("block") * BLOCK + F.col("doc")).alias("n")
        return hit.join(hits, ["block", "doc"]).select(n, "hits").join(read_numbered(self.spark, f"{self.folder}/documents").select("n", "id"), "n").select("id", "hits")
