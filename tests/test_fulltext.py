"""Stems of the published algorithm, and searches against a scan of all texts."""

from __future__ import annotations

import random
import re

import pytest

from corvane.functions import fulltext
from corvane.functions.stemmer import stem, stem_word, stems_sql

#: Examples of the paper, step by step.
STEMS = """caresses:caress ponies:poni ties:ti cats:cat feed:feed agreed:agre plastered:plaster bled:bled motoring:motor sing:sing conflated:conflat troubled:troubl sized:size hopping:hop
tanned:tan falling:fall hissing:hiss fizzed:fizz failing:fail filing:file happy:happi sky:sky relational:relat conditional:condit rational:ration valenci:valenc hesitanci:hesit
digitizer:digit conformabli:conform radicalli:radic differentli:differ vileli:vile analogousli:analog vietnamization:vietnam predication:predic operator:oper feudalism:feudal
decisiveness:decis hopefulness:hope callousness:callous formaliti:formal sensitiviti:sensit sensibiliti:sensibl triplicate:triplic formative:form formalize:formal
electriciti:electr electrical:electr hopeful:hope goodness:good revival:reviv allowance:allow inference:infer airliner:airlin gyroscopic:gyroscop adjustable:adjust
defensible:defens irritant:irrit replacement:replac adjustment:adjust dependent:depend adoption:adopt homologou:homolog communism:commun activate:activ angulariti:angular
homologous:homolog effective:effect bowdlerize:bowdler probate:probat rate:rate cease:ceas controll:control roll:roll by:by yes:ye youth:youth ééing:ééing a1ing:a1ing"""


def test_stems(spark):
    pairs = [p.split(":") for p in STEMS.split()]
    df = spark.createDataFrame(pairs, "word string, want string")
    assert [tuple(r) for r in df.withColumn("stem", stem(df["word"])).where("stem <> want").collect()] == []
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    con.execute("CREATE TABLE w AS SELECT unnest(" + str([w for w, _ in pairs]) + ") AS word")
    assert dict(con.sql(stems_sql("w")).fetchall()) == dict(pairs)


def test_searches(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(fulltext, "BLOCK", 16)
    r = random.Random(4)
    # a word in every text, one stem with several forms, stop words that keep their places
    word = lambda: r.choice(["run", "running", "runs", "the", "of", "cat", "dog", "été", "hopping", "x"])
    texts = [" ".join(["common"] + [word() for _ in range(r.randint(0, 9))]) for _ in range(150)] + [None, "", "the of", "Common-RUNNING,cat", "cat cat cat"]
    rows = [(i * 3 if i < 140 else 7, t) for i, t in enumerate(texts)]
    index = fulltext.FullText.build(spark.createDataFrame(rows, "id long, text string"), "id", "text", str(tmp_path / "i"), file_rows=4)
    of = {"running": "run", "runs": "run", "hopping": "hop"}
    lists = [(i, [None if w in fulltext.STOPS else of.get(w, w) for w in re.split(r"[\W_]+", (t or "").lower())]) for i, t in rows]
    among = lambda ws, *stems: all(s in ws for s in stems)
    follows = lambda ws, *stems: any(all(s is None or i + k < len(ws) and ws[i + k] == s for k, s in enumerate(stems)) for i in range(len(ws)))
    every, phrase = fulltext.every, fulltext.phrase
    asks = [
        (every("runs", "Cat"), lambda ws: among(ws, "run", "cat"), ("run", "cat")),
        (every("common"), lambda ws: among(ws, "common"), ("common",)),
        (every("the", "hopping"), lambda ws: among(ws, "hop"), ("hop",)),
        (every("absent", "cat"), lambda ws: False, ()),
        (phrase("running cat"), lambda ws: follows(ws, "run", "cat"), ("run", "cat")),
        (phrase("cat cat"), lambda ws: follows(ws, "cat", "cat"), ("cat",)),
        (phrase("dog of the été"), lambda ws: follows(ws, "dog", None, None, "été"), ("dog", "été")),
        (every("dog") | phrase("x x"), lambda ws: among(ws, "dog") or follows(ws, "x", "x"), ("dog", "x")),
        (every("cat") & every("dog") - every("runs"), lambda ws: among(ws, "cat", "dog") and "run" not in ws, ("cat", "dog", "run")),
        (every("the"), lambda ws: False, ()),
    ]
    for ask, ok, stems in asks:
        want = sorted((i, sum(ws.count(s) for s in stems)) for i, ws in lists if ok(ws))
        assert sorted(tuple(x) for x in index.search(ask).collect()) == want, ask
    # a common word is cut into blocks; a search opens the files of its own words
    assert index.lists(["common"]).count() == 10
    whole = spark.read.parquet(str(tmp_path / "i" / "lists"))
    assert len(whole.inputFiles()) > 5
    assert whole.groupBy("term", "block").count().where("count > 1").isEmpty()


def test_empty(spark, tmp_path):
    index = fulltext.FullText.build(spark.createDataFrame([], "id long, text string"), "id", "text", str(tmp_path / "i"))
    assert index.search(fulltext.every("cat")).collect() == []


def test_stems_of_words():
    pairs = [p.split(":") for p in STEMS.split()]
    assert [(w, stem_word(w)) for w, _ in pairs] == [tuple(p) for p in pairs]


def test_texts_are_not_shuffled(spark, tmp_path):
    """An index shuffles what it lists, not the texts: those of which nothing is a word cost nothing."""
    docs = spark.range(400).selectExpr("id", "array_join(transform(sequence(1, 2000), i -> md5(concat(id, '-', i))), '') AS text").selectExpr("id", "concat(translate(text, '0123456789abcdef', '!#$%&()*+,-./:;<'), ' cat') AS text")
    before = shuffled(spark)
    index = fulltext.FullText.build(docs, "id", "text", str(tmp_path / "i"))
    assert shuffled(spark) - before < 1_000_000
    assert index.search(fulltext.every("cats")).count() == 400


def shuffled(spark):
    """Bytes that all stages of the session wrote for others."""
    sc = spark.sparkContext
    stages = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), sc._jvm.java.util.ArrayList())
    return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))
