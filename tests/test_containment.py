"""Containment through the index, against the rule of containment itself."""

from __future__ import annotations

import json
import random

from pyspark.sql import functions as F

from corvane.functions import containment
from corvane.functions.containment import JsonIndex, contains, parsed


def holds(d, q, top=True):
    if isinstance(q, dict):
        return isinstance(d, dict) and all(k in d and holds(d[k], x, False) for k, x in q.items())
    if isinstance(q, list):
        return isinstance(d, list) and all(any(holds(e, x, False) for e in d) for x in q)
    same = type(d) is not dict and type(d) is not list and isinstance(d, bool) == isinstance(q, bool) and (d is None) == (q is None) and isinstance(d, str) == isinstance(q, str) and d == q
    return same or top and isinstance(d, list) and any(holds(e, q, False) for e in d)


def value(r, depth=0):
    kind = r.random()
    if depth < 3 and kind < 0.35:
        return {r.choice(["a", "b", "it's \"q\".x", ""]): value(r, depth + 1) for _ in range(r.randint(0, 3))}
    if depth < 3 and kind < 0.6:
        return [value(r, depth + 1) for _ in range(r.randint(0, 3))]
    return r.choice([None, True, False, 0, 1, 1.0, 1.5, -2, "a", "1", "", "true", 10**17 + 1, 10**17, 1e-30, 1e300])


def test_index_against_the_rule(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(containment, "BLOCK", 32)
    r = random.Random(9)
    texts = [json.dumps(value(r)) for _ in range(300)] + [None, "no json", "", "[]", "{}", '{"a": {"b": [1, {"a": null}]}}', '{"a": {"b": [1, {"a": null}]}}']
    rows = [(i % 290, t) for i, t in enumerate(texts)]
    index = JsonIndex.build(spark.createDataFrame(rows, "id long, data string"), "id", "data", str(tmp_path / "i"))
    docs = []
    for i, t in rows:
        try:
            docs.append((i, json.loads(t)))
        except (TypeError, ValueError):
            continue
    asks = [value(r) for _ in range(3)] + [{}, {"a": []}, 1, "a", None, [1, 1.0], {"a": {"b": [{"a": None}]}}, {"it's \"q\".x": 1}]
    v = F.try_parse_json("data")
    found = 0
    for q in asks:
        text = json.dumps(q)
        want = sorted(i for i, d in docs if holds(d, q))
        assert sorted(x["id"] for x in index.search(text).select("id").collect()) == want, text
        near = index.candidates(text)
        if near is not None:
            assert near.count() >= len(want)
            found += len(want)
    assert found > 50
    assert spark.createDataFrame([('{"a": 1}',)], "data string").select(contains(v, parsed('{"a": 1.0}'))).first()[0]
    # a long list of one leaf is cut into blocks
    lists = spark.read.parquet(str(tmp_path / "i" / "lists"))
    assert lists.groupBy("leaf").count().agg(F.max("count")).first()[0] > 3
    assert lists.agg(F.max(F.size("docs"))).first()[0] <= 32


def test_no_documents(spark, tmp_path):
    index = JsonIndex.build(spark.createDataFrame([], "id long, data string"), "id", "data", str(tmp_path / "i"))
    assert index.search('{"a": 1}').collect() == []
    assert index.search("{}").collect() == []


def test_documents_are_not_shuffled(spark, tmp_path):
    """An index shuffles hashes of leaves, not the documents."""

    def shuffled():
        sc = spark.sparkContext
        stages = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), sc._jvm.java.util.ArrayList())
        return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))

    docs = spark.range(300).selectExpr("id", """concat('{"a": 1, "b": "', array_join(transform(sequence(1, 1000), i -> md5(concat(id, '-', i))), ''), '"}') AS data""")
    before = shuffled()
    index = JsonIndex.build(docs, "id", "data", str(tmp_path / "i"))
    assert shuffled() - before < 1_000_000
    assert index.search('{"a": 1}').select("id").count() == 300
