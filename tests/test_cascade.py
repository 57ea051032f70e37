"""Keys that cascade, against row by row deletion."""

from __future__ import annotations

import random

import pytest

from corvane.operators import cascade
from corvane.operators.cascade import Entity, Refused, delete, update
from corvane.sources.schema import ForeignKey


def entity(spark, rows, *keys, defaults=None):
    return Entity(spark.createDataFrame(rows, "id long, up long, other long"), ("id",), keys, defaults or {})


def fk(name, column, table, action, on_update="NO_ACTION"):
    return ForeignKey(name, (column,), table, ("id",), action, on_update)


def got(df):
    return sorted(tuple(r) for r in df.collect())


def test_cycles_and_chains(spark):
    r = random.Random(2)
    # two tables that refer to each other, and one to itself: cycles, chains, references to nothing
    a = [(i, r.choice([None, r.randrange(40)]), r.randrange(30)) for i in range(30)]
    b = [(i, r.randrange(45), None) for i in range(30)]
    es = {"a": entity(spark, a, fk("aa", "up", "a", "CASCADE"), fk("ab", "other", "b", "NO_ACTION")), "b": entity(spark, b, fk("ba", "up", "a", "CASCADE"))}
    gone_a, gone_b = {3, 11}, {4}
    while True:
        n = len(gone_a) + len(gone_b)
        gone_a |= {i for i, up, _ in a if up in gone_a}
        gone_b |= {i for i, up, _ in b if up in gone_a}
        if n == len(gone_a) + len(gone_b):
            break
    out = delete(es, {"a": es["a"].rows.where("id IN (3, 11)"), "b": es["b"].rows.where("id = 4")})
    assert {i for (i,) in got(out.deleted["a"])} == gone_a
    assert {i for (i,) in got(out.deleted["b"])} == gone_b
    assert got(out.refused.selectExpr("constraint", "key")) == sorted(("ab", f'{{"id":{i}}}') for i, _, o in a if i not in gone_a and o in gone_b)


def test_ring_goes_whole(spark):
    ring = [(i, (i + 1) % 7, None) for i in range(7)] + [(9, 9, None), (10, None, None)]
    es = {"t": entity(spark, ring, fk("next", "up", "t", "CASCADE"))}
    assert got(delete(es, {"t": es["t"].rows.where("id = 5")}).result()["t"]) == [(9, 9, None), (10, None, None)]
    assert got(delete(es, {"t": es["t"].rows.where("id IN (9, 77)")}).result()["t"].select("id")) == [(i,) for i in (*range(7), 10)]
    assert len(got(delete(es, {"t": es["t"].rows.limit(0)}).result()["t"])) == 9


def test_actions(spark):
    parent = entity(spark, [(1, None, None), (2, None, None), (3, None, None)])
    child = lambda action, **kw: {"p": parent, "c": entity(spark, [(10, 1, 0), (11, 2, 0), (12, None, 0), (13, 8, 0)], fk("k", "up", "p", action), **kw)}
    ask = {"p": parent.rows.where("id = 1")}
    assert got(delete(child("SET_NULL"), ask).result()["c"].select("id", "up"))[0] == (10, None)
    assert got(delete(child("SET_DEFAULT", defaults={"up": "3"}), ask).result()["c"].select("id", "up"))[0] == (10, 3)
    assert got(delete(child("SET_DEFAULT"), ask).result()["c"].select("id", "up"))[0] == (10, None)
    with pytest.raises(Refused):  # the default goes too, or isn't there
        delete(child("SET_DEFAULT", defaults={"up": "1"}), ask).result()
    with pytest.raises(Refused):
        delete(child("SET_DEFAULT", defaults={"up": "77"}), ask).result()
    for action in ("RESTRICT", "NO_ACTION"):
        with pytest.raises(Refused, match="k: c"):
            delete(child(action), ask).result()
        assert len(got(delete(child(action), {"p": parent.rows.where("id = 3")}).result()["p"])) == 2
    # a row that goes too still refuses under RESTRICT
    both = {**ask, "c": child("RESTRICT")["c"].rows.where("id = 10")}
    assert delete(child("RESTRICT"), both).refused.count() == 1
    assert [i for (i,) in got(delete(child("NO_ACTION"), both).result()["c"].select("id"))] == [11, 12, 13]


def test_changed_keys_travel(spark):
    top = Entity(spark.createDataFrame([(1,), (2,)], "a long"), ("a",))
    mid = Entity(spark.createDataFrame([(1, 5), (2, 5)], "a long, b long"), ("a", "b"), (ForeignKey("m", ("a",), "top", ("a",), on_update="CASCADE"),))
    low = Entity(spark.createDataFrame([(7, 1, 5), (8, 2, 5), (9, None, 5)], "id long, x long, y long"), ("id",), (ForeignKey("l", ("x", "y"), "mid", ("a", "b"), on_update="CASCADE"),))
    out = update({"top": top, "mid": mid, "low": low}, {"top": spark.createDataFrame([(1, 100)], "a long, new_a long")}).result()
    assert got(out["top"]) == [(2,), (100,)]
    assert got(out["mid"]) == [(2, 5), (100, 5)]
    assert sorted(map(tuple, out["low"].collect()), key=repr) == sorted([(7, 100, 5), (8, 2, 5), (9, None, 5)], key=repr)
    nulled = update({"top": top, "mid": Entity(mid.rows.withColumn("k", mid.rows["b"] * 2 + mid.rows["a"]), ("k",), (ForeignKey("m", ("a",), "top", ("a",), on_update="SET_NULL"),))}, {"top": spark.createDataFrame([(1, 100)], "a long, new_a long")})
    assert sorted(r["a"] for r in nulled.result()["mid"].where("a is not null").collect()) == [2]
    with pytest.raises(Refused):
        update({"top": top, "mid": Entity(mid.rows, ("b",), (ForeignKey("m", ("a",), "top", ("a",)),))}, {"top": spark.createDataFrame([(1, 100)], "a long, new_a long")}).result()


def test_plans_of_turns_stay_small(spark):
    """What is known of a turn's keys isn't carried on into the plans of the next ones, where it would double."""
    rows = spark.range(1, 800).selectExpr("id", "CASE WHEN id > 0 THEN floor(id / 3) END AS up")
    es = {"t": Entity(rows, ("id",), (fk("up", "up", "t", "CASCADE"),))}
    out = delete(es, {"t": rows.where("id % 97 = 5")})
    gone = {i for i in range(1, 800) if i % 97 == 5}
    while more := {i for i in range(1, 800) if i // 3 in gone} - gone:
        gone |= more
    assert {i for (i,) in got(out.deleted["t"])} == gone
    assert len(out.deleted["t"]._jdf.queryExecution().optimizedPlan().constraints().toString()) < 1000


def test_keys_of_large_tables_are_dealt_out(spark, tmp_path, monkeypatch):
    """As many tasks make keys distinct as the table's size asks for, and none gathers those of its split before."""
    monkeypatch.setattr(cascade, "PART", 2000)
    spark.range(3000).selectExpr("id", "CASE WHEN id > 0 THEN id - 1 - id % 1000 END AS up", "id % 7 AS other").repartition(3).write.parquet(str(tmp_path / "t"))
    rows = spark.read.parquet(str(tmp_path / "t"))
    assert cascade.once(rows.select("other"), rows).count() == 7
    plan = cascade.once(rows.select("id"), rows)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "REPARTITION_BY_NUM" in plan
    out = delete({"t": Entity(rows, ("id",), (fk("up", "up", "t", "CASCADE"),))}, {"t": rows.where("id = 999")})
    assert {i for (i,) in got(out.deleted["t"])} == {999, *range(1000, 3000)}
