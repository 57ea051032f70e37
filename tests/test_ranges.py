"""Splits and merges rewrite what they touch, and can be run again."""

from __future__ import annotations

import pytest

from corvane.operators.ranges import RangeTable
from corvane.sources import schema


@pytest.fixture
def table(spark):
    schema.reset_schema(spark, "ranges_test")
    t = RangeTable.create(spark, "ranges_test.t", "k BIGINT, s STRING", "k", [10, 20, 30])
    t.insert(spark.createDataFrame([(i, f"v{i}") for i in range(0, 40, 3)] + [(None, "null")], "k long, s string"))
    yield t
    schema.drop_schema(spark, "ranges_test")


def by_range(t):
    return [sorted((r["k"] for r in t.rows([x]).collect()), key=lambda k: -1 if k is None else k) for x in t.ranges()]


def files(spark, t):
    return {f for f in spark.table(t.table).inputFiles()}


def test_split_and_merge(spark, table):
    assert by_range(table) == [[None, 0, 3, 6, 9], [12, 15, 18], [21, 24, 27], [30, 33, 36, 39]]
    before = files(spark, table)
    table.split(25)
    assert by_range(table) == [[None, 0, 3, 6, 9], [12, 15, 18], [21, 24], [27], [30, 33, 36, 39]]
    # three partitions weren't touched
    kept = {f for f in before if any(f"{r.name}" in f for r in table.ranges())}
    assert kept < before
    assert kept < files(spark, table)
    table.merge(10)
    assert by_range(table) == [[None, 0, 3, 6, 9, 12, 15, 18], [21, 24], [27], [30, 33, 36, 39]]
    table.split(-5)
    table.split(5000)
    assert by_range(table)[0] == [None]
    assert by_range(table)[-1] == []
    for at in (25, 30):
        table.merge(at)
    table.split(25)
    assert sorted(r["k"] for r in table.rows().where("k is not null").collect()) == list(range(0, 40, 3))
    with pytest.raises(ValueError, match="is there"):
        table.split(20)
    with pytest.raises(ValueError, match="no bound"):
        table.merge(21)
    scan = table.rows([table.ranges()[1]])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in scan


@pytest.mark.parametrize("dies", ["_keep", "recover"])
def test_restart(spark, table, monkeypatch, dies):
    whole = sorted(map(repr, table.rows().collect()))
    old, n = getattr(RangeTable, dies), 0

    def gone(self, *args):
        nonlocal n
        n += 1
        if dies == "recover" and n == 1:  # the first of a change cleans up before it
            return old(self)
        raise OSError("gone")

    monkeypatch.setattr(RangeTable, dies, gone)
    with pytest.raises(OSError, match="gone"):
        table.split(25)
    # before the bounds changed readers see the old rows, after it the new ones; never twice
    assert sorted(map(repr, table.rows().collect())) == whole
    monkeypatch.undo()
    if dies == "_keep":
        table.split(25)
    table.merge(25)
    assert sorted(map(repr, table.rows().collect())) == whole
    assert set(table.partitions()) <= {r.name for r in table.ranges()}


def test_bounds_of_text(spark):
    schema.reset_schema(spark, "ranges_text")
    try:
        t = RangeTable.create(spark, "ranges_text.t", "s STRING", "s", ["it's \\ ${x}", "b"])
        t.insert(spark.createDataFrame([("a",), ("b",), ("it's",), ("z",)], "s string"))
        assert [sorted(r["s"] for r in t.rows([x]).collect()) for x in t.ranges()] == [["a"], ["b", "it's"], ["z"]]
    finally:
        schema.drop_schema(spark, "ranges_text")
