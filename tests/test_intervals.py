"""Overlaps and folds against brute force."""

from __future__ import annotations

import random
from collections import Counter

import pytest

from corvane.functions import registry
from corvane.operators.intervals import overlaps, self_overlaps


def test_overlaps(spark):
    r = random.Random(3)

    def rows(n):
        out = []
        for i in range(n):
            a = r.randrange(-300, 300)
            out.append((i, r.choice(["x", "y"]), a, a + r.choice([0, -3, 1, 2, 3, 5, 8, 64, 65, 500, 10_000])))
        return out + [(n, "x", None, 5), (n + 1, "x", 5, None), (n + 2, "y", -(1 << 60), 1 << 60), *out[:4]]

    one, two = rows(80), rows(60)
    kind = "id long, k string, a long, b long"
    left, right = spark.createDataFrame(one, kind), spark.createDataFrame(two, kind)
    fine = lambda x: x[2] is not None and x[3] is not None and x[2] < x[3]
    want = Counter((x[0], y[0], x[1] == y[1]) for x in one for y in two if fine(x) and fine(y) and x[2] < y[3] and y[2] < x[3])
    got = overlaps(left, right, ("a", "b"), ("a", "b")).selectExpr("l.id", "r.id", "l.k = r.k").collect()
    assert Counter(map(tuple, got)) == want
    got = overlaps(left, right, ("a", "b"), ("a", "b"), ("k",)).selectExpr("l.id", "r.id", "true").collect()
    assert Counter(map(tuple, got)) == Counter({k: n for k, n in want.items() if k[2]})
    pairs = self_overlaps(left.dropDuplicates(["id"]), ("a", "b"), "id").count()
    assert pairs == sum(1 for x in one[:83] for y in one[:83] if fine(x) and fine(y) and x[0] < y[0] and x[2] < y[3] and y[2] < x[3])
    assert overlaps(left.limit(0), right, ("a", "b"), ("a", "b")).count() == 0
    times = spark.sql("SELECT id, CAST(TIMESTAMP '2024-01-01' + make_dt_interval(0, id) AS TIMESTAMP) AS a, TIMESTAMP '2024-01-01' + make_dt_interval(0, id + 2) AS b, CAST(id AS double) / 4 AS x, CAST(id AS double) / 4 + 0.3 AS y FROM range(10)")
    assert self_overlaps(times, ("a", "b"), "id").count() == 9
    assert self_overlaps(times, ("x", "y"), "id").count() == 9


def test_few_rows_of_a_value_take_no_grid(spark):
    """Values of few rows are compared as they are; crowded ones in grids; both give all pairs."""
    r = random.Random(4)
    rows = [(i, r.choice(["x"] * 6 + ["y", "z", None]), i % 2 if r.random() < 0.8 else None, a := r.randrange(99), a + r.choice([-1, 0, 1, 4, 30])) for i in range(120)]
    df = spark.createDataFrame(rows, "id long, k string, m int, a long, b long")
    for on, few in ((("k",), 20), (("k",), 500), (("k",), 0), (("k", "m"), 12)):
        key = lambda x: (x[1], x[2])[: len(on)]  # noqa: E731, B023
        want = Counter((x[0], y[0]) for x in rows for y in rows if x[4] > x[3] and y[4] > y[3] and x[3] < y[4] and y[3] < x[4] and None not in key(x) and key(x) == key(y))
        out = overlaps(df, df, ("a", "b"), ("a", "b"), on, few)
        assert Counter(map(tuple, out.selectExpr("l.id", "r.id").collect())) == want
        assert out.columns == ["l", "r"] and out.select("l.*").columns == df.columns
    plan = self_overlaps(df, ("a", "b"), "id", ("k",))._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan


def test_python_folds_in_parts(spark, monkeypatch):
    monkeypatch.setattr(registry, "MERGED_STATES", 2)
    rows = [(None if i % 50 == 0 else i % 3 == 0, float(i % 7), None if i % 11 == 0 else i) for i in range(2000)]
    df = spark.createDataFrame(rows, "k boolean, g double, x long").repartition(9)
    seen = registry.PythonFold("kinds", "array<long>", set(), lambda s, x: s | {-1 if x is None else x % 5}, sorted, lambda a, b: a | b)
    got = {(r["k"], r["g"]): r["kinds"] for r in seen.over(df, ["k", "g"], "x", "kinds").collect()}
    want = {}
    for k, g, x in rows:
        want.setdefault((k, g), set()).add(-1 if x is None else x % 5)
    assert got == {k: sorted(s) for k, s in want.items()}
    count = registry.PythonFold("n", "long", 0, lambda s, x: s + 1, None, lambda a, b: a + b)
    assert [tuple(r) for r in count.over(df.selectExpr("1 AS one", "x"), ["one"], "x", "n").collect()] == [(1, 2000)]
    assert count.over(df.limit(0), ["k"], "x", "n").collect() == []
    with pytest.raises(ValueError, match="no merge"):
        registry.PythonFold("n", "long", 0, lambda s, x: s + 1).over(df, ["k"], "x", "n")
