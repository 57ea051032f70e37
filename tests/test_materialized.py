"""A view refreshed by changes against the view computed anew."""

from __future__ import annotations

import os
import random

import pytest

from corvane.operators.materialized import Stored
from corvane.sources import schema

KIND = "k string, g long, x double, y long"


def test_changes(spark, tmp_path):
    r = random.Random(6)
    row = lambda: (r.choice(["a", "b", None, "c", "d"]), r.randrange(4), r.choice([None, r.randrange(50) / 4]), r.choice([None, r.randrange(9)]))
    rows = [row() for _ in range(60)]
    frame = lambda x: spark.createDataFrame(x, KIND)
    view = Stored(spark, str(tmp_path / "v"), ("k", "g"), ("x", "y"), ("x", "y"), buckets=5).create(frame(rows))
    for batch in range(1, 5):
        gone = r.sample(rows, 12) if batch < 4 else list(rows)
        for x in gone:
            rows.remove(x)
        new = [row() for _ in range(9)] if batch != 2 else []
        rows += new
        view.refresh(batch, frame(new) if new else None, frame(gone), frame(rows))
        fresh = Stored(spark, str(tmp_path / f"f{batch}"), ("k", "g"), ("x", "y"), ("x", "y"), buckets=5).create(frame(rows))
        assert sorted(map(repr, view.read().collect())) == sorted(map(repr, fresh.read().collect())), batch
    with pytest.raises(ValueError, match="more rows"):
        view.refresh(9, None, frame([("zz", 1, None, None)]), frame(rows))


def test_cost_and_restart(spark, tmp_path, monkeypatch):
    base = spark.range(1000).selectExpr("id AS k", "CAST(id AS double) AS x")
    view = Stored(spark, str(tmp_path / "v"), ("k",), ("x",), buckets=20).create(base)
    stamp = lambda: {b: sorted(f for f in os.listdir(tmp_path / "v" / b) if f.endswith("parquet")) for b in os.listdir(tmp_path / "v") if b.startswith("bucket")}
    before = stamp()
    new = spark.createDataFrame([(5, 1.5), (2000, 2.0)], "k long, x double")
    written = view.refresh(1, new, None, base.unionByName(new))
    after = stamp()
    # only the buckets touched were written
    assert {int(b.split("=")[1]) for b in after if after[b] != before.get(b)} == set(written)
    assert len(written) <= 2
    # given again, also where it died after one of its buckets, nothing counts twice
    assert view.refresh(1, new, None, base.unionByName(new)) == []
    more = spark.createDataFrame([(k, 1.0) for k in range(8)], "k long, x double")
    write = Stored._write

    def dies(self, df, mode):  # after the first of its buckets
        write(self, df.where(df["bucket"] == df.agg({"bucket": "min"}).first()[0]), mode)
        raise OSError("gone")

    monkeypatch.setattr(Stored, "_write", dies)
    with pytest.raises(OSError, match="gone"):
        view.refresh(2, more, None, base)
    monkeypatch.undo()
    view.refresh(2, more, None, base)
    got = {r["k"]: (r["n"], float(r["sum_x"])) for r in view.read().where("k < 9 or k = 2000").collect()}
    assert got == {k: (2 + (k == 5), k + 1.0 + 1.5 * (k == 5)) for k in range(8)} | {8: (1, 8.0), 2000: (1, 2.0)}


def test_refresh_after_a_crash(spark):
    schema.reset_schema(spark, "mv_crash")
    try:
        name = "mv_crash.v"
        schema.refresh_materialized(spark, "mv_crash", "v", "SELECT 1 AS a")
        spark.sql("CREATE TABLE mv_crash.v__new USING parquet AS SELECT 7 AS a")  # died before the swap
        schema.refresh_materialized(spark, "mv_crash", "v", "SELECT 2 AS a")
        assert [r["a"] for r in spark.table(name).collect()] == [2]
        spark.sql("ALTER TABLE mv_crash.v RENAME TO mv_crash.v__old")  # died within it
        schema.recover(spark, schema.Table("mv_crash", "v"))
        assert [r["a"] for r in spark.table(name).collect()] == [2]
        schema.refresh_materialized(spark, "mv_crash", "v", "SELECT 3 AS a")
        assert [r["a"] for r in spark.table(name).collect()] == [3]
        assert [t.name for t in spark.catalog.listTables("mv_crash")] == ["v"]
    finally:
        schema.drop_schema(spark, "mv_crash")
