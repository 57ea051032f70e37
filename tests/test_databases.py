"""Many databases as one source."""

from __future__ import annotations

import json
import os

import pytest
from pyspark.errors import PySparkException

from corvane.operators import predicate as P
from corvane.sources import databases


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    out = str(tmp_path_factory.mktemp("dbs"))
    rows = [(f"t{i % 4}", i, i / 2, None if i % 5 == 0 else f"n{i}") for i in range(40)] + [("it's/a", 100, 1.0, "x"), (None, 7, 0.0, "lost")]
    assert databases.write(spark.createDataFrame(rows, "tenant string, id long, x double, name string"), out, "ta\"b", "tenant") == 5
    return out, rows


def got(df):
    return sorted(map(tuple, df.collect()))


def test_rows_and_filters(spark, folder):
    where, rows = folder
    read = lambda p=None: databases.rows(spark, "ta\"b", p, folder=where)
    assert read().columns == ["tenant_id", "id", "x", "name"]
    kept = sorted(r for r in rows if r[0] is not None)
    assert got(read()) == kept
    c = P.compare
    asks = [
        (c("tenant_id", "=", "t1"), lambda r: r[0] == "t1"),
        (P.And(P.in_array("tenant_id", ["t1", "none"]), c("id", ">", 20)), lambda r: r[0] == "t1" and r[1] > 20),
        (P.Or(c("id", "<=", 3), P.Raw("name IS NULL")), lambda r: r[1] <= 3 or r[3] is None),
        (c("tenant_id", "=", "it's/a"), lambda r: r[0] == "it's/a"),
        (P.And(c("x", ">=", 4.5), c("x", "<", 6), c("name", "=", "n9"), c("id", "!=", 4)), lambda r: 4.5 <= r[2] < 6 and r[3] == "n9"),
        (P.And(c("tenant_id", "=", "t1"), c("tenant_id", "=", "t2")), lambda r: False),
    ]
    for p, ok in asks:
        assert got(read(p)) == [r for r in kept if ok(r)], p
    df = read()  # one frame under several filters
    assert got(df.where("tenant_id = 't1' AND id > 20")) == [r for r in kept if r[0] == "t1" and r[1] > 20]
    assert got(df.where("id <= 3 OR name IS NULL")) == [r for r in kept if r[1] <= 3 or r[3] is None]


def test_other_tenants_are_not_opened(spark, folder, tmp_path):
    where, rows = folder
    files = databases.tenants({"folder": where})
    (tmp_path / "bad.db").write_text("no database")
    registry = json.dumps({"t1": files["t1"], "t2": str(tmp_path / "bad.db")})
    one = databases.rows(spark, "ta\"b", P.compare("tenant_id", "=", "t1"), registry=registry)
    assert one.count() == 10
    assert one.rdd.getNumPartitions() == 1
    with pytest.raises(PySparkException, match="not a database"):
        databases.rows(spark, "ta\"b", registry=registry).count()


def test_unknown_tenants(spark, folder):
    where, _ = folder
    none = P.compare("tenant_id", "=", "none")
    assert databases.rows(spark, "ta\"b", none, folder=where).collect() == []
    with pytest.raises(PySparkException, match="unknown tenants: none"):
        databases.rows(spark, "ta\"b", none, folder=where, assign="unknown").collect()
    with pytest.raises(PySparkException, match="no database has"):
        databases.rows(spark, "absent", folder=where)
    wider = databases.rows(spark, "ta\"b", P.compare("tenant_id", "=", "t3"), "name string, more long, tenant_id string", folder=where)
    assert wider.where("more IS NULL").count() == 10
    assert not [f for f in os.listdir(where) if f.endswith(".part")]
