"""Indexes skip files and rows, and change no result."""

from __future__ import annotations

import enum
import random

import pytest

from corvane.operators import predicate as P
from corvane.operators.reader import Reader
from corvane.sources import indexes
from corvane.sources.schema import Index


def scanned(spark, df):
    """Rows that the scan of a plan gave on, after row groups were skipped."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        fresh = df.select("*")
        fresh.collect()
        leaves = fresh._jdf.queryExecution().executedPlan().collectLeaves()
        return sum(leaves.apply(i).metrics().apply("numOutputRows").value() for i in range(leaves.size()))
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def got(df):
    return sorted(map(repr, map(tuple, df.collect())))


@pytest.fixture(scope="module")
def ordered(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("lookup") / "t")
    rows = spark.range(20_000).selectExpr("id * 7 % 20011 AS id", "concat('d', id) AS data", "id % 50 AS kind")
    indexes.write_ordered(rows, folder, Index("pk", ("id",), unique=True), file_rows=2_500, group_bytes=1 << 12)
    return rows, indexes.Summaries(spark, folder, ("id",)).create()


def test_load_reads_one_file(spark, ordered):
    rows, kept = ordered
    assert len(kept.files()) == 8
    one = Reader.over(kept).load(1234)
    assert got(one) == got(Reader(rows).load(1234))
    assert len(one.inputFiles()) == 1
    many = Reader.over(kept).load_many([5, 6, 19_999, 500_000])
    assert got(many) == got(Reader(rows).load_many([5, 6, 19_999, 500_000]))
    assert len(many.inputFiles()) == 2
    absent = Reader.over(kept).load(500_000)
    assert got(absent) == []
    assert absent.inputFiles() == []


def test_bloom_filters_skip_row_groups(spark, tmp_path):
    # keys that the ranges of every row group hold, but no row: only a filter can tell
    rows = spark.range(0, 200_000, 2).selectExpr("id", "concat('data of ', id) AS data")
    indexes.write_ordered(rows, str(tmp_path / "t"), Index("pk", ("id",)), file_rows=1_000_000, group_bytes=1 << 16)
    x = spark.read.parquet(str(tmp_path / "t"))
    assert got(x.where("id = 77777")) == []
    assert scanned(spark, x.where("id = 77777")) == 0
    assert 0 < scanned(spark, x.where("id = 77776")) < 100_000


def test_unique(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a"), (1, "b"), (None, "a"), (None, "a"), (2, "a")], "id long, kind string")
    with pytest.raises(indexes.NotUnique, match="u: "):
        indexes.write_ordered(rows, str(tmp_path / "no"), Index("u", ("id",), unique=True))
    assert not (tmp_path / "no").exists()
    indexes.write_ordered(rows, str(tmp_path / "part"), Index("u", ("id",), unique=True, predicate="kind = 'a'"))
    assert got(spark.read.parquet(str(tmp_path / "part")).select("id")) == ['(1,)', '(2,)', '(None,)', '(None,)']
    indexes.write_ordered(rows, str(tmp_path / "covering"), Index("u", ("kind",), include=("id",)))
    assert spark.read.parquet(str(tmp_path / "covering")).columns == ["kind", "id"]


class Kind(enum.Enum):
    LOW, HIGH = 3, 90


def test_summaries_change_no_result(spark, tmp_path):
    r = random.Random(7)
    rows = [(i, r.choice([None, float("nan"), i / 10.0]), None if i < 40 else i % 100, f"s{i:03}") for i in range(300)]
    df = spark.createDataFrame(rows, "id long, x double, k long, s string")
    folder = str(tmp_path / "t")
    df.where("id < 200").repartitionByRange(10, "id").write.parquet(folder)
    kept = indexes.Summaries(spark, folder, ("id", "x", "k", "s")).create()
    df.where("id >= 200").repartitionByRange(5, "id").write.mode("append").parquet(folder)
    compare, n_all = P.compare, len(kept.files())
    asks = [
        (compare("id", "=", 15), True), (compare("id", "!=", 15), False), (compare("id", "<", 15), True), (compare("id", "<=", 0), True), (compare("id", ">", 290), True), (compare("id", ">=", 1000), True),
        (compare("x", ">", 1e9), False), (compare("k", "=", 5), True), (compare("s", "=", "s007"), True), (compare("s", "LIKE", "s1%"), False), (P.in_array("id", [1, 2, 250]), True), (P.in_array("id", []), True),
        (P.Comparison(P.Parameter(20), P.Ref("id"), ">"), True), (P.And(compare("id", ">", 30), compare("s", "<", "s050")), True), (P.Or(compare("id", "=", 3), compare("k", "=", 99)), False), (P.Not(compare("id", "<", 150)), False),
        (P.negated(compare("id", "<", 150)), True), (P.EnumIsOneOf((Kind.LOW, None), "k"), False), (P.EnumIsOneOf((Kind.LOW,), "k"), False), (P.FALSE, True), (P.TRUE, False), (None, False), (P.Raw("id % 2 = 0"), False), (compare("id", "=", None), False),
    ]
    for fresh in (False, True):
        for p, skips in asks:
            assert got(kept.rows(p)) == got(P.apply(df, p)), p
            if fresh and skips:
                assert len(kept.kept(p)) < n_all, p
        assert kept.refresh() == (0 if fresh else 5)
    assert kept.kept(compare("id", "=", 250)) == kept.kept(P.And(compare("id", "=", 250), compare("id", "<", 400)))
    assert len(kept.kept(compare("id", "=", 250))) == 1
    assert got(kept.rows(compare("id", "=", 250)).select("id")) == ["(250,)"]
