from __future__ import annotations

import datetime as dt
import random
from enum import Enum

import pytest
from pyspark.sql import functions as F

from corvane.functions import registry, scalar
from corvane.operators import batch, ordering, partition, reader, tenancy, writes
from corvane.operators import predicate as P
from corvane.operators.session import Session
from corvane.operators.writes import BulkMode, Mode, Op, Role
from corvane.streaming import events as ev


def ids(df, c="id"):
    return sorted(r[c] for r in df.collect())


# Predicates


def test_comparison_negates_and_swaps():
    c = P.compare("x", ">", 5)
    assert c.negate().to_sql() == "x <= 5" and c.to_sql() == "x > 5"
    assert c.swap().to_sql() == "5 < x"
    assert all(P.NEGATED[P.NEGATED[o]] == o and P.SWAPPED[P.SWAPPED[o]] == o for o in P.NEGATED)
    with pytest.raises(KeyError):
        P.compare("x", "LIKE", "a").negate()


def test_compounds_flatten_and_combine():
    a, b, c = (P.compare(x, "=", 1) for x in "abc")
    assert P.And(a, P.And(b, c)).items == (a, b, c)
    assert P.And(a, P.Or(b, c)).items == (a, P.Or(b, c))
    assert P.And().column() is None and P.And().to_sql() == ""
    assert P.combine_and(a) is a and P.combine_and(P.And(a), b) == P.And(a, b) and P.combine_and(P.Or(a, b), c).items == (P.Or(a, b), c)
    assert P.flatten(P.Or(a, b)) == (a, b) and P.flatten(a) == (a,)
    assert P.And(a, P.Not(P.And(b, P.TRUE))).contains(P.Always) and not P.And(a, b).contains(P.Always)
    assert P.negated(P.TRUE) == P.FALSE and P.negated(P.negated(P.And(a, b))) == P.And(a, b)
    assert (a & b) == P.And(a, b) and (a | b) == P.Or(a, b)


def test_literals_are_quoted():
    assert P.compare("x", "=", "it's").to_sql() == "x = ('it' || chr(39) || 's')"
    assert P.Raw("a = ? and b = ?", (1, None)).to_sql() == "a = 1 and b = NULL"
    assert P.Raw("a = :ab and b = :a", {"a": 1, "ab": 2}).to_sql() == "a = 2 and b = 1"
    with pytest.raises(ValueError):
        P.Raw("a = ?", ()).to_sql()
    assert P.literal(dt.date(2024, 1, 2)) == "DATE '2024-01-02'" and P.literal(True) == "true"


def test_membership_is_three_valued(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "id int, x string")
    subset = spark.createDataFrame([("a",)], "x string")
    with_null = spark.createDataFrame([("a",), (None,)], "x string")
    sub = lambda f: P.InSubQuery("x", f, "x")
    assert ids(P.apply(df, sub(subset))) == [1]
    assert ids(P.apply(df, P.Not(sub(subset)))) == [2]
    assert ids(P.apply(df, P.Not(sub(with_null)))) == []
    assert ids(P.apply(df, P.Or(sub(with_null), P.compare("id", "=", 3)))) == [1, 3]
    assert ids(P.apply(df, P.Not(sub(subset.limit(0))))) == [1, 2, 3]
    assert ids(P.apply(df, P.in_array("x", []))) == [] and ids(P.apply(df, None)) == [1, 2, 3]
    assert ids(P.apply(df, P.in_array("id", range(2, 5000)))) == [2, 3]
    assert ids(P.apply(df, P.Not(P.in_array("id", range(2, 5000))))) == [1]


def test_enums(spark):
    class Color(Enum):
        RED, BLUE = 1, 2

    df = spark.createDataFrame([(1, 1), (2, 2), (3, None)], "id int, c int")
    names = spark.createDataFrame([(1, "RED"), (2, "BLUE")], "id int, c string")
    assert ids(P.apply(df, P.EnumIsOneOf((Color.RED,), "c"))) == [1]
    assert ids(P.apply(df, P.EnumIsOneOf((Color.RED, None), "c"))) == [1, 3]
    assert ids(P.apply(df, P.EnumIsNotOneOf((Color.RED,), "c"))) == [2]
    assert ids(P.apply(names, P.EnumIsOneOf((Color.BLUE,), "c", as_text=True))) == [2]


def test_filters_reach_the_scan(spark, tmp_path):
    spark.range(10).withColumn("x", F.col("id") % 3).write.parquet(str(tmp_path / "t"))
    df = P.apply(spark.read.parquet(str(tmp_path / "t")), P.And(P.compare("x", "=", 1), P.compare("id", ">", 2)))
    plan = df.select("id")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(x,1)" in plan and "GreaterThan(id,2)" in plan


# Writes


def sequential(current, steps, op, mode):
    """What a server does, one statement at a time."""
    state, bad = dict(current), []
    for i, seq, data, expected, new, rev in sorted(steps, key=lambda s: s[1]):
        there = i in state
        v = state[i][1] if there else None
        ok = mode is Mode.OFF or there and (expected is not None and v == expected if mode is Mode.OPTIMISTIC else rev == 0 or v < rev)
        nv = None if mode is Mode.OFF else new if mode is Mode.OPTIMISTIC else rev or (v or 0) + 1
        if op is Op.INSERT and there:
            bad.append((i, seq, "exists"))
        elif op is Op.UPDATE and not there:
            bad.append((i, seq, "conflict" if mode is Mode.OPTIMISTIC else "missing"))
        elif op in (Op.UPDATE, Op.UPSERT) and there and not ok:
            bad.append((i, seq, "conflict"))
        else:
            state[i] = (data, nv)
    return state, bad


@pytest.mark.parametrize("mode", list(Mode))
@pytest.mark.parametrize("op", list(Op))
def test_writes_fold_like_statements(spark, op, mode):
    r = random.Random(f"{op}{mode}")
    version = {Mode.OFF: lambda i: None, Mode.OPTIMISTIC: lambda i: f"v{i}", Mode.NUMERIC: lambda i: i % 3 + 1}[mode]
    current = {i: (f"d{i}", version(i)) for i in range(12)}
    steps = [(r.randrange(18), k, f"x{k}", r.choice([None, f"v{r.randrange(18)}", f"n{k - 1}"]), f"n{k}", r.choice([0, 0, 1, 2, 3, 5])) for k in range(60)]
    steps += [(i, 100 + i, f"y{i}", f"v{i}", f"m{i}", 0) for i in range(6)]
    kind = "long" if mode is Mode.NUMERIC else "string"
    cur = spark.createDataFrame([(i, *x) for i, x in current.items()], f"id int, data string, version {kind}")
    inc = spark.createDataFrame(steps, "id int, op_seq long, data string, expected string, new_version string, revision long")
    plan = writes.plan_write(cur, inc, op, mode)
    state, bad = sequential(current, steps, op, mode)
    assert {r_[0]: (r_[1], r_[2]) for r_ in writes.next_state(plan).collect()} == state
    assert sorted(map(tuple, writes.rejections(plan).collect())) == sorted(bad)


def test_first_revision_follows_the_stream(spark):
    none = spark.createDataFrame([], "id int, data string, version long")
    inc = spark.createDataFrame([(1, 1, "a", 0, 7), (2, 1, "b", 0, None), (3, 1, "c", 4, 9)], "id int, op_seq long, data string, revision long, stream long")
    plan = writes.plan_write(none, inc, Op.INSERT, Mode.NUMERIC, "stream")
    assert {r["id"]: r["version"] for r in writes.next_state(plan).collect()} == {1: 7, 2: 1, 3: 4}


def test_bulk(spark):
    cur = spark.createDataFrame([(1, "a", "v1"), (2, "b", "v2")], "id int, data string, version string")
    inc = spark.createDataFrame([(2, "B", "w2", "v2"), (3, "C", "w3", None)], "id int, data string, version string, expected string")
    rows = lambda m, i=inc: sorted(map(tuple, writes.bulk(cur, i, m).collect()))
    assert rows(BulkMode.IGNORE_DUPLICATES) == [(1, "a", "v1"), (2, "b", "v2"), (3, "C", "w3")]
    assert rows(BulkMode.OVERWRITE_EXISTING) == rows(BulkMode.OVERWRITE_IF_VERSION_MATCHES) == [(1, "a", "v1"), (2, "B", "w2"), (3, "C", "w3")]
    stale = inc.withColumn("expected", F.lit("old"))
    assert rows(BulkMode.OVERWRITE_IF_VERSION_MATCHES, stale) == rows(BulkMode.IGNORE_DUPLICATES)
    with pytest.raises(ValueError):
        writes.bulk(cur, inc, BulkMode.INSERTS_ONLY)


def test_json_changes(spark):
    df = spark.createDataFrame([(1, '{"a":1,"b":[1,2]}', '{"b": [1, 2], "a": 1}'), (2, '{"b":[1,2]}', '{"b":[2,1]}'), (3, None, None), (4, None, "{}"), (5, "no json", "no json")], "id int, a string, b string")
    out = {r["id"]: r["c"] for r in df.select("id", writes.json_changed(F.col("a"), F.col("b")).alias("c")).collect()}
    assert out == {1: False, 2: True, 3: False, 4: True, 5: False}
    before, after = df.select("id", F.col("a").alias("data")), df.select("id", F.col("b").alias("data"))
    assert [r["op"] for r in writes.changes(before, after, versioned=True, checks=False).where("id = 2").collect()] == ["overwrite"]


def test_soft_delete_keeps_the_first_time(spark):
    df = spark.createDataFrame([(1, None, None), (2, True, dt.datetime(2020, 1, 1)), (3, False, None)], "id int, deleted boolean, deleted_at timestamp")
    out = {r["id"]: (r["deleted"], r["deleted_at"]) for r in writes.soft_delete(df, df.where("id < 3"), F.lit(dt.datetime(2024, 1, 1))).collect()}
    assert out == {1: (True, dt.datetime(2024, 1, 1)), 2: (True, dt.datetime(2020, 1, 1)), 3: (False, None)}


# Reads


def test_reader(spark):
    df = spark.createDataFrame([(1, "x", "a", "cat"), (1, "y", "a", "dog"), (2, "z", "b", "cat")], "id int, data string, tenant_id string, doc_type string")
    assert ids(reader.Reader(df, tenant="a").query()) == [1, 1]
    assert reader.Reader(df, tracking="query").query().columns == ["data"]
    first = reader.Reader(df, tracking="identity", order=("data",)).query()
    assert {(r["id"], r["data"]) for r in first.collect()} == {(1, "x"), (2, "z")}
    assert ids(reader.Reader(df).load_many(spark.createDataFrame([(2,), (9,)], "id int"))) == [2]
    with pytest.raises(ValueError):
        reader.Reader(df, tracking="dirty").query()
    m = reader.metadata(df, headers={"k": "v"}, causation="c").first()
    assert m["headers"] == '{"k":"v"}' and m["tenant_id"] == "a" and m["deleted"] is False


# Order


def test_dense_index(spark):
    r = random.Random(1)
    values = [(r.randrange(20) if r.random() > 0.1 else None, i) for i in range(100)]
    df = spark.createDataFrame(values, "k int, i int").repartition(5)
    want = {i: n for n, (k, i) in enumerate(sorted(values, key=lambda x: (x[0] is not None, x[0] or 0, x[1])))}
    assert {x["i"]: x["index"] for x in ordering.dense_index(df, "k", "i").collect()} == want
    assert ordering.dense_index(df.limit(0), "k").count() == 0


def test_topological():
    assert ordering.topological(["c", "b", "a"], {"c": {"b"}, "b": {"a", "b"}}) == ["a", "b", "c"]
    assert ordering.topological(["a", "b"], {"a": {"b"}, "b": {"a"}}) == ["a", "b"]


def test_newest_keeps_ties(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate([5, 4, 4, 4, 1, None])], "id int, t int")
    assert ids(ordering.newest(df, "t", 2)) == [0, 1, 2, 3]


def test_null_order(spark):
    df = spark.createDataFrame([(1,), (None,), (2,)], "x int")
    of = lambda d, f: [r["x"] for r in ordering.ordered(df, ("x", d, f)).collect()]
    assert of(False, None) == [1, 2, None] and of(True, None) == [None, 2, 1] and of(True, False) == [2, 1, None] and of(False, True) == [None, 1, 2]


# Partitions

MOMENT = dt.datetime(2026, 7, 30, 14, 37, 21, tzinfo=dt.UTC)
GOLDEN = {"hour": "h2026073014", "day": "d20260730", "week": "w20260727", "month": "m202607", "year": "y2026"}


@pytest.mark.parametrize("period, suffix", GOLDEN.items())
def test_rolling_windows(spark, period, suffix):
    p = partition.RollingWindow(partition.Period(period), 2, 1)
    assert p.name(p.start(MOMENT)) == suffix and p.parse(suffix) == p.start(MOMENT)
    now = F.lit(MOMENT.replace(tzinfo=None)).cast("timestamp_ntz")
    rows = sorted((r["suffix"], r["start"].replace(tzinfo=None), r["end"].replace(tzinfo=None)) for r in p.frame(now, spark).collect())
    assert rows == [(w.suffix, w.start, w.end) for w in p.windows(MOMENT)] and len(rows) == 4
    assert p.floor(MOMENT) == p.windows(MOMENT)[0].start
    for bad in ("", "x", suffix[:-1], suffix + "0", "z" + suffix[1:], suffix[0] + "abcd"):
        assert p.parse(bad) is None
    s = spark.createDataFrame([(suffix,), (suffix[:-1],), ("z" + suffix[1:],)], "s string")
    assert [r[0] is not None for r in s.select(partition.parse_suffix(F.col("s"), p.period)).collect()] == [True, False, False]


def test_windows_are_utc_and_weeks_start_where_told():
    west = dt.timezone(dt.timedelta(hours=-6))
    day = partition.RollingWindow(partition.Period.DAY, 0, 0)
    for at in (dt.datetime(2026, 7, 30, 1, 30, tzinfo=west), dt.datetime(2026, 7, 29, 20, tzinfo=west)):
        assert day.start(at) == dt.datetime(2026, 7, 30)
    assert partition.RollingWindow(partition.Period.WEEK, 0, 0, 6).start(MOMENT) == dt.datetime(2026, 7, 26)
    with pytest.raises(ValueError):
        partition.RollingWindow(partition.Period.DAY, -1, 0)


def test_roll():
    p = partition.RollingWindow(partition.Period.DAY, 1, 1)
    plan = partition.roll(p, ["d20260101", "d20260730", "default"], MOMENT)
    assert [w.suffix for w in plan.add] == ["d20260729", "d20260731"] and plan.drop == ("d20260101",) and plan.kept == ("default",)
    assert partition.roll(p, ["d20260101"], MOMENT, aged=False).drop == ()


def test_roll_table(spark):
    spark.sql("CREATE TABLE rolled (x INT, p STRING) USING parquet PARTITIONED BY (p)")
    try:
        spark.sql("ALTER TABLE rolled ADD PARTITION (p = 'd20260101')")
        policy = partition.RollingWindow(partition.Period.DAY, 0, 1)
        partition.roll_table(spark, "rolled", "p", partition.roll(policy, ["d20260101"], MOMENT))
        assert [r[0] for r in spark.sql("SHOW PARTITIONS rolled").collect()] == ["p=d20260730", "p=d20260731"]
    finally:
        spark.sql("DROP TABLE rolled")


def test_deltas():
    a, b = ("a", 1, 2), ("b", 2, 3)
    assert partition.range_delta([a, b], [a]) == (partition.Delta.ADDITIVE, [b])
    assert partition.range_delta([a], [a, b])[0] is partition.Delta.REBUILD
    assert partition.range_delta([a], [("a", 9, 9), b], managed=True) == (partition.Delta.NONE, [])
    assert partition.hash_delta(["x"], ["x"]) is partition.Delta.NONE and partition.hash_delta(["x"], ["y"]) is partition.Delta.REBUILD


def test_dropping_a_value_narrows_a_shared_bucket(spark):
    reg = spark.createDataFrame([("red", "warm"), ("pink", "Warm"), ("blue", "cold")], "value string, suffix string")
    rest, gone = partition.drop_value(reg, "red")
    assert rest.count() == 2 and gone.count() == 0
    assert [r[0] for r in partition.drop_value(reg, "blue")[1].collect()] == ["cold"]
    assert {r["suffix"]: r["values"] for r in partition.list_registry(reg).collect()} == {"warm": ["pink", "red"], "cold": ["blue"]}


def test_routes(spark):
    df = spark.createDataFrame([("a",), ("z",), (None,)], "x string")
    out = [r[0] for r in df.select(partition.by_list(F.col("x"), {"p": ["a", "b"]})).collect()]
    assert out == ["p", "default", "default"]
    hashed = {r[0] for r in spark.range(100).select(partition.by_hash(F.col("id"), ["one", "two", "three"])).collect()}
    assert hashed == {"one", "two", "three"}


# Tenants, identities


@pytest.mark.parametrize("text, value", [("tenant-1", 1127395211), ("", 2166136261)])
def test_fnv(spark, text, value):
    assert tenancy.fnv1a_of(text) == value
    assert spark.range(1).select(tenancy.fnv1a(F.lit(text))).first()[0] == value


def test_fnv_over_utf16(spark):
    texts = ["é€", "a😀", "x" * 100]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r[0] for r in df.select(tenancy.fnv1a(F.col("t"))).collect()] == [tenancy.fnv1a_of(t) for t in texts]


def test_assignment(spark):
    with pytest.raises(tenancy.EmptyPool):
        tenancy.by_hash(F.lit("a"), [])
    pool = spark.createDataFrame([("a", 2, False, 0), ("b", 1, False, 1), ("c", 1, False, 2), ("d", 0, True, 3)], "database_id string, tenant_count int, is_full boolean, position int")
    assert tenancy.smallest_of(pool) == "b"
    with pytest.raises(tenancy.EmptyPool):
        tenancy.smallest_of(pool.where("is_full"))
    with pytest.raises(tenancy.UnknownTenant):
        tenancy.explicit("x", {})
    assert tenancy.explicit("x", {"x": "a"}) == "a"


def test_ordinals_share_buckets(spark):
    reg = spark.createDataFrame([("t0", "B0", 3)], "tenant_id string, bucket string, ordinal int")
    new = spark.createDataFrame([("t0", "b0"), ("t1", "b0"), ("t2", "new"), ("t3", "NEW"), ("t4", "other")], "tenant_id string, bucket string")
    assert {r["tenant_id"]: r["ordinal"] for r in tenancy.ordinals(reg, new).collect()} == {"t1": 3, "t2": 4, "t3": 4, "t4": 5}


def test_hilo(spark):
    out = [r["id"] for r in tenancy.hilo(spark.range(5).withColumnRenamed("id", "k"), "k", first_hi=2, max_lo=2).orderBy("k").collect()]
    assert out == [5, 6, 7, 8, 9] and tenancy.blocks_needed(5, 2) == 3


# Events

EVENT = "data string, type string, id string, stream_id string, timestamp timestamp, tenant_id string, op_seq long"


def event(i, stream):
    return ("{}", "t", f"e{i}", stream, dt.datetime(2024, 1, 1), "t", i)


def test_append(spark):
    streams = spark.createDataFrame([("t", "a", 4, False)], "tenant_id string, stream_id string, version long, archived boolean")
    events = spark.createDataFrame([event(i, "ab"[i % 2]) for i in range(6)], EVENT)
    out = {r["id"]: (r["version"], r["seq_id"]) for r in ev.plan_append(streams, events, ev.Append.QUICK, 10).collect()}
    assert out == {"e0": (5, 10), "e1": (1, 11), "e2": (6, 12), "e3": (2, 13), "e4": (7, 14), "e5": (3, 15)}
    assert {(r["stream_id"], r["version"]) for r in ev.advanced(streams, ev.plan_append(streams, events)).collect()} == {("a", 7), ("b", 3)}


def test_versions_must_match(spark):
    streams = spark.createDataFrame([("t", "a", 4, False), ("t", "b", 1, False)], "tenant_id string, stream_id string, version long, archived boolean")
    want = spark.createDataFrame([("t", "a", 4), ("t", "b", 2), ("t", "c", 0)], "tenant_id string, stream_id string, expected long")
    assert sorted((r["stream_id"], r["actual"]) for r in ev.wrong_versions(streams, want).collect()) == [("b", 1), ("c", 0)]
    after, bad = ev.update_versions(streams, want.withColumn("new", F.lit(9)))
    assert {r["stream_id"]: r["version"] for r in after.collect()} == {"a": 9, "b": 1} and bad.count() == 2


def test_sink_compacts(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(ev, "COMPACTED", 2)
    source, store = str(tmp_path / "in"), str(tmp_path / "store")
    schema = spark.createDataFrame([], EVENT).schema
    for turn in range(6):
        spark.createDataFrame([event(10 * turn + i, "abc"[(turn + i) % 3]) for i in range(2)], EVENT).write.mode("append").parquet(source)
        ev.sink(spark.readStream.schema(schema).parquet(source), store, str(tmp_path / "check")).trigger(availableNow=True).start().awaitTermination()
    out = spark.read.parquet(f"{store}/events").collect()
    assert sorted((r["stream_id"], r["version"]) for r in out) == [(s, v) for s in "abc" for v in (1, 2, 3, 4)]
    assert sorted(r["seq_id"] for r in out) == list(range(1, 13))
    assert sorted(p.name for p in (tmp_path / "store" / "all_streams").iterdir()) == ["batch=2", "batch=4"]


def test_values_never_become_text(spark):
    odd = ["a\\b", "it's", 'a"b', ":b", "?", "a\\' OR true --", "${spark.app.name}", "\\", "'", ""]
    df = spark.createDataFrame([(x, i) for i, x in enumerate(odd)], "x string, i int")
    for i, v in enumerate(odd):
        for p in (P.Raw("x = ?", (v,)), P.Raw("x = :a and ':a' <> :b", {"a": v, "b": "z"}), P.Raw("x = :a and x <> :b", {"a": v, "b": ":a"}), P.compare("x", "<=>", v), P.in_array("x", [v])):
            assert [r["i"] for r in P.apply(df, p).collect()] == [i], (v, p)
        assert spark.sql(f"select {P.literal(v)} as v").first()[0] == v
    assert spark.sql(f"select {P.literal(float('nan'))} as n, {P.literal(float('-inf'))} as i, {P.literal(b'ab')} as b").first()["b"] == b"ab"


def test_null_keys_of_marked_memberships(spark):
    df = spark.createDataFrame([(i, None if i % 2 else i) for i in range(40)], "i int, k int")
    some = spark.createDataFrame([(0,), (4,)], "id int")
    p = P.Or(P.compare("i", "=", 7), P.Not(P.InSubQuery("k", some)))
    assert sorted(r["i"] for r in P.apply(df, p).collect()) == sorted([7, *(i for i in range(0, 40, 2) if i not in (0, 4))])


def test_fold_in_parts(spark, monkeypatch):
    monkeypatch.setattr(registry, "PART_ROWS", 4)
    total = registry.Fold("t", F.lit(0).cast("long"), lambda a, x: a + x, lambda a: a * 10, lambda a, b: a + b)
    df = spark.range(200).withColumn("g", F.when(F.col("id") < 150, 1).otherwise(2))
    out = {r["g"]: r["t"] for r in total.over(df, ["g"], "id", ["id"], "t").collect()}
    assert out == {1: 10 * sum(range(150)), 2: 10 * sum(range(150, 200))}
    with pytest.raises(ValueError):
        registry.Fold("u", F.lit(0), lambda a, x: a).over(df, ["g"], "id", ["id"], "t")


def test_dense_index_of_equal_keys_and_texts(spark):
    df = spark.createDataFrame([(i, "k" if i % 3 else None) for i in range(300)], "i int, k string").repartition(7)
    want = {i: n for n, i in enumerate([*range(0, 300, 3), *(i for i in range(300) if i % 3)])}
    assert {r["i"]: r["index"] for r in ordering.dense_index(df, "k", "i").collect()} == want


def test_sink_replays_a_batch(spark, tmp_path):
    source, store = str(tmp_path / "in"), str(tmp_path / "store")
    schema = spark.createDataFrame([], EVENT).schema
    for turn in range(2):
        spark.createDataFrame([event(10 * turn + i, "ab"[i % 2]) for i in range(4)], EVENT).write.mode("append").parquet(source)
        stream = spark.readStream.schema(schema).parquet(source)
        ev.sink(stream, store, str(tmp_path / "check")).trigger(availableNow=True).start().awaitTermination()
    out = spark.read.parquet(f"{store}/events")
    assert sorted((r["stream_id"], r["version"]) for r in out.collect()) == [(s, v) for s in "ab" for v in (1, 2, 3, 4)]
    assert sorted(r["seq_id"] for r in out.collect()) == list(range(1, 9))


# Functions, commands


def test_registry(spark):
    r = registry.Registry().add(registry.Scalar("get_answer", "int", lambda: 42)).add(registry.PythonFold("py_sum", "double", 0.0, lambda a, x: a + x))
    with pytest.raises(ValueError):
        r.add(registry.Scalar("GET_ANSWER", "int", lambda: 1))
    r.register_all(spark)
    assert spark.sql("SELECT get_answer()").first()[0] == 42
    assert spark.sql("SELECT py_sum(CAST(id AS DOUBLE)) FROM range(5)").first()[0] == 10.0
    with pytest.raises(ValueError):
        registry.Scalar("f", "int", lambda a, b, c, d, e: 1).register(spark)
    r.clear()
    assert len(r) == 0


def test_commands(spark):
    c = batch.Command().append("SELECT ").parameter(1).append(" AS a, ").group([2, 3]).named("n", 7).named("n", 8).append(", :n AS n")
    assert tuple(c.run(spark).first()) == (1, 2, 3, 7)
    with pytest.raises(ValueError):
        batch.Command().with_values("a = ?", [])
    assert batch.statements("a;b ';' c; -- x;\n d") == ["a", "b ';' c", "-- x;\n d"]
    assert batch.fetch_one(spark.range(0), 5) == 5 and batch.fetch_list(spark.range(2)) == [0, 1]


def test_batch(spark):
    b = batch.Batch()
    rows, one, none, bad = b.query(spark.range(3)), b.single(spark.range(3), F.col("id").desc()), b.scalar(spark.range(0)), b.query(spark.range(1).select(F.raise_error(F.lit("no"))))
    b.execute()
    assert len(rows.result()) == 3 and one.result()["id"] == 2 and none.result() is None
    with pytest.raises(Exception, match="no"):
        bad.result()
    with pytest.raises(RuntimeError):
        b.execute()
    with pytest.raises(RuntimeError):
        b.query(spark.range(1))


def test_words(spark):
    x = spark.range(1).select(scalar.matches_words(F.lit("One, two; THREE"), "three", "One"), scalar.matches_words(F.lit("one"), "two")).first()
    assert tuple(x) == (True, False)


def test_many_ranges(spark, monkeypatch):
    monkeypatch.setattr(partition, "FEW_RANGES", 4)
    ranges = spark.createDataFrame([(f"p{i}", i * 10, i * 10 + 5) for i in range(30)], "suffix string, start int, end int")
    df = spark.createDataFrame([(i,) for i in range(-5, 320)] + [(None,)], "x int")
    out = {r["x"]: r["suffix"] for r in partition.by_ranges(df, "x", ranges).collect()}
    assert len(out) == 326
    assert all(s == (f"p{x // 10}" if x is not None and 0 <= x < 300 and x % 10 < 5 else "default") for x, s in out.items())
    assert partition.by_ranges(df, "x", ranges.limit(0)).where("suffix = 'default'").count() == 326


def test_list_registry_changes(spark):
    reg = spark.createDataFrame([("red", "warm"), ("blue", "cold")], "value string, suffix string")
    new = spark.createDataFrame([("red", None), ("Light Green", None), ("pink", "warm")], "value string, suffix string")
    add = partition.add_values(reg, new)
    assert sorted(map(tuple, add.collect())) == [("Light Green", "light_green"), ("pink", "warm")]
    assert {r["suffix"]: r["state"] for r in partition.list_changes(reg.unionByName(add), reg).collect()} == {"warm": "different", "cold": "matched", "light_green": "missing"}


def test_event_layout(spark):
    e = spark.createDataFrame([event(1, "a")], EVENT)
    assert ev.laid_out(e, ("headers", "causation_id")).columns == [*ev.FIXED, "causation_id", "headers"]


def test_session(spark):
    cur = spark.createDataFrame([(1, '{"a":1}', "v1"), (2, '{"a":2}', "v2"), (3, '{"a":3}', "v3")], "id int, data string, version string")
    s = Session(reader.Reader(cur, tracking="dirty", order=("version",)), Mode.OPTIMISTIC)
    s.load_many([1, 2])
    s.queue_changes(spark.createDataFrame([(1, '{"a": 1}', "n1"), (2, '{"a":9}', "n2")], "id int, data string, new_version string"))
    s.queue(Op.UPSERT, spark.createDataFrame([(3, "{}", "n3"), (4, "{}", "n4")], "id int, data string, new_version string"))
    s.delete(spark.createDataFrame([(1,)], "id int"))
    after, refused = s.save(cur)
    assert sorted(map(tuple, after.collect())) == [(2, '{"a":9}', "n2"), (3, '{"a":3}', "v3"), (4, "{}", "n4")]
    assert [[(r["id"], r["reason"]) for r in x.collect()] for x in refused] == [[], [(3, "conflict")]]
    free = Session(reader.Reader(cur), Mode.OPTIMISTIC, checks=False)
    free.queue(Op.UPSERT, spark.createDataFrame([(3, "{}", "n3")], "id int, data string, new_version string"))
    assert (3, "{}", "n3") in map(tuple, free.save(cur)[0].collect())


def test_results_on_the_driver_have_a_bound(spark):
    rows = spark.range(12)
    assert len(batch.fetch_list(rows, most=12)) == 12
    b = batch.Batch()
    many, few = b.query(rows, most=5), b.query(rows.limit(5), most=5)
    b.execute()
    assert len(few.result()) == 5
    with pytest.raises(batch.TooManyRows):
        many.result()


def test_roles_of_a_session(spark):
    rows = spark.createDataFrame([("a", "{}"), ("b", "{}")], "id string, data string")
    s = Session(reader.Reader(rows), Mode.OFF)
    s.delete(rows.where("id = 'c'").select("id"))
    s.queue(Op.INSERT, spark.createDataFrame([("c", "1"), ("d", "2")], "id string, data string"))
    s.delete(spark.createDataFrame([("c",), ("a",)], "id string"))
    s.queue(Op.OVERWRITE, rows.where("id = 'b'"))
    assert s.pending() == [Role.INSERT, Role.UPSERT, Role.DELETION, Role.DELETION]
    after, refused = s.save(rows)
    assert sorted(r["id"] for r in after.collect()) == ["b", "d"]
    assert len(refused) == 2
    assert s.pending() == []


def test_versions_of_a_hot_stream(spark):
    rows = [("t", "hot" if i % 3 else "cold", i, f"e{i}") for i in range(90)] + [(None, "hot", 500 + i, "n") for i in range(3)]
    events = spark.createDataFrame(rows, "tenant_id string, stream_id string, op_seq long, id string").repartition(5)
    streams = spark.createDataFrame([("t", "hot", 7)], "tenant_id string, stream_id string, version long")
    got = sorted((r["seq_id"], r["tenant_id"], r["version"]) for r in ev.plan_append(streams, events, first_seq=10).collect())
    count = {"hot": 7, "cold": 0}
    want = []
    for n, (t, s, _, _) in enumerate(rows):
        key = s if t else "null"
        count[key] = count.get(key, 0) + 1
        want.append((10 + n, t, count[key]))
    assert got == want
