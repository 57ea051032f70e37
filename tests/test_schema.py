from __future__ import annotations

import datetime as dt
from dataclasses import dataclass, field, replace
from enum import Enum

import pytest

from corvane.sources import admin, names
from corvane.sources import schema as S

PEOPLE = S.Table("diffs", "people", (S.Column("id", "int", False), S.Column("first_name", "string")), ("id",))
STATES = S.Table("diffs", "states", (S.Column("id", "int", False),), ("id",))
REFERS = replace(PEOPLE, columns=(*PEOPLE.columns, S.Column("state_id", "int")), foreign_keys=(S.ForeignKey("fk_state", ("state_id",), "states", ("id",)),))


@pytest.fixture
def clean(spark):
    S.drop_schema(spark, "diffs")
    yield
    S.drop_schema(spark, "diffs")


def test_names():
    assert names.delimited("a`b") == "`a``b`" and names.undelimited("`a``b`") == "a`b" and names.undelimited("[a]") == "a"
    assert names.split_qualified("`x.y`.z") == ("x.y", "z") and names.split_qualified("z") == ("default", "z")
    with pytest.raises(ValueError):
        names.split_qualified("a.b.c")
    assert names.shortened("x" * 70) == "x" * 63 and names.normalised(" 'a' ") == "a"
    assert names.normalised("'2024-01-02 03:00:00+02:00'") == "2024-01-02 01:00:00" and names.normalised("20240102") == "20240102"


def test_canonical_expressions():
    assert S.canonical("CHECK ((a > 0))") == S.canonical("a>0::int") == "a>0"
    assert S.canonical("(a+b)*c") == S.canonical("a+(b*c)")  # coarse on purpose


def test_diff_states():
    assert S.diff(PEOPLE, None).difference is S.Difference.CREATE
    assert S.diff(PEOPLE, PEOPLE).difference is S.Difference.NONE
    assert S.diff(REFERS, PEOPLE).difference is S.Difference.UPDATE
    assert S.diff(replace(PEOPLE, partitioned_by=("id",)), PEOPLE).difference is S.Difference.INVALID
    known = replace(PEOPLE, checks=(S.Check("c", "id > 0"),))
    assert S.diff(PEOPLE, known).difference is S.Difference.NONE  # unknown checks are left alone
    assert S.diff(known, replace(PEOPLE, checks=(S.Check("C", "CHECK (id > 0)"),))).difference is S.Difference.NONE
    assert S.Migration((S.diff(PEOPLE, None), S.diff(REFERS, PEOPLE))).difference is S.Difference.UPDATE


def test_gates():
    create, update = S.Migration((S.diff(PEOPLE, None),)), S.Migration((S.diff(REFERS, PEOPLE),))
    for gate in (S.AutoCreate.CREATE_ONLY, S.AutoCreate.CREATE_OR_UPDATE, S.AutoCreate.ALL):
        create.check(gate)
    with pytest.raises(S.NotAllowed):
        create.check(S.AutoCreate.NONE)
    with pytest.raises(S.NotAllowed):
        update.check(S.AutoCreate.CREATE_ONLY)
    S.Migration(()).check(S.AutoCreate.NONE)


def test_actions_are_in_order_and_reverse():
    old = replace(PEOPLE, indexes=(S.Index("i1", ("id",)),), columns=(*PEOPLE.columns, S.Column("gone", "int")))
    new = replace(REFERS, indexes=(S.Index("i2", ("id",)),), checks=(S.Check("c", "id > 0"),), key=("id", "first_name"))
    d = S.diff(new, old)
    assert [a.kind for a in d.actions()] == ["drop index", "add column", "foreign key", "check", "index", "key", "drop column", "model"]
    assert [a.kind for a in d.rollback()] == [a.kind for a in d.actions()][::-1]


def test_apply(spark, clean):
    store = S.Store(spark, [REFERS, STATES])
    assert [t.name for t in store.order()] == ["states", "people"]
    assert store.apply() is S.Difference.CREATE and store.apply() is S.Difference.NONE
    store.assert_matches()
    assert S.objects(spark, "diffs")["tables"] == ["people", "states"]
    spark.sql("INSERT INTO diffs.people VALUES (1, 'a', 2)")
    wider = S.Store(spark, [replace(REFERS, columns=(*REFERS.columns, S.Column("age", "long"))), STATES])
    with pytest.raises(AssertionError):
        wider.assert_matches()
    assert wider.apply() is S.Difference.UPDATE
    wider.assert_matches()
    assert [tuple(r) for r in spark.table("diffs.people").collect()] == [(1, "a", 2, None)]
    retyped = replace(PEOPLE, columns=(S.Column("id", "long", False), S.Column("first_name", "string"), S.Column("twice", "long", computed="id * 2")))
    S.Store(spark, [retyped], S.AutoCreate.ALL).apply()
    assert [tuple(r) for r in spark.table("diffs.people").collect()] == [(1, "a", 2)]
    S.Store(spark, [retyped]).assert_matches()
    S.Store(spark, [retyped]).delete_all()
    assert spark.table("diffs.people").count() == 0


def test_ensure_follows_references(spark, clean):
    S.Store(spark, [REFERS, STATES]).ensure("people")
    assert S.read_table(spark, "diffs", "states") is not None
    assert S.read_table(spark, "diffs", "people").foreign_keys == REFERS.foreign_keys


def test_views(spark, clean):
    S.ensure_schema(spark, "diffs")
    S.create_view(spark, "diffs.v", "SELECT 1 AS one")
    S.refresh_materialized(spark, "diffs", "m", "SELECT * FROM diffs.v")
    S.refresh_materialized(spark, "diffs", "m", "SELECT 2 AS one")
    assert spark.table("diffs.m").first()[0] == 2
    assert not S.text_differs("SELECT 1;", " select 1 ") and S.text_differs("select 1", "select 2")
    with pytest.raises(S.Unsupported):
        S.refuse("trigger")


def test_snapshots(tmp_path):
    assert S.from_snapshot(S.snapshot([REFERS, STATES])) == [REFERS, STATES]
    up, down = S.snapshot_changes([PEOPLE], [REFERS, STATES])
    assert [a.kind for a in up] == ["create", "add column", "foreign key", "model"] and len(down) == 4
    m = S.Migration((S.diff(PEOPLE, None),))
    m.write(tmp_path / "a.sql")
    assert "CREATE TABLE" in (tmp_path / "a.sql").read_text() and "DROP TABLE" in (tmp_path / "a.drop.sql").read_text()
    (tmp_path / "x.function").write_text("f")
    assert S.templates(tmp_path) == {"x.function": "f"}


def test_checks(spark):
    df = spark.createDataFrame([(1, 5), (2, None), (3, -1), (3, 4)], "id int, x int")
    assert [r["id"] for r in S.violations(df, S.Check("c", "x > 0")).collect()] == [3]
    assert [r["id"] for r in S.repeated_keys(df, ["id"]).collect()] == [3]
    parent = spark.createDataFrame([(5,)], "k int")
    assert sorted(r["x"] for r in S.orphans(df, parent, S.ForeignKey("f", ("x",), "p", ("k",))).collect()) == [-1, 4]


def test_renames(spark, clean):
    new = replace(PEOPLE, columns=(PEOPLE.columns[0], S.Column("given_name", "string")))
    assert S.renames(S.diff(new, PEOPLE)) == {"first_name": "given_name"}
    two = replace(PEOPLE, columns=(*PEOPLE.columns, S.Column("b", "string")))
    assert S.renames(S.diff(replace(two, columns=(two.columns[0], S.Column("x", "string"), S.Column("y", "string"))), two)) == {}
    S.Store(spark, [PEOPLE]).apply()
    spark.sql("INSERT INTO diffs.people VALUES (1, 'a')")
    S.Store(spark, [new], S.AutoCreate.ALL).apply()
    assert [tuple(r) for r in spark.table("diffs.people").select("id", "given_name").collect()] == [(1, "a")]


def test_names_are_checked_first(spark):
    for bad in ("", "x" * 64, "a\nb"):
        with pytest.raises(names.BadName):
            S.Store(spark, [replace(PEOPLE, name=bad)])
    with pytest.raises(names.BadName):
        S.check_names([replace(PEOPLE, columns=(S.Column("a", "int"), S.Column("A", "int")))])
    with pytest.raises(names.BadName):
        names.checked(["y" * 63 + "1", "y" * 63 + "2"], "table")
    S.check_names([PEOPLE, STATES])


def test_odd_texts_come_back(spark, clean):
    odd = "first_name <> 'it''s' and first_name <> \"x\\\\y\" and first_name <> '${spark.app.name}'"
    t = replace(PEOPLE, checks=(S.Check("odd \\ 'one'", odd),), indexes=(S.Index("i", ("id",), predicate='first_name = "q"'),))
    S.Store(spark, [t]).apply()
    back = S.read_table(spark, "diffs", "people")
    assert back.checks == t.checks and back.indexes == t.indexes
    S.Store(spark, [t]).assert_matches()


def test_up_and_down(spark, clean):
    old = replace(PEOPLE, columns=(*PEOPLE.columns, S.Column("gone", "short")), checks=(S.Check("c", "id > 0"),))
    new = replace(PEOPLE, columns=(S.Column("id", "long", False), S.Column("first_name", "string"), S.Column("made", "int", default="7")), key=("id", "first_name"), indexes=(S.Index("i", ("id",)),))
    wider = replace(old, columns=(*old.columns, S.Column("x", "int"), S.Column("y", "string")))
    for after in (new, wider):
        S.drop_schema(spark, "diffs")
        S.Store(spark, [old]).apply()
        spark.sql("INSERT INTO diffs.people VALUES (1, 'a', 5), (2, NULL, NULL)")
        m = S.determine(spark, [after])
        m.run(spark)
        assert S.determine(spark, [after]).difference is S.Difference.NONE
        if after is new:
            assert sorted(map(tuple, spark.table("diffs.people").select("id", "first_name", "made").collect())) == [(1, "a", 7), (2, None, 7)]
        m.roll_back(spark)
        assert S.read_table(spark, "diffs", "people").columns == tuple(replace(c, type=S.spark_type(c.type), nullable=True) for c in old.columns) or S.determine(spark, [old]).difference is S.Difference.NONE
        assert S.read_table(spark, "diffs", "people").model() == old.model()
        assert sorted(r["id"] for r in spark.table("diffs.people").collect()) == [1, 2]
        if after is wider:
            assert sorted(r["gone"] or 0 for r in spark.table("diffs.people").collect()) == [0, 5]


def test_a_rebuild_that_was_cut_short(spark, clean):
    new = replace(PEOPLE, columns=(S.Column("id", "long", False), PEOPLE.columns[1]))
    steps = S.rebuild_script(new, PEOPLE, {}).split(";\n")
    for done in range(len(steps)):
        S.drop_schema(spark, "diffs")
        S.Store(spark, [PEOPLE]).apply()
        spark.sql("INSERT INTO diffs.people VALUES (1, 'a')")
        for s in steps[:done]:
            spark.sql(s)
        S.Store(spark, [new], S.AutoCreate.ALL).apply()
        assert [tuple(r) for r in spark.table("diffs.people").collect()] == [(1, "a")] and S.objects(spark, "diffs")["tables"] == ["people"]
        assert spark.table("diffs.people").dtypes[0] == ("id", "bigint")


def test_fingerprint_is_kept_and_one_driver_works(spark, clean, tmp_path):
    first, second = (S.Store(spark, [REFERS, STATES], folder=tmp_path) for _ in range(2))
    assert second.applied() == "" and first.apply() is S.Difference.CREATE
    assert second.applied() == S.fingerprint([REFERS, STATES]) and second.apply() is S.Difference.NONE
    changed = S.Store(spark, [replace(REFERS, columns=(*REFERS.columns, S.Column("age", "long"))), STATES], folder=tmp_path, wait=0)
    with admin.lock(tmp_path / "store.lock"), pytest.raises(admin.Locked):
        changed.apply()
    assert changed.apply() is S.Difference.UPDATE and not list(tmp_path.iterdir())


def test_locks_have_owners_and_run_out(tmp_path):
    path = tmp_path / "l"
    with admin.lock(path, lasts=0.05) as dead:
        import time

        time.sleep(0.1)
        with admin.lock(path) as alive:
            with pytest.raises(admin.Lost):
                dead.renew()
            dead.release()
            assert path.exists()
            alive.renew()
    assert not path.exists()
    path.write_text("what a crash left")
    with admin.lock(path):
        pass


def test_counters_are_given_out_once(spark, tmp_path):
    from concurrent.futures import ThreadPoolExecutor

    s = admin.Sequence(tmp_path, "orders", 10)
    with ThreadPoolExecutor(8) as pool:
        got = list(pool.map(lambda _: admin.Sequence(tmp_path, "orders", 10).take(3), range(20)))
    assert sorted(got) == list(range(10, 70, 3)) and s.peek() == 70
    s.floor(100)
    assert s.take() == 100
    s.restart(5)
    assert s.take() == 5
    df = spark.range(7).withColumnRenamed("id", "k")
    ids = [[r["id"] for r in admin.HiLo(tmp_path, "people", 3).assign(df, "k").orderBy("k").collect()] for _ in range(2)]
    assert ids == [list(range(1, 8)), list(range(10, 17))]


def test_specifications(spark, clean):
    spec = admin.Specification(admin.Database("diffs"), (S.Store(spark, [PEOPLE]),))
    assert spec.ensure(admin.Databases(spark)) == [S.Difference.CREATE]
    assert list(admin.by_server([spec, replace(spec, server="other")])) == ["spark_catalog", "other"]
    with pytest.raises(ValueError):
        admin.by_server([spec, spec])


def test_user_types(spark, clean):
    df = spark.createDataFrame([("a", 1), ("z", -1), (None, None)], "t string, n int")
    assert S.UserType("e", values=("a", "b")).violations(df, "t").count() == 1
    assert S.UserType("p", base="int", check="VALUE > 0").violations(df, "n").count() == 1
    assert S.UserType("s", fields=(S.Column("x", "int"), S.Column("y", "guid"))).spark() == "struct<x:int,y:string>"
    S.ensure_schema(spark, "diffs")
    spark.range(3).write.saveAsTable("diffs.t")
    S.create_synonym(spark, "diffs.also", "diffs.t")
    assert spark.table("diffs.also").count() == 3


def stores(spark):
    return {"main": S.Store(spark, [REFERS, STATES]), "other": S.Store(spark, [replace(STATES, name="others")])}


def test_commands(spark, clean, tmp_path, capsys, monkeypatch):
    monkeypatch.syspath_prepend(str(tmp_path))
    (tmp_path / "stores_of.py").write_text("made = None\ndef stores(spark):\n    return made(spark)\n")
    import stores_of

    stores_of.made = stores
    run = lambda *a: admin.main([*a, "stores_of:stores", "--out", str(tmp_path)], spark)
    assert run("assert") == 1 and run("apply", "--parallel", "2") == 0 and run("assert") == 0
    assert run("dump") == 0 and "CREATE TABLE" in (tmp_path / "main.sql").read_text() and S.from_snapshot((tmp_path / "main.json").read_text()) == [REFERS, STATES]
    assert run("patch") == 0 and (tmp_path / "main.patch.sql").read_text() == ""
    assert run("list", "--store", "main") == 0 and "states" in capsys.readouterr().out


def test_databases_locks_and_settings(spark, clean, tmp_path):
    dbs = admin.Databases(spark)
    assert not dbs.exists("diffs")
    dbs.find_or_create(admin.Database("diffs", comment="it's a test"))
    assert dbs.exists("diffs") and "diffs" in dbs.names()
    dbs.drop("diffs")
    assert not dbs.exists("diffs")
    with admin.lock(tmp_path / "l"), pytest.raises(admin.Locked), admin.lock(tmp_path / "l"):
        pass
    with admin.lock(tmp_path / "l"):
        pass
    s = admin.Settings({"spark.sql.shuffle.partitions": spark.conf.get("spark.sql.shuffle.partitions")})
    s.apply(spark)
    assert s.read(spark) == s.values
    r = admin.MultiReader([spark.range(2), spark.range(3)])
    assert len(list(r.rows())) == 2 and r.next_result() and len(list(r.rows())) == 3 and not r.next_result()


class Colour(Enum):
    RED, BLUE = 1, 2


@dataclass
class Named:
    id: int = field(metadata={"key": True})
    name: str | None = field(metadata={"index": True})


@dataclass
class Owner(Named):
    table = "owners"
    born: dt.date | None


@dataclass
class Thing(Named):
    owner: int | None = field(metadata={"name": "owner_id", "refers": Owner, "on_delete": "CASCADE"})
    tags: list[str]
    colour: Colour
    price: float = field(metadata={"check": "price > 0", "default": "1.5"})


def test_models_become_tables(spark):
    tables = S.from_models("models_db", Thing, Owner)
    assert [t.name for t in tables] == ["owners", "thing"]
    thing = tables[1]
    assert [(c.name, c.type, c.nullable) for c in thing.columns] == [("id", "long", False), ("name", "string", True), ("owner_id", "long", True), ("tags", "string[]", False), ("colour", "enum", False), ("price", "double", False)]
    assert thing.key == ("id",)
    assert [(k.columns, k.table, k.linked, k.on_delete) for k in thing.foreign_keys] == [(("owner_id",), "owners", ("id",), "CASCADE")]
    assert [i.columns for i in thing.indexes] == [("name",)]
    assert [c.expression for c in thing.checks] == ["price > 0"]
    try:
        store = S.Store(spark, tables)
        assert store.apply() is S.Difference.CREATE
        store.assert_matches()
        # a snapshot of the models and a later one: what to do, and what undoes it
        wider = replace(thing, columns=(*thing.columns, S.Column("more", "int")))
        up, down = S.snapshot_changes(S.from_snapshot(S.snapshot(tables)), [tables[0], wider])
        assert [a.kind for a in up] == ["add column", "model"]
        assert [a.kind for a in down] == ["model", "add column"]
    finally:
        S.drop_schema(spark, "models_db")
