import datetime as dt

import pytest
from pyspark.sql import functions as F

from marlstone.catalog.model import Rejected
from marlstone.catalog.types import Model
from marlstone.functions.scalar import is_v7
from marlstone.plans.values import BindError
from marlstone.session import Engine
from marlstone.sources.snapshots import Conflict, SnapshotStore
from marlstone.streaming.run import StreamEngine, start

MODEL = """
table Team { @@team_id: i64, title: utf8, lead: &Member? }
table Member {
    @@member_id: uuid, @name: utf8, avatar: utf8? = null, boss: &Member? = null,
    team: &Team?, active: bool = true, logins: i64 = 0, seen: datetime? = null,
}
class Point { x: i32, y: i32 }
class Shape { id: i32, at: Point, code: u8 = 1, vec: vector<2> }
enums Level { Low = 1, High = 2 }
flags Right { Read = 1, Write = 16 }
macro tidy(v: utf8) -> utf8 { v.trim().lower() }
query named(n: utf8) -> [Member] { Member.filter(m => m.name == n) }
"""
MEMBERS = [
    ("a", "Ann ", "x.png", None, 1, True, 3, dt.datetime(2020, 1, 1)),
    ("b", "", None, "a", 1, True, 0, None),
    ("c", "Cy", None, "c", 2, False, 5, dt.datetime(2030, 1, 1)),
    ("d", " dee", "y.png", "zz", None, None, None, None),
    ("e", "Cy", None, "b", 9, True, 5, None),
]


@pytest.fixture(scope="module")
def engine(spark):
    model = Model.of(MODEL)
    frames = {
        "Member": spark.createDataFrame(MEMBERS, "member_id string, name string, avatar string, boss string, team long, active boolean, logins long, seen timestamp"),
        "Team": spark.createDataFrame([(1, "one", "a"), (2, "two", None)], "team_id long, title string, lead string"),
    }
    return Engine(spark, model, frames=frames)


def rows(df):
    return [tuple(r) for r in df.collect()]


def ids(df):
    return sorted(r.member_id for r in df.collect())


@pytest.mark.parametrize(
    ("program", "want"),
    [
        ('Member.filter(m => m.avatar != null)', "ad"),
        ('Member.filter(m => m.avatar == null)', "bce"),
        ('Member.filter(m => m.name != "Cy")', "abd"),
        ('Member.filter(m => m.avatar != "x.png")', "bcde"),
        ("Member.filter(m => !m.active)", "c"),
        ("Member.filter(m => m.logins > 2)", "ace"),
        ('Member.filter(m => tidy(m.name) == "cy" && m.active)', "e"),
        ('Member.filter(m => m.boss.name == "Cy")', "c"),
        ('Member.filter(m => m.boss.boss.name == "Ann ")', "e"),
        ("Member.filter(m => m.boss.name == null)", "ad"),
        ("Member.filter(m => m.team == 1)", "ab"),
    ],
)
def test_filters_with_nulls(engine, program, want):
    assert ids(engine.run(program)) == list(want)


def test_null_check_is_never_null(engine):
    got = dict(rows(engine.run("Member.map(m => m.{ member_id, has: avatar != null })")))
    assert got == {"a": True, "b": False, "c": False, "d": True, "e": False}


def test_references_drop_no_row(engine):
    got = dict(rows(engine.run("Member.map(m => m.{ member_id, t: team.title })")))
    assert got == {"a": "one", "b": "one", "c": "two", "d": None, "e": None}


def test_order_ties_and_nulls(engine):
    assert [r[0] for r in rows(engine.run("Member.sort_by(m => m.logins).map(m => m.{ member_id })"))] == ["b", "a", "c", "e", "d"]
    assert [r[0] for r in rows(engine.run("Member.sort_by(m => m.name).take(2).map(m => m.{ member_id })"))] == ["b", "d"]
    assert [r[0] for r in rows(engine.run("Member.sort_by(m => m.logins).take(3).map(m => m.{ member_id, t: m.team.title })"))] == ["b", "a", "c"]


def test_receiver_fields_come_first(engine):
    assert rows(engine.run('Member.filter(m => m.member_id == "a").map(m => m.{ name, other: logins + n })', name="outer", n=10)) == [("Ann ", 13)]


def test_unused_reference_is_not_joined_and_paths_once(engine):
    plan = lambda p: engine.run(p)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan("Member.map(m => m.{ member_id, team })")
    assert plan("Member.map(m => m.{ a: team.title, b: team.title, c: team.lead })").count("Join") == 1


def test_point_access(engine):
    assert rows(engine.run("Member.get(k)?.map(m => m.name)", k="c")) == [("Cy",)]
    assert rows(engine.run('Member.get("none")')) == []
    with pytest.raises(Exception, match="NotFound"):
        engine.run('Member.get("none")?').collect()


def test_lists_constructed_and_defaults(engine):
    got = rows(engine.run('[Member { member_id: "p", name: "P", team: null }, Member { member_id: "q", name: "Q", team: 1, logins: 2 }]'))
    assert got == [("p", "P", None, None, None, True, 0, None), ("q", "Q", None, None, 1, True, 2, None)]


def test_inline_class_vector_and_ranges(engine):
    df = engine.run("Shape { id: 1, at: { x: 1, y: 2 }, vec: [1, 2] }")
    assert rows(df)[0][0] == 1 and df.collect()[0].vec == [1.0, 2.0] and df.collect()[0].at.y == 2
    for bad, why in (("code: 300, vec: [1, 2]", "OutOfRange"), ("vec: [1]", "BadDimension")):
        with pytest.raises(Exception, match=why):
            engine.run("Shape { id: 1, at: { x: 1, y: 2 }, " + bad + " }").collect()


def test_mutations_see_old_rows_and_keep_nulls(engine):
    c = engine.change("Member.filter(m => m.logins > 2).update(m => { logins: m.logins + 1, name: m.boss.name })")
    got = {r.member_id: (r.logins, r.name) for r in c.state.collect()}
    assert got == {"a": (4, None), "b": (0, ""), "c": (6, "Cy"), "d": (None, " dee"), "e": (6, "")}
    assert ids(c.affected) == ["a", "c", "e"] and rows(c.count()) == [(3,)]
    gone = engine.change("Member.filter(m => m.active).delete()")
    assert ids(gone.state) == ["c", "d"] and ids(gone.affected) == ["a", "b", "e"]
    one = engine.change('let m = Member.get("c")?\nm.update { avatar: pic }', pic="new")
    assert {r.member_id: r.avatar for r in one.state.collect()}["c"] == "new"
    assert ids(engine.change('Member.get("c")?.delete()').state) == ["a", "b", "d", "e"]


def test_later_statements_see_earlier_changes(engine):
    p = 'let x = Member.filter(m => m.active).delete()\nlet y = Member.filter(m => m.logins == 5).update({ name: "Z" })\nMember.map(m => m.{ member_id, name })'
    assert sorted(rows(engine.run(p))) == [("c", "Z"), ("d", " dee")]


def test_insert_checks_keys(engine):
    ok = engine.change('Member { member_id: "n", name: "New", team: 1 }.insert()')
    assert ids(ok.state) == list("abcden") and ids(ok.affected) == ["n"]
    for bad in ('Member { member_id: "a", name: "New", team: 1 }.insert()', 'Member { member_id: "n", name: "Cy", team: 1 }.insert()', '[Member { member_id: "n", name: "x", team: 1 }, Member { member_id: "n", name: "y", team: 1 }].insert()'):
        with pytest.raises(Exception, match="DuplicateKey"):
            engine.change(bad).affected.collect()


def test_ids_are_version_7(engine, spark):
    df = engine.run("Member.map(m => m.{ id: uuid() })").select(is_v7(F.col("id")).alias("ok"), "id").collect()
    assert all(r.ok for r in df) and len({r.id for r in df}) == 5
    ok = spark.createDataFrame([("x",), ("00000000-0000-4000-8000-000000000000",), (None,)], "s string").select(is_v7(F.col("s"))).collect()
    assert [r[0] for r in ok] == [False, False, None]


def test_named_query_and_choices(engine):
    assert ids(engine.query("named", n="Cy")) == ["c", "e"]
    assert ids(engine.run("Member.filter(m => m.team == Level.High)")) == ["c"]
    with pytest.raises(TypeError):
        engine.query("named")


@pytest.mark.parametrize(
    "bad",
    [
        "Member.map(m => m.{ name, name: logins })", "Member.map(m => m.{ *, name })", "Member.map(m => m.{ missing })", "Nobody", "Member.filter(m => m.missing)",
        "Member.skip(1)", "Member.map(m => m.{ a: nope })", "Member.sort_by(m => m.name).update({ name: \"x\" })", "Point { x: 1, y: 2 }.insert()", "Point.get(1)",
        "Member { name: \"n\" }", "Member { member_id: \"n\", name: \"n\", team: 1, extra: 2 }", "Member.filter(m => m.active)?", "Member.take(n)", "let a: Team = Member\na",
    ],
)
def test_misuse_is_found_while_lowering(engine, bad):
    with pytest.raises((BindError, KeyError)):
        engine.run(bad)


def test_model_problems(spark):
    for bad in ("flags F { A = 3 }", "enums E { A = 1, B = 1 }", "table T { @@id: i32, old: i32 } obsolete field T.old;", "class C { c: C }"):
        with pytest.raises(Rejected):
            m = Model.of(bad)
            m.schema(m.types["C"])


def test_schema_keeps_what_spark_cannot_say():
    m = Model.of(MODEL)
    s = m.schema(m.types["Shape"])
    assert s["vec"].metadata["dimension"] == 2 and s["at"].dataType.fieldNames() == ["x", "y"]
    s = m.schema(m.types["Member"])
    assert s["boss"].metadata["references"] == "Member" and s["boss"].nullable and not s["name"].nullable


def test_pushdown_and_pruning(spark, tmp_path):
    spark.range(10).selectExpr("id a", "id b", "id c").write.parquet(str(tmp_path / "t.parquet"))
    e = Engine(spark, "table T { @@a: i64, b: i64, c: i64 }", str(tmp_path))
    plan = e.run("T.filter(t => t.b > 3).map(t => t.{ a })")._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(b,3)" in plan and "c:bigint" not in plan


def test_snapshots(engine, spark, tmp_path):
    store = SnapshotStore(spark, f"file://{tmp_path}")
    store.write("Member", engine.run("Member"))
    e = Engine(spark, engine.model, frames={"Member": lambda: store.read("Member"), "Team": engine.source.frames["Team"]})
    stored = store.append(e.change("Member { member_id: uuid(), name: \"fresh\", team: 1 }.insert()"))
    assert stored.collect() == stored.collect() and store.read("Member").count() == 6 and store.read("Member", 1).count() == 5
    assert len(store.parts("Member", 2)) == 2
    store.write("Member", e.change("Member.filter(m => m.active).delete()").state, expect=2)
    assert sorted(r.member_id for r in store.read("Member").collect()) == ["c", "d"] and store.version("Member") == 3
    with pytest.raises(Conflict):
        store.write("Member", e.run("Member"), expect=1)


def test_streams(engine, spark, tmp_path):
    engine.source.frames["Member"].write.parquet(str(tmp_path / "in"))
    e = StreamEngine(spark, engine.model, str(tmp_path), {"Member": str(tmp_path / "in")}, frames={"Team": engine.source.frames["Team"]})
    df = e.run('Member.filter(m => tidy(m.name) != "").map(m => m.{ member_id, t: team.title })')
    assert df.isStreaming
    q = start(df, str(tmp_path / "check"), name="members_out")
    q.awaitTermination()
    assert sorted(map(tuple, spark.table("members_out").collect())) == [("a", "one"), ("c", "two"), ("d", None), ("e", None)]
    with pytest.raises(BindError):
        e.run("Member.sort_by(m => m.name)")


def test_a_row_that_must_be_there(engine):
    for program in ('Member.get("none")?.delete()', 'Member.get("none")?.update { name: "x" }', 'let m = Member.get("none")?\nm.update(x => { name: "y" })'):
        for part in ("state", "affected"):
            with pytest.raises(Exception, match="NotFound"):
                getattr(engine.change(program), part).collect()
    assert len(engine.change('Member.get("none").delete()').state.collect()) == 5
    plan = engine.run('Member.get("a")?')._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("Scan") == 1


def test_fields_of_a_row_got_by_key(engine):
    p = 'let m = Member.get("e")?\n'
    assert rows(engine.run(p + "m.name")) == [("Cy",)]
    assert rows(engine.run(p + "m.boss.boss.name")) == [("Ann ",)]
    assert rows(engine.run(p + "m.{ name, logins, over: boss.name }")) == [("Cy", 5, "")]
    assert ids(engine.run(p + "Member.filter(x => x.logins == m.logins && x.name == m.name)")) == ["c", "e"]
    assert ids(engine.change(p + "Member.filter(x => x.logins < m.logins).update({ avatar: m.name })").affected) == ["a", "b"]
    with pytest.raises(Exception, match="NotFound"):
        engine.run('let m = Member.get("none")?\nMember.filter(x => x.name == m.name)').collect()
    with pytest.raises(BindError):
        engine.run('let m = Member.get("e")\nm.name')


def test_rows_made_by_map_are_inserted(engine):
    p = 'Team.map(t => Member { member_id: t.title, name: t.title, team: t.team_id, logins: t.team_id + 1 }).insert()'
    c = engine.change(p)
    assert sorted((r.member_id, r.logins, r.active) for r in c.affected.collect()) == [("one", 2, True), ("two", 3, True)] and c.state.count() == 7
    for bad, why in (("member_id: \"x\", name: t.title, team: 1", "DuplicateKey"), ("member_id: t.title, name: t.lead, team: 1", "NullValue")):
        with pytest.raises(Exception, match=why):
            engine.change("Team.map(t => Member { " + bad + " }).insert()").affected.collect()
    for bad in ("Member.insert()", "Member.map(m => m.{ name }).insert()", "Member.map(m => Point { x: 1, y: 2 }).insert()"):
        with pytest.raises(BindError):
            engine.run(bad)


def test_many_constructed_rows(spark):
    import time

    e = Engine(spark, "table T { @@a: i64, b: utf8, c: f64?, d: u8 = 7 }", frames={"T": spark.createDataFrame([(-1, "x", 0.5, 1)], "a long, b string, c double, d int")})
    program = "[" + ", ".join(f'T {{ a: {i}, b: "v{i}", c: {"null" if i % 3 else i} }}' for i in range(10_000)) + "].insert()"
    start = time.time()
    got = engine_rows = e.change(program).state
    assert got.count() == 10_001 and time.time() - start < 30
    assert engine_rows.where("a = 9").collect()[0].asDict() == {"a": 9, "b": "v9", "c": 9.0, "d": 7}
    with pytest.raises(Exception, match="OutOfRange"):
        e.run('[T { a: 1, b: "x", d: 3 }, T { a: 2, b: "x", d: 300 }]').collect()


def test_take_by_parameter_and_ties_after_map(engine):
    top = lambda n: [r[0] for r in rows(engine.run("Member.map(m => m.{ name, logins }).sort_by(m => m.logins).take(n).map(m => m.{ name, logins })", n=n))]
    assert top(3) == ["", "Ann ", "Cy"] and top(0) == []
    assert [r[1] for r in rows(engine.run("Member.map(m => m.{ logins, member_id }).sort_by(m => m.logins).take(4)"))] == ["b", "a", "c", "e"]
    for bad in (-1, "3", True, 1.5, F.lit(2)):
        with pytest.raises(BindError):
            engine.run("Member.take(n)", n=bad)


def test_enum_names_and_flags_in_programs(engine):
    assert sorted(rows(engine.run("Member.map(m => m.{ member_id, level: Level.name(team), may: logins.has(Right.Read), both: logins.has(5) })")))[:3] == [("a", "Low", True, False), ("b", "Low", False, False), ("c", "High", True, True)]


def test_commits(engine, spark, tmp_path):
    store = SnapshotStore(spark, f"file://{tmp_path}")
    e = Engine(spark, engine.model, frames=engine.source.frames, store=store)
    one = e.commit('Member { member_id: uuid(), name: "fresh", team: 1 }.insert()')
    assert one.collect() == one.collect() and e.run("Member").count() == 6 and store.version("Member") == 2
    new = one.collect()[0].member_id
    e.commit("let gone = Member.filter(m => m.active).delete()\nlet t = Team.get(1)?.update { title: \"first\" }")
    assert ids(e.run("Member")) == ["c", "d"] and dict(rows(e.run("Team.map(t => t.{ team_id, title })"))) == {1: "first", 2: "two"}
    assert new in ids(store.read("Member", 2)) and store.version("Member") == 3
    with pytest.raises(Exception, match="DuplicateKey"):
        e.commit('Member { member_id: "c", name: "again", team: 1 }.insert()')
    assert ids(e.run("Member")) == ["c", "d"]


def test_no_commit_is_lost(engine, spark, tmp_path, monkeypatch):
    store, other = SnapshotStore(spark, f"file://{tmp_path}"), SnapshotStore(spark, f"file://{tmp_path}")
    e = Engine(spark, "table N { @@n: i64 }", frames={"N": lambda: store.read("N")})
    store.write("N", spark.range(3).toDF("n"))
    parts, second = store.parts, e.change("N { n: 200 }.insert()")

    def late(table, version):  # another writer commits while this one is under way
        found = parts(table, version)
        monkeypatch.setattr(store, "parts", parts)
        other.append(e.change("N { n: 100 }.insert()"))
        return found

    monkeypatch.setattr(store, "parts", late)
    with pytest.raises(Conflict):
        store.append(second)
    store.append(e.change("N { n: 200 }.insert()"))
    assert sorted(r.n for r in store.read("N").collect()) == [0, 1, 2, 100, 200]
    assert sorted(x.name for x in (tmp_path / "N/versions").iterdir() if x.name[0] != ".") == ["1", "2", "3"]
