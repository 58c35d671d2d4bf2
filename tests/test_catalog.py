import copy
import json

import pytest

from marlstone.catalog import builder, identity, projection
from marlstone.catalog.model import OWN, Rejected, to_json
from marlstone.catalog.types import Model

USER = "table User { @@id: uuid, @name: utf8, old: i32 }"


def manifest(types):
    return {"formatVersion": OWN.manifest, "types": [{"canonicalPath": p, "typeId": i, "kind": k, "fields": [{"canonicalName": n, "fieldId": f, "virtualFieldIndex": s} for n, f, s in fs]} for p, i, k, fs in types]}


def at(x, *path):
    for p in path:
        x = x[p]
    return x


def types(source):
    return projection.project_schema(projection.parse(source))


def codes(f, *args):
    with pytest.raises(Rejected) as e:
        f(*args)
    return e.value.codes


BASE = [(["User"], 1, "table", [("id", 10, 0), ("name", 11, 1), ("old", 12, 2)])]
bound = identity.bind(types(USER), manifest(BASE))


@pytest.mark.parametrize(
    ("source", "code", "hint"),
    [
        ("table A { x: i32 }", "SCH006", "requires a primary key"),
        ("table A { @@x: i32, @@y: i32 }", "SCH006", "declares 2 primary keys"),
        ("class A { x: i32, x: utf8 }", "SCH003", "duplicate field `x` on class `A`"),
        ("class A { x: i32 } table A { @@x: i32 }", "SCH002", "duplicate type name `A`"),
    ],
)
def test_schema_problems_have_codes_and_hints(source, code, hint):
    p, = projection.check(source)
    assert p.code == code and hint in p.hint and p.span


def test_strict_projection_takes_types_only():
    doc = projection.parse("enums E { A = 1 }")
    assert codes(lambda: projection.project_schema(doc, strict=True)) == ["SCH004"]
    assert projection.project_schema(doc) == []


@pytest.mark.parametrize("attribute", ["[]", "[a, b]", "[tag(\"x\")]"])
def test_attributes_without_canonical_form(attribute):
    assert codes(types, f"class A {{ {attribute} x: i32 }}") == ["SCH005"]


def test_unknown_references_and_types():
    assert codes(Model.of, "class A { x: &Missing }") == ["RES001"]
    assert codes(Model.of, "class A { x: Uuid }") == ["RES001"]


def test_last_namespace_holds():
    assert [t["canonicalPath"] for t in types("namespace a; class X { i: i32 } namespace b::c class Y { i: i32 }")] == [["a", "X"], ["b", "c", "Y"]]


def test_artifacts_round_trip_strictly():
    c = projection.contract(projection.parse(USER))
    assert projection.read_contract(to_json(c)) == c
    assert codes(projection.read_contract, to_json(c | {"more": 1})) == ["ART001"]
    bad = copy.deepcopy(c)
    bad["envelope"]["stage"] = "other"
    assert codes(projection.read_contract, to_json(bad)) == ["ART002"]
    bad = copy.deepcopy(c)
    at(bad, "types", 0, "span")["end"] = 999
    assert codes(projection.read_contract, to_json(bad)) == ["ART004"]


def test_operation_bodies_are_slices():
    o = projection.operations(projection.parse("query q(a: i32) -> [utf8] { a }\nudf f(v: utf8) { v.lower() }"))
    assert [x["identityKey"] for x in o["operations"]] == ["query:q(i32)->[utf8]", "udf:f(utf8)->unit"]
    assert projection.read_operations(to_json(o)) == o
    at(o, "operations", 0, "body")["text"] = "b"
    assert codes(projection.read_operations, to_json(o)) == ["OPR014"]
    assert codes(projection.operations, projection.parse("udf f(a: i32) { a } udf f(b: i32) { b }")) == ["OPR001"]


def test_binding_goes_by_name():
    other = manifest([(p, i, k, fs[::-1]) for p, i, k, fs in BASE])
    assert identity.bind(types(USER), other) == bound


@pytest.mark.parametrize(
    ("change", "code"),
    [
        (lambda m: m.update(formatVersion="x"), "ID001"),
        (lambda m: m.update(types=[]), "ID004"),
        (lambda m: at(m, "types", 0).update(canonicalPath=["Other"]), "ID005"),
        (lambda m: at(m, "types", 0).update(typeId=0), "ID002"),
        (lambda m: at(m, "types", 0, "fields").pop(), "ID006"),
        (lambda m: at(m, "types", 0, "fields").append({"canonicalName": "z", "fieldId": 99, "virtualFieldIndex": None}), "ID007"),
        (lambda m: at(m, "types", 0).update(kind="class"), "ID008"),
        (lambda m: at(m, "types", 0, "fields")[0].update(fieldId=11), "ID009"),
        (lambda m: at(m, "types", 0, "fields")[0].update(canonicalName=""), "ID010"),
    ],
)
def test_bad_manifests(change, code):
    m = manifest(BASE)
    change(m)
    assert code in codes(identity.bind, types(USER), m)


def test_fingerprint_sees_meaning_only():
    same = identity.bind(types("table User { old: i32, @name: utf8, @@id: uuid }"), manifest([(p, i, k, [(n, f, s + 5) for n, f, s in fs]) for p, i, k, fs in BASE]))
    assert identity.fingerprint(same["types"]) == identity.fingerprint(bound["types"])
    other = identity.bind(types(USER.replace("old: i32", "old: i64")), manifest(BASE))
    assert identity.fingerprint(other["types"]) != identity.fingerprint(bound["types"])


def test_resolution_and_reader():
    c = identity.resolve(bound)
    assert identity.read_resolved(to_json(c)) == c
    assert codes(identity.read_resolved, to_json(c | {"schemaFingerprint": "0" * 64})) == ["RES014"]
    assert codes(identity.read_resolved, to_json(c | {"formatVersion": "x"})) == ["RES011"]
    aliases = identity.bind(types("class A { a: d128, b: DateTime<UTC> }"), manifest([(["A"], 1, "class", [("a", 1, None), ("b", 2, None)])]))
    assert [f["canonicalType"] for f in at(identity.resolve(aliases), "types", 0, "fields")] == [{"builtin": ["decimal"]}, {"builtin": ["datetime"]}]
    unknown = identity.bind(types("class A { a: Uuid }"), manifest([(["A"], 1, "class", [("a", 1, None)])]))
    assert codes(identity.resolve, unknown) == ["RES001"]


def test_units_share_a_table_of_types():
    a = identity.bind(types("namespace m; table A { @@id: uuid }"), manifest([(["m", "A"], 1, "table", [("id", 1, 0)])]))
    b = identity.bind(types("namespace m; class B { a: &A, c: m::A }"), manifest([(["m", "B"], 2, "class", [("a", 2, 0), ("c", 3, 1)])]))
    fields = at(identity.resolve([a, b]), "types", 1, "fields")
    assert fields[0]["canonicalType"] == {"reference": {"user": {"path": ["m", "A"], "typeId": 1}}} and fields[1]["canonicalType"]["user"]["typeId"] == 1
    assert set(codes(identity.resolve, [a, a])) == {"RES005", "RES006", "RES007"}


def evolved():
    new = identity.bind(types("table Person { @@id: uuid, title: utf8, extra: i64 }"), manifest([(["Person"], 1, "table", [("id", 10, 0), ("title", 11, 1), ("extra", 13, 3)])]))
    return new, identity.evolve(identity.begin(bound), new)


def test_comparison_lists_changes_in_order():
    new, _ = evolved()
    got = [(c["change"], c.get("fieldId")) for c in identity.compare(bound, new)["changes"]]
    assert got == [("typeRenamed", None), ("fieldRenamed", 11), ("fieldChanged", 11), ("fieldRemoved", 12), ("fieldAdded", 13)]


def test_ids_do_not_move():
    moved = identity.bind(types(USER), manifest([(["User"], 1, "table", [("id", 10, 0), ("name", 11, 7), ("old", 12, 2)])]))
    assert codes(identity.compare, bound, moved) == ["ID027"]
    renumbered = identity.bind(types(USER), manifest([(["User"], 9, "table", [("id", 20, 0), ("name", 21, 1), ("old", 22, 2)])]))
    assert codes(identity.compare, bound, renumbered) == ["ID012"]


def test_history_keeps_tombstones():
    new, h = evolved()
    assert (h["revision"], h["layoutEpoch"], [f["fieldId"] for f in h["retiredFields"]]) == (1, 1, [12])
    assert identity.read_history(to_json(h)) == h
    assert identity.evolve(h, new)["revision"] == 1
    back = copy.deepcopy(new)
    at(back, "types", 0, "fields").append(at(new, "types", 0, "fields", 0) | {"fieldId": 12, "canonicalName": "z", "virtualFieldIndex": 2})
    assert codes(identity.evolve, h, back) == ["ID016", "ID026"]
    gone = identity.evolve(h, {"manifestVersion": OWN.manifest, "types": []})
    assert [t["typeId"] for t in gone["retiredTypes"]] == [1] and [f["fieldId"] for f in gone["retiredFields"]] == [10, 11, 12, 13]
    assert codes(identity.evolve, gone, new)[0] == "ID015"
    bad = copy.deepcopy(h)
    bad["retiredFields"][0]["fieldId"] = 10
    assert codes(identity.read_history, to_json(bad)) == ["ID023"]


def test_tool_envelope():
    x = projection.catalog_json("table A { x: i32 }")
    assert not x["ok"] and json.dumps(x) and x["diagnostics"][0]["code"] == "SCH006"


def test_builder_gives_the_same_model():
    v = builder
    made = v.module("m", v.table("User", id=v.uuid().primary(), name=v.utf8().unique(), boss=v.ref("User").optional(), tags=v.list_of(v.utf8()), v=v.vector(8)))
    text = "namespace m; table User { @@id: uuid, @name: utf8, boss: &User?, tags: [utf8], v: vector<8> }"
    strip = lambda ts: [{k: x for k, x in t.items() if k != "span"} | {"fields": [{k: x for k, x in f.items() if k != "span"} for f in t["fields"]]} for t in ts]
    assert strip(types(made)) == strip(types(text))
    for bad in (lambda: v.table("X", a=v.i32()), lambda: v.vector(0), lambda: v.table("1x", a=v.i32().primary())):
        with pytest.raises(ValueError):
            bad()


def test_difference_knows_types_without_fields(spark):
    from marlstone.catalog import frames

    def snapshot(source, ids):
        return identity.bind(types(source), manifest([([n], i, "class", [(f, 10 * i + k, k) for k, f in enumerate(fs)]) for n, i, fs in ids]))

    old = snapshot("class A { } class B { } class C { x: i32 }", [("A", 1, []), ("B", 2, []), ("C", 3, ["x"])])
    new = snapshot("class A2 { } class C { } class D { }", [("A2", 1, []), ("C", 3, []), ("D", 4, [])])
    got = frames.difference(frames.fields(spark, old), frames.fields(spark, new)).collect()
    assert sorted(map(tuple, got), key=str) == sorted([("fieldRemoved", 3, 30), ("typeRemoved", 2, None), ("typeAdded", 4, None), ("typeRenamed", 1, None)], key=str)
