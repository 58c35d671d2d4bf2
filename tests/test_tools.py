import json

import pytest
from pyspark.sql import types as T

from marlstone import tools
from marlstone.catalog.emit import emit
from marlstone.catalog.types import Model

SOURCE = "enums E { A = 1 }\nclass P { x: i32 } table T { @@id: uuid, e: E, p: P, tags: [utf8?], v: vector<3>, d: decimal?, up: &T?, big: u64 }"


def test_emitted_module_has_the_schemas():
    m, names = Model.of(SOURCE), {}
    exec(emit(m), names)
    for t in m.types.values():
        assert names[t.name.upper() + "_SCHEMA"] == m.schema(t) and all(a.metadata == b.metadata for a, b in zip(names[t.name.upper() + "_SCHEMA"], m.schema(t)))


@pytest.mark.parametrize(("source", "code"), [("table A { x: i32 }", "SCH006"), ("class A {", "SCH001"), ("class A { x: Uuid }", "RES001"), ("class A { x: &B }", "RES001"), (SOURCE, None)])
def test_check(source, code):
    x = json.loads(tools.check(source))
    assert (x["ok"], [d["code"] for d in x["diagnostics"]]) == (code is None, [code] if code else [])


def test_format_and_catalog():
    x = json.loads(tools.format("class A{x:i32}"))
    assert x["formatted"] == "class A {\n    x: i32,\n}\n" and json.loads(tools.format(x["formatted"]))["formatted"] == x["formatted"]
    bad = json.loads(tools.format("class A {"))
    assert not bad["ok"] and bad["formatted"] == "class A {"
    assert json.loads(tools.format("class A{}", "preserve"))["formatted"] == "class A{}"
    assert [t["canonicalPath"] for t in json.loads(tools.catalog("namespace n; class A { x: i32 }"))["types"]] == [["n", "A"]] and not json.loads(tools.catalog("x"))["ok"]
