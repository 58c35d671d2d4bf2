import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from marlstone.syntax import ast
from marlstone.syntax.ast import tree
from marlstone.syntax.formatter import canonical, preserve
from marlstone.syntax.lexer import SyntaxFault
from marlstone.syntax.parser import parse_document, parse_program

PROGRAMS = [
    'let a = Account.filter(x => x.open && x.label != "").sort_by(x => x.label)\na.map(x => x.{ id, title: label })',
    "micro tidy(v: utf8) -> utf8 { let t = v.trim() t.lower() } Account.filter(a => tidy(a.label) != null)",
    "let r = Account.get(k)?\nr.update { label: \"x\", seen: now() }",
    "Account.map(x => x.{ *, twice: n * 2 + 1, none: -n % 3 })",
    "[Account { id: 1, tags: [1, 2] }, Account { id: 0x1F }].insert()",
]
DOCUMENTS = [
    "namespace a::b; using c.d\ntable T { @@id: uuid, @name: utf8? = null, boss: &T?, tags: [[utf8]?]?, v: vector<8> }",
    "enums E { A = 1, B = 0x10 } flags F { R = 1, W = 2 } class C { x: i32 = 3 y: DateTime<UTC> }",
    "union U(E) { Left { a: i32 }, Right { b: utf8 } } service S { [get] find(id: uuid) -> C, all() -> stream<C> }",
    "const limit: i32 = 20; obsolete field T.old; obsolete table Gone; query q(a: i32) -> [T] { T.filter(t => t.n > a) }",
    "class 人 { 名: utf8 }",
]


def test_comparison_binds_tighter_than_and():
    e = parse_program('x.a && x.b != ""').result
    assert (e.op, e.right.op) == ("And", "Ne")


def test_postfix_binds_tighter_than_not():
    e = parse_program("!x.active").result
    assert isinstance(e, ast.Unary) and isinstance(e.operand, ast.Member)


def test_separators_differ_in_sep_only():
    a, b = (tree(parse_program(f"Account{s}filter(x => x.open)").result) for s in (".", "::"))
    assert a["callee"].pop("sep") == "Dot" and b["callee"].pop("sep") == "ColonColon" and a == b


def test_update_sugar_is_a_call_with_an_object():
    a, b = parse_program("u.update { n: 1 }").result, parse_program("u.update({ n: 1 })").result
    assert tree(a) == tree(b)


def test_shorthand_has_no_value():
    items = parse_program("x.{ a, b: c, * }").result.items
    assert [(i.name, i.value is None) for i in items] == [("a", True), ("b", False), ("*", True)]


def test_optional_reference_nests():
    f = parse_document("table T { @@id: uuid, r: &T? }").declarations[0].fields[1]
    assert isinstance(f.type, ast.Optional) and isinstance(f.type.inner, ast.Reference)


def test_program_result_is_the_last_expression():
    p = parse_program("let a = 1\na")
    assert len(p.statements) == 1 and p.result.name == "a"
    assert parse_program("let a = 1").result is None


@pytest.mark.parametrize("bad", ["let v = ", "Account.filter(", "a + ", "x => ", "class T {", "a\0b", "let bad = *", "class T { id uuid }"])
def test_incomplete_or_foreign_text_is_refused(bad):
    with pytest.raises(SyntaxFault):
        parse_document(bad) if bad.startswith("class") else parse_program(bad)


def test_durable_operation_needs_a_definition_session():
    with pytest.raises(SyntaxFault) as e:
        parse_program("macro m(v: utf8) -> utf8 { v }\n1")
    assert e.value.code == "DDL-SESSION-REQUIRED"


def test_spans_are_bytes_of_normalised_source():
    d = parse_document("﻿# é\r\nclass T { a: i32 }").declarations[0]
    assert d.span == (5, 23)


@pytest.mark.parametrize("source", DOCUMENTS)
def test_formatting_is_stable_and_keeps_meaning(source):
    once = canonical(source)
    assert canonical(once) == once
    assert tree(parse_document(once).declarations) == tree(parse_document(source).declarations)
    assert preserve(source) == source


@pytest.mark.parametrize("source", PROGRAMS)
def test_programs_parse(source):
    assert parse_program(source).result is not None


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab.(){}[]=>&|!\"1 \n:,?*-", max_size=30))
def test_parser_gives_a_tree_or_a_fault(text):
    try:
        parse_program(text)
    except SyntaxFault as e:
        assert 0 <= e.span[0] <= e.span[1] <= len(text.encode())
