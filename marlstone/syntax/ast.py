"""Nodes of programs and declarations.  ``tree`` gives a node as plain data
without spans, for comparison."""

from __future__ import annotations

from dataclasses import dataclass, field, fields, is_dataclass
from typing import Any

from .lexer import Span

_NOWHERE = (0, 0)


@dataclass
class Node:
    span: Span = field(default=_NOWHERE, kw_only=True)


# Types
@dataclass
class Named(Node):
    path: list[str]


@dataclass
class Reference(Node):
    target: Node


@dataclass
class Optional(Node):
    inner: Node


@dataclass
class ListOf(Node):
    item: Node


@dataclass
class Generic(Node):
    path: list[str]
    arguments: list[Any]  # types, or literals as text


# Expressions
@dataclass
class Name(Node):
    name: str


@dataclass
class Literal(Node):
    kind: str  # Int, Float, String, Bool, Null
    value: Any


@dataclass
class Member(Node):
    receiver: Node
    name: str
    sep: str  # Dot, ColonColon


@dataclass
class Call(Node):
    callee: Node
    args: list[Node]


@dataclass
class Lambda(Node):
    params: list[str]
    body: Node


@dataclass
class Binary(Node):
    op: str
    left: Node
    right: Node


@dataclass
class Unary(Node):
    op: str
    operand: Node


@dataclass
class Item(Node):
    name: str  # "*" for a spread
    value: Node | None


@dataclass
class StructProj(Node):
    receiver: Node
    items: list[Item]


@dataclass
class TypedObject(Node):
    type: list[str]
    fields: list[Item]


@dataclass
class AnonObject(Node):
    fields: list[Item]


@dataclass
class ListLit(Node):
    items: list[Node]


@dataclass
class Try(Node):
    operand: Node


@dataclass
class Let(Node):
    name: str
    type: Node | None
    value: Node


@dataclass
class Program(Node):
    micros: list["Operation"]
    statements: list[Node]
    result: Node | None


# Declarations
@dataclass
class Attribute(Node):
    syntax: str  # "@@", "@", "[]"
    names: list[str]
    arguments: list[str]
    has_arguments: bool = False


@dataclass
class Field(Node):
    name: str
    type: Node
    attributes: list[Attribute]
    default: str | None
    name_span: Span = _NOWHERE


@dataclass
class Record(Node):
    kind: str  # table, class
    name: str
    fields: list[Field]
    attributes: list[Attribute]
    name_span: Span = _NOWHERE


@dataclass
class Choice(Node):
    name: str
    value: int
    attributes: list[Attribute]


@dataclass
class Choices(Node):
    kind: str  # enums, flags
    name: str
    members: list[Choice]
    attributes: list[Attribute]


@dataclass
class Union(Node):
    name: str
    tag: Node
    variants: list[Record]
    attributes: list[Attribute]


@dataclass
class Param(Node):
    name: str
    type: Node


@dataclass
class Operation(Node):
    kind: str  # query, udf, micro, macro
    name: str
    params: list[Param]
    returns: Node | None
    body: Program | None
    body_text: str = ""
    body_span: Span = _NOWHERE


@dataclass
class Service(Node):
    name: str
    methods: list[Operation]
    attributes: list[Attribute]


@dataclass
class Path(Node):
    kind: str  # namespace, using
    path: list[str]


@dataclass
class Obsolete(Node):
    kind: str  # field, table
    path: list[str]


@dataclass
class Const(Node):
    name: str
    type: Node
    value: str


@dataclass
class Document(Node):
    source: str
    declarations: list[Node]


def tree(x: Any) -> Any:
    if is_dataclass(x):
        return {"node": type(x).__name__} | {f.name: tree(getattr(x, f.name)) for f in fields(x) if not f.name.endswith("span") and f.name not in ("body_text", "source")}
    return [tree(i) for i in x] if isinstance(x, list) else x
