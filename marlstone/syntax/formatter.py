"""Formatting: ``preserve`` gives a valid source back as it is, ``canonical`` prints
declarations in one layout.  Canonical text has no comments."""

from __future__ import annotations

from . import ast
from .parser import parse_document


def preserve(source: str) -> str:
    parse_document(source)
    return source


def type_of(t: ast.Node) -> str:
    if isinstance(t, ast.Optional):
        return type_of(t.inner) + "?"
    if isinstance(t, ast.Reference):
        return "&" + type_of(t.target)
    if isinstance(t, ast.ListOf):
        return f"[{type_of(t.item)}]"
    if isinstance(t, ast.Generic):
        return "::".join(t.path) + "<" + ", ".join(a if isinstance(a, str) else type_of(a) for a in t.arguments) + ">"
    return "::".join(t.path)


def _mark(a: ast.Attribute) -> str:
    if a.syntax != "[]":
        return a.syntax
    return "[" + ", ".join(a.names) + (f"({', '.join(a.arguments)})" if a.has_arguments else "") + "] "


def _marks(x) -> str:
    return "".join(map(_mark, x))


def _block(head: str, lines: list[str]) -> str:
    return head + " {\n" + "".join(f"    {x},\n".replace("\n    ", "\n        ") if "\n" in x else f"    {x},\n" for x in lines) + "}"


def _field(f: ast.Field) -> str:
    return f"{_marks(f.attributes)}{f.name}: {type_of(f.type)}" + (f" = {f.default}" if f.default is not None else "")


def _params(ps: list[ast.Param]) -> str:
    return "(" + ", ".join(f"{p.name}: {type_of(p.type)}" for p in ps) + ")"


def _one(d: ast.Node) -> str:
    if isinstance(d, ast.Path):
        return f"{d.kind} {'::'.join(d.path)};"
    if isinstance(d, ast.Record):
        return _block(f"{_marks(d.attributes)}{d.kind} {d.name}", list(map(_field, d.fields)))
    if isinstance(d, ast.Choices):
        return _block(f"{_marks(d.attributes)}{d.kind} {d.name}", [f"{_marks(m.attributes)}{m.name} = {m.value}" for m in d.members])
    if isinstance(d, ast.Union):
        variants = [f"{_marks(v.attributes)}{v.name} {{ {', '.join(map(_field, v.fields))} }}" for v in d.variants]
        return _block(f"{_marks(d.attributes)}union {d.name}({type_of(d.tag)})", variants)
    if isinstance(d, ast.Obsolete):
        return f"obsolete {d.kind} {'.'.join(d.path)};"
    if isinstance(d, ast.Const):
        return f"const {d.name}: {type_of(d.type)} = {d.value};"
    if isinstance(d, ast.Service):
        return _block(f"{_marks(d.attributes)}service {d.name}", [m.name + _params(m.params) + (f" -> {type_of(m.returns)}" if m.returns else "") for m in d.methods])
    head = f"{d.kind} {d.name}{_params(d.params)}" + (f" -> {type_of(d.returns)}" if d.returns else "")
    return head + " {\n    " + d.body_text.strip() + "\n}"


def canonical(source: str) -> str:
    return "\n\n".join(map(_one, parse_document(source).declarations)) + "\n"
