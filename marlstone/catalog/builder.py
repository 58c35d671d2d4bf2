"""Types declared in Python.  A builder prints the language, so that there is one
way into the catalog:

    v.module("shop", v.table("Item", id=v.uuid().primary(), name=v.utf8()))
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from .model import SCALARS


@dataclass(frozen=True)
class Typed:
    """A field's type with its marks, in the order they were given."""

    text: str
    marks: tuple[str, ...] = field(default=())
    value: str | None = None

    def optional(self) -> Typed:
        return replace(self, text=self.text + "?")

    def primary(self) -> Typed:
        return replace(self, marks=(*self.marks, "@@"))

    def unique(self) -> Typed:
        return replace(self, marks=(*self.marks, "@"))

    def attribute(self, name: str, *args: object) -> Typed:
        given = ", ".join('"' + str(a).replace("\\", "\\\\").replace('"', '\\"') + '"' for a in args)
        return replace(self, marks=(*self.marks, f"[{name}({given})] " if args else f"[{name}] "))

    def default(self, source: str) -> Typed:
        return replace(self, value=source)


def _name(name: str) -> str:
    if not name.isidentifier() or not name.isascii():
        raise ValueError(f"no name: {name}")
    return name


def __getattr__(name: str):
    """A builder for each scalar type: ``i32()``, ``utf8()``, ``uuid()`` and so on."""
    if name in SCALARS or name == "file":
        return lambda: Typed(name)
    raise AttributeError(name)


def ref(target: str) -> Typed:
    return Typed("&" + _name(target))


def inline(target: str) -> Typed:
    return Typed(_name(target))


def list_of(item: Typed) -> Typed:
    return Typed(f"[{item.text}]")


def vector(size: int) -> Typed:
    if not isinstance(size, int) or size < 1:
        raise ValueError("a vector has a positive number of dimensions")
    return Typed(f"vector<{size}>")


def stream(item: Typed) -> Typed:
    return Typed(f"stream<{item.text}>")


def _record(kind: str, name: str, fields: dict[str, Typed]) -> str:
    lines = [f"    {''.join(t.marks)}{_name(n)}: {t.text}" + (f" = {t.value}" if t.value is not None else "") + ",\n" for n, t in fields.items()]
    return f"{kind} {_name(name)} {{\n{''.join(lines)}}}\n"


def table(name: str, /, **fields: Typed) -> str:
    if sum("@@" in t.marks for t in fields.values()) != 1:
        raise ValueError(f"table {name} needs one primary field")
    return _record("table", name, fields)


def record(name: str, /, **fields: Typed) -> str:
    return _record("class", name, fields)


def _choices(kind: str, name: str, members: dict[str, int]) -> str:
    return f"{kind} {_name(name)} {{\n" + "".join(f"    {_name(k)} = {int(v)},\n" for k, v in members.items()) + "}\n"


def enums(name: str, /, **members: int) -> str:
    return _choices("enums", name, members)


def flags(name: str, /, **members: int) -> str:
    return _choices("flags", name, members)


def module(namespace: str, *declarations: str) -> str:
    return f"namespace {namespace};\n\n" + "\n".join(declarations)
