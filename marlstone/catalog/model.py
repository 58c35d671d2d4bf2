"""Catalog artifacts as plain data, their versions, and strict readers.

An artifact's version names start with a prefix, ``Versions(prefix)``, so that a
catalog can read and write artifacts of hosts that use another one."""

from __future__ import annotations

import json
from dataclasses import dataclass
from typing import Any

from ..syntax import ast
from ..syntax.lexer import Span


@dataclass(frozen=True)
class Problem:
    code: str
    message: str
    span: Span | None = None
    hint: str | None = None


class Rejected(ValueError):
    """One or more problems; nothing was produced."""

    def __init__(self, problems: list[Problem]):
        super().__init__("; ".join(f"{p.code}: {p.message}" for p in problems))
        self.problems = problems

    @property
    def codes(self) -> list[str]:
        return [p.code for p in self.problems]


@dataclass(frozen=True)
class Versions:
    prefix: str = "marlstone"

    def __getattr__(self, name: str) -> str:
        tails = {"contract": "contract-v0", "language": "language-v0", "canonical": "canonical-v0", "operation": "operation-contract-v0", "manifest": "identity-manifest-v0", "fingerprint": "identity-fingerprint-v0", "history": "identity-history-v0", "resolved": "resolved-contract-v1"}
        if name not in tails:
            raise AttributeError(name)
        return f"{self.prefix}-{tails[name]}"


OWN = Versions()
SCALARS = set("bool bytes date datetime decimal f32 f64 i8 i16 i32 i64 time u8 u16 u32 u64 utf8 utf16 uuid".split())
ALIASES = {"d128": "decimal"}
GENERICS = {"vector", "list", "stream"}


def canonical_type(t: ast.Node) -> dict:
    if isinstance(t, ast.Named):
        return {"named": t.path}
    if isinstance(t, ast.Reference):
        return {"reference": canonical_type(t.target)}
    if isinstance(t, ast.Optional):
        return {"optional": canonical_type(t.inner)}
    if isinstance(t, ast.ListOf):
        return {"list": canonical_type(t.item)}
    if isinstance(t, ast.Generic):
        return {"generic": {"path": t.path, "arguments": [{"literal": a} if isinstance(a, str) else {"type": canonical_type(a)} for a in t.arguments]}}
    raise TypeError(t)


def type_text(t: dict) -> str:
    """A canonical or resolved type as it is written."""
    (tag, x), = t.items()
    if tag in ("named", "builtin"):
        return "::".join(x)
    if tag == "user":
        return "::".join(x["path"])
    if tag == "reference":
        return "&" + type_text(x)
    if tag == "optional":
        return type_text(x) + "?"
    if tag == "list":
        return f"[{type_text(x)}]"
    return "::".join(x["path"]) + "<" + ", ".join(a["literal"] if "literal" in a else type_text(a["type"]) for a in x["arguments"]) + ">"


def to_json(artifact: Any) -> str:
    return json.dumps(artifact, indent=2, ensure_ascii=False)


_ID, _SLOT, _TEXT, _PATH, _KIND = "id", "slot?", "text", "path", "kind"
_ATTRS, _TYPE, _SPAN = ["attribute"], "type", {"start": "number", "end": "number"}
_IDENTITY = {"canonicalPath": _PATH, "typeId": _ID, "kind": _KIND, "fields": [{"canonicalName": _TEXT, "fieldId": _ID, "virtualFieldIndex": _SLOT}]}
_BOUND = {"typeId": _ID, "canonicalPath": _PATH, "kind": _KIND, "fields": [{"fieldId": _ID, "virtualFieldIndex": _SLOT, "canonicalName": _TEXT, "canonicalType": _TYPE, "attributes": _ATTRS, "defaultValue": "text?"}]}
SHAPES: dict[str, Any] = {
    "manifest": {"formatVersion": _TEXT, "types": [_IDENTITY]},
    "bound": {"manifestVersion": _TEXT, "types": [_BOUND]},
    "resolved": {"formatVersion": _TEXT, "identityManifestVersion": _TEXT, "schemaFingerprint": _TEXT, "types": [_BOUND]},
    "history": {
        "formatVersion": _TEXT, "manifestVersion": _TEXT, "revision": "number", "layoutEpoch": "number", "snapshot": {"manifestVersion": _TEXT, "types": [_BOUND]},
        "retiredTypes": [{"typeId": _ID, "canonicalPath": _PATH, "retiredAtRevision": "number"}],
        "retiredFields": [{"fieldId": _ID, "typeId": _ID, "canonicalName": _TEXT, "virtualFieldIndex": _SLOT, "retiredAtRevision": "number"}],
    },
    "contract": {
        "envelope": {"stage": _TEXT, "contractFormatVersion": _TEXT, "languageVersion": _TEXT, "canonicalizationVersion": _TEXT, "schemaFingerprint": "text?", "sourceUnits": [{"sourceUnitId": "number", "source": _TEXT}]},
        "types": [{"canonicalPath": _PATH, "kind": _KIND, "fields": [{"canonicalName": _TEXT, "canonicalType": _TYPE, "attributes": _ATTRS, "defaultValue": "text?", "span": _SPAN}], "span": _SPAN}],
    },
    "operations": {
        "envelope": {"stage": _TEXT, "contractFormatVersion": _TEXT, "languageVersion": _TEXT, "sourceUnits": [{"sourceUnitId": "number", "source": _TEXT}]},
        "operations": [{"kind": _TEXT, "name": _TEXT, "parameters": [{"name": _TEXT, "canonicalType": _TYPE}], "returnType": "type?", "body": {"text": _TEXT, "span": _SPAN}, "identityKey": _TEXT, "span": _SPAN}],
    },
}


def _fits(x: Any, shape: Any, at: str) -> str | None:
    """What is wrong with ``x``, if anything: fields must be those of the shape."""
    if isinstance(shape, dict):
        if not isinstance(x, dict):
            return f"{at}: an object is needed"
        optional = {k for k, s in shape.items() if isinstance(s, str) and s.endswith("?")}
        if extra := x.keys() - shape.keys():
            return f"{at}: unknown field {min(extra)}"
        if lost := shape.keys() - x.keys() - optional:
            return f"{at}: missing field {min(lost)}"
        return next((p for k, s in shape.items() if k in x and (p := _fits(x[k], s, f"{at}.{k}"))), None)
    if isinstance(shape, list):
        return f"{at}: a list is needed" if not isinstance(x, list) else next((p for i, v in enumerate(x) if (p := _fits(v, shape[0], f"{at}[{i}]"))), None)
    if shape.endswith("?"):
        return None if x is None else _fits(x, shape[:-1], at)
    if shape in (_ID, "slot", "number"):
        return None if isinstance(x, int) and not isinstance(x, bool) and 0 <= x < 1 << 64 else f"{at}: a number is needed"
    if shape == "path":
        return None if isinstance(x, list) and all(isinstance(i, str) for i in x) else f"{at}: a path is needed"
    if shape in ("type", "attribute"):
        return None if isinstance(x, dict) else f"{at}: an object is needed"
    if shape == "kind":
        return None if x in ("table", "class") else f"{at}: table or class is needed"
    return None if isinstance(x, str) else f"{at}: text is needed"


_UNREADABLE = {"manifest": "ID011", "history": "ID020", "resolved": "RES010", "contract": "ART001", "operations": "OPR010", "bound": "ID011"}


def read(kind: str, text: str) -> dict:
    """An artifact from JSON; unknown or missing fields are refused."""
    try:
        x = json.loads(text)
    except ValueError as e:
        raise Rejected([Problem(_UNREADABLE[kind], str(e))]) from None
    if p := _fits(x, SHAPES[kind], "artifact"):
        raise Rejected([Problem(_UNREADABLE[kind], p)])
    return x
