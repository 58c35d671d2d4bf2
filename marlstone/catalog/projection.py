"""From declarations to schema and operation projections."""

from __future__ import annotations

from ..syntax import ast
from ..syntax.lexer import SyntaxFault
from ..syntax.parser import OPERATIONS, parse_document
from .model import OWN, Problem, Rejected, Versions, canonical_type, read, to_json, type_text


def _span(n: tuple[int, int]) -> dict:
    return {"start": n[0], "end": n[1]}


def _units(*docs: ast.Document) -> list[dict]:
    return [dict(sourceUnitId=i, source=d.source) for i, d in enumerate(docs)]


def _attribute(a: ast.Attribute) -> dict:
    if a.syntax == "[]" and (len(a.names) != 1 or a.has_arguments):
        raise Rejected([Problem("SCH005", "attribute groups, arguments and empty brackets have no canonical form", a.span)])
    return {"name": a.names[0], "syntax": {"@@": "primary", "@": "unique", "[]": "bracket"}[a.syntax]}


def parse(source: str) -> ast.Document:
    try:
        return parse_document(source)
    except SyntaxFault as e:
        raise Rejected([Problem(getattr(e, "code", "SCH001"), e.message, e.span)]) from None


def project_schema(doc: ast.Document, strict: bool = False) -> list[dict]:
    """Tables and classes in source order.  A namespace holds for what follows.
    strict: any other declaration is refused (SCH004); else it is left out."""
    namespace: list[str] = []
    out, seen, problems = [], set(), []
    for d in doc.declarations:
        if isinstance(d, ast.Path) and d.kind == "namespace":
            namespace = d.path
        elif isinstance(d, ast.Record):
            path = [*namespace, d.name]
            if tuple(path) in seen:
                problems.append(Problem("SCH002", "duplicate type declaration", d.name_span, f"duplicate type name `{d.name}`"))
                continue
            seen.add(tuple(path))
            fields, names = [], set()
            try:
                for f in d.fields:
                    if f.name in names:
                        problems.append(Problem("SCH003", "duplicate field declaration", f.name_span, f"duplicate field `{f.name}` on {d.kind} `{d.name}`"))
                        continue
                    names.add(f.name)
                    fields.append({"canonicalName": f.name, "canonicalType": canonical_type(f.type), "attributes": [_attribute(a) for a in f.attributes], "defaultValue": f.default, "span": _span(f.span)})
            except Rejected as e:
                problems += e.problems
                continue
            out.append({"canonicalPath": path, "kind": d.kind, "fields": fields, "span": _span(d.span)})
        elif strict:
            problems.append(Problem("SCH004", "only namespaces, tables and classes have a schema projection", d.span))
    if problems:
        raise Rejected(problems)
    return out


def contract(doc: ast.Document, versions: Versions = OWN) -> dict:
    envelope = {"stage": "syntax-projection", "contractFormatVersion": versions.contract, "languageVersion": versions.language, "canonicalizationVersion": versions.canonical, "schemaFingerprint": None, "sourceUnits": _units(doc)}
    return {"envelope": envelope, "types": project_schema(doc, strict=True)}


def read_contract(text: str, versions: Versions = OWN) -> dict:
    x = read("contract", text)
    e = x["envelope"]
    if (e["stage"], e["contractFormatVersion"], e["languageVersion"], e["canonicalizationVersion"]) != ("syntax-projection", versions.contract, versions.language, versions.canonical):
        raise Rejected([Problem("ART002", "unsupported stage or version")])
    if e["schemaFingerprint"] is not None or [u["sourceUnitId"] for u in e["sourceUnits"]] != list(range(len(e["sourceUnits"]))):
        raise Rejected([Problem("ART003", "a syntax projection has no fingerprint, and its units are numbered")])
    most = max((len(u["source"].encode()) for u in e["sourceUnits"]), default=0)
    for t in x["types"]:
        for s in (t["span"], *(f["span"] for f in t["fields"])):
            if not s["start"] <= s["end"] <= most:
                raise Rejected([Problem("ART004", "span outside the source", (s["start"], s["end"]))])
    return x


def is_primary(field: dict) -> bool:
    return any(a["name"] == "primary" for a in field["attributes"])


def check_keys(types: list[dict]) -> list[Problem]:
    """Each table must have one primary field."""
    out = []
    for t in types:
        n = sum(map(is_primary, t["fields"]))
        if t["kind"] == "table" and n != 1:
            name = "::".join(t["canonicalPath"])
            hint = f"table `{name}` requires a primary key" if not n else f"table `{name}` declares {n} primary keys"
            out.append(Problem("SCH006", f"table {name} requires exactly one primary field", (t["span"]["start"], t["span"]["end"]), hint))
    return out


def check(source: str) -> list[Problem]:
    """Problems of a schema source; none: it is valid.  Never raises."""
    try:
        return check_keys(project_schema(parse(source), strict=False))
    except Rejected as e:
        return e.problems


def identity_key(op: ast.Operation) -> str:
    """kind:name(types)->result: parameter names and the namespace play no part."""
    types = ",".join(type_text(canonical_type(p.type)) for p in op.params)
    return f"{op.kind}:{op.name}({types})->{type_text(canonical_type(op.returns)) if op.returns else 'unit'}"


def operations(doc: ast.Document, versions: Versions = OWN) -> dict:
    found, keys = [], set()
    for d in doc.declarations:
        if isinstance(d, ast.Operation) and d.kind in OPERATIONS:
            key = identity_key(d)
            if key in keys:
                raise Rejected([Problem("OPR001", f"duplicate operation {key}", d.span)])
            keys.add(key)
            found.append({"kind": d.kind, "name": d.name, "parameters": [{"name": p.name, "canonicalType": canonical_type(p.type)} for p in d.params], "returnType": canonical_type(d.returns) if d.returns else None, "body": {"text": d.body_text, "span": _span(d.body_span)}, "identityKey": key, "span": _span(d.span)})
    envelope = {"stage": "operation-syntax-projection", "contractFormatVersion": versions.operation, "languageVersion": versions.language, "sourceUnits": _units(doc)}
    return {"envelope": envelope, "operations": found}


def read_operations(text: str, versions: Versions = OWN) -> dict:
    """Strict: each body must be the very slice of the source that it claims."""
    x = read("operations", text)
    e = x["envelope"]
    if (e["stage"], e["contractFormatVersion"], e["languageVersion"]) != ("operation-syntax-projection", versions.operation, versions.language):
        raise Rejected([Problem("OPR011", "unsupported stage or version")])
    if [u["sourceUnitId"] for u in e["sourceUnits"]] != [0]:
        raise Rejected([Problem("OPR012", "one source unit is needed")])
    source, keys = e["sourceUnits"][0]["source"].encode(), set()
    for o in x["operations"]:
        if o["identityKey"] in keys or o["kind"] not in OPERATIONS:
            raise Rejected([Problem("OPR013", "duplicate or unknown operation")])
        keys.add(o["identityKey"])
        for s in (o["span"], o["body"]["span"]):
            if not s["start"] <= s["end"] <= len(source):
                raise Rejected([Problem("OPR015", "span outside the source")])
        s = o["body"]["span"]
        if source[s["start"] : s["end"]].decode(errors="replace") != o["body"]["text"]:
            raise Rejected([Problem("OPR014", "a body isn't its slice of the source")])
    return x


def catalog_json(source: str) -> dict:
    """{ok, diagnostics, types}: the whole catalog of a source for tools."""
    try:
        types = project_schema(parse(source))
    except Rejected as e:
        return {"ok": False, "diagnostics": [{"code": p.code, "message": p.message, "span": p.span, "hint": p.hint} for p in e.problems], "types": []}
    problems = check_keys(types)
    return {"ok": not problems, "diagnostics": [{"code": p.code, "message": p.message, "span": p.span, "hint": p.hint} for p in problems], "types": types}


__all__ = ["catalog_json", "check", "contract", "identity_key", "is_primary", "operations", "parse", "project_schema", "read_contract", "read_operations", "to_json"]
