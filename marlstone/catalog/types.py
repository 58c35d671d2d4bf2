"""Declared types as Spark types, and the model that programs are bound against."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import types as T

from ..syntax import ast
from . import projection
from .model import ALIASES, GENERICS, SCALARS, Problem, Rejected, canonical_type

_SPARK: dict[str, T.DataType] = {
    "i8": T.ByteType(), "i16": T.ShortType(), "i32": T.IntegerType(), "i64": T.LongType(),
    "u8": T.ShortType(), "u16": T.IntegerType(), "u32": T.LongType(), "u64": T.DecimalType(20, 0),
    "f32": T.FloatType(), "f64": T.DoubleType(), "bool": T.BooleanType(), "utf8": T.StringType(), "utf16": T.StringType(), "uuid": T.StringType(),
    "decimal": T.DecimalType(38, 18), "date": T.DateType(), "time": T.LongType(), "datetime": T.TimestampType(), "bytes": T.BinaryType(),
}
FILE = T.StructType([T.StructField("identity", T.StringType(), False), T.StructField("manifestGeneration", T.LongType(), False), T.StructField("length", T.DecimalType(20, 0), False)])
#: Values that a widened unsigned type may hold.
RANGES = {"u8": (0, 255), "u16": (0, 65535), "u32": (0, (1 << 32) - 1), "u64": (0, (1 << 64) - 1)}


@dataclass
class FieldInfo:
    name: str
    type: dict  # canonical
    primary: bool = False
    unique: bool = False
    default: str | None = None

    @property
    def optional(self) -> bool:
        return "optional" in self.type

    @property
    def inner(self) -> dict:
        return self.type["optional"] if self.optional else self.type

    @property
    def target(self) -> list[str] | None:
        """The referenced type's path, if the field is a reference."""
        return self.inner["reference"]["named"] if "reference" in self.inner else None

    @property
    def scalar(self) -> str | None:
        t = self.inner
        return ALIASES.get(t["named"][0], t["named"][0]) if "named" in t and len(t["named"]) == 1 else None


@dataclass
class TypeInfo:
    path: list[str]
    kind: str
    fields: list[FieldInfo]

    @property
    def name(self) -> str:
        return self.path[-1]

    @property
    def key(self) -> FieldInfo | None:
        return next((f for f in self.fields if f.primary), None)

    def field(self, name: str) -> FieldInfo | None:
        return next((f for f in self.fields if f.name == name), None)


@dataclass
class Model:
    """Everything that a set of documents declares."""

    types: dict[str, TypeInfo] = field(default_factory=dict)
    choices: dict[str, ast.Choices] = field(default_factory=dict)
    unions: dict[str, ast.Union] = field(default_factory=dict)
    consts: dict[str, ast.Const] = field(default_factory=dict)
    services: dict[str, ast.Service] = field(default_factory=dict)
    operations: dict[str, ast.Operation] = field(default_factory=dict)
    obsolete: set[tuple[str, ...]] = field(default_factory=set)

    @classmethod
    def of(cls, *sources: str) -> Model:
        out, problems = cls(), []
        for source in sources:
            doc = projection.parse(source)
            projected = projection.project_schema(doc)
            problems += projection.check_keys(projected)
            for t in projected:
                fields = [FieldInfo(f["canonicalName"], f["canonicalType"], projection.is_primary(f), any(a["name"] == "unique" for a in f["attributes"]), f["defaultValue"]) for f in t["fields"]]
                out.types[t["canonicalPath"][-1]] = TypeInfo(t["canonicalPath"], t["kind"], fields)
            for d in doc.declarations:
                if isinstance(d, ast.Choices):
                    values = [m.value for m in d.members]
                    if len(set(values)) < len(values) or d.kind == "flags" and any(v < 1 or v & v - 1 for v in values):
                        problems.append(Problem("SCH007", f"values of {d.kind} {d.name} must be distinct" + ", powers of two" * (d.kind == "flags"), d.span))
                    out.choices[d.name] = d
                elif isinstance(d, ast.Union):
                    out.unions[d.name] = d
                elif isinstance(d, ast.Const):
                    out.consts[d.name] = d
                elif isinstance(d, ast.Service):
                    out.services[d.name] = d
                elif isinstance(d, ast.Operation):
                    out.operations[d.name] = d
                elif isinstance(d, ast.Obsolete):
                    out.obsolete.add(tuple(d.path))
        for t in out.types.values():
            for f in t.fields:
                if (t.name, f.name) in out.obsolete or (t.name,) in out.obsolete:
                    problems.append(Problem("SCH008", f"{t.name}.{f.name} is retired and declared"))
                problems += out._type_problems(f.type)
        if problems:
            raise Rejected(problems)
        return out

    def _type_problems(self, t: dict) -> list[Problem]:
        (tag, x), = t.items()
        if tag in ("optional", "list"):
            return self._type_problems(x)
        if tag == "reference":
            target = self.types.get(x["named"][-1]) if "named" in x else None
            name = "::".join(x.get("named", ["?"]))
            return [] if target and target.kind == "table" else [Problem("RES001", f"unknown type {name}", None, f"unknown reference target `{name}`")]
        if tag == "generic":
            return [] if x["path"][-1] in GENERICS or x["path"] == ["DateTime"] else [Problem("RES001", f"unknown generic type {x['path'][-1]}")]
        name = x[-1]
        known = len(x) == 1 and (ALIASES.get(name, name) in SCALARS or name == "file") or name in self.types or name in self.choices or name in self.unions
        return [] if known else [Problem("RES001", f"unknown type {'::'.join(x)}", None, f"unknown type `{'::'.join(x)}`")]

    # Spark types
    def spark(self, t: dict, inside: tuple[str, ...] = ()) -> T.DataType:
        (tag, x), = t.items()
        if tag == "optional":
            return self.spark(x, inside)
        if tag == "list":
            return T.ArrayType(self.spark(x, inside), "optional" in x)
        if tag == "reference":
            target = self.types[x["named"][-1]]
            if not target.key:
                raise Rejected([Problem("RES001", f"{target.name} has no key to refer to")])
            return self.spark(target.key.type, inside)
        if tag == "generic":
            name, args = x["path"][-1], x["arguments"]
            if x["path"] == ["DateTime"]:
                return T.TimestampType()
            if name == "vector" and len(args) == 1 and args[0].get("literal", "").isdigit() and int(args[0]["literal"]) > 0:
                return T.ArrayType(T.FloatType(), False)
            if name in ("list", "stream") and len(args) == 1 and "type" in args[0]:
                return T.ArrayType(self.spark(args[0]["type"], inside), "optional" in args[0]["type"])
            raise Rejected([Problem("RES016", f"no Spark type for {name}")])
        name = x[-1]
        if name in self.types:
            if name in inside:
                raise Rejected([Problem("SCH009", f"class {name} holds itself; Spark has no recursive type")])
            return self.schema(self.types[name], (*inside, name))
        if name in self.choices:
            return T.IntegerType() if self.choices[name].kind == "enums" else T.LongType()
        if name in self.unions:
            u = self.unions[name]
            variants = [T.StructField(v.name, T.StructType([T.StructField(f.name, self.spark(canonical_type(f.type), (*inside, name)), isinstance(f.type, ast.Optional)) for f in v.fields]), True) for v in u.variants]
            return T.StructType([T.StructField("tag", T.IntegerType(), False), *variants])
        return FILE if name == "file" else _SPARK[ALIASES.get(name, name)]

    def schema(self, t: TypeInfo, inside: tuple[str, ...] = ()) -> T.StructType:
        """The Spark schema of a type; what Spark cannot say is in the metadata."""
        out = []
        for f in t.fields:
            meta: dict = {"type": projection.type_text(f.type)}
            if f.primary or f.unique:
                meta["key"] = "primary" if f.primary else "unique"
            if f.target:
                meta["references"] = f.target[-1]
            if "generic" in f.inner and f.inner["generic"]["path"][-1] == "vector":
                meta["dimension"] = int(f.inner["generic"]["arguments"][0]["literal"])
            out.append(T.StructField(f.name, self.spark(f.type, inside), f.optional, meta))
        return T.StructType(out)
