"""Source code from a model: a Python module with a Spark schema for each type, for
programs that read the same tables without the engine."""

from __future__ import annotations

from string import Template

from pyspark.sql import types as T

from .types import Model

_MODULE = Template('"""Schemas of $names.  Made from a model; not to be edited."""\n\nfrom pyspark.sql import types as T\n$schemas')
_SCHEMA = Template("\n$constant = T.StructType([\n$fields])\n")
_FIELD = Template("    T.StructField($name, $type, $nullable, $metadata),\n")


def _type(t: T.DataType) -> str:
    if isinstance(t, T.ArrayType):
        return f"T.ArrayType({_type(t.elementType)}, {t.containsNull})"
    if isinstance(t, T.StructType):
        return "T.StructType([" + ", ".join(f"T.StructField({f.name!r}, {_type(f.dataType)}, {f.nullable}, {f.metadata})" for f in t) + "])"
    if isinstance(t, T.DecimalType):
        return f"T.DecimalType({t.precision}, {t.scale})"
    return f"T.{type(t).__name__}()"


def emit(model: Model) -> str:
    schemas = []
    for t in model.types.values():
        fields = [_FIELD.substitute(name=repr(f.name), type=_type(f.dataType), nullable=f.nullable, metadata=f.metadata) for f in model.schema(t)]
        schemas.append(_SCHEMA.substitute(constant=t.name.upper() + "_SCHEMA", fields="".join(fields)))
    return _MODULE.substitute(names=", ".join(model.types), schemas="".join(schemas))
