"""Scalar functions of the language, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def trim(s: Column) -> Column:
    """Without the spaces around it (spaces only, as in SQL)."""
    return F.trim(s)


def lower(s: Column) -> Column:
    return F.lower(s)


def now() -> Column:
    """The time of the query, the same in all its rows."""
    return F.current_timestamp()


def uuid7() -> Column:
    """A version-7 id: 48 bits of the query's time, the rest from Spark's own
    random ids, whose variant bits are right already.  The value is not the same
    when computed again, so store rows before using them twice."""
    time = F.lpad(F.lower(F.hex(F.unix_millis(F.current_timestamp()))), 12, "0")
    r = F.uuid()
    return F.concat(F.substring(time, 1, 8), F.lit("-"), F.substring(time, 9, 4), F.lit("-7"), F.substring(r, 16, 21))


def is_v7(s: Column) -> Column:
    return s.rlike("^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-7[0-9a-fA-F]{3}-[89abAB][0-9a-fA-F]{3}-[0-9a-fA-F]{12}$")


def enum_name(code: Column, names: dict[int, str]) -> Column:
    """The name of an enum's value; null for none."""
    pairs = [x for k, v in names.items() for x in (F.lit(k), F.lit(v))]
    return F.element_at(F.create_map(*pairs), code.cast("int")) if pairs else F.lit(None).cast("string")


def has_flag(bits: Column, mask: Column | int) -> Column:
    """Whether all bits of ``mask`` are set."""
    m = F.lit(mask) if isinstance(mask, int) else mask
    return bits.bitwiseAND(m) == m


#: name -> (function, number of arguments); methods take their receiver first.
METHODS = {"trim": (trim, 1), "lower": (lower, 1), "is_v7": (is_v7, 1), "has": (has_flag, 2)}
FREE = {"now": (now, 0), "uuid": (uuid7, 0), "is_v7": (is_v7, 1)}
