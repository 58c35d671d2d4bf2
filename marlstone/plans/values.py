"""What expressions mean while a program is lowered: lazy, nothing runs."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..catalog.types import Model, TypeInfo
from ..syntax import ast
from ..syntax.lexer import Span, SyntaxFault


class BindError(SyntaxFault):
    """A name, type or use that doesn't fit the model."""


def col(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


@dataclass
class Scalar:
    column: Column
    type: TypeInfo | None = None  # of a reference: its target
    path: tuple[str, ...] = ()  # of a reference: the fields that lead here
    name: str | None = None
    known: tuple[Any, ...] = ()  # the value, where it is known while lowering
    entity: "Rows | None" = None  # of a field of one row that was got by key: that row


@dataclass
class Rows:
    """A lazy collection.  ``df`` holds the visible columns, and behind them, under
    reserved names, sort keys and the columns of references that are joined."""

    df: DataFrame
    columns: list[str]
    type: TypeInfo | None = None
    keys: list[str] = field(default_factory=list)  # sort keys, in order
    sorted: bool = True  # rows still are in the order of ``keys``
    joined: dict[tuple[str, ...], str] = field(default_factory=dict)
    base: DataFrame | None = None  # the whole table, while rows are just filtered
    where: list[Callable[["Rows"], Column]] = field(default_factory=list)
    one: bool = False
    must: bool = False
    tie: list[str] = field(default_factory=list)  # hidden columns that tell rows of equal sort keys apart
    made: bool = False  # rows are constructed, not stored

    def frame(self) -> DataFrame:
        """The visible columns, in order."""
        df = self.df if not self.keys or self.sorted else self.df.orderBy(*[col(k).asc_nulls_last() for k in self.keys])
        if self.must:
            df = required(df)
        return df.select(*map(col, self.columns)) if df.columns != self.columns else df

    def hidden(self) -> list[str]:
        return [*self.keys, *(c for c in self.tie if c not in self.keys)]

    def fork(self, **changes: Any) -> "Rows":
        return replace(self, joined=dict(self.joined), keys=list(self.keys), **changes)


def found(n: Column) -> Column:
    """True; where the count ``n`` is zero, the action fails."""
    return F.when(n == 0, F.raise_error(F.lit("NotFound")).cast("boolean")).otherwise(F.lit(True))


def required(df: DataFrame) -> DataFrame:
    """The row of ``df``, which has one at most; the action fails if it has none.

    Row and count are one aggregate, so the table is read once and not joined."""
    one = df.limit(1).agg(F.count(F.lit(1)).alias("__n"), F.first(F.struct(*map(col, df.columns))).alias("__row"))
    return one.where(found(F.col("__n"))).select(*[F.col("__row").getField(c).alias(c) for c in df.columns])


@dataclass
class Row:
    """The row that a lambda's parameter stands for."""

    rows: Rows
    type: TypeInfo | None
    prefix: str = ""
    path: tuple[str, ...] = ()


@dataclass
class Objects:
    """Constructed values that aren't stored: rows of constants."""

    type: TypeInfo
    rows: list[dict[str, Any]]
    many: bool


@dataclass
class Shape:
    """An object's fields; of an enum or flags, its members."""

    fields: dict[str, Any]
    choices: ast.Choices | None = None


@dataclass
class Function:
    operation: ast.Operation


@dataclass
class Closure:
    params: list[str]
    body: ast.Node
    scope: Any


@dataclass
class Change:
    """A mutation: the table's new state, and the rows that it is about (as they
    are afterwards; of a deletion, as they were)."""

    table: TypeInfo
    state: DataFrame
    affected: DataFrame
    one: bool = False

    def count(self) -> DataFrame:
        return self.affected.agg(F.count(F.lit(1)).alias("affected"))


def fail(message: str, span: Span) -> BindError:
    return BindError(message, span)


__all__ = ["BindError", "Change", "Closure", "Function", "Model", "Objects", "Row", "Rows", "Scalar", "Shape", "col", "fail", "found", "required"]
