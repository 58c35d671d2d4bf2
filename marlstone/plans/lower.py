"""Programs to DataFrames.  Names and types are settled here; nothing runs.

Helpers (micro, macro, query, udf) are inlined, so Catalyst sees one expression.
A reference is joined where a program reads through it, once for each path, and
not otherwise: Catalyst would keep an unused left join."""

from __future__ import annotations

from dataclasses import replace
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import AtomicType, NullType

from ..catalog.types import Model, TypeInfo
from ..functions import scalar
from ..operators import mutation
from ..sources.tables import Source, checked_rows, literal_rows
from ..syntax import ast
from ..syntax.parser import parse_program
from .values import Change, Closure, Function, Objects, Row, Rows, Scalar, Shape, col, fail, found, required


class Scope:
    def __init__(self, names: dict[str, Any] | None = None, outer: "Scope | None" = None, row: Row | None = None):
        self.names, self.outer, self.row = names or {}, outer, row

    def find(self, name: str) -> Any:
        """Fields of a projection's receiver come first, then lets and parameters."""
        at: Scope | None = self
        while at:
            if at.row and name in _fields(at.row):
                return at.row, name
            if name in at.names:
                return at.names[name]
            at = at.outer
        return None

    def rows_here(self) -> Rows | None:
        at: Scope | None = self
        while at:
            if at.row:
                return at.row.rows
            for v in at.names.values():
                if isinstance(v, Row):
                    return v.rows
            at = at.outer
        return None


def _fields(row: Row) -> list[str]:
    return [f.name for f in row.type.fields] if row.path and row.type else row.rows.columns


def lit(value: Any) -> Column:
    return F.lit(value)


class Lowering:
    """One run of a program over a model and its sources.

    params: values of the program's free names.  Mutations see the state of earlier
    ones, and ``changed`` has the last state of each changed table."""

    def __init__(self, model: Model, source: Source, params: dict[str, Any] | None = None):
        self.model, self.source, self.changed = model, source, {}
        outer = {k: v if isinstance(v, (Rows, Objects)) else Scalar(v) if isinstance(v, Column) else Scalar(lit(v), known=(v,)) for k, v in (params or {}).items()}
        self.changes: list[tuple[str, Change]] = []  # what was done, in order
        self.scope = Scope(outer)
        self.depth = 0

    # Programs
    def run(self, program: ast.Program | str) -> Any:
        return self.body(parse_program(program) if isinstance(program, str) else program, self.scope)

    def body(self, program: ast.Program, scope: Scope) -> Any:
        scope = Scope({m.name: Function(m) for m in program.micros}, scope)
        for s in program.statements:
            if isinstance(s, ast.Let):
                value = self.value(s.value, scope)
                if s.type is not None:
                    self._declared(value, s.type)
                scope = Scope({s.name: value}, scope)
            else:
                self.value(s, scope)
        return None if program.result is None else self.value(program.result, scope)

    def _declared(self, value: Any, declared: ast.Node) -> None:
        t = declared
        while isinstance(t, (ast.Optional, ast.ListOf)):
            t = t.inner if isinstance(t, ast.Optional) else t.item
        if isinstance(t, ast.Named) and t.path[-1] in self.model.types and isinstance(value, (Rows, Objects)) and value.type and value.type.name != t.path[-1]:
            raise fail(f"expected {t.path[-1]}, found {value.type.name}", declared.span)

    def table(self, t: TypeInfo) -> DataFrame:
        return self.changed[t.name] if t.name in self.changed else self.source.scan(t)

    def rows(self, t: TypeInfo) -> Rows:
        df = self.table(t)
        return Rows(df, [f.name for f in t.fields], t, base=df, tie=[t.key.name] if t.key else [])

    # Values
    def value(self, e: ast.Node, scope: Scope) -> Any:
        return getattr(self, "_" + type(e).__name__)(e, scope)

    def column(self, e: ast.Node, scope: Scope) -> Scalar:
        v = self.value(e, scope)
        if isinstance(v, Shape):
            return Scalar(F.struct(*[self._as_scalar(x, e).column.alias(k) for k, x in v.fields.items()]))
        return self._as_scalar(v, e)

    def _as_scalar(self, v: Any, e: ast.Node) -> Scalar:
        if isinstance(v, Row) and v.type and v.type.key and v.path:
            return Scalar(self._cell(v, v.type.key.name).column)
        if not isinstance(v, Scalar):
            raise fail("expected a value, found a " + type(v).__name__.lower(), e.span)
        return v

    def _Name(self, e: ast.Name, scope: Scope) -> Any:
        v = scope.find(e.name)
        if isinstance(v, tuple):
            return self._cell(*v)
        if v is not None:
            return v
        m = self.model
        if e.name in m.types:
            return self.rows(m.types[e.name])
        if e.name in m.choices:
            return Shape({c.name: Scalar(lit(c.value), known=(c.value,)) for c in m.choices[e.name].members}, m.choices[e.name])
        if e.name in m.consts:
            return self.body(parse_program(m.consts[e.name].value), Scope())
        if e.name in m.operations:
            return Function(m.operations[e.name])
        raise fail(f"unknown name `{e.name}`", e.span)

    def _Literal(self, e: ast.Literal, scope: Scope) -> Scalar:
        if e.kind == "Int":
            n = int(e.value.replace("_", ""), 0)
            return Scalar(F.lit(n), known=(n,)) if -(1 << 63) <= n < 1 << 63 else Scalar(F.lit(str(n)).cast("decimal(20,0)"))
        value = float(e.value) if e.kind == "Float" else e.value
        return Scalar(F.lit(value), known=(value,))

    def _Lambda(self, e: ast.Lambda, scope: Scope) -> Closure:
        return Closure(e.params, e.body, scope)

    def _ListLit(self, e: ast.ListLit, scope: Scope) -> Any:
        items = [self.value(i, scope) for i in e.items]
        if items and all(isinstance(i, Objects) for i in items):
            if len({i.type.name for i in items}) > 1:
                raise fail("a list holds values of one type", e.span)
            return Objects(items[0].type, [r for i in items for r in i.rows], True)
        return Scalar(F.array(*[self._as_scalar(i, e).column for i in items]))

    def _TypedObject(self, e: ast.TypedObject, scope: Scope) -> Objects:
        t = self.model.types.get(e.type[-1])
        if not t:
            raise fail(f"unknown type `{e.type[-1]}`", e.span)
        given: dict[str, Any] = {}
        for item in e.fields:
            if not t.field(item.name):
                raise fail(f"{t.name} has no field `{item.name}`", item.span)
            if item.name in given:
                raise fail(f"field `{item.name}` is given twice", item.span)
            given[item.name] = self.column(item.value, scope)
        for f in t.fields:
            if f.name not in given:
                if f.default is not None:
                    given[f.name] = self.column(parse_program(f.default).result, Scope())
                elif f.optional:
                    given[f.name] = Scalar(F.lit(None), known=(None,))
                else:
                    raise fail(f"{t.name} needs field `{f.name}`", e.span)
        return Objects(t, [{f.name: given[f.name] for f in t.fields}], False)

    def _AnonObject(self, e: ast.AnonObject, scope: Scope) -> Shape:
        return Shape(self._named(e.fields, scope))

    def _named(self, items: list[ast.Item], scope: Scope) -> dict[str, Any]:
        out: dict[str, Any] = {}
        for i in items:
            if i.name in out:
                raise fail(f"output `{i.name}` is given twice", i.span)
            out[i.name] = self.column(i.value, scope)
        return out

    def _StructProj(self, e: ast.StructProj, scope: Scope) -> Shape:
        row, one = self.value(e.receiver, scope), None
        if isinstance(row, Rows) and row.one:
            one = row.fork()
            row = Row(one, one.type)
        if isinstance(row, Scalar) and row.type:
            row = self._through(row, scope, e)
        if not isinstance(row, Row):
            raise fail("a projection needs a row", e.span)
        inner, out = Scope(outer=scope, row=row), {}
        for i in e.items:
            names = _fields(row) if i.name == "*" else [i.name]
            for n in names:
                if n in out:
                    raise fail(f"output `{n}` is given twice", i.span)
                if i.value is not None:
                    out[n] = self.column(i.value, inner)
                elif n in _fields(row):
                    out[n] = self._cell(row, n)
                else:
                    raise fail(f"no field `{n}`", i.span)
        return self._shaped(one, out, None) if one else Shape(out)

    def _Unary(self, e: ast.Unary, scope: Scope) -> Scalar:
        c = self.column(e.operand, scope).column
        return Scalar(~c if e.op == "Not" else -c)

    def _Binary(self, e: ast.Binary, scope: Scope) -> Scalar:
        a, b = self.column(e.left, scope).column, self.column(e.right, scope).column
        ops = {
            "Eq": lambda: a.eqNullSafe(b), "Ne": lambda: ~a.eqNullSafe(b),  # null is a value like others
            "Lt": lambda: a < b, "Le": lambda: a <= b, "Gt": lambda: a > b, "Ge": lambda: a >= b,
            "And": lambda: a & b, "Or": lambda: a | b, "Add": lambda: a + b, "Sub": lambda: a - b, "Mul": lambda: a * b, "Div": lambda: a / b, "Rem": lambda: a % b,
        }
        return Scalar(ops[e.op]())

    def _Try(self, e: ast.Try, scope: Scope) -> Any:
        v = self.value(e.operand, scope)
        if not isinstance(v, Rows) or not v.one:
            raise fail("`?` unwraps the result of get", e.span)
        return v.fork(must=True)

    # Members, references, calls
    def _cell(self, row: Row, name: str) -> Scalar:
        f = row.type.field(name) if row.type else None
        target = self.model.types.get(f.target[-1]) if f and f.target else None
        return Scalar(col(row.prefix + name), target, (*row.path, name), name)

    def _through(self, ref: Scalar, scope: Scope, e: ast.Node) -> Row:
        """The row that a reference leads to: joined to the rows, once a path."""
        rows, t = ref.entity.fork() if ref.entity else scope.rows_here(), ref.type
        if rows is None or t is None:
            raise fail("a reference is read from a row", e.span)
        if ref.path not in rows.joined:
            prefix = "__ref_" + "_".join(ref.path) + "__"
            target = self.table(t)
            target = target.select(*[col(f.name).alias(prefix + f.name) for f in t.fields])
            # Outer, whether the reference is optional or not: a key without target drops no row.
            key = col((rows.joined[ref.path[:-1]] if ref.path[:-1] else "") + ref.path[-1]) if ref.entity else ref.column
            rows.df = rows.df.join(target, key == col(prefix + t.key.name), "left")
            rows.joined[ref.path] = prefix
            rows.sorted = not rows.keys
        return Row(rows, t, rows.joined[ref.path], ref.path)

    def _Member(self, e: ast.Member, scope: Scope) -> Any:
        v = self.value(e.receiver, scope)
        if isinstance(v, Shape):
            if e.name not in v.fields:
                raise fail(f"no member `{e.name}`", e.span)
            return v.fields[e.name]
        entity = isinstance(v, Scalar) and v.entity is not None
        if isinstance(v, Rows) and v.one:
            if not v.must:
                raise fail("the result of get is read after `?`", e.span)
            v, entity = Row(v.fork(), v.type), True
        if isinstance(v, Scalar) and v.type:
            v = self._through(v, scope, e)
        if isinstance(v, Row):
            if e.name not in _fields(v):
                raise fail(f"no field `{e.name}`", e.span)
            cell = self._cell(v, e.name)
            # One row's field is a value wherever it is used: a subquery of one row, which fails if there is none.
            return replace(cell, column=required(v.rows.df.select(cell.column.alias("value"))).scalar(), entity=v.rows) if entity else cell
        if isinstance(v, Scalar):
            return Scalar(v.column.getField(e.name), name=e.name)
        raise fail(f"no member `{e.name}`", e.span)

    def _Call(self, e: ast.Call, scope: Scope) -> Any:
        c = e.callee
        if isinstance(c, ast.Name):
            known = scope.find(c.name) or (Function(self.model.operations[c.name]) if c.name in self.model.operations else None)
            if isinstance(known, Function):
                return self._inline(known.operation, [self.value(a, scope) for a in e.args], e)
            if c.name in scalar.FREE:
                f, n = scalar.FREE[c.name]
                return Scalar(f(*self._args(e, scope, n)))
            raise fail(f"unknown function `{c.name}`", c.span)
        if not isinstance(c, ast.Member):
            raise fail("this can't be called", e.span)
        v = self.value(c.receiver, scope)
        if isinstance(v, Shape) and v.choices and c.name == "name":
            return Scalar(scalar.enum_name(*self._args(e, scope, 1), {m.value: m.name for m in v.choices.members}), name="name")
        if isinstance(v, (Rows, Objects)):
            do = getattr(self, f"_do_{c.name}", None)
            if do is None:
                raise fail(f"a collection has no method `{c.name}`", e.span)
            return do(v, e, scope)
        if isinstance(v, Change) and c.name == "collect":
            return v
        if isinstance(v, Scalar) and c.name in scalar.METHODS:
            f, n = scalar.METHODS[c.name]
            return Scalar(f(v.column, *self._args(e, scope, n - 1)))
        raise fail(f"no method `{c.name}`", e.span)

    def _args(self, e: ast.Call, scope: Scope, n: int) -> list[Column]:
        if len(e.args) != n:
            raise fail(f"expected {n} arguments, found {len(e.args)}", e.span)
        return [self.column(a, scope).column for a in e.args]

    def _inline(self, op: ast.Operation, args: list[Any], e: ast.Node) -> Any:
        if len(args) != len(op.params):
            raise fail(f"{op.name} takes {len(op.params)} arguments", e.span)
        if self.depth > 64:
            raise fail(f"{op.name} calls itself without end", e.span)
        self.depth += 1
        try:
            # The body sees its parameters and lets, and nothing of its caller.
            return self.body(op.body, Scope({p.name: a for p, a in zip(op.params, args)}))
        finally:
            self.depth -= 1

    # Methods of collections
    def _each(self, rows: Rows, e: ast.Call, scope: Scope) -> tuple[Rows, ast.Node, Scope]:
        if len(e.args) != 1 or not isinstance(e.args[0], ast.Lambda) or len(e.args[0].params) != 1:
            raise fail("expected a lambda of one parameter", e.span)
        out = rows.fork()
        f = e.args[0]
        return out, f.body, Scope({f.params[0]: Row(out, out.type)}, scope)

    def _need_rows(self, v: Any, e: ast.Node) -> Rows:
        if isinstance(v, Objects):
            df = literal_rows(self.source.spark, self.model, v.type, v.rows)
            return Rows(df, [f.name for f in v.type.fields], v.type, tie=[v.type.key.name] if v.type.key else [], made=True)
        return v

    def _do_filter(self, v: Any, e: ast.Call, scope: Scope) -> Rows:
        rows, body, inner = self._each(self._need_rows(v, e), e, scope)
        p = self.column(body, inner).column
        rows.df = rows.df.filter(p)
        if rows.base is not None:
            def again(r: Rows) -> Column:
                return self.column(body, Scope({e.args[0].params[0]: Row(r, r.type)}, scope)).column

            rows.where = [*rows.where, again]
        return rows

    def _do_map(self, v: Any, e: ast.Call, scope: Scope) -> Rows:
        rows, body, inner = self._each(self._need_rows(v, e), e, scope)
        got = self.value(body, inner)
        if isinstance(got, Objects):
            cells = got.rows[0]
        elif isinstance(got, Shape):
            cells = got.fields
        else:
            one = self._as_scalar(got, body)
            cells = {one.name or "value": one}
        return self._shaped(rows, cells, got.type if isinstance(got, Objects) else None)

    def _shaped(self, rows: Rows, cells: dict[str, Scalar], t: TypeInfo | None) -> Rows:
        """Rows of these cells; what orders them and tells them apart stays behind them."""
        if not rows.sorted:
            rows.df, rows.sorted = rows.df.orderBy(*[col(k).asc_nulls_last() for k in rows.keys]), True
        ties = {k: k if k.startswith("__") else f"__tie_{k}" for k in rows.tie}
        df = rows.df.select(*[c.column.alias(n) for n, c in cells.items()], *[col(k).alias(k) for k in rows.keys], *[col(k).alias(a) for k, a in ties.items() if a not in rows.keys])
        return Rows(df, list(cells), t, rows.keys, True, one=rows.one, must=rows.must, tie=list(ties.values()), made=t is not None)

    def _do_sort_by(self, v: Any, e: ast.Call, scope: Scope) -> Rows:
        rows, body, inner = self._each(self._need_rows(v, e), e, scope)
        key = self.column(body, inner).column
        # Ties by the key of the row or of the row it was made from, else by all that is seen: take is the same each time.
        ties = rows.tie or [f.name for f in rows.df.select(*map(col, rows.columns)).schema if isinstance(f.dataType, (AtomicType, NullType))]
        df = rows.df.select("*", key.alias("__by"), *[col(k).alias(f"__then{i}") for i, k in enumerate(ties)]).drop(*[k for k in rows.keys if k not in ties])
        names = ["__by", *(f"__then{i}" for i in range(len(ties)))]
        df = df.drop(*[f"__key{i}" for i in range(len(names))]).withColumnsRenamed({n: f"__key{i}" for i, n in enumerate(names)})
        rows.keys = [f"__key{i}" for i in range(len(names))]
        rows.tie = rows.keys[1:] if rows.tie else []
        if df.isStreaming:
            raise fail("a stream can't be sorted", e.span)
        rows.df = df.orderBy(*[col(k).asc_nulls_last() for k in rows.keys])
        rows.sorted, rows.base = True, None
        return rows

    def _do_take(self, v: Any, e: ast.Call, scope: Scope) -> Rows:
        rows = self._need_rows(v, e).fork()
        known = self.column(e.args[0], scope).known if len(e.args) == 1 else ()
        if not known or type(known[0]) is not int or not 0 <= known[0] < 1 << 31:
            raise fail("take needs a whole number", e.span)
        if not rows.sorted:
            rows.df, rows.sorted = rows.df.orderBy(*[col(k).asc_nulls_last() for k in rows.keys]), True
        rows.df, rows.base = rows.df.limit(known[0]), None
        return rows

    def _do_collect(self, v: Any, e: ast.Call, scope: Scope) -> Any:
        return v  # the boundary: the caller acts on the DataFrame

    def _do_load(self, v: Any, e: ast.Call, scope: Scope) -> Rows:
        """Joins a reference ahead of its use; a name or a lambda says which."""
        rows = self._need_rows(v, e).fork()
        for a in e.args:
            if isinstance(a, ast.Lambda):
                ref = self.value(a.body, Scope({a.params[0]: Row(rows, rows.type)}, scope))
            elif isinstance(a, ast.Name):
                ref = self.value(a, Scope(outer=scope, row=Row(rows, rows.type)))
            else:
                ref = None
            if not isinstance(ref, Scalar) or not ref.type:
                raise fail("load needs a reference", e.span)
            self._through(ref, Scope({"x": Row(rows, rows.type)}), e)
        return rows

    def _keyed(self, rows: Rows, e: ast.Node) -> TypeInfo:
        if not rows.type or not rows.type.key:
            raise fail("this needs a table with a key", e.span)
        return rows.type

    def _do_get(self, v: Any, e: ast.Call, scope: Scope) -> Rows:
        rows = self._need_rows(v, e).fork()
        key = self._keyed(rows, e).key.name
        k, = self._args(e, scope, 1)
        rows.df, rows.one = rows.df.filter(col(key) == k), True
        rows.where = [*rows.where, lambda r: col(key) == k]
        return rows

    def _do_insert(self, v: Any, e: ast.Call, scope: Scope) -> Change:
        if not isinstance(v, Objects) and not (isinstance(v, Rows) and v.made and v.type):
            raise fail("only constructed values are inserted", e.span)
        if v.type.kind != "table":
            raise fail(f"{v.type.name} is no table", e.span)
        if isinstance(v, Objects):
            new, one = literal_rows(self.source.spark, self.model, v.type, v.rows), not v.many
        else:
            new, one = checked_rows(self.model, v.type, v.frame()), v.one
        return self._changed("insert", mutation.insert(v.type, self.table(v.type), new, one))

    def _target(self, v: Any, e: ast.Call) -> tuple[Rows, TypeInfo]:
        if not isinstance(v, Rows) or v.base is None or not v.type or v.type.kind != "table":
            raise fail("only rows of a table, all or filtered, are changed", e.span)
        # A later let may have changed the table; conditions hold for its state now.
        now = self.table(v.type)
        return Rows(now, v.columns, v.type, base=now, where=v.where, one=v.one, must=v.must), v.type

    def _condition(self, rows: Rows) -> Column:
        p = F.lit(True)
        for w in rows.where:
            p = p & w(rows)
        return F.coalesce(p, F.lit(False))

    def _do_update(self, v: Any, e: ast.Call, scope: Scope) -> Change:
        rows, t = self._target(v, e)
        if len(e.args) != 1:
            raise fail("update takes an object or a lambda", e.span)
        a = e.args[0]
        p = self._condition(rows)
        got = self.value(a.body, Scope({a.params[0]: Row(rows, t)}, scope)) if isinstance(a, ast.Lambda) else self.value(a, scope)
        if not isinstance(got, Shape):
            raise fail("update takes an object or a lambda that gives one", e.span)
        for name in got.fields:
            if not t.field(name):
                raise fail(f"{t.name} has no field `{name}`", e.span)
        return self._changed("update", self._there(v, rows, p, mutation.update(t, rows.df, p, {k: x.column for k, x in got.fields.items()}, self.model.schema(t), v.one)))

    def _do_delete(self, v: Any, e: ast.Call, scope: Scope) -> Change:
        rows, t = self._target(v, e)
        p = self._condition(rows)
        return self._changed("delete", self._there(v, rows, p, mutation.delete(t, rows.df, p, v.one)))

    def _there(self, v: Rows, rows: Rows, p: Column, c: Change) -> Change:
        """After `?`, the action on either frame fails if there is no such row."""
        if not v.must:
            return c
        n = rows.df.where(p).limit(1).agg(F.count(F.lit(1)).alias("n")).scalar()
        return replace(c, state=c.state.where(found(n)), affected=required(c.affected))

    def _changed(self, what: str, c: Change) -> Change:
        self.changed[c.table.name] = c.state
        self.changes.append((what, c))
        return c


def frame(lowering: Lowering, value: Any) -> DataFrame:
    """The DataFrame of a program's result."""
    if isinstance(value, Change):
        return value.affected
    if isinstance(value, Objects):
        return literal_rows(lowering.source.spark, lowering.model, value.type, value.rows)
    if isinstance(value, Rows):
        return value.frame()
    if isinstance(value, Scalar):
        return lowering.source.spark.range(1).select(value.column.alias(value.name or "value"))
    raise TypeError("the program has no result" if value is None else f"no rows: {value}")
