"""The entry point: a model, its sources, and programs over them."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame, SparkSession

from .catalog.types import Model
from .plans.lower import Lowering, frame
from .plans.values import Change
from .sources.snapshots import SnapshotStore
from .sources.tables import Source

SETTINGS = {"spark.sql.caseSensitive": "true", "spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true"}


def configure(spark: SparkSession) -> SparkSession:
    """Settings that the language's meaning needs (names are case-sensitive, times
    are UTC), for sessions of your own."""
    for k, v in SETTINGS.items():
        spark.conf.set(k, v)
    return spark


class Engine:
    """``run`` lowers a program and gives its result's DataFrame; nothing is read
    until an action.  ``change`` gives a mutation with the new state of its table.

    With a ``store``, tables that have a version there are read from it, and ``commit``
    stores what a program changes."""

    def __init__(self, spark: SparkSession, model: Model | str, root: str | None = None, frames: dict[str, Any] | None = None, files: dict[str, str] | None = None, stream: bool = False, store: SnapshotStore | None = None):
        self.model = Model.of(model) if isinstance(model, str) else model
        self.source, self.store = Source(spark, self.model, root, frames, files, stream), store

    def run(self, program: str, **params: Any) -> DataFrame:
        lowering = Lowering(self.model, self._source()[0], params)
        return frame(lowering, lowering.run(program))

    def _source(self) -> tuple[Source, dict[str, int]]:
        """Where tables come from, and the versions of those that are in the store:
        a program reads one version of a table throughout."""
        if self.store is None:
            return self.source, {}
        s, at = self.source, {n: v for n in self.model.types if (v := self.store.version(n))}
        stored = {n: (lambda n=n, v=v: self.store.read(n, v)) for n, v in at.items()}
        return Source(s.spark, s.model, s.root, s.frames | stored, s.files, s.stream), at

    def commit(self, program: str, **params: Any) -> DataFrame | None:
        """Runs a program and stores the new state of each table that it changes, of
        tables with inserts alone just the new rows.  Returns the rows of its result:
        those of an insert as stored, with the ids and times that were made for them.

        A table that isn't in the store is put there first.  Another's commit to a
        table since the program began is a Conflict."""
        if self.store is None:
            raise TypeError("the engine has no store")
        source, at = self._source()
        lowering, stored = Lowering(self.model, source, params), {}
        result = lowering.run(program)
        for name in lowering.changed:
            own = [(what, c) for what, c in lowering.changes if c.table.name == name]
            if any(what != "insert" for what, _ in own):
                self.store.write(name, lowering.changed[name], at.get(name, 0))
                continue
            version = at.get(name) or self.store.write(name, source.scan(self.model.types[name]), 0)
            for _, c in own:
                stored[id(c)] = self.store.append(c, version)
                version += 1
        if id(result) in stored:
            return stored[id(result)]
        return None if result is None else frame(lowering, result)

    def change(self, program: str, **params: Any) -> Change:
        out = Lowering(self.model, self._source()[0], params).run(program)
        if not isinstance(out, Change):
            raise TypeError("the program's result is no mutation")
        return out

    def states(self, program: str, **params: Any) -> dict[str, DataFrame]:
        """The new state of each table that a program changes."""
        lowering = Lowering(self.model, self._source()[0], params)
        lowering.run(program)
        return lowering.changed

    def query(self, name: str, **params: Any) -> DataFrame:
        """A declared query by name, with its parameters' values."""
        op = self.model.operations[name]
        if {p.name for p in op.params} != set(params):
            raise TypeError(f"{name} takes {[p.name for p in op.params]}")
        lowering = Lowering(self.model, self._source()[0], params)
        return frame(lowering, lowering.body(op.body, lowering.scope))
