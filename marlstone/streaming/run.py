"""Programs over streams: the same stateless operators on a streaming source.

Filters, maps, projections and helpers, and references into tables that stand
still, need no state and no watermark; ``sort_by`` is refused while lowering."""

from __future__ import annotations

import tempfile
import uuid
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..catalog.types import Model
from ..session import Engine


class StreamEngine(Engine):
    """An engine in which the tables of ``streams`` (folders of Parquet files, by
    type name) grow, and the others stand still."""

    def __init__(self, spark: SparkSession, model: Model | str, root: str, streams: dict[str, str], **rest: Any):
        super().__init__(spark, model, root, **rest)
        for name, folder in streams.items():
            schema = self.model.schema(self.model.types[name])
            self.source.frames[name] = spark.readStream.schema(schema).parquet(folder)


def working_folder(spark: SparkSession) -> str:
    """A new folder in ``spark.checkpoint.dir``; only where that is unset, on one
    machine, a temporary one."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not root and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    root = root or tempfile.mkdtemp(prefix="marlstone-stream-")
    return f"{root if ':' in root else 'file://' + root}/stream-{uuid.uuid4().hex}"


def start(df: DataFrame, checkpoint: str, path: str | None = None, name: str | None = None) -> StreamingQuery:
    """Runs a streaming result over what there is: to Parquet files at ``path``
    (each row once), or to a table in memory for tests."""
    w = df.writeStream.outputMode("append").trigger(availableNow=True).option("checkpointLocation", checkpoint)
    return w.format("parquet").option("path", path).start() if path else w.format("memory").queryName(name).start()
