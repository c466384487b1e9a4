"""Append a stream to a table of the dialect. The dialect itself has no streaming; this is its INSERT for micro-batches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from lumenq.lang import ast as A
from lumenq.session import Engine


def append_stream(engine: Engine, stream: DataFrame, table: str, checkpoint: str, available_now: bool = False) -> StreamingQuery:
    """Insert every micro-batch with the checks of INSERT. The version that a batch makes names its stream and number, so a batch that comes again after a failure is told and left out."""
    columns = ", ".join(f'"{c}"' for c in stream.columns)
    source = checkpoint.rstrip("/")

    def insert(batch: DataFrame, number: int) -> None:
        _, meta = engine.table(A.TableName(table))
        if meta.marks.get(source, -1) >= number:
            return
        engine.register("__batch", batch)
        engine.mark = {source: number}
        try:
            engine.sql(f'INSERT INTO "{table}" ({columns}) SELECT {columns} FROM "__batch"')
        finally:
            engine.mark = {}

    writer = stream.writeStream.foreachBatch(insert).option("checkpointLocation", f"{source}/state")
    return (writer.trigger(availableNow=True) if available_now else writer).start()
