"""Small helpers for operators that map Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import wraps

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T


def map_batches(frame: DataFrame, function: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]], schema: T.StructType | str) -> DataFrame:
    """Each batch by itself; nothing is kept between batches."""

    def go(batches):
        for batch in batches:
            yield from function(batch)

    return frame.mapInArrow(go, schema)


#: Rows of a batch in operators that hold several values for each word: whole texts of so many rows are in a worker at once.
BATCH_ROWS = 1024


def in_small_batches(operator: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """For an operator that writes all its tables before it returns: its Arrow batches have BATCH_ROWS rows at most."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"

    @wraps(operator)
    def run(docs: DataFrame, *args, **kwargs) -> DataFrame:
        conf = docs.sparkSession.conf
        before = conf.get(key)
        conf.set(key, str(BATCH_ROWS))
        try:
            return operator(docs, *args, **kwargs)
        finally:
            conf.set(key, before)

    return run


def id_schema(frame: DataFrame, id_col: str, rest: str) -> T.StructType:
    """The id column as it is, then the given columns."""
    return T.StructType([T.StructField(id_col, frame.schema[id_col].dataType), *T.StructType.fromDDL(rest).fields])


def plain_names(frame: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Just id and text, so that no further column can clash."""
    return frame.select(id_col, text_col)


def shared_path(spark, name: str) -> str:
    """A new folder in the store that driver and executors share: spark.checkpoint.dir, or where it is unset in local mode, the warehouse."""
    import uuid

    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.conf.get("spark.master", "local").startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = spark.conf.get("spark.sql.warehouse.dir")
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


def written(frame: DataFrame, name: str) -> DataFrame:
    """The frame, written to the shared store and read back: lineage ends here, and a lost executor loses nothing."""
    path = shared_path(frame.sparkSession, name)
    frame.write.option("compression", "zstd").parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)


class Scratch:
    """Tables that only one operator reads; clear() removes them once its result is written."""

    def __init__(self, spark, name: str):
        self.spark, self.root = spark, shared_path(spark, name)

    def written(self, frame: DataFrame, name: str) -> DataFrame:
        path = f"{self.root}/{name}"
        frame.write.option("compression", "zstd").parquet(path)
        return self.spark.read.schema(frame.schema).parquet(path)

    def fresh(self, frame: DataFrame, name: str) -> DataFrame:
        """A table of its own each time, for names that come again."""
        import uuid

        return self.written(frame, f"{name}-{uuid.uuid4().hex[:12]}")

    def clear(self, *names: str) -> None:
        """The named tables, or all."""
        jvm = self.spark._jvm
        for path in [f"{self.root}/{n}" for n in names] or [self.root]:
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)
