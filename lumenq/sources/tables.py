"""Versioned tables: immutable Parquet folders, listed by numbered version files.

``<warehouse>/<database>/<table>/versions/00000007.json`` holds a table's schema and its data folders.
A commit writes the next number, which only one writer can get; whatever no version lists is ignored,
so a crash leaves nothing to repair. Columns have stable ids, which are their physical names: adding,
renaming and dropping columns rewrites no data.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import asdict, dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumenq.errors import ConflictError, ExecuteError
from lumenq.sources.filesystem import FileSystem

SPARK_TYPES = {"INTEGER": T.LongType(), "FLOAT": T.DoubleType(), "BOOLEAN": T.BooleanType(), "VARCHAR": T.StringType()}


@dataclass(frozen=True)
class ColumnMeta:
    """id: the physical name. default: a constant, if has_default."""

    id: str
    name: str
    type: str
    length: int | None = None
    not_null: bool = False
    primary_key: bool = False
    comment: str = ""
    has_default: bool = False
    default: object = None

    @property
    def spark_type(self) -> T.DataType:
        return SPARK_TYPES[self.type]


@dataclass(frozen=True)
class TableMeta:
    version: int
    columns: tuple[ColumnMeta, ...]
    next_id: int
    indexes: dict[str, tuple[str, bool]] = field(default_factory=dict)  # name -> column id, unique
    data: tuple[str, ...] = ()  # folders, or single files of folders
    marks: dict[str, int] = field(default_factory=dict)  # stream -> its last batch that is in

    def column(self, name: str) -> ColumnMeta:
        for c in self.columns:
            if c.name == name:
                return c
        raise ExecuteError(f"column {name} does not exist")

    def unique_columns(self) -> list[ColumnMeta]:
        keys = [c for c in self.columns if c.primary_key]
        ids = {c.id for c in keys} if len(keys) == 1 else set()
        ids |= {column for column, unique in self.indexes.values() if unique}
        return [c for c in self.columns if c.id in ids]

    def with_column(self, old: ColumnMeta, **changes) -> TableMeta:
        return replace(self, columns=tuple(replace(c, **changes) if c is old else c for c in self.columns))

    def to_json(self) -> str:
        return json.dumps(asdict(self))

    @staticmethod
    def from_json(text: str) -> TableMeta:
        x = json.loads(text)
        return TableMeta(x["version"], tuple(ColumnMeta(**c) for c in x["columns"]), x["next_id"], {k: tuple(v) for k, v in x["indexes"].items()}, tuple(x["data"]), x.get("marks", {}))


def check_name(name: str) -> str:
    """Names become folders."""
    if name in ("", ".", "..") or any(c in name for c in "/\\:\0"):
        raise ExecuteError(f"{name!r} is no valid name")
    return name


class TableStore:
    def __init__(self, spark: SparkSession, warehouse: str):
        self.spark, self.fs = spark, FileSystem(spark, warehouse)
        self.root = self.fs.root
        self.fs.make(self.root)

    def database_path(self, database: str) -> str:
        return f"{self.root}/{check_name(database)}"

    def path(self, database: str, table: str) -> str:
        return f"{self.database_path(database)}/{check_name(table)}"

    def databases(self) -> list[str]:
        return self.fs.folders(self.root)

    def tables(self, database: str) -> list[str]:
        at = self.database_path(database)
        if not self.fs.exists(at):
            raise ExecuteError(f"database {database} does not exist")
        return [t for t in self.fs.folders(at) if self.load(f"{at}/{t}") is not None]

    def load(self, path: str) -> TableMeta | None:
        """The newest version, or None."""
        names = [n for n in self.fs.names(f"{path}/versions") if n.endswith(".json")]
        return TableMeta.from_json(self.fs.read(f"{path}/versions/{names[-1]}")) if names else None

    def commit(self, path: str, meta: TableMeta) -> TableMeta:
        """meta.version is the version it builds on."""
        new = replace(meta, version=meta.version + 1)
        if not self.fs.put_new(f"{path}/versions/{new.version:08d}.json", new.to_json()):
            raise ConflictError(f"{path.rsplit('/', 1)[-1]} was changed by another writer")
        return new

    def read(self, path: str, meta: TableMeta) -> DataFrame:
        """Columns under their logical names; those that a data folder lacks are NULL."""
        return self._physical(path, meta).select(*[F.col(c.id).alias(c.name) for c in meta.columns])

    def _physical(self, path: str, meta: TableMeta) -> DataFrame:
        physical = T.StructType([T.StructField(c.id, c.spark_type) for c in meta.columns])
        if not meta.data:
            return self.spark.createDataFrame([], physical)
        return self.spark.read.schema(physical).parquet(*[f"{path}/data/{d}" for d in meta.data])

    def hits(self, path: str, meta: TableMeta, hit: Column, alias: str) -> dict[str, int]:
        """How many rows the condition, in which the table has this alias, holds for in each file that has some, as folder/file."""
        if not meta.data:
            return {}
        frame = self._physical(path, meta).withColumn("__file", F.col("_metadata.file_path"))
        frame = frame.select(*[F.col(c.id).alias(c.name) for c in meta.columns], "__file").alias(alias)
        return {"/".join(r["__file"].split("/")[-2:]): r["n"] for r in frame.filter(hit).groupBy("__file").agg(F.count(F.lit(1)).alias("n")).collect()}

    def without(self, path: str, meta: TableMeta, files: set[str]) -> tuple[str, ...]:
        """The table's data but for some files."""
        out: list[str] = []
        for entry in meta.data:
            if "/" in entry:
                out += [entry] if entry not in files else []
            elif not any(f.startswith(f"{entry}/") for f in files):
                out.append(entry)
            else:
                names = [f"{entry}/{n}" for n in self.fs.names(f"{path}/data/{entry}") if n.endswith(".parquet")]
                out += [n for n in names if n not in files]
        return tuple(out)

    def write(self, path: str, meta: TableMeta, frame: DataFrame) -> tuple[str, int]:
        """Write a frame with logical names as a new data folder; returns its name and its rows."""
        from pyspark.sql import Observation

        name, seen = uuid.uuid4().hex, Observation()
        frame = frame.select(*[F.col(f"`{c.name}`").cast(c.spark_type).alias(c.id) for c in meta.columns])
        keys = list(dict.fromkeys(column for column, _ in meta.indexes.values() if column in frame.columns))
        writer = frame.observe(seen, F.count(F.lit(1)).alias("rows"))
        # an index is a layout: files sorted by the first indexed column, and a Bloom filter of each
        writer = (writer.sortWithinPartitions(keys[0]) if keys else writer).write
        for key in keys:
            writer = writer.option(f"parquet.bloom.filter.enabled#{key}", "true")
        writer.parquet(f"{path}/data/{name}")
        return name, seen.get["rows"]
