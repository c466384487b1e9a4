"""INSERT, UPDATE and DELETE as new snapshots, with constraint checks that run before the commit."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumenq.errors import ExecuteError, TypeMismatch
from lumenq.lang import ast as A
from lumenq.plans.expr import Relation, Scope, kind
from lumenq.sources.tables import ColumnMeta, TableMeta


def _fits(column: ColumnMeta, t: T.DataType, strict: bool) -> None:
    have, want = kind(t), kind(column.spark_type)
    if have not in (want, "null") and (strict or (have, want) != ("int", "float")):
        raise TypeMismatch(f"column {column.name} is {column.type}, the value is {have}")


def check_not_null(frame: DataFrame, columns: list[ColumnMeta]) -> None:
    """One pass over the new rows for all columns."""
    if not columns:
        return
    row = frame.agg(*[F.max(F.col(f"`{c.name}`").isNull()).alias(c.id) for c in columns]).first()
    for c in columns:
        if row[c.id]:
            raise ExecuteError(f"column {c.name} cannot be NULL")


def check_unique(frame: DataFrame, columns: list[ColumnMeta], existing: DataFrame | None = None) -> None:
    """Each unique column costs one aggregation, and against existing rows one semi-join; NULL keys are exempt."""
    for c in columns:
        key = frame.select(F.col(f"`{c.name}`").alias("k")).filter("k IS NOT NULL")
        clash = key.groupBy("k").count().filter("count > 1").select("k")
        if existing is not None:
            clash = clash.unionByName(existing.select(F.col(f"`{c.name}`").alias("k")).join(key, "k", "left_semi"))
        if hit := clash.head(1):
            raise ExecuteError(f"column {c.name} is unique, and {hit[0]['k']!r} would be there twice")


def insert(engine, stmt: A.Insert) -> int:
    path, meta = engine.table(stmt.table)
    columns = [meta.column(n) for n in stmt.columns]
    if len({c.id for c in columns}) < len(columns):
        raise ExecuteError("a column is named twice")
    for c in meta.columns:
        if c not in columns and c.not_null and not c.has_default:
            raise ExecuteError(f"column {c.name} cannot be NULL and has no default")
    frame = _selected(engine, stmt, meta, columns) if stmt.query is not None else _listed(engine, stmt, meta, columns)
    required = [c for c in meta.columns if c.not_null and (c in columns or c.default is None)]
    unique = meta.unique_columns()
    if stmt.query is not None and (required or unique):
        # the checks and the write must see the same rows, so write first; nothing lists the folder before the commit
        name, n = engine.store.write(path, meta, frame)
        frame = engine.store.read(path, replace(meta, data=(name,)))
    else:
        name = n = None
    check_not_null(frame, required)
    check_unique(frame, unique, engine.store.read(path, meta) if meta.data else None)
    if name is None:
        name, n = engine.store.write(path, meta, frame)
    engine.save(path, replace(meta, data=(*meta.data, name), marks={**meta.marks, **engine.mark}))
    return n


def _default(c: ColumnMeta):
    return F.lit(c.default if c.has_default else None).cast(c.spark_type)


def _selected(engine, stmt: A.Insert, meta: TableMeta, columns: list[ColumnMeta]) -> DataFrame:
    frame = engine.planner().plan(stmt.query)
    if len(frame.columns) != len(columns):
        raise ExecuteError("INSERT has more or fewer columns than its SELECT")
    for c, f in zip(columns, frame.schema, strict=True):
        _fits(c, f.dataType, engine.strict_types)
    frame = frame.toDF(*[c.id for c in columns])
    return frame.select(*[(F.col(c.id) if c in columns else _default(c)).alias(c.name) for c in meta.columns])


def _listed(engine, stmt: A.Insert, meta: TableMeta, columns: list[ColumnMeta]) -> DataFrame:
    """The values of all rows as one local relation; constants need no Spark job."""
    rows = []
    for values in stmt.rows:
        row = {c.id: c.default if c.has_default else None for c in meta.columns}
        for c, value in zip(columns, values, strict=True):
            if not isinstance(value, A.Default):
                row[c.id] = engine.constant(value, lambda t, c=c: _fits(c, t, engine.strict_types))
        rows.append([float(row[c.id]) if c.type == "FLOAT" and row[c.id] is not None else row[c.id] for c in meta.columns])
    schema = T.StructType([T.StructField(c.name, c.spark_type) for c in meta.columns])
    return engine.spark.createDataFrame(rows, schema)


def _target(engine, table: A.TableName, alias: str | None):
    path, meta = engine.table(table)
    name = alias or table.name
    frame = engine.store.read(path, meta)
    scope = Scope([Relation(name, frame.alias(name), frame.schema)])
    return path, meta, scope.relations[0].frame, engine.planner().lowering(scope)


def _again(engine, meta: TableMeta, stmt: A.Update | A.Delete) -> DataFrame:
    """Part of a table's files, under the name that the statement's expressions use."""
    return engine.store.read(engine.path(stmt.table), meta).alias(stmt.alias or stmt.table.name)


def update(engine, stmt: A.Update) -> int:
    path, meta, frame, low = _target(engine, stmt.table, stmt.alias)
    hit = F.coalesce(low.condition(stmt.where), F.lit(False)) if stmt.where is not None else F.lit(True)
    sets = {}
    for name, e in stmt.sets:
        c, t = meta.column(name), low.typed(e)
        _fits(c, t.type, engine.strict_types)
        if c.id in sets:
            raise ExecuteError(f"column {name} is set twice")
        sets[c.id] = t.column.cast(c.spark_type)
    values = [(F.when(hit, sets[c.id]).otherwise(F.col(f"`{c.name}`")) if c.id in sets else F.col(f"`{c.name}`")).alias(c.name) for c in meta.columns]
    # only files with a row that changes are written anew
    hits = engine.store.hits(path, meta, low.condition(stmt.where) if stmt.where is not None else F.lit(True), stmt.alias or stmt.table.name)
    if not hits:
        return 0
    kept = engine.store.without(path, meta, set(hits))
    part = replace(meta, data=tuple(sorted(hits)))
    name, _ = engine.store.write(path, meta, _again(engine, part, stmt).select(*values))
    written = engine.store.read(path, replace(meta, data=(name,)))
    check_not_null(written, [c for c in meta.columns if c.not_null and c.id in sets])
    check_unique(written, [c for c in meta.unique_columns() if c.id in sets], engine.store.read(path, replace(meta, data=kept)) if kept else None)
    engine.save(path, replace(meta, data=(*kept, name)))
    return sum(hits.values())


def delete(engine, stmt: A.Delete) -> int:
    path, meta, frame, low = _target(engine, stmt.table, stmt.alias)
    if stmt.where is None:
        n = frame.count()
        engine.save(path, replace(meta, data=()))
        return n
    condition = low.condition(stmt.where)
    hits = engine.store.hits(path, meta, condition, stmt.alias or stmt.table.name)
    if hits:
        kept = engine.store.without(path, meta, set(hits))
        part = _again(engine, replace(meta, data=tuple(sorted(hits))), stmt)
        name, n = engine.store.write(path, meta, part.filter(~F.coalesce(condition, F.lit(False))))
        engine.save(path, replace(meta, data=(*kept, name) if n else kept))
    return sum(hits.values())
