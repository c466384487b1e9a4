"""SELECT to a DataFrame: sources, joins, filter, grouping, order, slice, projection."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenq.errors import ExecuteError
from lumenq.lang import ast as A
from lumenq.plans.expr import Lowering, Relation, Scope, Typed, aggregates, quoted


class SelectPlanner:
    """Builds lazy plans; read gives the DataFrame of a table."""

    def __init__(self, spark: SparkSession, read: Callable[[A.TableName], DataFrame], params: tuple = (), functions: dict | None = None, strict: bool = False):
        self.spark, self.read, self.params, self.functions, self.strict = spark, read, params, functions, strict

    def lowering(self, scope: Scope) -> Lowering:
        return Lowering(scope, self.plan, self.params, self.functions, self.strict)

    def plan(self, q: A.Select, outer: Scope | None = None) -> DataFrame:
        scope = Scope(outer=outer)
        frame = self.sources(q, scope)
        low = self.lowering(scope)
        if q.where is not None:
            if aggregates(q.where):
                raise ExecuteError("WHERE cannot hold an aggregate")
            frame = frame.filter(low.condition(q.where))
        items = self.items(q, scope)
        if q.group is not None or any(aggregates(e) for e, _ in items) or any(aggregates(o.expr) for o in q.order):
            frame, scope = self.grouped(q, frame, scope, items)
            low = self.lowering(scope)
            if q.having is not None:
                frame = frame.filter(low.condition(q.having))
        if keys := self.order_keys(q, items, low):
            frame = frame.orderBy(*keys)
        if q.offset:
            frame = frame.offset(q.offset)
        if q.limit is not None:
            frame = frame.limit(q.limit)
        return frame.select(*[low.column(e).alias(name) for e, name in items])

    # --- FROM ---

    def relation(self, source: A.Source) -> Relation:
        if isinstance(source.of, A.Select):
            if source.alias is None:
                raise ExecuteError("a derived table needs an alias")
            frame, alias = self.plan(source.of), source.alias
        else:
            frame, alias = self.read(source.of), source.alias or source.of.name
        return Relation(alias, frame.alias(alias), frame.schema)

    def sources(self, q: A.Select, scope: Scope) -> DataFrame:
        if q.source is None:
            return self.spark.range(1).select()
        first = self.relation(q.source)
        scope.relations.append(first)
        frame = first.frame
        for join in q.joins:
            right = self.relation(join.source)
            if any(r.alias == right.alias for r in scope.relations):
                raise ExecuteError(f"{right.alias} is named twice; give one an alias")
            scope.relations.append(right)
            if join.kind == "cross":
                frame = frame.crossJoin(right.frame)
            else:
                frame = frame.join(right.frame, self.lowering(scope).condition(join.on), join.kind)
        return frame

    # --- SELECT list ---

    def items(self, q: A.Select, scope: Scope) -> list[tuple[A.Node, str]]:
        """Expressions and their names; stars are spelled out."""
        out: list[tuple[A.Node, str]] = []
        for item in q.items:
            if isinstance(item.expr, A.Star):
                relations = [r for r in scope.relations if item.expr.table in (None, r.alias)]
                if not relations:
                    raise ExecuteError("* has no table" if item.expr.table is None else f"{item.expr.table} does not exist")
                out += [(A.ColumnRef(f.name, r.alias), f.name) for r in relations for f in r.schema]
            else:
                out.append((item.expr, item.alias or (item.expr.name if isinstance(item.expr, A.ColumnRef) else "?column?")))
        return out

    # --- GROUP BY ---

    def grouped(self, q: A.Select, frame: DataFrame, scope: Scope, items: list[tuple[A.Node, str]]) -> tuple[DataFrame, Scope]:
        """One aggregation with every key and every distinct aggregate call; later expressions read its columns."""
        if q.group == "ALL":
            if any(isinstance(i.expr, A.Star) for i in q.items):
                raise ExecuteError("GROUP BY ALL does not go with *")
            keys = [ref for e, _ in items for ref in _bare_columns(e)]
        else:
            keys = list(q.group or ())
        low = self.lowering(scope)
        calls = [c for e in [e for e, _ in items] + ([q.having] if q.having else []) + [o.expr for o in q.order] for c in aggregates(e)]
        calls = list(dict.fromkeys(calls))
        known: dict[A.Node, Typed] = {}
        key_columns: list[Column] = []
        for n, key in enumerate(dict.fromkeys(keys)):
            t = low.typed(key)
            key_columns.append(t.column.alias(f"__k{n}"))
            for spelling in self.spellings(key, scope):
                known[spelling] = Typed(F.col(f"__k{n}"), t.type)
        made: list[Column] = []
        for n, c in enumerate(calls):
            t = low.typed(c)
            made.append(t.column.alias(f"__a{n}"))
            known[c] = Typed(F.col(f"__a{n}"), t.type)
        if key_columns:
            frame = frame.groupBy(*key_columns).agg(*made) if made else frame.select(*key_columns).distinct()
        else:
            frame = frame.agg(*(made or [F.count(F.lit(1)).alias("__a")]))
        return frame, Scope(scope.relations, known or {A.Literal(object()): low.typed(A.Literal(None))}, scope.outer)

    def spellings(self, key: A.ColumnRef, scope: Scope) -> list[A.ColumnRef]:
        """c and t.c, where both mean the same column."""
        out = [key]
        for r in scope.relations:
            if key.name in r.schema.fieldNames() and key.table in (None, r.alias):
                out.append(A.ColumnRef(key.name, r.alias))
        if sum(key.name in r.schema.fieldNames() for r in scope.relations) == 1:
            out.append(A.ColumnRef(key.name))
        return out

    # --- ORDER BY ---

    def order_keys(self, q: A.Select, items: list[tuple[A.Node, str]], low: Lowering) -> list[Column]:
        """Names mean input columns first, then aliases of the list; a constant orders nothing."""
        named = {name: e for e, name in items}
        keys = []
        for o in q.order:
            e = o.expr
            if isinstance(e, A.ColumnRef) and e.table is None and e not in low.scope.known and low.scope.find(e) is None and e.name in named:
                e = named[e.name]
            t = low.typed(e)
            if t.literal:
                continue
            c = t.column
            keys.append((c.asc_nulls_first() if o.nulls_first else c.asc_nulls_last()) if o.ascending else (c.desc_nulls_first() if o.nulls_first else c.desc_nulls_last()))
        return keys


def _bare_columns(node: A.Node) -> list[A.ColumnRef]:
    """Columns of an expression that stand outside aggregates."""
    from lumenq.plans.expr import children, is_aggregate

    if isinstance(node, A.ColumnRef):
        return [node]
    return [] if is_aggregate(node) else [x for c in children(node) for x in _bare_columns(c)]


__all__ = ["SelectPlanner", "quoted"]
