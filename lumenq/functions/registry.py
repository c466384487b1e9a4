"""The functions of the dialect. Each gets typed arguments and returns a column and its type; all stay in the JVM."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumenq.errors import ExecuteError, TypeMismatch


@dataclass(frozen=True)
class Typed:
    """A column together with the type that it will have; literal: its constant, if it is one."""

    column: Column
    type: T.DataType
    literal: bool = False


def _numeric(t: T.DataType) -> bool:
    return isinstance(t, T.NumericType | T.NullType)


def common_type(args: list[Typed]) -> T.DataType:
    """The type that COALESCE and its kin return."""
    kinds = [a.type for a in args if not isinstance(a.type, T.NullType)]
    if not kinds:
        return T.NullType()
    if all(_numeric(k) for k in kinds) and any(isinstance(k, T.DoubleType | T.FloatType) for k in kinds):
        return T.DoubleType()
    if all(isinstance(k, T.IntegralType) for k in kinds):
        return T.LongType() if len({*map(str, kinds)}) > 1 else kinds[0]
    if len({type(k) for k in kinds}) > 1:
        raise TypeMismatch(f"arguments have the types {', '.join(k.simpleString() for k in kinds)}")
    return kinds[0]


def _sum(args: list[Typed]) -> Typed:
    if not _numeric(args[0].type):
        raise TypeMismatch("SUM takes a number")
    return Typed(F.sum(args[0].column), T.DoubleType() if isinstance(args[0].type, T.DoubleType | T.FloatType) else T.LongType())


def _avg(args: list[Typed]) -> Typed:
    if not _numeric(args[0].type):
        raise TypeMismatch("AVG takes a number")
    return Typed(F.avg(args[0].column), T.DoubleType())


def _every(args: list[Typed]) -> Typed:
    if not isinstance(args[0].type, T.BooleanType | T.NullType):
        raise TypeMismatch("EVERY takes a boolean")
    return Typed(F.every(args[0].column), T.BooleanType())


def _string_agg(args: list[Typed]) -> Typed:
    """Ordered by value, so that the result does not hang on the partitioning."""
    kept = F.array_sort(F.collect_list(args[0].column.cast("string")))
    return Typed(F.when(F.size(kept) > 0, F.call_function("array_join", kept, args[1].column)), T.StringType())


def _array_agg(args: list[Typed]) -> Typed:
    """NULLs are kept, as a list of one-field structs, and come last."""
    boxed = F.array_sort(F.collect_list(F.struct(args[0].column.isNull().alias("n"), args[0].column.alias("v"))))
    return Typed(F.when(F.size(boxed) > 0, F.transform(boxed, lambda x: x["v"])), T.ArrayType(args[0].type))


def _same(make: Callable[..., Column]) -> Callable[[list[Typed]], Typed]:
    return lambda args: Typed(make(args[0].column), args[0].type)


def _common(make: Callable[..., Column]) -> Callable[[list[Typed]], Typed]:
    return lambda args: Typed(make(*[a.column for a in args]) if len(args) > 1 else args[0].column, common_type(args))


#: name -> least and most arguments, maker
AGGREGATES: dict[str, tuple[int, int, Callable[[list[Typed]], Typed]]] = {
    "COUNT": (1, 1, lambda args: Typed(F.count(args[0].column), T.LongType())),
    "SUM": (1, 1, _sum),
    "MAX": (1, 1, _same(F.max)),
    "MIN": (1, 1, _same(F.min)),
    "AVG": (1, 1, _avg),
    "EVERY": (1, 1, _every),
    "ARRAYAGG": (1, 1, _array_agg),
    "STRINGAGG": (2, 2, _string_agg),
}

SCALARS: dict[str, tuple[int, int, Callable[[list[Typed]], Typed]]] = {
    "NULLIF": (2, 2, lambda args: Typed(F.nullif(args[0].column, args[1].column), args[0].type)),
    "COALESCE": (1, 99, _common(F.coalesce)),
    "GREATEST": (1, 99, _common(F.greatest)),
    "LEAST": (1, 99, _common(F.least)),
}


def call(table: dict, name: str, args: list[Typed]) -> Typed:
    least, most, make = table[name]
    if not least <= len(args) <= most:
        raise ExecuteError(f"{name} takes {least if least == most else f'{least} or more'} arguments, not {len(args)}")
    return make(args)
