"""Statistics of columns: built-in ones, a registry for the user's own, and their order."""

from __future__ import annotations

import inspect
from collections.abc import Callable
from dataclasses import dataclass, field
from graphlib import CycleError, TopologicalSorter

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestrata.functions import aggregates, types
from lodestrata.functions.scalars import col
from lodestrata.operators import quantiles

MISSING = object()


@dataclass(frozen=True)
class Stat:
    """A statistic: make(column, type) is an aggregate, make(**needs) an expression of other statistics of the same column, or query(df, columns) runs its own query."""

    name: str
    make: Callable[..., Column]
    test: types.TypeTest = types.everything
    needs: tuple[str, ...] = ()
    default: object = MISSING
    tags: frozenset = field(default_factory=frozenset)
    query: Callable | None = None
    returns: str = "double"


def stat(name: str | None = None, column_filter: types.TypeTest = types.everything, default: object = MISSING) -> Callable:
    """Makes a function a statistic. A parameter named `column` makes it an aggregate of the column (a second one, `kind`, gets its type); else parameters name the statistics it needs."""

    def wrap(fn: Callable) -> Stat:
        parameters = list(inspect.signature(fn).parameters)
        if parameters[:1] == ["column"]:
            make = fn if parameters[1:] == ["kind"] else lambda column, kind: fn(column)
            return Stat(name or fn.__name__, make, column_filter, (), default)
        return Stat(name or fn.__name__, fn, column_filter, tuple(parameters), default)

    return wrap


def query_stat(name: str | None = None, column_filter: types.TypeTest = types.everything, returns: str = "double") -> Callable:
    """Makes a function (df, columns) -> {column: value} a statistic that runs its own query over the table, one for all columns it applies to. returns: the values' type."""

    def wrap(fn: Callable) -> Stat:
        return Stat(name or fn.__name__, fn, column_filter, query=fn, returns=returns)

    return wrap


def in_order(stats: list[Stat]) -> list[Stat]:
    """Statistics after those they need. A need that nothing gives, or a cycle, is an error."""
    by_name = {s.name: s for s in stats}
    for s in stats:
        for n in s.needs:
            if n not in by_name:
                raise ValueError(f"statistic {s.name} needs {n}, which isn't there")
    try:
        return [by_name[n] for n in TopologicalSorter({s.name: s.needs for s in stats}).static_order()]
    except CycleError as e:
        raise ValueError(f"statistics need each other: {e.args[1]}") from e


def for_column(ordered: list[Stat], kind: T.DataType) -> list[Stat]:
    """Those that apply to a type; one whose need doesn't apply goes as well."""
    out: list[Stat] = []
    for s in ordered:
        if s.test(kind) and all(any(n == o.name for o in out) for n in s.needs):
            out.append(s)
    return out


def numbers(t: T.DataType) -> bool:
    return types.is_numeric_not_bool(t)


def _double(c: Column) -> Column:
    return c.cast("double")


hashable = types.not_(types.is_nested)

BASE: list[Stat] = [
    stat("length")(lambda column: F.count(F.lit(1))),
    stat("null_count")(lambda column: F.count_if(column.isNull())),
    stat("non_null_count")(lambda length, null_count: length - null_count),
    stat("nan_per")(lambda length, null_count: F.coalesce(F.try_divide(null_count, length), F.lit(0.0))),
    stat("min", numbers)(lambda column: F.min(column)),
    stat("max", numbers)(lambda column: F.max(column)),
    stat("mean", numbers)(lambda column: _double(F.avg(column))),
    stat("std", numbers)(lambda column: _double(F.stddev_samp(column))),
    stat("empty_count", types.is_string)(lambda column: F.count_if(column == "")),
    stat("empty_per", types.is_string)(lambda length, empty_count: F.coalesce(F.try_divide(empty_count, length), F.lit(0.0))),
    stat("memory_usage")(lambda column, kind: aggregates.byte_size(column, kind)),
]


def _exact(*probabilities: float) -> Callable:
    """A query for quantiles of all columns together."""

    def run(df, columns: list[str]) -> dict:
        found = quantiles.column_quantiles(df, [col(c) for c in columns], list(probabilities))
        return {c: (v if len(v) > 1 else v[0]) for c, v in zip(columns, found, strict=True) if v[0] is not None}

    return run


QUANTILES: list[Stat] = [
    query_stat("quartiles", numbers, "array<double>")(_exact(0.25, 0.5, 0.75)),
    stat("median", numbers)(lambda quartiles: quartiles[1]),
    stat("q1", numbers)(lambda quartiles: quartiles[0]),
    stat("q3", numbers)(lambda quartiles: quartiles[2]),
    stat("iqr", numbers)(lambda q1, q3: q3 - q1),
]
APPROXIMATE: list[Stat] = [
    stat("median", numbers)(lambda column: _double(F.percentile_approx(column, 0.5))),
    stat("distinct_count", lambda t: hashable(t) and not types.is_float(t) and not isinstance(t, T.DecimalType))(lambda column: aggregates.about_distinct(column)),
    stat("distinct_per")(lambda length, distinct_count: F.coalesce(F.try_divide(distinct_count, length), F.lit(0.0))),
]
#: Those of APPROXIMATE for every hashable column, floats too.
APPROXIMATE_ALL: list[Stat] = [APPROXIMATE[0], stat("distinct_count", hashable)(lambda column: aggregates.about_distinct(column))]
EXTRA: list[Stat] = [
    stat("sum", numbers)(lambda column, kind: F.sum(column.cast("decimal(38,0)") if types.is_integer(kind) else column)),
    stat("variance", numbers)(lambda column: _double(F.var_samp(column))),
    stat("value_range", numbers)(lambda max, min: _double(max) - _double(min)),  # noqa: A006
    stat("cv", numbers)(lambda mean, std: F.try_divide(std, mean)),
    query_stat("quin99", numbers)(_exact(0.99)),
    stat("probable_datetime", types.is_string)(lambda column: (F.count(F.try_to_timestamp(column)) == F.count(column)) & (F.max(F.try_to_timestamp(column)) >= F.lit("1973-01-01").cast("timestamp"))),
]
