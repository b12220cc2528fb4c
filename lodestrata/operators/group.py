"""Grouping: one row a key, or a group's aggregate on each of its rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.functions import aggregates
from lodestrata.functions.scalars import col
from lodestrata.operators import quantiles, spread


def _wanted(spec: dict[str, str | list[str]]) -> list[tuple[str, str]]:
    """(column, aggregate) pairs; "null" skips a column."""
    return [(c, a) for c, names in spec.items() for a in ([names] if isinstance(names, str) else names) if a != "null"]


#: Types whose values doubles hold exactly, so that those counted for a median tell how many are different.
_EXACT_AS_DOUBLE = ("tinyint", "smallint", "int", "float", "double")


def _medians(rows: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """__of, __median{i} and __distinct{i}: medians of groups and their numbers of different values, from values counted once and ranked along their order, so that no task holds a group's values."""
    tall = rows.select(F.explode(F.array(*[F.struct(F.struct(col(key).alias("k"), F.lit(i).alias("i")).alias("column"), col(c).cast("double").alias("v")) for i, c in enumerate(columns)])).alias("c")).select("c.*")
    found = quantiles.grouped_quantiles(tall, [0.5])
    made = [F.max(F.when(F.col("column.i") == i, F.col(what))).alias(f"{name}{i}") for i in range(len(columns)) for what, name in (("q", "__median"), ("distinct", "__distinct"))]
    return found.groupBy(F.col("column.k").alias("__of")).agg(*made)


def _aggregated(rows: DataFrame, key: str, wanted: list[tuple[str, str]], order_by: list[str] | None, name: str, counted: bool = False) -> DataFrame:
    medians = list(dict.fromkeys(c for c, a in wanted if a == "median"))
    ranked = lambda c, a: a == "median" or (a == "nunique" and c in medians and rows.schema[c].dataType.simpleString() in _EXACT_AS_DOUBLE)
    plain = [(c, a) for c, a in wanted if not ranked(c, a)]
    at = {(c, a): F.coalesce(F.col(f"__distinct{medians.index(c)}"), F.lit(0)) if a == "nunique" else F.col(f"__median{medians.index(c)}") for c, a in wanted if ranked(c, a)}
    found = aggregates.prepare(rows, plain, [key], order_by)
    # an aggregate at least, so that every group has its row
    grouped = found.groupBy(col(key)).agg(F.count(F.lit(1)).alias("__n"), *[aggregates.expression(found, c, a, order_by).alias(name.format(column=c, aggregate=a)) for c, a in plain])
    if medians:
        grouped = grouped.join(_medians(rows, key, medians), col(key).eqNullSafe(F.col("__of")), "left")
    label = lambda c, a: name.format(column=c, aggregate=a)
    return grouped.select(col(key), *(["__n"] if counted else []), *[at.get((c, a), col(label(c, a))).alias(label(c, a)) for c, a in wanted])


def group_by(df: DataFrame, key: str, spec: dict[str, str | list[str]], order_by: list[str] | None = None, name: str = "{column}_{aggregate}") -> DataFrame:
    """One row for each non-null key. name: how results are called, of {column} and {aggregate}."""
    return _aggregated(df.where(col(key).isNotNull()), key, _wanted(spec), order_by, name)


def group_by_sorted(df: DataFrame, key: str, spec: dict[str, str | list[str]]) -> DataFrame:
    """As group_by, with names like c(sum) and keys descending; a null key is a group."""
    return _aggregated(df, key, _wanted(spec), None, "{column}({aggregate})").orderBy(col(key).desc_nulls_last())


def group_by_transform(df: DataFrame, key: str, spec: dict[str, str | list[str]], order_by: list[str] | None = None) -> DataFrame:
    """df with {column}_{aggregate} of each row's group; null for a null key.

    Groups are aggregated first and joined to the rows; the rows of a frequent key aren't gathered in one task.
    """
    wanted = _wanted(spec)
    own = "__group_key"
    groups = _aggregated(df.where(col(key).isNotNull()), key, wanted, order_by, "{column}_{aggregate}", counted=True).withColumnRenamed(key, own)
    out = spread.look_up(df, groups, {key: own}, "__n")
    return out.select(*[col(c) for c in df.columns], *[col(f"{c}_{a}") for c, a in wanted])


def largest_group(df: DataFrame, keys: list[str]) -> DataFrame:
    """One row: rows of the largest group of a key; null is a group."""
    return df.groupBy(*[col(k) for k in keys]).count().agg(F.max("count").alias("max_group"))


def whole_table(df: DataFrame, spec: dict[str, str | list[str]], order_by: list[str] | None = None) -> DataFrame:
    """One row with the aggregates of all rows."""
    wanted = _wanted(spec)
    rows = aggregates.prepare(df, wanted, [], order_by)
    return rows.agg(*[aggregates.expression(df, c, a, order_by).alias(f"{c}_{a}") for c, a in wanted])


