"""Duplicates of a column's values."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.functions.scalars import col
from lodestrata.operators import spread


def distinct_on(df: DataFrame, column: str, order_by: list[str], keep: str = "first") -> DataFrame:
    """Whole rows, one for each value: the first or last in the order, or (keep="none") only those whose value occurs once.

    Rows are picked by an aggregate that is combined before the shuffle, so a hot value costs no sort.
    """
    if keep not in ("first", "last", "none"):
        raise ValueError(f"keep is first, last or none, not {keep}")
    row = F.struct(*[col(c) for c in df.columns])
    place = F.struct(*[col(o) for o in order_by])
    pick = F.max_by(row, place) if keep == "last" else F.min_by(row, place)
    picked = df.groupBy(col(column).alias("__v")).agg(pick.alias("__row"), F.count(F.lit(1)).alias("__n"))
    picked = picked.where("__n = 1") if keep == "none" else picked
    return picked.select(*[F.col("__row")[c].alias(c) for c in df.columns])


def drop_duplicates(df: DataFrame, column: str, keep: str = "first") -> DataFrame:
    """The column's values without duplicates: which of equal values is kept doesn't show, but none drops all of them."""
    if keep not in ("first", "last", "none"):
        raise ValueError(f"keep is first, last or none, not {keep}")
    counted = df.groupBy(col(column)).count()
    return (counted.where("count = 1") if keep == "none" else counted).select(col(column))


def distinct_tuples(df: DataFrame, columns: list[str]) -> int:
    """Distinct tuples; null is a value."""
    return df.select(*[col(c) for c in columns]).distinct().count()


def mark_duplicates(df: DataFrame, column: str, name: str = "is_duplicated") -> DataFrame:
    """df with whether each row's value occurs more than once; null is a value."""
    counted = df.groupBy(col(column).alias("__v")).agg(F.count(F.lit(1)).alias("__n")).where("__n > 1").withColumn("__dup", F.lit(True))
    out = spread.look_up(df, counted, {column: "__v"}, "__n", nulls=True)
    return out.select(*[col(c) for c in df.columns], F.coalesce("__dup", F.lit(False)).alias(name))
