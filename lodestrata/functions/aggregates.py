"""Aggregates by name, as expressions for agg() and for windows.

Those that compare a row with the one before it (`ORDERED`) are made of columns that prepare() adds with a lag over the given order.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestrata.functions.scalars import col
from lodestrata.functions.types import is_string
from lodestrata.operators import spread
from lodestrata.sources import shared

#: Bytes of a value of fixed width.
WIDTHS = {"boolean": 1, "tinyint": 1, "smallint": 2, "int": 4, "bigint": 8, "float": 4, "double": 8, "date": 4, "timestamp": 8, "timestamp_ntz": 8}


def about_distinct(*columns: Column, log_size: int = 14) -> Column:
    """About how many different values a column has, nulls left out, or how many different tuples several have: a sketch of 16 kB with a standard error of 0.8 %; log_size is that of its bytes."""
    # a hash passes nulls over: where they stand is hashed too
    key = F.when(columns[0].isNotNull(), F.xxhash64(columns[0])) if len(columns) == 1 else F.xxhash64(*columns, *[c.isNull() for c in columns])
    return F.coalesce(F.hll_sketch_estimate(F.hll_sketch_agg(key, F.lit(log_size))), F.lit(0))


def skew(c: Column) -> Column:
    """Skewness corrected for bias; null for under three values or no spread."""
    n = F.count(c).cast("double")
    return F.when((n > 2) & (F.var_pop(c) > 0), F.skewness(c) * F.sqrt(n * (n - 1)) / (n - 2))


def kurt(c: Column) -> Column:
    """Excess kurtosis corrected for bias; null for under four values or no spread."""
    n = F.count(c).cast("double")
    return F.when((n > 3) & (F.var_pop(c) > 0), (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * F.kurtosis(c) + 6))


def byte_size(c: Column, kind: T.DataType) -> Column:
    if kind.simpleString() in WIDTHS:
        return F.count(c) * WIDTHS[kind.simpleString()]
    text = c if is_string(kind) or kind.simpleString() == "binary" else F.to_json(F.struct(c))
    return F.coalesce(F.sum(F.octet_length(text)), F.lit(0)).cast("long")


def truth(c: Column, kind: T.DataType) -> Column:
    return c if isinstance(kind, T.BooleanType) else F.octet_length(c) > 0 if is_string(kind) else c != 0


#: name -> (column, its type) -> expression
SIMPLE: dict[str, Callable[[Column, T.DataType], Column]] = {
    "mean": lambda c, t: F.avg(c), "median": lambda c, t: F.median(c), "min": lambda c, t: F.min(c), "max": lambda c, t: F.max(c),
    "sum": lambda c, t: F.coalesce(F.sum(c), F.lit(0).cast(t)) if isinstance(t, T.NumericType) else F.sum(c),
    "count": lambda c, t: F.count(c), "count_null": lambda c, t: F.count_if(c.isNull()), "std": lambda c, t: F.stddev_samp(c), "var": lambda c, t: F.var_samp(c),
    "empty": lambda c, t: F.count(F.lit(1)) == 0, "hasnans": lambda c, t: F.coalesce(F.bool_or(c.isNull()), F.lit(False)), "nunique": lambda c, t: F.count_distinct(c),
    "all": lambda c, t: F.coalesce(F.bool_and(truth(c, t)), F.lit(True)), "any": lambda c, t: F.coalesce(F.bool_or(truth(c, t)), F.lit(False)),
    "kurt": lambda c, t: kurt(c), "sem": lambda c, t: F.stddev_samp(c) / F.sqrt(F.count(c)), "skew": lambda c, t: skew(c),
    "dtype": lambda c, t: F.max(F.lit(t.simpleString())), "dtypes": lambda c, t: F.max(F.lit(t.simpleString())), "nbytes": byte_size, "ndim": lambda c, t: F.max(F.lit(1)), "size": lambda c, t: F.count(F.lit(1)),
}
#: These need an order of rows.
ORDERED = ("is_monotonic", "is_monotonic_increasing", "is_monotonic_decreasing", "autocorr", "idxmax", "idxmin")
#: Of these, those that compare a row with the one before it.
BEFORE = ORDERED[:4]
#: This needs the group's mean first.
CENTRED = ("mad",)
NAMES = (*SIMPLE, *ORDERED, *CENTRED)


def helper(column: str, what: str) -> str:
    return f"__{what}_{column}"


def _with_before(df: DataFrame, columns: list[str], keys: list[str], order_by: list[str]) -> DataFrame:
    """df with each column's value in the row before, within the keys: found within ranges of (keys, order), whose last rows are carried to the next range."""
    ranged = df.repartitionByRange(*[col(k) for k in [*keys, *order_by]]).withColumn("__part", F.spark_partition_id())
    ranged = shared.keep(ranged)  # both uses below must see the same ranges
    own, order = [col(k) for k in keys], [col(o) for o in order_by]
    inside = Window.partitionBy("__part", *own).orderBy(*order)
    lasts = ranged.withColumn("__next", F.lead(F.lit(1)).over(inside)).where("__next is null")  # a row a range and key
    over = Window.partitionBy(*own).orderBy("__part")
    carried = lasts.select(F.col("__part").alias("__at"), *[c.alias(f"__key{i}") for i, c in enumerate(own)], *[F.lag(col(c)).over(over).alias(f"__carry{i}") for i, c in enumerate(columns)])
    found = ranged.withColumns({"__first": F.lag(F.lit(1)).over(inside).isNull(), **{helper(c, "before"): F.lag(col(c)).over(inside) for c in columns}})
    met = F.col("__part") == F.col("__at")
    for i, c in enumerate(own):
        met = met & c.eqNullSafe(F.col(f"__key{i}"))
    out = found.join(carried, met, "left")
    return out.select(*[col(c) for c in df.columns], *[F.when(F.col("__first"), F.col(f"__carry{i}")).otherwise(col(helper(c, "before"))).alias(helper(c, "before")) for i, c in enumerate(columns)])


def _with_apart(df: DataFrame, columns: list[str], keys: list[str]) -> DataFrame:
    """df with each column's distance from its group's mean; groups are aggregated first and joined to the rows."""
    means = df.groupBy(*[col(k).alias(f"__key{i}") for i, k in enumerate(keys)]).agg(F.count(F.lit(1)).alias("__n"), *[F.avg(col(c)).alias(f"__mean{i}") for i, c in enumerate(columns)])
    out = spread.look_up(df, means, {k: f"__key{i}" for i, k in enumerate(keys)}, "__n", nulls=True) if keys else df.crossJoin(means)
    return out.select(*[col(c) for c in df.columns], *[F.abs(col(c) - F.col(f"__mean{i}")).alias(helper(c, "apart")) for i, c in enumerate(columns)])


def _with_most(df: DataFrame, columns: list[str], keys: list[str]) -> DataFrame:
    """df with whether each column's value is its group's largest."""
    most = df.groupBy(*[col(k).alias(f"__key{i}") for i, k in enumerate(keys)]).agg(F.count(F.lit(1)).alias("__n"), *[F.max(col(c)).alias(f"__most{i}") for i, c in enumerate(columns)])
    out = spread.look_up(df, most, {k: f"__key{i}" for i, k in enumerate(keys)}, "__n", nulls=True) if keys else df.crossJoin(most)
    return out.select(*[col(c) for c in df.columns], *[(col(c) == F.col(f"__most{i}")).alias(helper(c, "most")) for i, c in enumerate(columns)])


def prepare(df: DataFrame, wanted: list[tuple[str, str]], keys: list[str], order_by: list[str] | None) -> DataFrame:
    """df with the columns that the wanted (column, name) aggregates are made of."""
    ordered = list(dict.fromkeys(c for c, name in wanted if name in ORDERED))
    centred = list(dict.fromkeys(c for c, name in wanted if name in CENTRED))
    if ordered and not order_by:
        raise ValueError(f"{next(name for _, name in wanted if name in ORDERED)} needs order_by")
    largest = list(dict.fromkeys(c for c, name in wanted if name == "idxmax" and not isinstance(df.schema[c].dataType, T.NumericType)))
    before = [c for c in ordered if any(name in BEFORE for other, name in wanted if other == c)]
    df = _with_before(df, before, keys, order_by) if before else df
    df = _with_most(df, largest, keys) if largest else df
    return _with_apart(df, centred, keys) if centred else df


def expression(df: DataFrame, column: str, name: str, order_by: list[str] | None = None) -> Column:
    c, kind = col(column), df.schema[column].dataType
    if name in SIMPLE:
        return SIMPLE[name](c, kind)
    before = col(helper(column, "before"))
    if name in ("is_monotonic", "is_monotonic_increasing"):
        return F.coalesce(F.bool_and(c >= before), F.lit(True)) & (F.count(c) == F.count(F.lit(1)))
    if name == "is_monotonic_decreasing":
        return F.coalesce(F.bool_and(c <= before), F.lit(True)) & (F.count(c) == F.count(F.lit(1)))
    if name == "autocorr":
        return F.corr(c, before)
    if name == "mad":
        return F.avg(col(helper(column, "apart")))
    if name in ("idxmax", "idxmin"):
        # of equal values the first in the order wins: null-safe, any type of order
        first = F.struct(*[col(o) for o in order_by])
        if name == "idxmin":
            return F.min(F.when(c.isNotNull(), F.struct(c.alias("v"), first.alias("at"))))["at"][order_by[0]]
        if not isinstance(kind, T.NumericType):
            return F.min(F.when(col(helper(column, "most")), first))[order_by[0]]
        falls = F.bitwise_not(c) if isinstance(kind, T.IntegralType) else -c
        return F.min(F.when(c.isNotNull(), F.struct(falls.alias("v"), first.alias("at"))))["at"][order_by[0]]
    raise ValueError(f"no aggregate {name}; there are {', '.join(NAMES)}")
