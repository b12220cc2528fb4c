"""Row filters."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestrata.functions import types
from lodestrata.functions.scalars import col, finite
from lodestrata.operators import quantiles


def _any(tests: list[Column]) -> Column:
    return reduce(or_, tests)


def search(df: DataFrame, term: str | None, regex: bool = False) -> DataFrame:
    """Rows of which a text column contains the term (case-sensitive, literal or a regular expression). No term: all rows; no text column: none."""
    if not term:
        return df
    names = types.columns_of(df, types.is_string)
    if not names:
        return df.where(F.lit(False))
    return df.where(_any([col(c).rlike(term) if regex else col(c).contains(term) for c in names]))


def search_column(df: DataFrame, column: str, term: str | None) -> DataFrame:
    return df.where(col(column).contains(term)) if term else df


def mark_matches(df: DataFrame, term: str, name: str = "matched_columns") -> DataFrame:
    """df with the names of the text columns that contain the term."""
    names = types.columns_of(df, types.is_string)
    found = F.array(*[F.when(col(c).contains(term), F.lit(c)) for c in names]) if names else F.array().cast("array<string>")
    return df.withColumn(name, F.filter(found, lambda x: x.isNotNull()))


def range_filter(df: DataFrame, column: str, lower=None, upper=None) -> DataFrame:
    """Rows strictly between the bounds that are given."""
    for bound, keep in ((lower, lambda b: col(column) > F.lit(b)), (upper, lambda b: col(column) < F.lit(b))):
        df = df.where(keep(bound)) if bound is not None else df
    return df


def remove_outliers(df: DataFrame, column: str, percent: float) -> DataFrame:
    """Rows strictly between the quantiles percent/100 and 1 - percent/100. The quantiles are found at once; the filter holds numbers, which a scan can use."""
    (low, high), = quantiles.column_quantiles(df, [col(column)], [percent / 100, 1 - percent / 100])
    return df.where((col(column) > F.lit(low)) & (col(column) < F.lit(high)))


def only_outliers(df: DataFrame, column: str, tail: float) -> DataFrame:
    """Rows below the quantile tail or above 1 - tail, null first filled with the mean (truncated for integers)."""
    kind = df.schema[column].dataType
    mean = df.agg(F.avg(col(column))).first()[0]
    fill = F.lit(mean).cast(kind)
    filled = df.select(*[F.coalesce(col(c), fill).alias(c) if c == column else col(c) for c in df.columns])
    (low, high), = quantiles.column_quantiles(filled, [col(column)], [tail, 1 - tail])
    return filled.where((col(column) < F.lit(low)) | (col(column) > F.lit(high)))


def any_outliers(df: DataFrame, low: float = 0.01, high: float = 0.99, columns: list[str] | None = None) -> DataFrame:
    """Rows at or beyond the quantiles of any numeric column."""
    names = columns or types.columns_of(df, types.is_numeric_not_bool)
    if not names:
        return df.where(F.lit(False))
    bounds = quantiles.column_quantiles(df, [col(c) for c in names], [low, high])
    return df.where(_any([(col(c) <= F.lit(a)) | (col(c) >= F.lit(b)) for c, (a, b) in zip(names, bounds, strict=True)]))


def rare_rows(df: DataFrame, share: float = 0.01) -> DataFrame:
    """Rows with a value in any column that is under `share` non-null."""
    filled = df.agg(*[F.try_divide(F.count(col(c)), F.count(F.lit(1))).alias(str(i)) for i, c in enumerate(df.columns)]).first()
    rare = [c for c, v in zip(df.columns, filled, strict=True) if v is not None and v < share]
    return df.where(_any([col(c).isNotNull() for c in rare])) if rare else df.where(F.lit(False))


def nullify_nonfinite(df: DataFrame) -> DataFrame:
    """NaN and infinities become null in float columns."""
    return df.select(*[finite(col(f.name)).alias(f.name) if types.is_float(f.dataType) else col(f.name) for f in df.schema])
