"""Ranks, row numbers, pages and samples. Spark tables have no order: callers name it."""

from __future__ import annotations

from weakref import WeakKeyDictionary

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestrata.functions.scalars import col
from lodestrata.operators import selection, spread
from lodestrata.operators.filters import search
from lodestrata.operators.running import running_sum

MOST_PAGE_ROWS = 10_000
#: Rows before the end of a page that each task may hold to sort it out; a deeper page is found by numbers.
MOST_HELD_ROWS = 100_000
_counts: WeakKeyDictionary = WeakKeyDictionary()


def row_count(df: DataFrame) -> int:
    """Rows of a table, counted once as long as the caller holds it."""
    if df not in _counts:
        _counts[df] = df.count()
    return _counts[df]


def rank(df: DataFrame, column: str, method: str = "min", new_name: str | None = None) -> DataFrame:
    """df with the rank of each value (min, dense or average), in place or as a new column; null stays null.

    Distinct values with their counts are ranked and joined to the rows, so that no task sorts the rows.
    """
    if method not in ("min", "dense", "average"):
        raise ValueError(f"method is min, dense or average, not {method}")
    if new_name and new_name in df.columns:
        raise ValueError(f"{new_name} is there already")
    counted = df.where(col(column).isNotNull()).groupBy(col(column).alias("__v")).agg(F.count(F.lit(1)).alias("__n"))
    numbered = running_sum(counted, "__v", {"__upto": F.col("__n"), "__dense": F.lit(1)})
    least = F.col("__upto") - F.col("__n") + 1
    made = {"min": least, "dense": F.col("__dense"), "average": least + (F.col("__n") - 1) / 2}[method].cast("double")
    ranks = numbered.select("__v", "__n", made.alias("__rank"))
    out = spread.look_up(df, ranks, {column: "__v"}, "__n")
    if new_name:
        return out.select(*[col(c) for c in df.columns], F.col("__rank").alias(new_name))
    return out.select(*[F.col("__rank").alias(c) if c == column else col(c) for c in df.columns])


def tag_rows(df: DataFrame, order_by: list[str], name: str = "rowid") -> DataFrame:
    """df with dense row numbers from 0 in the order, which must be total. Fails if the column is there already."""
    if name in df.columns:
        raise ValueError(f"{name} is there already")
    numbered = running_sum(df, [col(o) for o in order_by], {"__number": F.lit(1)})
    return numbered.select((F.col("__number") - 1).alias(name), *[col(c) for c in df.columns])


def clamp_window(start, end, total: int, most: int = MOST_PAGE_ROWS) -> tuple[int, int]:
    """A window within 0..total of at most `most` rows; what is no number is 0."""

    def number(x) -> int:
        try:
            return int(x)
        except (TypeError, ValueError, OverflowError):
            return 0

    lo = min(max(number(start), 0), total)
    hi = min(max(number(end), lo), total)
    return lo, min(hi, lo + most)


def page(df: DataFrame, start: int, end: int, sort: str | None = None, ascending: bool = True, order_by: list[str] | None = None) -> DataFrame:
    """Rows start to end (exclusive) of the sorted table, with their absolute places in `index`. Nulls come last either way; order_by settles ties, and is the order if the sort column is unknown.

    A page near the start is kept by each task in its heap; for a deep one rows are numbered within ranges of the order, so no task holds more than its range.
    """
    ties = [col(c).asc_nulls_last() for c in order_by or df.columns]
    keys = ([col(sort).asc_nulls_last() if ascending else col(sort).desc_nulls_last()] if sort in df.columns else []) + ties
    if end > MOST_HELD_ROWS:
        numbered = running_sum(df, keys, {"__number": F.lit(1)}).where((F.col("__number") > start) & (F.col("__number") <= end))
        return numbered.select((F.col("__number") - 1).alias("index"), *[col(c) for c in df.columns])
    window = df.orderBy(*keys).offset(start).limit(max(end - start, 0))
    # a page has at most MOST_PAGE_ROWS rows, so one task can number it
    return window.select((F.row_number().over(Window.orderBy(*keys)) - 1 + start).alias("index"), *[col(c) for c in df.columns])


def page_searched(df: DataFrame, term: str | None, start, end, sort: str | None = None, ascending: bool = True, order_by: list[str] | None = None) -> tuple[DataFrame, int]:
    """A page of the rows that contain the term, and how many there are."""
    found = search(df, term)
    total = found.count()
    lo, hi = clamp_window(start, end, total)
    return page(found, lo, hi, sort, ascending, order_by), total


def sort_permutation(tagged: DataFrame, column: str, ascending: bool = True, row_id: str = "rowid") -> DataFrame:
    """Row numbers in the order of a column, nulls last, ties by number."""
    key = col(column).asc_nulls_last() if ascending else col(column).desc_nulls_last()
    return tagged.orderBy(key, col(row_id)).select(col(row_id))


def matching_rows(tagged: DataFrame, condition, row_id: str = "rowid") -> DataFrame:
    return tagged.where(condition).select(col(row_id))


def rows_between(tagged: DataFrame, start: int, end: int, row_id: str = "rowid") -> DataFrame:
    """Rows by their numbers: a deep page costs no sort."""
    return tagged.where((col(row_id) >= start) & (col(row_id) < end))


def first_row(df: DataFrame, order_by: list[str] | None = None) -> DataFrame:
    return (df.orderBy(*[col(c) for c in order_by]) if order_by else df).limit(1)


def sample_rows(df: DataFrame, most: int, seed: int = 1, total: int | None = None) -> DataFrame:
    """Exactly `most` rows of a larger table, drawn evenly by a hash of seed and row, so the same however rows are dealt over tasks; a table that is no larger stays whole."""
    total = row_count(df) if total is None else total
    return df if total <= most else selection.least_rows(df, most, seed)


def sample_cells(df: DataFrame, most_cells: int = 1_000_000, rows: int = 50_000, seed: int = 1) -> DataFrame:
    """A sample of `rows` rows if the table has over most_cells cells."""
    total = row_count(df)
    return sample_rows(df, rows, seed, total) if total * len(df.columns) > most_cells else df


def display_sample(df: DataFrame, most: int = 5_000) -> DataFrame:
    return df.limit(most)
