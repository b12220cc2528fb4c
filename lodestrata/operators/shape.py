"""Column operations and operations on one column's values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestrata.functions import scalars as S
from lodestrata.functions import types
from lodestrata.functions.scalars import col
from lodestrata.operators import spread
from lodestrata.operators.running import running_sum


def no_op(df: DataFrame) -> DataFrame:
    return df


def drop_column(df: DataFrame, column: str) -> DataFrame:
    return df.select(*[col(c) for c in df.columns if c != column])


def drop_null_columns(df: DataFrame) -> DataFrame:
    """Without columns that are entirely null; one job counts all."""
    counts = df.agg(*[F.count(col(c)).alias(str(i)) for i, c in enumerate(df.columns)]).first()
    return df.select(*[col(c) for c, n in zip(df.columns, counts, strict=True) if n])


def first_columns(df: DataFrame, most: int = 250) -> DataFrame:
    return df.select(*[col(c) for c in df.columns[:most]])


def promote_to_index(df: DataFrame, column: str) -> DataFrame:
    """The column first, as `index`. A column that has that name already gets a trailing underscore."""
    rest = [col(c).alias("index_" if c == "index" else c) for c in df.columns if c != column]
    return df.select(col(column).alias("index"), *rest)


def transpose(df: DataFrame, index_column: str | None = None, most_rows: int = 1000) -> DataFrame:
    """Rows as columns, for tables of at most most_rows rows."""
    if df.limit(most_rows + 1).count() > most_rows:
        raise ValueError(f"only tables of up to {most_rows} rows can be transposed")
    return df.transpose(col(index_column) if index_column else None)


def flag(df: DataFrame, column: str, threshold: float, message: str, name: str = "error") -> DataFrame:
    """df with a message where the column is below the threshold."""
    return df.withColumn(name, F.when(col(column) < threshold, F.lit(message)))


def replace_column(df: DataFrame, column: str, made: Column) -> DataFrame:
    return df.select(*[made.alias(c) if c == column else col(c) for c in df.columns])


def with_originals(df: DataFrame, cleaned: dict[str, Column]) -> DataFrame:
    """Each cleaned column, with what it was beside it as {column}_orig."""
    out = []
    for c in df.columns:
        out += [cleaned[c].alias(c), col(c).alias(f"{c}_orig")] if c in cleaned else [col(c)]
    return df.select(*out)


def fill_null(df: DataFrame, column: str, value) -> DataFrame:
    return replace_column(df, column, F.coalesce(col(column), F.lit(value)))


def replace_value(df: DataFrame, column: str, old, new) -> DataFrame:
    return replace_column(df, column, F.when(col(column) == F.lit(old), F.lit(new)).otherwise(col(column)))


def one_hot(df: DataFrame, column: str, most: int = 1000) -> DataFrame:
    """Without the column, with a boolean column for each of its values (sorted); null is false in all."""
    values = [r[0] for r in df.select(col(column)).where(col(column).isNotNull()).distinct().orderBy(col(column)).limit(most + 1).collect()]
    if len(values) > most:
        raise ValueError(f"{column} has over {most} values")
    return df.select(*[col(c) for c in df.columns if c != column], *[F.coalesce(col(column) == F.lit(v), F.lit(False)).alias(str(v)) for v in values])


def safe_int(df: DataFrame, column: str) -> DataFrame:
    """Numbers as the narrowest integer type if all are whole, else as they parse; other values are null. A column named index stays."""
    if column == "index":
        return df
    d = S.parse_number(col(column))
    lo, hi, fractions = df.agg(F.min(d), F.max(d), F.count_if(d != F.floor(d))).first()
    return replace_column(df, column, d if fractions else d.cast(S.narrowest_int(None if lo is None else int(lo), None if hi is None else int(hi))))


def narrow_int(df: DataFrame, column: str) -> DataFrame:
    """An integer column in the narrowest type that holds its values."""
    lo, hi = df.agg(F.min(col(column)), F.max(col(column))).first()
    return replace_column(df, column, col(column).cast(S.narrowest_int(lo, hi)))


#: Coercions by the name of the type.
COERCIONS = {"bool": S.bool_from_number, "datetime": S.parse_datetime, "int": lambda c: S.truncated(S.parse_number(c)), "float": S.parse_number, "string": S.to_text}
#: Column cleaners by name.
CLEANERS = {"safe_int": lambda c: S.whole(S.parse_number(c)), "regular_int_parse": S.parse_number, "strip_int_parse": S.strip_int, "str_bool": S.parse_bool_word, "us_date": S.parse_us_date, "strip_int_and_period": S.digits_and_period}


def coerce(df: DataFrame, column: str, kind: str) -> DataFrame:
    if kind not in COERCIONS:
        raise ValueError(f"no type {kind}; there are {', '.join(COERCIONS)}")
    return replace_column(df, column, COERCIONS[kind](col(column)))


def to_datetime_strict(df: DataFrame, column: str) -> DataFrame:
    return replace_column(df, column, S.strict_datetime(col(column)))


def make_category(df: DataFrame, column: str) -> DataFrame:
    """The column marked as categorical, and its values' places in sorted order as {column}_code (null: -1). Distinct values are ranked, not rows."""
    values = df.where(col(column).isNotNull()).groupBy(col(column).alias("__v")).agg(F.count(F.lit(1)).alias("__n"))
    codes = running_sum(values, "__v", {"__place": F.lit(1)}).select("__v", "__n", (F.col("__place") - 1).alias("__code"))
    out = spread.look_up(df, codes, {column: "__v"}, "__n")
    own = [col(c).alias(c, metadata={"categorical": True}) if c == column else col(c) for c in df.columns]
    return out.select(*own, F.coalesce("__code", F.lit(-1)).alias(f"{column}_code"))


def nested_to_text(df: DataFrame) -> DataFrame:
    """Nested, binary and interval columns as text."""
    odd = lambda f: types.semantic_type(f) in ("obj", "binary", "duration", "time")
    return df.select(*[S.as_text(col(f.name), f.dataType).alias(f.name) if odd(f) else col(f.name) for f in df.schema])
