"""Semantic types of columns, type predicates and their combinators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import types as T

TypeTest = Callable[[T.DataType], bool]
TEMPORAL = (T.DateType, T.TimestampType, T.TimestampNTZType)


def is_boolean(t: T.DataType) -> bool:
    return isinstance(t, T.BooleanType)


def is_numeric(t: T.DataType) -> bool:
    """Numbers and booleans."""
    return isinstance(t, (T.NumericType, T.BooleanType))


def is_numeric_not_bool(t: T.DataType) -> bool:
    return isinstance(t, T.NumericType)


def is_integer(t: T.DataType) -> bool:
    return isinstance(t, T.IntegralType)


def is_float(t: T.DataType) -> bool:
    return isinstance(t, (T.FloatType, T.DoubleType))


def is_string(t: T.DataType) -> bool:
    return isinstance(t, (T.StringType, T.CharType, T.VarcharType))


def is_temporal(t: T.DataType) -> bool:
    return isinstance(t, TEMPORAL)


def is_nested(t: T.DataType) -> bool:
    return isinstance(t, (T.ArrayType, T.MapType, T.StructType)) or t.typeName() == "variant"


def any_of(*tests: TypeTest) -> TypeTest:
    return lambda t: any(f(t) for f in tests)


def not_(test: TypeTest) -> TypeTest:
    return lambda t: not test(t)


def everything(t: T.DataType) -> bool:
    return True


def semantic_type(field: T.StructField) -> str:
    """boolean, integer, float, decimal, datetime, duration, time, categorical, binary, string or obj."""
    t = field.dataType
    if field.metadata.get("categorical"):
        return "categorical"
    for test, name in ((is_boolean, "boolean"), (is_integer, "integer"), (is_float, "float"), (is_temporal, "datetime"), (is_string, "string")):
        if test(t):
            return name
    if isinstance(t, T.DecimalType):
        return "decimal"
    if isinstance(t, (T.DayTimeIntervalType, T.YearMonthIntervalType)):
        return "duration"
    if isinstance(t, T.BinaryType):
        return "binary"
    return "time" if t.typeName().startswith("time(") or t.typeName() == "time" else "obj"


FLAGS = {
    "is_numeric": is_numeric, "is_integer": is_integer, "is_float": is_float, "is_bool": is_boolean, "is_datetime": is_temporal, "is_string": is_string,
    "is_decimal": lambda t: isinstance(t, T.DecimalType), "is_binary": lambda t: isinstance(t, T.BinaryType), "is_timedelta": lambda t: isinstance(t, T.DayTimeIntervalType),
    "is_time": lambda t: t.typeName().startswith("time(") or t.typeName() == "time",
    # kinds that Spark has no type for
    "is_period": lambda t: False, "is_interval": lambda t: isinstance(t, T.YearMonthIntervalType),
}


def type_table(df: DataFrame) -> DataFrame:
    """A row for each column: name, dtype, semantic type and flags; no job."""
    rows = [(f.name, f.dataType.simpleString(), semantic_type(f), bool(f.metadata.get("categorical")), *(test(f.dataType) for test in FLAGS.values())) for f in df.schema]
    schema = "column string, dtype string, type string, is_categorical boolean, " + ", ".join(f"{k} boolean" for k in FLAGS)
    return df.sparkSession.createDataFrame(rows, schema)


def columns_of(df: DataFrame, test: TypeTest) -> list[str]:
    return [f.name for f in df.schema if test(f.dataType)]
