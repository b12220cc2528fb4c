"""Checks of rows: failures as rows, as a matrix, as numbers and as reasons. Checks are columns evaluated in place; no join."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestrata.functions.scalars import col


@dataclass(frozen=True)
class Check:
    """A column, a name, and whether a value passes; a null passes unless the check is for nulls."""

    column: str
    name: str
    passes: object

    def failed(self) -> Column:
        return ~F.coalesce(self.passes(col(self.column)), F.lit(True))


def isin(column: str, values: list) -> Check:
    return Check(column, f"isin({values})", lambda c: c.isin(values))


def less_than(column: str, bound) -> Check:
    return Check(column, f"less_than({bound})", lambda c: c < bound)


def greater_than(column: str, bound) -> Check:
    return Check(column, f"greater_than({bound})", lambda c: c > bound)


def at_most(column: str, bound) -> Check:
    return Check(column, f"less_than_or_equal_to({bound})", lambda c: c <= bound)


def at_least(column: str, bound) -> Check:
    return Check(column, f"greater_than_or_equal_to({bound})", lambda c: c >= bound)


def str_length(column: str, least: int = 0, most: int | None = None) -> Check:
    return Check(column, f"str_length({least}, {most})", lambda c: (F.length(c) >= least) & (F.lit(True) if most is None else F.length(c) <= most))


def str_matches(column: str, pattern: str) -> Check:
    """The pattern matches from the start of the text."""
    return Check(column, f"str_matches({pattern})", lambda c: c.rlike(f"^(?:{pattern})"))


def not_blank(column: str) -> Check:
    return Check(column, "not_blank", lambda c: F.trim(c) != "")


def not_null(column: str) -> Check:
    return Check(column, "not_nullable", lambda c: c.isNotNull())


def custom(column: str, name: str, passes) -> Check:
    """passes: Column -> Column."""
    return Check(column, name, passes)


def failure_cases(df: DataFrame, checks: list[Check], row_id: list[str]) -> DataFrame:
    """Row ids, column, check, value (as text) of each failure; no rows if all pass."""
    cells = F.array(*[F.when(k.failed(), F.struct(F.lit(k.column).alias("column"), F.lit(k.name).alias("check"), col(k.column).cast("string").alias("value"))) for k in checks])
    rows = df.select(*[col(c) for c in row_id], F.explode(F.filter(cells, lambda x: x.isNotNull())).alias("f"))
    return rows.select(*[col(c) for c in row_id], "f.*")


def failure_matrix(df: DataFrame, checks: list[Check], row_id: list[str]) -> DataFrame:
    """Row ids and a column {column}|{check} for each check, 1 where it fails; rows without a failure are left out."""
    flags = [F.when(k.failed(), 1).otherwise(0).alias(f"{k.column}|{k.name}") for k in checks]
    return df.select(*[col(c) for c in row_id], *flags).where(reduce(add, [col(f"{k.column}|{k.name}") for k in checks]) > 0)


def _by_column(checks: list[Check]) -> dict[str, list[Check]]:
    out: dict[str, list[Check]] = {}
    for k in checks:
        out.setdefault(k.column, []).append(k)
    return out


def with_errors(df: DataFrame, checks: list[Check]) -> DataFrame:
    """df with {column}_error (sum of the numbers, from 1, of the column's failed checks) and {column}_reason (their names joined by |) of each checked column."""
    made = {}
    for c, own in _by_column(checks).items():
        made[f"{c}_error"] = reduce(add, [F.when(k.failed(), i).otherwise(0) for i, k in enumerate(own, 1)])
        made[f"{c}_reason"] = F.array_join(F.filter(F.array(*[F.when(k.failed(), F.lit(k.name)) for k in own]), lambda x: x.isNotNull()), "|")
    return df.withColumns(made)


def schema_failures(df: DataFrame, expected: dict[str, str]) -> DataFrame:
    """column, check, found: columns that are missing or of another type; no job."""
    have = {f.name: f.dataType.simpleString() for f in df.schema}
    rows = [(c, "column_in_dataframe" if c not in have else f"dtype('{t}')", have.get(c)) for c, t in expected.items() if have.get(c) != t]
    return df.sparkSession.createDataFrame(rows, "column string, check string, found string")
