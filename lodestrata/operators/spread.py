"""Rows joined to a table of one row a key, where a few keys may have most of the rows."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.functions.scalars import col

#: Rows of one key that may meet in a task, and how many keys are broadcast at most: beyond their product, 1e11 rows, a task may meet a MOST_KEYS-th of all rows.
MOST_ROWS, MOST_KEYS = 1_000_000, 100_000


def look_up(rows: DataFrame, groups: DataFrame, keys: dict[str, str], count: str, nulls: bool = False) -> DataFrame:
    """rows (all of them) with the columns of groups that are neither keys nor the count.

    groups has one row a key and, in `count`, how many of the rows have it; keys: a column of groups by the column of rows that it equals; nulls: whether null equals null.
    Rows of frequent keys, and those without a key, stay where they are: frequent keys are broadcast. Only other rows are shuffled. rows is read twice where there is a frequent key.
    """
    made = [c for c in groups.columns if c != count and c not in keys.values()]
    met = reduce(and_, [col(k).eqNullSafe(F.col(g)) if nulls else col(k) == F.col(g) for k, g in keys.items()])
    most = groups.agg(F.greatest(F.lit(MOST_ROWS), F.floor(F.sum(count) / MOST_KEYS)).alias("__most"))
    marked = groups.crossJoin(F.broadcast(most))  # one row
    hot, others = marked.where(F.col(count) >= F.col("__most")), marked.where(F.col(count) < F.col("__most")).drop("__most")
    out = [*[col(c) for c in rows.columns], *[col(c) for c in made]]
    rest = rows.join(F.broadcast(hot), met, "left_anti")
    if nulls:
        here = rows.join(F.broadcast(hot), met, "inner")
    else:
        keyless = reduce(lambda a, b: a | b, [col(k).isNull() for k in keys])
        here = rows.join(F.broadcast(hot), met, "left").where(F.col("__most").isNotNull() | keyless)
        rest = rest.where(~keyless)
    return here.select(*out).unionByName(rest.join(others, met, "left").select(*out))
