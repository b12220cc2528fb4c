"""The k least rows by a hash, found by digits: a sample of an exact size, the same however rows are dealt over tasks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestrata.functions import types
from lodestrata.functions.scalars import col

BITS = 16


def row_hash(df: DataFrame, seed: int) -> Column:
    """A hash of a whole row: equal rows have equal ones."""
    values = [F.to_json(F.struct(col(f.name))) if types.is_nested(f.dataType) else col(f.name) for f in df.schema]
    return F.xxhash64(F.lit(seed), *[x for v in values for x in (v, v.isNull())])


def kth_least(df: DataFrame, key: str, k: int) -> tuple[int, int] | None:
    """(t, m): of the k least values of a column of longs those below t and m of those equal to it; None if there are no more than k. Each pass counts the rows of one digit, 2**BITS at most."""
    # with the sign bit turned, values are in the order of their bits
    turned = F.col(key).bitwiseXOR(F.lit(-(1 << 63)))
    prefix, left = 0, k
    for shift in range(64 - BITS, -1, -BITS):
        own = df if shift == 64 - BITS else df.where(F.shiftrightunsigned(turned, shift + BITS) == prefix)
        counts = own.groupBy(F.shiftrightunsigned(turned, shift).bitwiseAND((1 << BITS) - 1).alias("digit")).agg(F.count(F.lit(1)).alias("n")).collect()
        for r in sorted(counts, key=lambda r: r["digit"]):
            if left <= r["n"]:
                prefix = (prefix << BITS) | r["digit"]
                break
            left -= r["n"]
        else:
            return None
    bits = prefix ^ (1 << 63)
    return bits - (1 << 64) if bits >> 63 else bits, left


def least_rows(df: DataFrame, k: int, seed: int = 1) -> DataFrame:
    """k rows of df, or all if there are no more: those of the least hashes. Of rows that tie with the last, which are equal rows, as many as are wanted."""
    name = "__hash"
    while name in df.columns:
        name += "_"
    hashed = df.withColumn(name, row_hash(df, seed))
    if k <= 0:
        return df.limit(0)
    found = kth_least(hashed.select(name), name, k)
    if found is None:
        return df
    at, more = found
    # a limit takes `more` rows, k at most, not all that tie
    return hashed.where(F.col(name) < at).drop(name).unionByName(hashed.where(F.col(name) == at).drop(name).limit(more))
