"""Exact selection of the k-th largest of a column of longs, without sorting it or passing it through one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def ordered_longs(value: Column) -> tuple[Column, Column]:
    """A double under 2**33 in size (NaN excluded) as two longs of exactly its order: whole units of 2**-30, and what is left of it in units of 2**-90.

    Both steps only move the exponent and take off what is whole, so nothing is rounded above 2**-90.
    """
    scaled = F.least(F.greatest(value, F.lit(-float(1 << 33))), F.lit(float(1 << 33))) * F.lit(float(1 << 30))
    whole = F.floor(scaled)
    return whole, ((scaled - whole) * F.lit(float(1 << 60))).cast("long")


def kth_largest(df: DataFrame, key: str, k: int, bits: int = 16) -> tuple[int, int]:
    """(t, m): of the k largest values of the long column key, those above t and m of those equal to it; each pass counts one digit."""
    if k <= 0:
        return (1 << 63) - 1, 0
    values = df.select((F.col(key).bitwiseXOR(F.lit(-(1 << 63)))).alias("v"))  # unsigned order in two's complement
    prefix, left = 0, k
    for shift in range(64 - bits, -1, -bits):
        own = values if shift == 64 - bits else values.where(F.shiftrightunsigned("v", shift + bits) == F.lit(prefix))
        digits = own.groupBy(F.shiftrightunsigned("v", shift).bitwiseAND((1 << bits) - 1).alias("digit")).count()
        # at most 2**bits rows, whatever the size of df
        for row in sorted(digits.collect(), key=lambda r: -r["digit"]):
            if left <= row["count"]:
                prefix = (prefix << bits) | row["digit"]
                break
            left -= row["count"]
        else:
            return -(1 << 63), 0  # fewer than k rows: all of them
    return (prefix ^ (1 << 63)) - (1 << 64) if prefix ^ (1 << 63) >= 1 << 63 else prefix ^ (1 << 63), left
