"""Joins of many rows with a table of one row a key, where a few keys may have most of the rows."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


#: Rows of one key that a task may gather, and how many keys may be broadcast.
MOST_ROWS, MOST_KEYS = 1_000_000, 100_000


def look_up(rows: DataFrame, table: DataFrame, keys: list[str], count: str, how: str = "left", total: int | None = None, share: int = 1000, hint: str | None = None) -> DataFrame:
    """rows with the columns of table, which has one row a key and, in `count`, how many of the rows have it. how: left or inner.

    Rows of frequent keys stay where they are: keys of a thousandth of all rows or more, or of MOST_ROWS, beyond 1e11 rows of a MOST_KEYS-th of them. These keys, MOST_KEYS at most, are broadcast. Other keys are joined
    by a shuffle, or as Spark likes where they are few, unless hint names the kind of join. rows is read twice; it should be a table or a cheap map of one.
    """
    if total is None:
        total = table.agg(F.sum(count)).first()[0] or 0
    made = [c for c in table.columns if c not in (*keys, count)]
    named = table.select(*[F.col(k).alias(f"__{k}") for k in keys], *made, count)
    hot = (F.col(count) * share >= total) | (F.col(count) >= max(MOST_ROWS, total // MOST_KEYS))
    rare = named.where(~hot).hint(hint) if hint else named.where(~hot)
    met = reduce(and_, [F.col(k) == F.col(f"__{k}") for k in keys])
    frequent = F.broadcast(named.where(hot))
    out = [F.col(f"`{c}`") for c in [*rows.columns, *made]]
    here = rows.join(frequent, met, "inner").select(*out)
    return here.unionByName(rows.join(frequent, met, "left_anti").join(rare, met, how).select(*out))


#: Bits of a filter of keys: its table has 8 MB at most, whatever the number of keys.
FILTER_BITS = 1 << 26


def maybe_in(rows: DataFrame, keys: DataFrame, of: Column, its: Column, flag: str, bits: int = FILTER_BITS) -> DataFrame:
    """rows with a boolean column `flag`: false only where no row of keys has the hash `its` that a row has in `of` (null: false). A bitmap of the keys is broadcast; more keys than bits make it say true too often, never false."""
    place = lambda h: F.pmod(h, F.lit(bits)) + 1  # noqa: E731  bitmap positions count from 1
    maps = keys.where(its.isNotNull()).select(place(its).alias("__p")).groupBy(F.bitmap_bucket_number("__p").alias("__bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("__p")).alias("__map"))
    at = F.bitmap_bit_position(place(of))
    out = rows.join(F.broadcast(maps), F.bitmap_bucket_number(place(of)) == F.col("__bucket"), "left")
    byte = F.conv(F.hex(F.substring("__map", (at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    said = F.coalesce(F.getbit(byte, (at % 8).cast("int")) == 1, F.lit(False))
    return out.select(*[F.col(f"`{c}`") for c in rows.columns], said.alias(flag))
