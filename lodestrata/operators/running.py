"""Running sums over a whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestrata.functions.scalars import col
from lodestrata.sources import shared


def running_sum(df: DataFrame, order: str | list, sums: dict) -> DataFrame:
    """df with running sums in an order, without gathering all rows in one task: sums within ranges of the order, then over the ranges' totals.

    The ranges are written once, so that both steps see the same; shared.release() gives them up.
    """
    keys = [order] if isinstance(order, str) else list(order)
    ranged = df.repartitionByRange(*[F.col(k) if isinstance(k, str) else k for k in keys])
    parted = shared.keep(ranged.withColumns({"__part": F.spark_partition_id(), **{f"__add_{k}": v.cast("long") for k, v in sums.items()}}))
    by_part = parted.groupBy("__part").agg(*[F.sum(f"__add_{k}").alias(f"__sum_{k}") for k in sums])
    ahead = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = by_part.select(F.col("__part").alias("__of"), *[F.coalesce(F.sum(f"__sum_{k}").over(ahead), F.lit(0)).alias(f"__base_{k}") for k in sums])
    inside = Window.partitionBy("__part").orderBy(*keys).rowsBetween(Window.unboundedPreceding, 0)
    out = parted.withColumns({k: F.sum(f"__add_{k}").over(inside) for k in sums})
    out = out.join(F.broadcast(offsets), F.col("__part") == F.col("__of"))  # one row a partition
    return out.select(*[col(c) for c in df.columns], *[(F.col(k) + F.col(f"__base_{k}")).alias(k) for k in sums])
