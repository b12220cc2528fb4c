"""Connected components of a table of links, by alternating large-star and small-star."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.llm import scratch, skew


def _star(edges: DataFrame, small: bool, rows: int) -> DataFrame:
    """Hangs a node's neighbours on the least of them: those above it, or (small) those below it and itself. A hub's rows aren't gathered."""
    both = edges.select("u", "v") if small else edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count(F.lit(1)).alias("neighbours"))
    hung = skew.look_up(both, least, ["u"], "neighbours", "inner", total=rows * (1 if small else 2))
    out = hung.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    if small:
        out = hung.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.where("u <> m").select("u", F.col("m").alias("v")))
    return out.where("u <> v").distinct()


def components(links: DataFrame) -> DataFrame:
    """node, root (the least node of its component) of every node of links(u, v) that isn't a root itself."""
    edges = scratch.keep(links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct(), "links")
    seen = None
    while True:
        state = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(state) == seen or not state[0]:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        seen = tuple(state)
        large = scratch.keep(_star(edges, False, state[0]), "stars")
        edges = scratch.keep(_star(large, True, state[0]), "stars")
