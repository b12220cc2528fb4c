"""Exact quantiles, without gathering a column's values in one task.

Of whole columns: a sketch brackets the wanted ranks, one pass counts what lies below, inside and at the ends, and only where the wanted values aren't ends what lies inside is sorted. Of
groups: values are counted and the counts summed along their order.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestrata.operators.running import running_sum

#: A sketch's size: ranks are off by one row in 2,000 or so, and brackets reach two in so many to either side.
SKETCH, ACCURACY = 8_000, 2_000
#: Values of a bracket that are sorted; a bracket of more is narrowed first.
INSIDE = 200_000
GRID = 128


@dataclass
class Bracket:
    """Where a column's order statistics first and last (ranks from 0) lie: from lo to hi."""

    column: int
    first: int
    last: int
    part: float
    lo: float
    hi: float
    below: int = 0
    inside: int = 0
    at_lo: int = 0
    at_hi: int = 0
    few: bool = False  # so few different values that they need no narrowing


def column_quantiles(df: DataFrame, columns: list[Column], probabilities: list[float], accuracy: int = ACCURACY, most: int = INSIDE) -> list[list[float | None]]:
    """For each column its quantiles, interpolated linearly between two ranks; null values don't count, and a column without any has None.

    Each step is one aggregate over all columns; their number grows with the logarithm of the rows, in powers of GRID beyond the sketch.
    """
    named = df.select(*[c.cast("double").alias(f"v{i}") for i, c in enumerate(columns)])
    margin = 2 / accuracy
    while True:
        found = _brackets(named, len(columns), probabilities, margin)
        brackets = [b for row in found for b in row if b is not None]
        if not brackets:
            return [[None] * len(probabilities) for _ in columns]
        if _narrow(named, brackets, most):
            # where both values are ends of a bracket, counts have told
            ends = {id(b): e for b in brackets if (e := _at_ends(b))}
            wide = [b for b in brackets if id(b) not in ends]
            picked = dict(zip(map(id, wide), _pick(named, wide), strict=True)) if wide else {}
            at = ends | picked
            between = lambda b: (lambda lo, hi: lo if lo == hi or not b.part else lo + (hi - lo) * b.part)(*at[id(b)])  # noqa: E731, B023
            return [[None if b is None else between(b) for b in row] for row in found]
        margin *= 8  # the sketch missed a rank


def _sketched(v: str, probabilities: list[float]) -> Column:
    """About the quantiles of a column; null where the sketch took no value."""
    sketch = F.kll_sketch_agg_double(v, F.lit(SKETCH))
    return F.when(F.kll_sketch_get_n_double(sketch) > 0, F.kll_sketch_get_quantile_double(sketch, F.array(*[F.lit(p) for p in probabilities])))


def _brackets(named: DataFrame, n: int, probabilities: list[float], margin: float) -> list[list[Bracket | None]]:
    asked = sorted({min(max(p + s * margin, 0.0), 1.0) for p in probabilities for s in (-1, 1)})
    cells = [F.struct(F.count(f"v{i}"), F.min(f"v{i}"), F.max(f"v{i}"), _sketched(f"v{i}", asked)).alias(f"s{i}") for i in range(n)]
    out = []
    for i, (count, least, most, sketch) in enumerate(named.agg(*cells).first()):
        row = []
        for p in probabilities:
            at = p * (count - 1)
            lo, hi = p - margin, p + margin
            row.append(None if not count else Bracket(i, int(at), int(at) + (at > int(at)), at - int(at), least if lo <= 0 or not sketch else sketch[asked.index(lo)], most if hi >= 1 or not sketch else sketch[asked.index(hi)]))
        out.append(row)
    return out


def _literal(x: float) -> str:
    return f"({x!r}D)" if math.isfinite(x) else f"double('{x!r}')"


def _inside(b: Bracket) -> str:
    return f"(v{b.column} >= {_literal(b.lo)} and v{b.column} <= {_literal(b.hi)})"


def _narrow(named: DataFrame, brackets: list[Bracket], most: int) -> bool:
    """Counts values below, inside and at both ends of each bracket and narrows those that hold too many different ones; whether all hold their ranks."""
    steps = f"array({', '.join(f'{k / GRID}D' for k in range(GRID + 1))})"
    while True:
        wide = [_is_wide(b, most) for b in brackets]
        cells = []
        for b, w in zip(brackets, wide, strict=True):
            v, within = f"v{b.column}", f"case when {_inside(b)} then v{b.column} end"
            counts = f"count_if({v} < {_literal(b.lo)}), count({within}), count_if({v} = {_literal(b.lo)}), count_if({v} = {_literal(b.hi)})"
            more = f"percentile_approx({within}, {steps}, {8 * GRID}), hll_sketch_estimate(hll_sketch_agg(xxhash64({within}), 12))" if w else "null, null"
            cells.append(F.expr(f"struct({counts}, {more})").alias(f"s{len(cells)}"))
        narrower = False
        for b, w, (below, inside, at_lo, at_hi, grid, distinct) in zip(brackets, wide, named.agg(*cells).first(), strict=True):
            b.below, b.inside, b.at_lo, b.at_hi = below, inside, at_lo, at_hi
            if not below <= b.first or not b.last < below + inside:
                return False
            if w and distinct <= most // 2:
                b.few = True  # equal values are counted as one
            elif w:
                lo = int((b.first - below) / inside * GRID) - 1
                hi = -int(-(b.last - below + 1) / inside * GRID) + 2
                new = (b.lo if lo <= 0 else grid[lo], b.hi if hi >= GRID else grid[hi])
                narrower |= new != (b.lo, b.hi)
                b.lo, b.hi = new
        # a bracket that doesn't get narrower is full of equal values
        if not narrower and not any(_is_wide(b, most) and not w for b, w in zip(brackets, wide, strict=True)):
            return True


def _is_wide(b: Bracket, most: int) -> bool:
    return b.inside > most and not b.few and _at_ends(b) is None


def _at_ends(b: Bracket) -> tuple[float, float] | None:
    """The values of both ranks where counts tell that they are ends of the bracket."""
    out = [b.lo if b.lo == b.hi or r < b.below + b.at_lo else b.hi if r >= b.below + b.inside - b.at_hi else None for r in (b.first, b.last)]
    return None if None in out else (out[0], out[1])


def _pick(named: DataFrame, brackets: list[Bracket]) -> list[tuple[float, float]]:
    """The values of both ranks of each bracket: only values inside are taken, counted and put in order."""
    cells = ", ".join(f"struct({k} as k, {b.first - b.below}L as first, {b.last - b.below}L as last, case when {_inside(b)} then v{b.column} end as v)" for k, b in enumerate(brackets))
    tall = named.where(" or ".join(map(_inside, brackets))).select(F.expr(f"inline(array({cells}))")).where("v is not null")
    counted = tall.groupBy("k", "first", "last", "v").agg(F.count(F.lit(1)).alias("n"))
    upto = F.sum("n").over(Window.partitionBy("k").orderBy("v"))  # INSIDE values or so
    found: dict[int, tuple] = {}
    for r in counted.withColumn("upto", upto).where("upto > first and upto - n <= last").groupBy("k").agg(F.min("v").alias("a"), F.max("v").alias("b")).collect():  # a row a bracket
        found[r["k"]] = (r["a"], r["b"])
    return [found[k] for k in range(len(brackets))]


def grouped_quantiles(tall: DataFrame, probabilities: list[float]) -> DataFrame:
    """column, p, q, distinct of a table of (column, v): the same for each `column`, which may be any key, with how many different values it has; null values don't count.

    Values are counted (combined before the shuffle), the counts are summed along the order of (column, value) in ranges, and the rows that hold a wanted rank are picked.
    """
    counts = tall.where("v is not null").groupBy("column", "v").agg(F.count(F.lit(1)).alias("n"))
    placed = running_sum(counts, ["column", "v"], {"upto": F.col("n")})
    ends = placed.groupBy("column").agg(F.min(F.col("upto") - F.col("n")).alias("start"), F.max("upto").alias("end"), F.count(F.lit(1)).alias("distinct"))
    ranks = ends.select(F.col("column").alias("of"), "start", "distinct", (F.col("end") - F.col("start") - 1).alias("last"), F.explode(F.array(*[F.lit(float(p)) for p in probabilities])).alias("p"))
    ranks = ranks.withColumn("at", F.col("p") * F.col("last")).select("of", "p", "distinct", (F.col("at") - F.floor("at")).alias("part"), (F.col("start") + F.floor("at")).alias("lo"), (F.col("start") + F.ceil("at")).alias("hi"))
    holds = lambda rank: (F.col(rank) < F.col("upto")) & (F.col(rank) >= F.col("upto") - F.col("n"))
    found = placed.join(ranks, F.col("column").eqNullSafe(F.col("of"))).where(holds("lo") | holds("hi"))
    ends = found.groupBy("column", "p").agg(F.max(F.when(holds("lo"), F.col("v"))).alias("a"), F.max(F.when(holds("hi"), F.col("v"))).alias("b"), F.first("part").alias("part"), F.first("distinct").alias("distinct"))
    between = F.when((F.col("a") == F.col("b")) | (F.col("part") == 0), F.col("a")).otherwise(F.col("a") + (F.col("b") - F.col("a")) * F.col("part"))
    return ends.select("column", "p", between.alias("q"), "distinct")
