"""Regression, correlated columns, and an order of columns by usefulness."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.functions import types
from lodestrata.functions.scalars import col
from lodestrata.operators.running import running_sum


def linear_regression(df: DataFrame, target: str, inputs: list[str]) -> DataFrame:
    """{target}, {target}_predicted, {target}_pred_err first, then the other columns. Rows with a null target or input aren't fitted and have nulls.

    The normal equations are one aggregate of (inputs + 2)² / 2 sums, solved on the driver; sums are of values less their means, so large offsets do no harm.
    """
    import numpy as np

    names = [*inputs, target]
    if f"{target}_predicted" in df.columns or f"{target}_pred_err" in df.columns:
        raise ValueError("the columns to add are there already")
    full = df.where(" and ".join(f"`{c}` is not null" for c in names)).select(*[col(c).cast("double").alias(f"x{i}") for i, c in enumerate(names)])
    sums = full.agg(*[F.avg(f"x{i}").alias(f"m{i}") for i in range(len(names))], *[F.covar_pop(f"x{i}", f"x{j}").alias(f"c{i}_{j}") for i in range(len(names)) for j in range(i, len(names))]).first()
    if sums["m0"] is None:
        slopes, intercept = [None] * len(inputs), None
    else:
        k = len(inputs)
        c = np.array([[sums[f"c{min(i, j)}_{max(i, j)}"] for j in range(k + 1)] for i in range(k + 1)])
        solved = np.linalg.lstsq(c[:k, :k], c[:k, k], rcond=None)[0]
        slopes = [float(v) for v in solved]
        intercept = float(sums[f"m{k}"] - sum(s * sums[f"m{i}"] for i, s in enumerate(slopes)))
    predicted = F.lit(intercept).cast("double")
    for s, c in zip(slopes, inputs, strict=True):
        predicted = predicted + F.lit(s).cast("double") * col(c)
    fitted = F.when(col(target).isNotNull(), predicted)
    return df.select(col(target), fitted.alias(f"{target}_predicted"), (col(target) - fitted).alias(f"{target}_pred_err"), *[col(c) for c in df.columns if c != target])


def _codes(df: DataFrame, names: list[str]) -> DataFrame:
    """The columns as places of their values in sorted order; distinct values are ranked and joined, one small table a column."""
    out = df.select(*[col(c) for c in names])
    for i, c in enumerate(names):
        values = df.select(col(c).alias(f"__v{i}")).where(F.col(f"__v{i}").isNotNull()).distinct()
        ranked = running_sum(values, f"__v{i}", {f"__c{i}": F.lit(1)}).withColumn(f"__c{i}", F.col(f"__c{i}").cast("double"))
        out = out.join(ranked, col(c) == F.col(f"__v{i}"), "left").drop(f"__v{i}")
    return out.select(*[F.col(f"__c{i}").alias(c) for i, c in enumerate(names)])


def correlated_columns(df: DataFrame, least: float = 0.6, max_share: float = 0.3, max_values: int = 50) -> DataFrame:
    """left, right, correlation of pairs of columns with few values whose codes correlate above `least`."""
    from lodestrata.plans.profile import more_distinct_than

    able = [f.name for f in df.schema if not types.is_nested(f.dataType)]
    # as many values as a column may have: the more of a share of the rows and a fixed number
    most = max(int(max_share * df.count()), max_values)
    names = [c for c, several, many in zip(able, more_distinct_than(df, able, 1), more_distinct_than(df, able, most - 1), strict=True) if several and not many]
    pairs = list(combinations(names, 2))
    schema = "left string, right string, correlation double"
    if not pairs:
        return df.sparkSession.createDataFrame([], schema)
    wide = _codes(df, names).agg(F.array(*[F.struct(F.lit(a).alias("left"), F.lit(b).alias("right"), F.corr(col(a), col(b)).alias("correlation")) for a, b in pairs]).alias("x"))
    return wide.select(F.explode("x").alias("x")).select("x.*").where(F.col("correlation") > least)


def correlation_groups(pairs: list[tuple[str, str]]) -> list[list[str]]:
    """Columns that pairs connect, each group in the order of first mention."""
    group: dict[str, list[str]] = {}
    for a, b in pairs:
        joined = [*dict.fromkeys([*group.get(a, [a]), *group.get(b, [b])])]
        for c in joined:
            group[c] = joined
    return [*{id(g): g for g in group.values()}.values()]


def order_columns(df: DataFrame) -> DataFrame:
    """The columns by usefulness: times first, constants last, of correlated groups the first ahead of the others."""
    from lodestrata.plans.profile import more_distinct_than

    plain = [f.name for f in df.schema if not types.is_nested(f.dataType)]
    several = dict(zip(plain, more_distinct_than(df, plain, 1), strict=True))
    score = dict.fromkeys(df.columns, 0)
    for f in df.schema:
        score[f.name] += 11 * types.is_temporal(f.dataType) - 20 * (not several.get(f.name, True))
    for group in correlation_groups([(r["left"], r["right"]) for r in correlated_columns(df).orderBy("left", "right").collect()]):
        first, *others = sorted(group, key=lambda c: (-score[c], df.columns.index(c)))
        score[first] += 5
        for c in others:
            score[c] -= 5
    return df.select(*[col(c) for c in sorted(df.columns, key=lambda c: (-score[c], df.columns.index(c)))])
