"""Histograms of all numeric or categorical columns at once, as rows to draw bars from."""

from __future__ import annotations

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestrata.functions import scalars as S
from lodestrata.functions import types
from lodestrata.functions.scalars import col
from lodestrata.operators import quantiles
from lodestrata.operators.filters import nullify_nonfinite
from lodestrata.plans import profile

BINS = 10


def _ranges(df: DataFrame, within: list[tuple[Column, float | None, float | None]]) -> list[tuple[float | None, float | None]]:
    """Least and largest of each column's values strictly between two bounds, where there are bounds."""
    inside = lambda c, lo, hi: F.when((c > F.lit(lo)) & (c < F.lit(hi)), c) if lo is not None else c
    cells = [F.struct(F.min(inside(*w)).cast("double"), F.max(inside(*w)).cast("double")).alias(f"r{i}") for i, w in enumerate(within)]
    return [tuple(r) for r in df.agg(*cells).first()] if cells else []


def _bins(df: DataFrame, names: list[str], ranges: list[tuple[float | None, float | None]]) -> DataFrame:
    """column, bin (0..9), bin_lo, bin_hi, n, total: every bin of each column, those without values too; the last is closed. Ranges that can't be split have none."""
    able = [(i, lo, (hi - lo) / BINS, hi) for i, (lo, hi) in enumerate(ranges) if lo is not None and hi > lo and lo + (hi - lo) / BINS > lo and hi - (hi - lo) / BINS < hi]
    schema = "column string, bin int, bin_lo double, bin_hi double, n long, total long"
    if not able:
        return df.sparkSession.createDataFrame([], schema)
    cells = []
    for i, lo, width, hi in able:
        v = col(names[i]).cast("double")
        at = F.least(F.lit(BINS - 1), F.greatest(F.lit(0), F.floor((v - lo) / width))).cast("int")
        cells.append(F.struct(F.lit(i).alias("i"), F.when((v >= lo) & (v <= hi), at).alias("bin")))
    counted = df.select(F.explode(F.array(*cells)).alias("c")).select("c.*").where("bin is not null").groupBy("i", "bin").agg(F.count(F.lit(1)).alias("n"))
    every = df.sparkSession.createDataFrame([(i, k, names[i], lo + width * k, lo + width * (k + 1)) for i, lo, width, _ in able for k in range(BINS)], "i int, bin int, column string, bin_lo double, bin_hi double")
    # ten rows a column
    filled = every.join(F.broadcast(counted), ["i", "bin"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return filled.withColumn("total", F.sum("n").over(Window.partitionBy("i"))).select(*[c.split(" ")[0] for c in schema.split(", ")])


def trimmed(df: DataFrame, columns: list[str] | None = None, low: float = 0.01, high: float = 0.99) -> DataFrame:
    """column, low_tail, high_tail, bin, bin_lo, bin_hi, population: equal bins over the values strictly between two quantiles."""
    names = columns or types.columns_of(df, types.is_numeric_not_bool)
    clean = nullify_nonfinite(df).select(*[col(c) for c in names])
    tails = quantiles.column_quantiles(clean, [col(c) for c in names], [low, high])
    some = [i for i, (a, _) in enumerate(tails) if a is not None]
    names, tails = [names[i] for i in some], [tails[i] for i in some]
    bins = _bins(clean, names, _ranges(clean, [(col(c), a, b) for c, (a, b) in zip(names, tails, strict=True)]))
    of = df.sparkSession.createDataFrame([(c, a, b) for c, (a, b) in zip(names, tails, strict=True)], "of string, low_tail double, high_tail double")
    return bins.join(F.broadcast(of), F.col("column") == F.col("of")).select("column", "low_tail", "high_tail", "bin", "bin_lo", "bin_hi", (F.col("n") / F.col("total")).alias("population"))


def full_range(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """column, bin, bin_lo, bin_hi, n, percent (one decimal): equal bins over all values; a constant column has none."""
    names = columns or types.columns_of(df, types.is_numeric_not_bool)
    clean = nullify_nonfinite(df)
    binned = _bins(clean, names, _ranges(clean, [(col(c), None, None) for c in names]))
    return binned.select("column", "bin", "bin_lo", "bin_hi", "n", F.round(100 * F.col("n") / F.col("total"), 1).alias("percent"))


def bin_edges(lo: Column, hi: Column, bins: int = BINS) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(bins)), lambda i: lo + (hi - lo) / bins * i)


def categorical(df: DataFrame, columns: list[str] | None = None, most: int = 7, least_share: float = 0.0) -> DataFrame:
    """column, name, percent: the most frequent values (of at least least_share of all rows, and a whole percent), then `longtail` (other values that repeat), `unique` and `NA`."""
    names = columns or [c for c in df.columns if not types.is_nested(df.schema[c].dataType)]
    counts = profile.value_counts(df, names)
    length = df.agg(F.count(F.lit(1)).alias("length"))
    top = profile.top_values(counts, most).withColumnRenamed("n", "top_n").crossJoin(F.broadcast(length)).where(F.col("top_n") >= least_share * F.col("length"))
    in_top = top.groupBy("column").agg(F.sum("top_n").alias("top_sum"), F.count_if(F.col("top_n") == 1).alias("top_unique"))
    sums = counts.groupBy("column").agg(F.sum("n").alias("filled"), F.count_if(F.col("n") == 1).alias("unique"))
    every = df.sparkSession.createDataFrame([(c,) for c in names], "column string").crossJoin(F.broadcast(length))
    rest = every.join(sums, "column", "left").join(in_top, "column", "left").fillna(0)
    # values that occur once and are shown are not counted again
    unique = F.col("unique") - F.col("top_unique")
    long_tail = F.col("filled") - F.col("top_sum") - unique
    share = lambda n: F.bround(F.try_divide(100 * n, F.col("length")), 0)
    shown = top.select("column", F.col("place").alias("place"), F.col("value").alias("name"), share(F.col("top_n")).alias("percent"))
    other = rest.select("column", F.explode(F.array(*[F.struct(F.lit(100 + i).alias("place"), F.lit(n).alias("name"), share(v).alias("percent")) for i, (n, v) in enumerate((("longtail", long_tail), ("unique", unique), ("NA", F.col("length") - F.col("filled"))))])).alias("x")).select("column", "x.*")
    return shown.unionByName(other).where("percent > 0.3").select("column", "place", "name", "percent")


def top_ten(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """column, value, percent (of the ten's rows, one decimal) of the ten most frequent values."""
    top = profile.top_values(profile.value_counts(df, columns), 10)
    totals = top.groupBy(F.col("column").alias("of")).agg(F.sum("n").alias("total"))
    return top.join(F.broadcast(totals), F.col("column") == F.col("of")).select("column", "place", "value", F.round(100 * F.col("n") / F.col("total"), 1).alias("percent"))


def bars(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """column, place, name, percent of labelled bars of each column: numeric bins with their tails for numbers of over five values, else categories."""
    names = columns or df.columns
    numbers = [c for c in names if types.is_numeric_not_bool(df.schema[c].dataType)]
    wide = [c for c, many in zip(numbers, profile.more_distinct_than(df, numbers, 5), strict=True) if many]
    out = None
    if wide:
        bins = trimmed(df, wide)
        # ten rows a column
        found = bins.collect()
        full = {c: sum(r["population"] > 0 for r in found if r["column"] == c) for c in wide}
        wide = [c for c in wide if full[c] > 5]
    if wide:
        nulls = df.agg(*[F.try_divide(F.count_if(col(c).isNull()), F.count(F.lit(1))).alias(f"n{i}") for i, c in enumerate(wide)]).first()
        rows = []
        for c, missing, (least, most) in zip(wide, nulls, _ranges(nullify_nonfinite(df), [(col(c), None, None) for c in wide]), strict=True):
            own = sorted((r for r in found if r["column"] == c), key=lambda r: r["bin"])
            lo, hi = own[0]["bin_lo"], own[-1]["bin_hi"]
            step, ref = (hi - lo) / BINS, max(abs(lo), abs(hi))
            rows += [(c, r["bin"] + 2, "bin", r["bin_lo"], r["bin_hi"], step, ref, 100 * r["population"]) for r in own]
            rows += [(c, 1, "tail", least, own[0]["low_tail"], step, ref, 1.0), (c, 12, "tail", own[0]["high_tail"], most, step, ref, 1.0)]
            rows += [(c, 13, "NA", None, None, None, None, 100 * missing)] if missing else []
        said = df.sparkSession.createDataFrame(rows, "column string, place int, kind string, lo double, hi double, step double, ref double, share double")
        bounds = [F.col(k) for k in ("lo", "hi", "step", "ref")]
        label = F.when(F.col("kind") == "bin", S.bucket_label(*bounds)).when(F.col("kind") == "tail", S.tail_label(*bounds[:3])).otherwise(F.lit("NA"))
        out = said.select("column", "place", label.alias("name"), F.bround("share", 0).alias("percent")).where("place < 13 or percent > 0")
    rest = [c for c in names if c not in wide and not types.is_nested(df.schema[c].dataType)]
    if rest:
        other = categorical(df, rest)
        out = other if out is None else out.unionByName(other)
    return out


def pushed_down(df: DataFrame, column: str) -> list[dict]:
    """One column's bars as rows to draw, from aggregates that a source can compute: full-range bins of numbers of over five values, else the ten most frequent values. [] where either fails or there is nothing to show."""
    try:
        number = types.is_numeric_not_bool(df.schema[column].dataType)
        one = df.select(col(column))
        if number and profile.more_distinct_than(one, [column], 5)[0]:
            found = sorted(full_range(one, [column]).collect(), key=lambda r: r["bin"])
            if found:
                span = (found[-1]["bin_hi"] - found[0]["bin_lo"]) / BINS
                ref = max(abs(found[0]["bin_lo"]), abs(found[-1]["bin_hi"]))
                said = df.sparkSession.createDataFrame([(r["bin_lo"], r["bin_hi"], float(r["percent"])) for r in found], "lo double, hi double, percent double")
                label = S.bucket_label(F.col("lo"), F.col("hi"), F.lit(span), F.lit(ref))
                return [r.asDict() for r in said.select(label.alias("name"), F.col("percent").alias("population")).collect()]
        return [{"name": r["value"], "population": r["percent"]} for r in top_ten(one, [column]).orderBy("place").collect()]
    except (PySparkException, KeyError, TypeError, ValueError):
        return []
