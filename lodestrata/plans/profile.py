"""Profiles of whole tables in a fixed number of jobs, however many columns there are.

Aggregates of all columns are one agg(); value counts of all columns are one grouping of (column, value) rows, combined before it
is shuffled. A wide profile is one row of `{column}__{stat}`; a long one has a row for each column and statistic.
"""

from __future__ import annotations

import importlib.util
from pathlib import Path

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException, PySparkException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestrata.functions import types
from lodestrata.functions.aggregates import about_distinct
from lodestrata.functions.scalars import col, short_name
from lodestrata.operators import quantiles
from lodestrata.operators.filters import nullify_nonfinite
from lodestrata.plans import stats as S

SEPARATOR = "__"
#: Statistics whose whole or decimal numbers a double may not hold.
EXACT = ("min", "max", "sum")


def _aggregates(df: DataFrame, ordered: list[S.Stat], columns: list[str]) -> tuple[dict[str, Column], list[tuple[str, S.Stat]], list[tuple[str, str, str]]]:
    """(aggregates by wide name, statistics that need others, errors): each aggregate is analysed alone, so that a bad one stops no other."""
    made, later, errors = {}, [], []
    for c in columns:
        kind = df.schema[c].dataType
        for s in S.for_column(ordered, kind):
            if s.needs or s.query:
                later.append((c, s))
                continue
            name = f"{c}{SEPARATOR}{s.name}"
            try:
                e = s.make(col(c), kind)
                if s not in S.BASE and s not in S.QUANTILES:
                    df.agg(e.alias("x")).schema  # noqa: B018
                made[name] = e
            except (PySparkException, TypeError, ValueError, AttributeError) as error:
                if s.default is not S.MISSING:
                    made[name] = F.first(F.lit(s.default))
                else:
                    errors.append((c, s.name, str(error)[:500]))
    return made, later, errors


def _measured(df: DataFrame, made: dict[str, Column]) -> tuple[dict[str, object], dict[str, Exception]]:
    """(values by name, errors by name) of aggregates: those that fail while they run are found by halves, so f of m failures cost about 2 f log m jobs more."""
    try:
        row = df.agg(*[e.alias(f"x{i}") for i, e in enumerate(made.values())]).first()
        return dict(zip(made, row, strict=True)), {}
    except (PySparkException, Py4JJavaError) as error:
        if len(made) == 1:
            return {}, {next(iter(made)): error}
    names = list(made)
    values, errors = {}, {}
    for part in (names[: len(names) // 2], names[len(names) // 2 :]):
        v, e = _measured(df, {n: made[n] for n in part})
        values, errors = values | v, errors | e
    return values, errors


def _said(error: Exception) -> str:
    return str(error).split("\n\tat ")[0][:500]


def _row(df: DataFrame, made: dict[str, Column], own: dict[str, S.Stat]) -> tuple[DataFrame, dict[str, str]]:
    """(one row of aggregates, messages of those that failed). Built-in ones are left to the plan; where any is a user's (own), all are run at once.

    If not even the number of rows can be had, it is not the statistics that fail, and the error is raised.
    """
    lazy = df.agg(*([e.alias(n) for n, e in made.items()] or [F.count(F.lit(1)).alias("length")]))
    if not own:
        return lazy, {}
    values, errors = _measured(df, made)
    if errors and not values:
        df.agg(F.count(F.lit(1))).first()
    failed = {}
    for n, error in errors.items():
        if n in own and own[n].default is not S.MISSING:
            values[n] = own[n].default
        else:
            failed[n] = _said(error)
    kinds = T.StructType([f for f in lazy.schema if f.name in values])
    kinds = T.StructType([T.StructField(f.name, f.dataType, True) for f in kinds])
    return df.sparkSession.createDataFrame([tuple(values[f.name] for f in kinds)], kinds), failed


def profile_wide(df: DataFrame, stats: list[S.Stat] | None = None, skip: tuple[str, ...] = ()) -> tuple[DataFrame, list[tuple[str, str, str]]]:
    """(one row of {column}__{stat}, errors as (column, stat, message)). Skipped columns keep their length only; what depends on a failed statistic is null.

    Statistics fail alone, when they are made or while they run: an aggregate of all that fails is taken apart until the failing ones stand by themselves.
    """
    ordered = S.in_order(stats if stats is not None else S.BASE)
    clean = nullify_nonfinite(df)
    columns = [c for c in df.columns if c not in skip]
    made, later, errors = _aggregates(clean, ordered, columns)
    built_in = {*map(id, S.BASE), *map(id, S.QUANTILES), *map(id, S.APPROXIMATE), *map(id, S.EXTRA), *map(id, S.APPROXIMATE_ALL)}
    of = {f"{c}{SEPARATOR}{s.name}": s for c in columns for s in ordered if id(s) not in built_in}
    row, messages = _row(clean, made, {n: s for n, s in of.items() if n in made})
    errors += [(*n.rsplit(SEPARATOR, 1), m) for n, m in messages.items()]
    failed = {(c, s) for c, s, _ in errors}
    # statistics that run their own query: one for all columns
    for s in [s for s in ordered if s.query]:
        of_query = [c for c, x in later if x is s]
        later = [x for x in later if x[1] is not s]
        try:
            values = s.query(clean, of_query) if of_query else {}
            row = row.select("*", *[F.lit(values.get(c)).cast(s.returns).alias(f"{c}{SEPARATOR}{s.name}") for c in of_query])
        except Exception as error:  # noqa: BLE001  a user's query may fail in any way, and stops no other statistic
            errors += [(c, s.name, _said(error)) for c in of_query]
            failed |= {(c, s.name) for c in of_query}
    while later:
        depth, rest = [], []
        have = set(row.columns)
        for c, s in later:
            if any((c, n) in failed for n in s.needs):
                failed.add((c, s.name))
                errors.append((c, s.name, "what it needs failed"))
            elif all(f"{c}{SEPARATOR}{n}" in have for n in s.needs):
                depth.append((c, s))
            else:
                rest.append((c, s))
        for c, s in depth:
            name = f"{c}{SEPARATOR}{s.name}"
            try:
                value = s.make(**{n: col(f"{c}{SEPARATOR}{n}") for n in s.needs})
                if id(s) not in built_in:  # the row is at hand: trying it reads no table again
                    row.select(value).first()
            except Exception as error:  # noqa: BLE001  as above
                if s.default is S.MISSING:
                    errors.append((c, s.name, _said(error)))
                    failed.add((c, s.name))
                    continue
                value = F.lit(s.default)
            row = row.select("*", value.alias(name))
        if len(rest) == len(later):
            break
        later = rest
    return row, errors


def to_long(wide: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """column, stat, number, text of each cell of a wide profile; nested values are JSON text. Least, largest and summed whole and decimal numbers are exact in text."""
    # one text of SQL: a profile of many columns has thousands of cells
    quoted = lambda name: "'" + name.replace("\\", "\\\\").replace("'", "\\'") + "'"
    cells = []
    for f in wide.schema:
        c, _, s = f.name.rpartition(SEPARATOR)
        if keep is not None and s not in keep:
            continue
        own = "`" + f.name.replace("`", "``") + "`"
        numeric = types.is_numeric(f.dataType)
        coarse = s in EXACT and (types.is_integer(f.dataType) or isinstance(f.dataType, T.DecimalType))
        text = "null" if numeric and not coarse else f"to_json({own})" if types.is_nested(f.dataType) else own
        number = own if numeric else "null"
        cells.append(f"struct({quoted(c)} as column, {quoted(s)} as stat, cast({number} as double) as number, cast({text} as string) as text)")
    return wide.select(F.expr(f"inline(array({', '.join(cells)}))"))


def stat_rows(long: DataFrame, columns: list[str], value: str = "number") -> DataFrame:
    """A row for each statistic, a column for each of the table's columns."""
    return long.groupBy("stat").pivot("column", columns).agg(F.first(value))


def value_counts(df: DataFrame, columns: list[str] | None = None, numeric: bool | None = None) -> DataFrame:
    """column, value, n of every value of the columns, nulls dropped, in one grouping. numeric: value is a double and columns are those of numbers; else text of the others, or of all.

    Values are counted in their own type: whole numbers as such and decimals as text, which with `numeric` are in the column exact.
    """
    clean = nullify_nonfinite(df)
    test = (lambda t: types.is_numeric_not_bool(t)) if numeric else (lambda t: not types.is_nested(t)) if numeric is None else (lambda t: not types.is_numeric_not_bool(t) and not types.is_nested(t))
    names = [c for c in (columns or df.columns) if test(df.schema[c].dataType)]
    if not names:
        return df.sparkSession.createDataFrame([], "column string, value double, n long, exact string" if numeric else "column string, value string, n long")
    # places instead of names: shorter keys to hash and shuffle
    cells = []
    for i, c in enumerate(names):
        t = df.schema[c].dataType
        whole = col(c).cast("long") if types.is_integer(t) else None
        number = col(c).cast("double") + 0.0 if types.is_float(t) else None  # -0 is 0
        text = col(c).cast("string") if whole is None and number is None else None
        cells.append(F.struct(F.lit(i).alias("i"), *[(F.lit(None).cast(k) if v is None else v).alias(n) for n, v, k in (("whole", whole, "long"), ("number", number, "double"), ("text", text, "string"))]))
    counted = clean.select(F.explode(F.array(*cells)).alias("c")).select("c.*").where("whole is not null or number is not null or text is not null").groupBy("i", "whole", "number", "text").agg(F.count(F.lit(1)).alias("n"))
    name = F.get(F.array(*[F.lit(c) for c in names]), F.col("i")).alias("column")
    exact = F.coalesce(F.col("whole").cast("string"), F.col("text"))
    if numeric:
        return counted.select(name, F.coalesce("number", F.col("whole").cast("double"), F.col("text").cast("double")).alias("value"), "n", exact.alias("exact"))
    return counted.select(name, F.coalesce(exact, F.col("number").cast("string")).alias("value"), "n")


def more_distinct_than(df: DataFrame, columns: list[str], most: int) -> list[bool]:
    """Whether each column has over `most` different values. Sketches answer for columns of many; those near the bound are counted."""
    if not columns:
        return []
    about = nullify_nonfinite(df).agg(*[about_distinct(col(c)).alias(f"d{i}") for i, c in enumerate(columns)]).first()
    close = [c for c, d in zip(columns, about, strict=True) if d <= 2 * most + 10 and d >= most / 2]
    exact = {r["column"]: r["d"] for r in value_counts(df, close).groupBy("column").agg(F.count(F.lit(1)).alias("d")).collect()} if close else {}  # a row a column
    return [(exact.get(c, 0) if c in close else d) > most for c, d in zip(columns, about, strict=True)]


def _ordered_value(counts: DataFrame) -> list[Column]:
    """Keys of a value's order: the value, and where doubles are too coarse the exact number."""
    return [F.col("value"), F.col("exact").try_cast("decimal(38,10)")] if "exact" in counts.columns else [F.col("value")]


def top_values(counts: DataFrame, most: int = 10) -> DataFrame:
    """column, place (from 1), value, n (and exact) of each column's most frequent values; equal counts in order of the value.

    Values are dealt over 64 parts of which each keeps its best, so a column of many values isn't sorted in one place.
    """
    more = [c for c in ("exact",) if c in counts.columns]
    key = F.struct((-F.col("n")).alias("less"), *[c.alias(f"k{i}") for i, c in enumerate(_ordered_value(counts))], "value", *more)
    window = Window.partitionBy("column", "part").orderBy(F.desc("n"), *_ordered_value(counts))
    parts = counts.withColumn("part", F.pmod(F.xxhash64("value", *more), F.lit(64))).withColumn("r", F.row_number().over(window)).where(F.col("r") <= most)
    best = parts.groupBy("column").agg(F.slice(F.array_sort(F.collect_list(key)), 1, most).alias("best"))  # lists of 64 * most at most
    out = best.select("column", F.posexplode("best").alias("at", "b"))
    return out.select("column", (F.col("at") + 1).alias("place"), F.col("b.value").alias("value"), (-F.col("b.less")).alias("n"), *[F.col(f"b.{c}").alias(c) for c in more])


def value_stats(counts: DataFrame) -> DataFrame:
    """column, distinct_count, unique_count, mode (smallest of the most frequent; with exact counts also mode_exact) from value counts."""
    more = [c for c in ("exact",) if c in counts.columns]
    best = F.min(F.struct((-F.col("n")).alias("less"), *[c.alias(f"k{i}") for i, c in enumerate(_ordered_value(counts))], "value", *more))
    out = counts.groupBy("column").agg(F.count(F.lit(1)).alias("distinct_count"), F.count_if(F.col("n") == 1).alias("unique_count"), best.alias("best"))
    return out.select("column", "distinct_count", "unique_count", F.col("best.value").alias("mode"), *[F.col("best.exact").alias("mode_exact") for _ in more])


def profile_values(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """column, stat, number, text: distinct and unique counts and their shares, mode and the five most frequent values of every column. The text of whole and decimal numbers is exact."""
    total = df.agg(F.count(F.lit(1)).alias("length"))
    out = None
    for numeric in (True, False):
        counts = value_counts(df, columns, numeric=numeric)
        summary = value_stats(counts).crossJoin(F.broadcast(total))
        share = lambda c: F.coalesce(F.try_divide(F.col(c), F.col("length")), F.lit(0.0))
        none_n, none_t = F.lit(None).cast("double"), F.lit(None).cast("string")
        cell = lambda s, n, t: F.struct(F.lit(s).alias("stat"), n.alias("number"), t.alias("text"))
        value = lambda c, exact: (F.col(c), F.col(exact)) if numeric else (none_n, F.col(c))  # noqa: E731, B023
        cells = [cell("distinct_count", F.col("distinct_count").cast("double"), none_t), cell("unique_count", F.col("unique_count").cast("double"), none_t), cell("distinct_per", share("distinct_count"), none_t), cell("unique_per", share("unique_count"), none_t), cell("mode", *value("mode", "mode_exact"))]
        stats = summary.select("column", F.explode(F.array(*cells)).alias("c")).select("column", "c.*")
        names = F.array(*[F.lit(n) for n in ("most_freq", "2nd_freq", "3rd_freq", "4th_freq", "5th_freq")])
        number, text = value("value", "exact")
        top = top_values(counts, 5).select("column", F.get(names, F.col("place") - 1).alias("stat"), number.alias("number"), text.alias("text"))
        both = stats.unionByName(top)
        out = both if out is None else out.unionByName(both)
    return out


def profile_quantiles(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """column, stat, number, text: q1, median, q3 and iqr of every numeric column, exact."""
    names = [c for c in (columns or df.columns) if types.is_numeric_not_bool(df.schema[c].dataType)]
    found = quantiles.column_quantiles(nullify_nonfinite(df), [col(c) for c in names], [0.25, 0.5, 0.75]) if names else []
    rows = [(c, s, v, None) for c, (a, m, b) in zip(names, found, strict=True) if m is not None for s, v in (("q1", a), ("median", m), ("q3", b), ("iqr", b - a))]
    return df.sparkSession.createDataFrame(rows, "column string, stat string, number double, text string")


def profile(df: DataFrame, stats: list[S.Stat] | None = None, skip: tuple[str, ...] = (), values: bool = True, sample_rows: int | None = None) -> DataFrame:
    """The long profile of a table: column, stat, number, text. All rows are read unless sample_rows is given."""
    if sample_rows is not None:
        from lodestrata.operators.paging import sample_rows as draw

        df = draw(df, sample_rows)
    wide, errors = profile_wide(df, stats, skip)
    schema = T.StructType.fromDDL("column string, stat string, number double, text string")
    out = to_long(wide).where("stat <> 'quartiles'")
    if stats is None:
        out = out.unionByName(profile_quantiles(df, [c for c in df.columns if c not in skip]))
    rows = [(f.name, "_type", None, types.semantic_type(f)) for f in df.schema] + [(f.name, "dtype", None, f.dataType.simpleString()) for f in df.schema] + [(f.name, "orig_col_name", None, f.name) for f in df.schema] + [(f.name, "rewritten_col_name", None, short_name(i)) for i, f in enumerate(df.schema)]
    rows += [(c, s, None, f"error: {m}") for c, s, m in errors]
    out = out.unionByName(df.sparkSession.createDataFrame(rows, schema))
    if values:
        out = out.unionByName(profile_values(df, [c for c in df.columns if c not in skip]))
    return out


def profile_scopes(raw: DataFrame, cleaned: DataFrame | None = None, filtered: DataFrame | None = None, stats: list[S.Stat] | None = None, values: bool = True) -> DataFrame:
    """Profiles of the raw table and of those scopes that are given, with a `scope` column."""
    out = None
    for name, df in (("raw", raw), ("cleaned", cleaned), ("filtered", filtered)):
        if df is not None:
            one = profile(df, stats, values=values).select(F.lit(name).alias("scope"), "*")
            out = one if out is None else out.unionByName(one)
    return out


def try_stat(df: DataFrame, column: str, s: S.Stat):
    """One statistic of one column, for trying it out."""
    wide, errors = profile_wide(df.select(col(column)), [*S.BASE, *S.QUANTILES, s] if s.needs else [s])
    if errors:
        raise AnalysisException(errors[0][2])
    return wide.select(col(f"{column}{SEPARATOR}{s.name}")).first()[0]


def explain(stats: list[S.Stat], name: str) -> dict:
    s = next(s for s in stats if s.name == name)
    return {"name": s.name, "needs": list(s.needs), "needed_by": [o.name for o in stats if name in o.needs], "default": None if s.default is S.MISSING else s.default}


class Profiler:
    """A profile whose statistics can be changed while it is in use."""

    def __init__(self, df: DataFrame, stats: list[S.Stat] | None = None):
        self.df, self.stats = df, list(stats if stats is not None else S.BASE)
        S.in_order(self.stats)

    def add(self, s: S.Stat) -> bool:
        """Adds a statistic, or replaces the one of its name; whether it replaced one. One that would leave a need open or close a circle changes nothing and is an error."""
        changed = [s if o.name == s.name else o for o in self.stats]
        again = any(o.name == s.name for o in self.stats)
        changed = changed if again else [*changed, s]
        S.in_order(changed)
        self.stats = changed
        return again

    def remove(self, name: str) -> None:
        left = [o for o in self.stats if o.name != name]
        S.in_order(left)
        self.stats = left

    def explain(self, name: str) -> dict:
        return explain(self.stats, name)

    def try_on(self, column: str, s: S.Stat):
        return try_stat(self.df, column, s)

    def wide(self) -> tuple[DataFrame, list[tuple[str, str, str]]]:
        return profile_wide(self.df, self.stats)

    def long(self) -> DataFrame:
        return to_long(self.wide()[0])


def awkward(spark: SparkSession) -> DataFrame:
    """A table of columns that statistics often fail on: all NaN, all null, all false, all true, nulls among truths, infinities, negatives, numbers near the ends of their types, nested values."""
    rows = [(i, float("nan"), None, False, True, None if i % 3 == 0 else i % 2 == 0, [float("inf"), float("-inf"), float("nan"), 1.5, None][i % 5], -i, (1 << 63) - 1 - i, -(1 << 63) + i, None if i % 4 == 0 else "", [1, None] if i % 2 else None) for i in range(10)]
    return spark.createDataFrame(rows, "id int, all_nan double, all_null string, all_false boolean, all_true boolean, mixed_bool boolean, mixed_float double, negative int, largest long, least long, texts string, nested array<int>").withColumn("all_null_decimal", F.lit(None).cast("decimal(20,0)"))


def self_check(spark: SparkSession, stats: list[S.Stat] | None = None) -> list[tuple[str, str, str]]:
    """What of the statistics fails on the awkward table, all rows, one row and none of it: (column, statistic, message). Empty is good."""
    failed = []
    for rows in (awkward(spark), awkward(spark).limit(1), awkward(spark).limit(0)):
        try:
            wide, errors = profile_wide(rows, stats)
            failed += errors
            wide.collect()
        except Exception as e:  # noqa: BLE001  whatever it is, it is what is asked for
            failed.append(("*", "*", str(e)[:500]))
    return failed


def load_folder(folder: str, function: str) -> dict[str, object]:
    """Functions by file stem from a folder's Python files; names with a leading underscore, and files that fail or lack the function, are left out."""
    found = {}
    for path in sorted(Path(folder).glob("*.py")):
        if path.name.startswith("_"):
            continue
        spec = importlib.util.spec_from_file_location(f"user_{path.stem}", path)
        module = importlib.util.module_from_spec(spec)
        try:
            spec.loader.exec_module(module)
        except Exception:  # noqa: BLE001, S112  a user's file that doesn't load is left out
            continue
        if callable(getattr(module, function, None)):
            found[path.stem] = getattr(module, function)
    return found


def user_stats(folder: str) -> list[S.Stat]:
    """Each file's compute(column) as a statistic named after the file."""
    return [S.stat(name)(lambda column, f=f: f(column)) for name, f in load_folder(folder, "compute").items()]


def user_tables(folder: str) -> dict[str, object]:
    """Each file's process(df) as a table function."""
    return load_folder(folder, "process")
