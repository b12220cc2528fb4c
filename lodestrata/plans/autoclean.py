"""Automatic cleaning: how parseable text columns are, rules that pick a cleaner, and cleaning with the originals kept."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestrata.functions import scalars as S
from lodestrata.functions import types
from lodestrata.functions.aggregates import about_distinct
from lodestrata.functions.scalars import col
from lodestrata.operators import shape
from lodestrata.plans.chain import Op

#: Shares of all rows, nulls included, whose value parses.
FRACTIONS: dict[str, Callable[[Column], Column]] = {
    "regular_int_parse": lambda c: S.parse_number(c).isNotNull(),
    "strip_int_parse": lambda c: F.regexp_replace(c, r"[^\d.]", "") != "",
    "str_bool": lambda c: S.parse_bool_word(c).isNotNull(),
    "us_dates": lambda c: S.parse_us_date(c).isNotNull(),
    "euro_dates": lambda c: S.parse_euro_date(c).isNotNull(),
}


#: Columns whose values occur this often on average are parsed value by value.
REPEATS = 4


def parse_counts(df: DataFrame, parsers: dict[str, Callable[[Column], Column]]) -> DataFrame:
    """column, length (rows), filled (rows with a value) and, for each of the parsers, how many rows hold a value that it is true of, of every text column.

    Values of columns in which they repeat (by a sketch) are counted first, combined before the shuffle, and each is parsed once; columns of values that hardly repeat are parsed row by row.
    """
    names = types.columns_of(df, types.is_string)
    kinds = "column string, length long, filled long, " + ", ".join(f"`{k}` long" for k in parsers)
    if not names:
        return df.sparkSession.createDataFrame([], kinds)
    length, *sizes = df.agg(F.count(F.lit(1)), *[F.struct(F.count(col(c)), about_distinct(col(c), log_size=12)) for c in names]).first()
    repeated = [c for c, (filled, distinct) in zip(names, sizes, strict=True) if distinct * REPEATS <= filled]
    filled = {c: n for c, (n, _) in zip(names, sizes, strict=True)}
    rows = []
    if repeated:
        cells = F.array(*[F.struct(F.lit(c).alias("column"), col(c).alias("v")) for c in repeated])
        values = df.select(F.explode(cells).alias("c")).select("c.*").where("v is not null").groupBy("column", "v").agg(F.count(F.lit(1)).alias("n"))
        holds = [F.coalesce(F.sum(F.when(t(F.col("v")), F.col("n"))), F.lit(0)) for t in parsers.values()]
        rows += [(r[0], length, filled[r[0]], *r[1:]) for r in values.groupBy("column").agg(*holds).collect()]  # a row a column
    direct = [c for c in names if c not in repeated]
    if direct:
        found = df.agg(*[F.struct(*[F.count_if(t(col(c))) for t in parsers.values()]) for c in direct]).first()
        rows += [(c, length, filled[c], *r) for c, r in zip(direct, found, strict=True)]
    return df.sparkSession.createDataFrame([r for c in names for r in rows if r[0] == c], kinds)


def parse_fractions(df: DataFrame) -> DataFrame:
    """column and the shares of FRACTIONS, int_parse and int_parse_fail for every column; 0 for columns that aren't text."""
    counts = {r["column"]: r for r in parse_counts(df, FRACTIONS | {"int_parse": lambda c: c.try_cast("bigint").isNotNull()}).collect()}  # a row a column
    rows = []
    for c in df.columns:
        r = counts.get(c)
        share = lambda n, r=r: n / r["length"] if r and r["length"] else 0.0
        whole = r["int_parse"] if r else 0
        rows.append((c, *[share(r[k] if r else 0) for k in FRACTIONS], share(whole), share(r["length"] - whole if r else 0)))
    return df.sparkSession.createDataFrame(rows, "column string, " + ", ".join(f"{k} double" for k in (*FRACTIONS, "int_parse", "int_parse_fail")))


Rule = Callable[[dict[str, float]], float]


def above(measure: str, threshold: float) -> Rule:
    """A measure where it is over the threshold."""
    return lambda m: m[measure] if m[measure] > threshold else 0.0


def primary(rule: Rule) -> Rule:
    """A rule that goes before others where it holds."""
    return lambda m: 100 * rule(m)


def constant(score: float) -> Rule:
    return lambda m: score


def measure(name: str) -> Rule:
    return lambda m: m[name]


def top_score(rules: dict[str, Rule], measures: dict[str, float]) -> str | None:
    """The rule of the highest score; None if that is the rule `none` or nothing scores. Earlier rules win ties."""
    best, most = None, 0.0
    for name, rule in rules.items():
        if (s := rule(measures)) > most:
            best, most = name, s
    return None if best == "none" else best


#: Cleaners by method (fixed thresholds).
METHODS: dict[str, dict[str, Rule]] = {
    "default": {"safe_int": above("int_parse", 0.3)},
    "conservative": {"str_bool": above("str_bool", 0.9), "regular_int_parse": above("regular_int_parse", 0.9), "strip_int_parse": above("strip_int_parse", 0.9), "none": constant(0.1), "us_date": primary(above("us_dates", 0.8))},
    "aggressive": {"str_bool": above("str_bool", 0.6), "regular_int_parse": above("regular_int_parse", 0.7), "strip_int_parse": above("strip_int_parse", 0.6), "none": constant(0.1), "us_date": primary(above("us_dates", 0.7))},
}


def cleaning_ops(df: DataFrame, method: str | dict[str, Rule]) -> list[Op]:
    """The operations that a method's rules pick, by one job's measures."""
    rules = METHODS[method] if isinstance(method, str) else method
    out = []
    for row in parse_fractions(df).collect():  # a row a column
        name = top_score(rules, row.asDict())
        if name:
            out.append(Op(name, (row["column"],), {"auto": True, "add_orig": True}))
    return out


def auto_clean(df: DataFrame, method: str | dict[str, Rule] = "conservative") -> DataFrame:
    """Each column that a rule cleans, with {column}_orig beside it. The empty method cleans nothing."""
    if not method:
        return df
    return shape.with_originals(df, {o.column: shape.CLEANERS[o.name](col(o.column)) for o in cleaning_ops(df, method)})


def recommend_types(df: DataFrame, most_errors: float = 0.5) -> dict[str, str]:
    """For each text column the type, of datetime, bool, int, float and string, that parses best: under most_errors of its values fail. Dates before 1971 and fractions among integers are refused."""
    names = types.columns_of(df, types.is_string)
    if not names:
        return {}
    tests = {
        "datetime": lambda c: S.parse_datetime(c) >= F.lit("1971-01-01").cast("timestamp"), "bool": lambda c: S.parse_bool_word(c).isNotNull(),
        "float": lambda c: S.parse_number(c).isNotNull(), "fractions": lambda c: S.parse_number(c) != F.floor(S.parse_number(c)),
    }
    row = {}
    for r in parse_counts(df, tests).collect():  # a row a column
        row[r["column"]] = {k: 1 - r[k] / r["filled"] if r["filled"] else 1.0 for k in ("datetime", "bool", "float")} | {"fractions": r["fractions"]}
    out = {}
    for c in names:
        m = row[c]
        if m["datetime"] < most_errors and m["float"] >= most_errors:
            out[c] = "datetime"
        elif m["bool"] < most_errors and m["bool"] <= m["float"]:
            out[c] = "bool"
        elif m["float"] < most_errors:
            out[c] = "float" if m["fractions"] else "int"
        else:
            out[c] = "string"
    return out


def auto_type_ops(df: DataFrame, **options) -> list[Op]:
    return [Op("coerce", (c, t), {"auto": True}) for c, t in recommend_types(df, **options).items() if t != "string"]


def auto_type(df: DataFrame, **options) -> DataFrame:
    """Text columns as the types that recommend_types gives, in one projection."""
    kinds = {o.column: o.args[1] for o in auto_type_ops(df, **options)}
    made = {c: S.parse_bool_word(col(c)) if k == "bool" else shape.COERCIONS[k](col(c)) for c, k in kinds.items()}
    return df.select(*[made[c].alias(c) if c in made else col(c) for c in df.columns])
