"""Registered queries of the table operators and the SQL they are checked against.

Test tables have no nulls and no dirty text, so some queries make them from clean columns by the same expression as their SQL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.functions import scalars as S
from lodestrata.functions import types
from lodestrata.operators import compare, duplicates, filters, group, histogram, model, paging, shape, validate
from lodestrata.plans import autoclean, chain, files, profile, store
from lodestrata.plans import stats as st
from lodestrata.plans.chain import Op
from lodestrata.sources import avro, shared, tables

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    def wrap(fn):
        QUERIES[name or fn.__name__] = fn
        if sql:
            ORACLE_SQL[name or fn.__name__] = sql
        return fn

    return wrap


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return tables.read_table(spark, f"{sf_dir}/{table}.parquet")


NUMBERS = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def _union(parts: list[str]) -> str:
    return " UNION ALL ".join(parts)


# profiles

def _long_sql(table: str, columns: list[str], stats: dict[str, str]) -> str:
    return _union([f"SELECT '{c}' AS \"column\", '{s}' AS stat, CAST({e.format(c=c)} AS DOUBLE) AS number FROM {table}" for c in columns for s, e in stats.items()])


BASIC = {"length": "count(*)", "null_count": "count(*) - count({c})", "non_null_count": "count({c})", "nan_per": "(count(*) - count({c})) / count(*)", "min": "min({c})", "max": "max({c})", "mean": "avg({c})", "std": "stddev_samp({c})", "median": "median({c})", "q1": "quantile_cont({c}, 0.25)", "q3": "quantile_cont({c}, 0.75)", "iqr": "quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25)"}
#: Places to which sums and means of doubles are rounded where two engines add them in different orders.
ROUNDED = {k: (f"round({v}, 4)" if k in ("mean", "std", "q1", "q3", "iqr", "median") else v) for k, v in BASIC.items()}


def _rounded(long: DataFrame) -> DataFrame:
    loose = F.col("stat").isin("mean", "std", "q1", "q3", "iqr", "median", "variance", "cv", "quin99", "sum")
    return long.select("column", "stat", F.when(loose, F.round("number", 4)).otherwise(F.col("number")).alias("number"))


@query(_long_sql("lineitem", NUMBERS, ROUNDED))
def profile_lineitem(spark, d):
    """The profile of every numeric column: one aggregate, and quantiles by ranks."""
    found = profile.profile(read(spark, d, "lineitem").select(*NUMBERS), values=False)
    return _rounded(found.where(F.col("stat").isin([*BASIC])))


@query(_long_sql("orders", ["o_totalprice"], {"sum": "round(sum({c}), 2)", "variance": "round(var_samp({c}), 2)", "value_range": "max({c}) - min({c})", "cv": "round(stddev_samp({c}) / avg({c}), 4)", "quin99": "round(quantile_cont({c}, 0.99), 4)"}))
def profile_extra(spark, d):
    wide, _ = profile.profile_wide(read(spark, d, "orders").select("o_totalprice"), st.BASE + st.QUANTILES + st.EXTRA)
    long = profile.to_long(wide, ["sum", "variance", "value_range", "cv", "quin99"])
    return long.select("column", "stat", F.when(F.col("stat").isin("sum", "variance"), F.round("number", 2)).when(F.col("stat").isin("cv", "quin99"), F.round("number", 4)).otherwise(F.col("number")).alias("number"))


@query(_union([f"SELECT '{c}' AS \"column\", count(*) FILTER (WHERE TRUE) AS \"length\", median({c})::DOUBLE AS \"median\" FROM lineitem" for c in ("l_linenumber", "l_quantity")]))
def profile_stat_rows(spark, d):
    """A long profile pivoted to a row a statistic and back."""
    wide, _ = profile.profile_wide(read(spark, d, "lineitem").select("l_linenumber", "l_quantity"), st.BASE + st.QUANTILES)
    rows = profile.stat_rows(profile.to_long(wide, ["length", "median"]), ["l_linenumber", "l_quantity"])
    return rows.unpivot("stat", ["l_linenumber", "l_quantity"], "column", "v").groupBy("column").pivot("stat", ["length", "median"]).agg(F.first("v")).select("column", F.col("length").cast("long").alias("length"), "median")


def _value_sql(table: str, columns: list[str], cast: str = "VARCHAR") -> str:
    return _union([f"SELECT '{c}' AS \"column\", CAST({c} AS {cast}) AS value, count(*) AS n FROM {table} WHERE {c} IS NOT NULL GROUP BY {c}" for c in columns])


TEXTS = ["o_orderstatus", "o_orderpriority"]


@query(f"SELECT \"column\", value, n, CAST(place AS INTEGER) AS place FROM (SELECT *, row_number() OVER (PARTITION BY \"column\" ORDER BY n DESC, value) AS place FROM ({_value_sql('orders', ['o_custkey', 'o_totalprice'], 'DOUBLE')})) WHERE place <= 10")
def value_counts_top(spark, d):
    return profile.top_values(profile.value_counts(read(spark, d, "orders"), ["o_custkey", "o_totalprice"], numeric=True), 10).select("column", "value", "n", "place")


@query(_value_sql("events", ["event_type"]) + " UNION ALL " + _value_sql("orders", TEXTS))
def value_counts_text(spark, d):
    return profile.value_counts(read(spark, d, "events"), ["event_type"]).unionByName(profile.value_counts(read(spark, d, "orders"), TEXTS))


def _strings_sql(table: str, columns: list[str]) -> str:
    one = "SELECT '{c}' AS \"column\", count(*) AS distinct_count, count(*) FILTER (WHERE n = 1) AS unique_count, (SELECT v FROM (SELECT {c} AS v, count(*) AS n FROM {t} GROUP BY {c}) ORDER BY n DESC, v LIMIT 1) AS mode FROM (SELECT count(*) AS n FROM {t} GROUP BY {c})"
    return _union([one.format(c=c, t=table) for c in columns])


@query(_strings_sql("part", ["p_name", "p_brand", "p_type"]))
def profile_strings(spark, d):
    df = read(spark, d, "part")
    return profile.value_stats(profile.value_counts(df, ["p_name", "p_brand", "p_type"]))


@query("SELECT 'p_size' AS \"column\", CAST(p_size AS DOUBLE) AS number FROM part GROUP BY p_size ORDER BY count(*) DESC, p_size LIMIT 1")
def mode_stat(spark, d):
    return profile.profile_values(read(spark, d, "part"), ["p_size"]).where("stat = 'mode'").select("column", "number")


@query("WITH v AS (SELECT p_brand AS b, count(*) AS n FROM part GROUP BY 1), r AS (SELECT b, row_number() OVER (ORDER BY n DESC, b) AS k FROM v) SELECT 'p_brand' AS \"column\", CASE k WHEN 1 THEN 'most_freq' WHEN 2 THEN '2nd_freq' WHEN 3 THEN '3rd_freq' WHEN 4 THEN '4th_freq' ELSE '5th_freq' END AS stat, b AS text FROM r WHERE k <= 5")
def most_frequent(spark, d):
    return profile.profile_values(read(spark, d, "part"), ["p_brand"]).where("stat like '%_freq'").select("column", "stat", "text")


@query("SELECT scope, \"column\", stat, number FROM (SELECT 'raw' AS scope, 'o_totalprice' AS \"column\", 'length' AS stat, CAST(count(*) AS DOUBLE) AS number FROM orders UNION ALL SELECT 'filtered', 'o_totalprice', 'length', count(*) FROM orders WHERE contains(o_orderpriority, 'URGENT') OR contains(o_orderstatus, 'URGENT') UNION ALL SELECT 'raw', 'o_totalprice', 'max', max(o_totalprice) FROM orders UNION ALL SELECT 'filtered', 'o_totalprice', 'max', max(o_totalprice) FROM orders WHERE contains(o_orderpriority, 'URGENT') OR contains(o_orderstatus, 'URGENT'))")
def profile_scopes(spark, d):
    df = read(spark, d, "orders")
    found = profile.profile_scopes(df, filtered=filters.search(df, "URGENT"), values=False)
    return found.where("`column` = 'o_totalprice' and stat in ('length', 'max')").select("scope", "column", "stat", "number")


@query("SELECT 'o_orderdate' AS \"column\", 'timestamp' AS dtype, 'datetime' AS type, count(*) AS rows FROM orders UNION ALL SELECT 'o_orderkey', 'bigint', 'integer', count(*) FROM orders UNION ALL SELECT 'o_custkey', 'bigint', 'integer', count(*) FROM orders UNION ALL SELECT 'o_orderstatus', 'string', 'string', count(*) FROM orders UNION ALL SELECT 'o_totalprice', 'double', 'float', count(*) FROM orders UNION ALL SELECT 'o_orderpriority', 'string', 'string', count(*) FROM orders")
def table_metadata(spark, d):
    return tables.metadata(read(spark, d, "orders"), "orders").select("column", F.regexp_replace("dtype", "timestamp_ntz", "timestamp").alias("dtype"), "type", "rows")


@query(_union([f"SELECT '{c}' AS \"column\", count(DISTINCT {c}) AS distinct_count, quantile_disc({c}, 0.5)::DOUBLE AS median FROM lineitem" for c in ("l_linenumber", "l_quantity")]))
def approximate_distinct(spark, d):
    """Sketches of columns of few values, where they are exact."""
    wide, _ = profile.profile_wide(read(spark, d, "lineitem").select("l_linenumber", "l_quantity"), st.BASE + st.APPROXIMATE_ALL)
    rows = profile.stat_rows(profile.to_long(wide, ["distinct_count", "median"]), ["l_linenumber", "l_quantity"])
    return rows.unpivot("stat", ["l_linenumber", "l_quantity"], "column", "v").groupBy("column").pivot("stat", ["distinct_count", "median"]).agg(F.first("v")).select("column", F.col("distinct_count").cast("long").alias("distinct_count"), "median")


BIG = 1 << 60


@query(f"WITH k AS (SELECT o_orderkey + {BIG} AS k FROM orders UNION ALL SELECT o_orderkey + {BIG} FROM orders WHERE o_orderkey % 3 = 0), c AS (SELECT k, count(*) AS n FROM k GROUP BY k) SELECT * FROM (SELECT 'min' AS stat, CAST(min(k) AS VARCHAR) AS text FROM k UNION ALL SELECT 'max', CAST(max(k) AS VARCHAR) FROM k UNION ALL SELECT 'sum', CAST(sum(k) AS VARCHAR) FROM k UNION ALL SELECT 'mode', CAST((SELECT k FROM c ORDER BY n DESC, k LIMIT 1) AS VARCHAR) UNION ALL SELECT 'distinct_count', CAST(count(*) AS VARCHAR) FROM c UNION ALL SELECT 'unique_count', CAST(count(*) FILTER (WHERE n = 1) AS VARCHAR) FROM c)")
def profile_big_keys(spark, d):
    """Keys that a double can't tell apart: every count and every bound is exact."""
    df = read(spark, d, "orders").select("o_orderkey")
    df = df.unionByName(df.where("o_orderkey % 3 = 0")).select((F.col("o_orderkey") + BIG).alias("k"))
    wide, _ = profile.profile_wide(df, st.BASE + st.EXTRA[:1])
    long = profile.to_long(wide, ["min", "max", "sum"]).unionByName(profile.profile_values(df).where("stat in ('mode', 'distinct_count', 'unique_count')"))
    return long.select("stat", F.coalesce("text", F.col("number").cast("long").cast("string")).alias("text"))


@query(f"WITH v AS (SELECT o_orderkey // 4 + {BIG} AS k, count(*) AS n FROM orders GROUP BY 1) SELECT CAST(k AS VARCHAR) AS exact, n, CAST(row_number() OVER (ORDER BY n DESC, k) AS INTEGER) AS place FROM v ORDER BY n DESC, k LIMIT 10")
def value_counts_big_keys(spark, d):
    df = read(spark, d, "orders").select((F.floor(F.col("o_orderkey") / 4).cast("long") + BIG).alias("k"))
    return profile.top_values(profile.value_counts(df, numeric=True), 10).select("exact", "n", "place")


@query("WITH e AS (SELECT nullif(CASE WHEN event_id % 3 = 0 THEN '' WHEN event_id % 3 = 1 THEN event_type ELSE CAST(user_id AS VARCHAR) END, 'click') AS s FROM events), c AS (SELECT s, count(*) AS n FROM e WHERE s IS NOT NULL GROUP BY s), l AS (SELECT count(*) AS n, count(*) FILTER (WHERE s = '') AS z FROM e) SELECT stat, round(number, 9) AS number FROM (SELECT 'empty_count' AS stat, CAST(z AS DOUBLE) AS number FROM l UNION ALL SELECT 'empty_per', z / n FROM l UNION ALL SELECT 'distinct_per', (SELECT count(*) FROM c) / n FROM l UNION ALL SELECT 'unique_per', (SELECT count(*) FILTER (WHERE n = 1) FROM c) / n FROM l)")
def profile_text_shares(spark, d):
    k = F.col("event_id") % 3
    df = read(spark, d, "events").select(F.nullif(F.when(k == 0, "").when(k == 1, F.col("event_type")).otherwise(F.col("user_id").cast("string")), F.lit("click")).alias("s"))
    found = profile.profile(df).where("stat in ('empty_count', 'empty_per', 'distinct_per', 'unique_per')")
    return found.select("stat", F.round("number", 9).alias("number"))


@query("SELECT 'd' AS \"column\", max(o_orderdate) >= TIMESTAMP '1973-01-01' AS probable FROM orders UNION ALL SELECT 'old', max(o_orderdate - INTERVAL 40 YEAR) >= TIMESTAMP '1973-01-01' FROM orders UNION ALL SELECT 'p', FALSE")
def probable_datetime(spark, d):
    """Whether text columns hold times: dates, dates of 40 years before, and words."""
    when = F.col("o_orderdate").cast("timestamp_ntz")
    df = read(spark, d, "orders").select(F.date_format(when, "yyyy-MM-dd").alias("d"), F.date_format(when - F.expr("INTERVAL 40 YEARS"), "yyyy-MM-dd").alias("old"), F.col("o_orderpriority").alias("p"))
    wide, _ = profile.profile_wide(df, [s for s in st.EXTRA if s.name == "probable_datetime"])
    return profile.to_long(wide).select("column", (F.col("number") == 1).alias("probable"))


@query("WITH l AS (SELECT l_shipmode AS k, v FROM (SELECT l_returnflag AS l_shipmode, l_extendedprice AS v FROM lineitem)) SELECT 'l_extendedprice' AS \"column\", round(quantile_cont(v, 0.9) - quantile_cont(v, 0.1), 4) AS spread, round((quantile_cont(v, 0.9) - quantile_cont(v, 0.1)) / avg(v), 6) AS relative FROM l")
def user_query_stats(spark, d):
    """A user's statistic that runs its own query, and one made of it; a broken one stops neither."""
    from lodestrata.operators.quantiles import column_quantiles

    spread = st.query_stat("spread", types.is_numeric_not_bool)(lambda df, columns: {c: b - a for c, (a, b) in zip(columns, column_quantiles(df, [F.col(c) for c in columns], [0.1, 0.9]), strict=True)})
    relative = st.stat("relative", types.is_numeric_not_bool)(lambda spread, mean: F.try_divide(spread, mean))
    broken = st.query_stat("broken")(lambda df, columns: 1 / 0)
    live = profile.Profiler(read(spark, d, "lineitem").select("l_extendedprice"))
    for s in (st.stat("relative")(lambda mean: mean), spread, broken, relative):
        live.add(s)
    wide, errors = live.wide()
    assert [e[1] for e in errors] == ["broken"]
    return wide.select(F.lit("l_extendedprice").alias("column"), F.round("l_extendedprice__spread", 4).alias("spread"), F.round("l_extendedprice__relative", 6).alias("relative"))


@query("SELECT column_name AS \"column\", column_type IN ('BIGINT', 'INTEGER', 'DOUBLE') AS is_numeric, column_type IN ('BIGINT', 'INTEGER') AS is_integer, column_type = 'DOUBLE' AS is_float, column_type = 'VARCHAR' AS is_string, column_type LIKE 'TIMESTAMP%' AS is_datetime FROM (DESCRIBE SELECT * FROM lineitem)")
def type_flags(spark, d):
    return types.type_table(read(spark, d, "lineitem")).select("column", "is_numeric", "is_integer", "is_float", "is_string", "is_datetime")


# histograms

_TRIMMED = """
WITH t AS (SELECT quantile_cont({c}, 0.01) AS lt, quantile_cont({c}, 0.99) AS ht FROM {t}),
m AS (SELECT CAST({c} AS DOUBLE) AS v, lt, ht FROM {t}, t WHERE {c} > lt AND {c} < ht),
r AS (SELECT min(v) AS lo, max(v) AS hi, count(*) AS n FROM m),
b AS (SELECT least(9, greatest(0, CAST(floor((v - lo) / ((hi - lo) / 10)) AS INTEGER))) AS bin, count(*) AS k FROM m, r GROUP BY 1)
SELECT '{c}' AS "column", lt AS low_tail, ht AS high_tail, CAST(i AS INTEGER) AS bin, round(coalesce(k, 0) / n, 9) AS population FROM r, t, range(10) AS g(i) LEFT JOIN b ON b.bin = i
"""


@query(_TRIMMED.format(c="l_extendedprice", t="lineitem") + " UNION ALL " + f"SELECT * FROM ({_TRIMMED.format(c='l_quantity', t='lineitem')})")
def histogram_trimmed(spark, d):
    bins = histogram.trimmed(read(spark, d, "lineitem"), ["l_extendedprice", "l_quantity"])
    return bins.select("column", "low_tail", "high_tail", "bin", F.round("population", 9).alias("population"))


@query("WITH r AS (SELECT min(value) AS lo, max(value) AS hi, count(*) AS n FROM events), b AS (SELECT least(9, CAST(floor((value - lo) / ((hi - lo) / 10)) AS INTEGER)) AS bin, count(*) AS k FROM events, r GROUP BY 1) SELECT 'value' AS \"column\", CAST(i AS INTEGER) AS bin, coalesce(k, 0) AS n, round(100 * coalesce(k, 0) / n, 1) AS percent FROM r, range(10) AS g(i) LEFT JOIN b ON b.bin = i")
def histogram_full(spark, d):
    return histogram.full_range(read(spark, d, "events"), ["value"]).select("column", "bin", "n", "percent")


@query("WITH v AS (SELECT p_type AS value, count(*) AS n FROM part GROUP BY 1), k AS (SELECT value, n, row_number() OVER (ORDER BY n DESC, value) AS place FROM v), t AS (SELECT * FROM k WHERE place <= 10) SELECT 'p_type' AS \"column\", CAST(place AS INTEGER) AS place, value, round(100 * n / (SELECT sum(n) FROM t), 1) AS percent FROM t")
def histogram_top_ten(spark, d):
    return histogram.top_ten(read(spark, d, "part"), ["p_type"])


_CATEGORICAL = """
WITH d AS (SELECT {e} AS x FROM {t}), v AS (SELECT x AS name, count(*) AS n FROM d WHERE x IS NOT NULL GROUP BY 1), k AS (SELECT name, n, row_number() OVER (ORDER BY n DESC, name) AS place FROM v), l AS (SELECT count(*) AS len, count(x) AS filled FROM d),
s AS (SELECT coalesce(sum(n), 0) AS top_sum, count(*) FILTER (WHERE n = 1) AS top_unique FROM k WHERE place <= 7 AND n >= {share} * (SELECT len FROM l)), u AS (SELECT count(*) FILTER (WHERE n = 1) AS uniq FROM v),
a AS (SELECT place, name, 100.0 * n / len AS p FROM k, l WHERE place <= 7 AND n >= {share} * len UNION ALL SELECT 100, 'longtail', 100.0 * (filled - top_sum - (uniq - top_unique)) / len FROM l, s, u UNION ALL SELECT 101, 'unique', 100.0 * (uniq - top_unique) / len FROM s, u, l UNION ALL SELECT 102, 'NA', 100.0 * (len - filled) / len FROM l)
SELECT name, CAST(place AS INTEGER) AS place, round_even(p, 0) AS percent FROM a WHERE round_even(p, 0) > 0.3
"""


@query(_CATEGORICAL.format(e="nullif(o_orderpriority, '5-LOW')", t="orders", share=0))
def histogram_categorical(spark, d):
    df = read(spark, d, "orders").select(F.nullif(F.col("o_orderpriority"), F.lit("5-LOW")).alias("x"))
    return histogram.categorical(df).select("name", "place", "percent")


@query(_CATEGORICAL.format(e="CASE WHEN c_custkey % 3 = 0 THEN c_name WHEN c_custkey % 3 = 1 THEN c_mktsegment ELSE CAST(c_nationkey AS VARCHAR) END", t="customer", share=0.05))
def histogram_frequent_only(spark, d):
    x = F.when(F.col("c_custkey") % 3 == 0, F.col("c_name")).when(F.col("c_custkey") % 3 == 1, F.col("c_mktsegment")).otherwise(F.col("c_nationkey").cast("string"))
    return histogram.categorical(read(spark, d, "customer").select(x.alias("x")), least_share=0.05).select("name", "place", "percent")


def _label_sql(value: str, step: str, ref: str) -> str:
    """SQL of a number's label."""
    scale = f"CASE WHEN {ref} >= 1e12 THEN 1e12 WHEN {ref} >= 1e9 THEN 1e9 WHEN {ref} >= 1e6 THEN 1e6 WHEN {ref} >= 1e3 THEN 1e3 ELSE 1.0 END"
    places = f"CAST(greatest(0, least(CASE WHEN {ref} >= 1e3 THEN 2 ELSE 6 END, 1 - floor(log10({step} / ({scale}))))) AS INTEGER)"
    said = f"format('{{{{:.' || {places} || 'f}}}}', {value} / ({scale}))".replace("{{", "{").replace("}}", "}")
    return f"regexp_replace(CASE WHEN contains({said}, '.') THEN rtrim(rtrim({said}, '0'), '.') ELSE {said} END, '^-0$', '0') || CASE WHEN {ref} >= 1e12 THEN 'T' WHEN {ref} >= 1e9 THEN 'B' WHEN {ref} >= 1e6 THEN 'M' WHEN {ref} >= 1e3 THEN 'K' ELSE '' END"


def _bounds_sql(lo: str, hi: str) -> str:
    return f"{lo} || CASE WHEN {lo} LIKE '-%' OR {hi} LIKE '-%' THEN '<>' ELSE '–' END || {hi}"


def _bars_sql(table: str, c: str) -> str:
    bins = _TRIMMED.format(c=c, t=table)
    return f"""
SELECT '{c}' AS "column", place, {_bounds_sql('a', 'b')} AS name, percent FROM (
  WITH x AS ({bins}), e AS (SELECT min(v) AS lo, max(v) AS hi FROM (SELECT CAST({c} AS DOUBLE) AS v FROM {table}) WHERE v > (SELECT max(low_tail) FROM x) AND v < (SELECT max(high_tail) FROM x)),
  g AS (SELECT lo, hi, (hi - lo) / 10 AS step, greatest(abs(lo), abs(hi)) AS ref, (SELECT min({c}) FROM {table}) AS least, (SELECT max({c}) FROM {table}) AS most, (SELECT max(low_tail) FROM x) AS lt, (SELECT max(high_tail) FROM x) AS ht FROM e)
  SELECT CAST(bin + 2 AS INTEGER) AS place, {_label_sql('(lo + step * bin)', 'step', 'ref')} AS a, {_label_sql('(lo + step * (bin + 1))', 'step', 'ref')} AS b, round_even(100 * population, 0) AS percent FROM x, g
  UNION ALL SELECT 1, {_label_sql('least', 'step', 'abs(least)')}, {_label_sql('lt', 'step', 'abs(lt)')}, 1.0 FROM g
  UNION ALL SELECT 12, {_label_sql('ht', 'step', 'abs(ht)')}, {_label_sql('most', 'step', 'abs(most)')}, 1.0 FROM g)"""


@query(" UNION ALL ".join(f"SELECT * FROM ({_bars_sql(t, c)})" for t, c in (("orders", "o_totalprice"), ("customer", "c_acctbal"))) + " UNION ALL SELECT 'o_orderstatus', place, name, percent FROM (" + _CATEGORICAL.format(e="o_orderstatus", t="orders", share=0) + ")")
def histogram_bars(spark, d):
    """Labelled bars: numeric bins with tails, of either sign, and categories."""
    return histogram.bars(read(spark, d, "orders"), ["o_totalprice", "o_orderstatus"]).unionByName(histogram.bars(read(spark, d, "customer"), ["c_acctbal"]))


@query("SELECT 'p_size' AS \"column\", unnest([lo + (hi - lo) / 10 * i for i in range(11)]) AS edge FROM (SELECT min(p_size) AS lo, max(p_size) AS hi FROM part)")
def histogram_edges(spark, d):
    edges = read(spark, d, "part").agg(histogram.bin_edges(F.min("p_size").cast("double"), F.max("p_size").cast("double")).alias("e"))
    return edges.select(F.lit("p_size").alias("column"), F.explode("e").alias("edge"))


@query(f"WITH r AS (SELECT min(value) AS lo, max(value) AS hi, count(*) AS n FROM events), g AS (SELECT lo, hi, (hi - lo) / 10 AS step, greatest(abs(lo), abs(hi)) AS ref, n FROM r), b AS (SELECT least(9, CAST(floor((value - lo) / step) AS INTEGER)) AS bin, count(*) AS k FROM events, g GROUP BY 1), x AS (SELECT {_label_sql('(lo + step * i)', 'step', 'ref')} AS a, {_label_sql('(lo + step * (i + 1))', 'step', 'ref')} AS b, round(100 * coalesce(k, 0) / n, 1) AS population FROM g, range(10) AS q(i) LEFT JOIN b ON b.bin = i) SELECT 'value' AS \"column\", {_bounds_sql('a', 'b')} AS name, population FROM x UNION ALL SELECT 'event_type', event_type, round(100 * count(*) / (SELECT count(*) FROM events), 1) FROM events GROUP BY event_type")
def histogram_pushed_down(spark, d):
    """Bars from plain aggregates; a column that isn't there has none."""
    df = read(spark, d, "events")
    assert histogram.pushed_down(df, "no_such_column") == []
    rows = [(c, r["name"], float(r["population"])) for c in ("value", "event_type") for r in histogram.pushed_down(df, c)]
    return spark.createDataFrame(rows, "column string, name string, population double")


# grouping

PLAIN = {"mean": "round(avg({c}), 6)", "median": "median({c})", "min": "min({c})", "max": "max({c})", "sum": "round(sum({c}), 2)", "count": "count({c})", "count_null": "count(*) - count({c})", "std": "round(stddev_samp({c}), 6)", "nunique": "count(DISTINCT {c})", "hasnans": "count(*) > count({c})", "empty": "count(*) = 0", "all": "bool_and({c} <> 0)", "any": "bool_or({c} <> 0)", "kurt": "round(kurtosis({c}), 6)", "skew": "round(skewness({c}), 6)", "sem": "round(stddev_samp({c}) / sqrt(count({c})), 6)", "size": "count(*)", "nbytes": "8 * count({c})", "ndim": "1", "dtype": "'double'"}
_ROUND = {"mean": 6, "sum": 2, "std": 6, "kurt": 6, "skew": 6, "sem": 6}


def _group_sql(names: list[str], table: str, key: str, c: str) -> str:
    return f"SELECT {key}, " + ", ".join(f"{PLAIN[n].format(c=c)} AS {c}_{n}" for n in names) + f" FROM {table} GROUP BY {key}"


@query(_group_sql([*PLAIN], "lineitem", "l_returnflag", "l_quantity"))
def groupby_aggs(spark, d):
    out = group.group_by(read(spark, d, "lineitem"), "l_returnflag", {"l_quantity": [*PLAIN]})
    return out.select("l_returnflag", *[(F.round(f"l_quantity_{n}", _ROUND[n]) if n in _ROUND else F.col(f"l_quantity_{n}")).alias(f"l_quantity_{n}") for n in PLAIN])


@query("WITH w AS (SELECT event_type, event_id, value, lag(value) OVER (PARTITION BY event_type ORDER BY event_id) AS b, avg(value) OVER (PARTITION BY event_type) AS m FROM events) SELECT event_type, coalesce(bool_and(value >= b), TRUE) AS value_is_monotonic_increasing, coalesce(bool_and(value <= b), TRUE) AS value_is_monotonic_decreasing, round(corr(value, b), 6) AS value_autocorr, round(avg(abs(value - m)), 6) AS value_mad, arg_min(event_id, (-value, event_id)) AS value_idxmax, arg_min(event_id, (value, event_id)) AS value_idxmin FROM w GROUP BY event_type")
def groupby_ordered_aggs(spark, d):
    names = ["is_monotonic_increasing", "is_monotonic_decreasing", "autocorr", "mad", "idxmax", "idxmin"]
    out = group.group_by(read(spark, d, "events"), "event_type", {"value": names}, order_by=["event_id"])
    return out.select("event_type", *[(F.round(f"value_{n}", 6) if n in ("autocorr", "mad") else F.col(f"value_{n}")).alias(f"value_{n}") for n in names])


@query("SELECT o_orderpriority, arg_min(o_orderkey, o_orderkey) FILTER (WHERE o_orderstatus = m) AS o_orderstatus_idxmax, arg_min(o_orderkey, o_orderkey) FILTER (WHERE o_orderdate = e) AS o_orderdate_idxmax, arg_min(o_orderkey, (o_orderstatus, o_orderkey)) AS o_orderstatus_idxmin FROM (SELECT *, max(o_orderstatus) OVER w AS m, max(o_orderdate) OVER w AS e FROM orders WINDOW w AS (PARTITION BY o_orderpriority)) GROUP BY 1")
def groupby_idxmax(spark, d):
    """The first row with a group's largest text or date."""
    return group.group_by(read(spark, d, "orders"), "o_orderpriority", {"o_orderstatus": ["idxmax", "idxmin"], "o_orderdate": ["idxmax"]}, order_by=["o_orderkey"])


@query("SELECT c_mktsegment, round(sum(c_acctbal), 2) AS \"c_acctbal(sum)\", count(c_acctbal) AS \"c_acctbal(count)\", median(c_acctbal) AS \"c_acctbal(median)\" FROM customer GROUP BY 1")
def groupby_sorted(spark, d):
    out = group.group_by_sorted(read(spark, d, "customer"), "c_mktsegment", {"c_acctbal": ["sum", "count", "median"], "c_name": "null"})
    return out.withColumn("c_acctbal(sum)", F.round("c_acctbal(sum)", 2))


@query("SELECT l_orderkey, l_linenumber, l_suppkey, max(l_quantity) OVER (PARTITION BY l_suppkey) AS l_quantity_max, count(l_quantity) OVER (PARTITION BY l_suppkey) AS l_quantity_count FROM lineitem")
def groupby_transform(spark, d):
    df = read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_quantity")
    return group.group_by_transform(df, "l_suppkey", {"l_quantity": ["max", "count"]}).drop("l_quantity")


@query("SELECT max(n) AS max_group FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey, l_linenumber)")
def max_group(spark, d):
    return group.largest_group(read(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"])


# filters

@query("SELECT doc_id FROM documents WHERE contains(text, 'License') OR contains(lang, 'License') OR contains(source, 'License')")
def search_literal(spark, d):
    return filters.search(read(spark, d, "documents"), "License").select("doc_id")


@query(r"SELECT doc_id FROM documents WHERE regexp_matches(text, '[0-9]{2}-[0-9]{2}') OR regexp_matches(lang, '[0-9]{2}-[0-9]{2}') OR regexp_matches(source, '[0-9]{2}-[0-9]{2}')")
def search_regex(spark, d):
    return filters.search(read(spark, d, "documents"), "[0-9]{2}-[0-9]{2}", regex=True).select("doc_id")


@query("SELECT p_partkey, p_name FROM part WHERE contains(p_name, 'bolt')")
def search_column(spark, d):
    return filters.search_column(read(spark, d, "part"), "p_name", "bolt").select("p_partkey", "p_name")


@query("SELECT o_orderkey, concat_ws(',', CASE WHEN contains(o_orderstatus, 'F') THEN 'o_orderstatus' END, CASE WHEN contains(o_orderpriority, 'F') THEN 'o_orderpriority' END) AS matched FROM orders")
def search_highlight(spark, d):
    return filters.mark_matches(read(spark, d, "orders"), "F").select("o_orderkey", F.array_join("matched_columns", ",").alias("matched"))


@query("SELECT event_id, value FROM events WHERE value > 10 AND value < 60")
def range_filter(spark, d):
    return filters.range_filter(read(spark, d, "events"), "value", 10, 60).select("event_id", "value")


@query("WITH q AS (SELECT quantile_cont(o_totalprice, 0.05) AS a, quantile_cont(o_totalprice, 0.95) AS b FROM orders) SELECT o_orderkey FROM orders, q WHERE o_totalprice > a AND o_totalprice < b")
def remove_outliers(spark, d):
    return filters.remove_outliers(read(spark, d, "orders"), "o_totalprice", 5).select("o_orderkey")


@query("WITH f AS (SELECT o_orderkey, coalesce(CASE WHEN o_orderkey % 7 <> 0 THEN o_totalprice END, (SELECT avg(CASE WHEN o_orderkey % 7 <> 0 THEN o_totalprice END) FROM orders)) AS p FROM orders), q AS (SELECT quantile_cont(p, 0.02) AS a, quantile_cont(p, 0.98) AS b FROM f) SELECT o_orderkey FROM f, q WHERE p < a OR p > b")
def only_outliers(spark, d):
    df = read(spark, d, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 7 != 0, F.col("o_totalprice")).alias("p"))
    return filters.only_outliers(df, "p", 0.02).select("o_orderkey")


@query("WITH q AS (SELECT quantile_cont(user_id, 0.01) AS a, quantile_cont(user_id, 0.99) AS b, quantile_cont(value, 0.01) AS c, quantile_cont(value, 0.99) AS e FROM events) SELECT event_id FROM events, q WHERE user_id <= a OR user_id >= b OR value <= c OR value >= e")
def any_outliers(spark, d):
    return filters.any_outliers(read(spark, d, "events"), columns=["user_id", "value"]).select("event_id")


@query("SELECT o_orderkey FROM orders WHERE o_orderkey % 211 = 0")
def rare_rows(spark, d):
    df = read(spark, d, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 211 == 0, F.col("o_orderstatus")).alias("rare"))
    return filters.rare_rows(df).select("o_orderkey")


@query("SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_quantity < 25 THEN l_quantity END AS q FROM lineitem")
def nullify_nonfinite(spark, d):
    df = read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.when(F.col("l_quantity") < 25, F.col("l_quantity")).when(F.col("l_quantity") < 40, F.lit(float("nan"))).otherwise(F.lit(float("inf"))).alias("q"))
    return filters.nullify_nonfinite(df)


# shape and values

@query("SELECT o_orderkey AS \"index\", o_custkey, o_totalprice FROM orders")
def reindex(spark, d):
    df = read(spark, d, "orders").withColumn("nothing", F.lit(None).cast("string"))
    chosen = shape.drop_null_columns(shape.drop_column(df, "o_orderdate")).select("o_custkey", "o_orderkey", "o_totalprice")
    return shape.promote_to_index(shape.first_columns(chosen, 3), "o_orderkey")


@query("SELECT l_suppkey AS v, count(*) AS n, max(l_quantity) AS most FROM lineitem WHERE l_suppkey <= 100 GROUP BY 1")
def transpose_twice(spark, d):
    """Turned over and back, a small table made of a large one is itself."""
    df = read(spark, d, "lineitem").where("l_suppkey <= 100").groupBy(F.col("l_suppkey").cast("string").alias("k")).agg(F.count(F.lit(1)).cast("double").alias("n"), F.max("l_quantity").alias("most"))
    back = shape.transpose(shape.transpose(df, "k"), "key")
    return back.select(F.col("key").cast("long").alias("v"), F.col("n").cast("long").alias("n"), "most")


@query("SELECT o_orderkey, CASE WHEN o_totalprice < 1000 THEN 'low' END AS error FROM orders")
def error_flag(spark, d):
    return shape.flag(read(spark, d, "orders"), "o_totalprice", 1000, "low").select("o_orderkey", "error")


@query("SELECT o_orderkey, coalesce(nullif(o_orderpriority, '4-NOT SPECIFIED'), 'none') AS p FROM orders")
def fill_null(spark, d):
    df = read(spark, d, "orders").select("o_orderkey", F.nullif(F.col("o_orderpriority"), F.lit("4-NOT SPECIFIED")).alias("p"))
    return shape.fill_null(df, "p", "none")


@query("SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'done' ELSE o_orderstatus END AS o_orderstatus FROM orders")
def replace_value(spark, d):
    return shape.replace_value(read(spark, d, "orders").select("o_orderkey", "o_orderstatus"), "o_orderstatus", "F", "done")


@query("SELECT o_orderkey, o_orderstatus = 'F' AS \"F\", o_orderstatus = 'O' AS \"O\", o_orderstatus = 'P' AS \"P\" FROM orders")
def one_hot(spark, d):
    return shape.one_hot(read(spark, d, "orders").select("o_orderkey", "o_orderstatus"), "o_orderstatus")


@query("SELECT p_partkey, CAST(p_size AS SMALLINT) AS p_size FROM part")
def narrow_int(spark, d):
    return shape.narrow_int(read(spark, d, "part").select("p_partkey", "p_size"), "p_size")


@query("SELECT p_partkey, p_brand, dense_rank() OVER (ORDER BY p_brand) - 1 AS p_brand_code FROM part")
def make_category(spark, d):
    return shape.make_category(read(spark, d, "part").select("p_partkey", "p_brand"), "p_brand")


def dirty(spark: SparkSession, d: str) -> DataFrame:
    """Events with a number, a truth value and a date as dirty text."""
    k = F.col("event_id")
    case = lambda *pairs: _case(k, pairs)
    number = case((0, F.concat(F.lit("$"), k.cast("string"))), (1, k.cast("string")), (2, F.lit("none")), (3, F.concat(k.cast("string"), F.lit(" items"))), (4, F.concat(F.lit("-"), k.cast("string"))))
    truth = case((0, F.lit("Yes")), (1, F.lit(" no ")), (2, F.lit("TRUE")), (3, F.lit("0")), (4, F.lit("perhaps")))
    date = case((0, F.lit("7/4/1776")), (1, F.lit("12/31/2020")), (2, F.lit("17/10/1982")), (3, F.lit("")), (4, F.lit("1/2/2003")))
    return read(spark, d, "events").select("event_id", number.alias("n"), truth.alias("t"), date.alias("s"))


def _case(k, pairs):
    out = None
    for i, v in pairs:
        out = F.when(k % 5 == i, v) if out is None else out.when(k % 5 == i, v)
    return out


DIRTY = "d AS (SELECT event_id, CASE event_id % 5 WHEN 0 THEN '$' || event_id WHEN 1 THEN CAST(event_id AS VARCHAR) WHEN 2 THEN 'none' WHEN 3 THEN event_id || ' items' ELSE '-' || event_id END AS n, CASE event_id % 5 WHEN 0 THEN 'Yes' WHEN 1 THEN ' no ' WHEN 2 THEN 'TRUE' WHEN 3 THEN '0' ELSE 'perhaps' END AS t, CASE event_id % 5 WHEN 0 THEN '7/4/1776' WHEN 1 THEN '12/31/2020' WHEN 2 THEN '17/10/1982' WHEN 3 THEN '' ELSE '1/2/2003' END AS s FROM events)"
STRIPPED = "CAST(coalesce(try_cast(n AS DOUBLE), try_cast(regexp_replace(n, '[^0-9.]', '', 'g') AS DOUBLE)) AS BIGINT)"
TRUTH = "CASE WHEN lower(trim(t)) IN ('true', 'yes', 'on', '1') THEN TRUE WHEN lower(trim(t)) IN ('false', 'no', 'off', '0') THEN FALSE END"


@query(f"WITH {DIRTY} SELECT event_id, {STRIPPED} AS n, {TRUTH} AS t, strftime(try_strptime(s, '%m/%d/%Y'), '%Y-%m-%d') AS s FROM d")
def clean_values(spark, d):
    df = chain.run(dirty(spark, d), [Op("strip_int_parse", ("n",)), Op("str_bool", ("t",)), Op("us_date", ("s",))])[0]
    return df.withColumn("s", F.date_format("s", "yyyy-MM-dd"))


@query(f"WITH {DIRTY} SELECT 'n' AS \"column\", count(try_cast(n AS DOUBLE)) / count(*) AS regular_int_parse, count(*) FILTER (WHERE regexp_replace(n, '[^0-9.]', '', 'g') <> '') / count(*) AS strip_int_parse, 0.0::DOUBLE AS us_dates FROM d UNION ALL SELECT 's', 0, count(*) FILTER (WHERE regexp_replace(s, '[^0-9.]', '', 'g') <> '') / count(*), count(try_strptime(s, '%m/%d/%Y')) / count(*) FROM d")
def parse_fractions(spark, d):
    return autoclean.parse_fractions(dirty(spark, d).select("n", "s")).select("column", "regular_int_parse", "strip_int_parse", "us_dates")


@query(f"WITH {DIRTY} SELECT event_id, {STRIPPED} AS n, n AS n_orig, {TRUTH} AS t, t AS t_orig, {STRIPPED.replace("n,", "s,").replace("(n ", "(s ")} AS s, s AS s_orig FROM d")
def auto_clean(spark, d):
    return autoclean.auto_clean(dirty(spark, d), "aggressive")


@query(f"WITH {DIRTY} SELECT event_id, {TRUTH} AS t, s FROM d")
def auto_type(spark, d):
    return autoclean.auto_type(dirty(spark, d).select("event_id", "t", F.concat(F.lit("x"), "s").alias("s"))).withColumn("s", F.substring("s", 2, 20))


@query("SELECT o_orderkey, CAST(o_orderkey AS DOUBLE) AS f, o_orderkey <> 0 AS b, CAST(o_orderkey AS BIGINT) AS i FROM orders")
def coerce_types(spark, d):
    k = F.col("o_orderkey").cast("string")
    df = read(spark, d, "orders").select("o_orderkey", k.alias("f"), k.alias("b"), k.alias("i"))
    return chain.run(df, [Op("coerce", ("f", "float")), Op("coerce", ("b", "bool")), Op("coerce", ("i", "int"))])[0]


@query("SELECT o_orderkey, CASE WHEN o_totalprice >= 1000 THEN CAST(length(CAST(CAST(floor(o_totalprice) AS BIGINT) AS VARCHAR)) AS INTEGER) ELSE CAST(length(CAST(CAST(floor(o_totalprice) AS BIGINT) AS VARCHAR)) AS INTEGER) END AS digits, round_even(o_totalprice, 0) AS even FROM orders")
def number_text(spark, d):
    df = read(spark, d, "orders")
    return df.select("o_orderkey", S.int_digits(F.col("o_totalprice")).alias("digits"), S.round_half_even(F.col("o_totalprice")).alias("even"))


@query("SELECT event_id, '{\"k\":' || regexp_extract(props, '[0-9]+') || '}' AS m, '[' || user_id || ',null]' AS l, '{\"t\":\"' || event_type || '\",\"u\":' || user_id || '}' AS s, upper(hex(encode(event_type))) AS b, event_type AS plain FROM events")
def nested_text(spark, d):
    """Maps, arrays and structs as JSON, bytes as hexadecimal digits; plain columns stay."""
    df = read(spark, d, "events").select("event_id", F.from_json("props", "map<string,int>").alias("m"), F.array("user_id", F.lit(None).cast("long")).alias("l"), F.struct(F.col("event_type").alias("t"), F.col("user_id").alias("u")).alias("s"), F.col("event_type").cast("binary").alias("b"), F.col("event_type").alias("plain"))
    return shape.nested_to_text(df)


@query(f"WITH {DIRTY} SELECT event_id, CAST(try_cast(n AS DOUBLE) AS BIGINT) AS n, CAST(trunc(try_cast(n AS DOUBLE)) AS BIGINT) AS per_value, nullif(s, '') AS s, try_cast(regexp_replace(n, '[^0-9.]', '', 'g') AS DOUBLE) AS stripped, try_cast(n AS DOUBLE) AS regular FROM d")
def safe_ints(spark, d):
    """Dirty text as whole numbers, whole table and value by value, as numbers without anything but digits, and as text without empty values."""
    df = dirty(spark, d).select("event_id", "n", F.col("n").alias("per_value"), "s", F.col("n").alias("stripped"), F.col("n").alias("regular"))
    out = chain.run(df, [Op("safe_int", ("n",)), Op("coerce", ("per_value", "int")), Op("coerce", ("s", "string")), Op("strip_int_and_period", ("stripped",)), Op("regular_int_parse", ("regular",))])[0]
    return out.withColumn("n", F.col("n").cast("long"))


@query(f"WITH {DIRTY} SELECT event_id, CAST(try_cast(n AS DOUBLE) AS BIGINT) AS n, n AS n_orig, t, s FROM d")
def auto_clean_default(spark, d):
    return autoclean.auto_clean(dirty(spark, d), "default")


@query(f"WITH {DIRTY}, c AS (SELECT *, 'word' AS w FROM d WHERE event_id % 5 IN (1, 4)) SELECT event_id, try_cast(n AS DOUBLE) AS n, n AS n_orig, strftime(try_strptime(s, '%m/%d/%Y'), '%Y-%m-%d') AS s, s AS s_orig, w FROM c")
def auto_clean_conservative(spark, d):
    df = dirty(spark, d).where("event_id % 5 in (1, 4)").select("event_id", "n", "s", F.lit("word").alias("w"))
    out = autoclean.auto_clean(df, "conservative")
    return out.withColumn("s", F.date_format("s", "yyyy-MM-dd"))


@query(f"WITH {DIRTY} SELECT event_id, CAST(try_strptime(s, '%m/%d/%Y') AS TIMESTAMP) AS s FROM d")
def parse_datetimes(spark, d):
    return chain.run(dirty(spark, d).select("event_id", "s"), [Op("coerce", ("s", "datetime"))])[0].withColumn("s", F.col("s").cast("timestamp_ntz"))


@query("SELECT o_orderkey, o_orderdate FROM orders")
def strict_datetimes(spark, d):
    df = read(spark, d, "orders").select("o_orderkey", F.date_format(F.col("o_orderdate").cast("timestamp_ntz"), "yyyy-MM-dd HH:mm:ss").alias("o_orderdate"))
    return chain.run(df, [Op("to_datetime", ("o_orderdate",))])[0].withColumn("o_orderdate", F.col("o_orderdate").cast("timestamp_ntz"))


@query("SELECT o_orderkey, o_orderdate + INTERVAL 5 HOUR AS o_orderdate FROM orders")
def local_times_to_utc(spark, d):
    df = read(spark, d, "orders").select("o_orderkey", F.col("o_orderdate").cast("timestamp_ntz").alias("o_orderdate"))
    return tables.local_to_utc(df, "Etc/GMT+5").withColumn("o_orderdate", F.col("o_orderdate").cast("timestamp_ntz"))


# ranks, pages, duplicates

@query("SELECT p_partkey, CAST(rank() OVER (ORDER BY p_size) AS DOUBLE) AS least, CAST(dense_rank() OVER (ORDER BY p_size) AS DOUBLE) AS dense, rank() OVER (ORDER BY p_size) + (count(*) OVER (PARTITION BY p_size) - 1) / 2.0 AS mean FROM part")
def ranks(spark, d):
    df = read(spark, d, "part").select("p_partkey", "p_size")
    for method, name in (("min", "least"), ("dense", "dense"), ("average", "mean")):
        df = paging.rank(df, "p_size", method, name)
    return df.drop("p_size")


@query("SELECT row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) - 1 AS rowid, o_orderkey FROM orders")
def row_ids(spark, d):
    df = read(spark, d, "orders").select("o_orderkey", (-F.col("o_totalprice")).alias("less"))
    return paging.tag_rows(df, ["less", "o_orderkey"]).select("rowid", "o_orderkey")


@query("SELECT 100 + row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) - 1 AS \"index\", o_orderkey, o_totalprice FROM (SELECT * FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 50 OFFSET 100)")
def page_sorted(spark, d):
    return paging.page(read(spark, d, "orders").select("o_orderkey", "o_totalprice"), 100, 150, "o_totalprice", ascending=False, order_by=["o_orderkey"])


@query("SELECT row_number() OVER (ORDER BY o_custkey, o_orderkey) - 1 AS \"index\", o_orderkey FROM (SELECT * FROM orders WHERE contains(o_orderpriority, 'HIGH') ORDER BY o_custkey, o_orderkey LIMIT 20)")
def page_filtered(spark, d):
    df = read(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderpriority")
    return paging.page_searched(df, "HIGH", 0, 20, "o_custkey", order_by=["o_orderkey"])[0].select("index", "o_orderkey")


@query("SELECT o_orderkey - 1 AS first_id, o_orderkey FROM orders WHERE contains(o_orderpriority, 'URGENT')")
def filter_ids(spark, d):
    tagged = paging.tag_rows(read(spark, d, "orders").select("o_orderkey", "o_orderpriority"), ["o_orderkey"])
    ids = paging.matching_rows(tagged, F.contains("o_orderpriority", F.lit("URGENT")))
    return tagged.join(ids, "rowid").select((F.col("o_orderkey") - 1).alias("first_id"), "o_orderkey")


@query("WITH t AS (SELECT row_number() OVER (ORDER BY o_orderkey) - 1 AS rowid, o_totalprice FROM orders) SELECT rowid, row_number() OVER (ORDER BY o_totalprice DESC, rowid) AS place FROM t ORDER BY o_totalprice DESC, rowid LIMIT 100")
def sort_permutation(spark, d):
    """The first hundred row numbers in the order of the price, with their places."""
    tagged = paging.tag_rows(read(spark, d, "orders").select("o_orderkey", "o_totalprice"), ["o_orderkey"])
    ids = [r["rowid"] for r in paging.sort_permutation(tagged, "o_totalprice", False).limit(100).collect()]
    return spark.createDataFrame([(r, i + 1) for i, r in enumerate(ids)], "rowid long, place long")


@query("SELECT o_orderkey, o_custkey FROM orders ORDER BY o_custkey, o_orderkey LIMIT 1")
def first_row(spark, d):
    return paging.first_row(read(spark, d, "orders"), ["o_custkey", "o_orderkey"]).select("o_orderkey", "o_custkey")


@query("SELECT 'rows' AS kind, o_orderkey FROM orders UNION ALL SELECT 'cells', o_orderkey FROM orders UNION ALL SELECT 'display', o_orderkey FROM orders")
def samples_of_small_tables(spark, d):
    """Samples of tables within their bounds are whole."""
    df = read(spark, d, "orders").select("o_orderkey")
    made = {"rows": paging.sample_rows(df, 1 << 40), "cells": paging.sample_cells(df, most_cells=1 << 40), "display": paging.display_sample(df, (1 << 31) - 1)}
    return _unioned([m.select(F.lit(k).alias("kind"), "o_orderkey") for k, m in made.items()])


@query("SELECT 'rows' AS kind, least(2000, count(*)) AS n, least(2000, count(*)) AS in_table, 0::BIGINT AS otherwise_dealt FROM lineitem UNION ALL SELECT 'cells', least(700, count(*)), least(700, count(*)), 0 FROM orders")
def samples_of_exact_size(spark, d):
    """Samples have exactly as many rows as asked for, all of them the table's, and the same rows when the table is dealt otherwise."""
    cases = {"rows": (read(spark, d, "lineitem"), lambda df: paging.sample_rows(df, 2000, seed=3)), "cells": (read(spark, d, "orders"), lambda df: paging.sample_cells(df, most_cells=1000, rows=700))}
    parts = []
    for kind, (df, draw) in cases.items():
        one, other = draw(df), draw(df.repartition(13, df.columns[1]))
        counted = [one.agg(F.count(F.lit(1)).alias("n")), one.exceptAll(df).agg((F.count(F.lit(1))).alias("strange")), one.exceptAll(other).agg(F.count(F.lit(1)).alias("otherwise_dealt"))]
        row = [c.first()[0] for c in counted]
        parts.append((kind, row[0], row[0] - row[1], row[2]))
    return spark.createDataFrame(parts, "kind string, n long, in_table long, otherwise_dealt long")


_BY_FILE = ["l_orderkey", "l_quantity", "l_extendedprice"]


@query(_long_sql("lineitem", _BY_FILE, {k: ROUNDED[k] for k in ("length", "null_count", "non_null_count", "nan_per", "min", "max", "mean", "std")}) + " UNION ALL SELECT 'l_returnflag', 'length', count(*) FROM lineitem UNION ALL SELECT 'l_returnflag', 'empty_count', 0 UNION ALL SELECT 'files', 'read at first', 4 UNION ALL SELECT 'files', 'read again', 0 UNION ALL SELECT 'files', 'read after two more', 2 UNION ALL SELECT 'columns', 'same fingerprint', 4 UNION ALL SELECT 'columns', 'profiled anew', 0")
def profile_by_files(spark, d):
    """A table that grows by files: each is read once, and what all add up to is the whole table's profile and has its columns' fingerprints."""
    df = read(spark, d, "lineitem").select(*_BY_FILE, "l_returnflag")
    table, kept = shared.new_path(spark), files.FileProfiles(spark, shared.new_path(spark))
    late = F.col("l_orderkey") % 3 == 0
    groups = {"parquet.block.size": 8 << 20}  # bytes of a row group: few large files are read by as many tasks as a core needs
    df.where(~late).repartition(4, "l_orderkey").write.options(**groups).parquet(table)
    reads = [("read at first", kept.update(table)), ("read again", kept.update(table))]
    df.where(late).repartition(2, "l_orderkey").write.options(**groups).mode("append").parquet(table)
    reads.append(("read after two more", kept.update(table)))
    marks, whole = kept.fingerprints(table), shared.keep(store.fingerprints(df))
    same = marks.join(whole, ["column", "fingerprint"]).count()
    columns = store.ProfileStore(spark, shared.new_path(spark))
    columns.profile(df, marks=whole)
    columns.runs.misses = 0
    columns.profile(spark.read.parquet(table), marks=marks)
    said = [("files", k, float(v)) for k, v in reads] + [("columns", "same fingerprint", float(same)), ("columns", "profiled anew", float(columns.runs.misses))]
    wanted = (F.col("column").isin(_BY_FILE) & F.col("stat").isin("length", "null_count", "non_null_count", "nan_per", "min", "max", "mean", "std")) | ((F.col("column") == "l_returnflag") & F.col("stat").isin("length", "empty_count"))
    return _rounded(kept.profile(table).where(wanted)).unionByName(spark.createDataFrame(said, "column string, stat string, number double"))


# sources: whole tables written in each format and opened by extension

def _reopened(df: DataFrame, suffix: str, write) -> DataFrame:
    path = shared.new_path(df.sparkSession, suffix)
    write(df, path)
    return tables.read_table(df.sparkSession, path)


@query("SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, strftime(o_orderdate, '%Y-%m-%d') AS o_orderdate FROM orders")
def csv_reopened(spark, d):
    """A header and inferred types: numbers, text and dates come back as such."""
    df = read(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", F.col("o_orderdate").cast("date").alias("o_orderdate"))
    back = _reopened(df, ".csv", tables.write_csv)
    return back.select(F.col("o_orderkey").cast("long"), F.col("o_custkey").cast("long"), "o_orderstatus", "o_totalprice", F.date_format("o_orderdate", "yyyy-MM-dd").alias("o_orderdate"))


@query("SELECT c_custkey, c_name || chr(9) || 'x' AS c_name, c_acctbal, c_mktsegment FROM customer")
def tsv_reopened(spark, d):
    df = read(spark, d, "customer").select("c_custkey", F.concat("c_name", F.lit("\tx")).alias("c_name"), "c_acctbal", "c_mktsegment")
    back = _reopened(df, ".tsv", lambda df, path: df.write.csv(path, sep="\t", header=True))
    return back.select(F.col("c_custkey").cast("long"), "c_name", "c_acctbal", "c_mktsegment")


@query("SELECT l_orderkey, l_quantity, l_returnflag, CASE WHEN l_linenumber > 2 THEN l_linenumber END AS l_linenumber FROM lineitem")
def ndjson_reopened(spark, d):
    """Nulls are left out of the lines and come back."""
    df = read(spark, d, "lineitem").select("l_orderkey", "l_quantity", "l_returnflag", F.when(F.col("l_linenumber") > 2, F.col("l_linenumber")).alias("l_linenumber"))
    back = _reopened(df, ".ndjson", lambda df, path: df.write.json(path))
    return back.select("l_orderkey", "l_quantity", "l_returnflag", F.col("l_linenumber").cast(df.schema["l_linenumber"].dataType).alias("l_linenumber"))


@query("SELECT o_orderkey, o_totalprice, CASE WHEN o_custkey % 3 > 0 THEN o_orderpriority END AS priority, strftime(o_orderdate, '%Y-%m-%d') AS day, len(o_orderstatus) AS parts, (SELECT count(*) FROM orders) AS n FROM orders")
def avro_reopened(spark, d):
    """Files of blocks, read by many tasks each; nulls, dates and nested values come back."""
    df = read(spark, d, "orders").select("o_orderkey", "o_totalprice", F.when(F.col("o_custkey") % 3 > 0, F.col("o_orderpriority")).alias("priority"), F.col("o_orderdate").cast("date").alias("day"), F.split("o_orderstatus", "").alias("letters"))
    path = shared.new_path(spark, ".avro")
    avro.write_avro(df, path, codec="zstandard", block_rows=1000)
    back = avro.read_avro(spark, path, partition_bytes=1 << 20)
    total = back.agg(F.count(F.lit(1)).alias("n")).first()[0]
    return tables.read_table(spark, path).select("o_orderkey", "o_totalprice", "priority", F.date_format("day", "yyyy-MM-dd").alias("day"), F.length(F.array_join("letters", "")).cast("long").alias("parts"), F.lit(total).cast("long").alias("n"))


def _unioned(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query("SELECT count(*) AS n FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem)")
def distinct_tuples(spark, d):
    return spark.createDataFrame([(duplicates.distinct_tuples(read(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"]),)], "n long")


@query("SELECT rowid FROM (SELECT row_number() OVER (ORDER BY o_orderkey) - 1 AS rowid FROM orders) WHERE rowid >= 40 AND rowid < 70")
def rows_by_id(spark, d):
    tagged = paging.tag_rows(read(spark, d, "orders").select("o_orderkey", "o_totalprice"), ["o_orderkey"])
    return paging.sort_permutation(paging.rows_between(tagged, 40, 70), "o_totalprice", False)


def _kept(order: str) -> str:
    return f"SELECT o_orderkey, o_custkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey {order}) AS k FROM orders) WHERE k = 1"


@query(_kept("ASC"))
def distinct_rows_first(spark, d):
    return duplicates.distinct_on(read(spark, d, "orders"), "o_custkey", ["o_orderkey"], "first").select("o_orderkey", "o_custkey")


@query(_kept("DESC"))
def distinct_rows_last(spark, d):
    return duplicates.distinct_on(read(spark, d, "orders"), "o_custkey", ["o_orderkey"], "last").select("o_orderkey", "o_custkey")


@query("SELECT text FROM documents GROUP BY text HAVING count(*) = 1")
def drop_duplicates_none(spark, d):
    return duplicates.drop_duplicates(read(spark, d, "documents"), "text", "none")


@query("SELECT DISTINCT text FROM documents")
def drop_duplicates_first(spark, d):
    return duplicates.drop_duplicates(read(spark, d, "documents"), "text")


@query("SELECT doc_id, count(*) OVER (PARTITION BY text) > 1 AS is_duplicated FROM documents")
def mark_duplicates(spark, d):
    return duplicates.mark_duplicates(read(spark, d, "documents"), "text").select("doc_id", "is_duplicated")


# comparison

def versions(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Orders, and a version without some rows, with other prices, statuses that became null, and new rows."""
    a = read(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")
    k = F.col("o_orderkey")
    changed = a.where(k % 97 != 0).select("o_orderkey", "o_custkey", F.when(k % 31 != 0, F.col("o_orderstatus")).alias("o_orderstatus"), F.when(k % 53 == 0, F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice")).alias("o_totalprice"), F.lit("x").alias("extra"))
    added = a.where(k % 89 == 0).select((-k).alias("o_orderkey"), "o_custkey", "o_orderstatus", "o_totalprice", F.lit("x").alias("extra"))
    return a, changed.unionByName(added)


VERSIONS = "a AS (SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM orders), b AS (SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey % 31 <> 0 THEN o_orderstatus END AS o_orderstatus, CASE WHEN o_orderkey % 53 = 0 THEN o_totalprice + 1 ELSE o_totalprice END AS o_totalprice, 'x' AS extra FROM orders WHERE o_orderkey % 97 <> 0 UNION ALL SELECT -o_orderkey, o_custkey, o_orderstatus, o_totalprice, 'x' FROM orders WHERE o_orderkey % 89 = 0)"
BOTH = f"{VERSIONS}, j AS (SELECT a.o_orderkey AS ak, b.o_orderkey AS bk, a.o_custkey AS ac, b.o_custkey AS bc, a.o_orderstatus AS a_s, b.o_orderstatus AS bs, a.o_totalprice AS ap, b.o_totalprice AS bp, extra FROM a FULL JOIN b ON a.o_orderkey = b.o_orderkey)"
KEYS = ["o_orderkey"]


@query(f"WITH {BOTH} SELECT count(*) FILTER (WHERE bk IS NULL) AS only_before, count(*) FILTER (WHERE ak IS NULL) AS only_after, count(*) FILTER (WHERE ak = bk) AS matched FROM j")
def key_diff(spark, d):
    return compare.key_diff(*versions(spark, d), keys=KEYS)["totals"]


@query(f"WITH {BOTH}, m AS (SELECT *, CASE WHEN bk IS NULL THEN 1 WHEN ak IS NULL THEN 2 ELSE 3 END AS membership FROM j) SELECT coalesce(ak, bk) AS o_orderkey, membership, ac AS o_custkey, bc AS \"o_custkey|df2\", membership + CASE WHEN ac = bc THEN 4 ELSE 0 END AS \"o_custkey|eq\", a_s AS o_orderstatus, bs AS \"o_orderstatus|df2\", membership + CASE WHEN a_s = bs THEN 4 ELSE 0 END AS \"o_orderstatus|eq\", ap AS o_totalprice, bp AS \"o_totalprice|df2\", membership + CASE WHEN ap = bp THEN 4 ELSE 0 END AS \"o_totalprice|eq\", extra AS \"extra|df2\" FROM m")
def compare_join(spark, d):
    return compare.join_versions(*versions(spark, d), KEYS)


@query(f"WITH {BOTH} SELECT 'o_orderkey' AS \"column\", 'join_key' AS kind, CAST(NULL AS BIGINT) AS differences UNION ALL SELECT 'o_custkey', 'both', count(*) FILTER (WHERE ak = bk AND NOT coalesce(ac = bc, FALSE)) FROM j UNION ALL SELECT 'o_orderstatus', 'both', count(*) FILTER (WHERE ak = bk AND NOT coalesce(a_s = bs, FALSE)) FROM j UNION ALL SELECT 'o_totalprice', 'both', count(*) FILTER (WHERE ak = bk AND NOT coalesce(ap = bp, FALSE)) FROM j UNION ALL SELECT 'extra', 'df_2', NULL")
def diff_counts(spark, d):
    return compare.difference_counts(*versions(spark, d), KEYS)


@query(f"WITH {BOTH}, e AS (SELECT *, ac IS NOT DISTINCT FROM bc AND a_s IS NOT DISTINCT FROM bs AND ap IS NOT DISTINCT FROM bp AS eq FROM j) SELECT FALSE AS any_duplicates, count(*) FILTER (WHERE ak = bk) AS in_common, count(*) FILTER (WHERE bk IS NULL) AS only_df_1, count(*) FILTER (WHERE ak IS NULL) AS only_df_2, count(*) FILTER (WHERE ak = bk AND eq) AS all_equal, count(*) FILTER (WHERE ak = bk AND NOT eq) AS some_unequal FROM e")
def row_summary(spark, d):
    return compare.row_summary(*versions(spark, d), KEYS)


def _match(c: str, x: str, y: str, kind: str, apart: str) -> str:
    return f"SELECT '{c}' AS \"column\", '{kind}' AS dtype_1, '{kind}' AS dtype_2, count(*) FILTER (WHERE {x} IS DISTINCT FROM {y}) AS unequal, {apart} AS max_difference, count(*) FILTER (WHERE ({x} IS NULL) <> ({y} IS NULL)) AS null_differences FROM j WHERE ak = bk"


@query(f"WITH {BOTH} " + _union([_match("o_custkey", "ac", "bc", "bigint", "CAST(max(abs(ac - bc)) AS DOUBLE)"), _match("o_orderstatus", "a_s", "bs", "string", "CAST(NULL AS DOUBLE)"), _match("o_totalprice", "ap", "bp", "double", "round(max(abs(ap - bp)), 6)")]))
def match_stats(spark, d):
    return compare.match_stats(*versions(spark, d), KEYS).withColumn("max_difference", F.round("max_difference", 6))


@query(f"WITH {BOTH} SELECT CAST((max(CASE WHEN ac IS DISTINCT FROM bc THEN 1 ELSE 0 END) + max(CASE WHEN a_s IS DISTINCT FROM bs THEN 1 ELSE 0 END) + max(CASE WHEN ap IS DISTINCT FROM bp THEN 1 ELSE 0 END)) AS BIGINT) AS some_unequal, CAST(3 - (max(CASE WHEN ac IS DISTINCT FROM bc THEN 1 ELSE 0 END) + max(CASE WHEN a_s IS DISTINCT FROM bs THEN 1 ELSE 0 END) + max(CASE WHEN ap IS DISTINCT FROM bp THEN 1 ELSE 0 END)) AS BIGINT) AS all_equal, count(*) FILTER (WHERE ac IS DISTINCT FROM bc) + count(*) FILTER (WHERE a_s IS DISTINCT FROM bs) + count(*) FILTER (WHERE ap IS DISTINCT FROM bp) AS total_unequal FROM j WHERE ak = bk")
def column_matching(spark, d):
    return compare.column_matching(*versions(spark, d), KEYS)


@query(f"WITH {BOTH} SELECT ak AS o_orderkey, a_s AS o_orderstatus_df_1, bs AS o_orderstatus_df_2 FROM j WHERE ak = bk AND a_s IS DISTINCT FROM bs ORDER BY ak LIMIT 10")
def mismatch_sample(spark, d):
    return compare.mismatches(*versions(spark, d), KEYS, "o_orderstatus")


def _summary(side: str, table: str, c: str, number: bool) -> str:
    stats = ", ".join(f"round(CAST({g}({c}) AS DOUBLE), 4)" if number else "CAST(NULL AS DOUBLE)" for g in ("avg", "min", "max", "sum"))
    return f"SELECT '{side}' AS side, '{c}' AS \"column\", count(*) AS r, count(*) - count({c}) AS nu, count(DISTINCT {c}) AS di, {stats.replace('), round', ') , round')} FROM {table}"


_SIDES = _union([_summary(s, t, c, c != "o_orderstatus" and c != "extra") for s, t, cs in (("x", "a", ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice"]), ("y", "b", ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "extra"])) for c in cs])


@query(f"WITH {VERSIONS}, s(side, c, r, nu, di, me, mi, ma, su) AS ({_SIDES}), x AS (SELECT * FROM s WHERE side = 'x'), y AS (SELECT * FROM s WHERE side = 'y') SELECT coalesce(x.c, y.c) AS \"column\", x.r AS rows_before, y.r AS rows_after, x.nu AS nulls_before, y.nu AS nulls_after, x.di AS distinct_before, y.di AS distinct_after, x.me AS mean_before, y.me AS mean_after, x.mi AS min_before, y.mi AS min_after, x.ma AS max_before, y.ma AS max_after FROM x FULL JOIN y ON x.c = y.c")
def stats_diff(spark, d):
    out = compare.stats_diff(*versions(spark, d)).drop("sum_before", "sum_after")
    return out.select(*[F.round(c, 4).alias(c) if c.split("_")[0] in ("mean", "min", "max") else F.col(c) for c in out.columns])


@query(f"WITH {VERSIONS} SELECT 'before' AS side, (SELECT count(*) FROM a) AS total, o_orderkey FROM (SELECT o_orderkey FROM a ORDER BY 1 LIMIT 10) UNION ALL SELECT 'after', (SELECT count(*) FROM b), o_orderkey FROM (SELECT o_orderkey FROM b ORDER BY 1 LIMIT 10)")
def head_diff(spark, d):
    return compare.head_diff(*versions(spark, d), KEYS).select("side", "total", "o_orderkey")


@query(f"WITH {VERSIONS} SELECT 'df_1' AS side, 4 AS \"columns\", count(*) AS \"rows\" FROM a UNION ALL SELECT 'df_2', 5, count(*) FROM b")
def table_header(spark, d):
    return compare.header(*versions(spark, d))


@query(f"WITH {BOTH} SELECT coalesce(ak, bk) AS o_orderkey, ap AS o_totalprice_before, bp AS o_totalprice_after FROM j ORDER BY 1 LIMIT 50")
def diff_preview(spark, d):
    return compare.key_preview(*versions(spark, d), KEYS).select("o_orderkey", "o_totalprice_before", "o_totalprice_after")


@query(f"WITH {BOTH} SELECT ak AS o_orderkey, 3 AS membership, ap AS o_totalprice, bp AS \"o_totalprice|df2\", 'inner' AS how FROM j WHERE ak = bk UNION ALL SELECT ak, CASE WHEN bk IS NULL THEN 1 ELSE 3 END, ap, bp, 'left' FROM j WHERE ak IS NOT NULL UNION ALL SELECT bk, CASE WHEN ak IS NULL THEN 2 ELSE 3 END, ap, bp, 'right' FROM j WHERE bk IS NOT NULL")
def compare_join_how(spark, d):
    parts = [compare.join_versions(*versions(spark, d), KEYS, how).select("o_orderkey", "membership", "o_totalprice", "o_totalprice|df2", F.lit(how).alias("how")) for how in ("inner", "left", "right")]
    return _unioned(parts)


@query("SELECT 'versions' AS tables, count(DISTINCT o_orderkey) >= 0.98 * count(*) AS can_diff, CASE WHEN count(DISTINCT o_orderkey) >= 0.98 * count(*) THEN 'o_orderkey' END AS keys, CAST(NULL AS VARCHAR) AS reason FROM orders UNION ALL SELECT 'nothing shared', FALSE, NULL, 'no shared columns' UNION ALL SELECT 'no key', FALSE, NULL, 'no key in either table' UNION ALL SELECT 'key of the second', TRUE, 'o_orderkey', NULL UNION ALL SELECT 'repeats', FALSE, 'o_orderkey', 'the key''s groups are too large in the second table'")
def diff_preflight(spark, d):
    a, b = versions(spark, d)
    cases = {"versions": (a, b), "nothing shared": (a.select("o_orderkey"), b.select("extra")), "no key": (a.select("o_orderstatus"), b.select("o_orderstatus")), "key of the second": (a.select(F.floor(F.col("o_orderkey") / 4).alias("o_orderkey")), b.select("o_orderkey")), "repeats": (a.select("o_orderkey"), b.select(F.lit(1).cast("long").alias("o_orderkey")))}
    found = {k: compare.probe(*v, max_group=10) for k, v in cases.items()}
    return spark.createDataFrame([(k, f["can_diff"], ",".join(f["keys"]) if f["keys"] else None, f["reason"]) for k, f in found.items()], "tables string, can_diff boolean, keys string, reason string")


@query(f"WITH {VERSIONS}, x AS (SELECT column_name AS c FROM (DESCRIBE SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM orders)), y AS (SELECT c FROM x UNION ALL SELECT 'extra') SELECT count(*) FILTER (WHERE x.c = y.c) AS in_common, count(*) FILTER (WHERE y.c IS NULL) AS only_df_1, count(*) FILTER (WHERE x.c IS NULL) AS only_df_2 FROM x FULL JOIN y ON x.c = y.c")
def column_summary(spark, d):
    return compare.column_summary(*versions(spark, d))


@query("WITH d AS (SELECT count(DISTINCT l_orderkey) AS o, count(DISTINCT (l_orderkey, l_linenumber)) AS ol, count(DISTINCT l_partkey) AS p FROM lineitem) SELECT 'l_orderkey' AS keys, o AS distinct_tuples, (SELECT max(n) FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey)) AS largest FROM d UNION ALL SELECT 'l_orderkey,l_linenumber', ol, (SELECT max(n) FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey, l_linenumber)) FROM d UNION ALL SELECT 'l_partkey', p, (SELECT max(n) FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_partkey)) FROM d")
def measured_keys(spark, d):
    """Several candidate keys in one grouping."""
    found = compare.measure_keys(read(spark, d, "lineitem"), [("l_orderkey",), ("l_orderkey", "l_linenumber"), ("l_partkey",)])
    return found.select(F.array_join("keys", ",").alias("keys"), F.col("distinct").alias("distinct_tuples"), "largest")


@query("SELECT CASE WHEN count(DISTINCT l_orderkey) = count(*) THEN 'l_orderkey' WHEN count(DISTINCT (l_orderkey, l_partkey)) = count(*) THEN 'l_orderkey,l_partkey' WHEN count(DISTINCT (l_orderkey, l_suppkey)) = count(*) THEN 'l_orderkey,l_suppkey' WHEN count(DISTINCT (l_orderkey, l_extendedprice)) = count(*) THEN 'l_orderkey,l_extendedprice' END AS keys, count(*) AS n FROM lineitem")
def primary_key_of_many(spark, d):
    """The key of a table of 60 columns, most of them made of the first: hundreds of pairs are ruled out before any is counted."""
    df = read(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_extendedprice", *[(F.col("l_orderkey") % (1000 + i)).alias(f"rest_{i}") for i in range(56)])
    found = compare.rank_keys(df, max_width=2)
    return spark.createDataFrame([(",".join(found["keys"]) if found else None, df.count())], "keys string, n long")


@query("SELECT 'orders' AS t, 'o_orderkey' AS keys, count(*) AS n FROM orders UNION ALL SELECT 'conversations', CASE WHEN count(DISTINCT text) = count(*) THEN 'text' ELSE 'conv_id,turn' END, count(*) FROM conversations")
def primary_keys(spark, d):
    rows = []
    for t in ("orders", "conversations"):
        found = compare.rank_keys(read(spark, d, t), max_width=2)
        rows.append((t, ",".join(found["keys"]) if found else None, found["n"] if found else None))
    return spark.createDataFrame(rows, "t string, keys string, n long")


# validation, models, user statistics

CHECKS = [validate.isin("o_orderstatus", ["F", "O"]), validate.greater_than("o_totalprice", 1000), validate.at_most("o_totalprice", 400000), validate.str_matches("o_orderpriority", "[1-3]-"), validate.str_length("o_orderpriority", 5, 10)]


@query("SELECT o_orderkey, CASE WHEN o_orderstatus NOT IN ('F', 'O') THEN 1 ELSE 0 END AS o_orderstatus_error, CASE WHEN NOT o_totalprice > 1000 THEN 1 ELSE 0 END + CASE WHEN NOT o_totalprice <= 400000 THEN 2 ELSE 0 END AS o_totalprice_error, concat_ws('|', CASE WHEN NOT regexp_matches(o_orderpriority, '^[1-3]-') THEN 'str_matches([1-3]-)' END, CASE WHEN NOT (length(o_orderpriority) BETWEEN 5 AND 10) THEN 'str_length(5, 10)' END) AS o_orderpriority_reason FROM orders")
def validate_rows(spark, d):
    return validate.with_errors(read(spark, d, "orders"), CHECKS).select("o_orderkey", "o_orderstatus_error", "o_totalprice_error", "o_orderpriority_reason")


@query("SELECT o_orderkey, 'o_orderstatus' AS \"column\", 'isin([''F'', ''O''])' AS \"check\", o_orderstatus AS value FROM orders WHERE o_orderstatus NOT IN ('F', 'O') UNION ALL SELECT o_orderkey, 'o_orderpriority', 'str_matches([1-3]-)', o_orderpriority FROM orders WHERE NOT regexp_matches(o_orderpriority, '^[1-3]-') UNION ALL SELECT o_orderkey, 'o_orderpriority', 'str_length(5, 10)', o_orderpriority FROM orders WHERE NOT (length(o_orderpriority) BETWEEN 5 AND 10)")
def failure_cases(spark, d):
    return validate.failure_cases(read(spark, d, "orders"), [c for c in CHECKS if c.column != "o_totalprice"], ["o_orderkey"])


@query("SELECT o_orderkey, CASE WHEN o_orderstatus NOT IN ('F', 'O') THEN 1 ELSE 0 END AS status_fails FROM orders WHERE o_orderstatus NOT IN ('F', 'O')")
def failure_matrix(spark, d):
    return validate.failure_matrix(read(spark, d, "orders"), CHECKS[:1], ["o_orderkey"]).toDF("o_orderkey", "status_fails")


@query("WITH f AS (SELECT regr_slope(l_extendedprice, l_quantity) AS s, regr_intercept(l_extendedprice, l_quantity) AS i FROM lineitem) SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, round(i + s * l_quantity, 3) AS predicted FROM lineitem, f")
def regression_one_x(spark, d):
    out = model.linear_regression(read(spark, d, "lineitem"), "l_extendedprice", ["l_quantity"])
    return out.select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", F.round("l_extendedprice_predicted", 3).alias("predicted"))


@query("WITH c AS (SELECT dense_rank() OVER (ORDER BY p_size) AS a, dense_rank() OVER (ORDER BY p_size // 2) AS b FROM part), e AS (SELECT dense_rank() OVER (ORDER BY c_nationkey) AS a, dense_rank() OVER (ORDER BY CASE WHEN c_nationkey < 20 THEN c_nationkey ELSE 0 END) AS b FROM customer) SELECT 'p_size' AS \"left\", 'half' AS \"right\", round(corr(a, b), 6) AS correlation FROM c UNION ALL SELECT * FROM (SELECT 'c_nationkey', 'part', round(corr(a, b), 6) AS r FROM e) WHERE r > 0.6")
def correlated_columns(spark, d):
    part = read(spark, d, "part").select("p_size", F.floor(F.col("p_size") / 2).alias("half"), "p_brand", "p_retailprice")
    customer = read(spark, d, "customer").select("c_nationkey", F.when(F.col("c_nationkey") < 20, F.col("c_nationkey")).otherwise(0).alias("part"), "c_custkey")
    found = model.correlated_columns(part).where("left = 'p_size'").unionByName(model.correlated_columns(customer))
    return found.withColumn("correlation", F.round("correlation", 6))


@query("WITH s AS (SELECT count(DISTINCT o_orderstatus) > 1 AS several, count(*) AS n FROM orders) SELECT unnest(['o_orderdate', 'a_level', 'o_orderkey', 'o_totalprice', 'b_level', 'same']) AS name, unnest(range(6)) AS place FROM s WHERE several")
def columns_by_use(spark, d):
    """A time first, a constant last, of two correlated columns one ahead of the others and one behind."""
    k = F.col("o_orderkey") % 7
    df = read(spark, d, "orders").select(F.lit(1).alias("same"), "o_orderkey", k.alias("a_level"), (k * 3).alias("b_level"), "o_totalprice", "o_orderdate")
    return spark.createDataFrame([(c, i) for i, c in enumerate(model.order_columns(df).columns)], "name string, place long")


@query("SELECT round(max(o_totalprice) / min(o_totalprice), 4) AS spread, count(*) AS n FROM orders")
def user_stats(spark, d):
    """A user's statistic and one that depends on it, in the same aggregate; a broken one is an error row and stops nothing."""
    spread = st.stat("spread", types.is_numeric_not_bool)(lambda max, min: F.try_divide(max, min))  # noqa: A006
    broken = st.stat("broken")(lambda column: F.sum(F.col("no_such_column")))
    wide, errors = profile.profile_wide(read(spark, d, "orders").select("o_totalprice"), [*st.BASE, spread, broken])
    assert [e[1] for e in errors] == ["broken"]
    return wide.select(F.round("o_totalprice__spread", 4).alias("spread"), F.col("o_totalprice__length").alias("n"))


@query("SELECT 'o_orderkey' AS \"column\", 'least_number' AS stat, CAST(min(o_orderkey) AS DOUBLE) AS number FROM orders UNION ALL SELECT 'o_orderkey', 'doubled', 2.0 * min(o_orderkey) FROM orders UNION ALL SELECT 'o_orderpriority', 'failed', 2.0 UNION ALL SELECT 'o_orderpriority', 'length', count(*) FROM orders UNION ALL SELECT 'o_orderkey', 'length', count(*) FROM orders UNION ALL SELECT 'o_orderkey', 'failed', 0.0")
def failing_stats(spark, d):
    """Statistics that fail while they run, on text that is no number: each stands alone as an error, as does what needs it, and all others are there."""
    least = st.stat("least_number")(lambda column: F.min(column.cast("int")).cast("double"))
    doubled = st.stat("doubled")(lambda least_number: 2 * least_number)
    wide, errors = profile.profile_wide(read(spark, d, "orders").select("o_orderkey", "o_orderpriority"), [st.BASE[0], least, doubled])
    rows = [(c, "failed", float(sum(e[0] == c for e in errors))) for c in ("o_orderkey", "o_orderpriority")]
    return profile.to_long(wide, ["length", "least_number", "doubled"]).where("number is not null").select("column", "stat", "number").unionByName(spark.createDataFrame(rows, "column string, stat string, number double"))


@query("SELECT c_mktsegment, count(*) AS n FROM customer WHERE contains(c_name, '1') OR contains(c_mktsegment, '1') GROUP BY 1")
def op_chain(spark, d):
    """A chain of operations is one lazy plan."""
    ops = [Op("drop_column", ("c_acctbal",)), *chain.quick_ops({"search": ["1"]}), Op("group_by", ("c_mktsegment", {"c_custkey": "count"}))]
    return chain.run(read(spark, d, "customer"), ops)[0].select("c_mktsegment", F.col("c_custkey_count").alias("n"))


_CHANGED = "b AS (SELECT l_orderkey, l_partkey, l_quantity + CASE WHEN l_orderkey = (SELECT max(l_orderkey) FROM lineitem) THEN 1 ELSE 0 END AS l_quantity, nullif(l_returnflag, 'R') AS l_returnflag, l_shipdate FROM lineitem)"


@query(f"WITH {_CHANGED} " + _union([f"SELECT '{c}' AS \"column\", NOT EXISTS (SELECT {c} FROM lineitem EXCEPT ALL SELECT {c} FROM b) AS same FROM (SELECT 1)" for c in ("l_orderkey", "l_partkey", "l_quantity", "l_returnflag", "l_shipdate")]))
def column_fingerprints(spark, d):
    """Which columns of another version, whose rows are in another order, have the same content."""
    df = read(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_quantity", "l_returnflag", "l_shipdate")
    last = df.agg(F.max("l_orderkey")).first()[0]
    changed = df.repartition(7, "l_partkey").withColumns({"l_quantity": F.col("l_quantity") + F.when(F.col("l_orderkey") == last, 1.0).otherwise(0.0), "l_returnflag": F.nullif(F.col("l_returnflag"), F.lit("R"))})
    other = store.fingerprints(changed).withColumnRenamed("fingerprint", "other")
    return store.fingerprints(df).join(other, "column").select("column", (F.col("fingerprint") == F.col("other")).alias("same"))


@query("SELECT 'ok' AS kind, CAST(count(*) AS VARCHAR) AS said FROM orders UNION ALL SELECT 'err', 'no such thing'")
def post_processing(spark, d):
    """A user's table function, and one that fails: its message is the result."""

    def bad(df):
        raise ValueError("no such thing")

    df = read(spark, d, "orders")
    good = chain.process(df, lambda t: t.agg(F.count(F.lit(1)).cast("string").alias("said")))
    return good.select(F.lit("ok").alias("kind"), "said").unionByName(chain.process(df, bad).select(F.lit("err").alias("kind"), F.col("err").alias("said")))
