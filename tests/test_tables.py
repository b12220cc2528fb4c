"""Table operators on small literal tables."""

import datetime
import decimal
import itertools
import math
import random
import re
import statistics

import pytest
from pyspark.sql import functions as F

from lodestrata.functions import scalars as S
from lodestrata.functions import types
from lodestrata.operators import compare, duplicates, filters, group, histogram, model, paging, quantiles, selection, shape, spread, validate
from lodestrata.plans import autoclean, chain, files, profile, store
from lodestrata.plans import stats as st
from lodestrata.plans.chain import Op
from lodestrata.sources import avro, shared, tables


def one(spark, expression, *values):
    df = spark.createDataFrame([(v,) for v in values], "x " + ("string" if isinstance(values[0], str) or values[0] is None else "double"))
    return [r[0] for r in df.select(expression(F.col("x"))).collect()]


def column(df, name):
    return [r[name] for r in df.select(S.col(name)).collect()]


# cleaning: the outcomes that a user of the cleaners expects

DIRTY_INTS = ["3", "4", "a", "5", "5", "b9", None, " 9", "9-", "11", "867-5309", "-9", None]


def test_strip_int(spark):
    assert one(spark, S.strip_int, *DIRTY_INTS) == [3, 4, None, 5, 5, 9, None, 9, 9, 11, 8675309, -9, None]
    assert one(spark, S.digits_and_period, "-9", "1.5x", "x") == [9.0, 1.5, None]


def test_us_date(spark):
    got = one(spark, S.parse_us_date, "", "07/10/1982", "17/10/1982", "7/4/1776", "2/3/2020", None)
    assert [g and (g.year, g.month, g.day) for g in got] == [None, (1982, 7, 10), None, (1776, 7, 4), (2020, 2, 3), None]


def test_bool_words(spark):
    assert one(spark, S.parse_bool_word, "True", "yes", " On", "1", "False", "no", "OFF ", "0", "t", "", None) == [True] * 4 + [False] * 4 + [None] * 3


def test_numbers(spark):
    assert one(spark, S.parse_number, "1.5", "nan", " 2 ", "x", "1e3") == [1.5, None, 2.0, None, 1000.0]
    assert one(spark, lambda c: S.truncated(S.parse_number(c)), "1.9", "-1.9") == [1, -1]
    assert one(spark, S.round_half_even, 0.5, 1.5, 2.5) == [0.0, 2.0, 2.0]
    assert one(spark, S.int_digits, 12.7, -3.0, None) == [2, 2, 1]
    assert [S.narrowest_int(*b) for b in ((-1, 126), (-1, 127), (0, 254), (0, 255), (0, 65535), (-3, 2**31 - 1), (0, 2**32 - 1))] == ["tinyint", "smallint", "smallint", "int", "bigint", "bigint", "bigint"]


def test_labels(spark):
    def label(lo, hi):
        return spark.range(1).select(S.bucket_label(F.lit(float(lo)), F.lit(float(hi)))).first()[0]

    assert label(-100, -80) == "-100<>-80" and label(-0.5, 0.5) == "-0.5<>0.5" and label(7, 7) == "7–7" and label(300, 2200) == "0.3K–2.2K"


def test_auto_clean_keeps_originals(spark):
    df = spark.createDataFrame([(float(i), v) for i, v in enumerate(["1", "2", "3", "4", "5", "6", "7", "8", "nine", None])], "a double, b string")
    out = autoclean.auto_clean(df, "default")
    assert out.columns == ["a", "b", "b_orig"] and column(out, "b") == [1, 2, 3, 4, 5, 6, 7, 8, None, None]
    assert autoclean.auto_clean(df, "").columns == ["a", "b"]


def test_rule_scores():
    rules = autoclean.METHODS["aggressive"]
    zero = dict.fromkeys(autoclean.FRACTIONS, 0.0)
    assert autoclean.top_score(rules, zero | {"str_bool": 0.8}) == "str_bool"
    assert autoclean.top_score(rules, zero | {"str_bool": 0.8, "regular_int_parse": 0.95, "us_dates": 0.71}) == "us_date"
    assert autoclean.top_score(rules, zero) is None


def test_auto_type(spark):
    df = spark.createDataFrame([("1", "1.5", "2020-01-02", "yes", "x"), ("2", "2", "2021-05-06", "no", "y"), ("3", "z", "1/2/2003", "on", None)], "i string, f string, d string, b string, s string")
    assert autoclean.recommend_types(df) == {"i": "int", "f": "float", "d": "datetime", "b": "bool", "s": "string"}
    assert [f.dataType.simpleString() for f in autoclean.auto_type(df).schema] == ["bigint", "double", "timestamp", "boolean", "string"]


# values and shape

def test_shape(spark):
    df = spark.createDataFrame([("foo", 1, None), ("bar", None, None), (None, 3, None)], "`a.b` string, n int, gone string")
    assert shape.drop_null_columns(df).columns == ["a.b", "n"]
    assert column(shape.replace_value(df, "a.b", "foo", "baz"), "a.b") == ["baz", "bar", None]
    assert column(shape.fill_null(df, "n", 0), "n") == [1, 0, 3]
    hot = shape.one_hot(df, "a.b")
    assert hot.columns == ["n", "gone", "bar", "foo"] and column(hot, "foo") == [True, False, False]
    assert shape.promote_to_index(df, "n").columns == ["index", "a.b", "gone"]
    assert shape.safe_int(spark.createDataFrame([("1",), ("x",), ("300",)], "v string"), "v").schema["v"].dataType.simpleString() == "int"
    assert shape.safe_int(spark.createDataFrame([("1",), ("1.5",)], "v string"), "v").schema["v"].dataType.simpleString() == "double"
    codes = shape.make_category(df, "a.b")
    assert column(codes.orderBy("`a.b_code`"), "a.b_code") == [-1, 0, 1] and types.semantic_type(codes.schema["a.b"]) == "categorical"
    nested = spark.createDataFrame([([1, 2], bytearray(b"\x01"), {"k": 1})], "l array<int>, b binary, m map<string,int>")
    assert tuple(shape.nested_to_text(nested).first()) == ("[1,2]", "01", '{"k":1}')
    with pytest.raises(ValueError):
        shape.coerce(df, "n", "colour")


def test_filters(spark):
    df = spark.createDataFrame([("a.c", 1, None), (None, 2, "xa"), ("b", 3, "y")], "s string, n int, t string")
    assert column(filters.search(df, "a"), "n") == [1, 2] and column(filters.search(df, "a.", regex=True), "n") == [1]
    assert column(filters.search(df, "."), "n") == [1] and filters.search(df, "").count() == 3
    assert filters.search(df.select("n"), "a").count() == 0 and column(filters.search_column(df, "t", "a"), "n") == [2]
    assert column(filters.range_filter(df, "n", lower=1), "n") == [2, 3]
    numbers = spark.range(100).select(F.col("id").cast("double").alias("v"))
    assert sorted(column(filters.any_outliers(numbers), "v")) == [0.0, 99.0]
    assert filters.remove_outliers(numbers, "v", 10).count() == 80
    rare = spark.range(300).select(F.when(F.col("id") == 7, 1).alias("r"), "id")
    assert column(filters.rare_rows(rare), "id") == [7]
    odd = spark.createDataFrame([(math.nan,), (math.inf,), (-math.inf,), (1.0,)], "v double")
    assert column(filters.nullify_nonfinite(odd), "v") == [None, None, None, 1.0]


def test_groups(spark):
    df = spark.createDataFrame([("a", 10, 1), ("a", 20, 2), ("b", 30, 3), ("b", None, 4), (None, 9, 5)], "k string, v int, at int")
    got = {r["k"]: r for r in group.group_by(df, "k", {"v": ["mean", "count_null", "sum", "is_monotonic", "idxmax", "hasnans"], "at": "null"}, order_by=["at"]).collect()}
    assert set(got) == {"a", "b"} and got["a"]["v_mean"] == 15 and got["b"]["v_count_null"] == 1 and got["a"]["v_is_monotonic"] and got["a"]["v_idxmax"] == 2 and got["b"]["v_hasnans"]
    wide = group.group_by_transform(df, "k", {"v": ["mean", "count_null"]}).orderBy("at")
    assert column(wide, "v_mean") == [15.0, 15.0, 30.0, 30.0, None]
    assert group.group_by_sorted(df, "k", {"v": "sum"}).columns == ["k", "v(sum)"]
    with pytest.raises(ValueError):
        group.group_by(df, "k", {"v": "autocorr"})


def test_ranks_and_pages(spark):
    df = spark.createDataFrame([(3,), (1,), (1,), (None,), (7,)], "v int")
    assert sorted(column(paging.rank(df, "v", "min", "r"), "r"), key=str) == [1.0, 1.0, 3.0, 4.0, None]
    assert sorted(column(paging.rank(df, "v", "dense", "r"), "r"), key=str) == [1.0, 1.0, 2.0, 3.0, None]
    assert sorted(column(paging.rank(df, "v", "average"), "v"), key=str) == [1.5, 1.5, 3.0, 4.0, None]
    with pytest.raises(ValueError):
        paging.rank(df, "v", "min", "v")
    assert paging.clamp_window("x", 10**9, 50_000) == (0, 10_000) and paging.clamp_window(-5, 7, 5) == (0, 5) and paging.clamp_window(9, 2, 5) == (5, 5)
    assert column(paging.page(df, 0, 5, "v", ascending=False), "v") == [7, 3, 1, 1, None]
    tagged = paging.tag_rows(spark.range(1000).repartition(7), ["id"])
    assert tagged.where("rowid <> id").isEmpty() and column(paging.rows_between(tagged, 5, 8), "id") == [5, 6, 7]
    with pytest.raises(ValueError):
        paging.tag_rows(tagged, ["id"])


def test_deep_pages_and_samples(spark, monkeypatch):
    df = spark.range(1000).select(((F.col("id") * 7) % 1000).alias("v"), F.when(F.col("id") % 10 != 0, F.col("id") % 5).alias("k")).repartition(6)
    for options in ({"sort": "v"}, {"sort": "k", "ascending": False}, {"order_by": ["v"]}):
        plain = [tuple(r) for r in paging.page(df, 300, 340, **options).collect()]
        monkeypatch.setattr(paging, "MOST_HELD_ROWS", 10)
        deep = paging.page(df, 300, 340, **options)
        assert sorted(tuple(r) for r in deep.collect()) == sorted(plain, key=lambda x: x[0]) and len(plain) == 40
        assert "TakeOrdered" not in deep._jdf.queryExecution().executedPlan().toString()
        monkeypatch.undo()
    assert column(paging.first_row(df, ["v"]), "v") == [0] and paging.display_sample(df, 7).count() == 7
    assert paging.sample_rows(df, 2000).count() == 1000 and 50 < (few := paging.sample_rows(df, 100).count()) < 160 and paging.sample_rows(df, 100).count() == few
    assert paging.sample_cells(df, most_cells=1999, rows=100).count() < 160 and paging.sample_cells(df, most_cells=2000, rows=100).count() == 1000
    spark.sparkContext.setJobGroup("counted", "")
    assert paging.row_count(df) == 1000 == paging.row_count(df) and not spark.sparkContext.statusTracker().getJobIdsForGroup("counted")
    spark.sparkContext.setJobGroup("", "")
    tagged = paging.tag_rows(df, ["v"])
    assert column(paging.sort_permutation(tagged, "v", False).limit(3), "rowid") == [999, 998, 997]
    assert duplicates.distinct_tuples(df, ["k"]) == 6


def test_kept_tables_are_released(spark):
    from pathlib import Path

    at = shared.mark()
    tagged = paging.tag_rows(spark.range(100), ["id"])
    assert tagged.count() == 100 and not [x for x in spark.sparkContext._jsc.getPersistentRDDs()]
    paths = [Path(p.removeprefix("file://")) for _, p in shared._kept[at:]]
    shared.release(at)
    assert paths and not any(p.exists() for p in paths)


def test_first_places_of_the_largest_value(spark):
    df = spark.createDataFrame([("a", 1, "x", 5, None), ("a", 2, "z", -(1 << 63), True), ("a", 3, "z", 5, False), ("b", 4, None, None, None)], "k string, at int, s string, n long, b boolean").withColumn("d", F.date_add(F.lit("2020-01-01"), F.col("at") % 2))
    got = {r["k"]: r for r in group.group_by(df, "k", {c: ["idxmax", "idxmin"] for c in "snbd"} | {"n": ["idxmax", "idxmin", "median"]}, order_by=["at"]).collect()}
    assert [got["a"][f"{c}_idxmax"] for c in "snbd"] == [2, 1, 2, 1] and [got["a"][f"{c}_idxmin"] for c in "snbd"] == [1, 2, 3, 2] and got["a"]["n_median"] == 5 and got["b"]["n_median"] is None
    assert got["b"]["s_idxmax"] is None and group.whole_table(df, {"s": "idxmax"}, ["at"]).first()[0] == 2


def test_duplicates(spark):
    df = spark.createDataFrame([(1, "x", 1), (1, "y", 2), (2, "z", 3)], "k int, v string, at int")
    assert sorted(column(duplicates.distinct_on(df, "k", ["at"]), "v")) == ["x", "z"]
    assert sorted(column(duplicates.distinct_on(df, "k", ["at"], "last"), "v")) == ["y", "z"]
    assert column(duplicates.distinct_on(df, "k", ["at"], "none"), "v") == ["z"] and duplicates.drop_duplicates(df, "k").columns == ["k"]


# profiles and histograms

def test_profile(spark):
    df = spark.createDataFrame([(1, 1.5, "a", True), (2, None, "b", False), (3, math.nan, "", None), (4, 2.5, None, True)], "i int, f double, s string, b boolean")
    got = {(r["column"], r["stat"]): r["number"] if r["number"] is not None else r["text"] for r in profile.profile(df).collect()}
    assert got["i", "length"] == 4 and got["i", "mean"] == 2.5 and got["i", "median"] == 2.5 and got["f", "null_count"] == 2 and got["f", "max"] == 2.5
    assert got["s", "empty_count"] == 1 and ("s", "min") not in got and got["b", "_type"] == "boolean" and got["i", "distinct_count"] == 4 and got["i", "mode"] == 1 and got["b", "most_freq"] == "true"
    none = {(r["column"], r["stat"]): r["number"] for r in profile.profile(df.limit(0)).collect()}
    assert none["i", "length"] == 0 and none["i", "mean"] is None and none["i", "nan_per"] == 0
    assert {r["stat"] for r in profile.to_long(profile.profile_wide(df, skip=("i", "f", "s", "b"))[0]).collect()} <= {"length"}


def test_profile_jobs_do_not_grow_with_columns(spark):
    def jobs(n):
        df = spark.range(50).select(*[F.col("id").alias(f"c{i}") for i in range(n)])
        spark.sparkContext.setJobGroup(f"g{n}", "")
        profile.profile(df).collect()
        done = len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"g{n}"))
        spark.sparkContext.setJobGroup("", "")
        return done

    assert jobs(2) == jobs(8)


def test_stats_order_and_errors(spark):
    cv = st.stat("cv")(lambda mean, std: F.try_divide(std, mean))
    with pytest.raises(ValueError):
        st.in_order([cv])
    a, b = st.stat("a")(lambda b: b), st.stat("b")(lambda a: a)
    with pytest.raises(ValueError):
        st.in_order([a, b])
    bad, after, safe = st.stat("bad")(lambda column: F.sum(F.col("nope"))), st.stat("after")(lambda bad: bad), st.stat("safe", default=7)(lambda column: F.sum(F.col("nope")))
    wide, errors = profile.profile_wide(spark.range(3), [*st.BASE, bad, after, safe])
    row = wide.first()
    assert {e[1] for e in errors} == {"bad", "after"} and row["id__safe"] == 7 and row["id__max"] == 2
    assert profile.try_stat(spark.range(5), "id", cv) == pytest.approx(math.sqrt(2.5) / 2)


def test_user_folder(tmp_path):
    (tmp_path / "good.py").write_text("def compute(column):\n    return column\n")
    (tmp_path / "_hidden.py").write_text("raise RuntimeError")
    (tmp_path / "broken.py").write_text("raise RuntimeError")
    assert [s.name for s in profile.user_stats(str(tmp_path))] == ["good"]


def test_histograms(spark):
    meat = spark.createDataFrame([(1,)] * 400 + [(v,) for v in (10, 20, 30, 40, 50)], "v int")
    assert histogram.trimmed(meat).count() in (0, 10)
    close = spark.createDataFrame([(9007199254740993 + i,) for i in range(20)], "v long")
    assert {r["name"] for r in histogram.bars(close).collect()}
    flat = histogram.full_range(spark.range(100).select(F.col("id").alias("v"))).orderBy("bin")
    assert column(flat, "n") == [10] * 10 and column(flat, "percent") == [10.0] * 10
    assert histogram.full_range(spark.createDataFrame([(1,), (1,)], "v int")).isEmpty()
    bars = {r["name"]: r["percent"] for r in histogram.categorical(spark.createDataFrame([("a",)] * 6 + [("b",), ("c",), (None,), (None,)], "s string"), most=1).collect()}
    assert bars == {"a": 60.0, "unique": 20.0, "NA": 20.0}


def test_labels_of_histograms(spark):
    def number(value, step, ref):
        return spark.range(1).select(S.number_label(F.lit(float(value)), F.lit(float(step)), F.lit(float(ref)))).first()[0]

    assert number(1234567, 100, 1234567) == "1.23M" and number(1e-15, 1, 5) == "0" and number(-0.25, 0.5, 1) == "-0.25" and number(1200, 0, 1200) == "1.2K" and number(7.4, 0, 7) == "7"
    tail = lambda lo, hi, step: spark.range(1).select(S.tail_label(F.lit(float(lo)), F.lit(float(hi)), F.lit(float(step)))).first()[0]
    assert tail(1.2, 1.4, 0.2) == "1.2–1.4" and tail(1.8, 50_000, 0.2) == "1.8–50K" and tail(-3, 2, 1) == "-3<>2"


def test_column_quantiles(spark):
    """Against sorted values, with brackets that must be narrowed, misses of the sketch, ties, nulls and columns without values."""
    r = random.Random(3)
    kinds = {"even": lambda i: float(i), "ties": lambda i: float(r.choice([1, 2, 2, 2, 3])), "wide": lambda i: r.gauss(0, 10 ** r.randint(0, 9)), "some": lambda i: None if i % 3 else r.random(), "none": lambda i: None}
    table = [tuple(f(i) for f in kinds.values()) for i in range(3001)]
    df = spark.createDataFrame(table, ", ".join(f"{k} double" for k in kinds)).repartition(5)
    asked = [0.0, 0.01, 0.25, 0.5, 0.9, 1.0]
    for accuracy, most, asked in ((quantiles.ACCURACY, quantiles.INSIDE, asked), (30, 100, asked[2:4]), (30, 5, asked[1:3])):
        found = quantiles.column_quantiles(df, [F.col(k) for k in kinds], asked, accuracy, most)
        for i, got in enumerate(found):
            values = sorted(t[i] for t in table if t[i] is not None)
            for p, q in zip(asked, got, strict=True):
                at = p * (len(values) - 1)
                assert q is None if not values else math.isclose(q, values[int(at)] + (values[min(int(at) + 1, len(values) - 1)] - values[int(at)]) * (at - int(at)), rel_tol=1e-12, abs_tol=1e-12)
    assert quantiles.column_quantiles(df.limit(0), [F.col("even")], [0.5]) == [[None]]


def test_profile_keeps_large_numbers_apart(spark):
    big = 1 << 53
    df = spark.createDataFrame([(big + i,) for i in range(4)] + [(big + 1,)], "k long").withColumn("d", (F.col("k").cast("decimal(30,2)") * 1000 + F.lit(decimal.Decimal("0.25"))).cast("decimal(30,2)"))
    got = {(r["column"], r["stat"]): r for r in profile.profile(df).collect()}
    for c in ("k", "d"):
        assert got[c, "distinct_count"]["number"] == 4 and got[c, "unique_count"]["number"] == 3
    assert (got["k", "min"]["text"], got["k", "max"]["text"], got["k", "mode"]["text"]) == (str(big), str(big + 3), str(big + 1)) and got["d", "max"]["text"] == f"{(big + 3) * 1000}.25"
    assert sorted(r["exact"] for r in profile.value_counts(df, ["k"], numeric=True).collect()) == [str(big + i) for i in range(4)]


def test_live_profile(spark):
    live = profile.Profiler(spark.range(10).select(F.col("id").cast("double").alias("v")))
    assert not live.add(st.stat("span", types.is_numeric_not_bool)(lambda max, min: max - min)) and live.wide()[0].first()["v__span"] == 9  # noqa: A006
    assert live.add(st.stat("span", types.is_numeric_not_bool)(lambda max: max * 2)) and live.wide()[0].first()["v__span"] == 18  # noqa: A006
    before = list(live.stats)
    with pytest.raises(ValueError):
        live.add(st.stat("open")(lambda no_such_stat: no_such_stat))
    with pytest.raises(ValueError):
        live.remove("max")
    assert live.stats == before and live.explain("span")["needs"] == ["max"] and live.try_on("v", st.stat("twice")(lambda mean: mean * 2)) == 9
    live.remove("span")
    assert "v__span" not in live.wide()[0].columns


def test_query_stats(spark):
    df = spark.createDataFrame([(1, None), (5, None)], "a int, b int")
    seen = []
    second = st.query_stat("second", types.is_numeric_not_bool)(lambda t, columns: seen.append(columns) or {"a": 2.5})
    wide, errors = profile.profile_wide(df, [*st.BASE, second, st.stat("more", types.is_numeric_not_bool)(lambda second: second + 1), st.query_stat("bad")(lambda t, c: 1 / 0), st.stat("worse")(lambda bad: bad)])
    row = wide.first()
    assert seen == [["a", "b"]] and row["a__more"] == 3.5 and row["b__second"] is None and {e[1] for e in errors} == {"bad", "worse"}


def test_self_check(spark):
    assert profile.self_check(spark) == [] and profile.self_check(spark, st.BASE + st.QUANTILES + st.EXTRA) == []
    assert profile.profile(profile.awkward(spark)).where("text like 'error:%'").isEmpty()
    assert {f[1] for f in profile.self_check(spark, [*st.BASE, st.stat("fragile")(lambda column: F.sum(F.col("nope")))])} == {"fragile"}


def test_user_table_functions(spark, tmp_path):
    (tmp_path / "few.py").write_text("def process(df):\n    return df.limit(2)\n")
    (tmp_path / "fails.py").write_text("def process(df):\n    raise RuntimeError('broken on purpose')\n")
    (tmp_path / "other.py").write_text("def compute(column):\n    return column\n")
    found = profile.user_tables(str(tmp_path))
    assert sorted(found) == ["fails", "few"] and chain.process(spark.range(5), found["few"]).count() == 2
    assert [tuple(r) for r in chain.process(spark.range(5), found["fails"]).collect()] == [("broken on purpose",)] and chain.process(spark.range(5), lambda df: 3).columns == ["err"]
    with pytest.raises(RuntimeError):
        chain.process(spark.range(5), found["fails"], strict=True)


def test_pushed_down_histograms(spark):
    df = spark.range(100).select(F.col("id").cast("double").alias("v"), (F.col("id") % 3).alias("few"), F.concat(F.lit("t"), F.col("id") % 2).alias("s"), F.lit(None).cast("double").alias("none"))
    assert [b["population"] for b in histogram.pushed_down(df, "v")] == [10.0] * 10 and histogram.pushed_down(df, "v")[0]["name"] == "0–9.9"
    assert {b["name"] for b in histogram.pushed_down(df, "few")} == {"0", "1", "2"} and len(histogram.pushed_down(df, "s")) == 2
    assert histogram.pushed_down(df, "none") == [] and histogram.pushed_down(df, "no_such_column") == []


# comparison

def test_keys_with_nulls_and_probes(spark):
    df = spark.createDataFrame([(1, None, "a"), (2, 1, "a"), (None, 1, "b"), (None, 2, "b")], "x int, y int, z string")
    found = {tuple(r["keys"]): (r["distinct"], r["largest"]) for r in compare.measure_keys(df, [("x",), ("z",), ("x", "y"), ("x", "y", "z")]).collect()}
    assert found == {("x",): (2, 2), ("z",): (2, 2), ("x", "y"): (4, 1), ("x", "y", "z"): (4, 1)}
    assert compare.rank_keys(df) == {"keys": ["x", "y"], "uniqueness": 1.0, "max_group": 1, "n": 4} and compare.rank_keys(df, max_width=1) is None
    assert compare.sketch_keys(df, [("x",), ("y", "z")]) == {("x",): 2, ("y", "z"): 4}
    same = spark.range(50).select(F.col("id").alias("k"), F.col("id").alias("j"))
    assert compare.detect_key(same) == ["k"]
    assert compare.probe(same, same.select(F.lit("x").alias("other")))["reason"] == "no shared columns" and compare.probe(same, same)["keys"] == ["k"]
    assert tuple(compare.column_summary(same, same.select("k", F.lit(1).alias("new"))).first()) == (1, 1, 1)


def test_key_search_jobs_do_not_grow_with_keys(spark):
    def jobs(n):
        df = spark.range(200).select(*[(F.col("id") % (3 + i)).alias(f"c{i}") for i in range(n)])
        spark.sparkContext.setJobGroup(f"keys{n}", "")
        assert compare.rank_keys(df, max_width=2) is None
        done = len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"keys{n}"))
        spark.sparkContext.setJobGroup("", "")
        return done

    assert jobs(4) == jobs(9)


def jobs_of(spark, run):
    """(what run() returns, how many jobs it took)."""
    group = f"count-{id(run)}"
    spark.sparkContext.setJobGroup(group, group)
    try:
        out = run()
        return out, len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))
    finally:
        spark.sparkContext._jsc.clearJobGroup()


def test_keys_of_a_hundred_columns(spark):
    # 2,000 rows and middling columns, none of which is a key or half of one
    r = random.Random(8)
    rest = [f"(id % 40) * {1 + i % 7} % {31 + i} as c{i}" for i in range(97)]
    df = spark.range(2000).selectExpr("id % 10 as k1", "int(id / 10) % 20 as k2", "int(id / 200) as k3", *rest)
    found, jobs = jobs_of(spark, lambda: compare.rank_keys(df, max_width=3))
    assert found == {"keys": ["k1", "k2", "k3"], "uniqueness": 1.0, "max_group": 1, "n": 2000}
    assert jobs < 20
    again = spark.createDataFrame([(i % 20, r.random()) for i in range(40)] * 2, "a int, b double")
    assert compare.rank_keys(again) is None  # rows repeat: no set of columns is a key
    assert compare.rank_keys(again, threshold=0.5)["keys"] == ["b"]


def test_candidate_sets_leave_out_what_is_ruled_out():
    masks = [0b00111, 0b01010, 0b11000]
    for width in (1, 2, 3, 4):
        want = [k for k in itertools.combinations(range(5), width) if not any(sum(1 << i for i in k) & ~m == 0 for m in masks)]
        assert list(compare.candidate_sets(5, width, masks, lambda k: True)) == want
    assert list(compare.candidate_sets(3, 2, [], lambda k: 1 in k)) == [(0, 1), (1, 2)]


def test_key_of_the_second_table(spark):
    a, b = spark.range(40).selectExpr("int(id / 2) as k"), spark.range(40).selectExpr("int(id) as k")
    assert compare.probe(a, b) == {"can_diff": True, "keys": ["k"], "reason": None}
    assert compare.probe(b, a)["can_diff"] and compare.probe(a, a)["reason"] == "no key in either table"
    assert compare.probe(spark.range(40).selectExpr("1 as k"), b, max_group=10)["reason"] == "the key's groups are too large in the first table"


def test_statistics_that_fail_while_running(spark):
    df = spark.createDataFrame([("x", 1), ("7", 0), (None, 2)], "t string, n int").repartition(2)
    number = st.stat("number")(lambda column: F.max(column.cast("int")))
    twice = st.stat("twice")(lambda number: 2 * number)
    safe = st.stat("safe", default=-1)(lambda column: F.max(column.cast("int")))
    inverse = st.stat("inverse")(lambda length: F.lit(1) / (length - 3))
    wide, errors = profile.profile_wide(df, [*st.BASE, number, twice, safe, inverse])
    assert sorted((c, s) for c, s, _ in errors) == [("n", "inverse"), ("t", "inverse"), ("t", "number"), ("t", "twice")]
    assert "CAST_INVALID_INPUT" in dict(((c, s), m) for c, s, m in errors)["t", "number"] and dict(((c, s), m) for c, s, m in errors)["t", "twice"] == "what it needs failed"
    row = wide.first()
    assert (row["t__length"], row["t__null_count"], row["n__number"], row["n__twice"], row["t__safe"], row["n__safe"], row["n__mean"]) == (3, 1, 2, 4, -1, 2, 1.0) and "t__number" not in row
    long = profile.profile(df, [*st.BASE, number])
    assert [r.text[:7] for r in long.where("stat = 'number' and column = 't'").collect()] == ["error: "]
    # failures are found by halves
    many = [st.stat(f"s{i}")(lambda column, i=i: F.max(F.when(F.lit(i != 5), F.length(column)).otherwise(column.cast("int")))) for i in range(32)]
    (_, errors), jobs = jobs_of(spark, lambda: profile.profile_wide(df.select("t"), [st.BASE[0], *many]))
    assert [e[:2] for e in errors] == [("t", "s5")] and jobs <= 2 * 2 * 7
    # what fails for the whole table is no statistic's error
    broken = df.select(F.raise_error(F.lit("unreadable")).cast("string").alias("t"))
    with pytest.raises(Exception, match="unreadable"):
        profile.profile_wide(broken.where("t is not null"), [st.BASE[0], number])


def test_keys(spark):
    unique = spark.range(2000).select(F.concat(F.lit("r"), "id").alias("ride"), (F.col("id") % 2).alias("kind"))
    assert compare.detect_key(unique) == ["ride"]
    pairs = spark.range(500).select((F.col("id") % 25).alias("station"), (F.floor(F.col("id") / 25)).alias("day"), F.lit(1).alias("reading"))
    assert compare.detect_key(pairs) == ["station", "day"]
    near = spark.range(1000).select(F.greatest(F.col("id"), F.lit(10)).alias("k"), (F.col("id") % 3).alias("v"))
    assert compare.detect_key(near) is None and compare.detect_key(near, threshold=0.98) == ["k"] and compare.detect_key(near, threshold=0.98, max_group=5, columns=["k"]) is None
    assert compare.rank_keys(near.limit(0)) is None


def test_versions(spark):
    a = spark.createDataFrame([(1, "x", 1.0), (2, "y", None), (3, "z", 3.0)], "id int, s string, v double")
    b = spark.createDataFrame([(2, "y", None), (3, "w", 3.0), (4, "q", 4.0)], "id int, s string, v double")
    joined = {r["id"]: r for r in compare.join_versions(a, b, ["id"]).collect()}
    assert [joined[i]["membership"] for i in (1, 2, 3, 4)] == [1, 3, 3, 2] and joined[2]["s|eq"] == 7 and joined[3]["s|eq"] == 3 and joined[2]["v|eq"] == 3
    assert {r["column"]: r["differences"] for r in compare.difference_counts(a, b, ["id"]).collect()} == {"id": None, "s": 1, "v": 1}
    assert tuple(compare.key_totals(a, b, ["id"]).first()) == (1, 1, 2)
    assert tuple(compare.row_summary(a, b, ["id"]).first()) == (False, 2, 1, 1, 1, 1)
    assert compare.key_diff(a.select("s"), b.select("s").withColumnRenamed("s", "t")) is None
    with pytest.raises(ValueError):
        compare.join_versions(a.withColumnRenamed("s", "s|eq"), b, ["id"])
    with pytest.raises(ValueError):
        compare.join_versions(a.unionByName(a), b, ["id"])
    with pytest.raises(ValueError):
        compare.key_totals(a, b.drop("id"), ["id"])


# validation, models, chains, store, sources

def test_validation(spark):
    df = spark.createDataFrame([(1, "a", 5), (2, "zz", 50), (3, None, None)], "id int, s string, n int")
    checks = [validate.isin("s", ["a"]), validate.str_length("s", 1, 1), validate.less_than("n", 10), validate.not_null("s")]
    assert {(r["id"], r["column"]) for r in validate.failure_cases(df, checks, ["id"]).collect()} == {(2, "s"), (2, "n"), (3, "s")}
    out = {r["id"]: r for r in validate.with_errors(df, checks).collect()}
    assert [out[i]["s_error"] for i in (1, 2, 3)] == [0, 3, 3] and out[2]["s_reason"] == "isin(['a'])|str_length(1, 1)"
    assert [tuple(r) for r in validate.schema_failures(df, {"id": "int", "n": "string", "x": "int"}).orderBy("column").collect()] == [("n", "dtype('string')", "int"), ("x", "column_in_dataframe", None)]


def test_regression(spark):
    df = spark.createDataFrame([(float(x), float(z), 3.0 + 2 * x - z) for x in range(6) for z in range(4)] + [(None, 1.0, 2.0)], "x double, z double, y double")
    out = model.linear_regression(df, "y", ["x", "z"])
    assert out.columns[:3] == ["y", "y_predicted", "y_pred_err"] and out.where("abs(y_pred_err) > 1e-9").isEmpty() and out.where("x is null and y_predicted is null").count() == 1
    assert model.linear_regression(df.limit(0), "y", ["x"]).count() == 0


def test_column_order(spark):
    df = spark.range(60).select(F.lit(1).alias("same"), (F.col("id") % 5).alias("a"), (F.col("id") % 5 * 3).alias("b"), F.timestamp_seconds("id").alias("t"))
    assert model.order_columns(df).columns == ["t", "a", "b", "same"]
    assert model.correlation_groups([("a", "b"), ("b", "c"), ("x", "y")]) == [["a", "b", "c"], ["x", "y"]]


def test_chain(spark):
    df = spark.createDataFrame([("1", "x"), ("2", "y")], "n string, s string")
    auto, user = Op("safe_int", ("n",)), Op("drop_column", ("s",))
    merged = chain.merge([Op("strip_int_parse", ("n",), {"auto": True}), user], [auto])
    assert [o.name for o in merged] == ["safe_int", "drop_column"] and chain.run(df, merged)[0].columns == ["n"]
    assert [o.name for o in chain.merge([Op("str_bool", ("n",))], [auto])] == ["str_bool"]
    assert chain.quick_ops({"search": [""]}) == [] and chain.quick_ops({"search": ["x"]})[0].args == ("x",)
    with pytest.raises(ValueError):
        chain.quick_ops({"search": []})
    chain.register("noted")(lambda d, c: (d, {c: {"seen": True}}))
    assert chain.run(df, [Op("noted", ("n",))])[1] == {"n": {"seen": True}}


def test_store(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "i int, s string")
    assert sorted(store.fingerprints(df).collect()) == sorted(store.fingerprints(df.orderBy(F.desc("i"))).collect())
    kept = store.ProfileStore(spark, str(tmp_path / "store"))
    first = sorted(map(tuple, kept.profile(df).collect()), key=repr)
    assert kept.runs.misses == 2 and sorted(map(tuple, kept.profile(df).collect()), key=repr) == first and kept.runs.hits == 2
    kept.profile(df.withColumn("s", F.lit("new")))
    assert (kept.runs.hits, kept.runs.misses) == (3, 3)
    key = store.ProfileStore.key("t", [Op("search", ("x",))])
    assert key != store.ProfileStore.key("t", [Op("search", ("y",))])
    assert kept.cached(key, lambda: df).count() == 2 and kept.cached(key, lambda: 1 / 0).count() == 2
    assert kept.runs.bytes_written > 0 and kept.runs.bytes_read > 0 and kept.runs.unreadable == 0
    # a data file that can't be read is found when the result is asked for, and the result is made again
    for f in (tmp_path / "store" / "results" / key).glob("*.parquet"):
        f.write_bytes(b"no parquet at all")
    for f in (tmp_path / "store" / "results" / key).glob(".*.crc"):
        f.unlink()
    assert kept.cached(key, lambda: df).count() == 2 and kept.runs.unreadable == 1 and kept.cached(key, lambda: 1 / 0).count() == 2
    assert not list((tmp_path / "store" / "aside").iterdir())
    (tmp_path / "blocked").write_text("a file where a folder should be")
    blocked = store.ProfileStore(spark, str(tmp_path / "blocked"))
    assert blocked.cached(key, lambda: df).count() == 2 and blocked.runs.write_errors == 1
    df.write.parquet(str(tmp_path / "t.parquet"))
    t = spark.read.parquet(str(tmp_path / "t.parquet"))
    assert not kept.files_unchanged(t)
    kept.remember_files(t)
    assert kept.files_unchanged(t)
    rows_ = kept.size()
    # a replacement that ended between its two renames
    (tmp_path / "store" / "columns").rename(tmp_path / "store" / "columns-before")
    assert kept.size() == rows_ and kept.drop_older(1) == rows_ > 0 and kept.bytes() > 0
    kept.clear()
    assert kept.size() == 0


def test_sources(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "i int, s string")
    df.coalesce(1).write.parquet(str(tmp_path / "t.parq"))
    (tmp_path / "t.csv").write_text("i,s\n1,a\n2,b\n")
    (tmp_path / "t.tsv").write_text("i\ts\n1\ta\n2\tb\n")
    (tmp_path / "t.json").write_text('[{"i": 1, "s": "a"}, {"i": 2, "s": "b"}]')
    (tmp_path / "t.jsonl").write_text('{"i": 1, "s": "a"}\n{"i": 2, "s": "b"}\n')
    (tmp_path / "plain").write_text("i,s\n1,a\n2,b\n")
    for name in ("t.parq", "t.csv", "t.tsv", "t.json", "t.jsonl"):
        assert sorted(map(tuple, tables.read_table(spark, str(tmp_path / name)).collect())) == [(1, "a"), (2, "b")]
    assert tables.read_table(spark, str(tmp_path / "plain")).count() == 2
    with pytest.raises(FileNotFoundError):
        tables.read_table(spark, str(tmp_path / "none.csv"))
    with pytest.raises(ValueError):
        tables.check_columns(df.select("i", F.col("s").alias("i")))
    assert [tables.short_name(i) for i in (0, 25, 26, 27)] == ["a", "z", "ba", "bb"]
    tables.write_page(df, str(tmp_path / "page"), 1, 2, "i", False)
    assert [tuple(r) for r in spark.read.parquet(str(tmp_path / "page")).collect()] == [(1, 1, "a")]
    tables.write_csv(df, str(tmp_path / "out.csv"))
    assert tables.read_table(spark, str(tmp_path / "out.csv")).count() == 2
    wide, _ = profile.profile_wide(df)
    tables.write_profile(wide, str(tmp_path / "wide"))
    assert spark.read.parquet(str(tmp_path / "wide")).count() == 1


def test_types(spark):
    df = spark.createDataFrame([], "b boolean, i bigint, d decimal(10,2), t timestamp, s string, a array<int>, x binary, v interval day to second")
    assert [types.semantic_type(f) for f in df.schema] == ["boolean", "integer", "decimal", "datetime", "string", "obj", "binary", "duration"]
    assert types.columns_of(df, types.any_of(types.is_string, types.is_boolean)) == ["b", "s"] and "i" not in types.columns_of(df, types.not_(types.is_numeric))
    assert types.type_table(df).count() == 8


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_ordered_aggregates_of_a_hot_group_are_not_one_task(spark):
    r = random.Random(5)
    table = [("hot" if r.random() < 0.9 else None if r.random() < 0.1 else "cold", at, None if r.random() < 0.05 else float(at if at < 900 else r.randint(0, 900))) for at in range(1000)] + [("rising", at, float(at)) for at in range(300)]
    df = spark.createDataFrame(table, "k string, at long, v double").repartition(5)
    names = ["autocorr", "is_monotonic_increasing", "mad"]
    for key in ("k", None):
        out = group.group_by(df, "k", {"v": names}, order_by=["at"]) if key else group.whole_table(df.where("k = 'hot'"), {"v": names}, order_by=["at"])
        got = {(g["k"] if key else "hot"): g for g in out.collect()}
        assert set(got) == ({"hot", "cold", "rising"} if key else {"hot"})
        for k, g in got.items():
            v = [x for kk, _, x in sorted((t for t in table if t[0] == k), key=lambda t: t[1])]
            both = [(a, b) for a, b in zip(v, v[1:]) if a is not None and b is not None]
            there = [x for x in v if x is not None]
            mean = sum(there) / len(there)
            assert math.isclose(g["v_autocorr"], statistics.correlation([a for a, _ in both], [b for _, b in both]), abs_tol=1e-9)
            assert math.isclose(g["v_mad"], sum(abs(x - mean) for x in there) / len(there), rel_tol=1e-9)
            assert g["v_is_monotonic_increasing"] == (len(there) == len(v) and all(a <= b for a, b in both))
        plan = out._jdf.queryExecution().optimizedPlan().toString()
        assert not re.search(r"windowspecdefinition\((k#\d+, )?(at#|specified)", plan)  # no window over all rows of a key, or of the table


# samples and files

def test_samples_have_their_size(spark):
    df = spark.range(5000).selectExpr("id % 900 as k", "array(id % 3) as a", "if(id % 2 = 0, null, 'x') as t", "1 as __hash").repartition(3)
    one = paging.sample_rows(df, 321, seed=5)
    assert one.count() == 321 and one.columns == df.columns
    key = lambda rows: sorted(map(str, rows))
    assert key(one.collect()) == key(paging.sample_rows(df.repartition(7, "k"), 321, seed=5).collect()) != key(paging.sample_rows(df, 321, seed=6).collect())
    assert paging.sample_rows(df, 5000).count() == 5000 and paging.sample_rows(df, 0).count() == 0
    same = spark.range(1000).selectExpr("1 as x")
    assert paging.sample_rows(same, 17).count() == 17
    values = [-(1 << 63), -5, -5, 0, 3, (1 << 63) - 1]
    longs = spark.createDataFrame([(v,) for v in values], "v long")
    for k in range(1, 7):
        at, m = selection.kth_least(longs, "v", k)
        assert at == sorted(values)[k - 1] and m == k - sum(v < at for v in values)
    assert selection.kth_least(longs, "v", 7) is None


@pytest.mark.parametrize("codec", ["null", "deflate", "zstandard"])
def test_avro_round_trip(spark, tmp_path, codec):
    df = spark.sql("""SELECT id, cast(id % 100 AS tinyint) AS tiny, cast(id AS smallint) AS small, cast(id AS int) AS i, cast(id / 3 AS float) AS f, id / 7 AS d, id % 2 = 0 AS b,
      if(id % 5 = 0, NULL, concat('ünï', id)) AS t, encode(cast(id AS string), 'utf-8') AS bin, cast(id * -1.25 AS decimal(20, 3)) AS dec, date_add(date'1969-12-20', cast(id AS int)) AS day,
      timestamp_micros(id * 1000003 - 5000000) AS at, cast(timestamp_micros(id * 77) AS timestamp_ntz) AS here, if(id % 4 = 0, NULL, array(id, NULL, -id)) AS arr, map('a', id, concat('k', id), NULL) AS m,
      named_struct('x', id, 'y', named_struct('z', if(id % 3 = 0, NULL, 'deep'))) AS s FROM range(3000)""").repartition(2)
    path = str(tmp_path / "t.avro")
    avro.write_avro(df, path, codec=codec, block_rows=100)
    names = [f.name for f in df.schema if f.name != "m"]
    whole = tables.read_table(spark, path)
    parts = avro.read_avro(spark, path, partition_bytes=3000)
    assert [f.name for f in whole.schema] == df.columns and parts.rdd.getNumPartitions() > 20
    for back in (whole, parts):
        assert back.select(*names).exceptAll(df.select(*names)).count() == 0 and back.count() == 3000
        assert back.selectExpr("sum(m['a'])", "count(m[concat('k', id)])", "sum(size(m))").first() == df.selectExpr("sum(m['a'])", "count(m[concat('k', id)])", "sum(size(m))").first()
    avro.write_avro(df.limit(5), path, mode="overwrite")
    assert avro.read_avro(spark, path).count() == 5
    avro.write_avro(df.where("id < 0"), str(tmp_path / "none.avro"))
    assert tables.read_table(spark, str(tmp_path / "none.avro")).count() == 0
    with pytest.raises(FileNotFoundError):
        tables.read_table(spark, str(tmp_path / "missing.avro"))


def test_avro_files_that_are_cut_off(spark, tmp_path):
    path = tmp_path / "t.avro"
    avro.write_avro(spark.range(1000).repartition(1), str(path), block_rows=50)
    file = next(path.glob("*.avro"))
    data = file.read_bytes()
    (tmp_path / "cut.avro").write_bytes(data[:-30])
    (tmp_path / "other.avro").write_bytes(b"nothing of the kind")
    with pytest.raises(Exception, match="cut off"):
        avro.read_avro(spark, str(tmp_path / "cut.avro")).count()
    with pytest.raises(Exception, match="no Avro container"):
        avro.read_avro(spark, str(tmp_path / "other.avro"))


def test_avro_schemas_of_others():
    said = {"type": "record", "name": "r", "fields": [{"name": "e", "type": {"type": "enum", "name": "k", "symbols": ["A", "B"]}}, {"name": "again", "type": "k"}, {"name": "x", "type": {"type": "fixed", "name": "h", "size": 2}}, {"name": "u", "type": ["long", "null"]}, {"name": "at", "type": {"type": "long", "logicalType": "timestamp-millis"}}]}
    schema = avro.Schema(said)
    assert schema.type.simpleString() == "struct<e:string,again:string,x:binary,u:bigint,at:timestamp>"
    out = bytearray()
    row = {"e": "B", "again": "A", "x": b"zz", "u": None, "at": datetime.datetime(2020, 1, 1, tzinfo=datetime.timezone.utc)}
    schema.write(row, out)
    assert schema.read(avro.Input(bytes(out))) == row
    assert [avro.Input(avro.zigzag(n)).long() for n in (0, -1, 1, 300, -(1 << 63), (1 << 63) - 1)] == [0, -1, 1, 300, -(1 << 63), (1 << 63) - 1]
    with pytest.raises(ValueError, match="several types"):
        avro.Schema(["int", "string"])


def test_profiles_by_file(spark, tmp_path):
    table, kept = str(tmp_path / "a table+x"), files.FileProfiles(spark, str(tmp_path / "states"))
    df = spark.range(4000).selectExpr("id % 1000 as k", "if(id % 10 = 0, null, id / 4) as v", "if(id % 5 = 0, '', concat('t', id % 7)) as t", "array(id) as a", "cast(null as double) as none", "if(id % 9 = 0, double('nan'), id) as w", "id % 2 = 0 as b")
    df.where("k < 300").repartition(3).write.parquet(table)
    assert kept.update(table) == 3 and kept.update(table) == 0
    df.where("k >= 300").repartition(2).write.mode("append").parquet(table)
    df.where("k > 5000").coalesce(1).write.mode("append").parquet(table)  # a file without rows
    got = {(r["column"], r["stat"]): r["number"] if r["text"] is None else r["text"] for r in kept.profile(table).collect()}
    assert kept.files_read in (2, 3) and kept.update(table) == 0
    want, _ = profile.profile_wide(df)
    for r in profile.to_long(want).collect():
        if (r["column"], r["stat"]) in got and r["number"] is not None:
            assert got[r["column"], r["stat"]] == pytest.approx(r["number"], rel=1e-12), r
    assert {("v", s) for s in ("length", "null_count", "non_null_count", "nan_per", "min", "max", "mean", "std", "distinct_about", "median_about", "fingerprint")} <= set(got) and ("none", "mean") not in got and got["w", "null_count"] == 445
    assert got["k", "distinct_about"] == pytest.approx(1000, rel=0.05) and got["v", "median_about"] == pytest.approx(500, rel=0.05) and got["t", "empty_count"] == 800
    assert {r["column"]: r["fingerprint"] for r in store.fingerprints(df.drop("w")).collect()}.items() <= {r["column"]: r["fingerprint"] for r in kept.fingerprints(table).collect()}.items()
    # what a changed or missing file said isn't counted
    spark.range(7).selectExpr("id as k").write.mode("overwrite").parquet(table)
    again = {(r["column"], r["stat"]): r["number"] for r in kept.profile(table).collect()}
    assert again["k", "length"] == 7 and again["k", "max"] == 6 and ("v", "length") not in again


def test_hashes_are_added_as_longs(spark):
    """Exactly, and by no decimal and no text function a row."""
    values = [-(1 << 63), (1 << 63) - 1, -1, 0, 1, (1 << 42) - 1, -(1 << 42), 1 << 21, None] * 50
    df = spark.createDataFrame([(i % 2, v) for i, v in enumerate(values)], "k int, h long")
    want = {k: sum(v for i, v in enumerate(values) if i % 2 == k and v is not None) for k in (0, 1)}
    assert {r["k"]: int(r["s"]) for r in df.groupBy("k").agg(store.hash_sum(F.col("h")).alias("s")).collect()} == want
    assert df.where("k > 5").agg(store.hash_sum(F.col("h")).alias("s")).first()["s"] is None
    for made in (store.fingerprints(df), files.states_of(df, "k")):
        plan = made._jdf.queryExecution().optimizedPlan().toString()
        assert not re.search(r"sum\(cast\(xxhash64|hll_sketch_agg\((CASE|if|xxhash64)", plan), plan


@pytest.fixture
def shuffled_joins(spark):
    """No adaptive plans, no broadcast that isn't asked for."""
    own = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {k: spark.conf.get(k) for k in own}
    for k, v in own.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


@pytest.mark.parametrize("nulls", [False, True])
def test_rows_of_frequent_keys_stay_where_they_are(spark, monkeypatch, shuffled_joins, nulls):
    """Half of all rows have one key, a quarter none: no task meets more rows than its own and those of the other keys."""
    monkeypatch.setattr(spread, "MOST_ROWS", 500)
    key = F.when(F.col("id") % 4 < 2, 7).when(F.col("id") % 4 == 2, F.col("id") % 101)
    rows = spark.range(8000, numPartitions=8).select("id", key.cast("int").alias("k"))
    groups = rows.groupBy(F.col("k").alias("__g")).agg(F.count(F.lit(1)).alias("__n"), F.min("id").alias("least"))
    out = spread.look_up(rows, groups, {"k": "__g"}, "__n", nulls=nulls).withColumn("part", F.spark_partition_id())
    assert max(r["count"] for r in out.groupBy("part").count().collect()) <= 1500
    got = {r["id"]: (r["k"], r["least"]) for r in out.collect()}
    least = {}
    for i, (k, _) in sorted(got.items()):
        least.setdefault(k, i)
    assert len(got) == 8000 and all(v == (least[k] if nulls or k is not None else None) for k, v in got.values())


def test_operators_with_a_frequent_key(spark, monkeypatch, shuffled_joins):
    """Ranks, transforms, marks of duplicates, codes and deviations are those of a table without frequent keys, broadcast or not."""
    rows = spark.createDataFrame([(i, "a" if i % 2 else ["b", "c", None][i % 3], float(i % 5)) for i in range(300)], "id long, k string, v double")
    made = {
        "rank": lambda: paging.rank(rows, "k", "min", "r"), "transform": lambda: group.group_by_transform(rows, "k", {"v": ["max", "count", "median"]}), "marks": lambda: duplicates.mark_duplicates(rows, "k"),
        "codes": lambda: shape.make_category(rows, "k"), "mad": lambda: group.group_by(rows, "k", {"v": ["mad"]}), "idxmax": lambda: group.group_by(rows, "v", {"k": ["idxmax"]}, order_by=["id"]),
    }
    plain = {n: sorted(map(tuple, f().collect()), key=repr) for n, f in made.items()}
    monkeypatch.setattr(spread, "MOST_ROWS", 60)
    for n, f in made.items():
        assert sorted(map(tuple, f().collect()), key=repr) == plain[n], n
    ids = [i for i in range(300) if i % 2]
    assert {r["id"]: r["r"] for r in made["rank"]().collect()}[ids[3]] == 1.0 and dict(map(tuple, made["mad"]().collect()))["a"] == pytest.approx(1.2, abs=0.01)
    assert not any(r["is_duplicated"] is False for r in made["marks"]().collect())
    empty = rows.limit(0)
    assert paging.rank(empty, "k").count() == duplicates.mark_duplicates(empty, "k").count() == 0


def test_quantiles_at_the_ends_of_brackets(spark):
    """Values that repeat, not-a-number as the largest, infinities, negative zero and columns of not-a-number only."""
    nan, inf = float("nan"), float("inf")
    columns = {"few": [float(i % 4) for i in range(400)], "nans": [nan if i % 2 else float(i) for i in range(400)], "ends": [-inf if i < 150 else inf if i > 250 else 1.0 for i in range(400)], "zeros": [-0.0 if i % 2 else 0.0 for i in range(400)], "only": [nan] * 400}
    df = spark.createDataFrame(list(zip(*columns.values(), strict=True)), ", ".join(f"{c} double" for c in columns)).repartition(3)
    for most in (quantiles.INSIDE, 50, 1):
        found = quantiles.column_quantiles(df, [F.col(c) for c in columns], [0.0, 0.25, 1.0], most=most)
        for c, got in zip(columns, found, strict=True):
            values = sorted(columns[c], key=lambda v: (math.isnan(v), v))
            wanted = [values[0], values[99] if values[99] == values[100] else values[99] + (values[100] - values[99]) * 0.75, values[-1]]
            assert all(a == b or (math.isnan(a) and math.isnan(b)) for a, b in zip(got, wanted, strict=True)), (c, most, got, wanted)


def test_texts_that_repeat_are_parsed_once_a_value(spark, monkeypatch):
    """The same shares whether values are counted first or parsed row by row; nulls count as unparsed, other types as nothing."""
    texts = ["7/4/1776", "17/10/1982", "1/2/03", "12", "-3", " yes ", "No", "", None, "$5", "1/2/2003 4:05:06", "2020-01-01", "/", "x" * 10_000]
    df = spark.createDataFrame([(i, texts[i % len(texts)], str(i)) for i in range(1400)], "id long, t string, n string")
    repeated = {r["column"]: r.asDict() for r in autoclean.parse_fractions(df).collect()}
    kinds = autoclean.recommend_types(df)
    monkeypatch.setattr(autoclean, "REPEATS", 1_000_000)
    assert {r["column"]: r.asDict() for r in autoclean.parse_fractions(df).collect()} == repeated and autoclean.recommend_types(df) == kinds
    t = repeated["t"]
    share = lambda n: pytest.approx(n / len(texts))
    assert t["regular_int_parse"] == t["int_parse"] == share(2) and t["str_bool"] == share(2) and t["us_dates"] == share(1) and t["euro_dates"] == share(2) and t["int_parse_fail"] == share(12)
    assert repeated["n"]["int_parse"] == 1 and set(list(repeated["id"].values())[1:]) == {0.0} and kinds["n"] == "int"
    assert {r["column"]: r["us_dates"] for r in autoclean.parse_fractions(df.limit(0)).collect()} == {"id": 0.0, "t": 0.0, "n": 0.0}
