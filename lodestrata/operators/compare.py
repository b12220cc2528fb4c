"""Comparison of two versions of a table: keys, membership, differences by row and by column."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import combinations, islice
from math import prod
from operator import and_

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestrata.functions import types
from lodestrata.functions.aggregates import about_distinct
from lodestrata.functions.scalars import col
from lodestrata.operators.group import largest_group

OTHER = "|df2"
EQUAL = "|eq"
MEMBERSHIP = "membership"


def shared_columns(a: DataFrame, b: DataFrame) -> list[str]:
    return [c for c in a.columns if c in b.columns]


def all_columns(a: DataFrame, b: DataFrame) -> list[str]:
    """The first table's columns, then those only the second has."""
    return [*a.columns, *[c for c in b.columns if c not in a.columns]]


def keys_repeat(df: DataFrame, keys: list[str]) -> bool:
    return not df.groupBy(*[col(k) for k in keys]).count().where("count > 1").isEmpty()


def _sides(a: DataFrame, b: DataFrame, keys: list[str], how: str) -> DataFrame:
    """Both tables joined on keys, with __a and __b true where a side has the row; b's columns carry the suffix. Null keys match nothing."""
    left = a.withColumn("__a", F.lit(True))
    right = b.select(*[col(c).alias(f"{c}{OTHER}") for c in b.columns], F.lit(True).alias("__b"))
    return left.join(right, reduce(and_, [col(k) == col(f"{k}{OTHER}") for k in keys]), how)


def _member() -> Column:
    return F.when(F.col("__a") & F.col("__b"), 3).when(F.col("__a"), 1).otherwise(2)


def join_versions(a: DataFrame, b: DataFrame, keys: list[str], how: str = "outer", check: bool = True) -> DataFrame:
    """Keys, membership (1 first only, 2 second only, 3 both), then each column of either table, the second's with a suffix, and for shared ones {column}|eq: membership, and 4 more if equal. Nulls aren't equal.

    Names that would be taken for added columns, and keys that repeat on a side (check), are refused.
    """
    for df in (a, b):
        bad = [c for c in df.columns if c.endswith((OTHER, EQUAL)) or c in (MEMBERSHIP, "__a", "__b")]
        if bad:
            raise ValueError(f"columns {bad} have names that the comparison adds")
        missing = [k for k in keys if k not in df.columns]
        if missing:
            raise ValueError(f"no key columns {missing}")
        if check and keys_repeat(df, keys):
            raise ValueError(f"keys {keys} repeat")
    joined = _sides(a, b, keys, how)
    same = lambda c: F.coalesce(col(c) == col(f"{c}{OTHER}"), F.lit(False))
    out = [F.coalesce(col(k), col(f"{k}{OTHER}")).alias(k) for k in keys] + [_member().alias(MEMBERSHIP)]
    for c in all_columns(a, b):
        if c in keys:
            continue
        out += [col(c)] if c in a.columns else []
        out += [col(f"{c}{OTHER}")] if c in b.columns else []
        if c in a.columns and c in b.columns:
            out.append((_member() + F.when(same(c), 4).otherwise(0)).alias(f"{c}{EQUAL}"))
    return joined.select(*out)


def difference_counts(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """column, kind (join_key, df_1, df_2 or both), differences: rows of both tables whose values aren't equal; two nulls differ."""
    compared = [c for c in shared_columns(a, b) if c not in keys]
    joined = _sides(a.select(*[col(c) for c in [*keys, *compared]]), b.select(*[col(c) for c in [*keys, *compared]]), keys, "inner")
    counts = joined.agg(F.count(F.lit(1)).alias("__n"), *[F.count_if(~F.coalesce(col(c) == col(f"{c}{OTHER}"), F.lit(False))).alias(c) for c in compared])
    kind = lambda c: "join_key" if c in keys else "both" if c in compared else "df_1" if c in a.columns else "df_2"
    cells = [F.struct(F.lit(c).alias("column"), F.lit(kind(c)).alias("kind"), (col(c) if c in compared else F.lit(None).cast("long")).alias("differences")) for c in all_columns(a, b)]
    return counts.select(F.explode(F.array(*cells)).alias("x")).select("x.*")


def key_totals(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """One row: only_before, only_after, matched. A null in data is no missing row."""
    for df in (a, b):
        if missing := [k for k in keys if k not in df.columns]:
            raise ValueError(f"no key columns {missing}")
    joined = _sides(a.select(*[col(k) for k in keys]), b.select(*[col(k) for k in keys]), keys, "full")
    return joined.agg(F.count_if(F.col("__b").isNull()).alias("only_before"), F.count_if(F.col("__a").isNull()).alias("only_after"), F.count_if(F.col("__a") & F.col("__b")).alias("matched"))


def key_preview(a: DataFrame, b: DataFrame, keys: list[str], rows: int = 50) -> DataFrame:
    """The first rows, in order of the keys, of the full join, with {column}_before and {column}_after."""
    joined = _sides(a, b, keys, "full")
    named = [F.coalesce(col(k), col(f"{k}{OTHER}")).alias(k) for k in keys]
    rest = [x for c in all_columns(a, b) if c not in keys for x in ([col(c).alias(f"{c}_before")] if c in a.columns else []) + ([col(f"{c}{OTHER}").alias(f"{c}_after")] if c in b.columns else [])]
    return joined.select(*named, *rest).orderBy(*[col(k).asc_nulls_last() for k in keys]).limit(rows)


#: Logarithm of a sketch's bytes, how far its distinct count may be off (six times its standard error), and how many of it one job makes, 8 MB a task: precise sketches and small ones.
PRECISE, SMALL = (14, 0.05, 512), (11, 0.14, 4096)
#: Keys that one job counts.
COUNTED = 12
#: Rows of a sample in which counterexamples are looked for, and how many of those are held.
SAMPLED, HELD = 4_000, 512


def sketch_keys(df: DataFrame, keys: list[tuple[str, ...]], kind: tuple = PRECISE) -> dict[tuple[str, ...], int]:
    """About how many different tuples each key has, all keys of a job in one aggregate."""
    found, (log_size, _, most) = {}, kind
    for a in range(0, len(keys), most):
        some = keys[a : a + most]
        cells = F.array(*[about_distinct(*[col(c) for c in k], log_size=log_size) for k in some])
        found |= dict(zip(some, df.agg(cells.alias("x")).first()[0], strict=True))
    return found


def measure_keys(df: DataFrame, keys: list[tuple[str, ...]]) -> DataFrame:
    """keys, distinct, largest: for each key its exact number of different tuples (of a single column without null, of several with) and its largest group, all in one grouping."""
    names = sorted({c for k in keys for c in k}, key=df.columns.index)
    # a bit for each name, the first name's highest: set where a key leaves the name out
    number = {sum(1 << (len(names) - 1 - i) for i, c in enumerate(names) if c not in k): k for k in keys}
    groups = df.select(*[col(c) for c in names]).groupingSets([[col(c) for c in k] for k in keys], *[col(c) for c in names]).agg(F.grouping_id().alias("__key"), F.count(F.lit(1)).alias("__rows"))
    single = F.coalesce(*[F.when(F.col("__key") == g, col(k[0]).isNull()) for g, k in number.items() if len(k) == 1], F.lit(False))
    totals = groups.groupBy("__key").agg(F.count_if(~single).alias("distinct"), F.max("__rows").alias("largest"))
    said = F.create_map(*[x for g, k in number.items() for x in (F.lit(g).cast("long"), F.array(*[F.lit(c) for c in k]))])
    return totals.select(said[F.col("__key")].alias("keys"), "distinct", "largest")


def agreements(df: DataFrame, names: list[str], anchor: str, rows: int = SAMPLED, most: int = HELD) -> list[int]:
    """Sets of columns in which two rows agree, as bits in the order of names, the largest ones: no set within one of them is a key.

    Two samples of bounded size are drawn: rows of the least hashes, which keeps equal rows together, and rows of the values of `anchor` with the least hashes, which agree there.
    In them rows that stand side by side in the order of any column are compared.
    """
    hashes = [F.xxhash64(F.lit(i), col(c), col(c).isNull()).alias(f"h{i}") for i, c in enumerate(names)]
    hashed = df.select(*hashes)
    found: set[bytes] = set()
    for order in (F.xxhash64(*[f"h{i}" for i in range(len(names))]), F.col(f"h{names.index(anchor)}")):
        sample = hashed.orderBy(order, *hashed.columns).limit(rows).toArrow()
        values = np.stack([sample.column(c).to_numpy() for c in hashed.columns]) if sample.num_rows > 1 else np.zeros((len(names), 0), np.int64)
        for i in range(len(names)):
            by = np.argsort(values[i], kind="stable")
            ordered = values[:, by]
            packed = np.packbits((ordered[:, 1:] == ordered[:, :-1]).T, axis=1, bitorder="little")
            found |= set(map(bytes, packed))
    largest: list[int] = []
    for mask in sorted((int.from_bytes(x, "little") for x in found), key=lambda m: -m.bit_count())[: 8 * most]:
        if len(largest) >= most:
            break
        if mask and all(mask & ~m for m in largest):
            largest.append(mask)
    return largest


def repeats_in_part(df: DataFrame, keys: list[tuple[str, ...]], by: list[str], part: int = 16) -> set[int]:
    """Which keys (by place) have equal tuples among the rows whose value of the key's column in `by` falls in one of `part` parts: equal tuples fall in the same, so these are no keys. One job over all of them."""
    found: set[int] = set()
    for a in range(0, len(keys), 128):
        cells = []
        for i, k in enumerate(keys[a : a + 128]):
            values = [x for c in k for x in (col(c), col(c).isNull())]
            cells.append(F.when(F.pmod(F.xxhash64(F.lit(7), col(by[a + i])), F.lit(part)) == 0, F.struct(F.lit(a + i).alias("key"), F.xxhash64(F.lit(1), *values).alias("h"), F.xxhash64(F.lit(2), *values).alias("g"))))
        rows = df.select(F.explode(F.array_compact(F.array(*cells))).alias("x")).select("x.*")
        found |= {r["key"] for r in rows.groupBy("key", "h", "g").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("key").distinct().collect()}  # a row a key
    return found


def candidate_sets(names: int, width: int, ruled_out: list[int], may) -> Iterator[tuple[int, ...]]:
    """Sets of `width` columns, in order, that lie within none of those that are ruled out and that may(set) lets pass; made one by one."""
    every = (1 << names) - 1

    def grow(chosen: tuple[int, ...], holds: list[int]) -> Iterator[tuple[int, ...]]:
        """holds: the ruled-out sets that have all that is chosen."""
        left = width - len(chosen)
        allowed = every
        if left == 1:  # the last column must lie outside each of them
            for m in holds:
                allowed &= ~m
        for c in range(chosen[-1] + 1 if chosen else 0, names - left + 1):
            if not allowed >> c & 1:
                continue
            grown = (*chosen, c)
            if left == 1:
                if may(grown):
                    yield grown
            else:
                yield from grow(grown, [m for m in holds if m >> c & 1])

    yield from grow((), ruled_out)


def rank_keys(df: DataFrame, threshold: float = 1.0, max_width: int = 4, max_group: int | None = None, columns: list[str] | None = None) -> dict | None:
    """The best key: {keys, uniqueness, max_group, n}, or None: the column that has most different values (nulls left out) of those that may be keys, else the first tuple, in the table's order, of the fewest columns.

    A key may have `threshold` times as many values as there are rows, or more, and no group of over `max_group` rows. The search goes width by width and stops at the first batch with a key. Sets are made one by one, and
    left out if all columns together don't reach the threshold, if the different values of their parts multiply to too few, or (for keys without any repeat) if two rows of a sample agree in them. Those left are
    sketched in batches of thousands, first small sketches, then precise ones; where many come near, repeats are looked for in a part of the rows; and what is left is counted exactly.
    """
    names = [c for c in (columns or df.columns) if not types.is_nested(df.schema[c].dataType)]
    if not names:
        return None
    cells = [F.count(F.lit(1)), about_distinct(*[col(c) for c in names]), *[about_distinct(col(c)) for c in names]]
    n, whole, *each = df.agg(*[c.alias(f"x{i}") for i, c in enumerate(cells)]).first()
    if not n:
        return None
    enough = threshold * n
    near = lambda d, kind=PRECISE: d * (1 + kind[1]) >= enough
    if len(names) > 1 and not near(whole) and not any(map(near, each)):
        return None  # no set has more different tuples than all columns
    # null is a value of a tuple; what is known of a set bounds every set that holds it
    bound: dict[tuple[int, ...], float] = {(i,): d * (1 + PRECISE[1]) + 1 for i, d in enumerate(each)}

    def most_tuples(k: tuple[int, ...]) -> float:
        best = prod(bound[i,] for i in k)
        for pair in combinations(k, 2) if len(k) > 2 else ():
            if pair in bound:
                best = min(best, bound[pair] * prod(bound[i,] for i in k if i not in pair))
        return best

    def first_of(some: list[tuple[int, ...]], kind: tuple) -> list[tuple[int, ...]]:
        said = sketch_keys(df, [tuple(names[i] for i in k) for k in some], kind)
        for k, d in zip(some, said.values(), strict=True):
            bound[k] = min(bound.get(k, float("inf")), d * (1 + kind[1]) + 1)
        return [k for k, d in zip(some, said.values(), strict=True) if near(d, kind)]

    def counted(some: list[tuple[int, ...]], width: int) -> dict | None:
        found = {tuple(r["keys"]): r for r in measure_keys(df, [tuple(names[i] for i in k) for k in some]).collect()}  # a row a key
        kept = [k for k in (tuple(names[i] for i in k) for k in some) if k in found and found[k]["distinct"] >= enough and (max_group is None or found[k]["largest"] <= max_group)]
        if not kept:
            return None
        best = max(kept, key=lambda k: found[k]["distinct"]) if width == 1 else kept[0]
        return {"keys": list(best), "uniqueness": found[best]["distinct"] / n, "max_group": found[best]["largest"], "n": n}

    able = [(i,) for i, d in enumerate(each) if near(d)]
    if able and (best := counted(able, 1)):
        return best
    ruled_out: list[int] | None = None if threshold >= 1 else []
    enough_tuples = lambda k: most_tuples(k) >= enough
    for width in range(2, min(max_width, len(names)) + 1):
        if ruled_out is None and next(candidate_sets(len(names), width, [], enough_tuples), None):
            ruled_out = agreements(df, names, names[max(range(len(names)), key=lambda i: each[i] if not near(each[i]) else -1)])
        sets = candidate_sets(len(names), width, ruled_out or [], enough_tuples)
        while some := list(islice(sets, SMALL[2])):
            some = first_of(some, SMALL) if len(some) > PRECISE[2] else some
            for part in (some[:64], *(some[a : a + PRECISE[2]] for a in range(64, len(some), PRECISE[2]))):  # the first are few: where keys abound, one is among them
                able = first_of(part, PRECISE) if part else []
                if threshold >= 1 and len(able) > COUNTED:  # many come near: a part of the rows shows most that repeat
                    out = repeats_in_part(df, [tuple(names[i] for i in k) for k in able], [names[max(k, key=lambda i: each[i])] for k in able])
                    able = [k for i, k in enumerate(able) if i not in out]
                for b in range(0, len(able), COUNTED):
                    if best := counted(able[b : b + COUNTED], width):
                        return best
    return None


def detect_key(df: DataFrame, **options) -> list[str] | None:
    found = rank_keys(df, **options)
    return found["keys"] if found else None


def probe(a: DataFrame, b: DataFrame, threshold: float = 0.98, max_width: int = 4, max_group: int = 10_000) -> dict:
    """Whether two tables can be compared by key: {can_diff, keys, reason}. The key is the first table's, or the second's if the first has none."""
    shared = shared_columns(a, b)
    if not shared:
        return {"can_diff": False, "keys": None, "reason": "no shared columns"}
    how = {"threshold": threshold, "max_width": max_width, "max_group": max_group, "columns": shared}
    for df, other, name in ((a, b, "second"), (b, a, "first")):
        keys = detect_key(df, **how)
        if keys is None:
            continue
        largest = largest_group(other, keys).first()[0]
        if largest is not None and largest > max_group:
            return {"can_diff": False, "keys": keys, "reason": f"the key's groups are too large in the {name} table"}
        return {"can_diff": True, "keys": keys, "reason": None}
    return {"can_diff": False, "keys": None, "reason": "no key in either table"}


def key_diff(a: DataFrame, b: DataFrame, keys: list[str] | None = None, threshold: float = 0.98, max_width: int = 4, max_group: int = 10_000, rows: int = 50) -> dict | None:
    """Keys, totals (one row) and preview of a full outer comparison; None if no key is given or found."""
    if keys is None:
        found = probe(a, b, threshold, max_width, max_group)
        if not found["can_diff"]:
            return None
        keys = found["keys"]
    return {"keys": keys, "totals": key_totals(a, b, keys), "preview": key_preview(a, b, keys, rows)}


def summaries(df: DataFrame) -> DataFrame:
    """column, rows, nulls, distinct, mean, min, max, sum of each column: one aggregate and one grouping of values."""
    from lodestrata.plans.profile import value_counts

    number = lambda f: types.is_numeric_not_bool(f.dataType)
    none = F.lit(None).cast("double")
    cells = [F.struct(F.lit(f.name).alias("column"), F.count(F.lit(1)).alias("rows"), F.count_if(col(f.name).isNull()).alias("nulls"),
                      *[(g(col(f.name)).cast("double") if number(f) else F.first(none)).alias(k) for k, g in (("mean", F.avg), ("min", F.min), ("max", F.max), ("sum", F.sum))]) for f in df.schema]
    wide = df.agg(F.array(*cells).alias("x"))
    distinct = value_counts(df).groupBy("column").agg(F.count(F.lit(1)).alias("distinct"))
    return wide.select(F.explode("x").alias("x")).select("x.*").join(distinct, "column", "left").select("column", "rows", "nulls", F.coalesce("distinct", F.lit(0)).cast("long").alias("distinct"), "mean", "min", "max", "sum")


def stats_diff(a: DataFrame, b: DataFrame) -> DataFrame:
    """column, and each summary of either table as {summary}_before and {summary}_after."""
    x, y = summaries(a), summaries(b)
    names = [c for c in x.columns if c != "column"]
    joined = x.select("column", *[F.col(c).alias(f"{c}_before") for c in names]).join(y.select("column", *[F.col(c).alias(f"{c}_after") for c in names]), "column", "full")
    return joined.select("column", *[F.col(f"{c}_{s}") for c in names for s in ("before", "after")])


def head_diff(a: DataFrame, b: DataFrame, order_by: list[str], rows: int = 10) -> DataFrame:
    """side, total, and the first rows of each table in order; columns that a side lacks are null."""
    sides = []
    for name, df in (("before", a), ("after", b)):
        head = df.orderBy(*[col(c).asc_nulls_last() for c in order_by]).limit(rows)
        total = df.agg(F.count(F.lit(1)).alias("total"))
        sides.append(head.crossJoin(F.broadcast(total)).select(F.lit(name).alias("side"), "total", *[col(c) for c in df.columns]))
    return sides[0].unionByName(sides[1], allowMissingColumns=True)


def header(a: DataFrame, b: DataFrame) -> DataFrame:
    """side, columns, rows of each table."""
    one = lambda name, df: df.agg(F.lit(name).alias("side"), F.lit(len(df.columns)).alias("columns"), F.count(F.lit(1)).alias("rows"))
    return one("df_1", a).unionByName(one("df_2", b))


def column_summary(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: how many columns are in common, only in the first, only in the second."""
    both = len(shared_columns(a, b))
    return a.sparkSession.createDataFrame([(both, len(a.columns) - both, len(b.columns) - both)], "in_common long, only_df_1 long, only_df_2 long")


def row_summary(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """One row: any_duplicates, in_common, only_df_1, only_df_2, all_equal, some_unequal."""
    compared = [c for c in shared_columns(a, b) if c not in keys]
    joined = _sides(a, b.select(*[col(c) for c in [*keys, *compared]]), keys, "full")
    both = F.col("__a") & F.col("__b")
    equal = reduce(and_, [col(c).eqNullSafe(col(f"{c}{OTHER}")) for c in compared], F.lit(True))
    totals = joined.agg(F.count_if(both).alias("in_common"), F.count_if(F.col("__b").isNull()).alias("only_df_1"), F.count_if(F.col("__a").isNull()).alias("only_df_2"), F.count_if(both & equal).alias("all_equal"), F.count_if(both & ~equal).alias("some_unequal"))
    most = [largest_group(df, keys).withColumnRenamed("max_group", f"g{i}") for i, df in enumerate((a, b))]
    # three tables of one row
    return totals.crossJoin(most[0]).crossJoin(most[1]).select((F.greatest("g0", "g1") > 1).alias("any_duplicates"), *totals.columns)


def match_stats(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """column, dtype_1, dtype_2, unequal, max_difference, null_differences of the compared columns over rows in common; two nulls are equal here."""
    compared = [c for c in shared_columns(a, b) if c not in keys]
    joined = _sides(a, b, keys, "inner")
    cells = []
    for c in compared:
        x, y, kinds = col(c), col(f"{c}{OTHER}"), (a.schema[c].dataType, b.schema[c].dataType)
        apart = F.max(F.abs(x - y)).cast("double") if all(types.is_numeric_not_bool(k) for k in kinds) else F.first(F.lit(None).cast("double"))
        cells.append(F.struct(F.lit(c).alias("column"), F.lit(kinds[0].simpleString()).alias("dtype_1"), F.lit(kinds[1].simpleString()).alias("dtype_2"), F.count_if(~x.eqNullSafe(y)).alias("unequal"), apart.alias("max_difference"), F.count_if(x.isNull() != y.isNull()).alias("null_differences")))
    schema = "column string, dtype_1 string, dtype_2 string, unequal long, max_difference double, null_differences long"
    return joined.agg(F.array(*cells).alias("x")).select(F.explode("x").alias("x")).select("x.*") if cells else a.sparkSession.createDataFrame([], T.StructType.fromDDL(schema))


def column_matching(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """One row: columns with some and with no unequal values, and all unequal values."""
    return match_stats(a, b, keys).agg(F.count_if(F.col("unequal") > 0).alias("some_unequal"), F.count_if(F.col("unequal") == 0).alias("all_equal"), F.coalesce(F.sum("unequal"), F.lit(0)).alias("total_unequal"))


def mismatches(a: DataFrame, b: DataFrame, keys: list[str], column: str, rows: int = 10) -> DataFrame:
    """Keys and both values of the first rows, in order of the keys, that differ in a column."""
    joined = _sides(a, b, keys, "inner").where(~col(column).eqNullSafe(col(f"{column}{OTHER}")))
    return joined.select(*[col(k) for k in keys], col(column).alias(f"{column}_df_1"), col(f"{column}{OTHER}").alias(f"{column}_df_2")).orderBy(*[col(k) for k in keys]).limit(rows)
