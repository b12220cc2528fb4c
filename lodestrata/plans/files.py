"""Profiles of tables of files that are kept up by file: what a file adds is stored once and merged, so only new and changed files are read.

A file's state has, for each column, counts, mean and sum of squared deviations, least and largest value, sums of hashes, a distinct-count sketch and a quantile sketch; all of these merge. States are keyed by the
file's path, time and size, which a listing tells without reading data: a second profile of unchanged files starts no scan, and one new file costs that file's. States of files that are gone or changed
stay in the store and aren't merged. Counts, least and largest values, means and deviations and fingerprints are as exact as over the whole table; distinct counts and medians are sketched, to about 1.6 and 1.7 percent of the rows' ranks.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestrata.functions import types
from lodestrata.functions.scalars import col
from lodestrata.operators.filters import nullify_nonfinite
from lodestrata.plans import store

STATES = "file_path string, modified timestamp, bytes long, column string, kind string, rows long, nulls long, empties long, mean double, m2 double, least double, most double, sum_1 decimal(38,0), sum_2 decimal(38,0), distinct binary, ranks binary, stored_at timestamp"
_FILE = "__file_path"


def _path(said: Column) -> Column:
    """A file's path as listings say it: Spark's metadata escapes characters and puts three slashes after file:."""
    return F.regexp_replace(F.url_decode(F.replace(said, F.lit("+"), F.lit("%2B"))), "^file:/+", "file:/")


def states_of(rows: DataFrame, by: str) -> DataFrame:
    """A row of states for each value of `by` and other column of rows, in one aggregate."""
    clean, cells, made = nullify_nonfinite(rows), [], []
    for i, f in enumerate(f for f in rows.schema if f.name != by):
        c, number = col(f.name), types.is_numeric_not_bool(f.dataType)
        said = F.to_json(F.struct(c)) if types.is_nested(f.dataType) else c
        # what sketches and sums take is made in the projection below, compiled and once a row; sketches would interpret it
        made += [*[F.xxhash64(F.lit(seed), store.content(f)).alias(f"__h{seed}_{i}") for seed in (1, 2)], F.when(c.isNotNull(), F.xxhash64(said)).alias(f"__d{i}")]
        made += [c.cast("double").alias(f"__v{i}")] if number else []
        v, none = F.col(f"__v{i}"), F.first(F.lit(None).cast("double"))
        sums = [store.hash_sum(F.col(f"__h{seed}_{i}")) for seed in (1, 2)]
        cells.append(F.struct(
            F.lit(f.name).alias("column"), F.lit(f.dataType.simpleString()).alias("kind"), F.count(F.lit(1)).alias("rows"), F.count_if(c.isNull()).alias("nulls"), (F.count_if(c == "") if types.is_string(f.dataType) else F.first(F.lit(None).cast("long"))).alias("empties"),
            (F.avg(v) if number else none).alias("mean"), (F.var_pop(v) * F.count(v) if number else none).alias("m2"), (F.min(v) if number else none).alias("least"), (F.max(v) if number else none).alias("most"),
            sums[0].alias("sum_1"), sums[1].alias("sum_2"), F.hll_sketch_agg(f"__d{i}", F.lit(12)).alias("distinct"), (F.kll_sketch_agg_double(v) if number else F.first(F.lit(None).cast("binary"))).alias("ranks"),
        ))
    return clean.select("*", *made).groupBy(col(by)).agg(F.array(*cells).alias("x")).select(col(by), F.explode("x").alias("x")).select(by, "x.*")


def merged(states: DataFrame) -> DataFrame:
    """column, kind, rows, nulls, empties, mean, std, least, most, sum_1, sum_2, distinct, median of the states of several files together."""
    own = F.col("rows") - F.col("nulls")
    once = states.groupBy("column").agg(
        F.first("kind").alias("kind"), F.sum("rows").alias("rows"), F.sum("nulls").alias("nulls"), F.sum("empties").alias("empties"), (F.sum(own * F.col("mean")) / F.sum(F.when(F.col("mean").isNotNull(), own))).alias("mean"), F.min("least").alias("least"),
        F.max("most").alias("most"), F.sum("sum_1").alias("sum_1"), F.sum("sum_2").alias("sum_2"), F.hll_sketch_estimate(F.hll_union_agg("distinct")).alias("distinct"), F.count(F.when(own > 0, F.col("ranks"))).alias("ranked"), F.kll_merge_agg_double(F.when(own > 0, F.col("ranks"))).alias("ranks"))
    once = once.withColumn("median", F.when(F.col("ranked") > 0, F.kll_sketch_get_quantile_double("ranks", F.lit(0.5)))).drop("ranked", "ranks")
    # a file's deviations are from its own mean: the way to the whole's is added
    means = F.broadcast(once.select(F.col("column").alias("of"), F.col("mean").alias("whole")))
    spread = states.join(means, F.col("column") == F.col("of")).groupBy("of").agg(F.sum(F.col("m2") + own * (F.col("mean") - F.col("whole")) ** 2).alias("m2"))
    out = once.join(F.broadcast(spread), F.col("column") == F.col("of")).drop("of")
    return out.withColumn("std", F.when(F.col("rows") - F.col("nulls") > 1, F.sqrt(F.col("m2") / (F.col("rows") - F.col("nulls") - 1)))).drop("m2")


class FileProfiles:
    def __init__(self, spark: SparkSession, path: str, read: Callable[[SparkSession, list[str]], DataFrame] | None = None):
        """path: the store, a folder that all executors share; read: how files are read (Parquet)."""
        self.spark, self.path = spark, path.rstrip("/")
        self.read = read or (lambda spark, files: spark.read.parquet(*files))
        #: Files that the last call read.
        self.files_read = 0

    def files(self, table: str) -> DataFrame:
        """file_path, modified, bytes of a table's files: a listing, no data is read."""
        found = self.spark.read.format("binaryFile").load(table)
        return found.select(_path(F.col("path")).alias("file_path"), F.col("path").alias("as_listed"), F.col("modificationTime").alias("modified"), F.col("length").alias("bytes"))

    def states(self) -> DataFrame:
        """The stored states; of one that was stored twice the latest."""
        try:
            kept = self.spark.read.schema(STATES).parquet(f"{self.path}/states")
        except AnalysisException:
            return self.spark.createDataFrame([], STATES)
        key = ["file_path", "modified", "bytes", "column"]
        rest = [f.name for f in kept.schema if f.name not in key]
        return kept.groupBy(*key).agg(F.max_by(F.struct(*rest), "stored_at").alias("s")).select(*key, "s.*")

    def update(self, table: str) -> int:
        """Reads the files that have no state yet; how many they are."""
        listed, known = self.files(table), self.states().select("file_path", "modified", "bytes").distinct()
        key = ["file_path", "modified", "bytes"]
        new = listed.join(known, key, "left_anti")
        paths = [r["as_listed"] for r in new.select("as_listed").collect()]  # the names of what is to be read
        self.files_read = len(paths)
        if paths:
            rows = self.read(self.spark, paths)
            made = states_of(rows.select("*", F.col("_metadata.file_path").alias(_FILE)), _FILE).withColumn("file_path", _path(F.col(_FILE)))  # a path a file is unescaped, not one a row
            self._store(made.join(F.broadcast(new.select(*key)), "file_path"))
            # a file without rows has no group: its state is nothing, so it is listed as read
            self._store(new.select(*key).join(self.states().select(*key).distinct(), key, "left_anti"))
        return self.files_read

    def _store(self, states: DataFrame) -> None:
        said = {f.name: F.col(f.name) if f.name in states.columns else F.lit(None) for f in T.StructType.fromDDL(STATES)} | {"stored_at": F.current_timestamp()}
        states.select(*[said[f.name].cast(f.dataType).alias(f.name) for f in T.StructType.fromDDL(STATES)]).write.mode("append").parquet(f"{self.path}/states")

    def current(self, table: str) -> DataFrame:
        """The states of the table's files as they are now."""
        self.update(table)
        return self.states().join(self.files(table).drop("as_listed"), ["file_path", "modified", "bytes"], "left_semi").where("column is not null")

    def profile(self, table: str) -> DataFrame:
        """column, stat, number, text: the statistics that states give, and the column's fingerprint."""
        m = merged(self.current(table))
        share = lambda c: F.coalesce(F.try_divide(F.col(c), F.col("rows")), F.lit(0.0))
        numbers = {"length": "rows", "null_count": "nulls", "min": "least", "max": "most", "mean": "mean", "std": "std", "empty_count": "empties", "distinct_about": "distinct", "median_about": "median"}
        cells = [F.struct(F.lit(s).alias("stat"), F.col(c).cast("double").alias("number"), F.lit(None).cast("string").alias("text")) for s, c in numbers.items()]
        cells += [F.struct(F.lit("non_null_count").alias("stat"), (F.col("rows") - F.col("nulls")).cast("double").alias("number"), F.lit(None).cast("string").alias("text")), F.struct(F.lit("nan_per").alias("stat"), share("nulls").alias("number"), F.lit(None).cast("string").alias("text")),
                  F.struct(F.lit("fingerprint").alias("stat"), F.lit(None).cast("double").alias("number"), _mark().alias("text"))]
        return m.select("column", F.explode(F.array(*cells)).alias("x")).select("column", "x.*").where("number is not null or text is not null")

    def fingerprints(self, table: str) -> DataFrame:
        """column, fingerprint of the table's columns, as of its whole contents, from its files' states."""
        return merged(self.current(table)).select("column", _mark().alias("fingerprint"))


def _mark() -> Column:
    return store.mark_of(F.col("sum_1"), F.col("sum_2"), F.col("rows"), F.col("rows") - F.col("nulls"), F.col("kind"))
