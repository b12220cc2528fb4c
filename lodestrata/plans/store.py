"""Profiles kept as Parquet, keyed by what was profiled: by column contents, or by table, operations and statistics.

The store is a folder that all executors share; tables in it are written whole beside their place and renamed, or added to.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from dataclasses import dataclass, field

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException, PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestrata.functions import types
from lodestrata.functions.scalars import col
from lodestrata.plans import profile
from lodestrata.plans.chain import Op
from lodestrata.sources import shared

SCHEMA = "fingerprint string, stat string, number double, text string, stored_at timestamp"


def fingerprints(df: DataFrame) -> DataFrame:
    """column, fingerprint of each column's values, whatever their order: sums of two hashes, and counts of rows and nulls, in one job.

    Texts and bytes are hashed by SHA-256 first: what two seeds of a fast hash both take for one would pass for the same column.
    """
    cells = []
    for f in df.schema:
        total = lambda seed, f=f: hash_sum(F.xxhash64(F.lit(seed), content(f)))
        mark = mark_of(total(1), total(2), F.count(F.lit(1)), F.count(col(f.name)), F.first(F.lit(f.dataType.simpleString())))
        cells.append(F.struct(F.lit(f.name).alias("column"), mark.alias("fingerprint")))
    return df.agg(F.array(*cells).alias("x")).select(F.explode("x").alias("x")).select("x.*")


def content(f: T.StructField) -> Column:
    """What is hashed of a column's value: numbers as they are, of all else a digest."""
    c = F.to_json(F.struct(col(f.name))) if types.is_nested(f.dataType) else col(f.name)
    if types.is_nested(f.dataType) or isinstance(f.dataType, (T.StringType, T.CharType, T.VarcharType, T.BinaryType, T.DecimalType)):
        c = F.sha2(c.cast("string") if isinstance(f.dataType, T.DecimalType) else c, 256)
    return c


def hash_sum(h: Column) -> Column:
    """The exact sum of hashes, as a decimal: three parts of each hash are added as longs, which hold for 2**42 rows, instead of a decimal a row."""
    most = (1 << 21) - 1
    parts = [F.sum(F.shiftright(h, 42)), F.sum(F.shiftright(h, 21).bitwiseAND(most)), F.sum(h.bitwiseAND(most))]
    high, middle, low = (p.cast("decimal(38,0)") for p in parts)
    return (high * F.lit(1 << 42) + middle * F.lit(1 << 21) + low).cast("decimal(38,0)")


def mark_of(sum_1: Column, sum_2: Column, rows: Column, non_null: Column, kind: Column) -> Column:
    none = F.lit(0).cast("decimal(38,0)")
    return F.sha2(F.concat_ws("|", F.coalesce(sum_1, none).cast("string"), F.coalesce(sum_2, none).cast("string"), rows.cast("string"), non_null.cast("string"), kind), 256)


@dataclass
class Runs:
    """What a store has done: results found and made, those found but unreadable, bytes read and written, writes that failed, and a line for each."""

    hits: int = 0
    misses: int = 0
    unreadable: int = 0
    bytes_read: int = 0
    bytes_written: int = 0
    write_errors: int = 0
    status: list[str] = field(default_factory=list)


class ProfileStore:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self.runs = spark, path.rstrip("/"), Runs()

    # by column contents

    def _read(self, name: str, schema: str) -> DataFrame:
        try:
            return self.spark.read.schema(schema).parquet(f"{self.path}/{name}")
        except AnalysisException:
            return self.spark.createDataFrame([], schema)

    def columns(self) -> DataFrame:
        if not shared.bytes_of(self.spark, f"{self.path}/columns") and shared.bytes_of(self.spark, f"{self.path}/columns-before"):
            shared.delete(self.spark, f"{self.path}/columns")
            shared.move(self.spark, f"{self.path}/columns-before", f"{self.path}/columns")
        return self._read("columns", SCHEMA)

    def put(self, rows: DataFrame) -> None:
        """Adds fingerprint, stat, number, text rows; of a statistic stored twice the latest counts."""
        rows.select("fingerprint", "stat", "number", "text", F.current_timestamp().alias("stored_at")).write.mode("append").parquet(f"{self.path}/columns")

    def latest(self) -> DataFrame:
        best = F.max_by(F.struct("number", "text"), "stored_at").alias("v")
        return self.columns().groupBy("fingerprint", "stat").agg(best).select("fingerprint", "stat", "v.number", "v.text")

    def profile(self, df: DataFrame, stats: list | None = None, marks: DataFrame | None = None) -> DataFrame:
        """The long profile of df, computing only columns that lack a statistic in the store. marks: the columns' fingerprints, where they are known (as from FileProfiles), so that df needn't be read for them."""
        wanted = profile.S.in_order(stats if stats is not None else profile.S.BASE)
        names = {f.name: {s.name for s in profile.S.for_column(wanted, f.dataType)} - {"quartiles"} for f in df.schema}
        marks = {r["column"]: r["fingerprint"] for r in (fingerprints(df) if marks is None else marks).collect()}  # a row a column
        stored = self.latest().where(F.col("fingerprint").isin(list(marks.values())))
        have: dict[str, set[str]] = {}
        for r in stored.select("fingerprint", "stat").collect():  # a row a statistic of these columns
            have.setdefault(r["fingerprint"], set()).add(r["stat"])
        missing = [c for c in df.columns if not names[c] <= have.get(marks[c], set())]
        self.runs.hits += len(df.columns) - len(missing)
        self.runs.misses += len(missing)
        of = self.spark.createDataFrame(list(marks.items()), "column string, fingerprint string")
        if missing:
            wide, _ = profile.profile_wide(df.select(*[col(c) for c in missing]), stats)
            self.put(profile.to_long(wide).where("stat <> 'quartiles'").join(F.broadcast(of), "column"))  # a row a column
        return self.latest().join(F.broadcast(of), "fingerprint").select("column", "stat", "number", "text")

    # by file

    def remember_files(self, df: DataFrame) -> None:
        """Notes the files that df was read from, with their times."""
        files = df.select("_metadata.file_path", "_metadata.file_modification_time").distinct()
        files.select(F.col("file_path"), F.col("file_modification_time").alias("modified"), F.current_timestamp().alias("stored_at")).write.mode("append").parquet(f"{self.path}/files")

    def files_unchanged(self, df: DataFrame) -> bool:
        """Whether no file of df is newer than when it was last noted."""
        noted = self._read("files", "file_path string, modified timestamp, stored_at timestamp").groupBy("file_path").agg(F.max("stored_at").alias("stored_at"))
        files = df.select(F.col("_metadata.file_path").alias("file_path"), F.col("_metadata.file_modification_time").alias("modified")).distinct()
        return files.join(noted, "file_path", "left").where("stored_at is null or modified > stored_at").isEmpty()

    # by query

    @staticmethod
    def key(source: str, ops: list[Op] = (), stats: list[str] = (), extra: dict | None = None) -> str:
        """A name for the result of operations over a source."""
        said = json.dumps({"source": source, "ops": [[o.name, list(o.args)] for o in ops], "stats": sorted(stats), "extra": extra or {}}, sort_keys=True, default=str)
        return hashlib.blake2b(said.encode(), digest_size=16).hexdigest()

    def cached(self, key: str, make) -> DataFrame:
        """The result stored under a key, or make()'s, which is stored. One that can't be read, which all of it is tried for, is made again.

        A result is written beside its place and renamed when it is whole, so a reader finds a whole one or none. If it can't be written the result comes unstored.
        """
        path = f"{self.path}/results/{key}"
        size = shared.bytes_of(self.spark, path)
        if size:
            try:
                found = self.spark.read.parquet(path)
                found.write.format("noop").mode("overwrite").save()
                self._note("hits", f"hit {key}", bytes_read=size)
                return found
            except (PySparkException, Py4JJavaError):
                self._note("unreadable", f"unreadable {key}")
        self._note("misses", f"miss {key}")
        made = make()
        aside = f"{self.path}/aside/{key}-{uuid.uuid4().hex}"
        try:
            made.write.parquet(aside)
            self.spark.createDataFrame([], "x int").write.mode("ignore").parquet(f"{self.path}/results/_made")  # the folder to rename into
            shared.delete(self.spark, path)
            if not shared.move(self.spark, aside, path):
                raise OSError(f"{aside} can't be renamed to {path}")
        except (PySparkException, Py4JJavaError, OSError) as error:
            self._note("write_errors", f"write error {key}: {str(error)[:200]}")
            return made
        self.runs.bytes_written += shared.bytes_of(self.spark, path)
        return self.spark.read.parquet(path)

    def _note(self, what: str, said: str, bytes_read: int = 0) -> None:
        setattr(self.runs, what, getattr(self.runs, what) + 1)
        self.runs.bytes_read += bytes_read
        self.runs.status.append(said)

    # upkeep

    def size(self) -> int:
        """Rows of stored statistics."""
        return self.columns().count()

    def bytes(self) -> int:
        """Bytes of everything stored."""
        return shared.bytes_of(self.spark, self.path)

    def clear(self) -> None:
        self._replace(self.spark.createDataFrame([], SCHEMA))

    def drop_older(self, days: float = 30) -> int:
        """Drops statistics stored more than some days ago; returns how many rows are left."""
        self._replace(self.columns().where(F.col("stored_at") >= F.current_timestamp() - F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(days * 86400.0))))
        return self.size()

    def _replace(self, rows: DataFrame) -> None:
        """Statistics written beside the stored ones, which then take their place. If that ends between the two renames, the old ones are still there, under the name `columns-before`, and are put back on the next reading."""
        aside, before, place = (f"{self.path}/{x}" for x in ("columns-aside", "columns-before", "columns"))
        rows.write.mode("overwrite").parquet(aside)
        shared.delete(self.spark, before)
        if shared.bytes_of(self.spark, place):
            shared.move(self.spark, place, before)
        shared.move(self.spark, aside, place)
        shared.delete(self.spark, before)
