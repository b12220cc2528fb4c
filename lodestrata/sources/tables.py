"""Opening tables by extension, describing them, and writing pages."""

from __future__ import annotations

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException, PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.functions import types
from lodestrata.functions.scalars import col, short_name
from lodestrata.operators import paging
from lodestrata.sources import avro

READERS = {
    "parquet": lambda spark, path: spark.read.parquet(path),
    "csv": lambda spark, path: spark.read.csv(path, header=True, inferSchema=True),
    "tsv": lambda spark, path: spark.read.csv(path, sep="\t", header=True, inferSchema=True),
    "json": lambda spark, path: spark.read.json(path, multiLine=True),
    "ndjson": lambda spark, path: spark.read.json(path),
    "orc": lambda spark, path: spark.read.orc(path),
    "avro": avro.read_avro,
}
EXTENSIONS = {"parquet": "parquet", "parq": "parquet", "csv": "csv", "tsv": "tsv", "json": "json", "ndjson": "ndjson", "jsonl": "ndjson", "orc": "orc", "avro": "avro"}
#: Tried in turn where the extension says nothing.
FALLBACKS = ("parquet", "csv", "ndjson")


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """A table by its extension (a compression suffix aside), lazily. FileNotFoundError if there is nothing; ValueError, with the last error, if no reader takes it."""
    name = path.rstrip("/").rsplit("/", 1)[-1].lower()
    for suffix in (".gz", ".zst", ".bz2"):
        name = name.removesuffix(suffix)
    kind = EXTENSIONS.get(name.rsplit(".", 1)[-1] if "." in name else "")
    last: Exception | None = None
    for k in (kind,) if kind else FALLBACKS:
        try:
            df = READERS[k](spark, path)
            if kind is None and (not df.columns or (k == "ndjson" and df.columns == ["_corrupt_record"])):
                raise ValueError(f"no columns as {k}")
            return check_columns(df)
        except (PySparkException, Py4JJavaError, ValueError) as e:
            if (isinstance(e, AnalysisException) and e.getCondition() == "PATH_NOT_FOUND") or "FileNotFoundError" in str(e):
                raise FileNotFoundError(path) from e
            last = e
    raise ValueError(f"no reader takes {path}: {last}") from last


def check_columns(df: DataFrame) -> DataFrame:
    """df, unless columns share a name."""
    again = sorted({c for c in df.columns if df.columns.count(c) > 1})
    if again:
        raise ValueError(f"columns {again} occur more than once")
    return df


def local_to_utc(df: DataFrame, zone: str) -> DataFrame:
    """Timestamps without zone, which are local times of a zone, as instants."""
    return df.select(*[F.to_utc_timestamp(col(f.name).cast("timestamp"), zone).alias(f.name) if f.dataType.typeName() == "timestamp_ntz" else col(f.name) for f in df.schema])


def metadata(df: DataFrame, path: str) -> DataFrame:
    """path, rows, column, dtype, type: a row for each column."""
    cells = [F.struct(F.lit(f.name).alias("column"), F.lit(f.dataType.simpleString()).alias("dtype"), F.lit(types.semantic_type(f)).alias("type")) for f in df.schema]
    counted = df.agg(F.count(F.lit(1)).alias("rows"))
    return counted.select(F.lit(path).alias("path"), "rows", F.explode(F.array(*cells)).alias("x")).select("path", "rows", "x.*")


def short_names(df: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """df with short column names, which need no quoting, and what they stand for."""
    names = [short_name(i) for i in range(len(df.columns))]
    return df.toDF(*names), dict(zip(names, df.columns, strict=True))


def write_page(df: DataFrame, path: str, start: int, end: int, sort: str | None = None, ascending: bool = True, order_by: list[str] | None = None) -> None:
    """One sorted page, with absolute places in `index`, as Parquet."""
    paging.page(df, start, end, sort, ascending, order_by).write.mode("overwrite").parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    from lodestrata.operators.shape import nested_to_text

    nested_to_text(df).write.mode("overwrite").csv(path, header=True)


def write_profile(wide: DataFrame, path: str) -> None:
    """A wide profile as Parquet: one row, nested values as JSON text."""
    from lodestrata.operators.shape import nested_to_text

    nested_to_text(wide).write.mode("overwrite").parquet(path)
