"""Tables that are read several times, written once to a folder that driver and executors share, until they are released."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}
_kept: list[tuple[SparkSession, str]] = []


def folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; where that is unset, a temporary one, in local mode only."""
    if found := spark.conf.get("spark.checkpoint.dir", None):
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    app = spark.sparkContext.applicationId
    if app not in _own:
        _own[app] = "file://" + tempfile.mkdtemp(prefix="spark-tables-")
    return _own[app]


def new_path(spark: SparkSession, suffix: str = "") -> str:
    """A place for what stays until release(), or until the process ends."""
    path = f"{folder(spark)}/table-{uuid.uuid4().hex}{suffix}"
    _kept.append((spark, path))
    return path


def keep(df: DataFrame) -> DataFrame:
    """df as written and read back. It stays until release(), or until the process ends."""
    spark = df.sparkSession
    path = new_path(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def mark() -> int:
    """A place to release from: what is kept later."""
    return len(_kept)


def release(since: int = 0) -> None:
    """Deletes what was kept since a mark(); tables that read it can't be read any more."""
    for spark, path in _kept[since:]:
        if spark.sparkContext._jsc is not None:
            delete(spark, path)
    del _kept[since:]


def delete(spark: SparkSession, path: str) -> bool:
    """Deletes a folder; whether it was there."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def move(spark: SparkSession, source: str, target: str) -> bool:
    """Renames a folder in one step; whether it could."""
    path = spark._jvm.org.apache.hadoop.fs.Path
    return path(source).getFileSystem(spark._jsc.hadoopConfiguration()).rename(path(source), path(target))


def bytes_of(spark: SparkSession, path: str) -> int:
    """Bytes of the files of a folder; 0 if it isn't there."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = at.getFileSystem(spark._jsc.hadoopConfiguration())
    return system.getContentSummary(at).getLength() if system.exists(at) else 0


@atexit.register
def _at_exit() -> None:
    try:
        release()
    except Exception:  # noqa: BLE001  the JVM may be gone already
        _kept.clear()
    for path in _own.values():
        shutil.rmtree(path.removeprefix("file://"), ignore_errors=True)
