"""Tables that cut lineage, in the folder that driver and executors share.

They are dropped by settle(), by drop(), or when the process ends, the session still being there.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}
#: (session, folder, table or None) of what is kept, in the order it was made.
_made: list[tuple[SparkSession, str, str | None]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; where that is unset, a temporary one, in local mode only."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    app = spark.sparkContext.applicationId
    if app not in _own:
        _own[app] = "file://" + tempfile.mkdtemp(prefix="spark-scratch-")
    return _own[app]


def new_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    _made.append((spark, path, None))
    return path


def table_of(path: str) -> str:
    """The name under which the catalog knows what is kept at a path."""
    name = path.rsplit("/", 1)[1].replace("-", "_")
    _made[:] = [(spark, p, name if p == path else table) for spark, p, table in _made]
    return name


def keep(df: DataFrame, name: str) -> DataFrame:
    """Writes df as Parquet and returns it as read back: a lost executor costs no recomputation of what came before."""
    spark, path = df.sparkSession, new_path(df.sparkSession, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def settle(make: Callable[[], DataFrame], name: str) -> DataFrame:
    """keep() of what make() returns; everything else that was kept meanwhile is dropped."""
    before = list(_made)
    out = keep(make(), name)
    drop([x for x in _made[len(before) : -1]])
    return out


def drop(what: list[tuple] | None = None) -> None:
    """Deletes what was kept (by default all), folders and the catalog's tables. What is still to be read from it can't be read any more."""
    for spark, path, table in list(_made if what is None else what):
        if spark.sparkContext._jsc is not None:
            if table:
                spark.sql(f"DROP TABLE IF EXISTS `{table}`")
            folder = spark._jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
        _made[:] = [x for x in _made if x[1] != path]


@atexit.register
def _at_exit() -> None:
    try:
        drop()
    except Exception:  # noqa: BLE001  the JVM may be gone already
        _made.clear()
    for path in _own.values():
        shutil.rmtree(path.removeprefix("file://"), ignore_errors=True)


def parts_for(df_bytes: int, each: int, least: int = 1) -> int:
    """How many groups of about `each` bytes hold df_bytes."""
    return max(least, -(-int(df_bytes) // each))
