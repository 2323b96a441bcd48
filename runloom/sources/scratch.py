"""Folders for intermediate tables and stream checkpoints that the driver and all executors see."""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from weakref import WeakKeyDictionary

from pyspark.sql import DataFrame, SparkSession

#: Deletes a query's shuffle files when the query has ended.
RELEASE = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

_lock = threading.Lock()
#: By session, how many writes want RELEASE now, and what it was before the first of them.
_releasing: WeakKeyDictionary[SparkSession, tuple[int, str]] = WeakKeyDictionary()
_local: dict[str, str] = {}
_paths: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()


def shared_folder(spark: SparkSession) -> str:
    """A new folder in spark.checkpoint.dir. Where that is unset, a local master gets a temporary folder; a cluster is refused, as its machines share none."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = _local.setdefault(spark.sparkContext.applicationId, "file://" + tempfile.mkdtemp(prefix="runloom-"))
    return f"{base.rstrip('/')}/runloom-{uuid.uuid4().hex}"


@contextmanager
def _released(spark: SparkSession) -> Iterator[None]:
    """RELEASE is set in the session until the last of the writes that run at the same time has ended."""
    with _lock:
        writes, before = _releasing.get(spark, (0, spark.conf.get(RELEASE, "false")))
        _releasing[spark] = (writes + 1, before)
        spark.conf.set(RELEASE, "true")
    try:
        yield
    finally:
        with _lock:
            writes, before = _releasing.pop(spark)
            if writes > 1:
                _releasing[spark] = (writes - 1, before)
            else:
                spark.conf.set(RELEASE, before)


def saved(df: DataFrame) -> DataFrame:
    """The same rows, written once as Parquet in a shared folder: lineage ends here, and a lost executor takes nothing with it.

    Nothing reads the shuffle files of this query again, so they are released with it.
    """
    spark, path = df.sparkSession, shared_folder(df.sparkSession)
    with _released(spark):
        df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _paths[out] = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes tables of saved() that nothing will read again."""
    for table in tables:
        if path := _paths.pop(table, None):
            context = table.sparkSession.sparkContext
            at = context._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(context._jsc.hadoopConfiguration()).delete(at, True)
