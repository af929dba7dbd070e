"""Intermediate tables in the shared folder.

A panel that later steps read several times is written once as Parquet and read
back: the plan behind it is cut, a lost executor costs one re-read, and column
pruning works on what was stored. The shuffle files behind a written table are of no
further use, so Spark removes them when the write is done.
"""

from __future__ import annotations

import tempfile
import threading
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_LOCAL: dict[str, str] = {}
# the setting's old value, then one entry per write under way
_WRITERS: list = []
_LOCK = threading.Lock()
FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_folder(spark: SparkSession) -> str:
    """The folder named in `spark.checkpoint.dir`; a temporary one only locally."""
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if named:
        return named
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors can reach")
    return _LOCAL.setdefault(context.applicationId, tempfile.mkdtemp(prefix="plumbline-"))


@contextmanager
def _freeing_shuffles(spark: SparkSession):
    """Set while any thread writes; the last one puts the old value back."""
    with _LOCK:
        if not _WRITERS:
            _WRITERS.append(spark.conf.get(FREE_SHUFFLES, "false"))
        _WRITERS.append(None)
        spark.conf.set(FREE_SHUFFLES, "true")
    try:
        yield
    finally:
        with _LOCK:
            _WRITERS.pop()
            if len(_WRITERS) == 1:
                spark.conf.set(FREE_SHUFFLES, _WRITERS.pop())


def settle(frame: DataFrame, name: str = "table") -> DataFrame:
    """Write the frame and return a scan of what was written."""
    spark = frame.sparkSession
    path = f"{shared_folder(spark)}/plumbline-{name}-{uuid.uuid4().hex}"
    with _freeing_shuffles(spark):
        frame.write.parquet(path)
    file_system, folder = _resolved(spark, path)
    file_system.deleteOnExit(folder)
    stored = spark.read.schema(frame.schema).parquet(path)
    stored._stored_at = path
    return stored


def release(*frames: DataFrame) -> None:
    """Delete the tables behind frames that `settle` returned and that nothing reads any more."""
    for frame in frames:
        file_system, folder = _resolved(frame.sparkSession, frame._stored_at)
        file_system.delete(folder, True)


def _resolved(spark: SparkSession, path: str):
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark._jsc.hadoopConfiguration()), folder


def listing(spark: SparkSession, folder: str) -> tuple:
    """Names, sizes and times of the files below a folder: changes with what is stored there."""
    file_system, path = _resolved(spark, folder)
    if not file_system.exists(path):
        return ()
    files, out = file_system.listFiles(path, True), []
    while files.hasNext():
        status = files.next()
        out.append((status.getPath().toString(), status.getLen(), status.getModificationTime()))
    return tuple(sorted(out))


class Snapshots:
    """Stored panels by key, per application: each is computed once for the files its folders hold."""

    def __init__(self) -> None:
        self._frames: dict[tuple, DataFrame] = {}

    def get(self, spark: SparkSession, key: tuple, build) -> DataFrame:
        folders = tuple(listing(spark, k) for k in key if isinstance(k, str) and "/" in k)
        full = (spark.sparkContext.applicationId, *key, folders)
        if full not in self._frames:
            self._frames[full] = settle(build(), str(key[0]))
        return self._frames[full]

    def clear(self) -> None:
        self._frames.clear()
