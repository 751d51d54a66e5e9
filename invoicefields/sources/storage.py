"""A stored copy of a table that is read more than once."""

from __future__ import annotations

import posixpath
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: The folders that sessions of this process have named for checkpoints.
_NAMED: set[str] = set()


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names for checkpoints.  Only a session on a single machine may lack
    the setting; it gets a folder in its warehouse.  Elsewhere executors would each write to a disk
    of their own, so that is an error."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not on_one_machine(spark):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all machines share")
        named = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_stored"
        spark.sparkContext.setCheckpointDir(named)
    _NAMED.add(named)
    return named.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    """A path of its own in the shared folder, deleted when the session's process ends."""
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    _at_end(spark, path)
    return path


def stored(df: DataFrame) -> DataFrame:
    """Write the table once to the shared folder and read it back.

    Used where a costly table has more than one reader.  The copy is on shared storage, so a
    lost executor costs nothing but the re-read, and being columnar each reader takes only
    the columns it needs.
    """
    spark = df.sparkSession
    path = new_folder(spark, "stored")
    schema = df.schema
    df.write.parquet(path)
    copy = spark.read.schema(schema).parquet(path)
    copy._stored_at = path
    return copy


@contextmanager
def copies() -> Iterator[Callable[[DataFrame], DataFrame]]:
    """``stored``, for tables that nothing reads after the block: the copies are deleted at its end,
    so a stream that runs for months leaves none behind."""
    held: list[DataFrame] = []

    def keep(df: DataFrame) -> DataFrame:
        held.append(stored(df))
        return held[-1]

    try:
        yield keep
    finally:
        for df in held:
            files, where = _files(df.sparkSession, df._stored_at)
            files.delete(where, True)
            files.cancelDeleteOnExit(where)


def _files(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def _at_end(spark: SparkSession, path: str) -> None:
    """Deletes the path when the session's process ends."""
    files, where = _files(spark, path)
    files.deleteOnExit(where)


def on_one_machine(spark: SparkSession) -> bool:
    return spark.sparkContext.master.split("[")[0] == "local"


def shared_uri(spark: SparkSession, path: str) -> str:
    """The path as a URI that means the same on every machine: without a scheme it lies on the default
    file system, as for Spark's own readers.  Disks of single machines serve a session on one only; what
    lies in the folder that the cluster names for checkpoints is on a disk that all of them have."""
    if "://" not in path and not path.startswith("file:"):
        files, where = _files(spark, path)
        path = files.makeQualified(where).toUri().toString()
        if path.startswith("file:/") and not path.startswith("file://"):
            path = "file://" + path[len("file:"):]
    if path.startswith("file:") and not on_one_machine(spark) and not _in_shared_folder(spark, path):
        raise ValueError(f"{path} is a folder of one machine: name one that all machines share")
    return path


def _in_shared_folder(spark: SparkSession, path: str) -> bool:
    def place(of: str) -> tuple[str, str]:
        files, where = _files(spark, of)
        uri = files.makeQualified(where).toUri()
        return uri.getScheme(), posixpath.normpath(uri.getPath())

    scheme, inner = place(path)
    tops = [place(named) for named in _NAMED | {spark._jsc.getConf().get("spark.checkpoint.dir", "")} if named]
    return any(scheme == s and inner.startswith(f"{top.rstrip('/')}/") for s, top in tops)


def exists(spark: SparkSession, path: str) -> bool:
    """Is there anything at the path, on whatever storage it names?"""
    files, where = _files(spark, path)
    return files.exists(where)


def names_in(spark: SparkSession, path: str) -> list[str]:
    """Names directly in a folder; none if it is missing."""
    files, where = _files(spark, path)
    return [f.getPath().getName() for f in files.listStatus(where)] if files.exists(where) else []


def is_folder(spark: SparkSession, path: str) -> bool:
    files, where = _files(spark, path)
    return files.exists(where) and files.getFileStatus(where).isDirectory()
