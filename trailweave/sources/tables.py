"""Tables that are written once and read by several parts of a plan."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}
_seen: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``, which driver and executors share; in local mode (tests) it may be unset, and is a temporary one."""
    if found := spark.conf.get("spark.checkpoint.dir", None):
        return found
    if spark.sparkContext.master.partition("[")[0] != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    if "dir" not in _own:
        folder = tempfile.mkdtemp(prefix="trailweave-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        _own["dir"] = f"file://{folder}"
    return _own["dir"]


def _folder(spark: SparkSession) -> str:
    """The application's own folder; what is in it goes when the process ends in good order."""
    path = f"{shared_dir(spark)}/tables/{spark.sparkContext.applicationId}"
    if path not in _seen:
        _seen.add(path)
        atexit.register(_clear_at_exit, spark, path)
    return path


def _clear_at_exit(spark: SparkSession, path: str) -> None:
    if spark.sparkContext._jsc is not None and not spark.sparkContext._jsc.sc().isStopped():
        delete(spark, path)


def delete(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def scratch(spark: SparkSession, kind: str) -> str:
    """A new path in the shared folder for what a query writes on its way: files, streams, indexes."""
    return f"{_folder(spark)}/{kind}-{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: what reads it recomputes nothing, even if executors are lost."""
    path = scratch(df.sparkSession, "table")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def written_for_a_while(df: DataFrame) -> Iterator[DataFrame]:
    """As ``written``, for what is read within the block alone: the table is deleted at its end."""
    path = scratch(df.sparkSession, "table")
    try:
        df.write.parquet(path)
        yield df.sparkSession.read.schema(df.schema).parquet(path)
    finally:
        delete(df.sparkSession, path)


def clear(spark: SparkSession) -> None:
    """Deletes all that this application has written so far; results that read it can't be computed any more."""
    delete(spark, _folder(spark))
