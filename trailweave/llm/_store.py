"""Tables that cut lineage, in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import gc
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``, or in local mode (tests), where it may be unset, a temporary one of this process."""
    if found := spark.conf.get("spark.checkpoint.dir", None):
        return found
    if spark.sparkContext.master.partition("[")[0] != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    if "dir" not in _own:
        folder = tempfile.mkdtemp(prefix="trailweave-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        _own["dir"] = f"file://{folder}"
    return _own["dir"]


def stored(df: DataFrame) -> DataFrame:
    """Writes ``df`` as Parquet and reads it back, so that a lost executor costs no recomputation of what came before."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tables/{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop(*tables: DataFrame) -> None:
    """Deletes tables of ``stored`` that nothing reads any more."""
    for table in tables:
        spark = table.sparkSession
        for file in {f.rpartition("/")[0] for f in table.inputFiles()}:
            path = spark._jvm.org.apache.hadoop.fs.Path(file)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def release(spark: SparkSession) -> None:
    """Lets Spark remove the shuffle files of plans that are no longer referenced."""
    gc.collect()
    spark._jvm.System.gc()
