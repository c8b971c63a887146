"""Tables in the folder that the driver and all executors share: they cut lineage, and survive lost executors."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_sessions: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    It is ``spark.checkpoint.dir``. Where that is unset, a local master gets a temporary folder; a cluster gets an error, as
    a machine-local folder would lose rows there.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    made = "file://" + tempfile.mkdtemp(prefix="mosaica-")
    spark.conf.set("spark.checkpoint.dir", made)
    return made


def run_dir(spark: SparkSession) -> str:
    """This application's own folder in there; it goes when the driver ends, or by ``clear``."""
    path = f"{shared_dir(spark)}/mosaica/{spark.sparkContext.applicationId}"
    if path not in _sessions:
        _sessions.add(path)
        atexit.register(clear, spark)
    return path


def clear(spark: SparkSession) -> None:
    """Remove this application's tables; DataFrames that were made from them can't be read any more."""
    with contextlib.suppress(Exception):  # the context may have ended
        path = f"{shared_dir(spark)}/mosaica/{spark.sparkContext.applicationId}"
        jvm = spark._jvm
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it again."""
    path = f"{run_dir(df.sparkSession)}/{uuid.uuid4().hex}/{name}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
