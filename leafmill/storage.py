"""Where intermediate tables live, and how lineage is cut.

A cluster names a shared folder in ``spark.checkpoint.dir``; every table written
between stages goes below it, so a lost executor never loses it.  Only where the
setting is absent (unit tests on one machine) a folder of our own is used.
"""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL: dict[str, str] = {}
_WRITTEN: dict[str, list[str]] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, as the session states it."""
    stated = spark.conf.get("spark.checkpoint.dir", None)
    if stated:
        return stated.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if "dir" not in _LOCAL:
        _LOCAL["dir"] = tempfile.mkdtemp(prefix="leafmill-")
        atexit.register(shutil.rmtree, _LOCAL["dir"], True)
    return "file://" + _LOCAL["dir"]


def new_path(spark: SparkSession, label: str) -> str:
    path = f"{shared_dir(spark)}/leafmill/{label}-{uuid.uuid4().hex}"
    _WRITTEN.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back with a fresh lineage."""
    spark = df.sparkSession
    path = new_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def clean(spark: SparkSession) -> int:
    """Deletes every intermediate table this application has written; results not yet read are lost with them."""
    paths = _WRITTEN.pop(spark.sparkContext.applicationId, [])
    for path in paths:
        delete(spark, path)
    return len(paths)


def file_system(spark: SparkSession, path: str):
    """(Hadoop FileSystem, Path class) for ``path``; works on any store Spark can write to."""
    jvm = spark.sparkContext._jvm
    cls = jvm.org.apache.hadoop.fs.Path
    return cls(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), cls


def package_files() -> str:
    """Folder that holds the package, for executors that must import it."""
    return os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
