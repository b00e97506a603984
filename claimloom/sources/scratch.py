"""Written intermediate tables.

A table that several branches of a plan read is written once and read back: the branches
scan pruned parquet columns instead of repeating the work, and a lost executor re-reads
files instead of recomputing the chain.

The folder is the one in ``spark.checkpoint.dir``, which all machines of a cluster share. Where it is unset, a
local session, whose driver and tasks share one disk, gets a folder that is removed when Python ends; any other
session is refused.
"""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import time
import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager
from functools import cache

from pyspark.sql import DataFrame, SparkSession


@cache
def _local_folder() -> str:
    folder = tempfile.mkdtemp(prefix="claimloom-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    return folder


def shared_folder(spark: SparkSession) -> str:
    """The cluster's shared checkpoint folder."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        master = spark.sparkContext.master
        if not re.match(r"local(\[|$)", master):
            raise RuntimeError(f"spark.checkpoint.dir must name a folder that all machines share (master {master})")
        folder = _local_folder()
    return folder.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/claimloom/{uuid.uuid4().hex}/{name}"


#: Lists that take the paths of written tables, one for each open ``noted``.
_noting: list[list[str]] = []


@contextmanager
def noted() -> Iterator[list[str]]:
    """The paths of the tables that are written inside."""
    paths: list[str] = []
    _noting.append(paths)
    try:
        yield paths
    finally:
        _noting[:] = [p for p in _noting if p is not paths]


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back."""
    path = new_path(df.sparkSession, name)
    df.write.mode("errorifexists").parquet(path)
    for paths in _noting:
        paths.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove_tables(spark: SparkSession, paths: Iterable[str]) -> None:
    """Remove written tables that nothing reads any more, and the shuffled rows of writes that have ended.

    Spark removes shuffled files when the driver has collected the plan that they belong to; without a collection they stay, beside those of all later steps.
    The first collection only finds what holds the plan, the second the plan.
    """
    for path in paths:
        folder = spark._jvm.org.apache.hadoop.fs.Path(path).getParent()
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
    spark._jvm.System.gc()
    time.sleep(0.1)
    spark._jvm.System.gc()


def remove_written(spark: SparkSession) -> None:
    """Remove what this library has written under the shared folder; for the end of a job that has the folder to itself."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_folder(spark)}/claimloom")
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
