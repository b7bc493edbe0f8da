"""Intermediate tables in the folder that driver and executors share.

``spark.checkpoint.dir`` names that folder; only where it is unset and the master is local, as in
tests, a temporary folder of this machine stands in. A table written there cuts the lineage, so a
lost executor costs at most the running stage. The tables of an application are removed when it ends.
"""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Lets Spark remove a query's shuffle files at its end; older versions ignore it.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Bytes of rows that a Python worker is sent at once, besides a single longer row.
BATCH, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", "4m"

_folders: dict[str, str] = {}
_passing: list[list[str]] = []


def _folder(spark: SparkSession) -> str:
    app = spark.sparkContext.applicationId
    if app not in _folders:
        root = spark.conf.get("spark.checkpoint.dir", None)
        if not root and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = root or f"file://{tempfile.mkdtemp(prefix='scratch-')}"
        _folders[app] = f"{root.rstrip('/')}/scratch-{app}-{uuid.uuid4().hex[:8]}"
        atexit.register(_remove, spark, _folders[app])
    return _folders[app]


def _remove(spark: SparkSession, folder: str) -> None:
    try:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    except Exception:  # the session is gone already; its owner clears spark.checkpoint.dir
        return


def bounded(df: DataFrame) -> DataFrame:
    """``df``, in a session that limits what a Python worker is sent at once, unless it does so already."""
    if df.sparkSession.conf.get(BATCH, None) is None:
        df.sparkSession.conf.set(BATCH, BATCH_BYTES)
    return df


@contextmanager
def passing(spark: SparkSession) -> Iterator[None]:
    """Remove the tables kept in this block at its end; none of its lazy results may be used later."""
    _passing.append([])
    try:
        yield
    finally:
        for path in _passing.pop():
            _remove(spark, path)


@contextmanager
def _cleaning(spark: SparkSession) -> Iterator[None]:
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(CLEANUP)
        else:
            spark.conf.set(CLEANUP, before)


def keep(df: DataFrame, name: str, stay: bool = False) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and return it as read from there.

    With ``stay`` the table outlives a ``passing`` block.
    """
    spark = df.sparkSession
    path = f"{_folder(spark)}/{name}-{uuid.uuid4().hex[:8]}"
    if _passing and not stay:
        _passing[-1].append(path)
    with _cleaning(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
