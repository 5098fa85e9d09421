"""Reading tables, and working tables that a query writes for itself."""

from __future__ import annotations

import re
import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Deals rows out anew where the input has fewer splits than there are cores; a file of one row group is one task however it is split.

    A large input has more splits than cores and is not shuffled.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share; one of our own only where none is named and all run on this machine."""
    sc = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if base is None:
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise RuntimeError("spark.checkpoint.dir names no folder that the driver and the executors share")
        base = f"file://{tempfile.mkdtemp(prefix='wardline-shared-')}"
        sc.setCheckpointDir(base)
    return base.rstrip("/")


#: Each thread's tables written within ``working_tables``, innermost last: queries side by side on one driver don't delete each other's.
_OWN = threading.local()


def _within() -> list[list[str]]:
    if not hasattr(_OWN, "tables"):
        _OWN.tables = []
    return _OWN.tables


def working_folder(spark: SparkSession) -> str:
    """A new path in the shared folder; what is written there goes when the application ends, or with ``working_tables`` around it."""
    path = f"{shared_folder(spark)}/wardline-{uuid.uuid4().hex}"
    _at(spark, path, lambda fs, at: (fs.mkdirs(at), fs.deleteOnExit(at)))
    if _within():
        _within()[-1].append(path)
    return path


def written(df: DataFrame) -> DataFrame:
    """Cuts lineage with a table in the shared folder, computed once; it goes like other ``working_folder`` ones."""
    spark = df.sparkSession
    path = working_folder(spark)
    df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def working_tables(spark: SparkSession, keep: int = 0) -> Iterator[None]:
    """Deletes at its end the tables that were written within it, but for the last ``keep``, which pass to what is around it."""
    _within().append([])
    try:
        yield
    finally:
        own = _within().pop()
        gone = own[: len(own) - keep]
        if _within():
            _within()[-1].extend(own[len(gone) :])
        for path in gone:
            _at(spark, path, lambda fs, at: fs.delete(at, True))


def _at(spark: SparkSession, path: str, do) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    do(at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at)
