"""Tables that a job writes between its steps, so that later ones read them once made."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import cache

from pyspark.sql import DataFrame, SparkSession


@cache
def _own_folder() -> str:
    return tempfile.mkdtemp(prefix="sparkloom-")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, as ``spark.checkpoint.dir`` names it.

    Where that is unset, a temporary folder serves a local master (tests on one
    machine); on a cluster it is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return (named or _own_folder()).rstrip("/")


_SCOPES: list[list[DataFrame]] = []


def staged(df: DataFrame, label: str) -> DataFrame:
    """``df``, written as Parquet into the shared folder and read back: it survives the loss of any executor.

    Inside of :func:`temporary` the table belongs to that scope; else to the caller, who may :func:`forget` it.
    """
    path = f"{shared_dir(df.sparkSession)}/sparkloom-{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    if _SCOPES:
        _SCOPES[-1].append(out)
    return out


def _folders(df: DataFrame) -> set[str]:
    return {name.rsplit("/", 1)[0] for name in df.inputFiles() if "/sparkloom-" in name}


def forget(df: DataFrame) -> None:
    """Delete the staged tables that ``df`` reads; nobody may read them any more."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    for folder in _folders(df):
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def temporary() -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Tables staged inside are deleted at the end, but for those that a frame given to what this yields still reads.

    These belong to the scope around this one, or else to the caller.
    """
    made: list[DataFrame] = []
    kept: set[str] = set()

    def keep(df: DataFrame) -> DataFrame:
        kept.update(_folders(df))
        return df

    _SCOPES.append(made)
    try:
        yield keep
    finally:
        _SCOPES.remove(made)
    for df in made:
        if not _folders(df) & kept:
            forget(df)
        elif _SCOPES:
            _SCOPES[-1].append(df)


#: A table of fewer partitions than this, and than there are cores, is dealt anew: a few GB at most, on a cluster of any size.
FEW_PARTITIONS = 32


def spread(df: DataFrame, key: str) -> DataFrame:
    """``df``, dealt by ``key`` where its files give very few partitions.

    A small table in one file would otherwise be the work of one task. Larger
    ones stay as they are read and cost no shuffle, however many cores there are.
    """
    cores = min(df.sparkSession.sparkContext.defaultParallelism, FEW_PARTITIONS)
    return df.repartition(cores, key) if df.rdd.getNumPartitions() < cores else df
