"""Cutting lineage so that a lost executor costs no more than its own tasks."""

from __future__ import annotations

import atexit
import re
import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_scopes = threading.local()


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``, which all executors share. Where it is unset, a folder of this
    machine is made and set, but only under a local master: elsewhere that is an error."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not where:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        where = "file://" + tempfile.mkdtemp(prefix="newsloom-")
        spark.sparkContext.setCheckpointDir(where)
        spark.conf.set("spark.checkpoint.dir", where)
    return where


def materialise(df: DataFrame, what: str, outlives: bool = False) -> DataFrame:
    """``df`` written as Parquet in the shared folder and read back. The files go with ``discard``,
    at the end of the innermost ``scratch`` (of the next one around it where the table
    ``outlives`` that), or when the program ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/newsloom-{what}-{uuid.uuid4().hex}"
    scopes = getattr(_scopes, "open", [])
    scopes = scopes[:-1] if outlives else scopes
    if scopes:
        scopes[-1].append(path)
    else:
        atexit.register(_remove, spark, path)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._newsloom_path = path
    return out


def discard(df: DataFrame) -> None:
    """Remove the files of a table that ``materialise`` returned; nothing may read it any more."""
    _remove(df.sparkSession, df._newsloom_path)


def bound_batches(df: DataFrame, most: int = 4 << 20) -> None:
    """Let no Arrow batch of the session hold more than ``most`` bytes: the usual bound is 10,000
    rows, and with long texts a batch would be large in the JVM and in Python. The setting stays:
    the bound must hold when the lazy result of an operator is read, after the operator returns. It
    is only ever lowered, and changes no result."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(re.match(r"\d+", df.sparkSession.conf.get(name)).group()) > most:
        df.sparkSession.conf.set(name, str(most))


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables materialised inside are removed at the end, also after an error."""
    if not hasattr(_scopes, "open"):
        _scopes.open = []
    made: list[str] = []
    _scopes.open.append(made)
    try:
        yield
    finally:
        _scopes.open.pop()
        for path in made:
            _remove(spark, path)


def _remove(spark: SparkSession, path: str) -> None:
    sc = spark.sparkContext
    if sc._jsc is None or sc._jsc.sc().isStopped():
        return
    at = sc._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(sc._jsc.hadoopConfiguration()).delete(at, True)
