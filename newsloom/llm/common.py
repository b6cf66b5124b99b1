"""What several operators share: reading tables, cutting lineage, text splitting, batch streams."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.lineage import bound_batches, discard, materialise, scratch, shared_dir

__all__ = ["bound_batches", "discard", "hashed", "joined_side", "materialise", "release", "remembered", "row_key", "scratch", "shared_dir", "small_batches", "table", "trim"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _size(df: DataFrame) -> int:
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def hashed(df: DataFrame, most_bytes: int = 64 << 20, within: DataFrame | None = None) -> DataFrame:
    """One side of a join: the built side of a shuffled hash join where a partition's share of its
    files is small, which needs no sort of the other side. Where it isn't, the join is left to
    Spark, whose sort-merge join spills. What isn't a written table is as large as the written
    table ``within`` that it is a part of."""
    return df.hint("shuffle_hash") if _size(within or df) <= most_bytes * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else df


def joined_side(df: DataFrame, most_rows: int = 200_000, most_bytes: int = 16 << 20) -> DataFrame:
    """A written table as the smaller side of a join with texts: broadcast where its files and its
    rows are measured to be few, else as ``hashed``."""
    return F.broadcast(df) if _size(df) <= most_bytes and df.count() <= most_rows else hashed(df)


def small_batches(batches: Iterator[pa.RecordBatch], text: str, limit: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in slices of about ``limit`` bytes of the column ``text``, so that what
    Python makes of one slice fits in memory however long the texts are."""
    for batch in batches:
        n = batch.num_rows
        if n == 0:
            continue
        size = max(1, batch.column(text).nbytes)
        step = max(1, n * limit // size)
        for at in range(0, n, step):
            yield batch.slice(at, step)
    trim()


def trim() -> None:
    """Give memory that a task no longer needs back to the system: its worker stays for the next."""
    pa.default_memory_pool().release_unused()
    libc = ctypes.CDLL(None)
    if hasattr(libc, "malloc_trim"):
        libc.malloc_trim(0)


#: for each thing that a worker remembers from task to task: whether there is any, and how it is forgotten
remembered: list[tuple[Callable[[], bool], Callable[[], None]]] = []


def release() -> None:
    """Forget what tasks of other stages left in this worker for tasks of their own, as the memory
    is needed here; they make it again."""
    held = [forget for holds, forget in remembered if holds()]
    for forget in held:
        forget()
    if held:
        gc.collect()
        trim()


def row_key(*columns: str) -> F.Column:
    """64 bits that tell a row's content apart; nulls count as values of their own."""
    parts = []
    for c in columns:
        parts += [F.col(c).isNull(), F.col(c)]
    return F.xxhash64(*parts)
