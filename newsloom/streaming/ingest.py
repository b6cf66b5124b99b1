"""The same ingest under Structured Streaming."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.ingest import ingest

ENTRY_SCHEMA = "id long, ext_url string, title string, source string, text string, published timestamp"


def read_entries(spark: SparkSession, folder: str, schema: str = ENTRY_SCHEMA, most_files: int = 1000) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", most_files).parquet(folder)


def deduplicated(entries: DataFrame, delay: str = "1 day") -> DataFrame:
    """Each URL once while it is in the watermark; the state never grows beyond that."""
    return entries.withWatermark("published", delay).dropDuplicatesWithinWatermark(["ext_url"])


def start(entries: DataFrame, table_path: str, checkpoint: str, trigger: dict | None = None, after: Callable[[DataFrame, int], None] | None = None) -> StreamingQuery:
    """Each micro-batch goes through the batch ingest against what is stored so far and is
    written under its own number, so a batch that is run again overwrites itself. One query for a
    checkpoint is what a lock or a claimed flag would be for."""

    def batch(rows: DataFrame, number: int) -> None:
        spark = rows.sparkSession
        stored = _stored(spark, table_path, number)
        fresh = ingest(rows.filter(F.col("ext_url").isNotNull()), stored)
        fresh.write.mode("overwrite").parquet(f"{table_path}/batch={number}")
        if after:
            after(spark.read.parquet(f"{table_path}/batch={number}"), number)

    return deduplicated(entries).writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(**(trigger or {"processingTime": "10 minutes"})).start()


def _stored(spark: SparkSession, path: str, number: int) -> DataFrame:
    """What earlier batches stored; the folder's listing is the only state."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    empty = spark.createDataFrame([], "ext_url string, title string, source string")
    if not fs.exists(at):
        return empty
    names = [x.getPath().getName() for x in fs.listStatus(at)]
    old = [f"{path}/{n}" for n in names if n.startswith("batch=") and int(n[6:]) < number]
    return spark.read.parquet(*old).select("ext_url", "title", "source") if old else empty


def activity(events: DataFrame, window: str = "1 hour", delay: str = "10 minutes") -> DataFrame:
    """Events by window and type, late ones included up to the watermark."""
    stamped = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay)
    return stamped.groupBy(F.window("ts", window), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))


def freeze(events: DataFrame, now: str, days: int = 3) -> DataFrame:
    """Active events that didn't change for more than ``days`` full days become inactive."""
    age = F.floor((F.unix_micros(F.lit(now).cast("timestamp")) - F.unix_micros(F.col("updated_at").cast("timestamp"))) / F.lit(86400e6))
    return events.withColumn("active", F.col("active") & (age <= days))
