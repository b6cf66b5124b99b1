"""Users: what they watch and bookmark, and merging two accounts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def add_link(links: DataFrame, new: DataFrame) -> DataFrame:
    return links.unionByName(new.join(links, links.columns, "left_anti").distinct())


def remove_link(links: DataFrame, gone: DataFrame) -> DataFrame:
    return links.join(gone, links.columns, "left_anti")


def has_link(links: DataFrame, asked: DataFrame) -> DataFrame:
    """The asked links with ``linked``, whether they are there."""
    return asked.join(links.distinct().withColumn("found", F.lit(True)), links.columns, "left").select(*links.columns, F.coalesce("found", F.lit(False)).alias("linked"))


def merge(auths: DataFrame, survivor: int, other: int) -> DataFrame:
    """Auths (id, user_id, provider) after merging: the other's move to the survivor unless it has
    one with that provider; those stay behind."""
    mine = auths.filter(F.col("user_id") == survivor).select("provider").distinct()
    moved = auths.filter(F.col("user_id") == other).join(mine, "provider", "left_anti").select("id").withColumn("moved", F.lit(True))
    return auths.join(moved, "id", "left").select("id", F.when(F.col("moved"), F.lit(survivor)).otherwise(F.col("user_id")).cast("long").alias("user_id"), "provider")
