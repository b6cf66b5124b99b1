"""Ingest: parsing feed entries and keeping out what is known already."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

MIN_LENGTH = 400
IGNORED = r"^[A-Z].+\sprofile( - Overview)?"


def authors(name: Column) -> Column:
    """Names in title case: a leading "by " goes, commas part names, and so does " and " in the
    last part."""
    low = F.regexp_replace(F.lower(F.trim(name)), "^by ", "")
    parts = F.split(low, ",")
    n = F.size(parts)
    every = F.concat(F.slice(parts, 1, F.greatest(n - 1, F.lit(0))), F.split(F.concat(F.lit(" "), F.element_at(parts, -1)), " and "))
    return F.filter(F.transform(every, lambda p: F.initcap(F.trim(p))), lambda p: F.length(p) > 0)


def tags(known: Column, found: Column) -> Column:
    """The union of known tags and the terms of ``found`` (structs with a term), sorted."""
    terms = F.coalesce(F.transform(found, lambda t: t["term"]), F.array().cast("array<string>"))
    return F.sort_array(F.array_union(F.coalesce(known, F.array().cast("array<string>")), terms))


def image_extension(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"(\.[^./]+)$", 1))


def is_ignored(title: Column) -> Column:
    return F.coalesce(title.rlike(IGNORED), F.lit(False))


def long_enough(rows: DataFrame, text_col: str = "text") -> DataFrame:
    return rows.filter(F.length(text_col) >= MIN_LENGTH)


def entry_fields(entries: DataFrame) -> DataFrame:
    """Feed entries (url, canonical_url, published, publish_date, updated, entry_title, title) with
    the first of each field's sources that has a value; dates in RFC 822 form."""
    at = lambda c: F.try_to_timestamp(F.regexp_replace(c, "^[A-Za-z]{3}, ", ""), F.lit("d MMM yyyy HH:mm:ss z"))
    created = F.coalesce(at("published"), at("publish_date"))
    return entries.select(
        F.coalesce(F.nullif("canonical_url", F.lit("")), F.col("url")).alias("ext_url"),
        created.alias("created_at"),
        F.coalesce(at("updated"), created).alias("updated_at"),
        F.coalesce("entry_title", "title").alias("title"),
    )


def unseen(rows: DataFrame, existing: DataFrame) -> DataFrame:
    """Rows of a URL that no existing row has."""
    return rows.join(existing.select("ext_url"), "ext_url", "left_anti")


def ingest(rows: DataFrame, existing: DataFrame) -> DataFrame:
    """New articles: of an unknown URL, long enough, with a title that its source hasn't had; within
    the batch the first by id of each URL and of each title and source."""
    fresh = long_enough(unseen(rows, existing)).join(existing.select("title", "source").distinct(), ["title", "source"], "left_anti")
    for keys in (["ext_url"], ["title", "source"]):
        fresh = fresh.withColumn("nth", F.row_number().over(Window.partitionBy(*keys).orderBy("id"))).filter("nth = 1").drop("nth")
    return fresh.withColumn("ignore", is_ignored(F.col("title")))


def upsert_names(names: DataFrame, existing: DataFrame, key: str = "name") -> DataFrame:
    """Existing rows and the new names, each once."""
    new = names.select(key).filter(F.col(key).isNotNull()).distinct().join(existing, key, "left_anti")
    return existing.unionByName(new, allowMissingColumns=True)


def stale(feeds: DataFrame, now: str, hours: int = 1) -> DataFrame:
    """Feeds not looked at for an hour and not being looked at."""
    return feeds.filter((F.col("updated_at") < F.lit(now).cast("timestamp_ntz") - F.expr(f"interval {hours} hours")) & ~F.col("updating"))


def pick(feeds: DataFrame, seed: int = 0) -> DataFrame:
    """One of them, at random but the same for the same seed."""
    return feeds.orderBy(F.xxhash64("id", F.lit(seed)), "id").limit(1)
