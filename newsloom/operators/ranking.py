"""Listings: filters, orders, pages and feeds over events and stories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import hot_score

PER_PAGE = 20


def page(rows: DataFrame, order: list[Column], number: int = 1, per_page: int = PER_PAGE) -> DataFrame:
    """One page of rows in a total order; the caller's order must end in a key."""
    return rows.orderBy(*order).offset((number - 1) * per_page).limit(per_page)


def with_hot_score(events: DataFrame) -> DataFrame:
    return events.withColumn("hot", hot_score(F.col("raw_score"), F.col("created_at")) + F.lit(0.0))


def trending(events: DataFrame, number: int = 1, start: str | None = None, end: str | None = None) -> DataFrame:
    """Events by hot score, highest first and those without one before all others."""
    return page(with_hot_score(in_range(events, start, end)), [F.col("hot").desc_nulls_first(), F.col("event_id")], number)


def latest(events: DataFrame, number: int = 1, start: str | None = None, end: str | None = None) -> DataFrame:
    return page(in_range(events, start, end), [F.col("created_at").desc(), F.col("event_id")], number)


def in_range(rows: DataFrame, start: str | None = None, end: str | None = None, column: str = "created_at") -> DataFrame:
    """Both ends included; a date alone means its midnight."""
    if start:
        rows = rows.filter(F.col(column) >= F.lit(start).cast("timestamp_ntz"))
    if end:
        rows = rows.filter(F.col(column) <= F.lit(end).cast("timestamp_ntz"))
    return rows


def timespan(rows: DataFrame, start: str, end: str) -> DataFrame:
    """Strictly between the two."""
    return rows.filter((F.col("created_at") > F.lit(start).cast("timestamp_ntz")) & (F.col("created_at") < F.lit(end).cast("timestamp_ntz")))


def user_feed(events: DataFrame, stories_events: DataFrame, users_stories: DataFrame) -> DataFrame:
    """(user_id, event_id, created_at): the events of a user's stories, each once."""
    watched = users_stories.join(stories_events, "story_id").select("user_id", "event_id").distinct()
    return watched.join(events.select("event_id", "created_at"), "event_id").select("user_id", "event_id", "created_at")


def clustered_only(events: DataFrame, stories_events: DataFrame) -> DataFrame:
    return events.join(stories_events, "event_id", "left_semi")


def with_members(clusters: DataFrame, links: DataFrame, key: str, least: int = 1) -> DataFrame:
    """Clusters with at least ``least`` members."""
    return clusters.join(links.groupBy(key).count().filter(F.col("count") >= least), key, "left_semi")


def without_members(clusters: DataFrame, links: DataFrame, key: str) -> DataFrame:
    return clusters.join(links, key, "left_anti")


def top_per_group(rows: DataFrame, group: str, order: list[Column], k: int) -> DataFrame:
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy(*order))).filter(F.col("rank") <= k)


def latest_of_group(rows: DataFrame, group: str, value: str, at: str, tie: str) -> DataFrame:
    """(group, value) of the newest row of each group; ties by the least ``tie``."""
    best = F.max_by(value, F.struct(F.col(at), -F.col(tie)))
    return rows.groupBy(group).agg(best.alias(value))


def active(clusters: DataFrame) -> DataFrame:
    """Clusters that aren't frozen; one that says nothing is active."""
    return clusters.filter(F.coalesce("active", F.lit(True)))


def images(members: DataFrame, group: str, image: str = "image", order: str = "id") -> DataFrame:
    """(group, images): the images that members of a group have, in the order of the members; a
    group of which none has one gets the empty list."""
    found = F.array_sort(F.collect_list(F.when(F.col(image).isNotNull(), F.struct(order, image))))
    return members.groupBy(group).agg(F.transform(found, lambda x: x[image]).alias("images"))


def by_date(rows: DataFrame, group: str, at: str, item: str) -> DataFrame:
    """(group, day, items): the items of a group by calendar day."""
    return rows.groupBy(group, F.to_date(at).alias("day")).agg(F.sort_array(F.collect_list(item)).alias("items"))


def gaps(rows: DataFrame, at: str, least_seconds: float, after: str = "2013-05-02") -> DataFrame:
    """Stretches of at least ``least_seconds`` between neighbouring times, after a date. One global
    order is needed; it is taken day by day, so that no task gets all rows: each day's first time
    is compared with the last one of the day before that has any."""
    times = rows.filter(F.col(at) > F.lit(after).cast("timestamp_ntz")).select(F.col(at).alias("t"), F.to_date(at).alias("day")).distinct()
    inside = times.select(F.lag("t").over(Window.partitionBy("day").orderBy("t")).alias("start"), F.col("t").alias("end"))
    days = times.groupBy("day").agg(F.min("t").alias("first"), F.max("t").alias("last"))  # one row a day
    between = days.select(F.lag("last").over(Window.orderBy("day")).alias("start"), F.col("first").alias("end"))
    both = inside.union(between).filter("start is not null")
    seconds = (F.unix_micros(F.col("end").cast("timestamp")) - F.unix_micros(F.col("start").cast("timestamp"))) / F.lit(1e6)
    return both.withColumn("seconds", seconds).filter(F.col("seconds") >= least_seconds)


def days_between(start: Column, days: Column) -> Column:
    """The dates from ``start`` on, one for each of ``days`` whole days."""
    n = F.floor(days).cast("int")
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), F.greatest(n, F.lit(1)) - 1), lambda k: F.date_add(start, k))).otherwise(F.array().cast("array<date>"))
