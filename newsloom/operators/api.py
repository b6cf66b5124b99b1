"""The nested documents that readers of the data get, as JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import iso_datetime


def article_documents(articles: DataFrame) -> DataFrame:
    """(id, json)."""
    body = F.struct("id", "title", "source", F.col("ext_url").alias("url"), iso_datetime(F.col("created_at")).alias("created_at"), F.concat(F.lit("/articles/"), F.col("id").cast("string")).alias("self"))
    return articles.select("id", F.to_json(body).alias("json"))


def event_documents(events: DataFrame, members: DataFrame, concepts: DataFrame) -> DataFrame:
    """(event_id, json) with nested articles and concepts; concepts without a name are left out."""
    articles = members.groupBy("event_id").agg(F.sort_array(F.collect_list(F.struct("id", "title", "ext_url"))).alias("articles"))
    named = concepts.filter("slug is not null").groupBy("event_id").agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("order"), "slug", "score"))).alias("c"))
    rows = events.join(articles, "event_id", "left").join(named, "event_id", "left")
    body = F.struct(
        F.col("event_id").alias("id"), "num_articles", iso_datetime(F.col("updated_at")).alias("updated_at"), "articles", F.transform("c", lambda x: F.struct(x["slug"].alias("slug"), x["score"].alias("score"))).alias("concepts")
    )
    return rows.select("event_id", F.to_json(body).alias("json"))


def story_documents(stories: DataFrame, links: DataFrame) -> DataFrame:
    """(story_id, json) with the ids of the story's events. stories: (story_id, title, image,
    updated_at), links: (story_id, event_id)."""
    events = links.groupBy("story_id").agg(F.sort_array(F.collect_set("event_id")).alias("events"))
    body = F.struct(F.col("story_id").alias("id"), "title", "image", iso_datetime(F.col("updated_at")).alias("updated_at"), "events", F.concat(F.lit("/stories/"), F.col("story_id").cast("string")).alias("self"))
    return stories.join(events, "story_id", "left").select("story_id", F.to_json(body).alias("json"))


def concept_documents(concepts: DataFrame, holders: DataFrame) -> DataFrame:
    """(slug, json) of concepts (slug, name), those without a name left out, with the events they
    are in, (slug, event_id, relatedness), the most related first."""
    order = F.array_sort(F.collect_list(F.struct((-F.col("relatedness")).alias("order"), "event_id", "relatedness")))
    events = holders.groupBy("slug").agg(F.transform(order, lambda x: F.struct(x["event_id"].alias("id"), x["relatedness"].alias("relatedness"))).alias("events"))
    body = F.struct("slug", "name", "events", F.concat(F.lit("/concepts/"), F.col("slug")).alias("self"))
    return concepts.filter("name is not null").join(events, "slug", "left").select("slug", F.to_json(body).alias("json"))


def named_documents(rows: DataFrame, kind: str) -> DataFrame:
    """(id, json) of what has an id and a name alone: authors, sources and users."""
    body = F.struct("id", "name", F.concat(F.lit(f"/{kind}/"), F.col("id").cast("string")).alias("self"))
    return rows.select("id", F.to_json(body).alias("json"))


def preview(events: DataFrame, members: DataFrame, n: int = 10) -> DataFrame:
    """The first n events by id with their members."""
    return events.orderBy("event_id").limit(n).select("event_id").join(members, "event_id")
