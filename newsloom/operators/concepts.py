"""Concepts: finding mentions, scoring them for articles, clusters and other concepts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .ranking import top_per_group


def article_scores(mentions: DataFrame, key: str = "article_id") -> DataFrame:
    """(key, slug, score): a concept's share of all mentions. One aggregation; the total is a
    window over its result, on a prefix of the same key."""
    counts = mentions.groupBy(key, "slug").agg(F.count(F.lit(1)).alias("n"))
    return counts.select(key, "slug", (F.col("n") / F.sum("n").over(Window.partitionBy(key))).alias("score"))


def concept_scores(mentions: DataFrame, commonness: DataFrame, key: str) -> DataFrame:
    """(key, slug, score): mentions less commonness, over all mentions; may be negative."""
    counts = mentions.groupBy(key, "slug").agg(F.count(F.lit(1)).alias("n")).withColumn("total", F.sum("n").over(Window.partitionBy(key)))
    common = counts.join(commonness, "slug", "left")
    return common.select(key, "slug", ((F.col("n") - F.coalesce("commonness", F.lit(0.0))) / F.col("total")).alias("score"))


def cluster_scores(scores: DataFrame, members: DataFrame, commonness: DataFrame, cluster: str, member: str) -> DataFrame:
    """(cluster, slug, score): the members' scores of a concept over those of all concepts, damped
    by commonness."""
    sums = members.select(cluster, F.col(member)).join(scores, member).groupBy(cluster, "slug").agg(F.sum("score").alias("s"))
    sums = sums.withColumn("total", F.sum("s").over(Window.partitionBy(cluster))).join(commonness, "slug", "left")
    return sums.select(cluster, "slug", (F.try_divide("s", "total") / (F.coalesce("commonness", F.lit(0.0)) + 1)).alias("score"))


def cluster_mentions(mentions: DataFrame, members: DataFrame, cluster: str, member: str) -> DataFrame:
    return members.join(mentions, member).select(cluster, "slug", "name").distinct()


def top(scores: DataFrame, key: str, k: int) -> DataFrame:
    return top_per_group(scores, key, [F.col("score").desc(), F.col("slug")], k)


def holders(scores: DataFrame, key: str) -> DataFrame:
    """(slug, key, relatedness): what a concept is mentioned in - articles, events or stories - with
    its score there."""
    return scores.select("slug", key, F.col("score").alias("relatedness"))


def related(edges: DataFrame) -> DataFrame:
    """(slug, other, relatedness): both directions of the directed edges (from_slug, slug, score)."""
    to = edges.select(F.col("from_slug").alias("slug"), F.col("slug").alias("other"), F.col("score").alias("relatedness"))
    back = edges.select("slug", F.col("from_slug").alias("other"), F.col("score").alias("relatedness"))
    return to.unionAll(back)


def conceptize(mentions: DataFrame, concepts: DataFrame, aliases: DataFrame, resolver: DataFrame, key: str = "article_id") -> dict[str, DataFrame]:
    """What new mentions (key, name) change: concepts (slug, name) and aliases (name, slug) to add,
    and the scores (key, slug, score). resolver: (name, uri)."""
    slug = F.coalesce(F.element_at(F.split("uri", "/"), -1), F.btrim(F.regexp_replace(F.lower("name"), r"[^\p{L}\p{N}]+", "-"), F.lit("-")))
    named = mentions.join(resolver, "name", "left").select(key, "name", slug.alias("slug"))
    known = named.select("slug", "name").distinct()
    new_concepts = known.groupBy("slug").agg(F.min("name").alias("name")).join(concepts, "slug", "left_anti")
    new_aliases = known.select("name", "slug").join(aliases, ["name", "slug"], "left_anti")
    return {"concepts": new_concepts, "aliases": new_aliases, "scores": article_scores(named, key)}
