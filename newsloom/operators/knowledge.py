"""Look-ups over triples (s, p, o): names, types, profiles, by joins on the subject."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def pattern(triples: DataFrame, predicate: str, subject: str, object_: str) -> DataFrame:
    """One triple pattern; the predicate reaches the scan, which prunes where it is the partition."""
    return triples.filter(F.col("p") == predicate).select(F.col("s").alias(subject), F.col("o").alias(object_))


def uri_for_name(triples: DataFrame) -> DataFrame:
    """(name, uri): what a label's resource redirects to, or itself where it redirects nowhere; of
    several the least."""
    labels, redirects = pattern(triples, "label", "uri", "name"), pattern(triples, "redirects", "uri", "target")
    to = labels.join(redirects, "uri").select("name", F.col("target").alias("uri"))
    direct = labels.join(redirects, "uri", "left_anti").select("name", "uri")
    return to.unionAll(direct).groupBy("name").agg(F.min("uri").alias("uri"))


def values(triples: DataFrame, predicate: str) -> DataFrame:
    """(uri, values): all values of a predicate, sorted."""
    return pattern(triples, predicate, "uri", "value").groupBy("uri").agg(F.sort_array(F.collect_list("value")).alias("values"))


def first_value(triples: DataFrame, predicate: str) -> DataFrame:
    return pattern(triples, predicate, "uri", "value").groupBy("uri").agg(F.min("value").alias("value"))


def knowledge_for(triples: DataFrame, predicates: tuple[str, ...] = ("abstract", "image", "label")) -> DataFrame:
    """(uri, one column for each predicate): one aggregation, no joins."""
    return triples.filter(F.col("p").isin(*predicates)).groupBy(F.col("s").alias("uri")).agg(*[F.min(F.when(F.col("p") == p, F.col("o"))).alias(p) for p in predicates])


def commonness(triples: DataFrame, predicate: str) -> DataFrame:
    return triples.filter(F.col("p") == predicate).groupBy(F.col("o").alias("uri")).agg(F.count(F.lit(1)).alias("commonness"))


def company_profile(triples: DataFrame) -> DataFrame:
    """(uri, name, nation, place): all patterns are required."""
    companies = triples.filter("p = 'type' and o = 'Company'").select(F.col("s").alias("uri"))
    return (
        companies.join(pattern(triples, "label", "uri", "name"), "uri")
        .join(pattern(triples, "inNation", "uri", "nation"), "uri")
        .join(pattern(triples, "label", "nation", "place"), "nation")
        .select("uri", "name", "nation", "place")
    )


def subsidiaries(triples: DataFrame) -> DataFrame:
    """(nation, companies): a map of URI to name."""
    rows = company_profile(triples)
    return rows.groupBy("nation").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("uri", "name")))).alias("companies"))


def place_profile(triples: DataFrame) -> DataFrame:
    """(uri, name, region, region_name, alias): the region, both patterns together, and the alias
    are optional."""
    places = triples.filter("p = 'type' and o = 'Place'").select(F.col("s").alias("uri"))
    region = pattern(triples, "inRegion", "uri", "region").join(pattern(triples, "label", "region", "region_name"), "region")
    return (
        places.join(pattern(triples, "label", "uri", "name"), "uri")
        .join(region, "uri", "left")
        .join(pattern(triples, "alias", "uri", "alias"), "uri", "left")
        .select("uri", "name", "region", "region_name", "alias")
    )


def profile_kind(triples: DataFrame) -> DataFrame:
    """(uri, kind): Company before Place, else null."""
    types = values(triples, "type")
    kind = F.when(F.array_contains("values", "Company"), F.lit("Company")).when(F.array_contains("values", "Place"), F.lit("Place"))
    return types.select("uri", kind.alias("kind"))


def photo_radius(kind: str = "kind"):
    """How far around a place photographs count, in km."""
    return F.when(F.col(kind) == "Country", 20).when(F.col(kind) == "City", 10).otherwise(5)
