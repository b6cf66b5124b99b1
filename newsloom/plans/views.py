"""The domain tables, defined over the driver's tables: once as DataFrames and once as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


class Views:
    """Lazy domain tables of one folder; Catalyst prunes what a query doesn't use."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def raw(self, name: str) -> DataFrame:
        return table(self.spark, self.dir, name)

    @property
    def article(self) -> DataFrame:
        d, e = self.raw("documents"), self.raw("events")
        return d.join(e, d.doc_id == e.event_id).select(
            d.doc_id.alias("id"),
            F.element_at(F.split(d.text, "\n"), 1).alias("title"),
            d.text,
            d.source,
            F.concat(F.lit("http://news.example.org/"), d.source, F.lit("/"), F.pmod(d.doc_id, F.lit(700)).cast("string")).alias("ext_url"),
            e.ts.alias("created_at"),
            e.value.alias("score"),
        )

    @property
    def events_articles(self) -> DataFrame:
        v, d = self.raw("embeddings"), self.raw("documents")
        return v.join(d, v.vec_id == d.doc_id, "left_semi").select(v.label.cast("long").alias("event_id"), v.vec_id.alias("article_id"))

    @property
    def event(self) -> DataFrame:
        m = self.event_members
        return m.groupBy("event_id").agg(
            F.sum("score").alias("raw_score"), F.min("created_at").alias("created_at"), F.max("created_at").alias("updated_at"), F.count(F.lit(1)).alias("num_articles")
        )

    @property
    def event_members(self) -> DataFrame:
        return self.events_articles.join(self.article, F.col("article_id") == F.col("id"))

    @property
    def stories_events(self) -> DataFrame:
        return self.event.select(F.pmod("event_id", F.lit(4)).alias("story_id"), "event_id")

    @property
    def users_stories(self) -> DataFrame:
        return self.raw("events").filter("event_type = 'signup'").select("user_id", F.pmod("user_id", F.lit(4)).alias("story_id")).distinct()

    @property
    def users_events(self) -> DataFrame:
        return self.raw("events").filter("event_type = 'click'").select("user_id", F.pmod("event_id", F.lit(10)).alias("event_id")).distinct()

    @property
    def article_mention(self) -> DataFrame:
        """A row for each mention of a concept: capitalised words of five letters or more."""
        found = F.regexp_extract_all("text", F.lit(r"(\p{Lu}\p{L}{4,})"), 1)
        return self.article.select(F.col("id").alias("article_id"), F.explode(found).alias("name")).select("article_id", F.lower("name").alias("slug"), "name")

    @property
    def page_link(self) -> DataFrame:
        """Links of pages to the pages they are about: (page_id, slug)."""
        return self.raw("pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit(r"<a href=\"/([^\"]*)\""), 1)).alias("slug"))

    @property
    def commonness(self) -> DataFrame:
        return self.page_link.groupBy(F.lower("slug").alias("slug")).agg(F.count(F.lit(1)).cast("double").alias("commonness"))

    @property
    def triples(self) -> DataFrame:
        r, n, s, c = (self.raw(x) for x in ("region", "nation", "supplier", "customer"))

        def of(df: DataFrame, kind: str, key: str, predicate: str, value) -> DataFrame:
            return df.select(F.concat(F.lit(kind), F.col(key).cast("string")).alias("s"), F.lit(predicate).alias("p"), value.cast("string").alias("o"))

        parts = [
            of(r, "r/", "r_regionkey", "label", F.col("r_name")),
            of(r, "r/", "r_regionkey", "type", F.lit("Place")),
            of(n, "n/", "n_nationkey", "label", F.col("n_name")),
            of(n, "n/", "n_nationkey", "type", F.lit("Place")),
            of(n, "n/", "n_nationkey", "inRegion", F.concat(F.lit("r/"), F.col("n_regionkey").cast("string"))),
            of(n.filter("n_nationkey % 3 = 0"), "n/", "n_nationkey", "alias", F.concat(F.lit("Land of "), F.col("n_name"))),
            of(s, "s/", "s_suppkey", "label", F.col("s_name")),
            of(s, "s/", "s_suppkey", "type", F.lit("Company")),
            of(s, "s/", "s_suppkey", "inNation", F.concat(F.lit("n/"), F.col("s_nationkey").cast("string"))),
            of(s.filter("s_suppkey % 5 = 0"), "s/", "s_suppkey", "redirects", F.concat(F.lit("s/"), (F.col("s_suppkey") - 1).cast("string"))),
            of(s.filter("s_suppkey % 2 = 0"), "s/", "s_suppkey", "abstract", F.concat(F.lit("Supplier "), F.col("s_name"))),
            of(c, "c/", "c_custkey", "customerOf", F.concat(F.lit("n/"), F.col("c_nationkey").cast("string"))),
        ]
        out = parts[0]
        for x in parts[1:]:
            out = out.unionByName(x)
        return out


def _of(table_: str, kind: str, key: str, predicate: str, value: str, where: str = "true") -> str:
    return f"select '{kind}' || {key} as s, '{predicate}' as p, {value} as o from {table_} where {where}"


#: name -> (the views it needs, its SQL)
SQL_VIEWS: dict[str, tuple[tuple[str, ...], str]] = {
    "article": (
        (),
        "select d.doc_id as id, split_part(d.text, chr(10), 1) as title, d.text, d.source, 'http://news.example.org/' || d.source || '/' || (d.doc_id % 700) as ext_url, e.ts as created_at, e.value as score "
        "from documents d join events e on e.event_id = d.doc_id",
    ),
    "events_articles": ((), "select label::bigint as event_id, vec_id as article_id from embeddings where vec_id in (select doc_id from documents)"),
    "event_members": (("article", "events_articles"), "select * from events_articles join article on article_id = id"),
    "event": (("event_members",), "select event_id, sum(score) as raw_score, min(created_at) as created_at, max(created_at) as updated_at, count(*) as num_articles from event_members group by event_id"),
    "stories_events": (("event",), "select event_id % 4 as story_id, event_id from event"),
    "users_stories": ((), "select distinct user_id, user_id % 4 as story_id from events where event_type = 'signup'"),
    "users_events": ((), "select distinct user_id, event_id % 10 as event_id from events where event_type = 'click'"),
    "article_mention": (("article",), "select article_id, lower(name) as slug, name from (select id as article_id, unnest(regexp_extract_all(text, '\\p{Lu}\\p{L}{4,}')) as name from article)"),
    "page_link": ((), "select page_id, unnest(regexp_extract_all(html, '<a href=\"/([^\"]*)\"', 1)) as slug from pages"),
    "commonness": (("page_link",), "select lower(slug) as slug, count(*)::double as commonness from page_link group by 1"),
    "triples": (
        (),
        " union all ".join(
            [
                _of("region", "r/", "r_regionkey", "label", "r_name"),
                _of("region", "r/", "r_regionkey", "type", "'Place'"),
                _of("nation", "n/", "n_nationkey", "label", "n_name"),
                _of("nation", "n/", "n_nationkey", "type", "'Place'"),
                _of("nation", "n/", "n_nationkey", "inRegion", "'r/' || n_regionkey"),
                _of("nation", "n/", "n_nationkey", "alias", "'Land of ' || n_name", "n_nationkey % 3 = 0"),
                _of("supplier", "s/", "s_suppkey", "label", "s_name"),
                _of("supplier", "s/", "s_suppkey", "type", "'Company'"),
                _of("supplier", "s/", "s_suppkey", "inNation", "'n/' || s_nationkey"),
                _of("supplier", "s/", "s_suppkey", "redirects", "'s/' || (s_suppkey - 1)", "s_suppkey % 5 = 0"),
                _of("supplier", "s/", "s_suppkey", "abstract", "'Supplier ' || s_name", "s_suppkey % 2 = 0"),
                _of("customer", "c/", "c_custkey", "customerOf", "'n/' || c_nationkey"),
            ]
        ),
    ),
}


def with_views(sql: str, *names: str) -> str:
    """``sql`` after the common table expressions it uses, in an order that lets each see its own."""
    ordered: list[str] = []

    def add(name: str) -> None:
        if name not in ordered:
            for x in SQL_VIEWS[name][0]:
                add(x)
            ordered.append(name)

    for name in names:
        add(name)
    heads = ", ".join(f"{n} as ({SQL_VIEWS[n][1]})" for n in ordered)
    return f"with {heads} {sql}" if heads else sql
