"""The registry: each operator as a query over the driver's tables, with its equivalent in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import text as T
from .operators import api, clusters, concepts, ingest, knowledge, ranking, search, summarize, users, web
from .plans.views import Views, with_views
from .sources import readers

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

HOT = "round(log10(greatest(abs(raw_score), 1.0)) + sign(raw_score) * (epoch_us(created_at) / 1e6 - 1134028003.0) / 45000.0, 7) + 0.0"
STOPS = ", ".join(f"'{w}'" for w in T.STOP_WORDS)
R6 = "round({}, 6) + 0.0"


def query(name: str, sql: str | None = None, *views: str) -> Callable:
    def register(function: Callable[[Views], DataFrame]) -> Callable[[Views], DataFrame]:
        QUERIES[name] = lambda spark, sf_dir: function(Views(spark, sf_dir))
        if sql:
            ORACLE_SQL[name] = with_views(sql, *views)
        return function

    return register


def r6(column) -> F.Column:
    return F.round(column, 6) + F.lit(0.0)


def joined(column, by: str = ",") -> F.Column:
    return F.array_join(F.col(column).cast("array<string>") if isinstance(column, str) else column.cast("array<string>"), by)


def words_sql(text: str) -> str:
    return f"list_filter(regexp_extract_all(lower({text}), '[\\p{{L}}\\p{{N}}]+'), lambda w: w not in ({STOPS}))"


# --- feeds and listings ------------------------------------------------------------------------

EVENT_OUT = "event_id, round(raw_score, 6) as raw_score, created_at"


@query("trending", f"select {EVENT_OUT}, {HOT} as hot from event order by hot desc nulls first, event_id limit 20", "event")
def _(v):
    return ranking.trending(v.event.select("event_id", r6("raw_score").alias("raw_score"), "created_at"))


@query("trending_range", f"select {EVENT_OUT}, {HOT} as hot from event where created_at >= '2024-01-01' and created_at <= '2024-01-01 01:00:00' order by hot desc nulls first, event_id limit 20", "event")
def _(v):
    return ranking.trending(v.event.select("event_id", r6("raw_score").alias("raw_score"), "created_at"), 1, "2024-01-01", "2024-01-01 01:00:00")


@query("latest", f"select {EVENT_OUT} from event order by created_at desc, event_id limit 20", "event")
def _(v):
    return ranking.latest(v.event.select("event_id", r6("raw_score").alias("raw_score"), "created_at"))


@query("articles_page_2", "select id, title, created_at from article order by created_at desc, id limit 20 offset 20", "article")
def _(v):
    return ranking.page(v.article.select("id", "title", "created_at"), [F.col("created_at").desc(), F.col("id")], 2)


@query("listing_count", "select count(*) as total_count from event", "event")
def _(v):
    return v.event.agg(F.count(F.lit(1)).alias("total_count"))


@query("user_feed", "select distinct user_id, event_id, created_at from users_stories join stories_events using (story_id) join event using (event_id)", "users_stories", "stories_events")
def _(v):
    return ranking.user_feed(v.event, v.stories_events, v.users_stories)


@query("clustered_events", "select event_id, num_articles from event where event_id in (select event_id from stories_events)", "stories_events")
def _(v):
    return ranking.clustered_only(v.event, v.stories_events).select("event_id", "num_articles")


@query("bookmarks", "select user_id, event_id, round(raw_score, 6) + 0.0 as raw_score from users_events join event using (event_id)", "users_events", "event")
def _(v):
    return v.users_events.join(v.event, "event_id").select("user_id", "event_id", r6("raw_score").alias("raw_score"))


@query("point_lookup", "select id, title, source, ext_url from article where id = 17", "article")
def _(v):
    return v.article.filter("id = 17").select("id", "title", "source", "ext_url")


@query("sources_by_name", "select source as name, count(*) as num_articles from article group by source order by name", "article")
def _(v):
    return v.article.groupBy(F.col("source").alias("name")).agg(F.count(F.lit(1)).alias("num_articles")).orderBy("name")


@query("oldest_unclustered", "select id, created_at from article where id not in (select article_id from events_articles) order by created_at, id limit 100", "article", "events_articles")
def _(v):
    rest = v.article.join(v.events_articles, F.col("id") == F.col("article_id"), "left_anti")
    return rest.select("id", "created_at").orderBy("created_at", "id").limit(100)


@query("unclustered_count", "select count(*) as remaining from article where id not in (select article_id from events_articles)", "article", "events_articles")
def _(v):
    return v.article.join(v.events_articles, F.col("id") == F.col("article_id"), "left_anti").agg(F.count(F.lit(1)).alias("remaining"))


@query("iso_dates", "select id, regexp_replace(strftime(created_at, '%Y-%m-%dT%H:%M:%S.%f'), '\\.000000$', '') as created from article", "article")
def _(v):
    return v.article.select("id", T.iso_datetime(F.col("created_at")).alias("created"))


@query(
    "event_json",
    "select event_id, count(*) as num_articles, string_agg(id::varchar, ',' order by id) as article_ids from event_members group by event_id",
    "event_members",
)
def _(v):
    return v.event_members.groupBy("event_id").agg(F.count(F.lit(1)).alias("num_articles"), joined(F.sort_array(F.collect_list("id"))).alias("article_ids"))


# --- clusters ----------------------------------------------------------------------------------


@query("event_members", "select event_id, id, title from event_members", "event_members")
def _(v):
    return v.event_members.select("event_id", "id", "title")


@query("event_raw_score", "select event_id, round(raw_score, 6) + 0.0 as raw_score, num_articles from event", "event")
def _(v):
    return v.event.select("event_id", r6("raw_score").alias("raw_score"), "num_articles")


@query("min_articles", "select event_id from event where num_articles >= 52", "event")
def _(v):
    return ranking.with_members(v.event, v.events_articles, "event_id", 52).select("event_id")


@query("story_events", "select story_id, event_id, created_at from stories_events join event using (event_id)", "stories_events")
def _(v):
    return v.stories_events.join(v.event, "event_id").select("story_id", "event_id", "created_at")


@query(
    "story_events_by_date",
    "select story_id, created_at::date::varchar as day, string_agg(event_id::varchar, ',' order by event_id) as items from stories_events join event using (event_id) group by 1, 2",
    "stories_events",
)
def _(v):
    days = ranking.by_date(v.stories_events.join(v.event, "event_id"), "story_id", "created_at", "event_id")
    return days.select("story_id", F.col("day").cast("string").alias("day"), joined("items").alias("items"))


@query("event_latest_title", "select event_id, arg_max(title, (created_at, -id)) as title from event_members group by event_id", "event_members")
def _(v):
    return ranking.latest_of_group(v.event_members, "event_id", "title", "created_at", "id")


@query("events_before", "select event_id from event where created_at <= '2024-01-01 00:30:00'", "event")
def _(v):
    return ranking.in_range(v.event, None, "2024-01-01 00:30:00").select("event_id")


@query("events_after", "select event_id from event where created_at >= '2024-01-01 00:10:00'", "event")
def _(v):
    return ranking.in_range(v.event, "2024-01-01 00:10:00").select("event_id")


@query("timespan", "select id, created_at from article where created_at > '2024-01-01' and created_at < '2024-01-02'", "article")
def _(v):
    return ranking.timespan(v.article, "2024-01-01", "2024-01-02").select("id", "created_at")


@query("member_sources", "select event_id, string_agg(distinct source, ',' order by source) as sources from event_members where source is not null group by event_id", "event_members")
def _(v):
    return v.event_members.groupBy("event_id").agg(joined(F.sort_array(F.collect_set("source"))).alias("sources"))


_NEW = "select (label + (vec_id % 5 = 0)::int)::bigint as new_id, vec_id as member from embeddings"
_OLD = "select label::bigint as old_id, vec_id as member from embeddings"


def _old_new(v: Views) -> tuple[DataFrame, DataFrame]:
    e = v.raw("embeddings")
    return e.select(F.col("label").cast("long").alias("old_id"), F.col("vec_id").alias("member")), e.select((F.col("label") + F.when(F.col("vec_id") % 5 == 0, 1).otherwise(0)).cast("long").alias("new_id"), F.col("vec_id").alias("member"))


@query(
    "triage_pairs",
    f"with o as ({_OLD}), n as ({_NEW}), na as (select old_id, count(*) as a from o group by 1), nb as (select new_id, count(*) as b from n group by 1), "
    "c as (select old_id, new_id, count(*) as k from o join n using (member) group by 1, 2) "
    "select old_id, new_id, round(2.0 * k / (a + b), 6)::double as ratio from c join na using (old_id) join nb using (new_id) where 2.0 * k / (a + b) >= 0.5",
)
def _(v):
    return clusters.triage_pairs(*_old_new(v)).select("old_id", "new_id", r6("ratio").alias("ratio"))


@query("triage")
def _(v):
    return clusters.triage(*_old_new(v))


@query("triage_applied")
def _(v):
    old, new = _old_new(v)
    states = v.event.select(F.col("event_id").alias("old_id"), "updated_at")
    return clusters.apply_triage(clusters.triage(old, new), states, new, "2024-01-20 00:00:00")[0]


@query(
    "representative_article",
    "with x as (select label::bigint as event_id, vec_id, unnest(embedding)::double as x, generate_subscripts(embedding, 1) as k from embeddings), c as (select event_id, k, avg(x) as c from x group by 1, 2), "
    "d as (select event_id, vec_id, round(sum((x - c) ** 2), 9) as d from x join c using (event_id, k) group by 1, 2) select event_id, arg_min(vec_id, (d, vec_id)) as vec_id from d group by 1",
)
def _(v):
    return clusters.representative(v.raw("embeddings").select(F.col("label").cast("long").alias("event_id"), "vec_id", "embedding"), "event_id", "vec_id", "embedding")


_COS = "list_dot_product(x.embedding::double[], y.embedding::double[]) / sqrt(list_dot_product(x.embedding::double[], x.embedding::double[]) * list_dot_product(y.embedding::double[], y.embedding::double[]))"


@query("cosine_pairs", f"select x.vec_id as a, y.vec_id as b, round({_COS}, 5) + 0.0 as similarity from embeddings x join embeddings y on x.label = y.label and x.vec_id < y.vec_id where {_COS} >= 0.1")
def _(v):
    e = v.raw("embeddings").select("label", F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    return clusters.similar_pairs(e, 0.1, "label").select("a", "b", (F.round("similarity", 5) + F.lit(0.0)).alias("similarity"))


_COMPONENTS = f"with recursive e as (select x.vec_id as a, y.vec_id as b from embeddings x join embeddings y on x.label = y.label and x.vec_id <> y.vec_id where {_COS} >= 0.2), reach as (select vec_id as id, vec_id as m from embeddings union select r.id, e.b from reach r join e on r.m = e.a) select id, min(m) as cluster from reach group by id"


@query("cluster_components", _COMPONENTS)
def _(v):
    e = v.raw("embeddings").select("label", F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    return clusters.similar_components(e, 0.2, "label")


@query("stories_without_events", "select s.story_id from (select distinct user_id % 7 as story_id from events) s where s.story_id not in (select story_id from stories_events)", "stories_events")
def _(v):
    stories = v.raw("events").select(F.pmod("user_id", F.lit(7)).alias("story_id")).distinct()
    return ranking.without_members(stories, v.stories_events, "story_id")


@query("normalised_vectors", "select vec_id, round(list_aggregate(list_transform(embedding, lambda x: (x::double / sqrt(list_dot_product(embedding::double[], embedding::double[]))) ** 2), 'sum'), 6) as norm from embeddings")
def _(v):
    n = T.normalise(F.col("embedding"))
    return v.raw("embeddings").select("vec_id", F.round(T.dot(n, n), 6).alias("norm"))


@query(
    "weighted_vectors",
    "select vec_id, round(list_sum(list_transform(embedding, lambda x: x::double * 400.0::double)) + list_sum(list_transform(embedding, lambda x: x::double * 90.0::double)), 3) + 0.0 as total, 2 * len(embedding) as n from embeddings",
)
def _(v):
    w = T.weighted([(F.col("embedding"), 400.0), (F.col("embedding"), 90.0)])
    return v.raw("embeddings").select("vec_id", (F.round(F.aggregate(w, F.lit(0.0), lambda a, x: a + x), 3) + F.lit(0.0)).alias("total"), F.size(w).cast("long").alias("n"))


# --- concepts ----------------------------------------------------------------------------------

_ARTICLE_SCORES = "select article_id, slug, count(*) / sum(count(*)) over (partition by article_id) as score from article_mention group by article_id, slug"


@query("article_concept_scores", f"select article_id, slug, {R6.format('score')} as score from ({_ARTICLE_SCORES})", "article_mention")
def _(v):
    return concepts.article_scores(v.article_mention).select("article_id", "slug", r6("score").alias("score"))


@query(
    "concept_concept_scores",
    "select page_id, slug, round((n - coalesce(commonness, 0)) / total, 6) + 0.0 as score from (select page_id, lower(slug) as slug, count(*) as n, sum(count(*)) over (partition by page_id) as total from page_link group by 1, 2) left join commonness using (slug)",
    "page_link",
    "commonness",
)
def _(v):
    links = v.page_link.select("page_id", F.lower("slug").alias("slug"))
    return concepts.concept_scores(links, v.commonness, "page_id").select("page_id", "slug", r6("score").alias("score"))


_EVENT_SCORES = (
    f"select event_id, slug, (s / nullif(sum(s) over (partition by event_id), 0)) / (coalesce(commonness, 0) + 1) as score from (select event_id, slug, sum(score) as s from events_articles join ({_ARTICLE_SCORES}) using (article_id) group by 1, 2) left join commonness using (slug)"
)


def _event_scores(v: Views) -> DataFrame:
    return concepts.cluster_scores(concepts.article_scores(v.article_mention), v.events_articles, v.commonness, "event_id", "article_id")


@query("event_concept_scores", f"select event_id, slug, round(score, 9) + 0.0 as score from ({_EVENT_SCORES})", "events_articles", "article_mention", "commonness")
def _(v):
    return _event_scores(v).select("event_id", "slug", (F.round("score", 9) + F.lit(0.0)).alias("score"))


@query(
    "top_concepts",
    f"select event_id, slug, rank from (select event_id, slug, row_number() over (partition by event_id order by round(score, 9) desc, slug) as rank from ({_EVENT_SCORES})) where rank <= 10",
    "events_articles",
    "article_mention",
    "commonness",
)
def _(v):
    scores = _event_scores(v).withColumn("score", F.round("score", 9))
    return concepts.top(scores, "event_id", 10).select("event_id", "slug", F.col("rank").cast("long").alias("rank"))


@query("event_mentions", "select distinct event_id, slug, name from events_articles join article_mention using (article_id)", "events_articles", "article_mention")
def _(v):
    return concepts.cluster_mentions(v.article_mention, v.events_articles, "event_id", "article_id")


@query(
    "related_concepts",
    "with e as (select 'p' || page_id as from_slug, lower(slug) as slug, count(*)::double as score from page_link group by 1, 2) select from_slug as slug, slug as other, score as relatedness from e union all select slug, from_slug as other, score as relatedness from e".replace("with e", "e"),
    "page_link",
)
def _(v):
    edges = v.page_link.groupBy(F.concat(F.lit("p"), F.col("page_id").cast("string")).alias("from_slug"), F.lower("slug").alias("slug")).agg(F.count(F.lit(1)).cast("double").alias("score"))
    return concepts.related(edges)


# with_views puts its own WITH first; the edges above are one more of its expressions
ORACLE_SQL["related_concepts"] = ORACLE_SQL["related_concepts"].replace(") e as (", "), e as (")


@query("commonness", "select slug, commonness from commonness", "commonness")
def _(v):
    return v.commonness


@query(
    "conceptize_new_concepts",
    "select slug, min(name) as name from article_mention where slug not in (select lower(slug) from page_link) group by slug",
    "article_mention",
    "page_link",
)
def _(v):
    known = v.page_link.select(F.lower("slug").alias("slug")).distinct()
    aliases = v.spark.createDataFrame([], "name string, slug string")
    resolver = v.article_mention.select("name", F.concat(F.lit("http://kb.example.org/"), F.lower("name")).alias("uri")).distinct()
    return concepts.conceptize(v.article_mention.select("article_id", "name"), known, aliases, resolver)["concepts"]


@query("concept_aliases", "select r.s as uri, string_agg(a.o, ',' order by a.o) as aliases from (select distinct s from triples where p = 'type') r left join (select * from triples where p = 'alias') a using (s) where a.o is not null group by r.s", "triples")
def _(v):
    return knowledge.values(v.triples, "alias").select("uri", joined("values").alias("aliases"))


@query("preview", "select event_id, id, title from event_members where event_id in (select event_id from event order by event_id limit 3)", "event_members", "event")
def _(v):
    return api.preview(v.event, v.event_members, 3).select("event_id", "id", "title")


_ISO = "regexp_replace(strftime(created_at, '%Y-%m-%dT%H:%M:%S.%f'), '\\.000000$', '')"


@query("article_documents", f"select id, to_json({{'id': id, 'title': title, 'source': source, 'url': ext_url, 'created_at': {_ISO}, 'self': '/articles/' || id}})::varchar as json from article", "article")
def _(v):
    return api.article_documents(v.article)


@query("event_documents")
def _(v):
    return api.event_documents(v.event, v.event_members, concepts.top(_event_scores(v), "event_id", 10))


@query("recluster")
def _(v):
    e = v.raw("embeddings").select("label", F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    return clusters.recluster(e, "label", 0.3, 0.2)[1]


@query(
    "natural_dates",
    "select id, case when d = 0 then 'today' when d = 1 then 'yesterday' when d > 365 then strftime(t, '%b %d %Y') else strftime(t, '%b %d') end as day "
    "from (select id, t, datediff('day', t, timestamp '2024-01-02') as d from (select id, created_at - to_days((id % 500)::int) as t from article))",
    "article",
)
def _(v):
    rows = v.article.select("id", F.expr("created_at - make_dt_interval(id % 500)").alias("at"))
    return rows.select("id", T.natural_date(F.col("at"), F.lit("2024-01-02").cast("timestamp_ntz")).alias("day"))


@query("auth_ids")
def _(v):
    return v.raw("events").select("event_id", T.auth_id(F.col("event_type"), F.col("user_id").cast("string")).alias("auth_id"))


@query("json_counters", "select event_id, coalesce(try_cast(json_extract_string(props, '$.k') as double), 0)::double as n from events")
def _(v):
    return v.raw("events").select("event_id", T.json_count(F.col("props"), "$.k").alias("n"))


@query("active_events", "select event_id from event where event_id % 3 <> 0", "event")
def _(v):
    return ranking.active(v.event.withColumn("active", F.when(F.col("event_id") % 3 == 0, F.lit(False)))).select("event_id")


_IMAGED = "select *, case when id % 3 > 0 then ext_url || '/' || id || '.png' end as image from event_members"


def _imaged(v: Views) -> DataFrame:
    return v.event_members.withColumn("image", F.when(F.col("id") % 3 > 0, F.concat("ext_url", F.lit("/"), F.col("id").cast("string"), F.lit(".png"))))


@query("event_images", f"select event_id, coalesce(string_agg(image, ',' order by id), '') as images from ({_IMAGED}) group by event_id", "event_members")
def _(v):
    return ranking.images(_imaged(v), "event_id").select("event_id", joined("images").alias("images"))


@query("concept_events", f"select slug, event_id, round(score, 9) + 0.0 as relatedness from ({_EVENT_SCORES})", "events_articles", "article_mention", "commonness")
def _(v):
    return concepts.holders(_event_scores(v), "event_id").select("slug", "event_id", (F.round("relatedness", 9) + F.lit(0.0)).alias("relatedness"))


@query("concept_articles", f"select slug, article_id, {R6.format('score')} as relatedness from ({_ARTICLE_SCORES})", "article_mention")
def _(v):
    return concepts.holders(concepts.article_scores(v.article_mention), "article_id").select("slug", "article_id", r6("relatedness").alias("relatedness"))


def _labelled_events(v: Views) -> DataFrame:
    members = _imaged(v)
    nearest = members.groupBy("event_id").agg(F.min("id").alias("id"))  # stands for the representatives
    return clusters.event_labels(members, nearest).join(v.event.select("event_id", "updated_at"), "event_id")


_LABELLED = f"select event_id, arg_min(title, id) as title, list_first(list(image order by id)) as image, max(created_at) as updated_at from ({_IMAGED}) group by event_id"
_STORY_LABELS = f"select story_id, x.title as title, x.image as image, x.updated_at as updated_at from (select story_id, arg_max({{'title': title, 'image': image, 'updated_at': updated_at}}, (updated_at, -event_id)) as x from stories_events join ({_LABELLED}) using (event_id) group by story_id)"


@query("event_labels", f"select event_id, title, image, updated_at from ({_LABELLED})", "event_members")
def _(v):
    return _labelled_events(v).select("event_id", "title", "image", "updated_at")


@query("story_labels", _STORY_LABELS, "stories_events", "event_members")
def _(v):
    return clusters.story_labels(v.stories_events, _labelled_events(v))


@query("source_documents", "select id, to_json({'id': id, 'name': name, 'self': '/sources/' || id})::varchar as json from (select r_regionkey as id, r_name as name from region)")
def _(v):
    return api.named_documents(v.raw("region").select(F.col("r_regionkey").alias("id"), F.col("r_name").alias("name")), "sources")


# --- text --------------------------------------------------------------------------------------


def _string_query(name: str, expression: str, function: Callable) -> None:
    @query(name, f"select id, {expression} as value from article", "article")
    def _(v):
        return v.article.select("id", function(F.col("text")).alias("value"))


_QUOTED = T.PUNCTUATION.replace("'", "''")
_string_query("trim", "trim(regexp_replace(text, '\\s+', ' ', 'g'))", T.collapse)
_string_query("depunctuate", f"translate(text, '{_QUOTED}', '{' ' * len(T.PUNCTUATION)}')", T.depunctuate)
_string_query("strip", f"trim(text, '{_QUOTED}')", T.strip_punctuation)
_string_query("slugify", "trim(regexp_replace(lower(text), '[^\\p{L}\\p{N}]+', '-', 'g'), '-')", T.slugify)
_string_query("quote_uri", "replace(text, '\"', '%22')", T.quote_uri)
_string_query("tokens", f"array_to_string({words_sql('text')}, ' ')", lambda c: joined(T.tokens(c), " "))

_SENTENCES = "list_filter(string_split(regexp_replace(trim(text, ' '), '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda s: length(s) > 0)"


@query("sentences", f"select id, len({_SENTENCES}) as n, list_sum(list_transform({_SENTENCES}, lambda s: length(s))) as chars from article", "article")
def _(v):
    s = T.sentences(F.col("text"))
    return v.article.select("id", F.size(s).cast("long").alias("n"), F.when(F.size(s) > 0, F.aggregate(s, F.lit(0).cast("long"), lambda a, x: a + F.length(x))).alias("chars"))


_KEYWORDS = (
    f"select id, word, n / total * 1.5 + 1 as weight, row_number() over (partition by id order by n desc, word) as rank from (select id, word, count(*) as n, any_value(total) as total from (select id, "
    f"len(list_filter(string_split(regexp_replace(text, '[^\\p{{L}}\\p{{N}}_ ]', '', 'g'), ' '), lambda w: length(w) > 0)) as total, unnest({words_sql('text')}) as word from article) group by id, word)"
)


@query("keywords", f"select id, word, round(weight, 6) as weight from ({_KEYWORDS}) where rank <= 10", "article")
def _(v):
    return summarize.keywords(v.article).select("id", "word", F.round("weight", 6).alias("weight"))


_POSITIONS = "case " + " ".join(f"when pos * 10 <= n * {k} then {x}" for k, x in enumerate((0.17, 0.23, 0.14, 0.08, 0.05, 0.04, 0.06, 0.04, 0.04, 0.15), 1)) + " else 0 end"
_ROWS = f"select id, title, unnest(s) as sentence, generate_subscripts(s, 1) as pos, len(s) as n from (select id, title, {_SENTENCES} as s from article)"
_FEATURES = (
    f"select id, pos, round(1 - abs(20 - len(words)) / 20.0::double, 6) as length_score, ({_POSITIONS})::double as position_score, "
    f"round(len(list_filter(words, lambda w: list_contains(title_words, w))) / nullif(len(title_words), 0)::double, 6) as title_score "
    f"from (select id, pos, n, {words_sql('sentence')} as words, {words_sql('title')} as title_words from ({_ROWS}))"
)


@query("sentence_features", _FEATURES, "article")
def _(v):
    rows = summarize.sentence_features(v.article)
    return rows.select(
        "id", F.col("pos").cast("long").alias("pos"), F.round("length_score", 6).alias("length_score"), "position_score", F.round("title_score", 6).alias("title_score")
    )


@query("summarize")
def _(v):
    return summarize.summarize(v.article)


@query("multi_summarize")
def _(v):
    return summarize.multi_summarize(v.event_members, "event_id", "id")


@query("cluster_summaries")
def _(v):
    return summarize.cluster_summary(v.event_members, "event_id")


@query("summary_provenance")
def _(v):
    return summarize.provenance(summarize.multi_summarize(v.event_members, "event_id", "id"), v.event_members, "event_id")


@query("event_text", "select event_id, string_agg(title, ' ' order by id) as text from event_members group by event_id", "event_members")
def _(v):
    pairs = F.array_sort(F.collect_list(F.struct("id", "title")))
    return v.event_members.groupBy("event_id").agg(F.array_join(F.transform(pairs, lambda p: p["title"]), " ").alias("text"))


_LINKED = "regexp_replace({0}, ' {1}', ' <a href=\"/concepts/{1}\">{1}</a>', 'g')"


@query("highlight", f"select id, {_LINKED.format(_LINKED.format('title', 'then'), 'the')} as title from article", "article")
def _(v):
    return v.article.select("id", T.highlight(F.col("title"), F.array(F.lit("the"), F.lit("then"))).alias("title"))


@query("format_bytes", "select doc_id, case when n_chars < 1024 then printf('%.1f bytes', n_chars::double) else printf('%.1f KB', n_chars / 1024.0::double) end as size from documents where n_chars < 1000000")
def _(v):
    return v.raw("documents").filter("n_chars < 1000000").select("doc_id", T.format_bytes(F.col("n_chars")).alias("size"))


@query("currency", "select o_orderkey, '$' || format('{:,.2f}', o_totalprice) as price from orders where o_totalprice * 100 = round(o_totalprice * 100)")
def _(v):
    return v.raw("orders").filter("o_totalprice * 100 = round(o_totalprice * 100)").select("o_orderkey", T.currency(F.col("o_totalprice")).alias("price"))


@query("published_seconds", "select id, epoch_us(created_at) / 1e6 as published from article", "article")
def _(v):
    return v.article.select("id", (F.unix_micros(F.col("created_at").cast("timestamp")) / F.lit(1e6)).alias("published"))


@query("hot_scores", "select id, round(log10(greatest(abs(score), 1.0)) + sign(score) * (epoch_us(created_at) / 1e6 - 1134028003.0) / 45000.0, 7) + 0.0 as hot from article", "article")
def _(v):
    return v.article.select("id", (T.hot_score(F.col("score"), F.col("created_at")) + F.lit(0.0)).alias("hot"))


@query("flatten_bindings", "select event_id, json_extract_string(props, '$.k') as k, event_type as kind from events")
def _(v):
    bound = F.struct(*[F.struct(F.lit("literal").alias("type"), x.alias("value")).alias(n) for n, x in (("k", F.get_json_object("props", "$.k")), ("kind", F.col("event_type")))])
    rows = v.raw("events").select("event_id", T.flatten_bindings(F.to_json(bound)).alias("m"))
    return rows.select("event_id", F.try_element_at("m", F.lit("k")).alias("k"), F.try_element_at("m", F.lit("kind")).alias("kind"))


@query("split_scopes", "select event_id, array_to_string(list_filter(string_split(event_type || '  ' || user_id || ' ', ' '), lambda x: x <> ''), ',') as scopes from events")
def _(v):
    scopes = F.concat(F.col("event_type"), F.lit("  "), F.col("user_id").cast("string"), F.lit(" "))
    return v.raw("events").select("event_id", joined(T.split_scopes(scopes)).alias("scopes"))


# --- search ------------------------------------------------------------------------------------

_TABLES = "select 'article' as type, id, title, text as summary from article union all select 'page' as type, page_id as id, url as title, html as summary from pages"
_WORD_LIST = "regexp_extract_all(lower({}), '[\\p{{L}}\\p{{N}}]+')"


def _tables(v: Views) -> dict[str, DataFrame]:
    return {
        "article": v.article.select("id", "title", F.col("text").alias("summary")),
        "page": v.raw("pages").select(F.col("page_id").alias("id"), F.col("url").alias("title"), F.col("html").alias("summary")),
    }


def _has(column: str, *terms: str) -> str:
    return " and ".join(f"list_contains({_WORD_LIST.format(column)}, '{t}')" for t in terms)


@query("search_match", f"select type, id from ({_TABLES}) where ({_has('title', 'license', 'version')}) or ({_has('summary', 'license', 'version')})", "article")
def _(v):
    return search.search(_tables(v), "the license of a version").select("type", "id")


_RANKED = f"select type, id, round(len(list_filter({_WORD_LIST.format('summary')}, lambda w: w = 'disgusting')) * 0.1, 6)::double as rank from ({_TABLES}) where ({_has('title', 'disgusting')}) or ({_has('summary', 'disgusting')})"


@query("search_rank", _RANKED, "article")
def _(v):
    return search.search(_tables(v), "disgusting").select("type", "id", "rank")


@query("search_count", f"select count(*) as total_count from ({_TABLES}) where type = 'article' and (({_has('title', 'disgusting', 'trash')}) or ({_has('summary', 'disgusting', 'trash')}))", "article")
def _(v):
    return search.search_count(_tables(v), "the disgusting trash", ["article"])


@query("search_page", f"select * from ({_RANKED}) order by rank desc nulls first, type, id limit 20", "article")
def _(v):
    return search.search_page(_tables(v), "disgusting", None, 1).select("type", "id", "rank")


# --- ingest ------------------------------------------------------------------------------------


@query("min_length", "select id from article where length(text) >= 400", "article")
def _(v):
    return ingest.long_enough(v.article).select("id")


@query("dedup_url", "select id, ext_url from article where id % 3 <> 0 and ext_url not in (select ext_url from article where id % 3 = 0)", "article")
def _(v):
    return ingest.unseen(v.article.filter("id % 3 <> 0"), v.article.filter("id % 3 = 0")).select("id", "ext_url")


@query(
    "ingest",
    "select id from (select *, row_number() over (partition by title, source order by id) as k2 from (select *, row_number() over (partition by ext_url order by id) as k1 from article a where id % 3 <> 0 and length(text) >= 400 "
    "and ext_url not in (select ext_url from article where id % 3 = 0) and not exists (select 1 from article b where b.id % 3 = 0 and b.title = a.title and b.source = a.source)) where k1 = 1) where k2 = 1",
    "article",
)
def _(v):
    return ingest.ingest(v.article.filter("id % 3 <> 0"), v.article.filter("id % 3 = 0")).select("id")


@query(
    "authors",
    "select o_orderkey, array_to_string(authors_, ',') as authors from (select o_orderkey, list_filter(list_transform(list_concat(list_slice(p, 1, len(p) - 1), string_split(' ' || p[-1], ' and ')), lambda x: trim(x)), lambda x: length(x) > 0) as authors_ from (select o_orderkey, string_split(lower(regexp_replace(o_orderkey || ' x, y and z', '^by ', '')), ',') as p from orders))",
)
def _(v):
    return v.raw("orders").select("o_orderkey", joined(F.transform(ingest.authors(F.concat(F.col("o_orderkey").cast("string"), F.lit(" x, y and z"))), lambda a: F.lower(a))).alias("authors"))


@query("tags", "select id, array_to_string(list_sort(list_distinct(list_concat([source], ['news', lower(source)]))), ',') as tags from article", "article")
def _(v):
    found = F.array(F.struct(F.lit("news").alias("term")), F.struct(F.lower("source").alias("term")))
    return v.article.select("id", joined(ingest.tags(F.array("source"), found)).alias("tags"))


@query("check_ignored", "select id, regexp_matches(title || ' profile', '^[A-Z].+\\sprofile') as ignore from article", "article")
def _(v):
    return v.article.select("id", ingest.is_ignored(F.concat("title", F.lit(" profile"))).alias("ignore"))


@query("share_score", "select l_orderkey, l_linenumber, round_even(coalesce(l_quantity, 0)::double + l_linenumber / 4.0::double + l_partkey, 0) + 0.0 as shares from lineitem")
def _(v):
    c = F.col
    return v.raw("lineitem").select("l_orderkey", "l_linenumber", (T.share_score(c("l_linenumber"), c("l_partkey"), F.lit(0), c("l_quantity"), F.lit(None), F.lit(0)) + F.lit(0.0)).alias("shares"))


@query("stale_feeds", "select event_id as id from events where ts < timestamp '2024-01-10' - interval 1 hour and user_id % 2 = 0")
def _(v):
    feeds = v.raw("events").select(F.col("event_id").alias("id"), F.col("ts").alias("updated_at"), (F.col("user_id") % 2 != 0).alias("updating"))
    return ingest.stale(feeds, "2024-01-10 00:00:00").select("id")


@query("upsert_sources", "select distinct name from (select source as name from documents union select r_name as name from region)")
def _(v):
    return ingest.upsert_names(v.raw("documents").select(F.col("source").alias("name")), v.raw("region").select(F.col("r_name").alias("name")))


@query("seed_articles", "select id, title from article where source in ('src1', 'src2') order by id limit 25", "article")
def _(v):
    return readers.seed(v.article, v.spark.createDataFrame([("src1",), ("src2",)], "source string"), 25).select("id", "title")


@query("training_texts", "select concat_ws(' ', title, text) as text from article", "article")
def _(v):
    return readers.training_texts(v.article)


@query("image_extension", "select page_id, lower(regexp_extract(url, '(\\.[^./]+)$', 1)) as extension from pages")
def _(v):
    return v.raw("pages").select("page_id", ingest.image_extension(F.col("url")).alias("extension"))


# --- web ---------------------------------------------------------------------------------------


@query("page_anchors", "select page_id, unnest(regexp_extract_all(html, '(?i)<a\\s[^>]*?href\\s*=\\s*\"([^\"]*)\"', 1)) as href from pages")
def _(v):
    return v.raw("pages").select("page_id", F.explode(web.anchors(F.col("html"))).alias("href"))


@query("is_feed", "select page_id, not contains(lower(html), '<html') and len(regexp_extract_all(lower(html), '<rss|<rdf|<feed')) > 0 as is_feed from pages")
def _(v):
    return v.raw("pages").select("page_id", web.is_feed(F.col("html")).alias("is_feed"))


_ENDED = "href || case page_id % 4 when 0 then '/feed.rss' when 1 then '.XML' when 2 then '-Atom' else '' end"


@query("feedish_links", f"select page_id, href from (select page_id, {_ENDED} as href from (select page_id, unnest(regexp_extract_all(html, '(?i)<a\\s[^>]*?href\\s*=\\s*\"([^\"]*)\"', 1)) as href from pages)) where regexp_matches(lower(href), 'rss|rdf|xml|atom')")
def _(v):
    links = v.raw("pages").select("page_id", F.explode(web.anchors(F.col("html"))).alias("href"))
    ended = F.concat("href", F.element_at(F.array(F.lit("/feed.rss"), F.lit(".XML"), F.lit("-Atom"), F.lit("")), F.pmod(F.col("page_id"), F.lit(4)).cast("int") + 1))
    return links.select("page_id", ended.alias("href")).filter(web.is_feedish_link(F.col("href")))


@query("full_url", "select page_id, case when regexp_matches(u, '^https?://') then u else 'http://' || u end as url from (select page_id, case when page_id % 2 = 0 then url else regexp_replace(url, '^https?://', '') end as u from pages)")
def _(v):
    u = F.when(F.col("page_id") % 2 == 0, F.col("url")).otherwise(F.regexp_replace("url", "^https?://", ""))
    return v.raw("pages").select("page_id", T.full_url(u).alias("url"))


_MAIN = "coalesce(nullif(regexp_extract(page, '(?is)<article\\b[^>]*>(.*?)</article>', 1), ''), nullif(regexp_extract(page, '(?is)<body\\b[^>]*>(.*?)</body>', 1), ''), page)"
_BARE = f"regexp_replace(regexp_replace({_MAIN}, '(?is)" + "|".join(f"<{t}\\b.*?</{t}\\s*>" for t in ("script", "style", "nav", "footer")) + "|<!--.*?-->', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g')"
for _name, _char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&nbsp;", " "), ("&amp;", "&")):
    _BARE = f"replace({_BARE}, '{_name}', '{_char}')"


@query(
    "extract_text",
    f"select page_id, trim(regexp_extract(page, '(?is)<title[^>]*>(.*?)</title>', 1)) as title, trim(regexp_replace({_BARE}, '\\s+', ' ', 'g')) as text, nullif(regexp_extract(page, '(?is)<link[^>]*rel=\"canonical\"[^>]*href=\"([^\"]*)\"', 1), '') as canonical, "
    "nullif(regexp_extract(page, '(?is)<meta[^>]*property=\"og:image\"[^>]*content=\"([^\"]*)\"', 1), '') as image from (select page_id, replace(substr(html, strpos(html, '<')), '<title>', case page_id % 2 when 0 then '<link rel=\"canonical\" href=\"' || url || '\"><meta property=\"og:image\" content=\"/a.png\"><title>' else '<title>' end) as page from pages)",
)
def _(v):
    head = F.when(F.col("page_id") % 2 == 0, F.concat(F.lit('<link rel="canonical" href="'), F.col("url"), F.lit('"><meta property="og:image" content="/a.png"><title>'))).otherwise(F.lit("<title>"))
    return v.raw("pages").select("page_id", web.extract(F.replace("html", F.lit("<title>"), head)).alias("x")).select("page_id", "x.title", "x.text", "x.canonical", "x.image")


@query("sanitize", "select page_id, trim(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script\\b.*?</script\\s*>|<style\\b.*?</style\\s*>|<!--.*?-->', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g'), '\\s+', ' ', 'g')) as text from pages")
def _(v):
    return v.raw("pages").select("page_id", T.sanitize(F.col("html")).alias("text"))


_ROOT = "regexp_replace(url, '([^/:])/[^/]*$', '\\1')"


@query("discover_feeds", f"with r as (select page_id, url, {_ROOT} || '/feed' as feed from pages) select distinct url, feed from r where feed in (select feed from r where page_id % 2 = 0)")
def _(v):
    pages = v.raw("pages").select("page_id", "url", "html")
    root = F.regexp_replace("url", r"(?<![/:])/[^/]*$", "")
    feeds = pages.filter("page_id % 2 = 0").select(F.concat(root, F.lit("/feed")).alias("url"), F.lit("<?xml version='1.0'?><rss></rss>").alias("html"))
    return web.discover(pages.select("url", "html"), pages.select("url", "html").union(feeds))


# --- knowledge ---------------------------------------------------------------------------------


@query(
    "uri_for_name",
    "l as (select s as uri, o as name from triples where p = 'label'), r as (select s as uri, o as target from triples where p = 'redirects') "
    "select name, min(uri) as uri from (select name, target as uri from l join r using (uri) union all select name, uri from l where uri not in (select uri from r)) group by name",
    "triples",
)
def _(v):
    return knowledge.uri_for_name(v.triples)


ORACLE_SQL["uri_for_name"] = ORACLE_SQL["uri_for_name"].replace(") l as (", "), l as (")


@query("types", "select s as uri, string_agg(o, ',' order by o) as kinds from triples where p = 'type' group by s", "triples")
def _(v):
    return knowledge.values(v.triples, "type").select("uri", joined("values").alias("kinds"))


@query("labels", "select s as uri, min(o) as value from triples where p = 'label' group by s", "triples")
def _(v):
    return knowledge.first_value(v.triples, "label")


@query("knowledge_for", "select s as uri, min(o) filter (p = 'abstract') as abstract, min(o) filter (p = 'image') as image, min(o) filter (p = 'label') as label from triples where p in ('abstract', 'image', 'label') group by s", "triples")
def _(v):
    return knowledge.knowledge_for(v.triples)


@query("triple_commonness", "select o as uri, count(*) as commonness from triples where p = 'customerOf' group by o", "triples")
def _(v):
    return knowledge.commonness(v.triples, "customerOf")


@query(
    "company_profile",
    "select t.s as uri, l.o as name, n.o as nation, ll.o as place from triples t join triples l on l.s = t.s and l.p = 'label' join triples n on n.s = t.s and n.p = 'inNation' join triples ll on ll.s = n.o and ll.p = 'label' where t.p = 'type' and t.o = 'Company'",
    "triples",
)
def _(v):
    return knowledge.company_profile(v.triples)


@query("subsidiaries", "select n.o as nation, count(*) as companies from triples t join triples n on n.s = t.s and n.p = 'inNation' where t.p = 'type' and t.o = 'Company' group by 1", "triples")
def _(v):
    return knowledge.subsidiaries(v.triples).select("nation", F.size("companies").cast("long").alias("companies"))


@query(
    "place_profile",
    "select t.s as uri, l.o as name, r.region, r.region_name, a.o as alias from triples t join triples l on l.s = t.s and l.p = 'label' left join (select i.s, i.o as region, x.o as region_name from triples i join triples x on x.s = i.o and x.p = 'label' where i.p = 'inRegion') r on r.s = t.s "
    "left join (select * from triples where p = 'alias') a on a.s = t.s where t.p = 'type' and t.o = 'Place'",
    "triples",
)
def _(v):
    return knowledge.place_profile(v.triples)


@query("profile_kind", "select s as uri, case when bool_or(o = 'Company') then 'Company' when bool_or(o = 'Place') then 'Place' end as kind from triples where p = 'type' group by s", "triples")
def _(v):
    return knowledge.profile_kind(v.triples)


@query("not_exists", "select s as uri from triples where p = 'type' and s not in (select s from triples where p = 'redirects')", "triples")
def _(v):
    t = v.triples
    return knowledge.pattern(t, "type", "uri", "kind").join(knowledge.pattern(t, "redirects", "uri", "to"), "uri", "left_anti").select("uri")


# --- time and users ----------------------------------------------------------------------------


@query(
    "time_gaps",
    "select s as start, ts as \"end\", (epoch_us(ts) - epoch_us(s)) / 1e6 as seconds from (select ts, lag(ts) over (order by ts) as s from (select distinct ts from events where ts > '2013-05-02')) where epoch_us(ts) - epoch_us(s) >= 1800 * 1000000",
)
def _(v):
    return ranking.gaps(v.raw("events"), "ts", 1800)


@query("missing_days", "select c_custkey, (date '2024-01-01' + k::int)::varchar as day from (select c_custkey, unnest(range(0, (c_custkey % 5)::bigint)) as k from customer)")
def _(v):
    days = ranking.days_between(F.lit("2024-01-01").cast("date"), F.col("c_custkey") % 5 + 0.5)
    return v.raw("customer").select("c_custkey", F.explode(days.cast("array<string>")).alias("day"))


@query("watch", "select * from users_stories union select user_id, 9 as story_id from users_stories", "users_stories")
def _(v):
    return users.add_link(v.users_stories, v.users_stories.select("user_id", F.lit(9).cast("long").alias("story_id")))


@query("unwatch", "select user_id, story_id from users_stories where story_id <> 1", "users_stories")
def _(v):
    return users.remove_link(v.users_stories, v.users_stories.filter("story_id = 1"))


@query("is_watching", "select user_id, 2 as story_id, bool_or(story_id = 2) as linked from users_stories group by user_id", "users_stories")
def _(v):
    asked = v.users_stories.select("user_id", F.lit(2).cast("long").alias("story_id")).distinct()
    return users.has_link(v.users_stories, asked)


@query(
    "merge_users",
    "with a as (select event_id as id, user_id, event_type as provider from events) select id, case when user_id = 2 and provider not in (select provider from a where user_id = 1) then 1 else user_id end as user_id, provider from a",
)
def _(v):
    auths = v.raw("events").select(F.col("event_id").alias("id"), "user_id", F.col("event_type").alias("provider"))
    return users.merge(auths, 1, 2)
