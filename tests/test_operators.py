"""Literal cases for what the tables don't show."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from newsloom.functions import text as T
from newsloom.operators import api, clusters, concepts, ingest, ranking, search, summarize, users, web
from newsloom.sources import readers
from newsloom.streaming import ingest as stream


def values(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def members(spark, groups, key):
    return spark.createDataFrame([(k, m) for k, ms in groups for m in ms], f"{key} long, member long")


def test_triage_of_all_kinds(spark):
    old = members(spark, [(1, [0, 1, 2, 3]), (2, [4, 5]), (3, [6]), (4, [7, 8, 9]), (5, [10, 11, 12, 13])], "old_id")
    new = members(spark, enumerate([[0, 1, 2], [3, 4, 5], [6], [7], [8, 9, 10]]), "new_id")
    got = {tuple(r) for r in clusters.triage(old, new).collect()}
    assert got == {("update", 1, 0), ("update", 2, 1), ("unchanged", 3, 2), ("update", 4, 4), ("delete", 5, None), ("create", None, 3)}


def test_triage_of_nothing(spark):
    none, some = members(spark, [], "old_id"), members(spark, [(0, [1, 2])], "new_id")
    assert [tuple(r) for r in clusters.triage(none, some).collect()] == [("create", None, 0)]


def test_freezing(spark):
    old, new = members(spark, [(1, [1]), (2, [2])], "old_id"), members(spark, [(0, [1]), (1, [2])], "new_id")
    states = spark.createDataFrame([(1, dt.datetime(2024, 1, 1)), (2, dt.datetime(2024, 1, 6, 1))], "old_id long, updated_at timestamp_ntz")
    kept, moved = clusters.apply_triage(clusters.triage(old, new), states, new, "2024-01-10 00:00:00")
    assert values(kept, "old_id", "active") == [(1, False), (2, True)]
    assert values(moved, "cluster_id", "member", "fresh") == [(1, 1, False), (2, 2, False)]


def test_components(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (5, 6)], "a long, b long")
    nodes = spark.createDataFrame([(k,) for k in (1, 2, 3, 4, 5, 6)], "id long")
    assert values(clusters.components(edges, nodes), "id", "cluster") == [(1, 1), (2, 1), (3, 1), (4, 4), (5, 5), (6, 5)]


def test_snip(spark):
    events = spark.createDataFrame([(1, 1), (2, 1), (3, 3)], "id long, cluster long")
    stories = spark.createDataFrame([(1, 1), (2, 1), (3, 1)], "id long, cluster long")
    e, s = clusters.snip(events, stories, 1, 2)
    assert values(e, "event_id", "article_id") == [(1, 1), (1, 2), (3, 3)]
    assert values(s, "story_id", "event_id") == [(1, 1), (1, 3)]


def test_concept_scores(spark):
    rows = spark.createDataFrame([(1, "some")] * 3 + [(1, "another")], "article_id long, slug string")
    assert values(concepts.article_scores(rows), "slug", "score") == [("another", 0.25), ("some", 0.75)]


def test_cluster_scores_with_commonness(spark):
    scores = spark.createDataFrame([(1, "a", 0.5), (1, "b", 0.5)], "article_id long, slug string, score double")
    links = spark.createDataFrame([(7, 1)], "event_id long, article_id long")
    common = spark.createDataFrame([("a", 100.0), ("b", 100.0)], "slug string, commonness double")
    got = values(concepts.cluster_scores(scores, links, common, "event_id", "article_id"), "slug", "score")
    assert [round(s, 3) for _, s in got] == [0.005, 0.005]


@pytest.mark.parametrize(
    "name, expected",
    [
        ("BY JOHN HEIMER, HWAIDA SAAD, and BEN HUBBARD", ["John Heimer", "Hwaida Saad", "Ben Hubbard"]),
        ("by Maria Lopez", ["Maria Lopez"]),
        ("A and B", ["A", "B"]),
        ("Sandy Andrews", ["Sandy Andrews"]),
        ("", []),
        (None, None),
    ],
)
def test_authors(spark, name, expected):
    assert one(spark, ingest.authors(F.lit(name).cast("string"))) == expected


def test_tags(spark):
    found = F.array(F.struct(F.lit("Military").alias("term")), F.struct(F.lit("National Security").alias("term")))
    assert one(spark, ingest.tags(F.array(F.lit("Helicopters")), found)) == ["Helicopters", "Military", "National Security"]
    assert one(spark, ingest.tags(F.lit(None).cast("array<string>"), found)) == ["Military", "National Security"]


def test_entry_fields(spark):
    rows = spark.createDataFrame([("u", None, "Thu, 09 Jan 2014 14:00:00 GMT", None, None, None, "t")], "url string, canonical_url string, published string, publish_date string, updated string, entry_title string, title string")
    r = ingest.entry_fields(rows).first()
    assert (r.ext_url, r.created_at, r.updated_at, r.title) == ("u", dt.datetime(2014, 1, 9, 14), dt.datetime(2014, 1, 9, 14), "t")


def test_ingest_keeps_the_first(spark):
    long = "x" * 400
    rows = spark.createDataFrame([(1, "a", "T", "s", long), (2, "a", "U", "s", long), (3, "b", "T", "s", long), (4, "c", "V", "s", "short"), (5, "d", "W", "s", long)], "id long, ext_url string, title string, source string, text string")
    known = spark.createDataFrame([("d", "Z", "s")], "ext_url string, title string, source string")
    assert values(ingest.ingest(rows, known), "id") == [(1,)]


def test_share_score(spark):
    c = lambda x: F.lit(x)
    assert one(spark, T.share_score(c(265614.0), c(8503403), c(841), c(None), c(2), c(0))) == 8570650.0  # 8570649.5
    assert one(spark, T.share_score(c(2), c(0), c(0), c(0), c(0), c(0))) == 0.0  # 0.5 goes to the even


def test_hot_score_rises_with_time_and_score(spark):
    h = lambda s, t: one(spark, T.hot_score(F.lit(s), F.lit(t).cast("timestamp_ntz")))
    assert h(100.0, "2014-01-02") > h(100.0, "2014-01-01") and h(1000.0, "2014-01-01") > h(100.0, "2014-01-01")
    assert h(0.0, "2014-01-01") == 0.0


def test_small_functions(spark):
    assert one(spark, T.format_bytes(F.lit(1536))) == "1.5 KB"
    assert one(spark, T.iso_datetime(F.lit("2014-01-01 10:00:00").cast("timestamp_ntz"))) == "2014-01-01T10:00:00"
    assert one(spark, T.escape_literal(F.lit("a\"b\\c\nd"))) == 'a\\"b\\\\c\\nd'
    assert one(spark, T.currency(F.lit(1234.5))) == "$1,234.50"
    assert one(spark, T.natural_datetime(F.lit("2014-01-01").cast("timestamp_ntz"), F.lit("2014-01-01 02:00:00").cast("timestamp_ntz"))) == "2 hours ago"
    assert one(spark, T.slug_of(F.lit("http://x/resource/Foo_Bar"), F.lit("n"))) == "Foo_Bar"
    assert one(spark, T.slug_of(F.lit(None).cast("string"), F.lit("Foo & Bar!"))) == "foo-bar"
    assert one(spark, T.flatten_bindings(F.lit('{"uri":{"type":"uri","value":"u"}}'))) == {"uri": "u"}
    assert one(spark, T.cosine(F.array(F.lit(0.0)), F.array(F.lit(1.0)))) is None
    assert one(spark, T.normalise(F.array(F.lit(3.0), F.lit(4.0)))) == [0.6, 0.8]
    assert one(spark, T.highlight(F.lit("see Foo and Foo Bar"), F.array(F.lit("Foo"), F.lit("Foo Bar")))).count("<a") >= 2
    assert one(spark, T.allowed_file(F.lit("a.PNG"), ["png"])) is False
    assert one(spark, ingest.is_ignored(F.lit("John Doe profile"))) is True


def test_date_ends(spark):
    rows = spark.createDataFrame([("A", dt.datetime(2014, 1, 20)), ("B", dt.datetime(2014, 1, 22)), ("C", dt.datetime(2014, 1, 24))], "title string, created_at timestamp_ntz")
    assert values(ranking.timespan(rows, "2014-01-21", "2014-02-01"), "title") == [("B",), ("C",)]
    assert values(ranking.timespan(rows, "2014-01-20", "2014-01-24"), "title") == [("B",)]
    assert values(ranking.in_range(rows, "2014-01-20", "2014-01-24"), "title") == [("A",), ("B",), ("C",)]


def test_gaps(spark):
    rows = spark.createDataFrame([(dt.datetime(2014, 1, 1, 1),), (dt.datetime(2014, 1, 1, 2),), (dt.datetime(2014, 1, 4, 1),), (dt.datetime(2012, 1, 1),)], "t timestamp_ntz")
    assert values(ranking.gaps(rows, "t", 86400), "start", "end") == [(dt.datetime(2014, 1, 1, 2), dt.datetime(2014, 1, 4, 1))]


def test_search_ranks(spark):
    rows = {"event": spark.createDataFrame([(1, "Foo bar hey", "none")], "id long, title string, summary string"), "story": spark.createDataFrame([(2, "x", "foo foo foo foo foo"), (3, "foo", None)], "id long, title string, summary string")}
    got = [(r.type, r.id, r["rank"]) for r in search.search_page(rows, "foo").collect()]
    assert got == [("story", 3, None), ("story", 2, 0.5), ("event", 1, 0.0)]
    assert search.search_count(rows, "foo", ["story"]).first().total_count == 2
    near = {"a": spark.createDataFrame([(1, "", "big cat"), (2, "", "big brown lazy cat")], "id long, title string, summary string")}
    ranks = {r.id: r["rank"] for r in search.search(near, "big cat").collect()}
    assert ranks[1] > ranks[2] > 0


def test_summary(spark):
    text = "Dinosaurs are cool. Robots are cooler than dinosaurs! Is that so? Clinton said it is. Yes. Dinosaurs, he said, are great and so are robots."
    rows = spark.createDataFrame([(1, "Dinosaurs and robots", text), (2, "", ""), (3, None, None)], "id long, title string, text string")
    got = values(summarize.summarize(rows), "id", "rank")
    assert [x for x in got if x[0] == 1] == [(1, k) for k in range(1, 6)]


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def some_texts(spark):
    texts = ["Cats and dogs run. Dogs sleep! Dogs eat cats? Cats and dogs run.", "", None, "x.", "Birds fly high. The birds of prey fly; birds sing.\nFish swim. " * 3, "...", "a b c d e f g h i j k l m n o p"]
    return spark.createDataFrame([(i, t and t.split(".")[0], t) for i, t in enumerate(texts)], "id long, title string, text string").coalesce(1)


def test_keywords_are_counted_where_documents_are(spark):
    docs = some_texts(spark)
    got = summarize.keywords(docs)
    assert "Exchange" not in plan_of(got)
    dogs = [r for r in values(got, "id", "word", "weight") if r[0] == 0]
    assert dogs == [(0, "cats", 3 / 13 * 1.5 + 1), (0, "dogs", 4 / 13 * 1.5 + 1), (0, "eat", 1 / 13 * 1.5 + 1), (0, "run", 2 / 13 * 1.5 + 1), (0, "sleep", 1 / 13 * 1.5 + 1)]
    assert [r[1] for r in values(got, "id", "word") if r[0] == 6] == list("bcdefghijk")


def test_keywords_of_repeated_ids_are_counted_together(spark):
    docs = spark.createDataFrame([(1, "red red blue"), (1, "blue blue green"), (2, "red"), (None, "sun moon sun"), (None, "moon moon sun")], "id long, text string")
    got = sorted(((r.id is None, r.id or 0, r.word, r.weight) for r in summarize.keywords(docs).collect()))
    assert got == [(False, 1, "blue", 2.5), (False, 1, "green", 1.5), (False, 1, "red", 2.0), (False, 2, "red", 2.5), (True, 0, "moon", 2.5), (True, 0, "sun", 2.5)]


@pytest.mark.parametrize("batch", ["1", "2", "10000"])
def test_summaries_need_no_shuffle_and_take_documents_over_batches(spark, batch):
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    try:
        spark.conf.set(name, batch)
        want = [(0, 1, 'Cats and dogs run.'), (0, 2, 'Dogs eat cats?'), (3, 1, 'x.'), (4, 1, 'The birds of prey fly; birds sing.'), (4, 2, 'Birds fly high.'), (5, 1, '...'), (6, 1, 'a b c d e f g h i j k l m n o p')]
        got = summarize.summarize(some_texts(spark), length=2)
        assert "Exchange" not in plan_of(got)
        assert [(r.id, r.rank, r.sentence) for r in sorted(got.collect())] == want
        docs = some_texts(spark)
        assert [(r.id, r.rank, r.sentence) for r in sorted(summarize.summarize(docs.union(docs), length=2).collect())] == want
    finally:
        spark.conf.set(name, before)


def test_sentence_features_need_no_shuffle(spark):
    got = summarize.sentence_features(some_texts(spark))
    assert "Exchange" not in plan_of(got)
    row = [r for r in got.collect() if (r.id, r.pos) == (0, 1)][0]
    dogs, cats, run = (n / 13 * 1.5 + 1 for n in (4, 3, 2))
    assert row.title_score == 1.0 and row.words == 3 and row.sbs == pytest.approx((dogs + cats + run) / 3 / 10) and row.dbs == pytest.approx((cats * dogs + dogs * run) / (4 * 5))


def test_multi_summary_is_what_it_was_in_memory():
    import hashlib
    import random

    rnd = random.Random(7)
    words = [f"w{k}" for k in range(12)] + ["the", "of", "", ".", "...", "?"]
    got = []
    for least in (0.0, 0.2, 0.5) * 40:
        texts = [" ".join((". " if rnd.random() < 0.25 else "") + rnd.choice(words) for _ in range(rnd.randrange(40))) for _ in range(rnd.randrange(12))]
        got.append(summarize.multi_summary(iter(texts), 5, least))
    assert hashlib.md5(repr(got).encode()).hexdigest() == "f4469034427b2f82e5d3712c5a4bb1af"  # of the results before it became a stream


def test_a_cluster_is_summarised_once_however_joins_are_split(spark):
    wanted = {
        "spark.sql.shuffle.partitions": "200",
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "1k",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1k",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "0.1",
    }
    before = {k: spark.conf.get(k) for k in wanted}
    try:
        for k, v in wanted.items():
            spark.conf.set(k, v)
        rows = spark.range(0, 4000, 1, 8).selectExpr("id % 2 as event_id", "id", "'t' as title", "concat('Same words of every text. ', sha2(string(id), 512)) as text")
        got = [r[:2] for r in summarize.cluster_summary(rows, "event_id").collect()]
        assert len(got) == len(set(got)) == 10
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_provenance_makes_summaries_once(spark):
    made = spark.sparkContext.accumulator(0)

    def run(batches):
        for batch in batches:
            made.add(batch.num_rows)
            yield batch

    summaries = spark.range(3).selectExpr("id as event_id", "1 as rank", "'cats' as sentence").mapInArrow(run, "event_id long, rank int, sentence string")
    members = spark.range(3).selectExpr("id as event_id", "id", "'t' as title", "'cats run' as text", "'s' as source", "'u' as ext_url")
    assert values(summarize.provenance(summaries, members, "event_id"), "event_id", "member") == [(0, 0), (1, 1), (2, 2)] and made.value == 3


def test_multi_summary_holds_no_texts():
    import tracemalloc

    tracemalloc.start()
    try:
        got = summarize.multi_summary(" ".join(f"{k * 30 + i:012x}" for i in range(30)) + "." for k in range(3000))
        assert len(got) == 5 and tracemalloc.get_traced_memory()[1] < 30 << 20
    finally:
        tracemalloc.stop()


def test_sentences_of_odd_texts_equal_their_sql(spark, tmp_path):
    import duckdb

    from newsloom import queries

    odd = ["", "   ", None, "a.\x0bb", "a.\x0b b. c", "a\x01b. c", "a.\x01 b", "x.\n", "\n x", " \t.", "a.  .  b", "a.\x85b", "a.\u2003b", "a.\u00a0b", "A. B! C?\tD"]
    spark.createDataFrame(list(enumerate(odd)), "doc_id long, text string").selectExpr("*", "'s' as source").write.parquet(f"{tmp_path}/documents.parquet")
    spark.range(len(odd)).selectExpr("id as event_id", "timestamp_ntz '2024-01-01' as ts", "1.0d as value").write.parquet(f"{tmp_path}/events.parquet")
    con = duckdb.connect()
    for t in ("documents", "events"):
        con.execute(f"create view {t} as select * from read_parquet('{tmp_path}/{t}.parquet/*.parquet')")
    for name in ("sentences", "sentence_features"):
        result = con.execute(queries.ORACLE_SQL[name])
        columns = [c[0] for c in result.description]
        assert sorted(map(repr, result.fetchall())) == sorted(repr(tuple(r[c] for c in columns)) for r in queries.QUERIES[name](spark, str(tmp_path)).collect())


def test_multi_summary():
    docs = ["Cats are nice animals. They sleep.", "Cats are nice animals that sleep a lot. Dogs bark.", ""]
    got = summarize.multi_summary(docs)
    assert 0 < len(got) <= 5 and summarize.multi_summary([""]) == []


def test_feeds(spark):
    page = '<html><link rel="alternate" type="application/rss+xml" href="/rss.xml"><a href="http://x.org/a.rss">a</a></html>'
    rows = spark.createDataFrame([("http://x.org/", page), ("http://y.org", '<html><a href="http://y.org/news.rdf">n</a></html>'), ("http://z.org/f", "<rss></rss>")], "url string, html string")
    known = rows.union(spark.createDataFrame([("http://x.org/rss.xml", "<rss/>"), ("http://y.org/news.rdf", "<rdf></rdf>")], "url string, html string"))
    assert values(web.discover(rows, rows), "url", "feed") == [("http://z.org/f", "http://z.org/f")]  # what is unknown is no feed
    assert values(web.discover(rows, known), "url", "feed") == [("http://x.org/", "http://x.org/rss.xml"), ("http://y.org", "http://y.org/news.rdf"), ("http://z.org/f", "http://z.org/f")]


def test_feed_names(spark):
    ask = lambda u: one(spark, web.is_feed_link(F.lit(u)))
    assert ask("http://x/a.rss") and ask("http://x/a.XML") and not ask("http://x/a.atom") and not ask("http://x/a")


def test_page_text(spark):
    page = "junk<html><title> T </title><body><nav>n</nav><p>a &amp; b</p><script>x</script></body></html>"
    r = one(spark, web.extract(F.lit(page)))
    assert (r.title, r.text) == ("T", "a & b")


def test_users(spark):
    auths = spark.createDataFrame([(1, 1, "a"), (2, 2, "a"), (3, 2, "b")], "id long, user_id long, provider string")
    assert values(users.merge(auths, 1, 2), "id", "user_id") == [(1, 1), (2, 2), (3, 1)]


def test_sources(spark, tmp_path):
    (tmp_path / "s.json").write_text('{"A": ["u1", "u2"], "B": []}')
    assert values(readers.read_sources(spark, str(tmp_path / "s.json")), "name", "ext_url") == [("A", "u1"), ("A", "u2")]
    (tmp_path / "t.nt").write_text('# c\n<s> <p> <o> .\n<s> <label> "say \\"x\\""@en .\nbroken\n')
    triples = readers.read_triples(spark, str(tmp_path / "t.nt"))
    assert values(triples, "s", "p", "o") == [("s", "label", 'say \\"x\\"'), ("s", "p", "o")]
    readers.write_triples(triples, str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).filter("p = 'p'").count() == 1
    (tmp_path / "texts/deep").mkdir(parents=True)
    (tmp_path / "texts/deep/one.txt").write_text("line\nline")
    assert values(readers.read_texts(spark, str(tmp_path / "texts")), "title", "text") == [("one", "line\nline")]
    (tmp_path / "dump.xml").write_text("<m><page><title>P</title><ns>0</ns><id>1</id><revision><id>2</id><text x='1'>body</text></revision></page></m>")
    dump = readers.read_dump(spark, str(tmp_path / "dump.xml"))
    assert dump.select("title", readers.element("revision/text").alias("t")).collect()[0].t == "body"
    (tmp_path / "feed.xml").write_text("<rss><channel><item><title>A</title><link>l</link></item></channel></rss>")
    feed = readers.read_feeds(spark, str(tmp_path / "feed.xml"))
    assert values(feed, "title", "link") == [("A", "l")]
    assert readers.feed_errors(feed).first().errors == 0


def test_corpus(spark, tmp_path):
    (tmp_path / "sources.json").write_text('[{"_id":{"$oid":"s1"},"name":"S"}]')
    (tmp_path / "feeds.json").write_text('[{"_id":{"$oid":"f1"},"ext_url":"f","source":{"$oid":"s1"}}]')
    (tmp_path / "articles.json").write_text('[{"ext_url":"u","title":"t","text":"x","feed":{"$oid":"f1"},"created_at":{"$date":1000},"updated_at":{"$date":2000}},{"ext_url":"known","feed":{"$oid":"f1"}}]')
    got = readers.read_corpus(spark, str(tmp_path), spark.createDataFrame([("known",)], "ext_url string")).collect()
    assert [(r.ext_url, r.source, r.created_at) for r in got] == [("u", "S", dt.datetime(1970, 1, 1, 0, 0, 1))]


def test_decoding(spark):
    rows = spark.createDataFrame([(bytearray("é".encode()), None), (bytearray(b"\xe9"), "iso-8859-1")], "data binary, charset string")
    assert [r.x for r in rows.select(readers.decode(F.col("data"), F.col("charset")).alias("x")).collect()] == ["é", "é"]


def test_stream_over_two_batches(spark, tmp_path):
    long = "x" * 400
    schema = stream.ENTRY_SCHEMA

    def put(n, rows):
        spark.createDataFrame([(i, u, t, "s", long, dt.datetime(2024, 1, 1, n)) for i, u, t in rows], schema).coalesce(1).write.parquet(str(tmp_path / f"in/{n}"))

    def run():
        entries = stream.read_entries(spark, str(tmp_path / "in/*"))
        q = stream.start(entries, str(tmp_path / "table"), str(tmp_path / "check"), {"availableNow": True})
        q.awaitTermination()

    put(1, [(1, "a", "A"), (2, "b", "B"), (3, "a", "C")])
    run()
    put(2, [(4, "a", "D"), (5, "c", "B"), (6, "d", "E")])
    run()
    got = [r.ext_url for r in spark.read.parquet(str(tmp_path / "table")).collect()]
    assert sorted(got) == ["a", "b", "d"]


def test_freezing_by_age(spark):
    rows = spark.createDataFrame([(1, True, dt.datetime(2024, 1, 1)), (2, True, dt.datetime(2024, 1, 8))], "event_id long, active boolean, updated_at timestamp_ntz")
    assert values(stream.freeze(rows, "2024-01-10 00:00:00"), "event_id", "active") == [(1, False), (2, True)]


def test_counters(spark):
    assert one(spark, T.json_count(F.lit('{"shares": 12}'), "$.shares")) == 12.0
    assert one(spark, T.json_count(F.lit("broken"), "$.shares")) == 0.0
    assert one(spark, T.xml_count(F.lit("<a><b>3</b></a>"), "a/b")) == 3.0
    assert one(spark, T.xml_count(F.lit("no"), "a/b")) == 0.0


def vectors_of(spark, n, seed):
    import numpy as np

    x = np.random.default_rng(seed).normal(size=(n, 6)).round(2)
    x[3] = 0
    rows = [(k % 2, k * 7 % n, [float(e) for e in x[k]]) for k in range(n)]
    rows += [(0, n, None), (0, n + 1, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (0, n + 2, [1.0]), (0, n + 3, [2.0]), (None, n + 4, [1.0])]
    return rows, spark.createDataFrame(rows, "day int, id long, vector array<double>")


def brute_pairs(rows, least):
    import math

    def cosine(u, v):
        if u is None or v is None or len(u) != len(v) or None in u or None in v:
            return None
        norm = math.sqrt(sum(e * e for e in u) * sum(e * e for e in v))
        return sum(a * b for a, b in zip(u, v)) / norm if norm else None

    found = {}
    for da, a, u in rows:
        for db, b, v in rows:
            if da is not None and da == db and a < b and (s := cosine(u, v)) is not None and s >= least:
                found[a, b] = s
    return found


@pytest.mark.parametrize("block", [16, 2048])
def test_similar_components_meet_no_pairs_twice_and_are_exact(spark, monkeypatch, block):
    monkeypatch.setattr(clusters, "BLOCK", block)
    for least in (0.8, 0.93):
        rows, df = vectors_of(spark, 150, 1)
        parent = {r[1]: r[1] for r in rows}

        def root(x):
            while parent[x] != x:
                x = parent[x]
            return x

        for a, b in brute_pairs(rows, least):
            a, b = sorted((root(a), root(b)))
            parent[b] = a
        made = []
        monkeypatch.setattr(clusters, "similar_pairs", lambda *_: made.append(1))
        assert values(clusters.similar_components(df, least, "day"), "id", "cluster") == sorted((x, root(x)) for x in parent) and not made
        links = clusters._blocks(df, "day", "id", "vector").withColumn("group", F.lit(0)).select("within", "width", "group", "id", "vector")
        assert clusters._links(links, ["group"], -2.0).count() < len(rows)  # all are similar: as many edges as a tree has


@pytest.mark.parametrize("block", [16, 2048])
def test_similar_pairs_in_blocks(spark, monkeypatch, block):
    monkeypatch.setattr(clusters, "BLOCK", block)
    rows, df = vectors_of(spark, 120, 2)
    got = {(a, b): s for a, b, s in values(clusters.similar_pairs(df, 0.5, "day"), "a", "b", "similarity")}
    want = brute_pairs(rows, 0.5)
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], abs=1e-12) for k in want)
    exact = spark.createDataFrame([(0, 1, [0.1, 0.0]), (0, 2, [0.06, 0.08])], "day int, id long, vector array<double>")
    least = brute_pairs([tuple(r) for r in exact.collect()], 0)[1, 2]
    assert clusters.similar_pairs(exact, least, "day").count() == 1


def test_reclustering_makes_no_pairs(spark, monkeypatch):
    monkeypatch.setattr(clusters, "similar_pairs", None)
    _, df = vectors_of(spark, 60, 3)
    events, stories = clusters.recluster(df, "day", 0.95, 0.8)
    assert events.count() == 65 and stories.select("event_id").distinct().count() == events.select("event_id").distinct().count()


def test_reclustering_nests(spark):
    rows = [(1, 0, [1.0, 0.0]), (2, 0, [0.99, 0.1]), (3, 0, [0.8, 0.6]), (4, 0, [0.0, 1.0])]
    df = spark.createDataFrame(rows, "id long, day long, vector array<double>")
    events, stories = clusters.recluster(df, "day", 0.95, 0.7)
    assert values(events, "event_id", "article_id") == [(1, 1), (1, 2), (3, 3), (4, 4)]
    assert values(stories, "story_id", "event_id") == [(1, 1), (1, 3), (4, 4)]


def test_dataset_urls(spark):
    page = '<a href="http://d.org/3.9/en/labels_en.ttl.bz2">l</a><a href="http://d.org/3.9/de/labels_de.ttl.bz2">l</a><a href="http://d.org/3.9/en/other_en.ttl.bz2">o</a><a href="http://d.org/3.9/en/images_en.nt.bz2">i</a>'
    got = readers.dataset_urls(spark.createDataFrame([(page,)], "html string"))
    assert values(got, "url") == [("http://d.org/3.9/en/labels_en.ttl.bz2",)]


def test_summaries_are_of_all_members(spark, monkeypatch):
    from newsloom import queries
    from newsloom.plans.views import Views

    folder = "/root/testdata/sf0.001"
    every = Views(spark, folder).event_members.count()
    monkeypatch.setattr(summarize, "multi_summarize", lambda members, *_: members)
    monkeypatch.setattr(summarize, "cluster_summary", lambda members, *_: members)
    monkeypatch.setattr(summarize, "provenance", lambda summaries, members, *_: summaries.select("id").union(members.select("id")))
    assert [queries.QUERIES[q](spark, folder).count() for q in ("multi_summarize", "cluster_summaries", "summary_provenance")] == [every, every, 2 * every] and every > 0


def test_stop_words_are_not_searched_for(spark):
    rows = {"article": spark.createDataFrame([(1, "The is", "the is of"), (2, "A license", None)], "id long, title string, summary string")}
    assert search.search(rows, "the is").count() == 0 and values(search.search(rows, "the license of"), "id") == [(2,)]


def test_labels_images_and_scopes(spark):
    members = spark.createDataFrame([(1, 5, "five", None), (1, 6, "six", "b"), (2, 7, "seven", "c"), (2, 8, "eight", "a")], "event_id long, id long, title string, image string")
    assert values(ranking.images(members, "event_id"), "event_id", "images") == [(1, ["b"]), (2, ["c", "a"])]
    nearest = spark.createDataFrame([(1, 6), (2, 8)], "event_id long, id long")
    events = clusters.event_labels(members, nearest).withColumn("updated_at", F.lit("2024-01-01").cast("timestamp_ntz"))
    stories = spark.createDataFrame([(9, 1), (9, 2)], "story_id long, event_id long")
    assert values(clusters.story_labels(stories, events), "story_id", "title", "image") == [(9, "six", "b")]
    assert values(spark.createDataFrame([(" a  b ",), ("",), (None,)], "s string").select(T.split_scopes(F.col("s")).alias("x")), "x") == [([],), ([],), (["a", "b"],)]


def test_hierarchy_is_saved(spark, tmp_path):
    labels = spark.createDataFrame([(1, 1), (2, 1)], "id long, cluster long")
    clusters.save_hierarchy(labels, f"file://{tmp_path}/level")
    assert values(clusters.load_hierarchy(spark, f"file://{tmp_path}/level"), "id", "cluster") == [(1, 1), (2, 1)]


def test_documents(spark):
    import json

    stories = spark.createDataFrame([(1, "t", None)], "story_id long, title string, image string").withColumn("updated_at", F.lit("2024-01-01").cast("timestamp_ntz"))
    links = spark.createDataFrame([(1, 3), (1, 2)], "story_id long, event_id long")
    assert json.loads(api.story_documents(stories, links).first().json)["events"] == [2, 3]
    held = spark.createDataFrame([("x", 1, 0.2), ("x", 2, 0.9)], "slug string, event_id long, relatedness double")
    named = spark.createDataFrame([("x", "X"), ("y", None)], "slug string, name string")
    assert [[e["id"] for e in json.loads(r.json)["events"]] for r in api.concept_documents(named, held).collect()] == [[2, 1]]


def test_scratch_removes_its_tables(spark):
    from newsloom.plans import lineage

    with lineage.scratch(spark):
        inner = lineage.materialise(spark.range(3), "inner")
        with lineage.scratch(spark):
            kept = lineage.materialise(inner, "kept", outlives=True)
        assert kept.count() == inner.count() == 3
        paths = inner._newsloom_path, kept._newsloom_path
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    assert not any(hadoop.Path(p).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop.Path(p)) for p in paths)
