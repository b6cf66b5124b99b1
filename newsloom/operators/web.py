"""Web pages: links, feeds and main text, all as expressions over the HTML."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import collapse, full_url

FEED_TYPES = tuple(f"application/{kind}+xml" for kind in ("atom", "rss", "x-atom", "x.atom")) + ("text/xml",)
FEED_ENDINGS = (".rss", ".rdf", ".xml", "atom")  # the last four characters: ".atom" itself has five and can't match
GUESSES = ("feed", *(f"index.{end}" for end in ("atom", "rdf", "rss", "xml")), "atom.xml", "rss.xml")


def anchors(html: Column) -> Column:
    return F.regexp_extract_all(html, F.lit(r'(?i)<a\s[^>]*?href\s*=\s*"([^"]*)"'), 1)


def attribute(tag: Column, name: str) -> Column:
    return F.regexp_extract(tag, rf'(?i)\b{name}\s*=\s*["\']([^"\']*)["\']', 1)


def absolute(base: Column, link: Column) -> Column:
    """A link resolved against a page's URL: absolute, scheme-relative, root-relative or relative."""
    root = F.regexp_extract(base, r"^(https?://[^/]+)", 1)
    folder = F.regexp_replace(F.regexp_replace(base, r"[?#].*$", ""), r"(?<!/)/(?!/)[^/]*$", "")
    return (
        F.when(link.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), link)
        .when(link.startswith("//"), F.concat(F.regexp_extract(base, r"^(https?:)", 1), link))
        .when(link.startswith("/"), F.concat(root, link))
        .otherwise(F.concat(folder, F.lit("/"), link))
    )


def feed_links(url: Column, html: Column) -> Column:
    """Autodiscovery: <link> tags whose rel has the word alternate and whose type is a feed's."""
    tags = F.regexp_extract_all(html, F.lit(r"(?i)(<link\b[^>]*>)"), 1)
    good = F.filter(tags, lambda t: F.array_contains(F.split(F.lower(attribute(t, "rel")), r"\s+"), "alternate") & F.lower(attribute(t, "type")).isin(*FEED_TYPES))
    return F.transform(good, lambda t: absolute(url, attribute(t, "href")))


def is_feed(data: Column) -> Column:
    low = F.lower(data)
    return ~low.contains("<html") & (F.regexp_count(low, F.lit("<rss|<rdf|<feed")) > 0)


def is_feed_link(url: Column) -> Column:
    return F.lower(F.right(url, F.lit(4))).isin(*FEED_ENDINGS[:3], ".atom")


def is_feedish_link(url: Column) -> Column:
    return F.lower(url).rlike("rss|rdf|xml|atom")


def discover(pages: DataFrame, known: DataFrame) -> DataFrame:
    """(url, feed): the feeds of each page (url, html), from the first source that has any: itself,
    <link> tags, feed-like links on the same site, other feedish ones there, usual places, feed-like
    and then other feedish links anywhere. known: (url, html) of what can be fetched; only what is
    there and is a feed counts."""
    full = pages.select(full_url(F.col("url")).alias("url"), "html").withColumn("links", anchors(F.col("html")))
    feeds = known.filter(is_feed(F.col("html"))).select(full_url(F.col("url")).alias("feed")).distinct()
    root = F.regexp_replace("url", r"(?<![/:])/[^/]*$", "")
    local = F.filter("links", lambda link: F.startswith(link, F.col("url")))
    sources = [
        F.array("url"),
        feed_links(F.col("url"), F.col("html")),
        F.filter(local, is_feed_link),
        F.filter(local, is_feedish_link),
        F.array(*[F.concat(root, F.lit("/" + g)) for g in GUESSES]),
        F.filter("links", is_feed_link),
        F.filter("links", is_feedish_link),
    ]
    every = F.concat(*[F.transform(links, lambda link, k=k: F.struct(F.lit(k).alias("priority"), absolute(F.col("url"), link).alias("feed"))) for k, links in enumerate(sources)])
    found = full.select("url", F.explode(every).alias("c")).select("url", "c.priority", "c.feed").join(feeds, "feed", "left_semi")
    best = found.withColumn("best", F.min("priority").over(Window.partitionBy("url"))).filter(F.col("priority") == F.col("best"))
    return best.select("url", "feed").distinct()


def first_feed(found: DataFrame) -> DataFrame:
    return found.groupBy("url").agg(F.min("feed").alias("feed"))


def extract(html: Column) -> Column:
    """(title, text, canonical, image) of a page; bytes before the first < are junk. The text is
    that of <article> where there is one, else of <body>."""
    page = F.when(F.locate("<", html) > 0, F.substr(html, F.locate("<", html)))
    main = F.coalesce(F.nullif(F.regexp_extract(page, r"(?is)<article\b[^>]*>(.*?)</article>", 1), F.lit("")), F.nullif(F.regexp_extract(page, r"(?is)<body\b[^>]*>(.*?)</body>", 1), F.lit("")), page)
    bare = F.regexp_replace(F.regexp_replace(main, r"(?is)<(script|style|nav|footer)\b.*?</\1\s*>|<!--.*?-->", " "), r"(?s)<[^>]*>", " ")
    for name, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        bare = F.replace(bare, F.lit(name), F.lit(char))
    found = lambda pattern: F.nullif(F.regexp_extract(page, pattern, 1), F.lit(""))
    return F.struct(
        F.trim(found(r"(?is)<title[^>]*>(.*?)</title>")).alias("title"),
        F.coalesce(collapse(bare), F.lit("")).alias("text"),
        found(r'(?is)<link[^>]*rel="canonical"[^>]*href="([^"]*)"').alias("canonical"),
        found(r'(?is)<meta[^>]*property="og:image"[^>]*content="([^"]*)"').alias("image"),
    )
