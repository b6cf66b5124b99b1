"""Sources and sinks: feeds, XML dumps, triples, JSON corpora and text folders, read lazily."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

FEED_SCHEMA = "title string, link string, description string, author string, pubDate string, category array<string>, _corrupt_record string"
DUMP_SCHEMA = "title string, ns long, id long, revision struct<id:long,timestamp:string,text:struct<_VALUE:string>>"
ARTICLE_SCHEMA = (
    "ext_url string, text string, title string, image string, authors array<string>, feed struct<`$oid`:string>, "
    "created_at struct<`$date`:bigint>, updated_at struct<`$date`:bigint>"
)
SOURCE_SCHEMA = "_id struct<`$oid`:string>, name string"
FEED_JSON_SCHEMA = "_id struct<`$oid`:string>, ext_url string, source struct<`$oid`:string>"
WANTED = "disambiguations geo_coordinates images instance_types labels long_abstracts mappingbased_properties page_links persondata raw_infobox_properties redirects short_abstracts".split()


def read_feeds(spark: SparkSession, path: str, row_tag: str = "item") -> DataFrame:
    """Entries of RSS files (``row_tag`` entry: Atom). What isn't well formed has _corrupt_record."""
    return spark.read.format("xml").option("rowTag", row_tag).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt_record").schema(FEED_SCHEMA).load(path).withColumn("feed", F.col("_metadata.file_path"))


def feed_errors(entries: DataFrame) -> DataFrame:
    """(feed, errors) to add to a feed's count."""
    # Spark refuses to read the corrupt column alone, so the title comes along
    broken = F.length(F.concat(F.coalesce("_corrupt_record", F.lit("")), F.left(F.coalesce("title", F.lit("")), F.lit(0)))) > 0
    return entries.groupBy("feed").agg(F.count_if(broken).alias("errors"))


def read_dump(spark: SparkSession, path: str, tag: str = "page", schema: str = DUMP_SCHEMA) -> DataFrame:
    """Elements of an XML dump, also of one packed by bzip2, a row each; nothing is held whole."""
    return spark.read.format("xml").option("rowTag", tag).schema(schema).load(path)


def element(path: str) -> Column:
    """A nested element's text, such as revision/text."""
    return F.col(path.replace("/", ".") + "._VALUE")


def read_triples(spark: SparkSession, path: str) -> DataFrame:
    """(s, p, o, lang) from lines of Turtle or N-Triples, also of .bz2; comments and broken lines go."""
    line = r'^\s*<([^>]*)>\s+<([^>]*)>\s+(?:<([^>]*)>|"((?:[^"\\]|\\.)*)"(?:@([A-Za-z-]+)|\^\^<[^>]*>)?)\s*\.\s*$'
    part = lambda k: F.regexp_extract("value", line, k)
    rows = spark.read.text(path).filter(F.col("value").rlike(line))
    return rows.select(part(1).alias("s"), part(2).alias("p"), F.when(part(3) != "", part(3)).otherwise(part(4)).alias("o"), F.nullif(part(5), F.lit("")).alias("lang"))


def write_triples(triples: DataFrame, path: str) -> None:
    """Partitioned by predicate, so that a pattern reads only its own files."""
    triples.repartition("p").sortWithinPartitions("s").write.mode("overwrite").partitionBy("p").parquet(path)


def dataset_urls(pages: DataFrame) -> DataFrame:
    """The wanted datasets' URLs in download pages (html)."""
    links = pages.select(F.explode(F.regexp_extract_all("html", F.lit(r'href="([^"]*)"'), 1)).alias("url"))
    return links.filter(F.contains("url", F.lit("/en/")) & F.endswith("url", F.lit("ttl.bz2")) & F.col("url").rlike("|".join(WANTED))).distinct()


def read_sources(spark: SparkSession, path: str) -> DataFrame:
    """(name, ext_url) from a JSON object of names and lists of feeds."""
    text = spark.read.text(path, wholetext=True)
    return text.select(F.explode(F.from_json("value", "map<string,array<string>>")).alias("name", "urls")).select("name", F.explode("urls").alias("ext_url"))


def read_corpus(spark: SparkSession, folder: str, existing: DataFrame) -> DataFrame:
    """Articles of a JSON corpus whose URL isn't known, with their feed's URL and source's name. Feeds
    and sources are small next to articles; Catalyst broadcasts them where their size allows."""
    read = lambda name, schema: spark.read.schema(schema).option("multiLine", True).json(f"{folder}/{name}.json")
    sources = read("sources", SOURCE_SCHEMA).select(F.col("_id.$oid").alias("source_oid"), F.col("name").alias("source"))
    feeds = read("feeds", FEED_JSON_SCHEMA).select(F.col("_id.$oid").alias("feed_oid"), F.col("ext_url").alias("feed_url"), F.col("source.$oid").alias("source_oid"))
    rows = read("articles", ARTICLE_SCHEMA).join(existing.select("ext_url"), "ext_url", "left_anti")
    rows = rows.withColumn("feed_oid", F.col("feed.$oid")).join(feeds, "feed_oid").join(sources, "source_oid")
    return rows.select("ext_url", "title", "text", "image", "authors", "feed_url", "source", F.timestamp_millis("created_at.$date").alias("created_at"), F.timestamp_millis("updated_at.$date").alias("updated_at"))


def read_texts(spark: SparkSession, folder: str) -> DataFrame:
    """(title, text) of the .txt files of a folder and below; the title is the file's stem."""
    rows = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.txt").text(folder, wholetext=True)
    return rows.select(F.regexp_extract(F.col("_metadata.file_name"), r"^(.*)\.txt$", 1).alias("title"), F.col("value").alias("text"))


def training_texts(articles: DataFrame) -> DataFrame:
    return articles.select(F.concat_ws(" ", "title", "text").alias("text"))


def seed(articles: DataFrame, sources: DataFrame, n: int) -> DataFrame:
    """The first n articles by id of the given sources."""
    return articles.join(sources.select("source"), "source", "left_semi").orderBy("id").limit(n)


def decode(data: Column, charset: Column) -> Column:
    """Bytes as text: by a byte-order mark, else as UTF-8 where that is valid, else by the declared
    character set, else as Latin-1."""
    utf8 = F.when(F.is_valid_utf8(data.cast("string")), data.cast("string"))
    declared = F.when(F.lower(charset).isin("iso-8859-1", "latin-1", "windows-1252", "us-ascii"), F.decode(data, "ISO-8859-1")).when(F.lower(charset).startswith("utf-16"), F.decode(data, "UTF-16"))
    marked = F.when(F.substring(F.hex(data), 1, 4).isin("FEFF", "FFFE"), F.decode(data, "UTF-16"))
    return F.coalesce(marked, utf8, declared, F.decode(data, "ISO-8859-1"))
