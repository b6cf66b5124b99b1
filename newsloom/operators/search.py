"""Full-text search over titles and summaries."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ranking import page

_WORDS = r"([\p{L}\p{N}]+)"
#: English words that a query is searched without
STOP_WORDS = frozenset(
    "a about above after again against all am an and any are as at be because been before being below between both but by can did do does doing don down during each few for from further had has have having he her "
    "here hers herself him himself his how i if in into is it its itself just me more most my myself no nor not now of off on once only or other our ours ourselves out over own s same she should so some such t than "
    "that the their theirs them themselves then there these they this those through to too under until up very was we were what when where which while who whom why will with you your yours yourself yourselves".split()
)


def search(tables: dict[str, DataFrame], query: str, types: list[str] | None = None) -> DataFrame:
    """(type, id, title, summary, rank) of rows of ``tables`` (type -> id, title, summary) that have
    all words of ``query``, stop words left out, in the title or all in the summary. A query of stop
    words alone finds nothing.

    The rank looks at the summary alone: 0.1 for each occurrence of a single word; of several, 0.1
    times the covers, the shortest stretches with all words, each by the inverse of what it holds
    beyond them; 0 where only the title matches and null without a summary."""
    terms = [w for w in dict.fromkeys(re.findall(r"[^\W_]+", query.lower())) if w not in STOP_WORDS]
    found = None
    for kind, rows in tables.items():
        if types and kind not in types:
            continue
        rows = rows.select(F.lit(kind).alias("type"), F.col("id").cast("long").alias("id"), "title", "summary")
        found = rows if found is None else found.unionByName(rows)
    title = F.coalesce(F.regexp_extract_all(F.lower("title"), F.lit(_WORDS), 1), F.array().cast("array<string>"))
    words = F.regexp_extract_all(F.lower("summary"), F.lit(_WORDS), 1)
    rows = found.withColumn("t", title).withColumn("w", words)

    def all_in(column: str):
        out = F.lit(bool(terms))
        for term in terms:
            out &= F.coalesce(F.array_contains(column, term), F.lit(False))
        return out

    rows = rows.filter(all_in("t") | all_in("w"))
    if not terms:
        rank = F.lit(0.0)
    elif len(terms) == 1:
        rank = F.round(F.size(F.filter("w", lambda x: x == terms[0])) * 0.1, 6)
    else:
        rank = F.when(all_in("w"), F.round(_covers(terms) * 0.1, 6)).otherwise(F.lit(0.0))
    rank = F.when(F.col("summary").isNull(), F.lit(None)).otherwise(rank + F.lit(0.0))
    return rows.select("type", "id", "title", "summary", rank.alias("rank"))


def _covers(terms: list[str]):
    """For each place, the place of the last occurrence so far of every term; a cover ends where its
    least one moves. The fold keeps one place for each term and the sum."""
    k = len(terms)
    start = F.struct(F.array_repeat(F.lit(-1), k).alias("at"), F.lit(-1).alias("low"), F.lit(0.0).alias("sum"))

    def step(acc, item):
        at = F.array(*[F.when(item["x"] == t, item["i"]).otherwise(F.element_at(acc["at"], n + 1)) for n, t in enumerate(terms)])
        low, high = F.array_min(at), F.array_max(at)
        new = (low >= 0) & (low > acc["low"])
        return F.struct(at.alias("at"), F.when(new, low).otherwise(acc["low"]).alias("low"), F.when(new, acc["sum"] + 1.0 / (high - low + 1 - k + 1)).otherwise(acc["sum"]).alias("sum"))

    items = F.filter(F.transform("w", lambda x, i: F.struct(x.alias("x"), i.alias("i"))), lambda z: z["x"].isin(terms))
    return F.aggregate(items, start, step, lambda acc: acc["sum"])


def search_page(tables: dict[str, DataFrame], query: str, types: list[str] | None = None, number: int = 1) -> DataFrame:
    return page(search(tables, query, types), [F.col("rank").desc_nulls_first(), F.col("type"), F.col("id")], number)


def search_count(tables: dict[str, DataFrame], query: str, types: list[str] | None = None) -> DataFrame:
    return search(tables, query, types).agg(F.count(F.lit(1)).alias("total_count"))
