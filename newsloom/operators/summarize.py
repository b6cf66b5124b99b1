"""Summaries of one document, by scored sentences, and of several, by clusters of sentences."""

from __future__ import annotations

import heapq
import re
import tempfile
from array import array
from collections import Counter
from collections.abc import Iterable, Iterator
from itertools import groupby
from typing import BinaryIO

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.window import Window

from ..functions.text import STOP_WORDS, position_score, sentence_length_score, sentences, tokens
from ..plans.lineage import bound_batches, materialise

_WORD = re.compile(r"[^\W_]+")


def _total(text: Column) -> Column:
    return F.size(F.filter(F.split(F.trim(F.regexp_replace(text, r"[^\p{L}\p{N}_ ]", "")), " +"), lambda w: F.length(w) > 0))


def _repeated(docs: DataFrame, id_col: str) -> DataFrame | None:
    """(id) of the documents whose id others have too, or nothing."""
    ids = materialise(docs.select(F.col(id_col).alias("id")).groupBy("id").count().filter("count > 1").select("id"), "repeated")
    return ids if ids.take(1) else None


def _most_frequent(doc: np.ndarray, code: np.ndarray, words: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, word, n) of each document's k most frequent words, ties in alphabetical order."""
    key, n = np.unique(doc * max(1, len(words)) + code, return_counts=True)
    doc, code = np.divmod(key, max(1, len(words)))
    place = np.empty(len(words), np.int64)
    place[pc.sort_indices(words).to_numpy()] = np.arange(len(words))
    order = np.lexsort((place[code], -n, doc))
    doc, code, n = doc[order], code[order], n[order]
    best = np.arange(len(doc)) - np.searchsorted(doc, doc) < k
    return doc[best], code[best], n[best]


def _lengths(lists: pa.Array) -> np.ndarray:
    return lists.value_lengths().fill_null(0).to_numpy().astype(np.int64)


def keywords(docs: DataFrame, id_col: str = "id", text_col: str = "text", k: int = 10) -> DataFrame:
    """(id, word, weight): the k most frequent words without stop words, ties in alphabetical order;
    1.5 times the share of all words, plus 1. A document is counted where it is; only those that
    have an id in common are counted together, by a shuffle of their words."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(2)
            encoded = lists.flatten().dictionary_encode()
            doc = np.repeat(np.arange(batch.num_rows), _lengths(lists))
            doc, code, n = _most_frequent(doc, encoded.indices.to_numpy().astype(np.int64), encoded.dictionary, k)
            at = pa.array(doc)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), encoded.dictionary.take(pa.array(code)), pa.array(n, pa.int64()), batch.column(1).take(at)], ["id", "word", "n", "total"])

    bound_batches(docs)
    # the total is made before the words are exploded: beside explode it would be made for each word
    totals = docs.select(F.col(id_col).alias("id"), _total(F.col(text_col)).alias("total"), tokens(F.col(text_col)).alias("words"))
    repeated = _repeated(docs, id_col)
    alone = totals if repeated is None else totals.alias("t").join(repeated.alias("r"), F.expr("t.id <=> r.id"), "left_anti")
    best = alone.mapInArrow(run, f"id {kind}, word string, n long, total int")
    if repeated is not None:
        words = totals.alias("t").join(repeated.alias("r"), F.expr("t.id <=> r.id"), "left_semi").select("id", "total", F.explode("words").alias("word"))
        counts = words.groupBy("id", "word").agg(F.count(F.lit(1)).alias("n"), F.first("total").alias("total"))
        most = counts.withColumn("rank", F.row_number().over(Window.partitionBy("id").orderBy(F.col("n").desc(), "word"))).filter(F.col("rank") <= k)
        best = best.unionByName(most.drop("rank"))
    return best.select("id", "word", (F.col("n") / F.col("total") * 1.5 + 1).alias("weight"))


def _measures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each sentence, from (id, total, title, all, words) of documents: sums over its words
    that are keywords of its document, or in its title."""
    for batch in batches:
        ids, total, titles, split, lists = batch.columns
        n = _lengths(split)
        inner = lists.flatten()
        words = _lengths(inner)
        rows = len(words)
        doc = np.repeat(np.arange(batch.num_rows), n)
        pos = np.arange(rows) - np.repeat(np.cumsum(n) - n, n) + 1
        in_text, in_title = inner.flatten(), titles.flatten()
        # empty arrays from the JVM may have no offsets, which can't be put together
        encoded = pa.concat_arrays([x for x in (in_text, in_title) if len(x)] or [pa.array([], pa.string())]).dictionary_encode()
        codes, base = encoded.indices.to_numpy().astype(np.int64), max(1, len(encoded.dictionary))
        code, title = codes[: len(in_text)], codes[len(in_text) :]
        title_size = _lengths(titles)
        sentence = np.repeat(np.arange(rows), words)
        key = doc[sentence] * base + code
        d, c, count = _most_frequent(doc[sentence], code, encoded.dictionary, 10)
        order = np.argsort(d * base + c)
        known = (d * base + c)[order]
        weight = (count / total.fill_null(1).to_numpy()[d] * 1.5 + 1)[order]
        place = np.minimum(np.searchsorted(known, key), max(0, len(known) - 1))
        at = np.flatnonzero(known[place] == key) if len(known) else np.zeros(0, np.int64)  # the words that are keywords
        of, w = sentence[at], weight[place[at]]
        follows = of[1:] == of[:-1]
        pair = (w[1:] * w[:-1] / (np.diff(at).astype(np.float64) ** 2))[follows]
        titled = np.isin(key, np.repeat(np.arange(batch.num_rows), title_size) * base + title)
        size = title_size[doc]
        yield pa.RecordBatch.from_arrays(
            [
                ids.take(pa.array(doc)),
                pa.array(pos, pa.int32()),
                pa.array(n[doc], pa.int32()),
                split.flatten(),
                pa.array(words, pa.int32()),
                pa.array(np.bincount(sentence[titled], minlength=rows), pa.int64()),
                pa.array(size, pa.int64(), mask=size == 0),
                pa.array(np.bincount(of, w, rows).astype(np.float64)),
                pa.array(np.bincount(of[1:][follows], pair, rows).astype(np.float64)),
                pa.array(np.bincount(np.unique(of * base + code[at]) // base, minlength=rows) + 1, pa.int64()),
            ],
            ["id", "pos", "n", "sentence", "words", "in_title", "title_size", "weights", "pairs", "k"],
        )


def sentence_features(docs: DataFrame, id_col: str = "id", title_col: str = "title", text_col: str = "text") -> DataFrame:
    """(id, pos, n, sentence, words, title_score, length_score, position_score, sbs, dbs), the rows of
    a document one after the other.

    All of it is of one document, so there is no shuffle: keywords and title words are looked up by
    number within a batch of documents, which is bounded."""
    bound_batches(docs)
    split = docs.select(F.col(id_col).alias("id"), _total(F.col(text_col)).alias("total"), tokens(F.col(title_col)).alias("title"), sentences(F.col(text_col)).alias("all"))
    each = split.select("id", "total", "title", "all", F.transform("all", tokens).alias("words"))
    kind = docs.schema[id_col].dataType.simpleString()
    every = each.mapInArrow(_measures, f"id {kind}, pos int, n int, sentence string, words int, in_title long, title_size long, weights double, pairs double, k long")
    return every.select(
        "id",
        "pos",
        "n",
        "sentence",
        "words",
        (F.col("in_title") / F.col("title_size")).alias("title_score"),
        sentence_length_score(F.col("words")).alias("length_score"),
        position_score(F.col("pos"), F.col("n")).alias("position_score"),
        F.coalesce(F.try_divide("weights", "words") / 10, F.lit(0.0)).alias("sbs"),
        (F.col("pairs") / (F.col("k") * (F.col("k") + 1))).alias("dbs"),
    )


def sentence_scores(docs: DataFrame, id_col: str = "id", title_col: str = "title", text_col: str = "text") -> DataFrame:
    """(id, pos, sentence, score)."""
    c = F.col
    total = (F.coalesce("title_score", F.lit(0.0)) * 1.5 + (c("sbs") + c("dbs")) / 2 * 10 * 2 + c("length_score") + c("position_score")) / 4
    return sentence_features(docs, id_col, title_col, text_col).select("id", "pos", "sentence", F.round(total, 9).alias("score"))


def summarize(docs: DataFrame, id_col: str = "id", title_col: str = "title", text_col: str = "text", length: int = 5) -> DataFrame:
    """(id, rank, sentence, score): the best sentences in order of rank. Equal sentences are one,
    with the score of the last; ties go to the earlier one. The sentences of a document come one
    after the other, so the best are taken as they come; only documents that have an id in common
    are put together, by a shuffle of their best."""
    kind = docs.schema[id_col].dataType.simpleString()
    schema = pa.schema([("id", to_arrow_type(docs.schema[id_col].dataType)), ("rank", pa.int32()), ("sentence", pa.string()), ("score", pa.float64()), ("pos", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        of, one = None, {}

        def close() -> None:
            best = heapq.nsmallest(length, one.items(), key=lambda x: (-x[1][0], x[1][1]))
            rows.extend((of, rank, sentence, score, pos) for rank, (sentence, (score, pos)) in enumerate(best, 1))

        for batch in batches:
            for doc, pos, sentence, score in zip(*(c.to_pylist() for c in batch.columns)):
                if pos == 1:
                    close()
                    of, one = doc, {}
                one[sentence] = (score, one[sentence][1] if sentence in one else pos)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else [[]] * 5, schema)], schema=schema)
            rows.clear()
        close()
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else [[]] * 5, schema)], schema=schema)

    scored = sentence_scores(docs, id_col, title_col, text_col).select("id", "pos", "sentence", "score")
    best = scored.mapInArrow(run, f"id {kind}, rank int, sentence string, score double, pos int")
    repeated = _repeated(docs, id_col)
    if repeated is not None:
        some = best.alias("t").join(repeated.alias("r"), F.expr("t.id <=> r.id"), "left_semi")
        one = some.groupBy("id", "sentence").agg(F.max_by("score", F.struct("pos", "score")).alias("score"), F.min("pos").alias("pos"))
        ranked = one.withColumn("rank", F.row_number().over(Window.partitionBy("id").orderBy(F.col("score").desc(), "pos", "sentence")))
        best = best.alias("t").join(repeated.alias("r"), F.expr("t.id <=> r.id"), "left_anti").unionByName(ranked.filter(F.col("rank") <= length))
    return best.select("id", "rank", "sentence", "score")


def _tokens(text: str) -> list[str]:
    return [w for w in _WORD.findall(text.lower()) if w not in _STOP]


_STOP = frozenset(STOP_WORDS)


#: counters for words by hash, which tell words that occur in one sentence only
_COUNTERS = 1 << 24


def multi_summary(texts: Iterable[str], length: int = 5, least: float = 0.2) -> list[str]:
    """Sentences join, in order, the cluster with the highest average cosine (at least ``least``; of
    equal ones the later); of each of the largest clusters the sentence with the best average
    similarity, less its distance from 20 words, over its position.

    Texts are read once and may be a stream. Sentences go to a file; what is kept in memory is
    numbers: the words of sentences, and for each word the clusters that have it and how much, in
    places as many as there are sentences with it. Words of one sentence meet no other, so they get
    none."""
    with tempfile.TemporaryFile() as file:
        return _multi_summary(texts, length, least, file)


def _multi_summary(texts: Iterable[str], length: int, least: float, file: BinaryIO) -> list[str]:
    starts, orders = array("q", [0]), array("i")
    seen = np.zeros(_COUNTERS, np.uint8)
    for t in texts:
        for k, s in enumerate((x for x in re.split(r"(?<=[.!?])\s+", t.strip()) if x), 1):
            data = s.encode("utf-8", "surrogatepass")
            file.write(data)
            starts.append(starts[-1] + len(data))
            orders.append(k)
            at = np.fromiter({hash(w) % _COUNTERS for w in _tokens(s)}, np.int64)
            seen[at] = np.minimum(seen[at] + 1, 2)
    # a word that may be in several sentences has a number, any other a negative one by its place
    numbers: dict[str, int] = {}
    room = array("i")
    words, ends = array("i"), array("q", [0])
    file.seek(0)
    for r in range(len(orders)):
        ws = _tokens(file.read(starts[r + 1] - starts[r]).decode("utf-8", "surrogatepass"))
        lone: dict[str, int] = {}
        for w in ws:
            words.append((numbers.setdefault(w, len(numbers)) if seen[hash(w) % _COUNTERS] > 1 else lone.setdefault(w, -1 - len(lone))))
        room.extend([0] * (len(numbers) - len(room)))
        for w in set(words[ends[-1] :]):
            if w >= 0:
                room[w] += 1
        ends.append(len(words))
    del numbers, seen

    def unit(r: int) -> dict[int, float]:
        counts = Counter(words[ends[r] : ends[r + 1]])
        norm = np.sqrt(np.float32(sum(n * n for n in counts.values())))
        return {w: float(np.float32(n) / norm) for w, n in counts.items()}

    # sums of unit vectors by word, one word after the other
    first = np.concatenate([[0], np.cumsum(np.frombuffer(room, np.int32), dtype=np.int64)]) if room else np.zeros(1, np.int64)
    del room
    found, sums, used = np.zeros(first[-1], np.int32), np.zeros(first[-1]), np.zeros(len(first) - 1, np.int32)
    n = len(orders)
    joined, sizes, sims, blank = np.zeros(n, np.int32), np.zeros(n), np.zeros(n), np.zeros(n, bool)
    clusters = 0
    for r in range(n):
        vector, at = unit(r), None
        posts = [(w, u, slice(first[w], first[w] + used[w])) for w, u in vector.items() if w >= 0 and used[w]]
        if posts or (vector and clusters and least <= 1e-9):
            near = [found[span] for _, _, span in posts]
            for on, (_, u, span) in zip(near, posts):
                sims[on] += sums[span] * u
            # clusters without any of the words are at 0, which counts only where the limit is no higher
            on = np.concatenate(near) if least > 1e-9 else np.flatnonzero(~blank[:clusters])
            values = sims[on] / sizes[on]
            sims[on] = 0.0
            if len(on) and (best := values.max()) >= least - 1e-9:
                close, where = np.unique(on[values >= best - 1e-6], return_index=True)
                values = values[values >= best - 1e-6][where]
                k = int(values.argmax())
                at = int(close[k])
                for k in range(k + 1, len(close)):
                    if values[k] >= best - 1e-9:
                        best, at = values[k], int(close[k])
        fresh = at is None
        if fresh:
            at, clusters = clusters, clusters + 1
            blank[at] = not vector
        joined[r] = at
        sizes[at] += 1
        for w, u in vector.items():
            if w < 0:
                continue
            low, k = first[w], used[w]
            hit = -1 if fresh or not k else int((found[low : low + k] == at).argmax())
            if hit >= 0 and found[low + hit] == at:
                sums[low + hit] += u
            else:
                found[low + k], sums[low + k], used[w] = at, u, k + 1
    out = []
    for k in np.argsort(-sizes[:clusters], kind="stable")[:length]:
        best, chosen = 0.0, None
        for r in np.flatnonzero(joined == k):
            vector = unit(r)
            if not vector:
                continue
            # a word of one sentence adds its own square
            parts = (u * (u if w < 0 else sums[first[w] + np.flatnonzero(found[first[w] : first[w] + used[w]] == k)[0]]) for w, u in vector.items())
            similarity = sum(parts) / sizes[k]
            score = (similarity - abs(20 - (ends[r + 1] - ends[r])) / 20 / 2) / orders[r]
            if score >= best:
                best, chosen = score, r
        if chosen is None:
            out.append("")
            continue
        file.seek(starts[chosen])
        out.append(file.read(starts[chosen + 1] - starts[chosen]).decode("utf-8", "surrogatepass"))
    return out


def multi_summarize(members: DataFrame, cluster: str, id_col: str, text_col: str = "text", length: int = 5) -> DataFrame:
    """(cluster, rank, sentence). Sequential within a cluster by definition, so a cluster is in one
    task, which reads its members in order as a stream; clusters run in parallel."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = ((c, t) for batch in batches for c, t in zip(batch.column(0).to_pylist(), batch.column(1)))
        for c, group in groupby(rows, lambda row: row[0]):
            found = multi_summary((t.as_py() or "" for _, t in group), length)
            yield pa.RecordBatch.from_pydict({cluster: pa.array([c] * len(found), pa.int64()), "rank": pa.array(range(1, len(found) + 1), pa.int32()), "sentence": pa.array(found, pa.string())})

    bound_batches(members)
    parts = max(200, int(members.sparkSession.conf.get("spark.sql.shuffle.partitions")))  # by number, so that small ones aren't put together: their time isn't small
    # by a hash that no join before it can have as its key: a join's own partitions might be split by their size
    ordered = members.select(F.col(cluster).cast("long").alias(cluster), id_col, text_col).repartition(parts, F.xxhash64(cluster)).sortWithinPartitions(cluster, id_col)
    return ordered.select(cluster, text_col).mapInArrow(run, f"{cluster} long, rank int, sentence string")


def cluster_summary(members: DataFrame, cluster: str, id_col: str = "id", title_col: str = "title", text_col: str = "text") -> DataFrame:
    """(cluster, rank, sentence): a cluster of one document is summarised as that, others together."""
    sizes = members.groupBy(cluster).agg(F.count(F.lit(1)).alias("size"))
    tagged = members.join(sizes, cluster)
    alone = tagged.filter("size = 1")
    single = summarize(alone, id_col, title_col, text_col).join(alone.select(F.col(id_col).alias("id"), cluster), "id").select(cluster, "rank", "sentence")
    return single.unionByName(multi_summarize(tagged.filter("size > 1"), cluster, id_col, text_col))


def provenance(summaries: DataFrame, members: DataFrame, cluster: str, id_col: str = "id") -> DataFrame:
    """Each summary sentence with the first member that contains it: an equi-join on the cluster,
    so that the test for containment never runs over all pairs."""
    summaries = materialise(summaries, "summaries")  # else they would be made for each join
    m = members.select(cluster, F.col(id_col).alias("member"), F.concat_ws(" ", "title", "text").alias("whole"), "source", "ext_url")
    hit = summaries.join(m, cluster).filter(F.contains("whole", "sentence")).groupBy(cluster, "rank").agg(F.min_by(F.struct("member", "source", "ext_url"), "member").alias("from"))
    return summaries.join(hit, [cluster, "rank"], "left").select(cluster, "rank", "sentence", "from.member", "from.source", "from.ext_url")
