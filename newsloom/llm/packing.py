"""Packing by order-preserving dynamic programming.

Documents in the order of their ids are one long sequence of sentences. Windows of at most
``window`` tokens are cut out of it, each cut at the end of a document or of a sentence. A cut
inside a document truncates it and costs ``truncation``; every token that a window lacks costs 1.
With W the running token count, the least cost of ending a window after sentence i is

    f(i) = cut(i) + window - W(i) + min over j < i, W(j) >= W(i) - window of f(j) + W(j)

and the minimum over a range whose both ends only move forward is kept in a monotone queue: O(n).
Tokens are the ids of the SentencePiece model.

So that the work is spread, the sequence is cut into shards by its running token count: a document
belongs to the shard in which it begins, whatever its id. Each shard is packed by itself, so of the
optimum over the whole sequence no more is given up than the last window of every ``shard_tokens``
tokens. The running count is made in id order by a range partition: counts within a partition,
and the totals of the partitions before it. Only sentence lengths and offsets are shuffled, not
texts: a window is a list of spans (doc_id, from, to) of characters.
"""

from __future__ import annotations

import itertools
import re
from collections import deque
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, discard, materialise, row_key, small_batches
from .sentencepiece_codec import MODEL, Codec, codec, shipped

WINDOW, TRUNCATION, SHARD_TOKENS = 2048, 256.0, 1 << 20
#: white space after a full stop, or line ends; it begins with one class of characters, to which re skips
_END = re.compile(r"\s(?:(?<=[.!?…。]\s)\s*|(?<=\n)\n*)")


def units_of(texts: list[str], window: int, c: Codec) -> list[tuple[list[int], list[int]]]:
    """For each text the ends (in characters) and token counts of its sentences. A sentence has
    the tokens that it is encoded to by itself, without the white space at its end; one of more
    than ``window`` tokens is cut where the next word would be too many, and a word of more than
    that where the next piece would be."""
    stops = [[m.end() for m in _END.finditer(text)] for text in texts]
    for text, found in zip(texts, stops):
        if text and (not found or found[-1] < len(text)):
            found.append(len(text))
    units = [text[a:b].rstrip() for text, found in zip(texts, stops) for a, b in zip([0, *found], found)]
    tokens = c.counts(units)
    out, at = [], 0
    for found in stops:
        counts = tokens[at : at + len(found)]
        if counts and max(counts) > window:
            out.append(_shortened(found, counts, units[at : at + len(found)], window, c))
        else:
            out.append((found, counts))
        at += len(found)
    return out


def _shortened(stops: list[int], tokens: list[int], units: list[str], window: int, c: Codec) -> tuple[list[int], list[int]]:
    """Ends and counts where sentences of more than ``window`` tokens are cut."""
    ends: list[int] = []
    counts: list[int] = []
    for start, stop, n, unit in zip([0, *stops], stops, tokens, units):
        if n > window:
            (words,), ids = c.ids_of_words([unit])
            n, place = 0, start - c.prefix
            for word in words:
                size = len(ids[word]) // 4
                parts = [(len(word), size)] if size <= window else [(len(p), len(c._ids([p]))) for p in c.stream(word)]
                for length, more in parts:
                    if n + more > window:
                        ends.append(place)
                        counts.append(n)
                        n = 0
                    place += length
                    n += more
        ends.append(stop)
        counts.append(n)
    return ends, counts


def cuts(counts: list[int], inside: list[bool], window: int, truncation: float) -> list[int]:
    """The best cuts of a sequence of units: the indices after which a window ends, the last
    included. ``inside[i]``: a cut after unit i is inside a document. Of equally good cuts the
    latest start of the last window wins."""
    n = len(counts)
    total, best, back = 0, [0.0], [0]
    before = [0]
    queue: deque[tuple[float, int]] = deque([(0.0, 0)])  # (f(j) + W(j), j), rising
    for i in range(1, n + 1):
        total += counts[i - 1]
        before.append(total)
        least = total - window
        while before[queue[0][1]] < least:
            queue.popleft()
        value, j = queue[0]
        cost = value + window - total + (truncation if inside[i - 1] else 0.0)
        best.append(cost)
        back.append(j)
        key = cost + total
        while queue and queue[-1][0] >= key:
            queue.pop()
        queue.append((key, i))
    out = []
    while n:
        out.append(n)
        n = back[n]
    return out[::-1]


def _measure(model, window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(model.value)
        for batch in small_batches(batches, "text", 4 << 20):
            found = units_of(batch.column("text").to_pylist(), window, c)
            kind = pa.list_(pa.int32())
            lists = [pa.array([np.array(x[k], np.int32) for x in found], kind) for k in (0, 1)]
            sums = pa.array([sum(x[1]) for x in found], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("tie"), sums, *lists], ["doc_id", "tie", "tokens", "ends", "counts"])

    return run


PLACED = "part int, before long, tokens long, doc_id long, tie long, ends array<int>, counts array<int>"


def _place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each row of a partition with the partition's number and the tokens of the rows before."""
    part, before = TaskContext.get().partitionId(), 0
    for batch in batches:
        tokens = batch.column("tokens").to_numpy()
        sums = np.cumsum(tokens)
        columns = [pa.array(np.full(len(tokens), part, np.int32)), pa.array(before + sums - tokens), *(batch.column(c) for c in ("tokens", "doc_id", "tie", "ends", "counts"))]
        before += int(sums[-1]) if len(sums) else 0
        yield pa.RecordBatch.from_arrays(columns, ["part", "before", "tokens", "doc_id", "tie", "ends", "counts"])


WINDOWS = "shard long, window int, doc_ids array<long>, starts array<int>, ends array<int>, n_tokens int, padding int, truncated int"


def _pack(window: int, truncation: float):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["at", "doc_id", "tie"], kind="stable", na_position="last")
        ids = [None if pd.isna(x) else int(x) for x in pdf.doc_id]
        counts, inside, owner, froms, tos = [], [], [], [], []
        for k, (e, c) in enumerate(zip(pdf.ends, pdf.counts)):
            e, c = e.tolist(), c.tolist()
            counts += c
            inside += [True] * (len(c) - 1) + [False] * bool(c)
            owner += [k] * len(c)
            froms += [0, *e][:-1]
            tos += e
        rows, start = [], 0
        for number, stop in enumerate(cuts(counts, inside, window, truncation)):
            docs, a, b = [], [], []
            last = -1
            for u in range(start, stop):
                if owner[u] != last:
                    last = owner[u]
                    docs.append(ids[last])
                    a.append(froms[u])
                    b.append(tos[u])
                else:
                    b[-1] = tos[u]
            n = sum(counts[start:stop])
            rows.append((pdf["shard"].iloc[0], number, docs, a, b, n, window - n, int(inside[stop - 1])))
            start = stop
        return pd.DataFrame(rows, columns=["shard", "window", "doc_ids", "starts", "ends", "n_tokens", "padding", "truncated"])

    return run


def pack(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, truncation: float = TRUNCATION, shard_tokens: int = SHARD_TOKENS, model: str = MODEL
) -> DataFrame:
    """A row for every window: shard, window (its number in the shard), doc_ids, starts and ends
    (the characters from starts[k] to ends[k] of the document doc_ids[k]), n_tokens, padding and
    truncated (1 if it ends inside a document).

    Every character of every text is in exactly one window. Null and empty texts have no tokens
    and are in no window; blank ones have no tokens and are. Rows with a null id come last. Rows
    with one id, or none, follow each other by content; repeated rows are packed as often as they
    occur. Of cuts of equal cost the one with the shortest last window is taken. An empty table
    gives no windows. Other columns don't matter. Ids only give the order: gaps between them
    change nothing. ``window`` must be 4 at least, the most tokens that a character can have."""
    bound_batches(docs)
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), row_key(text_col).alias("tie"), F.col(text_col).alias("text")).filter(F.length("text") > 0)
    measured = materialise(rows.mapInArrow(_measure(shipped(spark, model), window), "doc_id long, tie long, tokens long, ends array<int>, counts array<int>"), "measured")
    order = [F.col("doc_id").asc_nulls_last(), F.col("tie")]
    ranged = measured.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), *order).sortWithinPartitions(*order)
    placed = materialise(ranged.mapInArrow(_place, PLACED), "placed")
    discard(measured)
    totals = {r[0]: r[1] for r in placed.groupBy("part").agg(F.sum("tokens")).collect()}  # a number for each partition
    offsets = [(part, before) for (part, n), before in zip(sorted(totals.items()), itertools.accumulate([0, *(n for _, n in sorted(totals.items()))]))]
    known = spark.createDataFrame(offsets, "part int, offset long")
    at = (F.col("offset") + F.col("before")).alias("at")
    sharded = placed.join(F.broadcast(known), "part").select(at, "doc_id", "tie", "ends", "counts")
    return sharded.withColumn("shard", F.floor(F.col("at") / F.lit(shard_tokens))).groupBy("shard").applyInPandas(_pack(window, truncation), WINDOWS)
