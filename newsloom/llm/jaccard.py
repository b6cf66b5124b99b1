"""N-gram Jaccard join with Bayesian candidate pruning.

Two documents match when the Jaccard similarity of their sets of word n-grams is at least
``threshold``. Documents with one set are collapsed first, so thousands of copies cost as much as
one. Of each distinct set, ``BANDS`` bands of ``ROWS`` MinHash values find candidates.

A bucket of at most ``CROWD`` sets gives candidate pairs as rows. A pair's MinHash values are compared ``STEP`` at a time; after each step, with m of n equal and
a uniform prior, the posterior of the similarity is Beta(m + 1, n - m + 1), and the pair goes as
soon as the probability of reaching the threshold is below ``tolerance``. What is left is verified
on the n-grams themselves, so no reported similarity is an estimate. So that not each pair carries
two texts, the pairs are put in groups around the least member, groups are cut in blocks of about
``BLOCK`` documents or ``BLOCK_BYTES``, and what is needed of a document is sent once to each pair
of blocks. Signatures go first; texts follow only for documents of pairs that pruning has left.

A cluster of m near copies has m**2 / 2 pairs, far too many for rows. Larger buckets are therefore
never made pairs: those with one least member are a crowd, all of whose members are compared with
each other, without pruning, block against block as a product of matrices of zeros and ones over
64-bit hashes of n-grams. Each pair is looked at in the first crowd that has both. Of a pair of
blocks come back a row for each document with its number of links and the least document that it
is connected with there; where pairs are asked for, all of them. No bucket, list of partners or
text is cut off.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, discard, hashed, joined_side, materialise, row_key, small_batches, trim

N, THRESHOLD, TOLERANCE = 3, 0.5, 0.001
BANDS, ROWS, STEP, BLOCK, BLOCK_BYTES, CROWD = 48, 4, 16, 256, 8 << 20, 64
HASHES = BANDS * ROWS

_TOKEN = re.compile(r"\w+")
_random = np.random.RandomState(20240229)
_A = (_random.randint(0, 2**31, HASHES).astype(np.uint32) << np.uint32(1)) | np.uint32(1)
_B = _random.randint(0, 2**32, HASHES, dtype=np.uint64).astype(np.uint32)
_P = _random.randint(1, 2**63, 64, dtype=np.uint64) | np.uint64(1)


def words_of(text: str) -> list[str]:
    return _TOKEN.findall(text.lower())


def ngrams(text: str, n: int = N) -> set[tuple[str, ...]]:
    """The set of word n-grams, in lower case and without punctuation; of a text with fewer than
    n words, its words as one n-gram; of a text without words, the empty set."""
    words = words_of(text)
    if not words:
        return set()
    return set(zip(*(words[k:] for k in range(n)))) if len(words) >= n else {tuple(words)}


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def hashes_of(text: str, n: int = N) -> np.ndarray:
    """One 64-bit hash for each distinct n-gram, sorted."""
    words = words_of(text)
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    if len(h) < n:
        return _mix(np.array([(h * _P[: len(h)]).sum() + np.uint64(len(h))], np.uint64))
    x = h[: len(h) - n + 1] * _P[0]
    for k in range(1, n):
        x = x + h[k : len(h) - n + 1 + k] * _P[k]
    return np.unique(_mix(x))


def signature(hashes: np.ndarray) -> np.ndarray:
    low = (hashes >> np.uint64(32)).astype(np.uint32)
    out = np.full(HASHES, 2**32 - 1, np.uint32)
    for at in range(0, len(low), 512):
        np.minimum(out, (low[at : at + 512, None] * _A + _B).min(0), out=out)
    return out


def least_matches(threshold: float, tolerance: float) -> list[int]:
    """For n = STEP, 2 STEP, ... compared values: the fewest equal ones with which the posterior
    probability of the threshold is still at least the tolerance."""
    grid = (np.arange(20_000) + 0.5) / 20_000
    out = []
    for n in range(STEP, HASHES + 1, STEP):
        for m in range(n + 1):
            logs = m * np.log(grid) + (n - m) * np.log1p(-grid)
            density = np.exp(logs - logs.max())
            if density[grid >= threshold].sum() / density.sum() >= tolerance:
                break
        out.append(m)
    return out


def _sign(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = _P[:ROWS]
        for batch in small_batches(batches, "text"):
            rows, sets, signs, bands = [], [], [], []
            for k, text in enumerate(batch.column("text").to_pylist()):
                h = hashes_of(text, n)
                if not len(h):
                    continue
                s = signature(h)
                rows.append(k)
                sets.append(np.int64(np.uint64(xxhash.xxh3_64_intdigest(h.tobytes())).view(np.int64)))
                signs.append(s.tobytes())
                bands.append(_mix((s.reshape(BANDS, ROWS).astype(np.uint64) * p).sum(1) + np.arange(BANDS, dtype=np.uint64)).view(np.int64))
            at = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(at), batch.column("tie").take(at), batch.column("size").take(at), pa.array(sets, pa.int64()), pa.array(signs, pa.binary()), pa.array(bands, pa.list_(pa.int64()))],
                ["doc_id", "tie", "size", "node", "sign", "bands"],
            )

    return run


def overlaps(pairs: np.ndarray, sets: dict[int, set]) -> np.ndarray:
    """The sizes of the intersections of pairs of sets. Where many pairs share few sets, as a
    product of matrices of zeros and ones, a stretch of columns at a time; exact either way."""
    nodes = np.unique(pairs)
    numbers: dict[tuple, int] = {}
    found = {int(i): np.fromiter((numbers.setdefault(g, len(numbers)) for g in sets[int(i)]), np.int64) for i in nodes}
    if len(pairs) < 8 * len(nodes):
        whole = {i: set(x.tolist()) for i, x in found.items()}
        return np.array([len(whole[int(a)] & whole[int(b)]) for a, b in pairs], np.int64)
    row = np.repeat(np.arange(len(nodes)), [len(found[int(i)]) for i in nodes])
    column = np.concatenate([found[int(i)] for i in nodes])
    x, y = np.searchsorted(nodes, pairs[:, 0]), np.searchsorted(nodes, pairs[:, 1])
    both = np.zeros((len(nodes), len(nodes)), np.float64)
    for at in range(0, len(numbers), 4096):
        inside = (column >= at) & (column < at + 4096)
        part = np.zeros((len(nodes), min(4096, len(numbers) - at)), np.float32)
        part[row[inside], column[inside] - at] = 1
        both += part @ part.T
    return both[x, y].astype(np.int64)


def _of_blocks(batches: Iterator[pa.RecordBatch], column: str, decide) -> Iterator[pa.RecordBatch]:
    """``decide(key, pairs, things)`` for each pair of blocks: ``pairs`` of nodes and, by node, what
    ``column`` holds. Rows come in the order of their keys, for each key the nodes first."""
    key, pairs, things = None, [], {}
    for batch in batches:
        for k, a, b, thing in zip(*(batch.column(c).to_pylist() for c in ("key", "a", "b", column))):
            if k != key:
                if pairs:
                    yield from decide(key, np.array(pairs, np.int64), things)
                key, pairs, things = k, [], {}
            if b is None:
                things[a] = thing
            else:
                pairs.append((a, b))
    if pairs:
        yield from decide(key, np.array(pairs, np.int64), things)


def _prune(threshold: float, tolerance: float):
    """Of the pairs of each pair of blocks, those that may still reach the threshold."""
    least = least_matches(threshold, tolerance)

    def decide(key: int, pairs: np.ndarray, signs: dict[int, bytes]) -> Iterator[pa.RecordBatch]:
        nodes = np.fromiter(sorted(signs), np.int64, len(signs))
        every = np.frombuffer(b"".join(signs[int(i)] for i in nodes), np.uint32).reshape(len(nodes), HASHES)
        x, y = np.searchsorted(nodes, pairs[:, 0]), np.searchsorted(nodes, pairs[:, 1])
        equal = np.zeros(len(pairs), np.int32)
        alive = np.arange(len(pairs))
        for step, fewest in enumerate(least):
            columns = every[:, step * STEP : (step + 1) * STEP]
            equal[alive] += (columns[x[alive]] == columns[y[alive]]).sum(1, dtype=np.int32)
            alive = alive[equal[alive] >= fewest]
        if len(alive):
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(alive), key)), pa.array(pairs[alive, 0]), pa.array(pairs[alive, 1])], ["key", "a", "b"])

    return lambda batches: _of_blocks(batches, "sign", decide)


def _verify(n: int, threshold: float):
    def decide(key: int, pairs: np.ndarray, texts: dict[int, str]) -> Iterator[pa.RecordBatch]:
        sets = {i: ngrams(text, n) for i, text in texts.items()}
        both = overlaps(pairs, sets)
        sizes = [np.fromiter((len(sets[int(i)]) for i in pairs[:, k]), np.int64, len(pairs)) for k in (0, 1)]
        similar = both / (sizes[0] + sizes[1] - both)
        good = similar >= threshold
        yield pa.RecordBatch.from_arrays([pa.array(pairs[good, 0]), pa.array(pairs[good, 1]), pa.array(similar[good])], ["a", "b", "jaccard"])

    return lambda batches: _of_blocks(batches, "text", decide)


def shared(hashes: list[np.ndarray], n_left: int, within: bool) -> np.ndarray:
    """The sizes of the intersections of the first ``n_left`` sets with the others, or ``within``
    one block of all with all, as a product of matrices, a stretch of columns at a time."""
    row = np.repeat(np.arange(len(hashes)), [len(h) for h in hashes])
    _, column = np.unique(np.concatenate(hashes), return_inverse=True)
    times = np.bincount(column)
    left = times if within else np.bincount(column[row < n_left], minlength=len(times))
    useful = times > 1 if within else (left > 0) & (left < times)
    row, column = row[useful[column]], (np.cumsum(useful) - 1)[column[useful[column]]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    both = np.zeros((n_left, len(hashes) if within else len(hashes) - n_left), np.float64)
    for at in range(0, int(useful.sum()), 4096):
        a, b = np.searchsorted(column, [at, at + 4096])
        part = np.zeros((len(hashes), min(4096, int(useful.sum()) - at)), np.float32)
        part[row[a:b], column[a:b] - at] = 1
        both += part @ part.T if within else part[:n_left] @ part[n_left:].T
    return both


def _crowd(n: int, threshold: float, listed: bool):
    """Compares the documents of pairs of blocks of crowds. Rows come in the order of their keys."""

    def decide(crowd: int, within: bool, rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        rows.sort(key=lambda r: r[:2])
        block, nodes, times = (np.array([r[k] for r in rows], np.int64) for k in range(3))
        n_left = len(rows) if within else int((block == block[0]).sum())
        if not within and n_left == len(rows):
            return
        x, y = slice(0, n_left), slice(0 if within else n_left, len(rows))
        mask = np.ones((n_left, len(nodes[y])), bool)
        if within:
            mask = np.triu(mask, 1)
        for other in sorted({c for r in rows for c in r[3] if c < crowd}):
            there = np.array([other in r[3] for r in rows])
            mask &= ~(there[x, None] & there[None, y])
        if not mask.any():
            return
        hashes = [hashes_of(r[4], n) for r in rows]
        sizes = np.array([len(h) for h in hashes])
        both = shared(hashes, n_left, within)
        similar = both / (sizes[x, None] + sizes[None, y] - both)
        good = mask & (similar >= threshold)
        if listed:
            i, j = np.nonzero(good)
            a, b = nodes[x][i], nodes[y][j]
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b)), pa.array(similar[i, j])], ["a", "b", "jaccard"])
            return
        links = np.zeros(len(rows), np.int64)
        links[x] += good @ times[y]
        links[y] += good.T @ times[x]
        label = nodes.copy()
        while True:
            new = label.copy()
            most = np.iinfo(np.int64).max
            new[x] = np.minimum(new[x], np.where(good, new[None, y], most).min(1))
            new[y] = np.minimum(new[y], np.where(good, new[x, None], most).min(0))
            if (new == label).all():
                break
            label = new
        some = links > 0
        yield pa.RecordBatch.from_arrays([pa.array(nodes[some]), pa.array(label[some]), pa.array(links[some])], ["a", "b", "links"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, rows = None, []
        for batch in batches:
            for key, crowd, within, *row in zip(*(batch.column(c).to_pylist() for c in ("key", "crowd", "within", "block", "node", "times", "crowds", "text"))):
                if last and key != last[0]:
                    yield from decide(*last[1:], rows)
                    rows = []
                last = key, crowd, within
                rows.append(tuple(row))
        if last:
            yield from decide(*last[1:], rows)
        trim()

    return run


class Matches:
    """The parts of a join: ``members`` (node, doc_id, tie) for every row with words, where a node
    is a distinct set of n-grams, and ``times`` (node, times), of how many documents it is the set.
    Of the matching nodes, where they are ``listed``, ``pairs`` (a, b, jaccard), a < b. Else
    ``edges`` (a, b), fewer than the pairs but with the same connected components, and ``links``
    (node, links), with how many documents of other nodes those of a node match."""

    def __init__(self, docs: DataFrame, id_col: str, text_col: str, n: int, threshold: float, tolerance: float, listed: bool = False):
        bound_batches(docs)
        keyed = docs.select(F.col(id_col).cast("long").alias("doc_id"), row_key(id_col, text_col).alias("tie"), F.octet_length(text_col).alias("size"), F.col(text_col).alias("text")).filter(F.length("text") > 0)
        signed = materialise(keyed.mapInArrow(_sign(n), "doc_id long, tie long, size int, node long, sign binary, bands array<long>"), "signatures")
        self.members = signed.select("node", "doc_id", "tie")
        self.times = self.members.distinct().groupBy("node").agg(F.count(F.lit(1)).alias("times"))
        one = signed.groupBy("node").agg(F.min(F.struct("doc_id", "tie", "size")).alias("at"), F.first("sign").alias("sign")).select("node", "at.*", "sign")
        nodes = materialise(signed.groupBy("node").agg(F.first("bands").alias("bands")), "bands")
        bands = nodes.select("node", F.explode("bands").alias("band"))
        full = materialise(bands.groupBy("band").agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("crowd")).filter(F.col("n") > CROWD).select("band", "crowd"), "full")
        crowds = materialise(bands.join(joined_side(full), "band").groupBy("node").agg(F.sort_array(F.collect_set("crowd")).alias("crowds")), "crowds")
        bands = bands.join(joined_side(full), "band", "left_anti")
        left, right = bands.select(F.col("node").alias("a"), "band"), bands.select(F.col("node").alias("b"), "band")
        candidates = left.join(right, "band").filter("a < b").select("a", "b").distinct()
        candidates = candidates.join(joined_side(crowds.toDF("a", "of_a")), "a", "left").join(joined_side(crowds.toDF("b", "of_b")), "b", "left")
        candidates = materialise(candidates.filter(~F.coalesce(F.arrays_overlap("of_a", "of_b"), F.lit(False))).select("a", "b"), "candidates")
        discard(nodes)
        discard(full)
        near = self._verified(keyed, one, candidates, n, threshold, tolerance)
        crowded = self._crowded(keyed, one, crowds, n, threshold, listed)
        discard(crowds)
        if listed:
            self.pairs = near.union(crowded)
            return
        ends = near.select("a", "b").union(near.select("b", "a"))
        links = ends.join(self.times.withColumnRenamed("node", "b"), "b").select(F.col("a").alias("node"), F.col("times").alias("links"))
        self.links = links.union(crowded.select(F.col("a").alias("node"), "links")).groupBy("node").agg(F.sum("links").alias("links"))
        self.edges = near.select("a", "b").union(crowded.filter("a != b").select("a", "b"))

    @staticmethod
    def _verified(keyed: DataFrame, one: DataFrame, candidates: DataFrame, n: int, threshold: float, tolerance: float) -> DataFrame:
        """(a, b, jaccard) for those of the candidate pairs that match."""
        both = candidates.select("a", "b").union(candidates.select(F.col("b").alias("a"), F.col("a").alias("b")))
        lead = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("lead"))
        led = candidates.join(lead, "a")
        weighed = led.select("lead", F.col("b").alias("node")).distinct().join(one.select("node", "size"), "node")
        size = weighed.groupBy("lead").agg(_blocks())
        keyed_pairs = materialise(
            led.join(size, "lead").select(F.xxhash64("lead", F.least(_block("a"), _block("b")), F.greatest(_block("a"), _block("b"))).alias("key"), "a", "b"), "pairs"
        )
        discard(candidates)

        def wanted(pairs: DataFrame) -> DataFrame:
            return pairs.select("key", "a").union(pairs.select("key", "b")).distinct().toDF("key", "node")

        def by_key(nodes: DataFrame, pairs: DataFrame, column: str, kind: str) -> DataFrame:
            rows = nodes.select("key", F.col("node").alias("a"), F.lit(None).cast("long").alias("b"), column).union(pairs.select("key", "a", "b", F.lit(None).cast(kind)))
            return rows.repartition("key").sortWithinPartitions("key", F.col("b").asc_nulls_first())

        signs = wanted(keyed_pairs).join(one.select("node", "sign"), "node")
        likely = materialise(by_key(signs, keyed_pairs, "sign", "binary").mapInArrow(_prune(threshold, tolerance), "key long, a long, b long"), "likely")
        discard(keyed_pairs)
        places = wanted(likely).groupBy("node").agg(F.collect_list("key").alias("keys")).join(one, "node").select("node", "keys", "doc_id", "tie")
        places = materialise(places, "places")
        texts = keyed.join(hashed(places), (keyed.tie == places.tie) & keyed.doc_id.eqNullSafe(places.doc_id)).select(F.explode("keys").alias("key"), "node", "text")
        matches = materialise(by_key(texts, likely, "text", "string").mapInArrow(_verify(n, threshold), "a long, b long, jaccard double"), "matches")
        discard(likely)
        discard(places)
        return matches

    def _crowded(self, keyed: DataFrame, one: DataFrame, crowds: DataFrame, n: int, threshold: float, listed: bool) -> DataFrame:
        """What ``_crowd`` gives for all crowds."""
        there = crowds.join(one.drop("sign"), "node").join(self.times, "node")
        there = materialise(there.dropDuplicates(["node"]), "there")
        apart = there.select(F.explode("crowds").alias("crowd"), "node", "size")
        size = apart.groupBy("crowd").agg(_blocks())
        homes = apart.join(size, "crowd").select("node", "crowd", _block("node").alias("block"), F.explode(F.expr("sequence(0, blocks - 1)")).alias("other"))
        key = F.xxhash64("crowd", F.least("block", "other"), F.greatest("block", "other"))
        homes = homes.groupBy("node").agg(F.collect_list(F.struct(key.alias("key"), "crowd", (F.col("block") == F.col("other")).alias("within"), "block")).alias("homes"))
        places = materialise(there.join(homes, "node").select("node", "times", "crowds", "homes", "doc_id", "tie"), "places")
        discard(there)
        found = keyed.select("doc_id", "tie", "text").join(joined_side(places), (keyed.tie == places.tie) & keyed.doc_id.eqNullSafe(places.doc_id)).drop(places.doc_id, places.tie)
        texts = found.dropDuplicates(["node"]).select(F.explode("homes").alias("home"), "node", "times", "crowds", "text").select("home.*", "node", "times", "crowds", "text")
        parts = int(keyed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        kind = "a long, b long, jaccard double" if listed else "a long, b long, links long"
        out = materialise(texts.repartition(parts, "key").sortWithinPartitions("key").mapInArrow(_crowd(n, threshold, listed), kind), "crowded")
        discard(places)
        return out


def _blocks() -> F.Column:
    """Of how many blocks a group of nodes of this ``size`` in bytes consists."""
    return F.ceil(F.greatest(F.count(F.lit(1)) / F.lit(BLOCK), F.sum("size") / F.lit(BLOCK_BYTES), F.lit(1.0))).alias("blocks")


def _block(node: str) -> F.Column:
    return F.pmod(F.xxhash64(node), F.col("blocks"))


def join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = N, threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> DataFrame:
    """All matching documents as rows (doc_ids, n_first, jaccard): any two documents of the list
    ``doc_ids`` match. The first ``n_first`` of them have one set of n-grams and the others
    another one, and ``jaccard`` is the similarity of the two sets; documents with one set have 1.
    A set of two or more documents also has a row of its own, with n_first the length of the list.
    Either part of a list is sorted, and the part with the smaller first id comes first. That is
    the whole join, without the square of the number of copies; ``expand`` gives plain pairs.

    Null, empty and wordless texts match nothing, a text with fewer than n words is one n-gram.
    Rows with a null id can't be named and are left out. Repeated rows with one id are one
    document. Of two rows with one id and different texts both are compared, under that id. An
    empty table gives an empty result. Other columns are not looked at."""
    m = Matches(docs.filter(F.col(id_col).isNotNull()), id_col, text_col, n, threshold, tolerance, listed=True)
    lists = m.members.groupBy("node").agg(F.sort_array(F.collect_set("doc_id")).alias("ids"))
    same = lists.filter(F.size("ids") > 1).select(F.col("ids").alias("doc_ids"), F.size("ids").alias("n_first"), F.lit(1.0).alias("jaccard"))
    x, y = lists.toDF("a", "x"), lists.toDF("b", "y")
    near = m.pairs.join(x, "a").join(y, "b")
    first = F.col("x") <= F.col("y")
    near = near.select(F.when(first, F.concat("x", "y")).otherwise(F.concat("y", "x")).alias("doc_ids"), F.when(first, F.size("x")).otherwise(F.size("y")).alias("n_first"), F.round("jaccard", 6).alias("jaccard"))
    return same.union(near)


def expand(rows: DataFrame) -> DataFrame:
    """The pairs (doc_a, doc_b, jaccard), doc_a < doc_b, that rows of ``join`` stand for. Of an
    empty table none; an id that is in both parts of a row is no pair with itself."""
    whole = F.col("n_first") == F.size("doc_ids")
    rest = F.when(whole, F.col("doc_ids")).otherwise(F.expr("slice(doc_ids, n_first + 1, size(doc_ids))"))
    pairs = rows.select(F.explode(F.expr("slice(doc_ids, 1, n_first)")).alias("p"), rest.alias("rest"), "jaccard").select("p", F.explode("rest").alias("q"), "jaccard").filter("p != q")
    return pairs.select(F.least("p", "q").alias("doc_a"), F.greatest("p", "q").alias("doc_b"), "jaccard").distinct()


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = N, threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> DataFrame:
    """The join as a row (doc_id, class_id, n_links) for every document: ``n_links`` other documents
    match it, and ``class_id`` is the smallest doc_id of its connected component of matches. The
    result grows with the documents, not with the pairs; ``join`` has the pairs themselves.

    Null, empty and wordless texts match nothing and are classes of their own, a text with fewer
    than n words is one n-gram. Rows with a null id can't be named and are left out. Repeated rows
    (one id and one text) are one document. Rows with one id and different texts are documents of
    their own, each with a row, so such an id may stand for more than one class. An empty table
    gives an empty result. Other columns are not looked at."""
    named = docs.filter(F.col(id_col).isNotNull())
    m = Matches(named, id_col, text_col, n, threshold, tolerance)
    label = components(m.edges)
    nodes = m.times.join(label, "node", "left").join(m.links, "node", "left")
    nodes = nodes.select("node", F.coalesce("label", "node").alias("label"), (F.col("times") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    found = materialise(m.members.distinct().join(nodes, "node"), "classed")
    first = found.groupBy("label").agg(F.min("doc_id").alias("class_id"))
    classed = found.join(first, "label").select("doc_id", "class_id", "n_links")
    wordless = named.select(F.col(id_col).cast("long").alias("doc_id"), row_key(id_col, text_col).alias("tie")).distinct().join(hashed(found.select("doc_id", "tie"), within=found), ["doc_id", "tie"], "left_anti")
    return classed.union(wordless.select("doc_id", F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("n_links")))


def components(pairs: DataFrame) -> DataFrame:
    """(node, label) for every node of the edges (a, b): the least node of its connected component.
    A null end makes no edge, repeated edges and loops change nothing, no edges give no rows.
    Each round takes the least label around and then the label of the label, so rounds grow with
    the logarithm of a component's width; each is written to the shared folder."""
    pairs = pairs.filter("a is not null and b is not null")
    edges = pairs.select("a", "b").union(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    last = labels = materialise(edges.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("label")), "labels")
    while True:
        around = edges.join(labels, edges.b == labels.node).groupBy(F.col("a").alias("node")).agg(F.min("label").alias("m"))
        step = labels.join(around, "node").select("node", F.col("label").alias("old"), F.least("label", "m").alias("via"))
        jump = labels.select(F.col("node").alias("via"), F.col("label").alias("far"))
        new = materialise(step.join(jump, "via").select("node", "old", F.least("via", "far").alias("label")), "labels")
        discard(last)
        last = new
        if not new.filter("old != label").take(1):
            return new.select("node", "label")
        labels = new.select("node", "label")


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = N, threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> DataFrame:
    """``docs`` with one document of each group, all columns kept. A group is a connected component
    of matches; its document with the smallest id stays (nulls come last; of several rows with that
    id the one with the smallest hash of its content, once). Documents without words stay."""
    m = Matches(docs, id_col, text_col, n, threshold, tolerance)
    label = components(m.edges)
    grouped = m.members.join(label, "node", "left").select(F.coalesce("label", "node").alias("label"), "doc_id", "tie")
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "tie")
    groups = grouped.groupBy("label").agg(F.min(order).alias("first"), F.count(F.lit(1)).alias("size")).filter("size > 1")
    fates = materialise(
        grouped.join(groups, "label").groupBy("doc_id", "tie").agg(F.count(F.lit(1)).alias("rows"), F.max(F.col("first.tie") == F.col("tie")).alias("stays")).filter("not stays or rows > 1"), "fates"
    )
    key = row_key(id_col, text_col)
    gone = fates.select(F.col("tie").alias("__newsloom_tie"))
    kept = docs.join(hashed(gone), key == F.col("__newsloom_tie"), "left_anti")
    again = fates.filter("stays").select(F.col("tie").alias("__newsloom_again"))
    if not again.take(1):
        return kept
    repeated = docs.withColumn("__newsloom_key", key).join(again, F.col("__newsloom_key") == F.col("__newsloom_again"), "left_semi")
    return kept.union(repeated.dropDuplicates(["__newsloom_key"]).select(docs.columns))
