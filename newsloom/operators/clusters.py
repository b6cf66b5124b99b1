"""Clusters: assigning articles to events and stories, and reconciling new clusters with old ones."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..plans.lineage import materialise


#: vectors of a block in about this number are compared at a time, as products of matrices
BLOCK = 2048


def _cosines(u: np.ndarray, v: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Cosines of all rows of u with all of v, and where they are at least ``least``: nowhere for
    zero vectors. What is near the limit is summed again by element in order, as in SQL."""

    def total(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        out = np.zeros(len(x))
        for k in range(x.shape[1]):
            out += x[:, k] * y[:, k]
        return out

    with np.errstate(all="ignore"):
        norm = np.sqrt(np.outer(total(u, u), total(v, v)))
        found = (u @ v.T) / norm
        i, j = np.nonzero(np.abs(found - least) < 1e-9)
        if len(i):
            found[i, j] = total(u[i], v[j]) / norm[i, j]
        return found, ~(found < least) & (norm != 0)


def _matrix(table: pa.Table, width: int) -> np.ndarray:
    return table.column("vector").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, width).astype(np.float64)


def _blocks(vectors: DataFrame, within: str, id_col: str, vector_col: str) -> DataFrame:
    """(within, width, id, vector, chunk, chunks): each block in as many chunks as it needs, by a
    hash of the id. Vectors of different lengths or with nulls have no cosine."""
    v = vectors.select(F.col(within).alias("within"), F.size(vector_col).alias("width"), F.col(id_col).alias("id"), F.col(vector_col).alias("vector"))
    v = v.filter("within is not null and id is not null and width > 0 and not exists(vector, x -> x is null)")
    sizes = v.groupBy("within", "width").agg(F.ceil(F.count(F.lit(1)) / F.lit(BLOCK)).cast("int").alias("chunks"))
    return v.join(sizes, ["within", "width"]).withColumn("chunk", F.pmod(F.xxhash64("id"), F.col("chunks")).cast("int"))


def similar_pairs(vectors: DataFrame, least: float, within: str, id_col: str = "id", vector_col: str = "vector") -> DataFrame:
    """(a, b, similarity) of vectors in one block ``within``, such as a day or a hash bucket. All
    pairs, by their definition, but as products of matrices: a task holds two chunks of a block and
    never more than their own pairs, however large the block is."""
    v = _blocks(vectors, within, id_col, vector_col)
    met = v.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    met = met.select("within", "width", F.least("chunk", "other").alias("i"), F.greatest("chunk", "other").alias("j"), "chunk", "id", "vector")
    kind = v.schema["id"].dataType.simpleString()
    names = pa.schema([("a", to_arrow_type(v.schema["id"].dataType)), ("b", to_arrow_type(v.schema["id"].dataType)), ("similarity", pa.float64())])

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        _, width, i, j = (k.as_py() for k in key)
        ids, x, chunk = table.column("id").combine_chunks(), _matrix(table, width), table.column("chunk").to_numpy()
        order = ids.to_numpy(zero_copy_only=False)
        left, right = np.flatnonzero(chunk == i), np.flatnonzero(chunk == j)
        out = []
        for at in range(0, len(left), 256):
            strip = left[at : at + 256]
            found, hit = _cosines(x[strip], x[right], least)
            if i == j:
                hit &= strip[:, None] < right
            r, c = np.nonzero(hit)
            first, second, similarity = strip[r], right[c], found[r, c]
            ahead, same = order[first] < order[second], order[first] == order[second]
            a, b = np.where(ahead, first, second)[~same], np.where(ahead, second, first)[~same]
            out.append(pa.table([ids.take(pa.array(a)), ids.take(pa.array(b)), pa.array(similarity[~same])], schema=names))
        return pa.concat_tables(out) if out else names.empty_table()

    return met.groupBy("within", "width", "i", "j").applyInArrow(run, f"a {kind}, b {kind}, similarity double")


def _spanning(x: np.ndarray, least: float, known: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Edges that connect what pairs at ``least`` connect, and no more than there are rows: a search
    breadth first, in which rows once reached are never compared again. Rows of one value in
    ``known`` are connected already; only one of them gets an edge."""
    sources, targets = [], []
    rest, codes = np.arange(len(x)), None
    if known is not None:
        _, codes, count = np.unique(known, return_inverse=True, return_counts=True)
        rest = np.argsort(-count[codes], kind="stable")
    while len(rest):
        seed = rest[0]
        own = np.arange(len(rest)) == 0 if codes is None else codes[rest] == codes[seed]
        reached, rest = rest[own], rest[~own]
        while len(reached) and len(rest):
            more = []
            for at in range(0, len(reached), 256):
                hit = _cosines(x[reached[at : at + 256]], x[rest], least)[1].any(axis=0)
                if not hit.any():
                    continue
                if codes is not None:
                    hit = np.isin(codes[rest], codes[rest[hit]])
                new = rest[hit]
                more.append(new)
                targets.append(new if codes is None else new[np.unique(codes[new], return_index=True)[1]])
                sources.append(np.full(len(targets[-1]), seed))
                rest = rest[~hit]
                if not len(rest):
                    break
            reached = np.concatenate(more) if more else rest[:0]
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *sources]), np.concatenate([none, *targets])


def _links(grouped: DataFrame, keys: list[str], least: float) -> DataFrame:
    """(a, b): edges within each group of (width, id, vector), and ``known`` where it is there."""
    kind = grouped.schema["id"].dataType.simpleString()
    has = "known" in grouped.columns

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        ids = table.column("id").combine_chunks()
        known = table.column("known").to_numpy() if has else None
        a, b = _spanning(_matrix(table, key[1].as_py()), least, known)
        return pa.table({"a": ids.take(pa.array(a)), "b": ids.take(pa.array(b))})

    return grouped.groupBy("within", "width", *keys).applyInArrow(run, f"a {kind}, b {kind}")


def similar_components(vectors: DataFrame, least: float, within: str) -> DataFrame:
    """(id, cluster) of vectors (id, vector, ``within``): the components of their similar pairs,
    exactly, without making the pairs. Chunks of a block are linked within themselves and with the
    block's first chunk. That joins most of a block where it is dense; a pair that could join more
    has an end outside of the block's largest component, so only those vectors meet all others."""
    v = _blocks(vectors, within, "id", "vector")
    nodes = vectors.select("id").distinct()
    every = F.sequence(F.lit(0), F.col("chunks") - 1)
    near = v.withColumn("group", F.explode(F.when(F.col("chunk") == 0, every).otherwise(F.array("chunk"))))
    edges = materialise(_links(near.select("within", "width", "group", "id", "vector"), ["group"], least), "links")
    found = components(edges, nodes)
    placed = v.join(found, "id").withColumnRenamed("cluster", "known")
    sizes = placed.groupBy("within", "width", "known").agg(F.count(F.lit(1)).alias("n"))
    largest = sizes.groupBy("within", "width").agg(F.max_by("known", F.struct("n", "known")).alias("largest"))
    few = placed.join(largest, ["within", "width"]).filter("known != largest").drop("largest")
    parts = few.groupBy("within", "width").agg(F.ceil(F.count(F.lit(1)) / F.lit(BLOCK)).cast("int").alias("parts"))
    parts = materialise(parts, "parts")
    if not parts.take(1):
        return found
    columns = ["within", "width", "part", "chunk", "id", "vector", "known"]
    few = few.join(parts, ["within", "width"]).withColumn("part", F.pmod(F.xxhash64("id", F.lit(1)), F.col("parts")).cast("int"))
    few = few.withColumn("chunk", F.explode(every)).select(columns)
    met = placed.join(parts, ["within", "width"]).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select(columns)
    more = materialise(_links(few.unionByName(met), ["part", "chunk"], least), "links")
    return components(edges.unionByName(more), nodes) if more.take(1) else found


def components(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(id, cluster): connected components, named by their least node: the cut of a single-linkage
    hierarchy at the threshold that made the edges (a, b). Least labels, then labels of labels."""
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    labels = nodes.select(F.col("id").alias("node"), F.col("id").alias("label"))
    while True:
        around = both.join(labels, both.b == labels.node).groupBy(F.col("a").alias("node")).agg(F.min("label").alias("m"))
        step = labels.join(around, "node", "left").select("node", F.col("label").alias("old"), F.least("label", F.coalesce("m", "label")).alias("via"))
        jump = labels.select(F.col("node").alias("via"), F.col("label").alias("far"))
        new = materialise(step.join(jump, "via").select("node", "old", F.least("via", "far").alias("label")), "labels")
        if not new.filter("old != label").take(1):
            return new.select(F.col("node").alias("id"), F.col("label").alias("cluster"))
        labels = new.select("node", "label")


def snip(articles: DataFrame, stories: DataFrame, min_articles: int = 1, min_events: int = 1) -> tuple[DataFrame, DataFrame]:
    """From articles (id, cluster) at the event cut and at the wider story cut: events (event_id,
    article_id) and stories (story_id, event_id) of the least sizes."""
    events = articles.select(F.col("cluster").alias("event_id"), F.col("id").alias("article_id"))
    events = events.join(events.groupBy("event_id").count().filter(F.col("count") >= min_articles).select("event_id"), "event_id", "left_semi")
    links = events.join(stories.select(F.col("id").alias("article_id"), F.col("cluster").alias("story_id")), "article_id").groupBy("event_id").agg(F.min("story_id").alias("story_id"))
    big = links.groupBy("story_id").count().filter(F.col("count") >= min_events)
    return events, links.join(big, "story_id", "left_semi").select("story_id", "event_id")


def triage_pairs(existing: DataFrame, new: DataFrame, least: float = 0.5) -> DataFrame:
    """(old_id, new_id, ratio) of clusters that share at least ``least`` by 2 |A & B| / (|A| + |B|).
    existing: (old_id, member), new: (new_id, member). Candidates come from an equi-join on the
    member, so clusters with nothing in common never meet."""
    sizes_a = existing.groupBy("old_id").agg(F.count(F.lit(1)).alias("na"))
    sizes_b = new.groupBy("new_id").agg(F.count(F.lit(1)).alias("nb"))
    common = existing.join(new, "member").groupBy("old_id", "new_id").agg(F.count(F.lit(1)).alias("both"))
    ratio = 2.0 * F.col("both") / (F.col("na") + F.col("nb"))
    return common.join(sizes_a, "old_id").join(sizes_b, "new_id").select("old_id", "new_id", ratio.alias("ratio")).filter(F.col("ratio") >= least)


def _greedy(pdf: pd.DataFrame) -> pd.DataFrame:
    """Old clusters in order of their ids: an identical new cluster, else the most similar one left."""
    taken, rows = set(), []
    for old, group in pdf.sort_values(["old_id", "new_id"]).groupby("old_id"):
        left = group[~group.new_id.isin(taken)]
        same = left[left.ratio == 1.0]
        if len(same):
            rows.append((old, same.new_id.iloc[0], "unchanged"))
        elif len(left):
            rows.append((old, left.sort_values(["ratio", "new_id"], ascending=[False, True]).new_id.iloc[0], "update"))
        else:
            continue
        taken.add(rows[-1][1])
    return pd.DataFrame(rows, columns=["old_id", "new_id", "action"])


def triage(existing: DataFrame, new: DataFrame) -> DataFrame:
    """(action, old_id, new_id), action being update, unchanged, create or delete. The greedy choice
    depends on its order, so it runs as such, but for each connected component of candidate pairs
    by itself; components never affect each other."""
    pairs = materialise(triage_pairs(existing, new), "triage")
    nodes = pairs.select((F.col("old_id") * 2).alias("id")).union(pairs.select((F.col("new_id") * 2 + 1).alias("id"))).distinct()
    found = components(pairs.select((F.col("old_id") * 2).alias("a"), (F.col("new_id") * 2 + 1).alias("b")), nodes)
    grouped = pairs.join(found, F.col("old_id") * 2 == F.col("id"))
    claimed = materialise(grouped.groupBy("cluster").applyInPandas(_greedy, "old_id long, new_id long, action string"), "claimed")
    none = F.lit(None).cast("long")
    gone = existing.select("old_id").distinct().join(claimed, "old_id", "left_anti").select(F.lit("delete").alias("action"), "old_id", none.alias("new_id"))
    made = new.select("new_id").distinct().join(claimed, "new_id", "left_anti").select(F.lit("create").alias("action"), none.alias("old_id"), "new_id")
    return claimed.select("action", "old_id", "new_id").unionByName(gone).unionByName(made)


def apply_triage(labels: DataFrame, existing: DataFrame, new: DataFrame, now: str, keep_days: int = 3) -> tuple[DataFrame, DataFrame]:
    """The clusters (old_id, updated_at, active) after triage, and their members (cluster_id,
    member, fresh). Unchanged ones freeze once more than ``keep_days`` full days have passed; fresh
    members belong to clusters that are still to get an id, which is that of the new cluster."""
    full = F.floor((F.unix_micros(F.lit(now).cast("timestamp")) - F.unix_micros(F.col("updated_at").cast("timestamp"))) / F.lit(86400e6))
    states = existing.join(labels.filter("old_id is not null"), "old_id").filter("action != 'delete'")
    kept = states.select("old_id", F.when(F.col("action") == "update", F.lit(now).cast("timestamp_ntz")).otherwise(F.col("updated_at")).alias("updated_at"), F.when((F.col("action") == "unchanged") & (full > keep_days), F.lit(False)).otherwise(F.lit(True)).alias("active"))
    moved = new.join(labels.filter("new_id is not null"), "new_id").select(F.coalesce("old_id", "new_id").alias("cluster_id"), "member", F.col("old_id").isNull().alias("fresh"))
    return kept, moved


def representative(members: DataFrame, cluster: str, id_col: str, vector: str) -> DataFrame:
    """(cluster, id) of the member nearest to the cluster's centroid; ties by the least id. Vectors
    have one length; centroids are sums by element, so only those of a cluster are spread out, and
    the members stay where they are while the centroids, one row a cluster, come to them."""
    width = F.size(vector)
    n = members.agg(F.max(width)).first()[0] or 0
    sums = members.groupBy(cluster).agg(*[F.avg(F.get(F.col(vector), F.lit(k)).cast("double")).alias(f"c{k}") for k in range(n)])
    centroid = sums.select(cluster, F.array(*[f"c{k}" for k in range(n)]).alias("centroid"))
    apart = F.aggregate(F.zip_with(vector, "centroid", lambda x, c: (x.cast("double") - c) * (x.cast("double") - c)), F.lit(0.0), lambda a, x: a + x)
    each = members.join(centroid, cluster).select(cluster, id_col, F.round(apart, 9).alias("d"))
    return each.groupBy(cluster).agg(F.min_by(id_col, F.struct("d", id_col)).alias(id_col))


def event_labels(members: DataFrame, nearest: DataFrame) -> DataFrame:
    """(event_id, title, image): those of an event's representative article. members: (event_id, id,
    title, image), nearest: (event_id, id)."""
    return members.join(nearest, ["event_id", "id"]).groupBy("event_id").agg(F.first("title").alias("title"), F.first("image").alias("image"))


def story_labels(stories: DataFrame, events: DataFrame) -> DataFrame:
    """(story_id, title, image, updated_at): those of a story's latest event, ties by the least id.
    stories: (story_id, event_id), events: (event_id, title, image, updated_at)."""
    newest = F.max_by(F.struct("title", "image", "updated_at"), F.struct(F.col("updated_at"), -F.col("event_id")))
    return stories.join(events, "event_id").groupBy("story_id").agg(newest.alias("x")).select("story_id", "x.*")


def save_hierarchy(labels: DataFrame, path: str) -> None:
    """The clusters (id, cluster) of a level, to go on from in a later run."""
    labels.write.mode("overwrite").parquet(path)


def load_hierarchy(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def recluster(vectors: DataFrame, within: str, event_least: float, story_least: float, min_articles: int = 1, min_events: int = 1) -> tuple[DataFrame, DataFrame]:
    """Events (event_id, article_id) and stories (story_id, event_id) of all articles (id, vector,
    ``within``): the components at a similarity for events and at a lower one for stories, so the
    cuts nest. One batch job; pairs are never made."""
    vectors = vectors.select(within, "id", "vector")
    events, stories = (similar_components(vectors, least, within) for least in (event_least, story_least))
    return snip(events, stories, min_articles, min_events)
