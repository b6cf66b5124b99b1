"""The pipeline against a brute-force version, and what each stage must do to its own input."""

import collections
import itertools

import numpy as np
import pytest

import __spark_entry__
import corpus_pipeline
from newsloom.llm import jaccard, line_dedup, packing, pii, quality, sentencepiece_codec

from .test_operators import brute_surrogates

SMALL = "/root/testdata/sf0.001"
COLUMNS = list(corpus_pipeline.COLUMNS)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet")


def brute(rows, key):
    """(doc_id -> text) after the first four stages."""
    codes = {i: quality.encode_votes(quality.votes_of(t)) for i, t in rows}
    counts = collections.Counter(codes.values())
    prior, table = quality.fit(np.array(sorted(counts)), np.array([counts[c] for c in sorted(counts)], float))

    def good(code):
        v = quality.decode_votes(code)
        a, b = ((prior if k else 1 - prior) * np.prod([table[k, r, x + 1] for r, x in enumerate(v)]) for k in (1, 0))
        return a / (a + b) >= quality.KEEP_AT

    rows = sorted((i, t) for i, t in rows if good(codes[i]))
    seen, left = [], []
    for i, text in rows:
        kept = []
        for line in text.split("\n"):
            words = frozenset(line.split())
            if not words:
                kept.append(line)
                continue
            if not any(len(words & s) >= (line_dedup.THRESHOLD - 1e-9) * len(words | s) for s in seen):
                kept.append(line)
            seen.append(words)
        if "\n".join(kept).strip(" "):
            left.append((i, "\n".join(kept)))
    sets = {i: jaccard.ngrams(t) for i, t in left}
    label = {i: i for i, _ in left}

    def top(i):
        while label[i] != i:
            i = label[i]
        return i

    for a, b in itertools.combinations([i for i, s in sets.items() if s], 2):
        both = len(sets[a] & sets[b])
        if both and both / len(sets[a] | sets[b]) >= jaccard.THRESHOLD:
            x, y = sorted((top(a), top(b)))
            label[y] = x
    left = [(i, t) for i, t in left if top(i) == i]
    found = brute_surrogates({(k, c) for _, t in left for _, _, k, c in pii.detect(t)}, key)
    return {i: pii.replace(t, found) for i, t in left}


def test_pipeline_equals_brute_force(spark, docs):
    texts = brute([(r.doc_id, r.text) for r in docs.collect()], pii.session_key(spark))
    got = collections.defaultdict(list)
    for r in corpus_pipeline.run(spark, SMALL).collect():
        got[r.shard].append((r.window, list(zip(r.doc_ids, r.starts, r.ends)), r.n_tokens))
    want = collections.defaultdict(list)
    shards, total = collections.defaultdict(list), 0
    units = dict(zip(sorted(texts), packing.units_of([texts[i] for i in sorted(texts)], packing.WINDOW, sentencepiece_codec.codec(packing.MODEL))))
    for i in sorted(texts):
        shards[total // packing.SHARD_TOKENS].append(i)
        total += sum(units[i][1])
    for shard, ids in shards.items():
        counts, inside, spans = [], [], []
        for i in ids:
            ends, c = units[i]
            counts += c
            inside += [True] * (len(c) - 1) + [False]
            spans += [(i, a, b) for a, b in zip([0, *ends], ends)]
        start = 0
        for number, stop in enumerate(packing.cuts(counts, inside, packing.WINDOW, packing.TRUNCATION)):
            merged = []
            for i, a, b in spans[start:stop]:
                if merged and merged[-1][0] == i:
                    merged[-1] = (i, merged[-1][1], b)
                else:
                    merged.append((i, a, b))
            want[shard].append((number, merged, sum(counts[start:stop])))
            start = stop
    assert {k: sorted(v) for k, v in got.items()} == dict(want)


def test_stages_keep_the_columns_and_clean_documents(spark, docs):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SMALL}/labels.parquet").collect()}
    rows = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, rows = rows, stage(spark, rows, SMALL)
        assert rows.columns == COLUMNS and rows.dtypes == docs.dtypes, name
        if name == "quality rules":
            kept = {r.doc_id for r in rows.collect()}
            good = [i for i, q in labels.items() if q == 1]
            assert sum(i in kept for i in good) / len(good) > 0.97
    assert before.count() == rows.count()


def test_stages_on_odd_rows(spark):
    odd = [(1, None, None, None, None), (None, "x y z. " * 30, "en", "a", 210), (2, "", "en", "a", 0), (2, "", "en", "a", 0)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    for rows in (odd, []):
        df = spark.createDataFrame(rows, schema)
        for _, stage in corpus_pipeline.STAGES:
            df = stage(spark, df, SMALL)
        assert df.count() <= 1


def test_near_copies_make_few_edges(spark):
    words = [f"w{k}" for k in range(150)]
    rows = [(k, " ".join(words[:k] + [f"other{k}"] + words[k + 1 :])) for k in range(120)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    m = jaccard.Matches(df, "doc_id", "text", jaccard.N, jaccard.THRESHOLD, jaccard.TOLERANCE)
    assert m.edges.count() < 1000 < len(rows) * (len(rows) - 1) // 2
    assert m.links.agg({"links": "max"}).first()[0] == len(rows) - 1


def test_registered():
    names = __spark_entry__.queries()
    assert "pipeline" in names and {f"op{n}" for n in range(1, 11)} <= {x.split("_")[0] for x in names}
