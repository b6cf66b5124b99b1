"""The ten operators against brute force, and on nulls, empty and odd input."""

import base64
import collections
import gzip
import itertools
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from newsloom.llm import html_extract, jaccard, language, line_dedup, media, media_column, packing, pii, quality, queries, urls
from newsloom.llm import sentencepiece_codec as sp
from newsloom.llm.common import row_key

SMALL = "/root/testdata/sf0.001"
KEY = b"a key for tests"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet").cache()


def odd(spark, extra=""):
    """Nulls in every column, empty, blank, very long, repeated and clashing."""
    long = " ".join(f"word{k}" for k in range(30_000)) + "."
    rows = [
        (1, "The cat sat on the mat and looked at the dog.", "en", "a", 45),
        (1, "The cat sat on the mat and looked at the dog.", "en", "a", 45),
        (2, None, None, None, None),
        (3, "", "en", "a", 0),
        (4, "   \n \n", "en", None, 5),
        (5, long, "en", "a", len(long)),
        (6, "\U0001f600 日本語 \x00 x", None, "a", 9),
        (None, "No id here, write to a@b.example.org or call +1 (415) 555-1234.", "de", "a", 60),
        (None, None, None, None, None),
    ]
    df = spark.createDataFrame(rows, DOCS)
    for name in ("tokens", "ids", "node", "tie", "bits", "code", "shard", "__x"):
        df = df.withColumn(name, F.lit("clash"))
    return df


def nothing(spark):
    return spark.createDataFrame([], DOCS)


def rows_of(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)


# --- 1 -----------------------------------------------------------------------------------------


def test_sentencepiece_equals_the_library(spark, docs):
    library = pytest.importorskip("sentencepiece").SentencePieceProcessor(model_file=sp.MODEL)
    codec = sp.Codec(sp.MODEL)
    rnd = random.Random(5)
    texts = ["", " ", "  a  b ", "日本語のテキスト" * 30, "x" * 5000, "====--==", "\t\n\r", "a" * 70, "\U0001f600é"]
    texts += ["".join(rnd.choice("abcdeéß .,\n日0▁-") for _ in range(rnd.randint(1, 60))) for _ in range(400)]
    texts += [r.text for r in docs.limit(60).collect()]
    assert codec.encode_batch(texts)[0].tolist() == []
    for text, ids in zip(texts, codec.encode_batch(texts)):
        assert ids.tolist() == library.encode(text)
        assert codec.decode(ids.tolist()) == library.decode(ids.tolist())


def test_lanes_equal_the_library():
    library = pytest.importorskip("sentencepiece").SentencePieceProcessor(model_file=sp.MODEL)
    codec = sp.Codec(sp.MODEL, remembered=500)
    rnd = random.Random(8)
    for size in (6, 40, 300):
        texts = ["".join(rnd.choice("theingtoaé日b1▁ ") for _ in range(rnd.randint(1, size))) for _ in range(400)]
        assert [x.tolist() for x in codec.encode_batch(texts)] == library.encode(texts)
    assert codec.lanes.forward(["then"], np.array([4])) == [codec._packed(codec._ids(codec.stream("then")))]


def test_lanes_commit_before_the_end():
    codec = sp.Codec(sp.MODEL)
    seen = []
    commit = codec.lanes.commit
    codec.lanes.commit = lambda lane, i, back, root, final, done: (commit(lane, i, back, root, final, done), seen.append(i - int(done.min())))
    codec.lanes.forward(["theandthatwith" * 40] * 3, np.array([560] * 3))
    assert max(seen) < 4 * codec.longest


def test_streaming_gives_pieces_before_the_end():
    codec = sp.Codec(sp.MODEL)
    seen = []

    class Text(str):
        def __getitem__(self, k):
            seen.append(k.stop if isinstance(k, slice) else k)
            return str.__getitem__(self, k)

    stream = codec.stream(Text("▁the▁cat▁sat" + "▁on▁and▁on" * 200))
    next(stream)
    assert max(x for x in seen if x is not None) < 200


def test_unigram_path_is_the_best():
    codec = sp.Codec(sp.MODEL)
    codec.kind, codec.scores, codec.longest = sp.UNIGRAM, {"a": -1.0, "b": -1.2, "ab": -1.5, "ba": -3.0, "aba": -2.0, "bab": -9.0}, 3
    codec.lengths = [3, 2, 1]
    for n in range(1, 9):
        for text in map("".join, itertools.product("ab", repeat=n)):
            best = [0.0] + [-1e9] * n
            for i in range(1, n + 1):
                best[i] = max(best[i - k] + codec.scores.get(text[i - k : i], -1e9) for k in (1, 2, 3) if k <= i)
            assert sum(codec.scores[p] for p in codec.stream(text)) == pytest.approx(best[n])


def test_sentencepiece_on_odd_input(spark):
    got = sp.encode(odd(spark))
    assert got.columns == ["doc_id", "ids", "n_ids", "round_trip"] and got.count() == 9
    by = {r.doc_id: r for r in got.filter("doc_id is not null").collect()}
    assert by[2].ids is None and by[3].ids == [] and by[5].round_trip
    texts = {r.doc_id: r.text for r in sp.decode(got.withColumn("text", F.lit("clash"))).filter("doc_id is not null").collect()}
    assert sp.decode(got.limit(0)).count() == 0
    assert texts[1].startswith("The cat") and texts[2] is None and texts[3] == ""
    assert sp.encode(nothing(spark)).count() == 0


# --- 2 -----------------------------------------------------------------------------------------


def brute_pairs(rows, n, threshold):
    sets = {i: jaccard.ngrams(t, n) for i, t in rows if t}
    out = {}
    for a, b in itertools.combinations(sorted(sets), 2):
        both = len(sets[a] & sets[b])
        if both and both / len(sets[a] | sets[b]) >= threshold:
            out[a, b] = round(both / len(sets[a] | sets[b]), 6)
    return out


def test_jaccard_join_equals_brute_force(spark, docs):
    want = brute_pairs([(r.doc_id, r.text) for r in docs.collect()], jaccard.N, jaccard.THRESHOLD)
    got = {(r.doc_a, r.doc_b): r.jaccard for r in jaccard.expand(jaccard.join(docs)).collect()}
    assert got.items() <= want.items() and len(got) >= 0.95 * len(want) > 0


def test_jaccard_join_of_many_near_copies(spark):
    rnd = random.Random(3)
    base = [f"w{rnd.randint(0, 10**6)}" for _ in range(120)]
    rows = []
    for k in range(90):
        words = list(base)
        for _ in range(3):
            words[rnd.randrange(120)] = f"e{rnd.randint(0, 10**6)}"
        rows.append((k, " ".join(words)))
    rows += [(1000 + k, rows[0][1]) for k in range(50)]
    got = {(r.doc_a, r.doc_b): r.jaccard for r in jaccard.expand(jaccard.join(spark.createDataFrame(rows, "doc_id long, text string"))).collect()}
    want = brute_pairs(rows, jaccard.N, jaccard.THRESHOLD)
    assert got.items() <= want.items() and len(got) >= 0.9 * len(want)
    kept = jaccard.drop_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    assert [r.doc_id for r in kept.collect()] == [0]


def test_jaccard_rows_hold_both_lists(spark):
    words = [f"w{k}" for k in range(60)]
    near = " ".join(words[:-1] + ["other"])
    rows = [(5, " ".join(words)), (9, " ".join(words)), (2, near), (7, near), (7, near), (3, "nothing like it at all")]
    got = jaccard.join(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted((r.doc_ids, r.n_first) for r in got.collect()) == [([2, 7], 2), ([2, 7, 5, 9], 2), ([5, 9], 2)]
    assert len(jaccard.expand(got).collect()) == 6


def brute_classes(rows, n=jaccard.N, threshold=jaccard.THRESHOLD):
    pairs = brute_pairs(rows, n, threshold)
    label = {i: i for i, _ in rows}
    for _ in range(len(rows)):
        before = dict(label)
        for a, b in pairs:
            label[a] = label[b] = min(label[a], label[b])
        if label == before:
            break
    links = collections.Counter(i for pair in pairs for i in pair)
    return {i: (label[i], links[i]) for i in label}


@pytest.mark.parametrize("block", [16, 256])
def test_classes_of_many_near_copies(spark, monkeypatch, block):
    rnd = random.Random(8)
    monkeypatch.setattr(jaccard, "BLOCK", block)
    rows = []
    for cluster, (size, edits) in enumerate([(150, 4), (80, 2), (20, 3), (1, 0)]):
        base = [f"w{rnd.randint(0, 10**6)}" for _ in range(120)]
        for k in range(size):
            words = list(base)
            for _ in range(edits):
                words[rnd.randrange(120)] = f"e{rnd.randint(0, 10**6)}"
            rows.append((1000 * (4 - cluster) + k, " ".join(words)))
    rows += [(9000 + k, rows[0][1]) for k in range(5)] + [(9100, rows[-1][1]), (9200, ""), (9300, None)]
    df = spark.createDataFrame(rows + rows[:3], "doc_id long, text string")
    got = jaccard.classes(df)
    assert got.columns == ["doc_id", "class_id", "n_links"]
    found, want = got.collect(), brute_classes(rows)
    assert {r.doc_id: r.class_id for r in found} == {i: c for i, (c, _) in want.items()} and len(found) == len(rows)
    assert all(r.n_links <= want[r.doc_id][1] for r in found)
    assert sum(r.n_links for r in found) >= 0.99 * sum(n for _, n in want.values())
    assert [r.doc_id for r in jaccard.drop_near_duplicates(df).orderBy("doc_id").collect()] == sorted({c for c, _ in want.values()})


def test_classes_equal_brute_force(spark, docs):
    want = brute_classes([(r.doc_id, r.text) for r in docs.collect()])
    found = {r.doc_id: (r.class_id, r.n_links) for r in jaccard.classes(docs).collect()}
    assert found.keys() == want.keys() and sum(found[i] == want[i] for i in want) >= 0.95 * len(want)
    assert {r.doc_id for r in queries.op2_ngram_jaccard_join(spark, SMALL).collect()} == want.keys()


def test_classes_on_odd_input(spark):
    assert jaccard.classes(nothing(spark)).count() == 0
    two = spark.createDataFrame([(7, "a b c d"), (7, "a b c e"), (7, "a b c e"), (8, "a"), (9, "A!"), (None, "a"), (5, "?"), (6, None)], "doc_id long, text string")
    assert sorted(tuple(r) for r in jaccard.classes(two).collect()) == [(5, 5, 0), (6, 6, 0), (7, 7, 0), (7, 7, 0), (8, 8, 1), (9, 8, 1)]


def test_shared_both_ways():
    rnd = random.Random(1)
    sets = [np.unique(np.array([rnd.randint(0, 9000) for _ in range(900)], np.uint64)) for _ in range(9)]
    want = np.array([[len(np.intersect1d(a, b)) for b in sets] for a in sets])
    assert (jaccard.shared(sets, 4, False) == want[:4, 4:]).all()
    got = jaccard.shared(sets, 9, True)
    assert (np.triu(got, 1) == np.triu(want, 1)).all()


def test_recall_at_the_threshold():
    least = jaccard.least_matches(jaccard.THRESHOLD, jaccard.TOLERANCE)
    equal = np.random.RandomState(1).rand(20_000, jaccard.HASHES) < jaccard.THRESHOLD
    found = equal.reshape(-1, jaccard.BANDS, jaccard.ROWS).all(2).any(1)
    for step, fewest in enumerate(least):
        found &= equal[:, : (step + 1) * jaccard.STEP].sum(1) >= fewest
    assert found.mean() > 0.94


def test_overlaps_both_ways():
    rnd = random.Random(1)
    sets = {k: {(str(rnd.randint(0, 60)),) for _ in range(30)} for k in range(12)}
    few, many = np.array([[0, 1], [2, 3]]), np.array(list(itertools.combinations(range(12), 2)) * 3)
    for pairs in (few, many):
        assert jaccard.overlaps(pairs, sets).tolist() == [len(sets[a] & sets[b]) for a, b in pairs]


def test_least_matches_rise():
    least = jaccard.least_matches(0.5, 0.01)
    assert least == sorted(least) and 0 < least[-1] < jaccard.HASHES * 0.5


def test_jaccard_on_odd_input(spark):
    got = jaccard.join(odd(spark))
    assert got.columns == ["doc_ids", "n_first", "jaccard"] and got.count() == 0 and jaccard.expand(got).count() == 0
    assert jaccard.join(nothing(spark)).count() == 0
    kept = jaccard.drop_near_duplicates(odd(spark))
    assert kept.columns == odd(spark).columns
    assert [r[0] for r in rows_of(kept.select("doc_id"), "doc_id")].count(1) == 1 and kept.count() == 8
    assert jaccard.drop_near_duplicates(nothing(spark)).count() == 0
    two = spark.createDataFrame([(7, "a b c d"), (7, "a b c e"), (8, "a"), (9, "A!"), (None, "a")], "doc_id long, text string")
    assert [tuple(r) for r in jaccard.join(two).filter("jaccard = 1").collect()] == [([8, 9], 2, 1.0)]
    assert sorted(r.doc_id for r in jaccard.drop_near_duplicates(two).collect() if len(r.text) < 3) == [8]


# --- 3 -----------------------------------------------------------------------------------------

GIF = base64.b64decode("R0lGODlhAQABAIAAAAAAAP///yH5BAEAAAAALAAAAAABAAEAAAIBRAA7")


def test_sniffing_by_hand():
    png = media_column.png(b"abc")
    assert media.sniff(png) == ("image/png", len(png), [])
    assert media.sniff(b"xx" + png + b"--" + GIF)[2] == [(2, len(png), "image/png", "raw"), (4 + len(png), len(GIF), "image/gif", "raw")]
    assert media.sniff(png[:-1])[0] == "application/octet-stream"  # cut off
    assert media.sniff(png[:20] + b"?" + png[21:])[0] == "application/octet-stream"  # checksum
    assert media.sniff(b"BM and PK are only letters, \x1f too")[0] == "application/octet-stream"
    assert media.sniff(b"")[0] == "application/x-empty" and media.sniff(b"<!doctype html><p>")[0] == "text/html"
    assert media.sniff(gzip.compress(b"x" * 1000) + b"tail")[:2] == ("application/gzip", len(gzip.compress(b"x" * 1000)))
    jpeg = b"\xff\xd8\xff\xe0\x00\x10JFIF\0\1\1\0\0\1\0\1\0\0\xff\xc0\x00\x0b\x08\0\1\0\1\1\1\x11\0\xff\xda\x00\x08\1\1\0\0\x3f\0ab\xff\0c\xff\xd9"
    assert media.sniff(jpeg + b"more")[:2] == ("image/jpeg", len(jpeg))
    mp4 = b"\0\0\0\x10ftypisom\0\0\0\0" + b"\0\0\0\x0cmdatdata"
    assert media.sniff(mp4)[:2] == ("video/mp4", 28)
    assert media.sniff(b"%PDF-1.4\nx\nstartxref\n9\n%%EOF\n")[0] == "application/pdf"


def flac(frames, total):
    """A stream of frames with the same content."""
    def frame(k):
        head = bytes([0xFF, 0xF8, 0x29, 0x08, k])
        crc = 0
        for c in head:
            crc = media._CRC8[crc ^ c]
        body, crc = head + bytes([crc]) + b"some coded samples" * 3, 0
        for c in body:
            crc = (crc << 8 & 0xFFFF) ^ media._CRC16[crc >> 8 ^ c]
        return body + crc.to_bytes(2, "big")

    info = bytes([16, 0, 16, 0, 0, 0, 0, 0, 0, 0]) + (44100 << 44 | 15 << 36 | total).to_bytes(8, "big") + bytes(16)
    return b"fLaC\x80\0\0\x22" + info + b"".join(map(frame, range(frames)))


def tiff(order):
    import struct

    entries = [(256, 3, 1, 4), (257, 3, 1, 2), (273, 4, 1, 100), (279, 4, 1, 8)]
    pack = lambda kind, v: struct.pack(order + ("HH" if kind == 3 else "I"), *((v, 0) if kind == 3 else (v,)))
    out = (b"II" if order == "<" else b"MM") + struct.pack(order + "HI", 42, 8) + struct.pack(order + "H", 4)
    out += b"".join(struct.pack(order + "HHI", t, k, n) + pack(k, v) for t, k, n, v in entries) + struct.pack(order + "I", 0)
    return out.ljust(100, b"\0") + b"pictures"


def test_more_formats_and_what_follows_them():
    mp4 = b"\0\0\0\x10ftypisom\0\0\0\0" + b"\0\0\0\x0cmdatdata"
    png = media_column.png(b"abc")
    assert media.sniff(mp4 + b"and some text after it")[:2] == ("video/mp4", 28)
    for total in (576, 0):
        sound = flac(1, total)
        assert media.sniff(sound + png) == ("audio/flac", len(sound), [(len(sound), len(png), "image/png", "raw")])
    sound = flac(4, 4 * 576)
    assert media.items_of(flac(3, 0) + png)[-1][2] == "image/png" and media.sniff(sound[:-1])[0] == "application/octet-stream"
    mp3 = (b"\xff\xfb\x90\x00".ljust(417, b"\0")) * 5
    assert media.sniff(mp3 + b"x")[:2] == ("audio/mpeg", 417 * 5) and media.sniff(mp3[: 417 * 3])[0] == "application/octet-stream"
    tagged = b"ID3\4\0\0\0\0\0\5title" + mp3[:417]
    assert media.sniff(tagged)[:2] == ("audio/mpeg", len(tagged))
    for order in "<>":
        assert media.sniff(tiff(order) + b"--")[:2] == ("image/tiff", 108)
    webm = b"\x1aE\xdf\xa3\x87\x42\x82\x84webm" + b"\x18\x53\x80\x67\x85abcde"
    assert media.sniff(webm + b"--")[:2] == ("video/webm", len(webm))
    import io, zipfile  # noqa: E401

    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("a.png", png)
    kind, length, inside = media.sniff(out.getvalue())
    assert (kind, length) == ("application/zip", len(out.getvalue())) and [x[1:] for x in inside] == [(len(png), "image/png", "raw")]
    text = b"<p>data:application/x;base64," + base64.b64encode(b"??" + png + GIF) + b"</p>"
    assert [x[1:] for x in media.sniff(text)[2]] == [(len(GIF), "image/gif", "base64"), (len(png), "image/png", "base64")]


def test_many_headers_take_linear_time():
    import time

    for magic in (b"PK\3\4", b"%PDF-1.4", b"\x1f\x8b\x08\0", b"fLaC", b"\xff\xfb\x90\0"):
        began = time.time()
        media.items_of(magic * 100_000 + b"PK\x05\x06" * 1000)
        assert time.time() - began < 20


def test_every_way_of_wrapping_is_found():
    html = b"<!DOCTYPE html><html><body>" + bytes(range(32, 127)) * 9 + b"</body></html>"
    kinds = ["text/html", "image/png", "image/bmp", "application/gzip", "application/zip", "audio/wav", "text/html", "application/octet-stream"]
    for k, kind in enumerate(kinds):
        found, length, inside = media.sniff(media_column.wrapped(k, html))
        assert found == kind
        assert [x[2:] for x in inside] == {6: [("image/png", "base64")], 7: [("image/png", "raw"), ("image/bmp", "raw")]}.get(k, [])


def test_automaton_equals_a_scan():
    rnd = random.Random(2)
    for _ in range(60):
        parts = [rnd.choice([GIF, media_column.png(b"q" * rnd.randint(1, 99)), b"BM", b"PK\3\4", rnd.randbytes(rnd.randint(0, 40)), media_column.wav(b"z" * 9)]) for _ in range(5)]
        data, want, free = b"".join(parts), [], 0
        for at in range(len(data)):
            for magic, before, kind, check in media.FORMATS:
                if at >= free and data[at + before : at + before + len(magic)] == magic and (end := check(data, at)):
                    want.append((at, end - at, kind))
                    free = end
        assert media.items_of(data) == want


def test_media_on_odd_input(spark):
    rows = spark.createDataFrame([(1, bytearray(GIF), None), (2, None, "image/png"), (3, bytearray(b""), "x"), (None, bytearray(GIF), "IMAGE/GIF; q=1")], "id long, content binary, declared string").withColumn("media_type", F.lit(1))
    got = {r.id: r for r in media.inspect(rows, "id", F.col("content"), F.col("declared")).collect()}
    assert got[1].corrected and got[2].media_type is None and got[3].media_type == "application/x-empty" and not got[None].corrected
    assert media.inspect(rows.limit(0), "id", F.col("content"), F.col("declared")).count() == 0
    assert media.carve(rows, "id", F.col("content")).filter("id = 1").first()["item"] == bytearray(GIF)
    assert media.carve(rows.limit(0), "id", F.col("content")).count() == 0 and media.carve(rows.withColumn("item", F.lit(1)), "id", F.col("content")).count() == 2


# --- 4 -----------------------------------------------------------------------------------------


@pytest.mark.parametrize(
    "url, expected",
    [
        ("HTTP://WWW.Example.com:80/A/", "example.com/A"),
        ("https://m.example.com/a?utm_source=x&b=1#top", "example.com/a?b=1"),
        ("http://example.com/a/index.html", "example.com/a"),
        ("http://example.com/a.html?ref=x", "example.com/a"),
        ("http://example.com", "example.com"),
        ("http://a.com/x:80/y", "a.com/x:80/y"),
        ("//a.com:443/./x?b=2&a=1", "a.com/x?a=1&b=2"),
        ("", ""),
        (None, None),
    ],
)
def test_canonical(spark, url, expected):
    assert spark.createDataFrame([(url,)], "url string").select(urls.canonical(F.col("url")).alias("x")).first().x == expected


@pytest.mark.parametrize("limit", [1 << 20, 0])
def test_url_match_equals_sets(spark, limit):
    rows = [(k, f"http://h{k % 7}.example.org/{k % 50}") for k in range(400)] + [(None, "http://h1.example.org/1/"), (900, None), (3, rows_url := "http://h3.example.org/3")]
    pages = spark.createDataFrame(rows, "page_id long, url string").withColumn("listed", F.lit("clash"))
    listed = spark.createDataFrame([(rows_url,), (rows_url + "/",), (None,), ("http://www.h1.example.org/1#x",)], "url string")
    got = urls.match(pages, listed, broadcast_bytes=limit)
    assert got.columns == ["page_id", "url", "canonical", "listed"] and got.count() == len(rows)
    want = {"h3.example.org/3", "h1.example.org/1"}
    assert all(r.listed == (r.canonical in want) for r in got.collect())
    assert urls.match(pages, listed.limit(0)).filter("listed").count() == 0
    assert urls.match(pages.limit(0), listed).count() == 0


def test_bloom_filter_has_no_false_negatives(spark):
    rows = spark.range(3000).select(F.concat(F.lit("u"), F.col("id").cast("string")).alias("canonical"))
    bloom = urls.bloom_filter(rows, 200)
    probe = spark.range(6000).select(F.concat(F.lit("u"), F.col("id").cast("string")).alias("canonical"), "id")
    h = F.xxhash64("canonical")
    joined = probe.withColumn("block", F.pmod(F.xxhash64("canonical", F.lit(1)), F.lit(200))).join(bloom, "block", "left")
    fits = F.lit(True)
    for k in range(4):
        fits &= urls._mask(h, k).bitwiseAND(F.col(f"w{k}")) == urls._mask(h, k)
    hits = joined.filter(fits)
    assert hits.filter("id < 3000").count() == 3000 and hits.filter("id >= 3000").count() < 200


# --- 5 -----------------------------------------------------------------------------------------


def brute_tree(pages):
    """(composite importance of all pages' root, for each page its texts with what they count for),
    by walking merged trees."""
    kept = collections.defaultdict(list)

    def merge(nodes, owners):
        m = len(nodes)
        log = lambda x: np.log(x) / np.log(m)
        leaves = [n for n in nodes if not n.children]
        by_style = collections.defaultdict(list)
        for n, o in zip(nodes, owners):
            by_style[tuple(c.label for c in n.children) if n.children else None].append((n, o))
        if len(leaves) == m:
            counts = collections.Counter(f for n in leaves for f in html_extract.content(n))
            value = (1.0 if m == 1 else max(0.0, 1 - np.mean([log(c) for c in counts.values()]))) if counts else 0.0
            return value, [(o, n.text, value) for n, o in zip(nodes, owners) if n.text is not None]
        own = 1.0 if m == 1 else -sum(len(g) / m * log(len(g) / m) for g in by_style.values())
        below, texts = 0.0, []
        for style, group in by_style.items():
            children = [merge([n.children[k] for n, _ in group], [o for _, o in group]) for k in range(len(style or ()))]
            below += len(group) / m * np.mean([v for v, _ in children]) if children else 0.0
            texts += [t for _, found in children for t in found]
        value = (1 - html_extract.DAMPING) * own + html_extract.DAMPING * below
        for o, text, leaf in texts:
            kept[o].append((text, (1 - html_extract.CONTEXT) * leaf + html_extract.CONTEXT * value))
        return value, []

    return merge([html_extract.parse(p) for p in pages], range(len(pages)))[0], kept


SITE = ["<html><body><div class=nav><a href='/a'>A</a><a href='/b'>B</a></div><p>text number {0}. More of {0}.</p>{1}<div id=foot>All rights reserved.</div></body></html>"]


def random_site(rnd, n):
    """Pages of one site: a fixed frame, parts that vary in content and parts that vary in layout."""
    pages = []
    for k in range(n):
        parts = ["<div class=nav><a href='/a'>Home</a><a href='/b'>About</a></div>"]
        parts.append("<div class=list>" + "".join(f"<p>item {rnd.randint(0, 4)}</p>" for _ in range(3)) + "</div>")
        parts.append("<div class=main>" + "".join(rnd.choice(["<p>topic {0}</p>", "<h3>topic {0}</h3>", "<ul><li>topic {0}</li></ul>"]).format(rnd.randint(0, 4)) for _ in range(rnd.randint(1, 4))) + f"<p>number {k}. More of {k}.</p></div>")
        if rnd.random() < 0.4:
            parts.append("<section><h2>Extra</h2><p>extra</p></section>")
        pages.append("<html><body>" + "".join(parts) + "<div id=foot>All rights reserved.</div></body></html>")
    return pages


def test_style_tree_equals_merged_trees(spark):
    pages = [SITE[0].format(k, "<p>extra %d</p>" % k if k % 3 == 0 else "") for k in range(9)]
    for pages in (pages, random_site(random.Random(3), 14)):
        rows = spark.createDataFrame([("h", k, p) for k, p in enumerate(pages)], "host string, tie long, html string").repartition(3)
        got = html_extract.importances(rows.mapInArrow(html_extract._elements, html_extract.ROWS)).filter(F.col("key") == html_extract._hash("h")).first().importance
        assert got == pytest.approx(brute_tree(pages)[0], abs=1e-4)


def test_extraction_equals_merged_trees(spark):
    pages = random_site(random.Random(5), 20)
    kept = brute_tree(pages)[1]
    df = spark.createDataFrame([(k, f"http://h.org/{k}", p) for k, p in enumerate(pages)], "page_id long, url string, html string").repartition(3)
    got = {r.page_id: r for r in html_extract.extract(df).collect()}
    for k in range(20):
        want = sorted(text for text, worth in kept[k] if worth >= html_extract.KEEP_AT)
        assert sorted(got[k].text.split("\n")) == want and got[k].n_left_out == len(kept[k]) - len(want)
    assert 0 < sum(r.n_left_out for r in got.values()) < sum(map(len, kept.values()))


def test_presentation_alone_decides(spark):
    # the same texts, once in a part that always looks the same and once in one that never does
    def site(host, layout):
        return [(f"http://{host}/{k}", f"<body><div class=part><section>{layout(k)}</section><p>price {k % 6}</p></div></body>") for k in range(12)]

    rows = site("same.org", lambda k: "<u></u>") + site("varied.org", lambda k: f"<u class=c{k % 6}></u>")
    df = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "page_id long, url string, html string")
    by = collections.defaultdict(set)
    for r in html_extract.extract(df, keep_at=0.59).collect():
        by[r.host].add(r.text != "")
    value = lambda pages: {round(w, 6) for texts in brute_tree([p for _, p in pages])[1].values() for _, w in texts}
    assert max(value(rows[:12])) < 0.59 < min(value(rows[12:])) and by == {"same.org": {False}, "varied.org": {True}}


def test_deep_pages(spark):
    page = "<div>" * 3000 + "deep" + "</div>" * 3000
    df = spark.createDataFrame([(1, "http://d/", page), (2, "http://d/", page.replace("deep", "other"))], "page_id long, url string, html string")
    assert [r.text for r in html_extract.extract(df).orderBy("page_id").collect()] == ["deep", "other"]


def test_extraction_leaves_out_what_all_pages_share(spark):
    rows = [(k, f"http://h.example.org/{k}", SITE[0].format(k, "")) for k in range(12)] + [(50, "http://one.example.org/", SITE[0].format("x", ""))]
    got = {r.page_id: r.text for r in html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[3] == "text number 3. More of 3."
    assert "All rights reserved." in got[50]  # a host with one page keeps all


@pytest.mark.parametrize(
    "page, text",
    [
        ("<html><head><title>t</title><meta charset=utf-8><body><p>one</p>two</html>", "one\ntwo"),
        ("<head><title>t</title><link href=x><div>one</div><p>two", "one\ntwo"),
        ("<head><title>t</title> one", "one"),
        ("<head><noscript><style>x</style><body><p>one</p><noscript>n</noscript>two", "one\ntwo"),
        ("<head><title>t</title><script>x</script></head><body>one<head>two</head>", "onetwo"),
        ("<body><svg><path d=x><p>one</p><svg><text>no</text></svg>two", "one\ntwo"),
        ("<body><svg><foreignObject><p>no</p></foreignObject><text>no</text></svg>two", "two"),
        ("<body><object data=x><p>one</p>two", "one\ntwo"),
        ("<body><iframe src=x><p>one</p><iframe2>", "one"),
        ("<body><object><p>no</p></object><iframe>no</iframe><p>one", "one"),
    ],
)
def test_what_is_hidden_ends(page, text):
    assert html_extract.render(page, "h", set()) == text


def test_extraction_on_odd_input(spark):
    rows = [(1, None, "<p>a<p>b<br>c</div>"), (2, "x", None), (3, "http://h", ""), (None, "http://h", "<script>x<y</script>&lt;z"), (3, "http://h", ""), (4, "http://g", "<a href='" + "x" * 10**5 + "'>" + "w " * 10**5)]
    got = html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("clash")))
    assert got.columns == ["page_id", "host", "text", "n_left_out"] and got.count() == 6
    by = collections.defaultdict(list)
    for r in got.collect():
        by[r.page_id].append(r.text)
    assert by[1] == ["a\nb\nc"] and by[2] == [None] and by[3] == ["", ""] and by[None] == ["<z"] and len(by[4][0]) == 2 * 10**5 - 1
    assert html_extract.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


# --- 6 -----------------------------------------------------------------------------------------


def test_quality_agrees_with_labels(spark):
    folder = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    got = quality.score_documents(spark.read.parquet(f"{folder}/documents.parquet")).join(labels, "doc_id").collect()
    good = [r for r in got if r.quality == 1]
    bad = [r for r in got if r.quality == 0]
    assert sum(r.keep for r in good) / len(good) > 0.98 and sum(r.keep for r in bad) / len(bad) < 0.1


def test_fit_equals_plain_expectation_maximisation():
    rnd = random.Random(21)
    counts = collections.Counter()
    for _ in range(3000):
        good = rnd.random() < 0.7
        counts[tuple(0 if rnd.random() < 0.3 else (1 if rnd.random() < (0.9 if good else 0.3) else -1) for _ in quality.RULES)] += 1
    codes = [quality.encode_votes(v) for v in counts]
    prior, table = quality.fit(np.array(codes), np.array(list(counts.values())))
    p = {v: 1 / (1 + np.exp(-(3.5 - 3.0 * v.count(-1)))) for v in counts}
    for _ in range(200):
        total = sum(counts.values())
        share = (sum(n * p[v] for v, n in counts.items()) + 1) / (total + 2)
        yes = [[1.0, 1.0] for _ in quality.RULES], [[1.0, 1.0] for _ in quality.RULES]
        for v, n in counts.items():
            for r, x in enumerate(v):
                if x:
                    yes[0][r][x > 0] += n * (1 - p[v])
                    yes[1][r][x > 0] += n * p[v]
        new = {}
        for v in counts:
            both = [1 - share, share]
            for c in (0, 1):
                for r, x in enumerate(v):
                    if x:
                        both[c] *= yes[c][r][x > 0] / sum(yes[c][r])
            new[v] = both[1] / sum(both)
        done = max(abs(new[v] - p[v]) for v in p) < 1e-9
        p = new
        if done:
            break
    assert prior == pytest.approx(share, abs=1e-6)
    assert all(table[c, r, 0] == pytest.approx(yes[c][r][0] / sum(yes[c][r]), abs=1e-6) for c in (0, 1) for r in range(len(quality.RULES)))


def test_other_scripts_are_not_voted_down():
    for text in ("Это обычный русский текст о погоде, который никто не хотел бы потерять. " * 5, "这是一个关于天气的普通中文文本。没有人想失去它。" * 3):
        assert -1 not in (quality.votes_of(text)[4], quality.votes_of(text)[8])
    assert quality.votes_of("zzz qqq")[4] == -1


def test_posterior_expression_equals_bayes(spark):
    codes = np.array([0, 5, 3**10 - 1, 29524])
    prior, table = quality.fit(codes, np.array([5, 1, 40, 3]))
    got = [r.p for r in spark.createDataFrame([(int(c),) for c in codes], "code int").select(quality.posterior(F.col("code"), prior, table).alias("p")).collect()]
    for c, p in zip(codes, got):
        v = quality.decode_votes(int(c))
        a, b = ((prior if k else 1 - prior) * np.prod([table[k, r, x + 1] for r, x in enumerate(v)]) for k in (1, 0))
        assert p == pytest.approx(a / (a + b)) and quality.encode_votes(v) == c


def test_quality_on_odd_input(spark):
    got = quality.score_documents(odd(spark))
    assert got.count() == 9 and got.columns == ["doc_id", "votes", "p_quality", "keep"]
    null = got.filter("doc_id = 2").first()
    assert null.votes is None and null.keep is False
    kept = quality.keep_good(odd(spark))
    assert kept.columns == odd(spark).columns and kept.filter("doc_id = 1").count() in (0, 2) and kept.filter("text is null").count() == 0
    assert quality.score_documents(nothing(spark)).count() == 0 and quality.keep_good(nothing(spark)).count() == 0


# --- 7 -----------------------------------------------------------------------------------------


def brute_cost(counts, inside, window, truncation):
    n = len(counts)
    best = [0.0] + [float("inf")] * n
    for i in range(1, n + 1):
        for j in range(i):
            size = sum(counts[j:i])
            if size <= window:
                best[i] = min(best[i], best[j] + window - size + (truncation if inside[i - 1] else 0))
    return best[n]


def test_cuts_are_optimal():
    rnd = random.Random(4)
    for _ in range(300):
        n, window = rnd.randint(1, 12), rnd.randint(5, 20)
        counts = [rnd.randint(0, window) for _ in range(n)]
        inside = [rnd.random() < 0.6 for _ in range(n - 1)] + [False]
        penalty = rnd.choice([0.0, 3.0, 50.0])
        found, start, cost = packing.cuts(counts, inside, window, penalty), 0, 0.0
        for stop in found:
            size = sum(counts[start:stop])
            assert size <= window
            cost += window - size + (penalty if inside[stop - 1] else 0)
            start = stop
        assert start == n and cost == pytest.approx(brute_cost(counts, inside, window, penalty))


def test_packing_has_every_character_once(spark, docs):
    c = sp.codec(sp.MODEL)
    texts = {r.doc_id: r.text for r in docs.collect()}
    windows = packing.pack(docs, window=100).orderBy("shard", "window").collect()
    back, tokens = collections.defaultdict(str), 0
    for w in windows:
        for d, a, b in zip(w.doc_ids, w.starts, w.ends):
            assert len(back[d]) == a
            back[d] += texts[d][a:b]
        assert w.n_tokens <= 100 and w.padding == 100 - w.n_tokens
        tokens += w.n_tokens
    assert dict(back) == {d: t for d, t in texts.items() if t}
    assert [d for w in windows for d in w.doc_ids] == sorted(d for w in windows for d in w.doc_ids)
    assert tokens == sum(sum(counts) for _, counts in packing.units_of(list(texts.values()), 100, c))


def test_tokens_are_those_of_the_model():
    c = sp.codec(sp.MODEL)
    texts = ["One sentence. Another one!  And more\nlines", "", "  \n ", "word " * 30, "x" * 300, "日本語" * 20 + " end."]
    for text, (ends, counts) in zip(texts, packing.units_of(texts, 10, c)):
        assert ends == sorted(ends) and ends[-1:] == [len(text)][: len(ends)] and max(counts, default=0) <= 10
        for a, b, n in zip([0, *ends], ends, counts):
            if "word word" not in text and max(map(len, text.split()), default=0) < 30:
                assert n == len(c.encode(text[a:b].rstrip()))
    assert len(packing.units_of(["word " * 30], 10, c)[0][0]) == 3


def test_counts_look_up_each_word_once():
    class Seen(dict):
        looked = 0

        def get(self, *key):
            Seen.looked += 1
            return super().get(*key)

        def __getitem__(self, key):
            Seen.looked += 1
            return super().__getitem__(key)

    c = sp.Codec(sp.MODEL)
    c.sizes = Seen()
    rnd = random.Random(2)
    texts = [" ".join(rnd.choices(["one", "zwei", "trois", "日本語", "x" * 80, "a.b", ""], k=30)).strip(" ") for _ in range(200)]
    texts += ["", " ", " a", "a ", "a  b", "\u2581a", "lone \ud800 half"]
    assert c.counts(texts) == [len(c.encode(t)) for t in texts]
    assert c.counts(texts[:-1]) == [len(c.encode(t)) for t in texts[:-1]] and c.counts([]) == []
    assert 0 < Seen.looked < 100


def test_sentences_end_where_they_did():
    rnd = random.Random(3)
    before = re.compile(r"(?<=[.!?…。])\s+|\n+")
    for _ in range(3000):
        text = "".join(rnd.choices("ab.!。 \n\t\u3000", k=rnd.randint(0, 14)))
        assert [m.span() for m in packing._END.finditer(text)] == [m.span() for m in before.finditer(text)]


def test_padding_is_the_same_for_dense_and_sparse_ids(spark):
    text = "some words in a sentence of ten or so here. " * 30
    padding = []
    for step in (1, 1_000_003):
        df = spark.createDataFrame([(k * step, text) for k in range(40)], "doc_id long, text string").repartition(5)
        got = packing.pack(df, shard_tokens=5000).collect()
        padding.append((len(got), sum(w.padding for w in got)))
        assert len({w.shard for w in got}) > 1
    assert padding[0] == padding[1]


def test_packing_on_odd_input(spark):
    got = packing.pack(odd(spark)).collect()
    c = sp.codec(sp.MODEL)
    texts = [r.text or "" for r in odd(spark).collect()]
    assert sum(w.n_tokens for w in got) == sum(sum(n) for _, n in packing.units_of(texts, packing.WINDOW, c))
    ids = [d for w in got for d in w.doc_ids]
    assert ids.count(1) == 2 and ids[-1] is None and 2 not in ids and 3 not in ids and max(w.n_tokens for w in got) <= packing.WINDOW
    assert packing.pack(nothing(spark)).count() == 0


# --- 8 -----------------------------------------------------------------------------------------


def brute_lines(rows, threshold=line_dedup.THRESHOLD):
    seen, gone = [], collections.defaultdict(set)
    for i, text in rows:
        for k, line in enumerate(text.split("\n")):
            words = frozenset(line.split())
            if words:
                if any(len(words & s) >= (threshold - 1e-9) * len(words | s) for s in seen):
                    gone[i].add(k)
                seen.append(words)
    return dict(gone)


def test_line_dedup_equals_brute_force(spark):
    rnd = random.Random(6)
    words = [f"w{k}" for k in range(80)]
    lines = [[rnd.choice(words) for _ in range(rnd.randint(1, 30))] for _ in range(60)]
    lines += [[f"v{rnd.randint(0, 10**5)}" for _ in range(n)] for n in (90, 170, 400, 900)]
    rows = []
    for i in range(150):
        part = []
        for _ in range(rnd.randint(1, 5)):
            line = list(rnd.choice(lines))
            for _ in range(rnd.randint(0, 1 + len(line) // 8)):
                line[rnd.randrange(len(line))] = rnd.choice(words)
            part.append(" ".join(line))
        rows.append((i, "\n".join(part)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r.doc_id: set(r.lines) for r in line_dedup.repeated_lines(df).collect()}
    assert got == brute_lines(rows)


def lines_in_order(df):
    """(doc_id, tie) -> the numbers of the lines that go, by brute force in the order of the operator."""
    rows = {(r.doc_id is None, r.doc_id or 0, r.tie): r.text for r in df.select("doc_id", "text", row_key("doc_id", "text").alias("tie")).collect()}
    return {(None if k[0] else k[1], k[2]): v for k, v in brute_lines(sorted(rows.items())).items()}


def test_line_dedup_of_a_chain_in_another_order(spark, request):
    # J(W, X) = J(X, Y) = 0.82, J(W, Y) = 0.67
    w, x, y = (" ".join(f"w{k}" for k in range(a, a + 20)) for a in (0, 2, 4))
    spark.conf.set("spark.sql.shuffle.partitions", "1")  # so that all of a line's partners meet in one place
    request.addfinalizer(lambda: spark.conf.set("spark.sql.shuffle.partitions", "4"))
    for rows in ([(100, x), (50, y), (5, x), (1, w)], [(None, x), (50, y), (None, w)]):
        df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
        assert {(r.doc_id, r.tie): set(r.lines) for r in line_dedup.repeated_lines(df).collect()} == lines_in_order(df)


@pytest.mark.parametrize("partitions", ["1", "32"])
def test_line_dedup_of_a_shuffled_table(spark, request, partitions):
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    request.addfinalizer(lambda: spark.conf.set("spark.sql.shuffle.partitions", "4"))
    rnd = random.Random(9)
    rows = []
    for c in range(12):  # chains whose neighbours match
        for k in range(16):
            line = " ".join(f"c{c}w{j}" for j in range(2 * k, 2 * k + 20))
            rows += [(rnd.choice([None, rnd.randint(0, 60), rnd.randint(-(2**62), 2**62)]), "\n".join([f"only{len(rows)}", line])) for _ in range(rnd.randint(1, 3))]
    rows += [(i, a + "\n" + b) for (i, a), (_, b) in zip(rows[::5], rows[3::7])]
    rnd.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(2).cache()
    assert {(r.doc_id, r.tie): set(r.lines) for r in line_dedup.repeated_lines(df).collect()} == lines_in_order(df)


def test_reach_has_every_pair_that_may_match_and_few_others():
    rnd, t = np.random.RandomState(5), line_dedup.THRESHOLD - 1e-9
    n = rnd.randint(1, 60, 1500)
    i = np.floor(rnd.rand(1500) * (n - np.ceil(t * n) + 1)).astype(np.int64)
    group = rnd.randint(0, 4, 1500)
    order = np.lexsort((i, n, group))
    group, n, i = group[order], n[order], i[order]
    index, low, high = line_dedup.reach(group, n, i, t)
    found = [(x, y) for x in range(1500) for y in index[low[x] : high[x]].tolist()]
    same = [(x, y) for x in range(1500) for y in range(x) if group[x] == group[y] and n[y] >= t * n[x]]
    may = {(x, y) for x, y in same if min(n[x] - i[x], n[y] - i[y]) >= np.ceil(t / (1 + t) * (n[x] + n[y]))}
    assert may <= set(found) <= set(same) and len(set(found)) == len(found) < 0.5 * len(same)


def test_earliest_of_rows_of_one_set():
    rows = [(1, 5, 0, 9), (1, 5, 0, 3), (1, 5, 0, 4), (1, 6, 0, 1), (2, 6, 0, 8), (2, 6, 1, 7), (2, 7, 1, 7), (2, 7, 1, 2)]
    word, node, i, at = (np.array(x) for x in zip(*rows))
    assert line_dedup.earliest(word, node, i, (np.zeros(8, bool), at)).tolist() == [1, 3, 4, 5, 7]
    assert line_dedup.earliest(word[:0], node[:0], i[:0], (at[:0],)).tolist() == []


def test_a_batch_sends_one_line_of_each_set():
    import pyarrow as pa

    class levels:
        value = np.zeros(line_dedup.SLOTS, np.uint8)

    def heads(*rows):
        columns = [pa.array(x, kind) for x, kind in zip(zip(*rows), (pa.bool_(), pa.int64(), pa.int64(), pa.string()))]
        (out,) = line_dedup._lines(levels, 0.8)(iter([pa.RecordBatch.from_arrays(columns, ["nulls", "doc_id", "tie", "text"])]))
        node, nulls, doc_id, line, again = (out.column(c).to_pylist() for c in ("node", "nulls", "doc_id", "line", "again"))
        sent = out.filter(pa.array([x is False for x in again])).select(["node", "nulls", "doc_id", "tie", "line"]).to_pydict()
        sent["line"] = [~x if null else x for x, null in zip(sent["line"], sent.pop("nulls"))]
        sent = pa.table(sent, pa.schema([("node", pa.int64()), ("doc_id", pa.int64()), ("tie", pa.int64()), ("line", pa.int32())]))
        return node, list(zip(nulls, doc_id, line, again)), list(line_dedup._by_node(2)(iter(sent.to_batches())))

    same = (False, 3, 2, "a c b\n\nq")
    node, lines, sent = heads((False, 7, 1, "a b c\nx y\nc b a"), same, (True, 0, 3, "x y"), same)
    assert lines == [(False, 7, 0, True), (False, 7, 1, False), (False, 7, 2, True), (False, 3, 0, False), (False, 3, 2, False), (True, 0, 0, True), (False, 3, 0, None), (False, 3, 2, None)]
    more = heads((True, 0, 4, "q"), same, (False, 1, 5, "c a b"), (False, 9, 6, "only here"))
    gone = list(line_dedup._by_node(2)(iter([pa.RecordBatch.from_arrays([pa.array([more[0][-1]])], ["node"])])))
    gone = [pa.RecordBatch.from_arrays([*x.columns, *[pa.nulls(1, pa.binary())] * 3], ["part", "node", "doc_id", "tie", "line"]) for x in gone]
    out = [tuple(x.values()) for b in line_dedup._removed(iter([*sent, *gone, *more[2]])) for x in b.to_pylist()]
    assert sorted(out) == [(False, 3, 2, 0), (False, 9, 6, 0)]


def test_line_dedup_takes_little_memory_for_a_batch():
    import tracemalloc

    import pyarrow as pa

    class levels:
        value = np.zeros(line_dedup.SLOTS, np.uint8)

    rnd = np.random.RandomState(4)
    words = np.char.add("word", np.arange(200_000).astype(str))
    texts = ["\n".join(" ".join(line) for line in rnd.choice(words, (10, 40))) for _ in range(1500)]
    batch = pa.RecordBatch.from_arrays([pa.array([False] * 1500), pa.array(range(1500)), pa.array(range(1500)), pa.array(texts)], ["nulls", "doc_id", "tie", "text"])
    assert 5 << 20 < batch.column("text").nbytes < 8 << 20
    for run in (line_dedup._count, line_dedup._lines(levels, 0.8)):
        tracemalloc.start()
        for _ in run(iter([batch])):
            pass
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert peak < 45 << 20


def test_line_dedup_releases_what_packing_left():
    import pyarrow as pa

    class levels:
        value = np.zeros(line_dedup.SLOTS, np.uint8)

    text = pa.array(["one two\nthree"])
    batch = pa.RecordBatch.from_arrays([pa.array([False]), pa.array([1]), pa.array([1]), text], ["nulls", "doc_id", "tie", "text"])
    for run in (line_dedup._count, line_dedup._lines(levels, 0.8)):
        packing.units_of(text.to_pylist(), 10, sp.codec(sp.MODEL))
        assert sp.codec.cache_info().currsize
        assert list(run(iter([batch]))) and not sp.codec.cache_info().currsize
    assert packing.units_of(text.to_pylist(), 10, sp.codec(sp.MODEL)) == [([8, 13], [2, 1])]


def test_blocks_of_words_give_the_same_hashes_and_marks(monkeypatch):
    import pyarrow as pa

    rnd = np.random.RandomState(6)
    words = pa.array(["", *[f"\u00e4{k}" for k in range(3000)], "q" * 9000, "", ""])
    lines = [" ".join(f"w{k}" for k in rnd.choice(4000, n, replace=False)) for n in rnd.randint(1, 400, 60)]
    found = []
    for block in (1 << 30, 1000, 1):
        monkeypatch.setattr(line_dedup, "BLOCK", block)
        w = line_dedup.Words(pa.array(["\n".join(lines)]))
        _, start, code = w.sets(np.argsort(w.hashes))
        n = np.diff(np.r_[start, len(code)])
        found.append([line_dedup.hashes_of(words).tolist(), *(x.tolist() for x in line_dedup.marks(w.hashes, code, start, n))])
    assert found[0] == found[1] == found[2] and line_dedup.hashes_of(pa.array(["", ""])).tolist() == [0, 0]


def test_any_order_of_words_gives_the_same_lines(spark, monkeypatch):
    rnd = random.Random(12)
    rows = []
    for i in range(80):
        line = [f"w{k}" for k in range(rnd.randint(0, 4), 24)]
        rows.append((i, "\n".join([" ".join(rnd.sample(line, len(line) - rnd.randint(0, 4))), f"line of {i % 9} only", " ".join(line)])))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    for seed in (None, 1):  # as counted; at random
        if seed:
            monkeypatch.setattr(line_dedup, "rarity", lambda texts: np.random.RandomState(seed).randint(0, 256, line_dedup.SLOTS).astype(np.uint8))
        assert {r.doc_id: set(r.lines) for r in line_dedup.repeated_lines(df).collect()} == brute_lines(rows)


def test_line_dedup_on_documents(spark, docs):
    rows = sorted((r.doc_id, r.text) for r in docs.collect())
    gone = brute_lines(rows)
    got = {r.doc_id: r.text for r in line_dedup.dedup(docs).collect()}
    for i, text in rows:
        assert got[i] == "\n".join(line for k, line in enumerate(text.split("\n")) if k not in gone.get(i, ()))


def test_string_hashes_differ():
    import pyarrow as pa

    words = pa.array([f"w{k}" for k in range(50_000)] + ["", "x" * 9000, "x" * 9001])
    h = line_dedup.hashes_of(words)
    assert len(set(h.tolist())) == len(words) and line_dedup.hashes_of(words.slice(7, 9)).tolist() == h[7:16].tolist()


def test_line_dedup_on_odd_input(spark):
    got = line_dedup.dedup(odd(spark))
    assert got.columns == odd(spark).columns and got.count() == 9
    by = collections.defaultdict(list)
    for r in got.collect():
        by[r.doc_id].append(r.text)
    assert by[1] == ["The cat sat on the mat and looked at the dog."] * 2 and by[2] == [None] and by[3] == [""] and by[4] == ["   \n \n"]
    assert line_dedup.dedup(nothing(spark)).count() == 0
    tie = spark.createDataFrame([(2, "a b c d e\nx"), (1, "a b c d e\n\ny"), (None, "a b c d e")], "doc_id long, text string")
    assert {r.doc_id: r.text for r in line_dedup.dedup(tie).collect()} == {1: "a b c d e\n\ny", 2: "x", None: ""}


# --- 9 -----------------------------------------------------------------------------------------


def test_surrogates_by_hand(spark):
    text = "Mr. John Smith (john.smith@corp.example.com, 10.1.2.3) met Anna Jones; John paid with 4111 1111 1111 1111. token = \"0123456789abcdef0123456789abcdef\" SMITH"
    rows = spark.createDataFrame([(1, text), (2, "Mrs. Anna Jones again, card 4111-1111-1111-1111.")], "doc_id long, text string")
    got = {r.doc_id: r.text for r in pii.anonymise(rows, KEY).collect()}
    for secret in ("John", "Smith", "SMITH", "Anna", "Jones", "corp", "10.1.2.3", "4111", "0123456789abcdef"):
        assert secret not in got[1] and secret not in got[2]
    found = {k: v for k, v in zip("first last".split(), got[1].split("Mr. ")[1].split()[:2])}
    assert got[1].count(found["first"]) == 2 and found["last"].upper() in got[1].split()[-1]
    digits = "".join(c for c in got[2].split("card ")[1] if c.isdigit())
    assert pii._luhn(digits) == 0 and got[1].split("paid with ")[1][:19].replace(" ", "") == digits
    assert got[1].split(", ")[1].startswith("10.")
    assert got[2].split("Mrs. ")[1].split()[0] in got[1]


def brute_surrogates(entities, key):
    """The operator's rules over a set of entities, one at a time."""
    family = lambda kind: "name" if kind.startswith(("first.", "last.")) else kind
    real = {(family(k), c) for k, c in entities}
    first = {e: pii.surrogate(*e, 0, key) for e in entities}
    owner = {}
    for e in sorted(entities, reverse=True):
        owner[family(e[0]), first[e]] = e
    left = [e for e in sorted(entities) if (family(e[0]), first[e]) in real or owner[family(e[0]), first[e]] != e]
    used, out = real | {(family(k), new) for (k, _), new in first.items()}, dict(first)
    for attempt in range(1, pii.ROUNDS + 1):
        if attempt == pii.ROUNDS:
            left = [e for e in left if family(e[0]) == "name"]
        fresh, still = {}, []
        for e in left:
            form = (family(e[0]), pii.surrogate(*e, attempt, key))
            if form in used or form in fresh:
                still.append(e)
            else:
                fresh[form] = e
        out |= {e: form[1] for form, e in fresh.items()}
        used |= set(fresh)
        left = still
    return out


def test_surrogates_equal_brute_force_and_are_distinct(spark):
    rnd = random.Random(12)
    rows = [("ssn", f"{k:09d}") for k in range(300)] + [("last.latin", f"name{k}") for k in range(3000)] + [("ip", f"10.0.{k // 250}.{k % 250}") for k in range(900)]
    rows += [("email", f"{a}@{d}.com") for a in "abcdefghijklmnopqrstuvwxyz" for d in "xy"]  # all that there are
    rows += [("ip", f"192.168.{a}.{b}") for a in range(0, 256, 5) for b in range(256)] + [("card", f"4{k}") for k in range(90)]
    rows += [("first.f.latin", x) for x in ("baba", "bebia", "zazaette")] + [("first.m.greek", "νίκος"), ("last.armenian", "պետրոսյան"), ("phone", "+4930123456"), ("phone", "0201234567")]
    rows += [("secret", "".join(rnd.choice("ab1") for _ in range(8))) for _ in range(500)] + [("iban", "DE89370400440532013000"), ("ip", "2001:db8:0:0:0:0:0:1")]
    rows = sorted(set(rows))
    got = {(r.kind, r.canonical): r.new for r in pii.surrogates(spark.createDataFrame(rows, "kind string, canonical string"), KEY).collect()}
    assert got == brute_surrogates(set(rows), KEY)
    assert len({(k.split(".")[0], new) for (k, _), new in got.items()}) == len(rows)
    mild = [e for e in rows if e[0] not in ("email", "card") and not e[1].startswith("192.168")]
    assert not {(k, got[k, c]) for k, c in mild} & set(rows)
    assert pii._iban_valid(got["iban", "DE89370400440532013000"]) and got["ip", "2001:db8:0:0:0:0:0:1"].startswith("2001:")
    assert all(got[e].startswith("192.168.") for e in rows if e[1].startswith("192.168."))


@pytest.mark.parametrize("size", [1, 2, 3, 10, 26, 97, 1000])
def test_permutations(size):
    assert sorted(pii.permuted(k, size, KEY, "x") for k in range(size)) == list(range(size))
    assert size < 20 or [pii.permuted(k, size, KEY, "x") for k in range(size)] != [pii.permuted(k, size, b"other", "x") for k in range(size)]


def test_formats_are_kept():
    for c in "aZ5йΩé中٣ßÉ-ſ":
        assert c in pii._pool(c) and len({pii._pool(x) for x in pii._pool(c)}) == 1 and len(set(pii._pool(c))) == len(pii._pool(c))
    assert len({pii.surrogate("card", f"4{k:02d}", 0, KEY) for k in range(100)}) == 100
    valid = [x for x in (f"4{k:03d}" for k in range(1000)) if pii._luhn(x) == 0]
    assert sorted(pii.surrogate("card", x, 0, KEY) for x in valid) == valid
    assert pii._network(pii.ipaddress.IPv4Address(pii.surrogate("ip", "8.8.8.8", 0, KEY))) is None


@pytest.mark.parametrize(
    "text, entities",
    [
        ("Priya Sharma met Wei Zhang and Kwame Mensah.", ["Priya", "Sharma", "Wei", "Zhang", "Kwame", "Mensah"]),
        ("Zorblax Quennell said that Tib Warrick and Ulo Pendergast left. Quennell laughed.", None),
        ("Olivia Brown", ["Olivia", "Brown"]),
        ("call 020 7946 0958", ["020 7946 0958"]),
        ("version 10.4.3.2 of the Apache License, New York", []),
        ("from 10.4.3.2 on", ["10.4.3.2"]),
        ("a@b.c@d.e, x..y@z, <q.r@s-t.org>", ["a@b.c", "q.r@s-t.org"]),
        ("token token=abcdefghij secret: abc12345x", ["abc12345x"]),
    ],
)
def test_what_is_detected(text, entities):
    found = [text[a:b] for a, b, _, _ in pii.detect(text)]
    if entities is None:
        assert found[:2] == ["Zorblax", "Quennell"] and found.count("Quennell") == 2
    else:
        assert found == entities


def test_detection_is_linear():
    import time

    mention = "Mr. John Smith wrote. "
    for text in ("x" * 10**6 + "@" + "y" * 10**6, mention * 40_000, "token=" * 150_000 + " 1", "a@" * 300_000, "Dr " * 300_000, "1 " * 400_000):
        began = time.time()
        pii.detect(text)
        assert time.time() - began < 20


def test_nothing_of_the_documents_personal_data_is_left(spark, docs):
    before = {r.doc_id: r.text for r in docs.collect()}
    after = {r.doc_id: r.text for r in pii.anonymise(docs, KEY).collect()}
    entities = {before[i][a:b] for i, t in before.items() for a, b, _, _ in pii.detect(t)}
    assert entities and not any(e in t for t in after.values() for e in entities)
    for i, t in before.items():
        if not pii.detect(t):
            assert after[i] == t


def test_pii_on_odd_input(spark):
    got = pii.anonymise(odd(spark), KEY)
    assert got.columns == odd(spark).columns and got.count() == 9
    texts = [r.text for r in got.filter("doc_id is null and text is not null").collect()]
    assert "a@b" not in texts[0] and "555-1234" not in texts[0]
    assert got.filter("text is null").count() == 2 and pii.anonymise(nothing(spark), KEY).count() == 0
    cyrillic = pii.detect("г-н Иван Петров и Мария Иванова")
    assert {k for _, _, k, _ in cyrillic} == {"first.m.cyrillic", "first.f.cyrillic", "last.cyrillic"}


# --- 10 ----------------------------------------------------------------------------------------


def test_windows_cover_the_text():
    data = bytes(random.Random(0).randbytes(1000))
    w = language.windows_of(data, 256)
    assert len(w) == 4 and b"".join(x.tobytes() for x in w[:3]) == data[:768] and w[3].tobytes() == data[-256:]
    assert len(language.windows_of(b"")) == 0 and language.windows_of(b"ab", 4).tolist() == [[97, 98, 0, 0]]


def test_tables_equal_the_convolution():
    rng = np.random.RandomState(0)
    net = language.train(rng.randint(0, 256, (64, 32)).astype(np.uint8), np.arange(64) % 2, ["a", "b"])
    x = rng.randint(0, 256, (3, 32)).astype(np.uint8)
    v = net.vectors[x]
    pooled = []
    for width, f in zip(language.WIDTHS, net.filters):
        pooled.append(np.stack([np.einsum("bwd,wdf->bf", v[:, o : o + width], f) for o in range(32 - width + 1)], 1).max(1))
    want = np.maximum(np.concatenate(pooled, 1) + net.bias, 0)
    assert np.allclose(net.pooled(x, net.tables()), want, atol=1e-4)


def test_language_on_held_out_text(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    train, test = docs.filter("doc_id % 4 < 3"), docs.filter("doc_id % 4 = 3").limit(800)
    hidden = test.withColumn("lang", F.lit(None).cast("string")).union(train.limit(2400))
    got = language.identify(hidden).join(test.select("doc_id", F.col("lang").alias("truth")), "doc_id").collect()
    assert len(got) == 800 and sum(r.language == r.truth for r in got) / 800 > 0.97


def test_a_rare_language_is_learnt(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    rare = docs.limit(3).select("doc_id", F.lit("слово и дело " * 40).alias("text"), F.lit("xx").alias("lang"))
    rows = language.sample(docs.union(rare), "text", "lang", 400)
    by = collections.Counter(a for a, _ in rows)
    assert by["xx"] == 3 and max(by.values()) < 2 * min(n for a, n in by.items() if a != "xx") and max(len(b) for _, b in rows) > 1500


def test_language_on_odd_input(spark):
    got = language.identify(odd(spark))
    assert got.columns == ["doc_id", "language", "confidence", "n_windows"] and got.count() == 9
    by = {r.doc_id: r for r in got.filter("doc_id is not null").collect()}
    assert by[2].language is None and by[3].n_windows == 0 and by[5].n_windows > 1000
    assert language.identify(nothing(spark)).count() == 0
    assert language.identify(odd(spark).withColumn("lang", F.lit(None).cast("string"))).filter("language is not null").count() == 0
