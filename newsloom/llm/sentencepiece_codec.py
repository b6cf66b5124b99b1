"""SentencePiece encoding and decoding by streaming Viterbi.

The model file is read here without the library. For a unigram model the best path maximises the
sum of piece scores. For a model of merges (BPE) the path is the one in which every two
neighbouring pieces are stable, that is, merging the characters of both gives these two again:
each prefix then has exactly one last piece, so the same forward pass with backpointers finds
what the merges would have made, in one pass and without a queue of merges.

The forward pass keeps a window of as many positions as the longest piece has characters. As soon
as the backpointer paths of all positions in it meet in one boundary, the ids before that are
final and given out; a text of any length needs no more than that window and what lies between
two meetings. Most meetings are at spaces, which no piece has in its middle: all paths go through
them. What lies between two of them is a word, so the words of a batch are passes of their own that
run side by side, a character at a time, as columns of numpy arrays (``_Lanes``); few or very long
ones run one after the other (``Codec.stream``). Ids of words are remembered in a table of bounded
size.
"""

from __future__ import annotations

import math
import re
import struct
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.core.broadcast import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bound_batches, remembered, small_batches

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
NORMAL, UNKNOWN, CONTROL, USER, BYTE = 1, 2, 3, 4, 6
UNIGRAM, MERGES = 1, 2
SPACE = "▁"


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """The fields of a protocol-buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            b = data[at]
            at += 1
            value |= (b & 127) << shift
            shift += 7
            if b < 128:
                return value

    while at < len(data):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
        elif kind == 2:
            n = varint()
            yield key >> 3, data[at : at + n]
            at += n
        else:
            n = 8 if kind == 1 else 4
            yield key >> 3, data[at : at + n]
            at += n


class Codec:
    """A SentencePiece model: ``encode`` a text to ids, ``decode`` ids to a text."""

    def __init__(self, model: str | bytes, remembered: int = 1_000_000):
        """``model``: the path of a model file, or its bytes."""
        message = model if isinstance(model, bytes) else Path(model).read_bytes()
        self.pieces: list[tuple[str, float, int]] = []
        self.kind, self.fallback, self.prefix, self.squeeze = UNIGRAM, False, True, True
        for n, value in _fields(message):
            if n == 1:
                piece, score, kind = "", 0.0, NORMAL
                for k, v in _fields(value):
                    if k == 1:
                        piece = v.decode("utf-8")
                    elif k == 2:
                        score = struct.unpack("<f", v)[0]
                    elif k == 3:
                        kind = v
                self.pieces.append((piece, score, kind))
            elif n == 2:
                for k, v in _fields(value):
                    if k == 3:
                        self.kind = v
                    elif k == 35:
                        self.fallback = bool(v)
            elif n == 3:
                for k, v in _fields(value):
                    if k == 1 and v not in (b"identity", b""):
                        raise ValueError(f"normaliser {v!r} is not supported")
                    if k == 3:
                        self.prefix = bool(v)
                    elif k == 4:
                        self.squeeze = bool(v)
        if self.squeeze:
            raise ValueError("models that remove white space are not supported")
        self.ids = {p: i for i, (p, _, kind) in enumerate(self.pieces) if kind in (NORMAL, USER)}
        self.scores = {p: self.pieces[i][1] for p, i in self.ids.items()}
        self.unknown = next((i for i, x in enumerate(self.pieces) if x[2] == UNKNOWN), 0)
        self.bytes = {int(p[3:5], 16): i for i, (p, _, kind) in enumerate(self.pieces) if kind == BYTE}
        self.longest = max(map(len, self.ids), default=1)
        self.lengths = sorted({len(p) for p in self.ids}, reverse=True)
        self.low = min(self.scores.values(), default=0.0) - 10.0
        if self.kind == MERGES:
            self.histories: dict[str, tuple[list[float], list[str], list[str]]] = {}
            self.stable = {p for p in self.ids if self.merged(p) == [p]}
            self.pairs = _Pairs(self, 1 << 19)
            self.lanes = _Lanes(self)
        self.whole_words = not any(SPACE in p.lstrip(SPACE) for p in self.ids)
        self.known: dict[str, bytes] = {}  # ids by word, packed; it is emptied when it is full
        self.sizes: dict[str, int] = {}  # the same for numbers of ids, by words without the space before them
        self.remembered = remembered
        self.texts = [self._text(i) for i in range(len(self.pieces))]
        self.byte_ids = frozenset(self.bytes.values())

    def merged(self, text: str) -> list[str]:
        """The merges themselves, for a text of a few characters."""
        parts = list(text)
        while True:
            best, where = None, -1
            for k in range(len(parts) - 1):
                s = self.scores.get(parts[k] + parts[k + 1])
                if s is not None and (best is None or s > best):
                    best, where = s, k
            if best is None:
                return parts
            parts[where : where + 2] = [parts[where] + parts[where + 1]]

    def history(self, text: str) -> tuple[list[float], list[str], list[str]]:
        """The scores of the merges of a text of a few characters, one after the other, and its
        first and last part before and after each."""
        found = self.histories.get(text)
        if found is None:
            parts, marks = list(text), []
            firsts, lasts = [parts[0]], [parts[-1]]
            while True:
                best, where = -math.inf, -1
                for k in range(len(parts) - 1):
                    s = self.scores.get(parts[k] + parts[k + 1], -math.inf)
                    if s > best:
                        best, where = s, k
                marks.append(best)
                if where < 0:
                    break
                parts[where : where + 2] = [parts[where] + parts[where + 1]]
                firsts.append(parts[0])
                lasts.append(parts[-1])
            found = marks, firsts, lasts
            if len(text) > 1:
                self.histories[text] = found  # one for each stable piece at most
        return found

    def fits(self, a: str, b: str) -> bool:
        """Whether merging the characters of two stable pieces gives these two again: their merges
        run side by side, the better first, and none goes across."""
        marks, _, lasts = self.history(a)
        others, firsts, _ = self.history(b)
        i = j = 0
        across = self.scores.get(lasts[0] + firsts[0], -math.inf)
        while True:
            x, y = marks[i], others[j]
            if across > x and across >= y:
                return False
            if x == y == -math.inf:
                return True
            if x >= y:
                i += 1
            else:
                j += 1
            across = self.scores.get(lasts[i] + firsts[j], -math.inf)

    @staticmethod
    def _packed(ids: list[int]) -> bytes:
        return struct.pack(f"<{len(ids)}i", *ids)

    def stream(self, text: str) -> Iterator[str]:
        """The pieces of a text, each given out as soon as no later character can change it."""
        size = self.longest + 1
        score = [0.0] * size
        last: list[str] = [""] * size
        done = 0
        merges, scores = self.kind == MERGES, self.scores
        pointers: dict[int, int] = {0: 0}  # start of the last piece, for every position not final
        for i in range(1, len(text) + 1):
            here, found = i % size, 0
            if merges:
                for n in self.lengths:
                    if n > i - done:
                        continue
                    piece = text[i - n : i]
                    if piece in self.stable and (n == i or self.pairs[last[(i - n) % size], piece]):
                        found = n
                        break
                if not found:
                    found = 1
            else:
                best = None
                for n in self.lengths:
                    if n > i - done:
                        continue
                    s = scores.get(text[i - n : i])
                    if s is not None and (best is None or score[(i - n) % size] + s > best):
                        best, found = score[(i - n) % size] + s, n
                if text[i - 1] not in scores and (best is None or score[(i - 1) % size] + self.low > best):
                    best, found = score[(i - 1) % size] + self.low, 1
                score[here] = best
            last[here] = text[i - found : i]
            pointers[i] = i - found
            meet = self._meeting(pointers, i, done)
            if meet > done:
                yield from self._path(pointers, meet, done, text)
                for k in [k for k in pointers if k < meet]:
                    del pointers[k]
                done = meet
        if done < len(text):
            yield from self._path(pointers, len(text), done, text)

    def _meeting(self, pointers: dict[int, int], i: int, done: int) -> int:
        """The last boundary through which the paths of all positions go that a later piece can
        start at."""
        first = max(done, i - self.longest + 1)
        at = {*range(first, i + 1)}
        while len(at) > 1:
            top = max(at)
            at.discard(top)
            if top <= done:
                return done
            at.add(pointers[top])
        return at.pop()

    @staticmethod
    def _path(pointers: dict[int, int], end: int, start: int, text: str) -> list[str]:
        out = []
        while end > start:
            out.append(text[pointers[end] : end])
            end = pointers[end]
        return out[::-1]

    def _ids(self, pieces: Iterator[str]) -> list[int]:
        out: list[int] = []
        for p in pieces:
            i = self.ids.get(p)
            if i is not None:
                out.append(i)
            elif self.fallback:
                out += [self.bytes[b] for b in p.encode("utf-8", "surrogatepass")]
            elif not (out and out[-1] == self.unknown):
                out.append(self.unknown)
        return out

    def words(self, text: str) -> list[str]:
        """The text cut where no piece goes across."""
        if self.prefix and self.whole_words and text and text[0] != " " and "  " not in text and SPACE not in text:
            return (SPACE + text.replace(" ", " " + SPACE)).split(" ")
        text = ((SPACE if self.prefix else "") + text).replace(" ", SPACE) if text else ""
        return _WORDS.findall(text) if self.whole_words else [text]

    def ids_of_words(self, texts: list[str]) -> tuple[list[list[str]], dict[str, bytes]]:
        """The words of each text, and the packed ids of all of them by word."""
        cut = [self.words(text) for text in texts]
        known, every = self.known, set().union(*cut)
        new = [w for w in every if w not in known]
        if len(known) + len(new) > self.remembered:
            known.clear()
            new = list(every)
        found = self.lanes.ids(new) if self.kind == MERGES else [self._packed(self._ids(self.stream(w))) for w in new]
        long = {}
        for w, ids in zip(new, found):
            (known if len(w) <= 64 else long)[w] = ids
        return cut, known if not long else known | long

    def counts(self, texts: list[str]) -> list[int]:
        """How many ids each text is encoded to."""
        out = [0] * len(texts)
        left = range(len(texts))
        if self.kind == MERGES and self.prefix and self.whole_words:
            try:
                array = pa.array(texts, pa.large_string())
            except UnicodeEncodeError:  # lone surrogates
                array = None
            if array is not None:
                odd = pc.or_(pc.or_(pc.starts_with(array, " "), pc.match_substring(array, "  ")), pc.match_substring(array, SPACE))
                plain = pc.and_(pc.invert(odd), pc.not_equal(array, "")).to_numpy(zero_copy_only=False)
                some = np.flatnonzero(plain)
                if len(some):
                    found = self._plain_counts(array.take(pa.array(some)))
                    for k, n in zip(some.tolist(), found.tolist()):
                        out[k] = n
                left = np.flatnonzero(~plain).tolist()
        others = [k for k in left if texts[k]]
        for k, ids in zip(others, self.encode_batch([texts[k] for k in others]) if others else ()):
            out[k] = len(ids)
        return out

    def _plain_counts(self, texts: pa.Array) -> np.ndarray:
        """``counts`` of texts whose words are what stands between single spaces: each distinct
        word is looked up once."""
        cut = pc.split_pattern(texts, " ")
        coded = cut.flatten().dictionary_encode()
        words = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        sizes = self.sizes
        found = list(map(sizes.get, words))
        new = [w for w, n in zip(words, found) if n is None]
        if new and len(sizes) + len(new) > self.remembered * 4 // 5:
            sizes.clear()
            new = words
        if new:
            sizes.update(zip(new, (len(x) // 4 for x in self.lanes.ids([SPACE + w for w in new]))))
            found = list(map(sizes.__getitem__, words))
        starts = cut.offsets.to_numpy()[:-1] - cut.offsets[0].as_py()
        return np.add.reduceat(np.array(found, np.int64)[coded.indices.to_numpy()], starts)

    def encode_batch(self, texts: list[str]) -> list[np.ndarray]:
        cut, found = self.ids_of_words(texts)
        return [np.frombuffer(b"".join(map(found.__getitem__, words)), "<i4") for words in cut]

    def encode(self, text: str) -> list[int]:
        return self.encode_batch([text])[0].tolist()

    def _text(self, i: int) -> bytes:
        piece, _, kind = self.pieces[i]
        if kind == BYTE:
            return bytes([int(piece[3:5], 16)])
        if kind == CONTROL:
            return b""
        return " ⁇ ".encode() if kind == UNKNOWN else piece.replace(SPACE, " ").encode()

    def decode(self, ids) -> str:
        out = b"".join(map(self.texts.__getitem__, ids))
        return (out[1:] if self.prefix and out[:1] == b" " else out).decode("utf-8", "replace")


_WORDS = re.compile(f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+")


class _Table:
    """int64 keys >= 0 to int32 values by open addressing; whole arrays are looked up at once."""

    def __init__(self, bits: int):
        self.bits = bits
        self.clear()

    def clear(self) -> None:
        self.keys, self.values, self.n = np.full(1 << self.bits, -1, np.int64), np.zeros(1 << self.bits, np.int32), 0

    def put(self, key: int, value: int) -> None:
        at = (key * 0x9E3779B97F4A7C15 & (1 << 64) - 1) >> 64 - self.bits
        while self.keys[at] not in (-1, key):
            at = (at + 1) & ((1 << self.bits) - 1)
        self.n += self.keys[at] == -1
        self.keys[at], self.values[at] = key, value

    def get(self, keys: np.ndarray) -> np.ndarray:
        """The values, -1 where a key isn't there."""
        at = (keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self.bits)).view(np.int64)
        there = self.keys[at]
        out = np.where(there == keys, self.values[at], np.int32(-1))
        left = np.flatnonzero((there != keys) & (there >= 0))
        while len(left):
            at[left] = (at[left] + 1) & ((1 << self.bits) - 1)
            there = self.keys[at[left]]
            hit = there == keys[left]
            out[left[hit]] = self.values[at[left[hit]]]
            left = left[~hit & (there >= 0)]
        return out


class _Lanes:
    """The streaming forward pass for many words side by side. Position i of all words is done at
    once: a tree of the stable pieces, read from their ends, gives the pieces that end there, and a
    table of pairs says which of them may follow the piece before. A character that is no piece is
    a piece by itself, with a code after those of the pieces."""

    CELLS, FEWEST = 1 << 20, 48

    def __init__(self, codec: Codec):
        self.codec = codec
        self.pieces = sorted(codec.stable)
        self.vocabulary = np.array([codec.ids[p] for p in self.pieces] + [-1], np.int32)
        states: dict[tuple[int, str], int] = {}
        ends = [-1]
        for code, piece in enumerate(self.pieces):
            at = 0
            for c in reversed(piece):
                step = states.get((at, c))
                if step is None:
                    step = states[at, c] = len(ends)
                    ends.append(-1)
                at = step
            ends[at] = code
        self.ends = np.array(ends, np.int32)
        self.tree = _Table(max(4, (4 * len(ends)).bit_length()))
        for (at, c), step in states.items():
            self.tree.put(at << 21 | ord(c), step)
        self.pairs = _Table(21)

    def piece(self, code: int) -> str:
        return self.pieces[code] if code < len(self.pieces) else chr(code - len(self.pieces))

    def fit(self, before: np.ndarray, after: np.ndarray) -> np.ndarray:
        """Whether merging gives two neighbouring pieces again."""
        keys = before.astype(np.int64) << 21 | after
        out = self.pairs.get(keys)
        unknown = np.unique(keys[out < 0])
        if len(unknown):
            if self.pairs.n + len(unknown) > 1 << 20:
                self.pairs.clear()
                unknown = np.unique(keys)
            for key in unknown.tolist():
                a, b = self.piece(key >> 21), self.piece(key & (1 << 21) - 1)
                self.pairs.put(key, int(self.codec.fits(a, b)))
            out = self.pairs.get(keys)
        return out == 1

    def ids(self, words: list[str]) -> list[bytes]:
        """The packed ids of each word."""
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        order = np.argsort(lengths, kind="stable")
        rising = lengths[order]
        out: list[bytes] = [b""] * len(words)
        at = 0
        while at < len(words):
            longest = 2 * int(rising[at]) + 8
            stop = max(at + 1, min(int(np.searchsorted(rising, longest, "right")), at + self.CELLS // longest))
            part = order[at:stop].tolist()
            some = [words[k] for k in part]
            found = self.forward(some, rising[at:stop]) if len(some) >= self.FEWEST else [self.codec._packed(self.codec._ids(self.codec.stream(w))) for w in some]
            for k, ids in zip(part, found):
                out[k] = ids
            at = stop
        return out

    def forward(self, words: list[str], lengths: np.ndarray) -> list[bytes]:
        """``ids`` for words in the order of their lengths."""
        most, longest, n_pieces = int(lengths[-1]), self.codec.longest, len(self.pieces)
        chars = np.full((len(words), most), (1 << 21) - 1, np.int64)
        chars[np.arange(most) < lengths[:, None]] = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
        shape = (len(words), most + 1)
        last, back, root, final = np.zeros(shape, np.int32), np.zeros(shape, np.int32), np.zeros(shape, np.int32), np.zeros(shape, bool)
        done = np.zeros(len(words), np.int64)
        for i in range(1, most + 1):
            first = int(np.searchsorted(lengths, i))
            here = np.arange(first, len(words))
            code, size = n_pieces + chars[first:, i - 1], np.ones(len(here), np.int64)
            live, state = here, np.zeros(len(here), np.int64)
            for n in range(1, min(i, longest) + 1):
                state = self.tree.get(state << 21 | chars[live, i - n]).astype(np.int64)
                there = state >= 0
                live, state = live[there], state[there]
                if not len(live):
                    break
                piece = self.ends[state]
                whole = piece >= 0
                lane, piece = live[whole], piece[whole]
                if 1 < n < i and len(lane):
                    good = self.fit(last[lane, i - n], piece)
                    lane, piece = lane[good], piece[good]
                code[lane - first], size[lane - first] = piece, n
            before = i - size
            last[first:, i], back[first:, i] = code, before
            root[first:, i] = np.where(before == done[first:], i, root[here, before])
            self.commit(here[done[first:] < i - longest + 1], i, back, root, final, done)
        lane, at = np.arange(len(words)), lengths.copy()
        while len(lane):
            final[lane, at] = True
            at = back[lane, at]
            left = at > done[lane]
            lane, at = lane[left], at[left]
        rows, places = np.nonzero(final)
        codes = last[rows, places]
        ends = np.cumsum(np.bincount(rows, minlength=len(words)))
        packed = self.vocabulary[np.minimum(codes, n_pieces)].astype("<i4").tobytes()
        out = [packed[4 * a : 4 * b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist())]
        for k in np.unique(rows[codes >= n_pieces]).tolist():
            pieces = map(self.piece, codes[ends[k - 1] if k else 0 : ends[k]].tolist())
            out[k] = self.codec._packed(self.codec._ids(pieces))
        return out

    def commit(self, lane: np.ndarray, i: int, back: np.ndarray, root: np.ndarray, final: np.ndarray, done: np.ndarray) -> None:
        """Where the paths of all positions of the window before i first go through one boundary,
        that boundary is final; so on until they differ. ``root`` is that first boundary."""
        start = i - self.codec.longest + 1
        while len(lane):
            roots = root[lane, start : i + 1]
            same = (roots == roots[:, :1]).all(1)
            lane, meet = lane[same], roots[same, 0]
            if not len(lane):
                return
            final[lane, meet] = True
            done[lane] = meet
            for p in range(int(meet.min()) + 1, i + 1):
                before = back[lane, p]
                root[lane, p] = np.where(before == meet, p, root[lane, before])
            lane = lane[meet < start]


class _Pairs(dict):
    """Whether merging gives two neighbouring pieces again; a full table is emptied."""

    def __init__(self, codec: Codec, most: int):
        super().__init__()
        self.codec, self.most = codec, most

    def __missing__(self, pair: tuple[str, str]) -> bool:
        if len(self) >= self.most:
            self.clear()
        self[pair] = found = self.codec.fits(*pair)
        return found


@lru_cache(2)
def codec(model: str | bytes) -> Codec:
    return Codec(model)


remembered.append((lambda: codec.cache_info().currsize > 0, codec.cache_clear))


def shipped(spark: SparkSession, model: str) -> Broadcast:
    """The bytes of a model file that only the driver has to have."""
    return spark.sparkContext.broadcast(Path(model).read_bytes())


def _encode(model: Broadcast):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(model.value)
        for batch in small_batches(batches, "text", 4 << 20):
            texts = batch.column("text").to_pylist()
            parts = c.encode_batch([text or "" for text in texts])
            offsets = [0, *np.cumsum([len(x) for x in parts]).tolist()]
            same = [None if text is None else c.decode(ids.tolist()) == text for text, ids in zip(texts, parts)]
            values = pa.array(np.concatenate(parts).astype(np.int32))
            nulls = pa.array([x is None for x in same] + [False], pa.bool_())
            at = pa.array(offsets, pa.int32(), mask=np.array(nulls))
            lists = pa.ListArray.from_arrays(at, values)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), lists, pa.array(same, pa.bool_())], ["doc_id", "ids", "round_trip"])

    return run


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str = MODEL) -> DataFrame:
    """A row for every row of ``docs``: doc_id, ids, n_ids and round_trip (decoding the ids gives
    the text again). One pass, no shuffle.

    A null text has null ids, an empty one the empty list. Characters that the model lacks become
    their bytes where it has these, else one unknown id for a run of them, and round_trip is then
    false. Repeated rows all come back; an empty table gives an empty result; other columns are
    not looked at and don't come back."""
    bound_batches(docs)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    out = rows.mapInArrow(_encode(shipped(docs.sparkSession, model)), "doc_id long, ids array<int>, round_trip boolean")
    return out.select("doc_id", "ids", F.when(F.col("ids").isNotNull(), F.size("ids")).alias("n_ids"), "round_trip")


def decode(rows: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", model: str = MODEL) -> DataFrame:
    """doc_id and text for every row of ``rows``; null ids give a null text, the empty list ''.
    Bytes that aren't UTF-8 become U+FFFD. An id outside the model, or a null in a list, is an
    error. Repeated rows all come back; an empty table gives an empty result; other columns are not
    looked at and don't come back."""
    model_bytes = shipped(rows.sparkSession, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(model_bytes.value)
        for batch in batches:
            texts = [None if ids is None else c.decode(ids) for ids in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    return rows.select(F.col(id_col).cast("long").alias("doc_id"), F.col(ids_col).alias("ids")).mapInArrow(run, "doc_id long, text string")
