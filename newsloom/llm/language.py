"""Language identification by a convolutional network over bytes.

A text is cut into windows of ``WINDOW`` bytes; each byte has a learnt vector, filters of several
widths run over the window, the maximum of each filter over the window is kept (max pooling) and a
softmax over these gives the languages. A document's languages are the mean over all its windows.

The network is trained here, in numpy, on a bounded sample of labelled rows (``TRAIN_DOCS``).
Applied, the filters are tables over pairs of bytes: a filter's value at a place is a sum of
look-ups, for all windows of a batch at once.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, small_batches

WINDOW, WIDTHS, FILTERS, DIM = 256, (2, 3, 4), 16, 8
TRAIN_DOCS, STEPS, EPOCHS, RATE, BATCH, SEED = 4000, 2200, 12, 4e-3, 64, 7


def windows_of(data: bytes, window: int = WINDOW) -> np.ndarray:
    """All windows of a text, one after the other; the last one ends where the text ends, and a
    text shorter than a window is filled up with zero bytes."""
    x = np.frombuffer(data, np.uint8)
    if len(x) <= window:
        return np.pad(x, (0, window - len(x)))[None] if len(x) else np.empty((0, window), np.uint8)
    full = len(x) // window
    out = x[: full * window].reshape(full, window)
    return out if full * window == len(x) else np.vstack([out, x[-window:]])


@dataclass
class Network:
    languages: list[str]
    vectors: np.ndarray  # (256, DIM)
    filters: list[np.ndarray]  # (width, DIM, FILTERS) each
    bias: np.ndarray  # (len(WIDTHS) * FILTERS)
    out: np.ndarray  # (len(WIDTHS) * FILTERS, languages)
    out_bias: np.ndarray

    def tables(self) -> list[list[tuple[int, np.ndarray]]]:
        """For each width, (offset, table over the pair of bytes there) that add up to its filters."""
        found = []
        for f in self.filters:
            single = [(self.vectors @ w).astype(np.float32) for w in f]
            parts = []
            for k in range(0, len(single), 2):
                second = single[k + 1][None] if k + 1 < len(single) else np.zeros((1, 256, FILTERS), np.float32)
                parts.append((k, np.ascontiguousarray((single[k][:, None] + second).reshape(65536, FILTERS))))
            found.append(parts)
        return found

    def pooled(self, windows: np.ndarray, tables) -> np.ndarray:
        pairs = np.zeros(windows.shape, np.int32)
        pairs[:, :-1] = windows[:, :-1].astype(np.int32) * 256 + windows[:, 1:]
        pairs[:, -1] = windows[:, -1].astype(np.int32) * 256
        n = windows.shape[1]
        got = []
        for width, parts in zip(WIDTHS, tables):
            places = n - width + 1
            total = None
            for offset, table in parts:
                x = table.take(pairs[:, offset : offset + places], axis=0)
                total = x if total is None else np.add(total, x, out=total)
            got.append(total.max(1))
        return np.maximum(np.concatenate(got, 1) + self.bias, 0)

    def probabilities(self, windows: np.ndarray, tables) -> np.ndarray:
        return _softmax(self.pooled(windows, tables) @ self.out + self.out_bias)


def _softmax(x: np.ndarray) -> np.ndarray:
    x = np.exp(x - x.max(1, keepdims=True))
    return x / x.sum(1, keepdims=True)


def train(windows: np.ndarray, labels: np.ndarray, languages: list[str]) -> Network:
    """Adam on the cross-entropy, each language drawn equally often, ``EPOCHS`` times the windows or
    ``STEPS`` batches; the same rows give the same network."""
    rng = np.random.RandomState(SEED)
    k, hidden = len(languages), len(WIDTHS) * FILTERS
    weights = [rng.randn(256, DIM) * 0.5, *(rng.randn(w, DIM, FILTERS) / np.sqrt(w * DIM) for w in WIDTHS), np.zeros(hidden), rng.randn(hidden, k) / np.sqrt(hidden), np.zeros(k)]
    weights = [w.astype(np.float32) for w in weights]
    moments = [[np.zeros_like(w), np.zeros_like(w)] for w in weights]
    by = [np.flatnonzero(labels == c) for c in range(k)]
    per = max(1, BATCH // k)
    step = 0
    for _ in range(min(STEPS, EPOCHS * max(1, len(windows) // BATCH))):
        pick = np.concatenate([rng.choice(b, per) for b in by if len(b)])
        x, y = windows[pick], labels[pick]
        vectors, filters, (bias, out, out_bias) = weights[0], weights[1:-3], weights[-3:]
        v = vectors[x]
        views, argmax, pooled = [], [], []
        for width, f in zip(WIDTHS, filters):
            places = x.shape[1] - width + 1
            view = np.concatenate([v[:, o : o + places] for o in range(width)], 2)
            act = view @ f.reshape(-1, FILTERS)
            best = act.argmax(1)
            views.append(view)
            argmax.append(best)
            pooled.append(np.take_along_axis(act, best[:, None], 1)[:, 0])
        h = np.concatenate(pooled, 1) + bias
        r = np.maximum(h, 0)
        d = _softmax(r @ out + out_bias)
        d[np.arange(len(y)), y] -= 1
        d /= len(y)
        grads = [np.zeros_like(vectors)]
        dh = (d @ out.T) * (h > 0)
        for number, (width, f) in enumerate(zip(WIDTHS, filters)):
            g = dh[:, number * FILTERS : (number + 1) * FILTERS]
            at = np.take_along_axis(views[number], argmax[number][:, :, None], 1)  # (batch, filters, width * DIM)
            grads.append(np.einsum("bf,bfd->df", g, at).reshape(f.shape))
            back = np.einsum("bf,wdf->bfwd", g, f)
            places = argmax[number][:, :, None] + np.arange(width)
            seen = x[np.arange(len(x))[:, None, None], places]
            np.add.at(grads[0], seen.ravel(), back.reshape(-1, DIM))
        grads += [dh.sum(0), r.T @ d, d.sum(0)]
        step += 1
        for w, g, m in zip(weights, grads, moments):
            m[0] += 0.1 * (g - m[0])
            m[1] += 0.001 * (g * g - m[1])
            w -= RATE * (m[0] / (1 - 0.9**step)) / (np.sqrt(m[1] / (1 - 0.999**step)) + 1e-8)
    return Network(languages, weights[0], weights[1:-3], weights[-3], weights[-2], weights[-1])


def sample(docs: DataFrame, text_col: str, label_col: str, most: int = TRAIN_DOCS) -> list[tuple[str, bytes]]:
    """About ``most`` labelled texts, whole and as many of each language as there are, up to its
    share; chosen by a hash of their content: two scans, no sort."""
    labelled = docs.filter(F.col(label_col).isNotNull() & (F.length(text_col) > 0)).select(F.col(label_col).cast("string").alias("label"), F.col(text_col).alias("text"))
    counts = {r[0]: r[1] for r in labelled.groupBy("label").count().collect()}  # a number for each language
    if not counts:
        return []
    share, left = {}, most
    for k, (label, n) in enumerate(sorted(counts.items(), key=lambda x: x[1])):  # what small ones leave goes to the others
        share[label] = min(n, left // (len(counts) - k))
        left -= share[label]
    chance = F.create_map(*[F.lit(x) for label, n in share.items() for x in (label, min(1 << 40, (1 << 40) * max(1, n) // counts[label]))])
    rows = labelled.filter(F.pmod(F.xxhash64("text", "label"), F.lit(1 << 40)) < F.element_at(chance, F.col("label"))).collect()
    return sorted((a, b.encode("utf-8", "replace")) for a, b in rows)


def fit(rows: list[tuple[str, bytes]]) -> Network | None:
    languages = sorted({a for a, _ in rows})
    if not languages:
        return None
    parts = [windows_of(b) for _, b in rows]
    labels = np.repeat([languages.index(a) for a, _ in rows], [len(w) for w in parts])
    return train(np.concatenate(parts), labels, languages)


def _apply(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = shared.value
        tables = net.tables() if net else None
        for batch in small_batches(batches, "text", 2 << 20):
            found, sure, counts = [], [], []
            parts = [windows_of(t.encode("utf-8", "replace")) if t and net else np.empty((0, WINDOW), np.uint8) for t in batch.column("text").to_pylist()]
            every = np.concatenate(parts)
            p = np.concatenate([net.probabilities(every[at : at + 64], tables) for at in range(0, len(every), 64)]) if len(every) else None
            at = 0
            for part in parts:
                counts.append(len(part))
                if not len(part):
                    found.append(None)
                    sure.append(None)
                    continue
                mean = p[at : at + len(part)].mean(0)
                at += len(part)
                best = int(mean.argmax())
                found.append(net.languages[best])
                sure.append(round(float(mean[best]), 4))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(found, pa.string()), pa.array(sure, pa.float64()), pa.array(counts, pa.int32())], ["doc_id", "language", "confidence", "n_windows"]
            )

    return run


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang", train_docs: int = TRAIN_DOCS) -> DataFrame:
    """A row for every row of ``docs``: doc_id, language, confidence (the mean probability) and
    n_windows. The network is trained on about ``train_docs`` of the rows whose ``label_col`` is
    not null, in equal numbers by language as far as there are, and then applied to all rows.

    Null and empty texts have a null language and no windows, and so has everything where no row
    is labelled. Equal probabilities: the first language in alphabetical order. Repeated rows all
    come back; an empty table gives an empty result; other columns are not looked at."""
    spark = docs.sparkSession
    bound_batches(docs)
    shared = spark.sparkContext.broadcast(fit(sample(docs, text_col, label_col, train_docs)))  # some 10 KB
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(_apply(shared), "doc_id long, language string, confidence double, n_windows int")
