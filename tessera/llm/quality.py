"""Quality classifier: histogram gradient-boosted trees over document statistics.

Statistics of whole texts are computed on Arrow buffers in numpy. Boosting bins each statistic by quantiles (at most
``BINS``), grows trees level by level from gradient histograms and flattens them into arrays (complete binary trees in heap
order); scoring steps through all trees at once by array indexing.

The model is fitted on at most about ``max_rows`` labelled rows, chosen by a hash of the id (a documented bound); statistics
and scores cover every row. Null texts count as empty; null labels are not learned. With no label or a single class, every
score is that class's share (0.5 without any). Rows of an equal id learn from each label row that joins.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tessera.llm.words import SEPARATOR, rolling, slices, small_batches, strings, word_hashes
from tessera.scratch import materialize

BINS = 64
_KIND = np.zeros(256, np.int64)  # 0 other ASCII, 1 upper, 2 lower, 3 digit, 4 punctuation, 5 white space, 6 beyond ASCII
_KIND[65:91], _KIND[97:123], _KIND[48:58], _KIND[128:] = 1, 2, 3, 6
_KIND[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = 4
_KIND[SEPARATOR] = 5
FEATURES = [
    "log_bytes", "log_words", "word_bytes", "upper", "digit", "punctuation", "newline", "pipe", "beyond_ascii", "odd_symbols",
    "distinct_words", "top_word", "adjacent_repeats", "distinct_triples", "distinct_lines", "sentence_ends", "word_spread", "words_per_line",
]


def _count(flags: np.ndarray, off: np.ndarray) -> np.ndarray:
    total = np.concatenate(([0], np.cumsum(flags)))
    return (total[off[1:]] - total[off[:-1]]).astype(np.float64)


def statistics(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row of ``FEATURES`` for each text."""
    off = offsets - offsets[0]
    raw = data[offsets[0] : offsets[-1]]
    n = np.maximum(np.diff(off), 1).astype(np.float64)
    kind = _KIND[raw]
    words, first = word_hashes(data, offsets)
    triples = rolling(words, 3)
    n_words = np.diff(first).astype(np.float64)
    w = np.maximum(n_words, 1)
    lines = _count(raw == 10, off) + 1
    share = [_count(kind == k, off) / n for k in (1, 3, 4)]
    plain = np.isin(raw, np.frombuffer(b".,;:!?'\"()-", np.uint8))
    distinct, top, repeats, triple, line, spread = (np.zeros(len(n)) for _ in range(6))
    text = raw.tobytes()
    for i, (a, b) in enumerate(zip(first[:-1].tolist(), first[1:].tolist(), strict=True)):
        if b == a:
            continue
        _, times = np.unique(words[a:b], return_counts=True)
        distinct[i], top[i] = len(times) / (b - a), times.max() / (b - a)
        repeats[i] = np.count_nonzero(words[a + 1 : b] == words[a : b - 1]) / (b - a)
        p = times / (b - a)
        spread[i] = -(p * np.log(p)).sum() / np.log(max(2, b - a))
        triple[i] = len(np.unique(triples[a : b - 2])) / (b - a - 2) if b - a > 2 else 1
        rows = text[off[i] : off[i + 1]].split(b"\n")
        line[i] = len(set(rows)) / len(rows)
    columns = [
        np.log1p(n), np.log1p(n_words), _count(kind != 5, off) / w, *share, lines / n, _count(raw == 124, off) / w, _count(kind == 6, off) / n,
        _count((kind == 4) & ~plain, off) / n, distinct, top, repeats, triple, line, _count(np.isin(raw, [33, 46, 63]), off) / w, spread, w / lines,
    ]
    return np.stack(columns, 1)


@dataclass
class Trees:
    """Complete binary trees in heap order: inner nodes (tree, 2**depth - 1), leaves (tree, 2**depth)."""

    base: float
    feature: np.ndarray
    threshold: np.ndarray
    leaf: np.ndarray

    def score(self, x: np.ndarray) -> np.ndarray:
        inner = self.feature.shape[1]
        out = np.full(len(x), self.base)
        if len(self.feature):
            trees, rows = np.arange(len(self.feature)), np.arange(len(x))[:, None]
            node = np.zeros((len(x), len(trees)), np.int64)
            while node[0, 0] < inner if len(x) else False:
                right = x[rows, self.feature[trees, node]] > self.threshold[trees, node]
                node = 2 * node + 1 + right
            out += self.leaf[trees, node - inner].sum(1)
        return 1 / (1 + np.exp(-out))


def boost(x: np.ndarray, y: np.ndarray, rounds: int = 80, depth: int = 4, rate: float = 0.15, penalty: float = 1.0) -> Trees:
    """Fit on rows ``x`` with labels 0/1."""
    inner, features = 2**depth - 1, x.shape[1] if x.ndim == 2 else 0
    mean = y.mean() if len(y) else 0.5
    base = float(np.log((mean + 1e-6) / (1 - mean + 1e-6)))
    empty = Trees(base, np.zeros((0, inner), np.int64), np.zeros((0, inner)), np.zeros((0, inner + 1)))
    if not len(y) or mean in (0, 1):
        return empty
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) for f in range(features)]
    binned = np.stack([np.searchsorted(e, x[:, f], "left") for f, e in enumerate(edges)], 1)
    slot = binned + np.arange(features) * BINS
    total = np.full(len(y), base)
    out = ([], [], [])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-total))
        g, h = y - p, p * (1 - p)
        feature, cut = np.zeros(inner, np.int64), np.full(inner, BINS)
        node = np.zeros(len(y), np.int64)
        for level in range(depth):
            first, width = 2**level - 1, 2**level
            at = ((node - first)[:, None] * features * BINS + slot).ravel()
            shape = (width, features, BINS)
            hist_g = np.bincount(at, np.repeat(g, features), width * features * BINS).reshape(shape)
            hist_h = np.bincount(at, np.repeat(h, features), width * features * BINS).reshape(shape)
            gl, hl = hist_g.cumsum(2), hist_h.cumsum(2)
            gt, ht = gl[:, :, -1:], hl[:, :, -1:]
            gain = gl**2 / (hl + penalty) + (gt - gl) ** 2 / (ht - hl + penalty) - gt**2 / (ht + penalty)
            gain[(hl < 1e-3) | (ht - hl < 1e-3)] = 0
            best = gain.reshape(width, -1).argmax(1)
            good = gain.reshape(width, -1)[np.arange(width), best] > 1e-9
            feature[first : first + width] = np.where(good, best // BINS, 0)
            cut[first : first + width] = np.where(good, best % BINS, BINS)
            node = 2 * node + 1 + (binned[np.arange(len(y)), feature[node]] > cut[node])
        leaf = node - inner
        value = rate * np.bincount(leaf, g, inner + 1) / (np.bincount(leaf, h, inner + 1) + penalty)
        total += value[leaf]
        out[0].append(feature)
        out[1].append([edges[f][c] if c < len(edges[f]) else np.inf for f, c in zip(feature.tolist(), cut.tolist(), strict=True)])
        out[2].append(value)
    return Trees(base, *(np.array(a) for a in out))


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = strings(batch.column("text"))
        for a, b in slices(offsets):
            x = statistics(data, offsets[a : b + 1])
            flat = pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32)), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, b - a), flat], ["doc_id", "x"])


def measure(docs: DataFrame) -> DataFrame:
    """(doc_id, x): statistics of every text, in the order of ``FEATURES``."""
    return small_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")).mapInArrow(_measure, "doc_id long, x array<double>")


def fit(measured: DataFrame, labels: DataFrame, label: str = "quality", max_rows: int = 20_000) -> Trees:
    """Trees for P(label = 1) from (doc_id, x) and (doc_id, ``label``)."""
    known = labels.select("doc_id", F.col(label).cast("int").alias("y")).where("y is not null")
    share = min(1.0, max_rows / max(1, known.count()))
    drawn = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int(share * (1 << 30)))
    rows = measured.join(drawn, "doc_id").orderBy("doc_id", "y").select("x", "y").collect()  # about max_rows at most
    x = np.array([r.x for r in rows]).reshape(len(rows), len(FEATURES))
    return boost(x, np.array([r.y for r in rows], np.float64))


def score(measured: DataFrame, trees: Trees) -> DataFrame:
    """(doc_id, score, predicted) for every measured row."""
    shared = measured.sparkSession.sparkContext.broadcast(trees)

    def run(batches):
        for batch in batches:
            x = batch.column("x").flatten().to_numpy().reshape(batch.num_rows, -1)
            parts = [shared.value.score(x[a : a + 4096]) for a in range(0, len(x), 4096)]
            s = np.concatenate(parts) if parts else np.empty(0)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(s), pa.array((s >= 0.5).astype(np.int32))], ["doc_id", "score", "predicted"])

    return measured.mapInArrow(run, "doc_id long, score double, predicted int")


def classify(docs: DataFrame, labels: DataFrame, label: str = "quality") -> DataFrame:
    """(doc_id, score, predicted) for every row of ``docs``, learnt from ``labels`` (doc_id, ``label``)."""
    measured = materialize(measure(docs), "statistics")
    return score(measured, fit(measured, labels, label))
