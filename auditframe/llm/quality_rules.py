"""Quality rules: calibrated logistic regression on hashed word and character n-grams.

Features are mean frequencies of hashed byte 4-grams (case kept) and of hashed
word uni- and bigrams (lower-cased; a word that repeats the one before is one more
feature).  A logistic regression is fitted on labelled rows, Platt scaling on a
part of them that the fit hasn't seen makes its margin a probability, and fixed
thresholds sort documents into tiers.  Weights are fixed-point integers, so a
score doesn't depend on how rows are batched.

Defined results: null, empty and wordless texts shorter than four bytes have no
features and get the model's prior; a null text isn't kept.  With no usable label
every document gets one half and is kept.  Repeated rows get equal scores.  The fit
uses at most ``TRAIN_BOUND`` labelled documents and ``labelled.TRAIN_BYTES`` of their
texts; scoring covers whole texts.  ``doc_id`` may be of any type.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import BLOCK, as_table, mix64, segment_sum, utf8, words
from .labelled import sample_labelled

TRAIN_BOUND, ROUNDS, KEEP_AT, HIGH_AT = 2000, 60, 0.5, 0.9
BITS = 16
SIZE = 1 << BITS
_ONE = 1 << 16  # fixed-point unit of a weight
_SCALE = 100.0
_REPEAT = 7  # the feature of a repeated word


class Model(NamedTuple):
    chars: np.ndarray  # int64, SIZE
    words: np.ndarray
    bias: float
    slope: float
    shift: float


def char_grams(piece: np.ndarray) -> np.ndarray:
    """Feature of the 4-gram that begins at each byte but the last three."""
    b = piece.astype(np.uint32)
    v = b[:-3] | (b[1:-2] << np.uint32(8)) | (b[2:-1] << np.uint32(16)) | (b[3:] << np.uint32(24))
    return (v * np.uint32(2654435761)) >> np.uint32(32 - BITS)


def word_grams(h: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(feature, document) of the words and of the pairs of adjacent words."""
    one = (mix64(h + np.uint64(1)) >> np.uint64(64 - BITS)).astype(np.int64)
    same = doc[1:] == doc[:-1]
    pair = mix64(h[:-1] * np.uint64(0xD6E8FEB86659FD93) + h[1:])[same] >> np.uint64(64 - BITS)
    pair = np.where((h[1:] == h[:-1])[same], _REPEAT, pair.astype(np.int64))
    return np.concatenate([one, pair]), np.concatenate([doc, doc[1:][same]])


def _char_parts(off: np.ndarray, n: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Pieces (from, to) of gram positions, the documents they touch and the valid gram range of each within the piece."""
    for a in range(0, n, BLOCK):
        b = min(n, a + BLOCK)
        lo, hi = np.searchsorted(off, a, "right") - 1, np.searchsorted(off, b, "left")
        docs = np.arange(lo, hi)
        yield a, min(n, b + 3), docs, np.stack([np.maximum(off[docs], a), np.minimum(np.maximum(off[docs + 1] - 3, off[docs]), b)], axis=1) - a


def _range_sums(values: np.ndarray, spans: np.ndarray) -> np.ndarray:
    """Integer sums of values[from:to] for each span."""
    total = np.concatenate([[0], np.cumsum(values)])
    good = spans[:, 1] > spans[:, 0]
    return np.where(good, total[np.where(good, spans[:, 1], 0)] - total[np.where(good, spans[:, 0], 0)], 0)


def margins(buf: np.ndarray, off: np.ndarray, model: Model) -> np.ndarray:
    n = len(off) - 1
    sums, lens = np.zeros(n, np.int64), np.maximum(np.diff(off) - 3, 0)
    for a, b, docs, spans in _char_parts(off, len(buf)):
        if b - a > 3:
            sums[docs] += _range_sums(model.chars[char_grams(buf[a:b])], spans)
    h, start = words(buf, off)
    at = np.searchsorted(start, off)
    doc = np.repeat(np.arange(n), np.diff(at))
    f, where = word_grams(h, doc)
    order = np.argsort(where, kind="stable")
    counts = np.bincount(where, minlength=n)
    wsums = segment_sum(model.words[f[order]], np.concatenate([[0], np.cumsum(counts)]))
    return model.bias + _SCALE / _ONE * (sums / np.maximum(lens, 1) + wsums / np.maximum(counts, 1))


def probability(margin: np.ndarray, model: Model) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(model.slope * margin + model.shift, -40, 40)))


def _counts(buf: np.ndarray, off: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each document its features (words after chars) and their scaled frequencies."""
    h, start = words(buf, off)
    at = np.searchsorted(start, off)
    out = []
    for k in range(len(off) - 1):
        text = buf[off[k] : off[k + 1]]
        c = np.bincount(char_grams(text), minlength=SIZE) if len(text) > 3 else np.zeros(SIZE, np.int64)
        own = h[at[k] : at[k + 1]]
        f, _ = word_grams(own, np.zeros(len(own), np.int64))
        w = np.bincount(f, minlength=SIZE)
        both = np.concatenate([c / max(c.sum(), 1), w / max(w.sum(), 1)])
        i = np.flatnonzero(both)
        out.append((i.astype(np.int32), (_SCALE * both[i]).astype(np.float32)))
    return out


def _descend(idx: np.ndarray, val: np.ndarray, at: np.ndarray, y: np.ndarray, rounds: int) -> tuple[np.ndarray, float]:
    w, b = np.zeros(2 * SIZE), 0.0
    m1, m2 = np.zeros(2 * SIZE + 1), np.zeros(2 * SIZE + 1)
    row = np.repeat(np.arange(len(y)), np.diff(at))
    for k in range(1, rounds + 1):
        margin = segment_sum(w[idx] * val, at) + b
        d = y - 1 / (1 + np.exp(-np.clip(margin, -40, 40)))
        g = np.concatenate([np.bincount(idx, weights=val * d[row], minlength=2 * SIZE), [d.sum()]]) / len(y)
        g[:-1] -= 1e-5 * w
        m1, m2 = 0.9 * m1 + 0.1 * g, 0.99 * m2 + 0.01 * g**2
        step = 0.05 * (m1 / (1 - 0.9**k)) / (np.sqrt(m2 / (1 - 0.99**k)) + 1e-6)
        w, b = w + step[:-1], b + float(step[-1])
    return w, b


def platt(margin: np.ndarray, y: np.ndarray, rounds: int = 50) -> tuple[float, float]:
    """Slope and shift of greatest likelihood with Platt's smoothed targets, by damped Newton steps."""
    pos, neg = (y == 1).sum(), (y == 0).sum()
    target = np.where(y == 1, (pos + 1) / (pos + 2), 1 / (neg + 2))
    a, c = 1.0, 0.0
    x = np.stack([margin, np.ones_like(margin)], axis=1)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ np.array([a, c]), -40, 40)))
        hess = (x * (p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2)
        da, dc = np.linalg.solve(hess, x.T @ (target - p) - 1e-3 * np.array([a - 1, c]))
        a, c = a + float(np.clip(da, -1, 1)), c + float(np.clip(dc, -1, 1))
    return max(a, 1e-3), c


def fit(idx: np.ndarray, val: np.ndarray, at: np.ndarray, y: np.ndarray, rounds: int = ROUNDS) -> Model:
    zero = np.zeros(SIZE, np.int64)
    if not len(y):
        return Model(zero, zero, 0.0, 1.0, 0.0)
    held = np.arange(len(y)) % 5 == 4 if len(y) >= 10 else np.zeros(len(y), bool)
    row = np.repeat(~held, np.diff(at))
    lens = np.diff(at)[~held]
    w, b = _descend(idx[row], val[row], np.concatenate([[0], np.cumsum(lens)]), y[~held].astype(float), rounds)
    w = np.round(w * _ONE).astype(np.int64)
    margin = segment_sum(w[idx] * val.astype(float), at) / _ONE + b
    a, c = platt(margin[held], y[held]) if held.any() else (1.0, 0.0)
    return Model(w[:SIZE], w[SIZE:], b, a, c)


def train(docs: DataFrame, labels: DataFrame, bound: int = TRAIN_BOUND) -> Model:
    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in as_table(batches, rows=64):
            buf, off, _ = utf8(batch.column(1))
            got = _counts(buf, off)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array([i for i, _ in got], pa.list_(pa.int32())), pa.array([v for _, v in got], pa.list_(pa.float32()))], ["doc_id", "y", "i", "v"])

    sample = sample_labelled(docs, labels, "quality", bound).select("doc_id", "text", "y")
    got = sample.mapInArrow(features, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, y int, i array<int>, v array<float>").toArrow().sort_by([("doc_id", "ascending")]).combine_chunks()
    if not got.num_rows:
        return fit(np.zeros(0, np.int32), np.zeros(0, np.float32), np.zeros(1, np.int64), np.zeros(0, np.int64))
    i, v = got.column("i").combine_chunks(), got.column("v").combine_chunks()
    return fit(i.flatten().to_numpy(), v.flatten().to_numpy(), i.offsets.to_numpy().astype(np.int64), got.column("y").to_numpy())


def score(docs: DataFrame, model: Model, keep_at: float = KEEP_AT, high_at: float = HIGH_AT) -> DataFrame:
    """(doc_id, p_good, tier, keep) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in as_table(batches):
            buf, off, valid = utf8(batch.column(1))
            p = np.round(probability(margins(buf, off, model), model), 6)
            tier = np.where(p >= high_at, "high", np.where(p >= keep_at, "medium", "low"))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(p), pa.array(tier.tolist(), pa.string()), pa.array((p >= keep_at) & valid)], ["doc_id", "p_good", "tier", "keep"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, p_good double, tier string, keep boolean")
