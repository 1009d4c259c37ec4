"""Document quality from a linear-chain conditional random field over lines.

Every line is described by binned measures (shares of capitals, digits, symbols,
repeated words ...) of itself and of its two neighbours.  A two-state chain with
learnt transitions is fitted by gradient ascent on the exact log-likelihood
(forward-backward); a labelled document's lines all carry its label.  A line is
good if its marginal is at least one half, and a document's quality is the mean
marginal of its lines weighted by their length in bytes.

Defined results: a null text has no lines and quality 0; an empty text, or one of
line breaks only, has quality 0; neither is kept.  With no usable label the model
is neutral (quality one half, kept).  Repeated rows get equal scores.  The fit
uses at most ``TRAIN_BOUND`` labelled documents and ``labelled.TRAIN_BYTES`` of their
texts; scoring covers every line.  ``doc_id`` may be of any type.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import BLOCK, as_table, map_rows, segment_sum, utf8, words
from .labelled import sample_labelled

TRAIN_BOUND, ROUNDS, KEEP_AT = 3000, 250, 0.5

_CLASS = np.zeros(256, np.int64)
for _b in range(128):
    _c = chr(_b)
    _CLASS[_b] = 0 if _c.islower() else 1 if _c.isupper() else 2 if _c.isdigit() else 8 if _c == "\n" else 3 if _c.isspace() else 4 if _c in ".,;:'\"?()-" else 5 if _c == "!" else 6 if _c == "|" else 7
_K = 9
_CUTS = [
    [0.02, 0.1, 0.3, 0.6],  # capitals
    [0.005, 0.05, 0.2],  # digits
    [0.05, 0.12, 0.2, 0.3],  # blanks
    [0.01, 0.03, 0.06, 0.12],  # sentence punctuation
    [0.001, 0.01, 0.05],  # exclamation marks
    [0.001, 0.02, 0.05],  # bars
    [0.001, 0.01, 0.05, 0.1, 0.2],  # other symbols
    [1, 3, 8, 20, 60],  # words
    [2.5, 4, 5.5, 7, 10],  # bytes a word
    [0.05, 0.15, 0.3, 0.5, 0.8],  # words seen before in the line
    [0.01, 0.1, 0.5],  # words equal to the one before
    [0.5],  # the line occurs again in the document
]
_CUTS = [np.array(c) for c in _CUTS]
_WORDS, _SEEN = 7, 9
_SIZES = [len(c) + 1 for c in _CUTS] + [(len(_CUTS[_WORDS]) + 1) * (len(_CUTS[_SEEN]) + 1)]
_STARTS = np.concatenate([[0], np.cumsum(_SIZES)])
N_CUR = int(_STARTS[-1])  # indicators of one line; then the line before and the line after, each with one for "none"
N_ALL = 3 * N_CUR + 2
Model = tuple[np.ndarray, float, np.ndarray]


def _distinct(line: np.ndarray, h: np.ndarray, n: int) -> np.ndarray:
    """The number of different hashes in each of n lines."""
    if n < 1 << 24:
        tag = (line.astype(np.uint64) << np.uint64(40)) | (h >> np.uint64(24))
        tag.sort()
        fresh = np.ones(len(tag), bool)
        fresh[1:] = tag[1:] != tag[:-1]
        return np.bincount((tag[fresh] >> np.uint64(40)).astype(np.int64), minlength=n)
    order = np.lexsort((h, line))  # the line's number doesn't fit beside the hash
    a, b = line[order], h[order] >> np.uint64(24)
    fresh = np.ones(len(a), bool)
    fresh[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    return np.bincount(a[fresh], minlength=n)


def line_features(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(indicator numbers per line, bytes per line, line offsets of the documents)."""
    nl = np.flatnonzero(buf == 10)
    nl_doc = np.searchsorted(off, nl, "right") - 1
    per_doc = 1 + np.bincount(nl_doc, minlength=len(off) - 1)
    at = np.concatenate([[0], np.cumsum(per_doc)])
    n = int(at[-1])
    line_of = lambda pos: np.searchsorted(nl, pos) + np.searchsorted(off, pos, "right") - 1
    counts = np.zeros(n * _K, np.int64)
    for a in range(0, len(buf), BLOCK):
        b = min(len(buf), a + BLOCK)
        marks = np.zeros(b - a, np.int64)  # steps of the line number
        inside = nl[(nl >= a) & (nl < b - 1)] + 1 - a
        np.add.at(marks, inside, 1)
        np.add.at(marks, off[(off > a) & (off < b)] - a, 1)
        first = int(line_of(np.array([a]))[0])
        ids = np.cumsum(marks)
        got = np.bincount(ids * _K + _CLASS[buf[a:b]])
        counts[first * _K : first * _K + len(got)] += got
    counts = counts.reshape(n, _K)
    length = counts[:, :8].sum(axis=1)
    safe = np.maximum(length, 1)
    h, start = words(buf, off)
    line = line_of(start)
    n_words = np.bincount(line, minlength=n)
    distinct = _distinct(line, h, n)
    same = np.zeros(len(h), bool)
    same[1:] = (h[1:] == h[:-1]) & (line[1:] == line[:-1])
    again = np.bincount(line[same], minlength=n)
    sums = segment_sum(h, np.concatenate([[0], np.cumsum(n_words)]))
    doc = np.repeat(np.arange(len(per_doc)), per_doc)
    _, where, times = np.unique((doc.astype(np.uint64) << np.uint64(40)) | (sums >> np.uint64(24)), return_inverse=True, return_counts=True)
    repeats = (times[where] > 1) & (n_words > 0)
    letters = np.maximum(counts[:, 0] + counts[:, 1], 1)
    nw = np.maximum(n_words, 1)
    values = [counts[:, 1] / letters, counts[:, 2] / safe, counts[:, 3] / safe, counts[:, 4] / safe, counts[:, 5] / safe, counts[:, 6] / safe, counts[:, 7] / safe, n_words, length / nw, 1 - distinct / nw * (n_words > 0), again / nw, repeats]
    values[_SEEN] = np.where(n_words > 0, 1 - distinct / nw, 0)
    bins = [np.searchsorted(c, v, "right") for c, v in zip(_CUTS, values)]
    bins.append(bins[_WORDS] * (len(_CUTS[_SEEN]) + 1) + bins[_SEEN])
    return np.stack(bins, axis=1).astype(np.int16) + _STARTS[:-1].astype(np.int16), length, at


def emissions(x: np.ndarray, at: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Log-odds that each line is good, from itself and its neighbours."""
    own, before, after = w[:N_CUR][x].sum(axis=1), w[N_CUR : 2 * N_CUR][x].sum(axis=1), w[2 * N_CUR : 3 * N_CUR][x].sum(axis=1)
    e = own.copy()
    e[1:] += before[:-1]
    e[:-1] += after[1:]
    first, last = at[:-1], at[1:] - 1
    inner = first[1:]
    e[inner] -= before[inner - 1]
    e[inner - 1] -= after[inner]
    e[first] += w[3 * N_CUR]
    e[last] += w[3 * N_CUR + 1]
    return e


def forward_backward(e: np.ndarray, at: np.ndarray, t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(marginal of good per line, expected pair counts [from, to]); all documents step by step together."""
    n = np.diff(at)
    order = np.argsort(-n, kind="stable")
    first, size = at[:-1][order], n[order]
    good = 1 / (1 + np.exp(-np.clip(e, -30, 30)))
    emit = np.stack([1 - good, good], axis=1)
    step = np.exp(t)
    alpha = np.empty((len(e), 2))
    live = np.searchsorted(-size, -np.arange(int(size[0]) if len(size) else 0), "left")  # documents with more than k lines
    for k, m in enumerate(live):
        i = first[:m] + k
        a = emit[i] if k == 0 else (alpha[i - 1] @ step) * emit[i]
        alpha[i] = a / a.sum(axis=1, keepdims=True)
    beta = np.ones((len(e), 2))
    pairs = np.zeros((2, 2))
    for k in range(len(live) - 2, -1, -1):
        i = first[: live[k + 1]] + k
        nxt = emit[i + 1] * beta[i + 1]
        b = nxt @ step.T
        both = alpha[i][:, :, None] * step[None] * nxt[:, None, :]
        pairs += (both / both.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
        beta[i] = b / b.sum(axis=1, keepdims=True)
    p = alpha * beta
    return p[:, 1] / p.sum(axis=1), pairs


def fit(x: np.ndarray, at: np.ndarray, y: np.ndarray, rounds: int = ROUNDS) -> Model:
    """Weights, bias and transitions of greatest penalised likelihood; y holds a document's label."""
    w, bias, t = np.zeros(N_ALL), 0.0, np.zeros((2, 2))
    if not len(y):
        return w, bias, t
    n = np.diff(at)
    line_y = np.repeat(y, n).astype(float)
    seen = np.zeros((2, 2))
    for label in (0, 1):
        seen[label, label] = (n[y == label] - 1).sum()
    theta = np.zeros(N_ALL + 5)
    m1, m2 = np.zeros_like(theta), np.zeros_like(theta)
    first, last = at[:-1], at[1:] - 1
    inner = np.ones(len(line_y), bool)
    inner[first] = False
    has_next = np.ones(len(line_y), bool)
    has_next[last] = False
    for k in range(1, rounds + 1):
        w, bias, t = theta[:N_ALL], theta[N_ALL], theta[N_ALL + 1 :].reshape(2, 2)
        p, pairs = forward_backward(emissions(x, at, w) + bias, at, t)
        d = line_y - p
        g = np.zeros(N_ALL)
        spread = lambda idx, val: np.bincount(idx.ravel(), weights=np.repeat(val, idx.shape[1]), minlength=N_CUR)
        g[:N_CUR] = spread(x, d)
        i = np.flatnonzero(inner)
        g[N_CUR : 2 * N_CUR] = spread(x[i - 1], d[i])
        i = np.flatnonzero(has_next)
        g[2 * N_CUR : 3 * N_CUR] = spread(x[i + 1], d[i])
        g[3 * N_CUR], g[3 * N_CUR + 1] = d[first].sum(), d[last].sum()
        grad = np.concatenate([g, [d.sum()], (seen - pairs).ravel()]) / len(line_y) - 1e-4 * theta
        m1, m2 = 0.9 * m1 + 0.1 * grad, 0.99 * m2 + 0.01 * grad**2
        theta = theta + 0.1 * (m1 / (1 - 0.9**k)) / (np.sqrt(m2 / (1 - 0.99**k)) + 1e-8)
    return theta[:N_ALL], float(theta[N_ALL]), theta[N_ALL + 1 :].reshape(2, 2)


def score_texts(buf: np.ndarray, off: np.ndarray, model: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(quality per document, marginals per line, line offsets)."""
    x, length, at = line_features(buf, off)
    p, _ = forward_backward(emissions(x, at, model[0]) + model[1], at, model[2])
    total = segment_sum(length, at)
    return np.where(total > 0, segment_sum(p * length, at) / np.maximum(total, 1), 0.0), p, at


def train(docs: DataFrame, labels: DataFrame, bound: int = TRAIN_BOUND) -> Model:
    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in as_table(batches):
            buf, off, _ = utf8(batch.column(1))
            x, _, at = line_features(buf, off)
            flat = pa.ListArray.from_arrays(pa.array((at * x.shape[1]).astype(np.int32)), pa.array(x.ravel(), pa.int16()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), flat], ["doc_id", "y", "x"])

    sample = sample_labelled(docs, labels, "quality", bound).select("doc_id", "text", "y")
    got = sample.mapInArrow(features, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, y int, x array<short>").toArrow().sort_by([("doc_id", "ascending")]).combine_chunks()
    if not got.num_rows:
        return fit(np.zeros((0, len(_SIZES)), np.int16), np.zeros(1, np.int64), np.zeros(0, np.int64))
    lists = got.column("x").combine_chunks()
    x = lists.flatten().to_numpy().reshape(-1, len(_SIZES))
    lens = np.diff(lists.offsets.to_numpy()) // len(_SIZES)
    return fit(x, np.concatenate([[0], np.cumsum(lens)]).astype(np.int64), got.column("y").to_numpy())


def classify(docs: DataFrame, model: Model, keep_at: float = KEEP_AT) -> DataFrame:
    """(doc_id, quality, keep, line_good) of every row; line_good has one entry for each line."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in as_table(batches):
            buf, off, valid = utf8(batch.column(1))
            quality, p, at = score_texts(buf, off, model)
            quality = np.where(valid, np.round(quality, 6), 0.0)
            lists = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(p >= 0.5))
            none = pa.array([[]] * 1, lists.type)
            if not valid.all():
                lists = pa.concat_arrays([lists, none]).take(pa.array(np.where(valid, np.arange(len(valid)), len(valid))))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(quality), pa.array(quality >= keep_at), lists], ["doc_id", "quality", "keep", "line_good"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, quality double, keep boolean, line_good array<boolean>")


def keep_good(docs: DataFrame, model: Model, keep_at: float = KEEP_AT) -> DataFrame:
    """The rows of docs, with all their columns, whose quality is at least keep_at."""
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in as_table(batches):
            buf, off, valid = utf8(batch.column(at))
            quality = np.round(score_texts(buf, off, model)[0], 6)
            yield batch.filter(pa.array(valid & (quality >= keep_at)))

    return map_rows(docs, run)
