"""Quality by a linear-chain conditional random field over lines.

Every line is described by binned measures of its own and of the lines before and after it. A two-state chain (good or
bad) with weights for these and for transitions is fitted by gradient steps on a bounded sample, in which a line takes
its document's label; forward-backward gives each line's marginal, and the length-weighted mean of the marginals,
calibrated, is the document's quality.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kernels import chunks
from .labelled import SAMPLE_ROWS, fold, labelled_sample
from .toxicity import logistic
from .runtime import tidy

SHARES = np.array([0.0, 0.004, 0.01, 0.02, 0.04, 0.08, 0.15, 0.3, 0.5, 0.8])
LENGTHS = np.array([0, 8, 16, 32, 64, 128, 256, 512, 1024, 4096])
WORD = np.array([1, 2, 3, 4, 5, 6, 8, 10, 14, 20])
BINS = 11
MEASURES = 13
OUTSIDE = BINS - 1
WIDTH = MEASURES * BINS * 3 + 1


@dataclass
class QualityModel:
    weights: np.ndarray
    move: np.ndarray
    slope: float
    offset: float


def byte_classes() -> list[np.ndarray]:
    def of(chars: str) -> np.ndarray:
        t = np.zeros(256, np.uint8)
        t[[ord(c) for c in chars]] = 1
        return t

    high = np.zeros(256, np.uint8)
    high[128:] = 1
    letters = "abcdefghijklmnopqrstuvwxyz"
    return [of(letters), of(letters.upper()), of("0123456789"), of(" \t\r\v\f"), of("#$%&*+=~^@_<>{}[]\\"), of("|"), of("!?"), of(".,;:"), of("\"'()-/"), high]


def line_bounds(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all lines, and each document's first line; a document has a line more than newlines."""
    breaks = np.flatnonzero(data == 10)
    n_breaks = np.searchsorted(breaks, off)
    first = n_breaks + np.arange(len(off))
    starts = np.empty(len(breaks) + len(off) - 1, np.int64)
    ends = np.empty_like(starts)
    starts[first[:-1]] = off[:-1]
    ends[first[1:] - 1] = off[1:]
    inner = breaks_at = np.arange(len(breaks)) + np.searchsorted(off[1:], breaks, side="right")
    ends[breaks_at] = breaks
    starts[inner + 1] = breaks + 1
    return starts, ends, first


def features(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each line, the indexes of its weights (own, before, after); the lines' lengths; each document's first line."""
    starts, ends, first = line_bounds(data, off)
    size = ends - starts
    most = np.maximum(size, 1)
    bins = np.empty((len(size), MEASURES), np.int64)
    space = None
    for k, table in enumerate(byte_classes()):
        mask = table[data]
        total = np.zeros(len(data) + 1, np.int32)
        np.cumsum(mask, out=total[1:])
        bins[:, k] = np.searchsorted(SHARES, (total[ends] - total[starts]) / most, side="left").clip(0, BINS - 2)
        if k == 3:
            space = mask.astype(bool)
    gap = np.ones(len(data) + 1, bool)
    if len(data):
        gap[1:] = space | (data == 10)
        gap[off[:-1]] = True
    word = np.flatnonzero(gap[:-1] & ~gap[1:])
    past = np.append(data, np.uint8(32))[np.minimum(word + 1, len(data))] if len(word) else word
    length = np.diff(np.append(word, len(data)))
    again = np.zeros(len(word) + 1, np.int32)
    if len(word) > 1:  # alike to the word before, as far as length and two letters tell
        same = (length[1:] == length[:-1]) & (data[word[1:]] == data[word[:-1]]) & (past[1:] == past[:-1])
        np.cumsum(same, out=again[2:])
    w0, w1 = np.searchsorted(word, starts), np.searchsorted(word, ends)
    words = np.maximum(w1 - w0, 1)
    bins[:, 12] = np.searchsorted(SHARES, np.maximum(again[w1] - again[np.minimum(w0 + 1, w1)], 0) / words, side="left").clip(0, BINS - 2)
    bins[:, 10] = np.searchsorted(WORD, size / words, side="left").clip(0, BINS - 2)
    bins[:, 11] = np.searchsorted(LENGTHS, size, side="left").clip(0, BINS - 2)
    own = bins + np.arange(MEASURES) * BINS
    edge = np.arange(MEASURES) * BINS + OUTSIDE
    before = np.vstack([edge[None, :], own[:-1]])
    before[first[:-1]] = edge
    after = np.vstack([own[1:], edge[None, :]])
    after[first[1:] - 1] = edge
    block = MEASURES * BINS
    return np.hstack([own, before + block, after + 2 * block]), size, first


def marginals(emit: np.ndarray, move: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """P(good) of every line, expected transitions, and log of the partition function, over all chains at once.

    emit: log-odds of good against bad for each line; move: 2 x 2 log potentials. All chains advance together, longest
    first, so a step works on those that are long enough.
    """
    count = np.diff(first)
    order = np.argsort(-count, kind="stable")
    begin, count = first[:-1][order], count[order]
    n = len(emit)
    a, b = np.zeros((n, 2)), np.zeros((n, 2))
    m = np.exp(move)
    e = np.stack([np.exp(-np.logaddexp(0, emit)), np.exp(-np.logaddexp(0, -emit))], axis=1)  # both scaled alike
    scale = np.zeros(n)
    live = [int(np.searchsorted(-count, -t, side="left")) for t in range(int(count[0]) + 1)] if len(count) else [0]
    at = begin
    for t in range(len(live) - 1):
        k = live[t]
        at = begin[:k] + t
        x = e[at] if t == 0 else (a[at - 1] @ m) * e[at]
        s = x.sum(axis=1)
        a[at], scale[at] = x / s[:, None], s
    for t in range(len(live) - 2, -1, -1):
        k, k1 = live[t], live[t + 1]
        at = begin[:k] + t
        b[at] = 1.0
        if k1:
            nxt = begin[:k1] + t + 1
            x = (b[nxt] * e[nxt] / scale[nxt][:, None]) @ m.T
            b[begin[:k1] + t] = x
    p = a * b
    p /= p.sum(axis=1, keepdims=True)
    linked = np.ones(n, bool)
    linked[begin] = False
    j = np.flatnonzero(linked)
    pair = np.zeros((2, 2))
    if len(j):
        pair = np.einsum("ni,ij,nj->ij", a[j - 1], m, (b[j] * e[j] / scale[j][:, None]))
    log_z = float(np.log(scale).sum() + np.logaddexp(0, emit).sum())
    return p[:, 1], pair, log_z


def document_means(p: np.ndarray, size: np.ndarray, first: np.ndarray) -> np.ndarray:
    w = np.maximum(size, 1).astype(float)
    return np.add.reduceat(p * w, first[:-1]) / np.add.reduceat(w, first[:-1])


def emissions(model: QualityModel, idx: np.ndarray) -> np.ndarray:
    return model.weights[idx].sum(axis=1) + model.weights[-1]


def logit(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-4, 1 - 1e-4)
    return np.log(p / (1 - p))


def fit_quality(sample: DataFrame, steps: int = 80, ridge: float = 3.0) -> QualityModel:
    """Fit on (text, label) rows of a bounded sample; without rows of both labels the model gives the base rate."""

    def describe(source) -> Iterator[pa.RecordBatch]:
        for batch in source:
            label = batch.column(1).to_pylist()
            for lo, hi, data, off in chunks(batch.column(0)):
                idx, size, first = features(data, off)
                blobs = [idx[first[d] : first[d + 1], :MEASURES].astype(np.int16).tobytes() for d in range(hi - lo)]
                sizes = [size[first[d] : first[d + 1]].astype(np.int32).tobytes() for d in range(hi - lo)]
                yield pa.RecordBatch.from_arrays([pa.array(blobs, pa.binary()), pa.array(sizes, pa.binary()), pa.array(label[lo:hi], pa.int32())], names=["own", "size", "label"])

    rows = sample.mapInArrow(tidy(describe), "own binary, size binary, label int").collect()
    y = np.array([r["label"] for r in rows], float)
    base = float(np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5)))
    model = QualityModel(np.zeros(WIDTH), np.zeros((2, 2)), 0.0, base)
    if len(y) == 0 or y.min() == y.max():
        return model
    own = [np.frombuffer(r["own"], np.int16).reshape(-1, MEASURES) for r in rows]
    first = np.concatenate([[0], np.cumsum([len(x) for x in own])])
    own = np.concatenate(own).astype(np.int64)
    size = np.concatenate([np.frombuffer(r["size"], np.int32) for r in rows])
    del rows
    edge, block = np.arange(MEASURES) * BINS + OUTSIDE, MEASURES * BINS
    before, after = np.vstack([edge[None, :], own[:-1]]), np.vstack([own[1:], edge[None, :]])
    before[first[:-1]], after[first[1:] - 1] = edge, edge
    idx = np.hstack([own, before + block, after + 2 * block]).astype(np.int16)
    line_y = np.repeat(y, np.diff(first))
    linked = np.ones(len(line_y), bool)
    linked[first[:-1]] = False
    seen = np.zeros((2, 2))
    j = np.flatnonzero(linked)
    np.add.at(seen, (line_y[j - 1].astype(int), line_y[j].astype(int)), 1)
    m1, m2 = np.zeros(WIDTH + 4), np.zeros(WIDTH + 4)
    for step in range(1, steps + 1):
        p, pair, _ = marginals(emissions(model, idx), model.move, first)
        g = np.zeros(WIDTH + 4)
        err = p - line_y
        g[: WIDTH - 1] = np.bincount(idx.ravel(), weights=np.repeat(err, idx.shape[1]), minlength=WIDTH - 1)[: WIDTH - 1]
        g[WIDTH - 1] = err.sum()
        g[WIDTH:] = (pair - seen).ravel()
        g[:WIDTH] += ridge * model.weights
        g[WIDTH:] += ridge * len(j) / 20 * model.move.ravel()
        g /= len(line_y)
        m1, m2 = 0.9 * m1 + 0.1 * g, 0.99 * m2 + 0.01 * g * g
        change = 0.1 * (m1 / (1 - 0.9**step)) / (np.sqrt(m2 / (1 - 0.99**step)) + 1e-8)
        model.weights -= change[:WIDTH]
        model.move -= change[WIDTH:].reshape(2, 2)
    p, _, _ = marginals(emissions(model, idx), model.move, first)
    x = logit(document_means(p, size, first))
    model.slope, model.offset = logistic(x, y, np.ones(len(y)))
    return model


def score_quality(docs: DataFrame, model: QualityModel, doc_id: str = "doc_id", text: str = "text", folds: int = 5, held: int = 0, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted, line_quality (P(good) of every line) for each row.

    A null or empty text is one empty line and is scored as such. held_out of a null id is false.
    """

    def run(source) -> Iterator[pa.RecordBatch]:
        for batch in source:
            score, lines = [], []
            for _, _, data, off in chunks(batch.column(2)):
                idx, size, first = features(data, off)
                p, _, _ = marginals(emissions(model, idx), model.move, first)
                score.append(1 / (1 + np.exp(-np.clip(model.slope * logit(document_means(p, size, first)) + model.offset, -30, 30))))
                lines.append(pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(p.astype(np.float32))))
            if score:
                s = np.concatenate(score)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(s), pa.array((s >= threshold).astype(np.int32)), pa.concat_arrays(lines)], names=["doc_id", "held_out", "score", "predicted", "line_quality"])

    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(fold(doc_id, folds) == held, F.lit(False)).alias("held_out"), F.col(text).alias("text"))
    kind = dict(rows.dtypes)["doc_id"]
    return rows.mapInArrow(tidy(run), f"doc_id {kind}, held_out boolean, score double, predicted int, line_quality array<float>")


def quality(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> DataFrame:
    """Fit on a bounded sample of labelled documents outside the held-out fold, then score every document."""
    train = F.coalesce(fold("doc_id", 5) != 0, F.lit(False))
    return score_quality(docs, fit_quality(labelled_sample(docs, labels, "quality", train, rows=rows)))


def keep_good(docs: DataFrame, model: QualityModel, text: str = "text", threshold: float = 0.3) -> DataFrame:
    """The rows of docs whose text scores at or over the threshold, with all their columns."""
    at = docs.columns.index(text)

    def run(source) -> Iterator[pa.RecordBatch]:
        for batch in source:
            keep = []
            for _, _, data, off in chunks(batch.column(at)):
                idx, size, first = features(data, off)
                p, _, _ = marginals(emissions(model, idx), model.move, first)
                keep.append(1 / (1 + np.exp(-np.clip(model.slope * logit(document_means(p, size, first)) + model.offset, -30, 30))) >= threshold)
            if keep:
                yield batch.filter(pa.array(np.concatenate(keep)))

    return docs.mapInArrow(tidy(run), docs.schema)
