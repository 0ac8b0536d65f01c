"""Toxicity by maximum-scoring segments of token log-odds.

Training estimates, for each token, the log-odds of its document frequency in toxic against other documents under an
informative Dirichlet prior, with their variance; tokens of LEAST_DOCS toxic documents or more whose lower bound is clear
of zero score, all others cost a little. Their number is bounded by what the labelled sample (SAMPLE_ROWS) holds. A linear scan finds every maximal segment of a document. The best segment is set against what documents of
that length have by chance (an extreme-value law whose scale solves the moment equation of the score distribution),
and that margin is calibrated to a probability.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kernels import U, alnum_table, chunks, lower_table, signed, span_hashes, word_spans
from .labelled import SAMPLE_ROWS, fold, labelled_sample
from .runtime import tidy

PRIOR = 200.0
LEAST_Z = 3.0
#: toxic documents of the sample that a scoring token stands in, at least
LEAST_DOCS = 3
SIGNIFICANT = 0.05


@dataclass
class ToxicityModel:
    """A bounded table: token hashes in order, their scores, what any other token costs, and the calibration."""

    tokens: np.ndarray
    scores: np.ndarray
    cost: float
    scale: float
    space: float
    slope: float
    offset: float


def tokens_of(data: np.ndarray, off: np.ndarray):
    low = lower_table()[data]
    starts, ends, first = word_spans(low, off, alnum_table())
    return span_hashes(low, starts, ends), starts, ends, first


def maximal_segments(at: np.ndarray, score: np.ndarray, cost: float) -> list[tuple[float, int, int]]:
    """Every maximal-scoring segment (score, first, last) of a sequence with positive scores at positions `at`
    and -cost anywhere else, in linear time: a list of candidates that merge when a later one rises above an earlier."""
    found: list[tuple[int, int, float, float]] = []  # first, last, total before it, total after it
    total, before = 0.0, -1
    for p, s in zip(at.tolist(), score.tolist(), strict=True):
        total -= cost * (p - before - 1)
        first, low = p, total
        total += s
        before = p
        while found:
            j = len(found) - 1
            while j >= 0 and found[j][2] >= low:
                j -= 1
            if j < 0 or found[j][3] >= total:
                break
            first, low = found[j][0], found[j][2]
            del found[j:]
        found.append((first, p, low, total))
    return [(r - lo, a, b) for a, b, lo, r in found]


def best_margins(model: ToxicityModel, data: np.ndarray, off: np.ndarray, spans: bool = False):
    """For each document, the best segment's margin over chance; with spans, also its significant byte ranges."""
    h, starts, ends, first = tokens_of(data, off)
    n = np.diff(first)
    room = np.log(np.maximum(n, 1) * model.space)
    best = np.zeros(len(n))
    passages: list[list[tuple[int, int]]] = [[] for _ in n] if spans else []
    if len(model.tokens) and len(h):
        pos = np.minimum(np.searchsorted(model.tokens, h), len(model.tokens) - 1)
        hit = np.flatnonzero(model.tokens[pos] == h)
        doc = np.searchsorted(first, hit, side="right") - 1
        cut = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]])) if len(hit) else np.zeros(0, int)
        for lo, hi in zip(cut, np.append(cut[1:], len(hit)), strict=True):
            d = int(doc[lo])
            segments = maximal_segments(hit[lo:hi] - first[d], model.scores[pos[hit[lo:hi]]], model.cost)
            best[d] = max(s for s, _, _ in segments)
            if spans:
                for s, a, b in segments:
                    if 1 - np.exp(-np.exp(min(50.0, room[d] - model.scale * s))) <= SIGNIFICANT:
                        passages[d].append((int(starts[first[d] + a] - off[d]), int(ends[first[d] + b] - off[d])))
    margin = model.scale * best - room
    return (margin, passages) if spans else margin


def fit_toxicity(sample: DataFrame) -> ToxicityModel:
    """Fit on (text, label) rows of a bounded sample. Without rows of both labels the model gives the base rate."""

    def count(source) -> Iterator[pa.RecordBatch]:
        for batch in source:
            label = np.asarray(batch.column(1))
            for lo, hi, data, off in chunks(batch.column(0)):
                h, _, _, first = tokens_of(data, off)
                doc = np.repeat(np.arange(hi - lo), np.diff(first))
                order = np.lexsort((doc, h))
                h, doc = h[order], doc[order]
                once = np.concatenate([[True], (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])]) if len(h) else np.zeros(0, bool)
                h, y = h[once], label[lo:hi][doc[once]]
                if len(h):
                    at = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
                    yield pa.RecordBatch.from_arrays([pa.array(signed(h[at])), pa.array(np.add.reduceat(y.astype(np.int64), at)), pa.array(np.diff(np.append(at, len(h))))], names=["token", "toxic", "docs"])

    both = sample.groupBy("label").agg(F.count("*").alias("n")).collect()
    n_pos = sum(r["n"] for r in both if r["label"] == 1)
    n_all = sum(r["n"] for r in both)
    empty = ToxicityModel(np.zeros(0, U), np.zeros(0), 1.0, 1.0, 1.0, 0.0, float(np.log((n_pos + 0.5) / (n_all - n_pos + 0.5))))
    if n_pos == 0 or n_pos == n_all:
        return empty
    n_neg = n_all - n_pos
    t = sample.mapInArrow(tidy(count), "token long, toxic long, docs long").groupBy("token").agg(F.sum("toxic").alias("y"), F.sum("docs").alias("d"))
    prior = F.lit(PRIOR) * (F.col("d") / n_all)
    pos, neg = F.col("y") + prior + 0.01, F.col("d") - F.col("y") + prior + 0.01
    odds = F.log(pos / (n_pos + PRIOR - pos + 1)) - F.log(neg / (n_neg + PRIOR - neg + 1))
    sd = F.sqrt(1 / pos + 1 / neg)
    kept = t.where(F.col("y") >= LEAST_DOCS).select("token", (odds - sd).alias("s"), (odds / sd).alias("z"), F.col("d").alias("d"), "y").where(f"z >= {LEAST_Z} and s > 0").orderBy("token").collect()
    if not kept:
        return empty
    tokens = np.array([r["token"] for r in kept], np.int64).view(U)
    order = np.argsort(tokens)
    model = ToxicityModel(tokens[order], np.array([r["s"] for r in kept])[order], 0.05, 1.0, 1.0, 1.0, 0.0)
    # chance level: how often scoring tokens stand in documents that are not toxic, out of all their tokens
    rate = np.array([(r["d"] - r["y"] + 0.1) / n_neg / 300 for r in kept])[order]
    model.scale = solve_scale(model.scores, rate, model.cost)
    model.space = float(max(1e-9, rate.sum()))

    def margins(source) -> Iterator[pa.RecordBatch]:
        for batch in source:
            m = [best_margins(model, data, off) for _, _, data, off in chunks(batch.column(0))]
            if m:
                yield pa.RecordBatch.from_arrays([pa.array(np.floor(np.clip(np.concatenate(m), -30, 60) * 4).astype(np.int32)), batch.column(1)], names=["bin", "label"])

    seen = sample.mapInArrow(tidy(margins), "bin int, label int").groupBy("bin", "label").count().collect()
    x = np.array([(r["bin"] + 0.5) / 4 for r in seen])
    y = np.array([float(r["label"]) for r in seen])
    model.slope, model.offset = logistic(x, y, np.array([float(r["count"]) for r in seen]))
    return model


def solve_scale(scores: np.ndarray, rate: np.ndarray, cost: float) -> float:
    """The positive root of sum(p * exp(scale * score)) = 1."""
    rest = max(1e-9, 1 - rate.sum())
    lo, hi = 1e-6, 50.0
    value = lambda a: float((rate * np.exp(np.minimum(700, a * scores))).sum() + rest * np.exp(-a * cost) - 1)
    if value(lo) >= 0:
        return 1.0
    for _ in range(80):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if value(mid) < 0 else (lo, mid)
    return lo


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-2) -> tuple[float, float]:
    """Slope and offset of a one-variable logistic fit, by Newton steps with a ridge on the slope."""
    a, b = 0.0, float(np.log(((weight * y).sum() + 0.5) / ((weight * (1 - y)).sum() + 0.5)))
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -30, 30)))
        g, v = weight * (p - y), weight * p * (1 - p) + 1e-9
        grad = np.array([(g * x).sum() + ridge * a, g.sum()])
        hess = np.array([[(v * x * x).sum() + ridge, (v * x).sum()], [(v * x).sum(), v.sum() + 1e-9]])
        step = np.linalg.solve(hess, grad)
        a, b = a - float(np.clip(step[0], -2, 2)), b - float(np.clip(step[1], -2, 2))
        if abs(step).max() < 1e-9:
            break
    return a, b


def score_toxicity(docs: DataFrame, model: ToxicityModel, doc_id: str = "doc_id", text: str = "text", folds: int = 4, held: int = 2, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted, passages (significant toxic byte ranges of the text) for each row.

    A null or empty text has no segment and takes the score of one without toxic tokens. held_out of a null id is false.
    """

    def run(source) -> Iterator[pa.RecordBatch]:
        for batch in source:
            score, passages = [], []
            for _, _, data, off in chunks(batch.column(2)):
                m, p = best_margins(model, data, off, spans=True)
                score.append(1 / (1 + np.exp(-np.clip(model.slope * m + model.offset, -30, 30))))
                passages += p
            if score:
                s = np.concatenate(score)
                spans = pa.array([[{"start": a, "end": b} for a, b in p] for p in passages], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(s), pa.array((s >= threshold).astype(np.int32)), spans], names=["doc_id", "held_out", "score", "predicted", "passages"])

    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(fold(doc_id, folds) == held, F.lit(False)).alias("held_out"), F.col(text).alias("text"))
    kind = dict(rows.dtypes)["doc_id"]
    return rows.mapInArrow(tidy(run), f"doc_id {kind}, held_out boolean, score double, predicted int, passages array<struct<start:long,end:long>>")


def toxicity(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> DataFrame:
    """Fit on a bounded sample of labelled documents outside the held-out fold, then score every document."""
    train = F.coalesce(fold("doc_id", 4) != 2, F.lit(False))
    return score_toxicity(docs, fit_toxicity(labelled_sample(docs, labels, "toxic", train, rows=rows)))
