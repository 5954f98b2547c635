"""Quality classifier: naive Bayes support vectors.

A text becomes the set of its n-gram indicators, hashed to `WIDTH` numbers:
single words and pairs; runs of one to three word shapes (letters of either case,
digits, and which signs stand where; a word equal to the one before has a shape
of its own); and the order of magnitude of its length. On a sample of about
`SAMPLE` labelled documents each indicator is scaled by the ratio of its smoothed
log counts in both classes, and a linear hinge-loss model with an L2 penalty is
fitted by dual coordinate descent, in an order that a fixed seed decides. Weights
are drawn towards their mean size by `MIX`; a Platt curve from a fifth of the
sample, which the model didn't see, gives scores.

Defined results: null and empty texts have the indicator of length 0 only and get
its score; whole texts count at any length; rows are independent, so repeated
rows, ties and null ids need no rule; an empty table gives an empty result;
without labelled documents of both kinds every score is 0.5.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import arrow_text

SAMPLE, WIDTH, MIX, COST, EPOCHS, SMOOTH = 12_000, 1 << 18, 0.5, 0.1, 12, 1.0

_LOWER, _UPPER, _DIGIT = re.compile(r"[^\W\d_A-Z]+"), re.compile(r"[A-Z]+"), re.compile(r"\d+")
_memory = arrow_text.Memory()


def _learn(words: list[bytes]) -> list[bytes]:
    """Word code and shape code of words, each with a space behind it, as two 32-bit numbers."""
    out = []
    for raw in words:
        w = raw[:-1].decode("utf-8", "replace")
        shape = _DIGIT.sub("0", _UPPER.sub("A", _LOWER.sub("a", w)))
        shape = re.sub(r"(.)\1{2,}", r"\1\1\1", shape)  # long runs of one sign look alike
        out.append(xxhash.xxh32_intdigest(w.lower()).to_bytes(4, "little") + xxhash.xxh32_intdigest(shape, 7).to_bytes(4, "little"))
    return out


def _mix(a: np.ndarray, b: np.ndarray, k: int) -> np.ndarray:
    return (a * np.uint64(0x9E3779B97F4A7C15) + b * np.uint64(0xC2B2AE3D27D4EB4F) + np.uint64(k)) >> np.uint64(20)


def indicators_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Sorted numbers of the indicators of all texts end to end, and where each text's begin (n+1)."""
    body, offsets = arrow_text.raw(column)
    words = arrow_text.joined(arrow_text.split(body, offsets))
    distinct, at = arrow_text.distinct(arrow_text.strings(words))
    codes = np.frombuffer(b"".join(_memory.values(distinct, _learn)), "<u4").reshape(-1, 2).astype(np.uint64)[at]
    word, shape, row = codes[:, 0], codes[:, 1].copy(), words.row
    follows = row[1:] == row[:-1]
    third = follows[1:] & follows[:-1]
    shape[1:][follows & (word[1:] == word[:-1])] = 11
    two = _mix(shape[:-1], shape[1:], 3)
    length = np.frexp(words.counts.astype(np.float64))[1].astype(np.uint64) * np.uint64(2654435761) + np.uint64(77)
    every = [(word, row), (_mix(word[:-1], word[1:], 1)[follows], row[1:][follows]), (_mix(shape, shape, 2), row), (two[follows], row[1:][follows]), (_mix(two[:-1], shape[2:], 5)[third], row[2:][third]), (length, np.arange(len(length)))]
    key = np.unique(np.concatenate([r.astype(np.int64) * WIDTH + (c % np.uint64(WIDTH)).astype(np.int64) for c, r in every]))
    return (key % WIDTH).astype(np.int32), np.searchsorted(key, np.arange(len(length) + 1) * WIDTH)


def indicators(text: str) -> np.ndarray:
    """Sorted numbers of the indicators that a text has."""
    return indicators_of(pa.array([text], pa.large_string()))[0]


@dataclass
class Model:
    weights: np.ndarray
    bias: float
    slope: float = 0.0
    shift: float = 0.0

    def raw(self, rows: list[np.ndarray]) -> np.ndarray:
        return np.array([self.weights[r].sum() / np.sqrt(len(r)) + self.bias for r in rows])

    def score(self, texts: pa.Array) -> np.ndarray:
        flat, upto = indicators_of(texts)  # every text has an indicator, that of its length
        raw = np.add.reduceat(self.weights[flat], upto[:-1]) / np.sqrt(np.diff(upto)) + self.bias if len(texts) else np.zeros(0)
        return 1 / (1 + np.exp(-(self.slope * raw + self.shift)))


def descend(rows: list[np.ndarray], values: list[np.ndarray], y: np.ndarray, width: int, cost: float = COST, epochs: int = EPOCHS) -> tuple[np.ndarray, float]:
    """L2-regularised hinge loss by dual coordinate descent; y is +1 or -1. Classes weigh alike."""
    w, b, alpha = np.zeros(width), 0.0, np.zeros(len(y))
    square = np.array([float(v @ v) + 1 for v in values])
    limit = np.where(y > 0, cost * len(y) / (2 * (y > 0).sum()), cost * len(y) / (2 * (y < 0).sum()))
    draw = np.random.default_rng(5)
    for _ in range(epochs):
        moved = 0.0
        for i in draw.permutation(len(y)):
            r, v = rows[i], values[i]
            gradient = y[i] * (float(w[r] @ v) + b) - 1
            new = min(max(alpha[i] - gradient / square[i], 0.0), limit[i])
            step = (new - alpha[i]) * y[i]
            if step:
                alpha[i] = new
                w[r] += step * v
                b += step
                moved = max(moved, abs(step))
        if moved < 1e-3 * cost:
            break
    return w, b


def fit(sample: DataFrame) -> Model:
    """Learn from (doc_id, text, y, held): rows of bounded number, whose indicators reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in arrow_text.slices(batches):
            flat, upto = indicators_of(b.column(1))
            rows = pa.ListArray.from_arrays(pa.array(upto.astype(np.int32)), pa.array(flat))
            yield pa.RecordBatch.from_arrays([b.column(0), rows, b.column(2), b.column(3)], names=["doc_id", "x", "y", "held"])

    got = sample.select("doc_id", "text", "y", "held").mapInArrow(run, "doc_id long, x array<int>, y int, held boolean").toArrow().sort_by([("doc_id", "ascending"), ("y", "ascending")])
    x = got["x"].combine_chunks()
    ends, flat = x.offsets.to_numpy(), x.values.to_numpy()
    rows = [flat[s:e] for s, e in zip(ends[:-1], ends[1:], strict=True)]
    y, held = got["y"].to_numpy() if len(got) else np.zeros(0, int), np.array(got["held"].to_pylist(), bool)
    own = np.flatnonzero(~held)
    if not 0 < y[own].sum() < len(own):
        return Model(np.zeros(WIDTH), 0.0)
    count = [np.bincount(np.concatenate([rows[i] for i in own if y[i] == c]), minlength=WIDTH) + SMOOTH for c in (0, 1)]
    ratio = np.log(count[1] / count[1].sum()) - np.log(count[0] / count[0].sum())
    ratio[(count[0] + count[1]) < 2 * SMOOTH + 2] = 0  # seen once: says nothing
    learn = [rows[i] for i in own]
    values = [ratio[r] / np.sqrt(len(r)) for r in learn]
    w, b = descend(learn, values, np.where(y[own] > 0, 1.0, -1.0), WIDTH)
    w = (1 - MIX) * np.abs(w).mean() + MIX * w
    model = Model(w * ratio, b)
    rest = np.flatnonzero(held)
    return _platt(model, model.raw([rows[i] for i in rest]), y[rest].astype(float))


def _platt(model: Model, s: np.ndarray, y: np.ndarray) -> Model:
    model.slope = 1.0
    if 0 < y.sum() < len(y):
        n1 = y.sum()
        target = np.where(y > 0, (n1 + 1) / (n1 + 2), 1 / (len(y) - n1 + 2))
        scale = s.std() or 1.0
        design, w = np.stack([s / scale, np.ones(len(s))], axis=1), np.zeros(2)
        for _ in range(60):
            p = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
            step = np.linalg.solve(design.T @ (design * (p * (1 - p))[:, None]) + 1e-3 * np.eye(2), design.T @ (target - p) - 1e-3 * w)
            w = w + np.clip(step, -4, 4)
            if np.abs(step).max() < 1e-9:
                break
        model.slope, model.shift = float(w[0] / scale), float(w[1])
    return model


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in arrow_text.slices(batches):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(model.score(b.column(1)), pa.float64())], names=["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, score double")
