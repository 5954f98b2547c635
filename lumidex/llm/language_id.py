"""Language identification with string kernels.

The blended-spectrum presence kernel of two texts is the mean, over n = 1, 2, 3,
of the number of byte n-grams that both have, divided by the geometric mean of
their numbers of distinct n-grams (letters lower-cased, other ASCII as spaces).
About `LANDMARKS` training texts, the same number of each language and chosen by
a hash of id and text, span a Nyström approximation; one-versus-rest kernel ridge
regression is solved in that space on about `SAMPLE` labelled documents. Its
penalty is chosen on a fifth of them. Documents are scored in blocks: presence
matrix times landmark matrix, times the solved coefficients.

Defined results: null texts and texts without a letter are `und` with score 0;
of equal scores the first language in alphabetical order wins; texts of any length
count whole; rows are independent when they are scored, and of rows of one id and text one is learned
from; an empty table gives an empty result; without labelled rows every text is `und`, with
labelled rows of one language every text with a letter is of that language, with
score 1. Landmarks are texts of `LONG` characters or more where there are enough of
them, else shorter ones too; never anything but texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import arrow_text
from .shared import cut, held_out

LANDMARKS, LONG, SAMPLE, ORDERS, PENALTIES, SHARP = 160, 200, 6000, (1, 2, 3), (1e-4, 1e-3, 1e-2, 1e-1), 6.0
LETTER = regex.compile(r"\p{L}")
_BLANK = bytes(c if c >= 128 or chr(c).isalpha() else 32 for c in range(256))
_stamp: dict[int, np.ndarray] = {}
_clock = [0]


def grams(text: str) -> list[np.ndarray]:
    """Distinct byte n-grams of a text for each order, as numbers below 256**n; time and memory follow the text."""
    body = np.frombuffer(text.lower().encode("utf-8", "ignore").translate(_BLANK), np.uint8).astype(np.int32)
    out, code = [], body
    for n in ORDERS:
        if n > 1:
            code = (code[:-1] << 8) | body[n - 1 :] if len(body) >= n else body[:0]
        if n not in _stamp:
            _stamp[n] = np.full(256**n, -1, np.int32)
        if _clock[0] + len(code) > 2**31 - 2:
            for s in _stamp.values():
                s.fill(-1)
            _clock[0] = 0
        at = np.arange(_clock[0], _clock[0] + len(code), dtype=np.int32)
        _stamp[n][code] = at
        out.append(code[_stamp[n][code] == at])
        _clock[0] += len(code)
    return out


@dataclass
class Landmarks:
    """For each order the n-grams of all landmarks, which of them each landmark has, and how many."""

    codes: list[np.ndarray]
    has: list[np.ndarray]
    size: list[np.ndarray]
    _place: list = field(default_factory=list, repr=False)

    def __getstate__(self):
        return self.__dict__ | {"_place": []}

    @classmethod
    def of(cls, sets: list[list[np.ndarray]]) -> Landmarks:
        codes = [np.unique(np.concatenate([s[k] for s in sets])) for k in range(len(ORDERS))]
        has = [np.zeros((len(c), len(sets)), np.float32) for c in codes]
        for j, s in enumerate(sets):
            for k, c in enumerate(codes):
                has[k][np.searchsorted(c, s[k]), j] = 1
        return cls(codes, has, [np.array([max(1, len(s[k])) for s in sets]) for k in range(len(ORDERS))])

    def kernel(self, texts: list[str], block: int = 128) -> np.ndarray:
        """Kernel values of texts and landmarks, by products of presence matrices in blocks."""
        if not self._place:
            for n, c in zip(ORDERS, self.codes, strict=True):
                place = np.full(256**n, -1, np.int32)
                place[c] = np.arange(len(c))
                self._place.append(place)
        out = np.zeros((len(texts), len(self.size[0])))
        for first in range(0, len(texts), block):
            sets = [grams(t) for t in texts[first : first + block]]
            for k in range(len(ORDERS)):
                there = np.zeros((len(sets), len(self.codes[k])), np.float32)
                for i, s in enumerate(sets):
                    at = self._place[k][s[k]]
                    there[i, at[at >= 0]] = 1
                own = np.array([max(1, len(s[k])) for s in sets])
                out[first : first + len(sets)] += (there @ self.has[k]) / np.sqrt(own[:, None] * self.size[k]) / len(ORDERS)
        return out


@dataclass
class Model:
    names: list[str]
    landmarks: Landmarks | None = None
    coefficients: np.ndarray | None = None  # (landmarks + 1) x names, the last row is the intercept

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        fits = np.array([bool(t) and LETTER.search(t) is not None for t in texts])
        if self.landmarks is None:
            return [self.names[0] if f and self.names else "und" for f in fits], fits * float(bool(self.names))
        if not len(texts):
            return [], np.zeros(0)
        values = self.landmarks.kernel([t if f else "" for t, f in zip(texts, fits, strict=True)])
        margin = values @ self.coefficients[:-1] + self.coefficients[-1]
        power = np.exp(SHARP * (margin - margin.max(axis=1, keepdims=True)))
        best = margin.argmax(axis=1)
        score = power[np.arange(len(texts)), best] / power.sum(axis=1)
        return [self.names[b] if f else "und" for b, f in zip(best, fits, strict=True)], np.where(fits, score, 0.0)


def _solve(phi: np.ndarray, y: np.ndarray, penalty: float) -> np.ndarray:
    mean, middle = phi.mean(axis=0), y.mean(axis=0)
    centred = phi - mean
    w = np.linalg.solve(centred.T @ centred + penalty * len(phi) * np.eye(phi.shape[1]), centred.T @ (y - middle))
    return np.vstack([w, middle - mean @ w])


def lowest(known: DataFrame, sizes: dict[str, int], many: int) -> DataFrame:
    """(mark, text, lang): of each language the rows of the `many` lowest marks (not negative, spread evenly), rows of one mark once.

    Marks below a share of their range, a few times `many` of them, are looked at; where rows repeat so often that they are
    too few, those below a greater share. So few marks are sorted, whatever the number of rows.
    """
    share = {x: min(1.0, 4 * many / n) for x, n in sizes.items()}
    while True:
        upto = F.coalesce(*(F.when(F.col("lang") == x, F.lit(int(s * ((1 << 63) - 1024)) if s < 1 else (1 << 63) - 1)) for x, s in share.items()))
        some = cut(known.where(F.col("mark") <= upto).select("lang", "mark").distinct())
        found = {r["lang"]: r["n"] for r in some.groupBy("lang").agg(F.count("*").alias("n")).collect()}
        few = [x for x, s in share.items() if s < 1 and found.get(x, 0) < many]
        if not few:
            break
        share |= {x: min(1.0, 16 * share[x]) for x in few}
    place = F.row_number().over(Window.partitionBy("lang").orderBy("mark"))
    last = some.withColumn("place", place).where(F.col("place") <= many).groupBy("lang").agg(F.max("mark").alias("upto"))
    rows = known.join(F.broadcast(last), "lang").where(F.col("mark") <= F.col("upto"))  # a row for each language
    return rows.groupBy("mark", "lang").agg(F.min("text").alias("text")).select("mark", "text", "lang")


def fit(docs: DataFrame, parts: int = 4, remainder: int = 2, landmarks: int = LANDMARKS, sample: int = SAMPLE) -> Model:
    """Learn from text and lang of the documents that aren't held out; kernel values of about `sample` of them reach the driver."""
    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id"), parts, remainder)).select(F.shiftrightunsigned(F.xxhash64("doc_id", F.lit(11), "text"), 1).alias("mark"), "text", "lang")
    sizes = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    names = sorted(sizes)
    if len(names) < 2:
        return Model(names)
    each = -(-landmarks // len(names))

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in arrow_text.slices(batches):
            sets = [grams(t) for t in b.column(1).to_pylist()]
            short = pc.less(pc.utf8_length(b.column(1)), LONG)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), short, *(pa.array([s[k] for s in sets], pa.list_(pa.int32())) for k in range(len(ORDERS)))], names=["mark", "lang", "short", *(f"g{n}" for n in ORDERS)])

    # texts of a few words make poor landmarks; they are drawn with room to spare, and the first long ones by hash are kept
    drawn = lowest(known, sizes, 4 * each).mapInArrow(spread, "mark long, lang string, short boolean, " + ", ".join(f"g{n} array<int>" for n in ORDERS))
    rows = drawn.toArrow()
    rows = rows.set_column(rows.schema.get_field_index("short"), "short", rows["short"].cast(pa.int8())).sort_by([("short", "ascending"), ("mark", "ascending")]).to_pylist()
    taken = [r for x in names for r in [q for q in rows if q["lang"] == x][:each]]
    marks = Landmarks.of([[np.array(r[f"g{n}"], np.int32) for n in ORDERS] for r in taken])

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in arrow_text.slices(batches):
            k = marks.kernel(b.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(list(k), pa.list_(pa.float64()))], names=["mark", "lang", "k"])

    got = lowest(known, sizes, -(-sample // len(names))).mapInArrow(measure, "mark long, lang string, k array<double>").toArrow().sort_by([("mark", "ascending"), ("lang", "ascending")])
    k = np.array(got["k"].to_pylist())
    y = np.array([[1.0 if r == x else -1.0 for x in names] for r in got["lang"].to_pylist()])
    # K(landmarks)^(-1/2), without directions of no weight
    own = sum((h.T @ h) / np.sqrt(s[:, None] * s) / len(ORDERS) for h, s in zip(marks.has, marks.size, strict=True))
    value, vector = np.linalg.eigh(own)
    keep = value > 1e-6 * value[-1]
    root = vector[:, keep] / np.sqrt(value[keep])
    phi, held = k @ root, np.arange(len(k)) % 5 == 0
    if held.sum() and (~held).sum():
        right = [(_solve(phi[~held], y[~held], p)[:-1], p) for p in PENALTIES]
        inter = [_solve(phi[~held], y[~held], p)[-1] for p in PENALTIES]
        good = [np.mean((phi[held] @ w + c).argmax(1) == y[held].argmax(1)) for (w, _), c in zip(right, inter, strict=True)]
        penalty = PENALTIES[int(np.argmax(good))]
    else:
        penalty = PENALTIES[1]
    solved = _solve(phi, y, penalty)
    return Model(names, marks, np.vstack([root @ solved[:-1], solved[-1]]))


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, lang_pred, score) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in arrow_text.slices(batches):
            names, score = model.predict(b.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(names, pa.string()), pa.array(score, pa.float64())], names=["doc_id", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, lang_pred string, score double")
