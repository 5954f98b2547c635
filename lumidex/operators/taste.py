"""Learned ranking: ridge regression from embeddings to judgements, its held-out agreement, and verdicts on rows without a judgement.

The fit is bounded: at most `MOST` samples, spread evenly over the judged rows from the newest
to the oldest, reach the driver. Defined results: without `AT_LEAST` liked and disliked rows
there is no model and every verdict is `unsure`; rows without a vector have no score.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..checkpoints import cut
from ..plans.search import placed
from .works import DISLIKED, LIKED, target

# Least number of either kind, useful agreement, most samples, folds, strengths.
AT_LEAST, USEFUL, MOST, FOLDS, STRENGTHS = 5, 0.65, 4000, 5, (0.03, 0.1, 0.3, 1.0, 3.0, 10.0)


@dataclass
class Model:
    weights: np.ndarray
    bias: float
    strength: float
    agreement: float
    keep_at: float
    reject_at: float
    liked: int
    disliked: int

    @property
    def useful(self) -> bool:
        return self.agreement >= USEFUL


def agreement(scores: np.ndarray, y: np.ndarray) -> float:
    """How often a liked row scores above a disliked one; equal scores count half. 0.5 without both kinds."""
    good, bad = scores[y >= LIKED], np.sort(scores[y <= DISLIKED])
    if not len(good) or not len(bad):
        return 0.5
    return float((np.searchsorted(bad, good, "left") + np.searchsorted(bad, good, "right")).sum() / 2 / len(good) / len(bad))


def quantile(values: np.ndarray, q: float) -> float:
    """The value of the nearest rank, halves rounded up."""
    return float(np.sort(values)[int((len(values) - 1) * q + 0.5)]) if len(values) else float("nan")


def ridge(x: np.ndarray, y: np.ndarray, strength: float) -> tuple[np.ndarray, float]:
    """Weights on features as they are (centred by the caller) for the deviations of y from its mean."""
    mean = float(y.mean())
    return np.linalg.solve(x.T @ x + strength * np.eye(x.shape[1]), x.T @ (y - mean)), mean


def learn(vectors: np.ndarray, y: np.ndarray) -> Model | None:
    """The model of samples in their order, newest first: folds by position, the strength of the best held-out agreement, then all of them."""
    liked, disliked = int((y >= LIKED).sum()), int((y <= DISLIKED).sum())
    if liked < AT_LEAST or disliked < AT_LEAST:
        return None
    middle = vectors.mean(axis=0)
    x, fold, best = vectors - middle, np.arange(len(y)) % min(FOLDS, len(y)), None
    for strength in STRENGTHS:
        held = np.zeros(len(y))
        for f in range(min(FOLDS, len(y))):
            own = fold != f
            w, mean = ridge(x[own], y[own], strength)
            held[~own] = mean + x[~own] @ w
        found = agreement(held, y)
        if best is None or found > best[0]:
            best = found, strength, held
    found, strength, held = best
    w, mean = ridge(x, y, strength)
    kept, refused = held[y >= LIKED], held[y <= DISLIKED]
    keep_at, reject_at = max(quantile(kept, 0.25), quantile(refused, 0.9)), min(quantile(refused, 0.75), quantile(kept, 0.1))
    return Model(w, mean - float(middle @ w), strength, found, max(keep_at, reject_at), min(keep_at, reject_at), liked, disliked)


def samples(rows: DataFrame, most: int = MOST) -> DataFrame:
    """(place, embedding, target) of judged rows with a vector, newest first; of more than `most`, every n-th by its place."""
    judged = rows.withColumn("target", target(F.col("rating"), F.col("flag"))).where("target is not null and embedding is not null")
    at = placed(judged.select("id", "mtime", "embedding", "target"), [F.desc("mtime"), F.asc("id")])
    n = at.count()
    if n > most:
        step = n / most
        first = F.ceil((F.col("place") - 1) / step - 1e-9)  # the sample that this place would be
        at = at.where(F.floor(first * step) == F.col("place") - 1).where(first < most)
    return at.select("place", "embedding", "target")


def fit(rows: DataFrame) -> Model | None:
    got = samples(rows).orderBy("place").toArrow()
    if not got.num_rows:
        return None
    return learn(np.array(got["embedding"].to_pylist(), np.float64), got["target"].to_numpy())


def scored(rows: DataFrame, model: Model | None) -> DataFrame:
    """All rows with `taste` (null without a model or a vector) and `verdict` (keep, reject or unsure; null for judged rows)."""
    names = [*rows.columns, "taste"]
    at = rows.columns.index("embedding")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            column = b.column(at)
            there = column.is_valid().to_numpy(zero_copy_only=False)
            score = np.full(b.num_rows, np.nan)
            if there.any():
                values = column.drop_null().flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(int(there.sum()), -1)
                score[there] = values @ model.weights + model.bias
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(score, mask=~there)], names=names)

    out = rows.withColumn("taste", F.lit(None).cast("double")) if model is None else rows.mapInArrow(run, f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in rows.schema)}, taste double")
    sure = model is not None and model.useful
    verdict = F.when(F.col("taste") >= model.keep_at, "keep").when(F.col("taste") <= model.reject_at, "reject").otherwise("unsure") if sure else F.lit("unsure")
    return out.withColumn("verdict", F.when(target(F.col("rating"), F.col("flag")).isNull(), verdict))


def auc(rows: DataFrame, score: str, good: str) -> DataFrame:
    """One row: the share of pairs of a good and a bad row that the score orders rightly, ties half; by counts of each distinct score, so equal scores shuffle as one."""
    from pyspark.sql import Window

    counts = rows.where(F.col(score).isNotNull()).groupBy(F.col(score).alias("s")).agg(F.count_if(F.col(good)).alias("g"), F.count_if(~F.col(good)).alias("b"))
    # ranges of scores, each with the bad rows of those before it; both uses see the same ranges
    parts = cut(counts.repartitionByRange("s").withColumn("_range", F.spark_partition_id()))
    sums = parts.groupBy("_range").agg(F.sum("b").alias("_b"))  # a row for each range
    before = sums.withColumn("_before", F.coalesce(F.sum("_b").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_b")
    inner = F.coalesce(F.sum("b").over(Window.partitionBy("_range").orderBy("s").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    each = parts.withColumn("_inner", inner).join(before, "_range")
    right = F.sum(F.col("g") * (F.col("_before") + F.col("_inner") + F.col("b") / 2))
    return each.agg(F.coalesce(F.try_divide(right, F.sum("g").cast("double") * F.sum("b")), F.lit(0.5)).alias("auc"), F.sum("g").alias("good"), F.sum("b").alias("bad"))
