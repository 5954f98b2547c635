"""Offline comparison of ways to turn scores against a fixed set of texts into a measure of how much one stands out."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..checkpoints import cut
from .vectors import BLOCK_BYTES, SCALE, matrix, whole

LEAST, QUARTER, SHARP = 1e-9, 0.6745, 100.0
MEASURED = "vec_id long, text_id long, score double, spreads double, lower_spreads double, share double, odds double"


def transforms(scores: np.ndarray) -> dict[str, np.ndarray]:
    """Of each row of scores: deviations from the middle by the spread, and by the lower half's; the share of scores below; log odds of a soft maximum."""
    n, ordered = scores.shape[1], np.sort(scores, axis=1)
    middle, quarter = ordered[:, [n // 2]], ordered[:, [n // 4]]
    apart = np.sort(np.abs(scores - middle), axis=1)[:, [n // 2]]
    top = ordered[:, [-1]]
    # how many of a row are less: where equal values begin in its order
    below = np.stack([np.searchsorted(o, x, "left") for o, x in zip(ordered, scores, strict=True)]) if len(scores) else np.zeros(scores.shape, int)
    total = np.exp(SHARP * (scores - top)).sum(axis=1, keepdims=True)
    return {
        "spreads": (scores - middle) / np.maximum(apart * SCALE, LEAST),
        "lower_spreads": (scores - middle) / np.maximum((middle - quarter) / QUARTER, LEAST),
        "share": below / max(1, n - 1),
        "odds": (SHARP * (scores - top) - np.log(total)) / np.log(10),
    }


def measured(vectors: DataFrame, texts: DataFrame, block: int = BLOCK_BYTES) -> DataFrame:
    """(vec_id, text_id, score, spreads, lower_spreads, share, odds) for every row and every text; texts are a small fixed set."""
    ids, t = whole(texts, block)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 512):
                part = b.slice(at, 512)
                score = matrix(part.column(1)) @ t.T
                own = {"score": score, **transforms(score)}
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(part.column(0).to_numpy(), len(ids))), pa.array(np.tile(ids, part.num_rows)), *(pa.array(x.ravel().astype(np.float64)) for x in own.values())], names=["vec_id", "text_id", *own])

    return vectors.where("embedding is not null").select("vec_id", "embedding").mapInArrow(run, MEASURED)


def text_auc(rows: DataFrame, score: str, told: str) -> DataFrame:
    """(text_id, auc, told): for each text, how often a row it is said of scores above one it isn't said of; ties count half.

    Equal scores are counted first; then ranges of (text, score) count what stands before them, so a text's scores take many tasks.
    """
    counts = rows.groupBy("text_id", F.col(score).alias("s")).agg(F.count_if(F.col(told)).alias("g"), F.count_if(~F.col(told)).alias("b"))
    dealt = cut(counts.repartitionByRange("text_id", "s").withColumn("_range", F.spark_partition_id()))  # both uses see the same ranges
    before = Window.partitionBy("text_id").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    ahead = dealt.groupBy("text_id", "_range").agg(F.sum("b").alias("n")).withColumn("_ahead", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    local = Window.partitionBy("text_id", "_range").orderBy("s").rowsBetween(Window.unboundedPreceding, -1)
    placed = dealt.withColumn("_local", F.coalesce(F.sum("b").over(local), F.lit(0))).join(ahead, ["text_id", "_range"])
    right = F.sum(F.col("g") * (F.col("_ahead") + F.col("_local") + F.col("b") / 2))
    out = placed.groupBy("text_id").agg(F.try_divide(right, F.sum("g").cast("double") * F.sum("b")).alias("auc"), F.sum("g").alias("told"))
    return out.where("auc is not null")


def quiet_bars(rows: DataFrame, score: str, leak: float, accuracy: int = 10_000) -> DataFrame:
    """(text_id, bar): for each text the score that more than a share of `leak` of its rows reach, but no more than that pass.

    Sketches of one pass bound it between two scores; a second pass counts what lies above and between them. Where
    a sketch was wrong, which the counts tell, that text's own range is taken.
    """
    own = rows.select("text_id", F.col(score).alias("s"))
    at = [max(0.0, 1 - leak - 2 / accuracy), min(1.0, 1 - leak + 2 / accuracy)]
    bounds = own.groupBy("text_id").agg(F.count("*").alias("n"), F.percentile_approx("s", at, accuracy).alias("q"), F.min("s").alias("least"), F.max("s").alias("most"))
    # the place from above of the score that is looked for
    bounds = cut(bounds.select("text_id", (F.floor(F.col("n") * leak) + 1).alias("k"), F.col("q")[0].alias("low"), F.col("q")[1].alias("high"), "least", "most"))
    out = None
    for whole in (False, True):
        both = own.join(bounds, "text_id")
        counts = both.groupBy("text_id", "k").agg(F.count_if(F.col("s") > F.col("high")).alias("above"), F.count_if(F.col("s") >= F.col("low")).alias("upto"))
        good = cut(counts.where((F.col("above") < F.col("k")) & (F.col("k") <= F.col("upto"))))
        between = both.where((F.col("s") >= F.col("low")) & (F.col("s") <= F.col("high"))).groupBy("text_id", "s").agg(F.count("*").alias("c"))
        passed = F.sum("c").over(Window.partitionBy("text_id").orderBy(F.desc("s")))
        found = between.join(good, "text_id").withColumn("at", F.col("above") + passed).where(F.col("at") >= F.col("k")).groupBy("text_id").agg(F.max("s").alias("bar"))
        out = found if out is None else out.unionByName(found)
        wrong = bounds.join(good.select("text_id"), "text_id", "left_anti")
        if whole or wrong.isEmpty():
            return out
        bounds = cut(wrong.withColumns({"low": F.col("least"), "high": F.col("most")}))
    return out


def middle(values: list[float]) -> float:
    """The element at n/2 in order, 0 of none."""
    return sorted(values)[len(values) // 2] if values else 0.0


def bar_at(rows: DataFrame, score: str, leak: float) -> float:
    """The bar above which the middle one of the texts leaks no more than a share of `leak` of its rows; texts are a small fixed set."""
    return middle([r["bar"] for r in quiet_bars(rows, score, leak).select("bar").collect()])


def recall(rows: DataFrame, score: str, told: str, bar: float) -> DataFrame:
    """One row: the share of told rows above a bar, and of others."""
    share = lambda c: F.avg(F.when(c, (F.col(score) > bar).cast("double")))
    return rows.agg(share(F.col(told)).alias("recall"), share(~F.col(told)).alias("leaked"))


def evaluation(rows: DataFrame, score: str, told: str, leak: float) -> DataFrame:
    """One row: the middle and the count-weighted agreement of the texts that are told of some row, the bar at which the middle one of the others leaks a share of `leak`, and the recall there."""
    loud = rows.where(F.col(told)).select("text_id").distinct()
    agreement = text_auc(rows.join(loud, "text_id", "left_semi"), score, told).collect()  # a row for each text of a small fixed set
    n = sum(r["told"] for r in agreement)
    bar = bar_at(rows.join(loud, "text_id", "left_anti"), score, leak)
    weighted = sum(r["auc"] * r["told"] for r in agreement) / n if n else 0.0
    at = recall(rows.join(loud, "text_id", "left_semi"), score, told, bar)
    return at.select(F.lit(len(agreement)).cast("long").alias("texts"), F.lit(middle([r["auc"] for r in agreement])).alias("middle_auc"), F.lit(weighted).alias("weighted_auc"), F.lit(bar).alias("bar"), "recall", "leaked")
