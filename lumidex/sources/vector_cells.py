"""Vectors filed by their nearest centroid, so that a search reads the cells that can hold what it looks for.

Centroids are fitted on a bounded sample, every row is filed. A search takes each query's `probes` best cells, reads these
alone, and scores their rows exactly. With `exact` it goes on: with a cell's radius, the greatest distance of a row to its centroid, no
row of it can score more than q.c + |q| radius, so cells for which this doesn't reach a query's last place are left out, and all
others are read. The answer is then that of a scan. Without, recall is measured in the tests.

Defined results: rows without a vector aren't filed; ties go by id; a table of fewer rows than cells has as many cells as
rows; an empty table or query set gives an empty result. `build` and `search` run jobs when they are called.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.vectors import FOUND, blocks, matrix, whole

CELLS, SAMPLE, ROUNDS, PROBES = 64, 20_000, 12, 8


def centroids(vectors: DataFrame, cells: int = CELLS, sample: int = SAMPLE) -> np.ndarray:
    """Centres of k-means on the `sample` rows of the lowest hashes of their id."""
    some = vectors.where("embedding is not null").orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample)
    v = whole(some.select("vec_id", "embedding"))[1]
    if not len(v):
        return np.zeros((0, 0))
    draw = np.random.default_rng(7)
    c = v[draw.permutation(len(v))[:cells]]
    for _ in range(ROUNDS):
        near = _nearest(v, c)
        for k in range(len(c)):
            own = v[near == k]
            c[k] = own.mean(axis=0) if len(own) else v[draw.integers(len(v))]
    return c


def _nearest(v: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.argmin((c**2).sum(axis=1) - 2 * v @ c.T, axis=1)


def build(vectors: DataFrame, root: str, cells: int = CELLS, sample: int = SAMPLE) -> None:
    """File all rows of (vec_id, embedding) under a folder, and their centroids and radii beside them."""
    c = centroids(vectors, cells, sample)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v = matrix(b.column(1))
            if len(v):
                near = _nearest(v, c)
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(near.astype(np.int32)), pa.array(np.sqrt(((v - c[near]) ** 2).sum(axis=1)))], names=["vec_id", "embedding", "cell", "far"])

    known = vectors.where("embedding is not null").select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<float>"))
    filed = known.mapInArrow(run, "vec_id long, embedding array<float>, cell int, far double").hint("rebalance", "cell")
    filed.write.mode("overwrite").partitionBy("cell").parquet(f"{root}/rows")
    spark = vectors.sparkSession
    radii = spark.read.schema("far double, cell int").parquet(f"{root}/rows").groupBy("cell").agg(F.max("far").alias("radius"))
    centres = spark.createDataFrame([(k, x.tolist()) for k, x in enumerate(c)], "cell int, centre array<double>")
    centres.join(radii, "cell").coalesce(1).write.mode("overwrite").parquet(f"{root}/cells")  # CELLS rows


def _cells(spark: SparkSession, root: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    got = spark.read.schema("cell int, centre array<double>, radius double").parquet(f"{root}/cells").toArrow().sort_by("cell").combine_chunks()
    return got["cell"].to_numpy(), matrix(got["centre"].combine_chunks()) if got.num_rows else np.zeros((0, 0)), got["radius"].to_numpy()


def _read(spark: SparkSession, root: str, ids: np.ndarray, q: np.ndarray, asked: np.ndarray, cells: np.ndarray, k: int) -> DataFrame:
    """The best `k` of each query in the cells that it asks for (query x cell), of each batch."""
    place = {int(c): j for j, c in enumerate(cells)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own = b.column(2).to_numpy()
            for cell in np.unique(own):
                part = b.filter(pa.array(own == cell))
                who = np.flatnonzero(asked[:, place[int(cell)]])
                vec, score = part.column(0).to_numpy(), matrix(part.column(1)) @ q[who].T
                order = np.argsort(vec, kind="stable")
                vec, score = vec[order], score[order]
                best = np.argsort(-score, axis=0, kind="stable")[:k]
                j = np.broadcast_to(np.arange(len(who)), best.shape)
                yield pa.RecordBatch.from_arrays([pa.array(ids[who][j.ravel()]), pa.array(vec[best.ravel()]), pa.array(score[best.ravel(), j.ravel()])], names=["query_id", "vec_id", "score"])

    wanted = [int(c) for j, c in enumerate(cells) if asked[:, j].any()]
    rows = spark.read.schema("vec_id long, embedding array<float>, far double, cell int").parquet(f"{root}/rows").where(F.col("cell").isin(wanted))
    return rows.select("vec_id", "embedding", "cell").mapInArrow(run, FOUND)


def _best(found: DataFrame, k: int) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("place", place).where(F.col("place") <= k)


def search(spark: SparkSession, root: str, queries: DataFrame, k: int, probes: int = PROBES, exact: bool = False) -> DataFrame:
    """(query_id, vec_id, score, place): the `k` best rows of each query of (vec_id, embedding), of its `probes` best cells or, with `exact`, of all."""
    cells, c, radius = _cells(spark, root)
    out = None
    for ids, q in blocks(queries) if len(cells) else ():
        score = q @ c.T
        bound = score + np.sqrt((q**2).sum(axis=1))[:, None] * radius
        asked = np.zeros(score.shape, bool)
        np.put_along_axis(asked, np.argsort(-score, axis=1, kind="stable")[:, :probes], True, axis=1)
        found = _best(_read(spark, root, ids, q, asked, cells, k), k)
        if exact:
            last = {r["query_id"]: r["score"] for r in found.where(F.col("place") == k).select("query_id", "score").collect()}  # a row for each query of the block
            level = np.array([last.get(i, -np.inf) for i in ids.tolist()])
            more = ~asked & (bound >= level[:, None] - 1e-9)
            if more.any():
                found = _best(found.drop("place").unionByName(_read(spark, root, ids, q, more, cells, k)), k)
        out = found if out is None else out.unionByName(found)
    return spark.createDataFrame([], f"{FOUND}, place int") if out is None else out
