"""Connected components of a table of links, by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..checkpoints import cut


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Every node links what it sees to the smallest node it sees: its larger neighbours (large) or itself and its smaller ones."""
    if large:
        seen = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = seen.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        return seen.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
    seen = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    low = seen.groupBy("u").agg(F.min("v").alias("m"))
    moved = seen.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(low.select("u", F.col("m").alias("v"))).distinct()


def roots(links: DataFrame, rounds: int = 60) -> DataFrame:
    """(u, v) links of orderable nodes -> (node, root): every linked node that isn't itself the smallest of its component.

    Self links and repeated links are allowed; null nodes are dropped. Each round is
    written with checkpoint(); the driver sees two numbers a round.
    """
    edges = cut(links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    mark = lambda e: tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
    last = mark(edges)
    for _ in range(rounds):
        if not last[0]:
            break
        edges = cut(_star(_star(edges, True), False))
        now = mark(edges)
        if now == last:
            break
        last = now
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
