"""Near-duplicate pictures by perceptual hashes: candidates share most of a band of bits and nearly their shape; links are verified, then joined to groups.

Two hashes of 64 bits together may differ in `BITS` bits, no colour channel by more than
`COLOUR`, and width over height by a share of `SHAPE`. The bits are cut into so many bands that
one of them differs in one bit at most; each picture is filed under its bands and looks under
each band and its one-bit variants, among pictures of its class of shape or the next. Pictures
equal in all of this are one node, so a group of copies costs as much as one picture. Crowded buckets, as
flat pictures make them, are cut by bands of other bits.
Defined results: pictures without a fingerprint or a size are in no group; a null id is nobody's;
groups of one aren't told; an empty table gives an empty result.
"""

from __future__ import annotations

from math import log

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..checkpoints import cut
from .components import roots

# How far apart near-duplicates may be.
BITS, COLOUR, SHAPE = 12, 24, 0.02
#: Pictures of a bucket from which on it is cut further, and the orders in which the bits are dealt then.
CROWD, STRIDES = 500, (37, 59, 83)
LOOK = ["across", "down", "r", "g", "b", "shape"]


def fingerprints(vectors: DataFrame) -> DataFrame:
    """(id, across, down, r, g, b, width, height): bits tell whether an element is greater than another, as difference hashes do with pixels."""

    def bits(step: int) -> Column:
        one = F.lit(1).cast("long")
        greater = lambda i: F.get("embedding", i) > F.get("embedding", (i + step) % 64)
        return F.aggregate(F.sequence(F.lit(0), F.lit(62)), F.lit(0).cast("long"), lambda out, i: F.when(greater(i), out.bitwiseOR(F.call_function("shiftleft", one, i))).otherwise(out))

    channel = lambda k: F.greatest(F.lit(0), F.least(F.lit(255), F.floor(128 + 200 * F.get("embedding", F.lit(k)).cast("double")))).cast("int")
    size = lambda n: (512 + 64 * (F.col("vec_id") % n)).cast("int")
    return vectors.select(F.col("vec_id").alias("id"), bits(1).alias("across"), bits(9).alias("down"), channel(0).alias("r"), channel(1).alias("g"), channel(2).alias("b"), size(2).alias("width"), size(3).alias("height"))


def distance(a: str, b: str) -> Column:
    return F.bit_count(F.col(f"{a}.across").bitwiseXOR(F.col(f"{b}.across"))) + F.bit_count(F.col(f"{a}.down").bitwiseXOR(F.col(f"{b}.down")))


def bands(most: int) -> list[tuple[str, int, int]]:
    """(hash, first bit, width) of bands such that two hashes `most` bits apart have a band with one differing bit at most."""
    n = most // 2 + 1
    half = -(-n // 2)
    out = []
    for name, many in (("across", half), ("down", max(1, n - half))):
        edges = [64 * k // many for k in range(many + 1)]
        out += [(name, a, b - a) for a, b in zip(edges, edges[1:], strict=False)]
    return out


def splits(level: int, most: int) -> list[list[tuple[str, int]]]:
    """Bands as lists of (hash, bit). Level 0 has runs of bits; further levels deal all 128 bits anew, each in another order, so bits that
    many flat pictures share in one band are spread over others."""
    if not level:
        return [[(name, first + k) for k in range(width)] for name, first, width in bands(most)]
    order = [(STRIDES[level - 1] * i + 11 * level) % 128 for i in range(128)]
    n = most // 2 + 1
    edges = [128 * k // n for k in range(n + 1)]
    return [[("across" if i < 64 else "down", i % 64) for i in order[a:b]] for a, b in zip(edges, edges[1:], strict=False)]


def _bits(band: list[tuple[str, int]], look: Column) -> Column:
    """The bits of a band, side by side."""
    out = F.lit(0).cast("long")
    for k, (name, bit) in enumerate(band):
        out = out.bitwiseOR(F.shiftleft(F.shiftrightunsigned(look[name], bit).bitwiseAND(F.lit(1).cast("long")), k))
    return out


def _filed(rows: DataFrame, level: int, most: int, near: bool) -> DataFrame:
    """Rows of (node, look, path), one for each bucket of the level."""
    held = rows
    for k, band in enumerate(splits(level, most)):
        held = held.withColumn(f"_b{k}", _bits(band, F.col("look")))
    width = [len(band) for band in splits(level, most)]
    lists = []
    for k, n in enumerate(width):
        flips = [0, *(1 << j if j < 63 else -(1 << 63) for j in range(n))] if near else [0]
        lists.append(F.array(*[F.xxhash64("path", F.lit(64 * level + k), F.col(f"_b{k}").bitwiseXOR(F.lit(f).cast("long"))) for f in flips]))
    return held.select("node", "look", F.explode(F.concat(*lists)).alias("path"))


def links(prints: DataFrame, most: int = BITS, colour: int = COLOUR, shape: float = SHAPE, crowd: int = CROWD) -> DataFrame:
    """(u, v) of nodes, which are the numbers of `nodes`, that are near each other; each pair once.

    A bucket of more than `crowd` pictures is cut further, by bands of other bits: within the distance two pictures
    have nearly equal bits in some band of every way to cut them, so none is lost. Runs a job for each level.
    """
    step = log(1 + shape)
    filed = prints.withColumn("class", F.floor(F.log("shape") / step)).withColumn("look", F.struct(*LOOK))
    here = _filed(filed.select("node", "look", F.xxhash64("class").alias("path")), 0, most, False)
    asks = _filed(filed.select("node", "look", F.explode(F.array(F.col("class"), F.col("class") + 1)).alias("c")).select("node", "look", F.xxhash64("c").alias("path")), 0, most, True)
    near = distance("x", "y") <= most
    for c in "rgb":
        near = near & (F.abs(F.col(f"x.{c}") - F.col(f"y.{c}")) <= colour)
    low, high = F.least("x.shape", "y.shape"), F.greatest("x.shape", "y.shape")
    out = None
    for level in range(len(STRIDES) + 1):
        crowded = None
        if level < len(STRIDES):
            crowded = cut(here.groupBy("path").agg(F.count("*").alias("n")).where(F.col("n") > crowd).select("path"))
            crowded = None if crowded.isEmpty() else crowded
        mine = here if crowded is None else here.join(crowded, "path", "left_anti")
        met = asks.select(F.col("node").alias("u"), F.col("look").alias("x"), "path").join(mine.select(F.col("node").alias("v"), F.col("look").alias("y"), "path"), "path")
        pairs = met.where(F.col("u") != F.col("v")).where(near & (high <= low * (1 + shape))).select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()
        out = pairs if out is None else out.unionByName(pairs)
        if crowded is None:
            break
        here = cut(_filed(here.join(crowded, "path", "left_semi"), level + 1, most, False))
        asks = _filed(asks.join(crowded, "path", "left_semi").distinct(), level + 1, most, True)
    return out.distinct()


def groups(pictures: DataFrame, most: int = BITS, colour: int = COLOUR, shape: float = SHAPE) -> DataFrame:
    """(id, group_id, members) of pictures in a group of two or more; a group is named by its smallest id."""
    known = pictures.where("across is not null and down is not null and width > 0 and height > 0 and id is not null").withColumn("shape", F.col("width") / F.col("height"))
    nodes = known.groupBy(*LOOK).agg(F.min("id").alias("node"))
    tree = roots(links(nodes, most, colour, shape))
    placed = nodes.join(tree, "node", "left").select(*LOOK, F.coalesce("root", "node").alias("group_id"))
    each = known.select("id", *LOOK).join(placed, LOOK).select("id", "group_id")
    sizes = each.groupBy("group_id").agg(F.count("*").alias("members")).where("members > 1")
    return each.join(sizes, "group_id").select("id", "group_id", "members")


def given(ids: DataFrame) -> DataFrame:
    """(id, group_id, members) of a given list of ids as one group, named by its smallest; fewer than two are no group."""
    own = ids.where("id is not null").select("id").distinct()
    one = own.agg(F.min("id").alias("group_id"), F.count("*").alias("members")).where("members > 1")
    return own.crossJoin(F.broadcast(one))  # one row


def report(found: DataFrame, rows: DataFrame) -> DataFrame:
    """Members of groups (`groups` or `given`), whether each is its group's best, and of the best why (see `vectors.best_of`)."""
    from .vectors import best_of

    marked = cut(found.join(rows, "id"))
    best = best_of(marked, "group_id").select("group_id", F.col("id").alias("_best"), F.col("why").alias("_why"))
    told = marked.join(best, "group_id").withColumn("best", F.col("id") == F.col("_best"))
    return told.withColumn("why", F.when(F.col("best"), F.col("_why"))).drop("_best", "_why")
