"""SimHash near-duplicates by meet-in-the-middle ball hashing.

A fingerprint bit is 1 if it is set in more than half of the XXH64 values (seed
42) of the text's 3-word shingles, repeats included. Two fingerprints within
radius 2 share a variant at distance 1 from both: each distinct fingerprint emits
itself and its 64 one-bit variants, the shuffle brings equal variants together,
and members of such a group (65 at most, all within radius 2 of each other) are
linked to the group's smallest; links are made distinct and verified by their
bit count. Documents with one fingerprint are merged before anything is emitted,
so a group of copies costs no more than one document.

Defined results: null and empty texts and texts without words have fingerprint 0,
which links like any other; texts of one or two words have one shingle, the whole
sequence. Rows of a repeated id are each given their own fingerprint. A null id
never becomes a component's id unless the component has no other. Empty input
gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import arrow_text
from ..operators.components import roots
from .shared import cut, numbered

SHINGLE, SEED, RADIUS, SPREAD = 3, 42, 2, 50_000
_LANES = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").copy().view(np.uint64).ravel()


def fingerprints(column: pa.Array) -> np.ndarray:
    """The 64-bit fingerprint of every row, as unsigned integers."""
    body, offsets = arrow_text.raw(column)
    upper = (body >= 65) & (body <= 90)
    words = arrow_text.joined(arrow_text.split(body + upper.astype(np.uint8) * np.uint8(32), offsets))
    n = words.counts
    shingles = np.where(n >= SHINGLE, n - SHINGLE + 1, np.minimum(n, 1))
    upto = np.concatenate([[0], np.cumsum(shingles)])
    row = np.repeat(np.arange(len(n)), shingles)
    begin = words.first[row] + np.arange(upto[-1]) - upto[row]
    last = begin + np.minimum(n[row], SHINGLE) - 1
    text, digest = words.body.tobytes(), xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(text[s:e], SEED) for s, e in zip(words.start[begin].tolist(), words.end[last].tolist(), strict=True)), np.uint64, len(row))
    # bit counts: eight counters of one byte side by side, summed over at most 255 shingles at a time
    parts = -(-shingles // 255)
    owner = np.repeat(np.arange(len(n)), parts)
    first = upto[owner] + 255 * (np.arange(len(owner)) - np.concatenate([[0], np.cumsum(parts)])[owner])
    out = np.zeros((len(n), 8), np.uint8)
    if len(owner):
        eight = hashes.astype("<u8").view(np.uint8).reshape(-1, 8)
        starts = np.flatnonzero(np.diff(owner, prepend=-1))
        for k in range(8):
            sums = np.add.reduceat(_LANES[eight[:, k]], first).astype("<u8").view(np.uint8).reshape(-1, 8)
            counts = np.add.reduceat(sums.astype(np.int64), starts, axis=0)
            out[owner[starts], k] = np.packbits(2 * counts > shingles[owner[starts], None], axis=1, bitorder="little")[:, 0]
    return out.view("<u8").ravel()


def _fingerprint_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in arrow_text.slices(batches, limit=2 << 20):
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fingerprints(b.column(1)).view(np.int64))], names=["doc_id", "fp"])


def fingerprint_table(docs: DataFrame) -> DataFrame:
    """(doc_id, fp) of every row; fp is the fingerprint's bit pattern as a signed long."""
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_fingerprint_batches, "doc_id long, fp long")


def links(distinct: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Links (u, v) that connect every two of the distinct fingerprints within `radius` bits (0 to 2), directly or over a third."""
    flips = [0, *(1 << k if k < 63 else -(1 << 63) for k in range(64))] if radius > 1 else [0]
    if radius == 1:  # one side flips, the other does not
        flips = [0, *(1 << k if k < 63 else -(1 << 63) for k in range(64))]
    masks = F.array(*[F.lit(x).cast("long") for x in flips])
    sent = distinct.select("fp", F.explode(F.transform(masks, lambda m: F.col("fp").bitwiseXOR(m))).alias("variant"))
    groups = sent.groupBy("variant").agg(F.array_sort(F.collect_list("fp")).alias("fps")).where(F.size("fps") > 1)
    if radius == 1:  # members may be two bits apart; only the variant itself is one bit from each
        pairs = groups.where(F.array_contains("fps", F.col("variant"))).select(F.col("variant").alias("u"), F.explode("fps").alias("v"))
    else:
        pairs = groups.select(F.element_at("fps", 1).alias("u"), F.explode(F.slice("fps", 2, len(flips))).alias("v"))
    return pairs.where("u <> v").distinct().where(F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= radius)


def classes(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """One row per document: doc_id, fp and component_id, the smallest id that links reach."""
    fps = cut(fingerprint_table(docs))
    nodes = fps.groupBy("fp").agg(F.min("doc_id").alias("low"))
    # each fingerprint becomes 65 rows, so they are spread by their number before that, whatever few bytes they are now
    nodes = cut(nodes)
    spread = max(int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-nodes.count() // SPREAD))
    tree = roots(links(nodes.select("fp").repartition(spread, "fp"), radius))
    placed = nodes.join(tree, nodes.fp == tree.node, "left").select("fp", "low", F.coalesce("root", "fp").alias("root"))
    least = placed.groupBy("root").agg(F.min("low").alias("component_id"))
    named = placed.join(least, "root").select("fp", "component_id")
    return fps.join(named, "fp", "left").select("doc_id", "fp", "component_id")


def hexed(fp):
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


def dedup(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """The input with all columns, but of each component only one row: that of the smallest id (null last), then of the smallest text."""
    own = numbered(docs, "rows")
    doc, text = own.at("doc_id").cast("long").alias("id"), own.at("text").alias("text")
    found = classes(own.rows.select(F.col("row").alias("doc_id"), text), radius).select(F.col("doc_id").alias("row"), F.col("component_id").alias("part"))
    # short stand-ins for rows travel; texts decide only between rows of one id
    placed = cut(own.rows.select("row", doc).join(found, "row"))
    order = F.struct(F.col("id").isNull().alias("void"), "id")
    least = placed.groupBy("part").agg(F.min(order).alias("x")).select("part", F.col("x.id").alias("least"))
    ties = placed.join(least, "part").where(F.col("id").eqNullSafe(F.col("least"))).groupBy("part").agg(F.count("*").alias("n"), F.min("row").alias("row"), F.first("least").alias("least"))
    clear = ties.where("n = 1").select("row")
    tied = placed.join(ties.where("n > 1").select("part", "least"), "part").where(F.col("id").eqNullSafe(F.col("least"))).select("row", "part")
    chosen = own.rows.select("row", text).join(tied, "row").groupBy("part").agg(F.min_by("row", F.struct(F.coalesce("text", F.lit("")), "row")).alias("row")).select("row")
    return own.back(own.rows.join(clear.union(chosen), "row", "left_semi"))
