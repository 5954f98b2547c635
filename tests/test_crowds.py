"""Near-duplicates where many pictures share a band of bits."""

import numpy as np
from pyspark.sql import functions as F

from lumidex.checkpoints import cut
from lumidex.operators import duplicates


def flat(spark, n, seed, across_bits=20, down_bits=64):
    """Pictures that share all but a few bits of one hash."""
    draw = np.random.default_rng(seed)
    across, down = draw.integers(0, 1 << across_bits, n), draw.integers(-(2**63), 2**63 - 1, n)
    near = draw.integers(0, n, n // 3)  # copies up to 14 bits apart
    a, d = across[near].copy(), down[near].copy()
    for k in range(len(near)):
        for b in draw.permutation(128)[: int(draw.integers(1, 15))]:
            if b < 64:
                a[k] ^= np.int64(1 << int(b)) if b < 63 else np.int64(-(1 << 63))
            else:
                d[k] ^= np.int64(1 << int(b - 64)) if b < 127 else np.int64(-(1 << 63))
    across, down = np.concatenate([across, a]), np.concatenate([down, d])
    rows = [(k, int(x), int(y), 9, 9, 9, 400, 300) for k, (x, y) in enumerate(zip(across, down, strict=True))]
    return across, down, spark.createDataFrame(rows, "id long, across long, down long, r int, g int, b int, width int, height int").repartition(4)


def nodes(pictures):
    return pictures.withColumn("shape", F.col("width") / F.col("height")).groupBy(*duplicates.LOOK).agg(F.min("id").alias("node"))


def test_levels_cut_all_bits():
    for level in range(len(duplicates.STRIDES) + 1):
        for most in (0, 5, 12):
            found = duplicates.splits(level, most)
            assert len(found) > most // 2 and sorted(x for band in found for x in band) == sorted((n, k) for n in ("across", "down") for k in range(64))


def test_crowded_bands_lose_nothing(spark):
    across, down, pictures = flat(spark, 900, 4)
    bits = np.bitwise_count((across[:, None] ^ across).astype(np.uint64)).astype(int) + np.bitwise_count((down[:, None] ^ down).astype(np.uint64))
    first = {}
    low = np.array([first.setdefault(x, k) for k, x in enumerate(zip(across.tolist(), down.tolist(), strict=True))])
    want = {(min(low[i], low[j]), max(low[i], low[j])) for i, j in zip(*np.nonzero(bits <= 12), strict=True) if low[i] != low[j]}
    for crowd in (10, 60, 10**6):
        got = {(r.u, r.v) for r in duplicates.links(nodes(pictures), crowd=crowd).collect()}
        assert got == want and len(want) > 200, crowd


def test_no_bucket_stays_crowded(spark):
    """Of many pictures that share one whole band, buckets after cutting are small."""
    _, _, pictures = flat(spark, 6000, 5)
    filed = nodes(pictures).select("node", F.struct(*duplicates.LOOK).alias("look"), F.lit(0).cast("long").alias("path"))
    most = lambda rows: rows.groupBy("path").count().agg(F.max("count")).first()[0]
    whole = cut(duplicates._filed(cut(filed), 0, 12, False))
    assert most(whole) >= 6000
    crowded = whole.groupBy("path").count().where("count > 100").select("path")
    assert most(duplicates._filed(whole.join(crowded, "path", "left_semi"), 1, 12, False)) < 1200
