"""The live index as base and log, and index tables filed by path."""

import random
import re
from pathlib import Path

from lumidex.operators import tables
from lumidex.sources import index_table
from lumidex.streaming import live_index

ROWS = live_index.ROWS


def play(batches):
    """What a list of batches leaves, one record after the other."""
    state = {}
    for batch in batches:
        trees = [(d, t) for _, d, _, _, t, a in batch if a == "tree" and d is not None]
        below = lambda d, root: d == root or d.startswith(root.rstrip("/") + "/")
        last = {}
        for i, d, n, s, t, a in batch:
            if d is not None and a in ("put", "gone") and (d, n) not in last or a in ("put", "gone") and d is not None and (t, i or 0) >= (last[d, n][2], last[d, n][0] or 0):
                last[d, n] = (i, s, t, a)
        last = {k: v for k, v in last.items() if not any(below(k[0], d) and v[2] < t for d, t in trees)}
        state = {k: v for k, v in state.items() if not any(below(k[0], d) for d, _ in trees)}
        for k, (i, s, t, a) in last.items():
            if a == "gone":
                state.pop(k, None)
            else:
                state[k] = (state[k][0] if k in state else i, s, t)
    return sorted((i, d, n, s, t) for (d, n), (i, s, t) in state.items())


def random_batches(n, seed):
    rng, out, number = random.Random(seed), [], 0
    for _ in range(n):
        batch = []
        for _ in range(rng.randrange(12)):
            number += 1
            d = rng.choice(["/a", "/a/b", "/a/b/c", "/ab", "/", None])
            batch.append((number, d, rng.choice("xyz"), rng.randrange(9), 10 * len(out) + rng.randrange(9), rng.choice(["put", "put", "put", "gone", "other"])) if rng.random() < 0.85 else (None, d, "", None, 10 * len(out) + rng.randrange(9), "tree"))
        out.append(batch)
    return out


def held(spark, root):
    return sorted(map(tuple, live_index.latest(spark, root).select("id", "dir", "name", "size", "mtime").collect()))


def test_batches_replay_and_compaction(spark, tmp_path):
    batches, root = random_batches(9, 5), str(tmp_path / "live")
    assert held(spark, root) == [] and live_index.compact(spark, root) is None
    for k, batch in enumerate(batches):
        rows = spark.createDataFrame(batch, live_index.CHANGES)
        assert live_index.append(spark, root, rows, k)
        if k % 2:  # a batch that is run again
            live_index.append(spark, root, rows, k)
        if k in (3, 6):
            assert live_index.compact(spark, root) == k
            assert not live_index.append(spark, root, rows, k)
        assert held(spark, root) == play(batches[: k + 1]), k
    assert live_index._numbers(spark, root, "base") == [3, 6] and live_index._numbers(spark, root, "log") == [4, 5, 6, 7, 8]
    (tmp_path / "live/log/99").mkdir()  # never committed
    live_index.index_table.forget(spark, f"{root}/base/6")  # as another session would find it
    assert held(spark, root) == play(batches)


def test_bytes_written_follow_the_batch(spark, tmp_path):
    root = str(tmp_path / "live")
    live_index.append(spark, root, spark.range(20_000).selectExpr("id", "'/d' AS dir", "concat('n', id) AS name", "id AS size", "id AS mtime", "'put' AS action"), 0)
    live_index.compact(spark, root)
    live_index.append(spark, root, spark.createDataFrame([(1, "/d", "n5", 1, 30_000, "put")], live_index.CHANGES), 1)
    size = lambda k: sum(f.stat().st_size for f in Path(root, f"log/{k}").rglob("*.parquet"))
    assert size(1) * 50 < size(0)
    assert live_index.latest(spark, root).where("name = 'n5'").first()[:] == (5, "/d", "n5", 1, 30_000)


def exchanges_over(plan, leaf):
    """Whether an Exchange stands over a scan in the text of a plan."""
    lines = plan.splitlines()
    at = next(k for k, x in enumerate(lines) if leaf in x)
    depth, found = len(re.match(r"[\s:|+-]*", lines[at])[0]), []
    for x in reversed(lines[:at]):
        d = len(re.match(r"[\s:|+-]*", x)[0])
        if d < depth:
            depth = d
            found.append(x.strip(" :+-"))
    return [x for x in found if x.startswith(("Exchange", "BroadcastExchange", "ShuffleQueryStage"))]


def test_index_table_is_read_as_it_lies(spark, tmp_path):
    path = str(tmp_path / "index")
    rows = spark.range(500).selectExpr("id", "concat('/d', id % 7) AS dir", "concat('n', id) AS name", "id AS size", "id AS mtime")
    index_table.save(rows, path, 4)
    index_table.forget(spark, path)
    listing = rows.where("id % 3 <> 0").selectExpr("id", "dir", "name", "size + id % 2 AS size", "mtime")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        index = index_table.load(spark, path, ROWS, 4)
        diff = index_table.changes(path, listing, ROWS, 4)
        moved = tables.move(index, listing.limit(5).selectExpr("dir", "name", "'/new' AS to_dir", "name AS to_name"))
        for df in (diff, index.join(listing.select("dir", "name"), ["dir", "name"], "left_anti")):
            plan = df._jdf.queryExecution().executedPlan().toString()
            assert "Bucketed: true" in plan and not exchanges_over(plan, "FileScan"), plan
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    counts = {r.change: r.n for r in diff.groupBy("change").agg({"*": "count"}).toDF("change", "n").collect()}
    assert counts == {"gone": 167, "same": 166, "changed": 167} and moved.count() == 500
