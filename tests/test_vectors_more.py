"""Vector cells, descriptions in groups, bars of measures, whole fixed sets."""

import numpy as np
from pyspark.sql import functions as F

from lumidex.operators import duplicates, measures, vectors
from lumidex.sources import vector_cells


def clustered(n, dim, seed):
    draw = np.random.default_rng(seed)
    v = draw.normal(size=(12, dim))[draw.integers(0, 12, n)] + 0.4 * draw.normal(size=(n, dim))
    return (v / np.linalg.norm(v, axis=1, keepdims=True)).astype(np.float32)


def table(spark, v, first=0):
    return spark.createDataFrame([(first + k, x.tolist()) for k, x in enumerate(v)], "vec_id long, embedding array<float>").repartition(4)


def test_cells_are_exact_or_of_good_recall(spark, tmp_path):
    v = clustered(3000, 16, 1)
    rows = table(spark, v).unionByName(spark.createDataFrame([(9999, None)], "vec_id long, embedding array<float>"))
    vector_cells.build(rows, str(tmp_path / "cells"), 24, 800)
    asked = rows.where("vec_id % 100 = 0")
    score = v[::100].astype(float) @ v.astype(float).T
    want = {(100 * i, int(j)) for i, s in enumerate(score) for j in np.argsort(-s, kind="stable")[:10]}
    near = {(r.query_id, r.vec_id) for r in vector_cells.search(spark, str(tmp_path / "cells"), asked, 10, 4).collect()}
    assert len(near & want) >= 0.9 * len(want)
    found = vector_cells.search(spark, str(tmp_path / "cells"), asked, 10, 1, exact=True)
    assert {(r.query_id, r.vec_id) for r in found.collect()} == want and found.where("place = 1").count() == 30
    vector_cells.build(rows.limit(0), str(tmp_path / "none"))
    assert vector_cells.search(spark, str(tmp_path / "none"), asked, 5).count() == 0
    assert vector_cells.search(spark, str(tmp_path / "cells"), asked.limit(0), 5).count() == 0


def test_fixed_sets_of_several_blocks_are_whole(spark):
    v = clustered(60, 8, 2)
    rows = table(spark, v)
    texts = rows.where("vec_id < 30")
    one, many = (vectors.described(rows, rows.where("vec_id % 9 = 0"), texts, rows.where("vec_id >= 40"), block=b).orderBy("vec_id").collect() for b in (1 << 20, 100))
    assert one == many and any(len(r.subjects) > 1 for r in one)
    whole, cut = (measures.measured(rows, texts, b).count() for b in (1 << 20, 100))
    assert whole == cut == 60 * 30


def test_shares_count_what_is_less():
    s = np.array([[0.3, 0.1, 0.3, 0.2, 0.1]])
    assert measures.transforms(s)["share"].tolist() == [[0.75, 0, 0.75, 0.5, 0]]


def test_bars_are_exact_whatever_the_sketch_says(spark):
    draw = np.random.default_rng(3)
    rows = [(t, float(x)) for t in range(7) for x in np.round(draw.normal(size=50 + 300 * t) * (t + 1), 1)]
    df = spark.createDataFrame(rows, "text_id long, s double").repartition(4)
    for leak in (0.0, 0.05, 0.5, 1.0):
        for accuracy in (3, 10_000):  # a sketch of 3 is mostly wrong
            got = {r.text_id: r.bar for r in measures.quiet_bars(df, "s", leak, accuracy).collect()}
            want = {}
            for t in range(7):
                own = sorted((s for u, s in rows if u == t), reverse=True)
                k = int(len(own) * leak)
                if k < len(own):
                    want[t] = own[k]
            assert got == want, (leak, accuracy)
    assert measures.bar_at(df.limit(0), "s", 0.1) == 0.0


def test_agreement_over_ranges(spark):
    draw = np.random.default_rng(4)
    rows = [(int(draw.integers(0, 3)), float(draw.integers(0, 40)), bool(draw.random() < 0.3)) for _ in range(900)]
    got = {r.text_id: r.auc for r in measures.text_auc(spark.createDataFrame(rows, "text_id long, s double, told boolean").repartition(5), "s", "told").collect()}
    for t in range(3):
        a, b = ([s for u, s, y in rows if u == t and y == told] for told in (True, False))
        assert abs(got[t] - np.mean([(x > y) + (x == y) / 2 for x in a for y in b])) < 1e-12


def plain_description(level, names, own, own_names):
    """The same choice, one phrase at a time."""
    taken, told = [], []
    bare = lambda p: p.removeprefix("a ").removeprefix("an ").removeprefix("the ")
    for k, (name, phrases) in enumerate(names):
        scored = [(x, p) for x, p in zip(level[k], phrases, strict=True)] + ([(x + 0.1, p) for x, p in zip(own, own_names, strict=True)] if not k else [])
        on, off = (2 if name == "light" else 3), 2 + (k == 0)
        for x, p in sorted(scored, key=lambda s: -s[0]):
            if on + off == 0 or any(t in bare(p) or bare(p) in t for t in taken):
                continue
            if x >= 1 and on:
                on -= 1
            elif x >= 0.6 and off:
                off -= 1
            else:
                continue
            taken.append(bare(p))
            told.append((name, p, round(x, 2), x >= 1))
    return told


def test_descriptions_in_groups(spark):
    v = clustered(90, 8, 5)
    words = ["red fox", "a fox", "blue sky", "the sky", "night", "day", "oil", "an oil painting", "soft", "warm", "sea", "lake", "tree", "the tree house"]
    phrase = lambda k: f"{words[k % len(words)]}{'' if k % 4 else f' {k}'}"
    texts = table(spark, v).withColumn("phrase", F.udf(phrase)("vec_id"))
    spans = [("subject", 0, 24), ("setting", 24, 36), ("style", 36, 48), ("light", 48, 60)]
    groups = [(n, texts.where(F.col("vec_id").between(a, b - 1))) for n, a, b in spans]
    got = vectors.described_in_groups(table(spark, v[60:], 60), texts.where("vec_id < 20"), groups, texts.where("vec_id between 60 and 70"))
    d = v.astype(float)
    usual = d @ d[:20].T
    listed = {phrase(k) for k in range(24, 60)}
    mine = [k for k in range(60, 71) if phrase(k) not in listed]
    for r in got.collect():
        lv = lambda a, r=r: vectors.levels(d[[r.vec_id]] @ d[a].T, usual[[r.vec_id]])[0].tolist()
        want = plain_description([lv(list(range(a, b))) for _, a, b in spans], [(n, [phrase(k) for k in range(a, b)]) for n, a, b in spans], lv(mine), [phrase(k) for k in mine])
        assert [(g.name, p.text, p.level, p.clear) for g in r.groups for p in g.phrases] == want
        assert r.prompt == ", ".join(p for _, p, _, c in want if c)


def test_a_given_list_is_one_group(spark):
    ids = spark.createDataFrame([(3,), (1,), (1,), (None,)], "id long")
    assert sorted(map(tuple, duplicates.given(ids).collect())) == [(1, 1, 2), (3, 1, 2)]
    assert duplicates.given(ids.where("id = 1")).count() == 0
    rows = spark.createDataFrame([(1, 0, 2, 5.0, 1, 2, 9.0), (3, 0, 0, None, None, None, 9.0)], "id long, rating int, flag int, likely double, seen int, checked int, sharpness double")
    best = duplicates.report(duplicates.given(ids), rows).where("best").first()
    assert best.id == 3 and tuple(best.why) == (None, False, None, None, None, True)
