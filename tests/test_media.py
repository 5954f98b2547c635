"""The registered queries against their SQL, and small cases of the operators."""

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from lumidex import queries
from lumidex.functions import facets as FA
from lumidex.functions import text as T
from lumidex.operators import audience, duplicates, measures, tables, taste, usage, vectors, works
from lumidex.plans import search as S
from lumidex.sources import files, store
from lumidex.sources.tables import media
from lumidex.streaming import live_index

SF = "/root/testdata/sf0.001"
NAMES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for n in NAMES:
        con.execute(f"CREATE VIEW {n} AS SELECT * FROM read_parquet('{SF}/{n}.parquet')")
    return con


def flat(rows):
    return sorted((tuple(round(v, 5) if isinstance(v, float) else v for v in r) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_sql(spark, duck, name):
    df = queries.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = flat(tuple(r[c] for c in cols) for r in df.collect())
    want = flat(duck.execute(f"SELECT {', '.join(cols)} FROM ({queries.ORACLE_SQL[name]})").fetchall())
    assert got == want
    assert got


@pytest.mark.parametrize(
    ("text", "needle", "first", "count"),
    [("a fox, fox!", "fox", 2, 2), ("foxes fox", "fox", 6, 1), ("foxes", "fox*", 0, 1), ("outfox", "*fox", 3, 1), ("été fox", "fox", 6, 1), ("лиса и лис", "лис", 12, 1), ("赤い狐です", "狐", 6, 1), ("none", "fox", None, 0), ("a.b a.b", "a.b", 0, 2), ("foxfox fox", "fox", 7, 1), ("+1 +1", "+1", 0, 2)],
)
def test_word_matching(spark, text, needle, first, count):
    row = spark.range(1).select(T.first_byte(F.lit(text), needle).alias("f"), T.count_words(F.lit(text), needle).alias("c"), T.has_word(F.lit(text), needle).alias("h")).first()
    assert (row.f, row.c, row.h) == (first, count, first is not None)


def test_relevance_goes_by_place(spark):
    rows = [(1, "fox at the start", "n1", "", ""), (2, "much later there is a fox", "n2", "", ""), (3, "fox and fox and fox", "n3", "", ""), (4, "nothing", "foxglove", "", ""), (5, "nothing", "n5", "fox", ""), (6, "foxes only", "n6", "", ""), (7, "nothing", "n7", "", "fox tool")]
    df = spark.createDataFrame(rows, "id long, prompt string, name string, negative string, source string").selectExpr("*", "'' AS model", "cast(array() as array<struct<name:string,weight:double>>) AS loras", "0L AS mtime", "cast(array() as array<struct<kind:string,name:string>>) AS models", "'' AS seed", "cast(array() as array<struct<key:string,value:string>>) AS params")
    found = S.Search(ranked=["fox"]).sorted(df).select("id", "score").collect()
    assert [r.id for r in found] == [3, 1, 2, 4, 7, 5] and [r.score for r in found][3:] == [40.0, 20.0, 10.0]


def test_wrong_values_match_nothing(spark):
    rows = spark.createDataFrame([(1,)], "mtime long").selectExpr("*", "0 AS kind", "0 AS flag", "0 AS rating")
    for c in (S.dates("2024-13"), S.dates("x"), S.kind("sculpture"), S.flagged("maybe")):
        assert rows.where(c).count() == 0 and rows.where(~c).count() == 1
    assert rows.where(S.unrated()).count() == 1


def test_natural_order_of_any_length(spark):
    names = ["img2", "img10", "IMG0003", "img" + "9" * 25, "img" + "9" * 24 + "8", "img1" + "0" * 25]
    keys = dict(spark.createDataFrame([(n,) for n in names], "n string").select("n", T.natural_key(F.col("n")).alias("k")).collect())
    assert sorted(names, key=keys.get) == ["img2", "IMG0003", "img10", "img" + "9" * 24 + "8", "img" + "9" * 25, "img1" + "0" * 25]


def test_phrases(spark):
    cases = {
        "a (red fox:1.2), [blue] sky. {x} <lora:y:1> best_quality|end": ["a red fox", "blue sky", "x", "best quality", "end"],
        r"fox \(animal\), 8k, embedding:z, -cat-, cat": ["fox (animal)", "8k", "cat"],
        "ratio 3:4, time: now": ["ratio 3", "time: now"],
        "": [],
    }
    for text, want in cases.items():
        assert spark.range(1).select(T.prompt_phrases(F.lit(text)).alias("p")).first().p == want
    row = spark.range(1).select(T.is_quality_phrase(F.lit("Best-Quality 8")).alias("a"), T.is_quality_phrase(F.lit("best fox")).alias("b"), T.prompt_words(F.lit("the cat's 123 4x4 <lora:abc:1> and été")).alias("w")).first()
    assert (row.a, row.b, sorted(row.w)) == (True, False, ["4x4", "cat", "été"])


def test_names_and_marks_of_the_library(spark, tmp_path):
    docs = spark.createDataFrame([(1234567, "A", "en", "s", 1), (123456, None, "en", "s", 0)], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "b", "t", 3)], "p_partkey long, p_brand string, p_type string, p_size int").write.parquet(f"{tmp_path}/part.parquet")
    spark.createDataFrame([(123456, 1, 0), (123456, 1, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    rows = {r.id: r for r in media(spark, str(tmp_path)).collect()}
    assert {i: r["name"] for i, r in rows.items()} == {1234567: "doc_1234567", 123456: "doc_123456"}
    assert rows[123456].rating == 2 and rows[123456].prompt == ""


def test_facets(spark):
    row = [("a", [("main", "My  Model"), ("vae", "V")], [("L", 0.8), ("L", 0.8), ("K", None)], [("Steps", "20.0"), ("CFG Scale", "7.50"), ("Sampler", "Euler a")], 832, 1216, "Tool")]
    df = spark.createDataFrame(row, "id string, models array<struct<kind:string,name:string>>, loras array<struct<name:string,weight:double>>, params array<struct<key:string,value:string>>, width int, height int, source string")
    found = [tuple(f) for f in FA.with_facets(df).first().facets]
    assert found == [("model", "my model", "My Model", ""), ("aux", "v", "V", "vae"), ("lora", "l", "L", ""), ("lora", "k", "K", ""), ("loraw", "l@0.8", "L@0.8", ""), ("sampler", "euler a", "Euler a", ""), ("steps", "20", "20", ""), ("cfg", "7.5", "7.5", ""), ("size", "832x1216", "832x1216", ""), ("source", "tool", "Tool", "")]
    yes = [S.facet("steps", "20"), S.facet("cfg", "7.5"), S.model("V", exact=True), S.facet("size", "832 × 1216", exact=True), ~S.facet("steps", "2"), ~S.facet("steps", "|"), S.lora("k", exact=True)]
    rows = FA.with_facets(df)
    assert all(rows.where(c).count() == 1 for c in yes)


def test_moves_and_notes(spark):
    index = spark.createDataFrame([(1, "/a", "x"), (2, "/a", "y"), (3, "/b", "z")], "id long, dir string, name string")
    moved = tables.move(index, spark.createDataFrame([("/a", "x", "/b", "z")], "dir string, name string, to_dir string, to_name string"))
    assert sorted(map(tuple, moved.collect())) == [(1, "/b", "z"), (2, "/a", "y")]
    notes = spark.createDataFrame([("/a", "x", 3, 0, ["Best", "old"]), ("/a", "y", 1, 0, [])], "dir string, name string, rating int, flag int, collections array<string>")
    change = spark.createDataFrame([("/a", "x", None, 1, ["best", "new  one"], ["OLD"]), ("/a", "y", 0, None, [], [])], "dir string, name string, rating int, flag int, add array<string>, drop array<string>")
    assert [tuple(r) for r in tables.change_notes(notes, change).collect()] == [("/a", "x", 3, 1, ["Best", "new one"])]
    kept = tables.prune_notes(spark.createDataFrame([("/a", "x"), ("/a", "gone"), ("/c", "q")], "dir string, name string"), index)
    assert sorted(map(tuple, kept.collect())) == [("/a", "x"), ("/c", "q")]
    left, said = tables.forget(index, notes, spark.createDataFrame([("/a", "x")], "dir string, name string"))
    assert sorted(r.id for r in left.collect()) == [2, 3] and [r.name for r in said.collect()] == ["y"]
    same, change = tables.reconcile(index.selectExpr("*", "1L AS size", "1L AS mtime"), index.limit(0).selectExpr("*", "1L AS size", "1L AS mtime"), readable=False)
    assert same.count() == 3 and {r.change for r in change.collect()} == {"same"}
    ledger, now = spark.createDataFrame([("/a", 1, 1), ("/b", 1, 1)], "dir string, mtime long, size long"), spark.createDataFrame([("/a", 1, 1), ("/b", 2, 1), ("/c", 1, 1)], "dir string, mtime long, size long")
    assert sorted(r.dir for r in tables.changed_files(ledger, now).collect()) == ["/b", "/c"]
    read = spark.createDataFrame([("/a", True), ("/b", True), ("/c", False), ("/d", True)], "dir string, readable boolean")
    old = spark.createDataFrame([("/a", "x", 3), ("/b", "z", 1), ("/c", "q", 2), ("/d", "r", 4)], "dir string, name string, rating int")
    new = spark.createDataFrame([("/a", "x", 3), ("/b", "z", 2)], "dir string, name string, rating int")
    after, differs = tables.reloaded(old, read, new)
    assert sorted(map(tuple, after.collect())) == [("/a", "x", 3), ("/b", "z", 2), ("/c", "q", 2)] and sorted(r.dir for r in differs.collect()) == ["/b", "/d"]
    with pytest.raises(Exception, match="unknown flag"):
        tables.batch_notes(notes, spark.createDataFrame([("/a", "x", 1, None, 7, [], [])], "dir string, name string, at int, rating int, flag int, add array<string>, drop array<string>")).collect()


def test_duplicates_at_the_exact_distance(spark):
    draw = np.random.default_rng(3)
    rows, want = [], set()
    for k in range(40):
        a, d = (int(x) for x in draw.integers(-(2**63), 2**63 - 1, 2))
        n = 12 + k % 2
        flips = draw.permutation(128)[:n].tolist()
        b, e = a, d
        for f in flips:
            if f < 64:
                b ^= 1 << f if f < 63 else -(1 << 63)
            else:
                e ^= 1 << (f - 64) if f < 127 else -(1 << 63)
        rows += [(2 * k, a, d, 100, 100, 100, 400, 300), (2 * k + 1, b, e, 124, 76, 100, 404, 300)]
        if n == 12:
            want.add((2 * k, 2 * k + 1))
    rows += [(200, 1, 1, 0, 0, 0, 100, 100), (201, 1, 1, 25, 0, 0, 100, 100), (202, 1, 1, 0, 0, 0, 103, 100), (203, 1, 1, 0, 0, 0, 0, 100), (204, None, 1, 0, 0, 0, 100, 100), (205, 1, 1, 0, 0, 0, 100, 100), (206, 1, 1, 0, 24, 0, 100, 100)]
    df = spark.createDataFrame(rows, "id long, across long, down long, r int, g int, b int, width int, height int")
    found = {}
    for r in duplicates.groups(df).collect():
        found.setdefault(r.group_id, set()).add(r.id)
    assert {tuple(sorted(g)) for g in found.values()} == want | {(200, 205, 206)}
    for most in (0, 1, 6, 12, 16):
        spans = duplicates.bands(most)
        assert sorted((n, b) for n, a, w in spans for b in range(a, a + w)) == sorted((n, b) for n in ("across", "down") for b in range(64))
        assert len(spans) > most // 2
    assert duplicates.groups(df.limit(0)).count() == 0


def test_vector_searches_equal_numpy(spark):
    draw = np.random.default_rng(2)
    v = draw.normal(size=(300, 8))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    rows = spark.createDataFrame([(k, [float(x) for x in e], float(k % 7)) for k, e in enumerate(v)] + [(999, None, 1.0)], "vec_id long, embedding array<double>, label double").repartition(5)
    asked = rows.where("vec_id % 100 = 0")
    score = v @ v[::100].T
    near = vectors.neighbours_mean(rows, asked, "label", 10)
    for r in near.collect():
        s = score[:, r.query_id // 100]
        best = np.argsort(-s, kind="stable")[:10]
        w = np.exp(-40 * (s[best].max() - s[best]))
        assert abs(r.value - (w * (best % 7)).sum() / w.sum()) < 1e-9 and r.n == 10
    for close, fair in ((0.7, 0.2), (0.3, 0.1)):
        got = {(r.query_id, r.vec_id) for r in vectors.similar(rows, asked, close, fair).collect()}
        want = set()
        for j in range(3):
            s = score[:, j]
            want |= {(100 * j, int(i)) for i in np.flatnonzero(s >= close)} | {(100 * j, int(i)) for i in np.argsort(-s, kind="stable")[:12] if s[i] >= fair}
        assert got == want
    many = [b[0].tolist() for b in vectors.blocks(asked, 40)]
    assert sorted(x for b in many for x in b) == [0, 100, 200]
    assert vectors.match(rows, asked.limit(0), v[:5]).count() == 0 and vectors.match(rows.limit(0), asked, v[:5]).count() == 0


def test_taste_learns_a_signal_and_no_noise(spark):
    draw = np.random.default_rng(4)
    v = draw.normal(size=(200, 6))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    mark = np.where(v[:, 0] > 0.2, 5, np.where(v[:, 0] < -0.2, 1, 0))
    schema = "id long, mtime long, embedding array<double>, rating int, flag int"
    rows = spark.createDataFrame([(k, 1000 - k, [float(x) for x in e], int(m), 0) for k, (e, m) in enumerate(zip(v, mark, strict=True))] + [(900, 1, None, 0, 0)], schema)
    model = taste.fit(rows)
    assert model.useful and model.agreement > 0.95 and model.keep_at > model.reject_at
    out = {r.id: r for r in taste.scored(rows, model).collect()}
    assert out[900].taste is None and out[900].verdict == "unsure" and all(out[k].verdict is None for k in range(200) if mark[k])
    assert np.allclose([out[k].taste for k in range(200)], v @ model.weights + model.bias)
    noise = spark.createDataFrame([(k, 1000 - k, [float(x) for x in e], 5 if k % 2 else 1, 0) for k, e in enumerate(draw.normal(size=(60, 6)))], schema)
    assert {r.verdict for r in taste.scored(noise.withColumn("rating", F.when(F.col("id") < 50, F.col("rating")).otherwise(0)), taste.fit(noise.where("id < 50"))).where("rating = 0").collect()} == {"unsure"} or taste.fit(noise.where("id < 50")).useful
    assert taste.fit(rows.where("rating > 1")) is None and taste.fit(rows.limit(0)) is None
    # of too many, evenly spread ones
    places = sorted(r.place - 1 for r in taste.samples(rows, 30).collect())
    n = int((mark != 0).sum())
    assert places == [int(i * (n / 30)) for i in range(30)]


def test_agreement_counts_ties_half():
    s, y = np.array([3.0, 1.0, 1.0, 0.0]), np.array([1.0, 1.0, 0.0, 0.0])
    assert taste.agreement(s, y) == (2 + 1.5) / 4 and taste.agreement(s, np.ones(4)) == 0.5
    assert taste.quantile(np.array([4.0, 1, 2, 3]), 0.5) == 3.0


def test_targets(spark):
    rows = spark.createDataFrame([(0, 0), (0, 1), (0, 2), (1, 0), (3, 1), (5, 0), (5, 2), (5, 1)], "rating int, flag int")
    assert [r.t for r in rows.select(works.target(F.col("rating"), F.col("flag")).alias("t")).collect()] == [None, 0.85, 0.0, 0.0, 0.85, 1.0, 0.0, 1.0]
    bins = spark.createDataFrame([(1.9,), (2.0,), (7.99,), (8.0,)], "v double").select(works.binned(F.col("v"), works.CFG_BINS).alias("b"))
    assert [r.b for r in bins.collect()] == ["CFG under 2", "CFG 2 – 3.5", "CFG 6 – 8", "CFG 8 and over"]


def test_levels(spark):
    cases = {"": 0, "a cat": 1, "blood splatter": 4, "<lora:nude:1> cat": 1, "a_sword fight": 2, "sex": 5}
    got = spark.createDataFrame([(t,) for t in cases], "p string").select("p", audience.prompt_level(audience.clean(F.col("p"))).alias("n"), audience.reasons(audience.clean(F.col("p"))).alias("r")).collect()
    assert {r.p: r.n for r in got} == cases
    assert [tuple(x) for x in next(r.r for r in got if r.p == "blood splatter")] == [(4, "blood splatter")]
    levels = spark.range(6)
    want = {"pg13": [3], "pg..r": [2, 3, 4], "..pg": [1, 2], "r..": [4, 5], "none": [0], "g | x": [1, 5], "bad": [], "": []}
    assert {w: [r.id for r in levels.where(audience.wanted(F.col("id"), w)).collect()] for w in want} == want
    row = spark.range(1).select(audience.picture_level(F.array(F.struct(F.lit(5).alias("level"), F.lit(1.2).alias("fit")), F.struct(F.lit(2).alias("level"), F.lit(1.0).alias("fit")))).alias("a"), audience.decided(F.lit(2), F.lit(3), F.lit(None).cast("int")).alias("b"), audience.decided(F.lit(2), F.lit(3), F.lit(1)).alias("c"), audience.decided(F.lit(2), F.lit(3), F.lit(None).cast("int"), "prompt").alias("d")).first()
    assert tuple(row) == (2, 3, 1, 2)


def test_measures():
    s = np.array([[0.1, 0.2, 0.4, 0.9]])
    m = measures.transforms(s)
    assert np.allclose(m["share"], [[0, 1 / 3, 2 / 3, 1]]) and np.allclose(m["spreads"][0, 2], 0)
    assert np.allclose(10.0 ** m["odds"].sum(axis=1) > 0, True)


def test_places_without_a_single_task(spark):
    draw = np.random.default_rng(1)
    rows = [(k, int(draw.integers(0, 5)), ["hot", "a", "b"][min(2, int(draw.integers(0, 9)) // 6)]) for k in range(400)]
    df = spark.createDataFrame(rows, "id long, x int, g string").repartition(6)
    got = {r.id: r.place for r in S.placed(df, [F.desc("x"), F.asc("id")], "g", spread=7).collect()}
    for g in ("hot", "a", "b"):
        order = sorted((r for r in rows if r[2] == g), key=lambda r: (-r[1], r[0]))
        assert [got[r[0]] for r in order] == list(range(1, len(order) + 1))
    assert S.placed(df.limit(0), [F.asc("x")]).count() == 0


def test_files_and_notes(spark, tmp_path):
    for n in ("a.PNG", "b.webm", "c.txt", ".d.png", "sub/e.jpg", ".hid/f.png"):
        p = tmp_path / "lib" / n
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_bytes(b"xyz")
    assert sorted((r.name, r.kind, r.size) for r in files.listing(spark, str(tmp_path / "lib")).collect()) == [("a.PNG", 0, 3), ("b.webm", 1, 3), ("e.jpg", 0, 3)]
    note = tmp_path / "notes.json"
    note.write_text('{"images": {"a.PNG": {"rating": 4, "flag": "keep", "collections": ["X"]}, "b.webm": {}}, "smart": [{"name": "One", "query": "q"}, {"name": "one", "query": "r"}], "other": 1}')
    assert sorted((r.name, r.rating, r.flag, r.collections) for r in files.notes(spark, str(note)).collect()) == [("a.PNG", 4, 1, ["X"]), ("b.webm", 0, 0, [])]
    assert [(r.name, r["query"]) for r in files.views(spark, str(note)).collect()] == [("One", "q")]
    note.write_text("{broken")
    with pytest.raises(Exception, match="(?i)malformed|parse"):
        files.notes(spark, str(note)).collect()
    words = tmp_path / "w.txt"
    words.write_text("# no\n red \n\nblue\n")
    assert [r.word for r in files.word_list(spark, str(words)).collect()] == ["red", "blue"]


def test_vector_store(spark, tmp_path):
    root = str(tmp_path / "vectors")
    files_ = spark.createDataFrame([("k1", 1), ("k2", 2), ("k3", 3)], "key string, mtime long")
    assert [r.key for r in store.missing(files_, root, "a").collect()] == ["k3", "k2", "k1"]
    store.put(spark.createDataFrame([("k1", [1.0, 0.0]), ("k2", None)], "key string, embedding array<float>"), root, "a")
    store.put(spark.createDataFrame([("k1", [0.0, 1.0])], "key string, embedding array<float>"), root, "a")
    store.put(spark.createDataFrame([("k1", [5.0])], "key string, embedding array<float>"), root, "b")
    assert {r.key: r.embedding for r in store.get(spark, root, "a").collect()} == {"k1": [0.0, 1.0], "k2": None}
    assert [r.key for r in store.missing(files_, root, "a").collect()] == ["k3"]
    assert store.forget_others(spark, root, "a") == ["b"] and store.get(spark, root, "b").count() == 0


def test_empty_library(spark, tmp_path):
    for n in ("documents", "part", "labels", "embeddings"):
        spark.read.parquet(f"{SF}/{n}.parquet").limit(0).coalesce(1).write.parquet(f"{tmp_path}/{n}.parquet")
    rows = media(spark, str(tmp_path))
    assert rows.count() == 0 and usage.usage(rows).count() == 0 and usage.timeline(rows).count() == 0
    for name in ("flagship", "vector_match", "duplicate_groups", "what_works", "taste_verdicts", "audience_levels", "best_of_folder"):
        assert queries.QUERIES[name](spark, str(tmp_path)).count() == 0
    assert usage.totals(rows).first().total == 0


def test_live_index_goes_on_after_a_restart(spark, tmp_path):
    source, root = tmp_path / "in", str(tmp_path / "index")
    source.mkdir()
    batches = [
        ['{"id":1,"dir":"/a","name":"x","size":1,"mtime":1,"action":"put"}', '{"id":2,"dir":"/a/b","name":"y","size":1,"mtime":1,"action":"put"}', '{"id":5,"dir":"/ab","name":"y","size":1,"mtime":1,"action":"put"}'],
        ['{"id":9,"dir":"/a","name":"x","size":5,"mtime":2,"action":"put"}', '{"id":3,"dir":"/a/b","name":"old","size":1,"mtime":2,"action":"put"}', '{"dir":"/a/b","name":"","mtime":3,"action":"tree"}', '{"id":4,"dir":"/a/b/c","name":"new","size":1,"mtime":4,"action":"put"}'],
        ['{"dir":"/ab","name":"y","mtime":9,"action":"gone"}'],
        [],
    ]
    for k, lines in enumerate(batches):
        (source / f"{k}.json").write_text("\n".join(lines))
        live_index.follow(spark, str(source), root, str(tmp_path / "state")).awaitTermination()
    assert sorted(tuple(r) for r in live_index.latest(spark, root).select("id", "dir", "name", "size").collect()) == [(1, "/a", "x", 5), (4, "/a/b/c", "new", 1)]
    there = live_index.still_there(live_index.latest(spark, root), spark.createDataFrame([("/a", "x")], "dir string, name string"))
    assert [r.id for r in there.collect()] == [1]
