"""Spelling, usage ties, advice by model, levels by hand, newest records, free words in settings."""

import random

import pytest
from pyspark.sql import functions as F

from lumidex.functions import text as T
from lumidex.operators import spelling, tables, usage, works
from lumidex.plans import search as S
from lumidex.sources import files
from lumidex.sources.tables import media

LETTERS = "abcdé"


def edits(w):
    """Words one edit away, over the letters of the test."""
    out = set()
    for i in range(len(w) + 1):
        a, b = w[:i], w[i:]
        out |= {a + b[1:]} if b else set()
        out |= {a + b[1] + b[0] + b[2:]} if len(b) > 1 else set()
        out |= {a + c + b for c in LETTERS} | ({a + c + b[1:] for c in LETTERS} if b else set())
    return out


def suggested(word, rank):
    found = {w: rank[w] for w in edits(word) if w in rank}
    if len(found) < 5 and len(word) <= 14:
        for e in edits(word):
            for w in edits(e):
                if w in rank:
                    found[w] = min(found.get(w, 10**9), rank[w] + 300_000)
    return sorted(found, key=lambda w: (found[w], w))[:5]


def test_suggestions_equal_trying_all_edits(spark, monkeypatch):
    monkeypatch.setattr(spelling, "STEPS", (5, 20))
    rng = random.Random(2)
    some = lambda n: "".join(rng.choice(LETTERS) for _ in range(n))
    known = sorted({some(rng.randrange(3, 8)) for _ in range(60)} | {"abcdabcdabcdab", "abcdabcdabcdabcd"})
    rng.shuffle(known)
    rank = {w: k + 1 for k, w in enumerate(known)}
    wrong = sorted({some(rng.randrange(2, 8)) for _ in range(60)} - set(rank) | {"abcdabcdabcda", "abdcabcdabcdba", "abcdabcdabcdabdc", "x"})
    got = spelling.suggestions(spark.createDataFrame([(w, 1) for w in wrong], "word string, n long"), spark.createDataFrame(list(rank.items()), "word string, rank int"))
    assert {r.word: r.suggestions for r in got.collect()} == {w: suggested(w, rank) for w in wrong}


def test_a_long_word_makes_no_strings_and_words_looked_up_are_not_shuffled(spark):
    wrong = spark.createDataFrame([("forrest", 2), ("tere", 1), ("fforrest", 1), ("x" * 300_000, 1)], "word string, n long")
    known = spark.createDataFrame([("forest", 1), ("tree", 2)], "word string, rank int")
    got = spelling.suggestions(wrong, known)
    assert {r.word[:9]: (r.n, r.suggestions) for r in got.collect()} == {"forrest": (2, ["forest"]), "tere": (1, ["tree"]), "fforrest": (1, ["forest"]), "x" * 9: (1, [])}
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()


def test_misspelled_words(spark):
    texts = ["The forest's trees, well-known <lora:zzqq:1> 1girl v2 embedding:qqzz Forrest", "forest tree well known forests WIP wip_x a_b don’t", None, "", "treeex well-knwon", "don't forest tree"]
    rows = spark.createDataFrame([(t,) for t in texts], "text string")
    counts = spelling.counted(rows, "text")
    found = {r.word: r.n for r in counts.collect()}
    assert found["forest"] == 2 and found["don't"] == 2 and not {"zzqq", "qqzz", "girl", "v", "wip", "a", "x"} & set(found) - {"wip"}
    known = spark.createDataFrame([("forest", 1), ("tree", 2), ("well", 3), ("known", 4), ("don't", 5)], "word string, rank int")
    assert sorted(r.word for r in spelling.misspelled(counts, known).collect()) == ["forrest", "the", "treeex", "well-knwon"]
    told = spark.createDataFrame([("Forrest", "forest"), ("FOREST", "tree"), ("été", "tree"), ("A", "b")], "a string, b string").select(spelling.same_case(F.col("a"), F.col("b")).alias("c"))
    assert [r.c for r in told.collect()] == ["Forest", "TREE", "tree", "B"]
    assert spelling.dictionary(counts, 2, 2).count() == 2 and spelling.counted(rows.limit(0), "text").count() == 0


def test_usage_ties_go_by_text(spark):
    """Of prompts that occur once the first by text are told, compared whole where their beginnings are equal."""
    base = media(spark, "/root/testdata/sf0.001").limit(150)
    head = "same beginning " * 10
    rows = base.withColumn("n", F.row_number().over(__import__("pyspark").sql.Window.orderBy("id"))).withColumn("prompt", F.when(F.col("n") <= 3, "zz twice").when(F.col("n") <= 120, F.concat(F.lit(head), F.format_string("%03d", 200 - F.col("n")))).otherwise(F.concat(F.lit("t"), "n")))
    got = [(r.place, r.value, r.uses) for r in usage.usage(rows).where("kind = 'prompt'").orderBy("place").collect()]
    texts = sorted(head + f"{200 - n:03d}" for n in range(4, 121))
    assert got == [(1, "zz twice", 3)] + [(k + 2, t, 1) for k, t in enumerate(texts[:49])]


def test_word_counts_pass_on_what_a_task_cannot_hold(spark, monkeypatch):
    rows = spark.createDataFrame([(f"w{k} common <tag:x y z> w{k} ab",) for k in range(60)], "prompt string").repartition(3)
    assert {r.key: r.uses for r in usage.word_counts(rows).collect()} == {"common": 60} | {f"w{k}": 1 for k in range(10, 60)}


def test_advice_of_a_model_and_of_all(spark):
    def recipe(i, prompt, model, target):
        return (i, prompt, [("model", model, model, "")] if model else [], target)

    judged = [recipe(k, "red fox, snow" if k % 2 else "red fox, mud", "m1", 1.0 if k % 2 else 0.0) for k in range(20)]
    judged += [recipe(100 + k, "blue sky, sea" if k % 2 else "grey sky, best quality", "m2" if k < 6 else None, 1.0 if k % 2 else 0.0) for k in range(30)]
    rows = spark.createDataFrame(judged, "id long, prompt string, facets array<struct<kind:string,key:string,value:string,role:string>>, target double")
    prompts = spark.createDataFrame([(1, "Mud BREAK red fox", "m1"), (2, "grey sky, dog", "m2"), (3, "blue sky and snow and sea", None), (4, "", "m1")], "id long, prompt string, model string")
    missed = spark.createDataFrame([(1, 0, "red fox", 0.4, False), (1, 1, "mud", 0.9, True), (2, 0, "dog", 0.7, False)], "id long, k int, phrase string, level double, seen boolean")
    got = {}
    for r in works.advice(prompts, rows, missed).orderBy("id", "place").collect():
        got.setdefault((r.id, r.scope), []).append((r.advice, r.phrase, r.weight))
    assert got[1, "m1"] == [("missed", "red fox", 1.3), ("in_rejects", "mud", None), ("in_keepers", "snow", None)]
    assert got[2, ""][:2] == [("missed", "dog", 1.2), ("in_rejects", "grey sky", None)] and [x[0] for x in got[2, ""][2:]] == ["in_keepers"] * 2
    assert (3, "") not in got and got[4, "m1"] == [("in_keepers", "snow", None)]
    assert works.advice(prompts.limit(0), rows).count() == 0 and works.advice(prompts, rows.limit(0), missed).count() == 2


def test_advice_reads_each_prompt_once_and_shuffles_no_text(spark):
    read = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def text(prompt):
        read.add(1)
        return prompt

    judged = [(k, "red fox, snow" if k % 2 else "red fox, mud", [("model", "m1", "m1", "")], 1.0 if k % 2 else 0.0) for k in range(20)]
    rows = spark.createDataFrame(judged, "id long, prompt string, facets array<struct<kind:string,key:string,value:string,role:string>>, target double")
    prompts = spark.createDataFrame([(1, "Mud, (red fox:1.5)", "m1"), (2, "mud, red fox", None)], "id long, prompt string, model string")
    missed = spark.createDataFrame([(k, 0, "red fox", 0.4, False) for k in (1, 2)], "id long, k int, phrase string, level double, seen boolean")
    told = works.advice(prompts.withColumn("prompt", text("prompt")), rows, missed)
    got = told.orderBy("id", "place").collect()
    assert [(r.id, r.advice, r.phrase) for r in got] == [(1, "in_rejects", "mud"), (1, "in_keepers", "snow"), (2, "missed", "red fox"), (2, "in_rejects", "mud"), (2, "in_keepers", "snow")]
    assert read.value == 2 and "prompt" not in told._jdf.queryExecution().optimizedPlan().toString()


def test_phrases_to_add_are_never_cut(spark):
    """A prompt that has the hundred best phrases is told of the next ones."""
    names = [f"p{k:03d}x" for k in range(200)]
    judged = [(k, ", ".join(names[(40 * (k % 5) + j) % 200] for j in range(40)), [], 1.0) for k in range(50)] + [(900 + k, "plain", [], 0.0) for k in range(50)]
    rows = spark.createDataFrame(judged, "id long, prompt string, facets array<struct<kind:string,key:string,value:string,role:string>>, target double")
    prompts = spark.createDataFrame([(1, " ".join(names[:150]), None)], "id long, prompt string, model string")
    assert [r.phrase for r in works.advice(prompts, rows).orderBy("place").collect()] == names[150:152]


def test_advice_of_phrases_at_the_end_of_long_prompts(spark):
    """The hundredth phrase of a judged text counts, and of a prompt's phrases the last is looked at; rows say what their whole texts say."""
    many = ", ".join(f"thing {chr(97 + k // 26)}{chr(97 + k % 26)}" for k in range(100))
    assert spark.range(1).select(F.size(T.prompt_phrases(F.concat(F.lit(many), F.lit(", the end")))).alias("n")).first().n == 101
    judged = [(k, f"{many}, {'snow' if k % 2 else 'mud'}, 8k uhd", [], 1.0 if k % 2 else 0.0) for k in range(20)]
    rows = spark.createDataFrame(judged, "id long, prompt string, facets array<struct<kind:string,key:string,value:string,role:string>>, target double")
    prompts = spark.createDataFrame([(1, f"{many}, 8K UHD, Mud", None), (2, f"{many}, snow", None), (7, "", None)], "id long, prompt string, model string")
    got = [tuple(r) for r in works.advice(prompts, rows).orderBy("id", "place").collect()]
    assert got == [(1, 1, "in_rejects", "mud", None, ""), (1, 2, "no_difference", "8k uhd", None, ""), (1, 3, "in_keepers", "snow", None, ""), (7, 1, "in_keepers", "snow", None, "")]


def test_levels_by_hand_survive(spark, tmp_path):
    note = tmp_path / "notes.json"
    note.write_text('{"images": {"a": {"rating": 1, "audience": "PG-13"}, "b": {"audience": "nc17"}, "c": {"rating": 2}}}')
    assert sorted((r.name, r.audience) for r in files.notes(spark, str(note)).collect()) == [("a", 3), ("b", 5), ("c", 0)]
    notes = files.notes(spark, str(note)).withColumn("dir", F.lit("/d"))
    change = "dir string, name string, rating int, flag int, audience int, add array<string>, drop array<string>"
    out = tables.change_notes(notes, spark.createDataFrame([("/d", "a", 0, None, None, [], []), ("/d", "b", None, None, 0, [], []), ("/d", "n", None, None, 7, [], [])], change))
    assert sorted((r.name, r.rating, r.audience) for r in out.collect()) == [("a", 0, 3), ("c", 2, 0), ("n", 0, 5)]
    plain = spark.createDataFrame([("/d", "a", None, 1, [], [])], "dir string, name string, rating int, flag int, add array<string>, drop array<string>")
    assert {r.name: r.audience for r in tables.change_notes(notes, plain).collect()} == {"a": 3, "b": 5, "c": 0}
    assert sorted(r.name for r in tables.delete_collection(notes, "x").collect()) == ["a", "b", "c"]
    assert sorted(r.name for r in tables.replace_notes(notes.limit(0), "/d", notes).collect()) == ["a", "b", "c"]
    batch = spark.createDataFrame([("/d", "a", 1, None, None, 2, [], []), ("/d", "a", 2, None, None, None, [], []), ("/d", "c", 1, None, None, 4, [], [])], "dir string, name string, at int, rating int, flag int, audience int, add array<string>, drop array<string>")
    assert {r.name: r.audience for r in tables.batch_notes(notes, batch).collect()} == {"a": 2, "b": 5, "c": 4}
    levels = tables.with_levels(spark.createDataFrame([("/d", "a", 1), ("/d", "c", 2)], "dir string, name string, level int"), notes, "level")
    assert {r.name: r.level for r in levels.collect()} == {"a": 3, "c": 2}


def test_the_newest_record_of_a_path_wins(spark):
    rows = "id long, dir string, name string, size long, mtime long"
    index = spark.createDataFrame([(9, "/a", "x", 1, 1)], rows)
    records = spark.createDataFrame([(1, "/a", "x", 5, 3), (2, "/a", "x", 4, 2), (3, "/a", "y", 1, 1), (4, "/a", "y", 2, 1), (4, "/a", "y", 2, 1)], rows)
    assert sorted(map(tuple, tables.upsert(index, records).collect())) == [(4, "/a", "y", 2, 1), (9, "/a", "x", 5, 3)]


@pytest.mark.parametrize(("words", "n"), [(["euler"], True), (["sampler"], True), (["7930"], True), (["vae"], True), (["ddim", "simple"], True), (["ddim", "karras"], False), (["7930", "nowhere"], False)])
def test_free_words_find_settings_and_seeds(spark, words, n):
    rows = S.Search(ranked=words).rows(media(spark, "/root/testdata/sf0.001"))
    assert (rows.count() > 0) == n


def test_words_with_a_star_are_left_out_of_the_bonus(spark):
    rows = media(spark, "/root/testdata/sf0.001").limit(1).withColumn("prompt", F.lit("red fox and cars"))
    score = lambda words: S.Search(ranked=words).rows(rows).first().score
    assert score(["red", "fox", "car*"]) == pytest.approx(score(["red", "fox"]) + score(["car*"]))
    assert score(["red", "fox"]) == pytest.approx(score(["red"]) + score(["fox"]) + 60)
