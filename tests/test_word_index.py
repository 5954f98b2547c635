"""The word index against the scan, through changes and compaction."""

import random

import pytest
from pyspark.sql import functions as F

from lumidex.operators import tables
from lumidex.plans import search as S
from lumidex.sources import word_index

SCHEMA = """id long, dir string, name string, mtime long, size long, prompt string, negative string, source string, seed string, model string, models array<struct<kind:string,name:string>>,
loras array<struct<name:string,weight:double>>, params array<struct<key:string,value:string>>"""
WORDS = ["red", "fox", "été", "лиса", "red fox", "12", "fox,", "foxes", "reflux", "flux1", "é", "a", "b", "狐", "𝔄b", "x" * 50]


def rows(n, seed):
    rng, out = random.Random(seed), []
    for i in range(n):
        text = lambda k: "".join(rng.choice(WORDS) + rng.choice([" ", " ", " ", ", ", "-", "\n", "  "]) for _ in range(rng.randrange(k)))
        out.append((i, "/d", f"{rng.choice(['fox', 'pic'])}_{i}.png", 1000 + i, 1, text(12) or None, text(4), rng.choice(["Tool", "flux app"]), str(7900 + i), rng.choice(["flux1-dev", "redfox", ""]), [("main", "Flux1"), ("vae", "Été VAE")][: rng.randrange(3)], [("Red Lora", 0.5)][: rng.randrange(2)], [("Sampler", "Euler a"), ("Steps", "12")][: rng.randrange(3)]))
    return out


ASKED = [(["fox"], []), (["red", "fox"], []), (["fox", "red"], ["été"]), (["flux"], ["a"]), (["euler"], []), (["79", "12"], []), (["лиса", "b"], []), (["red fox"], ["é"]), ([], ["red", "fox"]), (["nothing"], [])]


@pytest.fixture(scope="module")
def library(spark):
    return spark.createDataFrame(rows(300, 1), SCHEMA).withColumn("prompt", F.lower(F.coalesce("prompt", F.lit("")))).repartition(3)


def same(index, media):
    for ranked, only in ASKED:
        if " " in "".join(ranked):  # words side by side are looked for in prompts only, here and there
            want = S.Search(ranked_prompt=[*ranked, *only]).rows(media)
            got = index.search([], [*ranked, *only])
        else:
            want, got = S.Search(ranked=ranked, ranked_prompt=only).rows(media), index.search(ranked, only)
        want = {r.id: round(r.score, 9) for r in want.select("id", "score").collect()}
        assert {r.id: round(r.score, 9) for r in got.collect()} == want, (ranked, only)


def test_index_equals_scan(spark, library, tmp_path):
    index = word_index.WordIndex(spark, str(tmp_path / "words"))
    assert index.search(["fox"]).count() == 0
    index.put(library)
    same(index, library)
    assert not any(word_index.answers(n) for n in ("fox*", "red  fox", "a-b", "狐", "𝔄b", "", "the the"))
    with pytest.raises(ValueError, match="scan"):
        index.search(["fox*"])


def test_index_through_changes(spark, library, tmp_path):
    index = word_index.WordIndex(spark, str(tmp_path / "words"), buckets=3)
    index.put(library)
    changed = library.where("id % 3 = 0").withColumn("prompt", F.lit("red, fox red fox лиса")).withColumn("negative", F.lit("b"))
    index.put(tables.newest(changed.unionByName(changed.withColumn("mtime", F.lit(1).cast("long")))))
    index.delete(library.where("id % 5 = 0").select("id"))
    index.put(library.where("id % 10 = 0"))
    now = library.where("id % 3 <> 0 and id % 5 <> 0").unionByName(changed.where("id % 5 <> 0")).unionByName(library.where("id % 10 = 0"))
    same(index, now)
    (tmp_path / "words/rows/9").mkdir()  # a segment that was never finished
    assert index.compact() == 5 and index.segments() == [5]
    same(index, now)
    assert index.drop_old() == [1, 2, 3, 4]
    index.delete(library.select("id"))
    assert index.search(["fox"]).count() == 0
    assert index.put(library.limit(0)) == 7 and index.rows().count() == 0


def test_search_reads_its_own_words_only(spark, library, tmp_path):
    index = word_index.WordIndex(spark, str(tmp_path / "words"), buckets=16)
    index.put(library)
    files = index.search(["лиса"]).inputFiles()
    assert {f.split("bucket=")[1].split("/")[0] for f in files if "bucket=" in f} <= {str(word_index._bucket("лиса", o, 16)) for o in (False, True)}


def test_common_words_are_filed_by_slice_and_pass_compactions(spark, tmp_path):
    from lumidex.sources.tables import media

    rows = media(spark, "/root/testdata/sf0.001").where("id < 120").coalesce(1)
    index = word_index.WordIndex(spark, f"{tmp_path}/index")
    index.put(rows)
    filed = spark.read.parquet(f"{tmp_path}/index/words/1").where("field = 0")
    assert filed.groupBy("word").count().agg({"count": "max"}).first()[0] <= 2  # a common word isn't a row of the index for each row that has it
    before = index.postings().where("field = 0").select("word", "id", "at")
    kept = sorted((r.word, r.id, tuple(r.at)) for r in before.collect())
    # a row put anew begins a slice of the name that another slice has already
    index.put(rows.where("id % 3 = 0"))
    index.compact()
    index.put(rows.where("id % 5 = 0"))
    index.delete(rows.where("id % 7 = 0").select("id"))
    index.compact()
    after = sorted((r.word, r.id, tuple(r.at)) for r in index.postings().where("field = 0").select("word", "id", "at").collect())
    assert after == [x for x in kept if x[1] % 7]
