"""Columns whose names clash, repeated and null ids, of operators that keep rows or learn from them."""

import math
import re

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lumidex.llm import decontamination, language_id, quality_classifier, quality_rules, shared, simhash, toxicity

CLASHING = ["_row", "_part", "_id", "_text", "text_id", "row", "part", "id", "least", "c0", "fp", "spans", "score"]


@pytest.fixture
def clashing(spark):
    body = " ".join(f"w{k}" for k in range(90))
    rows = [(1, body, "mine", 7), (1, body, "mine", 8), (2, body + " end", "mine", 9), (3, " ".join(f"v{k}" for k in range(80)), "mine", 10), (None, "", "mine", 11)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, x string, n long").repartition(3)
    return docs.select("doc_id", *[F.concat("x", F.lit(c)).alias(c) for c in CLASHING], "text", "n")


@pytest.mark.parametrize("most", [1 << 20, 60])
def test_columns_of_any_name_pass(spark, clashing, most):
    items = spark.createDataFrame([(7, " ".join(f"v{k}" for k in range(80))), (8, "other " * 20), (None, "w1 " * 30), (8, "other " * 20)], "item_id long, text string")
    clean = decontamination.clean(clashing, items, most)
    assert clean.columns == clashing.columns and sorted(r.n for r in clean.collect()) == [7, 8, 9, 11]
    once = simhash.dedup(clashing)
    assert once.columns == clashing.columns and sorted(r.n for r in once.collect())[1:] == [9, 10, 11]
    kept = quality_rules.keep(clashing, spark.createDataFrame([], "doc_id long, quality int"))
    for out in (clean, once, kept):
        assert all(r[c] == "mine" + c for r in out.collect() for c in CLASHING)


def test_items_of_one_id_and_of_none_fill_no_block(spark):
    items = spark.createDataFrame([(1, f"a{k} b{k} c{k} " * 20) for k in range(60)] + [(None, "x " * 500)] * 60 + [(2, "same words here")] * 60, "item_id long, text string")
    n, block = decontamination._blocks(items, 3000)
    sizes = [len(block(k).names) for k in range(n)]
    assert n > 3 and sum(sizes) >= 2
    docs = spark.createDataFrame([(k, f"a{k} b{k} c{k} " * 20) for k in range(60)] + [(99, "same words here"), (98, "x " * 50)], "doc_id long, text string")
    assert {r.doc_id: r["items"] for r in decontamination.scan(docs, items, 3000).collect()} == {k: ["1"] for k in range(60)} | {99: ["2"], 98: []}


def test_language_of_one_id_many_times(spark):
    """One id in all rows, some of one text, in two languages."""
    texts = {"en": "the cat and the house of the king with that", "fr": "le chat et la maison du roi avec cela"}
    rows = [(5, f"{texts[x]} {k if k % 2 else ''}", x) for k in range(400) for x in texts] + [(5, "same in both", x) for x in texts for _ in range(50)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4)
    model = language_id.fit(docs, 4, (spark.range(1).select(F.crc32(F.lit("5")) % 4).first()[0] + 1) % 4, landmarks=20, sample=100)
    marked = docs.select(F.shiftrightunsigned(F.xxhash64("doc_id", "text"), 1).alias("mark"), "text", "lang")
    every = {}
    for r in marked.collect():
        every.setdefault(r.lang, set()).add(r.mark)
    for many in (1, 30, 1000):  # of 450 rows of a language some 200 differ
        got = {}
        for r in language_id.lowest(marked, {"en": 450, "fr": 450_000}, many).collect():
            got.setdefault(r.lang, []).append(r.mark)
        assert {x: sorted(m) for x, m in got.items()} == {x: sorted(m)[:many] for x, m in every.items()}
    assert model.predict(["the king and the cat", "le roi et le chat"])[0] == ["en", "fr"]


def test_labelled_rows_of_repeated_documents(spark, tmp_path):
    spark.createDataFrame([(k % 5, f"text {k}") for k in range(100)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(k, k % 2) for k in range(5)] * 3, "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    got = shared.labelled(spark, str(tmp_path), "quality", 1, 5, 4).collect()
    assert len(got) <= 4 and all(r.text == min(f"text {k}" for k in range(100) if k % 5 == r.doc_id) for r in got)


def plain(text):
    """Indicators, one word at a time."""
    words, q = re.findall("[^ \t\n\x0b\x0c\r]+", text), quality_classifier
    codes = [[int.from_bytes(b[k : k + 4], "little") for k in (0, 4)] for b in q._learn([w.encode() + b" " for w in words])]
    mix = lambda a, b, k: ((a * 0x9E3779B97F4A7C15 + b * 0xC2B2AE3D27D4EB4F + k) % (1 << 64)) >> 20
    shape = [11 if k and codes[k][0] == codes[k - 1][0] else c[1] for k, c in enumerate(codes)]
    two = [mix(a, b, 3) for a, b in zip(shape, shape[1:], strict=False)]
    out = [c[0] for c in codes] + [mix(a[0], b[0], 1) for a, b in zip(codes, codes[1:], strict=False)] + [mix(s, s, 2) for s in shape] + two + [mix(t, s, 5) for t, s in zip(two, shape[2:], strict=False)] + [len(words).bit_length() * 2654435761 + 77]
    return sorted({x % q.WIDTH for x in out})


def test_indicators_of_a_batch_equal_those_of_each_word():
    texts = ["", "a", "a a a", "One two 22 Two-two one", "x" * 9000 + " y", "é è\tÉ\n--", " \n", "b a b a b"] * 2
    flat, upto = quality_classifier.indicators_of(pa.array([*texts, None]))
    assert [flat[a:b].tolist() for a, b in zip(upto, upto[1:], strict=False)] == [plain(t) for t in [*texts, ""]]


def test_language_scores_equal_a_plain_prediction(spark):
    """The query's prediction from its landmarks and coefficients, with kernels of plain sets."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    model = language_id.fit(docs)
    got = {r.doc_id: (r.lang_pred, r.score) for r in language_id.predict(docs, model).collect()}
    marks = []
    for j in range(len(model.landmarks.size[0])):
        marks.append([set(c[h[:, j] > 0].tolist()) for c, h in zip(model.landmarks.codes, model.landmarks.has, strict=True)])
    for r in docs.select("doc_id", "text").orderBy("doc_id").limit(60).collect():
        own = [set(g.tolist()) for g in language_id.grams(r.text or "")]
        kernel = [sum(len(a & b) / (max(1, len(a)) * max(1, len(b))) ** 0.5 for a, b in zip(own, m, strict=True)) / 3 for m in marks]
        margin = [sum(k * c for k, c in zip(kernel, model.coefficients[:-1, x].tolist(), strict=True)) + model.coefficients[-1, x] for x in range(len(model.names))]
        power = [math.exp(language_id.SHARP * (m - max(margin))) for m in margin]
        name, score = got[r.doc_id]
        assert name == model.names[margin.index(max(margin))] and abs(score - max(power) / sum(power)) < 1e-5


def test_quality_scores_equal_a_plain_sum(spark):
    """The query's score from its weights, indicator by indicator."""
    sf = "/root/testdata/sf0.001"
    model = quality_classifier.fit(shared.labelled(spark, sf, "quality", 3, 1, quality_classifier.SAMPLE))
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = {r.doc_id: r.score for r in quality_classifier.score(docs, model).collect()}
    assert len(got) == docs.count()
    for r in docs.select("doc_id", "text").collect():
        own = plain(" ".join(w for w in (r.text or "").replace("\x85", "x").split(" ")) if r.text and not set(r.text) & set("\x1c\x1d\x1e\x1f\x85\xa0 　") else "") if r.text else plain("")
        if r.text and set(r.text) & set("\x1c\x1d\x1e\x1f\x85\xa0 　"):
            continue  # other spaces don't part words there
        raw = sum(model.weights[k] for k in own) / len(own) ** 0.5 + model.bias
        assert abs(got[r.doc_id] - 1 / (1 + math.exp(-(model.slope * raw + model.shift)))) < 1e-9


def test_toxic_scores_equal_a_plain_sum(spark):
    """The query's score from its lexicon, text by text, against the model's own single-text score."""
    sf = "/root/testdata/sf0.001"
    lexicon = toxicity.fit(shared.labelled(spark, sf, "toxic", 4, 2, toxicity.SAMPLE))
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = {r.doc_id: r.score for r in toxicity.score(docs, lexicon).collect()}
    assert all(abs(got[r.doc_id] - lexicon.score(r.text)) < 1e-9 for r in docs.select("doc_id", "text").collect()) and len(got) == docs.count()
