"""Every registered query against brute force, its SQL, or the public libraries; and the models' inner steps against plain versions."""

import collections
import hashlib
import math
import re
import time
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from lumidex.llm import decontamination, language_id, pii, quality_classifier, quality_rules, queries, sentencepieces, shared, simhash, substrings, token_files, toxicity
from lumidex.llm.boosting import Trees

from test_operators import ODD, PIECES, SF, WORDS, brute_components, brute_fingerprint, brute_spans, brute_windows, sha, texts, words

MEDIUM = "/root/testdata/sf0.01"


def rows_of(spark, name, sf=SF):
    return {r.doc_id: r for r in queries.QUERIES[name](spark, sf).collect()}


def flat(rows):
    return sorted((tuple(r) for r in rows), key=repr)


@pytest.mark.parametrize("sf", [SF, MEDIUM])
@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_sql(spark, name, sf):
    con = duckdb.connect()
    for n in ("documents", "labels", "benchmark", "conversations"):
        con.execute(f"CREATE VIEW {n} AS SELECT * FROM read_parquet('{sf}/{n}.parquet')")
    df = queries.QUERIES[name](spark, sf)
    cols = sorted(df.columns)
    want = con.execute(f"SELECT {', '.join(cols)} FROM ({queries.ORACLE_SQL[name]})").fetchall()
    assert flat(df.select(cols).collect()) == flat(want) and want


def test_op1_digests(spark, docs):
    import sentencepiece

    library, got = sentencepiece.SentencePieceProcessor(model_file=PIECES), rows_of(spark, "op1_sentencepiece")
    known = texts(docs)
    assert set(got) == set(known)
    for i, t in known.items():
        ids = library.encode(t or "", add_eos=True)
        assert (got[i].n_tokens, got[i].ids_sha256, got[i].decoded_sha256) == (len(ids), sha(" ".join(map(str, ids))), sha(library.decode(ids)))


def test_op3_digests(spark, docs):
    want = brute_windows(texts(docs), 20)
    got = rows_of(spark, "op3_substrings")
    assert {i: (r.n_words, r.n_removed, r.kept_sha256) for i, r in got.items()} == {i: (n, m, sha(k)) for i, (n, m, k) in want.items()}


def test_op4_digests(spark, docs):
    prints = {d: brute_fingerprint(t) for d, t in texts(docs).items()}
    roots = brute_components(prints)
    got = rows_of(spark, "op4_simhash")
    assert {i: (r.fingerprint, r.component_id) for i, r in got.items()} == {i: (f"{p:016x}", roots[i]) for i, p in prints.items()}


def test_op5_digests(spark, docs):
    from tokenizers import Tokenizer

    library, got, start = Tokenizer.from_file(WORDS), rows_of(spark, "op5_token_files"), 0
    for i, t in sorted(texts(docs).items()):
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 2]
        assert (got[i].start, got[i].n_tokens, got[i].ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


def test_op5_pieces_of_odd_texts():
    import pyarrow as pa

    e = token_files.encoder(WORDS)
    assert e.shares
    odd = ["It's a don't 'tis ''s !'s I'LL'd", "<|endoftext|> x<|startoftext|>y <|endof text|>", "É́ é ﬁ ① ½ 日本語 \U0001f600 tab\tand\x0bmore", "ÀÉÎ×÷Ÿÿß.,", "a1b22c333", "x y z\n\n\nq", "İstanbul ΣΑΣ Kelvin", "́abc abć def", "µªº", "!" * 70 + "word", "ab" * 3000, "", None, " "]
    draw = np.random.default_rng(4)
    odd += ["".join(draw.choice(list("aBÉß1 .,'!<|\n\t²ⅷ"), 60)) for _ in range(300)]
    ids, upto = e.encode(pa.array(odd), 2)
    for k, t in enumerate(odd):
        assert ids[upto[k] : upto[k + 1]].tolist() == [*e.tokenizer.encode(t or "", add_special_tokens=False).ids, 2], t


def test_op5_more_symbols_than_sixteen_bits():
    lengths = token_files.code_lengths({s: 1 + s % 7 for s in range(70_000)})
    assert max(lengths.values()) == 17 and sum(2.0**-n for n in lengths.values()) <= 1
    book, ids = token_files.Book(lengths), np.random.default_rng(1).integers(0, 70_000, 9000).astype(np.int32)
    payload, marks = book.pack(ids)
    assert marks.dtype == np.int64 and (book.unpack(payload, marks, len(ids)) == ids).all()


def test_op6_and_op9_equal_brute_force_on_odd_texts(spark, make):
    df = make(ODD)
    none = spark.createDataFrame([], "doc_id long, quality int")
    got = {r.doc_id: r.kept for r in quality_rules.judge(df, none).collect()}
    assert got == {i: len(words(t)) >= 50 and not t.startswith(("word word", "A, b; c!")) for i, t in texts(df).items()}


def test_op7_digests(spark, docs):
    got = rows_of(spark, "op7_pii")
    for i, t in texts(docs).items():
        base, r = brute_spans(t or ""), got[i]
        told = [f"{k}:{s}:{e}" for s, e, k in base]
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(x[2] == k for x in base) for k in pii.KINDS]
        assert r.base_sha256 == sha(",".join(told))
        every = r.spans.split(",") if r.spans else []
        assert [x for x in every if x in told] == told
        spans = [(x.split(":")[0], *map(int, x.split(":")[1:])) for x in every]
        assert spans == sorted(spans, key=lambda x: (x[1], pii.KINDS.index(x[0])))


@pytest.mark.parametrize(("name", "parts", "rest"), [("op2_language_id", 4, 2), ("op8_quality_classifier", 3, 1), ("op10_toxicity", 4, 2)])
def test_learned_queries(spark, docs, name, parts, rest):
    got, known = rows_of(spark, name), texts(docs)
    assert set(got) == set(known)
    for i, r in got.items():
        assert r.held_out == (zlib.crc32(str(i).encode()) % parts == rest) and 0 <= r.score <= 1
        if name == "op2_language_id":
            assert (r.lang_pred == "und") == (not re.search(r"[^\W\d_]", known[i] or "")) and r.lang_pred in ("und", "en", "fr", "de", "es")
        else:
            assert r.predicted == int(r.score >= (0.3 if name == "op10_toxicity" else 0.5))


# ---- quality rules


def test_quality_counts_where_hashes_clash(spark, make):
    draw = np.random.default_rng(8)
    rows = [" ".join(draw.choice(list("abc"), n)) for n in (3, 4, 5, 9, 30, 200)] + ["a b c d a b c", "x y z x y z x", "p q r s"]
    df = make(rows).withColumn("_w", F.split("text", " "))
    for digest in (lambda *a: F.lit(7).cast("long"), lambda a, b, c: F.length(F.concat(a, b)).cast("long") * 4096 + F.ascii(a) % 2 * 1024, F.xxhash64):
        for r in quality_rules._repeat_words(df, digest).collect():
            w = r.text.split(" ")
            seen = collections.Counter(zip(w, w[1:], w[2:], strict=False))
            assert r.n_repeat_words == len({k for i in range(len(w) - 2) if seen[tuple(w[i : i + 3])] > 1 for k in range(i, i + 3)})


def brute_cutoffs(rows, risk, delta):
    """The method in plain Python with exact binomial sums."""
    out = {}
    level, limit = delta / 9, risk / 3
    for s in range(3):
        good = [r for r in rows if r["s"] == s and r["q"] == 1]
        bad = [r for r in rows if r["s"] == s and r["q"] == 0]
        for rule, (_, _, steps) in quality_rules.RULES.items():
            best = 0
            for c in steps:
                lost, n = sum(r[rule] > c for r in good), len(good)
                if not n or sum(math.comb(n, k) * limit**k * (1 - limit) ** (n - k) for k in range(lost + 1)) > level:
                    break
                caught = sum(r[rule] > c for r in bad)
                if caught > best:
                    best, out[s, rule] = caught, c
    return out


def test_quality_cutoffs_on_planted_labels(spark):
    draw, plain, table = np.random.default_rng(5), [], []
    for i in range(6000):
        s, q = int(draw.choice(3, p=[0.5, 0.4, 0.1])), int(draw.random() < 0.7)
        n = (100, 500, 2000)[s]
        share = {"symbols": float(draw.choice([0.0, 0.05, 0.12, 0.25, 0.45], p=[0.9, 0.06, 0.03, 0.008, 0.002] if q else [0.2, 0.2, 0.2, 0.2, 0.2])), "dup_lines": float(draw.choice([0.0, 0.35, 0.75], p=[0.995, 0.004, 0.001] if q else [0.4, 0.3, 0.3])), "repeats": float(draw.choice([0.0, 0.12, 0.32], p=[0.93, 0.06, 0.01] if q else [0.5, 0.2, 0.3]))}
        plain.append(share | {"s": s, "q": q})
        table.append((i, n, 1000, int(round(share["symbols"] * 1000)), int(round(share["dup_lines"] * 20)), int(round(share["repeats"] * n)), 20, False))
    feats = spark.createDataFrame(table, "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long, base_failed boolean")
    labels = spark.createDataFrame([(i, r["q"]) for i, r in enumerate(plain)] + [(0, plain[0]["q"]), (None, 1), (3, None)], "doc_id long, quality int")
    for risk, delta in ((0.03, 0.05), (0.09, 0.05), (0.003, 0.01)):
        want = brute_cutoffs(plain, risk, delta)
        got = quality_rules.cutoffs(feats, labels, risk, delta)
        assert got == want
        kept = {r.doc_id: r.kept for r in feats.withColumn("kept", quality_rules.verdict(got)).collect()}
        assert kept == {i: not any(k[0] == r["s"] and r[k[1]] > c for k, c in want.items()) for i, r in enumerate(plain)}
        # the promise: of the good documents of a stratum no more than risk are lost (these are the very ones it was shown on)
        for s in range(3):
            good = [i for i, r in enumerate(plain) if r["s"] == s and r["q"] == 1]
            assert sum(not kept[i] for i in good) <= risk * len(good)
    assert len(brute_cutoffs(plain, 0.09, 0.05)) >= 3


def test_quality_without_labels_and_repeated_ids(spark, make):
    long = " ".join(f"w{k}" for k in range(60))
    df = make([long, "short", None, long], [1, 1, None, 2])
    empty = spark.createDataFrame([], "doc_id long, quality int")
    assert sorted((r.doc_id or -1, r.kept) for r in quality_rules.judge(df, empty).collect()) == [(-1, False), (1, False), (1, True), (2, True)]
    kept = quality_rules.keep(df, empty)
    assert kept.columns == df.columns and sorted(r.doc_id for r in kept.collect()) == [1, 2]
    assert quality_rules.keep(make([]), empty).count() == 0


# ---- language id


def test_kernel_and_ridge_equal_plain_versions():
    rows = ["the cat sat", "le chat est assis là", "der Hund", "", "AAA aaa", "1 2 3"]
    sets = [language_id.grams(t) for t in rows]
    marks = language_id.Landmarks.of(sets[:3])
    blank = lambda t: bytes(c if c >= 128 or chr(c).isalpha() else 32 for c in t.lower().encode())
    for i, t in enumerate(rows):
        for j in range(3):
            want = 0.0
            for n in (1, 2, 3):
                a, b = ({blank(x)[k : k + n] for k in range(len(blank(x)) - n + 1)} for x in (t, rows[j]))
                want += len(a & b) / math.sqrt(max(1, len(a)) * max(1, len(b))) / 3
            assert abs(marks.kernel(rows)[i, j] - want) < 1e-6
    draw = np.random.default_rng(1)
    phi, y, penalty = draw.normal(size=(40, 5)), draw.normal(size=(40, 2)), 0.3
    got = language_id._solve(phi, y, penalty)
    # ridge as least squares with extra rows; the intercept isn't penalised
    design = np.vstack([np.hstack([phi, np.ones((40, 1))]), np.hstack([np.sqrt(penalty * 40) * np.eye(5), np.zeros((5, 1))])])
    want = np.linalg.lstsq(design, np.vstack([y, np.zeros((5, 2))]), rcond=None)[0]
    assert np.allclose(got, want)


def test_language_of_one_and_of_short_texts(spark, make):
    one = make([f"the little text number {k}" for k in range(20)])
    model = language_id.fit(one)
    assert [tuple(r)[1:] for r in language_id.predict(make(["what is this", "12", None, ""]), model).orderBy("doc_id").collect()] == [("en", 1.0), ("und", 0.0), ("und", 0.0), ("und", 0.0)]
    short = one.union(make([f"un petit texte numéro {k}" for k in range(20)], range(100, 120)).withColumn("lang", F.lit("fr")))
    two = language_id.fit(short)
    marks = {bytes([c]) for h, codes in zip(two.landmarks.has[:1], two.landmarks.codes[:1], strict=True) for c in codes[h.any(axis=1)].tolist()}
    assert b"x" in marks  # of the texts, not of the languages' names
    assert two.predict(["the little one", "un petit mot"])[0] == ["en", "fr"]
    assert language_id.predict(make([]), two).count() == 0
    for odd in (make([None, None]), make(["a b", "a b"], [1, 1])):
        assert language_id.predict(odd, language_id.fit(odd)).count() == 2


# ---- classifiers


def test_descent_reaches_the_dual_optimum():
    draw = np.random.default_rng(2)
    x, y = draw.normal(size=(24, 4)), np.where(draw.random(24) < 0.4, 1.0, -1.0)
    rows, values = [np.arange(4)] * 24, list(x)
    w, b = quality_classifier.descend(rows, values, y, 4, cost=0.5, epochs=4000)
    limit = np.where(y > 0, 0.5 * 24 / (2 * (y > 0).sum()), 0.5 * 24 / (2 * (y < 0).sum()))
    z = np.hstack([x, np.ones((24, 1))]) * y[:, None]
    gram, alpha = z @ z.T, np.zeros(24)
    for _ in range(60_000):  # projected gradient on the dual
        alpha = np.clip(alpha + (1 - gram @ alpha) / np.linalg.norm(gram, 2), 0, limit)
    want = z.T @ alpha
    primal = lambda v: 0.5 * v @ v + np.sum(limit * np.maximum(0, 1 - z @ v))
    got = np.append(w, b)
    assert primal(got) <= primal(want) * (1 + 1e-2) + 1e-9
    assert np.abs(got - want).max() < 0.05


def test_quality_model_of_odd_samples(spark, make):
    schema = "doc_id long, text string, y int, held boolean"
    same = spark.createDataFrame([(1, "a", 1, False), (1, "a", 1, False), (2, "a", 0, False), (2, "a", 0, True), (3, "", 1, True)], schema)
    for module in (quality_classifier, toxicity):
        model = module.fit(same)
        assert module.score(make([]), model).count() == 0
        assert all(0 <= r.score <= 1 for r in module.score(make([*ODD, "x" * 100_000]), model).collect())
    # a word's whole shape tells, however long it is
    assert set(quality_classifier.indicators("a1" * 20)) != set(quality_classifier.indicators("a1" * 20 + "-"))


def test_toxic_matching_equals_a_plain_search():
    draw = np.random.default_rng(9)
    weights = {" ab": 1.0, " abc": 2.0, " abcd ": 4.0, " c ": 0.5, " da": 1.5}
    exceptions = (" ab c ", " x abcd ", " da da ")
    lexicon = toxicity.Lexicon(weights, exceptions, 0.5, 1.3, -1.0)
    for _ in range(400):
        line = draw.choice(["ab", "abc", "abcd", "abcde", "c", "x", "da", "dab"], int(draw.integers(0, 12))).tolist()
        text = f" {' '.join(line)} "
        covered = [(k, k + len(p) - 1) for p in exceptions for k in range(len(text)) if text.startswith(p, k)]
        want = []
        for k in range(len(text)):
            here = [e for e in weights if text.startswith(e, k)]
            if here and not any(a <= k <= b for a, b in covered):
                want.append(max(here, key=len))
        assert sorted(lexicon.matches(line)) == sorted(want)
        total = sum(weights[e] for e in want) / max(1, len(line)) ** 0.5
        assert math.isclose(lexicon.score(" ".join(line)), 1 / (1 + math.exp(-(1.3 * math.log1p(total) - 1.0))))


def test_labelled_samples_are_bounded(spark):
    every = shared.labelled(spark, MEDIUM, "quality", 3, 1, 10_000)
    size = every.agg(F.sum(F.octet_length("text"))).first()[0]
    some = shared.labelled(spark, MEDIUM, "quality", 3, 1, 10_000, size // 3)
    assert 0 < some.agg(F.sum(F.octet_length("text"))).first()[0] < size * 0.6
    assert shared.labelled(spark, MEDIUM, "quality", 3, 1, 50).count() <= 50


# ---- personal data


def test_base_spans_of_random_text():
    draw = np.random.default_rng(6)
    for alphabet in ("a1.@-", "0123.", "1 -+().", "a@b. 9+-", "12.@ x"):
        for _ in range(1500):
            t = "".join(draw.choice(list(alphabet), int(draw.integers(1, 60))))
            assert pii.base_spans(t) == brute_spans(t), t


@pytest.mark.parametrize("text", ["9" * 400_000, "a" * 400_000, "a" * 200_000 + "@" + "b" * 200_000, "1." * 200_000, "1 " * 200_000, "+1 " * 130_000, " at " * 100_000, "@" * 200_000])
def test_unbroken_runs_take_linear_time(text):
    begin = time.process_time()
    pii.base_spans(text)
    pii.candidates(text)
    assert time.process_time() - begin < 12


def unseen(s, kind):
    """Disguises that the trees don't learn from."""
    d, groups = pii._digits(s), re.findall("[0-9]+", s)
    if kind == "email":
        user, domain = s.split("@", 1)
        return {f"{a}{b}": user.replace(".", b) + a + domain.replace(".", b) for a, b in (("{at}", "{dot}"), (" AT ", " DOT "), ("<at>", "<dot>"), ("_at_", "_dot_"), (" {at} ", "."))}
    if kind == "ip":
        return {x: s.replace(".", x) for x in ("{.}", " [.] ", "-dot-", "<dot>", " DOT ")}
    if kind == "phone":
        return {x: x.join(groups) for x in ("/", "  ", " - ", "_", ":")}
    return {x: x.join(d[i : i + 4] for i in range(0, len(d), 4)) for x in (" . ", ":", "--", ", ")}


def test_disguised_spans_are_found(spark):
    df = spark.read.parquet(f"{MEDIUM}/documents.parquet")
    selector = pii.fit(df)
    assert set(selector.thresholds) == set(pii.KINDS)
    want = {"write to joe dot smith at example dot com today": ("joe dot smith at example dot com", "email"), "host 10[.]20[.]30[.]4 is up": ("10[.]20[.]30[.]4", "ip"), "call 0044 20 7946 0958 now": ("0044 20 7946 0958", "phone"), "card 4111.1111.1111.1111 ok": ("4111.1111.1111.1111", "card")}
    for t, (piece, kind) in want.items():
        assert [(t[s:e], k) for s, e, k, base, _ in selector.spans(t) if not base] == [(piece, kind)]
    for t in ("due 2024-01-02, version 1.2.3", "ISBN 978-3-16-148410-0", "12 345 678 901 euros", "see you at home."):
        assert selector.spans(t) == []
    # disguises of base spans of documents that the trees didn't see; those of `unseen` aren't in the list they learn from
    df = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").where(F.crc32(F.col("doc_id").cast("string")) % 4 == 1)
    selector, found, total = pii.fit(df), {}, {}
    for i, t in texts(df).items():
        for s, e, kind in pii.base_spans(t or "")[:3] if zlib.crc32(str(i).encode()) % 5 == 0 else ():
            hidden = {(kind, k): h for k, h in enumerate(pii.disguises(t[s:e], kind))} | {(kind, name): h for name, h in unseen(t[s:e], kind).items()}
            for key, h in hidden.items():
                line = f"{t[max(0, s - 30):s]}{h} {t[e:e + 30].lstrip()}"
                at = max(0, s - 30)
                total[key] = total.get(key, 0) + 1
                found[key] = found.get(key, 0) + any(a <= s - at + 1 and b >= s - at + len(h) - 1 and k == kind for a, b, k, *_ in selector.spans(line))
    assert len(total) > 40 and all(found[k] >= 0.9 * total[k] or total[k] - found[k] <= 1 for k in total), {k: (found[k], total[k]) for k in total}
    # what is added in real texts is right: cards whose digits pass the checksum
    added = [(t[s:e], k) for t in texts(df).values() for s, e, k, base, _ in selector.spans(t or "") if not base]
    assert all(k == "card" and pii.luhn(pii._digits(x)) for x, k in added), added
    assert pii.Selector().spans("joe at x dot com") == []


# ---- decontamination, components, pipeline


def test_decontamination_in_blocks_judges_rows(spark):
    run = " ".join(f"t{k}" for k in range(20))
    docs = spark.createDataFrame([(1, run), (1, "all clean here"), (2, "clean too"), (None, run), (None, "clean with no id")], "doc_id long, text string")
    items = spark.createDataFrame([(7, run), (7, run), (8, "other words " * 30), (9, "more of it " * 30)], "item_id long, text string")
    for most in (1 << 20, 100):
        out = decontamination.clean(docs, items, most)
        assert sorted((r.doc_id or 0, r.text) for r in out.collect()) == [(0, "clean with no id"), (1, "all clean here"), (2, "clean too")]
        assert sorted((r.doc_id or 0, r["items"]) for r in decontamination.scan(docs, items, most).collect()) == [(0, []), (0, ["7"]), (1, []), (1, ["7"]), (2, [])]


def test_very_long_texts(spark, make):
    df = make(["x" * 300_000, "ab " * 120_000, " ".join(map(str, range(60_000))), "ü" * 100_000 + " " + "9" * 100_000])
    known = texts(df)
    got = {r.doc_id: r for r in sentencepieces.encode(df, PIECES).collect()}
    assert len(got) == 4 and all(got[i].decoded == known[i].rstrip() or got[i].decoded == known[i] for i in known)
    rows = {r.doc_id: (r.n_words, r.n_removed, r.kept) for r in substrings.remove(df).collect()}
    assert rows == brute_windows(known, 20)
    assert len(token_files.round_trip(df, WORDS, 2).collect()) == 4
    assert {r.doc_id: r.fp % (1 << 64) for r in simhash.classes(df).collect()} == {i: brute_fingerprint(t) for i, t in known.items()}
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert quality_rules.judge(df, none).count() == 4
    assert pii.find(df, pii.Selector()).count() == 4


def test_pipeline_of_odd_tables(spark, make, tmp_path):
    import corpus_pipeline as cp

    body = " ".join(f"w{k}" for k in range(80))
    other = " ".join(f"v{k} me@x.org" if k % 40 == 0 else f"v{k}" for k in range(90))
    cases = {"empty": make([]), "odd": make([*ODD, body, body, other, None], [*range(len(ODD)), 50, 50, None, None])}
    spark.createDataFrame([], "doc_id long, quality int, toxic int").coalesce(1).write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/benchmark.parquet")
    for name, df in cases.items():
        at = df
        for _, stage in cp.STAGES[:-1]:
            at = shared.cut(stage(spark, at, str(tmp_path)))
            assert at.columns == df.columns
        out = cp.STAGES[-1][1](spark, at, str(tmp_path)).collect()
        if name == "empty":
            assert out == []
        else:
            assert sorted((r.doc_id is None, r.decoded) for r in out) == [(False, body), (True, other.replace("me@x.org", "[EMAIL]"))]


def test_hexdigest_helpers():
    assert sha("") == hashlib.sha256(b"").hexdigest() and public_tokenizers.path("piece_bpe_32k.model") == PIECES


def test_pii_learns_from_every_document_and_example(spark, monkeypatch):
    text = "call +49 30 1234567 or 10.1.2.3"
    df = spark.range(21_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") == 7, F.lit(f"{text}, " * 30)).otherwise(F.lit(text)).alias("text"))
    n = len(pii.examples(text)[1])
    many = len(pii.examples(f"{text}, " * 30)[1])
    assert many > 60 and pii.learned(df).agg(F.sum("n")).first()[0] == 20_999 * n + many
    # sums by tasks give the very trees that sums on the driver give
    monkeypatch.setattr(pii, "Trees", lambda: Trees(trees=2))
    docs = spark.createDataFrame([(i, f"ip 10.{i}.2.{i % 7} or a.b{i}@c.org, +49 30 12{i}4567 at {i} dot 5") for i in range(60)], "doc_id long, text string")
    here, there = pii.fit(docs), pii.fit(docs, most=0)
    assert here.thresholds == there.thresholds and here.trees.slope == there.trees.slope
    assert all(np.array_equal(a, b) for x, y in zip(here.trees.forest, there.trees.forest, strict=True) for a, b in zip(x, y, strict=True))
