"""The text operators against brute force, the public libraries and small cases."""

import collections
import hashlib
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
import xxhash

from lumidex.llm import decontamination, language_id, pii, quality_classifier, quality_rules, queries, sentencepieces, shared, simhash, substrings, token_files, toxicity

SF = "/root/testdata/sf0.001"
ODD = [None, "", " ", "\n", "a", "word " * 3000, "A, b; c! " * 40, "tab\tand\x0bmore", "日本語 テスト \U0001f600", "é é", "same text here", "same text here"]
PIECES, WORDS = public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.path("word_bpe_49k.json")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def texts(df):
    return dict(df.select("doc_id", "text").toPandas().itertuples(index=False))


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def test_sentencepieces_equal_the_library(spark, docs, make):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    for df in (docs, make(ODD), make([])):
        known = texts(df)
        rows = sentencepieces.encode(df, PIECES).collect()
        assert len(rows) == len(known)
        for r in rows:
            ids = library.encode(known[r.doc_id] or "", add_eos=True)
            assert (r.ids, r.decoded) == (ids, library.decode(ids))


def test_token_files_round_trip(spark, docs, make):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(WORDS)
    for df in (docs, make(ODD), make([])):
        start = 0
        got = {r.doc_id: r for r in token_files.round_trip(df, WORDS, 2).collect()}
        known = texts(df)
        assert set(got) == set(known)
        for i in sorted(known):
            ids = [*library.encode(known[i] or "", add_special_tokens=False).ids, 2]
            assert (got[i].start, got[i].ids) == (start, ids)
            start += len(ids)


def test_token_files_repeated_and_null_ids(spark, make):
    rows = token_files.round_trip(make(["b", "a a a", "c"], [None, 1, 1]), WORDS, 2).collect()
    assert [r.doc_id for r in sorted(rows, key=lambda r: r.start)] == [None, 1, 1]


def test_huffman_codes_are_limited_and_decode():
    draw = np.random.default_rng(1)
    counts = {int(s): int(2 ** (s % 40)) + 1 for s in range(3000)}
    lengths = token_files.code_lengths(counts)
    assert max(lengths.values()) <= 16 and sum(2.0**-n for n in lengths.values()) <= 1
    book = token_files.Book(lengths)
    for n in (1, 63, 64, 65, 5000):
        ids = draw.integers(0, 3000, n).astype(np.int32)
        payload, marks = book.pack(ids)
        assert (book.unpack(payload, marks, n) == ids).all()
    assert token_files.code_lengths({7: 3}) == {7: 1}


def brute_windows(rows, size):
    first, split, out = {}, {}, {}
    for d, t in sorted(rows.items()):
        split[d] = w = words(t)
        for i in range(len(w) - size + 1):
            first.setdefault(tuple(w[i : i + size]), (d, i))
    for d, w in split.items():
        gone = {k for i in range(len(w) - size + 1) if first[tuple(w[i : i + size])] != (d, i) for k in range(i, i + size)}
        out[d] = len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)
    return out


@pytest.mark.parametrize("large", [20_000, 1])
def test_substrings_equal_brute_force(spark, docs, make, large):
    draw = np.random.default_rng(3)
    loops = [" ".join(draw.choice(list("ab"), 60)) for _ in range(20)] + ["x y " * 30] * 3
    for df in (docs, make(ODD + loops), make([])):
        got = {r.doc_id: (r.n_words, r.n_removed, r.kept) for r in substrings.remove(df, large=large).collect()}
        assert got == brute_windows(texts(df), 20)


def test_substrings_repeated_ids(spark, make):
    long = " ".join(map(str, range(30)))
    rows = substrings.remove(make([long, long, "a b", None], [5, 5, None, 7])).collect()
    assert sorted((r.doc_id or -1, r.n_removed) for r in rows) == [(-1, 0), (5, 0), (5, 30), (7, 0)]


JOINS = {
    "broadcast": {"spark.sql.autoBroadcastJoinThreshold": "10m"},
    "hash": {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold": "64m"},
    "merge": {"spark.sql.autoBroadcastJoinThreshold": "-1"},
}


@pytest.mark.parametrize("join", sorted(JOINS))
def test_substrings_of_unordered_rows(spark, make, join):
    draw = np.random.default_rng(5)
    hot = " ".join(f"h{k}" for k in range(40))
    rows = [" ".join([*draw.choice(list("abcdefgh"), 30), hot[3 * (k % 7) :], *draw.choice(list("ijklmnop"), 30)]) for k in range(60)]
    df = make(rows, range(60, 0, -1)).repartition(16)
    old = {k: spark.conf.get(k, None) for k in JOINS[join]}
    try:
        for k, v in JOINS[join].items():
            spark.conf.set(k, v)
        got = {r.doc_id: (r.n_words, r.n_removed, r.kept) for r in substrings.remove(df, large=1).collect()}
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    assert got == brute_windows(texts(df), 20)


def test_substrings_displaced_windows_are_copies():
    import pyarrow as pa

    text, asked = " ".join(map(str, range(20))), [[{"kind": 2, "bucket": 1, "start": 0, "n": 1}]]
    for ids in ([5, 7, 9], [9, 7, 5], [7, 5, 9]):
        batch = pa.RecordBatch.from_arrays([pa.array(ids), pa.array([text] * 3), pa.array(asked * 3)], names=["doc_id", "text", "asked"])
        rows = [r for b in substrings._packed(iter([batch]), 20) for r in b.to_pylist()]
        assert sorted(r["doc_id"] for r in rows if r["bucket"] is None) == [7, 9]
        assert [r["doc_id"] for r in rows if r["bucket"] is not None] == [5]


def brute_fingerprint(text):
    w = words(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    grams = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << k for k in range(64) if 2 * sum(x >> k & 1 for x in h) > len(h))


def brute_components(prints):
    root = {d: d for d in prints}

    def top(d):
        while root[d] != d:
            d = root[d]
        return d

    ids = sorted(prints)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            if (prints[a] ^ prints[b]).bit_count() <= 2:
                x, y = sorted((top(a), top(b)))
                root[y] = x
    return {d: top(d) for d in ids}


def test_simhash_equals_brute_force(spark, docs, make):
    base = " ".join(f"w{k}" for k in range(300))
    near = [base, base.replace("w5 ", "v5 "), base + " end", base.upper()]
    for df in (docs, make(ODD + near), make([])):
        prints = {d: brute_fingerprint(t) for d, t in texts(df).items()}
        want = brute_components(prints)
        got = {r.doc_id: (r.fp % (1 << 64), r.component_id) for r in simhash.classes(df).collect()}
        assert got == {d: (prints[d], want[d]) for d in prints}


def test_dedup_repeated_and_null_ids(spark, make):
    draw = np.random.default_rng(2)
    one, two, three, four = (" ".join(f"{c}{k}" for k in draw.integers(0, 10**6, 300)) for c in "abcd")
    near = one.upper()  # the same fingerprint
    cases = [
        ([(5, one), (5, two), (3, two)], [(3, two), (5, one)]),
        ([(None, one), (None, two), (4, two), (None, three)], [(4, two), (None, one), (None, three)]),
        ([(5, one), (5, near)], [(5, min(one, near))]),
        ([(None, near), (None, one), (None, one)], [(None, min(one, near))]),
        ([(5, one), (5, one), (6, four), (6, four), (2, four)], [(5, one), (2, four)]),
        ([], []),
    ]
    for rows, want in cases:
        df = make([t for _, t in rows], [i for i, _ in rows])
        out = simhash.dedup(df)
        assert out.columns == df.columns
        assert collections.Counter((r.doc_id, r.text) for r in out.collect()) == collections.Counter(want)


def test_quality_rule_counts(spark, docs, make):
    for df in (docs, make([*ODD, "x y\nx y\n\nz\n#$ & <>"]), make([])):
        known = texts(df)
        rows = quality_rules.judge(df, spark.read.parquet(f"{SF}/labels.parquet")).collect()
        assert len(rows) == len(known)
        for r in rows:
            t = known[r.doc_id] or ""
            w = words(t)
            seen = collections.Counter(zip(w, w[1:], w[2:], strict=False))
            again = {k for i in range(len(w) - 2) if seen[tuple(w[i : i + 3])] > 1 for k in range(i, i + 3)}
            lines = [x for x in t.split("\n") if words(x)]
            failed = len(w) < 50 or 100 * len(again) > 50 * len(w)
            assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(again), failed)
            assert not (r.kept and failed)


def brute_spans(text):
    out = [(m.start(), m.end(), "email") for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [(m.start(), m.end(), "ip") for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = [int(c) for c in m[0] if c.isdigit()]
        if 12 <= len(d) <= 19 and sum(x if k % 2 == 0 else sum(divmod(2 * x, 10)) for k, x in enumerate(d[::-1])) % 10 == 0:
            out.append((m.start(), m.end(), "card"))
    out += [(m.start(), m.end(), "phone") for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= sum(c.isdigit() for c in m[0]) <= 15]
    return sorted(out, key=lambda x: (x[0], pii.KINDS.index(x[2])))


def test_pii_base_spans_and_redaction(spark, docs, make):
    more = ["a.b@c.de, x@y.z@w.v 1.2.3.4.5.6.7.8 300.1.1.1 4111 1111 1111 1111 +1 (974) 555-3436 0.0.0.0", "9" * 6000, "+1" + "2" * 20, "mail a@b"]
    for df in (docs, make(ODD + more), make([])):
        known, selector = texts(df), pii.fit(df)
        for r in pii.find(df, selector).collect():
            assert [(s.start, s.stop, s.kind) for s in r.spans if s.base] == brute_spans(known[r.doc_id] or "")
        clean = pii.redact(df, selector)
        assert clean.columns == df.columns
        for i, t in texts(clean).items():
            spans = brute_spans(known[i] or "")
            assert t == known[i] if not spans and t == known[i] else not any((known[i])[a:b] in t for a, b, k in spans if k == "email")


def brute_hits(text, items):
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    phrases = collections.defaultdict(set)
    for i, t in items:
        w = split(t)
        n = min(13, len(w))
        for a in range(len(w) - n + 1 if n else 0):
            phrases[tuple(w[a : a + n])].add(str(i))
    w, hit, found = split(text), set(), set()
    for n in {len(p) for p in phrases}:
        for a in range(len(w) - n + 1):
            if tuple(w[a : a + n]) in phrases:
                hit.update(range(a, a + n))
                found |= phrases[tuple(w[a : a + n])]
    return len(w), len(hit), sorted(found)


@pytest.mark.parametrize("most", [1 << 20, 200])
def test_decontamination_equals_brute_force(spark, docs, make, most):
    run = " ".join(f"t{k}" for k in range(40))
    small = spark.createDataFrame([(1, run), (2, "Short one"), (3, None), (4, "..."), (5, run), (None, "same text")], "item_id long, text string")
    held = ["x " + run, "a short one here", "SHORT, one. short one", run.upper() * 2, " ".join(["a"] * 500) + " " + run]
    for df, items in ((docs, spark.read.parquet(f"{SF}/benchmark.parquet")), (make(ODD + held), small), (make([]), small), (make(ODD), small.limit(0))):
        known, asked = texts(df), [(r.item_id, r.text) for r in items.collect() if r.item_id is not None]
        rows = decontamination.scan(df, items, most).collect()
        assert len(rows) == len(known)
        for r in rows:
            want = brute_hits(known[r.doc_id], asked)
            assert (r.n_words, r.n_hit, sorted(r["items"])) == want
            assert sum(s.stop - s.start for s in r.spans) == r.n_hit
            assert r.contaminated == (r.n_hit > 0 and 20 * r.n_hit >= r.n_words)
        assert decontamination.clean(df, items, most).count() == sum(not r.contaminated for r in rows)


def test_language_id_held_out_accuracy(spark, make):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = language_id.fit(df)
    rows = language_id.predict(df, model).join(df.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in rows if zlib.crc32(str(r.doc_id).encode()) % 4 == 2]
    assert np.mean([r.lang == r.lang_pred for r in held]) > 0.97
    odd = language_id.predict(make(ODD), model).collect()
    assert len(odd) == len(ODD) and {r.lang_pred for r in odd if not re.search(r"[^\W\d_]", ODD[r.doc_id] or "")} == {"und"}
    assert all(0 <= r.score <= 1 for r in odd)
    assert language_id.fit(make([])).predict(["a"])[0] == ["und"]


@pytest.mark.parametrize(("name", "label", "parts", "rest", "cut", "least"), [("quality", "quality", 3, 1, 0.5, 0.95), ("toxic", "toxic", 4, 2, 0.3, 0.93)])
def test_classifiers_held_out_accuracy(spark, make, name, label, parts, rest, cut, least):
    sf = "/root/testdata/sf0.01"
    module = quality_classifier if name == "quality" else toxicity
    model = module.fit(shared.labelled(spark, sf, label, parts, rest, module.SAMPLE))
    labels = dict(spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", label).toPandas().itertuples(index=False))
    rows = module.score(spark.read.parquet(f"{sf}/documents.parquet"), model).collect()
    held = [r for r in rows if r.doc_id in labels and zlib.crc32(str(r.doc_id).encode()) % parts == rest]
    assert np.mean([(r.score >= cut) == labels[r.doc_id] for r in held]) >= least
    odd = module.score(make(ODD), model).collect()
    assert len(odd) == len(ODD) and all(0 <= r.score <= 1 for r in odd)
    empty = module.fit(spark.createDataFrame([], "doc_id long, text string, y int, held boolean"))
    assert module.score(make(["a", None]), empty).count() == 2


def test_toxicity_folds_disguises():
    assert toxicity.folded("1d10t cl0wn ТRАSН 42 a1 $h@dy fooool") == ["idiot", "clown", "trash", "a", "shady", "fooool"]
    lexicon = toxicity.Lexicon({" clown ": 2.0}, (" circus clown ",), 0.5, 5.0, -3.0)
    assert lexicon.score("you cl0wn") > 0.5 > lexicon.score("the circus clown") == lexicon.score(None)


def test_toxicity_learns_from_all_but_near_copies(spark):
    draw = np.random.default_rng(11)
    fresh = lambda n: [f"w{''.join(chr(97 + int(c)) for c in str(k))}" for k in draw.integers(0, 10**6, n)]
    # six words only: many pairs in common, hardly any run of five
    rows = [(k, " ".join(draw.choice("ever of the same few words".split(), 40)), k % 3 // 2, False) for k in range(60)]
    long = fresh(200)
    rows += [(100 + k, " ".join([*long[:k], "new", *long[k + 1 :]]), 1, False) for k in range(10, 190, 20)]  # near copies: 9 rows, one stays
    rows += [(400, " ".join(long), 0, False), (401, " ".join(long).upper(), 0, False)]  # of the other label: one stays
    rows += [(500, " ".join([*long[:100], *fresh(100)]), 1, False)]  # a half in common: stays
    rows += [(600, "a b", 0, False), (600, "a b", 0, False), (600, "b a", 0, False), (601, "", 0, False), (602, "", 1, False)]  # a row twice; repeated id
    df = spark.createDataFrame(rows, "doc_id long, text string, y int, held boolean").repartition(5)
    kept = sorted((r.doc_id, r.y) for r in toxicity._once(df).collect())
    assert kept == sorted([*((k, k % 3 // 2) for k in range(60)), (110, 1), (400, 0), (500, 1), (600, 0), (600, 0), (601, 0), (602, 1)])


def test_pipeline_stages(spark, docs):
    import corpus_pipeline as cp

    at, kept = docs, texts(docs)
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    judged = {r.doc_id: r.kept for r in quality_rules.judge(docs, labels).collect()}
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    for name, stage in cp.STAGES[:-1]:
        at = shared.cut(stage(spark, at, SF))
        assert at.columns == docs.columns
        if name == "quality rules":
            kept = {d: t for d, t in kept.items() if judged[d]}
        elif name == "near duplicates":
            roots = brute_components({d: brute_fingerprint(t) for d, t in kept.items()})
            kept = {d: t for d, t in kept.items() if roots[d] == d}
        elif name == "decontamination":
            hit = {d: brute_hits(t, items) for d, t in kept.items()}
            kept = {d: t for d, t in kept.items() if not hit[d][1] or 20 * hit[d][1] < hit[d][0]}
        assert set(texts(at)) == set(kept)
        if name == "personal data":
            kept = texts(at)
        assert texts(at) == kept
    rows = cp.run(spark, SF).collect()
    assert {r.doc_id: r.decoded for r in rows} == kept


def test_registry(spark):
    assert all(f.__name__ == name for name, f in queries.QUERIES.items())
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES if n != "quality_rules_planted") == list(range(1, 14))
