"""Conversation repair, source divergence and streaming deduplication against brute force on small tables."""

import hashlib
import itertools
import random
import re
import zlib
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from lumidex.llm import conversation_repair, exact_dedup, source_divergence

CONV = "conv_id long, turn long, role string, text string, piece string, cost double, gone_by string"
SPACE = " \t\n\x0b\x0c\r"


def cases(n, longest, seed):
    """Random conversations with nulls, odd roles, repeated rows and blank texts."""
    rng, rows = random.Random(seed), []
    for conv in [*range(n), None]:
        for turn in range(rng.choice([1, 2, 3, longest])):
            turn = rng.choice([turn, turn, turn, None, turn // 2])
            rows += [(conv, turn, rng.choice(["user", "assistant", "system", "user", "assistant", "tool", "", None, "u"]), rng.choice(["A b.", "c d", "Yes!", " ", "", None, "\n", f"x{rng.random()}?", "é. \t"]), "p", 1.0, "x")] * rng.choice([1, 1, 1, 2])
    return rows


def damage(rows):
    out = {}
    for conv, turn, role, text, *_ in rows:
        got = out.setdefault(conv, [])
        role, text = (" " if x is None else x for x in (role, text))
        part = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if part == 1 else re.sub("[.!?]", "", text) if part == 2 else text
        got += [(turn, "user" if part == 4 else role, text)] * (0 if part == 0 else 2 if part == 3 else 1)
    for got in out.values():
        got.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).hexdigest()))
    return out


def faults(rows):
    seen, out = set(), []
    for _, role, text in rows:
        bare = text.strip(SPACE)
        out.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def cheapest(rows):
    """The least cost, then the least audit, over all states after each row, with the messages."""
    made, name = {"": "u", "s": "u", "u": "a", "a": "u"}, {"u": "user", "a": "assistant"}

    def inserts(best):
        for _ in range(3):
            for s, (cost, audit, said) in list(best.items()):
                t = made[s]
                best[t] = min(best.get(t, (10**9,)), (cost + 2, audit + "I", [*said, (name[t], "")]))
        return best

    best = inserts({"": (0, "", [])})
    for (_, role, text), fault in zip(rows, faults(rows), strict=True):
        after = {}
        for s, (cost, audit, said) in best.items():
            options = [(s, cost + 3, "D", [])]
            if fault not in ("blank", "duplicate"):
                extra = fault == "truncated"
                t = role[:1]
                if (s, t) in {("", "s"), ("", "u"), ("s", "u"), ("u", "a"), ("a", "u")}:
                    options.append((t, cost + extra, "K", [(role, text)]))
                options.append((made[s], cost + 2 + extra, "R", [(name[made[s]], text)]))
            for t, c, e, more in options:
                after[t] = min(after.get(t, (10**9,)), (c, audit + e, said + more))
        best = inserts(after)
    return min(best[s] for s in ("", "a") if s in best)


def every(rows):
    """The same by trying all edits of at most two rows."""
    found, some = [], [x for n in range(3) for x in itertools.product("ua", repeat=n)]
    name, fault = {"u": "user", "a": "assistant"}, faults(rows)
    for gaps in itertools.product(some, repeat=len(rows) + 1):
        for edits in itertools.product("DKUA", repeat=len(rows)):
            cost, audit, said = 2 * len(gaps[0]), "I" * len(gaps[0]), [(name[x], "") for x in gaps[0]]
            for (_, role, text), f, e, gap in zip(rows, fault, edits, gaps[1:], strict=True):
                if f in ("blank", "duplicate") and e != "D":
                    break
                cost += {"D": 3, "K": 0}.get(e, 2) + 2 * len(gap) + (f == "truncated" and e != "D")
                audit += ("R" if e in "UA" else e) + "I" * len(gap)
                said += ([] if e == "D" else [(role if e == "K" else name[e.lower()], text)]) + [(name[x], "") for x in gap]
            else:
                if re.fullmatch("(s?(ua)+)?", "".join(r[:1] or "-" for r, _ in said)):
                    found.append((cost, audit, said))
    return min(found)


def expected(conv, rows):
    f, turns = faults(rows), [t for t, *_ in rows if t is not None]
    cost, audit, said = cheapest(rows)
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(rows))
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    return (conv, gaps, f.count("blank"), f.count("duplicate"), f.count("truncated"), illegal, cost, audit, hashlib.sha256("\n".join(f"{r}:{t}" for r, t in said).encode()).hexdigest())


@pytest.mark.parametrize(("piece", "longest", "parts"), [(1024, 8, 1), (3, 40, 4), (1, 9, 3)])
def test_conversations_against_brute_force(spark, piece, longest, parts):
    rows = cases(60, longest, piece)
    table = spark.createDataFrame(rows, CONV).repartition(parts)
    out = conversation_repair.solve(conversation_repair.damaged(table), piece)
    sha = {r.conv_id: r.repaired_sha256 for r in conversation_repair.digests(out.messages).collect()}
    found = {r.conv_id: (*r, sha[r.conv_id]) for r in out.summary.collect()}
    assert found == {c: expected(c, r) for c, r in damage(rows).items()}


def test_cheapest_edits_by_trying_all():
    texts = [("user", "A."), ("assistant", "b"), ("system", "C!"), ("tool", "d?"), ("", "e."), ("user", " "), ("user", "A.")]
    for n in range(3):
        for rows in itertools.product(texts, repeat=n):
            rows = [(k, *r) for k, r in enumerate(rows)]
            assert cheapest(rows) == every(rows)


def test_one_conversation_of_many_equal_rows(spark):
    """One conversation over all tasks, its turns null, mostly of one row; and one whose rows are all gone."""
    rows = [(7, None, "user", "Hi.", "p", 1.0, "x")] * 3000 + [(7, k, "assistant" if k % 2 else "user", f"t{k}.", "p", 1.0, "x") for k in range(3000)]
    table = spark.createDataFrame(rows, CONV).withColumn("gone", F.lit(False)).union(spark.createDataFrame([(8, 1, "user", "x", "p", 1.0, "x")], CONV).withColumn("gone", F.lit(True)))
    out = conversation_repair.solve(table.repartition(4), 256)
    got = {r.conv_id: r for r in out.summary.collect()}
    assert (got[7].duplicate, got[7].gaps, got[7].cost) == (2999, 0, 2 + 2999 * 3)  # t0 follows Hi. as a second user turn
    assert got[7].audit == cheapest([(k, *r[2:4]) for k, r in enumerate(rows)])[1]
    assert tuple(got[8]) == (8, 0, 0, 0, 0, 0, 0, "")
    assert sum(len(r.messages) for r in out.messages.where("conv_id = 7").collect()) == 3002
    assert conversation_repair.solve(table.limit(0)).summary.count() == 0


TEXTS = ["the cat the dog", "The CAT saß é", "", None, "cat 12 dog-dog cat", "x" * 5000 + " cat", "été été été the", "12 34", "dog"]


def audited(rows, least, top):
    docs = [(a or "", b or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m.group().lower(), t or ""))) for a, b, t in rows]
    out = []
    for lang in {d[0] for d in docs}:
        here = [d for d in docs if d[0] == lang]
        terms = {w for d in here for w in d[2]}
        kept = [w for w in terms if sum(w in d[2] for d in here) >= least]
        count = {s: {w: sum(d[2].count(w) for d in here if d[1] == s) for w in kept} for s in {d[1] for d in here}}
        everywhere = {w: sum(c[w] for c in count.values()) for w in kept}
        p = lambda c, w: 1 + int(Fraction(10**9 * (c[w] + 5), sum(c.values()) + 5 * len(kept)) // 1)
        for s, c in count.items():
            pair = [(o, sum(abs(p(c, w) - p(count[o], w)) for w in kept)) for o in count if o != s]
            term = [(w, p(c, w) - p(everywhere, w)) for w in kept if c[w] and p(c, w) > p(everywhere, w)]
            for part, found, most in (("pair", pair, len(pair)), ("term", term, top)):
                found.sort(key=lambda x: (-x[1], x[0].encode()))
                out += [(lang, s, part, w, v, k + 1) for k, (w, v) in enumerate(found[:most])]
    return sorted(out)


@pytest.mark.parametrize(("least", "tile", "slices"), [(3, 256, 4096), (2, 2, 2), (100, 3, 5)])
def test_divergence_against_brute_force(spark, least, tile, slices):
    rng = random.Random(least)
    rows = [(rng.choice(["en", "fr", None, "en"]), rng.choice(["a", "b", "é", None, "c", "d"]), rng.choice(TEXTS)) for _ in range(150)]
    docs = spark.createDataFrame([(*r, 1, 2, "x") for r in rows], "lang string, source string, text string, value long, term int, item string").repartition(3)
    got = source_divergence.audit(docs, least, 5, tile, slices)
    assert sorted(map(tuple, got.collect())) == audited(rows, least, 5)
    assert source_divergence.audit(docs.limit(0)).count() == 0


def test_frequencies_are_exact(spark):
    rng = random.Random(1)
    rows = [(c, c + rng.randrange(1, 10**13)) for c in (0, 1, 7, 10**6, 10**9 + 7, 10**12 + 1, 123456789012345)]
    want = [1 + 10**9 * (c + 5) // n for c, n in rows]
    table = spark.createDataFrame(rows, "c long, n long").repartition(1)
    assert [r[0] for r in table.select(source_divergence.frequency(F.col("c"), F.col("n"))).collect()] == want
    import numpy as np

    assert source_divergence.frequencies(*(np.array(x) for x in zip(*rows, strict=True))).tolist() == want


def decided(rows):
    """rows: (doc_id, text) in the order of the files."""
    groups = {}
    for at, (doc, text) in enumerate(rows):
        groups.setdefault("".join(c for c in text or "" if c not in SPACE), []).append((-len(text or ""), doc is None, doc or 0, at))
    return sorted(
        (rows[at][0] if rows[at][0] is not None else -1, -1 if rows[min(g)[3]][0] is None else rows[min(g)[3]][0], len(g), (size, void, doc, at) == min(g), hashlib.sha256(t.encode()).hexdigest()) for t, g in groups.items() for size, void, doc, at in g
    )


DEDUP = [(5, "a b"), (2, "ab"), (1, "a  b"), (9, "a  b"), (1, "a  b"), (None, "a  b"), (4, None), (3, ""), (8, " \n"), (None, "z"), (6, "z" * 200_000), (7, "z " * 200_000), (10, "é\x85"), (11, "é ")] + [(100 + k, "copy \t me") for k in range(40)]


def written(spark, tmp_path, rows, name="docs.parquet", files=1):
    path = str(tmp_path / name)
    spark.createDataFrame([(d, t, "x", 1) for d, t in rows], "doc_id long, text string, digest string, keep int").coalesce(files).write.mode("append").parquet(path)
    return path


@pytest.mark.parametrize("bits", [None, 0, 4])
def test_dedup_against_brute_force(spark, tmp_path, bits, monkeypatch):
    """Whole digests, one digest for all texts, and four bits of it: different texts never share a group."""
    monkeypatch.setattr(exact_dedup, "SALT", 7)
    path = written(spark, tmp_path, DEDUP)
    weak = exact_dedup.sha256 if bits is None else lambda sha: F.unhex(F.substring(sha, 1, 1) if bits else F.lit("00"))
    got = exact_dedup.dedup(spark, path, weak).na.fill(-1, ["doc_id", "keep_id"])
    assert sorted(map(tuple, got.collect())) == decided(DEDUP)
    if bits == 0:
        groups = exact_dedup.absorb(spark, path, str(tmp_path / "state"), weak)
        assert exact_dedup.mismatched(spark.read.parquet(path), groups, weak).count() == 1


def test_dedup_goes_on_with_new_files(spark, tmp_path):
    path, state = written(spark, tmp_path, DEDUP[:9]), str(tmp_path / "state")
    first = exact_dedup.absorb(spark, path, state, per_batch=1)
    assert first.agg(F.sum("n")).first()[0] == 9
    written(spark, tmp_path, DEDUP[9:], files=2)
    again = exact_dedup.absorb(spark, path, state)
    docs = spark.read.parquet(path)
    assert {(r.digest, r.n) for r in again.collect()} == {(r.digest, r.n) for r in exact_dedup.absorb(spark, path, str(tmp_path / "other")).collect()}
    got = sorted((r.group_size, r.text_sha256) for r in exact_dedup.decide(docs, again).collect())
    assert got == sorted((x[2], x[4]) for x in decided(DEDUP))


def test_dedup_of_an_empty_table(spark, tmp_path):
    path = written(spark, tmp_path, [])
    assert exact_dedup.dedup(spark, path).count() == 0
