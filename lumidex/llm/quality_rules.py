"""Quality rules with risk-controlled cutoffs, in DataFrame functions only.

Each document gets counts of its whole text. A rule is the share of such a count
and a cutoff; which cutoffs are allowed is decided on labelled holdouts: within a
stratum (class of length) a cutoff is admitted if the exact binomial tail shows
that it rejects at most `risk` / rules of the good documents, at a confidence
that is split over all strata and rules (Bonferroni) and, within one rule, spent
by testing its cutoffs from the most lenient on and stopping at the first that
fails. Among admitted cutoffs the one that rejects most of the labelled bad
documents is used, the most lenient of equals. No admitted cutoff: no rejection.

Defined results: null or empty text has no words, all counts 0, `base_failed`
true and `kept` false. Null ids and repeated rows are judged row by row; labels
of a repeated id count once, good only if all agree. Without usable labels only
the base rule decides. Extra columns of the input are ignored by `features` and
kept by `keep`.
"""

from __future__ import annotations

from collections.abc import Callable
from math import exp, lgamma, log, log1p

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import cut, stored

GAPS = r"[\x20\x09-\x0D]+"
#: Strata by number of words: upper bounds, exclusive.
STRATA = (200, 1000)
#: rule -> (count, size it is a share of, cutoffs from the most lenient on)
RULES = {
    "symbols": ("n_symbols", "word_chars", (0.5, 0.4, 0.3, 0.2, 0.15, 0.1, 0.07, 0.05, 0.03, 0.02)),
    "dup_lines": ("n_dup_lines", "n_lines", (0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3, 0.2)),
    "repeats": ("n_repeat_words", "n_words", (0.5, 0.45, 0.4, 0.35, 0.3, 0.25, 0.2, 0.15, 0.1)),
}
RISK, DELTA = 0.03, 0.05


def _reach(starts: Column) -> Column:
    """How many words the 3-word windows at sorted positions cover."""
    three = F.lit(3).cast("long")
    reach = F.transform(starts, lambda p, k: F.least(three, F.coalesce(F.get(starts, k + 1) - p, three)))
    return F.aggregate(reach, F.lit(0).cast("long"), lambda a, b: a + b)


def _repeat_words(df: DataFrame, digest: Callable[..., Column] = F.xxhash64) -> DataFrame:
    """Adds n_repeat_words from `_w`: positions are packed under the hash of their 3-word window,
    so one sort of longs brings equal windows together; neighbours are then compared word by word.
    Where neighbours have one hash but not the same words, the row's windows are sorted as words instead."""
    n = F.size("_w")
    # low bits hold the position, so texts of any length fit
    low = F.call_function("shiftleft", F.lit(1).cast("long"), F.length(F.bin(n.cast("long")))) - 1
    df = df.withColumn("_low", low)
    window = lambda i: digest(F.get("_w", i), F.get("_w", i + 1), F.get("_w", i + 2))
    places = F.sequence(F.lit(0), n - 3)
    packed = F.transform(places, lambda i: window(i).bitwiseAND(F.bitwise_not(F.col("_low"))).bitwiseOR(i.cast("long")))
    df = df.withColumn("_s", F.when(n >= 4, F.sort_array(packed)).otherwise(F.array().cast("array<long>")))
    high = lambda x: x.bitwiseAND(F.bitwise_not(F.col("_low")))

    def same(x: Column, y: Column) -> Column:
        i, j = (x.bitwiseAND(F.col("_low"))).cast("int"), (y.bitwiseAND(F.col("_low"))).cast("int")
        words = F.lit(True)
        for k in range(3):
            words = words & (F.get("_w", i + k) == F.get("_w", j + k))
        return F.coalesce((high(x) == high(y)) & words, F.lit(False))

    before = lambda k: F.get("_s", F.greatest(k - 1, F.lit(0)))
    again = F.filter("_s", lambda x, k: same(x, F.get("_s", k + 1)) | ((k > 0) & same(x, before(k))))
    clash = F.size(F.filter("_s", lambda x, k: (k > 0) & (high(x) == high(before(k))) & ~same(x, before(k)))) > 0
    exact = F.sort_array(F.transform(places, lambda i: F.struct(F.get("_w", i).alias("a"), F.get("_w", i + 1).alias("b"), F.get("_w", i + 2).alias("c"), i.cast("long").alias("i"))))
    df = df.withColumn("_e", F.when(clash, exact))  # null for nearly all rows
    key = lambda x: F.struct(x.a, x.b, x.c)
    alike = lambda x, k: F.coalesce(key(x) == key(F.get("_e", k)), F.lit(False))
    twice = F.filter("_e", lambda x, k: alike(x, k + 1) | ((k > 0) & alike(x, F.greatest(k - 1, F.lit(0)))))
    df = df.withColumn("_r", F.sort_array(F.when(F.col("_e").isNotNull(), F.transform(twice, lambda x: x.i)).otherwise(F.transform(again, lambda x: x.bitwiseAND(F.col("_low"))))))
    return df.withColumn("n_repeat_words", _reach(F.col("_r")))


def features(df: DataFrame, keep: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """`keep` columns plus the counts of each row's whole text."""
    one = F.coalesce(F.col(text), F.lit(""))
    df = df.select(*keep, one.alias("_t"))
    df = df.withColumn("_w", F.filter(F.split("_t", GAPS), lambda w: w != ""))
    df = df.withColumn("_l", F.filter(F.split("_t", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    df = _repeat_words(df)
    counts = F.struct(
        F.size("_w").cast("long").alias("n_words"),
        F.length(F.array_join("_w", "")).cast("long").alias("word_chars"),
        F.regexp_count("_t", F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
        "n_repeat_words",
        F.size("_l").cast("long").alias("n_lines"),
    )
    # one row in, one row out; a filter on a count can't move below it and repeat the expressions
    df = df.select(*keep, F.explode(F.array(counts)).alias("_x")).select(*keep, "_x.*")
    return df.withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))


def stratum() -> Column:
    out = F.lit(len(STRATA))
    for k in range(len(STRATA) - 1, -1, -1):
        out = F.when(F.col("n_words") < STRATA[k], k).otherwise(out)
    return out


def _share(rule: str) -> Column:
    count, size, _ = RULES[rule]
    return F.coalesce(F.try_divide(F.col(count), F.col(size)), F.lit(0.0))


def binomial_tail(k: int, n: int, p: float) -> float:
    """P(X <= k) for X ~ Binomial(n, p), exact up to rounding."""
    if k >= n:
        return 1.0
    base = lgamma(n + 1)
    return min(1.0, sum(exp(base - lgamma(i + 1) - lgamma(n - i + 1) + i * log(p) + (n - i) * log1p(-p)) for i in range(k + 1)))


def cutoffs(feats: DataFrame, labels: DataFrame, risk: float = RISK, delta: float = DELTA) -> dict[tuple[int, str], float]:
    """The cutoff of each (stratum, rule) that has one. One aggregate of strata x (1 + cutoffs) counts is collected."""
    one = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull()).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    known = feats.where(~F.col("base_failed")).join(one, "doc_id")
    counts = [F.count_if((F.col("quality") == q) & (_share(r) > c)).alias(f"{r}|{i}|{q}") for r, (_, _, cs) in RULES.items() for i, c in enumerate(cs) for q in (0, 1)]
    rows = known.groupBy(stratum().alias("stratum")).agg(F.count_if(F.col("quality") == 1).alias("good"), *counts).collect()
    level, limit, out = delta / ((len(STRATA) + 1) * len(RULES)), risk / len(RULES), {}
    for row in rows:
        for rule, (_, _, steps) in RULES.items():
            best = 0
            for i, c in enumerate(steps):
                if not row["good"] or binomial_tail(row[f"{rule}|{i}|1"], row["good"], limit) > level:
                    break
                if row[f"{rule}|{i}|0"] > best:
                    best = row[f"{rule}|{i}|0"]
                    out[row["stratum"], rule] = c
    return out


def verdict(chosen: dict[tuple[int, str], float]) -> Column:
    """True where a document passes the base rule and all cutoffs of its stratum."""
    bad = F.col("base_failed")
    for (s, rule), c in sorted(chosen.items()):
        bad = bad | ((stratum() == s) & (_share(rule) > c))
    return ~bad


def judge(docs: DataFrame, labels: DataFrame, risk: float = RISK, delta: float = DELTA) -> DataFrame:
    """One row per document: its counts, base_failed and kept."""
    feats = cut(features(docs))
    return feats.withColumn("kept", verdict(cutoffs(feats, labels, risk, delta)))


def keep(docs: DataFrame, labels: DataFrame, risk: float = RISK, delta: float = DELTA) -> DataFrame:
    """The documents that are kept, with all their columns. Counted once: rows are written with their counts, and
    the cutoffs and the filter read them from there, so no text is shuffled and none is counted twice."""
    names = [f"_c{k}" for k in range(len(docs.columns))]
    own = docs.toDF(*names).withColumn("text", F.col(names[docs.columns.index("text")]))
    counted = stored(features(own, tuple(names)), "quality-counts")
    chosen = cutoffs(counted.withColumnRenamed(names[docs.columns.index("doc_id")], "doc_id"), labels, risk, delta)
    return counted.where(verdict(chosen)).select(*names).toDF(*docs.columns)
