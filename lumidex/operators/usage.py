"""Usage counts over a search: which values rows use, how often, when, and how those rows are judged.

Settings, models and collections are tallied in one pass, with sums by slot of time. Words and whole prompts, of which
nearly all occur once, are counted first, by partial sums of each task, and tallied by slot for the few that are
reported. Prompts are counted by their digest along with their first letters; texts are compared only
among those that these letters leave level with the last one reported. Defined results: rows without
a value of a kind don't count for it; of equally used values the first in order of their text is ahead, as
it was last written; an empty table gives an empty result. Plans of `usage` run jobs when they are made.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..checkpoints import cut
from ..functions import facets as FA
from ..functions import text as T

SLOTS, TOP, SAMPLES, HEAD = 24, 100, 3, 64
MOST = {"word": 60, "prompt": 50, "rating": 6, "flag": 2}
SAMPLED = ("model", "lora", "aux")
FLAGS = {1: "keep", 2: "reject"}
#: What `functions.text.prompt_words` takes for words before it looks at their letters.
WORD, TAG = regex.compile(r"[[\p{Alphabetic}\p{N}]&&[\x00-\u2E7F]]{3,}", regex.V1), regex.compile(T.TAG)
#: Counters that a task holds at once; beyond them it passes on what it has.
COUNTERS = 200_000


def pairs() -> Column:
    """(kind, key, value, role) of all that a row uses but for words and whole prompts, each once."""
    one = lambda kind, key: F.struct(F.lit(kind).alias("kind"), key.alias("key"), key.alias("value"), F.lit("").alias("role"))
    counted = F.filter("facets", lambda f: f["kind"].isin(*FA.COUNTED))
    flag = F.coalesce(*[F.when(F.col("flag") == n, F.lit(w)) for n, w in FLAGS.items()], F.lit(""))
    fixed = F.filter(F.array(one("rating", F.col("rating").cast("string")), one("flag", flag)), lambda x: x["key"] != "")
    named = F.transform(F.filter("collections", lambda c: c != ""), lambda c: F.struct(F.lit("collection").alias("kind"), F.lower(c).alias("key"), c.alias("value"), F.lit("").alias("role")))
    return F.concat(counted, fixed, named)


def _words(text: str | None) -> set[str]:
    return set(WORD.findall(TAG.sub(" ", text) if "<" in text else text)) if text else set()


def word_counts(rows: DataFrame) -> DataFrame:
    """(key, uses) of every word worth counting, by the number of prompts that have it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter = Counter()

        def told() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int64())], names=["key", "n"])
            found.clear()
            return out

        for b in batches:
            for text in b.column(0).to_pylist():
                found.update(_words(text))
                if len(found) > COUNTERS:
                    yield told()
        yield told()

    counts = rows.select("prompt").mapInArrow(run, "key string, n long").groupBy("key").agg(F.sum("n").alias("uses"))
    return counts.where(T.is_telling(F.col("key")))


def _among(words: list[str]):
    """A step from (prompt, slot, rating, flag) to (key, slot, rating, flag, n) of some words alone."""
    wanted = frozenset(words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found: Counter = Counter()
            for text, *marks in zip(*(c.to_pylist() for c in b.columns), strict=True):
                found.update((w, *marks) for w in wanted & _words(text))
            columns = list(zip(*found, strict=True)) or [(), (), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.string()), *(pa.array(c, pa.int64()) for c in columns[1:]), pa.array(list(found.values()), pa.int64())], names=["key", "slot", "rating", "flag", "n"])

    return run


def _tallies(n: Column) -> list[Column]:
    """Sums of a tally, for rows that stand for `n` each."""
    some = lambda c, name: F.sum(F.when(c, n).otherwise(0)).alias(name)
    sums = [F.sum(n).alias("uses"), some(F.col("rating") > 0, "rated"), F.sum(n * F.col("rating")).cast("long").alias("stars"), some(F.col("flag") == 1, "keeps"), some(F.col("flag") == 2, "rejects")]
    return sums + [some(F.col("slot") == k, f"_{k}") for k in range(SLOTS)]


def limits() -> Column:
    return F.coalesce(*[F.when(F.col("kind") == k, n) for k, n in MOST.items()], F.lit(TOP))


def top(tallies: DataFrame, parts: int) -> DataFrame:
    """The most used of each kind, from rows with kind, key, value and uses: first of each of several parts, then of those."""
    order = [F.desc("uses"), F.asc("value"), F.asc("key")]
    some = tallies.withColumn("_part", F.pmod(F.xxhash64("key"), F.lit(parts)))
    some = some.withColumn("_place", F.row_number().over(Window.partitionBy("kind", "_part").orderBy(*order))).where(F.col("_place") <= TOP).drop("_part")
    return some.withColumn("place", F.row_number().over(Window.partitionBy("kind").orderBy(*order)).cast("long")).drop("_place").where(F.col("place") <= limits())


def _top_prompts(rows: DataFrame, keyed: DataFrame) -> tuple[DataFrame, int]:
    """(key, value, place) of the most used whole prompts, and how many there are; equally used ones by their text.

    `keyed` has (id, key, head) of the prompts of `rows`: digest and first letters. Texts are read of those rows alone that
    these leave in question, one for each prompt.
    """
    most = MOST["prompt"]
    counts = cut(keyed.groupBy("key").agg(F.count("*").alias("uses"), F.min("head").alias("head"), F.min("id").alias("id")))
    n = counts.count()
    last = counts.orderBy(F.desc("uses"), "head").limit(most).agg(F.max(F.struct((-F.col("uses")).alias("a"), "head")).alias("x")).first()["x"]
    if last is None:
        return rows.sparkSession.createDataFrame([], "key string, value string, place long"), 0
    level = counts.where((F.col("uses") > -last["a"]) | ((F.col("uses") == -last["a"]) & (F.col("head") <= last["head"])))
    texts = rows.select("id", "prompt").join(level.select("id", "key", "uses"), "id").withColumn("value", T.same_text(F.col("prompt")))
    same = texts.where(F.sha2("value", 256) == F.col("key")).groupBy("key", "uses").agg(F.min("value").alias("value"))
    best = same.orderBy(F.desc("uses"), "value").limit(most)
    return best.select("key", "value", F.row_number().over(Window.orderBy(F.desc("uses"), "value")).cast("long").alias("place")), n  # `most` rows


def usage(rows: DataFrame) -> DataFrame:
    """kind, key, value and role (as first met, newest first), uses, rated, stars, keeps, rejects, trend slots as text, samples, distinct keys of the kind, and place."""
    low, high = rows.agg(F.min("mtime"), F.max("mtime")).first()
    low, high = low or 0, high or 0
    slot = F.least(F.lit(SLOTS - 1), F.expr(f"(mtime - {low}L) * {SLOTS} div {high - low + 1}L")).cast("long")
    timed = rows.withColumn("slot", slot)
    marks = ["slot", "rating", "flag"]
    # settings, models, collections, judgements: all in one pass
    each = FA.with_facets(timed).select("id", "mtime", *marks, F.explode(pairs()).alias("p")).select("id", "mtime", *marks, "p.*")
    facets = cut(each.groupBy("kind", "key").agg(*_tallies(F.lit(1)), F.max(F.struct("mtime", "id", "value", "role")).alias("new")))
    facets = facets.select("kind", "key", "new.value", "new.role", *facets.columns[2:-1])
    parts = max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    distinct = facets.groupBy("kind").agg(F.count("*").alias("distinct_keys"))
    best = cut(top(facets, parts).join(distinct, "kind"))
    # words: counted, then tallied for those that are reported
    counts = cut(word_counts(rows))
    words = [(r["key"], r["uses"]) for r in counts.orderBy(F.desc("uses"), "key").limit(MOST["word"]).collect()]
    found = timed.select("prompt", *[F.col(c).cast("long").alias(c) for c in marks]).mapInArrow(_among([w for w, _ in words]), "key string, slot long, rating long, flag long, n long")
    place = rows.sparkSession.createDataFrame([(w, k + 1) for k, (w, _) in enumerate(words)], "key string, place long")
    plain = lambda kind, value: [F.lit(kind).alias("kind"), "key", value.alias("value"), F.lit("").alias("role")]
    numbers = [c for c in facets.columns if c not in ("kind", "key", "value", "role")]
    words = found.groupBy("key").agg(*_tallies(F.col("n"))).join(F.broadcast(place), "key").select(*plain("word", F.col("key")), *numbers, "place", F.lit(counts.count()).alias("distinct_keys"))
    whole = timed.where("id is not null").select("id", *marks, F.explode(F.array(T.same_text(F.col("prompt")))).alias("t")).where("t <> ''")
    keyed = cut(whole.select("id", *marks, F.sha2("t", 256).alias("key"), F.substring("t", 1, HEAD).alias("head")))
    chosen, n = _top_prompts(rows, keyed)
    mine = keyed.join(F.broadcast(cut(chosen)), "key")  # MOST rows
    prompts = mine.groupBy("key", "value", "place").agg(*_tallies(F.lit(1))).select(*plain("prompt", F.col("value")), *numbers, "place", F.lit(n).alias("distinct_keys"))
    # samples, of reported models and LoRAs only
    sample = F.struct((-F.col("rating")).alias("a"), (-F.col("mtime")).alias("b"), "id")
    few = each.where(F.col("kind").isin(*SAMPLED) & (F.col("flag") != 2)).join(F.broadcast(best.select("kind", "key")), ["kind", "key"])
    samples = (
        few.select("kind", "key", F.pmod("id", F.lit(16)).alias("_part"), sample.alias("s"))
        .withColumn("_k", F.row_number().over(Window.partitionBy("kind", "key", "_part").orderBy("s"))).where(F.col("_k") <= SAMPLES)
        .groupBy("kind", "key").agg(F.array_join(F.transform(F.slice(F.array_sort(F.collect_list("s")), 1, SAMPLES), lambda x: x["id"].cast("string")), ",").alias("samples"))
    )
    columns = ["kind", "key", "value", "role", *numbers, "place", "distinct_keys"]
    out = best.select(columns).unionByName(words.select(columns)).unionByName(prompts.select(columns)).join(samples, ["kind", "key"], "left")
    return out.select("kind", "key", "value", "role", "uses", "rated", "stars", "keeps", "rejects", F.concat_ws(",", *[f"_{k}" for k in range(SLOTS)]).alias("trend"), F.coalesce("samples", F.lit("")).alias("samples"), F.col("distinct_keys").cast("long").alias("distinct_keys"), "place")


def totals(rows: DataFrame) -> DataFrame:
    """One row: rows, generated ones, judged ones, first and last time."""
    judged = (F.col("rating") > 0) | (F.col("flag") > 0)
    return rows.agg(F.count("*").alias("total"), F.count_if(F.col("source") != "").alias("generated"), F.count_if(judged).alias("judged"), F.min("mtime").alias("first_ms"), F.max("mtime").alias("last_ms"))


def best_rated(rows: DataFrame, most: int = 10) -> DataFrame:
    """Models, LoRAs and supporting models by average stars, then by how many rated rows use them."""
    each = FA.with_facets(rows.where("rating > 0")).select("rating", "flag", F.explode(F.filter("facets", lambda f: f["kind"].isin(*SAMPLED))).alias("p"))
    found = each.groupBy("p.kind", "p.key").agg(F.count("*").alias("rated"), F.sum("rating").alias("stars"), F.count_if(F.col("flag") == 1).alias("keeps"))
    found = found.withColumn("average", F.col("stars") / F.col("rated"))
    place = F.row_number().over(Window.partitionBy("kind").orderBy(F.desc("average"), F.desc("rated"), "key"))
    return found.withColumn("place", place).where(F.col("place") <= most)


UNITS = ((45, "day"), (400, "week"), (1900, "month"))


def timeline(rows: DataFrame) -> DataFrame:
    """Gap-free counts by day, week, month or year, whichever suits the span, each with the days (first, last) of its search.

    Times are those of the session's zone.
    """
    day = F.to_date(F.timestamp_millis("mtime"))
    days = rows.groupBy(day.alias("day")).agg(F.count("*").alias("n"))
    span = days.agg(F.min("day").alias("a"), F.max("day").alias("b")).where("a is not null")
    width = F.datediff("b", "a") + 1
    unit = F.coalesce(*[F.when(width <= n, F.lit(u)) for n, u in UNITS], F.lit("year"))
    steps = {"day": "interval 1 day", "week": "interval 7 day", "month": "interval 1 month", "year": "interval 1 year"}
    cut = lambda c: F.coalesce(*[F.when(F.col("unit") == u, F.to_date(F.date_trunc(u, c.cast("timestamp")))) for u in steps])
    span = span.withColumn("unit", unit)
    spine = span.select("unit", "a", F.explode(F.coalesce(*[F.when(F.col("unit") == u, F.sequence(cut(F.col("a")), F.col("b"), F.expr(s))) for u, s in steps.items()])).alias("bucket"))
    found = days.crossJoin(F.broadcast(span.select("unit"))).groupBy(cut(F.col("day")).alias("bucket")).agg(F.sum("n").alias("n"))  # the span is one row
    after = F.coalesce(*[F.when(F.col("unit") == u, F.to_date(F.col("bucket").cast("timestamp") + F.expr(s))) for u, s in steps.items()])
    return spine.join(found, "bucket", "left").select("bucket", F.date_sub(after, 1).alias("last"), "unit", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def vocabulary(rows: DataFrame, least: int = 2, most: int = 20_000) -> DataFrame:
    """Words of two characters or more by the number of prompts and negative prompts that use them."""
    each = rows.select(F.explode(F.concat(T.words_of(F.col("prompt"), 2, "'"), T.words_of(F.col("negative"), 2, "'"))).alias("word"))
    return each.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least).orderBy(F.desc("n"), "word").limit(most)


def collections(rows: DataFrame) -> DataFrame:
    """Collections, whatever their letter case, with one of their spellings and their number of rows."""
    each = rows.select("id", F.explode(F.filter("collections", lambda c: c != "")).alias("name"))
    return each.groupBy(F.lower("name").alias("key")).agg(F.min("name").alias("name"), F.countDistinct("id").alias("members"))
