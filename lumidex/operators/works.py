"""What works: phrases and settings that liked and disliked rows differ in, and advice from them.

Rows without a prompt say nothing here. Defined results: rows without a judgement are left out; a share
of no rows is 0; ties go by label; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..checkpoints import cut
from ..functions import facets as FA
from ..functions import text as T

# Bounds of what counts as liked and disliked, and of what is reported.
LIKED, DISLIKED, KEPT = 0.74, 0.26, 0.85
SEEN, FEW, LIFT, SUGGEST, SAME, SHOWN, SUGGESTIONS = 3, 8, 0.05, 0.12, 0.05, 10, 6
# The most models and phrases that are sent to all workers.
MODELS_SENT, PHRASES_SENT = 2_000, 50_000
CFG_BINS = ((2.0, "CFG under 2"), (3.5, "CFG 2 – 3.5"), (4.5, "CFG 3.5 – 4.5"), (6.0, "CFG 4.5 – 6"), (8.0, "CFG 6 – 8"), (None, "CFG 8 and over"))
STEPS_BINS = ((10.0, "Under 10 steps"), (20.0, "10 – 20 steps"), (25.0, "20 – 25 steps"), (35.0, "25 – 35 steps"), (50.0, "35 – 50 steps"), (None, "50 steps and over"))


def target(rating: Column, flag: Column) -> Column:
    """What a row's marks say of it, from 0 to 1: null if nothing."""
    stars = (F.least(rating, F.lit(5)) - 1) / 4
    return F.when(flag == 2, 0.0).when((rating <= 0) & (flag == 1), KEPT).when(rating <= 0, None).when(flag == 1, F.greatest(stars, F.lit(KEPT))).otherwise(stars)


def binned(value: Column, bins: tuple) -> Column:
    out = F.lit(bins[-1][1])
    for upto, label in reversed(bins[:-1]):
        out = F.when(value < upto, label).otherwise(out)
    return F.when(value.isNotNull(), out)


def recipes(rows: DataFrame) -> DataFrame:
    """Rows with a prompt, newest first, with their facets and target."""
    out = FA.with_facets(rows.where(F.trim("prompt") != "")).withColumn("target", target(F.col("rating"), F.col("flag")))
    return out.select("id", "dir", "mtime", "prompt", "facets", "rating", "target")


def _settings() -> Column:
    """(kind, label) of the settings of a row of recipes."""
    number = lambda kind: FA.first(F.col("facets"), kind).try_cast("double")
    item = lambda kind, label: F.struct(F.lit(kind).alias("kind"), label.alias("label"))

    def lora(f: Column) -> Column:
        name, weight = F.regexp_extract(f["key"], "^(.*)@[^@]*$", 1), F.regexp_extract(f["key"], "@([^@]*)$", 1).try_cast("double")
        low = F.floor(weight / 0.2) * 0.2
        return item("lora", F.concat(T.short_name(name), F.lit(" at "), T.number_text(F.round(low, 2)), F.lit(" – "), T.number_text(F.round(low + 0.2, 2))))

    sampler = FA.first(F.col("facets"), "sampler")
    one = F.array(item("cfg", binned(number("cfg"), CFG_BINS)), item("steps", binned(number("steps"), STEPS_BINS)), item("sampler", F.concat(F.lit("Sampler "), sampler)))
    return F.filter(F.concat(one, F.transform(F.filter("facets", lambda f: f["kind"] == "loraw"), lora)), lambda x: x["label"].isNotNull())


def counts(judged: DataFrame) -> DataFrame:
    """kind, label, liked, disliked and judged rows of each phrase and setting, with the shares of liked and disliked rows that have it.

    `judged` is what `recipes` gives, rows without a target left out.
    """
    judged = judged.where("target is not null")
    liked, disliked = F.col("target") >= LIKED, F.col("target") <= DISLIKED
    sizes = judged.agg(F.count_if(liked).alias("n_liked"), F.count_if(disliked).alias("n_disliked"))
    phrases = F.transform(T.prompt_phrases(F.lower("prompt"), T.MOST_PHRASES), lambda p: F.struct(F.lit("phrase").alias("kind"), p.alias("label")))
    each = judged.select("target", F.explode(F.concat(phrases, _settings())).alias("x")).select("target", "x.*")
    out = each.groupBy("kind", "label").agg(F.count_if(liked).alias("liked"), F.count_if(disliked).alias("disliked"), F.count("*").alias("judged"))
    share = lambda n, of: F.coalesce(F.try_divide(F.col(n), F.col(of)), F.lit(0.0))
    return out.crossJoin(F.broadcast(sizes)).select("kind", "label", "liked", "disliked", "judged", share("liked", "n_liked").alias("keep"), share("disliked", "n_disliked").alias("reject"))  # sizes is one row


def what_works(rows: DataFrame, model: str | None = None) -> DataFrame:
    """The phrases most common in liked rows (keep), in disliked ones (reject), and the settings that set them apart, ten of each at most."""
    judged = recipes(rows)
    if model:
        judged = judged.where(F.exists("facets", lambda f: (f["kind"] == "model") & (f["key"] == model.lower())))
    found = cut(counts(judged).where(F.col("judged") >= SEEN)).withColumn("lift", F.col("keep") - F.col("reject"))
    found = found.withColumn("weight", F.col("lift") * F.sqrt(F.least(F.col("judged") / FEW, F.lit(1.0))))
    phrase, lift = F.col("kind") == "phrase", F.round("lift", 9)  # shares are ratios; their difference has noise in its last digits
    groups = (
        ("keep", found.where(phrase & (lift >= LIFT) & ~T.is_quality_phrase(F.col("label"))), [F.desc(F.round("weight", 9)), F.asc("label")]),
        ("reject", found.where(phrase & (lift <= -LIFT)), [F.asc(F.round("weight", 9)), F.desc("label")]),
        ("settings", found.where(~phrase & (F.abs(lift) >= LIFT)), [F.desc(F.round(F.abs("weight"), 9)), F.asc("label")]),
    )
    out = None
    for name, some, order in groups:
        part = some.orderBy(*order).limit(SHOWN).select(F.lit(name).alias("part"), "*")
        out = part if out is None else out.unionByName(part)
    return out.withColumn("few", F.col("judged") < FEW)


def examples(rows: DataFrame, found: DataFrame, most: int = 3) -> DataFrame:
    """(kind, label, liked, disliked): for the few items of `found` (what `what_works` gives), ids of the best liked and the worst disliked rows with each."""
    judged = recipes(rows).where("target is not null")
    phrases = F.transform(T.prompt_phrases(F.lower("prompt"), T.MOST_PHRASES), lambda p: F.struct(F.lit("phrase").alias("kind"), p.alias("label")))
    each = judged.select("id", "mtime", "target", F.explode(F.concat(phrases, _settings())).alias("x")).select("id", "mtime", "target", "x.*")
    each = each.join(F.broadcast(found.select("kind", "label").distinct()), ["kind", "label"]).withColumn("_part", F.pmod("id", F.lit(16)))

    def best(some: DataFrame, order: list[Column], name: str) -> DataFrame:
        """The first ids of each item, of several parts first and then of those."""
        for key in (["kind", "label", "_part"], ["kind", "label"]):
            some = some.withColumn("_k", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where(F.col("_k") <= most)
        ids = F.transform(F.array_sort(F.collect_list(F.struct("_k", "id"))), lambda x: x["id"])
        return some.groupBy("kind", "label").agg(ids.alias(name))

    liked = best(each.where(F.col("target") >= LIKED), [F.desc("target"), F.desc("mtime"), F.asc("id")], "liked")
    disliked = best(each.where(F.col("target") <= DISLIKED), [F.asc("target"), F.desc("mtime"), F.asc("id")], "disliked")
    return liked.join(disliked, ["kind", "label"], "full_outer")


def judged_models(rows: DataFrame, most: int = 20) -> DataFrame:
    """First models of judged rows by how many rows they made."""
    first = recipes(rows).where("target is not null").select(FA.first(F.col("facets"), "model").alias("model")).where("model is not null")
    return first.groupBy("model").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "model").limit(most).withColumn("label", T.short_name(F.col("model")))


def own_phrases(rows: DataFrame, most: int = 300) -> DataFrame:
    """Phrases that two prompts or more use and that don't only ask for quality."""
    each = rows.select(F.explode(T.prompt_phrases(F.lower("prompt"), T.MOST_PHRASES)).alias("phrase"))
    found = each.groupBy("phrase").agg(F.count("*").alias("n")).where(F.col("n") >= 2)
    return found.where(~T.is_quality_phrase(F.col("phrase"))).orderBy(F.desc("n"), "phrase").limit(most)


def _labels(prompt: Column) -> Column:
    """All phrases of a prompt as typed, in lower case; none of a null."""
    return F.coalesce(F.array_distinct(F.transform(T.prompt_phrases(prompt), lambda p: F.lower(p))), F.array().cast("array<string>"))


def _sent(rows: DataFrame, most: int, number: Column | None = None) -> DataFrame:
    """Rows of a cut table, sent to all workers where they, or what `number` counts of them, are few; what they are joined with is large and stays in its place then."""
    n = rows.agg(F.count("*") if number is None else number).first()[0] or 0
    return F.broadcast(rows) if n <= most else rows


def counts_by_model(judged: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(scope, n, label, liked, judged, keep, reject) of the phrases that enough rows have, for each model and, as scope '', for all, in one pass; and (scope, n) with the liked and disliked rows of each.

    `judged` is what `recipes` gives; a row without a model counts for all alone. All phrases of whole texts are counted, and stored only where they are a reason for something.
    """
    models = F.transform(F.filter("facets", lambda f: f["kind"] == "model"), lambda f: f["key"])
    # worked out once a row, behind a generator, before phrases are dealt out to their scopes; the empty label, which is no phrase, counts the rows
    made = F.struct(F.array_distinct(F.concat(F.array(F.lit("")), models)).alias("scopes"), F.concat(F.array(F.lit("")), _labels(F.col("prompt"))).alias("labels"))
    rows = judged.where("target is not null").select("target", F.explode(F.array(made)).alias("x")).select("target", "x.scopes", F.explode("x.labels").alias("label"))
    each = rows.select("target", "label", F.explode("scopes").alias("scope"))
    liked, disliked = F.count_if(F.col("target") >= LIKED).alias("liked"), F.count_if(F.col("target") <= DISLIKED).alias("disliked")
    found = each.groupBy("scope", "label").agg(liked, disliked, F.count("*").alias("judged"))
    found = cut(found.where((F.col("label") == "") | (F.col("judged") >= FEW) | (F.col("liked") >= SEEN)))
    sizes = found.where(F.col("label") == "").select("scope", F.col("liked").alias("n_liked"), F.col("disliked").alias("n_disliked"), (F.col("liked") + F.col("disliked")).alias("n"))
    share = lambda n, of: F.coalesce(F.try_divide(F.col(n), F.col(of)), F.lit(0.0))
    out = found.where(F.col("label") != "").join(_sent(sizes, MODELS_SENT), "scope")
    return out.select("scope", "n", "label", "liked", "judged", share("liked", "n_liked").alias("keep"), share("disliked", "n_disliked").alias("reject")), sizes.select("scope", "n")


def advice(prompts: DataFrame, judged: DataFrame, missed: DataFrame | None = None) -> DataFrame:
    """(id, place, advice, phrase, weight, scope): what to change in each prompt of (id, prompt as typed, model), SUGGESTIONS at most.

    First come phrases that the picture misses, of `missed` (id, k, phrase, level, seen), with the weight to write them with; then phrases
    common in rejects, quality words that make no difference (together), and two at most of the phrases most common in liked rows that
    the prompt lacks. Counts are those of the prompt's model, or of all rows where fewer than 2 FEW of it are judged.
    Whole texts count, and the lists of phrases to add are whole: where liked rows have m phrases on average, m / SUGGEST at most have
    a share of SUGGEST in them.
    """
    counted, sizes = counts_by_model(judged)
    enough = F.col("n") >= 2 * FEW
    shares = counted.where(enough | (F.col("scope") == "")).withColumn("lift", F.round(F.col("keep") - F.col("reject"), 9))
    good = (F.col("liked") >= SEEN) & (F.col("lift") >= SUGGEST) & (F.size(F.split("label", " ")) <= 5) & ~T.is_quality_phrase(F.col("label"))
    listed = cut(shares.where(good).groupBy("scope").agg(F.array_sort(F.collect_list(F.struct((-F.col("lift")).alias("a"), "label"))).alias("adds")))
    judged_enough = shares.where(F.col("judged") >= FEW).withColumn("same", T.is_quality_phrase(F.col("label")) & (F.abs("lift") < SAME))
    telling = cut(judged_enough.where(F.col("same") | (F.col("lift") <= -SUGGEST)).select("scope", "label", "same"))
    own = prompts.select("id", "prompt", F.coalesce("model", F.lit("")).alias("model")).join(_sent(sizes.where(enough).select(F.col("scope").alias("model"), F.col("scope").alias("_scope")), MODELS_SENT), "model", "left")
    own = own.withColumn("scope", F.coalesce("_scope", F.lit(""))).join(_sent(listed, PHRASES_SENT, F.sum(F.size("adds"))), "scope", "left")
    # each text is read once; no weight is written without a bracket
    made = F.struct(_labels(F.col("prompt")).alias("labels"), F.when(F.col("adds").isNotNull(), F.lower("prompt")).alias("low"), F.when(F.contains("prompt", F.lit("(")), F.col("prompt")).alias("marked"))
    own = own.select("id", "scope", "adds", F.explode(F.array(made)).alias("x"))
    lack = lambda adds: F.slice(F.filter(adds, lambda x: ~F.contains(F.col("x.low"), x["label"])), 1, 2)
    # most prompts lack two of the first few; the whole list is looked through for the others
    lacking = F.when(F.size(lack(F.slice("adds", 1, FEW))) == 2, lack(F.slice("adds", 1, FEW))).otherwise(lack(F.col("adds")))
    own = own.select("id", "scope", "x.labels", F.explode(F.array(F.struct("x.marked", lacking.alias("lacking")))).alias("x"))
    # of its phrases those that tell something are kept, and one row (k = -1, under the id so that such rows spread) with the rest
    rest = F.struct(F.lit(-1).alias("k"), F.col("id").cast("string").alias("label"), F.col("x").alias("x"))
    phrases = F.transform("labels", lambda p, k: F.struct(k.alias("k"), p.alias("label"), F.when(F.lit(False), F.col("x")).alias("x")))
    each = own.select("id", "scope", F.explode(F.concat(phrases, F.array(rest))).alias("y")).select("id", "scope", "y.*")
    kept = cut(each.join(_sent(telling, PHRASES_SENT), ["scope", "label"], "left").where((F.col("k") < 0) | F.col("same").isNotNull()))
    own, told = kept.where("k < 0").select("id", "scope", "x.marked", "x.lacking"), kept.where("k >= 0")
    item = lambda part, k, advice, phrase, weight=None: [F.lit(part).alias("part"), F.col(k).cast("int").alias("k") if isinstance(k, str) else F.lit(k).alias("k"), F.lit(advice).alias("advice"), phrase.alias("phrase"), (F.lit(None).cast("double") if weight is None else weight).alias("weight")]
    out = told.where(~F.col("same")).select("id", *item(1, "k", "in_rejects", F.col("label")))
    alike = told.where("same").groupBy("id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "label"))), lambda x: x["label"]), ", ").alias("all"))
    out = out.unionByName(alike.select("id", *item(2, 0, "no_difference", F.col("all"))))
    out = out.unionByName(own.select("id", F.posexplode("lacking").alias("k", "x")).select("id", *item(3, "k", "in_keepers", F.col("x.label"))))
    if missed is not None:
        weight = F.when(F.col("level") < 0.5, 1.3).otherwise(1.2)
        unseen = missed.where(~F.col("seen")).select("id", "k", "phrase", weight.alias("w")).join(own.select("id", "marked"), "id")
        unseen = unseen.where(T.written_weight(F.coalesce("marked", F.lit("")), F.col("phrase")) < F.col("w"))
        out = out.unionByName(unseen.select("id", *item(0, "k", "missed", F.col("phrase"), F.col("w"))))
    first = F.slice(F.array_sort(F.collect_list(F.struct("part", "k", "phrase", "advice", "weight"))), 1, SUGGESTIONS)
    best = out.groupBy("id").agg(first.alias("x")).select("id", F.posexplode("x").alias("place", "x")).select("id", (F.col("place") + 1).alias("place"), "x.advice", "x.phrase", "x.weight")
    return best.join(own.select("id", "scope"), "id")


def rated_near(rows: DataFrame, folders: DataFrame) -> DataFrame:
    """Rated rows in one of the folders (`dir`), above one or below one: joined by equality on the ancestors of either side."""
    rated = rows.where("rating > 0")
    wanted = folders.select("dir").distinct()
    up = wanted.select(F.explode(ancestors(F.col("dir"))).alias("dir")).distinct()
    above = rated.join(up, "dir", "left_semi").select("id")
    below = rated.select("id", F.explode(ancestors(F.col("dir"))).alias("dir")).join(wanted, "dir", "left_semi").select("id")
    return rated.join(above.union(below).distinct(), "id", "left_semi")


def ancestors(path: Column) -> Column:
    """A path and all folders above it, the nearest first."""
    parts = F.filter(F.split(path, "/"), lambda x: x != "")
    n = F.size(parts)
    return F.when(n == 0, F.array(F.lit("/"))).otherwise(F.concat(F.transform(F.sequence(F.lit(0), n - 1), lambda k: F.concat(F.lit("/"), F.array_join(F.slice(parts, 1, n - k), "/"))), F.array(F.lit("/"))))
