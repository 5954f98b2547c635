"""Audience levels: what a prompt's words and what a picture's fits say, how they are weighed, and ranges of levels.

Levels are numbers from 0 (not rated) to 5. Defined results: an empty prompt isn't rated, one with none
of the phrases is 1; a row's own level always wins; ranges never take in rows that aren't rated.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORDS = ("none", "g", "pg", "pg13", "r", "nc17")
# Phrases and the level each raises a prompt to.
PHRASES = {
    2: "bikini swimsuit kiss battle fight fighting sword monster skull creepy".split(),
    3: "lingerie cleavage underwear seductive sensual sexy bloody blood wound gun rifle pistol shooting zombie horror war".split(),
    4: ["nsfw", "nude", "naked", "nudity", "topless", "bare breasts", "nipples", "gore", "gory", "guro", "mutilated", "severed", "corpse", "dead body", "blood splatter"],
    5: "explicit porn pornographic hentai sex genitals dismembered decapitated disemboweled torture".split(),
}
# Words that say that a prompt is about a child or a teenager.
MINORS = (
    "child children kid kids minor minors teen teens teenage teenager teenagers toddler baby infant preteen tween schoolgirl schoolboy loli lolita shota underage".split()
    + ["young girl", "young boy", "little girl", "little boy", "middle school", "high school", "elementary school", "junior high"]
)
# How well a picture must fit a description of a level.
BARS = {5: 1.3, 4: 1.1}


def clean(prompt: Column) -> Column:
    """The prompt's words between single spaces: tags and apostrophes out, other signs as spaces, lower case."""
    bare = F.regexp_replace(F.regexp_replace(prompt, "<[^>]*(?:>|$)", ""), "[>']", "")
    return F.trim(F.regexp_replace(F.lower(bare), r"[^\p{IsAlphabetic}\p{N}]+", " "))


def _spaced(words: Column) -> Column:
    """Words with a space of their own on either side, so that neighbours share none."""
    return F.concat(F.lit(" "), F.replace(words, F.lit(" "), F.lit("  ")), F.lit(" "))


def _sought(phrase: str) -> str:
    return " " + phrase.replace(" ", "  ") + " "


def _count(spaced: Column, phrase: str) -> Column:
    want = _sought(phrase)
    return F.when(F.contains(spaced, F.lit(want)), (F.length(spaced) - F.length(F.replace(spaced, F.lit(want), F.lit("")))) / len(want)).otherwise(F.lit(0.0))


def reasons(words: Column) -> Column:
    """Phrases found in cleaned words, with their levels, the highest first. A phrase that only stands inside a longer one that was found is no reason of its own."""
    spaced, level = _spaced(words), {p: n for n, ps in PHRASES.items() for p in ps}
    kept = F.array_intersect(F.split(words, " "), F.array(*[F.lit(p) for p in level if " " not in p]))
    for p in level:
        inside = [_count(spaced, q) for q in level if q != p and f" {p} " in f" {q} "]
        if inside:
            kept = F.when(_count(spaced, p) <= sum(inside[1:], inside[0]), F.array_remove(kept, p)).otherwise(kept)
    numbers = F.create_map(*[F.lit(x) for p, n in level.items() for x in (p, n)])
    pairs = F.filter(F.array(*[F.when(F.contains(spaced, F.lit(_sought(p))), F.lit(p)) for p in level if " " in p]), lambda x: x.isNotNull())
    return F.sort_array(F.transform(F.concat(kept, pairs), lambda w: F.struct(F.element_at(numbers, w).alias("level"), w.alias("phrase"))), asc=False)


def prompt_level(words: Column) -> Column:
    """Of a prompt's cleaned words: 0 without any, 1 with none of the phrases, else the highest level found."""
    found = reasons(words)
    return F.when(words == "", 0).otherwise(F.coalesce(F.get(F.transform(found, lambda x: x["level"]), F.lit(0)), F.lit(1)))


def picture_level(fits: Column) -> Column:
    """The level of the highest description that a picture fits; `fits` is an array of (level, fit). 1 with none, 0 where nothing is known."""
    bar = lambda level: F.coalesce(*[F.when(level == n, x) for n, x in BARS.items()], F.lit(1.0))
    found = F.transform(F.filter(fits, lambda f: f["fit"] >= bar(f["level"])), lambda f: f["level"])
    return F.when(fits.isNull(), 0).otherwise(F.coalesce(F.array_max(found), F.lit(1)))


def decided(prompt: Column, picture: Column, own: Column, source: str = "strictest") -> Column:
    """The level that counts: a row's own one, else that of the prompt, of the picture, or the higher."""
    found = prompt if source == "prompt" else picture if source == "image" else F.greatest(prompt, picture)
    return F.coalesce(own, found)


def parse(word: str) -> int | None:
    w = word.strip().lower().replace("-", "").replace(" ", "")
    return {"x": 5, "unrated": 0, "unknown": 0}.get(w, WORDS.index(w) if w in WORDS else None)


def wanted(level: Column, value: str) -> Column:
    """A level, a range (`pg..r`, `..pg13`, `r..`), or several with `|` between them; malformed ones match nothing."""
    out = F.lit(False)
    for part in filter(None, map(str.strip, value.split("|"))):
        low, dots, high = part.partition("..")
        a, b = (1 if dots and not low.strip() else parse(low)), (5 if dots and not high.strip() else parse(high) if dots else parse(low))
        if a is None or b is None:
            return F.lit(False)
        out = out | level.between(max(a, 1) if dots else a, b)
    return out


def mentions_minor(words: Column) -> Column:
    """Whether a prompt's cleaned words mention a child or a teenager, by word or by an age under 18."""
    spaced = _spaced(words)
    named = F.arrays_overlap(F.split(words, " "), F.array(*[F.lit(m) for m in MINORS if " " not in m]))
    for m in MINORS:
        if " " in m:
            named = named | F.contains(spaced, F.lit(_sought(m)))
    young = "0*(?:[0-9]|1[0-7])"
    return named | words.rlike(rf"(?:^| )(?:{young}y+(?:yo)*|{young}(?:yo)+|{young} (?:years|year|yo|yrs)|aged? {young})(?: |$)")


def levelled(rows: DataFrame, source: str = "prompt") -> DataFrame:
    """Rows with their prompt's level, and the level that counts; `picture` (a level) and `own` are used where there are such columns."""
    has = lambda c: F.col(c) if c in rows.columns else F.lit(None).cast("int")
    # cleaned once a row, and looked through once: each step stands behind a generator
    out = rows.withColumn("_words", F.explode(F.array(clean(F.col("prompt")))))
    out = out.withColumn("prompt_level", F.explode(F.array(prompt_level(F.col("_words"))))).drop("_words")
    return out.withColumn("level", decided(F.col("prompt_level"), F.coalesce(has("picture"), F.lit(0)), has("own"), source))


def confusion(rows: DataFrame) -> DataFrame:
    """Rows by prompt level, and how many of them have each picture level (p1 to p5); rows that lack either aren't counted."""
    known = rows.where((F.col("prompt_level") > 0) & (F.col("picture") > 0))
    return known.groupBy("prompt_level").agg(*[F.count_if(F.col("picture") == n).alias(f"p{n}") for n in range(1, 6)])


def bars(fits: DataFrame, steps: tuple[float, ...] = (0.8, 0.9, 1.0, 1.1, 1.2, 1.3, 1.5)) -> DataFrame:
    """Of (phrase, level, fit, prompt_level): how many rows each description catches at each bar, at or above its level and below it."""
    each = fits.where("prompt_level > 0").withColumn("bar", F.explode(F.array(*map(F.lit, steps))))
    at, hit = F.col("prompt_level") >= F.col("level"), F.col("fit") >= F.col("bar")
    return each.groupBy("phrase", "level", "bar").agg(F.count_if(at & hit).alias("hits"), F.count_if(at).alias("of_hits"), F.count_if(~at & hit).alias("misses"), F.count_if(~at).alias("of_misses"))
