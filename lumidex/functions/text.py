"""Word matching, relevance and normalising, as Column expressions that stay inside code generation."""

from __future__ import annotations


from pyspark.sql import Column
from pyspark.sql import functions as F

#: A word character: alphabetic or numeric, below U+2E80 (later scripts don't separate words).
W = r"[\p{IsAlphabetic}\p{N}&&[\x{0}-\x{2E7F}]]"
# Points of the relevance score.
PROMPT, EARLY, AGAIN, AGAIN_MOST, NAME, SETTING, NEGATIVE, PHRASE = 100, 40, 10, 3, 40, 20, 10, 60


def _is_word(c: str) -> bool:
    return c.isalnum() and ord(c) < 0x2E80


def word_pattern(needle: str, prefix: bool = False) -> str:
    """Whole-word pattern; stars at its ends open them, `prefix` opens the right end.

    The literal stands first, so that a text is passed over at its speed; what must not stand before it is looked at afterwards.
    """
    inner = needle.strip("*") or needle
    left, right = needle[:1] != "*" or inner == needle, (needle[-1:] != "*" or inner == needle) and not prefix
    inner = inner.lower()
    quoted = r"\Q" + inner.replace(r"\E", r"\E\\E\Q") + r"\E"
    return quoted + (f"(?<!{W}{quoted})" if left and _is_word(inner[0]) else "") + (f"(?!{W})" if right and _is_word(inner[-1]) else "")


def literal(needle: str) -> str:
    """What a text must contain for the word to be in it."""
    return (needle.strip("*") or needle).lower()


def has_word(text: Column, needle: str, prefix: bool = False) -> Column:
    return F.contains(text, F.lit(literal(needle))) & F.regexp_like(text, F.lit(word_pattern(needle, prefix)))


def count_words(text: Column, needle: str) -> Column:
    return F.when(F.contains(text, F.lit(literal(needle))), F.regexp_count(text, F.lit(word_pattern(needle)))).otherwise(F.lit(0))


def first_byte(text: Column, needle: str) -> Column:
    """Byte offset of the first occurrence; null if there's none."""
    at = F.when(F.contains(text, F.lit(literal(needle))), F.regexp_instr(text, F.lit(word_pattern(needle))))
    return F.when(at > 0, F.octet_length(F.substring(text, F.lit(1), at - 1)))


def _any(conditions: list[Column]) -> Column:
    out = F.lit(False)
    for c in conditions:
        out = out | c
    return out


def around(needle: str, prompt: Column) -> Column:
    """The pieces of a prompt between the first few places of a word, as many as count; one piece, or none, if it isn't there. The text is read no further than that."""
    return F.when(F.contains(prompt, F.lit(literal(needle))), F.split(prompt, word_pattern(needle), AGAIN_MOST + 2)).otherwise(F.array().cast("array<string>"))


def term_score(needle: str, pieces: Column, prompt: Column, negative: Column, names: list[Column], settings: list[Column]) -> Column:
    """Points of a word with these pieces `around` it: prompt hits by place (in bytes) and number, else names, else settings, else the negative prompt."""
    first, n = F.octet_length(F.get(pieces, F.lit(0))), F.size(pieces) - 1
    hit = PROMPT + EARLY * (1 - first / F.octet_length(prompt)) + AGAIN * F.least(n - 1, F.lit(AGAIN_MOST))
    out = F.when(n > 0, hit)
    for columns, points, prefix in ((names, NAME, True), (settings, SETTING, True), ([negative], NEGATIVE, False)):
        out = out.when(_any([has_word(c, needle, prefix) for c in columns]), F.lit(float(points)))
    return out.otherwise(F.lit(0.0))


def phrase_bonus(needles: list[str], prompt: Column) -> Column:
    """Points where the plain words, two or more, stand together in the prompt in the order typed; words with a star are left out."""
    plain = [n for n in needles if "*" not in n]
    if len(plain) < 2:
        return F.lit(0.0)
    return F.when(has_word(prompt, " ".join(plain)), F.lit(float(PHRASE))).otherwise(F.lit(0.0))


def same_text(text: Column) -> Column:
    """Lower case, no double quotes, single spaces: equal results mean the same text."""
    return F.trim(F.regexp_replace(F.replace(F.lower(text), F.lit('"'), F.lit("")), r"\s+", " "))


def facet_value(kind: Column, value: Column) -> Column:
    """Normal form of a facet: single spaces and no quotes; numbers without a trailing .0; sizes as WxH."""
    plain = F.trim(F.regexp_replace(F.replace(value, F.lit('"'), F.lit("")), r"\s+", " "))
    number = F.regexp_replace(plain.try_cast("double").cast("string"), r"\.0$", "")
    size = F.regexp_replace(F.regexp_replace(plain, "[×*X]", "x"), " ", "")
    return F.when(kind.isin("steps", "cfg"), F.coalesce(number, plain)).when(kind == "size", size).otherwise(plain)


# Words that say nothing about what a picture shows.
FILLER = (
    "the and with for from that this these those its his her their they she him who whose which what when where while into onto over under "
    "above below behind between through across around against along near off out are was were been being has have had but not nor than then "
    "there here also very some any all each one two can will about like such other both more most you your our lora break"
).split()
# Words that ask for quality only.
QUALITY = (
    "masterpiece best high higher highest top good great quality detailed detail details highly ultra very extremely super hyper intricate sharp focus "
    "resolution res highres absurdres hd hdr uhd 4k 8k 16k 32k raw photo realistic photorealistic hyperrealistic professional award winning trending on "
    "artstation pixiv deviantart amazing beautiful stunning perfect official art aesthetic aesthetics newest recent score up source rating safe general "
    "illustration wallpaper unity cg rendered render octane unreal engine the a an and of in with"
).split()
TAG = r"<[A-Za-z]{1,15}:[^>]*>"
MOST_PHRASES = 40


def words_of(text: Column, least: int, more: str = "") -> Column:
    """Distinct runs of word characters (and of `more`) of `least` characters or more."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(rf"([\p{{IsAlphabetic}}\p{{N}}{more}&&[\x{{0}}-\x{{2E7F}}]]{{{least},}})"), 1))


def prompt_words(text: Column) -> Column:
    """Distinct words of a lower-cased prompt worth counting: three characters or more, a letter among them, no filler, no <name:...> tags."""
    fillers = F.array(*map(F.lit, FILLER))
    return F.filter(F.array_except(words_of(untagged(text), 3), fillers), lambda w: w.rlike(r"\p{IsAlphabetic}"))


def untagged(text: Column) -> Column:
    return F.when(F.contains(text, F.lit("<")), F.regexp_replace(text, TAG, " ")).otherwise(text)


def is_telling(word: Column) -> Column:
    """Whether a word has a letter and is no filler."""
    return word.rlike(r"\p{IsAlphabetic}") & ~word.isin(FILLER)


def prompt_phrases(text: Column, most: int | None = None) -> Column:
    """Distinct phrases of a whole lower-cased prompt, or the first `most`: cut at commas, stops, bars and line ends, without tags, brackets, weights and escapes."""
    t = F.replace(F.regexp_replace(text, r"<[^>]*>", ","), F.lit("<"), F.lit(""))
    t = F.replace(t, F.lit("BREAK"), F.lit(","))
    weight, signs = r":[0-9. -]*[0-9][0-9. -]*", "()[]{}_"
    # escaped signs wait under private characters
    kept, escaped = "\\()[]{}:_", t
    for k, c in enumerate(kept):
        escaped = F.replace(escaped, F.lit("\\" + c), F.lit(chr(0xE000 + k)))
    escaped = F.translate(F.regexp_replace(F.replace(escaped, F.lit("\\"), F.lit("")), weight, ""), signs, " " * len(signs))
    escaped = F.translate(escaped, "".join(chr(0xE000 + k) for k in range(len(kept))), kept)
    plain = F.regexp_replace(F.regexp_replace(t, weight, ""), r"[()\[\]{}_]", " ")
    t = F.when(text.rlike(r"[\\\x{E000}-\x{E008}]"), escaped).otherwise(plain)
    # pieces have no line ends, so white space is made single in the whole text
    pieces = F.split(F.regexp_replace(t, r"[ \t\x0B\f]{2,}|[\t\x0B\f]", " "), r"[,;.\n\r|]")
    pieces = F.transform(pieces, lambda p: F.trim(p, F.lit(" -\"'!?*#/:+")))
    found = F.array_distinct(F.filter(pieces, lambda p: p.rlike(r"\p{IsAlphabetic}") & ~p.startswith("embedding")))
    return found if most is None else F.slice(found, 1, most)


def is_quality_phrase(phrase: Column) -> Column:
    """Whether all words only ask for quality, or are numbers."""
    words = F.filter(F.split(F.lower(phrase), r"[\s_-]+"), lambda w: w != "")
    return (F.size(words) > 0) & F.forall(words, lambda w: w.isin(QUALITY) | w.rlike("^[0-9]+$"))


# Words that say how a picture looks, and how it is framed.
LOOK = (
    "painting painted photograph photography photo illustration anime manga style lighting light lit art artwork render sketch drawing drawn watercolor "
    "watercolour oil acrylic ink cinematic film grain bokeh colors colours colorful palette shading lineart cel pastel vibrant muted monochrome noir "
    "impressionist impressionism surreal surrealism fantasy concept digital 3d pixel vector comic cartoon ukiyo baroque renaissance gothic cyberpunk "
    "steampunk vintage retro polaroid glow glowing rim volumetric dramatic soft warm cool golden hour moody atmospheric texture textured brushstrokes "
    "canvas matte gouache charcoal pencil chiaroscuro"
).split()
FRAMING = "close-up closeup full body upper wide angle aerial shot portrait view cowboy panorama panoramic".split()


def is_look_phrase(phrase: Column) -> Column:
    """Whether a phrase says how the picture looks, and neither what is in it nor how it is framed."""
    low = F.lower(phrase)
    words = F.filter(F.split(low, r"[\s_,]+"), lambda w: w != "")
    framed = F.exists(words, lambda w: w.isin(FRAMING) | F.contains(w, F.lit("close-up")))
    look = F.forall(words, lambda w: w.isin(LOOK) | w.isin(QUALITY) | w.rlike("^[0-9]+$")) & F.exists(words, lambda w: w.isin(LOOK))
    return (F.size(words) > 0) & ~framed & (look | low.rlike("^(?:by |art by |in the style of|style of)"))


def written_weight(prompt: Column, phrase: Column) -> Column:
    """The weight a phrase is written with, as in (red fox:1.2), else 1."""
    text, start = F.lower(prompt), F.concat(F.lit("("), F.lower(phrase), F.lit(":"))
    at = F.position(start, text)
    rest = F.substring_index(F.substr(text, at + F.length(start)), ")", 1)
    return F.when(at > 0, F.coalesce(F.trim(rest).try_cast("double"), F.lit(1.0))).otherwise(F.lit(1.0))


def number_text(value: Column) -> Column:
    """A number as it is shown: no trailing zeros, six places at most."""
    return F.regexp_replace(F.format_string("%.6f", value.cast("double")), r"\.?0+$", "")


def lora_tags(prompt: Column) -> Column:
    """(name, weight) of <lora:name:weight> tags, the first of each name."""
    tags = F.regexp_extract_all(prompt, F.lit(r"<((?:lora|lyco|lycoris):[^>]*)>"), 1)
    parts = F.transform(tags, lambda t: F.struct(F.trim(F.get(F.split(t, ":"), F.lit(1))).alias("name"), F.trim(F.get(F.split(t, ":"), F.lit(2))).try_cast("double").alias("weight")))
    named = F.filter(parts, lambda p: p["name"] != "")
    return F.filter(named, lambda p, k: F.array_position(F.transform(named, lambda q: q["name"]), p["name"]) == k + 1)


def model_key(name: Column) -> Column:
    """A model's name without hash, folders and file ending, in lower case."""
    s = F.regexp_replace(F.trim(name), r"\s*\[[0-9a-fA-F]+\]$", "")
    s = F.regexp_extract(s, r"([^/\\]*)$", 1)
    return F.trim(F.lower(F.regexp_replace(s, r"(?i)\.(safetensors|ckpt|pt|pth|bin|gguf|sft)$", "")))


def names_text(model: Column, models: Column) -> Column:
    """Names of the main model and of all others, a line each, in lower case."""
    every = F.concat(F.array(model), F.transform(models, lambda m: F.lower(m["name"])))
    return F.array_join(F.array_distinct(F.filter(every, lambda n: n != "")), "\n")


def settings_text(source: Column, seed: Column, params: Column) -> Column:
    """What is found as a setting: source, seed and every `key: value`, a line each, in lower case."""
    lines = F.concat(F.array(source, seed), F.transform(params, lambda p: F.concat(p["key"], F.lit(": "), p["value"])))
    return F.lower(F.array_join(F.filter(lines, lambda x: x != ""), "\n"))


def param(params: Column, *names: str) -> Column:
    """The first setting written under one of the names, in any letter case; null without one."""
    return F.get(F.transform(F.filter(params, lambda p: F.lower(p["key"]).isin(*names)), lambda p: p["value"]), F.lit(0))


def recipe_size(params: Column, width: Column, height: Column) -> Column:
    """(width, height) as written in the settings, else the picture's own."""
    size, pattern = param(params, "size"), r"(\d+)\s*[x×]\s*(\d+)"
    side = lambda k, own: F.coalesce(F.regexp_extract(size, pattern, k).try_cast("int"), own)
    return F.struct(side(1, width).alias("width"), side(2, height).alias("height"))


def recipe_steps(params: Column) -> Column:
    """The number of steps, rounded; null if it isn't told."""
    return F.round(F.trim(param(params, "steps")).try_cast("double")).cast("int")


def recipe_cfg(params: Column) -> Column:
    return F.trim(param(params, "cfg scale", "cfg", "cfg_scale")).try_cast("double")


def content_key(path: Column, mtime: Column, size: Column) -> Column:
    """A key that changes with a file's path, time or size."""
    return F.sha2(F.concat_ws("|", path, mtime.cast("string"), size.cast("string")), 256)


def natural_key(name: Column) -> Column:
    """Sort key: case folded, runs of digits as numbers. A run's number of digits stands before it, so runs of any length compare."""
    runs = F.regexp_extract_all(F.lower(name), F.lit(r"(\d+|\D+)"), 1)

    def key(r: Column) -> Column:
        digits = F.regexp_replace(r, r"^0+(?=\d)", "")
        return F.concat(F.lit("0"), F.lpad(F.length(digits).cast("string"), 10, "0"), digits)

    return F.array_join(F.transform(runs, lambda r: F.when(r.rlike(r"^\d"), key(r)).otherwise(r)), "")


def short_name(path: Column) -> Column:
    """File name without folders and without an extension of up to 11 characters."""
    return F.regexp_replace(F.regexp_extract(path, r"([^/\\]*)$", 1), r"(?<=.)\.[^.]{1,11}$", "")


def ascii_fold(name: Column) -> Column:
    return F.translate(name, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


