"""Spelling against the library's own vocabulary: words that few rows use, and the common words they may stand for.

The dictionary is the words that at least `least` rows use, `most` of them at most, ranked by how many do. A word is
known if it, or it without a plural or possessive ending, is in the dictionary, or if all parts between its
hyphens are. Words one edit apart (a letter left out, put in, exchanged, or two neighbours swapped) are suggested first,
and where these are fewer than `count`, words two edits apart, by rank. Two words within k edits have a
string in common that k letters left out of each make, so candidates meet by equality under these
strings; no pairs of all words are made. The dictionary has `most` words at most and is sent to all workers, which make its
strings, a number each; what is looked up is compared a batch at a time and never shuffled.

Defined results: letters are those of Latin scripts; words next to digits or underscores, in tags, links and
`embedding:` names don't count; of words in capitals those of up to five letters are taken for names; null and empty texts have no
words; ties go by the word; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

# How many corrections are told, and the longest word that two edits are tried for.
COUNT, LONGEST = 5, 14
LEAST, MOST, STEPS = 30, 20_000, (300, 3000)
LETTERS = "A-Za-zÀ-ɏ"
#: Numbers of strings: the base of their powers, what mixes them, and how many pairs are compared at once. A dictionary has fewer than MOST_WORDS words.
BASE, MIXED, PAIRS, MOST_WORDS = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93), 200_000, 1 << 31
_SKIPPED = re.compile(r"<[^>]*>|embedding:[^\x20\x09-\x0D]+|https?://[^\x20\x09-\x0D]+")
_DIGITS, _DIGIT = "0123456789_", re.compile("[0-9_]")
_FOUND = re.compile(rf"[0-9_]?(?:[{LETTERS}][{LETTERS}'’\-]*[{LETTERS}]|[{LETTERS}])[0-9_]?")


def words(text: str) -> set[str]:
    """The words of a text that a spelling check looks at, as written. Digits and underscores are doubled, so that words on both sides of one are told apart from others."""
    bare = _SKIPPED.sub(" ", text)
    if not _DIGIT.search(bare):
        return set(_FOUND.findall(bare))
    return {w for w in set(_FOUND.findall(_DIGIT.sub(r"\g<0>\g<0>", bare))) if not (w[0] in _DIGITS or w[-1] in _DIGITS)}


def lowered(some: set[str]) -> set[str]:
    return set(" ".join(some).lower().replace("’", "'").split())


def _tallies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, n, plain) of the rows of each batch."""
    for batch in batches:
        n, plain = Counter(), set()
        for text in batch.column(0):
            found = words(text.as_py() or "")
            names = {w for w in found if len(w) <= 5 and w == w.upper()}
            full = lowered(found - names)
            n.update(full | lowered(names))
            plain |= full
        yield pa.RecordBatch.from_arrays([pa.array(list(n), pa.string()), pa.array(list(n.values()), pa.int64()), pa.array([w in plain for w in n], pa.bool_())], ["word", "n", "plain"])


def counted(rows: DataFrame, column: str) -> DataFrame:
    """(word, n, plain): words in lower case, how many rows have each, and whether it is ever more than a short name in capitals."""
    each = rows.select(column).mapInArrow(_tallies, "word string, n long, plain boolean")
    return each.groupBy("word").agg(F.sum("n").alias("n"), F.bool_or("plain").alias("plain"))


def dictionary(counts: DataFrame, least: int = LEAST, most: int = MOST) -> DataFrame:
    """(word, rank) of the common words, the commonest first; `most` at most, so they are numbered as one list."""
    best = counts.where(F.col("n") >= least).orderBy(F.desc("n"), "word").limit(most)
    return best.agg(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("n"), "word"))).alias("w")).select(F.posexplode("w").alias("rank", "x")).select("x.word", (F.col("rank") + 1).alias("rank"))


def _forms(word: Column) -> Column:
    """A word, and what it is without a plural or possessive ending."""
    short = lambda end: F.when(F.endswith(word, F.lit(end)), F.substring(word, F.lit(1), F.length(word) - len(end)))
    return F.filter(F.array(word, *[short(e) for e in ("'s", "s'", "s", "es")]), lambda f: f.isNotNull())


def misspelled(counts: DataFrame, known: DataFrame) -> DataFrame:
    """(word, n) of the words that aren't known, of three letters or more."""
    own = counts.where((F.length("word") >= 3) & F.col("plain"))
    units = F.concat(F.array("word"), F.when(F.contains("word", F.lit("-")), F.filter(F.split("word", "-"), lambda p: F.length(p) >= 3)).otherwise(F.array().cast("array<string>")))
    each = own.select("word", "n", F.posexplode(units).alias("k", "unit")).select("*", F.explode(_forms(F.col("unit"))).alias("form"))
    there = each.join(known.select(F.col("word").alias("form"), F.lit(True).alias("there")), "form", "left")
    parts = there.groupBy("word", "n", "k").agg(F.bool_or(F.coalesce("there", F.lit(False))).alias("ok"))
    told = parts.groupBy("word", "n").agg(F.bool_or((F.col("k") == 0) & F.col("ok")).alias("whole"), F.bool_and((F.col("k") == 0) | F.col("ok")).alias("parts"))
    return told.where(~F.col("whole") & ~(F.contains("word", F.lit("-")) & F.col("parts"))).select("word", "n")


def _codes(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The letters of all words as one array of numbers, where each word begins, and its length."""
    size = np.fromiter(map(len, words), np.int64, len(words))
    return np.frombuffer("".join(words).encode("utf-32-le"), np.uint32), np.cumsum(size) - size, size


def _keys(letters: np.ndarray, edits: int) -> np.ndarray:
    """Numbers of the strings that words of one length (a row each) make with up to so many letters left out: sums of powers, so each takes a few steps, whatever the length."""
    n, size = letters.shape
    with np.errstate(over="ignore"):
        # sums[:, i] is the number of the first i letters; those after a gap move down by one power
        sums = np.zeros((n, size + 1), np.uint64)
        np.cumsum(letters.astype(np.uint64) * np.cumprod(np.full(size, BASE, np.uint64)), axis=1, out=sums[:, 1:])
        at, last, back = np.arange(size), sums[:, -1:], np.uint64(pow(int(BASE), -1, 1 << 64))
        every = [last, sums[:, at] + back * (last - sums[:, at + 1])]
        if edits > 1:
            i, j = np.triu_indices(size, 1)
            every.append(sums[:, i] + back * (sums[:, j] - sums[:, i + 1] + back * (last - sums[:, j + 1])))
        return np.concatenate(every, axis=1)


def _places(keys: np.ndarray, bits: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return ((keys ^ (keys >> np.uint64(29))) * MIXED) >> np.uint64(64 - bits)


class Filed:
    """Dictionary words by the strings that they make with letters left out: sorted numbers, looked up in a table of marks first."""

    def __init__(self, codes: np.ndarray, start: np.ndarray, size: np.ndarray, ranks: np.ndarray, edits: int):
        keys, owners = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
        for length in np.unique(size[ranks]):
            own = ranks[size[ranks] == length]
            made = _keys(codes[start[own][:, None] + np.arange(length)], edits)
            keys.append(made.ravel())
            owners.append(np.repeat(own, made.shape[1]))
        keys, owners = np.concatenate(keys), np.concatenate(owners)
        order = np.argsort(keys)
        self.edits, self.keys, self.owners = edits, keys[order], owners[order]
        self.bits = max(10, int(len(keys) * 8).bit_length())
        self.marks = np.zeros(1 << self.bits, bool)
        self.marks[_places(keys, self.bits)] = True

    def met(self, keys: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs (row of `keys`, dictionary word) with a string in common, each once, about PAIRS at a time."""
        row, column = np.nonzero(self.marks[_places(keys, self.bits)])
        asked = keys[row, column]
        low = np.searchsorted(self.keys, asked, "left")
        many = np.searchsorted(self.keys, asked, "right") - low
        row, low, many = row[many > 0], low[many > 0], many[many > 0]
        ends = np.cumsum(many)
        # a row's pairs stay together
        begin = 0
        while begin < len(row):
            upto = np.searchsorted(ends, (ends[begin - 1] if begin else 0) + PAIRS, "right")
            upto = np.searchsorted(row, row[min(max(upto, begin), len(row) - 1)], "right")
            part, first = many[begin:upto], np.repeat(low[begin:upto], many[begin:upto])
            word = self.owners[first + np.arange(len(first)) - np.repeat(np.cumsum(part) - part, part)]
            pairs = np.unique(np.repeat(row[begin:upto], part) * MOST_WORDS + word)
            yield pairs // MOST_WORDS, pairs % MOST_WORDS
            begin = upto


def distances(a: np.ndarray, b: np.ndarray, a_size: np.ndarray, b_size: np.ndarray) -> np.ndarray:
    """The fewest edits from row to row, 3 for more than two: how far into a word one gets with so many edits, by how many letters the other is ahead.

    Edits may meet: a letter put between two swapped ones, or left out of them, counts as the two edits that it is.
    """
    n, width = a.shape[0], max(a.shape[1], b.shape[1]) + 4
    left, right = np.zeros((n, width), np.int64), np.full((n, width + 4), -1, np.int64)
    left[:, : a.shape[1]] = np.where(np.arange(a.shape[1]) < a_size[:, None], a, 0)
    right[:, 2 : 2 + b.shape[1]] = np.where(np.arange(b.shape[1]) < b_size[:, None], b, -1)
    rows = np.arange(n)
    x = lambda i: left[rows, i]
    y = lambda j: right[rows, j + 2]
    # the next letter from each on that differs, for each shift
    differs = {}
    for d in range(-2, 3):
        equal, found = left == right[:, 2 + d : 2 + d + width], np.full((n, width), width - 1)
        for i in range(width - 2, -1, -1):
            found[:, i] = np.where(equal[:, i], found[:, i + 1], i)
        differs[d] = found
    slide = lambda i, d: differs[d][rows, i]
    most = {d: np.minimum(a_size, b_size - d) for d in range(-2, 3)}
    apart, out = b_size - a_size, np.full(n, 3)
    far = {0: slide(np.zeros(n, np.int64), 0)}
    start = far[0]
    out[(apart == 0) & (start >= a_size)] = 0
    for edit in (1, 2):
        reached = {}
        for d in range(-edit, edit + 1):
            best = np.full(n, -1)
            if d in far:
                i = far[d]
                j = np.maximum(i + d, -2)
                swap = (x(i) == y(j + 1)) & (x(i + 1) == y(j))
                best = np.maximum(best, np.where(i >= 0, i + np.where(swap, 2, 1), -1))
            if d - 1 in far:
                best = np.maximum(best, far[d - 1])
            if d + 1 in far:
                best = np.maximum(best, np.where(far[d + 1] >= 0, far[d + 1] + 1, -1))
            if edit == 2 and d == 1:
                best = np.maximum(best, np.where((x(start) == y(start + 2)) & (x(start + 1) == y(start)), start + 2, -1))
            if edit == 2 and d == -1:
                best = np.maximum(best, np.where((x(start) == y(start + 1)) & (x(start + 2) == y(start)), start + 3, -1))
            best = np.minimum(best, most[d])
            reached[d] = np.where(best >= max(0, -d), slide(np.maximum(best, 0), d), -1)
            out[(apart == d) & (reached[d] >= a_size) & (out > edit)] = edit
        far = reached
    return out


class Dictionary:
    """The dictionary's words filed for one edit, and for two in STEPS of their ranks."""

    def __init__(self, words: list[str], steps: tuple[int, ...]):
        self.words, (self.codes, self.start, self.size) = np.array(words, object), _codes(words)
        self.longest, every = int(self.size.max(initial=0)), np.arange(len(words))
        parts = [every[max(a, 0) : b] for a, b in zip((0, *steps), (*steps, len(words)), strict=True)]
        file = lambda own, edits: Filed(self.codes, self.start, self.size, own, edits)
        self.filed = [file(every, 1), *(file(p[self.size[p] <= LONGEST + 2], 2) for p in parts if len(p))]

    def _best(self, letters: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (row, dictionary word) of words of one length, the best first, and `count` of a row at most."""
        n, size = letters.shape
        keys = {e: _keys(letters, e) for e in ((1, 2) if size <= LONGEST else (1,))}
        found = np.zeros((0, 3), np.int64)
        for filed in self.filed:
            if filed.edits not in keys:
                continue
            # words one edit away come first; then the commonest are asked first, so who has enough of them is done
            lacking = np.flatnonzero(np.bincount(found[:, 0], minlength=n) < count)
            for row, word in filed.met(keys[filed.edits][lacking]):
                row, near = lacking[row], np.abs(self.size[word] - size) <= filed.edits
                row, word = row[near], word[near]
                at = np.arange(size + filed.edits)
                other = self.codes[np.minimum(self.start[word][:, None] + at, max(len(self.codes) - 1, 0))]
                edits = distances(letters[row], other, np.full(len(row), size), self.size[word])
                ok = (edits <= filed.edits) & ((filed.edits == 1) | (edits == 2))
                found = np.concatenate([found, np.stack([row[ok], np.full(ok.sum(), filed.edits), word[ok]], axis=1)])
        found = found[np.lexsort((found[:, 2], found[:, 1], found[:, 0]))]
        place = np.arange(len(found)) - np.searchsorted(found[:, 0], found[:, 0], "left")
        return found[place < count, 0], found[place < count, 2]

    def suggest(self, words: list[str], count: int) -> list[list[str]]:
        out = [[] for _ in words]
        codes, start, size = _codes(words)
        for length in np.unique(size[size <= self.longest + 2]):
            own = np.flatnonzero(size == length)
            for part in np.array_split(own, 1 + len(own) * length * length // (2 * PAIRS)):
                for row, word in zip(*self._best(codes[start[part][:, None] + np.arange(length)], count), strict=True):
                    out[part[row]].append(self.words[word])
        return out


def suggestions(wrong: DataFrame, known: DataFrame, count: int = COUNT) -> DataFrame:
    """(word, suggestions) for every row of `wrong`: dictionary words one edit away, then, where these are few, two, each by rank.

    Words two edits away are looked for in the commonest STEPS of the dictionary first, and further on only for words that
    still have too few: common ones stand first anyway. The dictionary, bounded by `most`, is sent to all workers;
    the words that are looked up stay where they are. Runs a job for the dictionary.
    """
    told = wrong.sparkSession.sparkContext.broadcast([r["word"] for r in known.orderBy("rank").select("word").collect()])  # bounded: MOST words
    steps = STEPS

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filed = None
        for batch in batches:
            filed = filed or Dictionary(told.value, steps)
            found = filed.suggest(batch.column("word").to_pylist(), count)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.list_(pa.string()))], [*batch.schema.names, "suggestions"])

    return wrong.mapInArrow(each, StructType([*wrong.schema.fields, StructField("suggestions", ArrayType(StringType()))]))


def same_case(like: Column, word: Column) -> Column:
    """A correction in the case of the word it is for: capitals, a capital first, or as it is."""
    first = F.substring(like, 1, 1)
    capital = (first == F.upper(first)) & (first != F.lower(first))
    return F.when((F.length(like) > 1) & (like == F.upper(like)), F.upper(word)).when(capital, F.concat(F.upper(F.substring(word, 1, 1)), F.substring(word, F.lit(2), F.length(word)))).otherwise(word)
