"""Toxicity by a weighted lexicon, matched with Aho-Corasick on folded text.

Folding lower-cases, maps homoglyphs and digit substitutions to the letters they
stand for, one character for one, and keeps runs of letters as words. Lexicon
entries are whole words or beginnings of words. They are learned on about
`SAMPLE` labelled documents: all words and beginnings of 4 to 8 letters are
counted by documents of either label, near copies of equal label once; those whose log-odds have
a high lower bound are taken, the surest first and none that a chosen beginning of
it already stands for; how many there are is bounded by the sample alone. An entry's weight is its log-odds. Word pairs around an entry that
labelled clean documents use at least as often as their share become exception
phrases: a match inside one doesn't count.

The sum of weights is divided by a power of the number of words, and a logistic
curve maps it to a score; power and curve are fitted on a fifth of the sample.

Defined results: null and empty texts, and texts without letters, have no match
and get the score of a sum of 0; texts of any length are matched whole; rows are
independent, so repeated rows, ties and null ids need no rule; an empty table
gives an empty result; without labelled documents of both kinds all scores are 0.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import arrow_text
from .shared import stored

SAMPLE, LEAST, SUREST = 30_000, 5, 1.0
SHORTEST, LONGEST = 4, 8
#: Near copies: words of a shingle, the share of shingles in common, and bands of minimal hashes; of rows at that share, 99 in 100 have a band in common.
SHINGLE, NEAR, BANDS, BAND = 5, 0.8, 24, 8
_TIMES, _PLUS = np.random.default_rng(7).integers(0, 1 << 63, (2, BANDS * BAND), np.uint64) * np.uint64(2) + np.uint64(1)
POWERS = (0.0, 0.25, 0.5, 0.75, 1.0)

# Characters that are written for others.
FOLDED = str.maketrans(
    "013457$@!|"  # digits and signs
    "абвеикмнорстухіјѕԁԛԝ"  # Cyrillic
    "αβεικνορτυχω",  # Greek
    "oieastsail"
    "abbeukmhopctyxijsdqw"
    "abeikvoptuxw",
)
WORD = re.compile(r"[^\W\d_]+")
#: A substitution counts only inside a word: a sign or digit with a letter on either side, or at the start before a letter.
INSIDE = re.compile(r"(?<=[^\W\d_])[013457$@!|]+(?=[^\W\d_])|(?<![^\W_])[013457$@](?=[^\W\d_])")
WIDE = {0xFF00 + k: 0x20 + k for k in range(1, 95)}
SIGNS = {ord(c): FOLDED[ord(c)] for c in "013457$@!|"}
LETTERS = WIDE | {k: v for k, v in FOLDED.items() if k not in SIGNS}


def folded(text: str) -> list[str]:
    text = text.lower() if text.isascii() else text.lower().translate(LETTERS)
    return WORD.findall(INSIDE.sub(lambda m: m[0].translate(SIGNS), text))


def terms(words: list[str]) -> set[str]:
    """Whole words between spaces, and beginnings after a space."""
    distinct = set(words)
    out = {f" {w} " for w in distinct if len(w) >= 3}
    for k in range(SHORTEST, LONGEST + 1):
        out.update(f" {w[:k]}" for w in distinct if len(w) > k)
    return out


def _automaton(entries: dict[str, object]):
    import ahocorasick

    a = ahocorasick.Automaton()
    for k, v in entries.items():
        a.add_word(k, v)
    a.make_automaton()
    return a


class Lexicon:
    def __init__(self, weights: dict[str, float], exceptions: tuple[str, ...] = (), power: float = 0.5, slope: float = 0.0, shift: float = -20.0):
        self.weights, self.exceptions = weights, exceptions
        self.power, self.slope, self.shift = power, slope, shift
        self._made = None

    def __getstate__(self):
        return self.__dict__ | {"_made": None}

    def matches(self, words: list[str]) -> list[str]:
        """Entries found, outside exception phrases, one for each place where any begins (the longest)."""
        if self._made is None:
            self._made = _automaton({e: (len(e), e, False) for e in self.weights} | {p: (len(p), p, True) for p in self.exceptions}) if self.weights else False
        if not self._made:
            return []
        line = f" {' '.join(words)} "
        found: dict[int, str] = {}
        spared = []
        for end, (n, e, exception) in self._made.iter(line):
            start = end - n + 1
            if exception:
                spared.append((start, end))
            elif len(found.get(start, "")) < n:
                found[start] = e
        if not spared or not found:
            return list(found.values())
        spared.sort()
        begin, reach = np.array([a for a, _ in spared]), np.maximum.accumulate([b for _, b in spared])
        at = np.searchsorted(begin, np.fromiter(found, np.int64, len(found)), "right") - 1
        return [e for (s, e), k in zip(found.items(), at.tolist(), strict=True) if k < 0 or reach[k] < s]

    def sums(self, words: list[str]) -> float:
        return sum(self.weights[e] for e in self.matches(words)) / max(1, len(words)) ** self.power

    def score(self, text: str | None) -> float:
        return float(1 / (1 + np.exp(-(self.slope * np.log1p(self.sums(folded(text or ""))) + self.shift))))


def _shingles(words: list[str]) -> np.ndarray:
    """Distinct hashes of the runs of `SHINGLE` words; shorter texts have one, the whole."""
    runs = {" ".join(words[i : i + SHINGLE]) for i in range(max(1, len(words) - SHINGLE + 1))}
    return np.sort(np.fromiter((xxhash.xxh64_intdigest(r) for r in runs), np.uint64, len(runs)))


def _bands(shingles: np.ndarray) -> np.ndarray:
    """One hash for each band of minimal hashes."""
    low = np.full(BANDS * BAND, np.iinfo(np.uint64).max)
    for at in range(0, len(shingles), 4096):
        low = np.minimum(low, (shingles[at : at + 4096] * _TIMES[:, None] + _PLUS[:, None]).min(axis=1))
    return np.array([xxhash.xxh64_intdigest(x.tobytes()) for x in low.reshape(BANDS, BAND)], np.uint64).view(np.int64)


def _together(y: np.ndarray, bands: np.ndarray) -> np.ndarray:
    """The first row of each row's component, where rows of equal label that share a band are linked."""
    top = list(range(len(y)))

    def root(i: int) -> int:
        while top[i] != i:
            top[i] = top[top[i]]
            i = top[i]
        return i

    for k in range(bands.shape[1]):
        first: dict[tuple[int, int], int] = {}
        for i, key in enumerate(zip(y.tolist(), bands[:, k].tolist(), strict=True)):
            u, v = sorted((root(i), root(first.setdefault(key, i))))
            top[v] = u
    return np.array([root(i) for i in range(len(y))], np.int64)


def _leaders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by component, those that aren't near copies of an earlier kept one of it."""
    last, kept = None, []
    for b in arrow_text.slices(batches):
        stay = []
        for part, size, text in zip(b["part"].to_pylist(), b["size"].to_pylist(), b["text"].to_pylist(), strict=True):
            if part != last:
                last, kept = part, []
            fresh = True
            if size > 1:
                mine = _shingles(folded(text))
                for other in kept:
                    n, most = sorted((len(mine), len(other)))
                    if n >= NEAR * most:
                        both = len(np.intersect1d(mine, other, assume_unique=True))
                        if both >= NEAR * (n + most - both):
                            fresh = False
                            break
                if fresh:
                    kept.append(mine)
            stay.append(fresh)
        yield b.select(["doc_id", "text", "y"]).filter(pa.array(stay))


def _once(sample: DataFrame) -> DataFrame:
    """(doc_id, text, y) of the sample without near copies, whose words would all look telling.

    Near copies have equal labels and share `NEAR` of their distinct runs of words. Rows
    that share a band are candidates; their hashes (a bounded number of rows) reach the
    driver, which tells components of candidates. In each, row by row, what is no near
    copy of a kept row is kept, by the shingles themselves.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in arrow_text.slices(batches):
            words = [folded(t) for t in b.column(1).to_pylist()]
            same = [xxhash.xxh3_128_hexdigest(" ".join(w)) for w in words]
            bands = [_bands(_shingles(w)) for w in words]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(same, pa.string()), pa.array(bands, pa.list_(pa.int64()))], names=["doc_id", "text", "y", "same", "bands"])

    marked = stored(sample.select("doc_id", "text", "y").mapInArrow(run, "doc_id long, text string, y int, same string, bands array<long>"), "marked")
    rows = marked.groupBy("y", "same").agg(F.min("doc_id").alias("doc_id"), F.first("bands").alias("bands")).toArrow().sort_by([("doc_id", "ascending"), ("same", "ascending"), ("y", "ascending")])
    if not rows.num_rows:
        return marked.select("doc_id", "text", "y")
    part = _together(rows["y"].to_numpy(), np.array(rows["bands"].to_pylist(), np.int64))
    size = np.bincount(part)[part]
    told = sample.sparkSession.createDataFrame(rows.select(["doc_id", "y", "same"]).append_column("part", pa.array(part)).append_column("size", pa.array(size)))
    one = marked.drop("bands").dropDuplicates(["doc_id", "y", "same"]).join(F.broadcast(told), ["doc_id", "y", "same"])
    ordered = one.select("doc_id", "text", "y", "same", "part", "size").repartition("part").sortWithinPartitions("part", "doc_id", "same")
    return stored(ordered.mapInArrow(_leaders, "doc_id long, text string, y int"), "once")


def _counted(sample: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in arrow_text.slices(batches):
            seen: tuple[Counter, Counter] = (Counter(), Counter())
            for t, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                seen[y].update(terms(folded(t)))
            every = list(seen[0] | seen[1])
            yield pa.RecordBatch.from_arrays([pa.array(every, pa.string()), *(pa.array([seen[y][e] for e in every], pa.int64()) for y in (1, 0))], names=["term", "bad", "good"])

    counts = sample.select("text", "y").mapInArrow(run, "term string, bad long, good long")
    return counts.groupBy("term").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))


def _odds(bad, good, n_bad: int, n_good: int):
    return np.log((bad + 0.5) / (n_bad + 1)) - np.log((good + 0.5) / (n_good + 1))


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float, float]:
    """Slope, shift and mean loss of a lightly damped logistic curve."""
    design, w = np.stack([x, np.ones(len(x))], axis=1), np.zeros(2)
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
        step = np.linalg.solve(design.T @ (design * (p * (1 - p))[:, None]) + 1e-2 * np.eye(2), design.T @ (y - p) - 1e-2 * w)
        w = w + np.clip(step, -4, 4)
        if np.abs(step).max() < 1e-8:
            break
    p = np.clip(1 / (1 + np.exp(-np.clip(design @ w, -30, 30))), 1e-6, 1 - 1e-6)
    return float(w[0]), float(w[1]), float(-np.mean(y * np.log(p) + (1 - y) * np.log(1 - p)))


def fit(sample: DataFrame) -> Lexicon:
    """Learn from (doc_id, text, y, held): rows of bounded number, whose telling terms reach the driver. The sample should be a stored table, as it is read several times."""
    learn = _once(sample.where(~F.col("held")))
    sizes = {r["y"]: r["n"] for r in learn.groupBy("y").agg(F.count("*").alias("n")).collect()}
    if not sizes.get(1) or not sizes.get(0):
        return Lexicon({})
    n_bad, n_good = sizes[1], sizes[0]
    odds = F.log((F.col("bad") + 0.5) / (n_bad + 1)) - F.log((F.col("good") + 0.5) / (n_good + 1))
    bound = odds - 1.5 * F.sqrt(1 / (F.col("bad") + 0.5) + 1 / (F.col("good") + 0.5))
    rows = _counted(learn).where(F.col("bad") >= LEAST).select("term", "bad", "good", bound.alias("bound")).where((F.col("bound") > SUREST) & (F.col("bad") * n_good > F.col("good") * n_bad)).orderBy(F.desc("bound"), F.desc(F.length("term")), "term").collect()
    if not rows:
        return Lexicon({})
    weights: dict[str, float] = {}
    for r in rows:  # from the surest on; what a chosen beginning already says as well is left out
        term, odds = r["term"], float(_odds(r["bad"], r["good"], n_bad, n_good))
        shorter = [weights[term[:k]] for k in range(SHORTEST + 1, len(term)) if term[:k] in weights]
        if not shorter or odds > max(shorter) + 0.5:
            weights[term] = odds
    return _calibrated(Lexicon(weights, _exceptions(learn, weights, n_bad, n_good)), sample)


def _exceptions(learn: DataFrame, weights: dict[str, float], n_bad: int, n_good: int) -> tuple[str, ...]:
    """Pairs of neighbouring words, one of them an entry, that clean documents use at least as often as toxic ones."""
    bare = Lexicon(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in arrow_text.slices(batches):
            seen: tuple[Counter, Counter] = (Counter(), Counter())
            for t, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                words = folded(t)
                if bare.matches(words):
                    hit = {w for w in set(words) if bare.matches([w])}
                    seen[y].update({f" {u} {v} " for u, v in zip(words, words[1:], strict=False) if u in hit or v in hit})
            every = list(seen[0] | seen[1])
            yield pa.RecordBatch.from_arrays([pa.array(every, pa.string()), *(pa.array([seen[y][e] for e in every], pa.int64()) for y in (1, 0))], names=["term", "bad", "good"])

    pairs = learn.select("text", "y").mapInArrow(run, "term string, bad long, good long").groupBy("term").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))
    rows = pairs.where((F.col("good") >= LEAST) & (F.col("good") * n_bad >= F.col("bad") * n_good)).orderBy(F.desc("good"), "term").collect()
    return tuple(r["term"] for r in rows)


def _calibrated(made: Lexicon, sample: DataFrame) -> Lexicon:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in arrow_text.slices(batches):
            words = [folded(t) for t in b.column(0).to_pylist()]
            sums = [sum(made.weights[e] for e in made.matches(w)) for w in words]
            yield pa.RecordBatch.from_arrays([b.column(1), pa.array(sums, pa.float64()), pa.array([len(w) for w in words], pa.int64())], names=["y", "s", "n"])

    held = sample.where("held").select("text", "y").mapInArrow(run, "y int, s double, n long").toArrow()
    y, s, n = held["y"].to_numpy().astype(float), held["s"].to_numpy(), np.maximum(1, held["n"].to_numpy())
    order = np.lexsort((y, s, n))
    y, s, n = y[order], s[order], n[order]
    if len(set(y)) == 2:
        fits = [(*_logistic(np.log1p(s / n**p), y), p) for p in POWERS]
        made.slope, made.shift, _, made.power = min(fits, key=lambda f: f[2])
    return made


def score(docs: DataFrame, lexicon: Lexicon) -> DataFrame:
    """(doc_id, score, entries) of every row; entries lists the lexicon entries found."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in arrow_text.slices(batches):
            words = [folded(t or "") for t in b.column(1).to_pylist()]
            found = [lexicon.matches(w) for w in words]
            sums = np.array([sum(lexicon.weights[e] for e in f) / max(1, len(w)) ** lexicon.power for f, w in zip(found, words, strict=True)])
            p = 1 / (1 + np.exp(-(lexicon.slope * np.log1p(sums) + lexicon.shift)))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(p, pa.float64()), pa.array([sorted({e.strip() for e in f}) for f in found], pa.list_(pa.string()))], names=["doc_id", "score", "entries"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, score double, entries array<string>")
