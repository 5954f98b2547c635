"""Benchmark decontamination with an FM-index of each shard of the training texts.

Words are runs of ASCII letters (lower-cased), digits and all other non-ASCII
bytes. A phrase is `WINDOW` consecutive words of a test item, or all words of a
shorter one. Each slice of a partition is a shard. Words that no phrase holds end
a run, and runs too short for any phrase can't hold one; over the remaining runs
the shard gets a suffix array (prefix doubling), the Burrows-Wheeler sequence of
word numbers, a wavelet matrix for its ranks and sampled suffix positions. All
phrases are searched backwards at once; occurrences are located by walking to the
next sample, and their words merged to removal spans.

The test items are a stated query set. They are cut into blocks of about
`BLOCK_BYTES` bytes of text by a hash of item and text. One block reaches the driver and
the workers at a time and runs over all documents; what several blocks find is
merged by row, under a number that each row is given and stored with.

Defined results: null and empty texts have no words and are never contaminated;
items without words and items of null id have no phrase; items of equal texts count
each, rows of one item_id as one item; rows of one doc_id are judged each for
itself, however many blocks there are; null ids stay; empty tables give no row
(documents) or no hit (items). `clean` keeps all columns.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import arrow_text
from .shared import numbered, stored

WINDOW, SHARE, SAMPLED = 13, 20, 16
SHARD_BYTES, BLOCK_BYTES = 8 << 20, 4 << 20

_SPACE = np.ones(256, bool)
_SPACE[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False


def word_slice(column: pa.Array) -> arrow_text.Words:
    body, offsets = arrow_text.raw(column)
    upper = (body >= 65) & (body <= 90)
    return arrow_text.joined(arrow_text.split(body + upper.astype(np.uint8) * np.uint8(32), offsets, _SPACE))


class WaveletMatrix:
    """Ranks of symbols in a sequence, one bit plane after the other."""

    def __init__(self, sequence: np.ndarray, top: int):
        self.bits = max(1, int(top).bit_length())
        self.ones, self.zeros = [], []
        for level in range(self.bits - 1, -1, -1):
            bit = (sequence >> level) & 1
            self.ones.append(np.concatenate([[0], np.cumsum(bit, dtype=np.int64)]))
            self.zeros.append(len(sequence) - int(self.ones[-1][-1]))
            sequence = np.concatenate([sequence[bit == 0], sequence[bit == 1]])

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol stands before its position."""
        first = np.zeros_like(at)
        for k in range(self.bits):
            one, ones = (symbol >> (self.bits - 1 - k)) & 1 == 1, self.ones[k]
            at = np.where(one, self.zeros[k] + ones[at], at - ones[at])
            first = np.where(one, self.zeros[k] + ones[first], first - ones[first])
        return at - first

    def symbol(self, at: np.ndarray) -> np.ndarray:
        out = np.zeros_like(at)
        for k in range(self.bits):
            ones = self.ones[k]
            bit = ones[at + 1] - ones[at]
            out = out << 1 | bit
            at = np.where(bit == 1, self.zeros[k] + ones[at], at - ones[at])
        return out


class FMIndex:
    """Of runs of symbols above 0; `ends` marks the position after each run, which holds a 0."""

    def __init__(self, sequence: np.ndarray, every: int = SAMPLED):
        n, ends = len(sequence), sequence == 0
        # the 0 after each run is a symbol of its own, smaller than all words; so no comparison passes the end of a run
        runs = int(ends.sum())
        first = np.where(ends, np.cumsum(ends) - 1, sequence + runs)
        rank = np.unique(first, return_inverse=True)[1].astype(np.int64)
        step = 1
        while True:
            later = np.full(n, -1, np.int64)
            later[: n - step] = rank[step:]
            key = rank * (n + 1) + later + 1
            suffixes = np.argsort(key, kind="stable")
            ordered = key[suffixes]
            place = np.concatenate([[0], np.cumsum(ordered[1:] != ordered[:-1])])
            rank = np.empty(n, np.int64)
            rank[suffixes] = place
            if place[-1] == n - 1 or step >= n:
                break
            step *= 2
        previous = sequence[suffixes - 1]
        previous[suffixes == 0] = 0
        self.top = int(sequence.max())
        self.tree = WaveletMatrix(previous, self.top)
        self.first = np.concatenate([[0], np.cumsum(np.bincount(sequence, minlength=self.top + 1))])
        start = np.concatenate([[True], ends[:-1]])
        self.sampled = (suffixes % every == 0) | start[suffixes]
        self.at = np.cumsum(self.sampled) - 1
        self.positions = suffixes[self.sampled]
        self.n = n

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows [low, high) of the suffixes that begin with each phrase (rows of a matrix)."""
        low, high = np.zeros(len(phrases), np.int64), np.full(len(phrases), self.n, np.int64)
        alive = np.flatnonzero((phrases <= self.top).all(axis=1))
        high[(phrases > self.top).any(axis=1)] = 0
        for k in range(phrases.shape[1] - 1, -1, -1):
            if not len(alive):
                break
            c = phrases[alive, k]
            low[alive] = self.first[c] + self.tree.rank(c, low[alive])
            high[alive] = self.first[c] + self.tree.rank(c, high[alive])
            alive = alive[low[alive] < high[alive]]
        return low, np.maximum(low, high)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Positions of rows, by steps back to a sampled one; a run's start is sampled, so no walk leaves its run."""
        out, row, walking, steps = np.zeros(len(rows), np.int64), rows.copy(), np.arange(len(rows)), 0
        while len(walking):
            here = row[walking]
            done = self.sampled[here]
            out[walking[done]] = self.positions[self.at[here[done]]] + steps
            walking, here = walking[~done], here[~done]
            c = self.tree.symbol(here)
            row[walking] = self.first[c] + self.tree.rank(c, here)
            steps += 1
        return out


class Phrases:
    """Phrases of test items as word numbers, grouped by length, with the items of each."""

    def __init__(self, items: pa.Table, window: int = WINDOW):
        items = items.filter(pc.is_valid(items["item_id"])).sort_by("item_id").combine_chunks()
        self.names, item = np.unique(np.array(items["item_id"].cast(pa.string()).to_pylist(), object), return_inverse=True) if items.num_rows else ([], np.zeros(0, np.int64))
        text = items["text"].combine_chunks() if items.num_rows else pa.array([], pa.string())
        words = word_slice(text if isinstance(text, pa.Array) else text.chunk(0))
        coded = arrow_text.strings(words).dictionary_encode()
        self.vocabulary = coded.dictionary.to_pylist()
        code, length, self.groups = coded.indices.to_numpy().astype(np.int64) + 1, np.minimum(words.counts, window), []
        for n in np.unique(length[length > 0]):
            own = np.flatnonzero(length == n)
            many = words.counts[own] - n + 1
            begin = np.repeat(words.first[own] - (np.cumsum(many) - many), many) + np.arange(many.sum())
            phrases, which = np.unique(code[begin[:, None] + np.arange(n)], axis=0, return_inverse=True)
            # distinct (phrase, item), by phrase
            pair = np.unique(which.ravel() * len(self.names) + np.repeat(item[own], many))
            phrase, names = np.divmod(pair, len(self.names))
            self.groups.append((int(n), phrases, np.split(names, np.searchsorted(phrase, np.arange(1, len(phrases))))))
        self.shortest = int(length[length > 0].min()) if len(self.groups) else 0


def hits(words: arrow_text.Words, phrases: Phrases) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(covered, document, item): which words stand in an occurrence, and the distinct pairs of document and item."""
    total, none = int(words.first[-1]), np.zeros(0, np.int64)
    covered = np.zeros(total, bool)
    if not total or not phrases.groups:
        return covered, none, none
    code = pc.index_in(arrow_text.strings(words), pa.array(phrases.vocabulary, pa.large_binary()))
    code = pc.fill_null(code, -1).to_numpy(zero_copy_only=False).astype(np.int64) + 1
    row = words.row
    # runs of known words within a document
    new = np.concatenate([[True], (row[1:] != row[:-1]) | (code[:-1] == 0) | (code[1:] == 0)])
    begin = np.flatnonzero(new)
    length = np.diff(np.append(begin, total))
    fits = (code[begin] > 0) & (length >= phrases.shortest)
    begin, length = begin[fits], length[fits]
    if not len(begin):
        return covered, none, none
    upto = np.concatenate([[0], np.cumsum(length + 1)])
    sequence, origin = np.zeros(upto[-1], np.int64), np.zeros(upto[-1], np.int64)
    inner = np.arange(int(length.sum())) - np.repeat(np.cumsum(length) - length, length)
    target, source = np.repeat(upto[:-1], length) + inner, np.repeat(begin, length) + inner
    sequence[target], origin[target] = code[source], source
    index = FMIndex(sequence)
    change = np.zeros(total + 1, np.int64)
    docs, names = [], []
    for n, matrix, items in phrases.groups:
        low, high = index.search(matrix)
        count = high - low
        which = np.repeat(np.arange(len(matrix)), count)
        if not len(which):
            continue
        rows = np.repeat(low - (np.cumsum(count) - count), count) + np.arange(len(which))
        at = origin[index.locate(rows)]
        np.add.at(change, at, 1)
        np.add.at(change, at + n, -1)
        # distinct (document, phrase) before phrases become items
        pair = np.unique(row[at] * len(matrix) + which)
        doc, phrase = np.divmod(pair, len(matrix))
        size = np.array([len(x) for x in items])
        docs.append(np.repeat(doc, size[phrase]))
        names.append(np.concatenate([items[p] for p in phrase]))
    covered = np.cumsum(change[:-1]) > 0
    if not docs:
        return covered, none, none
    pair = np.unique(np.concatenate(docs) * len(phrases.names) + np.concatenate(names))
    return covered, *np.divmod(pair, len(phrases.names))


FOUND = "doc_id long, n_words long, n_hit long, items array<string>, spans array<struct<start:long,stop:long>>"
_SPAN = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))


def _found(column: pa.Array, phrases: Phrases) -> list[pa.Array]:
    """n_words, n_hit, items and spans (of word positions) of every row."""
    words = word_slice(column)
    covered, doc, item = hits(words, phrases)
    n = len(words.first) - 1
    upto = np.concatenate([[0], np.cumsum(covered)])
    n_hit = upto[words.first[1:]] - upto[words.first[:-1]]
    lists: list[list[str]] = [[] for _ in range(n)]
    for d, i in zip(doc.tolist(), item.tolist(), strict=True):
        lists[d].append(phrases.names[i])
    spans: list[list[dict]] = [[] for _ in range(n)]
    for d in np.flatnonzero(n_hit):
        edge = np.diff(np.concatenate([[0], covered[words.first[d] : words.first[d + 1]].astype(np.int8), [0]]))
        spans[d] = [{"start": s, "stop": e} for s, e in zip(np.flatnonzero(edge > 0).tolist(), np.flatnonzero(edge < 0).tolist(), strict=True)]
    return [pa.array(words.counts), pa.array(n_hit), pa.array([sorted(x) for x in lists], pa.list_(pa.string())), pa.array(spans, _SPAN)]


def _blocks(benchmark: DataFrame, most: int) -> tuple[int, Callable[[int], Phrases]]:
    """How many blocks of about `most` bytes of text the test items need, and how to get one."""
    # items without id have no phrase; equal rows are one, and texts decide the block as well, so no id makes a block large
    one = benchmark.where(F.col("item_id").isNotNull() & F.col("text").isNotNull()).select("item_id", "text").distinct()
    size = one.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = -(-size // most) or 1
    return n, lambda k: Phrases((one.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k) if n > 1 else one).toArrow())


def _search(phrases: Phrases, hits_only: bool = False) -> Callable:
    """A step from (doc_id, text, further columns) to what the phrases find, the further columns behind."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in arrow_text.slices(batches, limit=SHARD_BYTES):
            out = pa.RecordBatch.from_arrays([b.column(0), *_found(b.column(1), phrases), *b.columns[2:]], names=[f.split()[0] for f in FOUND.split(", ")] + b.schema.names[2:])
            yield out.filter(pc.greater(out["n_hit"], 0)) if hits_only else out

    return run


def _merged(rows: DataFrame, n: int, block: Callable[[int], Phrases]) -> DataFrame:
    """What all blocks find in rows of (doc_id, text, _row), by _row. The first block tells of every row, the others of rows with a hit."""
    every = None
    for k in range(n):
        part = stored(rows.mapInArrow(_search(block(k), k > 0), f"{FOUND}, _row long"), f"block-{k}")
        every = part if every is None else every.unionByName(part)
    flat = lambda c: F.flatten(F.collect_list(c))
    merged = every.groupBy("_row").agg(F.first("doc_id").alias("doc_id"), F.max("n_words").alias("n_words"), F.array_sort(F.array_distinct(flat("items"))).alias("items"), F.array_sort(flat("spans")).alias("spans"))
    return merged.select("doc_id", "n_words", "items", "spans", "_row").mapInArrow(_joined, f"{FOUND}, _row long")


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted spans of several blocks become spans that don't touch."""
    for b in batches:
        out = []
        for spans in b["spans"].to_pylist():
            joined: list[dict] = []
            for s in spans:
                if joined and s["start"] <= joined[-1]["stop"]:
                    joined[-1]["stop"] = max(joined[-1]["stop"], s["stop"])
                else:
                    joined.append(dict(s))
            out.append(joined)
        count = pa.array([sum(s["stop"] - s["start"] for s in x) for x in out], pa.int64())
        yield pa.RecordBatch.from_arrays([b["doc_id"], b["n_words"], count, b["items"], pa.array(out, _SPAN), b["_row"]], names=["doc_id", "n_words", "n_hit", "items", "spans", "_row"])


def _contaminated() -> Column:
    return (F.col("n_hit") > 0) & (SHARE * F.col("n_hit") >= F.col("n_words"))


def scan(docs: DataFrame, benchmark: DataFrame, most: int = BLOCK_BYTES) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, items, spans and contaminated."""
    one = docs.select(F.col("doc_id").cast("long"), "text")
    n, block = _blocks(benchmark, most)
    if n == 1:
        out = one.mapInArrow(_search(block(0)), FOUND)
    else:
        out = _merged(stored(one.withColumn("_row", F.monotonically_increasing_id()), "numbered"), n, block).drop("_row")
    return out.withColumn("contaminated", _contaminated())


def clean(docs: DataFrame, benchmark: DataFrame, most: int = BLOCK_BYTES) -> DataFrame:
    """The rows that are not contaminated, with all their columns."""
    n, block = _blocks(benchmark, most)
    if n > 1:
        own = numbered(docs, "numbered")
        rows = own.rows.select(own.at("doc_id").cast("long").alias("doc_id"), own.at("text").alias("text"), F.col("row").alias("_row"))
        bad = _merged(rows, n, block).where(_contaminated()).select(F.col("_row").alias("row"))
        return own.back(own.rows.join(bad, "row", "left_anti"))
    at, phrases = docs.columns.index("text"), block(0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in arrow_text.slices(batches, limit=SHARD_BYTES):
            n_words, n_hit = (x.to_numpy() for x in _found(b.column(at), phrases)[:2])
            yield b.filter(pa.array((n_hit == 0) | (SHARE * n_hit < n_words)))

    return docs.mapInArrow(run, docs.schema)
