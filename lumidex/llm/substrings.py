"""Substring deduplication by super-k-mer partitioning.

A window is `WINDOW` consecutive words of a document; its minimiser is the least
hash among its runs of `SEED` words. Consecutive windows with one minimiser form a
super-k-mer. Equal windows have equal minimisers, so they meet in its bucket.

1. Each slice of a partition drops windows that occur earlier in the slice, which
   is told by their words, and reduces the rest to super-k-mers, described by
   minimiser, a hash of their words, and place.
2. A bucket (shuffle on the minimiser, sorted) finds super-k-mers that are copies of
   an earlier one, whose windows all go, and asks for the words of the others,
   if the bucket has more than one of them.
3. Only those travel: one packed string each, to the minimiser's bucket, where
   windows are sorted and compared as strings. A bucket of more than `LARGE`
   different super-k-mers is split: its strings are cut to single windows, each
   dealt out by its own hash, combined in its slice and again in `SALTS` shares,
   so no key grows with the number of copies.
4. What was found is gathered by document and words are taken out of the texts.

Equal super-k-mers of different slices are recognised by two independent hashes of
64 bits, made from the 128-bit digests of their words; everything else by its words.

Defined results: null and empty texts have no words and stay empty; texts of any
length count whole; texts of fewer words than a window keep all; of repeated ids
each row counts as a document of its own, in the order of their texts (so a
repeated row goes as a copy); null ids come first; an empty table gives an empty
result. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import arrow_text
from .shared import stored

WINDOW, SEED, LARGE, SALTS = 20, 8, 20_000, 32
SLICE, CHUNK_ROWS = 3 << 20, 200_000

_PLACES = "kind int, bucket long, content long, other long, doc_id long, start int, n int"
_COPY, _PIECE = 0, 1  # rows of step 1; step 2 gives copies (0), strings that are asked for (1) and those of large buckets (2)


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every `width` consecutive values."""
    have, out = 1, values
    while 2 * have <= width:
        out = np.minimum(out[:-have], out[have:])
        have *= 2
    rest = width - have
    return np.minimum(out[:-rest], out[rest:]) if rest else out


def _runs(flags: np.ndarray, breaks: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """First position and length of each run of set flags; `breaks` marks positions where a new run begins anyway."""
    at = np.flatnonzero(flags)
    if not len(at):
        return at, at
    new = np.concatenate([[True], np.diff(at) > 1])
    if breaks is not None:
        new |= breaks[at]
    first = np.flatnonzero(new)
    return at[first], np.diff(np.append(first, len(at)))


def _describe(ids: np.ndarray, column: pa.Array, window: int, seed: int) -> pa.RecordBatch:
    """Step 1 of one slice."""
    order = np.argsort(ids, kind="stable")
    words = arrow_text.joined(arrow_text.split(*arrow_text.raw(column.take(pa.array(order)))))
    ids, total = ids[order], int(words.first[-1])
    empty = total < window
    if not empty:
        row = words.row
        count = total - window + 1
        valid = row[:count] == row[window - 1 :]
        distinct, number = arrow_text.distinct(arrow_text.strings(words))
        digest = np.frombuffer(b"".join([xxhash.xxh3_128_digest(w) for w in distinct]), "<u8").reshape(-1, 2)
        code, second = digest[number, 0], digest[number, 1]
        left = np.arange(count)
        one = arrow_text.span_hash(code, left, left + window)
        # windows that occur earlier in the slice; positions ascend with id and place
        at = np.flatnonzero(valid)
        sort = at[np.argsort(one[at], kind="stable")]
        again = np.zeros(count, bool)
        alike = np.flatnonzero(one[sort[1:]] == one[sort[:-1]])
        for k in range(0, len(alike), 1 << 15):  # by their words, a share at a time
            u, v = sort[alike[k : k + (1 << 15)]], sort[alike[k : k + (1 << 15)] + 1]
            again[v[(number[u[:, None] + np.arange(window)] == number[v[:, None] + np.arange(window)]).all(axis=1)]] = True
        parts = np.arange(total - seed + 1)
        least = _least(arrow_text.span_hash(code, parts, parts + seed), window - seed + 1)
        edge = np.concatenate([[True], (row[1:count] != row[: count - 1])])
        gone, n_gone = _runs(again, edge)
        first, n = _runs(valid & ~again, edge | np.concatenate([[True], least[1:] != least[:-1]]))
        kind = np.repeat(np.array([_COPY, _PIECE], np.int32), [len(gone), len(first)])
        where, size = np.concatenate([gone, first]), np.concatenate([n_gone, n])
        bucket = np.concatenate([arrow_text.mix(ids[row[gone]].astype(np.uint64)), least[first]]).view(np.int64)
        content, other = (np.concatenate([np.zeros(len(gone), np.uint64), arrow_text.span_hash(c, first, first + n + window - 1)]).view(np.int64) for c in (code, second))
        columns = [kind, bucket, content, other, ids[row[where]], (where - words.first[row[where]]).astype(np.int32), size.astype(np.int32)]
    else:
        columns = [np.zeros(0, t) for t in ("i4", "i8", "i8", "i8", "i8", "i4", "i4")]
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=[f.split()[0] for f in _PLACES.split(", ")])


class _Buckets:
    """Step 2 over the sorted rows of one partition, a chunk at a time; a bucket that is larger than a chunk goes through in parts."""

    def __init__(self, large: int):
        self.large, self.last, self.counted = large, None, 0

    def chunk(self, t: pa.Table, final: bool) -> tuple[pa.RecordBatch, pa.Table]:
        """The findings of all complete buckets of a chunk, and what is left for the next."""
        bucket, content, other, kind = (t[c].to_numpy() for c in ("bucket", "content", "other", "kind"))
        n = len(bucket)
        cut = n if final else int(np.searchsorted(bucket, bucket[-1]))
        part = cut == 0  # one bucket fills the chunk: it's a large one
        cut = cut or n
        bucket, content, other, kind = bucket[:cut], content[:cut], other[:cut], kind[:cut]
        piece = kind == _PIECE
        new_bucket = np.concatenate([[True], bucket[1:] != bucket[:-1]])
        new = new_bucket | np.concatenate([[True], (content[1:] != content[:-1]) | (other[1:] != other[:-1]) | (kind[1:] != kind[:-1])])
        if self.last and self.last[:3] == (bucket[0], content[0], other[0]) and piece[0]:
            new[0] = False
        group = np.cumsum(new_bucket) - 1
        distinct = np.bincount(group[new & piece], minlength=group[-1] + 1)
        if self.last and self.last[0] == bucket[0]:
            distinct[0] += self.last[3]
        if part:
            distinct[0] += self.large
        out = np.where(piece & new, np.where(distinct[group] > self.large, 2, np.where(distinct[group] > 1, 1, -1)), 0)
        self.last = (bucket[-1], content[-1], other[-1], self.large + 1) if part else None
        keep = pa.array(out >= 0)
        done = t.slice(0, cut)
        found = pa.table({"kind": pa.array(out.astype(np.int32)), **{c: done[c] for c in ("bucket", "doc_id", "start", "n")}}).filter(keep)
        return found, t.slice(cut)


def _judge(batches: Iterator[pa.RecordBatch], large: int) -> Iterator[pa.RecordBatch]:
    state, held, rows = _Buckets(large), [], 0
    for b in batches:
        if b.num_rows:
            held.append(b)
            rows += b.num_rows
        if rows >= max(CHUNK_ROWS, 2 * large):
            found, rest = state.chunk(pa.Table.from_batches(held).combine_chunks(), False)
            yield from found.to_batches()
            held, rows = rest.to_batches(), rest.num_rows
    if held:
        yield from state.chunk(pa.Table.from_batches(held).combine_chunks(), True)[0].to_batches()


def _packed(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    """Step 3, sending: the words that were asked for."""
    for b in arrow_text.slices(batches, limit=SLICE):
        out: tuple[list, ...] = ([], [], [], [])
        single: dict[bytes, tuple[int, int]] = {}
        for doc, text, asked in zip(b["doc_id"].to_pylist(), b["text"].to_pylist(), b["asked"].to_pylist(), strict=True):
            words = text.encode("utf-8", "surrogatepass").split()
            for a in asked:
                s, n = a["start"], a["n"]
                if a["kind"] == 1:
                    for column, v in zip(out, (a["bucket"], b" ".join(words[s : s + n + window - 1]), doc, s), strict=True):
                        column.append(v)
                else:
                    for i in range(s, s + n):
                        w = b" ".join(words[i : i + window])
                        known = single.get(w)
                        if known is None:
                            single[w] = (doc, i)
                        else:  # twice in the slice, so the later of the two is a copy; it needs no string. Rows come in any order
                            single[w], later = sorted((known, (doc, i)))
                            for column, v in zip(out, (None, b"", *later), strict=True):
                                column.append(v)
        alone = [False] * len(out[0]) + [True] * len(single)
        for w, (doc, i) in single.items():
            for column, v in zip(out, (hash_of(w), w, doc, i), strict=True):
                column.append(v)
        yield pa.RecordBatch.from_arrays([pa.array(alone, pa.bool_()), *(pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.binary(), pa.int64(), pa.int32()), strict=True))], names=_STRINGS)


_STRINGS = ["alone", "bucket", "words", "doc_id", "start"]


def hash_of(words: bytes) -> int:
    return xxhash.xxh64_intdigest(words) - (1 << 63)


def _copies(t: pa.Table, window: int) -> pa.RecordBatch:
    """Step 3, receiving: windows of complete buckets, sorted as strings; all but the earliest of equal ones are copies."""
    bucket, ids, start = t["bucket"].to_numpy(), t["doc_id"].to_numpy(), t["start"].to_numpy()
    lines = t["words"].to_pylist()
    doc, place = [], []
    s = 0
    for e in np.append(np.flatnonzero(np.diff(bucket)) + 1, len(bucket)):
        seen = []
        for k in range(s, e):
            words = lines[k].split(b" ")
            seen += [(b" ".join(words[i : i + window]), int(ids[k]), int(start[k]) + i) for i in range(len(words) - window + 1)]
        seen.sort()
        for before, now in zip(seen, seen[1:], strict=False):
            if before[0] == now[0] and before[1:] != now[1:]:
                doc.append(now[1])
                place.append(now[2])
        s = e
    return pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(place, pa.int32()), pa.array(np.ones(len(doc), np.int32))], names=["doc_id", "start", "n"])


def _earliest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by words and place, the first of equal words goes on; the others are copies and lose bucket and words."""
    last = None
    for b in batches:
        if b.num_rows:
            words = b["words"]
            again = np.concatenate([[words[0].as_py() == last], pc.equal(words[1:], words[:-1]).to_numpy(zero_copy_only=False)]).astype(bool)  # rows without words are copies already
            last = words[-1].as_py()
            gone = pa.array(again)
            yield pa.RecordBatch.from_arrays([b["alone"], pc.if_else(gone, pa.scalar(None, pa.int64()), b["bucket"]), pc.if_else(gone, pa.scalar(b"", pa.binary()), words), b["doc_id"], b["start"]], names=_STRINGS)


def _compared(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    """Strings of super-k-mers, sorted by bucket: of each bucket there are `LARGE` at most, as larger ones were split."""
    held: list[pa.RecordBatch] = []
    rows = 0
    for b in batches:
        if b.num_rows:
            held.append(b)
            rows += b.num_rows
        if rows >= 20_000 and held[0]["bucket"][0].as_py() != held[-1]["bucket"][-1].as_py():
            t = pa.Table.from_batches(held).combine_chunks()
            bucket = t["bucket"].to_numpy()
            cut = int(np.searchsorted(bucket, bucket[-1]))
            yield _copies(t.slice(0, cut), window)
            held, rows = t.slice(cut).to_batches(), len(bucket) - cut
    if held:
        yield _copies(pa.Table.from_batches(held).combine_chunks(), window)


def _taken(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    """Step 4: words of whole texts without those that a copied window covers."""
    for b in arrow_text.slices(batches, limit=SLICE):
        n_words, n_gone, kept = [], [], []
        for text, spans in zip(b["text"].to_pylist(), b["copies"].to_pylist(), strict=True):
            words = (text or "").encode("utf-8", "surrogatepass").split()
            n_words.append(len(words))
            if spans:
                change = np.zeros(len(words) + 1, np.int64)
                for s in spans:
                    change[s["start"]] += 1
                    change[s["start"] + s["n"] + window - 1] -= 1
                stay = np.flatnonzero(np.cumsum(change[:-1]) == 0)
                words = [words[i] for i in stay]
            n_gone.append(n_words[-1] - len(words))
            kept.append(b" ".join(words).decode("utf-8", "surrogatepass"))
        yield pa.RecordBatch.from_arrays([b["doc_id"], pa.array(n_words, pa.int64()), pa.array(n_gone, pa.int64()), pa.array(kept, pa.string())], names=["doc_id", "n_words", "n_removed", "kept"])


def remove(docs: DataFrame, window: int = WINDOW, seed: int = SEED, large: int = LARGE) -> DataFrame:
    """One row per document: doc_id, n_words, n_removed and kept, the text that stays (words joined by one space)."""
    one = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    n, distinct = one.agg(F.count("*"), F.countDistinct("doc_id")).first()
    if n == distinct:
        return _removed(one, window, seed, large)
    # ids repeat or are null: ascending stand-ins, by id and text
    ordered = one.withColumnRenamed("doc_id", "own").repartitionByRange(F.col("own").asc_nulls_first(), F.col("text").asc_nulls_first()).sortWithinPartitions(F.col("own").asc_nulls_first(), F.col("text").asc_nulls_first())
    told = stored(ordered.withColumn("doc_id", F.monotonically_increasing_id()), "ordered")
    return _removed(told.select("doc_id", "text"), window, seed, large).join(told.select("doc_id", "own"), "doc_id").select(F.col("own").alias("doc_id"), "n_words", "n_removed", "kept")


def _removed(docs: DataFrame, window: int, seed: int, large: int) -> DataFrame:
    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in arrow_text.slices(batches, limit=SLICE):
            yield _describe(b.column(0).to_numpy(), b.column(1), window, seed)

    places = docs.mapInArrow(describe, _PLACES).repartition("bucket").sortWithinPartitions("bucket", "content", "other", "doc_id", "start")
    found = stored(places.mapInArrow(lambda b: _judge(b, large), "kind int, bucket long, doc_id long, start int, n int"), "places")
    asked = found.where("kind > 0").groupBy("doc_id").agg(F.collect_list(F.struct("kind", "bucket", "start", "n")).alias("asked"))
    kinds = "alone boolean, bucket long, words binary, doc_id long, start int"
    sent = stored(docs.join(asked, "doc_id").mapInArrow(lambda b: _packed(b, window), kinds), "strings")
    # single windows: the earliest of a share of their documents, then of all
    single, place = sent.where("alone"), ["words", "doc_id", "start"]
    shares = single.repartition("bucket", F.pmod("doc_id", F.lit(SALTS))).sortWithinPartitions(*place).mapInArrow(_earliest, kinds)
    last = shares.repartition(F.coalesce("bucket", F.xxhash64("doc_id", "start"))).sortWithinPartitions(*place)
    ends = last.mapInArrow(_earliest, kinds).where("bucket is null")
    dealt = sent.where("not alone and bucket is not null").repartition("bucket").sortWithinPartitions("bucket").select(_STRINGS)
    copies = found.where("kind = 0").select("doc_id", "start", "n")
    for more in (sent.where("not alone and bucket is null"), ends):
        copies = copies.union(more.select("doc_id", "start", F.lit(1)))
    copies = copies.union(dealt.mapInArrow(lambda b: _compared(b, window), "doc_id long, start int, n int"))
    spans = copies.groupBy("doc_id").agg(F.collect_list(F.struct("start", "n")).alias("copies"))
    return docs.join(spans, "doc_id", "left").mapInArrow(lambda b: _taken(b, window), "doc_id long, n_words long, n_removed long, kept string")
