"""Token-id output: canonical length-limited Huffman coding of ids from global counts.

`encode` gives the ids of each whole text by the tokenizers library, with an end
id. `write` counts ids over all documents, builds one canonical code of at most
16 bits a symbol (more only for a vocabulary of over 65,536 used ids) by package-merge, deals documents out by ranges of their id and
writes sorted, independent blocks through Spark's own file writer; `read` decodes
them. Ids are counted while texts are encoded. A block is one row of a Parquet table:

    part, first     the range it belongs to, and ids before it in that range
    doc_id, sizes   its documents in ascending order, and their numbers of ids
    payload         codes end to end, most significant bit first
    checkpoints     bit offset of every 64th id of the block

Decoding walks all checkpoints of a block in step, one table lookup for each id.
The code book (symbol, length) is a small table beside the blocks: any reader
rebuilds the codes from the lengths. Both grow with the vocabulary only.

Texts are cut at spaces and line feeds, which no token spans, and where the
tokenizer's own rules part them. Each distinct piece is encoded once by a worker
and remembered, in a table of bounded size. In every slice one text is compared
with the library's ids of the whole.

Defined results: null and empty texts have the end id alone; null ids sort first;
rows of one id are written one after another, shorter first, then by their ids;
an empty table gives no block and an empty result. Other columns are ignored.
"""

from __future__ import annotations

import os
import re
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import arrow_text
from .shared import shared_dir

LONGEST, STEP = 16, 64
BLOCK_IDS = 1 << 17

_GAP = np.zeros(256, bool)
_GAP[[0x20, 0x0A]] = True
_DIGITS, _SIGNS = "0123456789", "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
_LATIN = "".join(chr(c) for c in range(0xC0, 0x100) if c not in (0xD7, 0xF7))
_LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz" + _LATIN


def _byte_classes() -> np.ndarray:
    """1 letter, 2 sign, 3 digit, 4 lead byte of a Latin letter, 0 any other."""
    out = np.zeros(256, np.int8)
    for n, chars in ((1, _LETTERS[:52]), (2, _SIGNS), (3, _DIGITS)):
        out[[ord(c) for c in chars]] = n
    out[0xC3] = 4
    return out


_CLASS = _byte_classes()
_UPPER, _SECOND = np.zeros(256, bool), np.zeros(256, bool)
_UPPER[65:91] = True
_SECOND[[c & 0x3F | 0x80 for c in map(ord, _LATIN)]] = True


class Encoder:
    """Ids of whole texts.

    Texts are cut to chunks at spaces and line feeds. A chunk of Latin letters, digits and signs
    (no apostrophe) is cut further, to runs of letters, in lower case, runs of signs and single
    digits, if the tokenizer's normaliser and pre-tokenizer do so with every pair of such
    characters, which is tried when it is loaded. All other chunks, and chunks that hold an added
    token, stay whole. Each distinct piece is encoded once by the library and remembered.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = t = Tokenizer.from_file(path)
        self.size = t.get_vocab_size()
        self.memory = arrow_text.Memory()
        self.marks = np.zeros(self.size, bool)
        for token, i in t.get_vocab().items():
            self.marks[i] = token.endswith("</w>")
        added = t.get_added_tokens_decoder().values()
        self.added = [a.content.encode() for a in added]
        # an added token that takes spaces along, or holds one, could reach over a gap
        self.cuts = not any(a.lstrip or a.rstrip or a.single_word or a.content.split() != [a.content] for a in added) and self._gaps_part()
        self.shares = self.cuts and bool(self.marks.any()) and self._pairs_part()

    def _gaps_part(self) -> bool:
        """Whether ids on both sides of a space or line end are those of the two sides alone, for all pairs of kinds of characters, and for gaps of several."""
        some = ["a", "Z", "7", "é", "-", ".", "(", "ñ", "世", "ab1.c", "\t"]
        ids = lambda texts: [x.ids for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        alone = dict(zip(some, ids(some), strict=True))
        tried = [(x, y, x + gap + y) for x in some for y in some for gap in (" ", "\n", "  ", "\n\n", " \n")]
        return ids([" ", "\n", " \n "]) == [[], [], []] and ids([t for *_, t in tried]) == [alone[x] + alone[y] for x, y, _ in tried]

    def _pairs_part(self) -> bool:
        """Whether every pair of known characters becomes its lower case, and parts exactly where classes change or a digit stands."""
        kinds = {c: k for k, cs in enumerate((_LETTERS, _SIGNS, _DIGITS)) for c in cs}
        pairs = [x + y for x in kinds for y in kinds]
        text = " ".join(pairs)
        if any(a.decode() in text for a in self.added) or self.tokenizer.normalizer is None or self.tokenizer.pre_tokenizer is None:
            return False
        normal = self.tokenizer.normalizer.normalize_str(text)
        if normal != text.lower():
            return False
        found = [normal[s:e] for _, (s, e) in self.tokenizer.pre_tokenizer.pre_tokenize_str(normal)]
        parted = lambda x, y: kinds[x] != kinds[y] or kinds[x] == 2
        return found == [piece for x, y in pairs for piece in ((x.lower(), y.lower()) if parted(x, y) else ((x + y).lower(),))]

    def _ids(self, chunks: list[str]) -> list[bytes]:
        return [np.array(x.ids, "<i4").tobytes() for x in self.tokenizer.encode_batch_fast(chunks, add_special_tokens=False)]

    def _learn(self, pieces: list[bytes]) -> list[bytes]:
        """Ids of new pieces; those that are words of their own go to the library in one text, as the vocabulary marks the token that ends a word."""
        out: list[bytes] = []
        for at in range(0, len(pieces), 1024):
            some = [p.decode("utf-8", "replace") for p in pieces[at : at + 1024]]
            simple = [self.shares and SIMPLE(p) is not None for p in some]
            own, plain = [p for p, x in zip(some, simple, strict=True) if not x], [p for p, x in zip(some, simple, strict=True) if x]
            ids = np.array(self.tokenizer.encode_batch_fast([" ".join(plain)], add_special_tokens=False)[0].ids, np.int32)
            ends = np.flatnonzero(self.marks[ids]) + 1
            if plain and len(ends) == len(plain) and ends[-1] == len(ids):
                raw, cut = ids.tobytes(), ends.tolist()
                found = {p: raw[4 * s : 4 * e] for p, s, e in zip(plain, [0, *cut], cut, strict=False)}
            else:
                own, found = some, {}
            found |= zip(own, self._ids(own), strict=True)
            out += [found[p] for p in some]
        return out

    def _classes(self, body: np.ndarray, words: arrow_text.Words) -> tuple[np.ndarray, np.ndarray]:
        """The class of each byte, and whether its chunk is cut further; changes letters of such chunks to lower case."""
        kind = _CLASS[body]
        lead = np.flatnonzero(kind == 4)
        lead = lead[_SECOND[body[lead + 1]]]  # a space follows each chunk
        latin = np.zeros(len(body), bool)
        latin[lead + 1] = True
        kind[kind == 4] = 0
        kind[lead] = kind[lead + 1] = 1
        for a in self.added:
            raw = body.tobytes()
            at = raw.find(a)
            while at >= 0:
                kind[at] = 0
                at = raw.find(a, at + 1)
        kind[words.end] = 5  # so that a chunk's sum of odd characters is one span
        whole = np.logical_or.reduceat(kind == 0, words.start) if len(words.start) else np.zeros(0, bool)
        inside = np.repeat(~whole, words.end - words.start + 1)
        body[inside & (_UPPER[body] | (latin & (body <= 0x9E)))] += np.uint8(32)
        return kind, inside

    def pieces(self, column: pa.Array) -> tuple[list[bytes], np.ndarray, np.ndarray]:
        """Distinct pieces, the number of each piece of the texts, and the first piece of each text (n+1)."""
        body, offsets = arrow_text.raw(column)
        if not self.cuts:
            texts = [t or "" for t in column.to_pylist()]
            return *arrow_text.distinct(pa.array([t.encode("utf-8", "replace") for t in texts], pa.large_binary())), np.arange(len(texts) + 1)
        words = arrow_text.joined(arrow_text.split(body, offsets, _GAP))
        body, begin = words.body, np.zeros(len(words.body) + 1, bool)
        begin[words.start] = True
        if self.shares and len(body):
            kind, inside = self._classes(body, words)
            begin[1:-1] |= inside[1:] & ((kind[1:] != kind[:-1]) | (kind[1:] == 3))  # a digit always begins a piece
        # the space after each chunk would be part of its last piece
        begin[words.end] = False
        start = np.flatnonzero(begin)
        gaps = np.zeros(len(body), np.int32)
        gaps[words.end] = 1
        packed, moved = body[gaps == 0], np.concatenate([[0], np.cumsum(gaps)])
        moved = np.arange(len(moved)) - moved
        strings = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(np.append(moved[start], len(packed)).astype(np.int64)), pa.py_buffer(packed)])
        first = np.searchsorted(start, np.append(words.start, len(body) + 1)[words.first])
        return *arrow_text.distinct(strings), first

    def encode(self, column: pa.Array, end: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts end to end, each with the end id, and where each text begins (n+1)."""
        distinct, codes, first = self.pieces(column)
        parts = self.memory.values(distinct, self._learn)
        # the end id is one more piece, after each text's last
        codes = np.insert(codes, first[1:], len(parts))
        ids, upto = arrow_text.gathered([*parts, np.array([end], "<i4").tobytes()], codes)
        upto = upto[first + np.arange(len(first))]
        self._compare(column, ids, upto)
        return ids, upto

    def _compare(self, column: pa.Array, ids: np.ndarray, upto: np.ndarray) -> None:
        """One text of each slice, drawn by a checksum of its ids and of any length, is encoded whole by the library as well."""
        k = zlib.crc32(ids[:4096].tobytes()) % max(1, len(column))
        if len(column):
            text, mine = column[k].as_py() or "", ids[upto[k] : upto[k + 1] - 1]
            if self.tokenizer.encode(text, add_special_tokens=False).ids != mine.tolist():
                raise AssertionError(f"pieces and library differ on {text[:1000]!r}")


SIMPLE = re.compile(f"[{_LETTERS}]+|[{re.escape(_SIGNS)}]+|[{_DIGITS}]").fullmatch
_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def width(path: str) -> str:
    """The type that ids of a vocabulary are packed in between the steps."""
    return "<u2" if encoder(path).size <= 1 << 16 else "<u4"


def encode(docs: DataFrame, path: str, end: int, packed: str = "") -> DataFrame:
    """(doc_id, ids) of every row: the whole text's ids and the end id; as an array, or as bytes of the type `packed`.

    With `packed` each partition ends in a row that has a tally instead, the number of each id in it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally = np.zeros(max(encoder(path).size, end + 1), np.int64)
        for b in arrow_text.slices(batches):
            values, upto = encoder(path).encode(b.column(1), end)
            if not packed:
                yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array(upto.astype(np.int32)), pa.array(values))], names=["doc_id", "ids"])
                continue
            tally += np.bincount(values, minlength=len(tally))
            raw = values.astype(packed)
            ids = pa.BinaryArray.from_buffers(pa.binary(), len(upto) - 1, [None, pa.py_buffer((upto * raw.itemsize).astype(np.int32)), pa.py_buffer(raw)])
            yield pa.RecordBatch.from_arrays([b.column(0), ids, pa.nulls(len(ids), pa.binary())], names=["doc_id", "ids", "tally"])
        if packed and tally.any():
            yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.nulls(1, pa.binary()), pa.array([tally.tobytes()])], names=["doc_id", "ids", "tally"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, PACKED if packed else "doc_id long, ids array<int>")


PACKED = "doc_id long, ids binary, tally binary"


def code_lengths(counts: dict[int, int], longest: int = LONGEST) -> dict[int, int]:
    """Optimal code length of each symbol under a limit, by package-merge; more than 2**longest symbols raise the limit to what they need."""
    leaves = sorted((n, s) for s, n in counts.items())
    if len(leaves) == 1:
        return {leaves[0][1]: 1}
    longest = max(longest, (len(leaves) - 1).bit_length())  # room for every symbol
    weight = np.array([n for n, _ in leaves], np.float64)
    lengths = np.zeros(len(leaves), np.int64)
    # levels[k]: merged order of leaves (index >= 0) and packages (-1) from the deepest level on
    levels, packages = [], np.zeros(0)
    for _ in range(longest):
        both = np.concatenate([weight, packages])
        order = np.argsort(both, kind="stable")
        levels.append(order)
        merged = both[order]
        half = len(merged) // 2
        packages = merged[: 2 * half : 2] + merged[1 : 2 * half : 2]
    take = 2 * len(leaves) - 2
    for order in reversed(levels):
        chosen = order[:take]
        own = chosen[chosen < len(leaves)]
        lengths[own] += 1
        take = 2 * (len(chosen) - len(own))
    return {s: int(n) for (_, s), n in zip(leaves, lengths, strict=True)}


class Book:
    """Canonical codes: by length, then symbol; of up to 32 bits each."""

    def __init__(self, lengths: dict[int, int]):
        order = sorted(lengths.items(), key=lambda x: (x[1], x[0]))
        size, self.longest = max(lengths, default=-1) + 1, max(lengths.values(), default=1)
        self.length, self.code = np.zeros(size, np.int64), np.zeros(size, np.uint64)
        self.table_symbol, self.table_length = np.zeros(1 << self.longest, np.int32), np.ones(1 << self.longest, np.int64)
        code = last = 0
        for symbol, n in order:
            code <<= n - last
            last = n
            self.length[symbol], self.code[symbol] = n, code
            at = code << (self.longest - n)
            self.table_symbol[at : at + (1 << (self.longest - n))], self.table_length[at : at + (1 << (self.longest - n))] = symbol, n
            code += 1

    def pack(self, ids: np.ndarray) -> tuple[bytes, np.ndarray]:
        """The codes end to end, and the bit offset of every STEP-th id."""
        n = self.length[ids]
        end = np.cumsum(n)
        start = end - n
        words = np.zeros((int(end[-1]) >> 5) + 2 if len(ids) else 0, np.uint64)
        # each code touches at most two 32-bit words: its bits within the pair of words, high first
        pair = self.code[ids] << (64 - (start & 31) - n).astype(np.uint64)
        at = start >> 5
        for which, what in ((at, pair >> np.uint64(32)), (at + 1, pair & np.uint64(0xFFFFFFFF))):
            # positions ascend and no bit is set twice, so sums are unions
            first = np.flatnonzero(np.diff(which, prepend=-1))
            if len(first):
                words[which[first]] += np.add.reduceat(what, first)
        return words.astype(">u4").tobytes(), start[::STEP]

    def unpack(self, payload: bytes, checkpoints: np.ndarray, total: int) -> np.ndarray:
        words = np.frombuffer(payload + bytes(8), ">u4").astype(np.uint64)
        at = checkpoints.astype(np.int64)
        out = np.zeros((len(at), STEP), np.int32)
        shift, mask = 64 - self.longest, np.uint64((1 << self.longest) - 1)
        for k in range(STEP):
            if k and k == total - STEP * (len(at) - 1):  # the last lane is shorter
                at = at[:-1]
            word = at >> 5
            look = ((words[word] << np.uint64(32) | words[word + 1]) >> (shift - (at & 31)).astype(np.uint64)) & mask
            out[: len(at), k] = self.table_symbol[look]
            at = at + self.table_length[look]
        return out.ravel()[:total]


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Tallies of a partition as one (id, n) table."""
    counts = np.zeros(0, np.int64)
    for b in batches:
        for raw in b.column(0).to_pylist():
            more = np.frombuffer(raw, np.int64)
            counts = np.concatenate([counts, np.zeros(max(0, len(more) - len(counts)), np.int64)])
            counts[: len(more)] += more
    used = np.flatnonzero(counts)
    yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(counts[used])], names=["id", "n"])


def _blocks(book: Book, kind: str, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted documents of one range -> blocks. A document may be longer than a block is meant to be; it's never split."""
    from pyspark import TaskContext

    part, before = TaskContext.get().partitionId(), 0
    held: list[tuple] = []
    size = 0

    def flush() -> pa.RecordBatch:
        nonlocal before, held, size
        payload, marks = book.pack(np.concatenate([x[1] for x in held]))
        row = [[part], [before], [[x[0] for x in held]], [[len(x[1]) for x in held]], [payload], [marks]]
        before, held, size = before + size, [], 0
        return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(row, (pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary(), pa.list_(pa.int64())), strict=True)], names=["part", "first", "doc_id", "sizes", "payload", "checkpoints"])

    for b in batches:
        for doc, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            held.append((doc, np.frombuffer(raw, kind).astype(np.int32)))
            size += len(held[-1][1])
            if size >= BLOCK_IDS:
                yield flush()
    if held:
        yield flush()


def write(coded: DataFrame, path: str, kind: str) -> None:
    """Write what `encode` packed as `kind` as sorted blocks under path/blocks and the code book under path/book.

    The input should be a stored table: its tallies are read first, then its ids for the ranges and the blocks.
    """
    spark = coded.sparkSession
    counts = coded.where("tally is not null").select("tally").mapInArrow(_summed, "id int, n long").groupBy("id").agg(F.sum("n").alias("n"))
    lengths = code_lengths({r["id"]: r["n"] for r in counts.collect()})  # as many rows as the vocabulary at most
    spark.createDataFrame(sorted(lengths.items()), "symbol int, length int").coalesce(1).write.parquet(f"{path}/book")
    book, order = Book(lengths), F.col("doc_id").asc_nulls_first()
    dealt = coded.where("tally is null").select("doc_id", "ids").repartitionByRange(order).sortWithinPartitions(order, F.octet_length("ids"), "ids")
    blocks = dealt.mapInArrow(lambda batches: _blocks(book, kind, batches), "part int, first long, doc_id array<long>, sizes array<long>, payload binary, checkpoints array<long>")
    blocks.write.parquet(f"{path}/blocks")


def read(spark: SparkSession, path: str, packed: bool = False) -> DataFrame:
    """(doc_id, start, ids) of every document from the files; start counts the ids of all documents before it.

    ids is an array, or with `packed` the bytes of little-endian unsigned 32-bit integers.
    """
    book = Book({r["symbol"]: r["length"] for r in spark.read.parquet(f"{path}/book").collect()})
    blocks = spark.read.parquet(f"{path}/blocks")
    totals = blocks.groupBy("part").agg(F.sum(F.aggregate("sizes", F.lit(0).cast("long"), lambda a, x: a + x)).alias("n")).orderBy("part").collect()
    base, before = {}, 0
    for r in totals:  # one row for each range
        base[r["part"]], before = before, before + r["n"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k, (part, first, payload) in enumerate(zip(*(b[c].to_pylist() for c in ("part", "first", "payload")), strict=True)):
                sizes, marks = (b[c][k].values.to_numpy() for c in ("sizes", "checkpoints"))
                upto = np.concatenate([[0], np.cumsum(sizes)])
                ids = book.unpack(payload, marks, int(upto[-1]))
                start = base[part] + first + upto[:-1]
                # offsets are 32-bit numbers, so very many ids go out in several batches
                step = 1 << 28
                cut = [0, *np.flatnonzero(np.diff(upto // step)).tolist(), len(sizes)]
                for s, e in zip(cut, cut[1:], strict=False):
                    if e > s:
                        yield pa.RecordBatch.from_arrays([b["doc_id"][k].values.slice(s, e - s), pa.array(start[s:e]), _packed(ids[upto[s] : upto[e]], upto[s : e + 1] - upto[s], packed)], names=["doc_id", "start", "ids"])

    return blocks.mapInArrow(run, "doc_id long, start long, ids " + ("binary" if packed else "array<int>"))


def _packed(ids: np.ndarray, upto: np.ndarray, packed: bool) -> pa.Array:
    if packed:
        return pa.BinaryArray.from_buffers(pa.binary(), len(upto) - 1, [None, pa.py_buffer((4 * upto).astype(np.int32)), pa.py_buffer(ids.astype("<u4"))])
    return pa.ListArray.from_arrays(pa.array(upto.astype(np.int32)), pa.array(ids))


def round_trip(docs: DataFrame, tokenizer: str, end: int, packed: bool = False) -> DataFrame:
    """Write the documents' ids to files in the shared folder and read them back: (doc_id, start, ids)."""
    spark = docs.sparkSession
    at = f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex}"
    kind = width(tokenizer)
    encode(docs, tokenizer, end, kind).write.option("compression", "zstd").parquet(f"{at}/ids")
    write(spark.read.schema(PACKED).parquet(f"{at}/ids"), f"{at}/out", kind)
    return read(spark, f"{at}/out", packed)


def checksums(read_back: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and the crc32 of packed ids, which are little-endian unsigned 32-bit integers."""
    n = (F.octet_length("ids") / 4).cast("long")
    return read_back.select("doc_id", "start", n.alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))
