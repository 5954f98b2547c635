"""SentencePiece encoding and decoding for merge-type (BPE) vocabularies.

Encoding keeps an agenda of adjacent symbol pairs, ordered by score and then by
position: the best pair that is a piece of the vocabulary is merged, its new
neighbours join the agenda, and pairs whose symbols have changed meanwhile are
passed over. Symbols that are no piece become byte pieces, or the unknown id.

No piece of such a vocabulary holds the space mark after another character, so
no merge crosses from a word to the next mark; this is verified on the pieces
when a model is loaded (else whole texts are one chunk). Each worker therefore
encodes every distinct chunk once and remembers it, in a table bounded by bytes.
In every Arrow batch the chunks that are new are checked against the
sentencepiece library; a difference stops the job. Where a model has a normaliser of
its own, the library normalises, and its ids of each whole text are compared.
Decoding is the library's.

Defined results: null and empty texts give the end id alone and decode to an
empty text; texts of any length are encoded whole; rows are independent, so ties,
repeated rows and null ids need no rule; an empty table gives an empty result.
Vocabularies with user-defined symbols are not supported by the agenda.
"""

from __future__ import annotations

from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import arrow_text

MARK, NEWLINE = "▁", "\n"
_MARK = MARK.encode()


class Encoder:
    """Ids of whole texts for one model file."""

    def __init__(self, path: str, end: bool = True):
        self.model = m = sentencepiece.SentencePieceProcessor(model_file=path)
        plain = [i for i in range(m.get_piece_size()) if not (m.is_control(i) or m.is_unknown(i) or m.is_byte(i))]
        pieces = [m.id_to_piece(i) for i in plain]
        order = {s: k for k, s in enumerate(sorted({m.get_score(i) for i in plain}, reverse=True))}
        self.rank = {p: order[m.get_score(i)] for p, i in zip(pieces, plain, strict=True) if len(p) > 1}
        self.ids = dict(zip(pieces, plain, strict=True))
        names = [m.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.bytes = names if all(m.is_byte(i) for i in names) else None
        self.unknown = m.unk_id()
        self.end = np.array([m.eos_id()], np.int32).tobytes() if end and m.eos_id() >= 0 else b""
        cuts = all(MARK not in p.lstrip(MARK) for p in pieces)
        self.lines = cuts and not any(NEWLINE in p for p in pieces)
        self.cuts = cuts
        probe = " a  bÉﬁ　\n c "
        # what the model's own normaliser does beyond marking spaces; a probe decides whether it has to be called
        self.plain = m.normalize(probe) == MARK + probe.replace(" ", MARK)
        self.memory = arrow_text.Memory()
        self.lead = self.merge(MARK) + self.merge(NEWLINE) if self.lines else b""

    def chunks(self, column: pa.Array) -> tuple[list[bytes], np.ndarray, np.ndarray]:
        """Distinct chunks, with spaces for marks, the number of each chunk of the texts, and the first chunk of each text (n+1)."""
        if not self.plain:
            column = pa.array([self.model.normalize(t or "").replace(MARK, " ") for t in column.to_pylist()], pa.large_string())
        body, offsets = arrow_text.raw(column)
        if self.plain:
            if _MARK in body.tobytes():  # a mark in a text is a space to the model
                body, offsets = arrow_text.raw(pa.array([(t or "").replace(MARK, " ") for t in column.to_pylist()], pa.large_string()))
            filled = np.diff(offsets) > 0  # a space leads each text
            body = np.insert(body, offsets[:-1][filled], 0x20)
            offsets = offsets + np.concatenate([[0], np.cumsum(filled)])
        begin = np.zeros(len(body) + 1, bool)
        begin[offsets[:-1]] = True
        if self.cuts:
            space = body == 0x20
            begin[1:-1] |= space[1:] & ~space[:-1]
        if self.lines:
            line = body == 0x0A
            begin[:-1] |= line
            begin[1:] |= line
        start = np.flatnonzero(begin[:-1])
        strings = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(np.append(start, len(body)).astype(np.int64)), pa.py_buffer(np.ascontiguousarray(body))])
        return *arrow_text.distinct(strings), np.searchsorted(start, offsets)

    def merge(self, chunk: str) -> bytes:
        """Ids of a chunk by the agenda, as little-endian 32-bit integers."""
        rank, n = self.rank, len(chunk)
        held: list = list(chunk)
        agenda = []
        for i in range(n - 1):
            pair = chunk[i : i + 2]
            if pair in rank:
                agenda.append((rank[pair], i, pair))
        heapify(agenda)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        while agenda:
            _, i, pair = heappop(agenda)
            j = after[i]
            if held[i] is None or j >= n or held[i] + held[j] != pair:
                continue
            held[i], held[j] = pair, None
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                wider = pair + held[k]
                if wider in rank:
                    heappush(agenda, (rank[wider], i, wider))
            h = before[i]
            if h >= 0:
                wider = held[h] + pair
                if wider in rank:
                    heappush(agenda, (rank[wider], h, wider))
        ids, out = self.ids, []
        for symbol in held:
            if symbol is None:
                continue
            one = ids.get(symbol)
            if one is not None:
                out.append(one)
            elif self.bytes:
                out.extend(self.bytes[b] for b in symbol.encode())
            elif not out or out[-1] != self.unknown:
                out.append(self.unknown)
        return np.array(out, np.int32).tobytes()

    def _check(self, chunks: list[str], mine: list[bytes]) -> None:
        """Compare chunks with the library; those that open with a mark are sent without it, as the library adds one."""
        sent = [c[1:].replace(MARK, " ") if c[0] == MARK else NEWLINE + c for c in chunks]
        for c, text, own, ids in zip(chunks, sent, mine, self.model.encode(sent, num_threads=1), strict=True):
            if text and (b"" if c[0] == MARK else self.lead) + own != np.array(ids, "<i4").tobytes():
                raise AssertionError(f"agenda and library differ on {c!r}")

    def _learn(self, chunks: list[bytes]) -> list[bytes]:
        out: list[bytes] = []
        for at in range(0, len(chunks), 4096):
            some = [c.decode().replace(" ", MARK) for c in chunks[at : at + 4096]]
            mine = [self.merge(c) for c in some]
            if self.plain:
                checked = [k for k, c in enumerate(some) if c[0] == MARK or self.lines]
                self._check([some[k] for k in checked], [mine[k] for k in checked])
            out += mine
        return out

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts end to end, each with the end id, and where each text begins (n+1)."""
        distinct, codes, first = self.chunks(column)
        parts = self.memory.values(distinct, self._learn)
        codes = np.insert(codes, first[1:], len(parts))
        ids, upto = arrow_text.gathered([*parts, self.end], codes)
        upto = upto[first + np.arange(len(first))]
        if not self.plain:
            for k, t in enumerate(column.to_pylist()):
                if self.model.encode(t or "") != ids[upto[k] : upto[k + 1] - len(self.end) // 4].tolist():
                    raise AssertionError(f"agenda and library differ on {t!r}")
        return ids, upto


_encoders: dict[tuple, Encoder] = {}


def encoder(path: str, end: bool = True) -> Encoder:
    if (path, end) not in _encoders:
        _encoders[path, end] = Encoder(path, end)
    return _encoders[path, end]


def encode(docs: DataFrame, path: str, end: bool = True, decode: bool = True) -> DataFrame:
    """doc_id, ids and, with `decode`, the text that the ids give again, of every row; `path` is known to every worker."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(path, end)
        for b in arrow_text.slices(batches):
            values, upto = e.encode(b.column(1))
            columns = [b.column(0), pa.ListArray.from_arrays(pa.array(upto.astype(np.int32)), pa.array(values))]
            if decode:
                columns.append(pa.array([e.model.decode(values[s:t].tolist()) for s, t in zip(upto, upto[1:], strict=False)], pa.string()))
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "ids", "decoded"][: len(columns)])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, ids array<int>" + ", decoded string" * decode)
