"""Vectorised word splitting over Arrow text columns, shared by the text operators.

Everything here works on one slice of a partition at a time; slices are cut by
bytes of text, so memory does not follow the number of rows in an Arrow batch.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: The characters that separate words: space and U+0009 to U+000D.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
SLICE_BYTES = 4 << 20

_ODD = np.uint64(0x9E3779B97F4A7C15)
_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_pow: dict[str, np.ndarray] = {}


def slices(batches: Iterator[pa.RecordBatch], text: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut record batches so that each piece holds about `limit` bytes of text (one row at least)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        column = batch.column(batch.schema.get_field_index(text))
        sizes = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
        upto, start = np.cumsum(sizes, dtype=np.int64), 0
        while start < len(sizes):
            base = upto[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(upto, base + limit, "right")))
            yield batch.slice(start, stop - start)
            start = stop


def raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all rows end to end, and the n+1 row offsets. Null counts as empty."""
    column = column.cast(pa.large_string()) if not pa.types.is_large_string(column.type) else column
    if column.null_count:
        column = column.fill_null("")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    body = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None and len(offsets) else np.zeros(0, np.uint8)
    return body, offsets - offsets[0]


@dataclass
class Words:
    """Words of a slice: byte starts and ends in `body`, and the first word of each row in `first` (n+1)."""

    body: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    @property
    def row(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.counts)


def split(body: np.ndarray, offsets: np.ndarray, space: np.ndarray = SPACE) -> Words:
    """Maximal runs of bytes that are not in `space`, never across rows."""
    word = np.zeros(len(body) + 1, bool)
    np.logical_not(space[body], out=word[:-1])
    begins, ends = word.copy(), word.copy()
    begins[1:] &= ~word[:-1]
    ends[:-1] &= ~word[1:]
    filled = offsets[:-1][np.diff(offsets) > 0]
    begins[filled] = word[filled]
    ends[filled[filled > 0] - 1] = word[filled[filled > 0] - 1]
    start, end = np.flatnonzero(begins[:-1]), np.flatnonzero(ends[:-1]) + 1
    return Words(body, start, end, np.searchsorted(start, offsets).astype(np.int64))


def joined(words: Words) -> Words:
    """The same words, each followed by exactly one space, in a new body."""
    length = words.end - words.start
    end = np.cumsum(length + 1) - 1
    keep = np.zeros(len(words.body) + 1, np.int8)
    keep[words.start] = 1
    keep[words.end] -= 1
    body = np.full(int(end[-1]) + 1 if len(end) else 0, 0x20, np.uint8)
    target = np.ones(len(body), bool)
    target[end] = False
    body[target] = words.body[np.cumsum(keep[:-1]).astype(bool)]
    return Words(body, end - length, end, words.first)


def _powers(kind: str, n: int) -> np.ndarray:
    have = _pow.get(kind)
    if have is None or len(have) < n:
        base = np.full(max(n, 1 << 16), _ODD if kind == "up" else _INV, np.uint64)
        base[0] = 1
        _pow[kind] = have = np.cumprod(base)
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x7FB5D329728EA185)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def span_hash(values: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit polynomial hash of values[start:end] for many spans at once, by prefix sums.

    For bucketing only: callers that need equality compare contents after it.
    """
    prefix = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(mix(values.astype(np.uint64) + np.uint64(1)) * _powers("up", len(values)), out=prefix[1:])
    return mix((prefix[end] - prefix[start]) * _powers("down", len(values) + 1)[start] + (end - start).astype(np.uint64))


def strings(words: Words) -> pa.Array:
    """The words as a pyarrow string array without copying the body; needs a body from joined()."""
    offsets = np.append(words.start, len(words.body)).astype(np.int64)
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(words.start), [None, pa.py_buffer(offsets), pa.py_buffer(words.body)])


class Memory:
    """What a worker has worked out for chunks of text. Bounded by bytes, whatever the chunks' lengths: of two generations the older goes when the younger is full."""

    def __init__(self, most: int = 96 << 20):
        self.most, self.size = most // 2, 0
        self.young: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}

    def values(self, keys: list[bytes], make: Callable[[list[bytes]], list[bytes]]) -> list[bytes]:
        """The value of each of the distinct keys; `make` gives those of new ones."""
        out = list(map(self.young.get, keys))
        if None not in out:
            return out
        missing = [i for i, v in enumerate(out) if v is None]
        for i in missing if self.old else ():
            out[i] = self.old.get(keys[i])
        new = [i for i in missing if out[i] is None]
        for i, v in zip(new, make([keys[i] for i in new]) if new else (), strict=True):
            out[i] = v
        for at in range(0, len(missing), 4096):
            more = {keys[i]: out[i] for i in missing[at : at + 4096]}
            self.young |= more
            self.size += sum(map(len, more)) + sum(map(len, more.values())) + 180 * len(more)  # with what the objects take themselves
            if self.size > self.most:
                self.old, self.young, self.size = self.young, {}, 0
        return out


def distinct(strings: pa.Array) -> tuple[list[bytes], np.ndarray]:
    """The distinct values of a large binary array without nulls, and the number of each row's value."""
    coded = strings.dictionary_encode()
    values = coded.dictionary
    body = (values.buffers()[2] or b"") and values.buffers()[2].to_pybytes()
    ends = np.frombuffer(values.buffers()[1], np.int64)[values.offset : values.offset + len(values) + 1].tolist() if len(values) else [0]
    return [body[a:b] for a, b in zip(ends, ends[1:], strict=False)], coded.indices.to_numpy()


def gathered(parts: list[bytes], codes: np.ndarray, kind: str = "<i4") -> tuple[np.ndarray, np.ndarray]:
    """The numbers of parts[codes] end to end, and how many there are up to each of them (n+1)."""
    flat = np.frombuffer(b"".join(parts), kind)
    size = np.array([len(p) for p in parts], np.int64) // np.dtype(kind).itemsize
    begin = np.cumsum(size) - size
    many = size[codes]
    upto = np.concatenate([[0], np.cumsum(many)])
    return flat[np.repeat(begin[codes] - upto[:-1], many) + np.arange(upto[-1])], upto
