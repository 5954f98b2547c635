"""Repair of the turn structure of conversations, at the least cost.

Rows are sorted by conversation and turn over ranges, which may part a long conversation
anywhere, even between equal rows, so one that holds a third of all rows takes as many tasks as any
other third. Within a task conversations are bucketed by length and solved together, time-major:
for each turn one vectorised step updates the costs that every conversation has from each of four
states to its end (nothing yet, after a system turn, after a user's, after an assistant's).
The costs are stored backward and edits are traced forward, again one turn of all
conversations at a time. Of the cheapest edits those whose initials come first in ASCII are
taken: Delete, Insert, Keep, Rerole.

A conversation that a range or PIECE rows cut goes on in pieces: rows said before in another
piece are found by their digests; each piece gives the cheapest costs from every state
before it to every state after it; these are composed, one number set a piece; each piece is
traced for all four states before it, and then for the one that is reached. Only digests, costs
and states of pieces meet, never their rows.

Defined results: null role and text are one space. Rows are taken by turn (null first), equal
turns by role and then by the SHA-256 of the text; rows equal in all of these are repetitions.
A null conv_id is one conversation. Conversations without rows (all `gone`) have zeros, an
empty audit and no messages. Texts of any length are taken whole; an empty table gives an empty
result; further columns are ignored. `solve` writes its tables and runs jobs when it is called.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import arrow_text
from .shared import stored

#: Rows of a piece, bytes of a piece, and the most rows that are solved at once.
PIECE, PIECE_BYTES = 1024, 4 << 20
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
START, SYSTEM, USER, ASSISTANT = range(4)
_FAR = 1 << 40
_ROLES = ("user", "assistant")
#: The state after an inserted or reroled turn, and after a kept turn of initial s, u, a or another.
_MADE = np.array([USER, USER, ASSISTANT, USER])
_KEPT = np.array([[SYSTEM, USER, -1, -1], [-1, USER, -1, -1], [-1, -1, ASSISTANT, -1], [-1, USER, -1, -1]])
#: What is still to be paid after the last row, from each state: an assistant's answer, or a turn of each.
_END = np.array([0, 2 * INSERT, INSERT, 0])
_STATS = ("blank", "duplicate", "truncated", "illegal")


@dataclass
class Turns:
    """Rows of conversations (or pieces) end to end; `first` has the n+1 bounds."""

    turn: pa.Array
    role: pa.Array
    text: pa.Array
    first: np.ndarray
    initial: np.ndarray
    blank: np.ndarray
    again: np.ndarray
    cut: np.ndarray

    @property
    def owner(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def turns(turn: pa.Array, role: pa.Array, text: pa.Array, first: np.ndarray, again: np.ndarray | None = None) -> Turns:
    """Rows with their initials and faults; `again` marks rows said before outside of what is given."""
    body, offsets = arrow_text.raw(text)
    words = arrow_text.split(body, offsets)
    blank = words.counts == 0
    cut = np.zeros(len(blank), bool)
    cut[~blank] = ~np.isin(body[words.end[words.first[1:][~blank] - 1] - 1], list(b".!?"))
    names, at = arrow_text.raw(role)
    initial = np.full(len(blank), 3)
    some = np.diff(at) > 0
    for k, letter in enumerate(b"sua"):
        initial[np.flatnonzero(some)[names[at[:-1][some]] == letter]] = k
    owner = np.repeat(np.arange(len(first) - 1), np.diff(first))
    codes = [x.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64) for x in (role, text)]
    said = np.unique(np.stack([owner, *codes], axis=1), axis=0, return_index=True)[1] if len(owner) else np.zeros(0, np.int64)
    repeated = np.ones(len(blank), bool)
    repeated[said] = False
    return Turns(turn, role, text, first, initial, blank, repeated if again is None else repeated | again, cut)


def statistics(t: Turns) -> dict[str, np.ndarray]:
    """Counts of faults and illegal neighbours, and what gaps are counted from, of each conversation."""
    n, owner = len(t.first) - 1, t.owner
    per = lambda mask: np.bincount(owner[mask], minlength=n)
    said = t.again & ~t.blank
    same = np.append(owner[1:] == owner[:-1], False) if len(owner) else np.zeros(0, bool)
    pair = np.append(t.initial[1:], 3) if len(owner) else t.initial
    legal = (t.initial == 0) & (pair == 1) | (t.initial == 1) & (pair == 2) | (t.initial == 2) & (pair == 1)
    turn, known = pc.fill_null(t.turn, 0).to_numpy(zero_copy_only=False), ~pc.is_null(t.turn).to_numpy(zero_copy_only=False)
    some = np.flatnonzero(known)
    new = np.ones(len(some), bool)
    new[1:] = (owner[some][1:] != owner[some][:-1]) | (turn[some][1:] != turn[some][:-1])
    low, high = np.zeros(n, np.int64), np.zeros(n, np.int64)
    high[owner[some]] = turn[some]
    low[owner[some[::-1]]] = turn[some[::-1]]
    return {"blank": per(t.blank), "duplicate": per(said), "truncated": per(t.cut & ~said & ~t.blank), "illegal": per(same & ~legal), "low": low, "high": high, "known": per(known), "distinct": np.bincount(owner[some[new]], minlength=n)}


def buckets(first: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Conversations of about one length (up to the next power of two) together: their numbers, and the row of each turn (time-major, -1 past the end)."""
    length = np.diff(first)
    size = np.where(length > 0, 1 << np.ceil(np.log2(np.maximum(length, 1))).astype(int), 0)
    for most in np.unique(size):
        which = np.flatnonzero(size == most)
        at = np.arange(most)[:, None]
        yield which, np.where(at < length[which], first[which] + at, -1)


def backward(t: Turns, rows: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Costs (turn, conversation, state) from before each turn to the end, where `end` (conversation, state) is still to pay."""
    cost = np.empty((len(rows) + 1, rows.shape[1], 4), np.int64)
    cost[-1] = end
    for k in range(len(rows) - 1, -1, -1):
        row, after = rows[k], cost[k + 1]
        must = (t.blank | t.again)[row]
        stay = np.where(t.cut[row], TRUNCATED, 0) + np.where(must, _FAR, 0)
        best = np.minimum(DELETE + after, (stay + REROLE)[:, None] + after[:, _MADE])
        for state in range(4):
            to = _KEPT[state][t.initial[row]]
            best[:, state] = np.minimum(best[:, state], np.where(to >= 0, stay + np.take_along_axis(after, np.maximum(to, 0)[:, None], 1)[:, 0], _FAR))
        plain = best.copy()
        best[:, USER] = np.minimum(plain[:, USER], INSERT + plain[:, ASSISTANT])
        best[:, ASSISTANT] = np.minimum(plain[:, ASSISTANT], INSERT + plain[:, USER])
        best[:, START] = np.minimum(plain[:, START], INSERT + best[:, USER])
        best[:, SYSTEM] = np.minimum(plain[:, SYSTEM], INSERT + best[:, USER])
        cost[k] = np.where((row < 0)[:, None], after, best)
    return cost


@dataclass
class Edits:
    """Edits of all conversations in order: owner, initial, row (-1 if inserted), and made role (-1 if kept), with the state at each end."""

    owner: np.ndarray
    letter: np.ndarray
    row: np.ndarray
    made: np.ndarray
    state: np.ndarray


def trace(t: Turns, which: np.ndarray, rows: np.ndarray, cost: np.ndarray, state: np.ndarray, close: np.ndarray) -> Edits:
    """The edits of least initials at the costs found; where `close`, the turns that are missing at the end are inserted too."""
    each, found, state = np.arange(len(which)), [], state.copy()

    def edit(mask, letter, row=None, to=None):
        if mask.any():
            made = np.full(mask.sum(), -1) if to is None else to[mask] - USER
            found.append((which[mask], np.full(mask.sum(), ord(letter)), np.full(mask.sum(), -1) if row is None else row[mask], made))

    for k in range(len(rows)):
        row, open_ = rows[k], rows[k] >= 0
        must, cut = (t.blank | t.again)[row], t.cut[row]
        stay = np.where(cut, TRUNCATED, 0) + np.where(must, _FAR, 0)
        while open_.any():
            now, to = cost[k][each, state], _MADE[state]
            kept = _KEPT[state, t.initial[row]]
            drop = open_ & (DELETE + cost[k + 1][each, state] == now)
            more = open_ & ~drop & (INSERT + cost[k][each, to] == now)
            keep = open_ & ~drop & ~more & (kept >= 0) & (stay + cost[k + 1][each, np.maximum(kept, 0)] == now)
            other = open_ & ~drop & ~more & ~keep
            edit(drop, "D", row)
            edit(more, "I", None, to)
            edit(keep, "K", row)
            edit(other, "R", row, to)
            state = np.where(more | other, to, np.where(keep, kept, state))
            open_ = more
    for _ in range(2):
        more = close & ((state == SYSTEM) | (state == USER))
        edit(more, "I", None, _MADE[state])
        state = np.where(more, _MADE[state], state)
    if not found:
        return Edits(*[np.zeros(0, np.int64)] * 4, state)
    owner, letter, row, made = (np.concatenate([f[k] for f in found]) for k in range(4))
    order = np.argsort(owner, kind="stable")
    return Edits(owner[order], letter[order], row[order], made[order], state)


def edited(t: Turns, state: np.ndarray | None = None, end: np.ndarray | None = None, close: np.ndarray | None = None) -> tuple[np.ndarray, Edits]:
    """Least costs and edits of whole conversations, or of pieces from given states to given costs; edits sorted by conversation."""
    n = len(t.first) - 1
    state = np.zeros(n, np.int64) if state is None else state
    end = np.tile(_END, (n, 1)) if end is None else end
    close = np.ones(n, bool) if close is None else close
    least, after, parts = np.zeros(n, np.int64), state.copy(), []
    for which, rows in buckets(t.first):
        cost = backward(t, rows, end[which])
        least[which] = cost[0][np.arange(len(which)), state[which]]
        e = trace(t, which, rows, cost, state[which], close[which])
        after[which] = e.state
        parts.append(e)
    cat = lambda k: np.concatenate([getattr(e, k) for e in parts]) if parts else np.zeros(0, np.int64)
    owner = cat("owner")
    order = np.argsort(owner, kind="stable")
    return least, Edits(owner[order], cat("letter")[order], cat("row")[order], cat("made")[order], after)


def written(t: Turns, e: Edits) -> tuple[pa.Array, pa.Array]:
    """The initials of the edits, and the repaired messages, of each conversation."""
    n = len(t.first) - 1
    bounds = np.searchsorted(e.owner, np.arange(n + 1)).astype(np.int32)
    audit = pa.Array.from_buffers(pa.string(), n, [None, pa.py_buffer(bounds), pa.py_buffer(e.letter.astype(np.uint8))])
    keep = e.letter != ord("D")
    roles = pa.concat_arrays([t.role.cast(pa.large_string()), pa.array(_ROLES, pa.large_string())])
    texts = pa.concat_arrays([t.text.cast(pa.large_string()), pa.array([""], pa.large_string())])
    role = roles.take(pa.array(np.where(e.made >= 0, len(t.role) + e.made, e.row)[keep]))
    text = texts.take(pa.array(np.where(e.row >= 0, e.row, len(t.text))[keep]))
    at = pa.array(np.searchsorted(e.owner[keep], np.arange(n + 1)).astype(np.int32))
    return audit, pa.ListArray.from_arrays(at, pa.StructArray.from_arrays([role.cast(pa.string()), text.cast(pa.string())], ["role", "text"]))


def _listed(column: pa.Array) -> tuple[list[pa.Array], np.ndarray]:
    """Fields of a list of structs end to end, and the bounds of the lists."""
    flat = column.flatten()
    first = np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False))]).astype(np.int64)
    return [pc.struct_field(flat, k) for k in range(flat.type.num_fields)], first


def _cut(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """Whole conversations solved; the first and last of a task, and those of many rows, as pieces with their rows."""
    number, held, joined = TaskContext.get().partitionId() << 33, None, True

    def piece(rows: pa.RecordBatch) -> pa.RecordBatch:
        nonlocal number
        number += 1
        here = rows.filter(pc.invert(rows.column("gone")))
        body = pa.StructArray.from_arrays([here.column(c) for c in ("turn", "role", "text")], ["turn", "role", "text"])
        one = pa.ListArray.from_arrays(pa.array([0, len(body)], pa.int32()), body)
        return _answer(rows.column("conv_id").slice(0, 1), {"piece": pa.array([number], pa.int64()), "rows": one})

    for part in arrow_text.slices(batches, limit=PIECE_BYTES):
        rows = part if held is None else pa.Table.from_batches([held, part]).combine_chunks().to_batches()[0]
        conv = rows.column("conv_id").dictionary_encode("encode").indices.to_numpy(zero_copy_only=False)
        starts = np.flatnonzero(np.diff(conv, prepend=-1))
        if joined and len(starts) > 1:  # the task's first conversation, or one that has pieces already
            yield piece(rows.slice(0, starts[1]))
            rows, starts, joined = rows.slice(starts[1]), starts[1:] - starts[1], False
        if len(starts) > 1:
            whole = rows.slice(0, starts[-1])
            here = ~whole.column("gone").to_numpy(zero_copy_only=False)
            first = np.concatenate([[0], np.cumsum(here)])[starts]
            some = whole.filter(pa.array(here))
            t = turns(*[some.column(c) for c in ("turn", "role", "text")], first)
            cost, e = edited(t)
            audit, messages = written(t, e)
            s = statistics(t)
            gaps = np.where(s["known"] > 0, s["high"] - s["low"] + 1 - s["distinct"], 0)
            yield _answer(whole.column("conv_id").take(pa.array(starts[:-1])), {"gaps": gaps, **{k: s[k] for k in _STATS}, "cost": cost, "audit": audit, "messages": messages})
            rows = rows.slice(starts[-1])
        while rows.num_rows > most:
            yield piece(rows.slice(0, most))
            rows, joined = rows.slice(most), True
        *full, rows = arrow_text.slices(iter([rows]), limit=PIECE_BYTES)
        for f in full:
            yield piece(f)
            joined = True
        held = rows
    if held is not None:
        yield piece(held)


_MESSAGES = pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))
_ROWS = pa.list_(pa.struct([("turn", pa.int64()), ("role", pa.string()), ("text", pa.string())]))
_FIELDS = {"piece": pa.int64(), "gaps": pa.int64(), **{k: pa.int64() for k in _STATS}, "cost": pa.int64(), "audit": pa.string(), "messages": _MESSAGES, "rows": _ROWS}
_SCHEMA = "piece long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, messages array<struct<role:string,text:string>>, rows array<struct<turn:long,role:string,text:string>>"


def _answer(conv: pa.Array, some: dict) -> pa.RecordBatch:
    cols = [pa.array(some[k], t) if isinstance(some.get(k), np.ndarray) else some[k].cast(t) if k in some else pa.nulls(len(conv), t) for k, t in _FIELDS.items()]
    return pa.RecordBatch.from_arrays([conv, *cols], names=["conv_id", *_FIELDS])


# pieces of a conversation


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(conv_id, piece, at, digest) of the rows of a piece that the piece itself hasn't said before."""
    for b in batches:
        (_, role, text), first = _listed(b.column(2))
        t = turns(pa.nulls(len(role), pa.int64()), role, text, first)
        new = np.flatnonzero(~t.again)
        said = [hashlib.sha256(f"{len(r)}:{r}{x}".encode()).digest() for r, x in zip(role.take(pa.array(new)).to_pylist(), text.take(pa.array(new)).to_pylist(), strict=True)]
        own = pa.array(t.owner[new])
        yield pa.RecordBatch.from_arrays([b.column(0).take(own), b.column(1).take(own), pa.array(new - first[t.owner[new]]), pa.array(said, pa.binary())], names=["conv_id", "piece", "at", "digest"])


def _of(b: pa.RecordBatch) -> Turns:
    """The rows of a batch of pieces, with those that earlier pieces have said."""
    fields, first = _listed(b.column("rows"))
    said = b.column("said")
    marked = np.zeros(len(fields[0]), bool)
    lists = np.repeat(first[:-1], pc.fill_null(pc.list_value_length(said), 0).to_numpy(zero_copy_only=False))
    marked[(lists + said.flatten().to_numpy(zero_copy_only=False)).astype(np.int64)] = True
    return turns(*fields, first, marked)


def _transfer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What a piece adds to its conversation: counts, and the least cost from each state before it to each one after it."""
    for b in batches:
        t = _of(b)
        n = len(t.first) - 1
        costs = np.zeros((n, 4, 4), np.int64)
        for which, rows in buckets(t.first):
            for after in range(4):
                end = np.full((len(which), 4), _FAR)
                end[:, after] = 0
                costs[which, :, after] = backward(t, rows, end)[0]
        s = statistics(t)
        size = np.diff(t.first)
        edge = [np.full(n, -1), np.full(n, -1)]
        edge[0][size > 0], edge[1][size > 0] = t.initial[t.first[:-1][size > 0]], t.initial[t.first[1:][size > 0] - 1]
        cols = [*(s[k] for k in (*_STATS, "low", "high", "known", "distinct")), *edge]
        lists = pa.FixedSizeListArray.from_arrays(pa.array(costs.ravel()), 16).cast(pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays([b.column("conv_id"), b.column("piece"), *(pa.array(c, pa.int64()) for c in cols), lists], names=["conv_id", "piece", *_STATS, "low", "high", "known", "distinct", "head", "tail", "costs"])


_PARTS = ", ".join(f"{c} long" for c in (*_STATS, "low", "high", "known", "distinct", "head", "tail")) + ", costs array<long>"


def _composed(table: pa.Table) -> pa.Table:
    """Of the pieces of one conversation, in order: its counts and cost, and what is still to pay after each piece."""
    table = table.sort_by("piece")
    got = {c: table.column(c).to_numpy() for c in (*_STATS, "low", "high", "known", "distinct", "head", "tail")}
    costs = np.array(table.column("costs").to_pylist(), np.int64).reshape(-1, 4, 4)
    end, still = np.empty((len(costs), 4), np.int64), _END
    for k in range(len(costs) - 1, -1, -1):
        end[k] = still
        still = np.minimum((costs[k] + still).min(axis=1), _FAR)
    some, rows = np.flatnonzero(got["known"] > 0), np.flatnonzero(got["head"] >= 0)
    twice = (got["low"][some[1:]] == got["high"][some[:-1]]).sum()
    gaps = got["high"][some[-1]] - got["low"][some[0]] + 1 - (got["distinct"].sum() - twice) if len(some) else 0
    joints = list(zip(got["tail"][rows[:-1]], got["head"][rows[1:]], strict=True))
    illegal = got["illegal"].sum() + sum(j not in ((0, 1), (1, 2), (2, 1)) for j in joints)
    sums = {"gaps": gaps, **{k: got[k].sum() for k in _STATS}, "illegal": illegal, "cost": still[START]}
    n = len(costs)
    return pa.table({"conv_id": table.column("conv_id"), "piece": table.column("piece"), "last": pa.array(np.arange(n) == n - 1), "still": pa.array(list(end), pa.list_(pa.int64())), **{k: pa.array([v] * n, pa.int64()) for k, v in sums.items()}})


def _ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The state after each piece for every state before it."""
    for b in batches:
        t, still = _of(b), np.array(b.column("still").to_pylist(), np.int64).reshape(-1, 4)
        no = np.zeros(len(still), bool)
        ends = np.stack([edited(t, np.full(len(still), s), still, no)[1].state for s in range(4)], axis=1)
        yield pa.RecordBatch.from_arrays([b.column("conv_id"), b.column("piece"), pa.array(list(ends), pa.list_(pa.int64()))], names=["conv_id", "piece", "ends"])


def _reached(table: pa.Table) -> pa.Table:
    """The state before each piece of one conversation."""
    table, state, before = table.sort_by("piece"), START, []
    for ends in table.column("ends").to_pylist():
        before.append(state)
        state = ends[state]
    return pa.table({"piece": table.column("piece"), "state": pa.array(before, pa.int64())})


def _mended(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Initials of the edits and repaired messages of each piece."""
    for b in batches:
        t, still = _of(b), np.array(b.column("still").to_pylist(), np.int64).reshape(-1, 4)
        _, e = edited(t, b.column("state").to_numpy(), still, b.column("last").to_numpy(zero_copy_only=False))
        audit, messages = written(t, e)
        yield pa.RecordBatch.from_arrays([b.column("conv_id"), b.column("piece"), audit, messages], names=["conv_id", "piece", "audit", "messages"])


def _pieces(found: DataFrame, kind: str) -> tuple[DataFrame, DataFrame]:
    """(conv_id, counts, cost, audit) and (conv_id, piece, messages) of the conversations in pieces."""
    parts = found.where("piece is not null").select("conv_id", "piece", "rows")
    new = parts.mapInArrow(_digests, f"conv_id {kind}, piece long, at long, digest binary")
    earlier = F.min("piece").over(Window.partitionBy("conv_id", "digest"))
    said = new.withColumn("earlier", earlier).where("piece > earlier").groupBy("piece").agg(F.collect_list("at").alias("said"))
    parts = stored(parts.join(said, "piece", "left").select("conv_id", "piece", "rows", F.coalesce("said", F.array().cast("array<long>")).alias("said")), "pieces")
    moved = parts.mapInArrow(_transfer, f"conv_id {kind}, piece long, {_PARTS}")
    counts = ", ".join(f"{c} long" for c in ("gaps", *_STATS, "cost"))
    composed = stored(moved.groupBy("conv_id").applyInArrow(_composed, f"conv_id {kind}, piece long, last boolean, still array<long>, {counts}"), "composed")
    ready = parts.join(composed.select("piece", "last", "still"), "piece")
    ends = ready.mapInArrow(_ends, f"conv_id {kind}, piece long, ends array<long>")
    reached = ends.groupBy("conv_id").applyInArrow(_reached, "piece long, state long")
    mended = stored(ready.join(reached, "piece").mapInArrow(_mended, f"conv_id {kind}, piece long, audit string, messages array<struct<role:string,text:string>>"), "mended")
    audit = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("piece", "audit"))), lambda x: x.audit), "").alias("audit")
    audits = mended.groupBy(F.col("conv_id").alias("id")).agg(F.max("piece").alias("piece"), audit)
    summary = composed.where("last").drop("last", "still").join(audits, "piece").select("conv_id", "gaps", *_STATS, "cost", "audit")
    return summary, mended.select("conv_id", "piece", "messages")


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each conversation whose pieces come one after the other."""
    at, running, empty, out = None, None, True, []
    for b in batches:
        for conv, messages in zip(b.column(0).to_pylist(), b.column(1), strict=True):
            if running is None or conv != at:
                out += [] if running is None else [(at, running.hexdigest())]
                at, running, empty = conv, hashlib.sha256(), True
            for m in messages.as_py():
                running.update(("" if empty else "\n").encode() + f"{m['role']}:{m['text']}".encode())
                empty = False
    out += [] if running is None else [(at, running.hexdigest())]
    yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], b.schema.field(0).type if out else pa.null()), pa.array([x[1] for x in out], pa.string())], names=["conv_id", "repaired_sha256"])


@dataclass
class Repaired:
    """`summary` has a row for each conversation; `messages` the repaired role and text of each, in pieces where it is long."""

    summary: DataFrame
    messages: DataFrame


def solve(rows: DataFrame, piece: int = PIECE) -> Repaired:
    """Repair conversations of (conv_id, turn, role, text) rows; rows marked by an optional boolean `gone` only tell that their conversation exists."""
    kind = rows.schema["conv_id"].dataType.simpleString()
    gone = F.coalesce("gone", F.lit(False)) if "gone" in rows.columns else F.lit(False)
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c)
    keys = ["conv_id", "turn", "role", "tie", "uid"]
    plain = rows.select("conv_id", F.col("turn").cast("long").alias("turn"), space("role"), space("text"), gone.alias("gone"))
    plain = plain.withColumn("tie", F.unhex(F.sha2("text", 256))).withColumn("uid", F.monotonically_increasing_id())
    dealt = plain.repartitionByRange(*keys).sortWithinPartitions(*keys).select("conv_id", "turn", "role", "text", "gone")
    found = stored(dealt.mapInArrow(lambda batches: _cut(batches, piece), f"conv_id {kind}, {_SCHEMA}"), "conversations")
    summary, messages = _pieces(found, kind)
    whole = found.where("piece is null")
    return Repaired(whole.select(*summary.columns).unionByName(summary), whole.select("conv_id", "piece", "messages").unionByName(messages))


def digests(messages: DataFrame) -> DataFrame:
    """(conv_id, repaired_sha256) of `role:text` lines; a conversation in pieces is read piece by piece."""
    lines = F.array_join(F.transform("messages", lambda m: F.concat(m.role, F.lit(":"), m.text)), "\n")
    whole = messages.where("piece is null").select("conv_id", F.sha2(lines, 256).alias("repaired_sha256"))
    kind = messages.schema["conv_id"].dataType.simpleString()
    parts = messages.where("piece is not null").repartition("conv_id").sortWithinPartitions("conv_id", "piece").select("conv_id", "messages")
    return whole.unionByName(parts.mapInArrow(_hashed, f"conv_id {kind}, repaired_sha256 string"))


def damaged(rows: DataFrame) -> DataFrame:
    """Conversations damaged by the checksum of `conv_id:turn`: rows gone, emptied, without sentence ends, repeated, or said by the user."""
    text, role = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("text", "role"))
    part = F.crc32(F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")])) % 20
    out = rows.select("conv_id", F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"), part.alias("part"))
    text = F.when(F.col("part").isin(0, 1), "").when(F.col("part") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    out = out.select("conv_id", "turn", F.when(F.col("part") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), (F.col("part") == 0).alias("gone"), F.when(F.col("part") == 3, 2).otherwise(1).alias("times"))
    return out.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("times")))).drop("times", "copy")
