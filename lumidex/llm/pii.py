"""Personal data: fixed base patterns, and further spans chosen by boosted trees among many candidates.

Base spans (e-mail, ip, card, phone) are found leftmost and non-overlapping per
kind and always stay. High-recall generators then propose overlapping spans of
the same kinds that the patterns miss:

    email  an `@` or a written `at`, and a domain with a dot or a written `dot`;
           a local part reaches back `REACH` characters at most
    ip     four numbers up to 255 with bracketed, spaced or written dots
    card   12 to 19 digits that pass the checksum, up to three separators between any two
    phone  9 to 15 digits in two to seven groups, up to three separators between them,
           or in one run, with 00 or no plus at all

These reaches and numbers of groups are what the generators propose at most; base spans know no such bounds.

A candidate that touches no base span gets features of its format and its context,
and gradient boosted trees give a calibrated probability.

The trees learn here, without labels from outside, on all documents.
Positive are their base spans, as they are and in every disguise of `disguises`, and in
documents of fewer than `FEW` examples spans of the same form with other digits or letters (`varied`).
Negative are numbers and words made from them that only look alike (`lookalikes`:
amounts, book and order numbers, versions, failing checksums, sentences with `at` and
`dot`), and real candidates whose format rules them out. Other real candidates are
neither, as nobody knows what they are. All examples count; equal ones are stored once, with
their number, and the trees grow from sums over them, which tasks add up, so the driver gets tables
of fixed size (and up to `LOCAL_ROWS` different examples as they are). One document in five calibrates the scores and sets the threshold of each kind: the
lowest at which `PRECISION` of the examples chosen there are positive; with fewer
than `FEWEST` of them the kind adds nothing. Of overlapping choices the likeliest
(in hundredths, then of the first kind as listed) stays.

Offsets are code points, ends exclusive. Defined results: null and empty texts
have no spans; texts of any length are searched whole, in time that follows their
length also for unbroken runs of digits or letters; rows are independent, so
repeated rows, ties and null ids need no rule; an empty table gives an empty
result. `redact` keeps all columns and changes texts with a span only.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_left
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import arrow_text
from .boosting import CODES, STEP, Trees
from .shared import stored

KINDS = ("email", "ip", "card", "phone")
FEW, VARIED, PRECISION, FEWEST, REACH = 60, 4, 0.98, 10, 120
#: Different examples that are added up on the driver at most, and that a task holds at once.
LOCAL_ROWS, COUNTERS = 200_000, 200_000

# base patterns; possessive repeats never go back, so each run of characters is read once
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
CHAIN = re.compile(r"[0-9]++(?:\.[0-9]++)*+")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
ANY = re.compile(r"[0-9@]")

# generators
DOT = r"(?:\.|\x20?[\[({<]\x20?(?:[Dd]ot|DOT|\.)\x20?[\])}>]\x20?|[\x20_-](?:[Dd]ot|DOT)[\x20_-])"
AT = re.compile(r"@|\x20?[\[({<]\x20?(?:[Aa]t|AT|@)\x20?[\])}>]\x20?|[\x20_-](?:[Aa]t|AT)[\x20_-]")
BEFORE = re.compile(rf"[A-Za-z0-9_%+-]+(?:{DOT}[A-Za-z0-9_%+-]+)*\Z")
AFTER = re.compile(rf"[A-Za-z0-9-]++(?:{DOT}[A-Za-z0-9-]++)++")
SPELLED = re.compile(r"[\[({<]\x20?(?:[Aa]t|AT|@)\x20?[\])}>]|[\x20_-](?:[Aa]t|AT)[\x20_-]")
WIDE = {
    "ip": re.compile(rf"(?<![0-9])[0-9]{{1,3}}(?:(?:{DOT}|\x20\.\x20|,)[0-9]{{1,3}}){{3}}(?![0-9])"),
    # from every group of digits on, so these overlap
    "card": re.compile(r"(?<![0-9A-Za-z])(?=([0-9](?:[\x20._/:,-]{0,3}[0-9]){11,18})(?![0-9A-Za-z]))"),
    "phone": re.compile(r"(?<![0-9A-Za-z+(])(?=(\+?\(?[0-9]{1,5}\)?(?:[\x20._/:-]{1,3}\(?[0-9]{2,5}\)?){1,6}|[0-9]{9,15})(?![0-9A-Za-z]))"),
}
CONTACT = re.compile(r"(?i)\b(?:mail|email|contact|write|call|phone|tel|mobile|fax|ip|host|server|address|card|visa|pay|account)\b")
WORD = re.compile(r"\w+")
MORE_BEFORE, MORE_AFTER = re.compile(r"[0-9][\x20._/:,-]{1,3}\Z"), re.compile(r"[\x20._/:,-]{1,3}[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        n = ord(d) - 48
        total += n if k % 2 == 0 else 2 * n - 9 * (n > 4)
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def _small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or 0) <= 255


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Matches of the e-mail pattern, from each @ to either side."""
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(text, at) if start < at else None
        if m:
            end = m.end()
            yield start, end
        # what stands left of the next @ isn't read again beyond this one, as no local part holds an @
        at = text.find("@", max(at + 1, end))
        end = max(end, 0)


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) by start, then kind as listed."""
    out = [(s, e, "email") for s, e in _emails(text)]
    for m in CHAIN.finditer(text):
        if m[0].count(".") >= 3:  # each four numbers of a chain are a match
            at, parts = m.start(), m[0].split(".")
            for k in range(0, len(parts) - 3, 4):
                size = sum(map(len, parts[k : k + 4])) + 3
                if all(map(_small, parts[k : k + 4])):
                    out.append((at, at + size, "ip"))
                at += size + 1
    for m in CARD.finditer(text):
        if 12 <= m.end() - m.start() <= 37 and 12 <= len(d := _digits(m[0])) <= 19 and luhn(d):
            out.append((m.start(), m.end(), "card"))
    if "+" in text:
        out += [(m.start(), m.end(), "phone") for m in PHONE.finditer(text) if 9 <= len(_digits(m[0])) <= 15]
    return sorted(out, key=lambda x: (x[0], KINDS.index(x[2])))


def candidates(text: str) -> list[tuple[int, int, str]]:
    """Proposed spans of every kind, overlapping ones too."""
    out = []
    if "@" in text or SPELLED.search(text):
        for m in AT.finditer(text):
            after = AFTER.match(text, m.end())
            if after and (before := BEFORE.search(text[max(0, m.start() - REACH) : m.start()])):
                out.append((m.start() - len(before[0]), after.end(), "email"))
    if ANY.search(text):
        out += [(*m.span(m.re.groups), k) for k in ("ip", "card", "phone") for m in WIDE[k].finditer(text) if _possible(m[m.re.groups], k)]
    return out


def _possible(s: str, kind: str) -> bool:
    """What no span of the kind can lack."""
    d = _digits(s)
    if kind == "ip":
        return all(map(_small, re.findall("[0-9]+", s)))
    return 12 <= len(d) <= 19 and luhn(d) if kind == "card" else 9 <= len(d) <= 15


def _ruled_out(s: str, kind: str) -> bool:
    """Whether the format alone tells that a candidate is nothing personal."""
    if kind == "email":
        last = re.split(DOT, s)[-1]
        return not last.isalpha() or not 2 <= len(last) <= 12
    if kind == "phone":
        groups = re.findall("[0-9]+", s)
        # amounts in groups of three, and dates
        return len(groups) > 2 and len(groups[0]) <= 3 and set(map(len, groups[1:])) == {3} and len(set(re.findall("[^0-9]", s))) == 1 or bool(re.search(r"(?:19|20)[0-9]{2}[-./][01]?[0-9][-./][0-3]?[0-9]", s))
    return kind == "card" and len(set(_digits(s))) < 3


def features(text: str, start: int, end: int, kind: str) -> list[float]:
    s = text[start:end]
    digits = _digits(s)
    parts = re.split(r"[^0-9A-Za-z]+", s.strip("()+"))
    groups = re.findall("[0-9]+", s)
    before, after = text[max(0, start - 40) : start], text[end : end + 40]
    last, following = WORD.findall(before)[-1:], WORD.findall(after)[:1]
    bucket = lambda w: float(zlib.crc32(w[0].lower().encode()) % 16) if w else -1.0
    tail = re.split(DOT, s)[-1]
    return [
        float(KINDS.index(kind)), len(s), len(digits), float(luhn(digits)), len(parts), max(map(len, parts), default=0), min(map(len, parts), default=0), len(groups), float(len(set(map(len, groups[1:]))) == 1 and len(groups) > 2),
        float(len(groups) == 4 and all(map(_small, groups))), float(s[0] == "+"), float(s[:2] == "00"), float("(" in s), float("@" in s), float("[" in s), s.count(" "), s.count("."), s.count("-"), s.count("/"),
        float(len(re.findall(r"(?i)[\[({<] ?(?:at|dot|@)|[ _-](?:at|dot)[ _-]", s))), float(tail.isalpha()), float(min(len(tail), 20)), float(s.lower().count(" at ")), float(digits[:3] in ("978", "979")), float(before[-1:].isalnum()), float(after[:1].isalnum()), float(before[-1:] in "$€£#"), float(bool(MORE_BEFORE.search(before))), float(bool(MORE_AFTER.match(after))), float(bool(CONTACT.search(before))), bucket([tail]), bucket(last), bucket(following),
    ]


def disguises(s: str, kind: str) -> list[str]:
    """Ways to write a base span that the base patterns miss, all of which the generators propose."""
    if kind == "email":
        user, domain = s.split("@", 1)
        # the address as it is, and a plainer one, so that addresses of one provider don't set the form
        plain = re.sub("[0-9]+", "", user).strip("._%+-") or "me", ".".join(re.sub("[0-9]+", "", domain).split(".")[-2:])
        hide = ((" at ", " dot "), (" [at] ", " [dot] "), ("[at]", "[dot]"), ("(at)", "."), (" at ", "."), (" (at) ", " (dot) "))
        return [f"{u.replace('.', d)}{a}{v.replace('.', d)}" for u, v in ((user, domain), plain) for a, d in hide]
    if kind == "ip":
        return [s.replace(".", d) for d in ("[.]", "(.)", " dot ", "[dot]", " . ")]
    d = _digits(s)
    if kind == "phone":
        plain = s.lstrip("+")
        return [plain, "00" + plain, d, "00" + d, re.sub(r"[^0-9]+", ".", plain).strip("."), re.sub(r"[^0-9]+", "-", plain).strip("-")]
    return [x.join(d[i : i + 4] for i in range(0, len(d), 4)) for x in (".", "/", "_", "  ", " -")]


def varied(s: str, kind: str, k: int) -> str:
    """Another span of the same kind and form: other digits, by a checksum; of addresses other letters. It serves to learn forms, not numbers, from few spans."""
    seed = zlib.crc32(f"{k} {s}".encode("utf-8", "replace"))
    if kind == "email":
        return "".join(c if not c.isascii() or not c.isalpha() else chr((ord(c.lower()) - 97 + seed % 25 + 1) % 26 + 97) for c in s[: s.rfind(".")]) + s[s.rfind(".") :]
    if kind == "ip":
        return ".".join(str((seed >> 8 * i) % 256) for i in range(4))
    out = []
    for c in s:
        if c.isdigit() and (out or kind == "card"):
            seed = (seed * 1103515245 + 12345) % (1 << 31)
            c = str(max(seed >> 16, 1) % 9 + 1)
        out.append(c)
    if kind == "card":  # the last digit makes the checksum right
        last = max(i for i, c in enumerate(out) if c.isdigit())
        for d in "0123456789":
            out[last] = d
            if luhn(_digits("".join(out))):
                break
    return "".join(out)


def lookalikes(s: str, kind: str) -> list[tuple[str, str]]:
    """Strings that the generators may propose but that are no personal data, made from a base span."""
    d = _digits(s)
    out = []
    if kind == "email":
        user, domain = s.split("@", 1)
        first, second = (re.sub("[0-9]+", "", re.split("[._%+-]+", x)[0]) or "all" for x in (user, domain))
        out += [(f"{first} at {second} dot matrix", "email"), (f"{first} at {second}.Then", "email"), (f"look at {second} dot {first}", "email"), *((f"{first} at {second} dot {w}", "email") for w in ("the", "and", "it", "not", "then")), (f"look at {second} dot {len(s)}", "email"), (f"{second}@{len(s)}.{len(user)}", "email")]
    if kind in ("card", "phone") and len(d) >= 9:
        odd = d[:-1] + str((int(d[-1]) + 1) % 10)
        for sep in (" ", ".", "-"):  # amounts
            out.append((sep.join(x for x in [d[: len(d) % 3], *(d[i : i + 3] for i in range(len(d) % 3, len(d), 3))] if x), "phone"))
        out += [(f"978-{d[0]}-{d[1:3]}-{d[3:9]}-{d[-1]}", "phone"), (f"979{odd[:10]}", "phone"), (f"20{d[:2]}{int(d[2]) % 2}{int(d[3]) % 9 + 1}1{d[4]} {d[:6]}", "phone")]
        out += [(odd, "card"), (".".join(odd[i : i + 4] for i in range(0, len(odd), 4)), "card")]
    if kind == "ip":
        a, b, c, e = s.split(".")
        out += [(f"{a}.{b}.{c}", "ip"), (f"{a} dot {b} dot {c} dot {int(e) + 256}", "ip")]
    return out


def examples(text: str) -> tuple[list[list[float]], list[int]]:
    """Feature rows and labels that one document gives."""
    base = base_spans(text)
    found: list[tuple[tuple[str, int, int, str], int]] = []

    def put(t: str, s: int, e: int, kind: str, y: int) -> None:
        found.append(((t, s, e, kind), y))

    for turn in range(VARIED):
        for s, e, kind in base if len(found) < FEW else ():
            if not turn:
                put(text, s, e, kind, 1)
            near, rest = text[max(0, s - 40) : s], text[e : e + 40]
            own = varied(text[s:e], kind, turn) if turn else text[s:e]
            for hidden in disguises(own, kind):
                put(near + hidden + rest, len(near), len(near) + len(hidden), kind, 1)
            for other, k in lookalikes(own, kind):
                put(near + other + rest, len(near), len(near) + len(other), k, 0)
    for s, e, kind in _apart(candidates(text), base):
        if _ruled_out(text[s:e], kind):
            put(text, s, e, kind, 0)
    return [features(*x) for x, _ in found], [y for _, y in found]


def _apart(spans: list, base: list) -> list:
    """The spans that touch no base span."""
    if not spans or not base:
        return spans
    starts = np.array([b[0] for b in base])
    reach = np.maximum.accumulate(np.array([b[1] for b in base]))
    return [x for x in spans if not (k := int(np.searchsorted(starts, x[1]))) or reach[k - 1] <= x[0]]


class Selector:
    """Trees and a threshold for each kind."""

    def __init__(self, trees: Trees | None = None, thresholds: dict[str, float] | None = None):
        self.trees, self.thresholds = trees, thresholds or {}

    def spans(self, text: str) -> list[tuple[int, int, str, bool, float]]:
        """(start, end, kind, base, score) by start, then kind."""
        if not text or not (ANY.search(text) or SPELLED.search(text)):
            return []
        base = base_spans(text)
        out = [(s, e, k, True, 1.0) for s, e, k in base]
        more = [c for c in _apart(candidates(text), base) if c[2] in self.thresholds]
        if more:
            p = self.trees.probability(coded([features(text, *c) for c in more]))
            taken: list[tuple[int, int]] = []  # sorted, apart from each other
            for i in np.argsort(-np.round(p, 2), kind="stable"):  # of about equal ones the first kind as listed
                s, e, k = more[i]
                at = bisect_left(taken, (s, e))
                if p[i] >= self.thresholds[k] and (not at or taken[at - 1][1] <= s) and (at == len(taken) or e <= taken[at][0]):
                    taken.insert(at, (s, e))
                    out.append((s, e, k, False, float(p[i])))
        return sorted(out, key=lambda x: (x[0], KINDS.index(x[2])))


def coded(rows: list[list[float]]) -> np.ndarray:
    """Feature rows as bytes; -1, for no word, becomes 0, and what is over 254 counts as 254."""
    return np.clip(np.array(rows) + 1, 0, 255).astype(np.uint8)


def learned(docs: DataFrame) -> DataFrame:
    """(key, n) of all examples of all documents: key has the coded features and a last byte of label + 2 if the document calibrates."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter = Counter()

        def told() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(found), pa.binary()), pa.array(list(found.values()), pa.int64())], names=["key", "n"])
            found.clear()
            return out

        for b in arrow_text.slices(batches):
            for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if t and (ANY.search(t) or SPELLED.search(t)):
                    xs, ys = examples(t)
                    held = 2 * (zlib.crc32(str(i).encode()) % 5 == 0)
                    found.update(x.tobytes() + bytes([y + held]) for x, y in zip(coded(xs) if xs else (), ys, strict=True))
                    if len(found) > COUNTERS:
                        yield told()
        yield told()

    some = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "key binary, n long")
    return stored(some.groupBy("key").agg(F.sum("n").alias("n")), "pii-examples")


def _rows(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Codes, labels, whether they calibrate, and numbers of some rows of `learned`."""
    key = np.frombuffer(b"".join(b.column(0).to_pylist()), np.uint8).reshape(b.num_rows, -1)
    return key[:, :-1], (key[:, -1] & 1).astype(float), key[:, -1] >= 2, b.column(1).to_numpy()


class Examples:
    """The rows of `learned`, added up by tasks; few of them, `most` at most, on the driver, with the same sums."""

    def __init__(self, rows: DataFrame, most: int):
        self.rows = rows
        self.local = rows.toArrow().combine_chunks().to_batches() if rows.count() <= most else None

    def total(self, values: Callable[[pa.RecordBatch], tuple[np.ndarray, np.ndarray]]) -> dict[int, int]:
        """Sums by slot of what `values` gives of a batch, slots and numbers; slots are bounded by the caller."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            out: Counter = Counter()
            for b in batches:
                if b.num_rows:
                    slot, n = values(b)
                    out.update(dict(zip(slot.tolist(), n.tolist(), strict=True)))
            yield pa.RecordBatch.from_arrays([pa.array(list(out), pa.int64()), pa.array(list(out.values()), pa.int64())], names=["slot", "n"])

        if self.local is not None:
            return dict(zip(*(c.to_pylist() for c in next(run(iter(self.local))).columns), strict=True))
        return dict(self.rows.mapInArrow(run, "slot long, n long").groupBy("slot").agg(F.sum("n")).collect())


def _dense(slots: dict[int, int], size: int) -> np.ndarray:
    out = np.zeros(size, np.int64)
    out[list(slots)] = list(slots.values())
    return out


def _summed(slot: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    own, at = np.unique(slot, return_inverse=True)
    return own, np.rint(np.bincount(at, n, len(own))).astype(np.int64)


def fit(docs: DataFrame, precision: float = PRECISION, most: int = LOCAL_ROWS) -> Selector:
    """Learn on all examples of all documents. Runs a job for each level of each tree where there are more than `most` different ones; only sums reach the driver then."""
    rows = Examples(learned(docs), most)
    n_features = len(features("0", 0, 1, KINDS[0]))
    sort = _dense(rows.total(lambda b: _summed(np.frombuffer(b"".join(b.column(0).to_pylist()), np.uint8).reshape(b.num_rows, -1)[:, -1], b.column(1).to_numpy())), 4)
    if not sort.all():  # a label is missing in either part
        return Selector()

    def codes(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        x, _, held, n = _rows(b)
        return _summed((x[~held].astype(np.int64) + CODES * np.arange(n_features)).ravel(), np.repeat(n[~held], n_features))

    def sums(column: np.ndarray, cut: np.ndarray, level: int) -> np.ndarray:
        def values(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
            x, y, held, n = _rows(b)
            flat = trees.histogram(x[~held], y[~held], n[~held], column, cut, level).ravel()
            return (at := np.flatnonzero(flat)), flat[at]

        shape = (2, 2**level, n_features, trees.bins + 2)
        return _dense(rows.total(values), int(np.prod(shape))).reshape(shape)

    trees = Trees()
    trees.fit(_dense(rows.total(codes), n_features * CODES).reshape(n_features, CODES), int(sort[1]), int(sort[0] + sort[1]), sums)

    def scored(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        x, y, held, n = _rows(b)
        return _summed(((trees.steps(x[held]) + 30 * STEP) * len(KINDS) + x[held][:, 0] - 1) * 2 + y[held].astype(np.int64), n[held])

    slots = sorted(rows.total(scored).items())
    at, n = np.array([s for s, _ in slots]), np.array([v for _, v in slots], float)
    y, kind, step = (at % 2).astype(float), at // 2 % len(KINDS), at // 2 // len(KINDS) - 30 * STEP
    trees.calibrate(step, y, n)
    thresholds = {}
    for k, name in enumerate(KINDS):
        own = kind == k
        p, back = np.unique(-trees.of_steps(step[own]), return_inverse=True)  # the likeliest first
        chosen, good = np.bincount(back, n[own], len(p)).cumsum(), np.bincount(back, n[own] * y[own], len(p)).cumsum()
        fits = np.flatnonzero((good >= precision * chosen) & (good >= FEWEST))
        if len(fits):  # halfway to the first score that is no longer chosen
            thresholds[name] = max(0.5, float(np.append(-p, 0.0)[fits[-1] : fits[-1] + 2].mean()))
    return Selector(trees, thresholds)


SPANS = "array<struct<start:int,stop:int,kind:string,base:boolean,score:double>>"


def find(docs: DataFrame, selector: Selector) -> DataFrame:
    """(doc_id, spans) of every row."""
    kind = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32()), ("kind", pa.string()), ("base", pa.bool_()), ("score", pa.float64())]))
    names = [f.name for f in kind.value_type]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in arrow_text.slices(batches):
            spans = [[dict(zip(names, s, strict=True)) for s in selector.spans(t or "")] for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(spans, kind)], names=["doc_id", "spans"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, f"doc_id long, spans {SPANS}")


def redacted(text: str, spans: list[tuple]) -> str:
    """Each stretch of overlapping spans becomes the name of its first kind in brackets."""
    out, at = [], 0
    for s, e, kind, *_ in spans:
        if s >= at:
            out += [text[at:s], f"[{kind.upper()}]"]
        at = max(at, e)
    return "".join(out) + text[at:]


def redact(docs: DataFrame, selector: Selector) -> DataFrame:
    """All rows and columns; texts without their spans, and n_chars (where there is such a column) counted anew for those."""
    at = docs.columns.index("text")
    count = docs.columns.index("n_chars") if "n_chars" in docs.columns else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in arrow_text.slices(batches):
            columns = list(b.columns)
            texts = columns[at].to_pylist()
            found = [selector.spans(t or "") for t in texts]
            new = [redacted(t, s) if s else t for t, s in zip(texts, found, strict=True)]
            columns[at] = pa.array(new, columns[at].type)
            if count is not None:
                columns[count] = pa.array([len(t) if s else n for t, s, n in zip(new, found, columns[count].to_pylist(), strict=True)], columns[count].type)
            yield pa.RecordBatch.from_arrays(columns, schema=b.schema)

    return docs.mapInArrow(run, docs.schema)
