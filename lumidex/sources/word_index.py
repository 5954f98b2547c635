"""A positional word index that ranked searches read instead of the texts.

For each word of a row there is a posting: the word, the field it stands in, the row, and in prompts the byte
offset of every place. Postings of a word in rows that are read together (a slice) are filed as one, so a common word takes few
rows of the index; the ids of a slice are filed beside them, so that a compaction passes over what no longer counts slice by slice. Postings are filed by a checksum of their word (names and settings, which words open, by
their first letter), in sorted files, so a search reads the folders of its own words and of those the row
groups that hold them. Words of a search meet by a sum over rows; no text is read, and words that
stand together are told by their places.

An index is a folder of segments. A change writes one segment, as large as the change: postings of the rows put,
and for every row put or deleted its number, with the columns that searches show and sort by. The newest segment
of a row is the one that counts; older postings of it are passed over. `compact` writes one segment
of what counts; the old ones stay readable until the new one is complete. A segment without its row
list isn't there yet, so a writer that is lost leaves nothing behind that counts.

Words with stars, of scripts without spaces, or with other signs than single spaces in them aren't
answered here but by a scan (`plans.search.Search`), which gives the same scores. Defined results: null texts
have no words; rows without an id aren't filed; ids put at once must differ (`operators.tables.newest` sees to that for
paths); an empty table gives an index without rows; an index without segments finds nothing.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..checkpoints import shared_dir
from ..functions import text as T

PROMPT, NAMES, SETTINGS, NEGATIVE, IDS = range(5)
BUCKETS = 8
SHOWN = ("dir", "name", "mtime", "size")
#: Runs of what `functions.text.W` takes for word characters.
RUN = regex.compile(r"[[\p{Alphabetic}\p{N}]&&[\x00-⹿]]+", regex.V1)
#: Which code points these are; the last one stands for all that come later.
IS_WORD = np.array([bool(RUN.fullmatch(chr(c))) for c in range(0x2E80)] + [False])
POSTS = "array<struct<id: long, row: int, size: int, at: array<int>>>"
FILED = f"word string, field int, slice long, posts {POSTS}"
BLOCKS = f"bucket int, origin int, {FILED}"
#: Bytes of text and rows of a slice at most (one row may be longer).
SLICE_BYTES, SLICE_ROWS = 8 << 20, 2048


def answers(needle: str) -> bool:
    """Whether postings tell where a word, or words with single spaces between them, stands."""
    words = needle.lower().split(" ")
    return all(RUN.fullmatch(w) for w in words) and len(set(words)) == len(words)


def _bucket(word: str, opens: bool, buckets: int) -> int:
    return zlib.crc32((word[:1] if opens else word).encode()) % buckets + (buckets if opens else 0)


def _bytes_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts end to end (and four zeros), and where each begins (n+1); null texts are empty."""
    texts = pa.concat_arrays([texts.fill_null("")])
    offsets = np.frombuffer(texts.buffers()[1], np.int32, len(texts) + 1, 4 * texts.offset).astype(np.int64)
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    return np.concatenate([data, np.zeros(4, np.uint8)]), offsets - offsets[0]


def _in_words(data: np.ndarray) -> np.ndarray:
    """Whether each byte belongs to a word character."""
    inside = IS_WORD[:128][np.minimum(data, 127)] & (data < 128)
    for lead, low, size in ((0xC0, 0x1F, 2), (0xE0, 0x0F, 3)):
        at = np.flatnonzero((data >= lead) & (data < lead + low + 1))
        code = (data[at] & low).astype(np.int64)
        for k in range(1, size):
            code = code << 6 | data[np.minimum(at + k, len(data) - 1)] & 0x3F
        at = at[IS_WORD[np.minimum(code, 0x2E80)]]
        for k in range(size):
            inside[np.minimum(at + k, len(data) - 1)] = True
    inside[-4:] = False
    return inside


def _tokens(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """All words of all texts in order: the word, the number of its text, its byte offset there and whether a single space follows; and the bytes of each text."""
    data, starts = _bytes_of(texts)
    inside = _in_words(data)
    cut = np.zeros(len(data), bool)
    cut[starts] = True  # words end with their text
    before = np.concatenate([[False], inside[:-1]])
    begin = np.flatnonzero(inside & (~before | cut))
    end = np.flatnonzero(before & (~inside | cut))
    length = np.concatenate([[0], np.cumsum(end - begin)]).astype(np.int32)
    words = pa.StringArray.from_buffers(len(begin), pa.py_buffer(length), pa.py_buffer(data[inside]))
    text = np.searchsorted(starts, begin, "right") - 1
    spaced = (data[end] == 32) & ~cut[end]
    return words, text, 2 * (begin - starts[text]) + spaced, np.diff(starts)


def _filed(words: pa.Array, row: np.ndarray, place: np.ndarray | None, size: np.ndarray, ids: np.ndarray, field: int, slice_: int) -> pa.RecordBatch:
    """Words of rows, in order of rows, as one block for each word."""
    coded = words.dictionary_encode()
    code = coded.indices.to_numpy()
    order = np.argsort(code, kind="stable")
    code, row = code[order], row[order]
    new_word = np.concatenate([[True], code[1:] != code[:-1]])[: len(code)]
    first = np.flatnonzero(new_word | np.concatenate([[True], row[1:] != row[:-1]])[: len(code)])
    at = np.append(first, len(code)) if place is not None else np.zeros(len(first) + 1)
    places = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array((place[order] if place is not None else np.zeros(0)).astype(np.int32)))
    posts = pa.StructArray.from_arrays([pa.array(ids[row[first]]), pa.array(row[first].astype(np.int32)), pa.array(size[row[first]].astype(np.int32)), places], names=["id", "row", "size", "at"])
    blocks = np.flatnonzero(new_word[first])
    posts = pa.ListArray.from_arrays(pa.array(np.append(blocks, len(first)).astype(np.int32)), posts)
    n, own = len(blocks), coded.dictionary.take(pa.array(code[first[blocks]]))
    return pa.RecordBatch.from_arrays([own, pa.array(np.full(n, field, np.int32)), pa.array(np.full(n, slice_, np.int64)), posts], names=["word", "field", "slice", "posts"])


def _slices(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """A batch in slices of bounded rows and bytes of prompts."""
    upto = _bytes_of(b.column(1))[1]
    first = 0
    while first < b.num_rows:
        last = min(first + SLICE_ROWS, max(first + 1, int(np.searchsorted(upto, upto[first] + SLICE_BYTES, "right")) - 1), b.num_rows)
        yield b.slice(first, last - first)
        first = last


def _posted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of rows of (id, prompt, names, settings, negative); places are twice the byte offset, and one more where a single space follows."""
    for b in batches:
        for rows in _slices(b):
            ids = rows.column(0).to_numpy()
            here, sizes = int(ids[0]), None
            for field, texts in zip((PROMPT, NAMES, SETTINGS, NEGATIVE), rows.columns[1:], strict=True):
                words, row, place, size = _tokens(texts)
                sizes = size if sizes is None else sizes  # of prompts
                yield _filed(words, row, place if field == PROMPT else None, sizes, ids, field, here)
            yield _filed(pa.array([""] * len(ids), pa.string()), np.arange(len(ids)), None, sizes, ids, IDS, here)


def blocks(rows: DataFrame, segment: int, buckets: int = BUCKETS) -> DataFrame:
    """What is filed for some rows: (bucket, origin, word, field, slice, posts); a slice is named by its first id and the segment it was first put in."""
    from ..plans.search import searched_names

    lines = F.array_join(F.array(*searched_names()), "\n")
    texts = rows.where("id is not null").select(F.col("id").cast("long"), "prompt", lines.alias("names"), T.settings_text(F.col("source"), F.col("seed"), F.col("params")).alias("settings"), "negative")
    out = texts.mapInArrow(_posted, FILED)
    opens = F.col("field").isin(NAMES, SETTINGS)
    bucket = F.crc32(F.when(opens, F.substring("word", 1, 1)).otherwise(F.col("word"))) % buckets + F.when(opens, buckets).otherwise(0)
    return out.select(F.when(F.col("field") == IDS, 2 * buckets).otherwise(bucket).cast("int").alias("bucket"), F.lit(segment).alias("origin"), "word", "field", "slice", "posts")


def _each(filed: DataFrame) -> DataFrame:
    """One row for each posting of some blocks."""
    return filed.select("bucket", "word", "field", "segment", F.explode("posts").alias("p")).select("bucket", "word", "field", "p.id", "p.size", "p.at", "segment")


@dataclass
class Hits:
    """What a search asks for: words anywhere that rank, words of the prompt that rank there only."""

    ranked: list[str] = field(default_factory=list)
    ranked_prompt: list[str] = field(default_factory=list)


@dataclass
class WordIndex:
    spark: SparkSession
    root: str
    buckets: int = BUCKETS
    shown: tuple[str, ...] = SHOWN

    # ---- writing

    def segments(self) -> list[int]:
        """Numbers of the complete segments, ascending, from the last compaction on."""
        fs, path = self._folder("rows")
        if not fs.exists(path):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(path) if fs.exists(self._path(f"rows/{s.getPath().getName()}/_SUCCESS"))]
        found = sorted((int(n.split("-")[0]), n) for n in names)
        whole = max((k for k, n in found if n.endswith("-all")), default=0)
        return [k for k, n in found if k >= whole]

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")

    def _folder(self, name: str):
        path = self._path(name)
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def _named(self, segment: int) -> str:
        fs, _ = self._folder("rows")
        return f"{segment}-all" if fs.exists(self._path(f"rows/{segment}-all")) else str(segment)

    def _write(self, posted: DataFrame, rows: DataFrame, segment: int, ending: str = "") -> None:
        # a bucket of common words is written by several tasks, small ones by one; each file is sorted
        dealt = posted.hint("rebalance", "bucket").sortWithinPartitions("bucket", "word", "field")
        dealt.write.mode("overwrite").partitionBy("bucket").parquet(f"{self.root}/words/{segment}")
        rows.write.mode("overwrite").parquet(f"{self.root}/rows/{segment}{ending}")  # a segment counts from here on

    def put(self, records: DataFrame) -> int:
        """File new rows, or rows anew; the number of the segment."""
        one = records.where("id is not null")
        segment = max(self.segments(), default=0) + 1
        self._write(blocks(one, segment, self.buckets), one.select(F.col("id").cast("long"), *self.shown, F.lit(False).alias("gone")), segment)
        return segment

    def delete(self, ids: DataFrame) -> int:
        segment = max(self.segments(), default=0) + 1
        nothing = [F.lit(None).cast(t).alias(c) for c, t in self._rows_schema()[1:-1]]
        self._write(self.spark.createDataFrame([], BLOCKS), ids.select(F.col("id").cast("long"), *nothing, F.lit(True).alias("gone")), segment)
        return segment

    def _rows_schema(self) -> list[tuple[str, str]]:
        known = {"dir": "string", "name": "string"}
        return [("id", "long"), *((c, known.get(c, "long")) for c in self.shown), ("gone", "boolean")]

    def compact(self) -> int:
        """One segment of all that counts."""
        segment = max(self.segments(), default=0) + 1
        alive = self.rows()
        self._write(self._counting().select("bucket", "origin", "word", "field", "slice", "posts"), alive.select("id", *self.shown, F.lit(False).alias("gone")), segment, "-all")
        return segment

    def drop_old(self) -> list[int]:
        """Remove the segments that a compaction has replaced; no search may be reading them."""
        fs, path = self._folder("words")
        kept, gone = set(self.segments()), []
        for s in fs.listStatus(path) if fs.exists(path) else []:
            number = int(s.getPath().getName())
            if number < min(kept, default=0):
                fs.delete(s.getPath(), True)
                fs.delete(self._path(f"rows/{number}"), True)
                fs.delete(self._path(f"rows/{number}-all"), True)
                gone.append(number)
        return sorted(gone)

    # ---- reading

    def rows(self) -> DataFrame:
        """The rows that count, with their segment."""
        out, segments = None, self.segments()
        schema = ", ".join(f"{c} {t}" for c, t in self._rows_schema())
        for k in segments:
            part = self.spark.read.schema(schema).parquet(f"{self.root}/rows/{self._named(k)}").withColumn("segment", F.lit(k))
            out = part if out is None else out.unionByName(part)
        if out is None:
            return self.spark.createDataFrame([], f"id long, {', '.join(f'{c} {t}' for c, t in self._rows_schema()[1:-1])}, segment int")
        columns = ["id", *self.shown, "segment"]
        if len(segments) == 1:
            return out.where("not gone").select(columns)
        last = out.groupBy("id").agg(F.max_by(F.struct(*self.shown, "segment", "gone"), "segment").alias("x"))
        return last.where("not x.gone").select("id", "x.*").select(columns)

    def _read(self, segments: list[int], buckets: list[int]) -> DataFrame:
        """Blocks of some buckets: the folders of these alone are listed and read."""
        out = None
        for k in segments:
            base, fs = f"{self.root}/words/{k}", self._folder("words")[0]
            paths = [f"{base}/bucket={b}" for b in buckets if fs.exists(self._path(f"words/{k}/bucket={b}"))]
            if paths:
                part = self.spark.read.schema(BLOCKS).option("basePath", base).parquet(*paths).withColumn("segment", F.lit(k))
                out = part if out is None else out.unionByName(part)
        return self.spark.createDataFrame([], f"{BLOCKS}, segment int") if out is None else out

    def _counting(self) -> DataFrame:
        """Blocks without postings that no longer count. What a slice has lost is told by its own list of ids, and joined to its blocks."""
        segments = self.segments()
        filed = self._read(segments, list(range(2 * self.buckets + 1)))
        if len(segments) < 2:  # nothing was put or deleted since
            return filed
        own = ["segment", "origin", "slice"]
        listed = self._read(segments, [2 * self.buckets]).select(*own, F.explode("posts").alias("p")).select(*own, "p.id", "p.row")
        lost = listed.join(self.rows().select("id", "segment"), ["id", "segment"], "left_anti").groupBy(own).agg(F.collect_set("row").alias("rows"))
        # a mark for each row of a slice up to the last one lost
        marks = lost.select(*own, F.transform(F.sequence(F.lit(0), F.array_max("rows")), lambda k: F.array_contains("rows", k)).alias("lost"))
        marked = filed.join(marks, own, "left")
        # what is left of a slice that lost rows is filed posting by posting
        left = marked.where("lost is not null").select("*", F.explode("posts").alias("p")).where(~F.coalesce(F.get("lost", F.col("p.row")), F.lit(False)))
        return marked.where("lost is null").drop("lost").unionByName(left.withColumn("posts", F.array("p")).drop("lost", "p"))

    def postings(self) -> DataFrame:
        """All postings that count."""
        return _each(self._counting().where(F.col("field") != IDS))

    def scores(self, ask: Hits) -> DataFrame:
        """(id, segment, score) of the rows that have every word, as `plans.search.Search` scores them; older segments of a row are among them."""
        terms = [(n.lower(), k < len(ask.ranked)) for k, n in enumerate([*ask.ranked, *ask.ranked_prompt])]
        if not all(answers(n) for n, _ in terms) or not terms:
            raise ValueError("words with stars or signs need a scan")
        words = [n.split(" ") for n, _ in terms]
        alone, opening = sorted({w for ws in words for w in ws}), sorted({n for n, anywhere in terms if anywhere and " " not in n})
        buckets = sorted({_bucket(w, False, self.buckets) for w in alone} | {_bucket(w, True, self.buckets) for w in opening})
        opens = F.col("field").isin(NAMES, SETTINGS)
        starts = F.lit(False)
        for w in opening:
            starts = starts | ((F.col("word") >= w) & F.startswith("word", F.lit(w)))
        found = _each(self._read(self.segments(), buckets).where((~opens & F.col("word").isin(alone)) | (opens & starts)))
        at = lambda w: F.max(F.when((F.col("field") == PROMPT) & (F.col("word") == w), F.col("at")))
        there = lambda w, f: F.bool_or((F.col("field") == f) & (F.startswith("word", F.lit(w)) if f in (NAMES, SETTINGS) else F.col("word") == w))
        flags = [F.coalesce(there(n, f), F.lit(False)).alias(f"f{k}_{f}") for k, (n, anywhere) in enumerate(terms) if anywhere and " " not in n for f in (NAMES, SETTINGS, NEGATIVE)]
        size = F.max(F.when(F.col("field") == PROMPT, F.col("size"))).alias("size")
        rows = found.groupBy("id", "segment").agg(size, *[at(w).alias(f"w{k}") for k, w in enumerate(alone)], *flags)
        where = {w: F.col(f"w{k}") for k, w in enumerate(alone)}
        points = []
        for k, (n, anywhere) in enumerate(terms):
            places = _together([where[w] for w in words[k]], words[k])
            hit = T.PROMPT + T.EARLY * (1 - F.shiftright(F.get(places, F.lit(0)), 1) / F.col("size")) + T.AGAIN * F.least(F.size(places) - 1, F.lit(T.AGAIN_MOST))
            out = F.when(F.coalesce(F.size(places), F.lit(0)) > 0, hit)
            if anywhere and " " not in n:
                for f, p in ((NAMES, T.NAME), (SETTINGS, T.SETTING), (NEGATIVE, T.NEGATIVE)):
                    out = out.when(F.col(f"f{k}_{f}"), F.lit(float(p)))
            points.append(out.otherwise(F.lit(0.0)))
        rows = rows.withColumn("_p", F.array(*points)).where(F.forall("_p", lambda p: p > 0))
        total = F.aggregate("_p", F.lit(0.0), lambda a, p: a + p)
        if len(ask.ranked) > 1:
            flat = [w for ws in words[: len(ask.ranked)] for w in ws]
            beside = _together([where[w] for w in flat], flat)
            total = total + F.when(F.coalesce(F.size(beside), F.lit(0)) > 0, F.lit(float(T.PHRASE))).otherwise(F.lit(0.0))
        return rows.select("id", "segment", total.alias("score"))

    def search(self, ranked: list[str], ranked_prompt: list[str] = ()) -> DataFrame:
        """Rows that have every word, with the columns shown and their score."""
        return self.scores(Hits(list(ranked), list(ranked_prompt))).join(self.rows(), ["id", "segment"]).drop("segment")


def _together(places: list[Column], words: list[str]) -> Column:
    """Places of the first word at which all follow one another with a single space between them; null where one is missing."""
    if len(places) == 1:
        return places[0]
    # from the last word back: where a run of the remaining words begins
    begins = F.transform(places[-1], lambda p: F.shiftright(p, 1))
    for word, own in reversed(list(zip(words[:-1], places[:-1], strict=True))):
        step = F.lit(len(word.encode()) + 1)
        spaced = F.filter(own, lambda p: p.bitwiseAND(F.lit(1)) == 1)
        ends = F.transform(begins, lambda b: b - step)  # noqa: B023
        begins = F.array_intersect(F.transform(spaced, lambda p: F.shiftright(p, 1)), ends)
    return F.transform(begins, lambda b: F.shiftleft(b, 1))


_known: dict[tuple[str, str], WordIndex] = {}


def of(spark: SparkSession, sf_dir: str, rows: DataFrame | None = None) -> WordIndex:
    """The index of a library's media table in the shared folder of this session; made when it is first asked for."""
    from .tables import media

    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _known:
        rows = media(spark, sf_dir) if rows is None else rows
        index = WordIndex(spark, f"{shared_dir(spark)}/words-{uuid.uuid4().hex}", min(4096, max(8, rows.count() // 50_000)))
        index.put(rows)
        _known[key] = index
    return _known[key]
