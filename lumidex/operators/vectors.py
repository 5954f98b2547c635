"""Vector search over an embedding column, many queries at a time: match against a yardstick, nearest rows, kernel regression on neighbours.

A query set is held in blocks of `BLOCK_BYTES` bytes; each block is multiplied with every
partition's vectors, batch by batch, and a partition passes on what can still count. The yardstick
is a fixed set of bounded size. Defined results: rows without a vector are nobody's neighbour;
ties go by id; a spread of 0 gives level 0; an empty table or query set gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Bars of a match and of likeness, numbers of rows, sharpness of the weights.
BAR, CLOSE, FAIR, FEWEST, NEIGHBOURS, SHARPNESS, SCALE = 1.5, 0.78, 0.6, 12, 24, 40.0, 1.4826
BLOCK_BYTES, FIXED_BYTES = 32 << 20, 512 << 20
FOUND = "query_id long, vec_id long, score double"


def matrix(column: pa.Array) -> np.ndarray:
    """An array column without nulls as a matrix of doubles."""
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return values.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def blocks(queries: DataFrame, most: int = BLOCK_BYTES) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(ids, matrix) of the queries, a block of bounded bytes at a time."""
    known = queries.where("embedding is not null").select("vec_id", "embedding")
    size = known.agg(F.sum(F.size("embedding") * 4)).first()[0] or 0
    n = -(-size // most)
    for k in range(n):
        got = (known.where(F.pmod(F.xxhash64("vec_id"), F.lit(n)) == k) if n > 1 else known).toArrow().sort_by("vec_id").combine_chunks()
        if got.num_rows:
            yield got["vec_id"].to_numpy(), matrix(got["embedding"].combine_chunks())


def whole(fixed: DataFrame, most: int = BLOCK_BYTES) -> tuple[np.ndarray, np.ndarray]:
    """(ids, matrix) of a small fixed set, all of it, by id; one of more than FIXED_BYTES is an error."""
    parts, size = [], 0
    for ids, m in blocks(fixed, most):
        size += m.nbytes
        if size > FIXED_BYTES:
            raise ValueError(f"a fixed set of texts may hold {FIXED_BYTES} bytes of vectors")
        parts.append((ids, m))
    if not parts:
        return np.zeros(0, np.int64), np.zeros((0, 0))
    ids, m = (np.concatenate([p[k] for p in parts]) for k in (0, 1))
    order = np.argsort(ids, kind="stable")
    return ids[order], m[order]


def _crossed(vectors: DataFrame, queries: DataFrame, step: Callable, schema: str, more: str | None = None) -> DataFrame:
    """What `step(ids, vectors, further column, query ids, query matrix)` finds in each batch, for all blocks of queries."""
    rows = vectors.where("embedding is not null").select("vec_id", "embedding", *([more] if more else []))
    out = None
    for ids, q in blocks(queries):

        def run(batches: Iterator[pa.RecordBatch], ids=ids, q=q) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for at in range(0, b.num_rows, 4096):
                    part = b.slice(at, 4096)
                    yield from step(part.column(0).to_numpy(), matrix(part.column(1)), part.column(2).to_numpy(zero_copy_only=False) if more else None, ids, q)

        found = rows.mapInArrow(run, schema)
        out = found if out is None else out.unionByName(found)
    return rows.sparkSession.createDataFrame([], schema) if out is None else out


def _rows(schema: str, *columns: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=[f.split()[0] for f in schema.split(", ")])


def spread(scores: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Middle of each row of scores (the element at n/2 in order), and 1.4826 times that of the deviations from it."""
    half = scores.shape[1] // 2
    middle = np.partition(scores, half, axis=1)[:, half]
    return middle, SCALE * np.partition(np.abs(scores - middle[:, None]), half, axis=1)[:, half]


def levels(scores: np.ndarray, usual: np.ndarray) -> np.ndarray:
    """How far each score stands out from the row's usual ones."""
    middle, width = spread(usual)
    return np.divide(scores - middle[:, None], width[:, None] * BAR, out=np.zeros_like(scores), where=width[:, None] > 0)


def match(vectors: DataFrame, queries: DataFrame, yardstick: np.ndarray, bar: float = 1.0) -> DataFrame:
    """(query_id, vec_id, score) where the score, a level, is at least `bar`."""

    def step(ids, v, _, qids, q):
        level = levels(v @ q.T, v @ yardstick.T)
        i, j = np.nonzero(level >= bar)
        yield _rows(FOUND, qids[j], ids[i], level[i, j])

    return _crossed(vectors, queries, step, FOUND)


def fits(vectors: DataFrame, phrases: DataFrame, yardstick: np.ndarray) -> DataFrame:
    """(query_id, vec_id, score): the level of every row for every phrase; phrases are a small stated set."""
    return match(vectors, phrases, yardstick, -np.inf)


def _nearest(vectors: DataFrame, queries: DataFrame, k: int, least: float, always: float = np.inf, more: str | None = None) -> DataFrame:
    """Of each query the rows with a score of `always`, and the best `k` of at least `least`, with ties by id; a batch passes on its own best."""
    schema = FOUND + (f", {more} double" if more else "")

    def step(ids, v, extra, qids, q):
        order = np.argsort(ids, kind="stable")
        ids, score = ids[order], (v @ q.T)[order]
        best = np.argsort(-score, axis=0, kind="stable")[:k]  # ties by id, as rows are in that order
        keep = score >= always
        np.put_along_axis(keep, best, True, axis=0)
        i, j = np.nonzero(keep & (score >= least))
        columns = [qids[j], ids[i], score[i, j]]
        yield _rows(schema, *columns, *([extra[order][i].astype(np.float64)] if more else []))

    found = _crossed(vectors, queries, step, schema, more)
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("place", place).where((F.col("place") <= k) | (F.col("score") >= always))


def similar(vectors: DataFrame, queries: DataFrame, close: float = CLOSE, fair: float = FAIR, fewest: int = FEWEST) -> DataFrame:
    """(query_id, vec_id, score): rows at least `close`; with fewer than `fewest` of them, the best `fewest` that are `fair`."""
    found = _nearest(vectors, queries, fewest, min(close, fair), close)
    return found.where((F.col("score") >= close) | ((F.col("place") <= fewest) & (F.col("score") >= fair))).drop("place")


def neighbours_mean(vectors: DataFrame, queries: DataFrame, target: str, k: int = NEIGHBOURS) -> DataFrame:
    """(query_id, value, n): the mean of `target` over each query's `k` nearest rows that have one, weighted by exp(-40 (best - score))."""
    near = _nearest(vectors.where(F.col(target).isNotNull()), queries, k, -np.inf, more=target)
    near = near.where(F.col("place") <= k).withColumn("w", F.exp(-SHARPNESS * (F.max("score").over(Window.partitionBy("query_id")) - F.col("score"))))
    return near.groupBy("query_id").agg((F.sum(F.col("w") * F.col(target)) / F.sum("w")).alias("value"), F.count("*").alias("n"))


def described(vectors: DataFrame, queries: DataFrame, texts: DataFrame, styles: DataFrame, most: int = 8, block: int = BLOCK_BYTES) -> DataFrame:
    """(vec_id, subjects, style) of the queried rows: the texts they match best, and the style that scores highest.

    Texts (the yardstick) and styles are small fixed sets of (vec_id, embedding).
    """
    (ids, t), (style_ids, s) = whole(texts, block), whole(styles, block)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v = matrix(b.column(1))
            if not len(v):
                continue
            usual = v @ t.T
            level = levels(usual, usual)
            best = np.argsort(-level, axis=1, kind="stable")[:, :most]
            subjects = [[int(ids[j]) for j in row if level[i, j] >= 1.0] for i, row in enumerate(best)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(subjects, pa.list_(pa.int64())), pa.array(style_ids[np.argmax(v @ s.T, axis=1)])], names=["vec_id", "subjects", "style"])

    return queries.where("embedding is not null").select("vec_id", "embedding").mapInArrow(run, "vec_id long, subjects array<long>, style long")


def prompt_check(phrases: DataFrame, vectors: DataFrame, texts: DataFrame, yardstick: np.ndarray) -> DataFrame:
    """(id, phrase, level, seen) of (id, phrase, text_id): how well each row's picture shows each phrase of its prompt.

    Rows find their picture by id and phrases their text by text_id, both by equality.
    """
    both = phrases.join(vectors.select(F.col("vec_id").alias("id"), F.col("embedding").alias("v")), "id").join(texts.select(F.col("vec_id").alias("text_id"), F.col("embedding").alias("t")), "text_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                v = matrix(b.column(2))
                level = levels((v * matrix(b.column(3))).sum(axis=1, keepdims=True), v @ yardstick.T)[:, 0]
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(level)], names=["id", "phrase", "level"])

    return both.select("id", "phrase", "v", "t").mapInArrow(run, "id long, phrase string, level double").withColumn("seen", F.col("level") >= 1.0)


def keyed(vectors: DataFrame, files: DataFrame, key: Column) -> DataFrame:
    """Vectors of files by their content key, so a file that changed since has none."""
    return files.withColumn("key", key).join(vectors.select("key", "embedding"), "key", "left")


def status(files: DataFrame) -> DataFrame:
    """One row: how many files have a vector, of how many."""
    return files.agg(F.count_if(F.col("embedding").isNotNull()).alias("embedded"), F.count("*").alias("total"))


def best_of(members: DataFrame, group: str) -> DataFrame:
    """The best member of each group, with its score and why: rated, kept, likely, seen, checked, sharpest.

    `members` has the group, id, rating, flag, likely (stars a model gives), seen and checked (phrases) and sharpness, null where
    unknown, and any further columns. Own stars count more than guessed ones; what is unknown takes the group's mean; rejected
    members come last; of equals the smallest id is ahead. Means and maxima are partial sums, joined to the members, so
    no group is sorted in one task.
    """
    stars = F.coalesce(F.when(F.col("rating") > 0, F.col("rating").cast("double")), F.col("likely").cast("double"))
    own = members.withColumn("_star", (stars - 1) / 4).withColumn("_shown", F.when(F.col("checked") > 0, F.col("seen") / F.col("checked")))
    usual = own.groupBy(group).agg(F.avg("_star").alias("_star_mean"), F.avg("_shown").alias("_shown_mean"), F.max("sharpness").alias("_sharpest"), F.count("sharpness").alias("_n"))
    both = own.join(usual, group)
    sharp = F.when(F.col("sharpness").isNotNull() & (F.col("_sharpest") > 0), F.col("sharpness") / F.col("_sharpest")).otherwise(0.5)
    trust = F.when(F.col("rating") > 0, 0.8).otherwise(0.55)
    points = trust * F.coalesce("_star", "_star_mean", F.lit(0.5)) + 0.3 * F.coalesce("_shown", "_shown_mean", F.lit(0.5)) + 0.15 * sharp + F.when(F.col("flag") == 1, 0.5).otherwise(0.0)
    score = F.round(F.when(F.col("flag") == 2, F.lit(float("-inf"))).otherwise(points), 9)  # sums in any order give one score
    why = [
        F.when(F.col("rating") > 0, F.col("rating")).alias("rated"),
        (F.col("flag") == 1).alias("kept"),
        F.when(~(F.col("rating") > 0), F.round("likely", 1)).alias("likely"),
        F.col("seen").alias("seen"),
        F.col("checked").alias("checked"),
        F.coalesce((F.col("_n") > 1) & (F.col("sharpness") == F.col("_sharpest")), F.lit(False)).alias("sharpest"),
    ]
    scored = both.select(*members.columns, score.alias("_score"), F.struct(*why).alias("why"))
    whole = F.struct(*[F.col(c) for c in members.columns], F.col("_score").alias("score"), "why")
    return scored.groupBy(F.col(group).alias("_group")).agg(F.max_by(whole, F.struct("_score", (-F.col("id")).alias("i"))).alias("_best")).select("_best.*")


# Phrases of a group that a picture clearly and half shows, from which level on half, and what a phrase of the user's is ahead by.
CLEAR_MOST, HALF_MOST, LIGHT_MOST, HALF, OWN = 3, 2, 2, 0.6, 0.1


def _bare(phrase: str) -> str:
    for article in ("a ", "an ", "the "):
        while phrase.startswith(article):
            phrase = phrase[len(article) :]
    return phrase


def picked(scored: list[tuple[float, str]], clear: int, half: int, taken: list[str]) -> list[tuple[str, float, bool]]:
    """Of (level, phrase) the best that say something new: `clear` of level 1 or more, `half` of level HALF or more; none that holds, or is held by, one that is taken."""
    out, n, m = [], 0, 0
    for level, phrase in sorted(scored, key=lambda x: -x[0]):
        key = _bare(phrase)
        if any(t in key or key in t for t in taken):
            continue
        if level >= 1.0 and n < clear:
            n += 1
        elif level >= HALF and m < half:
            m += 1
        else:
            continue
        taken.append(key)
        out.append((phrase, level, level >= 1.0))
        if n == clear and m == half:
            break
    return out


GROUPS = "array<struct<name:string,phrases:array<struct<text:string,level:double,clear:boolean>>>>"


def described_in_groups(queries: DataFrame, yardstick: DataFrame, groups: list[tuple[str, DataFrame]], own: DataFrame | None = None) -> DataFrame:
    """(vec_id, groups, prompt): phrases that describe each queried picture, group by group, and the clear ones as a prompt.

    Groups are small fixed sets of (vec_id, phrase, embedding), the first of them the subjects, to which `own` phrases of
    the user's are added, a little ahead; the yardstick is what levels are measured by. Batches of pictures are multiplied with all
    phrases at once; the choice in each group, which depends on what groups before it took, is made picture by picture.
    """

    def held(rows: DataFrame) -> tuple[list[str], np.ndarray]:
        ids, m = whole(rows)
        names = {r["vec_id"]: r["phrase"] for r in rows.where("embedding is not null").select("vec_id", "phrase").collect()}
        return [names[i] for i in ids.tolist()], m

    sets = [(name, *held(rows)) for name, rows in groups]
    listed = {p for _, phrases, _ in sets[1:] for p in phrases}
    mine, mine_m = held(own.where(~F.col("phrase").isin(*listed)) if listed else own) if own is not None else ([], np.zeros((0, 0)))
    usual_m = whole(yardstick)[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v = matrix(b.column(1))
            if not len(v):
                continue
            usual = v @ usual_m.T
            level = [levels(v @ m.T, usual) if len(m) else np.zeros((len(v), 0)) for *_, m in sets]
            more = levels(v @ mine_m.T, usual) + OWN if len(mine) else np.zeros((len(v), 0))
            told, prompts = [], []
            for i in range(len(v)):
                taken: list[str] = []
                found = []
                for k, (name, phrases, _) in enumerate(sets):
                    scored = list(zip(level[k][i].tolist(), phrases, strict=True))
                    if not k:
                        scored += zip(more[i].tolist(), mine, strict=True)
                    found.append((name, picked(scored, LIGHT_MOST if name == "light" else CLEAR_MOST, HALF_MOST + (not k), taken)))
                told.append([{"name": n, "phrases": [{"text": t, "level": round(x, 2), "clear": c} for t, x, c in p]} for n, p in found])
                prompts.append(", ".join(t for _, p in found for t, _, c in p if c))
            kind = pa.list_(pa.struct([("name", pa.string()), ("phrases", pa.list_(pa.struct([("text", pa.string()), ("level", pa.float64()), ("clear", pa.bool_())])))]))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(told, kind), pa.array(prompts, pa.string())], names=["vec_id", "groups", "prompt"])

    return queries.where("embedding is not null").select("vec_id", "embedding").mapInArrow(run, f"vec_id long, groups {GROUPS}, prompt string")
