"""Queries of vectors, near-duplicates, learned ranking and its evaluation, with their SQL.

Searches take every row whose id is divisible by 100 as a query, against all rows.
"""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .checkpoints import cut, shared_dir
from .functions import text as T
from .operators import duplicates, measures, taste, vectors, works
from .plans import search as S
from .registry import query
from .sources import vector_cells
from .sources.tables import MEDIA_SQL, media, table

#: Rows below this id are the yardstick.
YARDSTICK = 20


def _yardstick(spark: SparkSession, sf_dir: str) -> np.ndarray:
    rows = table(spark, sf_dir, "embeddings").where(F.col("vec_id") < YARDSTICK)
    found = vectors.whole(rows)[1]
    return found if len(found) else np.zeros((1, 64))


def _queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").where("vec_id % 100 = 0")


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Media rows with their vector, where they have one."""
    own = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding", "label")
    return media(spark, sf_dir).join(own, "id", "left")


_PAIRS = "p AS (SELECT q.vec_id AS query_id, v.vec_id, v.label, list_inner_product(CAST(q.embedding AS DOUBLE[]), CAST(v.embedding AS DOUBLE[])) AS score FROM embeddings q, embeddings v WHERE q.vec_id % 100 = 0)"
_USUAL = f"""ys AS (SELECT v.vec_id, list_sort(list(list_inner_product(CAST(v.embedding AS DOUBLE[]), CAST(y.embedding AS DOUBLE[])))) AS l FROM embeddings v, embeddings y WHERE y.vec_id < {YARDSTICK} GROUP BY v.vec_id),
us AS (SELECT vec_id, l[len(l) // 2 + 1] AS middle, 1.4826 * list_sort(list_transform(l, lambda x: abs(x - l[len(l) // 2 + 1])))[len(l) // 2 + 1] AS spread FROM ys)"""
_LEVEL = "CASE WHEN spread > 0 THEN (score - middle) / spread / 1.5 ELSE 0 END"


@query(f"WITH {_PAIRS}, {_USUAL} SELECT query_id, vec_id, round({_LEVEL}, 6) AS level FROM p JOIN us USING (vec_id) WHERE {_LEVEL} >= 1.0")
def vector_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that match a query more than they match the yardstick."""
    found = vectors.match(table(spark, sf_dir, "embeddings"), _queries(spark, sf_dir), _yardstick(spark, sf_dir))
    return found.select("query_id", "vec_id", F.round("score", 6).alias("level"))


@query(f"WITH {_PAIRS}, r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS place FROM p) SELECT query_id, vec_id, round(score, 6) AS score FROM r WHERE score >= 0.4 OR (place <= 12 AND score >= 0.1)")
def similar_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """More like each of these."""
    return vectors.similar(table(spark, sf_dir, "embeddings"), _queries(spark, sf_dir), 0.4, 0.1).select("query_id", "vec_id", F.round("score", 6).alias("score"))


@query(f"WITH {_PAIRS}, r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS place FROM p) SELECT query_id, vec_id, round(score, 6) AS score, place FROM r WHERE place <= 12")
def nearest_by_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest rows of each query from vectors filed by cells; cells that can't hold one aren't read."""
    rows, root = table(spark, sf_dir, "embeddings"), f"{shared_dir(spark)}/cells-{uuid.uuid4().hex}"
    vector_cells.build(rows, root, 32)
    found = vector_cells.search(spark, root, _queries(spark, sf_dir), 12, 4, exact=True)
    return found.select("query_id", "vec_id", F.round("score", 6).alias("score"), F.col("place").cast("long").alias("place"))


@query(f"WITH {_PAIRS}, r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS place, max(score) OVER (PARTITION BY query_id) AS top FROM p), w AS (SELECT query_id, label, exp(-40.0 * (top - score)) AS w FROM r WHERE place <= 24) SELECT query_id, round(sum(w * label) / sum(w), 6) AS value, count(*) AS n FROM w GROUP BY query_id")
def neighbours_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V5: what the nearest rows say, the nearer the more."""
    return vectors.neighbours_mean(table(spark, sf_dir, "embeddings"), _queries(spark, sf_dir), "label").select("query_id", F.round("value", 6).alias("value"), "n")


@query(f"WITH p AS (SELECT q.vec_id AS query_id, v.vec_id, list_inner_product(CAST(q.embedding AS DOUBLE[]), CAST(v.embedding AS DOUBLE[])) AS score FROM embeddings q, embeddings v WHERE q.vec_id < {YARDSTICK}), {_USUAL} SELECT query_id, vec_id, round({_LEVEL}, 6) AS level FROM p JOIN us USING (vec_id)")
def phrase_fits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V4, V6: how well every row fits every text of the yardstick."""
    rows = table(spark, sf_dir, "embeddings")
    return vectors.fits(rows, rows.where(F.col("vec_id") < YARDSTICK), _yardstick(spark, sf_dir)).select("query_id", "vec_id", F.round("score", 6).alias("level"))


@query(
    f"""WITH q AS (SELECT * FROM embeddings WHERE vec_id % 100 = 0), p AS (SELECT q.vec_id, y.vec_id AS t, list_inner_product(CAST(q.embedding AS DOUBLE[]), CAST(y.embedding AS DOUBLE[])) AS score FROM q, embeddings y WHERE y.vec_id < 60), {_USUAL.replace(f'y.vec_id < {YARDSTICK}', 'y.vec_id < 60')},
l AS (SELECT vec_id, t, {_LEVEL} AS level, score FROM p JOIN us USING (vec_id)), s AS (SELECT vec_id, list(t ORDER BY level DESC, t)[1:8] AS ts FROM l WHERE level >= 1 GROUP BY vec_id),
st AS (SELECT q.vec_id, arg_max(y.vec_id, list_inner_product(CAST(q.embedding AS DOUBLE[]), CAST(y.embedding AS DOUBLE[]))) AS style FROM q, embeddings y WHERE y.vec_id BETWEEN 100 AND 119 GROUP BY q.vec_id)
SELECT q.vec_id, coalesce(array_to_string(list_transform(ts, lambda x: CAST(x AS VARCHAR)), ','), '') AS subjects, style FROM q LEFT JOIN s USING (vec_id) LEFT JOIN st USING (vec_id)"""
)
def described(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V7: the texts that rows match best, and their style."""
    rows = table(spark, sf_dir, "embeddings")
    out = vectors.described(rows, _queries(spark, sf_dir), rows.where("vec_id < 60"), rows.where("vec_id between 100 and 119"))
    return out.select("vec_id", F.array_join(F.transform("subjects", lambda x: x.cast("string")), ",").alias("subjects"), "style")


@query(
    f"""WITH e AS (SELECT v.vec_id AS id, (v.vec_id * 7) % (SELECT count(*) FROM embeddings) AS t, list_inner_product(CAST(v.embedding AS DOUBLE[]), CAST(y.embedding AS DOUBLE[])) AS score FROM embeddings v JOIN embeddings y ON y.vec_id = (v.vec_id * 7) % (SELECT count(*) FROM embeddings)), {_USUAL}
SELECT id, 'phrase ' || t AS phrase, round({_LEVEL}, 6) AS level, {_LEVEL} >= 1.0 AS seen FROM e JOIN us ON us.vec_id = e.id"""
)
def prompt_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V9, V4: how well each row's picture shows each phrase of its prompt."""
    rows = table(spark, sf_dir, "embeddings")
    n = rows.count()
    text = (F.col("vec_id") * 7) % n
    phrases = rows.select(F.col("vec_id").alias("id"), F.concat(F.lit("phrase "), text).alias("phrase"), text.alias("text_id"))
    return vectors.prompt_check(phrases, rows, rows, _yardstick(spark, sf_dir)).select("id", "phrase", F.round("level", 6).alias("level"), "seen")


@query(f"WITH {MEDIA_SQL} SELECT count(*) FILTER (WHERE v.vec_id IS NOT NULL) AS embedded, count(*) AS total FROM media m LEFT JOIN embeddings v ON v.vec_id = m.id AND m.id % 3 <> 0")
def embedding_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors found by content key; files that changed since have none."""
    path = F.concat("dir", F.lit("/"), "name")
    rows = media(spark, sf_dir)
    stored = _files(spark, sf_dir).where("embedding is not null").select(T.content_key(path, F.col("mtime"), F.col("size")).alias("key"), "embedding")
    now = rows.withColumn("size", F.when(F.col("id") % 3 == 0, F.col("size") + 1).otherwise(F.col("size")))
    return vectors.status(vectors.keyed(stored, now, T.content_key(path, F.col("mtime"), F.col("size"))))


# ---- near-duplicates

_BIT = lambda step: " + ".join(f"CASE WHEN embedding[{i + 1}] > embedding[{(i + step) % 64 + 1}] THEN {1 << i}::BIGINT ELSE 0 END" for i in range(63))
_CH = lambda k: f"CAST(greatest(0, least(255, floor(128 + 200 * CAST(embedding[{k + 1}] AS DOUBLE)))) AS INTEGER)"
#: Planted copies differ in so many bits, spread over both hashes one to five bits apart.
_FLIP = lambda n, shift: sum(1 << (5 * k + shift) for k in range(n))
_PLANTS = [(10_000_000, 6, 6, 0), (20_000_000, 7, 6, 0), (30_000_000, 2, 1, 24), (40_000_000, 0, 0, 25)]
_COPY = " UNION ALL ".join(
    f"SELECT id + {far}, xor(across, {_FLIP(a, 1)}::BIGINT), xor(down, {_FLIP(d, 2)}::BIGINT), CASE WHEN r > 128 THEN r - {c} ELSE r + {c} END, g, b, width, height FROM o WHERE id % {7 + k} = 0" for k, (far, a, d, c) in enumerate(_PLANTS)
)
_PRINTS = f"o AS (SELECT vec_id AS id, {_BIT(1)} AS across, {_BIT(9)} AS down, {_CH(0)} AS r, {_CH(1)} AS g, {_CH(2)} AS b, CAST(512 + 64 * (vec_id % 2) AS INTEGER) AS width, CAST(512 + 64 * (vec_id % 3) AS INTEGER) AS height FROM embeddings), f AS (SELECT * FROM o UNION ALL {_COPY})"
_NEAR = "bit_count(xor(a.across, b.across)) + bit_count(xor(a.down, b.down)) <= 12 AND abs(a.r - b.r) <= 24 AND abs(a.g - b.g) <= 24 AND abs(a.b - b.b) <= 24 AND greatest(a.width / a.height, b.width / b.height) <= least(a.width / a.height, b.width / b.height) * 1.02"
_GROUPS = f"{_PRINTS}, l AS (SELECT a.id AS u, b.id AS v FROM f a, f b WHERE {_NEAR}), t AS (SELECT id AS node, id AS root FROM f UNION SELECT l.v AS node, t.root FROM t JOIN l ON l.u = t.node), g AS (SELECT node AS id, min(root) AS group_id FROM t GROUP BY node), gs AS (SELECT *, count(*) OVER (PARTITION BY group_id) AS members FROM g QUALIFY count(*) OVER (PARTITION BY group_id) > 1)"


def _planted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of the vectors, and copies of some at and just beyond the greatest distances."""
    own = cut(duplicates.fingerprints(table(spark, sf_dir, "embeddings")))  # as from a table of fingerprints
    out = own
    for k, (far, a, d, c) in enumerate(_PLANTS):
        red = F.when(F.col("r") > 128, F.col("r") - c).otherwise(F.col("r") + c)
        some = own.where(F.col("id") % (7 + k) == 0)
        out = out.unionByName(some.withColumns({"id": F.col("id") + far, "across": F.col("across").bitwiseXOR(F.lit(_FLIP(a, 1)).cast("long")), "down": F.col("down").bitwiseXOR(F.lit(_FLIP(d, 2)).cast("long")), "r": red.cast("int")}))
    return out


@query(f"WITH RECURSIVE {_GROUPS} SELECT id, group_id, members FROM gs")
def duplicate_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of near-duplicate pictures, by bits, colours and shape."""
    return duplicates.groups(_planted(spark, sf_dir))


@query(f"WITH RECURSIVE {MEDIA_SQL}, {_GROUPS} SELECT m.id, m.name FROM media m WHERE m.rating >= 2 AND m.id IN (SELECT id FROM gs)")
def search_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of a search that are in a group of near-duplicates."""
    rows = S.Search([S.rated(2)]).rows(media(spark, sf_dir))
    return S.duplicates(duplicates.groups(_planted(spark, sf_dir)), rows).select("id", "name")


_MEMBER = "id % 6 AS rating, id % 4 % 3 AS flag, CASE WHEN id % 3 = 0 THEN 1.0::DOUBLE + id % 4 END AS likely, CASE WHEN id % 4 <> 0 THEN id % 6 END AS seen, CASE WHEN id % 4 <> 0 THEN 6 END AS checked, CASE WHEN id % 5 <> 0 THEN (id % 17)::DOUBLE END AS sharpness"


def _best_sql(rows: str, group: str) -> str:
    """Steps h to z: members, what is known of their group, their score, and why."""
    return f"""h AS ({rows}), hs AS (SELECT *, CASE WHEN rating > 0 THEN rating::DOUBLE ELSE likely END AS stars, CASE WHEN checked > 0 THEN seen / checked::DOUBLE END AS adh FROM h),
m AS (SELECT *, coalesce((stars - 1) / 4, avg((stars - 1) / 4) OVER w, 0.5) AS s, coalesce(adh, avg(adh) OVER w, 0.5) AS a, CASE WHEN sharpness IS NOT NULL AND max(sharpness) OVER w > 0 THEN sharpness / max(sharpness) OVER w ELSE 0.5 END AS sharp,
 coalesce(count(sharpness) OVER w > 1 AND sharpness = max(sharpness) OVER w, false) AS sharpest FROM hs WINDOW w AS (PARTITION BY {group})),
z AS (SELECT *, round(CASE WHEN flag = 2 THEN '-inf'::DOUBLE ELSE CASE WHEN rating > 0 THEN 0.8::DOUBLE ELSE 0.55::DOUBLE END * s + 0.3::DOUBLE * a + 0.15::DOUBLE * sharp + CASE WHEN flag = 1 THEN 0.5 ELSE 0 END END, 9) AS score,
 concat_ws(' ', CASE WHEN rating > 0 THEN 'rated ' || rating END, CASE WHEN flag = 1 THEN 'kept' END, CASE WHEN NOT rating > 0 THEN 'likely ' || likely END, 'seen ' || seen || ' of ' || checked, CASE WHEN sharpest THEN 'sharpest' END) AS why FROM m)"""


def _members(rows: DataFrame, rating: bool = True) -> DataFrame:
    """Rows with what is known of them as pictures: stars, a flag, guessed stars, phrases seen, sharpness."""
    i = F.col("id")
    out = rows.withColumns({"rating": i % 6, "flag": i % 4 % 3}) if rating else rows
    known = {"likely": F.when(i % 3 == 0, 1.0 + i % 4), "seen": F.when(i % 4 != 0, i % 6), "checked": F.when(i % 4 != 0, F.lit(6)), "sharpness": F.when(i % 5 != 0, (i % 17).cast("double"))}
    return out.withColumns(known)


def _why(why: Column) -> Column:
    told = lambda name, c: F.concat(F.lit(name), c.cast("string"))
    return F.concat_ws(" ", told("rated ", why["rated"]), F.when(why["kept"], "kept"), told("likely ", why["likely"]), F.concat(told("seen ", why["seen"]), told(" of ", why["checked"])), F.when(why["sharpest"], "sharpest"))


@query(f"WITH RECURSIVE {_GROUPS}, {_best_sql(f'SELECT id, group_id, {_MEMBER} FROM gs', 'group_id')}, b AS (SELECT *, row_number() OVER (PARTITION BY group_id ORDER BY score DESC, id) = 1 AS best FROM z) SELECT id, group_id, best, CASE WHEN best THEN why END AS why FROM b")
def duplicate_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best of each group and why, and all the others."""
    found = cut(duplicates.groups(_planted(spark, sf_dir)))
    out = duplicates.report(found, _members(found.select("id")))
    return out.select("id", "group_id", "best", F.when(F.col("best"), _why(F.col("why"))).alias("why"))


@query(f"WITH {MEDIA_SQL}, g AS (SELECT id, min(id) OVER () AS group_id FROM media WHERE id % 50 = 3), {_best_sql(f'SELECT id, group_id, {_MEMBER} FROM g', 'group_id')} SELECT group_id, id, (SELECT count(*) FROM g) AS members, why FROM (SELECT *, row_number() OVER (ORDER BY score DESC, id) AS k FROM z) WHERE k = 1")
def best_of_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A given list of rows as one group, its best, and why."""
    ids = media(spark, sf_dir).where("id % 50 = 3").select("id")
    out = duplicates.report(duplicates.given(ids), _members(ids)).where("best")
    return out.select("group_id", "id", "members", _why(F.col("why")).alias("why"))


_FOLDER = "SELECT id, dir, size, flag, rating, CASE WHEN id % 3 = 0 THEN 1.0::DOUBLE + id % 4 END AS likely, CASE WHEN id % 4 <> 0 THEN id % 6 END AS seen, CASE WHEN id % 4 <> 0 THEN 6 END AS checked, CASE WHEN id % 5 <> 0 THEN (id % 17)::DOUBLE END AS sharpness FROM media"


@query(f"WITH {MEDIA_SQL}, {_best_sql(_FOLDER, 'dir')} SELECT dir, id, size, why FROM (SELECT *, row_number() OVER (PARTITION BY dir ORDER BY score DESC, id) AS k FROM z) WHERE k = 1")
def best_of_folder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best row of each folder and why: own or guessed stars, phrases seen, sharpness and the keep flag."""
    rows = _members(media(spark, sf_dir).select("id", "dir", "size", "flag", "rating"), False)
    return vectors.best_of(rows, "dir").select("dir", "id", "size", _why(F.col("why")).alias("why"))


# ---- learned ranking


@query()
def taste_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """L2-L4, F16, O3: learned scores of all rows, verdicts on those without a judgement, in order of score."""
    rows = _files(spark, sf_dir)
    found = taste.scored(rows, taste.fit(rows)).select("id", "mtime", "name", F.round("taste", 6).alias("taste"), "verdict")
    return found.orderBy(*S.ORDERS["taste"](), "id").select("id", "taste", "verdict")


_AUC = "SELECT (count(*) FILTER (WHERE a.s > b.s) + count(*) FILTER (WHERE a.s = b.s) / 2.0) / count(*)"


_TARGET = "CASE WHEN flag = 2 THEN 0.0 WHEN rating <= 0 AND flag = 1 THEN 0.85 WHEN rating <= 0 THEN NULL WHEN flag = 1 THEN greatest((rating - 1) / 4.0, 0.85) ELSE (rating - 1) / 4.0 END"


@query(f"WITH {MEDIA_SQL}, m AS (SELECT id, (id * 37 % 101) // 3 AS s, ({_TARGET}) AS t FROM media), g AS (SELECT s FROM m WHERE t >= 0.74), d AS (SELECT s FROM m WHERE t <= 0.26) SELECT round(({_AUC} FROM g a, d b), 9) AS auc, (SELECT count(*) FROM g) AS good, (SELECT count(*) FROM d) AS bad")
def agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often a score puts liked rows above disliked ones, ties half."""
    rows = media(spark, sf_dir).withColumn("t", works.target(F.col("rating"), F.col("flag"))).where((F.col("t") >= works.LIKED) | (F.col("t") <= works.DISLIKED))
    found = taste.auc(rows.select(F.floor((F.col("id") * 37 % 101) / 3).alias("s"), (F.col("t") >= works.LIKED).alias("good")), "s", "good")
    return found.select(F.round("auc", 9).alias("auc"), F.col("good").cast("long").alias("good"), F.col("bad").cast("long").alias("bad"))


_Y = f"sc AS (SELECT v.vec_id, y.vec_id AS t, list_inner_product(CAST(v.embedding AS DOUBLE[]), CAST(y.embedding AS DOUBLE[])) AS score FROM embeddings v, embeddings y WHERE y.vec_id < {YARDSTICK})"


@query(
    f"""WITH {_Y}, ls AS (SELECT vec_id, list_sort(list(score)) AS l FROM sc GROUP BY vec_id), m AS (SELECT *, l[len(l) // 2 + 1] AS middle, l[len(l) // 4 + 1] AS quarter FROM ls),
x AS (SELECT vec_id, t, score, l, middle, greatest(1e-9, 1.4826 * list_sort(list_transform(l, lambda z: abs(z - middle)))[len(l) // 2 + 1]) AS spread, greatest(1e-9, (middle - quarter) / 0.6745) AS lower FROM sc JOIN m USING (vec_id))
SELECT vec_id, t AS text_id, round((score - middle) / spread, 6) + 0.0::DOUBLE AS spreads, round((score - middle) / lower, 6) + 0.0::DOUBLE AS lower_spreads, round(len(list_filter(l, lambda z: z < score)) / greatest(1, len(l) - 1), 6) AS share, round((100 * (score - l[-1]) - ln(list_sum(list_transform(l, lambda z: exp(100 * (z - l[-1])))))) / ln(10), 6) + 0.0::DOUBLE AS odds FROM x"""
)
def score_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ways to say how much a score stands out among a row's scores."""
    rows = table(spark, sf_dir, "embeddings")
    out = measures.measured(rows, rows.where(F.col("vec_id") < YARDSTICK))
    return out.select("vec_id", "text_id", *[F.round(c, 6).alias(c) for c in ("spreads", "lower_spreads", "share", "odds")])


@query(
    f"""WITH {_Y}, {_USUAL}, lv AS (SELECT vec_id, t, (score - middle) / greatest(spread, 1e-9) AS level, (vec_id + t) % 10 = 0 AS told FROM sc JOIN us USING (vec_id)),
c AS (SELECT a.t, count(*) AS n, sum(CASE WHEN a.level > b.level THEN 1.0 WHEN a.level = b.level THEN 0.5 ELSE 0 END) AS w FROM lv a JOIN lv b ON a.t = b.t WHERE a.told AND NOT b.told GROUP BY a.t)
SELECT t AS text_id, round(w / n, 6) AS auc, (SELECT count(*) FROM lv WHERE lv.t = c.t AND told) AS told FROM c"""
)
def text_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each text, how well its levels tell rows that it is said of from others."""
    rows = table(spark, sf_dir, "embeddings")
    out = measures.measured(rows, rows.where(F.col("vec_id") < YARDSTICK)).withColumn("told", (F.col("vec_id") + F.col("text_id")) % 10 == 0)
    return measures.text_auc(out, "spreads", "told").select("text_id", F.round("auc", 6).alias("auc"), "told")


_LEAK = 0.1


@query(
    f"""WITH {_Y}, {_USUAL}, lv AS (SELECT vec_id, t, round((score - middle) / greatest(spread, 1e-9), 6) AS level, t % 4 <> 3 AND (vec_id + t) % 10 = 0 AS told FROM sc JOIN us USING (vec_id)),
loud AS (SELECT DISTINCT t FROM lv WHERE told), c AS (SELECT a.t, avg(CASE WHEN a.level > b.level THEN 1.0 WHEN a.level = b.level THEN 0.5 ELSE 0 END) AS auc, count(DISTINCT a.vec_id) AS told FROM lv a JOIN lv b ON a.t = b.t WHERE a.told AND NOT b.told GROUP BY a.t),
q AS (SELECT t, list_sort(list(level))[-(CAST(floor(count(*) * {_LEAK}::DOUBLE) AS BIGINT) + 1)] AS bar FROM lv WHERE t NOT IN (SELECT t FROM loud) GROUP BY t), bar AS (SELECT list_sort(list(bar))[count(*) // 2 + 1] AS bar FROM q)
SELECT (SELECT count(*) FROM c) AS texts, round((SELECT list_sort(list(auc))[count(*) // 2 + 1] FROM c), 6) AS middle_auc, round((SELECT sum(auc * told) / sum(told) FROM c), 6) AS weighted_auc, bar.bar AS bar,
 round(avg(CASE WHEN told THEN CAST(level > bar.bar AS INT) END), 6) AS recall, round(avg(CASE WHEN NOT told THEN CAST(level > bar.bar AS INT) END), 6) AS leaked FROM lv, bar WHERE t IN (SELECT t FROM loud) GROUP BY bar.bar"""
)
def measure_evaluation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How well levels tell what texts are said of, the bar at which a text that is said of nothing leaks a tenth, and the recall there."""
    rows = table(spark, sf_dir, "embeddings")
    told = (F.col("text_id") % 4 != 3) & ((F.col("vec_id") + F.col("text_id")) % 10 == 0)
    out = cut(measures.measured(rows, rows.where(F.col("vec_id") < YARDSTICK)).select("text_id", F.round("spreads", 6).alias("level"), told.alias("told")))
    found = measures.evaluation(out, "level", "told", _LEAK)
    return found.select("texts", *[F.round(c, 6).alias(c) for c in ("middle_auc", "weighted_auc", "bar", "recall", "leaked")])


@query()
def described_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V8: phrases that describe pictures, in groups with quotas, none of which says what another says."""
    rows, part = table(spark, sf_dir, "embeddings"), table(spark, sf_dir, "part").select((F.col("p_partkey") - 1).alias("vec_id"), F.concat(F.when(F.col("p_partkey") % 3 == 0, "a ").otherwise(""), F.lower("p_type")).alias("phrase"))
    texts = rows.join(part, "vec_id").select("vec_id", "phrase", "embedding")
    group = lambda a, b: texts.where(F.col("vec_id").between(a, b))
    named = [("subject", group(0, 59)), ("setting", group(60, 89)), ("style", group(90, 119)), ("light", group(120, 139))]
    out = vectors.described_in_groups(_queries(spark, sf_dir), rows.where(F.col("vec_id") < 60), named, group(140, 159))
    told = F.transform("groups", lambda g: F.concat(g["name"], F.lit(":"), F.array_join(F.transform(g["phrases"], lambda p: F.concat(p["text"], F.when(p["clear"], "+").otherwise("-"))), "/")))
    return out.select("vec_id", F.array_join(told, ";").alias("groups"), "prompt")
