"""Queries of usage, contrasts, notes, levels and reports, with their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .checkpoints import cut, shared_dir
from .functions import facets as FA
from .functions import text as T
from .operators import audience, spelling, tables, usage, works
from .registry import query
from .sources import store
from .sources.tables import MEDIA_SQL, media, table

_TAG = "<[A-Za-z]{1,15}:[^>]*>"
_LIST = lambda words: "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + "]"
_WORDS = f"list_filter(list_distinct(regexp_extract_all(regexp_replace(prompt, '{_TAG}', ' ', 'g'), '[\\p{{L}}\\p{{N}}]{{3,}}')), lambda w: regexp_matches(w, '\\p{{L}}') AND NOT list_contains({_LIST(T.FILLER)}, w))"
_SAME = "trim(regexp_replace(replace(prompt, '\"', ''), '\\s+', ' ', 'g'))"
_SLOTS = " || ',' || ".join(f"count(*) FILTER (WHERE slot = {k})" for k in range(24))
_PAIR = lambda kind, key, value: f"{{'kind': '{kind}', 'key': {key}, 'value': {value}, 'role': ''}}"


@query(
    f"""WITH {MEDIA_SQL}, span AS (SELECT min(mtime) AS a, max(mtime) AS b FROM media),
e AS (SELECT id, mtime, rating, flag, least(23, (mtime - a) * 24 // (b - a + 1)) AS slot, unnest(list_concat(list_filter(facets, lambda f: f.kind <> 'loraw'), list_transform({_WORDS}, lambda x: {_PAIR('word', 'x', 'x')}),
 CASE WHEN {_SAME} <> '' THEN [{_PAIR('prompt', f'sha256({_SAME})', _SAME)}] ELSE [] END, [{_PAIR('rating', 'CAST(rating AS VARCHAR)', 'CAST(rating AS VARCHAR)')}],
 CASE WHEN flag > 0 THEN [{_PAIR('flag', "CASE flag WHEN 1 THEN 'keep' ELSE 'reject' END", "CASE flag WHEN 1 THEN 'keep' ELSE 'reject' END")}] ELSE [] END, list_transform(collections, lambda c: {_PAIR('collection', 'lower(c)', 'c')}))) AS p FROM media, span),
t AS (SELECT p.kind AS kind, p.key AS key, arg_max(p.value, mtime) AS value, arg_max(p.role, mtime) AS role, count(*) AS uses, count(*) FILTER (WHERE rating > 0) AS rated, CAST(sum(rating) AS BIGINT) AS stars, count(*) FILTER (WHERE flag = 1) AS keeps, count(*) FILTER (WHERE flag = 2) AS rejects, {_SLOTS} AS trend,
 coalesce(array_to_string(list_transform((list(id ORDER BY rating DESC, mtime DESC) FILTER (WHERE flag <> 2 AND p.kind IN ('model', 'lora', 'aux')))[1:3], lambda x: CAST(x AS VARCHAR)), ','), '') AS samples FROM e GROUP BY 1, 2),
r AS (SELECT *, count(*) OVER (PARTITION BY kind) AS distinct_keys, row_number() OVER (PARTITION BY kind ORDER BY uses DESC, value, key) AS place FROM t)
SELECT * FROM r WHERE place <= CASE kind WHEN 'word' THEN 60 WHEN 'prompt' THEN 50 WHEN 'rating' THEN 6 WHEN 'flag' THEN 2 ELSE 100 END"""
)
def usage_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tallies, trends, samples and top values of all kinds."""
    return usage.usage(media(spark, sf_dir))


@query(f"WITH {MEDIA_SQL} SELECT count(*) AS total, count(*) FILTER (WHERE source <> '') AS generated, count(*) FILTER (WHERE rating > 0 OR flag > 0) AS judged, min(mtime) AS first_ms, max(mtime) AS last_ms FROM media")
def usage_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows, generated and judged ones, first and last time."""
    return usage.totals(media(spark, sf_dir))


@query(f"WITH {MEDIA_SQL}, e AS (SELECT rating, flag, unnest(facets) AS f FROM media WHERE rating > 0), t AS (SELECT f.kind AS kind, f.key AS key, count(*) AS rated, CAST(sum(rating) AS BIGINT) AS stars, count(*) FILTER (WHERE flag = 1) AS keeps FROM e WHERE f.kind IN ('model', 'lora', 'aux') GROUP BY 1, 2) SELECT kind, key, rated, keeps, round(average, 6) AS average, place FROM (SELECT *, stars / rated AS average, row_number() OVER (PARTITION BY kind ORDER BY stars / rated DESC, rated DESC, key) AS place FROM t) WHERE place <= 10")
def best_rated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Models and LoRAs by average stars."""
    return usage.best_rated(media(spark, sf_dir)).select("kind", "key", "rated", "keeps", F.round("average", 6).alias("average"), F.col("place").cast("long").alias("place"))


_STEP = "CASE unit WHEN 'day' THEN INTERVAL 1 DAY WHEN 'week' THEN INTERVAL 7 DAY WHEN 'month' THEN INTERVAL 1 MONTH ELSE INTERVAL 1 YEAR END"


@query(
    f"""WITH {MEDIA_SQL}, d AS (SELECT CAST(to_timestamp(mtime / 1000) AT TIME ZONE 'UTC' AS DATE) AS day FROM media), s AS (SELECT min(day) AS a, max(day) AS b FROM d),
u AS (SELECT CASE WHEN b - a + 1 <= 45 THEN 'day' WHEN b - a + 1 <= 400 THEN 'week' WHEN b - a + 1 <= 1900 THEN 'month' ELSE 'year' END AS unit, a, b FROM s),
spine AS (SELECT unit, CAST(unnest(generate_series(CAST(date_trunc(unit, a) AS TIMESTAMP), CAST(b AS TIMESTAMP), {_STEP})) AS DATE) AS bucket FROM u),
c AS (SELECT CAST(date_trunc(unit, day) AS DATE) AS bucket, count(*) AS n FROM d, u GROUP BY 1)
SELECT spine.bucket, CAST(CAST(spine.bucket AS TIMESTAMP) + {_STEP} - INTERVAL 1 DAY AS DATE) AS last, unit, coalesce(n, 0) AS n FROM spine LEFT JOIN c USING (bucket)"""
)
def timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts over time without gaps, with the days of each bucket's search."""
    return usage.timeline(media(spark, sf_dir))


_VOC = lambda c: f"list_distinct(regexp_extract_all({c}, '[\\p{{L}}\\p{{N}}'']{{2,}}'))"


@query(f"WITH {MEDIA_SQL}, w AS (SELECT unnest(list_concat({_VOC('prompt')}, {_VOC('negative')})) AS word FROM media), c AS (SELECT word, count(*) AS n FROM w GROUP BY word HAVING count(*) >= 2) SELECT word, n FROM c ORDER BY n DESC, word LIMIT 20000")
def vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words by the prompts and negative prompts that use them."""
    return usage.vocabulary(media(spark, sf_dir))


@query(f"WITH {MEDIA_SQL}, e AS (SELECT id, unnest(collections) AS c FROM media) SELECT lower(c) AS key, min(c) AS name, count(DISTINCT id) AS members FROM e GROUP BY 1")
def collection_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Collections in any letter case, and their members."""
    return usage.collections(media(spark, sf_dir))


# ---- what works

_TARGET = "CASE WHEN flag = 2 THEN 0.0 WHEN rating <= 0 AND flag = 1 THEN 0.85 WHEN rating <= 0 THEN NULL WHEN flag = 1 THEN greatest((least(rating, 5) - 1) / 4.0, 0.85) ELSE (least(rating, 5) - 1) / 4.0 END"


def _phrases(col: str, upto: str = "[1:40]") -> str:
    t = f"replace(replace(regexp_replace({col}, '<[^>]*>', ',', 'g'), '<', ''), 'BREAK', ',')"
    kept = "\\()[]{}:_"
    for k, c in enumerate(kept):
        t = f"replace({t}, '\\{c}', chr({0xE000 + k}))"
    t = f"translate(regexp_replace(replace({t}, '\\', ''), ':[0-9. -]*[0-9][0-9. -]*', '', 'g'), '()[]{{}}_', '       ')"
    for k, c in enumerate(kept):
        t = f"replace({t}, chr({0xE000 + k}), '{c}')"
    edge = "[\\s\\-\"''!?*#/:+]+"
    pieces = f"list_filter(list_transform(string_split_regex({t}, '[,;.\\n\\r|]'), lambda p: regexp_replace(regexp_replace(p, '\\s+', ' ', 'g'), '^{edge}|{edge}$', '', 'g')), lambda p: regexp_matches(p, '\\p{{L}}') AND NOT starts_with(p, 'embedding'))"
    return f"(SELECT list_filter(l, lambda x, i: list_position(l, x) = i){upto} FROM (SELECT {pieces} AS l))"


def _bins(value: str, bins: tuple) -> str:
    return "CASE " + " ".join(f"WHEN {value} < {n} THEN '{x}'" for n, x in bins[:-1]) + f" ELSE '{bins[-1][1]}' END"


_QUALITY = lambda c: f"(len(list_filter(regexp_extract_all(lower({c}), '[^\\s_-]+'), lambda w: NOT (list_contains({_LIST(T.QUALITY)}, w) OR regexp_matches(w, '^[0-9]+$')))) = 0)"
_FIRST = lambda kind: f"list_filter(facets, lambda f: f.kind = '{kind}')[1].key"
_NUM = lambda x: f"regexp_replace(printf('%.6f', CAST({x} AS DOUBLE)), '\\.?0+$', '')"
_LOW = "floor(CAST(regexp_extract(f.key, '@([^@]*)$', 1) AS DOUBLE) / 0.2::DOUBLE) * 0.2::DOUBLE"
_SETTINGS = f"""list_concat([{{'kind': 'cfg', 'label': {_bins(f"CAST({_FIRST('cfg')} AS DOUBLE)", works.CFG_BINS)}}}, {{'kind': 'steps', 'label': {_bins(f"CAST({_FIRST('steps')} AS DOUBLE)", works.STEPS_BINS)}}}, {{'kind': 'sampler', 'label': 'Sampler ' || {_FIRST('sampler')}}}],
 list_transform(list_filter(facets, lambda f: f.kind = 'loraw'), lambda f: {{'kind': 'lora', 'label': regexp_extract(f.key, '^(.*)@[^@]*$', 1) || ' at ' || {_NUM(f'round({_LOW}, 2)')} || ' – ' || {_NUM(f'round({_LOW} + 0.2::DOUBLE, 2)')}}}))"""
_counts = lambda phrases: f"""j AS (SELECT id, prompt, facets, {_TARGET} AS target FROM media WHERE trim(prompt) <> '' AND ({_TARGET}) IS NOT NULL),
ph AS (SELECT id, prompt, {phrases} AS ps FROM media WHERE trim(prompt) <> ''),
n AS (SELECT count(*) FILTER (WHERE target >= 0.74) AS nl, count(*) FILTER (WHERE target <= 0.26) AS nd FROM j),
x AS (SELECT target, unnest(list_concat(list_transform(ps, lambda p: {{'kind': 'phrase', 'label': p}}), {_SETTINGS})) AS s FROM j JOIN ph USING (id)),
c AS (SELECT s.kind AS kind, s.label AS label, count(*) FILTER (WHERE target >= 0.74) AS liked, count(*) FILTER (WHERE target <= 0.26) AS disliked, count(*) AS judged FROM x GROUP BY 1, 2),
k AS (SELECT kind, label, liked, disliked, judged, CASE WHEN nl > 0 THEN liked::DOUBLE / nl ELSE 0.0 END AS keep, CASE WHEN nd > 0 THEN disliked::DOUBLE / nd ELSE 0.0 END AS reject FROM c, n)"""  # noqa: E731
_COUNTS = _counts(_phrases("prompt"))
_PART = lambda name, where, order: f"(SELECT '{name}' AS part, * FROM w WHERE {where} ORDER BY {order} LIMIT 10)"


@query(
    f"""WITH {MEDIA_SQL}, {_COUNTS}, w AS (SELECT *, keep - reject AS lift, (keep - reject) * sqrt(least(judged / 8.0::DOUBLE, 1.0)) AS weight FROM k WHERE judged >= 3),
u AS ({_PART('keep', f"kind = 'phrase' AND round(lift, 9) >= 0.05 AND NOT {_QUALITY('label')}", 'round(weight, 9) DESC, label')} UNION ALL {_PART('reject', "kind = 'phrase' AND round(lift, 9) <= -0.05", 'round(weight, 9), label DESC')} UNION ALL {_PART('settings', "kind <> 'phrase' AND abs(round(lift, 9)) >= 0.05", 'round(abs(weight), 9) DESC, label')})
SELECT part, kind, label, liked, disliked, judged, round(keep, 6) AS keep, round(reject, 6) AS reject, round(weight, 6) AS weight, judged < 8 AS few FROM u"""
)
def what_works(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Phrases and settings that liked and disliked rows differ in."""
    r = lambda c: F.round(c, 6).alias(c)
    return works.what_works(media(spark, sf_dir)).select("part", "kind", "label", "liked", "disliked", "judged", r("keep"), r("reject"), r("weight"), "few")


@query(
    f"""WITH {MEDIA_SQL}, {_COUNTS}, w AS (SELECT *, keep - reject AS lift, (keep - reject) * sqrt(least(judged / 8.0::DOUBLE, 1.0)) AS weight FROM k WHERE judged >= 3),
u AS ({_PART('keep', f"kind = 'phrase' AND round(lift, 9) >= 0.05 AND NOT {_QUALITY('label')}", 'round(weight, 9) DESC, label')} UNION ALL {_PART('reject', "kind = 'phrase' AND round(lift, 9) <= -0.05", 'round(weight, 9), label DESC')} UNION ALL {_PART('settings', "kind <> 'phrase' AND abs(round(lift, 9)) >= 0.05", 'round(abs(weight), 9) DESC, label')}),
e AS (SELECT id, mtime, target, unnest(list_concat(list_transform(ps, lambda p: {{'kind': 'phrase', 'label': p}}), {_SETTINGS})) AS s FROM (SELECT j.*, m.mtime, ph.ps FROM j JOIN media m USING (id) JOIN ph USING (id)))
SELECT kind, label, coalesce(array_to_string((list(id ORDER BY target DESC, mtime DESC) FILTER (WHERE target >= 0.74))[1:3], ','), '') AS liked, coalesce(array_to_string((list(id ORDER BY target, mtime DESC) FILTER (WHERE target <= 0.26))[1:3], ','), '') AS disliked
FROM (SELECT DISTINCT id, mtime, target, s.kind AS kind, s.label AS label FROM e) WHERE (kind, label) IN (SELECT (kind, label) FROM u) AND (target >= 0.74 OR target <= 0.26) GROUP BY 1, 2"""
)
def works_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best liked and worst disliked rows of what works."""
    rows = media(spark, sf_dir)
    out = works.examples(rows, works.what_works(rows))
    told = lambda c: F.coalesce(F.array_join(F.transform(c, lambda x: x.cast("string")), ","), F.lit("")).alias(c)
    return out.select("kind", "label", told("liked"), told("disliked"))


@query(f"WITH {MEDIA_SQL}, e AS (SELECT DISTINCT unnest({_phrases('prompt || CASE id % 5 WHEN 0 THEN \', soft lighting, oil_painting 8k\' WHEN 1 THEN \', best close-up portrait, art by x\' WHEN 2 THEN \', golden hair, 8k uhd\' ELSE \'\' END')}) AS phrase FROM media), w AS (SELECT phrase, {_QUALITY('phrase')} AS quality, list_filter(string_split_regex(phrase, '[\\s_,]+'), lambda w: w <> '') AS ws FROM e) SELECT phrase, quality, len(ws) > 0 AND len(list_filter(ws, lambda w: list_contains({_LIST(T.FRAMING)}, w) OR contains(w, 'close-up'))) = 0 AND ((len(list_filter(ws, lambda w: NOT (list_contains({_LIST(T.LOOK)}, w) OR list_contains({_LIST(T.QUALITY)}, w) OR regexp_matches(w, '^[0-9]+$')))) = 0 AND len(list_filter(ws, lambda w: list_contains({_LIST(T.LOOK)}, w))) > 0) OR regexp_matches(phrase, '^(by |art by |in the style of|style of)')) AS look FROM w")
def phrase_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which phrases only ask for quality, and which for a look."""
    more = F.coalesce(*[F.when(F.col("id") % 5 == k, F.lit(v)) for k, v in enumerate((", soft lighting, oil_painting 8k", ", best close-up portrait, art by x", ", golden hair, 8k uhd"))], F.lit(""))
    found = media(spark, sf_dir).select(F.explode(T.prompt_phrases(F.concat("prompt", more), T.MOST_PHRASES)).alias("phrase")).distinct()
    return found.select("phrase", T.is_quality_phrase(F.col("phrase")).alias("quality"), T.is_look_phrase(F.col("phrase")).alias("look"))


@query(f"WITH {MEDIA_SQL}, m AS (SELECT {_FIRST('model')} AS model FROM media WHERE trim(prompt) <> '' AND ({_TARGET}) IS NOT NULL) SELECT model, count(*) AS n, model AS label FROM m WHERE model IS NOT NULL GROUP BY model ORDER BY n DESC, model LIMIT 20")
def judged_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The models of judged rows."""
    return works.judged_models(media(spark, sf_dir))


@query(f"WITH {MEDIA_SQL}, e AS (SELECT unnest({_phrases('prompt')}) AS phrase FROM media) SELECT phrase, count(*) AS n FROM e GROUP BY phrase HAVING count(*) >= 2 AND NOT {_QUALITY('phrase')} ORDER BY n DESC, phrase LIMIT 300")
def own_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Phrases used twice or more."""
    return works.own_phrases(media(spark, sf_dir))


_TYPED = "prompt || CASE WHEN id % 4 = 0 THEN ' BREAK Best Quality, 8k. masterpiece BREAK' ELSE '' END"


@query(
    f"""WITH {MEDIA_SQL}, {_counts(_phrases('prompt', ''))}, js AS (SELECT id, target, unnest(list_distinct(list_concat([''], list_transform(list_filter(facets, lambda f: f.kind = 'model'), lambda f: f.key)))) AS scope FROM j),
ns AS (SELECT scope, count(*) FILTER (WHERE target >= 0.74) AS nl, count(*) FILTER (WHERE target <= 0.26) AS nd FROM js GROUP BY scope),
cs AS (SELECT scope, label, count(*) FILTER (WHERE target >= 0.74) AS liked, count(*) FILTER (WHERE target <= 0.26) AS disliked, count(*) AS judged FROM (SELECT js.scope, js.target, unnest(ph.ps) AS label FROM js JOIN ph USING (id)) GROUP BY 1, 2),
s AS (SELECT scope, label, liked, judged, round(CASE WHEN nl > 0 THEN liked::DOUBLE / nl ELSE 0 END - CASE WHEN nd > 0 THEN disliked::DOUBLE / nd ELSE 0 END, 9) AS lift FROM cs JOIN ns USING (scope)),
q AS (SELECT id, {_TYPED} AS typed, coalesce(ns.scope, '') AS scope, (SELECT list_filter(l, lambda x, i: list_position(l, x) = i) FROM (SELECT list_transform({_phrases(_TYPED, '')}, lambda p: lower(p)) AS l)) AS ps FROM media LEFT JOIN ns ON ns.scope = coalesce({_FIRST('model')}, '') AND nl + nd >= 16),
o AS (SELECT id, scope, unnest(ps) AS label, unnest(range(len(ps))) AS k FROM q), t AS (SELECT o.*, lift, {_QUALITY('label')} AND abs(lift) < 0.05 AS same FROM o JOIN s USING (scope, label) WHERE judged >= 8),
b AS (SELECT scope, list({{'l': -lift, 'p': label}} ORDER BY lift DESC, label) AS ls FROM s WHERE liked >= 3 AND lift >= 0.12 AND len(string_split(label, ' ')) <= 5 AND NOT {_QUALITY('label')} GROUP BY scope),
w AS (SELECT id, 0 AS part, 0 AS k, 'missed' AS advice, ps[1] AS phrase, CASE WHEN id % 10 < 5 THEN 1.3 ELSE 1.2 END AS weight FROM q WHERE id % 3 = 0 AND id % 2 = 1 AND len(ps) > 0
 UNION ALL SELECT id, 1, k, 'in_rejects', label, NULL FROM t WHERE NOT same AND lift <= -0.12 UNION ALL SELECT id, 2, 0, 'no_difference', string_agg(label, ', ' ORDER BY k), NULL FROM t WHERE same GROUP BY id
 UNION ALL SELECT id, 3, unnest(range(len(xs))), 'in_keepers', unnest(list_transform(xs, lambda x: x.p)), NULL FROM (SELECT id, list_filter(ls, lambda x: NOT contains(lower(typed), x.p))[1:2] AS xs FROM q JOIN b USING (scope))),
r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY part, k) AS place FROM w)
SELECT r.id, CAST(place AS INTEGER) AS place, advice, phrase, CAST(weight AS DOUBLE) AS weight, q.scope FROM r JOIN q USING (id) WHERE place <= 6"""
)
def prompt_advice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What to change in each whole prompt as it was typed, by all phrases of the judged rows of its model or of all."""
    rows = media(spark, sf_dir)
    typed = rows.withColumn("prompt", F.concat("prompt", F.when(F.col("id") % 4 == 0, " BREAK Best Quality, 8k. masterpiece BREAK").otherwise("")))
    first = F.get(F.array_distinct(F.transform(T.prompt_phrases(F.col("prompt")), lambda p: F.lower(p))), F.lit(0))
    missed = typed.where("id % 3 = 0").select("id", F.lit(0).alias("k"), F.explode(F.array(first)).alias("phrase"), (F.col("id") % 10 / 10).alias("level"), (F.col("id") % 2 == 0).alias("seen")).where("phrase is not null")
    own = typed.select("id", "prompt", FA.first(FA.main_models(), "model").alias("model"))
    return works.advice(own, works.recipes(rows.withColumn("facets", FA.main_models())), missed)


@query(f"WITH {MEDIA_SQL}, f AS (SELECT DISTINCT dir FROM media WHERE id % 97 = 0 UNION SELECT '/lib/de') SELECT DISTINCT m.id, m.dir FROM media m JOIN f ON m.dir = f.dir OR starts_with(m.dir, f.dir || '/') OR starts_with(f.dir, m.dir || '/') WHERE m.rating > 0")
def rated_near(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rated rows in, above or below some folders."""
    rows = media(spark, sf_dir)
    some = rows.where("id % 97 = 0").select("dir").union(spark.createDataFrame([("/lib/de",)], "dir string"))
    return works.rated_near(rows, some).select("id", "dir")


# ---- notes

_NOTES = "nt AS (SELECT dir, name, rating, flag, collections FROM media WHERE rating > 0 OR flag > 0 OR len(collections) > 0)"


def _notes(rows: DataFrame) -> DataFrame:
    return rows.where((F.col("rating") > 0) | (F.col("flag") > 0) | (F.size("collections") > 0)).select("dir", "name", "rating", "flag", "collections")


@query(f"WITH {MEDIA_SQL}, {_NOTES}, k AS (SELECT dir, name, rating, flag, list_filter(collections, lambda c: lower(c) <> 'best') AS cs FROM nt) SELECT dir, name, rating, flag, array_to_string(cs, ',') AS collections FROM k WHERE rating > 0 OR flag > 0 OR len(cs) > 0")
def collection_deleted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Notes without a collection in any spelling."""
    return tables.delete_collection(_notes(media(spark, sf_dir)), "BEST").withColumn("collections", F.array_join("collections", ","))


@query(
    f"""WITH {MEDIA_SQL}, {_NOTES}, c AS (SELECT dir, name, id FROM media WHERE id % 4 = 1), b AS (SELECT m.dir, m.name, coalesce(n.rating, 0) AS rating, coalesce(n.flag, 0) AS flag, coalesce(n.collections, []) AS cs, c.id FROM media m LEFT JOIN nt n ON n.dir = m.dir AND n.name = m.name LEFT JOIN c ON c.dir = m.dir AND c.name = m.name),
d AS (SELECT dir, name, CASE WHEN id IS NOT NULL THEN 4 ELSE rating END AS rating, CASE WHEN id % 8 = 1 THEN 2 ELSE flag END AS flag, CASE WHEN id IS NULL THEN cs ELSE list_filter(cs, lambda x: lower(x) <> 'to print') END AS kept, id FROM b),
e AS (SELECT dir, name, rating, flag, CASE WHEN id IS NULL OR len(list_filter(kept, lambda x: lower(x) = 'best')) > 0 THEN kept ELSE list_append(kept, 'BEST') END AS cs FROM d)
SELECT dir, name, rating, flag, array_to_string(cs, ',') AS collections FROM e WHERE rating > 0 OR flag > 0 OR len(cs) > 0"""
)
def notes_changed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Several changes of each chosen file at once, in their order."""
    rows = media(spark, sf_dir)
    some, i = rows.where("id % 4 = 1"), F.col("id")
    empty, none = F.array().cast("array<string>"), F.lit(None).cast("int")
    one = some.select("dir", "name", F.lit(1).alias("at"), F.lit(2).alias("rating"), F.when(i % 8 == 1, 1).alias("flag"), F.array(F.lit("to  PRINT"), F.lit("BEST")).alias("add"), empty.alias("drop"))
    two = some.select("dir", "name", F.lit(2).alias("at"), F.lit(4).alias("rating"), F.when(i % 8 == 1, 2).alias("flag"), empty.alias("add"), F.array(F.lit("To Print"), F.lit("to  PRINT")).alias("drop"))
    three = some.select("dir", "name", F.lit(3).alias("at"), none.alias("rating"), none.alias("flag"), empty.alias("add"), empty.alias("drop"))
    return tables.batch_notes(_notes(rows), one.unionByName(two).unionByName(three)).withColumn("collections", F.array_join("collections", ","))


@query(f"WITH {MEDIA_SQL}, {_NOTES}, mv AS (SELECT dir, name, '/moved' || dir AS to_dir, name AS to_name FROM media WHERE id % 5 = 0 UNION ALL SELECT a.dir, a.name, b.dir, b.name FROM media a JOIN media b ON b.id = a.id + 1 WHERE a.id % 5 = 2), g AS (SELECT to_dir AS dir, to_name AS name, rating, flag FROM nt JOIN mv USING (dir, name)) SELECT dir, name, rating, flag FROM g UNION ALL SELECT dir, name, rating, flag FROM nt WHERE NOT EXISTS (SELECT 1 FROM mv WHERE mv.dir = nt.dir AND mv.name = nt.name) AND NOT EXISTS (SELECT 1 FROM g WHERE g.dir = nt.dir AND g.name = nt.name)")
def notes_moved(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K8: notes go where their files went."""
    rows = media(spark, sf_dir)
    far = rows.where("id % 5 = 0").select("dir", "name", F.concat(F.lit("/moved"), "dir").alias("to_dir"), F.col("name").alias("to_name"))
    over = rows.where("id % 5 = 2").select((F.col("id") + 1).alias("id"), "dir", "name").join(rows.select("id", F.col("dir").alias("to_dir"), F.col("name").alias("to_name")), "id").drop("id")
    return tables.transfer_notes(_notes(rows), far.unionByName(over)).select("dir", "name", "rating", "flag")


@query(f"WITH {MEDIA_SQL}, {_NOTES}, f AS (SELECT dir, name FROM media WHERE id % 3 <> 0 AND dir NOT LIKE '/lib/es/%'), a AS (SELECT DISTINCT nt.dir FROM nt JOIN f USING (dir, name)) SELECT nt.dir, nt.name FROM nt WHERE EXISTS (SELECT 1 FROM f WHERE f.dir = nt.dir AND f.name = nt.name) OR nt.dir NOT IN (SELECT dir FROM a)")
def notes_pruned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K9: notes of missing files go, but for folders that are missing as a whole."""
    rows = media(spark, sf_dir)
    files = rows.where("id % 3 <> 0 and dir not like '/lib/es/%'").select("dir", "name")
    return tables.prune_notes(_notes(rows), files).select("dir", "name")


@query(f"WITH {MEDIA_SQL}, {_NOTES} SELECT dir, name, CASE WHEN rating = 5 AND m.id % 2 = 0 THEN 0 ELSE rating END AS rating, flag FROM nt JOIN (SELECT dir, name, id, len(collections) AS k FROM media) m USING (dir, name) WHERE NOT (rating = 5 AND m.id % 2 = 0 AND flag = 0 AND k = 0)")
def notes_toggled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A rating that all chosen rows have already is cleared."""
    rows = media(spark, sf_dir)
    return tables.toggled(_notes(rows), rows.where("rating = 5 and id % 2 = 0"), "rating", 5).select("dir", "name", "rating", "flag")


@query(f"WITH {MEDIA_SQL}, {_NOTES} SELECT dir, count(*) AS n FROM nt GROUP BY dir")
def note_folders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Folders that hold notes."""
    return tables.note_folders(_notes(media(spark, sf_dir)))


@query(f"WITH {MEDIA_SQL}, {_NOTES} SELECT dir, name, rating FROM nt WHERE dir <> (SELECT min(dir) FROM media) UNION ALL SELECT dir, name, 3 FROM media WHERE dir = (SELECT min(dir) FROM media) AND id % 2 = 0")
def notes_replaced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K4: one folder's notes are replaced."""
    rows = media(spark, sf_dir)
    folder = rows.agg(F.min("dir")).first()[0]
    fresh = rows.where(F.col("dir") == folder).select("dir", "name", F.when(F.col("id") % 2 == 0, 3).otherwise(0).alias("rating"), F.lit(0).alias("flag"), F.array().cast("array<string>").alias("collections"))
    return tables.replace_notes(_notes(rows), folder, fresh).select("dir", "name", "rating")


_VIEWS = [("/", "All", "x"), ("/lib", "best", "a"), ("/lib/en", "Best", "b"), ("/lib/fr", "other", "c")]


@query(f"WITH {MEDIA_SQL}, v(saved_in, name, q) AS (VALUES {', '.join(map(str, _VIEWS))}), f AS (SELECT DISTINCT dir FROM media), h AS (SELECT f.dir, v.name, v.q AS query, v.saved_in, row_number() OVER (PARTITION BY f.dir, lower(v.name) ORDER BY length(v.saved_in) DESC) AS k FROM f JOIN v ON v.saved_in = '/' OR f.dir = v.saved_in OR starts_with(f.dir, v.saved_in || '/')) SELECT dir, name, query, saved_in FROM h WHERE k = 1")
def views_inherited(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Saved views of a folder and of those above it, the nearest of one name."""
    return tables.inherited(spark.createDataFrame(_VIEWS, "dir string, name string, query string"), media(spark, sf_dir))


@query(f"WITH {MEDIA_SQL} SELECT 'rated' AS name, count(*) FILTER (WHERE rating > 0) AS n FROM media UNION ALL SELECT 'words', count(*) FILTER (WHERE contains(prompt, 'the')) FROM media UNION ALL SELECT 'nothing', 0")
def view_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of each saved view, in one pass."""
    return tables.view_counts(media(spark, sf_dir), {"rated": F.col("rating") > 0, "words": F.contains("prompt", F.lit("the")), "nothing": F.lit(False)})


_KEY = lambda c: f"trim(lower(regexp_replace({c}, '(?i)\\.(safetensors|ckpt|pt|pth|bin|gguf|sft)$', '')))"
_W = lambda c: f"list_distinct(list_filter(regexp_extract_all({c}, '[a-z0-9]+'), lambda w: length(w) > 1))"


_FAST = f"(list_contains({_W(_KEY('p_type'))}, 'turbo') OR (NOT list_has_any({_W(_KEY('p_type'))}, ['raw', 'base']) AND p_size <= 12 AND 1 + p_partkey % 3 * 0.5 <= 1.5))"


@query(
    f"""WITH w AS (SELECT DISTINCT p_type AS model, p_brand AS family, {_FAST} AS fast FROM part), i AS (SELECT DISTINCT p_type || CASE WHEN p_partkey % 2 = 0 THEN ' turbo' ELSE '' END || '.ckpt' AS file, p_brand AS family, CASE WHEN p_partkey % 3 = 0 THEN 'plain' ELSE 'packed' END AS format FROM part WHERE p_partkey % 4 < 2),
x AS (SELECT model, w.family, fast, min(i.file) AS file FROM w JOIN i ON {_KEY('i.file')} = {_KEY('w.model')} GROUP BY ALL),
s AS (SELECT w.model, w.family, w.fast, i.file, CASE WHEN list_contains({_W(_KEY('i.file'))}, 'turbo') = w.fast THEN 10.0 ELSE 0.0 END + len(list_intersect({_W(_KEY('i.file'))}, {_W(_KEY('w.model'))})) + CASE WHEN format = 'plain' THEN 0.5 ELSE 0.0 END AS score FROM w JOIN i USING (family) WHERE NOT EXISTS (SELECT 1 FROM x WHERE x.model = w.model AND x.family = w.family)),
n AS (SELECT model, family, fast, file FROM (SELECT *, row_number() OVER (PARTITION BY model, family, fast ORDER BY score DESC, file) AS k FROM s) WHERE k = 1)
SELECT w.model, w.family, w.fast, coalesce(x.file, n.file) AS file, x.file IS NULL AND n.file IS NOT NULL AS stand_in FROM w LEFT JOIN x USING (model, family, fast) LEFT JOIN n USING (model, family, fast)"""
)
def matched_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The installed file of a recipe's model, else the most alike of its family, fast ones for fast recipes."""
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    k = F.col("p_partkey")
    installed = part.where("p_partkey % 4 < 2").select(F.concat("p_type", F.when(k % 2 == 0, " turbo").otherwise(""), F.lit(".ckpt")).alias("file"), F.col("p_brand").alias("family"), F.when(k % 3 == 0, "plain").otherwise("packed").alias("format")).distinct()
    return tables.matched_models(part.select(F.col("p_type").alias("model"), F.col("p_brand").alias("family"), F.col("p_size").alias("steps"), (1 + k % 3 * 0.5).alias("cfg")), installed)


@query(
    f"""WITH {MEDIA_SQL}, n AS (SELECT *, CASE WHEN id % 3 = 0 THEN id % 5 + 1 ELSE 0 END AS a FROM media), c AS (SELECT *, CASE WHEN id % 4 = 1 THEN 0 WHEN id % 4 = 2 THEN 5 ELSE a END AS b, list_filter(collections, lambda c: lower(c) <> 'to print') AS cs FROM n WHERE rating > 0 OR flag > 0 OR len(collections) > 0 OR a > 0 OR id % 4 = 2),
k AS (SELECT dir, name, b FROM c WHERE rating > 0 OR flag > 0 OR len(cs) > 0 OR b > 0) SELECT m.id, CAST(coalesce(nullif(k.b, 0), m.id % 4 + 1) AS INTEGER) AS level, k.name IS NOT NULL AS noted FROM media m LEFT JOIN k ON k.dir = m.dir AND k.name = m.name"""
)
def notes_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Levels set by hand stay with their notes, are set and taken off, and go before what the prompt says."""
    rows, i = media(spark, sf_dir), F.col("id")
    notes = rows.withColumn("audience", F.when(i % 3 == 0, i % 5 + 1).otherwise(0).cast("int")).where((F.col("rating") > 0) | (F.col("flag") > 0) | (F.size("collections") > 0) | (F.col("audience") > 0)).select("dir", "name", "rating", "flag", "collections", "audience")
    none, empty = F.lit(None).cast("int"), F.array().cast("array<string>")
    change = rows.where("id % 4 in (1, 2)").select("dir", "name", none.alias("rating"), none.alias("flag"), F.when(i % 4 == 2, 9).otherwise(0).alias("audience"), empty.alias("add"), empty.alias("drop"))
    kept = tables.delete_collection(tables.change_notes(notes, change), "to print")
    there = kept.select("dir", "name", F.lit(True).alias("noted"))
    levels = tables.with_levels(rows.select("id", "dir", "name", (i % 4 + 1).cast("int").alias("level")), kept, "level")
    return levels.join(there, ["dir", "name"], "left").select("id", "level", F.coalesce("noted", F.lit(False)).alias("noted"))


@query(f"WITH {MEDIA_SQL}, a AS (SELECT * FROM media WHERE id = 1), b AS (SELECT * FROM media WHERE id = 4), r(setting, x, y) AS (SELECT 'prompt', a.prompt, b.prompt FROM a, b UNION ALL SELECT 'seed', a.seed, b.seed FROM a, b UNION ALL SELECT 'size', a.width || ' × ' || a.height, b.width || ' × ' || b.height FROM a, b UNION ALL SELECT 'sampler', list_filter(a.facets, lambda f: f.kind = 'sampler')[1].value, list_filter(b.facets, lambda f: f.kind = 'sampler')[1].value FROM a, b) SELECT setting, x || '|' || y AS pair, x <> y AS differs FROM r")
def compared_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two rows side by side."""
    out = tables.compared(media(spark, sf_dir), [1, 4]).where(F.col("setting").isin("prompt", "seed", "size", "sampler"))
    return out.select("setting", F.array_join("values", "|").alias("pair"), "differs")


# ---- levels

_CLEAN = lambda c: f"trim(regexp_replace(lower(regexp_replace(regexp_replace({c}, '<[^>]*(?:>|$)', '', 'g'), '[>'']', '', 'g')), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'))"
_LEVELS = {p: n for n, ps in audience.PHRASES.items() for p in ps}
_IN = lambda p: f"contains(s, '{audience._sought(p)}')"
_N = lambda p: f"((length(s) - length(replace(s, '{audience._sought(p)}', ''))) / {len(audience._sought(p))})"


def _level() -> str:
    parts = []
    for p, n in _LEVELS.items():
        inside = [q for q in _LEVELS if q != p and f" {p} " in f" {q} "]
        spared = f" AND {_N(p)} > {' + '.join(map(_N, inside))}" if inside else ""
        parts.append(f"CASE WHEN {_IN(p)}{spared} THEN {n} ELSE 0 END")
    return f"CASE WHEN w = '' THEN 0 ELSE greatest(1, {', '.join(parts)}) END"


_LEVEL_SQL = f"lv AS (SELECT id, rating, w, {_level()} AS level FROM (SELECT id, rating, w, ' ' || replace(w, ' ', '  ') || ' ' AS s FROM (SELECT id, rating, {_CLEAN('p')} AS w FROM (SELECT id, rating, prompt || CASE id % 9 WHEN 1 THEN ', Blood splatter' WHEN 2 THEN ' <lora:nude:1> a (war:1.2), blood' WHEN 3 THEN ' blood splatter, blood' WHEN 4 THEN ' topless' WHEN 5 THEN ' kiss-ing gun''s kiss' ELSE '' END AS p FROM media))))"


def _marked(rows: DataFrame) -> DataFrame:
    """Prompts with planted phrases, as the documents have none."""
    more = {1: ", Blood splatter", 2: " <lora:nude:1> a (war:1.2), blood", 3: " blood splatter, blood", 4: " topless", 5: " kiss-ing gun's kiss"}
    tail = F.coalesce(*[F.when(F.col("id") % 9 == k, F.lit(v)) for k, v in more.items()], F.lit(""))
    return rows.withColumn("prompt", F.concat("prompt", tail))


@query(f"WITH {MEDIA_SQL}, {_LEVEL_SQL} SELECT id, CAST(level AS INTEGER) AS prompt_level, CAST(CASE WHEN id % 14 = 0 THEN 2 ELSE greatest(level, CASE WHEN id % 5 = 0 THEN 3 ELSE 0 END) END AS INTEGER) AS level FROM lv WHERE CASE WHEN id % 14 = 0 THEN 2 ELSE greatest(level, CASE WHEN id % 5 = 0 THEN 3 ELSE 0 END) END IN (0, 2, 3, 4)")
def audience_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Levels of prompts, the one that counts, and a range of them."""
    rows = _marked(media(spark, sf_dir)).withColumn("picture", F.when(F.col("id") % 5 == 0, 3).otherwise(0)).withColumn("own", F.when(F.col("id") % 14 == 0, 2))
    return audience.levelled(rows, "strictest").where(audience.wanted(F.col("level"), "pg..r | none")).select("id", "prompt_level", "level")


def _reasons() -> str:
    parts = []
    for p, n in _LEVELS.items():
        inside = [q for q in _LEVELS if q != p and f" {p} " in f" {q} "]
        spared = f" AND {_N(p)} > {' + '.join(map(_N, inside))}" if inside else ""
        parts.append(f"CASE WHEN {_IN(p)}{spared} THEN '{n}:{p}' END")
    return f"array_to_string(list_reverse_sort(list_filter([{', '.join(parts)}], lambda x: x IS NOT NULL)), ',')"


_SPACED_SQL = _LEVEL_SQL.replace("lv AS (SELECT id, rating, w, " + _level() + " AS level FROM (", "lv AS (SELECT id, s, w FROM (")


@query(f"WITH {MEDIA_SQL}, {_SPACED_SQL} SELECT id, {_reasons()} AS reasons FROM lv WHERE {_reasons()} <> ''")
def audience_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The phrases that set a prompt's level, the highest first."""
    rows = _marked(media(spark, sf_dir)).select("id", F.explode(F.array(audience.clean(F.col("prompt")))).alias("w"))
    told = F.array_join(F.transform(audience.reasons(F.col("w")), lambda x: F.concat(x["level"].cast("string"), F.lit(":"), x["phrase"])), ",")
    return rows.select("id", F.explode(F.array(told)).alias("reasons")).where("reasons <> ''")


@query(f"WITH {MEDIA_SQL}, {_LEVEL_SQL}, p AS (SELECT level AS prompt_level, CASE WHEN id % 7 = 0 THEN 0 WHEN rating > 3 THEN 4 WHEN rating > 0 THEN 2 ELSE 1 END AS picture FROM lv) SELECT CAST(prompt_level AS INTEGER) AS prompt_level, " + ", ".join(f"count(*) FILTER (WHERE picture = {n}) AS p{n}" for n in range(1, 6)) + " FROM p WHERE prompt_level > 0 AND picture > 0 GROUP BY 1")
def level_confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prompt levels against picture levels."""
    fit = lambda n, x: F.struct(F.lit(n).alias("level"), x.cast("double").alias("fit"))
    fits = F.when(F.col("id") % 7 != 0, F.array(fit(2, F.when(F.col("rating") > 0, 1.05).otherwise(0.9)), fit(4, F.when(F.col("rating") > 3, 1.15).otherwise(1.05)), fit(5, F.lit(1.25))))
    rows = audience.levelled(_marked(media(spark, sf_dir)), "prompt").withColumn("picture", audience.picture_level(fits))
    return audience.confusion(rows)


@query(f"WITH {MEDIA_SQL}, {_LEVEL_SQL}, f AS (SELECT level, unnest([{{'p': 'calm', 'l': 2, 'f': round(0.8 + (id % 8) / 10.0, 6)}}, {{'p': 'gore', 'l': 4, 'f': round(0.7 + (id % 9) / 10.0, 6)}}]) AS x FROM lv WHERE level > 0), b AS (SELECT x.p AS phrase, x.l AS lev, x.f AS fit, level, unnest([0.8, 0.9, 1.0, 1.1, 1.2, 1.3, 1.5]) AS bar FROM f) SELECT phrase, CAST(lev AS INTEGER) AS level, CAST(bar AS DOUBLE) AS bar, count(*) FILTER (WHERE level >= lev AND fit >= bar) AS hits, count(*) FILTER (WHERE level >= lev) AS of_hits, count(*) FILTER (WHERE level < lev AND fit >= bar) AS misses, count(*) FILTER (WHERE level < lev) AS of_misses FROM b GROUP BY ALL")
def level_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each description catches at each bar."""
    rows = audience.levelled(_marked(media(spark, sf_dir)), "prompt")
    one = lambda p, n, low, k: F.struct(F.lit(p).alias("phrase"), F.lit(n).alias("level"), F.round(low + F.col("id") % k / 10, 6).alias("fit"))
    fits = rows.select("prompt_level", F.explode(F.array(one("calm", 2, 0.8, 8), one("gore", 4, 0.7, 9))).alias("x")).select("prompt_level", "x.*")
    return audience.bars(fits)


@query(f"WITH {MEDIA_SQL} SELECT id, id % 6 IN (1, 2, 4) AS minor FROM media")
def minor_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prompts that mention a child or a teenager, by word or age."""
    told = {1: "a Teenager, reading", 2: "woman, (15yo)", 3: "aged 45, childhood", 4: "17 years old", 5: "18 years old, 12 monkeys"}
    text = F.coalesce(*[F.when(F.col("id") % 6 == k, F.lit(v)) for k, v in told.items()], F.lit("kidney bean"))
    return media(spark, sf_dir).select("id", audience.mentions_minor(audience.clean(text)).alias("minor"))



_ACCENTS = ("ßàáâãäåæçèéêëìíîïñòóôõöøùúûüýÿœ", "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"[:32])
_SPELLED = "[A-Za-zÀ-ɏ][A-Za-zÀ-ɏ''’\\-]*[A-Za-zÀ-ɏ]|[A-Za-zÀ-ɏ]"
_BARE = "regexp_replace(regexp_replace(coalesce(text, ''), '<[^>]*>|embedding:\\S+|https?://\\S+', ' ', 'g'), '([0-9_])', '\\1\\1', 'g')"
_ENDS = "list_filter([{w}, CASE WHEN ends_with({w}, '''s') OR ends_with({w}, 's''') OR ends_with({w}, 'es') THEN left({w}, -2) END, CASE WHEN ends_with({w}, 's') THEN left({w}, -1) END], lambda f: f IS NOT NULL)"


@query(
    f"""WITH t AS (SELECT row_number() OVER () AS r, list_filter(regexp_extract_all({_BARE}, '[0-9_]?(?:{_SPELLED})[0-9_]?'), lambda x: NOT regexp_matches(x, '[0-9_]')) AS ws FROM documents),
e AS (SELECT r, unnest(ws) AS x FROM t), c AS (SELECT replace(lower(x), '’', '''') AS w, count(DISTINCT r) AS n, bool_or(NOT (length(x) <= 5 AND x = upper(x))) AS plain FROM e GROUP BY 1),
k AS (SELECT w, row_number() OVER (ORDER BY n DESC, w) AS rank FROM c WHERE n >= 100 ORDER BY n DESC, w LIMIT 20000), ks AS (SELECT list(w) AS known FROM k),
u AS (SELECT w, n, list_has_any(known, {_ENDS.format(w='w')}) AS whole, contains(w, '-') AND list_bool_and(list_transform(list_concat(['ab'], string_split(w, '-')), lambda p: length(p) < 3 OR list_has_any(known, {_ENDS.format(w='p')}))) AS parts FROM c, ks WHERE length(w) >= 3 AND plain),
b AS (SELECT w, n, translate(w, '{_ACCENTS[0]}', '{_ACCENTS[1]}') AS a FROM u WHERE NOT whole AND NOT parts), g AS (SELECT w, rank, translate(w, '{_ACCENTS[0]}', '{_ACCENTS[1]}') AS a FROM k),
d AS (SELECT b.w, g.w AS s, g.rank, damerau_levenshtein(b.a, g.a) AS edits FROM b JOIN g ON abs(length(b.a) - length(g.a)) <= 2),
o AS (SELECT w, s, rank FROM d WHERE edits = 1), f AS (SELECT w, count(*) AS many FROM o GROUP BY w),
x AS (FROM o UNION ALL SELECT d.w, d.s, d.rank + 300000 FROM d LEFT JOIN f USING (w) WHERE edits = 2 AND coalesce(many, 0) < 5 AND length(d.w) <= 14),
l AS (SELECT w, list(s ORDER BY rank, s)[1:5] AS ss FROM x GROUP BY w)
SELECT b.w AS word, b.n, coalesce(array_to_string(ss, ','), '') AS suggestions FROM b LEFT JOIN l USING (w)"""
)
def spelling_suggestions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of the documents that the common ones don't explain, with what they may stand for."""
    counts = cut(spelling.counted(table(spark, sf_dir, "documents"), "text"))
    known = cut(spelling.dictionary(counts, 100))
    return spelling.suggestions(spelling.misspelled(counts, known), known).select("word", "n", F.array_join("suggestions", ",").alias("suggestions"))


_OLD = "SELECT dir, name, rating, flag FROM media WHERE rating > 0"


@query(
    f"""WITH {MEDIA_SQL}, o AS ({_OLD}), f AS (SELECT dir, name, CASE WHEN source_n % 3 = 0 AND id % 2 = 0 THEN 1 ELSE rating END AS rating, flag, source_n FROM (SELECT *, CAST(regexp_extract(dir, '([0-9]+)$', 1) AS INTEGER) AS source_n FROM media) WHERE rating > 0 AND (source_n % 4 <> 1 OR id % 3 <> 0)),
r AS (SELECT DISTINCT dir, CAST(regexp_extract(dir, '([0-9]+)$', 1) AS INTEGER) % 5 <> 2 AS readable FROM media), n AS (SELECT o.* FROM o JOIN r USING (dir) WHERE NOT readable UNION ALL SELECT f.dir, f.name, f.rating, f.flag FROM f JOIN r USING (dir) WHERE readable)
SELECT dir, count(*) AS notes, CAST(sum(rating) AS BIGINT) AS stars FROM n GROUP BY dir"""
)
def notes_reloaded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Notes after some folders were read again; those of folders that can't be read are kept."""
    rows, number = media(spark, sf_dir), F.regexp_extract("dir", "([0-9]+)$", 1).cast("int")
    rated = rows.where("rating > 0")
    read = rows.select("dir").distinct().withColumn("readable", number % 5 != 2)
    fresh = rated.where((number % 4 != 1) | (F.col("id") % 3 != 0)).withColumn("rating", F.when((number % 3 == 0) & (F.col("id") % 2 == 0), 1).otherwise(F.col("rating")))
    columns = ["dir", "name", "rating", "flag"]
    fresh = fresh.select(*columns).join(read.where("readable"), "dir", "left_semi")
    after, _ = tables.reloaded(rated.select(*columns), read, fresh)
    return after.groupBy("dir").agg(F.count("*").alias("notes"), F.sum("rating").cast("long").alias("stars"))


@query(f"WITH {MEDIA_SQL}, g AS (SELECT dir, name FROM media WHERE id % 6 = 1) SELECT m.id, m.rating > 0 AS noted FROM media m WHERE NOT EXISTS (SELECT 1 FROM g WHERE g.dir = m.dir AND g.name = m.name)")
def files_forgotten(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Index and notes without some files."""
    rows = media(spark, sf_dir)
    index, notes = tables.forget(rows.select("id", "dir", "name"), rows.where("rating > 0").select("dir", "name", "rating"), rows.where("id % 6 = 1").select("dir", "name"))
    return index.join(notes, ["dir", "name"], "left").select("id", F.col("rating").isNotNull().alias("noted"))


@query("SELECT vec_id AS id, CASE WHEN vec_id % 5 = 0 THEN NULL WHEN vec_id % 3 = 0 THEN 2 * embedding[1]::DOUBLE ELSE embedding[1]::DOUBLE END AS first, vec_id % 7 = 0 AS missing FROM embeddings")
def vector_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors by model and key: the newest of each, what can't be read, and what is missing."""
    rows, root = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("vec_id").cast("string").alias("key"), "embedding"), f"{shared_dir(spark)}/store-{uuid.uuid4().hex}"
    double = F.transform("embedding", lambda x: (2 * x).cast("float"))
    known = rows.where("id % 7 <> 0")
    store.put(known.select("key", "embedding"), root, "one")
    store.put(known.where("id % 3 = 0").select("key", double.alias("embedding")), root, "one")
    store.put(known.where("id % 5 = 0").select("key", F.lit(None).cast("array<float>").alias("embedding")), root, "two")
    lost = known.where("id % 5 = 0").select("key")
    have = store.get(spark, root, "one").join(lost, "key", "left_anti")
    missing = store.missing(rows.select("id", "key", F.col("id").alias("mtime")), root, "one").select("id", F.lit(True).alias("missing"))
    # what the other model couldn't read has no vector here
    own = rows.where("id % 7 = 0").select("key", F.when(F.col("id") % 5 != 0, F.when(F.col("id") % 3 == 0, double).otherwise(F.col("embedding"))).alias("embedding"))
    found = rows.select("id", "key").join(have.unionByName(own), "key", "left").join(missing, "id", "left")
    return found.select("id", F.get("embedding", F.lit(0)).cast("double").alias("first"), F.coalesce("missing", F.lit(False)).alias("missing"))
