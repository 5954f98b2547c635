"""Queries of searches, orders, functions and the index, with their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .checkpoints import shared_dir
from .functions import facets as FA
from .functions import text as T
from .operators import tables
from .plans import search as S
from .registry import query
from .sources import files, index_table, word_index
from .sources.tables import MEDIA_SQL, media, table
from .streaming import live_index

# the word rules of functions.text without look-around: separators are doubled before counting
SEP = r"[^\p{L}\p{N}]"


def _has(col: str, word: str) -> str:
    return f"regexp_matches({col}, '(^|{SEP}){word}($|{SEP})')"


def _prefix(col: str, word: str) -> str:
    return f"regexp_matches({col}, '(^|{SEP}){word}')"


def _count(col: str, word: str) -> str:
    doubled = f"regexp_replace({col}, '({SEP})', '\\1\\1', 'g')"
    inner = word.replace(" ", "  ")
    return f"len(regexp_extract_all({doubled}, '(^|{SEP}){inner}($|{SEP})'))"


def _first(col: str, word: str) -> str:
    return f"strlen(regexp_extract({col}, '(?s)^(.*?(?:^|{SEP})){word}(?:$|{SEP})', 1))"


def _facet(kind: str, test: str) -> str:
    return f"len(list_filter(facets, lambda f: f.kind IN ({kind}) AND {test})) > 0"


def _hit(word: str) -> str:
    return f"100 + 40 * (1 - {_first('prompt', word)}::DOUBLE / strlen(prompt)) + 10 * least({_count('prompt', word)} - 1, 3)"


def _rest(word: str) -> str:
    return f"WHEN {_prefix('lower(name)', word)} OR {_prefix('models_text', word)} OR {_prefix('loras_text', word)} THEN 40.0 WHEN {_prefix('settings_text', word)} THEN 20.0"


def _score(word: str) -> str:
    return f"CASE WHEN {_has('prompt', word)} THEN {_hit(word)} {_rest(word)} WHEN {_has('negative', word)} THEN 10.0 ELSE 0.0 END"


def _open_score(word: str) -> str:
    """Of a word that goes on: only what stands before it matters."""
    first = f"strlen(regexp_extract(prompt, '(?s)^(.*?(?:^|{SEP})){word}', 1))"
    hit = f"100 + 40 * (1 - {first}::DOUBLE / strlen(prompt)) + 10 * least(len(regexp_extract_all(prompt, '(^|{SEP}){word}')) - 1, 3)"
    return f"CASE WHEN {_prefix('prompt', word)} THEN {hit} {_rest(word)} WHEN {_prefix('negative', word)} THEN 10.0 ELSE 0.0 END"


@query(f"WITH {MEDIA_SQL}, s AS (SELECT id, name, {_score('the')} + {_score('and')} + CASE WHEN {_has('prompt', 'the and')} THEN 60.0 ELSE 0.0 END AS score FROM media WHERE ({_score('the')}) > 0 AND ({_score('and')}) > 0) SELECT id, name, round(score, 6) AS score FROM s")
def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two words anywhere, ranked by where they stand, from the word index: no text is read."""
    found = word_index.of(spark, sf_dir).search(["the", "and"])
    return found.orderBy(F.desc("score"), *S.ORDERS["newest"](), "id").select("id", "name", F.round("score", 6).alias("score"))


@query("SELECT word, count(DISTINCT id) AS n_rows, count(*) AS places FROM (SELECT doc_id AS id, unnest(regexp_extract_all(lower(coalesce(text, '')), '[\\p{L}\\p{N}]+')) AS word FROM documents) GROUP BY word")
def word_index_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F1, K1: what the word index holds of prompts: rows and places of every word."""
    index = word_index.of(spark, sf_dir)
    own = index.postings().where(F.col("field") == word_index.PROMPT)
    return own.groupBy("word").agg(F.count("*").alias("n_rows"), F.sum(F.size("at")).alias("places"))


_UPDATED = "SELECT * REPLACE (CASE WHEN id % 5 = 0 THEN 'and the and, new' ELSE prompt END AS prompt, CASE WHEN id % 3 = 0 THEN 'the_' || name ELSE name END AS name) FROM media WHERE id % 7 <> 0 OR id % 5 = 0"


@query(f"WITH {MEDIA_SQL}, u AS ({_UPDATED}), s AS (SELECT id, name, {_score('and')} AS a, CASE WHEN {_has('prompt', 'the')} THEN {_hit('the')} ELSE 0 END AS b FROM u) SELECT id, name, round(a + b, 6) AS score FROM s WHERE a > 0 AND b > 0")
def word_index_updated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K1, K2, F1: a ranked search of an index whose rows were changed, deleted, and put again."""
    rows = media(spark, sf_dir)
    index = word_index.WordIndex(spark, f"{shared_dir(spark)}/words-{uuid.uuid4().hex}")
    index.put(rows.where("id % 2 = 0"))
    index.put(rows.where("id % 2 = 1"))
    index.delete(rows.where("id % 7 = 0").select("id"))
    renamed = rows.withColumn("name", F.when(F.col("id") % 3 == 0, F.concat(F.lit("the_"), "name")).otherwise(F.col("name")))
    index.compact()
    index.put(renamed.where("id % 3 = 0 and id % 7 <> 0"))
    index.put(renamed.where("id % 5 = 0").withColumn("prompt", F.lit("and the and, new")))
    return index.search(["and"], ["the"]).select("id", "name", F.round("score", 6).alias("score"))


@query(f"WITH {MEDIA_SQL}, s AS (SELECT id, {_score('euler')} AS a, {_score('63')} AS b FROM media) SELECT id, round(a + b, 6) AS score FROM s WHERE a > 0 AND b > 0")
def search_settings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Free words that settings and seeds have, by the scan."""
    return S.Search(ranked=["euler", "63"]).rows(media(spark, sf_dir)).select("id", F.round("score", 6).alias("score"))


@query(f"WITH {MEDIA_SQL}, s AS (SELECT id, {_score('the')} AS a, {_score('and')} AS b, {_open_score('o')} AS c, CASE WHEN {_has('prompt', 'the and')} THEN 60.0 ELSE 0.0 END AS d FROM media) SELECT id, round(a + b + c + d, 6) AS score FROM s WHERE a > 0 AND b > 0 AND c > 0")
def search_starred(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A word with a star among others; the others still get points for standing together."""
    return S.Search(ranked=["the", "o*", "and"]).rows(media(spark, sf_dir)).select("id", F.round("score", 6).alias("score"))


@query(f"WITH {MEDIA_SQL}, s AS (SELECT id, {_score('economy')} AS a, CASE WHEN {_has('prompt', 'et')} THEN {_hit('et')} ELSE 0 END AS b FROM media) SELECT id, round(a + b, 6) AS score FROM s WHERE a > 0 AND b > 0")
def ranked_prompt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R2: a word that ranks wherever it stands, and one that ranks in the prompt only."""
    return S.Search(ranked=["economy"], ranked_prompt=["et"]).sorted(media(spark, sf_dir)).select("id", F.round("score", 6).alias("score"))


@query(f"WITH {MEDIA_SQL} SELECT id, dir, steps FROM media WHERE {_has('prompt', 'the')} AND NOT {_has('prompt', 'scum')} AND contains(models_text, 'vae-') AND (dir = '/lib/en' OR (dir >= '/lib/en/' AND dir < '/lib/en0'))")
def search_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F2, F3, F18 and negation: phrases, parts of names, a folder tree."""
    where = [S.in_prompt("the"), ~S.in_prompt("scum"), S.model("VAE-"), S.folder("/lib/en")]
    return S.Search(where).rows(media(spark, sf_dir)).select("id", "dir", "steps")


@query(
    f"""WITH {MEDIA_SQL} SELECT id, array_to_string(list_sort(list_transform(facets, lambda f: f.kind || '=' || f.key || '/' || f.role)), ';') AS facets FROM media
WHERE ({_facet("'model', 'aux'", "f.key IN ('vae-0', 'vae-3')")} OR {_facet("'scheduler'", "contains(f.key, 'simp')")}) AND {_facet("'cfg'", "f.key IN ('7', '7.5', '2', '3', '4')")} AND NOT ({_facet("'loraw'", "contains(f.key, 'tweaker@0')")}) AND {_facet("'sampler'", "f.key IN ('ddim', 'euler a')")} AND {_facet("'size'", "contains(f.key, '512')")}"""
)
def search_facets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facets whole and in part, numbers in any form, supporting models by `model`."""
    where = [S.model("VAE-0", "vae-3", exact=True) | S.facet("scheduler", "simp"), S.facet("cfg", "7.0", "7.5", "2", "3.00", "4"), ~S.facet("loraw", "Tweaker@0"), S.facet("sampler", "DDIM", "Euler  a", exact=True), S.facet("size", "512")]
    told = F.array_join(F.array_sort(F.transform(F.col("facets"), lambda f: F.concat(f["kind"], F.lit("="), f["key"], F.lit("/"), f["role"]))), ";")
    return S.Search(where).rows(FA.with_facets(media(spark, sf_dir))).select("id", told.alias("facets"))


@query(f"WITH {MEDIA_SQL} SELECT id, seed, source FROM media WHERE (starts_with(seed, '79') OR starts_with(seed, '2') OR seed = '15849') AND (contains(lower(name), '_00') OR lower(name) = 'doc_000500') AND lower(source) IN (SELECT DISTINCT lower(source) FROM media WHERE id < 40 AND id % 2 = 0) AND kind = 0")
def search_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seeds by their beginning or whole, names, sources, kinds."""
    rows = media(spark, sf_dir)
    some = [r["source"] for r in rows.where("id < 40 and id % 2 = 0").select("source").distinct().collect()]  # 20 rows at most
    where = [S.seed("79", "2") | S.seed("15849", exact=True), S.name("_00") | S.name("DOC_000500", exact=True), S.source(*some), S.kind("picture", "nonsense")]
    return S.Search(where).rows(rows).select("id", "seed", "source")


@query(f"WITH {MEDIA_SQL} SELECT id, mtime, rating, flag FROM media WHERE mtime >= 1701388800000 AND mtime < 1706745600000 AND rating BETWEEN 2 AND 5 AND flag IN (0, 1) AND kind = 0")
def search_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dates, ratings, flags and kinds."""
    where = [S.dates("2023-12", "2024-01"), S.rated(2), S.flagged("none", "keep"), F.col("kind") == 0]
    return S.Search(where).rows(media(spark, sf_dir)).select("id", "mtime", "rating", "flag")


@query(f"WITH {MEDIA_SQL}, d AS (SELECT *, CAST(timezone('Europe/Berlin', to_timestamp(mtime / 1000)) AS DATE) AS day FROM media) SELECT id FROM d WHERE (day BETWEEN DATE '2023-11-20' AND DATE '2023-12-02' OR rating = 0) AND NOT (rating = 0 AND id % 2 = 0)")
def search_local_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days of another time zone, rows without a rating."""
    where = [S.dates("2023-11-20", "2023-12-02", "Europe/Berlin") | S.unrated(), ~(S.unrated() & (F.col("id") % 2 == 0))]
    return S.Search(where).rows(media(spark, sf_dir)).select("id")


@query(f"WITH {MEDIA_SQL} SELECT id, array_to_string(collections, ',') AS collections FROM media WHERE (len(list_filter(collections, lambda c: lower(c) IN ('best', 'nothing'))) > 0 OR len(list_filter(collections, lambda c: contains(lower(c), 'äß'))) > 0) AND NOT len(list_filter(collections, lambda c: contains(lower(c), 'print'))) > 0")
def search_collections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Members of collections by whole or partial name, in any letter case."""
    where = [S.collection("BEST", "nothing", exact=True) | S.collection("ÄSS") | S.collection("ÄSS", "äß"), ~S.collection("print")]
    return S.Search(where).rows(media(spark, sf_dir)).select("id", F.array_join("collections", ",").alias("collections"))


@query(f"""WITH {MEDIA_SQL}, w AS (SELECT id, trim(regexp_replace(replace(prompt, '"', ''), '\\s+', ' ', 'g')) AS t FROM media) SELECT a.id, count(*) AS same FROM w a JOIN w b ON a.t = b.t GROUP BY a.id HAVING count(*) > 1""")
def same_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows whose whole prompt another row has. Hashes bring texts together, and the texts themselves decide."""
    rows = media(spark, sf_dir).select("id", T.same_text(F.col("prompt")).alias("t")).withColumn("key", F.xxhash64("t"))
    many = rows.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key")
    some = rows.join(many, "key")
    return some.join(some.groupBy("key", "t").agg(F.count("*").alias("same")).where("same > 1"), ["key", "t"]).select("id", "same")


@query(f"WITH {MEDIA_SQL} SELECT id, row_number() OVER (PARTITION BY dir ORDER BY rating DESC, CASE flag WHEN 1 THEN 0 WHEN 0 THEN 1 ELSE 2 END, mtime DESC, name DESC, id) AS place FROM media")
def sorted_by_rating(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O2: places in the order by rating within each folder."""
    return S.placed(media(spark, sf_dir).select("id", "dir", "rating", "flag", "mtime", "name"), [*S.ORDERS["rating"](), F.asc("id")], "dir").select("id", "place")


_FOLD = "translate(name, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_ORDERS = {"newest": "mtime DESC, name DESC", "oldest": "mtime, name", "name": f"dir, {_FOLD}", "name_desc": f"dir DESC, {_FOLD} DESC", "size": "size DESC, name"}


@query(f"WITH {MEDIA_SQL} " + " UNION ALL ".join(f"SELECT '{k}' AS sorted_by, id, row_number() OVER (ORDER BY {v}, id) AS place FROM media" for k, v in _ORDERS.items()))
def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places in every order over the whole library."""
    rows, out = media(spark, sf_dir).select("id", "dir", "name", "mtime", "size"), None
    for k in _ORDERS:
        part = S.placed(rows, [*S.ORDERS[k](), F.asc("id")]).select(F.lit(k).alias("sorted_by"), "id", "place")
        out = part if out is None else out.unionByName(part)
    return out


@query(f"WITH {MEDIA_SQL} SELECT id, mtime FROM media WHERE rating >= 2 AND id NOT IN (SELECT id FROM media WHERE rating >= 2 AND id % 5 <> 0) AND mtime >= {1_700_000_000_000 + 9_137_000 * 30 - 5000}")
def arrivals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a search finds now and didn't find before, made since the folder was opened."""
    now = S.Search([S.rated(2)]).rows(media(spark, sf_dir))
    return S.arrivals(now, now.where("id % 5 <> 0"), 1_700_000_000_000 + 9_137_000 * 30).select("id", "mtime")


@query(f"WITH {MEDIA_SQL} SELECT m.id, m.name FROM media m WHERE m.id IN (SELECT vec_id FROM embeddings WHERE vec_id % 3 = 0)")
def selected_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of a list of ids, however long."""
    ids = table(spark, sf_dir, "embeddings").where("vec_id % 3 = 0").select(F.col("vec_id").alias("id"))
    return media(spark, sf_dir).join(ids, "id", "left_semi").select("id", "name")


_LISTING = "SELECT id, dir, name, CASE WHEN id % 7 = 0 THEN size + 1 ELSE size END AS size, mtime FROM media WHERE id % 11 <> 0 UNION ALL SELECT id + 10000000, dir, name || '_new', size, mtime FROM media WHERE id % 13 = 0"


def _listing(rows: DataFrame) -> DataFrame:
    cols = ["id", "dir", "name", "size", "mtime"]
    old = rows.where("id % 11 <> 0").withColumn("size", F.when(F.col("id") % 7 == 0, F.col("size") + 1).otherwise(F.col("size"))).select(cols)
    return old.unionByName(rows.where("id % 13 = 0").withColumns({"id": F.col("id") + 10000000, "name": F.concat("name", F.lit("_new"))}).select(cols))


@query(f"WITH {MEDIA_SQL}, l AS ({_LISTING}) SELECT coalesce(m.dir, l.dir) AS dir, coalesce(m.name, l.name) AS name, CASE WHEN m.name IS NULL THEN 'new' WHEN l.name IS NULL THEN 'gone' WHEN m.size <> l.size OR m.mtime <> l.mtime THEN 'changed' ELSE 'same' END AS change FROM media m FULL JOIN l ON m.dir = l.dir AND m.name = l.name")
def index_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a listing changes in the index."""
    rows = media(spark, sf_dir)
    return tables.difference(rows, _listing(rows))


@query(f"WITH {MEDIA_SQL}, l AS ({_LISTING}), u AS (SELECT m.id, m.dir, m.name, coalesce(l.size, m.size) AS size, m.mtime FROM media m LEFT JOIN l ON m.dir = l.dir AND m.name = l.name UNION ALL SELECT l.* FROM l WHERE NOT EXISTS (SELECT 1 FROM media m WHERE m.dir = l.dir AND m.name = l.name)) SELECT * FROM u WHERE NOT (dir = '/lib/fr' OR (dir >= '/lib/fr/' AND dir < '/lib/fr0'))")
def index_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K1, K2: records replace rows of their path, ids stay; then a tree is deleted."""
    rows = media(spark, sf_dir)
    return tables.delete_tree(tables.upsert(rows.select("id", "dir", "name", "size", "mtime"), _listing(rows)), "/lib/fr")


@query(f"WITH {MEDIA_SQL}, l AS ({_LISTING}) SELECT coalesce(m.id, l.id) AS id, l.dir, l.name, l.size, l.mtime FROM l LEFT JOIN media m ON m.dir = l.dir AND m.name = l.name")
def index_reconciled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T5: the index after a full listing."""
    rows = media(spark, sf_dir)
    return tables.reconcile(rows.select("id", "dir", "name", "size", "mtime"), _listing(rows))[0]


@query(f"WITH {MEDIA_SQL}, l AS ({_LISTING}) SELECT change, count(*) AS files, CAST(sum(length(name)) AS BIGINT) AS letters FROM (SELECT coalesce(m.name, l.name) AS name, CASE WHEN m.name IS NULL THEN 'new' WHEN l.name IS NULL THEN 'gone' WHEN m.size <> l.size OR m.mtime <> l.mtime THEN 'changed' ELSE 'same' END AS change FROM media m FULL JOIN l ON m.dir = l.dir AND m.name = l.name) GROUP BY change")
def index_table_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changes of a listing against an index that is stored by path, which is read as it lies."""
    rows = media(spark, sf_dir)
    index = index_table.save(rows.select("id", "dir", "name", "size", "mtime"), f"{shared_dir(spark)}/index-{uuid.uuid4().hex}")
    return tables.difference(index, _listing(rows)).groupBy("change").agg(F.count("*").alias("files"), F.sum(F.length("name")).alias("letters"))


_CUT = 1_700_000_000_000 + 9_137_000 * 100


@query(
    f"""WITH {MEDIA_SQL}, r AS (SELECT id, dir, name, size, mtime, starts_with(dir, '/lib/fr/') AS fr FROM media), s0 AS (SELECT * FROM r WHERE id % 2 = 0),
k1 AS (SELECT * FROM s0 WHERE id % 5 <> 0 AND NOT fr), p1 AS (SELECT * REPLACE (id + 10000000 AS id, size + 1 AS size) FROM r WHERE id % 3 = 0 AND id % 5 <> 0 AND NOT (fr AND mtime < {_CUT})),
s1 AS (SELECT coalesce(k.id, p.id) AS id, coalesce(p.dir, k.dir) AS dir, coalesce(p.name, k.name) AS name, coalesce(p.size, k.size) AS size, coalesce(p.mtime, k.mtime) AS mtime FROM k1 k FULL JOIN p1 p ON p.dir = k.dir AND p.name = k.name),
g2 AS (SELECT dir, name FROM r WHERE id % 7 = 0 AND id % 4 <> 0), k2 AS (SELECT * FROM s1 WHERE NOT EXISTS (SELECT 1 FROM g2 WHERE g2.dir = s1.dir AND g2.name = s1.name)), p2 AS (SELECT * REPLACE (id + 20000000 AS id, size + 2 AS size, mtime + 1 AS mtime) FROM r WHERE id % 4 = 0)
SELECT coalesce(k.id, p.id) AS id, coalesce(p.dir, k.dir) AS dir, coalesce(p.name, k.name) AS name, coalesce(p.size, k.size) AS size, coalesce(p.mtime, k.mtime) AS mtime FROM k2 k FULL JOIN p2 p ON p.dir = k.dir AND p.name = k.name"""
)
def live_index_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The index that three batches of changes make, the first two merged to a base, the third in the log."""
    rows, root = media(spark, sf_dir).select("id", "dir", "name", "size", "mtime"), f"{shared_dir(spark)}/live-{uuid.uuid4().hex}"
    act = lambda some, action, far=0, more=0, late=0: some.select((F.col("id") + far).alias("id"), "dir", "name", (F.col("size") + more).alias("size"), (F.col("mtime") + late).alias("mtime"), F.lit(action).alias("action"))
    tree = rows.limit(1).select(F.lit(None).cast("long").alias("id"), F.lit("/lib/fr").alias("dir"), F.lit("").alias("name"), F.lit(None).cast("long").alias("size"), F.lit(_CUT).alias("mtime"), F.lit("tree").alias("action"))
    live_index.append(spark, root, act(rows.where("id % 2 = 0"), "put"), 0)
    live_index.append(spark, root, act(rows.where("id % 5 = 0"), "gone").unionByName(act(rows.where("id % 3 = 0 and id % 5 <> 0"), "put", 10_000_000, 1)).unionByName(tree), 1)
    live_index.compact(spark, root)
    live_index.append(spark, root, act(rows.where("id % 4 = 0"), "put", 20_000_000, 2, 1).unionByName(act(rows.where("id % 7 = 0 and id % 4 <> 0"), "gone")), 2)
    return live_index.latest(spark, root)


@query(f"WITH {MEDIA_SQL}, mv AS (SELECT dir, name, '/moved' || dir AS to_dir, name AS to_name FROM media WHERE id % 9 = 0 UNION ALL SELECT a.dir, a.name, b.dir, b.name FROM media a JOIN media b ON b.id = a.id + 1 WHERE a.id % 9 = 4) SELECT m.id, coalesce(mv.to_dir, m.dir) AS dir, coalesce(mv.to_name, m.name) AS name FROM media m LEFT JOIN mv ON mv.dir = m.dir AND mv.name = m.name WHERE NOT EXISTS (SELECT 1 FROM mv x WHERE x.to_dir = m.dir AND x.to_name = m.name)")
def index_moved(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K3: rows that move keep their id, rows at a target give way."""
    rows = media(spark, sf_dir).select("id", "dir", "name")
    far = rows.where("id % 9 = 0").select("dir", "name", F.concat(F.lit("/moved"), "dir").alias("to_dir"), F.col("name").alias("to_name"))
    over = rows.where("id % 9 = 4").select((F.col("id") + 1).alias("id"), "dir", "name").join(rows.select("id", F.col("dir").alias("to_dir"), F.col("name").alias("to_name")), "id").drop("id")
    return tables.move(rows, far.unionByName(over))


_NUMBER = "regexp_replace(CAST(CAST(steps AS DOUBLE) AS VARCHAR), '\\.0$', '')"


@query(f"""WITH {MEDIA_SQL} SELECT id, {_NUMBER} AS steps, width || 'x' || height AS size, strftime(CAST(to_timestamp(mtime / 1000) AT TIME ZONE 'UTC' AS DATE), '%Y-%m-%d') AS day, 'doc_0' || lpad(CAST(length(CAST(id AS VARCHAR)) AS VARCHAR), 10, '0') || id AS number FROM media""")
def normal_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facet values, days and natural order keys."""
    rows = media(spark, sf_dir)
    size = T.facet_value(F.lit("size"), F.concat("width", F.lit(" × "), "height"))
    return rows.select("id", T.facet_value(F.lit("steps"), F.concat("steps", F.lit(".0"))).alias("steps"), size.alias("size"), F.date_format(F.timestamp_millis("mtime"), "yyyy-MM-dd").alias("day"), T.natural_key(F.col("name")).alias("number"))


_STEP = "regexp_replace(printf('%.6f', CAST(id % 12 / 8.0 AS DOUBLE)), '\\.?0+$', '')"


@query(f"WITH {MEDIA_SQL} SELECT id, 'file_' || id AS short, {_STEP} AS number, CASE WHEN id % 2 = 0 THEN 1.25 ELSE 1.0 END AS weight, 'a' || id || ':' || coalesce(CASE WHEN id % 3 > 0 THEN printf('%.1f', CAST(id % 3 AS DOUBLE)) END, '-') || ',b:-' AS tags, 'my model ' || id AS key FROM media")
def text_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Short names, numbers, written weights, tags, model keys."""
    i = F.col("id")
    prompt = F.concat(F.lit("(Red fox"), F.when(i % 2 == 0, ":1.25").otherwise(""), F.lit("), <lora:a"), i, F.lit(":"), F.when(i % 3 > 0, (i % 3).cast("string")).otherwise("x"), F.lit("> <lyco: b > <lora:a"), i, F.lit(":9> <wild:c:1>"))
    tags = F.array_join(F.transform(T.lora_tags(prompt), lambda x: F.concat(x["name"], F.lit(":"), F.when(x["weight"].isNull(), "-").otherwise(F.format_string("%.1f", x["weight"])))), ",")
    path = F.concat(F.lit("C:\\models/sub\\file_"), i, F.lit(".safetensors"))
    key = T.model_key(F.concat(F.lit(" dir/My Model "), i, F.lit(".CKPT [ab12F] ")))
    return media(spark, sf_dir).select("id", T.short_name(path).alias("short"), T.number_text(i % 12 / 8).alias("number"), T.written_weight(prompt, F.lit("red FOX")).alias("weight"), tags.alias("tags"), key.alias("key"))


@query(f"WITH {MEDIA_SQL} SELECT id, CAST(CASE WHEN id % 3 = 0 THEN 640 ELSE width END AS INTEGER) AS width, CAST(CASE WHEN id % 3 = 0 THEN 480 ELSE height END AS INTEGER) AS height, steps, CAST(1 + (id % 19) * 0.5 AS DOUBLE) AS cfg FROM media")
def recipe_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Size, steps and scale of a recipe, whatever they are written under."""
    size = F.when(F.col("id") % 3 == 0, F.array(F.struct(F.lit("SIZE").alias("key"), F.lit("640 × 480").alias("value")))).otherwise(F.array().cast("array<struct<key:string,value:string>>"))
    rows = media(spark, sf_dir).withColumn("params", F.concat("params", size))
    return rows.select("id", T.recipe_size(F.col("params"), F.col("width"), F.col("height")).alias("s"), T.recipe_steps(F.col("params")).alias("steps"), T.recipe_cfg(F.col("params")).alias("cfg")).select("id", "s.*", "steps", "cfg")


@query("SELECT event_id, CASE WHEN event_id % 7 IN (0, 1) THEN 0 WHEN event_id % 7 = 2 THEN 1 END AS kind FROM events")
def media_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pictures and films by their file ending; hidden files and others are neither."""
    names = F.array(*[F.lit(x) for x in ("a.PNG", "b.jxl", "c.d.MKV", ".e.png", "f.txt", "png", "g.png.bak")])
    name = F.element_at(names, (F.col("event_id") % 7 + 1).cast("int"))
    return table(spark, sf_dir, "events").select("event_id", files.media_kind(name).alias("kind"))


@query(f"WITH {MEDIA_SQL} SELECT id FROM media WHERE kind = 0 AND (id % 4 <> 1 OR id % 12 = 1)")
def prints_pending(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pictures without a fingerprint, not even one that failed, by content key."""
    rows = media(spark, sf_dir).where("kind = 0")
    path = F.concat("dir", F.lit("/"), "name")
    done = rows.where("id % 4 = 1").select(T.content_key(path, F.col("mtime"), F.col("size")).alias("key"))
    now = rows.withColumn("mtime", F.when(F.col("id") % 12 == 1, F.col("mtime") + 1).otherwise(F.col("mtime")))
    return tables.pending(now.withColumn("key", T.content_key(path, F.col("mtime"), F.col("size"))), done).select("id")


@query(
    """WITH n AS (SELECT o_custkey AS c, 'r' || o_orderpriority AS k, o_totalprice AS v FROM orders) SELECT k AS kind, count(*) AS uses, count(DISTINCT c) AS users, round(sum(v), 2) AS total FROM n GROUP BY k
UNION ALL SELECT 'f' || l_returnflag, count(*), count(DISTINCT l_suppkey), round(sum(l_extendedprice), 2) FROM lineitem GROUP BY l_returnflag"""
)
def star_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G2 over the star schema: grouped counts, users and totals."""
    o = table(spark, sf_dir, "orders").groupBy(F.concat(F.lit("r"), "o_orderpriority").alias("kind")).agg(F.count("*").alias("uses"), F.countDistinct("o_custkey").alias("users"), F.round(F.sum("o_totalprice"), 2).alias("total"))
    li = table(spark, sf_dir, "lineitem").groupBy(F.concat(F.lit("f"), "l_returnflag").alias("kind")).agg(F.count("*").alias("uses"), F.countDistinct("l_suppkey").alias("users"), F.round(F.sum("l_extendedprice"), 2).alias("total"))
    return o.unionByName(li)
