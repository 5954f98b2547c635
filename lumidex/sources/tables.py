"""The canonical media table, made from the star schema and the documents, labels and parts.

Defined results: labels of a repeated id count once (by their least quality and greatest
toxicity), so no document is doubled; documents without text have an empty prompt; ids of
any length keep all their digits in names; an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FIRST_MS, STEP_MS = 1_700_000_000_000, 9_137_000
SAMPLERS, SCHEDULERS = ("Euler a", "DPM++ 2M", "DDIM", "UniPC"), ("karras", "Simple")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(rows: DataFrame) -> DataFrame:
    """Rows of a table of fewer files or row groups than there are cores, dealt out to all of them; larger tables stay as they are."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores) if rows.rdd.getNumPartitions() < cores else rows


def media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document: file columns, prompt, settings, and marks from a left join that leaves no null behind.

    The part and label tables are dimensions; whether they are broadcast is left to their size.
    """
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source", "n_chars"))
    part = table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_type", "p_size")
    n = part.count()
    labels = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("toxic").alias("toxic"))
    out = docs.withColumn("p_partkey", F.col("doc_id") % n + 1).join(part, "p_partkey", "left").join(labels, "doc_id", "left")
    rating = F.when(F.col("quality").isNull(), 0).when((F.col("quality") == 1) & (F.col("toxic") == 0), 5).when(F.col("quality") == 1, 2).when(F.col("toxic") == 0, 3).otherwise(1)
    i = F.col("doc_id")
    pick = lambda names, k: F.element_at(F.array(*map(F.lit, names)), (k % len(names) + 1).cast("int"))
    named = lambda a, b, x, y: F.struct(F.lit(x).alias(a), y.alias(b))
    only = lambda condition, item, type_: F.when(condition, F.array(item)).otherwise(F.array().cast(f"array<struct<{type_}>>"))
    brand, type_ = F.coalesce("p_brand", F.lit("")), F.coalesce("p_type", F.lit(""))
    cfg = (F.lit(1.0) + (i % 19) * 0.5).cast("string")
    lora = lambda name, weight: F.struct(name.alias("name"), weight.cast("double").alias("weight"))
    return out.select(
        i.alias("id"),
        F.concat(F.lit("/lib/"), "lang", F.lit("/"), "source").alias("dir"),
        F.concat(F.lit("doc_"), F.lpad(i.cast("string"), F.greatest(F.lit(6), F.length(i.cast("string"))), F.lit("0"))).alias("name"),
        F.col("n_chars").alias("size"),
        (FIRST_MS + i * STEP_MS).alias("mtime"),
        F.when(i % 10 == 0, 1).otherwise(0).alias("kind"),
        (512 + 64 * (i % 8)).cast("int").alias("width"),
        (512 + 64 * (i % 5)).cast("int").alias("height"),
        "source",
        (i * 7919 + 11).cast("string").alias("seed"),
        F.lower(F.coalesce("text", F.lit(""))).alias("prompt"),
        F.lower(type_).alias("negative"),
        F.lower(brand).alias("model"),
        F.coalesce("p_size", F.lit(0)).alias("steps"),
        F.concat(F.array(named("kind", "name", "main", brand)), only(i % 3 == 0, named("kind", "name", "vae", F.concat(F.lit("VAE-"), (i % 4).cast("string"))), "kind:string,name:string")).alias("models"),
        F.concat(F.array(lora(type_, F.when(i % 6 != 5, (i % 7 + 1) / 8))), only(i % 5 == 0, lora(F.lit("Detail  Tweaker"), F.lit(0.5)), "name:string,weight:double")).alias("loras"),
        F.concat(F.array(named("key", "value", "Steps", F.concat(F.coalesce("p_size", F.lit(0)).cast("string"), F.lit(".0"))), named("key", "value", "CFG scale", cfg), named("key", "value", "Sampler", pick(SAMPLERS, i))), only(i % 2 == 0, named("key", "value", "Scheduler", pick(SCHEDULERS, F.floor(i / 2))), "key:string,value:string")).alias("params"),
        F.filter(F.array(F.when(rating == 5, F.when(i % 7 == 0, "best").otherwise("Best")), F.when(i % 6 == 0, "To Print"), F.when(i % 11 == 0, "Späße")), lambda c: c.isNotNull()).alias("collections"),
        rating.alias("rating"),
        F.when(rating == 5, 1).when(rating == 1, 2).otherwise(0).alias("flag"),
    )


_PICK = lambda names, k: f"list_extract([{', '.join(repr(n) for n in names)}], CAST({k} % {len(names)} + 1 AS BIGINT))"
_NUM = lambda x: f"regexp_replace(printf('%.6f', CAST({x} AS DOUBLE)), '\\.?0+$', '')"
_FACET = lambda kind, value, role="''": f"{{'kind': '{kind}', 'key': lower({value}), 'value': {value}, 'role': {role}}}"
_TYPE = "trim(regexp_replace(coalesce(p.p_type, ''), '\\s+', ' ', 'g'))"

#: The same table in SQL, for the checks, with facets in their normal form.
MEDIA_SQL = f"""marks AS (SELECT doc_id, min(quality) AS quality, max(toxic) AS toxic FROM labels GROUP BY doc_id), media AS (
SELECT d.doc_id AS id, '/lib/' || d.lang || '/' || d.source AS dir, 'doc_' || lpad(CAST(d.doc_id AS VARCHAR), greatest(6, CAST(length(CAST(d.doc_id AS VARCHAR)) AS INTEGER)), '0') AS name,
 d.n_chars AS size, {FIRST_MS} + d.doc_id * {STEP_MS} AS mtime, CASE WHEN d.doc_id % 10 = 0 THEN 1 ELSE 0 END AS kind,
 CAST(512 + 64 * (d.doc_id % 8) AS INTEGER) AS width, CAST(512 + 64 * (d.doc_id % 5) AS INTEGER) AS height, d.source, CAST(d.doc_id * 7919 + 11 AS VARCHAR) AS seed,
 lower(coalesce(d.text, '')) AS prompt, lower(coalesce(p.p_type, '')) AS negative, lower(coalesce(p.p_brand, '')) AS model, coalesce(p.p_size, 0) AS steps,
 list_filter(list_distinct(list_concat([{_FACET('model', "coalesce(p.p_brand, '')")}], CASE WHEN d.doc_id % 3 = 0 THEN [{_FACET('aux', "'VAE-' || (d.doc_id % 4)", "'vae'")}] ELSE [] END,
 [{_FACET('lora', _TYPE)}], CASE WHEN d.doc_id % 5 = 0 THEN [{_FACET('lora', "'Detail Tweaker'")}, {_FACET('loraw', "'Detail Tweaker@0.5'")}] ELSE [] END,
 CASE WHEN d.doc_id % 6 <> 5 THEN [{_FACET('loraw', _TYPE + " || '@' || " + _NUM('round((d.doc_id % 7 + 1) / 8.0::DOUBLE, 2)'))}] ELSE [] END,
 [{_FACET('sampler', _PICK(SAMPLERS, 'd.doc_id'))}], CASE WHEN d.doc_id % 2 = 0 THEN [{_FACET('scheduler', _PICK(SCHEDULERS, 'd.doc_id // 2'))}] ELSE [] END,
 [{_FACET('steps', _NUM('coalesce(p.p_size, 0)'))}, {_FACET('cfg', _NUM('1 + (d.doc_id % 19) * 0.5'))}, {_FACET('size', "(512 + 64 * (d.doc_id % 8)) || 'x' || (512 + 64 * (d.doc_id % 5))")}, {_FACET('source', 'd.source')}])), lambda x: x.value <> '') AS facets,
 array_to_string(list_filter([lower(coalesce(p.p_brand, '')), CASE WHEN d.doc_id % 3 = 0 THEN 'vae-' || (d.doc_id % 4) END], lambda x: x <> ''), chr(10)) AS models_text,
 lower(coalesce(p.p_type, '')) || CASE WHEN d.doc_id % 5 = 0 THEN chr(10) || 'detail  tweaker' ELSE '' END AS loras_text,
 lower(array_to_string([d.source, CAST(d.doc_id * 7919 + 11 AS VARCHAR), 'Steps: ' || coalesce(p.p_size, 0) || '.0', 'CFG scale: ' || CAST(1 + (d.doc_id % 19) * 0.5 AS DOUBLE), 'Sampler: ' || {_PICK(SAMPLERS, 'd.doc_id')}, CASE WHEN d.doc_id % 2 = 0 THEN 'Scheduler: ' || {_PICK(SCHEDULERS, 'd.doc_id // 2')} END], chr(10))) AS settings_text,
 list_filter([CASE WHEN l.quality = 1 AND l.toxic = 0 THEN CASE WHEN d.doc_id % 7 = 0 THEN 'best' ELSE 'Best' END END, CASE WHEN d.doc_id % 6 = 0 THEN 'To Print' END, CASE WHEN d.doc_id % 11 = 0 THEN 'Späße' END], lambda c: c IS NOT NULL) AS collections,
 CASE WHEN l.quality IS NULL THEN 0 WHEN l.quality = 1 AND l.toxic = 0 THEN 5 WHEN l.quality = 1 THEN 2 WHEN l.toxic = 0 THEN 3 ELSE 1 END AS rating,
 CASE WHEN l.quality = 1 AND l.toxic = 0 THEN 1 WHEN l.quality = 0 AND l.toxic = 1 THEN 2 ELSE 0 END AS flag
FROM documents d LEFT JOIN part p ON p.p_partkey = d.doc_id % (SELECT count(*) FROM part) + 1 LEFT JOIN marks l ON l.doc_id = d.doc_id)"""
