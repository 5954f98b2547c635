"""Media files, notes files and word lists as tables.

Defined results: hidden files and folders, and files of other kinds, are not listed; a notes file
that can't be read is an error, a missing one is no notes; of saved views of one name the first counts;
comments and empty lines of a word list are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# File endings of pictures and of films.
IMAGES, VIDEOS = ("png", "jpg", "jpeg", "webp", "gif", "bmp", "jxl"), ("mp4", "webm", "mov", "mkv", "m4v")
# The words of levels set by hand, from 1 on.
LEVELS = ("g", "pg", "pg13", "r", "nc17")
NOTES = "images map<string, struct<rating:int, flag:string, collections:array<string>, audience:string>>, smart array<struct<name:string, query:string>>"


def media_kind(name: Column) -> Column:
    """0 for pictures, 1 for films, null for anything else and for hidden files."""
    ending = F.lower(F.regexp_extract(name, r"\.([^.]+)$", 1))
    return F.when(name.startswith("."), None).when(ending.isin(*IMAGES), 0).when(ending.isin(*VIDEOS), 1)


def listing(spark: SparkSession, root: str, recursive: bool = True) -> DataFrame:
    """(dir, name, size, mtime, kind) of the media files below a folder; contents aren't read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(root).select("path", "modificationTime", "length")
    name = F.regexp_extract("path", "([^/]*)$", 1)
    out = files.select(F.regexp_replace(F.regexp_extract("path", "^(.*)/[^/]*$", 1), "^[a-z]+:/*", "/").alias("dir"), name.alias("name"), F.col("length").alias("size"), F.unix_millis("modificationTime").alias("mtime"), media_kind(name).alias("kind"))
    return out.where(F.col("kind").isNotNull() & ~F.col("dir").rlike(r"/\.[^/]"))


def notes(spark: SparkSession, paths: list[str] | str) -> DataFrame:
    """(dir, name, rating, flag, collections, audience) of notes files; audience is 0 where no level is set by hand."""
    read = spark.read.schema(NOTES).option("multiLine", True).option("mode", "FAILFAST").json(paths)
    each = read.select(F.regexp_extract(F.input_file_name(), "^(.*)/[^/]*$", 1).alias("dir"), F.explode("images").alias("name", "n"))
    flag = F.coalesce(*[F.when(F.col("n.flag") == w, F.lit(k)) for k, w in ((1, "keep"), (2, "reject"))], F.lit(0))
    return each.select(F.regexp_replace("dir", "^[a-z]+:/*", "/").alias("dir"), "name", F.coalesce("n.rating", F.lit(0)).alias("rating"), flag.alias("flag"), F.coalesce("n.collections", F.array().cast("array<string>")).alias("collections"), F.coalesce(*[F.when(F.regexp_replace(F.lower("n.audience"), "[^a-z0-9]", "") == w, F.lit(k + 1)) for k, w in enumerate(LEVELS)], F.lit(0)).alias("audience"))


def views(spark: SparkSession, paths: list[str] | str) -> DataFrame:
    """(dir, name, query) of the saved views in notes files; of one name in a folder, in any letter case, the first."""
    read = spark.read.schema(NOTES).option("multiLine", True).option("mode", "FAILFAST").json(paths)
    each = read.select(F.regexp_replace(F.regexp_extract(F.input_file_name(), "^(.*)/[^/]*$", 1), "^[a-z]+:/*", "/").alias("dir"), F.posexplode("smart").alias("at", "s"))
    first = F.row_number().over(Window.partitionBy("dir", F.lower("s.name")).orderBy("at"))
    return each.where("s.name <> '' and s.query is not null").withColumn("_k", first).where("_k = 1").select("dir", "s.name", "s.query")


def word_list(spark: SparkSession, paths: list[str] | str) -> DataFrame:
    """(word) of lists with one entry a line."""
    return spark.read.text(paths).select(F.trim("value").alias("word")).where("word <> '' and not startswith(word, '#')")
