"""Exact deduplication over a stream of documents, with keyed state on disk.

Two texts are equal if they are the same bytes after whitespace (space and U+0009 to
U+000D) is deleted. `absorb` runs a structured stream over a folder or file of documents:
its state, kept in RocksDB under the stream's checkpoint and never expired, holds for each
digest the row to keep (stable identifier and content locator: file and row index) and how
many rows have come. Copies are combined before the shuffle, so a group that holds a third
of all rows sends one row a task to its key. Run again with the same checkpoint, it goes on
with the files that have arrived since; a lost executor's state is rebuilt from the checkpoint.

`decide` holds each hit's full bytes against the content that its digest's locator names,
and gives every document its decision. The content of a large group is laid out once for
every SALT of its copies, so that no task compares more of them. Should different texts
share a digest, their rows are told apart by the texts themselves.

Defined results: null counts as empty, and texts of whitespace only equal the empty text. Of equal
texts the row with the most code points in the original stays, then the one with the smallest
doc_id (null last), then the first by file and row index: exactly one row of a group has
`kept`, however often ids repeat. An empty table gives an empty result. Other columns, of whatever
name, aren't read. Both functions run jobs when they are called.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import fresh, stored

#: Copies that are compared with one laid-out content; digests with more than one row in HOT take a broadcast, HOT at most.
SALT, HOT = 1000, 256
_DISK = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",  # small stores else take 4 MB each
}


def sha256(sha: Column) -> Column:
    """The digest that state is keyed by, from the hexadecimal SHA-256 of the normal text: all of it."""
    return F.unhex(sha)


def normal(text: Column) -> Column:
    for space in " \t\n\x0b\x0c\r":
        text = F.replace(text, F.lit(space), F.lit(""))
    return text


def contents(docs: DataFrame, digest: Callable[[Column], Column] = sha256) -> DataFrame:
    """(digest, sha, row, plain) of each row of a file source, batch or stream; the least `row` of equal texts is the one to keep."""
    text = F.coalesce("text", F.lit(""))
    row = F.struct((-F.length(text)).alias("size"), F.col("doc_id").isNull().alias("void"), "doc_id", F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("at"))
    plain = docs.select(normal(text).alias("plain"), row.alias("row"))
    return plain.withColumn("sha", F.sha2("plain", 256)).select(digest(F.col("sha")).alias("digest"), "sha", "row", "plain")


def absorb(spark: SparkSession, path: str, checkpoint: str, digest: Callable[[Column], Column] = sha256, per_batch: int = 256 << 30) -> DataFrame:
    """(digest, keep, n) of all rows that the stream over `path` has seen up to now; `per_batch` bounds the bytes of a micro-batch."""
    own = spark.newSession()  # the settings of the state store stay out of the caller's session
    for k, v in _DISK.items():
        own.conf.set(k, v)
    schema = spark.read.parquet(path).select("doc_id", "text").schema
    source = own.readStream.schema(schema).option("maxBytesPerTrigger", per_batch).parquet(f"{path[:-1]}[{path[-1]}]")  # a pattern, as a stream takes no single file
    groups = contents(source, digest).groupBy("digest").agg(F.min("row").alias("keep"), F.count("*").alias("n"))
    query = groups.writeStream.format("noop").outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    held = own.read.format("statestore").load(checkpoint).select("key.*", "value.*").toDF("digest", "keep", "n")
    at = fresh(spark, "digests")
    held.write.parquet(at)
    return spark.read.schema(held.schema).parquet(at)


def _met(rows: DataFrame, groups: DataFrame, total: int) -> DataFrame:
    """Each row with `keep` and `n` of its digest, or nulls. Digests of more than a HOT-th of all rows, HOT at most, are broadcast, and their rows dealt by place instead of digest."""
    hot = groups.where(F.col("n") * HOT > total).select("digest", F.struct("keep", "n").alias("hot"))
    rest = groups.where(F.col("n") * HOT <= total).select(F.col("digest").alias("key"), F.struct("keep", "n").alias("rest"))
    near = rows.join(F.broadcast(hot), "digest", "left")
    key = F.when(F.col("hot").isNull(), F.col("digest")).otherwise(F.unhex(F.sha2(F.concat_ws(":", "row.file", "row.at"), 384)))  # 48 bytes: no digest has as many
    near = near.withColumn("key", key)
    found = near.join(rest, "key", "left").withColumn("found", F.coalesce("hot", "rest"))
    return found.select(*rows.columns, "found.keep", "found.n")


def mismatched(docs: DataFrame, groups: DataFrame, digest: Callable[[Column], Column] = sha256) -> DataFrame:
    """Digests under which some row's bytes differ from the content that the locator names."""
    total = groups.agg(F.sum("n")).first()[0] or 0
    rows = _met(contents(docs, digest).select("digest", "row", "plain"), groups.where("n > 1"), total).where("n > 1")
    here = (F.col("row.file") == F.col("keep.file")) & (F.col("row.at") == F.col("keep.at"))
    most = F.floor(F.col("n") / SALT)
    own = F.array(F.pmod(F.xxhash64("row.file", "row.at"), most + 1))
    rows = rows.select("digest", "plain", here.alias("here"), F.explode(F.when(here, F.sequence(F.lit(0).cast("long"), most)).otherwise(own)).alias("salt"))
    content = F.first("plain").over(Window.partitionBy("digest", "salt").orderBy(F.desc("here")))
    return rows.select("digest", (F.col("plain") != content).alias("other")).where("other").select("digest").distinct()


def decide(docs: DataFrame, groups: DataFrame, digest: Callable[[Column], Column] = sha256) -> DataFrame:
    """doc_id, keep_id, group_size, kept and the text's SHA-256 of every document; `docs` reads the files that `absorb` has seen."""
    bad = stored(mismatched(docs, groups, digest), "mismatched")
    rows = stored(contents(docs, digest).select("digest", "sha", "row"), "rows")
    if not bad.isEmpty():  # the texts themselves tell these rows apart
        shared = contents(docs, digest).join(bad, "digest")
        exact = stored(shared.groupBy("digest", "plain").agg(F.min("row").alias("keep"), F.count("*").alias("n"), F.min("sha").alias("sha")), "exact")
        apart = shared.select("digest", "plain", "row").join(exact.select("digest", "plain", "keep", "n", "sha"), ["digest", "plain"]).select("digest", "sha", "row", "keep", "n")
        rows, groups = rows.join(bad, "digest", "left_anti"), groups.join(bad, "digest", "left_anti")
    total = groups.agg(F.sum("n")).first()[0] or 0
    met = _met(rows, groups, total)
    if not bad.isEmpty():
        met = met.unionByName(apart)
    kept = (F.col("row.file") == F.col("keep.file")) & (F.col("row.at") == F.col("keep.at"))
    return met.select("row.doc_id", F.col("keep.doc_id").alias("keep_id"), F.col("n").alias("group_size"), kept.alias("kept"), F.col("sha").alias("text_sha256"))


def dedup(spark: SparkSession, path: str, digest: Callable[[Column], Column] = sha256) -> DataFrame:
    """Absorb a table of documents with a checkpoint of its own in the shared folder, then decide on all of its rows."""
    groups = absorb(spark, path, fresh(spark, "dedup-state", ""), digest)
    return decide(spark.read.parquet(path), groups, digest)
