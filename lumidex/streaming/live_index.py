"""A live index: a file stream of change records, kept as a base table and a log of small batches.

Each micro-batch writes its own records only, one for a path, filed by a bucket of (dir, name); the index is
merged from base and log when it is read. After every `COMPACT` batches the merged rows become
the new base, a table filed and sorted by (dir, name), so that merging deals out the log and reads the base as
it lies. The state is in these folders alone, so a restart goes on from them. A batch that is run again
writes the same records to the same place; one that a base holds already is passed over. A base
or batch counts when its writer has committed it, and an older base is removed one compaction later.

Defined results: of several records for a path in a batch the newest counts, of equal times that of the
greater id; a path keeps the id of its first record since it was last removed; a folder's removal takes what
earlier batches put below it, and of its own batch what is older than itself; records without a folder or
of another action are ignored; an empty batch changes nothing; without any batch the index is empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.works import ancestors
from ..sources import index_table

CHANGES = "id long, dir string, name string, size long, mtime long, action string"
ROWS = "id long, dir string, name string, size long, mtime long"
COMPACT, BUCKETS = 16, 16
KEY = ["dir", "name"]


def _numbers(spark: SparkSession, root: str, kind: str) -> list[int]:
    """Numbers of the complete batches (`log`) or bases (`base`), ascending."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/{kind}")
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return []
    done = lambda s: fs.exists(spark._jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS"))
    return sorted(int(s.getPath().getName()) for s in fs.listStatus(path) if s.getPath().getName().isdigit() and done(s))


def _remove(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def _below(rows: DataFrame, trees: DataFrame) -> DataFrame:
    """(dir, ...) of the folders of `rows` that lie below one of `trees` (tree, ...), told by equality with an ancestor."""
    up = rows.select("dir").distinct().select("dir", F.explode(ancestors(F.col("dir"))).alias("tree"))
    return up.join(trees, "tree").drop("tree")


def reduced(batch: DataFrame) -> DataFrame:
    """The records of a batch that count: one `put` or `gone` for a path, one `tree` for a folder."""
    batch = batch.where("dir is not null and action in ('put', 'gone', 'tree')")
    last = batch.where("action <> 'tree'").groupBy(*KEY).agg(F.max_by(F.struct("id", "size", "mtime", "action"), F.struct("mtime", "id")).alias("x")).select(*KEY, "x.*")
    trees = batch.where("action = 'tree'").groupBy("dir").agg(F.max("mtime").alias("mtime"))
    cut = _below(last, trees.select(F.col("dir").alias("tree"), F.col("mtime").alias("cut"))).groupBy("dir").agg(F.max("cut").alias("cut"))
    last = last.join(cut, "dir", "left").where("cut is null or mtime >= cut").drop("cut")
    told = trees.select(F.lit(None).cast("long").alias("id"), "dir", F.lit("").alias("name"), F.lit(None).cast("long").alias("size"), "mtime", F.lit("tree").alias("action"))
    return last.select(told.columns).unionByName(told)


def append(spark: SparkSession, root: str, batch: DataFrame, number: int, buckets: int = BUCKETS) -> bool:
    """Log a batch; false if a base holds it already."""
    if number <= max(_numbers(spark, root, "base"), default=-1):
        return False
    bucket = F.pmod(F.xxhash64(*KEY), F.lit(buckets)).cast("int").alias("bucket")
    filed = reduced(batch).select("*", bucket).hint("rebalance", "bucket").sortWithinPartitions("bucket", *KEY)
    filed.write.mode("overwrite").partitionBy("bucket").parquet(f"{root}/log/{number}")
    return True


def _log(spark: SparkSession, root: str, after: int, upto: int | None) -> DataFrame | None:
    out = None
    for k in _numbers(spark, root, "log"):
        if k > after and (upto is None or k <= upto):
            part = spark.read.schema(f"{CHANGES}, bucket int").parquet(f"{root}/log/{k}").withColumn("at", F.lit(2 * k).cast("long"))
            out = part if out is None else out.unionByName(part)
    return out


def _alive(puts: Column, gone: Column, tree: Column) -> Column:
    """The records of a path since it was last removed; a folder's removal stands just before the records of its batch."""
    return F.filter(puts, lambda p: (p["at"] > F.coalesce(gone, F.lit(-1))) & (p["at"] > F.coalesce(tree, F.lit(-2))))


def state(spark: SparkSession, root: str, upto: int | None = None) -> DataFrame:
    """The index after the last batch, or after batch `upto`: base and log, merged by path."""
    base = max((k for k in _numbers(spark, root, "base") if upto is None or k <= upto), default=None)
    log = _log(spark, root, -1 if base is None else base, upto)
    old = spark.createDataFrame([], ROWS) if base is None else index_table.load(spark, f"{root}/base/{base}", ROWS, BUCKETS)
    if log is None:
        return old.select("id", *KEY, "size", "mtime")
    trees = log.where("action = 'tree'").groupBy(F.col("dir").alias("tree")).agg((F.max("at") - 1).alias("cut"))
    paths = log.where("action <> 'tree'")
    # a path has one record a batch, so no list is longer than the batches since the base
    record = F.struct("at", "id", "size", "mtime")
    each = paths.groupBy(*KEY).agg(F.array_sort(F.collect_list(F.when(F.col("action") == "put", record))).alias("puts"), F.max(F.when(F.col("action") == "gone", F.col("at"))).alias("gone"))
    own = F.struct("id", "size", "mtime").alias("old")
    both = old.select(*KEY, own).join(each, KEY, "full_outer")
    if trees.isEmpty():
        both = both.withColumn("cut", F.lit(None).cast("long"))
    else:
        both = both.join(_below(old.select("dir").unionByName(paths.select("dir")), trees).groupBy("dir").agg(F.max("cut").alias("cut")), "dir", "left")
    there = F.col("old").isNotNull() & F.col("gone").isNull() & F.col("cut").isNull()
    puts = _alive(F.coalesce("puts", F.array().cast("array<struct<at:bigint,id:bigint,size:bigint,mtime:bigint>>")), F.col("gone"), F.col("cut"))
    both = both.withColumn("there", there).withColumn("puts", puts)
    first, last = F.get("puts", F.lit(0)), F.get("puts", F.size("puts") - 1)
    of = lambda c: F.coalesce(last[c], F.when(F.col("there"), F.col(f"old.{c}"))).alias(c)
    alive = both.where(F.col("there") | (F.size("puts") > 0))
    return alive.select(F.when(F.col("there"), F.col("old.id")).otherwise(first["id"]).alias("id"), *KEY, of("size"), of("mtime"))


def latest(spark: SparkSession, root: str) -> DataFrame:
    return state(spark, root)


def compact(spark: SparkSession, root: str, buckets: int = BUCKETS) -> int | None:
    """Make a base of all complete batches; gives its number, or none if there is nothing new. The base before it and the batches it held go."""
    bases, logs = _numbers(spark, root, "base"), _numbers(spark, root, "log")
    old, new = max(bases, default=-1), max(logs, default=-1)
    if new <= old:
        return None
    index_table.save(state(spark, root, new), f"{root}/base/{new}", buckets)
    for k in bases[:-1]:
        index_table.forget(spark, f"{root}/base/{k}")
        _remove(spark, f"{root}/base/{k}")
    for k in logs:
        if k <= old:
            _remove(spark, f"{root}/log/{k}")
    return new


def follow(spark: SparkSession, source: str, root: str, checkpoint: str, every: int = COMPACT) -> StreamingQuery:
    """Log the records of new files in `source`; of every `every` batches a base is made."""

    def apply(batch: DataFrame, number: int) -> None:
        session = batch.sparkSession
        append(session, root, batch, number)
        base = max(_numbers(session, root, "base"), default=-1)
        if number - base >= every:
            compact(session, root)

    stream = spark.readStream.schema(CHANGES).json(source)
    return stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def still_there(records: DataFrame, files: DataFrame) -> DataFrame:
    """Records whose file hasn't vanished while they were read."""
    return records.join(files.select("dir", "name"), ["dir", "name"], "left_semi")
